"""Chunks across a document's pages, cut in parallel within each document.

A chunk starts where the one before ends, so a document's cuts are a chain.  The document is dealt as segments of ``SEGMENT``
characters (and as many more as a chunk may reach).  Where the chain enters a segment is not known, but it is one of its first
``size`` characters: each segment follows the chain from all of them (they soon meet) and gives the place at which each
leaves it.  A document's segments are then passed through by looking up one number in each, and with its true entry each
segment cuts its chunks.  No row holds a whole document.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written
from .text import CHUNK, boundary, sliced

SEGMENT = 65_536
# A heading line, and what its beginning may look like.
HEADING_LINE = re.compile(r"\s*(?:[IVXLCDM]+\.\s+|[0-9]+(?:\.[0-9]+)*\s+)?([A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ0-9 /,\-]{4,})\s*")
HEADING_START = re.compile(r"[\sA-ZÁÉÍÓÚÑ0-9 /,\-.]*")
#: Pages of a document are joined by this.
BETWEEN = "\n\n"


def heading(line: str) -> str | None:
    m = HEADING_LINE.fullmatch(line)
    return m[1].strip() if m else None


def following(text: str, start: int, size: int, overlap: int, total: int) -> tuple[int, int]:
    """(end, next start) of the chunk that starts at ``start``; the next start is -1 at the end of a document of ``total`` characters."""
    end = min(start + size, total)
    if end < total:
        end = boundary(text, start, end)
    return end, -1 if end >= total else max(end - overlap, end - 1, start + 1)


def exits(text: str, entries: int, size: int, overlap: int, total: int, segment: int) -> list[int]:
    """Where the chain from each of the first ``entries`` characters leaves the segment, from the segment's end on; -1 if the document ends first."""
    known: dict[int, int] = {}
    for entry in range(entries):
        path, at = [], entry
        while at not in known and 0 <= at < min(segment, total):
            path.append(at)
            at = following(text, at, size, overlap, total)[1]
        out = known[at] if at in known else -1 if at < 0 or at >= total else at - segment
        for p in path:
            known[p] = out
    return [known.get(e, e - segment if e < total else -1) for e in range(entries)]


def placed(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, start, total, last, text): each page with its place in the joined text of its document.

    Pages go by number, then by a hash of their text; a page given several times is there as often.
    """
    rows = pages.select(F.col("document_id").cast("string").alias("document_id"), F.col("page_number").cast("int").alias("page_number"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    narrow = rows.select("document_id", "page_number", "h", F.char_length("text").alias("n"))  # texts do not take part in the windows
    narrow = narrow.withColumn("copy", F.row_number().over(W.partitionBy("document_id", "page_number", "h").orderBy("n")))
    order = W.partitionBy("document_id").orderBy("page_number", "h", "copy")
    narrow = narrow.withColumn("start", F.sum(F.col("n") + len(BETWEEN)).over(order.rowsBetween(W.unboundedPreceding, -1)))
    totals = narrow.groupBy("document_id").agg((F.sum(F.col("n") + len(BETWEEN)) - len(BETWEEN)).alias("total"))
    narrow = narrow.withColumn("start", F.coalesce("start", F.lit(0))).join(totals, "document_id").withColumn("last", F.col("start") + F.col("n") == F.col("total"))
    return rows.dropDuplicates(["document_id", "page_number", "h"]).join(narrow.drop("n"), ["document_id", "page_number", "h"]).drop("h", "copy")


def pieces(where: DataFrame, size: int, segment: int) -> DataFrame:
    """(document_id, seg, total, at, page_number, text, line): what each segment needs of each page; line: what a page's line that the segment's start cuts has before it, if that may begin a heading."""
    kind = "document_id string, seg int, total long, at long, page_number int, text string, line string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches, 64):
            rows = []
            for doc, page, start, total, last, text in batch[["document_id", "page_number", "start", "total", "last", "text"]].itertuples(index=False):
                span = text if last else text + BETWEEN
                for seg in range(max(0, (start - size) // segment), (start + len(span) - 1) // segment + 1 if span else 0):
                    low, high = max(seg * segment - start, 0), min((seg + 1) * segment + size - start, len(span))
                    if low < high:
                        line = None
                        if start + low == seg * segment:
                            begin = span.rfind("\n", 0, low) + 1
                            line = span[begin:low] if HEADING_START.fullmatch(span, begin, low) else None
                        rows.append((doc, seg, total, start + low, page, span[low:high], line))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in kind.split(", ")])

    return where.mapInPandas(run, kind)


def headings(where: DataFrame, segment: int) -> DataFrame:
    """(document_id, seg, heads, before): the heading lines that end in each segment, as (end, heading), and the last one before it; segments without any are not there."""
    kind = "document_id string, seg int, at long, heading string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches, 64):
            rows = []
            for doc, start, text in batch[["document_id", "start", "text"]].itertuples(index=False):
                at = start
                for line in text.split("\n"):
                    at += len(line)
                    if len(line) > 4 and (name := heading(line)):
                        rows.append((doc, at // segment, at, name))
                    at += 1
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in kind.split(", ")])

    return where.mapInPandas(run, kind).groupBy("document_id", "seg").agg(F.array_sort(F.collect_list(F.struct("at", "heading"))).alias("heads"))


def entered(segments: DataFrame, size: int, overlap: int, segment: int) -> DataFrame:
    """(document_id, seg, entry) of every segment that a chunk starts in; entry counts from the segment's start."""
    inner = segments.where(F.col("total") > segment)

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches, 64):
            out = [exits(joined(parts), size if seg else 1, size, overlap, total - seg * segment, segment) for seg, total, parts in zip(batch["seg"], batch["total"], batch["parts"])]
            yield pd.DataFrame({"document_id": batch["document_id"], "seg": batch["seg"], "exits": out})

    def passed(rows: pd.DataFrame) -> pd.DataFrame:
        out, entry = [], 0
        for doc, seg, there in rows.sort_values("seg")[["document_id", "seg", "exits"]].itertuples(index=False):
            if entry < 0:
                break
            out.append((doc, seg, entry))
            entry = int(there[entry])
        return pd.DataFrame(out, columns=["document_id", "seg", "entry"])

    maps = inner.mapInPandas(mapped, "document_id string, seg int, exits array<int>")
    found = maps.groupBy("document_id").applyInPandas(passed, "document_id string, seg int, entry int")
    return found.unionByName(segments.where(F.col("total") <= segment).select("document_id", "seg", F.lit(0).alias("entry")).where("seg = 0"))


def joined(parts) -> str:
    return "".join(p["text"] for p in sorted(parts, key=lambda p: p["at"]))


def chunks(pages: DataFrame, size: int = 1200, overlap: int = 1, segment: int = SEGMENT) -> DataFrame:
    """A document's pages joined by an empty line and cut into chunks, with the pages each lies on and the last heading before it.

    Null texts are empty pages; a document without any character but white space has no chunks.  A heading is a line of capitals, or what of it
    stands before the chunk's start.  An empty table gives no rows; other columns are not read.
    """
    segment = max(segment, size)
    where = written(placed(pages), "placed-pages")
    cut = pieces(where, size, segment).groupBy("document_id", "seg", "total").agg(F.collect_list(F.struct("at", "page_number", "text")).alias("parts"), F.max("line").alias("line"))
    segments = written(cut, "segments")  # a segment's pieces, never a document's
    heads = headings(where, segment)
    entries = entered(segments, size, overlap, segment)
    rows = segments.join(entries, ["document_id", "seg"]).join(heads, ["document_id", "seg"], "left")
    kind = "document_id string, seg int, k int, page_start int, page_end int, char_start int, char_end int, hint string, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches, 64):
            out = []
            for doc, seg, total, parts, line, entry, heads in batch[["document_id", "seg", "total", "parts", "line", "entry", "heads"]].itertuples(index=False):
                base, text = seg * segment, joined(parts)
                parts = sorted(parts, key=lambda p: p["at"])
                starts, numbers = [p["at"] - base for p in parts], [p["page_number"] for p in parts]
                ends, names = ([h[c] for h in heads] if heads is not None else [] for c in ("at", "heading"))
                at, k = entry, 0
                while 0 <= at < min(segment, total - base):
                    end, after = following(text, at, size, overlap, total - base)
                    if body := text[at:end].strip():
                        begin = text.rfind("\n", 0, at) + 1
                        cut = heading(text[begin:at]) if begin else heading(line + text[:at]) if line is not None else None
                        last = bisect_right(ends, base + at)
                        out.append((doc, seg, k, numbers[bisect_right(starts, at) - 1], numbers[bisect_right(starts, end - 1) - 1], base + at, base + end, cut or (names[last - 1] if last else None), body))
                        k += 1
                    at = after
            yield pd.DataFrame(out, columns=[c.split()[0] for c in kind.split(", ")])

    found = written(rows.select("document_id", "seg", "total", "parts", "line", "entry", "heads").mapInPandas(run, kind), "chunks-cut")
    # Numbers of chunks, and the last heading of earlier segments, are carried from segment to segment: a few numbers each.
    counts = found.groupBy("document_id", "seg").agg(F.count("*").alias("n"))
    order = W.partitionBy("document_id").orderBy("seg").rowsBetween(W.unboundedPreceding, -1)
    carried = segments.select("document_id", "seg").join(counts, ["document_id", "seg"], "left").join(heads.select("document_id", "seg", F.element_at("heads", -1)["heading"].alias("h")), ["document_id", "seg"], "left")
    carried = carried.select("document_id", "seg", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"), F.last("h", True).over(order).alias("h"))
    n = (F.col("before") + F.col("k")).cast("int")
    out = found.join(carried, ["document_id", "seg"]).select("document_id", F.concat("document_id", F.lit("::"), F.lpad(n.cast("string"), 5, "0")).alias("chunk_id"), n.alias("chunk_index"), "page_start", "page_end", "char_start", "char_end", F.coalesce("hint", "h").alias("section_hint"), "text")
    return out.select(*[c.split()[0] for c in CHUNK.split(", ")])
