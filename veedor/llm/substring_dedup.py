"""Substring dedup by relative Lempel-Ziv parsing: every document is factored against the indexed windows of all documents.

Three steps, each over all rows; numbers travel as packed blobs dealt by hash (see ``exchange``).

1. A window's anchor is the run of words with the least hash in it.  Equal windows have equal anchors, so a window can
   recur only where its anchor does.  Anchors are counted; those met twice or more fill a bitmap of ``filter_bits``
   bits, whose size is its proven bound for the broadcast.  A full bitmap lets more through and loses nothing.
2. The windows around recurring anchors are the reference index.  A task settles what recurs within a flush of texts and
   sends each different window once, so a passage that a third of all documents share is one value a flush.  Where a
   window's hash lands, its reference is the least (doc_id, start) that it has elsewhere.
3. Each document is parsed from left to right: a factor starts at a window with a reference and grows for as long as
   the next window's reference is the next place of the same source, so it is a copy of its source; then the next
   factor starts.  A window that straddles two factors has been looked up itself, so spans are exact at the boundaries.

A window is compared by 96 bits: 64 of its own, 32 of it and its anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import TH, discard, grams, keyed, mix, same_row, slices, tally, words, written

#: Windows and texts of a flush, at most but for one long text.
WINDOWS, TEXTS = 1_000_000, 60_000
ANCHOR, HEADER, LOCAL, WINDOW, REPLY = range(5)
KINDS = {
    ANCHOR: ["u8", "i8"],  # hash, n
    HEADER: ["i8", "i8", "i8", "i8"],  # doc_id, both halves of th, words before the text in the flush
    LOCAL: ["u4", "u4", "i8", "u4"],  # first window, windows, source document, source start
    WINDOW: ["u8", "u4", "i8", "u4", "u4"],  # hash, check, doc_id, start, place in the flush
    REPLY: ["u4", "i8", "u4"],  # place in the flush, source document, source start
}
#: Stands for a null id in packed columns.
NONE = -(2**63)


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """Least or greatest (best: np.minimum or np.maximum) of each run of ``width`` values."""
    have, span = x, 1
    while span * 2 <= width:
        have = best(have[:-span], have[span:])
        span *= 2
    rest = width - span
    return best(have[: len(x) - width + 1], have[rest : rest + len(x) - width + 1])


def anchor_size(window: int) -> int:
    return max(1, window * 16 // 35)


def blocks(h: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, anchor) of each run of windows that share an anchor hash; start counts words over all texts."""
    k = anchor_size(window)
    anchors = grams(h, k, 11)
    n = len(h) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    least = _sliding(anchors, window - k + 1, np.minimum)[:n]
    valid = np.zeros(n, bool)
    for a, b in zip(first[:-1], first[1:]):
        valid[a : max(a, b - window + 1)] = True
    at = np.flatnonzero(valid)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]])
    begin = np.flatnonzero(new)
    return at[begin], np.diff(np.append(begin, len(at))), least[at[begin]]


def occurrences(h: np.ndarray, start: np.ndarray, size: np.ndarray, anchor: np.ndarray, window: int) -> np.ndarray:
    """For each run of blocks(), how many places its windows have the anchor at: several in a text that repeats itself."""
    k = anchor_size(window)
    width = window - k + 1
    anchors = grams(h, k, 11)
    least = np.zeros(len(anchors) + width - 1, np.uint64)
    least[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum()) + width - 1] = np.repeat(anchor, size)
    at = np.flatnonzero(_sliding(least, width, np.maximum) == anchors)  # places that are some window's least
    kinds, kind = np.unique(anchors[at], return_inverse=True)
    places = np.sort(kind.astype(np.int64) * len(h) + at)
    low = np.searchsorted(kinds, anchor).astype(np.int64) * len(h) + start
    return np.searchsorted(places, low + size - 1 + width - 1, side="right") - np.searchsorted(places, low)


def recurring(docs: DataFrame, window: int, bits: int, places: int) -> np.ndarray:
    """The bitmap of anchors that occur twice or more; bits / 8 bytes.  Counts err to more, never to fewer."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in slices(batches):
            w = words(batch.column(2))
            start, size, anchor = blocks(w.hashes, w.first, window)
            if len(start):
                yield np.repeat(anchor, np.minimum(occurrences(w.hashes, start, size, anchor, window), 2)).view(np.int64)

    def counted(batches):
        found = tally(seen(batches), "h")
        return exchange.dealt(((ANCHOR, [b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()]) for b in found), places)

    def twice(place, rows):
        h, n = exchange.gathered(rows, {ANCHOR: KINDS[ANCHOR]})[ANCHOR]
        order = np.argsort(h)
        begin = exchange.groups(h[order])
        if len(begin):
            h, n = h[order][begin], np.add.reduceat(n[order], begin)
            yield exchange.rows([(place, ANCHOR, 0, int((n > 1).sum()), exchange.packed([h[n > 1], n[n > 1]]))])

    table = exchange.met(docs.mapInArrow(counted, exchange.ROWS), places, twice)
    return exchange.bitmap(lambda b: (c[0] for _, c in exchange.unfolded(b, {ANCHOR: KINDS[ANCHOR]})), table, bits)


def _runs(at: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where, sizes) of the runs of windows ``at`` (rising) that are neighbours and have neighbouring sources."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    where = np.flatnonzero(new)
    return where, np.diff(np.append(where, len(at)))


def _asking(batches: Iterator[pa.RecordBatch], window: int, sent, places: int) -> Iterator[pa.RecordBatch]:
    """Of rows (doc_id, th, text) a HEADER for each flush, what recurs within it as LOCAL runs, and each different WINDOW once."""
    held, total, texts = [], 0, 0  # (doc_id, th, words) of texts, (hash, check, doc_id, start, place) of windows

    def out() -> Iterator[pa.RecordBatch]:
        ids, a, b, counts = (np.concatenate(c) for c in zip(*(x[0] for x in held)))
        h, check, doc, start, at = (np.concatenate(c) for c in zip(*(x[1] for x in held)))
        # The flush is named by what is in it: a task that runs again with its rows in another order names other flushes.
        name = xxhash.xxh64(np.concatenate([ids, a, b]).tobytes(), seed=TaskContext.get().partitionId())
        flush = name.intdigest() - (1 << 63)
        yield exchange.rows([(flush % places, HEADER, flush, len(ids), exchange.packed([ids, a, b, np.cumsum(counts) - counts]))])
        if not len(h):
            return
        order = np.argsort(h)
        begin = exchange.groups(h[order])
        size = np.diff(np.append(begin, len(h)))
        first = np.minimum.reduceat(order, begin)
        group = np.empty(len(h), np.int64)
        group[order] = np.repeat(np.arange(len(begin)), size)
        later = np.where(np.arange(len(h)) == first[group], len(h), np.arange(len(h)))
        second = np.minimum.reduceat(later[order], begin)
        source = np.where(later < len(h), first[group], second[group])
        twin = np.flatnonzero(source < len(h))
        source = source[twin]
        where, sizes = _runs(at[twin].astype(np.int64), doc[source], start[source].astype(np.int64))
        if len(where):
            yield exchange.rows([(flush % places, LOCAL, flush, len(where), exchange.packed([at[twin][where], sizes.astype(np.uint32), doc[source][where], start[source][where]]))])
        yield from exchange.dealt(iter([(WINDOW, [c[first] for c in (h, check, doc, start, at)])]), places, flush)

    for batch in slices(batches):
        w = words(batch.column(2))
        start, size, anchor = blocks(w.hashes, w.first, window)
        hit = exchange.in_bitmap(sent.value, anchor)
        start, size, anchor = start[hit], size[hit], anchor[hit]
        ends = np.cumsum(size)
        index = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(start, size)
        h = grams(w.hashes, window, 77)[index] if len(index) else np.zeros(0, np.uint64)
        text = np.searchsorted(w.first, index, side="right") - 1
        ids, th = batch.column(0).fill_null(NONE).to_numpy(zero_copy_only=False), batch.column(1)
        check = (mix(h + np.repeat(anchor, size)) >> np.uint64(32)).astype(np.uint32)
        windows = (h, check, ids[text], (index - w.first[text]).astype(np.uint32), (index + total).astype(np.uint32))
        held.append(((ids, th.field(0).to_numpy(), th.field(1).to_numpy(), w.counts), windows))
        total += len(w.hashes)
        texts += batch.num_rows
        if sum(len(x[1][0]) for x in held) > WINDOWS or texts > TEXTS or total > 1 << 31:
            yield from out()
            held, total, texts = [], 0, 0
    if texts:
        yield from out()


def _answered(place: int, rows: Iterator[exchange.Row]) -> Iterator[pa.RecordBatch]:
    """To each flush the references of the windows that it asked about and that others have too; HEADER and LOCAL rows pass."""
    flushes, sizes, parts = [], [], []
    for kind, flush, n, blob in rows:
        if kind == WINDOW:
            flushes.append(flush)
            sizes.append(n)
            parts.append(exchange.unpacked(blob, n, KINDS[WINDOW]))
        else:
            yield exchange.rows([(0, kind, flush, n, blob.to_pybytes())])
    if not parts:
        return
    h, check, doc, start, at = (np.concatenate(c) for c in zip(*parts))
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(h)
    many = np.zeros(len(h), bool)
    same = h[order][1:] == h[order][:-1]
    many[order[1:][same]] = True
    many[order[:-1][same]] = True
    h, check, doc, start, at, row = (c[many] for c in (h, check, doc, start, at, row))
    order = np.lexsort((start, doc, check, h))
    h, check, doc, start, at, row = (c[order] for c in (h, check, doc, start, at, row))
    begin = exchange.groups(h, check)
    size = np.diff(np.append(begin, len(h)))
    source = np.repeat(begin, size)
    source[begin] = begin + (size > 1)
    found = np.flatnonzero(np.repeat(size > 1, size))
    found = found[np.argsort(row[found], kind="stable")]
    cuts = np.concatenate([[0], np.cumsum(np.bincount(row[found], minlength=len(sizes)))])
    for i, flush in enumerate(flushes):
        mine = found[cuts[i] : cuts[i + 1]]
        if len(mine):
            yield exchange.rows([(0, REPLY, flush, len(mine), exchange.packed([at[mine], doc[source[mine]], start[source[mine]]]))])


FACTORS = "array<struct<start:int,end:int,src_doc:bigint,src_start:int>>"


def _parsed(window: int):
    """The factors of the texts of a flush that have any, from its LOCAL runs and all replies."""
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("src_doc", pa.int64()), ("src_start", pa.int32())])

    def settle(flush: int, rows: Iterator[exchange.Row]) -> Iterator[pa.RecordBatch]:
        of, _, n, blob = next(rows)
        if of != HEADER:
            raise RuntimeError("replies to an unknown flush: a task that ran again gave its rows in another order")
        ids, a, b, before = exchange.unpacked(blob, n, KINDS[HEADER])
        at, doc, start = [], [], []
        for of, _, n, blob in rows:
            if of == LOCAL:
                first, size, d, s = exchange.unpacked(blob, n, KINDS[LOCAL])
                inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                at.append(np.repeat(first.astype(np.int64), size) + inner)
                doc.append(np.repeat(d, size))
                start.append(np.repeat(s.astype(np.int64), size) + inner)
            else:
                x, d, s = exchange.unpacked(blob, n, KINDS[REPLY])
                at.append(x.astype(np.int64))
                doc.append(d)
                start.append(s.astype(np.int64))
        if not at:
            return
        at, doc, start = (np.concatenate(c) for c in (at, doc, start))
        order = np.argsort(at, kind="stable")  # of a window found here and elsewhere, what is here comes first
        begin = order[exchange.groups(at[order])]
        at, doc, start = at[begin], doc[begin], start[begin]
        where, size = _runs(at, doc, start)
        at, doc, start = at[where], doc[where], start[where]
        text = np.searchsorted(before, at, side="right") - 1
        some = exchange.groups(text)
        own = (at - before[text]).astype(np.int32)
        values = [pa.array(own), pa.array(own + size.astype(np.int32) + np.int32(window - 1)), pa.array(doc, mask=doc == NONE), pa.array(start.astype(np.int32))]
        lists = pa.ListArray.from_arrays(np.append(some, len(text)).astype(np.int32), pa.StructArray.from_arrays(values, fields=list(kind)))
        mine = text[some]
        th = pa.StructArray.from_arrays([pa.array(a[mine]), pa.array(b[mine])], ["a", "b"])
        yield pa.RecordBatch.from_arrays([pa.array(ids[mine], mask=ids[mine] == NONE), th, lists], ["doc_id", "th", "factors"])

    return settle


def factored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, filter_bits: int = 1 << 27) -> DataFrame:
    """(doc_id, th, text, factors): every row, with its factors by start (null where it has none), in words.

    A factor's words are those from src_start of src_doc on.  One that starts before the last one's end is a copy across a
    boundary.  Rows that share id and text have the same factors; where an id is repeated or null, src_doc is that id.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    rows = keyed(docs, id_col, text_col)
    spark = docs.sparkSession
    places = exchange.places_for(spark, exchange.words_in(rows))  # there are at most as many windows as words
    sent = spark.sparkContext.broadcast(recurring(rows, window, filter_bits, places))
    asked = rows.mapInArrow(lambda b: _asking(b, window, sent, places), exchange.ROWS)
    replies = exchange.met(asked, places, _answered)
    parsed = written(exchange.met(replies, places, _parsed(window), f"doc_id long, th {TH}, factors {FACTORS}", by="flush"), "factors")
    discard()
    return same_row(rows, parsed.dropDuplicates(["doc_id", "th"]), "left")


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, filter_bits: int = 1 << 27) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, factors, n_spans) for every row: kept is the text's words that stay, joined by one space.

    A word goes if a window of ``window`` words over it has the same words as a window that starts anywhere else,
    in the same text or another.  Windows are judged on the input.  Rows that share id and text are different rows
    with equal windows.  Null and empty texts have no words, very long ones count whole; an empty table stays empty.
    n_spans counts the runs of neighbouring windows that recur, whatever their sources.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = {n: [] for n in ("n_words", "n_removed", "kept", "n_spans")}
            for text, parse in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                w = text.encode().split()
                stay, at, spans, next_start = [], 0, 0, None
                for f in parse or []:
                    stay += w[at : f["start"]]
                    at = max(at, f["end"])
                    spans += f["start"] != next_start
                    next_start = f["end"] - window + 1
                stay += w[at:]
                out["n_words"].append(len(w))
                out["n_removed"].append(len(w) - len(stay))
                out["kept"].append(b" ".join(stay).decode())
                out["n_spans"].append(spans)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64()]
            columns = [pa.array(v, k) for v, k in zip(out.values(), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns[:3], batch.column(3), columns[3]], ["doc_id", "n_words", "n_removed", "kept", "factors", "n_spans"])

    parsed = factored(docs, id_col, text_col, window, filter_bits)
    out = parsed.mapInArrow(run, f"doc_id long, n_words long, n_removed long, kept string, factors {FACTORS}, n_spans long")
    return out.withColumn("factors", F.coalesce("factors", F.array().cast(FACTORS)))


def report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, n_spans) for every row: nulls, repeats and long texts as ``removed`` takes them."""
    return removed(docs, **options).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "n_spans")
