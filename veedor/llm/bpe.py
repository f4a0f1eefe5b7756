"""Byte-level BPE: overlapping chunk encoding, and decoding by concatenating raw bytes.

Every text is cut into chunks of ``chunk`` characters that overlap by ``overlap``; each chunk is pre-tokenised on its own.
In each overlap the boundaries that both chunks found, between a character that is no white space and one that is, are
true boundaries whatever stands before: no pre-token holds white space after another character.  The text is stitched
at the first of them; each chunk's part is a piece, and the pieces are encoded.  An overlap with no such place
joins its two chunks into one piece, so results never depend on chunk sizes.  A task works through the chunks of a text of
up to ``spread`` characters itself; those of a longer one are dealt to tasks, both to find boundaries and to be encoded.

The ranks and the pattern come from outside (see ``Ranks``); nothing is trained.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices

#: Characters a pre-token's class looks at beyond its end, at most.
LOOKAHEAD = 2
#: Pre-tokens that a worker remembers with their ids.
REMEMBERED = 100_000


@dataclass
class Ranks:
    """A vocabulary: the bytes of a ``.tiktoken`` file and the pattern that parts pre-tokens."""

    table: bytes
    pattern: str

    @classmethod
    def read(cls, path: str, pattern: str) -> Ranks:
        """On the driver; the table (under 1 MB for 50,000 ids) travels with the tasks."""
        with open(path, "rb") as f:
            return cls(f.read(), pattern)

    def __getstate__(self):
        return {"table": self.table, "pattern": self.pattern}

    @cached_property
    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.table.splitlines())}

    @cached_property
    def encoding(self):
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})

    @cached_property
    def pre_token(self):
        return regex.compile(self.pattern)

    @cached_property
    def pieces(self) -> list[bytes]:
        """The bytes of each id."""
        out = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for piece, i in self.ranks.items():
            out[i] = piece
        return out

    @cached_property
    def known(self) -> dict[str, bytes]:
        """Pre-tokens met so far, with their ids as int32 bytes; forgotten when it is full."""
        return _Known(self)

    @cached_property
    def plain(self):
        """Parts texts of characters below U+0250 as the pattern does, but faster; None for another pattern."""
        import public_tokenizers

        if self.pattern != public_tokenizers.PATTERN:
            return None
        below = [chr(i) for i in range(0x250)]
        kinds = {kind: "".join(re.escape(c) for c in below if regex.fullmatch(kind, c)) for kind in (r"\p{L}", r"\p{N}")}
        kinds[r"\s"] = r"\t-\r \x85\xa0"
        letter, digit, white = (kinds[k] for k in (r"\p{L}", r"\p{N}", r"\s"))
        parts = [f" ?[{letter}]+", f" ?[{digit}]+", f" ?[^{white}{letter}{digit}]+", f"[{white}]+(?![^{white}])", f"[{white}]+"]
        return re.compile("|".join(["'s|'t|'re|'ve|'m|'ll|'d", *parts]))

    @cached_property
    def beyond(self):
        return re.compile("[^\x00-ɏ]")

    def tokens(self, text: str) -> list[str]:
        """The pre-tokens of a chunk or piece."""
        if self.plain is None or self.beyond.search(text):
            return self.pre_token.findall(text)
        return self.plain.findall(text)

    def ids(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        return np.frombuffer(b"".join(map(known.__getitem__, tokens)), np.int32)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a piece, int32."""
        return self.ids(self.tokens(text))

    def encode_chunked(self, text: str, chunk: int, overlap: int) -> np.ndarray:
        """The ids of a text, by its chunks."""
        n, step = len(text), chunk - overlap
        starts = [0, *range(step, max(n - overlap, 0), step)]
        if len(starts) == 1:
            return self.encode(text)
        cut = [self.tokens(text[a : a + chunk]) for a in starts]
        ends = [np.cumsum([a, *map(len, t)])[1:] for a, t in zip(starts, cut)]
        out, at = [], 0  # what is encoded so far ends at ``at``
        for i, (a, t, e) in enumerate(zip(starts, cut, ends)):
            if i + 1 < len(starts):
                to = stitch(text, a, min(a + chunk, n), starts[i + 1], overlap, e, ends[i + 1])
                if to is None:
                    continue
            else:
                to = n
            low, high = np.searchsorted(e, [at, to], side="right")
            if at < a or at and e[low - 1] != at:  # the overlap before had no common boundary: one piece over both chunks
                out.append(self.encode(text[at:to]))
            else:
                out.append(self.ids(t[low:high]))
            at = to
        return np.concatenate(out)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


class _Known(dict):
    def __init__(self, ranks: Ranks):
        self.single = ranks.encoding.encode_ordinary

    def __missing__(self, token: str) -> bytes:
        ids = np.array(self.single(token), np.int32).tobytes()  # the pattern takes a pre-token on its own whole
        if len(token) <= 64:
            self[token] = ids
        return ids


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int64).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate(rows) if rows else np.zeros(0, np.int32))


def _encoded(batches: Iterator[pa.RecordBatch], text: str, encode) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, text):
        at = batch.schema.get_field_index(text)
        ids = _lists([encode(t or "") for t in batch.column(at).to_pylist()])
        rest = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if i != at]
        yield pa.RecordBatch.from_arrays([*(c for _, c in rest), ids], [*(n for n, _ in rest), "ids"])


def safe(text: str, at: int) -> bool:
    """Whether a pre-token that ends at ``at`` may be stitched there."""
    return not text[at - 1].isspace() and text[at].isspace()


def boundaries(text: str, ends, base: int, low: int, high: int, last: int) -> list[int]:
    """Of a chunk's pre-token ends (in the whole text; text[0] is at ``base``) those in [low, high] where a stitch is safe and that nothing beyond ``last`` could move."""
    few = ends[np.searchsorted(ends, low) : np.searchsorted(ends, min(high, last - 1), side="right")]
    return [int(at) for at in few if safe(text, int(at) - base)]


def stitch(text: str, start: int, end: int, after: int, overlap: int, ends: np.ndarray, next_ends: np.ndarray) -> int | None:
    """The first boundary that a chunk [start, end) and the one from ``after`` on both found in their overlap."""
    tail = boundaries(text, ends, 0, after, end, end - LOOKAHEAD)
    head = set(boundaries(text, next_ends, 0, after + 1, after + overlap, len(text)))
    return next((at for at in tail if at in head), None)


def _parted(batches: Iterator[pa.RecordBatch], ranks: Ranks, overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = batch.to_pydict()
        found = []
        for t, s, last in zip(rows["text"], rows["start"], rows["last"]):
            ends = np.cumsum([s, *map(len, ranks.tokens(t))])[1:]
            n = s + len(t)
            head = boundaries(t, ends, s, s + 1, s + overlap, n if last else n - LOOKAHEAD) if s else []
            found.append((head, [] if last else boundaries(t, ends, s, n - overlap, n, n - LOOKAHEAD)))
        kind = pa.list_(pa.int64())
        keep = [batch.column(batch.schema.get_field_index(n)) for n in ("row", "start", "text")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array([f[0] for f in found], kind), pa.array([f[1] for f in found], kind)], ["row", "start", "text", "head", "tail"])


def encode(docs: DataFrame, ranks: Ranks, id_col: str = "doc_id", text_col: str = "text", chunk: int = 8_192, overlap: int = 256, spread: int = 65_536) -> DataFrame:
    """(doc_id, ids array<int>) for every row, repeated rows included.

    Null and empty texts have no ids.  Ids may be null or repeat.  ``chunk`` characters at least twice ``overlap``.
    Very long texts are encoded by many tasks; an empty table gives no row; other columns are not looked at.
    """
    if chunk < 2 * overlap or overlap < 1:
        raise ValueError("chunk must be at least twice overlap, and overlap positive")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    short = rows.where(F.char_length("text") <= spread)
    kind = rows.schema["doc_id"].dataType.simpleString()
    whole = short.mapInArrow(lambda b: _encoded(b, "text", lambda t: ranks.encode_chunked(t, chunk, overlap)), f"doc_id {kind}, ids array<int>")

    # A row of a long text is known by its id and a hash of its text; equal rows are encoded once and counted.
    long = rows.where(F.char_length("text") > spread).groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    long = long.select(F.struct("doc_id", F.xxhash64("text").alias("h"), "copies").alias("row"), "text", F.char_length("text").alias("n"))
    cut = long.select("row", "text", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(chunk - overlap))).alias("start"))
    cut = cut.where((F.col("start") == 0) | (F.col("start") + overlap < F.col("n")))
    cut = cut.select("row", F.col("start").cast("long").alias("start"), F.substring("text", F.col("start") + 1, F.lit(chunk)).alias("text"), (F.col("start") + chunk >= F.col("n")).alias("last"))
    row = cut.schema["row"].dataType.simpleString()
    places = "row {0}, start long, text string, head array<long>, tail array<long>".format(row)
    spread = cut.repartition(F.col("row"), F.col("start"))
    parted = spread.mapInArrow(lambda b: _parted(b, ranks, overlap), places)
    order = W.partitionBy("row").orderBy("start")
    stitched = parted.select("row", "start", "text", F.array_min(F.array_intersect(F.lag("tail").over(order), "head")).alias("from"), F.array_min(F.array_intersect("tail", F.lead("head").over(order))).alias("to"), F.lead("start").over(order).alias("next"))
    # The chunk's own part runs from its stitch, or where there is none from the next chunk's start, as one piece with the one before.
    stitched = stitched.withColumn("piece", F.count("from").over(order))
    first, end = F.coalesce("from", "start"), F.coalesce("to", "next", F.col("start") + F.char_length("text"))
    own = F.substring("text", (first - F.col("start") + 1).cast("int"), (end - first).cast("int"))
    parts = stitched.select("row", "start", "piece", own.alias("part"))
    pieces = parts.groupBy("row", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda x: x["part"]), "").alias("text"))
    pieces = pieces.repartition(F.col("row"), F.col("piece")).mapInArrow(lambda b: _encoded(b, "text", ranks.encode), f"row {row}, piece long, ids array<int>")
    joined = pieces.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"])).alias("ids"))
    joined = joined.select("row.doc_id", "ids", F.explode(F.array_repeat(F.lit(0), F.col("row.copies").cast("int")))).select("doc_id", "ids")
    return whole.unionByName(joined)


def decode(encoded: DataFrame, ranks: Ranks, ids_col: str = "ids") -> DataFrame:
    """The rows with a further column ``decoded`` (binary): the bytes of all ids, joined.  Null ids: no bytes.  A column of that name is an error."""
    if "decoded" in encoded.columns:
        raise ValueError("there is a column named decoded already")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                column = part.column(at)
                ends = column.offsets.to_numpy().astype(np.int64)
                values = column.values.to_numpy()[ends[0] : ends[-1]].tolist()
                ends = ends - ends[0]
                out = [ranks.decode(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, f"{fields}, decoded binary")


def report(docs: DataFrame, ranks: Ranks, **options) -> DataFrame:
    """Digests of ``decode(encode(docs))``: one row per row."""
    both = decode(encode(docs, ranks, **options), ranks)
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
