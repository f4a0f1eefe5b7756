"""What the corpus operators share: places for written tables, columns that cannot clash, vectorised words.

Words are ``[^\\x20\\x09-\\x0D]+``.  Arrow hands each task its texts as one byte buffer; splitting and
hashing work on that buffer with numpy, so no Python object is made per word.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.  Only a local session without the setting gets a folder of its own."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="veedor-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts lineage and survives lost executors.

    Tables that a result may still be read from stay until the folder is cleared; the others go with ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and nothing reads any more, and let Spark delete the shuffle files of finished jobs.

    Spark drops a shuffle's files once the driver's collector finds its plan unused, which on a quiet driver can take half an hour.
    """
    for t in tables:
        place = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_to)
        place.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
    gc.collect()
    SparkSession.active()._jvm.System.gc()


#: A row's text in 128 bits; with the id it tells rows apart.
TH = "struct<a:bigint,b:bigint>"


def text_key(text: Column) -> Column:
    """Two XXH64 of a text under different seeds, so that rows that share an id (or have none) are told apart by 128 bits."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(0x5EED), text).alias("b"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (doc_id, th, text): other columns cannot clash.  th tells rows apart that share an id; null text is empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text).alias("th"), text.alias("text"))


def same_row(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Join on (doc_id, th), where a null id equals a null id; a's key columns stay."""
    right = b.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), *[c for c in b.columns if c not in ("doc_id", "th")])
    return a.join(right, a["doc_id"].eqNullSafe(right["_id"]) & (a["th"] == right["_th"]), how).drop("_id", "_th")


def ascii_lower(column):
    """A-Z only.  Where a text is plain ASCII the built-in lower() does the same and is faster."""
    return F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(F.translate(column, UPPER, LOWER))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` text bytes, a longer row alone; views, not copies."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(pc.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, done = 0, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(at, to - at)
            at, done = to, int(ends[to - 1])


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets); nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return b, o - o[0]


WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_rng = np.random.default_rng(20_240_607)
_BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64, endpoint=True)
_BASE = int(_rng.integers(2**60, 2**63)) * 8 + 3 & (2**64 - 1)
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 21:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values after which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of some texts: 64-bit hashes, byte spans in ``raw``, and for each text the first word's index."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    raw: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(column: pa.Array, fold: bool = False, white: np.ndarray = WHITE, hashed: bool = True) -> Words:
    """All words of a column of texts: runs of bytes outside ``white``; fold lower-cases A-Z first.  Without ``hashed`` there are no hashes."""
    raw, offsets = raw_text(column)
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64), raw)
    if fold:
        raw = FOLD[raw]
    inside = ~white[raw]
    edge = np.zeros(n + 1, bool)  # a text's start parts words as white space does
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(span_hashes(raw, s, e) if hashed else np.zeros(0, np.uint64), s, e, np.searchsorted(s, offsets), raw)


def span_hashes(raw: np.ndarray, s: np.ndarray, e: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """Hashes of the byte spans [s, e), rising and disjoint; worked out for about ``piece`` bytes at a time, so a long text takes no more memory."""
    h = np.empty(len(s), np.uint64)
    at = 0
    while at < len(s):
        to = max(at + 1, int(np.searchsorted(e, s[at] + piece, side="right")))
        low, high = s[at], e[to - 1]
        n = int(high - low)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw[low:high]] * powers(_BASE, n), out=sums[1:])
        h[at:to] = (sums[e[at:to] - low] - sums[s[at:to] - low]) * powers(_INVERSE, n)[s[at:to] - low]
        at = to
    return mix(h)


def pieces_of(mask_ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of things whose sizes add up to ``mask_ends``: about ``most`` in each, a larger one alone."""
    at = 0
    while at < len(mask_ends):
        done = int(mask_ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(mask_ends, done + most, side="right")))
        yield at, to
        at = to


def strings(w: Words) -> Iterator[tuple[int, int, pa.DictionaryArray]]:
    """(a, b, the words a to b, dictionary-encoded), some MB of bytes at a time; equal words have equal codes within such a piece."""
    lengths = w.ends - w.starts
    for a, b in pieces_of(np.cumsum(lengths), 1 << 22):
        offsets = np.zeros(b - a + 1, np.int32)
        np.cumsum(lengths[a:b], out=offsets[1:])
        low, high = int(w.starts[a]), int(w.ends[b - 1])
        edges = np.zeros(high - low + 1, np.int8)  # +1 where a word begins, -1 after it
        edges[w.starts[a:b] - low] += 1
        edges[w.ends[a:b] - low] -= 1
        data = w.raw[low:high][np.cumsum(edges[:-1], dtype=np.int8).view(bool)]
        yield a, b, pa.StringArray.from_buffers(b - a, pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()


def summed(parts: Iterator[pa.Table], keys: list[str], most: int = 600_000, size: int = 1 << 26) -> Iterator[pa.RecordBatch]:
    """Rows of the parts with equal ``keys`` added up over a task (every other column is a sum), given out whenever more than ``most`` rows or ``size`` bytes are held."""
    held: list[pa.Table] = []
    rows = kept = 0
    names: list[str] = []

    def merged() -> pa.Table:
        t = pa.concat_tables(held).group_by(keys, use_threads=False).aggregate([(c, "sum") for c in names if c not in keys])
        return t.rename_columns(keys + [c for c in names if c not in keys]).select(names)

    for part in parts:
        names = part.column_names
        held.append(part)
        rows += part.num_rows
        if rows > max(2 * kept, most // 2):
            held = [merged()]
            rows = kept = held[0].num_rows
            if kept > most or held[0].nbytes > size:
                yield from held[0].combine_chunks().to_batches(max_chunksize=100_000)
                held, rows, kept = [], 0, 0
    if held:
        yield from merged().combine_chunks().to_batches(max_chunksize=100_000)


def grams(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hashes of all runs of k values; the result has len(h) - k + 1 entries."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    base = (int(_BYTE[seed % 256]) | 1) & (2**64 - 1)
    out, have, part, width, n = None, 0, h, 1, k
    while n:  # by doubling: a run of width words at every place
        if n & 1:
            m = len(h) - k + 1
            piece = part[have : have + m]
            out = piece.copy() if out is None else out + piece * np.uint64(pow(base, have, 2**64))
            have += width
        n >>= 1
        if n:
            part = part[: len(part) - width] + part[width:] * np.uint64(pow(base, width, 2**64))
            width *= 2
    return mix(out)


def least(df: DataFrame, rank: str, most: int, *ties: str) -> DataFrame:
    """The ``most`` rows with the least ``rank`` (an XXH64 of a key), ties by ``ties``: at most about that many rows meet in one task, whatever the table's size."""
    n = df.count()
    share = (most + 8 * most**0.5 + 100) / max(n, 1)  # of evenly spread ranks; that fewer than most fall below is beyond chance
    if share < 1:
        few = df.where(F.col(rank) < F.lit(int(-(2**63) + share * 2**64)))
        if few.count() >= most:
            df = few
    return df.orderBy(rank, *ties).limit(most)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df, a written table, with a broadcast hint if it has at most ``rows`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bit_of(h: np.ndarray, bits: int) -> np.ndarray:
    """The place of each hash in a bitmap of ``bits`` bits, a power of two."""
    return (mix(h ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(bits - 1)).astype(np.int64)


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap with the places of all hashes of a one-column table; bits / 8 bytes, whatever the table's size."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bit_of(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits) + 1)], ["at"])

    page = F.call_function("bitmap_bucket_number", F.col("at")).alias("page")
    pages = hashes.mapInArrow(places, "at long").groupBy(page).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", F.col("at"))).alias("bitmap"))
    out = np.zeros(max(bits // 8, 4096), np.uint8)
    for number, part in pages.toLocalIterator():
        part = np.frombuffer(part, np.uint8)
        out[(number - 1) * 4096 : (number - 1) * 4096 + len(part)] = part
    return out


def in_bitmap(full: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    at = bit_of(h, bits)
    return (full[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def tally(parts: Iterator[np.ndarray], kind: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """(kind, n): how often each of the parts' 64-bit values occurs, summed over a task, given out whenever more than ``most`` different keys are held."""
    keys, counts, fresh, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def merge():
        k = np.concatenate([keys, *(f[0] for f in fresh)])
        c = np.concatenate([counts, *(f[1] for f in fresh)])
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        return k[begin], np.add.reduceat(c, begin) if len(k) else c

    def batch(k, c):
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], [kind, "n"])

    for part in parts:
        found, n = np.unique(part, return_counts=True)
        fresh.append((found, n))
        size += len(found)
        if size > max(500_000, len(keys)):
            keys, counts = merge()
            fresh, size = [], 0
            if len(keys) > most:
                yield batch(keys, counts)
                keys, counts = keys[:0], counts[:0]
    keys, counts = merge()
    if len(keys):
        yield batch(keys, counts)
