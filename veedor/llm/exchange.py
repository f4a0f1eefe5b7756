"""Columns of numbers dealt between tasks as packed blobs, not as rows.

A table here has rows (place, kind, flush, n, blob): n values of each of some columns, the first of which are 64-bit
hashes in rising order.  The hash's first bits are its place; what has one place meets in one task (``met``).  As a task
sums equal keys before it deals, a hot key sends one value a flush.  The number of places grows with the values
(``places_for``), so up to MOST_PLACES a place holds a bounded share; a partition may have several places.  Blobs are byte planes under zstandard: sorted hashes and small
counts cost a third of what rows of the same numbers do.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROWS = "place int, kind int, flush long, n int, blob binary"
NAMES = ["place", "kind", "flush", "n", "blob"]
#: Values that a place holds on average, at most.
PER_PLACE = 2_000_000
#: Places, at most: a flush of a million values gives some 60 to each of so many, below which blobs would cost more than they hold.  Over
#: 3e10 values (those of some 200 GB of text) places hold more than PER_PLACE.  Partitions of an exchange, at most: each then has several places, one after another.
MOST_PLACES, MOST_PARTITIONS = 1 << 14, 4096
Part = tuple[int, list[np.ndarray]]
_COMPRESSOR, _DECOMPRESSOR = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def places_for(spark: SparkSession, values: int) -> int:
    """A power of two: at least the session's shuffle partitions, and one for each PER_PLACE values, up to MOST_PLACES."""
    least = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-values // PER_PLACE))
    return min(1 << (least - 1).bit_length(), MOST_PLACES)


def words_in(texts: DataFrame) -> int:
    """About how many words a table's ``text`` has, six bytes each: what places are reckoned from before anything is counted."""
    return (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6


def written(df: DataFrame, name: str) -> DataFrame:
    """A packed table in the shared folder; its blobs are compressed already, and a codec's buffers outside the heap would only pile up."""
    return common.written(df, name, "uncompressed")


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Give freed memory back, so that a worker that waits for its next task does not keep what its last one needed."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def packed(columns: list[np.ndarray]) -> bytes:
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns]
    return _COMPRESSOR.compress(b"".join(planes))


def unpacked(blob: bytes | pa.Buffer, n: int, kinds: list[str]) -> list[np.ndarray]:
    raw = np.frombuffer(_DECOMPRESSOR.decompress(blob), np.uint8)
    out, at = [], 0
    for kind in map(np.dtype, kinds):
        size = kind.itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return out


def rows(parts: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*parts) if parts else [[]] * 5, kinds)], NAMES)


def dealt(parts: Iterator[Part], places: int, flush: int = 0, thin: Callable = lambda columns: columns) -> Iterator[pa.RecordBatch]:
    """Rows of parts (kind, columns), cut by place; the first column is the hash.  ``thin`` makes the columns that are packed."""
    shift = np.uint64(64 - (places.bit_length() - 1))
    for kind, columns in together(parts):
        order = np.argsort(columns[0])
        columns = [c[order] for c in columns]
        place = (columns[0] >> shift).astype(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1, [len(place)]])
        batch = rows([(int(place[a]), kind, flush, int(b - a), packed(thin([c[a:b] for c in columns]))) for a, b in zip(cuts[:-1], cuts[1:])])
        del columns, place, order
        trim()
        yield batch
    trim()


def together(parts: Iterator[Part], least: int = 500_000) -> Iterator[Part]:
    """The parts, small ones of a kind put together, so that a task sends about one row to a place."""
    held: dict[int, list[list[np.ndarray]]] = {}
    for kind, columns in parts:
        mine = held.setdefault(kind, [])
        mine.append(columns)
        if sum(len(c[0]) for c in mine) >= least:
            yield kind, [np.concatenate(c) for c in zip(*mine)] if len(mine) > 1 else columns
            del held[kind]
    for kind, mine in held.items():
        if sum(len(c[0]) for c in mine):
            yield kind, [np.concatenate(c) for c in zip(*mine)]


def unfolded(batches: Iterator[pa.RecordBatch], kinds: dict[int, list[str]]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(kind, columns) of each row of a table whose kind is among ``kinds``."""
    for batch in batches:
        kind, n, blob = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("kind", "n", "blob"))
        for k, m, b in zip(kind, n, blob):
            if k in kinds:
                yield k, unpacked(b, m, kinds[k])


Row = tuple[int, int, int, pa.Buffer]


def met(table: DataFrame, places: int, settle: Callable[[int, Iterator[Row]], Iterator[pa.RecordBatch]], schema: str = ROWS, by: str = "place") -> DataFrame:
    """settle(place, rows (kind, flush, n, blob) by kind) for each place of the table; what it yields are rows of ``schema``."""
    at = NAMES.index(by)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            numbers = [batch.column(i).to_pylist() for i in range(4)]
            for row in zip(*numbers, batch.column(4)):
                yield (*row[:4], row[4].as_buffer())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, rows in groupby(each(batches), lambda row: row[at]):
            yield from settle(place, (row[1:] for row in rows))
            trim()

    return table.repartition(min(places, MOST_PARTITIONS), by).sortWithinPartitions(by, "kind").mapInArrow(run, schema)


def gathered(rows: Iterator[Row], kinds: dict[int, list[str]]) -> dict[int, list[np.ndarray]]:
    """The columns of all rows of each kind, one after the other."""
    parts: dict[int, list[list[np.ndarray]]] = {k: [] for k in kinds}
    for kind, _, n, blob in rows:
        parts[kind].append(unpacked(blob, n, kinds[kind]))
    return {k: [np.concatenate([np.zeros(0, t), *(p[i] for p in parts[k])]) for i, t in enumerate(types)] for k, types in kinds.items()}


def groups(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where each group of equal neighbours begins."""
    if not len(sorted_columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(sorted_columns[0]), bool)
    new[0] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def bitmap(hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], table: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` bits (a power of two, 2**16 to 2**32) in which a hash's first bits are its position; bits / 8 bytes on the driver, whatever the table's size."""
    places = min(places_for(table.sparkSession, 0), bits >> 10)
    shift, width = np.uint64(64 - (bits.bit_length() - 1)), bits // places

    def positions(batches):
        return dealt(((0, [np.unique(h >> shift) << shift]) for h in hashes(batches)), places)

    def settle(place, held):
        piece = np.zeros(width, bool)
        for _, _, n, blob in held:
            piece[((unpacked(blob, n, ["u8"])[0] >> shift) - np.uint64(place * width)).astype(np.int64)] = True
        yield rows([(place, 0, 0, width, np.packbits(piece, bitorder="little").tobytes())])

    out = np.zeros(bits // 8, np.uint8)
    for row in met(table.mapInArrow(positions, ROWS), places, settle).select("place", "blob").toLocalIterator():
        out[row[0] * width // 8 : (row[0] + 1) * width // 8] = np.frombuffer(row[1], np.uint8)
    return out


def in_bitmap(full: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - (len(full).bit_length() + 2))
    return (full[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
