"""An approximate index of unit vectors: k-means cells written as partitions, residual codes to scan, exact vectors to decide.

A vector belongs to the cell of its nearest centre.  Its row has the residual from the centre in one byte a dimension, and
the vector itself.  A search looks at the ``probes`` cells nearest a query: other cells are pruned as partitions.  It scans
codes only (the vectors' column is not read), keeps ``refine`` times the wanted rows of each query, and ranks these by their vectors.

Centres come from a sample of at most ``sample`` vectors (those with the least hashes of their id); every vector is indexed.  ``probes``
is the least number of cells that holds ``recall`` of the sample's own nearest neighbours, which lie farther apart than the table's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx

SAMPLE, MOST_CELLS = 20_000, 4096
#: Vectors that one task scans, about, where both sides are dealt; queries that travel to every task, at most.
PER_TASK, SENT = 500_000, 20_000
#: Vectors or queries whose scores a task holds at a time.
AT_ONCE = 512


@dataclass
class Index:
    path: str
    centres: np.ndarray
    probes: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/cells")


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a float32 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(column), -1)


def nearest(x: np.ndarray, centres: np.ndarray, most: int) -> np.ndarray:
    """Of each row the ``most`` nearest centres, nearest first, ties by number; scores of all centres are held for AT_ONCE rows at a time."""
    out = np.empty((len(x), min(most, len(centres))), np.int32)
    for low in range(0, len(x), AT_ONCE):
        near = x[low : low + AT_ONCE] @ centres.T
        out[low : low + AT_ONCE] = near.argmax(axis=1)[:, None] if most == 1 else np.argsort(-near, axis=1, kind="stable")[:, :most]
    return out


def asked_cells(q: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """Of each cell the queries that probe it, a bit for each: far less than their numbers, where many cells are probed."""
    asks = np.zeros((len(centres), len(q)), bool)
    for low in range(0, len(q), AT_ONCE):
        cells = nearest(q[low : low + AT_ONCE], centres, probes)
        asks[cells.ravel(), np.repeat(np.arange(low, low + len(cells)), cells.shape[1])] = True
    return np.packbits(asks, axis=1)


def kmeans(x: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Unit centres by Lloyd's rounds from evenly spaced rows; a cell without rows takes the row that fits its own centre worst."""
    centres = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        near = x @ centres.T
        at = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        empty = np.flatnonzero(np.bincount(at, minlength=cells) == 0)
        sums[empty] = x[np.argsort(near.max(axis=1), kind="stable")[: len(empty)]]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


def probes_for(x: np.ndarray, centres: np.ndarray, recall: float, top: int = 20, asked: int = 400) -> int:
    """The least number of probed cells that hold ``recall`` of the nearest ``top`` rows of ``asked`` rows of the sample."""
    q = x[:: max(1, len(x) // asked)]
    hits = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, : top + 1]
    order = np.argsort(nearest(q, centres, len(centres)), axis=1)  # the place of each cell in a query's order
    place = np.take_along_axis(order, nearest(x, centres, 1)[:, 0][hits], axis=1)
    share = np.cumsum(np.bincount(place.ravel(), minlength=len(centres))) / place.size
    return int(np.searchsorted(share, recall) + 1)


def build(vectors: DataFrame, path: str, cells: int | None = None, recall: float = 0.95, sample: int = SAMPLE) -> Index:
    """Index all rows (chunk_id, v) of unit vectors in a new folder.  Null vectors are left out; an empty table gives an index without cells."""
    spark, rows = vectors.sparkSession, vectors.select("chunk_id", "v").where("v is not null")
    n = rows.count()
    share = (sample + 8 * sample**0.5 + 100) / max(n, 1)  # of evenly spread hashes
    few = rows.withColumn("h", F.xxhash64("chunk_id")).where(F.col("h") / 2.0**64 + 0.5 <= share)
    x = np.array([r.v for r in few.orderBy("h", "chunk_id").limit(sample).select("v").collect()], np.float32)
    cells = min(max(1, round(n**0.5)) if cells is None else cells, MOST_CELLS, max(len(x), 1))
    centres = kmeans(x, cells) if len(x) else np.zeros((0, 1), np.float32)
    index = Index(path, centres, min(len(centres), probes_for(x, centres, recall)) if len(x) else 0)
    sent = spark.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(1))
                cell = nearest(v, sent.value, 1)[:, 0]
                rest = v - sent.value[cell]
                scale = np.maximum(np.abs(rest).max(axis=1), 1e-12) / 127
                code = np.rint(rest / scale[:, None]).astype(np.int8)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale.astype(np.float32)), pa.array(cell.astype(np.int32))], ["chunk_id", "v", "code", "scale", "cell"])

    kind = rows.schema["chunk_id"].dataType.simpleString()
    coded = rows.select("chunk_id", F.col("v").cast("array<float>").alias("v")).mapInArrow(run, f"chunk_id {kind}, v array<float>, code binary, scale float, cell int")
    coded.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/cells")  # a large cell becomes several files
    spark.createDataFrame([(i, c.tolist(), index.probes) for i, c in enumerate(centres)], "cell int, centre array<float>, probes int").coalesce(1).write.parquet(f"{path}/centres")
    return index


def load(spark: SparkSession, path: str) -> Index:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # at most MOST_CELLS
    return Index(path, np.array([r.centre for r in rows], np.float32) if rows else np.zeros((0, 1), np.float32), rows[0].probes if rows else 0)


def best_columns(scores: np.ndarray, k: int) -> np.ndarray:
    """Of each row the columns of its k highest scores, in any order; of equal ones the first.  Only rows with ties at the k-th are sorted."""
    n = scores.shape[1]
    if n <= 4 * k:
        return np.argsort(-scores, axis=1, kind="stable")[:, :k]
    high = scores >= np.partition(scores, n - k, axis=1)[:, n - k, None]
    plain = high.sum(axis=1) == k
    at = np.empty((len(scores), k), np.int64)
    at[plain] = np.nonzero(high[plain])[1].reshape(-1, k)
    at[~plain] = np.argsort(-scores[~plain], axis=1, kind="stable")[:, :k]
    return at


class Best:
    """The ``most`` best (query, cell, row, score) of each query that a task has seen; equal scores go by row."""

    def __init__(self, most: int, digits: int | None = None):
        self.most, self.digits, self.held, self.size, self.limit = most, digits, [], 0, 2_000_000

    def add(self, ids: np.ndarray, cell: int, rows: pa.Array, scores: np.ndarray) -> None:
        """scores: (queries, rows)."""
        by_row = pc.sort_indices(rows).to_numpy()
        rows, scores = rows.take(pa.array(by_row)), scores[:, by_row]
        if self.digits is not None:
            scores = np.round(scores, self.digits)
        k = min(self.most, scores.shape[1])
        at = best_columns(scores, k)
        self.held.append((np.repeat(ids, k), np.full(len(ids) * k, cell, np.int32), rows.take(pa.array(at.ravel())), np.take_along_axis(scores, at, axis=1).ravel()))
        self.size += len(ids) * k
        if self.size > self.limit:
            self.merge()
            self.limit = max(2_000_000, self.size + 1_000_000)

    def merge(self) -> tuple:
        q, cell, score = (np.concatenate([h[i] for h in self.held]) for i in (0, 1, 3))
        rows = pa.concat_arrays([h[2] for h in self.held])
        place = np.empty(len(q), np.int64)
        place[pc.sort_indices(rows).to_numpy()] = np.arange(len(q))
        order = np.lexsort((place, -score, q))
        begin = np.flatnonzero(np.concatenate([[True], q[order][1:] != q[order][:-1]]))
        rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
        at = order[rank < self.most]
        self.held = [(q[at], cell[at], rows.take(pa.array(at)), score[at])]
        self.size = len(at)
        return self.held[0]

    def batch(self) -> pa.RecordBatch:
        q, cell, rows, score = self.merge()
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(cell), rows, pa.array(score)], ["n", "cell", "chunk_id", "near"])


def exact(vectors: DataFrame, queries: DataFrame, top: int = 20, sent: int = SENT, block: int = 1024) -> DataFrame:
    """(query_id, chunk_id, score, rank): the exact search of ``text.vector_top`` as matrix products, a block of queries and a batch of rows at a time.

    At most ``sent`` queries travel to every task, whose best rows alone are shuffled; with more, at most ``sent`` rows do, and each task
    ranks them for its own queries; where there are more of both they go by ``text.vector_top``.
    """
    asked = queries.select("query_id", "q").where("q is not null").withColumn("n", F.xxhash64("query_id"))
    some = asked.select("n", "q").limit(sent + 1).collect()
    if len(some) > sent:
        few = vectors.select("chunk_id", "v").where("v is not null").limit(sent + 1).collect()
        if few and len(few) <= sent:
            return turned(few, vectors.schema["chunk_id"].dataType.simpleString(), queries, top)
    if not some or len(some) > sent:
        return tx.vector_top(vectors, queries, top)
    held = queries.sparkSession.sparkContext.broadcast((np.array([r.n for r in some], np.int64), np.array([r.q for r in some], np.float64)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (numbers, q), best = held.value, Best(top, 6)
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                for low in range(0, len(numbers), block):
                    best.add(numbers[low : low + block], 0, batch.column(0), q[low : low + block] @ x.T)
        if best.held:
            yield best.batch()

    kind = vectors.schema["chunk_id"].dataType.simpleString()
    found = vectors.select("chunk_id", "v").where("v is not null").mapInArrow(scan, f"n long, cell int, chunk_id {kind}, near double")
    return tx.ranked(found.join(asked.select("n", "query_id"), "n").select("query_id", "chunk_id", F.col("near").alias("score")), top)


def turned(few: list, kind: str, queries: DataFrame, top: int, block: int = 256) -> DataFrame:
    """The exact search of few rows (chunk_id, v) for queries of any number, each of which is settled where it lies."""
    ids = pa.array([r.chunk_id for r in few])
    by_id = pc.sort_indices(ids)
    order = by_id.to_numpy()
    held = queries.sparkSession.sparkContext.broadcast((ids.take(by_id), np.array([few[i].v for i in order], np.float64)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = held.value
        k = min(top, len(ids))
        for batch in batches:
            for low in range(0, batch.num_rows, block):
                part = batch.slice(low, block)
                q = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                scores = np.round(q @ x.T, 6)
                at = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                again = pa.array(np.repeat(np.arange(part.num_rows), k))
                yield pa.RecordBatch.from_arrays([part.column(0).take(again), ids.take(pa.array(at.ravel())), pa.array(np.take_along_axis(scores, at, axis=1).ravel()), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows))], ["query_id", "chunk_id", "score", "rank"])

    asked = queries.select("query_id", "q").where("q is not null")
    return asked.mapInArrow(scan, f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {kind}, score double, rank int")


def decoded(batch: pa.RecordBatch, centre: np.ndarray) -> np.ndarray:
    """Vectors of rows (_, code, scale) of one cell, to a byte a dimension."""
    code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int8).reshape(batch.num_rows, -1)
    return centre + code * batch.column(2).to_numpy()[:, None]


def search(index: Index, queries: DataFrame, top: int = 20, probes: int | None = None, refine: int = 4, sent: int = SENT) -> DataFrame:
    """(query_id, chunk_id, score, rank): for each query (query_id, q) its ``top`` rows by inner product, among the probed cells.

    At most ``sent`` queries travel to the tasks that read cells, and nothing but their best rows is shuffled.  With more, queries and
    codes of a cell are dealt together, large cells over several tasks, so no task holds all of either.  Null queries have no rows;
    equal scores go by chunk_id, as in the exact search.
    """
    spark = queries.sparkSession
    probes = min(index.probes if probes is None else probes, len(index.centres))
    asked = queries.select("query_id", F.col("q").cast("array<float>").alias("q")).where("q is not null").withColumn("n", F.xxhash64("query_id"))
    if not len(index.centres):
        return spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id long, score double, rank int")
    rows, most, centres = index.rows(spark), top * refine, index.centres
    codes = rows.select("chunk_id", "code", "scale", "cell")
    kind = rows.schema["chunk_id"].dataType.simpleString()
    out = f"n long, cell int, chunk_id {kind}, near float"
    some = asked.select("n", "q").limit(sent + 1).collect()
    if len(some) <= sent:
        numbers, q = np.array([r.n for r in some], np.int64), np.array([r.q for r in some], np.float32).reshape(len(some), centres.shape[1])
        wanted = asked_cells(q, centres, probes)
        held = spark.sparkContext.broadcast((numbers, q, wanted, centres))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (numbers, q, wanted, centres), best = held.value, Best(most)
            for batch in batches:
                cell = batch.column(3).to_numpy()
                cut = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else []
                for a, b in zip(cut, [*cut[1:], len(cell)]):
                    asking, x = np.flatnonzero(np.unpackbits(wanted[cell[a]], count=len(numbers))), decoded(batch.slice(a, b - a), centres[cell[a]])
                    for low in range(0, len(asking), AT_ONCE):
                        at = asking[low : low + AT_ONCE]
                        best.add(numbers[at], int(cell[a]), batch.column(0).slice(a, b - a), q[at] @ x.T)
            if best.held:
                yield best.batch()

        found = codes.where(F.col("cell").isin(np.flatnonzero(wanted.any(axis=1)).tolist())).mapInArrow(scan, out)
    else:
        found = dealt(index, asked, codes, probes, most, out)
    order = tx.W.partitionBy("n").orderBy(F.desc("near"), "chunk_id")
    near = found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    dot = F.aggregate(F.zip_with("v", "q", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)
    exact = near.join(rows.select("cell", "chunk_id", "v"), ["cell", "chunk_id"]).join(asked, "n").select("query_id", "chunk_id", F.round(dot, 6).alias("score"))
    return tx.ranked(exact, top)


def dealt(index: Index, asked: DataFrame, codes: DataFrame, probes: int, most: int, out: str) -> DataFrame:
    """The best rows of many queries: queries and codes meet by cell and part of it."""
    spark, centres = asked.sparkSession, index.centres
    sent = spark.sparkContext.broadcast(centres)
    sizes = codes.groupBy("cell").agg(F.ceil(F.count("*") / PER_TASK).cast("int").alias("parts"))

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(low, AT_ONCE)
                cells = nearest(matrix(part.column(1)), sent.value, probes)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1) * cells.shape[1], pa.int32()), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["n", "q", "cells"])

    probed = asked.select("n", "q").mapInArrow(probing, "n long, q array<float>, cells array<int>").select("n", "q", F.explode("cells").alias("cell"))
    left = probed.join(sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "n", "q", F.lit(None).cast(codes.schema["chunk_id"].dataType).alias("chunk_id"), F.lit(None).cast("binary").alias("code"), F.lit(None).cast("float").alias("scale"))
    right = codes.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("chunk_id"), "parts").cast("int").alias("part"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("array<float>").alias("q"), "chunk_id", "code", "scale")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(most)
        for cell, mine in groupby(pieces(batches), lambda x: x[0]):
            numbers, q, joined = [], [], None
            for _, kind, batch in mine:
                if kind == 0:
                    numbers.append(batch.column(3).to_numpy())
                    q.append(matrix(batch.column(4)))
                elif numbers:
                    joined = joined or (np.concatenate(numbers), np.concatenate(q))
                    held = batch.select(["chunk_id", "code", "scale"])
                    x = decoded(held, sent.value[cell[0]])
                    for low in range(0, len(joined[0]), AT_ONCE):
                        best.add(joined[0][low : low + AT_ONCE], cell[0], held.column(0), joined[1][low : low + AT_ONCE] @ x.T)
        if best.held:
            yield best.batch()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy() for i in range(3)])
            cut = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])) if batch.num_rows else []
            for a, b in zip(cut, [*cut[1:], batch.num_rows]):
                yield (int(key[0, a]), int(key[1, a])), int(key[2, a]), batch.slice(a, b - a)

    return left.union(right).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind").mapInArrow(run, out)
