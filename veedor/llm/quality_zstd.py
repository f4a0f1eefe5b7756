"""Quality classifier by compression: two zstandard dictionaries, one built from good and one from bad labelled text.

A text is compressed block by block with either dictionary.  The difference of its two sizes, normalised by its
length and by the larger size, and its better compression ratio go through a logistic calibration fitted on labelled
rows that built no dictionary.  Every text is scored whole; blocks keep a long text's own history from hiding the dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, least, raw_text, slices, written

BLOCK, SAMPLE_BLOCK = 1_024, 2_048


@dataclass
class Model:
    """Bytes of both dictionaries and the calibration's weights (bias, two differences, ratio); no dictionaries: the rate alone."""

    good: bytes
    bad: bytes
    weights: list[float]

    def __getstate__(self):
        return {"good": self.good, "bad": self.bad, "weights": self.weights}

    @cached_property
    def compressors(self) -> list:
        kinds = [zstandard.ZstdCompressionDict(d) for d in (self.good, self.bad)]
        return [zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False) for d in kinds]

    def features(self, text: bytes) -> list[float]:
        """1, (bad - good) / length, (bad - good) / larger, smaller / length; an empty text's sizes are equal."""
        if not text or not self.good:
            return [1.0, 0.0, 0.0, 0.0]
        good, bad = (sum(len(c.compress(text[i : i + BLOCK])) for i in range(0, len(text), BLOCK)) for c in self.compressors)
        return [1.0, (bad - good) / len(text), (bad - good) / max(good, bad), min(good, bad) / len(text)]

    def score(self, texts: list[bytes]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts]).reshape(-1, 4)
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights), -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Weights by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def dictionary(texts: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; where the texts are too few to train one, their raw content."""
    parts = [t[i : i + SAMPLE_BLOCK] for t in texts for i in range(0, len(t), SAMPLE_BLOCK)]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-size:]


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 3_000, calibration: int = 8_000, sample_bytes: int = 32 << 20, size: int = 65_536) -> Model:
    """A model from labelled rows that are not held out.

    The sample is bounded: ``per_class`` rows of either label build the dictionaries, with at most ``sample_bytes`` of
    whole texts each (none longer than an eighth of that); ``calibration`` others, in their natural proportion, fit the weights.  Rows are taken in the order of a hash of the id.
    With too few labels (none for the dictionary of a class; an empty table) the score is the rate of label 1.  Of an id labelled twice the larger label
    counts; null ids and labels do not; null and empty texts are rows like others.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("r", F.xxhash64("doc_id"))
    half = F.col("r").bitwiseAND(F.lit(1)) == 0
    first = [least(known.where(half & (F.col("y") == y)).withColumn("s", F.xxhash64(F.lit(y), "doc_id")), "s", per_class, "doc_id").drop("s").withColumn("use", F.lit(y)) for y in (0, 1)]
    second = least(known.where(~half).withColumn("s", F.xxhash64(F.lit(2), "doc_id")), "s", calibration, "doc_id").drop("s").withColumn("use", F.lit(2))
    chosen = first[0].unionByName(first[1]).unionByName(second)  # at most 2 * per_class + calibration rows of two numbers
    rows = keyed(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
    # The rows of a dictionary are chosen by numbers alone, in an order that does not depend on how the table lies in files; only their texts move.
    sizes = rows.where("use < 2").select("use", "r", "doc_id", "th", F.octet_length("text").alias("bytes")).where(F.col("bytes") <= sample_bytes // 8)
    order = Window.partitionBy("use").orderBy("r", "doc_id", "th")
    sizes = sizes.withColumns({"k": F.row_number().over(order), "sum": F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    wanted = written(sizes.where((F.col("k") <= per_class) & (F.col("sum") <= sample_bytes)).groupBy("use", "doc_id", "th").agg(F.min("k").alias("k"), F.count("*").alias("copies")), "dictionary-rows")
    found = rows.where("use < 2").select("doc_id", "th", "text").join(F.broadcast(wanted), ["doc_id", "th"]).groupBy("use", "k").agg(F.first("text").alias("text"), F.first("copies").alias("copies"))  # at most 2 * per_class keys
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    for r in found.orderBy("use", "k").toLocalIterator():  # at most sample_bytes of each class
        texts[r.use] += [r.text.encode()] * r.copies
    base = Model(dictionary(texts[1], size), dictionary(texts[0], size), [0.0] * 4)
    if not base.good or not base.bad:
        n, ones = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
        return Model(b"", b"", [float(np.log((ones + 1) / (n - ones + 1))), 0.0, 0.0, 0.0])
    sent = docs.sparkSession.sparkContext.broadcast(base)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, offsets = raw_text(batch.column(1))
            raw = raw.tobytes()
            x = np.array([sent.value.features(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(x[:, k])) for k in range(4))], ["y", *"abcd"])

    got = rows.where("use = 2").select("y", "text").mapInArrow(measure, "y int, a double, b double, c double, d double").toPandas()
    got = got.sort_values(["y", *"abcd"])
    x, y = got[list("abcd")].to_numpy(), got["y"].to_numpy(float)
    if not len(y):
        x, y = np.array([[1.0, 0, 0, 0]] * 2), np.array([0.0, 1.0])
    return Model(base.good, base.bad, logistic(x, y).tolist())


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; null and empty texts get the calibration's value for no difference.

    Rows that repeat each get the same score; very long texts count whole; an empty table gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, offsets = raw_text(batch.column(1))
            raw = raw.tobytes()
            score = sent.value.score([raw[a:b] for a, b in zip(offsets[:-1], offsets[1:])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    rows = keyed(docs, id_col, text_col).select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
