"""Change detection over a stream of records: a registry table per batch, or keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import changes


def read(spark: SparkSession, path: str, schema: str, fmt: str = "json", files: int = 100) -> DataFrame:
    """A folder as a stream: at most ``files`` new files a batch."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).load(path)


def with_registry(stream: DataFrame, registry: str, output: str, checkpoint: str, key: str = "key") -> StreamingQuery:
    """Each batch is judged against the registry, its changes are written under the batch's number, then the registry moves on.

    Both writes are named by batch and overwrite, so a batch that is run again after a failure leaves the same files:
    batch n reads registry version n - 1 and writes version n.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = spark.read.parquet(f"{registry}/v{number - 1}") if number else spark.createDataFrame([], f"{key} string, hash string")
        found = changes.detect(batch.select(key, "hash"), known, key)
        found.where("change <> 'unchanged'").write.mode("overwrite").parquet(f"{output}/batch={number}")
        changes.commit(known, found.where("change in ('new', 'modified')"), key).write.mode("overwrite").parquet(f"{registry}/v{number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_state(stream: DataFrame, key: str = "key") -> DataFrame:
    """(key, hash, change) for each new or modified record; the last hash of a key is kept as state, in time order within a batch."""

    def step(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for frame in frames:
            for h in frame.sort_values("ts")["hash"]:
                if h != last:
                    out.append((group[0], h, "new" if last is None else "modified"))
                    last = h
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["key", "hash", "change"])

    return stream.where(F.col(key).isNotNull()).groupBy(key).applyInPandasWithState(step, "key string, hash string, change string", "hash string", "append", "NoTimeout")


def windowed(stream: DataFrame, size: str = "1 day", late: str = "1 hour", time: str = "ts", by: str = "event_type") -> DataFrame:
    """Counts and sums by window, with a watermark for late rows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), by, "n", "value")
