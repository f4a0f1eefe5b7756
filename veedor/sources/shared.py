"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; only a local session without the setting gets a folder of its own."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="veedor-shared-")
        spark.conf.set("spark.checkpoint.dir", place)
    return f"{place}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, so that what is used several times is worked out once and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """df as a side of a join that is dealt by key at any size: what grows with the input must not pass through the driver, and a file's or shuffle's size says little of repeated texts."""
    return df.hint("merge")


def placed(table: DataFrame, name: str) -> DataFrame:
    """A written table with the number of each row from 0, as rows lie in its files; a sorted table keeps its order in them, so no task sees all rows."""
    rows = table.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    before = files.select("_file", (F.sum("_n").over(W.orderBy(F.length("_file"), "_file")) - F.col("_n")).alias("_before"))  # one row a file
    return rows.join(F.broadcast(before), "_file").withColumn(name, F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")
