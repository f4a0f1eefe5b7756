"""Change detection between a snapshot and a registry of record hashes, and keyed merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def contract_hash(ocid: Column, amount: Column, date: Column, supplier: Column, procedure: Column) -> Column:
    """SHA-256 of the five fields' canonical text; other fields, documents among them, change nothing."""
    return F.sha2(F.concat_ws("~", text_of(ocid), text_of(amount), F.substring(text_of(date), 1, 10), text_of(supplier), text_of(procedure)), 256)


def generic_hash(*fields: Column) -> Column:
    """SHA-256 of any fields' canonical text; nested ones as JSON."""
    return F.sha2(F.concat_ws("~", *map(text_of, fields)), 256)


def detect(now: DataFrame, registry: DataFrame, key: str = "key", full: bool = False) -> DataFrame:
    """now (key, hash, ...) with change: new, modified or unchanged, and the hash before.

    Rows without a key are failed.  A key that occurs twice is judged twice.  full ignores the registry.
    """
    if full:
        return now.withColumns({"hash_before": F.lit(None).cast("string"), "change": F.when(F.col(key).isNull(), "failed").otherwise("new")})
    known = registry.select(F.col(key).alias("_key"), F.col("hash").alias("hash_before"))
    change = F.when(F.col(key).isNull(), "failed").when(F.col("hash_before").isNull(), "new").when(F.col("hash") != F.col("hash_before"), "modified").otherwise("unchanged")
    return now.join(known, F.col(key) == F.col("_key"), "left").drop("_key").withColumn("change", change)


def tally(changes: DataFrame, *by: str) -> DataFrame:
    return changes.groupBy(*by, "change").agg(F.count("*").alias("n"))


def commit(registry: DataFrame, done: DataFrame, key: str = "key", order: str | None = None) -> DataFrame:
    """The registry with the hashes of what was processed; of a key's rows the last by ``order``, else the largest hash."""
    best = F.max_by("hash", order) if order else F.max("hash")
    fresh = done.where(F.col(key).isNotNull()).groupBy(key).agg(best.alias("hash"))
    return registry.select(key, "hash").join(fresh.select(key), key, "left_anti").unionByName(fresh)


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keyed merge: of target and updates the row with the latest ``order`` for each key, updates before target at a tie."""
    both = target.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    latest = W.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n", "_new")


def upsert_edges(edges: DataFrame, nodes: DataFrame, key: str = "canonical_id", node_id: str = "id") -> DataFrame:
    """Edges (source, target, kind) by node ids: unresolved ends drop out, each edge once."""
    n = nodes.select(F.col(key).alias("_k"), F.col(node_id).alias("_id"))
    s, t = n.toDF("_sk", "source_id"), n.toDF("_tk", "target_id")
    return edges.join(s, F.col("source") == F.col("_sk")).join(t, F.col("target") == F.col("_tk")).select("source_id", "target_id", "kind").distinct()


def merge_nodes(target: DataFrame, updates: DataFrame, key: str, keep_first: list[str], union: list[str]) -> DataFrame:
    """Graph-style merge: keep_first columns keep the target's value where it has one, union columns join their arrays, others take the update's."""
    t, u = target.alias("t"), updates.alias("u")
    joined = t.join(u, F.col(f"t.{key}") == F.col(f"u.{key}"), "full")
    old, new = (lambda c: F.col(f"t.{c}")), (lambda c: F.col(f"u.{c}"))
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    columns = []
    for c in target.columns:
        if c == key or c in keep_first:
            columns.append(F.coalesce(old(c), new(c)).alias(c))
        elif c in union:
            columns.append(F.array_sort(F.array_union(empty(old(c)), empty(new(c)))).alias(c))
        else:
            columns.append(F.coalesce(new(c), old(c)).alias(c))
    return joined.select(*columns)
