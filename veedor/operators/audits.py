"""Aggregations, selections and audits over record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as c


def discovery(contracts: DataFrame, since, words: list[str], name: str = "entidad", limit: int | None = None) -> DataFrame:
    """Contracts since a date whose buyer's name has any of the words, whatever the case; largest first, null amounts last."""
    found = F.lit(False)
    for w in words:
        found = found | F.lower(name).contains(w.lower())
    out = contracts.where((F.col("fecha") >= F.lit(since).cast("date")) & found)
    return out.orderBy(F.desc_nulls_last("monto"), "external_id").limit(limit) if limit else out


def leaders(contracts: DataFrame, key: str, top: int = 20) -> DataFrame:
    """The top keys by number and by amount, as (measure, key, value, place)."""
    per = contracts.groupBy(F.col(key).alias("key")).agg(F.count("*").cast("double").alias("count"), F.round(F.sum("monto"), 2).cast("double").alias("amount"))
    parts = [per.select(F.lit(m).alias("measure"), "key", F.col(m).alias("value")).orderBy(F.desc("value"), "key").limit(top) for m in ("count", "amount")]
    order = W.partitionBy("measure").orderBy(F.desc("value"), "key")
    return parts[0].unionByName(parts[1]).withColumn("place", F.row_number().over(order))


def pick_sample(contracts: DataFrame, priority: Column, top: int = 50) -> DataFrame:
    """One contract a tender, the best by amount and priority, then the best tenders."""
    score = F.round(F.col("monto").cast("double") / 1e6 + F.when(priority, 50).otherwise(0), 6)
    best = W.partitionBy("tender_id").orderBy(F.desc("score"), "external_id")
    rows = contracts.withColumn("score", score).withColumn("k", F.row_number().over(best)).where("k = 1")
    return rows.select("tender_id", "external_id", "score").orderBy(F.desc("score"), "external_id").limit(top)


def checks(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row a check: how many rows meet it, and the share."""
    totals = df.agg(F.count("*").alias("_all"), *[F.count_if(cond).alias(n) for n, cond in conditions.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("n")) for n in conditions])
    return totals.select(F.explode(pairs).alias("x"), "_all").select("x.check", "x.n", F.round(F.when(F.col("_all") > 0, F.col("x.n") / F.col("_all")), 4).alias("share"))


def match_rate(keys: DataFrame, register: DataFrame, key: str) -> DataFrame:
    """How many distinct keys the register has: a semi join, not a join."""
    wanted = keys.select(key).where(F.col(key).isNotNull()).distinct()
    found = wanted.join(register.select(key), key, "left_semi")
    return wanted.agg(F.count("*").alias("keys")).crossJoin(found.agg(F.count("*").alias("matched"))).withColumn("rate", F.round(F.when(F.col("keys") > 0, F.col("matched") / F.col("keys")), 4))


def packs(processes: DataFrame, documents: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Processes with their documents nested, in order."""
    nested = documents.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("documents"))
    return processes.join(nested, key, "left").withColumn("total_documents", F.coalesce(F.size("documents"), F.lit(0)))


def broken_rows(df: DataFrame, invariants: dict[str, Column]) -> DataFrame:
    """Rows with the names of the invariants they break, in order; rows that break none are left out."""
    errors = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in invariants.items()]))
    return df.withColumn("errors", F.array_join(errors, ",")).where("errors <> ''")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.where(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


def greatest_per_group(df: DataFrame, group: str, *order: Column) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(W.partitionBy(group).orderBy(*order))).where("_k = 1").drop("_k")


def evaluate(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, n_expected, n_found, precision, recall, missing, unexpected) from (key, flags array) on both sides."""
    e, f = expected.select(key, F.col("flags").alias("e")), found.select(key, F.col("flags").alias("f"))
    none = F.array().cast("array<string>")
    j = e.join(f, key, "full").select(key, F.coalesce("e", none).alias("e"), F.coalesce("f", none).alias("f"))
    both = F.size(F.array_intersect("e", "f"))
    ratio = lambda n: F.round(F.when(F.size(n) > 0, both / F.size(n)), 3)
    text = lambda a: F.array_join(F.array_sort(a), ",")
    return j.select(key, F.size("e").cast("long").alias("n_expected"), F.size("f").cast("long").alias("n_found"), ratio("f").alias("precision"), ratio("e").alias("recall"), text(F.array_except("e", "f")).alias("missing"), text(F.array_except("f", "e")).alias("unexpected"))


def coverage(pages: DataFrame, least: int = 50, usable: float = 0.20, partial: float = 0.05) -> DataFrame:
    """Per document: pages, pages with text, coverage and status."""
    with_text = F.count_if(~c.needs_ocr(F.col("text"), least))
    out = pages.groupBy("document_id").agg(F.count("*").alias("pages"), with_text.alias("pages_with_text")).withColumn("coverage", F.round(F.col("pages_with_text") / F.col("pages"), 4))
    status = F.when(F.col("coverage") >= usable, "usable").when(F.col("coverage") >= partial, "partial").otherwise("unusable")
    kind = F.when(F.col("coverage") >= 0.70, "textual").when(F.col("coverage") >= 0.20, "mixed").otherwise("scanned")
    return out.withColumns({"status": status, "ocr_class": kind})


def recurrent(won: DataFrame, days: int = 365, more_than: int = 5, buyer: str = "cliente_ruc") -> DataFrame:
    """Contracts of a supplier and buyer with over ``more_than`` others in the days up to each: a range window, not a self join."""
    day = F.datediff("fecha", F.lit("1970-01-01").cast("date"))
    w = W.partitionBy("ruc", buyer).orderBy("day").rangeBetween(-days, 0)
    rows = won.withColumn("day", day).withColumn("n_before", F.count("*").over(w) - 1)
    return rows.where(F.col("n_before") > more_than).select("ruc", buyer, "external_id", "fecha", "n_before")


def case_scores(flags: DataFrame, amounts: DataFrame, confidence: Column, least: float = 7.0) -> DataFrame:
    """(case_id, score): most severe flag + amount up to 1.5 + confidence - 1; cases from ``least`` on."""
    severity = F.when(F.col("severity") == "high", 8).when(F.col("severity") == "medium", 6).otherwise(3)
    per = flags.groupBy("case_id").agg(F.max(severity).alias("s"))
    score = F.round(F.col("s") + F.least(F.col("monto").cast("double") / 1e7, F.lit(1.5)) + confidence - 1, 4)
    return per.join(amounts, "case_id").select("case_id", score.alias("score")).where(F.col("score") >= least)
