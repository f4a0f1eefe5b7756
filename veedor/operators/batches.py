"""Which documents of which contracts are fetched next, a reason for each that is not, and counters taken in the same pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import fresh_path


def counted(rows: DataFrame, name: str, write: bool = True, **counters: Column) -> tuple[DataFrame, Observation]:
    """rows, and an Observation of ``counters`` (aggregates), which Spark fills while it runs over them: no second pass.

    With ``write`` the rows are written to the shared folder here, so the counters are there at once and belong to exactly these rows.
    """
    seen = Observation(name)
    observed = rows.observe(seen, *[c.alias(n) for n, c in counters.items()])
    if not write:
        return observed, seen
    path = fresh_path(rows.sparkSession, name)
    observed.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path), seen


def counters(seen: Observation, rows: DataFrame) -> DataFrame:
    """What an Observation has seen, as one row."""
    found = seen.get
    return rows.sparkSession.range(1).select(*[F.lit(v).cast("long").alias(n) for n, v in found.items()])


def selection(contracts: DataFrame, documents: DataFrame, key: str, fetched: DataFrame | None = None, existing: DataFrame | None = None, per_contract: int = 1) -> DataFrame:
    """(key, doc_id, url, fetched, place, reason) of every document of the contracts, and one row without doc_id for a contract without any.

    documents: (key, doc_id, url, wanted, rank), of which the wanted with the least (rank, doc_id) come first.  A contract without documents takes
    those of ``fetched``, of the same form.  reason, the first that holds: no_documents, not_wanted, over_contract (beyond ``per_contract``), no_url,
    exists (its url is in ``existing``); null: selected.  Contracts count once; null keys are left out.
    """
    names = ["doc_id", "url", "wanted", "rank"]
    who = contracts.select(key).where(F.col(key).isNotNull()).distinct()
    own = who.join(documents.select(key, *names), key).withColumn("fetched", F.lit(False))
    if fetched is not None:
        own = own.unionByName(who.join(documents.select(key), key, "left_anti").join(fetched.select(key, *names), key).withColumn("fetched", F.lit(True)))
    rows = who.join(own, key, "left")
    wanted = F.coalesce(F.col("wanted"), F.lit(False))
    order = W.partitionBy(key, wanted).orderBy("rank", "doc_id")
    rows = rows.withColumn("place", F.when(wanted, F.row_number().over(order)))
    known = F.lit(False)
    if existing is not None:
        rows = rows.join(existing.select(F.col("url").alias("_url")).distinct(), F.col("url") == F.col("_url"), "left")
        known = F.col("_url").isNotNull()
    reason = F.coalesce(
        F.when(F.col("doc_id").isNull(), "no_documents"), F.when(~wanted, "not_wanted"), F.when(F.col("place") > per_contract, "over_contract"),
        F.when(F.trim(F.coalesce("url", F.lit(""))) == "", "no_url"), F.when(known, "exists"),
    )
    return rows.select(key, "doc_id", "url", F.coalesce("fetched", F.lit(False)).alias("fetched"), "place", reason.alias("reason"))


def selection_counters(key: str) -> dict[str, Column]:
    """Counters of a selection's rows: of contracts, by the row that each has first or alone, and of documents."""
    there = F.col("doc_id").isNotNull()
    return {
        "documents": F.count_if(there), "fetched": F.count_if(F.col("fetched")), "selected": F.count_if(F.col("reason").isNull()), "without_documents": F.count_if(~there),
        **{r: F.count_if(F.col("reason") == r) for r in ("not_wanted", "over_contract", "no_url", "exists")},
    }


def preparation(pages: DataFrame, min_chars: int = 100) -> DataFrame:
    """(document_id, pages, text_pages, chars, status, reason): whether a document may be analysed; reason: no_text (no page with any), short_pages (none over ``min_chars``), else null."""
    n = F.char_length(F.coalesce("text", F.lit("")))
    per = pages.groupBy("document_id").agg(F.count("*").alias("pages"), F.count_if(n > min_chars).alias("text_pages"), F.sum(n).alias("chars"))
    reason = F.when(F.col("chars") == 0, "no_text").when(F.col("text_pages") == 0, "short_pages")
    return per.withColumns({"status": F.when(reason.isNull(), "ready").otherwise("skipped"), "reason": reason})
