"""Rows that a graph or a loader takes from stored tables: entities, persons, documents, pages, links and contract rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A key of eleven digits; what a downloadable file ends with.
KEY = r"^[0-9]{11}$"
FILES = ("pdf", "doc", "docx", "xls", "xlsx", "csv", "zip", "rar", "json")
HREF = r"""(?i)href\s*=\s*["']([^"'<>]+)["']"""


def public_entities(rows: DataFrame, key: str = "entidad_ruc") -> DataFrame:
    """Entities with a whole key, each key once; of rows with one key the first by name."""
    first = W.partitionBy(key).orderBy("entidad")
    return rows.where(F.col(key).rlike(KEY)).withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def persons(rows: DataFrame, key: str = "person_id", *names: str) -> DataFrame:
    """Different persons; any key that is not blank will do.  ``names`` are columns of which the least not null value is taken."""
    return rows.where(F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) != "").groupBy(key).agg(*([F.min(n).alias(n) for n in names] or [F.count("*").alias("n")])).select(key, *names)


def flagged_documents(dossiers: DataFrame) -> DataFrame:
    """Dossiers of a process (ocid) that have a flag."""
    return dossiers.where("ocid is not null and total_flags > 0")


def page_rows(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, char_count) of the pages with text."""
    n = F.char_length(F.coalesce("text", F.lit("")))
    return pages.where(n > 0).select("document_id", "page_number", n.cast("long").alias("char_count"))


def coverage(pages: DataFrame) -> DataFrame:
    """(document_id, pages, with_text, chars, mean, coverage_pct): how much of a document its pages' text covers; null and empty pages count as pages."""
    n = F.char_length(F.coalesce("text", F.lit("")))
    return pages.groupBy("document_id").agg(
        F.count("*").alias("pages"), F.count_if(n > 0).alias("with_text"), F.sum(n).alias("chars"), F.round(F.avg(n), 2).alias("mean"), F.round(100.0 * F.count_if(n > 0) / F.count("*"), 2).alias("coverage_pct"),
    )


def links(pages: DataFrame, html: str = "html", base: str = "url", endings: tuple[str, ...] = FILES) -> DataFrame:
    """(page_id, href, target, file_kind) of each link of a page, in any quotes and case, once each: its address from the page's, and its ending if it is a file's.

    Addresses from the root and beside the page are put together with the page's; others with a scheme stay as they are; anchors and scripts are left out.
    """
    found = pages.select("page_id", base, F.explode(F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(HREF), F.lit(1)))).alias("href"))
    found = found.withColumn("href", F.trim("href")).where("href <> '' and not href rlike '^(?i)(#|javascript:|mailto:)'")
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    beside = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^:/])/[^/]*$", "")
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    target = F.when(F.col("href").rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.col("href")).when(F.col("href").startswith("//"), F.concat(scheme, "href")).when(F.col("href").startswith("/"), F.concat(root, "href")).otherwise(F.concat(beside, F.lit("/"), "href"))
    ending = F.lower(F.regexp_extract(F.regexp_replace("href", r"[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))
    return found.select("page_id", "href", target.alias("target"), F.when(ending.isin(*endings), ending).alias("file_kind"))


def flag_samples(chunks: DataFrame, code: str = "flag_code", most: int = 3, shown: int = 200) -> DataFrame:
    """(code, n, samples): chunks (chunk_id, text) per flag code, and for the first ``most`` by id their id and the first ``shown`` characters; tasks keep so many of a code each."""
    first = W.partitionBy(code).orderBy("chunk_id")
    some = chunks.select(code, "chunk_id", F.substring("text", 1, shown).alias("quote")).withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= most)
    told = some.groupBy(code).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "chunk_id", "quote"))), lambda x: F.struct(x["chunk_id"], x["quote"])).alias("samples"))
    return chunks.groupBy(code).agg(F.count("*").alias("n")).join(told, code)


def discovery_rows(won: DataFrame) -> DataFrame:
    """(external_id, entidad, proveedor, objeto, monto, fecha): contracts as a search for documents takes them; missing texts are empty, a missing amount is null."""
    text = lambda n, name: F.coalesce(F.col(n).cast("string"), F.lit("")).alias(name)
    return won.select("external_id", text("entidad", "entidad"), text("empresa", "proveedor"), text("modalidad", "objeto"), F.col("monto").cast("double").alias("monto"), text("fecha", "fecha"))
