"""JSON whose shape differs from file to file, as Spark's VARIANT: parsed once, read by path, compared in one canonical form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical(text: Column) -> Column:
    """JSON text in one form: object keys in order, no white space between tokens, numbers and strings as VARIANT writes them; null where it is no JSON.

    Two texts that differ in the order of keys or in white space alone become equal; the order of list elements counts.
    """
    return F.to_json(F.try_parse_json(text))


def canonical_hash(text: Column) -> Column:
    """SHA-256 of the canonical form; null where it is no JSON."""
    return F.sha2(canonical(text), 256)


def documents(spark: SparkSession, path: str, name: str = "*.json") -> DataFrame:
    """(file, folder, v): each whole file below path as VARIANT; files that are no JSON are left out."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(path, wholetext=True)
    place = F.split("_metadata.file_path", "/")
    return rows.select(F.element_at(place, -1).alias("file"), F.element_at(place, -2).alias("folder"), F.try_parse_json("value").alias("v")).where("v is not null")


def elements(v: Column, *inside: str) -> Column:
    """The items of a VARIANT that is a list, or an object that holds the list under one of the names ``inside`` (the first there is), or one item alone; a JSON null has none."""
    kind = F.schema_of_variant(v)
    own = [F.try_variant_get(v, f"$.{n}", "array<variant>") for n in inside]
    alone = F.when(kind.startswith("OBJECT") & ~F.coalesce(*[F.try_variant_get(v, f"$.{n}", "variant").isNotNull() for n in inside], F.lit(False)), F.array(v)) if inside else F.when(kind.startswith("OBJECT"), F.array(v))
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), *own, alone, F.array().cast("array<variant>"))


def flags(spark: SparkSession, path: str, name: str = "flags.json") -> DataFrame:
    """(ocid, place, flag_code, severity, score, page_number, quote) of the flags in dossier folders: a list, ``{"flags": [...]}`` or one flag.

    Scores and pages may be numbers or texts; what cannot be read is null.  ocid is the folder's name, place counts from 0.
    """
    rows = documents(spark, path, name).select(F.col("folder").alias("ocid"), F.posexplode(elements(F.col("v"), "flags")).alias("place", "f"))
    get = lambda n, kind: F.try_variant_get("f", f"$.{n}", kind).alias(n)
    return rows.select("ocid", "place", get("flag_code", "string"), get("severity", "string"), get("score", "int"), get("page_number", "int"), get("quote", "string"))


def dossiers(spark: SparkSession, path: str, name: str = "dossier.json") -> DataFrame:
    """(ocid, entity_name, risk_level, total_score, total_flags) of dossier files, whose totals may be numbers or texts, at the top or under ``summary``."""
    rows = documents(spark, path, name)
    get = lambda n, kind: F.coalesce(F.try_variant_get("v", f"$.{n}", kind), F.try_variant_get("v", f"$.summary.{n}", kind)).alias(n)
    return rows.select(F.col("folder").alias("ocid"), get("entity_name", "string"), get("risk_level", "string"), get("total_score", "int"), get("total_flags", "int"))
