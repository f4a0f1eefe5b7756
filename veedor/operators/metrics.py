"""Metrics of companies and buyers, and relations derived from shared attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .detectors import money, share
from .groups import all_pairs


def client_diversity(companies: DataFrame, won: DataFrame) -> DataFrame:
    """Every company with its number of buyers and contracts and its total; zeros where it won nothing."""
    per = won.groupBy("ruc").agg(F.countDistinct("entidad_ruc").alias("c"), F.count("*").alias("n"), F.sum("monto").alias("m"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return companies.select("ruc").join(per, "ruc", "left").select("ruc", zero("c").alias("diversity_clients"), zero("n").alias("total_contracts"), money(F.coalesce("m", F.lit(0))).alias("total_won"))


def supplier_concentration(won: DataFrame, buyer: str = "entidad_ruc") -> DataFrame:
    """The top supplier's share of a buyer's year, averaged over years."""
    year = won.groupBy(buyer, "anio", "ruc").agg(F.sum("monto").alias("m")).groupBy(buyer, "anio").agg(F.max("m").alias("top"), F.sum("m").alias("all"))
    return year.groupBy(buyer).agg(F.round(F.avg(F.round(F.col("top").cast("double") / F.col("all").cast("double"), 8)), 4).alias("avg_concentration"), F.count("*").alias("years"))


def geo_coverage(won: DataFrame) -> DataFrame:
    return won.groupBy("ruc").agg(F.countDistinct("region").alias("geographic_coverage"))


def _points(*rules: tuple[Column, int]) -> Column:
    return sum((F.when(c, p).otherwise(0) for c, p in rules), F.lit(0)).cast("int")


def ghost() -> Column:
    return (F.col("estado") == "BAJA") | (F.col("condicion") == "NO HABIDO")


def risk_score(companies: DataFrame, won: DataFrame) -> DataFrame:
    """30 inactive, 20 incomplete id, 15 one client with 3 contracts or more, 15 generic address."""
    base = companies.join(client_diversity(companies, won), "ruc")
    single = (F.col("diversity_clients") == 1) & (F.col("total_contracts") >= 3)
    return base.select("ruc", _points((ghost(), 30), (~F.col("is_ruc_complete"), 20), (single, 15), (F.col("is_generic"), 15)).alias("risk_score"))


def days_to_first(companies: DataFrame, won: DataFrame) -> DataFrame:
    first = won.groupBy("ruc").agg(F.min("fecha").alias("f"))
    return companies.join(first, "ruc").select("ruc", F.datediff("f", "inicio").cast("long").alias("days_to_first_contract"))


def risk_score_v2(companies: DataFrame, won: DataFrame, new_days: int = 365) -> DataFrame:
    """30 inactive, 20 incomplete id, 15 generic address, 25 debt, 20 few workers, 10 one client, 20 first contract soon after the start."""
    base = companies.join(client_diversity(companies, won), "ruc").join(days_to_first(companies, won), "ruc", "left")
    soon = F.col("days_to_first_contract").between(0, new_days - 1)
    rules = [(ghost(), 30), (~F.col("is_ruc_complete"), 20), (F.col("is_generic"), 15), (F.col("deuda_coactiva") | F.col("omisiones"), 25), (F.col("max_trabajadores") <= 2, 20), (F.col("diversity_clients") == 1, 10), (soon, 20)]
    return base.select("ruc", _points(*rules).alias("risk_score_v2"))


def summary(scores: DataFrame, diversity: DataFrame, high: int = 50) -> DataFrame:
    both = scores.join(diversity, "ruc")
    return both.agg(F.count("*").alias("companies"), F.round(F.avg("risk_score_v2"), 4).alias("avg_score"), F.round(F.avg("diversity_clients"), 4).alias("avg_diversity"), F.max("risk_score_v2").alias("max_score"), F.count_if(F.col("risk_score_v2") >= high).alias("n_high"))


def same_attribute(companies: DataFrame, key: str) -> DataFrame:
    """All pairs of companies with one value of an attribute."""
    return all_pairs(companies, "ruc", key).select(F.col("a").alias("ruc_a"), F.col("b").alias("ruc_b"), F.col(key).alias("via"))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """The number of rows of each table; tables are counted where they lie, in one job."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("label"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def market_share(won: DataFrame, as_of, years: int = 3, min_share: float = 0.5, min_contracts: int = 3) -> DataFrame:
    """A supplier's share of a buyer's spend over the years before as_of: an aggregate over a window of aggregates."""
    from pyspark.sql import Window as W

    recent = won.where(F.col("fecha") >= F.add_months(F.lit(as_of).cast("date"), -12 * years))
    per = recent.groupBy("entidad_ruc", "entidad", "ruc", "empresa").agg(F.count("*").alias("n_contratos"), F.sum("monto").alias("m"))
    part = share(F.col("m"), F.sum("m").over(W.partitionBy("entidad_ruc")))
    out = per.withColumn("cuota", part).where((F.col("cuota") > min_share) & (F.col("n_contratos") >= min_contracts))
    return out.select("entidad_ruc", "entidad", "ruc", "empresa", "n_contratos", money(F.col("m")).alias("monto_total"), "cuota")
