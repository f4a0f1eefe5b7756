"""Risk signals over contracts won: each takes DataFrames and thresholds and gives rows that deserve review.

``won`` has one row a contract and winner, as veedor.plans.star.won makes it.  Amounts are summed as decimals, so sums
do not depend on order; lists are sorted; ``limit`` None gives all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written


def money(c: Column) -> Column:
    return F.round(c, 2).cast("double")


def total(name: str) -> Column:
    return money(F.sum("monto")).alias(name)


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.round(part.cast("double") / whole.cast("double"), digits)


def top(df: DataFrame, limit: int | None, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(limit) if limit else df


def names(c: str, most: int | None = None) -> Column:
    """The distinct values, sorted, joined by commas."""
    every = F.array_sort(F.collect_set(c))
    return F.array_join(F.slice(every, 1, most) if most else every, ",")


def inactive_supplier(won: DataFrame, estados=("BAJA",), condiciones=("NO HABIDO",), limit: int | None = None) -> DataFrame:
    rows = won.where(F.col("estado").isin(*estados) | F.col("condicion").isin(*condiciones))
    out = rows.groupBy("ruc", "empresa", "estado", "condicion", "entidad").agg(F.count("*").alias("n_contratos"), total("monto_total"), F.min("fecha").alias("primer_contrato"), F.max("fecha").alias("ultimo_contrato"))
    return top(out, limit, F.desc("monto_total"), F.col("ruc"), F.col("entidad"))


def few(df: DataFrame, by: str, c: str, most: int, name: str) -> DataFrame:
    """(by, name): the ``most`` least values of c, joined by commas; tasks keep so many of each group before they meet, so no group is gathered whole."""
    order = W.partitionBy(by).orderBy(c)
    rows = df.select(by, c).distinct().withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most)
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", c))), lambda x: x[c].cast("string")), ",").alias(name))


def shared_key(won: DataFrame, companies: DataFrame, key: str, buyer=("entidad_ruc", "entidad"), min_pairs: int = 1, dedup_contracts: bool = False, limit: int | None = None) -> DataFrame:
    """Two or more companies with one address or representative that sell to one buyer.

    The amount is summed over the cross product of a pair's contracts, as the signal defines it: each contract
    counts once for each contract of the other; with dedup_contracts each counts once a pair.  Neither pairs nor products
    are made: over pairs of different companies the sum of a.m b.n + b.m a.n is M N less each company's own m n.
    """
    per = won.groupBy("suppkey", *buyer).agg(F.count("*").alias("n"), F.sum("monto").alias("m"))
    own = companies.select("suppkey", "ruc", "empresa", key).join(per, "suppkey").groupBy(key, *buyer, "ruc").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.count("*").alias("c"), F.collect_set("empresa").alias("e"))
    wide = lambda x: x.cast("decimal(38,2)")
    out = own.groupBy(key, *buyer).agg(
        F.sum("c").alias("members"), F.sum(F.col("c") * F.col("c")).alias("own_pairs"), F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum(wide(F.col("m")) * F.col("n")).alias("own_mn"), F.sum(wide(F.col("m")) * F.col("c")).alias("own_mc"),
        F.array_distinct(F.flatten(F.collect_set("e"))).alias("e"),
    )
    amount = wide(F.col("m")) * F.col("members") - F.col("own_mc") if dedup_contracts else wide(F.col("m")) * F.col("n") - F.col("own_mn")
    pairs = (F.col("members") * F.col("members") - F.col("own_pairs")) / 2
    out = out.where((pairs >= min_pairs) & (pairs > 0)).select(key, *buyer, F.size("e").cast("long").alias("n_empresas"), F.array_join(F.array_sort("e"), ",").alias("empresas"), money(amount).alias("monto_cluster"))
    return top(out, limit, F.desc("monto_cluster"), F.col(key), F.col(buyer[0]))


def generic_address(won: DataFrame, companies: DataFrame, limit: int | None = None) -> DataFrame:
    per = won.groupBy("suppkey").agg(F.count("*").alias("n_contratos"), total("monto_total"))
    out = companies.where("is_generic").join(per, "suppkey").select("ruc", "empresa", "estado", "domicilio", "n_contratos", "monto_total")
    return top(out, limit, F.desc("monto_total"), F.col("ruc"))


#: Regions by the first two digits of the place code.
UBIGEO_REGION = {"15": "LIMA", "04": "AREQUIPA", "08": "CUSCO", "17": "LORETO", "07": "CALLAO", "13": "LA LIBERTAD", "14": "LAMBAYEQUE", "25": "UCAYALI", "21": "PUNO"}


def far_from_home(won: DataFrame, regions: dict[str, str] = UBIGEO_REGION, min_amount: float = 100_000, limit: int | None = None) -> DataFrame:
    home = F.create_map(*[F.lit(x) for kv in regions.items() for x in kv])[F.substring("ubigeo", 1, 2)]
    rows = won.withColumn("region_domicilio", home).where(F.col("region_domicilio").isNotNull() & (F.col("region_domicilio") != F.upper("region")) & (F.col("monto") > min_amount))
    out = rows.groupBy("ruc", "empresa", "region_domicilio").agg(names("region").alias("regiones_contrato"), F.count("*").alias("n_contratos_lejanos"), total("monto_lejano"))
    return top(out, limit, F.desc("monto_lejano"), F.col("ruc"))


def captive_client(won: DataFrame, buyer: str = "entidad", min_contracts: int = 5, min_share: float = 0.70, limit: int | None = None) -> DataFrame:
    by_buyer = won.groupBy("ruc", "empresa", "estado", buyer).agg(F.count("*").alias("n"), F.sum("monto").alias("m"))
    best = F.max(F.struct(F.col("m"), F.col(buyer).alias("who")))
    out = by_buyer.groupBy("ruc", "empresa", "estado").agg(F.sum("n").alias("total_contratos"), F.sum("m").alias("all"), best.alias("best"))
    part = share(F.col("best.m"), F.col("all"))
    out = out.where((F.col("total_contratos") >= min_contracts) & (part >= min_share))
    out = out.select("ruc", "empresa", "estado", F.col("best.who").alias("cliente_principal"), "total_contratos", money(F.col("all")).alias("monto_total"), F.round(part * 100, 2).alias("pct_concentrado"))
    return top(out, limit, F.desc("pct_concentrado"), F.col("ruc"))


def captured_entity(won: DataFrame, buyer=("entidad_ruc",), min_share: float = 0.40, min_total: float = 1_000_000, limit: int | None = None) -> DataFrame:
    by_supplier = won.groupBy(*buyer, "anio", "empresa").agg(F.sum("monto").alias("m"))
    out = by_supplier.groupBy(*buyer, "anio").agg(F.sum("m").alias("all"), F.max(F.struct("m", "empresa")).alias("best"))
    part = share(F.col("best.m"), F.col("all"))
    out = out.where((F.col("all") > min_total) & (part >= min_share)).select(*buyer, "anio", F.col("best.empresa").alias("proveedor_dominante"), money(F.col("all")).alias("gasto_total"), F.round(part * 100, 2).alias("pct_top_proveedor"))
    return top(out, limit, F.desc("pct_top_proveedor"), *map(F.col, buyer), F.col("anio"))


def split_contracts(won: DataFrame, buyer: str = "cliente_ruc", procedures=("Simplificada", "Directa"), days: int = 30, size: int = 3, limit: int | None = None) -> DataFrame:
    """Runs of ``size`` contracts of one supplier and buyer within ``days`` days, by direct procedures."""
    direct = F.lit(False)
    for p in procedures:
        direct = direct | F.col("modalidad").contains(p)
    order = W.partitionBy("ruc", buyer).orderBy("fecha", "external_id")
    rows = won.where(direct).withColumns({"fecha_fin": F.lead("fecha", size - 1).over(order), "m": F.sum("monto").over(order.rowsBetween(0, size - 1))})
    out = rows.where(F.datediff("fecha_fin", "fecha") <= days).select("ruc", "empresa", buyer, F.col("external_id").alias("primer_contrato"), F.col("fecha").alias("fecha_inicio"), "fecha_fin", F.lit(size).cast("long").alias("n_contratos"), money(F.col("m")).alias("monto_acumulado"))
    return top(out, limit, F.desc("monto_acumulado"), F.col("primer_contrato"))


def december_burst(won: DataFrame, key=("ruc", "empresa"), min_contracts: int = 5, min_share: float = 0.5, limit: int | None = None) -> DataFrame:
    december = F.month("fecha") == 12
    out = won.groupBy(*key, "anio").agg(F.count("*").alias("total_contratos"), F.count_if(december).alias("contratos_en_dic"), money(F.coalesce(F.sum(F.when(december, F.col("monto"))), F.lit(0))).alias("monto_dic"), total("monto_total"))
    part = F.col("contratos_en_dic") / F.col("total_contratos")
    out = out.where((F.col("total_contratos") >= min_contracts) & (part >= min_share)).withColumn("pct_diciembre", F.round(part * 100, 2))
    return top(out, limit, F.desc("pct_diciembre"), *map(F.col, key), F.col("anio"))


def direct_award_outlier(won: DataFrame, procedures=("Simplificada", "Directa"), quantile: float = 0.9, limit: int | None = None) -> DataFrame:
    direct = F.lit(False)
    for p in procedures:
        direct = direct | F.col("modalidad").contains(p)
    rows = won.where(direct).withColumn("x", F.col("monto").cast("double"))
    amounts = written(rows.select("modalidad", "x"), "amounts")
    cut = written(quantile_of(amounts, "modalidad", "x", quantile).withColumnRenamed("value", "cut"), "cuts")  # one row a procedure type: written, its size is known before contracts are dealt by their few types
    out = rows.join(cut, "modalidad").where("x > cut").select("external_id", "ruc", "empresa", "entidad", "modalidad", F.col("x").alias("monto"), F.round("cut", 2).alias("p90_tipo"), "fecha", "region")
    return top(out, limit, F.desc("monto"), F.col("external_id"))


def quantile_of(rows: DataFrame, by: str, c: str, q: float, near: float = 0.005) -> DataFrame:
    """(by, value): the exact interpolated quantile of each group, without a group's values in one buffer.

    A sketch bounds the quantile from both sides; values below are counted, and only the different ones between are ranked.
    """
    sketch = F.percentile_approx(c, F.array(F.lit(max(q - near, 0.0)), F.lit(min(q + near, 1.0))), 10_000)
    group = rows.groupBy(by).agg(F.count(c).alias("_n"), F.min(c).alias("_min"), F.max(c).alias("_max"), sketch.alias("_s"))
    small = F.col("_n") < 2_000
    edges = group.select(by, "_n", F.when(small, F.col("_min")).otherwise(F.col("_s")[0]).alias("_lo"), F.when(small, F.col("_max")).otherwise(F.col("_s")[1]).alias("_hi"))
    j = rows.select(by, c).join(written(edges, "edges"), by)  # Spark sees its size and need not deal the rows by group
    below = j.where(F.col(c) < F.col("_lo")).groupBy(by).agg(F.count("*").alias("_below"))
    mid = j.where(F.col(c).between(F.col("_lo"), F.col("_hi"))).groupBy(by, c, "_n").agg(F.count("*").alias("_k")).join(below, by, "left")
    upto = F.sum("_k").over(W.partitionBy(by).orderBy(c)) + F.coalesce("_below", F.lit(0))
    at, mid = q * (F.col("_n") - 1), mid.withColumn("_upto", upto)
    has = lambda i: (F.col("_upto") - F.col("_k") <= i) & (i < F.col("_upto"))
    low, high = F.max(F.when(has(F.floor(at)), F.col(c))), F.max(F.when(has(F.ceil(at)), F.col(c)))
    out = mid.groupBy(by, "_n").agg(low.alias("_a"), high.alias("_b"))
    return out.select(by, (F.col("_a") + (F.col("_b") - F.col("_a")) * (at - F.floor(at))).alias("value"))


def single_client(won: DataFrame, supplier=("ruc", "empresa"), client: str = "entidad", min_contracts: int = 3, max_clients: int = 1, min_years: int = 2, limit: int | None = None) -> DataFrame:
    out = won.groupBy(*supplier).agg(F.count("*").alias("n_contratos"), F.countDistinct(client).alias("n_clientes"), F.size(F.collect_set("anio")).cast("long").alias("n_anios"), total("monto_total"), F.min(client).alias("cliente"))  # a set of few years: a second distinct count would send each contract three times
    out = out.where((F.col("n_contratos") >= min_contracts) & (F.col("n_clientes") <= max_clients) & (F.col("n_anios") >= min_years))
    return top(out, limit, F.desc("monto_total"), *map(F.col, supplier))


def incomplete_id(won: DataFrame, most_entities: int = 3, limit: int | None = None) -> DataFrame:
    rows = won.where(F.col("ruc").startswith("hash_") | ~F.col("is_ruc_complete"))
    out = rows.groupBy("ruc", "empresa").agg(F.count("*").alias("n_contratos"), total("monto_total"), names("entidad", most_entities).alias("entidades"))
    return top(out, limit, F.desc("monto_total"), F.col("ruc"))


def amount_outlier(won: DataFrame, k_sigma: float = 3.0, limit: int | None = None) -> DataFrame:
    """Amounts over mean + k sample deviations of their region and procedure type; null keys have no baseline."""
    rows = won.withColumn("x", F.col("monto").cast("double"))
    base = rows.groupBy("region", "modalidad").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("dev")).where("dev > 0")
    base = written(base, "baselines")  # one row a region and type: its size is known before contracts are dealt by them
    cut = F.col("mean") + F.lit(k_sigma) * F.col("dev")
    out = rows.join(base, ["region", "modalidad"]).where(F.col("x") > cut).select("external_id", "empresa", "entidad", "region", "modalidad", F.col("x").alias("monto"), F.round(cut, 2).alias("umbral"), "fecha")
    return top(out, limit, F.desc("monto"), F.col("external_id"))


def risky_dossier(dossiers: DataFrame, contracts: DataFrame, levels=("MEDIO", "ALTO"), limit: int | None = None) -> DataFrame:
    """Contracts whose dossier has one of the levels; supplier and buyer may be missing."""
    out = dossiers.where(F.col("risk_level").isin(*levels)).join(contracts, "ocid").select("ocid", "external_id", "empresa", "ruc", "entidad", "monto", "risk_level", "total_score", "total_flags", "fecha")
    return top(out, limit, F.desc("total_score"), F.col("external_id"))


def document_flags(flags: DataFrame, dossiers: DataFrame, contracts: DataFrame, limit: int | None = None) -> DataFrame:
    out = flags.join(dossiers.select("ocid", "risk_level"), "ocid").join(contracts.select("ocid", "external_id", "empresa", "monto", "fecha"), "ocid", "left")
    out = out.select("flag_code", "severity", "score", "page", "ocid", "risk_level", "external_id", "monto", "empresa", "fecha")
    return top(out, limit, F.desc("score"), F.desc_nulls_last("monto"), F.col("ocid"), F.col("flag_code"))


def few_workers(won: DataFrame, max_workers: int = 2, min_amount: float = 100_000, limit: int | None = None) -> DataFrame:
    rows = won.where((F.col("max_trabajadores") <= max_workers) & (F.col("monto") > min_amount))
    out = rows.groupBy("ruc", "empresa", "tipo", "estado", "max_trabajadores", "entidad").agg(F.count("*").alias("n_contratos"), total("monto_total"))
    return top(out, limit, F.desc("monto_total"), F.col("ruc"), F.col("entidad"))


def tax_debt(won: DataFrame, limit: int | None = None) -> DataFrame:
    rows = won.where(F.col("deuda_coactiva") | F.col("omisiones"))
    out = rows.groupBy("ruc", "empresa", "estado", "deuda_coactiva", "omisiones", "actas", "entidad").agg(F.count("*").alias("n_contratos"), total("monto_total"))
    return top(out, limit, F.desc("monto_total"), F.col("ruc"), F.col("entidad"))


#: Sectors by the first two digits of the activity code, and by words in a buyer's name.
CIIU_SECTOR = {"86": "salud", "87": "salud", "38": "ambiente", "39": "ambiente", "01": "agricultura", "41": "construccion", "42": "construccion", "43": "construccion", "51": "transporte_aereo", "47": "comercio_retail"}
ENTITY_SECTOR = [("salud", ("SALUD", "ESSALUD", "HOSPITAL")), ("ambiente", ("AMBIENTE", "ANA", "SERNANP")), ("educacion", ("EDUCACION", "UGEL"))]


def sector_of_name(name: Column, rules=ENTITY_SECTOR, other: str | None = "otro") -> Column:
    """The first rule one of whose words the upper-cased name contains."""
    out = F.lit(other)
    for sector, keywords in reversed(rules):
        found = F.lit(False)
        for k in keywords:
            found = found | F.upper(name).contains(k)
        out = F.when(found, F.lit(sector)).otherwise(out)
    return out


def activity_mismatch(won: DataFrame, min_amount: float = 50_000, limit: int | None = None) -> DataFrame:
    own = F.coalesce(F.create_map(*[F.lit(x) for kv in CIIU_SECTOR.items() for x in kv])[F.substring("ciiu", 1, 2)], F.lit("otro"))
    rows = won.withColumns({"sector_empresa": own, "sector_contrato": sector_of_name(F.col("entidad"))})
    rows = rows.where((F.col("sector_empresa") != "otro") & (F.col("sector_contrato") != "otro") & (F.col("sector_empresa") != F.col("sector_contrato")) & (F.col("monto") > min_amount))
    out = rows.groupBy("ruc", "empresa", "ciiu", "sector_empresa", "sector_contrato", "entidad").agg(F.count("*").alias("n_contratos"), total("monto_total"))
    return top(out, limit, F.desc("monto_total"), F.col("ruc"), F.col("entidad"))


def new_company(won: DataFrame, max_days: int = 365, min_amount: float = 500_000, limit: int | None = None) -> DataFrame:
    days = F.datediff("fecha", "inicio")
    rows = won.withColumn("dias", days).where((F.col("dias") >= 0) & (F.col("dias") < max_days) & (F.col("monto") > min_amount))
    out = rows.groupBy("ruc", "empresa", "tipo", "inicio", "entidad").agg(F.min("dias").cast("long").alias("dias_min"), F.count("*").alias("n_contratos"), total("monto_total"))
    return top(out, limit, F.col("dias_min"), F.col("ruc"), F.col("entidad"))


def executive_summary(won: DataFrame, procedure: str = "Simplificada", large: float = 500_000, limit: int | None = 200) -> DataFrame:
    out = won.groupBy("ruc", "empresa", "entidad", "estado", "condicion").agg(
        F.count("*").alias("n_contratos"), total("monto_total"), F.count_if(F.col("modalidad").contains(procedure) & (F.col("monto") > large)).alias("flag_directa"), F.max(F.col("ruc").startswith("hash_").cast("int")).alias("flag_id_incompleto"),
    )
    out = out.withColumn("flag_inactiva", ((F.col("estado") == "BAJA") | (F.col("condicion") == "NO HABIDO")).cast("int"))
    return top(out, limit, F.desc("monto_total"), F.col("ruc"), F.col("entidad"))
