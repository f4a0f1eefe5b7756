"""Queries over the star schema for the risk signals, each with its SQL."""

from __future__ import annotations

from ..operators import detectors as d
from . import star
from .star import sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query, and its SQL if it has one."""

    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


@query("f01_ghost_company", sql("""
SELECT ruc, empresa, estado, condicion, entidad, count(*) AS n_contratos, round(sum(monto), 2)::DOUBLE AS monto_total, min(fecha) AS primer_contrato, max(fecha) AS ultimo_contrato
FROM won WHERE estado = 'BAJA' OR condicion = 'NO HABIDO' GROUP BY ALL"""))
def f01(spark, sf):
    return d.inactive_supplier(star.won(spark, sf))


PAIRS = """, per AS (SELECT suppkey, entidad_ruc, entidad, count(*) AS n, sum(monto) AS m FROM won GROUP BY ALL),
mem AS (SELECT c.ruc, c.empresa, c.{key}, per.* FROM company c JOIN per USING (suppkey) {where}),
pairs AS (SELECT a.{key}, a.entidad_ruc, a.entidad, a.empresa AS e1, b.empresa AS e2, a.m * b.n + b.m * a.n AS amount
  FROM mem a JOIN mem b ON a.{key} = b.{key} AND a.entidad_ruc = b.entidad_ruc AND a.ruc < b.ruc)
SELECT {key}, entidad_ruc, entidad, count(DISTINCT e) AS n_empresas, array_to_string(list_sort(list(DISTINCT e)), ',') AS empresas, round(sum(half), 2)::DOUBLE AS monto_cluster
FROM (SELECT {key}, entidad_ruc, entidad, unnest([e1, e2]) AS e, (amount / 2.0)::DECIMAL(38,6) AS half FROM pairs) GROUP BY {key}, entidad_ruc, entidad"""


@query("f02_shared_address", sql(PAIRS.format(key="address_hash", where="WHERE NOT c.is_generic")))
def f02(spark, sf):
    return d.shared_key(star.won(spark, sf), star.companies(spark, sf).where("not is_generic"), "address_hash")


@query("f03_generic_address", sql("""
SELECT ruc, empresa, estado, domicilio, count(*) AS n_contratos, round(sum(monto), 2)::DOUBLE AS monto_total FROM won WHERE is_generic GROUP BY ALL"""))
def f03(spark, sf):
    return d.generic_address(star.won(spark, sf), star.companies(spark, sf))


@query("f04_geo_mismatch", sql("""
, r(code, region_domicilio) AS (VALUES ('15', 'LIMA'), ('04', 'AREQUIPA'), ('08', 'CUSCO'), ('17', 'LORETO'), ('07', 'CALLAO'), ('13', 'LA LIBERTAD'), ('14', 'LAMBAYEQUE'), ('25', 'UCAYALI'), ('21', 'PUNO'))
SELECT ruc, empresa, region_domicilio, array_to_string(list_sort(list(DISTINCT region)), ',') AS regiones_contrato, count(*) AS n_contratos_lejanos, round(sum(monto), 2)::DOUBLE AS monto_lejano
FROM won JOIN r ON r.code = substr(ubigeo, 1, 2) WHERE region_domicilio <> upper(region) AND monto > 90000 GROUP BY ruc, empresa, region_domicilio"""))
def f04(spark, sf):
    return d.far_from_home(star.won(spark, sf), min_amount=90_000)


@query("f05_captive_client", sql("""
, b AS (SELECT ruc, empresa, estado, entidad, count(*) AS n, sum(monto) AS m FROM won GROUP BY ALL),
s AS (SELECT ruc, empresa, estado, sum(n)::BIGINT AS total_contratos, sum(m) AS total, max(m) AS most FROM b GROUP BY ALL)
SELECT ruc, empresa, estado, (SELECT max(entidad) FROM b WHERE b.ruc = s.ruc AND b.m = s.most) AS cliente_principal, total_contratos, round(total, 2)::DOUBLE AS monto_total, round(round(most::DOUBLE / total::DOUBLE, 4) * 100, 2) AS pct_concentrado
FROM s WHERE total_contratos >= 5 AND round(most::DOUBLE / total::DOUBLE, 4) >= 0.07"""))
def f05(spark, sf):
    return d.captive_client(star.won(spark, sf), min_share=0.07)


@query("f06_captured_entity", sql("""
, b AS (SELECT cliente_ruc, anio, empresa, sum(monto) AS m FROM won GROUP BY ALL),
s AS (SELECT cliente_ruc, anio, sum(m) AS total, max({'m': m, 'e': empresa}) AS best FROM b GROUP BY ALL)
SELECT cliente_ruc, anio, best.e AS proveedor_dominante, round(total, 2)::DOUBLE AS gasto_total, round(round(best.m::DOUBLE / total::DOUBLE, 4) * 100, 2) AS pct_top_proveedor
FROM s WHERE total > 100000 AND round(best.m::DOUBLE / total::DOUBLE, 4) >= 0.40"""))
def f06(spark, sf):
    return d.captured_entity(star.won(spark, sf), buyer=("cliente_ruc",), min_total=100_000)


URGENT = ("1-URGENT", "2-HIGH")


@query("f07_split_contracts", sql("""
, w AS (SELECT *, lead(fecha, 2) OVER o AS fecha_fin, sum(monto) OVER (o ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS m FROM won WHERE modalidad IN ('1-URGENT', '2-HIGH')
  WINDOW o AS (PARTITION BY ruc, cliente_ruc ORDER BY fecha, external_id))
SELECT ruc, empresa, cliente_ruc, external_id AS primer_contrato, fecha AS fecha_inicio, fecha_fin, 3::BIGINT AS n_contratos, round(m, 2)::DOUBLE AS monto_acumulado FROM w WHERE fecha_fin - fecha <= 180"""))
def f07(spark, sf):
    return d.split_contracts(star.won(spark, sf), procedures=URGENT, days=180)


@query("f08_december_burst", sql("""
SELECT cliente_ruc, anio, count(*) AS total_contratos, count(*) FILTER (month(fecha) = 12) AS contratos_en_dic, round(coalesce(sum(monto) FILTER (month(fecha) = 12), 0), 2)::DOUBLE AS monto_dic,
  round(sum(monto), 2)::DOUBLE AS monto_total, round(count(*) FILTER (month(fecha) = 12) / count(*) * 100, 2) AS pct_diciembre
FROM won GROUP BY cliente_ruc, anio HAVING count(*) >= 5 AND count(*) FILTER (month(fecha) = 12) / count(*) >= 0.5"""))
def f08(spark, sf):
    return d.december_burst(star.won(spark, sf), key=("cliente_ruc",))


@query("f09_direct_award_outlier", sql("""
, c AS (SELECT modalidad, quantile_cont(monto::DOUBLE, 0.9) AS cut FROM won WHERE modalidad IN ('1-URGENT', '2-HIGH') GROUP BY modalidad)
SELECT external_id, ruc, empresa, entidad, modalidad, monto::DOUBLE AS monto, round(cut, 2) AS p90_tipo, fecha, region FROM won JOIN c USING (modalidad) WHERE monto::DOUBLE > cut"""))
def f09(spark, sf):
    return d.direct_award_outlier(star.won(spark, sf), procedures=URGENT)


@query("f10_monogamous_supplier", sql("""
SELECT ruc, empresa, count(*) AS n_contratos, count(DISTINCT cliente_ruc) AS n_clientes, count(DISTINCT anio) AS n_anios, round(sum(monto), 2)::DOUBLE AS monto_total, min(cliente_ruc) AS cliente
FROM won GROUP BY ruc, empresa HAVING count(*) >= 3 AND count(DISTINCT cliente_ruc) <= 530 AND count(DISTINCT anio) >= 2"""))
def f10(spark, sf):
    """Suppliers of the test tables sell to 139 clients at least, so the operator's one client would find none; 530 keeps some and drops some at sf0.01 and sf0.1."""
    return d.single_client(star.won(spark, sf), client="cliente_ruc", max_clients=530)


@query("f11_incomplete_ruc", sql("""
SELECT ruc, empresa, count(*) AS n_contratos, round(sum(monto), 2)::DOUBLE AS monto_total, array_to_string(list_sort(list(DISTINCT entidad))[1:3], ',') AS entidades
FROM won WHERE ruc LIKE 'hash_%' OR NOT is_ruc_complete GROUP BY ruc, empresa"""))
def f11(spark, sf):
    return d.incomplete_id(star.won(spark, sf))


@query("f12_amount_outlier", sql("""
, b AS (SELECT region, modalidad, avg(monto::DOUBLE) AS mean, stddev_samp(monto::DOUBLE) AS dev FROM won GROUP BY ALL HAVING stddev_samp(monto::DOUBLE) > 0)
SELECT external_id, empresa, entidad, region, modalidad, monto::DOUBLE AS monto, round(mean + 1.7 * dev, 2) AS umbral, fecha FROM won JOIN b USING (region, modalidad) WHERE monto::DOUBLE > mean + 1.7 * dev"""))
def f12(spark, sf):
    return d.amount_outlier(star.won(spark, sf), k_sigma=1.7)


@query("f15_no_workers", sql("""
SELECT ruc, empresa, tipo, estado, max_trabajadores, entidad, count(*) AS n_contratos, round(sum(monto), 2)::DOUBLE AS monto_total FROM won WHERE max_trabajadores <= 2 AND monto > 90000 GROUP BY ALL"""))
def f15(spark, sf):
    return d.few_workers(star.won(spark, sf), min_amount=90_000)


@query("f16_shared_representative", sql(PAIRS.format(key="person_id", where="")))
def f16(spark, sf):
    return d.shared_key(star.won(spark, sf), star.companies(spark, sf), "person_id")


@query("f17_tax_debt", sql("""
SELECT ruc, empresa, estado, deuda_coactiva, omisiones, actas, entidad, count(*) AS n_contratos, round(sum(monto), 2)::DOUBLE AS monto_total FROM won WHERE deuda_coactiva OR omisiones GROUP BY ALL"""))
def f17(spark, sf):
    return d.tax_debt(star.won(spark, sf))


@query("f18_activity_mismatch", sql("""
, s AS (SELECT *, CASE substr(ciiu, 1, 2) WHEN '86' THEN 'salud' WHEN '87' THEN 'salud' WHEN '38' THEN 'ambiente' WHEN '39' THEN 'ambiente' WHEN '01' THEN 'agricultura' WHEN '41' THEN 'construccion'
    WHEN '42' THEN 'construccion' WHEN '43' THEN 'construccion' WHEN '51' THEN 'transporte_aereo' WHEN '47' THEN 'comercio_retail' ELSE 'otro' END AS sector_empresa,
  CASE WHEN upper(entidad) LIKE '%SALUD%' OR upper(entidad) LIKE '%HOSPITAL%' THEN 'salud' WHEN upper(entidad) LIKE '%AMBIENTE%' OR upper(entidad) LIKE '%ANA%' OR upper(entidad) LIKE '%SERNANP%' THEN 'ambiente'
    WHEN upper(entidad) LIKE '%EDUCACION%' OR upper(entidad) LIKE '%UGEL%' THEN 'educacion' ELSE 'otro' END AS sector_contrato FROM won)
SELECT ruc, empresa, ciiu, sector_empresa, sector_contrato, entidad, count(*) AS n_contratos, round(sum(monto), 2)::DOUBLE AS monto_total
FROM s WHERE sector_empresa <> 'otro' AND sector_contrato <> 'otro' AND sector_empresa <> sector_contrato AND monto > 50000 GROUP BY ALL"""))
def f18(spark, sf):
    return d.activity_mismatch(star.won(spark, sf))


@query("f19_new_company", sql("""
SELECT ruc, empresa, tipo, inicio, entidad, min(fecha - inicio)::BIGINT AS dias_min, count(*) AS n_contratos, round(sum(monto), 2)::DOUBLE AS monto_total
FROM won WHERE fecha - inicio >= 0 AND fecha - inicio < 365 AND monto > 50000 GROUP BY ruc, empresa, tipo, inicio, entidad"""))
def f19(spark, sf):
    return d.new_company(star.won(spark, sf), min_amount=50_000)


@query("f20_exec_summary", sql("""
SELECT ruc, empresa, entidad, estado, condicion, count(*) AS n_contratos, round(sum(monto), 2)::DOUBLE AS monto_total, count(*) FILTER (modalidad LIKE '%URGENT%' AND monto > 90000) AS flag_directa,
  max((ruc LIKE 'hash_%')::INT) AS flag_id_incompleto, (estado = 'BAJA' OR condicion = 'NO HABIDO')::INT AS flag_inactiva
FROM won GROUP BY ruc, empresa, entidad, estado, condicion ORDER BY monto_total DESC, ruc, entidad LIMIT 200"""))
def f20(spark, sf):
    return d.executive_summary(star.won(spark, sf), procedure="URGENT", large=90_000)


#: Dossiers and document flags from documents: a document with upper-case shouting, currency or pipe signs is flagged; contracts hang on it by number.
DOSSIER_SQL = """
flag AS (
  SELECT doc_id, f.code AS flag_code, f.severity, f.score, 1 AS page FROM documents, (VALUES ('SIGNS', 'high', 30, '$$$'), ('LIST', 'medium', 20, ' | '), ('SHOUT', 'low', 10, '!!')) f(code, severity, score, needle) WHERE contains(text, f.needle)
), dossier AS (
  SELECT doc_id AS ocid, coalesce(sum(score), 0)::INT AS total_score, count(score) AS total_flags,
    CASE WHEN coalesce(sum(score), 0) >= 30 THEN 'ALTO' WHEN coalesce(sum(score), 0) >= 15 THEN 'MEDIO' ELSE 'BAJO' END AS risk_level
  FROM documents LEFT JOIN flag USING (doc_id) GROUP BY doc_id
), oc AS (SELECT tender_id AS ocid, external_id, empresa, ruc, entidad, monto::DOUBLE AS monto, fecha FROM won)"""


def dossier_tables(spark, sf):
    from pyspark.sql import functions as F

    docs = star.read(spark, sf, "documents")
    kinds = [("SIGNS", "high", 30, "$$$"), ("LIST", "medium", 20, " | "), ("SHOUT", "low", 10, "!!")]
    found = F.array_compact(F.array(*[F.when(F.col("text").contains(n), F.struct(F.lit(c).alias("flag_code"), F.lit(s).alias("severity"), F.lit(p).alias("score"))) for c, s, p, n in kinds]))
    hit = docs.select(F.col("doc_id").alias("ocid"), found.alias("f"))
    flags = hit.select("ocid", F.explode("f").alias("f")).select("ocid", "f.*", F.lit(1).alias("page"))
    score = F.aggregate("f", F.lit(0), lambda a, x: a + x["score"])
    dossiers = hit.select("ocid", score.alias("total_score"), F.size("f").cast("long").alias("total_flags")).withColumn("risk_level", F.when(F.col("total_score") >= 30, "ALTO").when(F.col("total_score") >= 15, "MEDIO").otherwise("BAJO"))
    won = star.won(spark, sf).select(F.col("tender_id").alias("ocid"), "external_id", "empresa", "ruc", "entidad", F.col("monto").cast("double").alias("monto"), "fecha")
    return flags, dossiers, won


@query("f13_high_risk_dossier", sql(f""", {DOSSIER_SQL.strip()}
SELECT ocid, external_id, empresa, ruc, entidad, monto, risk_level, total_score, total_flags, fecha FROM dossier JOIN oc USING (ocid) WHERE risk_level IN ('MEDIO', 'ALTO')"""))
def f13(spark, sf):
    _, dossiers, contracts = dossier_tables(spark, sf)
    return d.risky_dossier(dossiers, contracts)


@query("f14_tdr_flags", sql(f""", {DOSSIER_SQL.strip()}
SELECT flag_code, severity, f.score, page, d.ocid, risk_level, external_id, monto, empresa, fecha FROM flag f JOIN dossier d ON f.doc_id = d.ocid LEFT JOIN oc ON oc.ocid = d.ocid"""))
def f14(spark, sf):
    return d.document_flags(*dossier_tables(spark, sf))
