"""Procurement tables over a star schema, and the same tables as SQL for the oracles.

Suppliers play companies, nations and customers play public entities, order lines play contracts.  Register
attributes that the star schema lacks are derived from keys; each formula stands here once for Spark and once in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
CIIU = ["8610", "3811", "0111", "4100", "5110", "4711", "9900"]
ENTITY_KINDS = ["HOSPITAL ", "MINISTERIO DE AMBIENTE ", "UGEL "]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    return s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(*company_columns())


def company_columns() -> list[Column]:
    """A company's columns from its rows in supplier and nation."""
    k = F.col("s_suppkey")
    name = F.col("s_name")
    home = F.concat(F.lit("CALLE "), F.col("n_name"), F.lit(" "), (k % 3).cast("string"), F.when(k % 7 == 0, F.lit(" S/N")).otherwise(F.lit("")))
    return [
        k.alias("suppkey"),
        F.when(k % 10 == 0, F.concat(F.lit("hash_"), F.substring(F.md5(F.lower(name)), 1, 16))).otherwise(F.concat(F.lit("20"), F.lpad(k.cast("string"), 9, "0"))).alias("ruc"),
        name.alias("empresa"), (k % 10 != 0).alias("is_ruc_complete"), F.when(k % 13 == 0, "BAJA").otherwise("ACTIVO").alias("estado"),
        F.when(F.col("s_acctbal") < 0, "NO HABIDO").otherwise("HABIDO").alias("condicion"), F.concat(F.lpad((F.col("s_nationkey") + 1).cast("string"), 2, "0"), F.lit("0101")).alias("ubigeo"),
        home.alias("domicilio"), F.md5(home).alias("address_hash"), (k % 7 == 0).alias("is_generic"), (k % 6).cast("int").alias("max_trabajadores"),
        (k % 11 == 0).alias("deuda_coactiva"), (k % 17 == 0).alias("omisiones"), (k % 19 == 0).alias("actas"), F.element_at(F.array(*map(F.lit, CIIU)), (k % 7 + 1).cast("int")).alias("ciiu"),
        F.when(k % 2 == 0, "SAC").otherwise("EIRL").alias("tipo"), F.date_add(F.lit("1994-06-01").cast("date"), (k * 37 % 2400).cast("int")).alias("inicio"), F.lpad((k % 40).cast("string"), 8, "0").alias("person_id"),
    ]


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    k = F.col("n_nationkey")
    kind = F.when(k % 5 == 0, ENTITY_KINDS[0]).when(k % 5 == 1, ENTITY_KINDS[1]).when(k % 5 == 2, ENTITY_KINDS[2]).otherwise("MUNICIPALIDAD ")
    return n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(
        k.alias("nationkey"), F.concat(F.lit("2050000"), F.lpad(k.cast("string"), 4, "0")).alias("entidad_ruc"), F.concat(kind, F.col("n_name")).alias("entidad"), F.upper("r_name").alias("region"),
    )


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a contract, with its winner's and its buyers' keys."""
    line, orders, customer = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    joined = line.join(orders.join(customer, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))  # lines, of which there are most, are dealt once
    date = F.to_date("o_orderdate")
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("external_id"), F.col("o_orderkey").alias("tender_id"), F.col("l_suppkey").alias("suppkey"), F.col("c_nationkey").alias("nationkey"),
        F.concat(F.lit("10"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("cliente_ruc"), F.col("l_extendedprice").cast(MONEY).alias("monto"), date.alias("fecha"), F.year(date).alias("anio"), F.col("o_orderpriority").alias("modalidad"), F.col("o_orderstatus").alias("estado_tender"),
    )


def won(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide relation most detectors use: contract, winner and buyer.

    Suppliers are joined as their table has them, so that Spark knows their size and need not deal all contracts anew; their columns are derived
    after that.  Nations and regions are tables of fixed size; dealt by their 25 keys, contracts would meet in as many tasks.
    """
    won = contracts(spark, sf_dir)
    winner = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal", "s_nationkey")
    rows = won.join(winner, F.col("suppkey") == F.col("s_suppkey")).join(F.broadcast(read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.select("nationkey", *[c for c in won.columns if c not in ("nationkey", "suppkey")], *company_columns())
    return rows.join(F.broadcast(entities(spark, sf_dir)), "nationkey")


SQL = """
company AS (
  SELECT s_suppkey AS suppkey,
    CASE WHEN s_suppkey % 10 = 0 THEN 'hash_' || substr(md5(lower(s_name)), 1, 16) ELSE '20' || lpad(s_suppkey::VARCHAR, 9, '0') END AS ruc,
    s_name AS empresa, s_suppkey % 10 <> 0 AS is_ruc_complete, CASE WHEN s_suppkey % 13 = 0 THEN 'BAJA' ELSE 'ACTIVO' END AS estado,
    CASE WHEN s_acctbal < 0 THEN 'NO HABIDO' ELSE 'HABIDO' END AS condicion, lpad((s_nationkey + 1)::VARCHAR, 2, '0') || '0101' AS ubigeo,
    'CALLE ' || n_name || ' ' || (s_suppkey % 3)::VARCHAR || CASE WHEN s_suppkey % 7 = 0 THEN ' S/N' ELSE '' END AS domicilio,
    md5('CALLE ' || n_name || ' ' || (s_suppkey % 3)::VARCHAR || CASE WHEN s_suppkey % 7 = 0 THEN ' S/N' ELSE '' END) AS address_hash,
    s_suppkey % 7 = 0 AS is_generic, (s_suppkey % 6)::INT AS max_trabajadores, s_suppkey % 11 = 0 AS deuda_coactiva, s_suppkey % 17 = 0 AS omisiones, s_suppkey % 19 = 0 AS actas,
    ['8610', '3811', '0111', '4100', '5110', '4711', '9900'][(s_suppkey % 7 + 1)::INT] AS ciiu, CASE WHEN s_suppkey % 2 = 0 THEN 'SAC' ELSE 'EIRL' END AS tipo,
    DATE '1994-06-01' + (s_suppkey * 37 % 2400)::INT AS inicio, lpad((s_suppkey % 40)::VARCHAR, 8, '0') AS person_id
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
), entity AS (
  SELECT n_nationkey AS nationkey, '2050000' || lpad(n_nationkey::VARCHAR, 4, '0') AS entidad_ruc,
    CASE n_nationkey % 5 WHEN 0 THEN 'HOSPITAL ' WHEN 1 THEN 'MINISTERIO DE AMBIENTE ' WHEN 2 THEN 'UGEL ' ELSE 'MUNICIPALIDAD ' END || n_name AS entidad, upper(r_name) AS region
  FROM nation JOIN region ON n_regionkey = r_regionkey
), contract AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS external_id, o_orderkey AS tender_id, l_suppkey AS suppkey, c_nationkey AS nationkey,
    '10' || lpad(c_custkey::VARCHAR, 9, '0') AS cliente_ruc, l_extendedprice::DECIMAL(18,2) AS monto, o_orderdate::DATE AS fecha, year(o_orderdate)::INT AS anio, o_orderpriority AS modalidad, o_orderstatus AS estado_tender
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
), won AS (
  SELECT * FROM contract JOIN company USING (suppkey) JOIN entity USING (nationkey)
)"""


def sql(body: str) -> str:
    """An oracle: body may start with further CTEs, each led by a comma, and ends with a SELECT."""
    return f"WITH {SQL.strip()}\n{body.strip()}"
