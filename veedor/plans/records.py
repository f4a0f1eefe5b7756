"""Queries for normalisers, releases, change detection, merges, audits and text operators, each with its SQL where it has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import rules
from ..operators import audits as a
from ..operators import changes as ch
from ..operators import releases as rel
from ..operators import text as tx
from ..operators import vector_index
from ..sources import sinks
from . import star
from .star import sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


# -- normalisers


@query("t10_ruc_normalize", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN '20' || lpad(s_suppkey::VARCHAR, 9, '0') END AS ruc FROM supplier")
def t10(spark, sf):
    k = F.col("s_suppkey")
    text = F.concat(F.when(k % 3 == 0, "2-").when(k % 3 == 1, "RUC 20-").otherwise(" 20."), F.lpad(k.cast("string"), 9, "0"), F.lit(" "))
    return star.read(spark, sf, "supplier").select("s_suppkey", c.ruc(text).alias("ruc"))


@query("t11_ruc_canonical", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '20' || lpad(s_suppkey::VARCHAR, 9, '0') ELSE 'hash_' || substr(md5(lower(s_name)), 1, 16) END AS ruc, s_suppkey % 2 = 0 AS sane, 'company_' || substr(sha1(lower(s_name)), 1, 12) AS name_key, '***' || right(s_suppkey::VARCHAR, 3) AS masked FROM supplier")
def t11(spark, sf):
    k, name = F.col("s_suppkey"), F.col("s_name")
    text = F.when(k % 2 == 0, F.concat(F.lit("20"), F.lpad(k.cast("string"), 9, "0"))).otherwise(k.cast("string"))
    return star.read(spark, sf, "supplier").select("s_suppkey", c.ruc_or_hash(text, name).alias("ruc"), c.ruc_is_sane(text).alias("sane"), c.name_key("company", name).alias("name_key"), c.mask(k.cast("string")).alias("masked"))


@query("t13_amount_parse", "SELECT o_orderkey, o_totalprice::DECIMAL(18,2)::DOUBLE AS amount FROM orders")
def t13(spark, sf):
    k, x = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    text = F.when(k % 3 == 0, F.concat(F.lit("S/ "), F.format_number(x, 2))).when(k % 3 == 1, F.replace(x.cast("string"), F.lit("."), F.lit(","))).otherwise(x.cast("string"))
    return star.read(spark, sf, "orders").select("o_orderkey", c.amount(text).alias("amount"))


@query("t14_date_parse", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN o_orderdate::DATE END AS d FROM orders")
def t14(spark, sf):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.when(k % 5 == 0, F.date_format(d, "dd/MM/yyyy")).when(k % 5 == 1, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T10:00:00Z"))).when(k % 5 == 2, F.date_format(d, "yyyyMMdd")).when(k % 5 == 3, F.date_format(d, "dd-MM-yyyy")).otherwise("n/a")
    return star.read(spark, sf, "orders").select("o_orderkey", c.date(text).alias("d"))


@query("t15_ciiu_parse", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 > 0 THEN lpad((s_suppkey % 9000)::VARCHAR, 4, '0') END AS code, CASE WHEN s_suppkey % 4 > 0 THEN s_name END AS name, (s_suppkey % 5)::INT AS least, (s_suppkey % 5 + 3)::INT AS most FROM supplier")
def t15(spark, sf):
    k, text = F.col("s_suppkey"), lambda x: x.cast("string")
    acts = F.array(F.lit("Secundaria 1 - 0000 - X"), F.when(k % 4 > 0, F.concat(F.lit("Principal - "), F.lpad(text(k % 9000), 4, "0"), F.lit(" - "), F.col("s_name"))).otherwise("Otra"))
    history = F.array(F.struct(text(k % 5 + 3).alias("workers")), F.struct(text(k % 5).alias("workers")), F.struct(F.lit("NE").alias("workers")))
    m, w = c.main_activity(acts), c.workers_range(history)
    return star.read(spark, sf, "supplier").select("s_suppkey", m["code"].alias("code"), m["name"].alias("name"), w["least"].alias("least"), w["most"].alias("most"))


@query("t17_truthy", "SELECT s_suppkey, s_suppkey % 5 IN (0, 4) AS yes FROM supplier")
def t17(spark, sf):
    k = F.col("s_suppkey") % 5
    return star.read(spark, sf, "supplier").select("s_suppkey", c.truthy(F.when(k == 0, "SI").when(k == 1, "Sin información").when(k == 2, " no ").when(k == 3, None).otherwise("deuda 2020")).alias("yes"))


@query("t18_address_hash", sql("SELECT ruc, address_hash, is_generic FROM company"))
def t18(spark, sf):
    return star.companies(spark, sf).select("ruc", c.address_hash(F.col("domicilio")).alias("address_hash"), c.is_generic_address(F.col("domicilio")).alias("is_generic"))


def _like(column: str, words) -> str:
    return " OR ".join(f"contains(upper({column}), '{w}')" for w in words)


@query("t23_sector", sql(f"SELECT entidad_ruc, CASE WHEN {_like('entidad', rules.SECTOR_WORDS['salud'])} THEN 'salud' WHEN {_like('entidad', rules.SECTOR_WORDS['ambiente'])} THEN 'ambiente' ELSE 'otros' END AS sector, CASE WHEN {_like('entidad', rules.SECTOR_WORDS['salud'])} THEN 'salud' WHEN {_like('entidad', rules.SECTOR_WORDS['ambiente'])} THEN 'ambiente' END AS by_votes FROM entity"))
def t23(spark, sf):
    return star.entities(spark, sf).select("entidad_ruc", c.sector(F.col("entidad")).alias("sector"), c.sector_by_votes(F.col("entidad")).alias("by_votes"))


@query("t25_sector_discovery", sql("SELECT external_id, monto::DOUBLE AS monto FROM won WHERE (entidad ILIKE '%hospital%' OR entidad ILIKE '%ambiente%') AND fecha >= DATE '2000-01-01' ORDER BY won.monto DESC NULLS LAST, external_id LIMIT 100"))
def t25(spark, sf):
    return a.discovery(star.won(spark, sf), "2000-01-01", ["hospital", "ambiente"], limit=100).select("external_id", F.col("monto").cast("double").alias("monto"))


TITLES = ["Términos de  Referencia", "Bases Integradas", "Pliego de absolución", "Acta de buena pro", "Contrato", "Otro anexo"]


@query("t26_doc_type_title", "SELECT p_partkey, ['tdr', 'bases', 'pliego_absolucion', 'acta', 'contrato', 'otros'][(p_partkey % 6 + 1)::INT] AS kind, [95, 85, 50, 0, 0, 0][(p_partkey % 6 + 1)::INT]::INT AS score FROM part")
def t26(spark, sf):
    title = F.element_at(F.array(*map(F.lit, TITLES)), (F.col("p_partkey") % 6 + 1).cast("int"))
    kind = c.title_type(F.replace(title, F.lit("é"), F.lit("e")))
    return star.read(spark, sf, "part").select("p_partkey", kind.alias("kind"), c.title_score(title).alias("score"))


@query("t28_select_documents", "SELECT p_partkey // 6 AS pack, arg_min(p_partkey, (-[95, 85, 50, 0, 0, 0][(p_partkey % 6 + 1)::INT], p_partkey)) AS best FROM part WHERE p_partkey % 6 < 3 GROUP BY 1")
def t28(spark, sf):
    title = F.element_at(F.array(*map(F.lit, TITLES)), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = star.read(spark, sf, "part").select(F.floor(F.col("p_partkey") / 6).alias("pack"), "p_partkey", c.title_score(title).alias("score")).where("score > 0")
    return a.greatest_per_group(rows, "pack", F.desc("score"), F.col("p_partkey")).select("pack", F.col("p_partkey").alias("best"))


@query("t29_file_type", "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'pdf' ELSE coalesce(nullif(lower(regexp_extract(regexp_extract(url, '^[^?#]*'), '/[^/]*\\.([A-Za-z0-9]+)$', 1)), ''), 'unknown') END AS kind FROM pages WHERE url LIKE '%/%/%/%'")
def t29(spark, sf):
    return star.read(spark, sf, "pages").where("url like '%/%/%/%'").select("page_id", c.file_type(F.lit(None).cast("string"), F.when(F.col("page_id") % 7 == 0, "application/pdf"), F.col("url")).alias("kind"))


@query("t30_ocid_extract", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN 'ocds-dgv273-seacev3-' || o_orderkey END AS ocid FROM orders")
def t30(spark, sf):
    k = F.col("o_orderkey")
    return star.read(spark, sf, "orders").select("o_orderkey", c.ocid(F.when(k % 4 > 0, F.concat(F.lit("Ref: OCDS_dgv273-SEACEV3-"), k.cast("string"), F.lit("."))).otherwise("none")).alias("ocid"))


@query("t31_coerce", "SELECT s_suppkey, ['null', 'bool', 'int', 'float', 'str'][(s_suppkey % 5 + 1)::INT] AS kind, CASE s_suppkey % 5 WHEN 2 THEN s_suppkey::DOUBLE WHEN 3 THEN s_suppkey + 0.5 END::DOUBLE AS number FROM supplier")
def t31(spark, sf):
    k = F.col("s_suppkey")
    text = F.when(k % 5 == 0, " ").when(k % 5 == 1, "True").when(k % 5 == 2, k.cast("string")).when(k % 5 == 3, F.concat(k.cast("string"), F.lit(".5"))).otherwise("abc1")
    x = c.coerce(text)
    return star.read(spark, sf, "supplier").select("s_suppkey", x["kind"].alias("kind"), x["number"].alias("number"))


# -- releases


def releases(spark, sf):
    """Nested releases from orders: one award a line, one supplier an award but none where the part's key divides by 10; no awards for orders that divide by 50."""
    o, line = star.read(spark, sf, "orders"), star.read(spark, sf, "lineitem")
    award = F.struct(F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.lit(None).cast("string").alias("date"), F.struct(F.col("l_extendedprice").alias("amount")).alias("value"), F.when(F.col("l_partkey") % 10 > 0, F.array(F.struct(F.concat(F.lit("PE-RUC-20"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("id"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("name")))).alias("suppliers"))
    awards = line.where("l_orderkey % 50 > 0").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(award)).alias("awards"))
    k = F.col("o_custkey")
    rucs = F.array(F.struct(F.concat(F.lit("10"), F.lpad(k.cast("string"), 9, "0")).alias("id"), F.lit("PE-RUC").alias("scheme"), F.lit(None).cast("string").alias("legalName")))
    parties = F.array(F.struct(F.lit("x").alias("id"), F.lit("Seller").alias("name"), F.array(F.lit("supplier")).alias("roles"), F.struct(F.lit("1").alias("id"), F.lit("OTHER").alias("scheme")).alias("identifier"), rucs.alias("additionalIdentifiers"), F.struct(F.lit("cusco").alias("department")).alias("address")),
                      F.struct(F.lit("b").alias("id"), F.concat(F.lit("C"), k.cast("string")).alias("name"), F.array(F.lit("procuringEntity"), F.lit("buyer")).alias("roles"), F.struct(F.lit("9").alias("id"), F.lit("OTHER").alias("scheme")).alias("identifier"), rucs.alias("additionalIdentifiers"), F.struct(F.lit("lima").alias("department")).alias("address")))
    docs = F.array(*[F.struct(F.lit(str(i)).alias("id"), F.lit(t).alias("title"), F.lit("u").alias("url"), F.lit("pdf").alias("format")) for i, t in enumerate(("Bases", "Contrato"))])
    tender = F.struct(F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("open").alias("procurementMethod"), F.col("o_orderpriority").alias("procurementMethodDetails"), F.lit("Title").alias("title"), F.struct(F.col("o_totalprice").alias("amount")).alias("value"), docs.alias("documents"))
    return o.join(awards, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.concat(F.lit("ocds-"), F.col("o_orderkey").cast("string")).alias("ocid"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), F.struct(F.lit("b").alias("id"), F.concat(F.lit("C"), k.cast("string")).alias("name")).alias("buyer"), tender.alias("tender"), parties.alias("parties"), F.array(F.struct(F.struct(F.lit(1.0).alias("amount")).alias("value"))).alias("contracts"), "awards")


T1 = """r AS (SELECT o.*, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice FROM orders o LEFT JOIN (SELECT * FROM lineitem WHERE l_orderkey % 50 > 0) l ON o_orderkey = l_orderkey),
flat AS (SELECT concat_ws(':', 'ocds-' || o_orderkey, CASE WHEN l_suppkey IS NOT NULL THEN concat_ws('-', l_linenumber, l_partkey, l_suppkey) END, CASE WHEN l_partkey % 10 > 0 THEN '20' || lpad(l_suppkey::VARCHAR, 9, '0') END) AS external_id,
  'ocds-' || o_orderkey AS ocid, CASE WHEN l_suppkey IS NULL THEN 'procedure' ELSE 'contract' END AS record_type, 'C' || o_custkey AS entity_name, '10' || lpad(o_custkey::VARCHAR, 9, '0') AS entity_ruc, CASE WHEN l_partkey % 10 > 0 THEN 'S' || l_suppkey END AS supplier_name,
  CASE WHEN l_partkey % 10 > 0 THEN '20' || lpad(l_suppkey::VARCHAR, 9, '0') END AS supplier_ruc, coalesce(l_extendedprice, 1.0)::DOUBLE AS monto, strftime(o_orderdate, '%Y-%m-%d') AS fecha, year(o_orderdate)::INT AS period_year, 'LIMA' AS region, o_orderpriority AS procedure_type FROM r)"""


@query("t1_ocds_flatten", f"WITH {T1} SELECT * FROM flat")
def t1(spark, sf):
    return rel.flatten(releases(spark, sf))


@query("t4_ocds_process_split", "SELECT 'ocds-' || o_orderkey || '-000' || i AS document_id, 'ocds-' || o_orderkey AS ocid, ['Bases', 'Contrato'][i] AS title, 'u' AS url, ['bases', 'contrato'][i] AS document_type FROM orders, (VALUES (1), (2)) v(i)")
def t4(spark, sf):
    return rel.split(releases(spark, sf))[1]


@query("t2_party_ruc", "SELECT 'ocds-' || o_orderkey AS ocid, 'C' || o_custkey AS entity_name, '10' || lpad(o_custkey::VARCHAR, 9, '0') AS entity_ruc, 'T' || o_orderkey AS procedure_code, 'Title' AS title, NULL::VARCHAR AS sector FROM orders")
def t2(spark, sf):
    return rel.split(releases(spark, sf))[0]


@query("t19_map_to_graph", f"""WITH {T1}, e AS (SELECT 'public_entity' AS entity_type, entity_ruc AS canonical_id, entity_name AS name, 'src' || period_year % 2 AS s FROM flat UNION ALL SELECT 'company', supplier_ruc, supplier_name, 'src' || period_year % 2 FROM flat WHERE supplier_ruc IS NOT NULL)
SELECT entity_type, canonical_id, min(name) AS display_name, array_to_string(list_sort(list(DISTINCT s)), ',') AS sources FROM e GROUP BY ALL""")
def t19(spark, sf):
    return rel.graph(rel.flatten(releases(spark, sf)).withColumn("source_code", F.concat(F.lit("src"), (F.col("period_year") % 2).cast("string"))))[0]


@query("k2_upsert_edges", f"WITH {T1} SELECT DISTINCT 's' || s_suppkey AS source_id, entity_ruc AS target_id, 'GANO_CONTRATO' AS kind FROM flat JOIN supplier ON supplier_ruc = '20' || lpad(s_suppkey::VARCHAR, 9, '0') WHERE s_suppkey % 2 = 0")
def k2(spark, sf):
    edges = rel.graph(rel.flatten(releases(spark, sf)).withColumn("source_code", F.lit("x")))[1].where("kind = 'GANO_CONTRATO'")
    s, cu = star.read(spark, sf, "supplier"), star.read(spark, sf, "customer")
    nodes = s.where("s_suppkey % 2 = 0").select(F.concat(F.lit("20"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("canonical_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    nodes = nodes.unionByName(cu.select(F.concat(F.lit("10"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("canonical_id")).withColumn("id", F.col("canonical_id")))
    return ch.upsert_edges(edges, nodes)


@query("t21_sunat_merge", sql("""SELECT ruc, CASE WHEN suppkey % 2 = 0 THEN 'ocds_name=' || empresa || ';sunat_estado=' || estado ELSE 'ocds_name=' || empresa END AS meta, CASE WHEN suppkey % 2 = 0 THEN 'ocds,sunat' ELSE 'ocds' END AS sources FROM company"""))
def t21(spark, sf):
    co = star.companies(spark, sf)
    old = co.select("ruc", F.create_map(F.lit("ocds_name"), F.col("empresa")).alias("metadata"), F.array(F.lit("ocds")).alias("sources"))
    out = rel.enrich(old, co.where("suppkey % 2 = 0").select("ruc", "estado"))
    entries = F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return out.select("ruc", F.array_join(entries, ";").alias("meta"), F.array_join("sources", ",").alias("sources"))


@query("t22_sunat_semi", sql("SELECT DISTINCT ruc, estado FROM company SEMI JOIN (SELECT suppkey FROM contract WHERE monto > 104000) w USING (suppkey)"))
def t22(spark, sf):
    wanted = star.contracts(spark, sf).where("monto > 104000").select("suppkey")
    return star.companies(spark, sf).join(wanted, "suppkey", "left_semi").select("ruc", "estado").dropDuplicates(["ruc"])


# -- change detection: the latest event of each (user, props) is its record; the registry holds those before a date

EVENT_SQL = """last AS (SELECT user_id || '|' || props AS key, max({'ts': ts, 'id': event_id, 't': event_type, 'v': value}) AS x FROM events WHERE %s GROUP BY 1),
h AS (SELECT key, sha256(concat_ws('~', key, (x.v)::DECIMAL(18,4)::VARCHAR, strftime(x.ts, '%%Y-%%m-%%d'), '', x.t)) AS hash, x FROM last)"""
NOW = EVENT_SQL % "true"
BEFORE = (EVENT_SQL % "ts < TIMESTAMP '2024-01-15'").replace("last AS", "last0 AS").replace("FROM last)", "FROM last0)").replace("h AS (", "h0 AS (", 1)
CHANGES = f"WITH {NOW}, {BEFORE}, c AS (SELECT h.key, h.hash, h0.hash AS hash_before, CASE WHEN h0.hash IS NULL THEN 'new' WHEN h.hash <> h0.hash THEN 'modified' ELSE 'unchanged' END AS change FROM h LEFT JOIN h0 USING (key))"


def snapshot(spark, sf, until=None):
    e = star.read(spark, sf, "events")
    e = e if until is None else e.where(F.col("ts") < F.lit(until).cast("timestamp"))
    key = F.concat_ws("|", "user_id", "props")
    last = e.groupBy(key.alias("key")).agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("x"))
    return last.select("key", ch.contract_hash(F.col("key"), F.col("x.value").cast("decimal(18,4)"), F.date_format("x.ts", "yyyy-MM-dd"), F.lit(None).cast("string"), F.col("x.event_type")).alias("hash"))


def detected(spark, sf):
    return ch.detect(snapshot(spark, sf), snapshot(spark, sf, "2024-01-15"))


@query("c1_hash_contract", f"WITH {NOW} SELECT key, hash FROM h")
def c1(spark, sf):
    return snapshot(spark, sf)


@query("c2_detect_changes", f"{CHANGES} SELECT * FROM c WHERE change <> 'unchanged'")
def c2(spark, sf):
    return detected(spark, sf).where("change <> 'unchanged'").select("key", "hash", "hash_before", "change")


@query("c3_registry_commit", f"{CHANGES} SELECT key, hash FROM c")
def c3(spark, sf):
    return ch.commit(snapshot(spark, sf, "2024-01-15"), detected(spark, sf).where("change in ('new', 'modified')"))


@query("c4_prescan_counts", f"{CHANGES} SELECT split_part(key, '|', 2) AS sector, change, count(*) AS n FROM c GROUP BY ALL")
def c4(spark, sf):
    return ch.tally(detected(spark, sf).withColumn("sector", F.element_at(F.split("key", r"\|"), 2)), "sector")


@query("c5_hash_generic", "SELECT event_id, sha256(concat_ws('~', event_id::VARCHAR, coalesce(event_type, ''), coalesce(props, ''))) AS hash FROM events")
def c5(spark, sf):
    return star.read(spark, sf, "events").select("event_id", ch.generic_hash(F.col("event_id"), F.col("event_type"), F.col("props")).alias("hash"))


@query("c6_changeset", f"{CHANGES} SELECT change, count(*) AS n FROM c GROUP BY change UNION ALL SELECT 'failed', 1")
def c6(spark, sf):
    bad = spark.createDataFrame([(None, "x")], "key string, hash string")
    return ch.tally(ch.detect(snapshot(spark, sf).unionByName(bad), snapshot(spark, sf, "2024-01-15")))


@query("c7_incremental_vs_full", f"{CHANGES} SELECT 'new' AS change, count(*) AS n FROM c")
def c7(spark, sf):
    return ch.tally(ch.detect(snapshot(spark, sf), snapshot(spark, sf, "2024-01-15"), full=True))


@query("k1_upsert", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, (ts >= TIMESTAMP '2024-01-15') DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def k1(spark, sf):
    e = star.read(spark, sf, "events").select("user_id", "event_id", "value", F.struct("ts", "event_id").alias("at"))
    return ch.upsert(e.where("at.ts < timestamp'2024-01-15'"), e.where("at.ts >= timestamp'2024-01-15'"), ["user_id"], "at").drop("at")


@query("k3_graph_merge", sql("""SELECT coalesce(a.ruc, b.ruc) AS ruc, coalesce(a.empresa, b.empresa || '*') AS name, coalesce(b.condicion, a.condicion) AS condicion,
 CASE WHEN a.ruc IS NOT NULL AND b.ruc IS NOT NULL THEN 'ocds,sunat' WHEN a.ruc IS NOT NULL THEN 'ocds' ELSE 'sunat' END AS source FROM (SELECT * FROM company WHERE suppkey % 3 > 0) a FULL JOIN (SELECT * REPLACE (condicion || '!' AS condicion) FROM company WHERE suppkey % 2 = 0) b ON a.ruc = b.ruc"""))
def k3(spark, sf):
    co = star.companies(spark, sf)
    t = co.where("suppkey % 3 > 0").select("ruc", F.col("empresa").alias("name"), "condicion", F.array(F.lit("ocds")).alias("source"))
    u = co.where("suppkey % 2 = 0").select("ruc", F.concat("empresa", F.lit("*")).alias("name"), F.concat("condicion", F.lit("!")).alias("condicion"), F.array(F.lit("sunat")).alias("source"))
    return ch.merge_nodes(t, u, "ruc", ["name"], ["source"]).withColumn("source", F.array_join("source", ","))


@query("k7_contract_chunks", sql("SELECT external_id, concat_ws(chr(10), 'Entidad: ' || entidad, 'Proveedor: ' || empresa, 'Monto: ' || monto::VARCHAR, 'Fecha: ' || strftime(fecha, '%Y-%m-%d'), 'Modalidad: ' || modalidad) AS text, 'contrato,' || lower(modalidad) || ',' || lower(region) AS tags, ruc FROM won"))
def k7(spark, sf):
    return sinks.contract_chunks(star.won(spark, sf)).select("external_id", "text", F.array_join("tags", ",").alias("tags"), F.col("metadata")["ruc"].alias("ruc"))


# -- audits

@query("a2_discovery_summary", sql(""", p AS (SELECT entidad AS key, count(*)::DOUBLE AS n, round(sum(monto), 2)::DOUBLE AS m FROM won GROUP BY entidad), u AS (SELECT 'count' AS measure, key, n AS value FROM p UNION ALL SELECT 'amount', key, m FROM p)
SELECT measure, key, value, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY value DESC, key) AS place FROM u) WHERE place <= 20"""))
def a2(spark, sf):
    return a.leaders(star.won(spark, sf), "entidad")


@query("a3_pick_sample", sql(""", s AS (SELECT tender_id, external_id, round(monto::DOUBLE / 1e6 + CASE WHEN entidad LIKE 'HOSPITAL%' THEN 50 ELSE 0 END, 6) AS score FROM won),
b AS (SELECT *, row_number() OVER (PARTITION BY tender_id ORDER BY score DESC, external_id) AS k FROM s) SELECT tender_id, external_id, score FROM b WHERE k = 1 ORDER BY score DESC, external_id LIMIT 50"""))
def a3(spark, sf):
    return a.pick_sample(star.won(spark, sf), F.col("entidad").startswith("HOSPITAL"))


CHECKS = {"large": "o_totalprice > 200000", "open": "o_orderstatus = 'O'", "urgent": "o_orderpriority = '1-URGENT'", "old": "o_orderdate < timestamp '1997-01-01 00:00:00'"}


@query("a5_pipeline_audit", " UNION ALL ".join(f"SELECT '{k}' AS \"check\", count(*) FILTER ({v}) AS n, round(count(*) FILTER ({v}) / count(*), 4) AS share FROM orders" for k, v in CHECKS.items()))
def a5(spark, sf):
    return a.checks(star.read(spark, sf, "orders"), {k: F.expr(v) for k, v in CHECKS.items()})


@query("a6_sunat_audit", "SELECT count(DISTINCT l_partkey) AS keys, count(DISTINCT p_partkey) AS matched, round(count(DISTINCT p_partkey) / count(DISTINCT l_partkey), 4) AS rate FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 3 = 0) ON l_partkey = p_partkey")
def a6(spark, sf):
    return a.match_rate(star.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("k")), star.read(spark, sf, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("k")), "k")


@query("a7_data_reality_audit", "SELECT event_type, count(*) AS n, count(*) FILTER (value IS NOT NULL) AS with_value, round(count(*) FILTER (value > 50) / count(*) * 100, 2) AS pct FROM events GROUP BY event_type")
def a7(spark, sf):
    return star.read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count("value").alias("with_value"), F.round(F.count_if(F.col("value") > 50) / F.count("*") * 100, 2).alias("pct"))


@query("a8_build_packs", "SELECT conv_id, count(*)::INT AS total_documents, array_to_string(list(role ORDER BY turn, role), ',') AS roles FROM conversations GROUP BY conv_id")
def a8(spark, sf):
    conv = star.read(spark, sf, "conversations")
    out = a.packs(conv.select("conv_id").distinct(), conv, "conv_id", "turn", ["role"])
    return out.select("conv_id", "total_documents", F.array_join(F.transform("documents", lambda d: d["role"]), ",").alias("roles"))


@query("a9_validate_packs", """SELECT * FROM (SELECT conv_id, turn, concat_ws(',', CASE WHEN NOT coalesce(role IN ('user', 'assistant'), false) THEN 'role' END, CASE WHEN NOT coalesce(length(text) > 40, false) THEN 'text' END, CASE WHEN NOT coalesce(turn >= 0, false) THEN 'turn' END) AS errors FROM conversations) WHERE errors <> ''""")
def a9(spark, sf):
    invariants = {"role": F.col("role").isin("user", "assistant"), "text": F.length("text") > 40, "turn": F.col("turn") >= 0}
    return a.broken_rows(star.read(spark, sf, "conversations"), invariants).select("conv_id", "turn", "errors")


@query("a10_validate_delivery", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ANTI JOIN (SELECT p_partkey AS l_partkey FROM part WHERE p_partkey % 100 > 0) p USING (l_partkey)")
def a10(spark, sf):
    parents = star.read(spark, sf, "part").where("p_partkey % 100 > 0").select(F.col("p_partkey").alias("l_partkey"))
    return a.orphans(star.read(spark, sf, "lineitem"), parents, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("a12_golden_candidates", "SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k = 1")
def a12(spark, sf):
    return a.greatest_per_group(star.read(spark, sf, "documents"), "source", F.desc("n_chars"), F.col("doc_id")).select("source", "doc_id", "n_chars")


@query("a13_golden_eval", """WITH x AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'LOW' END AS a, CASE WHEN toxic = 1 THEN 'TOXIC' END AS b, contains(text, '!!') OR contains(text, '$$$') OR contains(text, ' | ') AS f, contains(text, 'the ') AS g FROM labels JOIN documents USING (doc_id)),
y AS (SELECT doc_id, list_filter([a, b], lambda v: v IS NOT NULL) AS e, list_filter([CASE WHEN f THEN 'LOW' END, CASE WHEN g THEN 'EN' END], lambda v: v IS NOT NULL) AS f FROM x)
SELECT doc_id, len(e)::BIGINT AS n_expected, len(f)::BIGINT AS n_found, round(len(list_intersect(e, f)) / nullif(len(f), 0), 3) AS "precision", round(len(list_intersect(e, f)) / nullif(len(e), 0), 3) AS recall,
 array_to_string(list_sort(list_filter(e, lambda v: NOT list_contains(f, v))), ',') AS missing, array_to_string(list_sort(list_filter(f, lambda v: NOT list_contains(e, v))), ',') AS unexpected FROM y""")
def a13(spark, sf):
    labels, docs = star.read(spark, sf, "labels"), star.read(spark, sf, "documents")
    some = lambda *x: F.array_compact(F.array(*x)).alias("flags")
    expected = labels.select("doc_id", some(F.when(F.col("quality") == 0, "LOW"), F.when(F.col("toxic") == 1, "TOXIC")))
    t = F.col("text")
    found = docs.join(labels, "doc_id", "left_semi").select("doc_id", some(F.when(t.contains("!!") | t.contains("$$$") | t.contains(" | "), "LOW"), F.when(t.contains("the "), "EN")))
    return a.evaluate(expected, found, "doc_id")


PAGES_SQL = "page AS (SELECT 'd' || doc_id // 8 AS document_id, (doc_id % 8 + 1)::INT AS page_number, doc_id, text FROM documents)"
FOLD_SQL = "lower(translate({}, 'áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ', 'aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC'))"


def pages(spark, sf):
    """Documents of eight pages, both from the text's number: no window over a source that may hold a third of all texts."""
    k = F.col("doc_id")
    return star.read(spark, sf, "documents").select(F.concat(F.lit("d"), F.floor(k / 8).cast("string")).alias("document_id"), (k % 8 + 1).cast("int").alias("page_number"), "doc_id", "text")


@query("a14_pdf_usability", f"""WITH {PAGES_SQL}, s AS (SELECT document_id, count(*) AS pages, count(*) FILTER (length(trim(text)) >= 300) AS pages_with_text FROM page GROUP BY 1), r AS (SELECT *, round(pages_with_text / pages, 4) AS coverage FROM s)
SELECT *, CASE WHEN coverage >= 0.2 THEN 'usable' WHEN coverage >= 0.05 THEN 'partial' ELSE 'unusable' END AS status, CASE WHEN coverage >= 0.7 THEN 'textual' WHEN coverage >= 0.2 THEN 'mixed' ELSE 'scanned' END AS ocr_class FROM r""")
def a14(spark, sf):
    return a.coverage(pages(spark, sf), least=300)


@query("a17_ocr_merge_pages", f"WITH {PAGES_SQL} SELECT document_id, page_number, CASE WHEN page_number % 2 = 0 THEN 'OCR ' || page_number ELSE text END AS text FROM page")
def a17(spark, sf):
    p = pages(spark, sf)
    ocr = p.where("page_number % 2 = 0").select("document_id", "page_number", F.concat(F.lit("OCR "), F.col("page_number").cast("string")).alias("ocr"))
    return p.join(ocr, ["document_id", "page_number"], "left").select("document_id", "page_number", F.coalesce("ocr", "text").alias("text"))


@query("a18_recurrent", sql(", x AS (SELECT ruc, entidad_ruc, external_id, fecha, count(*) OVER (PARTITION BY ruc, entidad_ruc ORDER BY fecha RANGE BETWEEN INTERVAL 60 DAY PRECEDING AND CURRENT ROW) - 1 AS n_before FROM won) SELECT * FROM x WHERE n_before > 2"))
def a18(spark, sf):
    return a.recurrent(star.won(spark, sf), days=60, more_than=2, buyer="entidad_ruc")


@query("a19_case_score", "WITH f AS (SELECT doc_id AS case_id, max(CASE WHEN contains(text, '$$$') THEN 8 WHEN contains(text, ' | ') THEN 6 ELSE 3 END) AS s FROM documents GROUP BY 1) SELECT case_id, round(s + least(o_totalprice::DECIMAL(18,2)::DOUBLE / 1e7, 1.5) + 0.9 - 1, 4) AS score FROM f JOIN orders ON o_orderkey = case_id WHERE round(s + least(o_totalprice::DECIMAL(18,2)::DOUBLE / 1e7, 1.5) + 0.9 - 1, 4) >= 7")
def a19(spark, sf):
    t = F.col("text")
    flags = star.read(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), F.when(t.contains("$$$"), "high").when(t.contains(" | "), "medium").otherwise("low").alias("severity"))
    amounts = star.read(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("monto"))
    return a.case_scores(flags, amounts, F.lit(0.9))


# -- text

@query("x2_needs_ocr", f"WITH {PAGES_SQL} SELECT document_id, page_number, length(trim(text)) < 300 AS needs_ocr FROM page")
def x2(spark, sf):
    return pages(spark, sf).select("document_id", "page_number", c.needs_ocr(F.col("text"), 300).alias("needs_ocr"))


@query("x1_clean_text", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || '  ' || chr(10) || chr(10) || chr(10) || chr(10) || 'fin-' || chr(10) || 'al', '([0-9A-Za-z_À-ÖØ-öø-ÿ])-\n([0-9A-Za-z_À-ÖØ-öø-ÿ])', '\1\2', 'g'), '[ \t]+\n', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS h FROM documents")
def x1(spark, sf):
    return star.read(spark, sf, "documents").select("doc_id", F.md5(c.clean_text(F.concat("text", F.lit("  \n\n\n\nfin-\nal")))).alias("h"))


@query("x3_header_footer", f"""WITH {PAGES_SQL.replace('text FROM', "'CABECERA ' || (doc_id % 2) || chr(10) || text || chr(10) || 'PIE' AS text FROM")}, l AS (SELECT document_id, page_number, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM page),
e AS (SELECT DISTINCT document_id, page_number, unnest([ls[1], ls[-1]]) AS line FROM l), k AS (SELECT document_id, line, count(*) AS n FROM e WHERE length(line) BETWEEN 2 AND 120 AND NOT (regexp_matches(line, '[.?!]$') AND len(regexp_split_to_array(line, '\\s+')) > 6) GROUP BY 1, 2)
SELECT document_id, line, n FROM k JOIN (SELECT document_id, count(*) AS pages FROM page GROUP BY 1) USING (document_id) WHERE pages >= 3 AND n >= greatest(3, ceil(pages * 0.5))""")
def x3(spark, sf):
    p = pages(spark, sf).withColumn("text", F.concat(F.lit("CABECERA "), (F.col("doc_id") % 2).cast("string"), F.lit("\n"), "text", F.lit("\nPIE")))
    return tx.boilerplate(p)


@query("x7_normalize", "SELECT doc_id, md5(upper(replace(translate(text, 'áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ', 'aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC'), 'ß', 'SS'))) AS h FROM documents")
def x7(spark, sf):
    return star.read(spark, sf, "documents").select("doc_id", F.md5(F.upper(c.fold(F.col("text")))).alias("h"))


@query("x8_cluster_label", "SELECT p_partkey, ['Plazos', 'Forma de pago', 'Penalidades', 'Otros'][(p_partkey % 4 + 1)::INT] AS label FROM part")
def x8(spark, sf):
    text = F.element_at(F.array(*map(F.lit, ["3. Plazo de ejecución", "pagos y facturación", "MULTAS", "xyz"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    return star.read(spark, sf, "part").select("p_partkey", c.cluster(F.when(F.col("p_partkey") % 2 == 0, text), text).alias("label"))


DOT = "round(list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"


@query("x11_vector_topk", f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, {DOT} AS score FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q)
SELECT query_id, chunk_id, score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INT AS rank FROM s) WHERE rank <= 20""")
def x11(spark, sf):
    e = star.read(spark, sf, "embeddings")
    return vector_index.exact(e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v")), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")))


BM25 = r"""w AS (SELECT doc_id AS chunk_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0b\f\r]+'), lambda x: x <> '')) AS token FROM documents), dl AS (SELECT doc_id AS chunk_id, len(list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0b\f\r]+'), lambda x: x <> '')) AS dl FROM documents),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), tf AS (SELECT chunk_id, token, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT token, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, st GROUP BY token),
m AS (SELECT avg(idf) AS mean FROM df), q AS (SELECT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0b\f\r]+'), lambda x: x <> '')) AS token FROM benchmark WHERE item_id % 20 = 0),
sc AS (SELECT query_id, chunk_id, round(sum(CASE WHEN idf < 0 THEN 0.25 * mean ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN df USING (token) JOIN tf USING (token) JOIN dl USING (chunk_id), st, m GROUP BY ALL),
bm AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INT AS rank FROM sc WHERE score > 0)"""


def bm25(spark, sf):
    docs = star.read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return tx.bm25(docs, star.read(spark, sf, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))


@query("x12_bm25_topk", f"WITH {BM25} SELECT query_id, chunk_id, score, rank FROM bm WHERE rank <= 20")
def x12(spark, sf):
    return bm25(spark, sf)


VEC = "vec AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, " + DOT + " AS score FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q))"


@query("x13_rrf_hybrid", f"""WITH {BM25}, {VEC}, u AS (SELECT query_id, chunk_id, rank FROM bm WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, rank FROM vec WHERE rank <= 20), f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM u GROUP BY ALL)
SELECT * FROM (SELECT query_id, chunk_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INT AS rank FROM f WHERE chunk_id IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)) WHERE rank <= 5""")
def x13(spark, sf):
    e, docs = star.read(spark, sf, "embeddings"), star.read(spark, sf, "documents")
    vec = vector_index.exact(e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v")), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")))
    return tx.fuse([bm25(spark, sf), vec], allowed=docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("chunk_id")))


RULE_WORDS = {"R-A": ("signs", "high", 30, (r"[a-z]+\$\$\$", r"[a-z]+###")), "R-B": ("list", "medium", 20, (r"[a-z]+ \| [a-z]+",))}


@query("x23_score", """WITH f AS (SELECT source AS document_id, count(*) AS n, sum(CASE WHEN contains(text, '$$$') THEN 30 ELSE 10 END) AS base, max((lang = 'fr')::INT) AS anchor, max((n_chars > 5000)::INT) AS evidence FROM documents WHERE contains(text, '$$$') OR contains(text, '!!') GROUP BY 1),
j AS (SELECT document_id, n, (CASE WHEN n IS NULL THEN 0 ELSE least(base + 15 * anchor + 15 * evidence + CASE WHEN substr(document_id, 4)::INT % 2 = 0 THEN 10 ELSE 0 END, 100) END)::INT AS score, substr(document_id, 4)::INT % 2 = 0 AS k, evidence FROM (SELECT DISTINCT source AS document_id FROM documents) LEFT JOIN f USING (document_id))
SELECT document_id, score, concat_ws(',', CASE WHEN n IS NULL THEN 'no_flags' END, CASE WHEN NOT k THEN 'no_key' END, CASE WHEN evidence = 0 THEN 'no_evidence' END) AS blockers, coalesce(score >= 75 AND n IS NOT NULL AND k AND evidence > 0, false) AS active FROM j""")
def x23(spark, sf):
    docs = star.read(spark, sf, "documents").withColumn("document_id", F.col("source"))
    t = F.col("text")
    flags = docs.where(t.contains("$$$") | t.contains("!!")).select("document_id", F.when(t.contains("$$$"), "high").otherwise("low").alias("severity"), F.when(F.col("lang") == "fr", "q").alias("anchor_quote"), F.when(F.col("n_chars") > 5000, "q").alias("evidence_quote"))
    context = docs.select("document_id").distinct().withColumn("has_key", F.substring("document_id", 4, 9).cast("int") % 2 == 0)
    return tx.score(flags, context)


_REASONS = ["quote_empty", "page_invalid", "chunk_id_missing", "quote_not_literal", "anchor_missing", "anchor_quote_empty", "anchor_source_empty", "low_confidence"]


@query("x21_critic", "SELECT item_id, reason, reason IS NULL AS accepted FROM (SELECT item_id, CASE item_id % 10 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(_REASONS)) + " END AS reason FROM benchmark)")
def x21(spark, sf):
    """Every benchmark text as a flag that fails one check, or none, or (the last) names a chunk that is not given."""
    b, k = star.read(spark, sf, "benchmark"), F.col("item_id") % 10
    fails = lambda i, bad, good: F.when(k == i, bad).otherwise(good)
    flags = b.select(
        "item_id", F.when(k == 2, None).when(k == 9, -1).otherwise(F.col("item_id")).alias("chunk_id"), F.when(k == 0, " ").when(k == 3, "zzz not there").otherwise(F.substring("text", 5, 30)).alias("quote"), fails(1, 0, 3).alias("page_number"),
        fails(4, F.lit(None), "a").alias("anchor_id"), fails(5, "", "q").alias("anchor_quote"), fails(6, " ", "s").alias("anchor_source"), fails(7, 0.1, 0.9).alias("confidence"),
    )
    return tx.critique(flags, b.select(F.col("item_id").alias("chunk_id"), "text"), dual=True).select("item_id", "reason", "accepted")


@query("x29_smoke_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') ORDER BY doc_id LIMIT 20")
def x29(spark, sf):
    return star.read(spark, sf, "documents").where(F.lower(c.fold(F.col("text"))).contains("license")).select("doc_id").orderBy("doc_id").limit(20)


@query("x31_embed_inputs", "SELECT conv_id, turn, text FROM conversations WHERE trim(text) <> ''")
def x31(spark, sf):
    return star.read(spark, sf, "conversations").where("trim(text) <> ''").select("conv_id", "turn", "text")


@query("n1_extract_companies", sql("SELECT ruc, estado, condicion, ubigeo FROM company WHERE regexp_matches(ruc, '^[0-9]{11}$')"))
def n1(spark, sf):
    j = star.companies(spark, sf).select("ruc", F.to_json(F.struct("estado", "condicion", "ubigeo")).alias("metadata"))
    get = lambda k: F.get_json_object("metadata", f"$.{k}").alias(k)
    return j.where(F.col("ruc").rlike("^[0-9]{11}$")).select("ruc", get("estado"), get("condicion"), get("ubigeo"))


@query("n4_extract_contracts", "SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def n4(spark, sf):
    return star.read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("double").alias("k")).where("k is not null")
