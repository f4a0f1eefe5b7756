"""Further queries: packs, manifests, register rows, html, reads; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import audits as a
from ..operators import documents as d
from ..operators import extract
from ..operators import releases as rel
from ..operators import text as tx
from . import star
from .records import PAGES_SQL, pages
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


@query("a1_discovery_fetch", sql("SELECT external_id, entidad, monto::DOUBLE AS monto FROM won WHERE fecha >= DATE '2001-01-01' AND (entidad ILIKE '%ugel%' OR entidad ILIKE '%hospital%')"))
def a1(spark, sf):
    return a.discovery(star.won(spark, sf), "2001-01-01", ["UGEL", "hospital"]).select("external_id", "entidad", F.col("monto").cast("double").alias("monto"))


@query("a4_recon_status", "SELECT conv_id, CASE WHEN max((turn = 3)::INT) = 1 THEN 'bases' WHEN max((turn = 2)::INT) = 1 THEN 'pliego' ELSE 'other' END AS status, count(*) AS n_documents FROM conversations GROUP BY conv_id")
def a4(spark, sf):
    title = F.when(F.col("turn") == 3, "Bases").when(F.col("turn") == 2, "PLIEGO 2").otherwise("x")
    return d.best_document(star.read(spark, sf, "conversations").select("conv_id", title.alias("title")), "conv_id", [("bases", "bases|tdr"), ("pliego", "pliego")])


KIND = "CASE WHEN turn = 0 THEN 'tdr' WHEN turn = 4 THEN 'award' ELSE 'other' END"


def pack_documents(spark, sf):
    t = F.col("turn")
    return star.read(spark, sf, "conversations").select("conv_id", "turn", F.when(t == 0, "tdr").when(t == 4, "award").otherwise("other").alias("kind"), (t + 1).alias("pages"), F.concat_ws(".", "conv_id", "turn").alias("doc"), "text")


INV = f"""inv AS (SELECT conv_id, count(*) AS total_documents, sum(turn + 1)::BIGINT AS total_pages, max((k = 'tdr')::INT) AS has_tdr, max((k = 'award')::INT) AS has_award FROM (SELECT *, {KIND} AS k FROM conversations) GROUP BY conv_id),
inv2 AS (SELECT *, CASE WHEN has_tdr = 1 AND has_award = 1 THEN 'investigative' WHEN has_tdr = 1 THEN 'preventive' ELSE 'unknown' END AS mode, concat_ws(',', CASE WHEN has_tdr = 0 THEN 'tdr' END, CASE WHEN has_award = 0 THEN 'award' END) AS missing FROM inv)"""


@query("a20_pack_inventory", f"WITH {INV} SELECT * FROM inv2")
def a20(spark, sf):
    return d.inventory(pack_documents(spark, sf), "conv_id")


@query("a21_pack_strategy", f"WITH {INV} SELECT conv_id, mode, t AS evidence_threshold, k AS top_k FROM inv2 LEFT JOIN (VALUES ('preventive', 0.6::DOUBLE, 5), ('investigative', 0.5::DOUBLE, 8), ('unknown', 0.7::DOUBLE, 3)) v(mode, t, k) USING (mode)")
def a21(spark, sf):
    return d.strategy(d.inventory(pack_documents(spark, sf), "conv_id")).select("conv_id", "mode", "evidence_threshold", "top_k")


@query("a22_pack_graph", f"SELECT DISTINCT 'pack:' || conv_id AS source, 'doc:' || conv_id || '.' || turn AS target, 'HAS_DOCUMENT' AS kind FROM conversations UNION SELECT DISTINCT 'doc:' || conv_id || '.' || turn, 'kind:' || {KIND}, 'OF_KIND' FROM conversations")
def a22(spark, sf):
    return d.pack_graph(pack_documents(spark, sf), "conv_id", "doc")


@query("a11_batch_metrics", "SELECT CASE WHEN n_chars = 0 THEN '0' WHEN n_chars < 1000 THEN '1-999' WHEN n_chars < 5000 THEN '1000-4999' ELSE '5000+' END AS bucket, count(*) AS n, count(*) FILTER (lang = 'en') AS n_en FROM documents GROUP BY 1")
def a11(spark, sf):
    bucket = c.bucket(F.col("n_chars"), [(1, "1-999"), (1000, "1000-4999"), (5000, "5000+")], "0")
    return star.read(spark, sf, "documents").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("n_en"))


@query("a15_pdf_ocr_class", f"WITH {PAGES_SQL}, s AS (SELECT document_id, round(count(*) FILTER (length(trim(text)) >= 2000) / count(*), 4) AS coverage FROM page GROUP BY 1) SELECT document_id, CASE WHEN coverage >= 0.7 THEN 'textual' WHEN coverage >= 0.2 THEN 'mixed' ELSE 'scanned' END AS ocr_class FROM s")
def a15(spark, sf):
    return a.coverage(pages(spark, sf), least=2000).select("document_id", "ocr_class")


@query("a16_ocr_bridge", "SELECT o_orderkey, ocid, CASE WHEN ocid IS NULL THEN 'no_ocid' WHEN n IS NULL THEN 'no_contract' END AS reason FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 > 0 THEN o_orderkey END AS ocid FROM orders) LEFT JOIN (SELECT l_orderkey AS ocid, count(*) AS n FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY 1) USING (ocid)")
def a16(spark, sf):
    o, line = star.read(spark, sf, "orders"), star.read(spark, sf, "lineitem")
    manifest = o.select("o_orderkey", F.when(F.col("o_orderkey") % 10 > 0, F.col("o_orderkey")).alias("ocid"))
    contracts = line.where("l_partkey % 3 = 0").select(F.col("l_orderkey").alias("ocid"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("external_id"))
    return d.bridge(manifest, contracts).select("o_orderkey", "ocid", "reason")


@query("c9_source_health", "SELECT n_name AS source_code, CASE WHEN n_nationkey % 4 = 0 THEN 'unknown' WHEN n_nationkey % 3 = 0 THEN 'failed' WHEN n_nationkey % 2 = 0 THEN 'degraded' ELSE 'ok' END AS health FROM nation")
def c9(spark, sf):
    k = F.col("n_nationkey")
    reg = star.read(spark, sf, "nation").select(F.col("n_name").alias("source_code"), F.when(k % 4 == 0, "playwright").otherwise("api").alias("source_type"), (k % 3 > 0).alias("collector"), (k % 2 > 0).alias("local_data"))
    return d.source_health(reg).select("source_code", "health")


@query("t6_sunat_row", sql("SELECT ruc, concat_ws(' ', 'AV.', empresa, suppkey::VARCHAR) AS domicilio, substr(ubigeo, 1, 2) AS region FROM company"))
def t6(spark, sf):
    return star.companies(spark, sf).select("ruc", F.concat_ws(" ", F.lit("AV."), "empresa", F.col("suppkey").cast("string")).alias("domicilio"), c.region_code(F.col("ubigeo")).alias("region"))


@query("t9_sanction_row", "SELECT s_suppkey, ['MULTA', 'INHABILITACION', 'OTRA'][(s_suppkey % 3 + 1)::INT] AS tipo, s_suppkey % 3 = 0 OR s_suppkey % 5 < 3 AS active FROM supplier")
def t9(spark, sf):
    k = F.col("s_suppkey")
    tipo = F.when(k % 3 == 0, "Multa económica").when(k % 3 == 1, "inhabilitación temporal").otherwise("x")
    norm = F.upper(c.fold(tipo))
    kind = F.when(norm.contains("MULTA"), "MULTA").when(norm.contains("INHABILIT"), "INHABILITACION").otherwise("OTRA")
    until = F.date_add(F.lit("2000-01-03").cast("date"), -(k % 5).cast("int"))
    return star.read(spark, sf, "supplier").select("s_suppkey", kind.alias("tipo"), d.active_sanction(F.when(k % 3 == 0, "Sanción vigente"), until, "2000-01-01").alias("active"))


@query("t32_evidence_quote", sql("SELECT external_id, CASE WHEN suppkey % 5 = 0 THEN 'Proveedor no identificado' ELSE empresa END || ' gano contrato con ' || entidad || CASE WHEN suppkey % 7 = 0 THEN '' ELSE ' por ' || monto::DECIMAL(18,2)::VARCHAR END || '.' AS quote FROM won"))
def t32(spark, sf):
    k = F.col("suppkey")
    return star.won(spark, sf).select("external_id", rel.won_sentence(F.when(k % 5 > 0, F.col("empresa")), F.col("entidad"), F.when(k % 7 > 0, F.col("monto"))).alias("quote"))


X26 = f"""WITH f AS (SELECT conv_id, turn, 'F' || turn % 3 AS code, 'Name ' || turn % 3 AS name, turn + 1 AS page, ((turn + conv_id) % 5)::DOUBLE / 4 AS confidence FROM conversations WHERE turn % 2 = 1 AND conv_id % 5 > 0),
q AS (SELECT conv_id, 'q' || turn % 4 AS q, min(turn) AS t FROM f GROUP BY ALL), s AS (SELECT conv_id, array_to_string(list(q ORDER BY t)[1:5], ',') AS questions FROM q GROUP BY conv_id),
g AS (SELECT conv_id, count(*) AS n, avg(confidence) AS c, string_agg(code, ', ' ORDER BY turn) AS codes, string_agg('- ' || name || ': why (pag. ' || page || ')', chr(10) ORDER BY turn) AS lines FROM f GROUP BY conv_id)
SELECT conv_id, coalesce(n, 0)::BIGINT AS n, CASE WHEN c >= 0.65 THEN 'high' WHEN c >= 0.40 THEN 'medium' ELSE 'low' END AS level, coalesce(questions, '') AS questions,
  CASE WHEN n > 0 THEN replace(replace('{d.WITH_FLAGS}', '%d', n::VARCHAR), '%s', codes) || chr(10) || chr(10) || '{d.DETAIL}' || chr(10) || lines ELSE '{d.NO_FLAGS}' END AS summary
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN g USING (conv_id) LEFT JOIN s USING (conv_id)"""


@query("x26_synthesize", X26)
def x26(spark, sf):
    talk, t = star.read(spark, sf, "conversations"), F.col("turn")
    code, s = (t % 3).cast("string"), lambda x: F.lit(x)
    flags = talk.where("turn % 2 = 1 and conv_id % 5 > 0").select(
        "conv_id", t.alias("flag_id"), F.concat(s("F"), code).alias("flag_code"), F.concat(s("Name "), code).alias("flag_name"), s("why").alias("explanation"), (t + 1).alias("page_number"),
        (((t + F.col("conv_id")) % 5) / 4).alias("confidence"), F.array(F.concat(s("q"), (t % 4).cast("string"))).alias("questions"),
    )
    return d.synthesis(flags, talk, "conv_id")


@query("x30_doc_class", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'tdr' WHEN p_partkey % 4 = 1 THEN 'contrato' WHEN p_partkey % 4 = 2 THEN 'tdr' ELSE 'unknown' END AS kind FROM part")
def x30(spark, sf):
    k = F.col("p_partkey") % 4
    docs = star.read(spark, sf, "part").select("p_partkey", F.when(k == 0, "tdr contrato").when(k == 1, "contrato").otherwise("x").alias("name"), F.when(k == 1, "tdr").when(k == 2, "el tdr y contrato").otherwise("").alias("text"))
    return d.classify(docs, [("tdr", 90, r"\btdr\b"), ("contrato", 50, r"\bcontrato\b")]).select("p_partkey", "kind")


@query("x32_token_search", "SELECT doc_id FROM documents WHERE list_contains(string_split(lower(text), ' '), 'the') AND list_contains(string_split(lower(text), ' '), 'with')")
def x32(spark, sf):
    return tx.token_search(star.read(spark, sf, "documents"), "the", "with").select("doc_id")


@query("n7_extract_represents", sql("SELECT ruc, person_id FROM company WHERE suppkey % 2 = 0"))
def n7(spark, sf):
    rel = star.companies(spark, sf).select("ruc", "person_id", F.to_json(F.create_map(F.when(F.col("suppkey") % 2 == 0, "cargo").otherwise("x"), F.lit("gerente"))).alias("properties"))
    return rel.where(F.get_json_object("properties", "$.cargo").isNotNull()).select("ruc", "person_id")


@query("n11_resolve_record", "SELECT o_orderkey::VARCHAR AS wanted, arg_min(l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey, (-l_extendedprice::DECIMAL(18,2), l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey)) AS external_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def n11(spark, sf):
    wanted = star.read(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("wanted"))
    records = star.read(spark, sf, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("external_id"), F.col("l_extendedprice").cast("decimal(18,2)").alias("monto"))
    return d.resolve(wanted, records).select("wanted", "external_id")


@query("n12_doc_external_id", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN page_id::VARCHAR WHEN page_id % 3 = 1 THEN 'c' || page_id ELSE sha256(url) END AS key, substr(sha1(url || '::' || page_id), 1, 16) AS document_id FROM pages")
def n12(spark, sf):
    k, s = F.col("page_id"), F.col("page_id").cast("string")
    return star.read(spark, sf, "pages").select("page_id", d.doc_key(F.when(k % 3 == 0, s), F.when(k % 3 == 1, F.concat(F.lit("c"), s)), F.col("url")).alias("key"), d.document_id(F.col("url"), k).alias("document_id"))


@query("n13_batch_selection", "SELECT source, doc_id, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents) WHERE place <= 3")
def n13(spark, sf):
    return d.first_per_contract(star.read(spark, sf, "documents"), "source", 3, F.desc("n_chars"), F.col("doc_id")).select("source", "doc_id", "place")


@query("n16_index_stats", """SELECT lang, any_value(n) AS n, string_agg(doc_id || '=' || md5(substr(text, 1, 200)), ',' ORDER BY doc_id) AS samples FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) WHERE k <= 3 GROUP BY lang""")
def n16(spark, sf):
    stats = extract.flag_samples(star.read(spark, sf, "documents").select("lang", F.col("doc_id").alias("chunk_id"), "text"), "lang")
    return stats.withColumn("samples", F.array_join(F.transform("samples", lambda x: F.concat_ws("=", x["chunk_id"].cast("string"), F.md5(x["quote"]))), ","))


@query("n19_production_guard", "SELECT page_id FROM pages WHERE page_id % 3 > 0")
def n19(spark, sf):
    p = star.read(spark, sf, "pages").withColumn("path", F.concat(F.lit("/data/"), F.when(F.col("page_id") % 3 == 0, "fixtures").otherwise("raw"), F.lit("/a.json")))
    return d.guard(p, "path").select("page_id")


@query("n26_link_discovery", """SELECT DISTINCT page_id, href, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || href ELSE NULL END AS target
FROM (SELECT page_id, url, trim(unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']([^"''<>]+)["'']', 1))) AS href FROM pages) WHERE href <> '' AND NOT regexp_matches(href, '^(?i)(#|javascript:|mailto:)')""")
def n26(spark, sf):
    """Addresses beside the page are left to the tests: their targets are null on both sides."""
    beside = ~(F.col("href").startswith("/") | F.col("href").rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"))
    return extract.links(star.read(spark, sf, "pages")).select("page_id", "href", F.when(~beside, F.col("target")).alias("target"))


@query("n22_ruc_lookup", sql("SELECT ruc, CASE WHEN suppkey % 2 = 0 THEN empresa ELSE '' END AS razon_social, CASE WHEN suppkey % 2 = 0 THEN estado ELSE 'NO_ENCONTRADO' END AS estado, CASE WHEN suppkey % 2 = 0 THEN condicion ELSE '' END AS condicion, CASE WHEN suppkey % 2 = 0 THEN ubigeo ELSE '' END AS ubigeo FROM company"))
def n22(spark, sf):
    co = star.companies(spark, sf)
    return d.register_lookup(co, co.where("suppkey % 2 = 0").withColumnRenamed("empresa", "razon_social"))
