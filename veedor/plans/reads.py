"""Queries that go through files (sources and sinks) and the remaining record reads; each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import documents as d
from ..operators import extract, runs
from ..operators import releases as rel
from ..operators import text as tx
from ..sources import readers, sinks
from ..sources.shared import fresh_path
from . import graph, star
from .records import CHANGES, PAGES_SQL, RULE_WORDS, T1, pages, releases, snapshot
from .signals import DOSSIER_SQL, dossier_tables
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


@query("s1_release_scan", f"WITH {T1} SELECT * FROM flat")
def s1(spark, sf):
    path = fresh_path(spark, "releases")
    releases(spark, sf).write.option("compression", "gzip").json(path)
    return rel.flatten(readers.releases(spark, path))


@query("s3_register_scan", sql("SELECT ruc, empresa AS razon_social, estado, condicion, ubigeo FROM company"))
def s3(spark, sf):
    path = fresh_path(spark, "register")
    co = star.companies(spark, sf)
    co.select(F.concat_ws("|", "ruc", "empresa", "estado", "condicion", "ubigeo").alias("value")).write.text(path)
    return readers.register(spark, path).select("ruc", "razon_social", "estado", "condicion", "ubigeo")


@query("s4_delimited_scan", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def s4(spark, sf):
    path = fresh_path(spark, "nations")
    star.read(spark, sf, "nation").select("n_nationkey", "n_name").write.options(header=True, sep=";").csv(path)
    return readers.delimited(spark, path, ("n_nationkey",)).select("n_nationkey", "n_name")


@query("s12_source_registry", "SELECT n_name AS source_code, 'P0' AS priority FROM nation WHERE n_nationkey % 2 = 0")
def s12(spark, sf):
    rows = [(r.n_name, "api", f"P{r.n_nationkey % 2}", "active") for r in star.read(spark, sf, "nation").collect()]  # a registry of sources, one row each
    return readers.sources(spark, rows, "active", "P0").select("source_code", "priority")


@query("s13_jsonl", "SELECT user_id, event_type, value FROM events ")
def s13(spark, sf):
    path = fresh_path(spark, "events")
    star.read(spark, sf, "events").select("user_id", "event_type", "value").write.json(path)
    return readers.jsonl(spark, path, "user_id long, event_type string, value double")


@query("k4_idempotent_load", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def k4(spark, sf):
    path = fresh_path(spark, "loaded")
    e = star.read(spark, sf, "events").select("user_id", "event_id")
    for part in (0, 1, 1):  # the second load is run again, as after a failure
        table = sinks.merge_table(e.where(F.col("event_id") % 2 == part), path, ["user_id"], "event_id")
    return table


@query("k5_json_artifacts", "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def k5(spark, sf):
    path = fresh_path(spark, "artifacts")
    sinks.json_artifacts(star.read(spark, sf, "documents").select("source", "doc_id", "n_chars"), path, "source")
    return spark.read.schema("doc_id long, n_chars long, source string").json(path).groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("k6_csv_writers", "SELECT r_regionkey::VARCHAR AS r_regionkey, r_name FROM region")
def k6(spark, sf):
    path = fresh_path(spark, "csv")
    sinks.csv_tables({"region": star.read(spark, sf, "region").select("r_regionkey", "r_name")}, path)
    return readers.delimited(spark, f"{path}/region")


@query("g9_findings_text", sql(f", {graph.FLAGGED} SELECT ruc, '# ' || ruc || chr(10) || string_agg(line, chr(10) ORDER BY line) AS body FROM (SELECT DISTINCT ruc, '- ' || ocid || ': ' || flag_code AS line FROM cf) GROUP BY ruc"))
def g9(spark, sf):
    flags, _, contracts = dossier_tables(spark, sf)
    lines = flags.join(contracts, "ocid").groupBy("ruc").agg(F.array_sort(F.collect_set(F.concat(F.lit("- "), F.col("ocid").cast("string"), F.lit(": "), F.col("flag_code")))).alias("l"))
    return lines.select("ruc", F.concat(F.lit("# "), F.col("ruc"), F.lit("\n"), F.array_join("l", "\n")).alias("body"))


@query("n2_extract_public_entities", sql("SELECT entidad_ruc, entidad, region FROM entity WHERE regexp_matches(entidad_ruc, '^[0-9]{11}$')"))
def n2(spark, sf):
    return extract.public_entities(star.entities(spark, sf)).select("entidad_ruc", "entidad", "region")


@query("n3_extract_persons", sql("SELECT DISTINCT person_id FROM company"))
def n3(spark, sf):
    return extract.persons(star.companies(spark, sf))


@query("n5_extract_documents", sql(f", {DOSSIER_SQL.strip()} SELECT ocid, total_score, risk_level FROM dossier WHERE total_flags > 0"))
def n5(spark, sf):
    return extract.flagged_documents(dossier_tables(spark, sf)[1]).select("ocid", "total_score", "risk_level")


@query("n8_extract_official", graph.esql("SELECT person_id, entidad_ruc FROM official"))
def n8(spark, sf):
    return graph.edges(spark, sf)["official"]


@query("n9_extract_committee", graph.esql("SELECT external_id, person_id FROM committee"))
def n9(spark, sf):
    return graph.edges(spark, sf)["committee"]


@query("n14_prepare_analyzer", f"WITH {PAGES_SQL} SELECT document_id, count(*) AS pages, CASE WHEN count(*) FILTER (length(text) > 100) = 0 THEN 'skipped' ELSE 'ready' END AS status FROM page GROUP BY 1")
def n14(spark, sf):
    out = pages(spark, sf).groupBy("document_id").agg(F.count("*").alias("pages"), F.count_if(F.length("text") > 100).alias("k"))
    return out.select("document_id", "pages", F.when(F.col("k") == 0, "skipped").otherwise("ready").alias("status"))


@query("n15_prepare_loader", f"WITH {PAGES_SQL} SELECT document_id, page_number, length(text) AS char_count FROM page WHERE length(text) > 0")
def n15(spark, sf):
    return extract.page_rows(pages(spark, sf))


@query("n17_mime_type", "SELECT page_id, CASE WHEN url LIKE '%.html%' THEN 'text/html' ELSE 'application/octet-stream' END AS mime FROM pages")
def n17(spark, sf):
    kind = c.file_type(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("url"))
    return star.read(spark, sf, "pages").select("page_id", F.when(kind == "html", "text/html").otherwise("application/octet-stream").alias("mime"))


@query("n18_pages_inspect", f"WITH {PAGES_SQL} SELECT document_id, count(*) AS pages, count(*) FILTER (length(text) > 0) AS with_text, sum(length(text))::BIGINT AS chars, round(avg(length(text)), 2) AS mean, round(100.0 * count(*) FILTER (length(text) > 0) / count(*), 2)::DOUBLE AS coverage_pct FROM page GROUP BY 1")
def n18(spark, sf):
    return extract.coverage(pages(spark, sf))


@query("n21_sanction_active", "SELECT o_orderkey, o_orderstatus = 'P' OR o_orderdate::DATE >= DATE '1998-06-01' AS active FROM orders")
def n21(spark, sf):
    """Orders play sanctions: their status says vigente, terminada or nothing, their date is the end."""
    said = F.when(F.col("o_orderstatus") == "P", "sancion vigente").when(F.col("o_orderstatus") == "F", "terminada")
    return star.read(spark, sf, "orders").select("o_orderkey", d.active_sanction(said, F.to_date("o_orderdate"), "1998-06-01").alias("active"))


@query("n24_get_dossier", sql(f", {DOSSIER_SQL.strip()} SELECT d.ocid, total_score, flag_code FROM dossier d LEFT JOIN flag f ON f.doc_id = d.ocid"))
def n24(spark, sf):
    flags, dossiers, _ = dossier_tables(spark, sf)
    return dossiers.join(flags.select("ocid", "flag_code"), "ocid", "left").select("ocid", "total_score", "flag_code")


@query("n25_demo_cases", sql(f""", {DOSSIER_SQL.strip()}, head AS (SELECT doc_id AS ocid, arg_max(flag_code, score) AS headline_quote, 1 AS headline_page FROM flag GROUP BY 1)
SELECT v.ocid, v.title, coalesce(d.risk_level, 'SIN_DATOS') AS risk_level, coalesce(total_score, 0)::INT AS score, coalesce(total_flags, 0)::BIGINT AS flag_count, headline_quote, headline_page
FROM (VALUES (1::BIGINT, 'A'), (5::BIGINT, 'B'), (-1::BIGINT, 'C')) v(ocid, title) LEFT JOIN dossier d USING (ocid) LEFT JOIN head USING (ocid)"""))
def n25(spark, sf):
    flags, dossiers, _ = dossier_tables(spark, sf)
    cases = spark.createDataFrame([(1, "A"), (5, "B"), (-1, "C")], "ocid long, title string")
    told = flags.select("ocid", (-F.col("score")).alias("flag_id"), "severity", F.col("flag_code").alias("evidence_quote"), F.col("page").alias("page_number"))
    return d.demo_cases(cases, dossiers, told)


@query("t3_party_region", "SELECT 'ocds-' || o_orderkey AS ocid, 'lima' AS region, 1.0::DOUBLE AS contract_amount FROM orders")
def t3(spark, sf):
    r = releases(spark, sf)
    return r.select("ocid", rel.party(F.col("parties"), "buyer")["address"]["department"].alias("region"), F.get("contracts", F.lit(0))["value"]["amount"].cast("double").alias("contract_amount"))


@query("t5_case_record", """WITH a AS (SELECT l_orderkey, arg_min(struct_pack(p := l_extendedprice, k := l_partkey, s := l_suppkey), concat_ws('-', l_linenumber, l_partkey, l_suppkey)) AS a FROM lineitem WHERE l_orderkey % 50 > 0 GROUP BY 1)
SELECT 'ocds-' || o_orderkey AS code, 'C' || o_custkey AS entity, 'b' AS entity_id, 'Title' AS object, coalesce(o_totalprice, 0)::DOUBLE AS amount, coalesce(a.p, o_totalprice, 0)::DOUBLE AS awarded,
  CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '2024-01-01' END AS called_on, '2024-01-01' AS awarded_on, CASE WHEN o_orderkey % 3 = 0 THEN 4 ELSE 1 END AS n_bidders,
  CASE WHEN a.k % 10 > 0 THEN 'PE-RUC-20' || lpad(a.s::VARCHAR, 9, '0') ELSE '' END AS bidders, 'OCDS/OECE' AS source FROM orders LEFT JOIN a ON o_orderkey = l_orderkey""")
def t5(spark, sf):
    k = F.substring_index("ocid", "-", -1).cast("long")
    tender = F.col("tender").withField("numberOfTenderers", F.when(k % 3 == 0, 4)).withField("tenderPeriod", F.struct(F.when(k % 2 == 0, F.col("date")).alias("startDate"))).withField("description", F.lit(None).cast("string"))
    return rel.case_record(releases(spark, sf).withColumn("tender", tender), "2024-01-01").withColumn("bidders", F.array_join("bidders", ","))


@query("t34_discovery_row", sql("SELECT external_id, coalesce(entidad, '') AS entidad, coalesce(empresa, '') AS proveedor, coalesce(modalidad, '') AS objeto, monto::DOUBLE AS monto, coalesce(fecha::VARCHAR, '') AS fecha FROM won"))
def t34(spark, sf):
    return extract.discovery_rows(star.won(spark, sf))


@query("x6_paragraph_chunks")
def x6(spark, sf):
    said = F.when(F.col("doc_id") % 5 == 0, "\n\nThe Discretion of the Evaluator\nsole source or equivalent; audit trail").otherwise("")
    return tx.paragraph_chunks(pages(spark, sf).withColumn("text", F.concat(F.regexp_replace("text", r"\. ", ".\n\n"), said))).withColumn("flag_codes", F.array_join("flag_codes", ","))


@query("x14_index_save_load", "SELECT vec_id, len(embedding)::INT AS dim, length(text) AS chars FROM embeddings LEFT JOIN documents ON doc_id = vec_id")
def x14(spark, sf):
    path = fresh_path(spark, "index")
    chunks = star.read(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    sinks.save_index(star.read(spark, sf, "embeddings").select("vec_id", "embedding"), path, "hash", 64, chunks)
    loaded = sinks.load_index(spark, path, "hash", 64).join(sinks.load_chunks(spark, path), "vec_id", "left")
    return loaded.select("vec_id", F.size("embedding").alias("dim"), F.length("text").cast("long").alias("chars"))


@query("k9_run_artifacts", f"WITH {PAGES_SQL} SELECT document_id, count(*) AS n FROM page WHERE regexp_matches(lower(translate(text, 'áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ', 'aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC')), '[a-z]+ \\| [a-z]+') GROUP BY 1")
def k9(spark, sf):
    path = fresh_path(spark, "run")
    flags = tx.page_flags(pages(spark, sf), [(k, *v) for k, v in RULE_WORDS.items() if k == "R-B"], most=None)
    flags.write.json(f"{path}/flags")
    return spark.read.schema("document_id string").json(f"{path}/flags").groupBy("document_id").agg(F.count("*").alias("n"))


@query("k9_run_audit", f"""{CHANGES}, k AS (SELECT count(*) AS n FROM c), r AS (SELECT count(*) FILTER (change = 'new') AS new, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'unchanged') AS unchanged FROM c)
SELECT 'completed' AS status, n AS records_seen, new AS records_new, modified AS records_changed, unchanged AS records_unchanged, new + modified AS changed_records, n AS hashes FROM k, r""")
def k9_audit(spark, sf):
    """A run over the whole events against the registry of an earlier day, and what it left: the audit's counters, lines of changed records, hashes."""
    done = runs.run(snapshot(spark, sf), snapshot(spark, sf, "2024-01-15"), fresh_path(spark, "run"), "events", "r1")
    lines, hashes = done.changed(spark).agg(F.count("*").alias("changed_records")), done.hashes(spark).agg(F.count("*").alias("hashes"))
    own = [F.col(f"source_run.{n}").alias(n) for n in ("status", "records_seen", "records_new", "records_changed", "records_unchanged")]
    return done.audit(spark).select(*own).join(lines).join(hashes)  # one row each


@query("s11_manual_manifest", "SELECT s_suppkey, row_number() OVER (ORDER BY s_name) AS place FROM supplier")
def s11(spark, sf):
    path = fresh_path(spark, "manifest")
    star.read(spark, sf, "supplier").select("s_suppkey", "s_name").write.option("header", True).csv(path)
    rows = readers.delimited(spark, path, ("s_suppkey", "s_name")).select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name")
    return rows.select("s_suppkey", F.row_number().over(W.orderBy("s_name")).cast("long").alias("place"))  # a hand-made manifest is small
