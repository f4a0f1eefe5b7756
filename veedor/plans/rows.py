"""Queries of rows, readers, loaders, case detectors and change runs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import rules
from ..operators import changes as ch
from ..operators import rows as r
from ..operators import text as tx
from ..sources import readers, sinks
from ..sources.shared import fresh_path, placed, written
from . import graph, star
from .chain import DESK_SQL, FLAGS_SQL, all_hits, listed, pick
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


@query("a18_single_bidder", """WITH k AS (SELECT o_orderkey AS case_id, CASE o_custkey % 4 WHEN 0 THEN 'Minsa Lima' WHEN 1 THEN 'GORE Cusco' WHEN 2 THEN 'MTC' ELSE 'Otra' END AS entidad, 1 + o_orderkey % 2 AS n, (o_orderkey % 40)::INT AS d FROM orders)
SELECT case_id, greatest(d, 1) AS dias_proceso, CASE WHEN upper(entidad) LIKE '%MTC%' THEN 45 WHEN upper(entidad) LIKE '%MINSA%' THEN 38 WHEN upper(entidad) LIKE '%GORE%' THEN 42 ELSE 40 END AS promedio_sector
FROM k WHERE n = 1 AND greatest(d, 1) < 0.5 * CASE WHEN upper(entidad) LIKE '%MTC%' THEN 45 WHEN upper(entidad) LIKE '%MINSA%' THEN 38 WHEN upper(entidad) LIKE '%GORE%' THEN 42 ELSE 40 END""")
def a18_single(spark, sf):
    o, k = star.read(spark, sf, "orders"), F.col("o_orderkey")
    day = F.lit("2020-01-01").cast("date")
    return r.single_bidder(o.select(k.alias("case_id"), pick(["Minsa Lima", "GORE Cusco", "MTC", "Otra"], F.col("o_custkey")).alias("entidad"), (1 + k % 2).alias("numero_postores"), day.alias("convocatoria"), F.date_add(day, (k % 40).cast("int")).alias("adjudicacion")))


@query("a18_split_awards", sql(", x AS (SELECT ruc, entidad_ruc, external_id, count(*) OVER w AS num_contratos, sum(monto) OVER w AS monto_total FROM won WINDOW w AS (PARTITION BY ruc, entidad_ruc ORDER BY fecha RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW)) SELECT ruc, entidad_ruc, external_id, num_contratos, monto_total::DOUBLE AS monto_total FROM x WHERE num_contratos >= 2 AND monto_total > 60000"))
def a18_split(spark, sf):
    return r.split_awards(star.won(spark, sf), amount=60_000).withColumn("monto_total", F.col("monto_total").cast("double"))


@query("a18_sanctioned_official", "SELECT DISTINCT o_orderkey AS case_id, substr(p, 1, 2) || '***' || substr(p, -2) AS masked FROM (SELECT o_orderkey, lpad((o_custkey % 50)::VARCHAR, 8, '0') AS p, o_custkey % 50 AS k FROM orders) WHERE k < 40 AND (k % 3 = 0 OR k % 5 < 3)")
def a18_sanctioned(spark, sf):
    person = lambda k: F.lpad(k.cast("string"), 8, "0")
    people = star.read(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), person(F.col("o_custkey") % 50).alias("person_id"))
    k = F.col("id")
    sanctions = spark.range(40).select(person(k).alias("person_id"), F.when(k % 3 == 0, "Sanción vigente").otherwise("cumplida").alias("vigencia"), F.date_add(F.lit("2000-01-03").cast("date"), -(k % 5).cast("int")).alias("hasta"))
    return r.sanctioned_officials(people, sanctions, "2000-01-01")


def open_rows(spark, sf):
    k, s = F.col("l_orderkey"), lambda x: x.cast("string")
    when = lambda n, v: F.when(k % 5 == n, v)
    return star.read(spark, sf, "lineitem").where("l_linenumber = 1").select(
        k.alias("key"), when(0, F.concat(F.lit(" P-"), s(k))).alias("Código Proceso"), when(1, F.concat(F.lit("N-"), s(k))).alias("NOMENCLATURA"), when(2, F.concat(F.lit("U"), s(k))).alias("uuid"), F.concat(F.lit("Entidad "), s(F.col("l_suppkey"))).alias("Comprador"),
        F.when(k % 2 == 0, F.concat(F.lit("20-"), F.lpad(s(F.col("l_suppkey")), 9, "0"))).otherwise("123").alias("Ruc Proveedor"), F.concat(F.lit("S/ 1,0"), s(F.col("l_quantity").cast("int") + 10), F.lit(".50")).alias("Monto Adjudicado"),
        F.when(k % 3 == 0, F.date_format("l_shipdate", "dd/MM/yyyy")).when(k % 3 == 1, F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T00:00:00"))).otherwise("sin fecha").alias("Fecha Publicacion"), F.lit("1995-1").alias("PERIODO"),
        when(3, "Proceso DESIERTO, único postor").otherwise("x").alias("descripcion"), F.when(k % 7 == 0, "Ana").otherwise("").alias("Integrante Comité"),
    )


_FECHA = "CASE WHEN k % 3 < 2 THEN l_shipdate::DATE END"
_MONTO = "(1000 + l_quantity::INT + 10)::DOUBLE + 0.5"
_SUPPLIER = "CASE WHEN k % 2 = 0 THEN '20' || lpad(l_suppkey::VARCHAR, 9, '0') END"


@query("t7_open_data_row", f"""SELECT k AS key, 'comites' AS category, 'committee_member' AS record_type, concat_ws(':', 'comites', coalesce(CASE k % 5 WHEN 0 THEN 'P-' || k WHEN 1 THEN 'N-' || k WHEN 2 THEN 'U' || k END), {_SUPPLIER}, CASE WHEN k % 7 = 0 THEN 'Ana' END) AS external_id,
CASE k % 5 WHEN 0 THEN 'P-' || k WHEN 1 THEN 'N-' || k END AS codigo_proceso, CASE k % 5 WHEN 3 THEN 'Proceso DESIERTO, único postor' ELSE 'x' END AS objeto, 'Entidad ' || l_suppkey AS entity_name, {_SUPPLIER} AS supplier_ruc, {_MONTO} AS monto, {_FECHA} AS fecha,
coalesce(year({_FECHA}), 1995)::INT AS period_year, CASE k % 5 WHEN 3 THEN 'unico_postor,proceso_desierto' ELSE '' END AS risk_hints, CASE WHEN k % 7 = 0 THEN 'Ana' END AS miembro_comite FROM (SELECT *, l_orderkey AS k FROM lineitem WHERE l_linenumber = 1)""")
def t7(spark, sf):
    rows = open_rows(spark, sf).withColumnRenamed("Código Proceso", "Codigo Proceso").withColumnRenamed("Integrante Comité", "Integrante Comite")
    return r.open_data(rows, "comites", ["key"]).select("key", "category", "record_type", "external_id", "codigo_proceso", "objeto", "entity_name", "supplier_ruc", "monto", "fecha", "period_year", "risk_hints", "miembro_comite")


@query("t8_portal_row", f"SELECT k AS key, 'contract' AS record_type, CASE k % 5 WHEN 0 THEN 'P-' || k END AS external_id, CASE k % 5 WHEN 3 THEN 'Proceso DESIERTO, único postor' ELSE 'x' END AS objeto, 'Entidad ' || l_suppkey AS entity_name, {_SUPPLIER} AS supplier_ruc, {_MONTO} AS monto, {_FECHA} AS fecha, year({_FECHA})::INT AS period_year FROM (SELECT *, l_orderkey AS k FROM lineitem WHERE l_linenumber = 1)")
def t8(spark, sf):
    rows = open_rows(spark, sf).withColumnRenamed("Código Proceso", "Codigo Proceso")
    return r.portal(rows, ["key"]).select("key", "record_type", "external_id", "objeto", "entity_name", "supplier_ruc", "monto", "fecha", "period_year")


_NAMES = ["Red de Salud Norte", "Oficina OEFA", "Municipalidad", "HOSPITAL  del Ambiente", "Agua y Samú", "areas protegidas"]


@query("t24_phase1_sector", f"SELECT s_suppkey, name, CASE WHEN regexp_matches(hay, 'salud|hospital|samú|samu') THEN 'salud' WHEN regexp_matches(hay, 'oefa|ambiente|agua| areas protegidas') THEN 'ambiente' END AS sector FROM (SELECT *, trim(regexp_replace(lower(name || ' ' || s_name), '\\s+', ' ', 'g')) AS hay FROM (SELECT s_suppkey, s_name, {listed(_NAMES)}[(s_suppkey % 6 + 1)::INT] AS name FROM supplier))")
def t24(spark, sf):
    name = pick(_NAMES, F.col("s_suppkey"))
    return star.read(spark, sf, "supplier").select("s_suppkey", name.alias("name"), r.phase1_sector(name, F.col("s_name")).alias("sector"))


@query("n20_html_rows", """SELECT page_id, p::INT AS place, 'LP-' || page_id || '-' || p AS codigo, 'Entidad & ' || page_id AS entidad, 'Obra' AS objeto, CASE WHEN p = 1 THEN 1234567.5 ELSE 0 END::DOUBLE AS monto, CASE WHEN p < 2 THEN make_date(2020 + p, 3, 1 + (page_id % 28)::INT) END AS fecha, CASE WHEN p = 2 THEN 1 ELSE 2 END AS numero_postores
FROM pages, range(3) t(p) WHERE p > 0""")
def n20(spark, sf):
    k = F.col("page_id").cast("string")
    row = lambda p, amount, date, state: F.concat(F.lit("<tr class='x'><td>\n Entidad <b>&</b> "), k, F.lit("</td><td>LP-"), k, F.lit(f"-{p}</td><TD>Obra</TD><td>{amount}</td><td>"), date, F.lit(f"</td><td>{state}</td></tr>"))
    date = lambda y: F.concat((F.col("page_id") % 28 + 1).cast("string"), F.lit(f"/3/{y}"))
    table = F.concat(F.lit("<table><tr><th>a</th></tr><tr><td>1</td></tr>"), row(0, "1", date(2020), "x"), row(1, "de S/ 1,000 a S/ 1,234,567.50", date(2021), "x"), row(2, "0", F.lit("s/f"), "Adjudicado"), F.lit("</table>"))
    found = r.html_rows(star.read(spark, sf, "pages"), F.concat(F.coalesce("html", F.lit("")), table), ["page_id"], "2021-01-01")
    order = F.row_number().over(r.W.partitionBy("page_id").orderBy("place"))
    return found.withColumn("place", order)


@query("x28_legal_safe", f"WITH {DESK_SQL.replace(' || coalesce(text', ' || {}[(doc_id % 4 + 1)::INT] || coalesce(text').format(listed(['', 'CORRUPCIÓN ', 'un mafioso robó, es delito ', 'cómplices ']))} SELECT chunk_id, CASE chunk_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'corrupción' WHEN 2 THEN 'robó,mafioso,delito' ELSE 'cómplice,cómplices' END AS matches, CASE chunk_id % 4 WHEN 0 THEN 'bajo' WHEN 2 THEN 'alto' ELSE 'medio' END AS risk FROM desk")
def x28(spark, sf):
    text = F.concat(pick(["", "CORRUPCIÓN ", "un mafioso robó, es delito ", "cómplices "], F.col("doc_id")), F.coalesce("text", F.lit("")))
    found = pages(spark, sf).select(F.col("doc_id").alias("chunk_id"), r.public_check(text).alias("x"))
    return found.select("chunk_id", F.array_join("x.matches", ",").alias("matches"), F.col("x.risk").alias("risk"))


@query("x27_legal_filter", "SELECT p_partkey, mode, ['corrupto', 'corrupcion', 'robo', ''][(p_partkey % 4 + 1)::INT] AS terms, CASE WHEN p_partkey % 4 = 3 THEN 'passed' ELSE CASE mode WHEN 'reject' THEN 'blocked' WHEN 'flag' THEN 'flagged' ELSE 'sanitized' END END AS status, CASE WHEN mode = 'sanitize' THEN ['Acto que presenta senales de riesgo', 'la corrupción', 'un apropiacion indebida', 'clean'][(p_partkey % 4 + 1)::INT] WHEN mode = 'reject' AND p_partkey % 4 < 3 THEN NULL ELSE ['Acto corrupto', 'la corrupción', 'un robo', 'clean'][(p_partkey % 4 + 1)::INT] END AS text FROM part, (VALUES ('reject'), ('flag'), ('sanitize')) m(mode)")
def x27(spark, sf):
    text = pick(["Acto corrupto", "la corrupción", "un robo", "clean"], F.col("p_partkey"))
    rows = star.read(spark, sf, "part").select("p_partkey", F.explode(F.array(*map(F.lit, ("reject", "flag", "sanitize")))).alias("mode"), text.alias("t"))
    return tx.legal_filter(rows, F.col("t"), F.col("mode")).select("p_partkey", "mode", "terms", "status", "text")


@query("n10_graph_ingest", graph.esql(f""", {FLAGS_SQL.replace("page AS", "page AS MATERIALIZED", 1)}, tdr AS (SELECT DISTINCT document_id AS tdr_id, substr(document_id, 2)::BIGINT AS n FROM page), link AS (SELECT tdr_id, external_id, ruc FROM tdr JOIN (SELECT external_id, ruc, row_number() OVER (ORDER BY external_id) - 1 AS n FROM won) USING (n))
SELECT kind, count(*) AS n FROM (SELECT DISTINCT 'GANA_CONTRATO' AS kind, ruc AS a, external_id AS b FROM won UNION SELECT DISTINCT 'COMPRO_A', ruc, entidad_ruc FROM won UNION SELECT DISTINCT 'REPRESENTA', rep_id, ruc FROM represents UNION SELECT DISTINCT 'MIEMBRO_COMITE', person_id, external_id FROM committee UNION SELECT DISTINCT 'ES_FUNCIONARIO_DE', person_id, entidad_ruc FROM official
UNION SELECT 'PERTENECE_A', tdr_id, external_id FROM link UNION SELECT 'DETECTADA_EN', document_id || flag_code || chunk_id, document_id FROM weak UNION SELECT 'IMPLICA_A', document_id || flag_code || chunk_id, ruc FROM weak JOIN link ON tdr_id = document_id) GROUP BY kind""").replace("WITH ", "WITH ", 1))
def n10(spark, sf):
    """Contracts are written once, narrow; their numbers by id, which only tie test documents to contracts, come from the places of a sorted table."""
    e, won = graph.edges(spark, sf), written(star.won(spark, sf).select("external_id", "ruc", "entidad_ruc"), "won")
    from ..operators import retrieval as rt

    flags = written(rt.flags(all_hits(spark, sf)).select("document_id", F.concat("document_id", "flag_code", F.col("chunk_id").cast("string")).alias("flag_id")), "flags")  # two kinds of edges come from them
    number = placed(written(won.select("external_id", "ruc").orderBy("external_id"), "by-id"), "n")
    link = pages(spark, sf).select("document_id").distinct().withColumn("n", F.substring("document_id", 2, 18).cast("long")).join(number, "n")
    edge = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"))
    every = [
        edge(won, "GANA_CONTRATO", "ruc", "external_id"), edge(won, "COMPRO_A", "ruc", "entidad_ruc"), edge(e["represents"], "REPRESENTA", "rep_id", "ruc"), edge(e["committee"], "MIEMBRO_COMITE", "person_id", "external_id"),
        edge(e["official"], "ES_FUNCIONARIO_DE", "person_id", "entidad_ruc"), edge(link, "PERTENECE_A", "document_id", "external_id"), edge(flags, "DETECTADA_EN", "flag_id", "document_id"), edge(flags.join(link, "document_id"), "IMPLICA_A", "flag_id", "ruc"),
    ]
    return r.reduce(lambda a, b: a.unionByName(b), every).distinct().groupBy("kind").agg(F.count("*").alias("n"))


@query("n6_extract_flags", f"WITH {FLAGS_SQL} SELECT w.document_id, w.flag_code, w.chunk_id, o.o_custkey AS contract FROM weak w LEFT JOIN orders o ON o.o_orderkey = substr(w.document_id, 2)::BIGINT AND o.o_orderkey % 3 > 0")
def n6(spark, sf):
    from ..operators import retrieval as rt

    flags = rt.flags(all_hits(spark, sf)).select("document_id", "flag_code", "chunk_id", F.substring("document_id", 2, 18).cast("long").alias("o_orderkey"))
    contracts = star.read(spark, sf, "orders").where("o_orderkey % 3 > 0").select("o_orderkey", F.col("o_custkey").alias("contract"))
    return flags.join(contracts, "o_orderkey", "left").select("document_id", "flag_code", "chunk_id", "contract")


@query("c8_cdc_pipeline", """WITH k AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'modified' END AS change, ['salud', 'otros', 'ambiente'][(o_custkey % 3 + 1)::INT] AS sector,
CASE WHEN o_orderkey % 11 > 0 THEN 1 ELSE 0 END AS has, o_orderkey % 13 = 0 AS failed, o_orderkey % 17 <> 0 AS pdf, o_orderkey % 5 > 0 AS usable, o_orderkey % 7 < 3 AS flagged FROM orders),
s AS (SELECT *, CASE WHEN change IS NULL THEN 'a' WHEN sector = 'otros' THEN 'b' WHEN has = 0 THEN 'c' WHEN failed THEN 'd' WHEN NOT pdf THEN 'e' WHEN NOT usable THEN 'f' WHEN NOT flagged THEN 'g' ELSE 'h' END AS st FROM k)
SELECT count(*) AS total_evaluated, count(*) FILTER (change = 'new') AS new_contracts, count(*) FILTER (change = 'modified') AS modified_contracts, count(*) FILTER (st >= 'c') AS priority_contracts, count(*) FILTER (st = 'b') AS skipped_sector, count(*) FILTER (st = 'a') AS skipped_no_change, count(*) FILTER (st >= 'd') AS tdrs_url_found,
count(*) FILTER (st = 'c') AS tdrs_url_not_found, count(*) FILTER (st = 'd') AS tdrs_download_failed, count(*) FILTER (st = 'e') AS tdrs_not_pdf, count(*) FILTER (st = 'f') AS tdrs_needs_ocr, count(*) FILTER (st = 'h') AS dossiers_generated FROM s""")
def c8(spark, sf):
    """Changes are found by content hashes between two loads, as c2 does; each contract has a worse and a better document."""
    k, o = F.col("o_orderkey"), star.read(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("string").alias("v"))
    old = o.where("o_orderkey % 12 <> 3 and o_orderkey % 12 <> 6 and o_orderkey % 12 <> 9").select(k.alias("external_id"), F.when(k % 4 == 0, F.col("v")).otherwise("before").alias("v"))
    now = o.select(k.alias("external_id"), "v")
    j = now.join(old.select("external_id", F.md5("v").alias("h")), "external_id", "left")
    changes = j.where(F.col("h").isNull() | (F.col("h") != F.md5("v"))).select("external_id", F.when(F.col("h").isNull(), "new").otherwise("modified").alias("change"))
    contracts = o.select(k.alias("external_id"), pick(["salud", "otros", "ambiente"], F.col("o_custkey")).alias("sector"))
    doc = lambda n, points, **v: o.where("o_orderkey % 11 > 0").select(k.alias("external_id"), F.concat(F.lit(n), k.cast("string")).alias("document_id"), v["kind"].alias("kind"), v["usable"].alias("usable"), v["failed"].alias("failed"), F.lit(points).alias("points"))
    documents = doc("best", 100, kind=F.when(k % 17 == 0, "zip").otherwise("pdf"), usable=k % 5 > 0, failed=k % 13 == 0).unionByName(doc("poor", 50, kind=F.lit("zip"), usable=F.lit(False), failed=F.lit(True)))
    flags = o.where("o_orderkey % 7 < 3").select(F.concat(F.lit("best"), k.cast("string")).alias("document_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    return r.run_counters(r.change_run(contracts, changes, documents, flags, ["salud", "ambiente"]))


@query("a23_pack_analyze", f"WITH {FLAGS_SQL}, k AS (SELECT document_id, page_number, chunk_id, length(text) AS n, CASE page_number % 3 WHEN 0 THEN 'tdr' WHEN 1 THEN 'award' ELSE 'other' END AS kind FROM desk) SELECT k.document_id, k.kind, count(DISTINCT k.chunk_id) AS n, count(DISTINCT k.chunk_id) FILTER (k.n > 400) AS usable, count(w.flag_code) FILTER (k.n > 400 AND CASE WHEN w.weak THEN least(w.confidence, 0.45) ELSE w.confidence END >= CASE k.kind WHEN 'tdr' THEN 0.6 WHEN 'award' THEN 0.5 ELSE 0.7 END) AS n_flags FROM k LEFT JOIN weak w USING (chunk_id) GROUP BY ALL")
def a23(spark, sf):
    from ..operators import retrieval as rt

    from .chain import desk

    kind = F.when(F.col("page_number") % 3 == 0, "tdr").when(F.col("page_number") % 3 == 1, "award").otherwise("other")
    pack = desk(spark, sf).select("document_id", "chunk_id", kind.alias("kind"), (F.char_length("text") > 400).alias("ok"))
    least = F.when(F.col("kind") == "tdr", 0.6).when(F.col("kind") == "award", 0.5).otherwise(0.7)  # by the mode that a kind is analysed in
    found = rt.flags(all_hits(spark, sf)).select("chunk_id", "flag_code", "confidence")
    per = pack.where("ok").join(found, "chunk_id").where(F.col("confidence") >= least).groupBy("document_id", "kind").agg(F.count("*").alias("n_flags"))
    out = pack.groupBy("document_id", "kind").agg(F.count("*").alias("n"), F.count_if("ok").alias("usable")).join(per, ["document_id", "kind"], "left")
    return out.select("document_id", "kind", "n", "usable", F.coalesce("n_flags", F.lit(0)).alias("n_flags"))


@query("k8_document_loaders", f"WITH {PAGES_SQL} SELECT document_id, page_number, CASE WHEN doc_id % 2 = 0 THEN length(text) ELSE -1 END AS n FROM page WHERE text IS NOT NULL")
def k8(spark, sf):
    """Pages by document and number, then a second load of the even ones, run twice as after a failure."""
    path, p = fresh_path(spark, "tdr-pages"), pages(spark, sf).where("text is not null")
    first = p.select("document_id", "page_number", F.lit(-1).cast("long").alias("n"), F.lit(1).alias("load"))
    second = p.where("doc_id % 2 = 0").select("document_id", "page_number", F.length("text").cast("long").alias("n"), F.lit(2).alias("load"))
    for rows in (first, second, second):
        table = sinks.document_tables({"pages": rows}, path, "load")["pages"]
    return table.select("document_id", "page_number", "n")


@query("s2_phase1_scan", "SELECT event_id, event_type FROM events WHERE event_id % 3 > 0")
def s2(spark, sf):
    """JSON lines of which every third is cut off."""
    path, e = fresh_path(spark, "lines"), star.read(spark, sf, "events")
    line = F.to_json(F.struct("event_id", "event_type"))
    e.select(F.when(F.col("event_id") % 3 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.option("compression", "gzip").text(path)
    return readers.json_lines(spark, path, "event_id long, event_type string")


@query("s5_spreadsheet_scan", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def s5(spark, sf):
    path = fresh_path(spark, "sheet")
    sinks.spreadsheet(star.read(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("n_nationkey"), "n_name"), path)
    return readers.table_of(readers.spreadsheet(spark, path), ["n_nationkey", "n_name"])


@query("s6_catalogue_scan", "SELECT n_name AS dataset, 'T ' || n_name AS title, 'CSV' AS format, 'http://x/' || n_nationkey AS url FROM nation")
def s6(spark, sf):
    path, k = fresh_path(spark, "catalogue"), F.col("n_nationkey").cast("string")
    res = F.array(F.struct(F.lit("r").alias("name"), F.lit("CSV").alias("format"), F.concat(F.lit("http://x/"), k).alias("url")))
    one = F.struct(F.col("n_name").alias("name"), F.concat(F.lit("T "), "n_name").alias("title"), res.alias("resources"))
    star.read(spark, sf, "nation").select(F.struct(F.array(one).alias("results")).alias("result")).write.json(path)
    return readers.catalogue(spark, path, multi_line=False).select("dataset", "title", "format", "url")


@query("s7_procedure_metadata", "SELECT 'u' || n_nationkey AS uuid, n_name AS entidad, n_regionkey::INT AS numero FROM nation WHERE n_nationkey % 2 = 0")
def s7(spark, sf):
    """Folders of metadata.json; those without a uuid are left out."""
    path, k = fresh_path(spark, "procedures"), F.col("n_nationkey")
    rows = star.read(spark, sf, "nation").select(F.concat(F.lit("p"), k.cast("string"), F.lit("/metadata.json")).alias("name"), F.to_json(F.struct(F.when(k % 2 == 0, F.concat(F.lit("u"), k.cast("string"))).alias("uuid"), F.col("n_name").alias("entidad"), F.col("n_regionkey").cast("string").alias("numero"))).alias("body"))
    sinks.files(rows, path)
    return readers.procedures(spark, path).where("uuid is not null").select("uuid", "entidad", F.coalesce(F.col("numero").try_cast("int"), F.lit(0)).alias("numero"))


@query("s8_dossier_scan", "SELECT 'o' || n_nationkey AS ocid, n_name AS entity_name, 'F' || n_regionkey AS flag_code, 'o' || n_nationkey || '_F' || n_regionkey || '_p' || (n_nationkey + 1) AS flag_id FROM nation")
def s8(spark, sf):
    path, k = fresh_path(spark, "dossiers"), F.col("n_nationkey")
    n, folder = star.read(spark, sf, "nation"), F.concat(F.lit("o"), k.cast("string"))
    dossier = n.select(F.concat(folder, F.lit("/dossier.json")).alias("name"), F.to_json(F.struct(F.col("n_name").alias("entity_name"))).alias("body"))
    flag = F.to_json(F.array(F.struct(F.concat(F.lit("F"), F.col("n_regionkey").cast("string")).alias("flag_code"), (k + 1).alias("page_number"))))
    sinks.files(dossier.unionByName(n.select(F.concat(folder, F.lit("/flags.json")).alias("name"), flag.alias("body"))), path)
    d, f = readers.dossiers(spark, path)
    return d.select("ocid", "entity_name").join(f.select("ocid", "flag_code", "flag_id"), "ocid")


@query("s10_delivery_scan", "SELECT 'P' || o.o_orderkey AS process, count(DISTINCT l_linenumber) AS documents, max(l_suppkey)::VARCHAR AS supplier FROM orders o JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def s10(spark, sf):
    """The three tables of a delivery, written and read back."""
    path = fresh_path(spark, "delivery")
    o, line = star.read(spark, sf, "orders"), star.read(spark, sf, "lineitem")
    process = lambda k: F.concat(F.lit("P"), F.col(k).cast("string")).alias("process")
    tables = {"processes": o.select(process("o_orderkey")), "documents": line.select(process("l_orderkey"), F.col("l_linenumber").alias("document")), "awards": line.groupBy(process("l_orderkey")).agg(F.max("l_suppkey").alias("supplier"))}
    sinks.csv_tables(tables, path)
    got = readers.delivery(spark, path)
    counted = got["documents"].groupBy("process").agg(F.countDistinct("document").alias("documents"))
    return got["processes"].join(counted, "process").join(got["awards"], "process").select("process", "documents", "supplier")


@query("n23_list_dossiers", "SELECT 'o' || n_nationkey AS dossier, true AS has_dossier, n_nationkey % 2 = 0 AS has_flags, n_nationkey % 3 = 0 AS has_pages FROM nation")
def n23(spark, sf):
    """Which artefacts each folder has, from a listing of its files."""
    path, k = fresh_path(spark, "listing"), F.col("n_nationkey")
    n = star.read(spark, sf, "nation")
    name = lambda f: F.concat(F.lit("o"), k.cast("string"), F.lit("/" + f)).alias("name")
    rows = n.select(name("dossier.json")).unionByName(n.where(k % 2 == 0).select(name("flags.json"))).unionByName(n.where(k % 3 == 0).select(name("pages.jsonl")))
    sinks.files(rows.withColumn("body", F.lit("{}")), path)
    return readers.listing(spark, path, {"has_dossier": "dossier.json", "has_flags": "flags.json", "has_pages": "pages.jsonl"})
