"""Queries of loose JSON, archives, batch selection with counters, collated search and pack graphs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import batches, collated
from ..operators import documents as d
from ..operators import text as tx
from ..sources import archives, loose
from ..sources.shared import fresh_path, written
from . import chain, star
from .chain import ORACLES as ORACLES_OF_CHAIN
from .chain import listed, values
from .records import PAGES_SQL, pages
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


@query("n24_loose_flags", sql(f", {DOSSIER_SQL.strip()} SELECT doc_id::VARCHAR AS ocid, flag_code, score::INT AS score, page::INT AS page_number FROM flag"))
def n24_loose(spark, sf):
    """Each dossier's flags as JSON, a list or an object by the dossier's number, scores as texts, read back by path of a VARIANT."""
    flags, _, _ = dossier_tables(spark, sf)
    path, k = fresh_path(spark, "loose-flags"), F.col("ocid").cast("long")
    one = F.struct("flag_code", F.col("score").cast("int").cast("string").alias("score"), F.col("page").cast("int").alias("page_number"))
    per = flags.groupBy("ocid").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("list"))
    body = F.when(k % 2 == 0, F.col("list")).otherwise(F.concat(F.lit('{"note": "x", "flags": '), "list", F.lit("}")))
    per.select(F.to_json(F.struct(F.col("ocid").cast("string").alias("ocid"), body.alias("body"))).alias("value")).write.text(path)
    rows = spark.read.text(path).select(F.try_parse_json("value").alias("v"))
    rows = rows.select(F.variant_get("v", "$.ocid", "string").alias("ocid"), F.try_parse_json(F.variant_get("v", "$.body", "string")).alias("v"))
    items = rows.select("ocid", F.explode(loose.elements(F.col("v"), "flags")).alias("f"))
    get = lambda n, kind: F.try_variant_get("f", f"$.{n}", kind).alias(n)
    return items.select("ocid", get("flag_code", "string"), get("score", "int"), get("page_number", "int"))


@query("c5_hash_json", "SELECT event_id, sha256('{\"a\":[1,\"x\"],\"k\":' || event_id || ',\"kind\":\"' || event_type || '\"}') AS hash FROM events")
def c5_json(spark, sf):
    """Events as JSON whose keys come in two orders and two spacings: the hash is of the canonical form."""
    k = F.col("event_id").cast("string")
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"kind": "'), "event_type", F.lit('", "k": '), k, F.lit(', "a": [1, "x"]}'))).otherwise(F.concat(F.lit('{"a":[1,"x"],"k":'), k, F.lit(',"kind":"'), "event_type", F.lit('"}')))
    return star.read(spark, sf, "events").select("event_id", loose.canonical_hash(text).alias("hash"))


@query("s3_archive_scan", sql("SELECT ruc, estado, ubigeo FROM company"))
def s3_archives(spark, sf):
    """The register in archives of several members; of five columns three are read."""
    archives.register(spark)
    path, columns = fresh_path(spark, "archives"), ["ruc", "razon_social", "estado", "condicion", "ubigeo"]
    star.companies(spark, sf).withColumnRenamed("empresa", "razon_social").select(*columns).write.format("archive_lines").options(columns=",".join(columns), rows=100).mode("append").save(path)
    return spark.read.format("archive_lines").options(columns=",".join(columns)).schema("ruc string, estado string, ubigeo string").load(path)


@query("s5_books_scan", "SELECT c_custkey::VARCHAR AS c_custkey, c_mktsegment FROM customer")
def s5_books(spark, sf):
    """Customers in books of several sheets, with one column that is not read."""
    archives.register(spark)
    path = fresh_path(spark, "books")
    star.read(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment").write.format("xlsx_rows").options(rows=5000).mode("append").save(path)
    return spark.read.format("xlsx_rows").schema("c_mktsegment string, c_custkey string").load(path)


def batch(spark, sf):
    """Contracts are sources, and regions, which have no documents but two that can be fetched; every seventh document has no url, every fifth is there already."""
    docs, k = star.read(spark, sf, "documents"), F.col("doc_id")
    region = star.read(spark, sf, "region").select(F.col("r_name").alias("source"))
    contracts = docs.select("source").unionByName(region)
    own = docs.select("source", "doc_id", F.when(k % 7 > 0, F.concat(F.lit("u"), k.cast("string"))).alias("url"), (F.col("lang") == "en").alias("wanted"), (-F.col("n_chars")).alias("rank"))
    fetched = region.where("source in ('ASIA', 'EUROPE')").select("source", F.lit(-1).cast("long").alias("doc_id"), F.lit("r").alias("url"), F.lit(True).alias("wanted"), F.lit(0).cast("long").alias("rank"))
    existing = docs.where(k % 5 == 0).select(F.concat(F.lit("u"), k.cast("string")).alias("url"))
    return batches.selection(contracts, own, "source", fetched, existing, 12)


BATCH = """x AS (SELECT source, doc_id, CASE WHEN doc_id % 7 > 0 THEN 'u' || doc_id END AS url, lang = 'en' AS wanted, -n_chars AS rank, false AS fetched FROM documents UNION ALL SELECT r_name, -1, 'r', true, 0, true FROM region WHERE r_name IN ('ASIA', 'EUROPE')
UNION ALL SELECT r_name, NULL, NULL, NULL, NULL, false FROM region WHERE r_name NOT IN ('ASIA', 'EUROPE')),
p AS (SELECT *, CASE WHEN wanted THEN row_number() OVER (PARTITION BY source, wanted ORDER BY rank, doc_id) END AS place FROM x),
b AS (SELECT source, doc_id, url, fetched, place::INT AS place, CASE WHEN doc_id IS NULL THEN 'no_documents' WHEN NOT wanted THEN 'not_wanted' WHEN place > 12 THEN 'over_contract' WHEN url IS NULL THEN 'no_url' WHEN doc_id >= 0 AND doc_id % 5 = 0 THEN 'exists' END AS reason FROM p)"""


@query("n13_batch_reasons", f"WITH {BATCH} SELECT source, coalesce(doc_id, 0) AS doc_id, coalesce(url, '') AS url, fetched, coalesce(place, 0) AS place, coalesce(reason, 'selected') AS reason FROM b")
def n13_reasons(spark, sf):
    rows = batch(spark, sf).withColumn("reason", F.coalesce("reason", F.lit("selected")))
    return rows.na.fill(0, ["doc_id", "place"]).na.fill("", ["url"])


@query("n13_batch_counters", f"""WITH {BATCH} SELECT count(doc_id) AS documents, count(*) FILTER (fetched) AS fetched, count(*) FILTER (reason IS NULL) AS selected, count(*) FILTER (doc_id IS NULL) AS without_documents,
{', '.join(f"count(*) FILTER (reason = '{r}') AS {r}" for r in ('not_wanted', 'over_contract', 'no_url', 'exists'))} FROM b""")
def n13_counters(spark, sf):
    """The counters that the pass which writes the selection has seen."""
    rows, seen = batches.counted(batch(spark, sf), "batch", **batches.selection_counters("source"))
    return batches.counters(seen, rows)


PREPARED = f"""WITH {PAGES_SQL}, per AS (SELECT document_id, count(*) AS pages, count(*) FILTER (length(text) > 100) AS text_pages, sum(length(text))::BIGINT AS chars FROM page GROUP BY 1),
r AS (SELECT *, CASE WHEN chars = 0 THEN 'no_text' WHEN text_pages = 0 THEN 'short_pages' END AS reason FROM per)"""


@query("n14_preparation", f"{PREPARED} SELECT document_id, pages, text_pages, chars, CASE WHEN reason IS NULL THEN 'ready' ELSE 'skipped' END AS status, reason FROM r")
def n14_preparation(spark, sf):
    return batches.preparation(pages(spark, sf))


@query("n14_preparation_counters", f"{PREPARED} SELECT count(*) AS documents, count(*) FILTER (reason IS NULL) AS ready, coalesce(sum(pages), 0)::BIGINT AS pages FROM r")
def n14_counters(spark, sf):
    rows, seen = batches.counted(batches.preparation(pages(spark, sf)), "prepared", documents=F.count(F.lit(1)), ready=F.count_if(F.col("reason").isNull()), pages=F.sum("pages"))
    return batches.counters(seen, rows)


@query("x29_collated_search", "SELECT doc_id FROM documents WHERE contains(strip_accents(lower(text)), 'tion a')")
def x29_collated(spark, sf):
    """All documents with a phrase, whatever its case and accents."""
    return collated.search(star.read(spark, sf, "documents"), "text", "TIÓN Á").select("doc_id")


@query("x7_collated_names", "SELECT min(name) AS name, count(DISTINCT name) AS spellings, count(*) AS n FROM (SELECT unnest([c_mktsegment, lower(c_mktsegment), replace(c_mktsegment, 'O', 'Ó')]) AS name FROM customer) GROUP BY strip_accents(lower(name))")
def x7_collated(spark, sf):
    """Segments in three spellings are one name each."""
    s = F.col("c_mktsegment")
    rows = star.read(spark, sf, "customer").select(F.explode(F.array(s, F.lower(s), F.replace(s, F.lit("O"), F.lit("Ó")))).alias("name"))
    return collated.grouped(rows, "name")


_TABLE = values([(code, i, q) for code, qs in rules.DOSSIER_QUESTIONS.items() for i, q in enumerate(qs)], "flag_code, i, q")


@query("x25_questions", ORACLES_OF_CHAIN["x24_rule_flags_v1"].replace("SELECT * FROM h QUALIFY", ", z AS (SELECT * FROM h QUALIFY") + f"""), first AS (SELECT document_id, flag_code, min(page_number) AS page FROM z GROUP BY ALL),
own AS (SELECT document_id, string_agg(q, '|' ORDER BY page, flag_code, i) AS q FROM first JOIN (SELECT * FROM {_TABLE}) USING (flag_code) GROUP BY 1), pg AS (SELECT document_id, string_agg(DISTINCT page_number::VARCHAR, ', ' ORDER BY page_number::VARCHAR) AS pages FROM z GROUP BY 1)
SELECT document_id, concat_ws('|', own.q, {", ".join("'" + q + "'" for q in rules.EVERY_DOSSIER_ASKS)}) AS questions, coalesce(pg.pages, 'N/A') AS pages, md5(format('{rules.DOSSIER_REQUEST.replace("%s", "{}")}', document_id, coalesce(pg.pages, 'N/A'))) AS request
FROM (SELECT DISTINCT document_id FROM page) LEFT JOIN own USING (document_id) LEFT JOIN pg USING (document_id)""")
def x25_questions(spark, sf):
    """Pages of a document are fewer than ten here, so SQL may order them as texts."""
    pages_of = chain.ruled(spark, sf)
    documents = pages_of.select("document_id", F.lit(None).cast("string").alias("procedure")).distinct()
    return d.dossier_questions(tx.page_flags(pages_of), documents).withColumns({"questions": F.array_join("questions", "|"), "request": F.md5("request")})


@query("x26_by_flag", f"""WITH f AS (SELECT conv_id, turn, {listed(list(rules.EXPLANATIONS))}[(turn % 9 + 1)::INT] AS code FROM conversations WHERE turn % 2 = 1), e AS (SELECT * FROM {values(list(rules.EXPLANATIONS.items()), "code, explanation")}),
q AS (SELECT * FROM {values([(code, i, q) for code, qs in rules.SUMMARY_QUESTIONS.items() for i, q in enumerate(qs)], "code, i, q")}), a AS (SELECT code, string_agg(q, '|' ORDER BY i) AS questions FROM q GROUP BY 1)
SELECT conv_id, turn, coalesce(code, '') AS flag_code, coalesce(explanation, '') AS explanation, coalesce(questions, '') AS questions FROM f LEFT JOIN e USING (code) LEFT JOIN a USING (code)""")
def x26_by_flag(spark, sf):
    """Every second turn as a flag, by number one of eight codes or none."""
    codes = F.array(*map(F.lit, rules.EXPLANATIONS))
    flags = star.read(spark, sf, "conversations").where("turn % 2 = 1").select("conv_id", "turn", F.coalesce(F.get(codes, (F.col("turn") % 9).cast("int")), F.lit("")).alias("flag_code"))
    return d.explained(flags).withColumn("questions", F.array_join("questions", "|"))


def pack_tables(spark, sf):
    """Sources as packs, documents by number, pages as chunks of eight to a document, languages as clusters, a missing key for every third pack."""
    docs, k = star.read(spark, sf, "documents"), F.col("doc_id")
    p = pages(spark, sf).select("document_id", "doc_id", "page_number")
    mine = docs.select("doc_id", "source", "lang")
    first = p.where("page_number = 1").join(mine, "doc_id")
    sizes = p.groupBy("document_id").agg(F.count("*").alias("pages"), F.count_if(k % 6 == 0).alias("pages_needing_ocr"))
    documents = first.select(F.col("source").alias("pack_id"), "document_id", F.concat("document_id", F.lit(".pdf")).alias("file_name"), F.when(k % 2 == 0, "tdr").otherwise("award").alias("kind")).join(sizes, "document_id")
    documents = written(documents, "pack-documents")
    packs = documents.groupBy("pack_id").agg(F.max("kind").alias("mode"))
    chunks = p.select("document_id", F.concat("document_id", F.lit("::"), F.lpad("page_number", 5, "0")).alias("chunk_id"), F.when(k % 4 > 0, F.concat(F.lit("s"), (k % 4).cast("string"))).alias("section_hint"), F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end"), "doc_id")
    clusters = chunks.join(mine, "doc_id").select(F.concat("document_id", F.lit("-"), "lang").alias("cluster_id"), F.col("lang").alias("label"), "chunk_id")
    return packs, documents, chunks.drop("doc_id"), clusters, packs.where("substring(pack_id, 4) % 3 = 0").select("pack_id", F.lit("award").alias("key"))


PACK = f"""WITH {PAGES_SQL}, p AS (SELECT document_id, page.doc_id, page_number, d.source, d.lang FROM page JOIN documents d ON d.doc_id = page.doc_id),
dz AS (SELECT f.source AS pack_id, document_id, CASE WHEN f.doc_id % 2 = 0 THEN 'tdr' ELSE 'award' END AS kind, z.pages, z.ocr FROM (SELECT * FROM p WHERE page_number = 1) f JOIN (SELECT document_id, count(*) AS pages, count(*) FILTER (doc_id % 6 = 0) AS ocr FROM p GROUP BY 1) z USING (document_id)),
pk AS (SELECT pack_id, max(kind) AS mode FROM dz GROUP BY 1), ck AS (SELECT dz.pack_id, document_id, document_id || '::' || lpad(page_number::VARCHAR, 5, '0') AS chunk_id, CASE WHEN doc_id % 4 > 0 THEN 's' || (doc_id % 4) END AS hint, document_id || '-' || lang AS cluster_id, lang FROM p JOIN dz USING (document_id)),
ms AS (SELECT pack_id FROM pk WHERE substr(pack_id, 4)::INT % 3 = 0)"""


@query("a22_pack_nodes", f"""{PACK} SELECT pack_id, pack_id || '::process_pack::root' AS node_id, 'process_pack' AS node_type, pack_id AS label FROM pk UNION ALL SELECT pack_id, pack_id || '::document::' || document_id, 'document', document_id || '.pdf' FROM dz
UNION ALL SELECT pack_id, pack_id || '::chunk::' || chunk_id, 'chunk', coalesce(hint, right(chunk_id, 8)) FROM ck UNION ALL SELECT DISTINCT pack_id, pack_id || '::semantic_cluster::' || cluster_id, 'semantic_cluster', lang FROM ck UNION ALL SELECT pack_id, pack_id || '::missing_key::award', 'missing_key', 'missing: award' FROM ms""")
def a22_nodes(spark, sf):
    return d.pack_nodes_edges(*pack_tables(spark, sf))[0].drop("properties")


@query("a22_pack_edges", f"""{PACK} SELECT pack_id, pack_id || '::process_pack::root' AS source_id, pack_id || '::document::' || document_id AS target_id, 'PACK_CONTAINS_DOCUMENT' AS relationship FROM dz UNION ALL SELECT pack_id, pack_id || '::document::' || document_id, 'ocr', 'DOCUMENT_NEEDS_OCR' FROM dz WHERE ocr > 0
UNION ALL SELECT pack_id, pack_id || '::document::' || document_id, pack_id || '::chunk::' || chunk_id, 'DOCUMENT_HAS_CHUNK' FROM ck UNION ALL SELECT DISTINCT pack_id, pack_id || '::document::' || document_id, pack_id || '::semantic_cluster::' || cluster_id, 'DOCUMENT_HAS_CLUSTER' FROM ck
UNION ALL SELECT pack_id, pack_id || '::semantic_cluster::' || cluster_id, pack_id || '::chunk::' || chunk_id, 'CLUSTER_CONTAINS_CHUNK' FROM ck UNION ALL SELECT pack_id, pack_id || '::process_pack::root', pack_id || '::missing_key::award', 'PACK_MISSING_KEY' FROM ms""")
def a22_edges(spark, sf):
    return d.pack_nodes_edges(*pack_tables(spark, sf))[1].drop("properties")
