"""Queries of the retrieval chain and the doctrine over documents of eight pages, with SQL where SQL can say it.

The test texts are invented prose, so each page starts with a phrase chosen by its number: some have evidence, some do not.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import rules
from ..operators import chunking, fulltext, vector_index
from ..operators import retrieval as rt
from ..operators import text as tx
from ..operators.similar import similar_quotes
from ..sources.shared import fresh_path, written
from . import star
from .records import FOLD_SQL, PAGES_SQL, pages

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


PHRASES = [
    "Se pide copia legalizada y 12 documentos.", "informe en formato A3 solamente", "a criterio del comite, juicio del comite", "texto corriente", "experiencia minima de 8 anios en el mismo sector",
    "experiencia especifica restrictiva", "sobre cerrado y foliado", "certificacion ISO obligatoria, iso 9001", "plazo muy corto de entrega", "marca unica y modelo exclusivo", "entrega sin dataset ni trazabilidad", "notarial",
]
HEADINGS = ["3. PLAZO DE ENTREGA", "texto en minusculas", "II. ENTREGABLES", "NOTA", "CRITERIOS DE EVALUACION", "4.1 EXPERIENCIA DEL POSTOR", "REQUISITOS TECNICOS"]


def pick(values: list[str], at):
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def desk(spark, sf):
    """(document_id, page_number, chunk_id, text, cluster): pages as chunks, with a phrase first and the cluster of a heading."""
    k = F.col("doc_id")
    text = F.concat(pick(PHRASES, k), F.lit(" "), F.coalesce("text", F.lit("")))
    return pages(spark, sf).select("document_id", "page_number", k.alias("chunk_id"), text.alias("text"), c.cluster(pick(HEADINGS, k), F.lit("")).alias("cluster"))


DESK_SQL = f"""{PAGES_SQL}, desk AS (SELECT document_id, page_number, doc_id AS chunk_id, {listed(PHRASES)}[(doc_id % {len(PHRASES)} + 1)::INT] || ' ' || coalesce(text, '') AS text,
['Plazos', 'Otros', 'Entregables', 'Otros', 'Criterios de evaluación', 'Experiencia del postor', 'Requisitos técnicos'][(doc_id % 7 + 1)::INT] AS cluster FROM page)"""

QUESTIONS = ["Detecta senales de riesgo", "¿Qué copias y documentos piden?", "¿Quién evalúa?", "marca o modelo del comité"]


def planned(spark, sf):
    chunks = desk(spark, sf)
    number = F.substring("document_id", 2, 18).cast("long")
    questions = chunks.select("document_id").distinct().withColumn("question", pick(QUESTIONS, number))
    codes = list(rules.PLANNER_QUERIES)
    hits = chunks.where("page_number <= 3 and chunk_id % 2 = 0").select("document_id", F.col("page_number").alias("place"), pick(codes, F.col("chunk_id")).alias("flag_code"), F.concat(F.lit("dc"), F.col("chunk_id").cast("string")).alias("chunk_id"))
    return chunks, rt.plan(questions, hits, chunks.select("document_id", F.col("cluster").alias("label")))


def doctrine(spark, sf):
    """Every tenth benchmark text has no flag; the others have one by number."""
    k = F.col("item_id")
    return star.read(spark, sf, "benchmark").select(F.concat(F.lit("d"), k.cast("string")).alias("chunk_id"), (k % 7).alias("place"), F.when(k % 10 > 0, pick(list(rules.PLANNER_QUERIES)[:-2], k)).alias("flag_code"), "text")


@query("x16_doctrine_plan")
def x16_doctrine(spark, sf):
    """The plan from the doctrine's own hits; hashed vectors are part of it, and tests hold it against a brute-force version."""
    chunks = desk(spark, sf)
    first = chunks.groupBy("document_id").agg(F.min_by("text", "page_number").alias("question"))
    questions = written(first.withColumn("question", F.array_join(F.slice(F.split("question", " "), 1, 20), " ")), "questions")
    hits = rt.doctrine_hits(questions, doctrine(spark, sf))
    return rt.plan(questions, hits, chunks.select("document_id", F.col("cluster").alias("label"))).select("document_id", "flag_code", "query_id", "anchor_id")


@query("x15_anchored")
def x15_anchored(spark, sf):
    """Every flag asks, by an id that exists or not; the last two flags have no doctrine and take the nearest text."""
    k = F.col("item_id")
    asked = star.read(spark, sf, "benchmark").select(k.alias("asked_id"), pick(list(rules.PLANNER_QUERIES), k).alias("flag_code"), F.when(k % 3 == 0, F.concat(F.lit("d"), (k + 1).cast("string"))).alias("anchor_id"))
    return rt.anchored(asked, doctrine(spark, sf)).select("asked_id", "flag_code", "chunk_id")


@query("x33_debug_rows")
def x33_rows(spark, sf):
    chunks, plan = planned(spark, sf)
    plan = written(plan, "plan")
    hits = written(rt.retrieve(chunks, plan), "hits")
    return rt.debug_rows(plan, hits, rt.critiqued(chunks, plan, 5, hits))


def values(rows: list[tuple], columns: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + f") v({columns})"


_CODES = list(rules.PLANNER_QUERIES)
_ASKED = {0: rules.INTENTS["risk_scan"][1], 1: rules.INTENTS["documentary_burden"][1], 3: [*rules.INTENTS["evaluation_discretion"][1], *rules.INTENTS["market_restriction"][1]]}


@query("x16_plan", f"""WITH {DESK_SQL}, q AS (SELECT DISTINCT document_id, substr(document_id, 2)::BIGINT % {len(QUESTIONS)} AS k FROM page),
h AS (SELECT document_id, page_number AS place, {listed(_CODES)}[(chunk_id % {len(_CODES)} + 1)::INT] AS flag_code, 'dc' || chunk_id AS chunk_id FROM desk WHERE page_number <= 3 AND chunk_id % 2 = 0),
told AS (SELECT document_id, flag_code, min(place) AS o FROM h GROUP BY ALL), asked AS (SELECT document_id, flag_code, 100 + o AS o FROM q JOIN (SELECT * FROM {values([(k, i, code) for k, v in _ASKED.items() for i, code in enumerate(v)], 'k, o, flag_code')}) USING (k)),
maybe AS (SELECT document_id, flag_code, min(o) AS o FROM (SELECT * FROM told UNION ALL SELECT * FROM asked) GROUP BY ALL),
cand AS (SELECT * FROM maybe UNION ALL SELECT document_id, flag_code, i FROM q, (SELECT * FROM {values(list(enumerate(_CODES)), 'i, flag_code')}) WHERE document_id NOT IN (SELECT document_id FROM maybe)),
placed AS (SELECT document_id, flag_code, row_number() OVER (PARTITION BY document_id ORDER BY o) - 1 AS place FROM cand),
t AS (SELECT * FROM {values([(code, k, text) for code, v in rules.PLANNER_QUERIES.items() for k, text in enumerate(v[:4])], 'flag_code, k, query')}),
fc AS (SELECT * FROM {values([(code, label) for code, v in rules.FLAG_CLUSTERS.items() for label in v], 'flag_code, label')}),
has AS (SELECT DISTINCT document_id, cluster AS label FROM desk), cl AS (SELECT document_id, flag_code, string_agg(label, ',' ORDER BY label) AS clusters FROM fc JOIN has USING (label) GROUP BY ALL)
SELECT p.document_id, p.flag_code, (p.place * 1000 + t.k)::BIGINT AS query_id, t.query, coalesce(cl.clusters, '') AS clusters, a.anchor_id
FROM placed p JOIN t USING (flag_code) LEFT JOIN cl USING (document_id, flag_code) LEFT JOIN (SELECT document_id, flag_code, arg_min(chunk_id, place) AS anchor_id FROM h GROUP BY ALL) a USING (document_id, flag_code)""")
def x16(spark, sf):
    plan = planned(spark, sf)[1]
    return plan.select("document_id", "flag_code", F.col("query_id").cast("long").alias("query_id"), "query", F.array_join(F.array_sort("clusters"), ",").alias("clusters"), "anchor_id")


@query("x17_retrieve")
def x17(spark, sf):
    """Hashed vectors are part of it, which SQL does not have; tests hold it against a brute-force version."""
    return rt.retrieve(*planned(spark, sf)).drop("excerpt")


def all_hits(spark, sf):
    """Each page as a hit for each flag."""
    codes = F.posexplode(F.array(*map(F.lit, rules.FLAGS))).alias("query_id", "flag_code")
    return desk(spark, sf).select("document_id", "chunk_id", "cluster", F.col("page_number").alias("rank"), F.col("text").alias("excerpt"), codes)


def _matched(patterns) -> str:
    """SQL for (start, end) of the first match of the first pattern that matches."""
    out = "NULL"
    for p in reversed(patterns):
        p = p.replace("'", "''")
        out = f"CASE WHEN regexp_matches(t, '(?i){p}') THEN [length(regexp_extract(t, '(?is)^(.*?)(?:{p})', 1)), length(regexp_extract(t, '(?i){p}'))] ELSE {out} END"
    return out


_WEAK = " OR ".join(f"(flag_code = '{code}' AND NOT (" + " OR ".join(f"regexp_matches(quote, '(?i){p}')" for p in patterns) + "))" for code, patterns in rules.ANCHORS.items())
FLAGS_SQL = f"""{DESK_SQL}, hay AS (SELECT document_id, page_number, chunk_id, cluster, regexp_replace(regexp_replace(text, '\\s+$', ''), '\\.\\.\\.$', '') AS t FROM desk),
m AS ({' UNION ALL '.join(f"SELECT document_id, page_number, chunk_id, cluster, t, {i} AS q, '{code}' AS flag_code, '{level}' AS severity, {sure}::DOUBLE AS confidence, {_matched(rules.EVIDENCE[code])} AS m FROM hay" for i, (code, (level, sure)) in enumerate(rules.FLAGS.items()))}),
cut AS (SELECT *, regexp_replace(regexp_replace(t[greatest(m[1] - 40, 0) + 1:m[1] + m[2] + 80], '^\\s+', ''), '\\s+$', '') AS quote FROM m WHERE m IS NOT NULL),
one AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY document_id, quote ORDER BY q, page_number) = 1),
weak AS (SELECT *, cluster IN ('Otros', 'Confidencialidad y propiedad', '') AND ({_WEAK}) AS weak FROM one)"""


@query("x18_regex_flags", f"WITH {FLAGS_SQL} SELECT document_id, flag_code, chunk_id, md5(quote) AS quote FROM weak")
def x18(spark, sf):
    return rt.flags(all_hits(spark, sf)).select("document_id", "flag_code", "chunk_id", F.md5("quote").alias("quote"))


@query("x19_weak_signal", f"WITH {FLAGS_SQL} SELECT document_id, flag_code, chunk_id, CASE WHEN weak THEN 'low' ELSE severity END AS severity, CASE WHEN weak THEN least(confidence, 0.45) ELSE confidence END::DOUBLE AS confidence FROM weak")
def x19(spark, sf):
    return rt.flags(all_hits(spark, sf)).select("document_id", "flag_code", "chunk_id", "severity", "confidence")


@query("x20_semantic_dedup")
def x20(spark, sf):
    """Which flags stay depends on those kept before; tests hold it against a brute-force version."""
    found = rt.flags(all_hits(spark, sf)).withColumn("flag_id", F.col("chunk_id"))
    return similar_quotes(found).select("document_id", "flag_code", "flag_id", F.md5("quote").alias("quote"))


@query("x22_retry")
def x22(spark, sf):
    return rt.with_retry(*planned(spark, sf), keep=written).select("document_id", "flag_code", "chunk_id", "reason", "accepted", "retried")


@query("x33_debug_retrieval")
def x33(spark, sf):
    chunks, plan = planned(spark, sf)
    plan = written(plan, "plan")
    hits = written(rt.retrieve(chunks, plan), "hits")
    return rt.diagnostics(plan, hits, rt.critiqued(chunks, plan, 5, hits))


@query("x15_lookup", """WITH doctrine AS (SELECT item_id, ['A', 'B', 'C', NULL][(item_id % 4 + 1)::INT] AS flag_code, item_id % 7 AS place FROM benchmark),
asked AS (SELECT item_id AS asked_id, ['A', 'B', 'C', 'D'][(item_id % 4 + 1)::INT] AS flag_code, CASE WHEN item_id % 3 = 0 THEN 'd' || (item_id + 1) END AS anchor_id FROM benchmark),
first AS (SELECT flag_code, arg_min('d' || item_id, (place, 'd' || item_id)) AS f FROM doctrine WHERE flag_code IS NOT NULL GROUP BY 1)
SELECT asked_id, flag_code, coalesce(i.id, f) AS chunk_id FROM asked LEFT JOIN (SELECT 'd' || item_id AS id FROM doctrine) i ON i.id = anchor_id LEFT JOIN first USING (flag_code)""")
def x15(spark, sf):
    b, k = star.read(spark, sf, "benchmark"), F.col("item_id")
    name = lambda n: F.concat(F.lit("d"), n.cast("string"))
    doctrine = b.select(name(k).alias("chunk_id"), (k % 7).alias("place"), F.when(k % 4 < 3, pick(["A", "B", "C", "-"], k)).alias("flag_code"))
    asked = b.select(k.alias("asked_id"), pick(["A", "B", "C", "D"], k).alias("flag_code"), F.when(k % 3 == 0, name(k + 1)).alias("anchor_id"))
    return rt.anchor(asked, doctrine).select("asked_id", "flag_code", "chunk_id")


def titled(spark, sf):
    """Pages whose text starts with a heading line, or with a line that looks like none, and a second one below."""
    k = F.col("doc_id")
    return pages(spark, sf).withColumn("text", F.concat_ws("\n", pick(HEADINGS, k), F.lit("cuerpo del texto"), F.when(k % 3 == 0, pick(HEADINGS, k + 2)), F.regexp_replace(F.lower("text"), r"[\n\r]", " ")))


_LABELS = ["Plazos", "", "Entregables", "", "Criterios de evaluación", "Experiencia del postor", "Requisitos técnicos"]


@query("x9_sections", f"""WITH {PAGES_SQL}, hit AS (SELECT document_id, page_number, 0 AS line, doc_id % 7 AS k FROM page UNION ALL SELECT document_id, page_number, 2, (doc_id + 2) % 7 FROM page WHERE doc_id % 3 = 0),
l AS (SELECT document_id, page_number, line, {listed(_LABELS)}[(k + 1)::INT] AS label, {listed(HEADINGS)}[(k + 1)::INT] AS heading FROM hit WHERE k NOT IN (1, 3)), last AS (SELECT document_id, max(page_number) AS last FROM page GROUP BY 1),
e AS (SELECT *, greatest(coalesce(lead(page_number) OVER o - 1, last), page_number) AS page_end, coalesce((label <> lag(label) OVER o)::INT, 1) AS new FROM l JOIN last USING (document_id) WINDOW o AS (PARTITION BY document_id ORDER BY page_number, line)),
r AS (SELECT *, sum(new) OVER (PARTITION BY document_id ORDER BY page_number, line) AS place FROM e)
SELECT document_id, place::INT AS place, any_value(label) AS label, min(page_number) AS page_start, max(page_end) AS page_end, arg_min(heading, (page_number, line)) AS heading FROM r GROUP BY document_id, place""")
def x9(spark, sf):
    return tx.sections(titled(spark, sf))


@query("x5_doc_chunks")
def x5(spark, sf):
    """Each cut depends on the one before; tests hold it against a brute-force version."""
    return chunking.chunks(titled(spark, sf)).select("document_id", "chunk_id", "page_start", "page_end", "char_start", "char_end", "section_hint", F.md5("text").alias("text"))


@query("x11_vector_index")
def x11_index(spark, sf):
    """Near the exact x11_vector_topk; tests measure the recall."""
    e = star.read(spark, sf, "embeddings")
    index = vector_index.build(e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v")), fresh_path(spark, "vector-index"))
    return vector_index.search(index, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")))


@query("x32_fulltext")
def x32_index(spark, sf):
    """Stems are beyond SQL; tests hold searches against a brute-force version.  Every twentieth benchmark text asks with its first two words, in each mode."""
    docs = star.read(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text")
    mode = F.explode(F.array(*map(F.lit, ("all", "any", "phrase")))).alias("mode")
    some = star.read(spark, sf, "benchmark").where("item_id % 20 = 0").select("item_id", mode, F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("text"))
    asked = some.select(F.concat_ws(":", "item_id", "mode").alias("query_id"), "mode", "text")
    return fulltext.search(fulltext.build(docs, fresh_path(spark, "inverted-index")), asked)


@query("x4_page_chunks")
def x4(spark, sf):
    return tx.page_chunks(pages(spark, sf))


@query("x10_hash_embedding")
def x10(spark, sf):
    return star.read(spark, sf, "documents").select("doc_id", tx.hash_embedding(F.col("text")).alias("v"))


@query("x24_rule_flags_v1", f"""WITH {DESK_SQL.replace("AS text,", "|| ' solo podran participar con sector salud; formato a3; iso 9001; a criterio del comite; forma fisica' AS text,")}, t AS (SELECT document_id, page_number, {FOLD_SQL.format("text")} AS t FROM desk),
h AS ({' UNION ALL '.join(f"SELECT document_id, page_number, '{r}' AS rule_id, '{code}' AS flag_code, '{s}' AS severity, {x} AS score FROM t WHERE " + ' OR '.join("regexp_matches(t, '" + p.replace("'", "''") + "')" for p in ps) for r, code, s, x, ps in rules.PAGE_RULES)})
SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY document_id, rule_id ORDER BY page_number) <= 3""")
def x24(spark, sf):
    return tx.page_flags(ruled(spark, sf)).drop("quote")


def ruled(spark, sf):
    return desk(spark, sf).withColumn("text", F.concat("text", F.lit(" solo podran participar con sector salud; formato a3; iso 9001; a criterio del comite; forma fisica")))


_ASKED_BY = values([(code, i, q) for code, qs in rules.DOSSIER_QUESTIONS.items() for i, q in enumerate(qs)], "flag_code, i, q")


@query("x25_dossier_agg", ORACLES["x24_rule_flags_v1"].replace("SELECT * FROM h QUALIFY", ", z AS (SELECT * FROM h QUALIFY") + f"""), first AS (SELECT document_id, flag_code, min(page_number) AS page FROM z GROUP BY ALL),
own AS (SELECT document_id, string_agg(q, '|' ORDER BY page, flag_code, i) AS q FROM first JOIN (SELECT * FROM {_ASKED_BY}) USING (flag_code) GROUP BY 1), pg AS (SELECT document_id, string_agg(DISTINCT page_number::VARCHAR, ', ' ORDER BY page_number::VARCHAR) AS told FROM z GROUP BY 1),
agg AS (SELECT document_id, count(*) AS total_flags, count(*) FILTER (severity = 'low') AS n_low, count(*) FILTER (severity = 'medium') AS n_medium, count(*) FILTER (severity = 'high') AS n_high, sum(score)::BIGINT AS total_score, count(DISTINCT page_number) AS pages FROM z GROUP BY document_id)
SELECT document_id, coalesce(total_flags, 0) AS total_flags, coalesce(n_low, 0) AS n_low, coalesce(n_medium, 0) AS n_medium, coalesce(n_high, 0) AS n_high, coalesce(total_score, 0)::BIGINT AS total_score, coalesce(pages, 0) AS pages,
CASE WHEN total_score >= 100 THEN 'CRITICO' WHEN total_score >= 60 THEN 'ALTO' WHEN total_score >= 30 THEN 'MEDIO' WHEN total_score >= 15 THEN 'BAJO' ELSE 'SIN_SENALES' END AS risk_level,
concat_ws('|', own.q, {", ".join("'" + q + "'" for q in rules.EVERY_DOSSIER_ASKS)}) AS questions, md5(format('{rules.DOSSIER_REQUEST.replace("%s", "{}")}', document_id, coalesce(pg.told, 'N/A'))) AS request
FROM (SELECT DISTINCT document_id FROM page) LEFT JOIN agg USING (document_id) LEFT JOIN own USING (document_id) LEFT JOIN pg USING (document_id)""")
def x25(spark, sf):
    """Pages of a document are fewer than ten here, so SQL may order them as texts."""
    pages_of = ruled(spark, sf)
    documents = pages_of.select("document_id", F.lit(None).cast("string").alias("procedure")).distinct()
    return tx.dossiers(tx.page_flags(pages_of), documents).withColumns({"questions": F.array_join("questions", "|"), "request": F.md5("request")})
