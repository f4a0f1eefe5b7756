"""Process packs, manifests and per-record reads: selections and joins with a stated reason for what is left out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules


def best_document(documents: DataFrame, key: str, classes: list[tuple[str, str]]) -> DataFrame:
    """Per process the class of its best document, the first class whose pattern a title matches, and how many documents it has."""
    title, rank = F.lower("title"), F.lit(len(classes))
    for i, (_, pattern) in reversed(list(enumerate(classes))):
        rank = F.when(title.rlike(pattern), F.lit(i)).otherwise(rank)
    names = F.array(*[F.lit(n) for n, _ in classes], F.lit("other"))
    return documents.groupBy(key).agg(F.min(rank).alias("r"), F.count("*").alias("n_documents")).select(key, F.get(names, F.col("r")).alias("status"), "n_documents")


def inventory(documents: DataFrame, key: str) -> DataFrame:
    """Per pack: which kinds of document it has, pages, its mode, and what is missing."""
    has = lambda kind, name: F.max((F.col("kind") == kind).cast("int")).alias(name)
    out = documents.groupBy(key).agg(F.count("*").alias("total_documents"), F.sum("pages").cast("long").alias("total_pages"), has("tdr", "has_tdr"), has("award", "has_award"))
    mode = F.when((F.col("has_tdr") == 1) & (F.col("has_award") == 1), "investigative").when(F.col("has_tdr") == 1, "preventive").otherwise("unknown")
    missing = F.array_join(F.array_compact(F.array(F.when(F.col("has_tdr") == 0, "tdr"), F.when(F.col("has_award") == 0, "award"))), ",")
    return out.withColumns({"mode": mode, "missing": missing})


#: Settings by mode.
STRATEGY = {"preventive": (0.6, 5), "investigative": (0.5, 8), "unknown": (0.7, 3)}


def strategy(packs: DataFrame, table: dict = STRATEGY) -> DataFrame:
    rows = packs.sparkSession.createDataFrame([(k, *v) for k, v in table.items()], "mode string, evidence_threshold double, top_k int")
    return packs.join(F.broadcast(rows), "mode", "left")  # one row a mode


def pack_graph(documents: DataFrame, key: str, doc: str) -> DataFrame:
    """(source, target, kind): packs to documents, documents to their kinds."""
    text = lambda c: F.col(c).cast("string")
    a = documents.select(F.concat(F.lit("pack:"), text(key)).alias("source"), F.concat(F.lit("doc:"), text(doc)).alias("target"), F.lit("HAS_DOCUMENT").alias("kind"))
    b = documents.select(F.concat(F.lit("doc:"), text(doc)).alias("source"), F.concat(F.lit("kind:"), F.col("kind")).alias("target"), F.lit("OF_KIND").alias("kind"))
    return a.unionByName(b).distinct()


def pack_nodes_edges(packs: DataFrame, documents: DataFrame, chunks: DataFrame, clusters: DataFrame, missing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of process packs.

    nodes: (pack_id, node_id, node_type, label, properties) of types process_pack, document, chunk, semantic_cluster and missing_key; properties is a map of texts.
    edges: (pack_id, source_id, target_id, relationship, properties): PACK_CONTAINS_DOCUMENT, DOCUMENT_NEEDS_OCR (to ``ocr``), DOCUMENT_HAS_CHUNK,
    DOCUMENT_HAS_CLUSTER, CLUSTER_CONTAINS_CHUNK, PACK_MISSING_KEY.

    packs (pack_id, mode), documents (pack_id, document_id, file_name, kind, pages, pages_needing_ocr), chunks (document_id, chunk_id, section_hint, page_start,
    page_end), clusters (cluster_id, label, chunk_id), one row a chunk, missing (pack_id, key).  A cluster belongs to each document that has one of its chunks.
    Rows repeated in any of them give one node and one edge.
    """
    text = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    node_id = lambda kind, c: F.concat_ws("::", text("pack_id"), F.lit(kind), text(c))
    told = lambda **kv: F.map_filter(F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), text(v))]), lambda k, v: v.isNotNull())
    node = lambda df, kind, c, label, **kv: df.select("pack_id", node_id(kind, c).alias("node_id"), F.lit(kind).alias("node_type"), text(label).alias("label"), told(**kv).alias("properties"))
    edge = lambda df, a, b, name, **kv: df.select("pack_id", a.alias("source_id"), b.alias("target_id"), F.lit(name).alias("relationship"), (told(**kv) if kv else F.create_map().cast("map<string,string>")).alias("properties"))
    pack, doc, chunk, cluster = node_id("process_pack", F.lit("root")), node_id("document", "document_id"), node_id("chunk", "chunk_id"), node_id("semantic_cluster", "cluster_id")
    totals = documents.groupBy("pack_id").agg(F.countDistinct("document_id").alias("total_documents"), F.sum("pages").alias("total_pages"))
    packs = packs.join(totals, "pack_id", "left").na.fill(0, ["total_documents", "total_pages"])
    held = chunks.join(documents.select("pack_id", "document_id").distinct(), "document_id")
    grouped = clusters.join(held.select("pack_id", "document_id", "chunk_id").distinct(), "chunk_id")
    sizes = grouped.groupBy("pack_id", "cluster_id", "label").agg(F.countDistinct("chunk_id").alias("chunk_count"))
    nodes = [
        node(packs, "process_pack", F.lit("root"), "pack_id", mode="mode", total_documents="total_documents", total_pages="total_pages"),
        node(documents, "document", "document_id", "file_name", document_type="kind", pages_total="pages", pages_needing_ocr="pages_needing_ocr"),
        node(held, "chunk", "chunk_id", F.coalesce(text("section_hint"), F.substring(text("chunk_id"), -8, 8)), page_start="page_start", page_end="page_end"),
        node(sizes, "semantic_cluster", "cluster_id", "label", chunk_count="chunk_count"),
        node(missing, "missing_key", "key", F.concat(F.lit("missing: "), text("key")), key="key"),
    ]
    edges = [
        edge(documents, pack, doc, "PACK_CONTAINS_DOCUMENT"), edge(documents.where("pages_needing_ocr > 0"), doc, F.lit("ocr"), "DOCUMENT_NEEDS_OCR", pages="pages_needing_ocr"), edge(held, doc, chunk, "DOCUMENT_HAS_CHUNK"),
        edge(grouped, doc, cluster, "DOCUMENT_HAS_CLUSTER"), edge(grouped, cluster, chunk, "CLUSTER_CONTAINS_CHUNK"), edge(missing, pack, node_id("missing_key", "key"), "PACK_MISSING_KEY", key="key"),
    ]
    once = lambda parts, *by: reduce(lambda a, b: a.unionByName(b), [p.dropDuplicates(list(by)) for p in parts])
    return once(nodes, "node_id"), once(edges, "source_id", "target_id")


def bridge(manifest: DataFrame, contracts: DataFrame, key: str = "ocid") -> DataFrame:
    """The manifest with its contract, or the reason why there is none."""
    c = contracts.select(F.col(key).alias("_key"), "external_id").groupBy("_key").agg(F.min("external_id").alias("external_id"))
    j = manifest.join(c, F.col(key) == F.col("_key"), "left").drop("_key")
    return j.withColumn("reason", F.when(F.col(key).isNull(), "no_ocid").when(F.col("external_id").isNull(), "no_contract"))


def resolve(wanted: DataFrame, records: DataFrame) -> DataFrame:
    """For each wanted key the record with that id, else one whose id starts with it and a colon; the largest amount first, nulls last."""
    exact = wanted.join(records, F.col("wanted") == F.col("external_id")).withColumn("how", F.lit(0))
    prefix = wanted.join(records.withColumn("_head", F.substring_index("external_id", ":", 1)).where("external_id like '%:%'"), F.col("wanted") == F.col("_head")).drop("_head").withColumn("how", F.lit(1))
    order = W.partitionBy("wanted").orderBy("how", F.desc_nulls_last("monto"), "external_id")
    return exact.unionByName(prefix).withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def first_per_contract(documents: DataFrame, key: str, most: int, *order: Column) -> DataFrame:
    return documents.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("place") <= most)


def doc_key(*parts: Column) -> Column:
    """The first of id and checksum that there is, else a hash of the url."""
    *known, url = parts
    return F.coalesce(*known, F.sha2(url, 256))


def document_id(path: Column, size: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("::", path, size.cast("string"))), 1, 16)


def active_sanction(text: Column, until: Column, as_of) -> Column:
    return F.coalesce(F.upper(text).rlike("VIGENTE|ACTIVA"), F.lit(False)) | F.coalesce(until >= F.lit(as_of).cast("date"), F.lit(False))


def guard(df: DataFrame, path: str, pattern: str = r"(?i)(^|/)(fixtures?|tests?|mock)(/|$)") -> DataFrame:
    """Rows whose path is no fixture's."""
    return df.where(~F.coalesce(F.col(path).rlike(pattern), F.lit(False)))


def source_health(registry: DataFrame) -> DataFrame:
    """unknown where a browser is needed, failed without a collector, degraded without local data, else ok."""
    status = F.when(F.col("source_type") == "playwright", "unknown").when(~F.col("collector"), "failed").when(~F.col("local_data"), "degraded").otherwise("ok")
    return registry.withColumn("health", status)


def classify(documents: DataFrame, table: list[tuple[str, int, str]]) -> DataFrame:
    """Document class by weights: a pattern in the file name counts twice; ties go to the higher priority (first in the table)."""
    scores = F.array(*[F.struct((2 * F.col("name").rlike(p).cast("int") + F.col("text").rlike(p).cast("int")).alias("score"), F.lit(prio).alias("priority"), F.lit(k).alias("kind")) for k, prio, p in table])
    best = F.array_max(F.filter(scores, lambda s: s["score"] > 0))
    return documents.withColumn("kind", F.coalesce(best["kind"], F.lit("unknown")))


#: Sentences of a summary.
NO_FLAGS = "No se encontro evidencia suficiente para sostener senales de riesgo bajo los criterios evaluados. El documento no presenta patrones atipicos en las secciones analizadas."
WITH_FLAGS = "Se identificaron %d senales de riesgo en el documento analizado (%s). Cada senal esta respaldada por evidencia textual extraida del documento y contrastada con la metodologia de referencia (OCP Red Flags Guide / OECD). Se recomienda revision humana de las clausulas senaladas."
DETAIL, DETAIL_LINE = "Detalle de las senales:", "- %s: %s (pag. %s)"


def synthesis(flags: DataFrame, documents: DataFrame, key: str = "document_id", most: int = 5) -> DataFrame:
    """Per document of ``documents``: the number of flags, confidence by their average, the first ``most`` different questions, and a summary.

    flags: key, flag_id (their order), flag_code, flag_name, explanation, page_number, confidence, questions (array).  What
    is gathered per document is what its summary says.  A document without flags has low confidence and no question.
    """
    item = F.struct("flag_id", "flag_code", "flag_name", F.coalesce("explanation", F.lit("")).alias("explanation"), F.col("page_number").cast("string").alias("page"), "questions")
    per = flags.groupBy(key).agg(F.avg("confidence").alias("c"), F.array_sort(F.collect_list(item)).alias("f"))
    j = documents.select(key).distinct().join(per, key, "left")
    n = F.when(F.col("f").isNull(), 0).otherwise(F.size("f"))
    level = F.when(F.col("c") >= 0.65, "high").when(F.col("c") >= 0.40, "medium").otherwise("low")
    asked = F.array_compact(F.array_distinct(F.flatten(F.transform("f", lambda x: F.coalesce(x["questions"], F.array().cast("array<string>"))))))
    lines = F.transform("f", lambda x: F.format_string(DETAIL_LINE, x["flag_name"], x["explanation"], x["page"]))
    text = F.concat(F.format_string(WITH_FLAGS, n, F.array_join(F.transform("f", lambda x: x["flag_code"]), ", ")), F.lit(f"\n\n{DETAIL}\n"), F.array_join(lines, "\n"))
    return j.select(key, n.cast("long").alias("n"), level.alias("level"), F.coalesce(F.array_join(F.slice(asked, 1, most), ","), F.lit("")).alias("questions"), F.when(n > 0, text).otherwise(NO_FLAGS).alias("summary"))


def by_code(table: dict[str, list[str]], code: Column) -> Column:
    """The texts of a code in a table of few codes, in order; none for another code."""
    listed = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(listed[code], F.array().cast("array<string>"))


def explained(flags: DataFrame, explanations: dict[str, str] = rules.EXPLANATIONS, questions: dict[str, list[str]] = rules.SUMMARY_QUESTIONS) -> DataFrame:
    """flags with the explanation and the questions of their flag_code, as ``synthesis`` wants them; an unknown code has an empty one and none."""
    said = F.create_map(*[F.lit(x) for kv in explanations.items() for x in kv])
    return flags.withColumns({"explanation": F.coalesce(said[F.col("flag_code")], F.lit("")), "questions": by_code(questions, F.col("flag_code"))})


def questions_of(codes: Column, table: dict[str, list[str]] = rules.DOSSIER_QUESTIONS, every: list[str] = rules.EVERY_DOSSIER_ASKS) -> Column:
    """The questions of all codes in their order, then those of every dossier, each once; null codes are none."""
    own = F.flatten(F.transform(F.coalesce(codes, F.array().cast("array<string>")), lambda c: by_code(table, c)))
    return F.array_distinct(F.concat(own, F.array(*map(F.lit, every))))


def dossier_questions(flags: DataFrame, documents: DataFrame, key: str = "document_id", table: dict[str, list[str]] = rules.DOSSIER_QUESTIONS, every: list[str] = rules.EVERY_DOSSIER_ASKS, request: str = rules.DOSSIER_REQUEST) -> DataFrame:
    """(key, questions, pages, request) for every document (key, procedure): what its dossier asks the authority, and the request it sends.

    Questions go by code in the order of their first flag (page_number, flag_code), then those of every dossier, each once.  pages: the flagged
    pages, rising, or N/A.  A null procedure is named by the key.  Codes are few; pages are those of one document.
    """
    codes = flags.groupBy(key, "flag_code").agg(F.min("page_number").alias("page"))
    asked = codes.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "flag_code"))), lambda x: x["flag_code"]).alias("codes"))
    where = flags.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("page_number")), ", ").alias("pages"))
    j = documents.select(key, F.coalesce(F.col("procedure").cast("string"), F.col(key).cast("string")).alias("_procedure")).join(asked, key, "left").join(where, key, "left")
    pages = F.coalesce("pages", F.lit("N/A"))
    return j.select(key, questions_of(F.col("codes"), table, every).alias("questions"), pages.alias("pages"), F.format_string(request, "_procedure", pages).alias("request"))


def register_lookup(wanted: DataFrame, register: DataFrame, key: str = "ruc") -> DataFrame:
    """Each wanted key with its register row: razon_social, estado, condicion, ubigeo; NO_ENCONTRADO and empty fields where there is none."""
    fields = {"razon_social": "", "estado": "NO_ENCONTRADO", "condicion": "", "ubigeo": ""}
    j = wanted.select(key).join(register.select(key, *fields, F.lit(True).alias("_found")), key, "left")
    return j.select(key, *[F.when(F.col("_found"), F.coalesce(f, F.lit(""))).otherwise(other).alias(f) for f, other in fields.items()])


def demo_cases(cases: DataFrame, dossiers: DataFrame, flags: DataFrame) -> DataFrame:
    """Stated cases (ocid and other columns) with their dossier's level, score and number of flags, and the quote of its first high flag, else of its first."""
    head = flags.groupBy("ocid").agg(F.min_by(F.struct("evidence_quote", "page_number"), F.struct(F.coalesce(F.upper("severity") != "HIGH", F.lit(True)), "flag_id")).alias("h"))
    j = cases.join(dossiers.select("ocid", "risk_level", "total_score", "total_flags"), "ocid", "left").join(head, "ocid", "left")
    none = {"risk_level": F.lit("SIN_DATOS"), "total_score": F.lit(0), "total_flags": F.lit(0)}
    told = [F.coalesce(c, v).alias(n) for (c, v), n in zip(none.items(), ("risk_level", "score", "flag_count"))]
    return j.select(*cases.columns, *told, F.col("h.evidence_quote").alias("headline_quote"), F.col("h.page_number").alias("headline_page"))


def plan(flags: DataFrame, templates: DataFrame, clusters: DataFrame, most: int = 4) -> DataFrame:
    """(document_id, flag_code, query): at most ``most`` templates of a flag whose cluster the document has."""
    rows = flags.join(templates, "flag_code").join(clusters, ["document_id", "cluster"], "left_semi")
    order = W.partitionBy("document_id", "flag_code").orderBy("place")
    return rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).select("document_id", "flag_code", "query")
