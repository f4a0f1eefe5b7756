"""The retrieval chain over documents: plan, hybrid retrieval, regex flags, weak signals, similar quotes, critique, retry.

Everything is grouped by document, so all documents go at once and none meets another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import rules
from ..sources.shared import dealt
from . import text as tx
from . import vector_index, within
from .similar import similar_quotes

#: A text's first characters, which is what a hit shows.
EXCERPT = 400
#: Fixed value: Unicode's white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def asked_flags(question: Column, intents: dict = rules.INTENTS) -> Column:
    """The flags of all intents with a word in the question, in the intents' order, once each."""
    said = F.lower(c.fold(F.coalesce(question, F.lit(""))))
    parts = []
    for words, codes in intents.values():
        found = F.lit(False)
        for w in words:
            found = found | said.contains(w)
        parts.append(F.when(found, strings(codes)).otherwise(strings(())))
    return F.array_distinct(F.flatten(F.array(*parts)))


def plan(questions: DataFrame, doctrine_hits: DataFrame, clusters: DataFrame, most: int = 4, intents: dict = rules.INTENTS, templates: dict = rules.PLANNER_QUERIES, wanted: dict = rules.FLAG_CLUSTERS) -> DataFrame:
    """(document_id, flag_code, place, query_id, query, clusters, anchor_id): at most ``most`` queries of each candidate flag.

    Candidates of (document_id, question) are the flags of its doctrine hits (document_id, place, flag_code, chunk_id) by
    place, then those that the question asks for, or all flags where there is none.  ``clusters`` are those of the flag's
    sections that the document has (document_id, label); empty: anywhere.  The anchor is the flag's first doctrine hit.
    """
    hits = doctrine_hits.where("flag_code is not null").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("place", "flag_code", "chunk_id"))).alias("hits"))
    labels = clusters.groupBy("document_id").agg(F.collect_set("label").alias("labels"))
    j = questions.join(dealt(hits), "document_id", "left").join(dealt(labels), "document_id", "left")
    told = F.coalesce(F.transform("hits", lambda h: h["flag_code"]), strings(()))
    codes = F.array_distinct(F.concat(told, asked_flags(F.col("question"), intents)))
    codes = F.when(F.size(codes) > 0, codes).otherwise(strings(templates))
    table = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), strings(v))])
    rows = j.select("document_id", "hits", "labels", F.posexplode(codes).alias("place", "flag_code"))
    rows = rows.withColumn("anchor_id", F.get(F.filter("hits", lambda h: h["flag_code"] == F.col("flag_code")), F.lit(0))["chunk_id"])
    rows = rows.withColumn("clusters", F.filter(F.coalesce(table(wanted)[F.col("flag_code")], strings(())), lambda x: F.coalesce(F.array_contains("labels", x), F.lit(False))))
    rows = rows.select("document_id", "flag_code", "place", "clusters", "anchor_id", F.posexplode(F.slice(table(templates)[F.col("flag_code")], 1, most)).alias("k", "query"))
    return rows.select("document_id", "flag_code", "place", (F.col("place") * 1000 + F.col("k")).alias("query_id"), "query", "clusters", "anchor_id")


def bm25(chunks: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, top: int = 20) -> DataFrame:
    """(document_id, query_id, chunk_id, score, rank): Okapi scores above zero within each document; statistics are the document's own."""
    rows = chunks.select("document_id", "chunk_id", tx.tokens(F.col("text")).alias("w")).withColumn("dl", F.size("w"))
    stats = rows.groupBy("document_id").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = rows.select("document_id", "chunk_id", "dl", F.explode("w").alias("token")).groupBy("document_id", "chunk_id", "dl", "token").agg(F.count("*").alias("tf"))
    df = tf.groupBy("document_id", "token").agg(F.count("*").alias("df")).join(dealt(stats), "document_id")
    idf = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    df = df.withColumn("idf", idf).withColumn("mean", F.avg("idf").over(W.partitionBy("document_id")))
    df = df.select("document_id", "token", "avgdl", F.when(F.col("idf") < 0, epsilon * F.col("mean")).otherwise(F.col("idf")).alias("idf"))
    asked = queries.select("document_id", "query_id", F.explode(tx.tokens(F.col("query"))).alias("token"))
    hits = asked.join(dealt(df), ["document_id", "token"]).join(dealt(tf), ["document_id", "token"])
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy("document_id", "query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
    return _ranked(scored, top)


def vectors(chunks: DataFrame, queries: DataFrame, top: int = 20) -> DataFrame:
    """(document_id, query_id, chunk_id, score, rank) by the inner product of hashed vectors within each document.

    Each different query is hashed once, and only its few places that are not zero are multiplied, in their order.
    """
    own = chunks.select("document_id", "chunk_id", tx.hash_embedding(F.col("text")).alias("v"))
    words = queries.select(F.col("query").alias("_query")).distinct().withColumn("q", tx.hash_embedding(F.col("_query")))
    words = words.select("_query", F.filter(F.transform("q", lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("x"))), lambda e: e["x"] != 0).alias("q"))
    asked = queries.select("document_id", "query_id", "query").join(words, F.col("query").eqNullSafe(F.col("_query"))).select("document_id", "query_id", "q")
    dot = F.aggregate("q", F.lit(0.0), lambda a, e: a + F.get(F.col("v"), e["i"]).cast("double") * e["x"])
    return _ranked(own.join(dealt(asked), "document_id").select("document_id", "query_id", "chunk_id", F.round(dot, 6).alias("score")), top)


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    order = W.partitionBy("document_id", "query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def retrieve(chunks: DataFrame, queries: DataFrame, top: int = 5, per_ranker: int = 20, k: int = 60) -> DataFrame:
    """(document_id, query_id, flag_code, chunk_id, score, rank, cluster, excerpt): each query of a plan over its document's chunks.

    Ranks by vectors and by words are fused by reciprocal ranks; of the fused list only chunks of the query's clusters
    count (all, where it names none), so fewer than ``top`` may remain.  chunks: (document_id, chunk_id, text, cluster).
    ``vectors`` and ``bm25`` are the two rankers by themselves; here both take one pass, and texts are dealt once.
    """
    return within.search(chunks, queries, EXCERPT, top, per_ranker, k)


def first_match(text: Column, patterns) -> Column:
    """(at, n) of the first match of the first pattern that matches, case aside; null without one."""
    parts = []
    for p in patterns:
        p = f"(?iU){p}"
        parts.append(F.when(text.rlike(p), F.struct(F.regexp_instr(text, F.lit(p)).alias("at"), F.char_length(F.regexp_substr(text, F.lit(p))).alias("n"))))
    return F.coalesce(*parts)


def is_weak(flag: Column, quote: Column, cluster: Column, anchors: dict = rules.ANCHORS, neutral=rules.NEUTRAL_CLUSTERS) -> Column:
    """Whether a quote stands in a neutral section and has none of its flag's anchors."""
    out = F.lit(False)
    for code, patterns in anchors.items():
        hit = F.lit(False)
        for p in patterns:
            hit = hit | quote.rlike(f"(?iU){p}")
        out = F.when(flag == code, ~hit).otherwise(out)
    return F.coalesce(cluster, F.lit("")).isin(*neutral) & out


def flags(hits: DataFrame, evidence: dict = rules.EVIDENCE, known: dict = rules.FLAGS, least: float = 0.3, before: int = 40, after: int = 80) -> DataFrame:
    """(document_id, flag_code, chunk_id, query_id, rank, quote, severity, confidence, cluster): hits whose excerpt has the flag's evidence.

    The quote is the first match with ``before`` and ``after`` characters around it.  Of equal quotes of a document the
    first by query and rank counts.  Weak signals are low and at most 0.45 sure.
    """
    trim = lambda x: F.btrim(x, F.lit(SPACES))
    ended = F.rtrim(F.col("excerpt"), F.lit(SPACES))
    shown = trim(F.when(ended.endswith("..."), F.left(ended, F.char_length(ended) - 3)).otherwise(ended))
    match, severity, sure = F.lit(None).cast("struct<at:int,n:int>"), F.lit(None).cast("string"), F.lit(None).cast("double")
    for code, (level, confidence) in known.items():
        of = F.col("flag_code") == code
        match = F.when(of, first_match(F.col("shown"), evidence[code])).otherwise(match)
        severity, sure = F.when(of, level).otherwise(severity), F.when(of, confidence).otherwise(sure)
    # As rows of one: a column would be worked out again wherever a pattern or the filter names it.
    rows = hits.select("*", F.explode(F.array(shown)).alias("shown"))
    rows = rows.select("*", F.explode(F.array_compact(F.array(match))).alias("m"))
    start = F.greatest(F.col("m.at") - 1 - before, F.lit(0))
    rows = rows.withColumn("quote", trim(F.substring("shown", start + 1, F.col("m.at") - 1 + F.col("m.n") + after - start)))
    order = W.partitionBy("document_id", "quote").orderBy("query_id", "rank")
    rows = rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").withColumns({"severity": severity, "confidence": sure})
    rows = tx.weakened(rows, is_weak(F.col("flag_code"), F.col("quote"), F.col("cluster")))
    return rows.where(F.col("confidence") >= least).select("document_id", "flag_code", "chunk_id", "query_id", "rank", "quote", "severity", F.round("confidence", 2).alias("confidence"), "cluster")


def critiqued(chunks: DataFrame, queries: DataFrame, top: int, hits: DataFrame | None = None) -> DataFrame:
    """Retrieval (unless its ``hits`` are given), flags, similar quotes and critique in one: the candidates with reason and accepted."""
    found = flags(retrieve(chunks, queries, top) if hits is None else hits).withColumn("flag_id", F.col("query_id") * 1000 + F.col("rank"))
    return tx.critique(similar_quotes(found), chunks.select("chunk_id", "text"))


def with_retry(chunks: DataFrame, queries: DataFrame, top: int = 5, keep=lambda df, name: df) -> DataFrame:
    """``keep`` may write what is used twice.  As ``critiqued``; a document with candidates of which none is accepted is searched again for twice as many hits.  ``retried`` says so."""
    queries = keep(queries, "plan")
    once = keep(critiqued(chunks, queries, top), "candidates")
    again = once.groupBy("document_id").agg(F.bool_or("accepted").alias("any")).where("not any").select("document_id")
    again = keep(again, "again")
    texts = keep(chunks.join(dealt(again), "document_id", "left_semi"), "chunks-again")  # searched and looked up, so dealt once
    twice = critiqued(texts, queries.join(dealt(again), "document_id", "left_semi"), 2 * top)
    return once.join(dealt(again), "document_id", "left_anti").withColumn("retried", F.lit(False)).unionByName(twice.withColumn("retried", F.lit(True)))


def diagnostics(queries: DataFrame, hits: DataFrame, judged: DataFrame) -> DataFrame:
    """Per document of a plan: queries, hits, queries without a hit, candidates, accepted ones, reasons against."""
    planned = queries.groupBy("document_id").agg(F.count("*").alias("n_queries"))
    met = hits.groupBy("document_id").agg(F.count("*").alias("n_hits"), F.countDistinct("query_id").alias("answered"))
    seen = judged.groupBy("document_id").agg(F.count("*").alias("n_candidates"), F.count_if("accepted").alias("n_accepted"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    j = planned.join(dealt(met), "document_id", "left").join(dealt(seen), "document_id", "left")
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return j.select("document_id", "n_queries", zero("n_hits"), (F.col("n_queries") - F.coalesce("answered", F.lit(0))).alias("n_unanswered"), zero("n_candidates"), zero("n_accepted"), F.coalesce("reasons", F.lit("")).alias("reasons"))


def anchor(asked: DataFrame, doctrine: DataFrame) -> DataFrame:
    """asked (document_id, flag_code, anchor_id) with ``chunk_id`` of a doctrine chunk (chunk_id, place, flag_code): that of the id, else the flag's first."""
    first = doctrine.where("flag_code is not null").groupBy("flag_code").agg(F.min_by("chunk_id", F.struct("place", "chunk_id")).alias("_first"))
    by_id = doctrine.select(F.col("chunk_id").alias("_id"))
    j = asked.join(by_id, F.col("anchor_id") == F.col("_id"), "left").join(first, "flag_code", "left")
    return j.withColumn("chunk_id", F.coalesce("_id", "_first")).drop("_id", "_first")


def doctrine_hits(questions: DataFrame, doctrine: DataFrame, top: int = 10) -> DataFrame:
    """(document_id, place, flag_code, chunk_id, score): the ``top`` doctrine chunks (chunk_id, text, flag_code) nearest each document's question.

    Each different question is searched once, by matrix products; blank and null questions have no hits.  It feeds ``plan``.
    """
    asked = questions.where(F.trim(F.coalesce("question", F.lit(""))) != "").select("document_id", "question")
    found = vector_index.exact(doctrine.select("chunk_id", tx.hash_embedding(F.col("text")).alias("v")), asked.select(F.col("question").alias("query_id")).distinct().withColumn("q", tx.hash_embedding(F.col("query_id"))), top)
    hits = found.join(doctrine.select("chunk_id", "flag_code"), "chunk_id")
    return asked.join(hits, F.col("question") == F.col("query_id")).select("document_id", F.col("rank").alias("place"), "flag_code", "chunk_id", "score")


def anchored(asked: DataFrame, doctrine: DataFrame) -> DataFrame:
    """As ``anchor``, with a third way: a flag that no doctrine chunk names gets the chunk nearest its own words.  doctrine has ``text`` too."""
    found = anchor(asked, doctrine)
    lost = found.where("chunk_id is null").select("flag_code").distinct()
    words = F.lower(F.replace("flag_code", F.lit("_"), F.lit(" ")))
    near = vector_index.exact(doctrine.select("chunk_id", tx.hash_embedding(F.col("text")).alias("v")), lost.select(F.col("flag_code").alias("query_id"), tx.hash_embedding(words).alias("q")), 1)
    out = found.join(near.select(F.col("query_id").alias("flag_code"), F.col("chunk_id").alias("_near")), "flag_code", "left")
    return out.withColumn("chunk_id", F.coalesce("chunk_id", "_near")).drop("_near")


def debug_rows(queries: DataFrame, hits: DataFrame, judged: DataFrame, shown: int = 300) -> DataFrame:
    """(document_id, part, query_id, flag_code, rank, query, clusters, anchor_id, chunk_id, score, excerpt, reason): what a search did, row by row.

    part ``query``: a query of the plan; ``hit``: a chunk that it found, with the excerpt's first ``shown`` characters; ``candidate``: a flag
    and the reason against it, null if it was accepted.  Columns that a part does not have are null.
    """
    names = ["document_id", "part", "query_id", "flag_code", "rank", "query", "clusters", "anchor_id", "chunk_id", "score", "excerpt", "reason"]
    kinds = {"rank": "int", "query": "string", "clusters": "string", "anchor_id": "string", "chunk_id": "string", "score": "double", "excerpt": "string", "reason": "string"}

    def rows(df: DataFrame, part: str, **columns: Column) -> DataFrame:
        own = {"document_id": F.col("document_id"), "part": F.lit(part), "query_id": F.col("query_id").cast("long"), "flag_code": F.col("flag_code")} | {k: v.cast(kinds[k]) for k, v in columns.items()}
        return df.select(*[own.get(n, F.lit(None).cast(kinds.get(n, "string"))).alias(n) for n in names])

    out = rows(queries, "query", query=F.col("query"), clusters=F.array_join("clusters", ","), anchor_id=F.col("anchor_id"))
    out = out.unionByName(rows(hits, "hit", rank=F.col("rank"), chunk_id=F.col("chunk_id"), score=F.col("score"), excerpt=F.substring("excerpt", 1, shown)))
    return out.unionByName(rows(judged, "candidate", rank=F.col("rank"), chunk_id=F.col("chunk_id"), excerpt=F.col("quote"), reason=F.col("reason")))
