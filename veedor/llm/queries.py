"""The queries opN_<name> and pipeline over the test tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, divergence, exact_dedup, language_id, mixing, pii, quality_zstd, repetition, simhash, substring_dedup, suffix_tree_lm, url_filter


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.Ranks.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.report(documents(spark, sf_dir), ranks)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(documents(spark, sf_dir))


def op3_zstd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_zstd.scored(docs, quality_zstd.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(documents(spark, sf_dir))


OP4_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op6_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.scored(documents(spark, sf_dir))


def op7_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(documents(spark, sf_dir))


OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws FROM documents
), p AS (
  SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 34 <= len(ws) THEN array_to_string(ws[i:i + 34], ' ') END AS run FROM w, unnest(range(1, len(ws) + 1)) r(i)
), f AS (
  SELECT doc_id, i, word, run IS NOT NULL AND count(*) OVER (PARTITION BY run) > 1 AS found FROM p
), c AS (
  SELECT doc_id, i, word, max(found::INT) OVER (o ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) = 1 AS gone, found AND NOT coalesce(lag(found) OVER o, false) AS starts FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), g AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept, count(*) FILTER (starts) AS n_spans FROM c GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0)::BIGINT AS n_spans FROM w LEFT JOIN g USING (doc_id)
"""


def op8_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return mixing.mixed(docs, mixing.tempered(docs))


OP8_SQL = """
WITH RECURSIVE sizes AS (
  SELECT source, count(*) AS n, pow(count(*), 0.7) AS w FROM documents GROUP BY source
), exact AS (
  SELECT source, n, w / sum(w) OVER () * 1000 AS x FROM sizes
), quota AS (
  SELECT source, n, floor(x)::BIGINT + (row_number() OVER (ORDER BY x - floor(x) DESC, source NULLS FIRST) <= 1000 - sum(floor(x)) OVER ())::BIGINT AS q FROM exact
), served AS (
  SELECT source, n, q, row_number() OVER (ORDER BY source NULLS FIRST) AS i FROM quota WHERE q > 0
), sim(slot, ks, pick, k) AS (
  SELECT -1::BIGINT, list_transform(list(q ORDER BY i), lambda v: 0::BIGINT), 0::BIGINT, 0::BIGINT FROM served
  UNION ALL
  SELECT slot + 1, list_transform(ks, lambda v, j: v + (j = best)::BIGINT), best, ks[best] FROM (
    SELECT slot, ks, list_min(list_transform(ks, lambda v, j: CASE WHEN v < qs[j] AND v * 1000 // qs[j] <= slot + 1 THEN ((v + 1) * 1000 + qs[j] - 1) // qs[j] * 1000 + j ELSE 1000000000 END)) % 1000 AS best
    FROM sim, (SELECT list(q ORDER BY i) AS qs FROM served) WHERE slot < 999)
), slots AS (
  SELECT pick AS i, k, slot AS s FROM sim WHERE slot >= 0
), ranked AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS rank FROM documents
), ends AS (
  SELECT min((n + 63) // 64 // q * 1000 + s) AS stop FROM served JOIN slots USING (i) WHERE k = (n + 63) // 64 % q
), placed AS (
  SELECT doc_id, r.source, rank, rank // 64 AS block, rank // 64 // q * 1000 + s AS slot
  FROM ranked r LEFT JOIN served v ON r.source IS NOT DISTINCT FROM v.source LEFT JOIN slots t ON t.i = v.i AND t.k = rank // 64 % q
)
SELECT doc_id, source, rank, block, slot, coalesce(slot < stop, false) AS in_mix FROM placed, ends
"""


URL_RULES = [url_filter.Rule.parse(v, t) for v, t in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))]


def op9_boosted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document whose number ends its path; that document's labels are the url's: toxic or of low quality is blocked."""
    pages, labels = spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    number = F.regexp_extract(url_filter.parts(F.col("url"))[1], r"/([0-9]{1,18})(?:\.html)?/?$", 1).try_cast("long")
    bad = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("blocked"))
    model = url_filter.fit(pages.select("url", number.alias("doc_id")).join(bad, "doc_id").select("url", "blocked"))
    return url_filter.judged(pages, URL_RULES, model)


def op10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judged(documents(spark, sf_dir)).drop("th")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mined(documents(spark, sf_dir))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?

]')) AS piece FROM d
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') AS ws FROM p
), g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) s(k))
), c AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, count(*)::HUGEINT AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30
), cut AS (
  SELECT c.lang, c.phrase, c.f AS a, j, l.f AS l, r.f AS r, 2000000 * c.f // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c WHERE k > 1) c
  JOIN c l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:j], ' ')
  JOIN c r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[j + 1:], ' ')
), best AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), held AS (
  SELECT lang, array_to_string(ws[i:i + s - 1], ' ') AS phrase, max(f) AS most
  FROM (SELECT lang, ws, f, s, unnest(range(1, k - s + 2)) AS i FROM c, (VALUES (2), (3)) z(s) WHERE s < k) GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase WHERE h.most IS NULL OR 100 * h.most < 80 * b.a
), words AS (
  SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN words USING (lang) QUALIFY rank <= 2000
"""


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.report(documents(spark, sf_dir))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), o AS (
  SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS d FROM o GROUP BY ALL
), k AS (
  SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL HAVING sum(d) >= 30
), v AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n_all FROM k GROUP BY lang
), g AS (
  SELECT e.lang, e.source, coalesce(sum(c.n) FILTER (k.term IS NOT NULL), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM d) e LEFT JOIN c ON e.lang = c.lang AND e.source = c.source LEFT JOIN k ON c.lang = k.lang AND c.term = k.term
  GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (g.total + 5 * v.v) AS p, 1 + (1000000000 * (k.n + 5)) // (v.n_all + 5 * v.v) AS q
  FROM g JOIN v USING (lang) JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, term AS item, (p - q)::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS rank FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term' AS part, item, value, rank::INTEGER AS rank FROM terms WHERE rank <= 50
"""


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language_id.fit(docs.where(~held_out).select("text", "lang"))
    return language_id.predicted(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_simhash": op2_simhash,
    "op3_zstd_quality": op3_zstd_quality,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_pii": op5_pii,
    "op6_suffix_tree_lm": op6_suffix_tree_lm,
    "op7_relative_lz": op7_relative_lz,
    "op8_pfair_mix": op8_pfair_mix,
    "op9_boosted_urls": op9_boosted_urls,
    "op10_repetition": op10_repetition,
    "op11_collocations": op11_collocations,
    "op12_source_divergence": op12_source_divergence,
    "op13_language_id": op13_language_id,
}

ORACLES: dict[str, str] = {
    "op4_exact_dedup": OP4_SQL,
    "op7_relative_lz": OP7_SQL,
    "op8_pfair_mix": OP8_SQL,
    "op11_collocations": OP11_SQL,
    "op12_source_divergence": OP12_SQL,
}
