"""The registered queries over the smallest tables, against their SQL or a brute-force version of their contract."""

import hashlib
import math
import os
import zlib
from collections import Counter

import duckdb
import pytest

from tests.llm import test_bpe, test_pii, test_repetition, test_simhash, test_suffix_tree_lm, test_url_filter
from veedor.llm import pii, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def docs():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


def rows(spark, name):
    return {r[0]: r for r in queries.QUERIES[name](spark, SF).collect()}


def test_op1(spark, docs):
    got = rows(spark, "op1_byte_bpe")
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        ids = test_bpe.RANKS.encoding.encode_ordinary(t or "")
        assert tuple(got[i]) == (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_op2(spark, docs):
    got = rows(spark, "op2_simhash")
    fps = {i: test_simhash.brute_fp(t) for i, t in docs.items()}
    comp = test_simhash.brute_components(set(fps.values()))
    least = {}
    for i, f in fps.items():
        least[comp[f]] = min(least.get(comp[f], i), i)
    assert {i: tuple(r)[1:] for i, r in got.items()} == {i: (f"{f:016x}", least[comp[f]]) for i, f in fps.items()}


def test_op3(spark, docs):
    got = rows(spark, "op3_zstd_quality")
    assert got.keys() == docs.keys() and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = c.sql(queries.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(x) for x in cols]
    assert sorted(str([r[x] for x in cols]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in want.fetchall())


def test_op5(spark, docs):
    got = rows(spark, "op5_pii")
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        base = test_pii.plain(t or "")
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        r = got[i]
        assert tuple(r)[1:6] == (*(sum(k == x for x, _, _ in base) for k in range(4)), hashlib.sha256(text.encode()).hexdigest())
        assert r.spans == text or r.spans.startswith(text) and "term_" in r.spans


def test_op6(spark, docs):
    got = rows(spark, "op6_suffix_tree_lm")
    held = {i: test_suffix_tree_lm.held(i) for i in docs}
    tokens = {i: test_suffix_tree_lm.tokens(t) for i, t in docs.items()}
    c = Counter(x for i, t in tokens.items() if not held[i] for x in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[x] > 0 for x in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t))
        assert r.score < 0
    seen = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in seen) > sum(r.base_score for r in seen)


def test_op9(spark):
    pages = dict(duckdb.sql(f"SELECT page_id, url FROM '{SF}/pages.parquet'").fetchall())
    got = rows(spark, "op9_boosted_urls")
    for i, u in pages.items():
        host, path, rule = test_url_filter.plain(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule.text)
        assert got[i].verdict == rule.verdict if rule else got[i].verdict in ("allow", "block")


def test_op10(spark, docs):
    got = rows(spark, "op10_repetition")
    for i, t in docs.items():
        plain = test_repetition.brute if len(t or "") < 2_000 else test_repetition.brute_by_windows
        n, chars, signs, lines, repeated, covered, longest = plain(t)
        failed = n < 20 or 100 * repeated > 30 * n
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, signs, lines, repeated, failed)
        assert r.kept == (not failed and covered <= 0.4 * n and longest <= 120)


def test_op13(spark, docs):
    got = rows(spark, "op13_language_id")
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    assert got.keys() == docs.keys() and list(next(iter(got.values())).asDict()) == ["doc_id", "held_out", "lang_pred", "score"]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].lang_pred == lang[i] for i in held) >= 0.95 * len(held)
    assert all(r.lang_pred in {*lang.values(), "und"} for r in got.values())
