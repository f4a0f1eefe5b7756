import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from veedor.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
KIND = "text string, lang string, source string"


def brute(rows, least_docs, top):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        whole = Counter()
        for (x, _), c in counts.items():
            if x == lang:
                whole += c
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}
        p = {s: share(c) for (x, s), c in counts.items() if x == lang}
        q = share(whole)
        for s in p:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in p if o != s)
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)}
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])
            out |= {(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(terms[:top])}
    return out


def report(spark, rows, **options):
    got = divergence.report(spark.createDataFrame(rows, KIND), **options).collect()
    assert len(set(map(tuple, got))) == len(got)
    return {tuple(r) for r in got}


def test_against_brute_force_over_many_groups_and_chunks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    terms = [f"{a}{b}é" for a in "abcdefgh" for b in "klmnop"]
    rows = [(" ".join(rng.choice(terms, rng.integers(0, 30), p=None)) + ", X9y", str(rng.choice(["en", "de", "x"])), f"s{rng.integers(0, 11)}") for _ in range(400)]
    rows += [(None, None, None), ("", "en", None), ("!!", "lonely", "s"), ("a" * 9, "", "s1")] * 2
    monkeypatch.setattr(divergence, "CHUNK", 7)
    for block in (1, 4, 16):
        assert report(spark, rows, least_docs=20, top=5, block=block) == brute(rows, 20, 5)


def test_odd_rows(spark):
    assert report(spark, []) == set()
    same = [("A b", "en", "s1")] * 3 + [("b c", "en", "s2")] * 3
    assert report(spark, same, least_docs=2) == brute(same, 2, 50)
    extra = spark.createDataFrame([(*r, 1, "t") for r in same], KIND + ", n int, term string")
    assert {tuple(r) for r in divergence.report(extra, least_docs=2).collect()} == brute(same, 2, 50)


def test_a_long_text_counts_each_term_once_as_a_document(spark):
    rows = [("ab " * 3_000_000 + "cd", "en", "s1"), ("ab", "en", "s1"), ("cd ef", "en", "s2")]
    got = {(r.source, r.term): (r.n, r.d) for r in divergence.counted(spark.createDataFrame(rows, KIND)).where("term <> ''").collect()}
    assert got == {("s1", "ab"): (3_000_001, 2), ("s1", "cd"): (1, 1), ("s2", "cd"): (1, 1), ("s2", "ef"): (1, 1)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10**15), min_size=1, max_size=5), st.integers(1, 10**6))
def test_shares_are_exact(counts, kept):
    total = sum(counts)
    assert divergence.shares(np.array(counts), total, kept).tolist() == [1 + 10**9 * (c + 5) // (total + 5 * kept) for c in counts]


def test_shares_in_sql_are_exact(spark):
    for n, total, kept in ((0, 1, 1), (10**13, 10**14 + 7, 123_456), (999, 1000, 3)):
        got = spark.range(1).selectExpr(f"{n}L as n", f"{total}L as total", f"{kept}L as kept").select(divergence.share("n", "total", "kept")).first()[0]
        assert got == 1 + 10**9 * (n + 5) // (total + 5 * kept)
