import re
from collections import Counter, defaultdict

import numpy as np

from veedor.llm import collocations


def brute(rows, least, top, inside=80):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if a >= least}
        held = defaultdict(int)
        for p, a in frequent.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    held[p[i : i + k]] = max(held[p[i : i + k]], a)
        found = []
        for p, a in frequent.items():
            if len(p) > 1 and 100 * held[p] < inside * a:
                score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), " ".join(p), left, right))
        out |= {(lang, i + 1, p, -a, left, right, n[lang], -s) for i, (s, a, _, p, left, right) in enumerate(sorted(found)[:top])}
    return out


def prose(seed, texts=300):
    rng = np.random.default_rng(seed)
    words = [*"abcde", "né", "ñu", " x"]
    gaps = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ! "]
    return [("".join(str(rng.choice(words)) + str(rng.choice(gaps)) for _ in range(rng.integers(0, 60))), [None, "en", "De"][rng.integers(0, 3)]) for _ in range(texts)]


def mined(spark, rows, least, top, **options):
    got = collocations.mined(spark.createDataFrame(rows, "text string, lang string"), least, top, **options).collect()
    assert len({(r.lang, r["rank"]) for r in got}) == len(got)
    return {tuple(r) for r in got}


def test_against_brute_force(spark):
    rows = prose(1) + [("New York city. new york CITY; New York", "en")] * 12 + [(None, "en"), ("", None), ("...", "none")]
    assert mined(spark, rows, 10, 1000) == brute(rows, 10, 1000)
    assert mined(spark, rows, 10, 7) == brute(rows, 10, 7)


def test_full_sketches_and_many_shards_change_nothing(spark):
    rows = prose(2)
    want = brute(rows, 8, 500)
    assert mined(spark, rows, 8, 500, most_bits=16, per_shard=5) == want
    # A sketch of few cells rules out nothing: every phrase is a candidate and only the scan counts.
    least_bits = collocations.MOST_BITS
    try:
        sketch = collocations.sketched(collocations.prepared(spark.createDataFrame(rows, "text string, lang string"), "text", "lang"), 1, 8, 10)
    finally:
        assert collocations.MOST_BITS == least_bits
    assert sketch.bits == 10 and sum(sketch.shares()) > 0


def test_a_phrase_at_its_bound_and_repeats_across_pieces(spark):
    rows = [("u v", "en")] * 30 + [("p q", "en")] * 29 + [("q, p q", "en"), ("s s s s s", "en")] * 15
    got = mined(spark, rows, 30, 100)
    assert got == brute(rows, 30, 100)
    assert {r[2] for r in got} >= {"u v", "p q"}


def test_odd_rows(spark):
    assert mined(spark, [], 2, 10) == set()
    assert mined(spark, [(None, None), ("", "en")], 2, 10) == set()
    rows = [("a b", "en")] * 4
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "text string, lang string, n int, phrase string, shard int")
    assert {tuple(r) for r in collocations.mined(df, 2, 10).collect()} == brute(rows, 2, 10)


def test_a_long_text_and_a_long_word(spark):
    rows = [("a b c " * 700_000 + "w" * 300_000 + " z", "en"), (("w" * 300_000 + " z, ") * 3, "en"), ("b c. d", "en")]
    assert mined(spark, rows, 3, 100) == brute(rows, 3, 100)
