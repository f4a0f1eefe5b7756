import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from veedor.llm import suffix_tree_lm as lm


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def model(rows, max_context, least_context, least_pair):
    """The same model by dictionaries of tuples: (P(x | context), retained contexts, unigram, counts, their sum)."""
    train = [tokens(t) for i, t in rows if not held(i)]
    c = Counter(x for t in train for x in t)
    n, v = sum(c.values()), len(c)
    uni = lambda x: (c[x] + 1) / (n + v + 1)
    counts = [{(x,): k for x, k in c.items()}]
    for d in range(1, max_context + 1):
        m = Counter()
        for t in train:
            s = ["start", *t]
            s[0] = None
            for i in range(d, len(s)):
                m[tuple(s[i - d : i + 1])] += 1
        counts.append(m)
    retained = {}

    def prob(context, x):
        for k in range(min(max_context, len(context)), 0, -1):
            s = tuple(context[-k:])
            if s in retained:
                kept, total, back = retained[s]
                return (kept[x] - lm.DISCOUNT) / total * (x in kept) + back * prob(context[len(context) - k + 1 :], x) if x in kept else back * prob(context[len(context) - k + 1 :], x)
        return uni(x)

    tried = {(x,): k for x, k in c.items() if k >= least_context * n}
    for d in range(1, max_context + 1):
        entries, new = {}, {}
        for g, k in counts[d].items():
            if g[:-1] in tried and len(g) == d + 1 and k >= max(2, least_pair * n) and c[g[-1]] >= least_pair * n:
                entries.setdefault(g[:-1], Counter())[g[-1]] = k
        for s, kept in entries.items():
            total = tried[s]
            parent = {x: prob(list(s[1:]), x) for x in kept}
            gain = sum(k * math.log(k / total / parent[x]) for x, k in kept.items())
            rest = total - sum(kept.values())
            if rest > 0:
                gain += rest * math.log(rest / total / max(1e-12, 1 - sum(parent.values())))
            if lm.diverges(np.array(gain), np.array(len(kept)), np.array(float(total))):
                new[s] = (kept, total, 1 - (sum(kept.values()) - lm.DISCOUNT * len(kept)) / total)
        retained |= new
        tried = {s + (x,): k for s, kept in entries.items() for x, k in kept.items() if k >= least_context * n}
    return prob, retained, uni, c, n


def brute(rows, max_context, least_context, least_pair):
    prob, retained, uni, c, n = model(rows, max_context, least_context, least_pair)
    out = []
    for i, t in rows:
        seq = [None, *tokens(t)]
        score = sum(math.log10(prob(seq[max(0, j - max_context) : j], seq[j])) for j in range(1, len(seq)))
        out.append((i, held(i), len(seq) - 1, sum(c[x] > 0 for x in seq[1:]), n, sum(math.log10(uni(x)) for x in seq[1:]), score))
    return out, retained


def corpus():
    r = random.Random(11)
    phrases = ["The cat sat on a mat", "a dog ran home fast", "the sun is up", "É ß ü"]
    rows = [(i, " ".join(r.choice(phrases) if r.random() < 0.7 else r.choice("xyzwvu") * r.randint(1, 3) for _ in range(r.randint(1, 12)))) for i in range(120)]
    return rows + [(500, None), (501, ""), (None, "the cat sat"), (502, "never seen words here"), (9, rows[9][1])]


@pytest.mark.parametrize("max_context,head", [(1, 1e-9), (2, 0.01), (3, 1e-9)])
def test_scores_match_brute_force(spark, max_context, head):
    rows = corpus()
    least = max(head, 0.002)
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    got = lm.scored(docs, max_context=max_context, least_head=head, least_context=max(least, 0.004), least_pair=least).collect()
    want, retained = brute(rows, max_context, max(least, 0.004), least)
    assert len({len(s) for s in retained}) >= min(2, max_context)
    order = lambda x: (str(x[0]), x[2])
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(want, key=order), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_contexts_help_on_held_out_text(spark):
    rows = lm.scored(spark.createDataFrame(corpus(), "doc_id long, text string"), least_context=0.004, least_pair=0.002).collect()
    seen = [r for r in rows if r.held_out]
    assert sum(r.score for r in seen) > sum(r.base_score for r in seen)
    assert lm.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_distributions_sum_to_one():
    """What follows a retained context adds up to one over all tokens, but for the share that unseen ones keep."""
    prob, retained, _, c, _ = model(corpus(), 3, 0.0, 0.0)
    assert {len(s) for s in retained} == {1, 2, 3}
    for s in retained:
        assert sum(prob(list(s), x) for x in c) == pytest.approx(1, abs=0.002)


@pytest.mark.parametrize("travel", [{}, {"least_head": 0.01, "least_sent": 0.01, "filter_bits": 1 << 15}])
def test_evidence_counts_alike_at_every_size(spark, travel):
    """A pair seen a few times keeps its entry however much other text there is, joined or broadcast."""
    r = random.Random(4)
    filler = [(i, " ".join(f"w{r.randrange(40)}" for _ in range(60))) for i in range(1000, 6000)]
    rows = corpus() + [(600 + i, "quod erat demonstrandum") for i in range(4)] + filler
    want, retained = brute(rows, 2, 0.0, 0.0)
    assert ("quod",) in retained and 4 < 2e-5 * want[0][4]
    got = lm.scored(spark.createDataFrame(rows, "doc_id long, text string"), **travel).collect()
    order = lambda x: (str(x[0]), x[2])
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(want, key=order), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)
    alone = {r.doc_id: r.score - r.base_score for r in lm.scored(spark.createDataFrame(rows, "doc_id long, text string"), least_context=2e-4, least_pair=2e-4).collect()}
    many = {r.doc_id: r.score - r.base_score for r in got}
    assert all(many[600 + i] > alone[600 + i] + 3 for i in range(4))


def test_very_long_text_and_small_flushes(spark, monkeypatch):
    """A text of many flushes' size, and rows over many flushes, score as by brute force."""
    r = random.Random(8)
    rows = corpus() + [(700, " ".join(f"w{r.randrange(50)}" for _ in range(30_000)))]
    want, _ = brute(rows, 2, 0.0, 0.0)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    order = lambda x: (str(x[0]), x[2])
    for a, b in zip(sorted(map(tuple, lm.scored(docs, least_head=0.01, least_sent=0.01).collect()), key=order), sorted(want, key=order), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_index_finds_each_hash():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 1000):
        values = np.unique(r.integers(0, 2**63, n, dtype=np.uint64) >> np.uint64(r.integers(0, 40)))
        asked = np.concatenate([values, r.integers(0, 2**64, 500, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        at = lm.Index(values).find(asked)
        where = {int(v): i for i, v in enumerate(values)}
        assert at.tolist() == [where.get(int(x), -1) for x in asked]
