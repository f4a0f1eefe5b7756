import random
import re

import pyarrow as pa
import pytest

from veedor.llm import substring_dedup
from veedor.llm.common import words


def brute(texts, window):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    where = {}
    for d, w in enumerate(docs):
        for p in range(len(w) - window + 1):
            where.setdefault(tuple(w[p : p + window]), []).append((d, p))
    gone = [set() for _ in docs]
    for places in where.values():
        if len(places) > 1:
            for d, p in places:
                gone[d].update(range(p, p + window))
    return [(len(w), len(g), " ".join(x for i, x in enumerate(w) if i not in g)) for w, g in zip(docs, gone)]


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") * r.randint(1, 2)
    passage = [[word() for _ in range(r.randint(5, 60))] for _ in range(8)]
    texts = []
    for _ in range(80):
        parts = []
        for _ in range(r.randint(1, 5)):
            parts += r.choice(passage)[r.randint(0, 3) :] if r.random() < 0.5 else [word() for _ in range(r.randint(1, 40))]
        texts.append(r.choice([" ", "\n"]).join(parts))
    texts += [texts[0]] * 30 + [None, "", "a", "x " * 400, "é ü " * 50, "Case words " * 3, "case words " * 3]
    return texts


@pytest.mark.parametrize("window,bits", [(35, 1 << 27), (7, 1 << 20), (3, 1 << 15), (2, 1 << 15)])
def test_removed_matches_brute_force(spark, window, bits):
    texts = corpus(window)
    rows = [(i, t, "n") for i, t in enumerate(texts)] + [(None, texts[5], "n"), (7, texts[7], "n"), (7, "other text " * 30, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(5)
    got = substring_dedup.removed(docs, window=window, filter_bits=bits)
    want = [(i, *x) for (i, _, _), x in zip(rows, brute([t for _, t, _ in rows], window))]
    assert sorted(map(str, (tuple(r)[:4] for r in got.collect()))) == sorted(map(str, want))


def test_factors_name_a_source(spark):
    texts = {1: [f"a{i}" for i in range(60)], 2: ["z"] + [f"a{i}" for i in range(10, 50)] + ["y"], 3: [f"q{i}" for i in range(50)]}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.factors for r in substring_dedup.removed(docs).collect()}
    (f,) = got[2]
    assert (f.start, f.end, f.src_doc, f.src_start) == (1, 41, 1, 10)
    (f,) = got[1]
    assert (f.start, f.end, f.src_doc, f.src_start) == (10, 50, 2, 1)
    assert got[3] == []
    assert substring_dedup.removed(docs.limit(0)).count() == 0


@pytest.mark.parametrize("window", [35, 7, 3])
def test_every_factor_is_a_copy_of_its_source(spark, window):
    """Passages of several sources in a row, the text's own repeats, and copies of whole documents over many tasks."""
    texts = corpus(window + 1)
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    passages = [[f"p{k}w{i}" for i in range(60)] for k in range(3)]
    texts += [" ".join(passages[0]), " ".join(passages[1]), " ".join(passages[0][:50] + passages[1][5:]), " ".join(passages[2]) * 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: r for r in substring_dedup.removed(docs, window=window).collect()}
    factors = 0
    for i, t in enumerate(texts):
        w = split(t)
        gone = set()
        for f in got[i].factors:
            assert f.end - f.start >= window and (f.src_doc, f.src_start) != (i, f.start)
            assert w[f.start : f.end] == split(texts[f.src_doc])[f.src_start : f.src_start + f.end - f.start]
            gone.update(range(f.start, f.end))
            factors += 1
        assert len(gone) == got[i].n_removed
    assert factors > 50
    two = got[len(texts) - 2].factors
    assert [f.src_doc for f in two if f.end - f.start >= 40] == [len(texts) - 4, len(texts) - 3]


def test_rows_with_equal_32_bit_hashes_are_told_apart(spark):
    from veedor.llm import pii, simhash, suffix_tree_lm

    a, b = "short 24812", "a much longer text of many words number 106293"
    for i in (None, 7):
        docs = spark.createDataFrame([(i, a, "x", 1), (i, b, "y", 2)], "doc_id long, text string, _id string, _th int")
        assert docs.select(substring_dedup.F.hash("text").alias("h")).distinct().count() == 1
        assert sorted(r.n_tokens for r in suffix_tree_lm.scored(docs).collect()) == [3, 10]
        assert sorted(r.n_words for r in substring_dedup.removed(docs).collect()) == [2, 9]
        assert pii.sanitised(docs).count() == 2 and sorted(r.text for r in pii.sanitised(docs).collect()) == sorted([a, b])
        kept = simhash.keep_one(docs)
        assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == sorted([a, b])


def test_blocks_cover_every_window_once():
    texts = corpus(1)
    w = words(pa.array(texts))
    start, size, _ = substring_dedup.blocks(w.hashes, w.first, 9)
    got = [p for s, n in zip(start, size) for p in range(s, s + n)]
    assert got == [p for a, b in zip(w.first[:-1], w.first[1:]) for p in range(a, b - 8)]


def test_a_very_long_text(spark):
    r = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(60))
    long = " ".join(f"u{i}" for i in range(150_000)) + " " + passage + " " + " ".join(f"v{i}" for i in range(150_000))
    docs = spark.createDataFrame([(1, long), (2, "x " + passage), (3, "same " * 200_000)], "doc_id long, text string")
    got = {x.doc_id: (x.n_words, x.n_removed) for x in substring_dedup.removed(docs).collect()}
    assert got == {1: (300_060, 60), 2: (61, 60), 3: (200_000, 200_000)}
