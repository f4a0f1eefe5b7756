import hashlib
import random

import pytest

from veedor.llm import exact_dedup


def norm(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def some_rows():
    r = random.Random(1)
    texts = ["", None, "Ab", "aB", "ÀB", "àb", "x" * 50_000, "X" * 50_000, "İx", "K", "k"] + [r.choice("abAB") * r.randint(1, 3) for _ in range(60)]
    return [(i, t, "k") for i, t in enumerate(texts)] + [(None, "only null", "k"), (None, "only null", "k"), (None, "ab", "k"), (3, "aB", "k")]


@pytest.mark.parametrize("bits", [1 << 29, 1 << 15])
def test_groups(spark, bits):
    rows = some_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    best, size = {}, {}
    for i, t, _ in rows:
        k = norm(t)
        size[k] = size.get(k, 0) + 1
        best[k] = max((x for x in (i, best.get(k)) if x is not None), default=None)
    want = [(i, best[norm(t)], size[norm(t)], i == best[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, _ in rows]
    got = exact_dedup.groups(docs, most_bits=bits)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert "Python" not in got._jdf.queryExecution().toString()


def test_keep_one(spark):
    rows = some_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = exact_dedup.keep_one(docs)
    assert got.columns == docs.columns
    kept = [(r.doc_id, norm(r.text)) for r in got.collect()]
    assert len(kept) == len({k for _, k in kept}) == len({norm(t) for _, t, _ in rows})
    best = {}
    for i, t, _ in rows:
        best[norm(t)] = max((x for x in (i, best.get(norm(t))) if x is not None), default=None)
    assert dict((k, i) for i, k in kept) == best
    assert exact_dedup.keep_one(docs.limit(0)).count() == 0


def test_full_filter_still_gives_exact_groups(spark):
    docs = spark.range(30_000).selectExpr("id as doc_id", "cast(id div 2 * 2 + if(id < 1000, id % 2, 0) as string) as text")
    got = exact_dedup.groups(docs, most_bits=1 << 15)
    assert got.where("group_size = 2").count() == 29_000
    assert got.where("group_size = 1").count() == 1_000
