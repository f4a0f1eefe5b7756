import hashlib
import random
from collections import Counter

import pytest

from veedor.llm import mixing


@pytest.mark.parametrize("weights,period", [({"a": 1, "b": 1, "c": 1}, 7), ({"a": 5, "b": 3, None: 2}, 10), ({"x": 1}, 5), ({str(i): i**2 for i in range(1, 21)}, 1000), ({"a": 1e-9, "b": 1}, 100)])
def test_schedule_stays_within_a_block(weights, period):
    quota = mixing.quotas(weights, period)
    assert sum(quota.values()) == period and all(abs(q - weights[s] / sum(weights.values()) * period) < 1 for s, q in quota.items())
    served = Counter()
    for source, k, slot in mixing.schedule(quota, period):
        assert k == served[source]
        served[source] += 1
        for s, q in quota.items():
            assert abs(served[s] * period - q * (slot + 1)) < period
    assert served == {s: q for s, q in quota.items() if q}


def rows():
    r = random.Random(1)
    out = [(i, "abc"[min(2, r.randrange(6))], f"t{i}") for i in range(400)] + [(i, None, "n") for i in range(400, 440)] + [(None, "a", "x"), (5, "z", "t5"), (7, "a", "t"), (7, "a", "t")]
    return out


@pytest.mark.parametrize("block", [1, 7, 64])
def test_mixed_matches_brute_force(spark, block):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, source string, slot string")
    weights = {"a": 0.5, "b": 0.2, "c": 0.2, None: 0.1}
    got = mixing.mixed(docs, weights, block=block, period=20).collect()
    order = {s: sorted((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), -1 if i is None else i) for i, x, _ in data if x == s) for s in {x for _, x, _ in data}}
    slots = {(s, k): t for s, k, t in mixing.schedule(mixing.quotas(weights, 20), 20)}
    q = mixing.quotas(weights, 20)
    slot = lambda s, b: b // q[s] * 20 + slots[s, b % q[s]] if s in q else None
    end = min(slot(s, -(-len(order[s]) // block)) for s in q)
    want = [(None if i < 0 else i, s, n, n // block, slot(s, n // block), s in q and slot(s, n // block) < end) for s, x in order.items() for n, (_, i) in enumerate(x)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    inside = Counter(r.source for r in got if r.in_mix)
    for s, share in weights.items():
        assert abs(inside[s] / block - share * end) < 2
    kept = mixing.selected(docs, weights, block=block, period=20)
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.source) for r in kept.collect()))) == sorted(map(str, ((r.doc_id, r.source) for r in got if r.in_mix)))


def test_empty_and_wrong_weights(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mixed(docs, {"a": 1}).count() == 0 and mixing.selected(docs, {"a": 1}).count() == 0
    with pytest.raises(ValueError):
        mixing.quotas({}, 10)
    with pytest.raises(ValueError):
        mixing.quotas({"a": -1, "b": 2}, 10)


def test_tempered(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, source string, slot string")
    got = mixing.tempered(docs, power=0.5)
    assert got["a"] == pytest.approx(len([1 for _, s, _ in rows() if s == "a"]) ** 0.5) and None in got


def test_arranged_keeps_every_row_in_order(spark):
    data = rows() + [(10_000 + i, f"s{i}", "u") for i in range(1_100)] + [(20_000, None, "n")]
    docs = spark.createDataFrame(data, "doc_id long, source string, slot string")
    weights = mixing.tempered(docs)
    quota, period = mixing.served(weights)
    assert min(quota.values()) >= 1 and sum(quota.values()) == period and set(quota) == {s for _, s, _ in data}
    assert mixing.served({"big": 1e6, "tiny": 1.0, None: 1.0}) == ({"big": 998, "tiny": 1, None: 1}, 1_000)
    got = mixing.arranged(docs, weights, block=7)
    assert got.columns == docs.columns
    slots = {(s, k): t for s, k, t in mixing.schedule(quota, period)}
    order = {s: sorted((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), -1 if i is None else i) for i, x, _ in data if x == s) for s in quota}
    want = sorted((k // 7 // quota[s] * period + slots[s, k // 7 % quota[s]], k, i, s) for s, x in order.items() for k, (_, i) in enumerate(x))
    assert [(-1 if r.doc_id is None else r.doc_id, r.source) for r in got.collect()] == [(i, s) for _, _, i, s in want]


def test_the_mix_stage_keeps_small_and_hot_sources_whole(spark):
    import corpus_pipeline

    data = [(i, "hot" if i < 2_000 else f"s{i % 3}" if i < 2_300 else "tiny", "x") for i in range(2_303)]
    docs = spark.createDataFrame(data, "doc_id long, source string, text string")
    assert sorted(map(tuple, corpus_pipeline.mix(spark, docs, "").collect())) == data


def test_no_source_with_a_weight_is_left_out(spark):
    data = [(i, f"s{i // 2}", "x") for i in range(4_000)]
    docs = spark.createDataFrame(data, "doc_id long, source string, text string")
    got = mixing.mixed(docs, mixing.tempered(docs), block=2)
    assert got.where("slot is null").count() == 0 and got.where("in_mix").count() > 3_900
    assert mixing.served({"a": 1.0, "b": 0.0})[0] == {"a": 1000, "b": 0}


def test_rows_are_dealt_once_for_their_ranks(spark):
    """Ranges and offsets meet by the column that the rows were dealt by, so wide rows are not dealt again for the join."""
    docs = spark.createDataFrame(rows(), "doc_id long, source string, slot string")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = mixing.ranked(docs, "doc_id", "source", docs["slot"].alias("wide"))._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    wide = [line for line in plan.splitlines() if line.lstrip().startswith(":")]  # the join's left side: the rows
    assert sum("Exchange" in line for line in wide) == 1
