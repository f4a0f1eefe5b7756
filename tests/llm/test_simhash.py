import random
import re

import numpy as np
import pytest
import xxhash

from veedor.llm import simhash


def brute_fp(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, distance=3):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    todo = list(nodes)
    for i, a in enumerate(todo):
        for b in todo[:i]:
            if (a ^ b).bit_count() <= distance:
                parent[root(a)] = root(b)
    return {n: root(n) for n in nodes}


def test_fingerprints_and_components(spark):
    r = random.Random(3)
    base = [" ".join(r.choice("The quick Brown fox éx ÀB jumps over a lazy dog".split()) for _ in range(r.randint(1, 40))) for _ in range(60)]
    texts = base + [b.upper() for b in base[:5]] + ["", None, "one", "one two", " \t\n"] + [b + " tail" for b in base[:30]]
    rows = [(10 + i, t, i) for i, t in enumerate(texts)] + [(12, base[3], 0), (None, base[4], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = simhash.report(docs).collect()
    fps = {i: brute_fp(t) for i, t in enumerate([t for _, t, _ in rows])}
    comp = brute_components(set(fps.values()))
    ids = {}
    for i, (doc, _, _) in enumerate(rows):
        if doc is not None:
            ids[comp[fps[i]]] = min(ids.get(comp[fps[i]], doc), doc)
    want = [(doc, f"{fps[i]:016x}", ids[comp[fps[i]]]) for i, (doc, _, _) in enumerate(rows)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("limit", [2, 40, simhash.LIMIT])
def test_links_connect_all_near_fingerprints(spark, limit):
    r = random.Random(limit)
    centres = [r.getrandbits(64) for _ in range(6)] + [0]
    fps = set(centres)
    for c in centres:
        for _ in range(60):
            x = c
            for _ in range(r.randint(1, 7)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    found = simhash.components(simhash.links(df, limit=limit)).collect()
    got = {x.node: x.component for x in found}
    want = brute_components({simhash.signed(x) & (2**64 - 1) for x in fps})
    same = {}
    for x in fps:
        same.setdefault(want[x], set()).add(got.get(simhash.signed(x), simhash.signed(x)))
    assert all(len(s) == 1 for s in same.values())
    assert len({next(iter(s)) for s in same.values()}) == len(same)


def test_masks_bound_meetings():
    for m in simhash.masks(6, 3):
        finer = simhash._finer(m, 3)
        assert all(64 - f.bit_count() <= 13 and f & m == m for f in finer)
    assert len(simhash.masks(6, 3)) == 20


def test_long_path_settles(spark):
    edges = spark.range(0, 300).selectExpr("id as a", "id + 1 as b")
    assert {r.component for r in simhash.components(edges).collect()} == {0}
    assert simhash.components(edges.limit(0)).count() == 0


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(5, text, "a"), (2, text.upper(), "b"), (9, "quite another text of some words", "c"), (None, text, "d")], "id long, body string, component_id string")
    got = simhash.keep_one(docs, "id", "body")
    assert got.columns == docs.columns
    assert sorted(r.component_id for r in got.collect()) == ["b", "c", "d"]
    assert simhash.keep_one(docs.limit(0), "id", "body").count() == 0
    assert np.bitwise_count(np.uint64(7)) == 3


def test_second_dealing_has_each_fingerprint_once(spark):
    all_masks = [simhash.signed(m) for m in simhash.masks(6, 3)]
    first = spark.createDataFrame([(1, fp, m) for fp in range(5) for m in all_masks], "kind long, a long, b long")
    finer = {f for m in simhash.masks(6, 3) for f in simhash._finer(m, 3)}
    assert simhash._again(first, 3, 6).count() == 5 * len(finer) < 5 * sum(len(simhash._finer(m, 3)) for m in simhash.masks(6, 3))


def test_nothing_too_large_is_dropped_after_the_last_dealing():
    import pyarrow as pa
    import pytest

    rows = pa.RecordBatch.from_arrays([pa.array([0, 0, 0]), pa.array([0, 0, 0]), pa.array([1, 2, 3])], ["mask", "key", "fp"])
    with pytest.raises(RuntimeError):
        list(simhash._met(3, 2, True)([rows]))
    assert sum(b.num_rows for b in simhash._met(3, 2)([rows])) == 3


def test_a_long_text_in_pieces_has_the_same_fingerprint():
    import random

    r = random.Random(6)
    texts = [" ".join(r.choice(["ab", "c", "d" * 40]) for _ in range(r.randint(0, 80))) + r.choice(["", " ", "\n\n"]) for _ in range(60)] + ["", " ", "one", "one two", "x" * 500]
    for text in texts:
        assert {simhash.fingerprint(text.encode(), piece=p) for p in (1, 7, 64, 1 << 20)} == {brute_fp(text)}
    long = "lorem ipsum dolor " * 400_000
    assert simhash.fingerprint(long.encode()) == simhash.fingerprint(long.encode(), piece=1 << 16)
