import math
import random
import zlib

import pytest
import zstandard

from veedor.llm import quality_zstd


def corpus(n=600):
    r = random.Random(4)
    syllables = "ka lo mi ne ru sa to ve".split()
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(r.randint(15, 120))]
        good = r.random() < 0.8
        docs.append((i, " ".join(w) + "." if good else r.choice([" ".join(x.upper() + "!!" for x in w), " | ".join(w), " ".join([w[0]] * len(w))]), "s"))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([*docs, (None, "x", "s"), (9001, None, "s"), (9002, "", "s"), (5, docs[5][1], "s")], "doc_id long, text string, score string")
    y = spark.createDataFrame([*labels, (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    got = quality_zstd.scored(df, quality_zstd.fit(df, y)).collect()
    assert len(got) == len(docs) + 4
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_held_out_labels_do_not_matter(spark):
    docs, labels = corpus(200)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    models = []
    for flip in (False, True):
        y = [(i, 1 - q if flip and zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q, _ in labels]
        models.append(quality_zstd.fit(df, spark.createDataFrame(y, "doc_id long, quality int")))
    assert models[0].weights == models[1].weights and models[0].good == models[1].good


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 1), (2, 1), (3, 1)]])
def test_too_few_labels(spark, labels):
    df = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "d")], "doc_id long, text string")
    y = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality_zstd.fit(df, y)
    assert {0 <= r.score <= 1 for r in quality_zstd.scored(df, model).collect()} == {True}
    assert quality_zstd.scored(df.limit(0), model).count() == 0


def test_scores_do_not_depend_on_how_rows_lie(spark):
    """Nor on bounds that bind; repeated rows and a very long text are scored like any other."""
    docs, labels = corpus(300)
    rows = [*docs, docs[3], (5_000, "long text " * 300_000, "s")]
    df, y = spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    options = {"per_class": 40, "calibration": 100, "sample_bytes": 8_000}
    scores = []
    for d, lab in ((df, y), (df.repartition(7), y.repartition(5)), (df.orderBy(quality_zstd.F.desc("text")), y.orderBy(quality_zstd.F.desc("doc_id")))):
        got = quality_zstd.scored(d, quality_zstd.fit(d, lab, **options)).collect()
        scores.append(sorted((r.doc_id, r.score) for r in got))
    assert scores[0] == scores[1] == scores[2] and len(scores[0]) == len(rows)


def brute_score(model, text):
    """The compressed sizes block by block under either dictionary, and the logistic curve of their differences."""
    raw, sizes = (text or "").encode(), []
    for d in (model.good, model.bad):
        blocks = [raw[i : i + 1024] for i in range(0, len(raw), 1024)]
        sizes.append(sum(len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(b)) for b in blocks))
    good, bad = sizes
    x = [1.0, (bad - good) / len(raw), (bad - good) / max(sizes), min(sizes) / len(raw)] if raw else [1.0, 0.0, 0.0, 0.0]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights))))


def test_scores_of_a_given_model_match_brute_force(spark):
    docs, labels = corpus(150)
    df = spark.createDataFrame([*docs, (900, None, "s"), (901, "", "s"), (902, "é" * 5_000, "s")], "doc_id long, text string, source string")
    model = quality_zstd.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.score for r in quality_zstd.scored(df, model).collect()}
    for i, text in [(d, t) for d, t, _ in docs] + [(900, None), (901, ""), (902, "é" * 5_000)]:
        assert abs(got[i] - brute_score(model, text)) < 1e-12


def test_a_very_long_labelled_text_does_not_reach_the_dictionaries(spark):
    docs, labels = corpus(200)
    kept = spark.createDataFrame(docs, "doc_id long, text string, source string")
    longs = [i for i in range(10_000, 10_030) if zlib.crc32(str(i).encode()) % 5]
    more = kept.unionByName(spark.createDataFrame([(i, "s") for i in longs], "doc_id long, source string").selectExpr("doc_id", "repeat('WORD!! ', 900000) as text", "source"))
    y = spark.createDataFrame([*labels, *((i, 0, 0) for i in longs)], "doc_id long, quality int, toxic int")
    model = quality_zstd.fit(more, y, sample_bytes=1 << 20, calibration=50)
    assert model.good and model.bad and len(model.bad) < 100_000
    alone = quality_zstd.fit(kept, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), sample_bytes=1 << 20, calibration=50)
    assert model.good == alone.good and model.bad == alone.bad
