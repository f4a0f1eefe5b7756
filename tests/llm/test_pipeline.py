import hashlib
import random

import public_tokenizers

import corpus_pipeline
from tests.llm.test_repetition import brute as brute_repeats
from tests.llm.test_simhash import brute_components, brute_fp
from veedor.llm import bpe


def some_docs():
    r = random.Random(8)
    syllables = "ka lo mi ne ru sa to ve pi du".split()
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    rows = []
    for i in range(160):
        kind = r.random()
        text = " ".join(word() for _ in range(r.randint(10, 120)))
        if kind < 0.15 and rows:
            text = rows[r.randrange(len(rows))][1].upper()
        elif kind < 0.3 and rows:
            text = rows[r.randrange(len(rows))][1] + " tail"
        elif kind < 0.4:
            text = " ".join([word(), word()] * 30)
        rows.append((i, text, "en", r.choice(["a", "a", "a", "b", "c"]), len(text)))
    return rows + [(900, None, "en", None, 0), (901, "", "en", "a", 0)]


def brute(rows):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    kept = []
    for row in rows:
        n, _, _, _, windows, spans, longest = brute_repeats(row[1])
        if n >= 20 and 100 * windows <= 30 * n and spans <= 0.4 * n and longest <= 120:
            kept.append(row)
    best = {}
    for row in kept:
        best[lower(row[1])] = max(best.get(lower(row[1]), row), row)
    kept = list(best.values())
    fps = {row[0]: brute_fp(row[1]) for row in kept}
    comp = brute_components(set(fps.values()))
    least = {}
    for i, f in fps.items():
        least[comp[f]] = min(least.get(comp[f], i), i)
    kept = [row for row in kept if least[comp[fps[row[0]]]] == row[0]]
    ranks = bpe.Ranks.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return sorted((row[0], ranks.encoding.encode_ordinary(row[1]), hashlib.sha256(row[1].encode()).hexdigest()) for row in kept)


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows = some_docs()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, list(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = brute(rows)
    assert 20 < len(want) < len(rows) and got == want


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0


def test_pipeline_keeps_all_clean_documents(spark, tmp_path):
    """Nothing after near dedup leaves a document out, however unlike the sources' sizes are."""
    rows = some_docs()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
    got = sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect())
    assert got == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_places_of_the_tokens_follow_the_mix(spark, tmp_path):
    """Each stage has an effect on the result: the mix decides the place of every document."""
    rows = some_docs() + [(2000 + i, f"{i} " + " ".join(f"w{i}x{k}" for k in range(40)), "en", "big", 1) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
    want = [r.doc_id for r in docs.collect()]
    got = corpus_pipeline.run(spark, str(tmp_path)).select("place", "doc_id").collect()
    assert [r.doc_id for r in sorted(got)] == want != sorted(want) and sorted(r.place for r in got) == list(range(len(want)))
