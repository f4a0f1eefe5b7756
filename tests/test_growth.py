"""Work that must not grow faster than the input: what is worked out once, sent on in pieces, or numbered without one task for all."""

import numpy as np
import pandas as pd

from veedor.operators import retrieval as rt
from veedor.operators import text as tx
from veedor.operators import vector_index
from veedor.plans import records
from veedor.sources.shared import placed, written


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_excerpts_are_trimmed_once_for_all_patterns(spark):
    hits = spark.createDataFrame([("d", 1, "  se pide formato A3  ...\n", 0, "Otros", "OBSOLETE_PHYSICAL_FORMAT", 1), ("d", 2, None, 0, "Otros", "OBSOLETE_PHYSICAL_FORMAT", 1)], "document_id string, chunk_id long, excerpt string, rank int, cluster string, flag_code string, query_id int")
    found = rt.flags(hits)
    assert [(r.chunk_id, r.quote) for r in found.collect()] == [(1, "se pide formato A3")]
    assert optimized(found).count("excerpt#") < 20


def test_pages_are_folded_once_for_all_rules(spark):
    pages = spark.createDataFrame([("d", 1, "SÓLO podrán: formato a3; a criterio del comité"), ("d", 2, None)], "document_id string, page_number int, text string")
    found = tx.page_flags(pages)
    assert found.where("page_number = 1").count() > 0 and found.where("page_number = 2").count() == 0
    assert optimized(found).count("lower(") == 1


def test_the_exact_vector_search_makes_no_row_for_each_pair(spark, tmp_path):
    rows = [(i, [float(np.cos(i)), float(np.sin(i))]) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = records.x11(spark, str(tmp_path))
    assert got.count() == 10 * 20 and "Join Cross" not in optimized(got)


def test_best_columns_with_ties():
    r = np.random.default_rng(1)
    for values in (3, 1_000_000):
        scores = r.integers(0, values, (50, 400)).astype(float)
        got = np.sort(vector_index.best_columns(scores, 20), axis=1)
        assert (got == np.sort(np.argsort(-scores, axis=1, kind="stable")[:, :20], axis=1)).all()


def test_rows_of_a_sorted_table_are_numbered_by_file(spark):
    ids = [f"{k * 7 % 1000:04d}" for k in range(1000)]
    table = written(spark.createDataFrame([(i,) for i in ids], "id string").repartitionByRange(5, "id").sortWithinPartitions("id"), "ids")
    got = {r.id: r.n for r in placed(table, "n").collect()}
    assert got == {i: k for k, i in enumerate(sorted(ids))}


def test_frames_are_cut_small():
    parts = list(tx.sliced(iter([pd.DataFrame({"a": range(600)}), pd.DataFrame({"a": []})])))
    assert [len(p) for p in parts] == [256, 256, 88]


def test_a_query_is_multiplied_where_it_is_not_zero(spark):
    """The same scores as over all places, and each different query is hashed once."""
    chunks = spark.createDataFrame([("d", i, f"uno dos tres {i} plazo de entrega") for i in range(6)] + [("e", 9, None)], "document_id string, chunk_id long, text string")
    queries = spark.createDataFrame([(d, k, q) for d in "de" for k, q in enumerate(["plazo de entrega", "tres 4", None, "uno uno tres"])], "document_id string, query_id long, query string")
    got = rt.vectors(chunks, queries)
    dense = chunks.select("document_id", "chunk_id", tx.hash_embedding(chunks["text"]).alias("v")).join(queries.select("document_id", "query_id", tx.hash_embedding(queries["query"]).alias("q")), "document_id").collect()
    want = {(r.query_id, r.chunk_id): round(sum(a * b for a, b in zip(r.v, r.q)), 6) for r in dense}
    assert {(r.query_id, r.chunk_id): r.score for r in got.collect()} == want and "zip_with" not in optimized(got)


def test_few_rows_travel_where_queries_are_many(spark):
    r = np.random.default_rng(2)
    unit = lambda n: [(f"x{i:03d}", (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(r.integers(-2, 3, (n, 8)) + 0.25)]
    vectors, queries = spark.createDataFrame(unit(40), "chunk_id string, v array<double>"), spark.createDataFrame([*unit(90), (None, None)], "query_id string, q array<double>")
    got = vector_index.exact(vectors, queries, 7, sent=50)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, tx.vector_top(vectors, queries.where("q is not null"), 7).collect())) and "Join" not in optimized(got)


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_what_grows_with_documents_is_dealt_and_not_sent_through_the_driver(spark):
    """Only the different queries' vectors may travel to all tasks; plans, scores, texts and quotes meet by key at any size."""
    chunks = spark.createDataFrame([("d", i, f"se pide copia legalizada {i} formato A3", "Otros") for i in range(4)], "document_id string, chunk_id long, text string, cluster string")
    plan = spark.createDataFrame([("d", 7, "formato A3", "OBSOLETE_PHYSICAL_FORMAT", [])], "document_id string, query_id long, query string, flag_code string, clusters array<string>")
    hits = rt.retrieve(chunks, plan)
    assert physical(hits).count("BroadcastExchange") <= 1 and hits.count() == 4
    judged = rt.critiqued(chunks, plan, 5, written(hits, "hits"))
    assert "BroadcastExchange" not in physical(judged) and judged.count() > 0
    assert "BroadcastExchange" not in physical(rt.diagnostics(plan, written(hits, "hits"), judged))
    assert "BroadcastExchange" not in physical(rt.plan(spark.createDataFrame([("d", "copias")], "document_id string, question string"), spark.createDataFrame([], "document_id string, place int, flag_code string, chunk_id string"), chunks.selectExpr("document_id", "cluster label")))


SF = "/root/testdata/sf0.001"


def test_contracts_are_not_dealt_by_their_few_nations(spark):
    """Order lines meet orders that know their customers, and nations travel whatever size Spark thinks they have."""
    from veedor.plans import star

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical(star.won(spark, SF))
        assert "hashpartitioning(nationkey" not in plan and "hashpartitioning(c_nationkey" not in plan and plan.count("hashpartitioning(l_orderkey") == 1 and "hashpartitioning(l_suppkey" not in plan.split("Exchange hashpartitioning(l_orderkey")[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_contracts_are_not_dealt_by_their_few_procedures(spark):
    from veedor.plans import signals

    for name in ("f09_direct_award_outlier", "f12_amount_outlier"):
        plan = physical(signals.QUERIES[name](spark, SF))
        assert "hashpartitioning(modalidad" not in plan and "hashpartitioning(region" not in plan


def test_a_contract_is_not_sent_once_more_for_each_distinct_count(spark):
    from veedor.plans import graph, signals

    assert "Expand" not in physical(signals.QUERIES["f10_monogamous_supplier"](spark, SF))
    assert "Expand" not in physical(graph.QUERIES["g6_company_summary"](spark, SF))


def test_few_scores_are_held_at_a_time():
    """Memory of the nearest centres and of who asks a cell: bounded by a block, and a bit for each query and cell."""
    import tracemalloc

    r = np.random.default_rng(3)
    x, centres = r.normal(size=(6000, 8)).astype(np.float32), r.normal(size=(1000, 8)).astype(np.float32)
    tracemalloc.start()
    bits = vector_index.asked_cells(x, centres, 400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6  # all scores and their order at once: 72 MB and more
    order = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :400]
    want = np.zeros((1000, 6000), bool)
    want[order.ravel(), np.repeat(np.arange(6000), 400)] = True
    assert (np.unpackbits(bits, axis=1, count=6000).astype(bool) != want).mean() < 1e-4 and (vector_index.nearest(x, centres, 1)[:, 0] == order[:, 0]).mean() > 0.999


def test_both_sides_of_a_record_come_from_one_pass(spark):
    assert "Union" not in optimized(records.QUERIES["t19_map_to_graph"](spark, SF))


def test_a_page_is_folded_and_looked_through_for_a_title_once(spark, monkeypatch):
    pages = spark.createDataFrame([("d", 1, "Red Flags of Procurement\n\nthe DISCRETIÓN of few; audit trail"), ("d", 2, None)], "document_id string, page_number int, text string")
    found = tx.paragraph_chunks(pages)
    assert [(r.section, r.flag_codes) for r in found.collect()] == [("Red Flags of Procurement", ["SUBJECTIVE_EVALUATION_CRITERIA", "LOW_TRACEABILITY_OUTPUT", "AI_NO_AUDIT_TRAIL"])]
    assert optimized(found).count("translate(") == 1
    seen = []
    monkeypatch.setattr(tx, "title_of", lambda text: seen.append(text) or "T")
    assert len(tx.page_paragraphs("d", 1, "\n\n".join(["word " * 100] * 9), 700, 200)) > 5 and len(seen) == 1


def test_flags_of_two_kinds_of_edges_are_worked_out_once(spark):
    from veedor.plans import rows

    assert "regexp" not in optimized(rows.QUERIES["n10_graph_ingest"](spark, SF)).lower()
