"""Loose JSON, archives, batch selection, collated search and pack graphs over small fixtures."""

import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from veedor.operators import batches, collated
from veedor.operators import documents as d
from veedor.sources import archives, loose


def test_flags_in_every_form(spark, tmp_path):
    one = {"flag_code": "A", "severity": "high", "score": 7, "page_number": 2, "quote": "q"}
    for name, body in {"list": [one, {"flag_code": "B", "score": "x"}], "object": {"flags": [one], "other": 1}, "alone": one, "none": None, "empty": [], "nested": {"flags": []}, "text": {"flag_code": "C", "page_number": "4"}}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "flags.json").write_text(json.dumps(body, indent=2))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "flags.json").write_text("{no json")
    got = sorted(tuple(r) for r in loose.flags(spark, str(tmp_path)).collect())
    assert got == [("alone", 0, "A", "high", 7, 2, "q"), ("list", 0, "A", "high", 7, 2, "q"), ("list", 1, "B", None, None, None, None), ("object", 0, "A", "high", 7, 2, "q"), ("text", 0, "C", None, None, 4, None)]


def test_dossiers_at_the_top_or_in_a_summary(spark, tmp_path):
    for name, body in {"a": {"entity_name": "E", "total_score": "12", "risk_level": "ALTO"}, "b": {"summary": {"total_score": 3, "total_flags": 1}}}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "dossier.json").write_text(json.dumps(body))
    assert sorted(map(tuple, loose.dossiers(spark, str(tmp_path)).collect()), key=str) == [("a", "E", "ALTO", 12, None), ("b", None, None, 3, 1)]


def test_canonical_json_does_not_depend_on_order_or_spacing(spark):
    texts = ['{"b": [1, 2], "a": {"y": null, "x": "é"}}', '{"a":{"x":"é","y":null},"b":[1,2]}', '{"b": [2, 1], "a": {"y": null, "x": "é"}}', "{", None]
    got = [tuple(r) for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(loose.canonical(F.col("t")), loose.canonical_hash(F.col("t"))).collect()]
    assert got[0] == got[1] == ('{"a":{"x":"é","y":null},"b":[1,2]}', hashlib.sha256('{"a":{"x":"é","y":null},"b":[1,2]}'.encode()).hexdigest())
    assert got[2] != got[0] and got[3] == got[4] == (None, None)


def test_members_of_archives_are_read_by_tasks_of_their_own(spark, tmp_path):
    archives.register(spark)
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        z.writestr("a.txt", "1|uno|x\r\n\r\n2| dos |y\n".encode("latin-1"))
        z.writestr("b.txt", "3|España\n4\n".encode("latin-1"))
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("c.txt", "5|cinco|z")
    df = spark.read.format("archive_lines").options(columns="k,name,kind").schema("name string, k string").load(f"file:{tmp_path}")
    assert df.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, df.collect()), key=str) == [("", "4"), ("España", "3"), ("cinco", "5"), ("dos", "2"), ("uno", "1")]
    assert spark.read.format("archive_lines").options(columns="k,name").load(str(tmp_path / "no*.zip")).count() == 0
    with pytest.raises(Exception, match="mounted folder"):
        spark.read.format("archive_lines").options(columns="k").load("hdfs://x/y").count()


def test_archives_and_books_round_trip(spark, tmp_path):
    archives.register(spark)
    rows = spark.range(1000).select(F.col("id").cast("string").alias("k"), F.concat(F.lit("n<&"), F.col("id").cast("string")).alias("name"), F.lit(None).cast("string").alias("none")).repartition(3)
    rows.write.format("archive_lines").options(columns="k,name,none", rows=100).mode("append").save(str(tmp_path / "z"))
    back = spark.read.format("archive_lines").options(columns="k,name,none").load(str(tmp_path / "z"))
    assert sorted(map(tuple, back.collect())) == sorted((str(i), f"n<&{i}", "") for i in range(1000)) and back.rdd.getNumPartitions() >= 10
    rows.write.format("xlsx_rows").options(rows=100).mode("append").save(str(tmp_path / "x"))
    back = spark.read.format("xlsx_rows").schema("name string, k string, lacking string").load(str(tmp_path / "x"))
    assert sorted(map(tuple, back.collect())) == sorted((f"n<&{i}", str(i), None) for i in range(1000)) and back.rdd.getNumPartitions() >= 10
    rows.limit(1).write.format("xlsx_rows").mode("overwrite").save(str(tmp_path / "x"))
    assert spark.read.format("xlsx_rows").schema("k string").load(str(tmp_path / "x")).count() == 1


def test_shared_strings_and_cell_references(spark, tmp_path):
    archives.register(spark)
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>k</t></si><si><r><t>v</t></r><r><t>al</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="C2"><v>7</v></c></row><row><c r="A3"><v>1</v></c></row></sheetData></worksheet>')
    got = spark.read.format("xlsx_rows").schema("val string, k string").load(str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("", "1"), ("7", "")]


def batch_tables(spark):
    contracts = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("d",), (None,)], "c string")
    kind = "c string, doc_id int, url string, wanted boolean, rank int"
    docs = [("a", 1, "u1", True, 2), ("a", 2, "u2", True, 1), ("a", 3, "u3", None, 0), ("b", 4, None, True, 0), ("b", 5, "u5", True, 1), ("b", 6, "u6", True, 2), ("z", 9, "u9", True, 0)]
    fetched = [("c", 7, "u7", True, 0), ("a", 8, "u8", True, 0)]
    return contracts, spark.createDataFrame(docs, kind), spark.createDataFrame(fetched, kind), spark.createDataFrame([("u5",), ("u5",)], "url string")


def test_batch_selection_gives_a_reason_for_each(spark):
    contracts, docs, fetched, existing = batch_tables(spark)
    got = {(r.c, r.doc_id): (r.fetched, r.place, r.reason) for r in batches.selection(contracts, docs, "c", fetched, existing, 2).collect()}
    assert got == {
        ("a", 2): (False, 1, None), ("a", 1): (False, 2, None), ("a", 3): (False, None, "not_wanted"), ("b", 4): (False, 1, "no_url"), ("b", 5): (False, 2, "exists"), ("b", 6): (False, 3, "over_contract"),
        ("c", 7): (True, 1, None), ("d", None): (False, None, "no_documents"),
    }


def test_counters_are_seen_in_the_pass_that_writes(spark):
    contracts, docs, fetched, existing = batch_tables(spark)
    plan = batches.selection(contracts, docs, "c", fetched, existing, 2)
    rows, seen = batches.counted(plan, "batch", **batches.selection_counters("c"))
    again = rows.agg(*[c.alias(n) for n, c in batches.selection_counters("c").items()]).first().asDict()
    assert seen.get == again and again["selected"] == 3 and again["without_documents"] == 1
    assert batches.counters(seen, rows).first().asDict() == again
    lazy, later = batches.counted(plan, "lazy", write=False, n=F.count(F.lit(1)))
    assert lazy.count() == 8 and later.get == {"n": 8}


def test_preparation(spark):
    pages = spark.createDataFrame([("a", "x" * 101), ("a", None), ("b", "x" * 100), ("c", ""), ("c", None)], "document_id string, text string")
    assert {tuple(r) for r in batches.preparation(pages).collect()} == {("a", 2, 1, 101, "ready", None), ("b", 1, 0, 100, "skipped", "short_pages"), ("c", 2, 0, 0, "skipped", "no_text")}


def test_collated_search_and_names(spark):
    rows = spark.createDataFrame([(1, "CONTRATACIÓN pública"), (2, "contratacion"), (3, "Őszi Ĉapelo"), (4, None), (5, "otra")], "i int, t string")
    assert sorted(r.i for r in collated.search(rows, "t", "Contratación").collect()) == [1, 2]
    assert sorted(r.i for r in collated.search(rows, "t", "oszi", "CAPELO").collect()) == [3]  # letters that no table of ours has
    assert collated.search(rows, "t").count() == 5
    terms = rows.select("i", collated.terms_in(F.col("t"), ["PUBLICA", "otrá", "x"]).alias("x")).where("size(x) > 0")
    assert sorted((r.i, r.x) for r in terms.collect()) == [(1, ["PUBLICA"]), (5, ["otrá"])]
    names = spark.createDataFrame([("José",), ("JOSE",), ("jose",), ("Ana",), (None,), (None,)], "n string")
    assert sorted(map(tuple, collated.grouped(names, "n").collect()), key=str) == [("Ana", 1, 1), ("JOSE", 3, 3), (None, 0, 2)]


def test_pack_graph_of_one_pack(spark):
    packs = spark.createDataFrame([("p", "preventive"), ("q", None)], "pack_id string, mode string")
    documents = spark.createDataFrame([("p", "d1", "a.pdf", "tdr", 3, 0), ("p", "d2", "b.pdf", "award", 2, 2)] * 2, "pack_id string, document_id string, file_name string, kind string, pages int, pages_needing_ocr int").dropDuplicates()
    chunks = spark.createDataFrame([("d1", "d1::00000", "OBJETO", 1, 2), ("d1", "d1::00001", None, 2, 3), ("d9", "d9::0", "x", 1, 1)], "document_id string, chunk_id string, section_hint string, page_start int, page_end int")
    clusters = spark.createDataFrame([("k1", "Plazos", "d1::00000"), ("k1", "Plazos", "d1::00001"), ("k2", "Otros", "d9::0")], "cluster_id string, label string, chunk_id string")
    missing = spark.createDataFrame([("p", "contract")], "pack_id string, key string")
    nodes, edges = d.pack_nodes_edges(packs, documents, chunks, clusters, missing)
    got = {r.node_id: (r.node_type, r.label, r.properties) for r in nodes.collect()}
    assert got == {
        "p::process_pack::root": ("process_pack", "p", {"mode": "preventive", "total_documents": "2", "total_pages": "5"}), "q::process_pack::root": ("process_pack", "q", {"total_documents": "0", "total_pages": "0"}),
        "p::document::d1": ("document", "a.pdf", {"document_type": "tdr", "pages_total": "3", "pages_needing_ocr": "0"}), "p::document::d2": ("document", "b.pdf", {"document_type": "award", "pages_total": "2", "pages_needing_ocr": "2"}),
        "p::chunk::d1::00000": ("chunk", "OBJETO", {"page_start": "1", "page_end": "2"}), "p::chunk::d1::00001": ("chunk", "1::00001", {"page_start": "2", "page_end": "3"}),
        "p::semantic_cluster::k1": ("semantic_cluster", "Plazos", {"chunk_count": "2"}), "p::missing_key::contract": ("missing_key", "missing: contract", {"key": "contract"}),
    }
    assert sorted((r.relationship, r.source_id.split("::", 1)[1], r.target_id.split("::", 1)[-1]) for r in edges.collect()) == [
        ("CLUSTER_CONTAINS_CHUNK", "semantic_cluster::k1", "chunk::d1::00000"), ("CLUSTER_CONTAINS_CHUNK", "semantic_cluster::k1", "chunk::d1::00001"), ("DOCUMENT_HAS_CHUNK", "document::d1", "chunk::d1::00000"), ("DOCUMENT_HAS_CHUNK", "document::d1", "chunk::d1::00001"),
        ("DOCUMENT_HAS_CLUSTER", "document::d1", "semantic_cluster::k1"), ("DOCUMENT_NEEDS_OCR", "document::d2", "ocr"), ("PACK_CONTAINS_DOCUMENT", "process_pack::root", "document::d1"), ("PACK_CONTAINS_DOCUMENT", "process_pack::root", "document::d2"), ("PACK_MISSING_KEY", "process_pack::root", "missing_key::contract"),
    ]
