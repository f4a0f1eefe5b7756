"""Extraction operators and runs over small fixtures."""

from veedor.operators import extract as x
from veedor.operators import runs


def test_entities_persons_and_documents(spark):
    rows = spark.createDataFrame([("20500000001", "B"), ("20500000001", "A"), ("123", "C"), (None, "D")], "entidad_ruc string, entidad string")
    assert [tuple(r) for r in x.public_entities(rows).collect()] == [("20500000001", "A")]
    people = spark.createDataFrame([("1", "b"), ("1", "a"), (" ", "c"), (None, "d"), ("x-9", None)], "person_id string, name string")
    assert sorted(map(tuple, x.persons(people, "person_id", "name").collect())) == [("1", "a"), ("x-9", None)] and x.persons(people).count() == 2
    dossiers = spark.createDataFrame([("o1", 2), ("o2", 0), (None, 3), ("o3", None)], "ocid string, total_flags int")
    assert [r.ocid for r in x.flagged_documents(dossiers).collect()] == ["o1"]


def test_pages(spark):
    pages = spark.createDataFrame([("a", 1, "ñandú"), ("a", 2, None), ("a", 3, ""), ("b", 1, None)], "document_id string, page_number int, text string")
    assert [tuple(r) for r in x.page_rows(pages).collect()] == [("a", 1, 5)]
    assert sorted(map(tuple, x.coverage(pages).collect())) == [("a", 3, 1, 5, 1.67, 33.33), ("b", 1, 0, 0, 0.0, 0.0)]


def test_links(spark):
    html = """<a HREF='/x/a.PDF?v=1'>1</a><a href="b.csv">2</a><a href = "https://o.example/c.html">3</a><a href="#top">4</a><a href="javascript:f()">5</a><a href="//p.example/d.zip">6</a><a href="b.csv">again</a><a href=" ">7</a>"""
    rows = spark.createDataFrame([(1, "http://h.example/d/page.html?q=1", html), (2, "http://h.example", '<a href="z">z</a>'), (3, None, None)], "page_id int, url string, html string")
    assert sorted(map(tuple, x.links(rows).collect())) == [
        (1, "//p.example/d.zip", "http://p.example/d.zip", "zip"), (1, "/x/a.PDF?v=1", "http://h.example/x/a.PDF?v=1", "pdf"), (1, "b.csv", "http://h.example/d/b.csv", "csv"), (1, "https://o.example/c.html", "https://o.example/c.html", None),
        (2, "z", "http://h.example/z", None),
    ]


def test_samples_of_flags(spark):
    rows = spark.createDataFrame([("F", i, "t" * 300) for i in range(9)] + [(None, 50, None)], "flag_code string, chunk_id int, text string")
    got = {r.flag_code: (r.n, [(s.chunk_id, s.quote) for s in r.samples]) for r in x.flag_samples(rows.where("flag_code is not null")).collect()}
    assert got == {"F": (9, [(i, "t" * 200) for i in range(3)])}


def test_a_run_leaves_its_artifacts(spark, tmp_path):
    registry = spark.createDataFrame([("a", "1"), ("b", "1"), ("z", "9")], "key string, hash string")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), (None, "4")], "key string, hash string")
    done = runs.run(now, registry, str(tmp_path / "r"), "source", "r1")
    assert sorted(map(tuple, done.changed(spark).collect())) == [("b", "2", "1", "modified"), ("c", "3", None, "new")]
    assert sorted(map(tuple, done.hashes(spark).select("key", "hash").collect())) == [("a", "1"), ("b", "2"), ("c", "3"), ("z", "9")]
    told = {"source_code": "source", "run_id": "r1", "mode": "incremental", "status": "partial", "records_seen": 4, "records_new": 1, "records_changed": 1, "records_unchanged": 1, "records_failed": 1}
    assert done.manifest(spark).first().asDict() == told
    audit = done.audit(spark).first()
    assert audit.source_run.asDict() == told and (audit.changed_records_count, audit.failed_records_count) == (2, 1) and audit.hashes_path.endswith("/hashes")
    again = runs.run(now, done.hashes(spark), str(tmp_path / "s"), "source", "r2")
    assert again.changed(spark).count() == 0
    whole = runs.run(now, registry, str(tmp_path / "t"), "source", "r3", full=True)
    assert whole.manifest(spark).first().records_new == 3
