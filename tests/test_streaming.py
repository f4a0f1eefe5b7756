import json

from veedor.streaming import changes


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_registry_over_batches(spark, tmp_path):
    src = tmp_path / "in"
    put(src, "a.json", [{"key": "1", "hash": "x"}, {"key": "2", "hash": "y"}, {"hash": "z"}])

    def run():
        q = changes.with_registry(changes.read(spark, str(src), "key string, hash string"), str(tmp_path / "reg"), str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination(120)

    run()
    put(src, "b.json", [{"key": "1", "hash": "x2"}, {"key": "2", "hash": "y"}, {"key": "3", "hash": "w"}])
    run()
    out = {(r.batch, r.key, r.change) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out == {(0, "1", "new"), (0, "2", "new"), (0, None, "failed"), (1, "1", "modified"), (1, "3", "new")}
    reg = {(r.key, r.hash) for r in spark.read.parquet(str(tmp_path / "reg" / "v1")).collect()}
    assert reg == {("1", "x2"), ("2", "y"), ("3", "w")}


def test_state(spark, tmp_path):
    src = tmp_path / "in"
    put(src, "a.json", [{"key": "1", "hash": "x", "ts": 1}, {"key": "1", "hash": "y", "ts": 2}, {"key": "2", "hash": "x", "ts": 1}, {"key": "2", "hash": "x", "ts": 3}])
    stream = changes.with_state(changes.read(spark, str(src), "key string, hash string, ts long"))
    q = stream.writeStream.format("memory").queryName("found").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.key, r.hash, r.change) for r in spark.table("found").collect()} == {("1", "x", "new"), ("1", "y", "modified"), ("2", "x", "new")}


def test_windows(spark, tmp_path):
    src = tmp_path / "in"
    put(src, "a.json", [{"ts": "2024-01-01T10:00:00", "event_type": "a", "value": 1.0}, {"ts": "2024-01-01T12:00:00", "event_type": "a", "value": 2.0}, {"ts": "2024-01-02T12:00:00", "event_type": "b", "value": 5.0}])
    stream = changes.windowed(changes.read(spark, str(src), "ts timestamp, event_type string, value double"))
    q = stream.writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(str(r.start), r.event_type, r.n, r.value) for r in spark.table("win").collect()} == {("2024-01-01 00:00:00", "a", 2, 3.0), ("2024-01-02 00:00:00", "b", 1, 5.0)}
