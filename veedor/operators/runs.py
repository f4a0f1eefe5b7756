"""A run of change detection with what it leaves behind: changed records, the new hashes, a manifest and an audit, counted in the pass that writes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import changes as ch
from .batches import counted

#: Kinds of change, by the counter's name.
COUNTERS = {"records_new": "new", "records_changed": "modified", "records_unchanged": "unchanged", "records_failed": "failed"}


@dataclass
class Run:
    """Folders of a run: JSON lines of changed records, the registry of hashes, one line each of manifest and audit."""

    path: str

    def changed(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("key string, hash string, hash_before string, change string").json(f"{self.path}/changed_records")

    def hashes(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/hashes")

    def manifest(self, spark: SparkSession) -> DataFrame:
        return spark.read.json(f"{self.path}/run_manifest")

    def audit(self, spark: SparkSession) -> DataFrame:
        return spark.read.json(f"{self.path}/audit")


def run(now: DataFrame, registry: DataFrame, path: str, source_code: str, run_id: str, full: bool = False) -> Run:
    """Detect changes of ``now`` (key, hash) against ``registry`` and write the run's artifacts below path.

    Rows are detected once: the pass that writes them sees the counters.  New and changed records go to changed_records; the registry gets
    their hashes and keeps the others; a record without key counts as failed, is written nowhere else, and makes the run ``partial``.
    With ``full`` every record is new.  A repeated key is judged twice and keeps its largest hash.
    """
    spark = now.sparkSession
    judged = ch.detect(now.select("key", "hash"), registry, full=full)
    is_ = lambda kind: F.count_if(F.col("change") == kind)
    rows, seen = counted(judged, "judged", records_seen=F.count(F.lit(1)), **{n: is_(kind) for n, kind in COUNTERS.items()})
    done = rows.where("change in ('new', 'modified')")
    done.select("key", "hash", "hash_before", "change").write.json(f"{path}/changed_records")
    ch.commit(registry, done).write.parquet(f"{path}/hashes")
    counts = seen.get
    status = "partial" if counts["records_failed"] else "completed"
    told = {"source_code": source_code, "run_id": run_id, "mode": "full" if full else "incremental", "status": status, **counts}
    one = spark.range(1).select(*[F.lit(v).alias(k) for k, v in told.items()])
    one.write.json(f"{path}/run_manifest")
    places = {"changed_records_path": f"{path}/changed_records", "hashes_path": f"{path}/hashes"}
    audit = one.select(F.struct(*told).alias("source_run"), F.lit(counts["records_new"] + counts["records_changed"]).alias("changed_records_count"), F.lit(counts["records_failed"]).alias("failed_records_count"), *[F.lit(v).alias(k) for k, v in places.items()])
    audit.write.json(f"{path}/audit")
    return Run(path)
