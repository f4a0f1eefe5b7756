"""Mixing sources to target weights by Pfair scheduling.

A source's rows are dealt into blocks.  With a weight of q slots in each period of Q, its k-th block is released at
slot floor(k Q / q) and due by slot ceil((k + 1) Q / q).  Earliest deadline first serves one released block a slot;
at weights that add up to one this keeps every source within one block of its target share after every slot.
As releases and deadlines repeat each period, so does the schedule: Q slots are worked out on the driver, whatever
the input, and every block's slot follows from its number by a join with that table.

Ranks within a source are counted by ranges of a hash, so a source with a third of all rows is no single task.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Most rows that a range of hashes has on average within all sources together.
RANGE_ROWS = 20_000
#: Most sources of a mix; the schedule has at least four slots for each.
MOST_SOURCES = 100_000


def quotas(weights: dict, period: int) -> dict:
    """Whole slots for each source that add up to period: rounded down, the largest remainders first to get one more."""
    total = sum(weights.values())
    if not weights or total <= 0 or min(weights.values()) < 0:
        raise ValueError("weights must be positive numbers")
    exact = {s: w / total * period for s, w in weights.items()}
    out = {s: int(x) for s, x in exact.items()}
    order = sorted(weights, key=lambda s: (-(exact[s] - out[s]), s is not None, s or ""))
    for s in order[: period - sum(out.values())]:
        out[s] += 1
    return out


def schedule(quota: dict, period: int) -> list[tuple[object, int, int]]:
    """(source, number of its block, slot) for a whole period, by earliest deadline first; ties by name."""
    names = sorted((s for s, q in quota.items() if q), key=lambda s: (s is not None, s or ""))
    window = lambda i, k: (k * period // quota[names[i]], -(-(k + 1) * period // quota[names[i]]))
    waiting = [(window(i, 0)[0], i, 0) for i in range(len(names))]
    ready: list[tuple[int, int, int]] = []
    heapq.heapify(waiting)
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (window(i, k)[1], i, k))
        _, i, k = heapq.heappop(ready)
        out.append((names[i], k, slot))
        if k + 1 < quota[names[i]]:
            heapq.heappush(waiting, (window(i, k + 1)[0], i, k + 1))
    return out


def tempered(docs: DataFrame, source_col: str = "source", power: float = 0.7) -> dict:
    """Target weights from the sources' sizes to a power below one, which raises small sources; a null source is one of its own."""
    return {s: float(n) ** power for s, n in sizes(docs, source_col).items()}


def sizes(docs: DataFrame, source_col: str) -> dict:
    """Rows of each source.  The schedule is worked out on the driver, so more than MOST_SOURCES are refused, not cut."""
    rows = docs.groupBy(source_col).count().limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources: group them first")
    return {r[0]: r[1] for r in rows}


def key(id_col: str) -> Column:
    return F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def ranked(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", *more: Column) -> DataFrame:
    """(doc_id, source, key, rank) and columns ``more``: ranks within each source from 0 in the order of a hash of the id."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), key(id_col).alias("key"), *more)
    names = rows.columns[3:]
    ranges = 16 ** max(1, len(f"{docs.count() // RANGE_ROWS:x}"))
    # One column says source and range, null apart from all names, so the rows (which may be wide) are dealt once for both ranks and the join.
    place = F.concat(F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")), F.substring("key", 1, len(f"{ranges - 1:x}")))
    rows = rows.withColumns({"place": place, "range": F.substring("key", 1, len(f"{ranges - 1:x}"))})
    sizes = rows.groupBy("source", "range", "place").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(W.partitionBy("source").orderBy("range")) - F.col("n")).select("place", "before")
    inner = rows.withColumn("inner", F.row_number().over(W.partitionBy("place").orderBy("key", "doc_id")) - 1)
    return inner.join(before, "place").select("doc_id", "source", "key", (F.col("before") + F.col("inner")).alias("rank"), *names)


def mixed(docs: DataFrame, weights: dict, id_col: str = "doc_id", source_col: str = "source", block: int = 64, period: int = 1_000) -> DataFrame:
    """(doc_id, source, rank, block, slot, in_mix) for every row.

    ``slot`` orders the mix; in_mix holds for the slots before the first one whose source has run out, in which
    every source is within one block of its weight.  Every source with a weight has a slot, as the period grows with the
    sources.  Rows of a source of weight 0 or not named have a null slot and are not in the mix.  A null source is a
    source; repeated rows each have a rank, ties go by id; texts are not looked at; an empty table gives no row.
    """
    quota, period = served(weights, period)
    placed = _placed(docs, quota, ranked(docs, id_col, source_col), source_col, block, period)
    end = mix_end(docs, quota, source_col, block, period)
    return placed.select("doc_id", "source", "rank", "block", "slot", F.coalesce(F.col("slot") < end, F.lit(False)).alias("in_mix"))


def _placed(docs: DataFrame, quota: dict, rows: DataFrame, source_col: str, block: int, period: int) -> DataFrame:
    """Ranked rows of docs with their block and slot."""
    table, names = _table(docs.sparkSession, docs, source_col, quota, period)
    rows = rows.withColumn("block", F.floor(F.col("rank") / block).cast("long"))
    placed = rows.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("_s")), "left").join(F.broadcast(table), (F.col("_i") == F.col("_t")) & (F.col("block") % F.col("_q") == F.col("_k")), "left")
    return placed.withColumn("slot", (F.floor(F.col("block") / F.col("_q")) * period + F.col("_slot")).cast("long"))


def _table(spark: SparkSession, docs: DataFrame, source_col: str, quota: dict, period: int) -> tuple[DataFrame, DataFrame]:
    """The schedule and the sources with a slot as tables; neither has more than period rows."""
    number = {s: i for i, s in enumerate(quota)}
    kind = docs.schema[source_col].dataType.simpleString()
    table = spark.createDataFrame([(number[s], k, slot) for s, k, slot in schedule(quota, period)], "_t int, _k long, _slot long")
    names = spark.createDataFrame([(s, number[s], q) for s, q in quota.items() if q], f"_s {kind}, _i int, _q long")
    return table, names


def mix_end(docs: DataFrame, quota: dict, source_col: str, block: int, period: int) -> int:
    """The first slot whose block no row is in."""
    have = sizes(docs, source_col)
    slot_of = {(s, k): slot for s, k, slot in schedule(quota, period)}
    blocks = {s: -(-have.get(s, 0) // block) for s, q in quota.items() if q}
    return min(n // quota[s] * period + slot_of[s, n % quota[s]] for s, n in blocks.items())


def selected(docs: DataFrame, weights: dict, id_col: str = "doc_id", source_col: str = "source", block: int = 64, period: int = 1_000) -> DataFrame:
    """The rows of docs that are in the mix (see ``mixed``), all columns as they were; the others are those of ``mixed`` that are not in_mix.

    Each source's share of the mix is a prefix of its ranks, so its last row's key says which rows are in; one key a source travels, no text.
    """
    names = docs.columns
    inside = written(mixed(docs, weights, id_col, source_col, block, period).where("in_mix").groupBy("source").agg(F.max(F.struct(key("doc_id").alias("key"), F.col("doc_id").alias("doc_id"))).alias("last")), "shares")
    last = inside.select(F.col("source").alias("_s"), "last")  # at most period rows, as each has a slot in the period
    own = F.struct(key(id_col).alias("key"), F.col(id_col).alias("doc_id"))
    joined = docs.select(F.struct(*[docs[n] for n in names]).alias("_row"), F.col(source_col).alias("_source"), own.alias("_own"))
    return joined.join(F.broadcast(last), F.col("_source").eqNullSafe(F.col("_s"))).where(F.col("_own") <= F.col("last")).select("_row.*")


def served(weights: dict, period: int = 1_000) -> tuple[dict, int]:
    """(quotas, period) with a slot for every source: the period grows with the sources, and the largest give what the smallest lack."""
    period = max(period, 4 * len(weights))
    quota = quotas(weights, period)
    large = [(-q, i, s) for i, (s, q) in enumerate(quota.items()) if q > 1]
    heapq.heapify(large)
    for s in [s for s, q in quota.items() if not q and weights[s]]:
        q, i, most = heapq.heappop(large)
        quota[s], quota[most] = 1, -q - 1
        if quota[most] > 1:
            heapq.heappush(large, (q + 1, i, most))
    return quota, period


def arranged(docs: DataFrame, weights: dict, id_col: str = "doc_id", source_col: str = "source", block: int = 64, period: int = 1_000) -> DataFrame:
    """All rows of docs, all columns as they were, ordered by slot: none is left out.

    Until the first source has run out every source is within one block of its share (see ``served``); later slots hold the sources
    that are left, in the same order.  Rows of a source that ``weights`` does not name come last.
    """
    quota, period = served(weights, period)
    rows = ranked(docs, id_col, source_col, F.struct(*[docs[n] for n in docs.columns]).alias("_row"))
    placed = _placed(docs, quota, rows, source_col, block, period)
    return placed.orderBy(F.col("slot").asc_nulls_last(), "source", "rank").select("_row.*")
