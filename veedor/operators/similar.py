"""Flags with similar quotes: of each document and code the surest stay, found by a set-similarity join and not by gathering.

Two quotes are alike if they share ``least`` of their different words.  Going by confidence, a flag stays if no flag that stays is alike
and before it.  Alike sets share a word among the first |x| - ceil(least |x|) + 1 of each, rarest words first (prefix filtering),
so only flags that meet at such a word are compared.  Where very many meet at one word, rounds of leaders come first: what comes first at
all its words stays and takes those alike away, one comparison a row, so copies by the thousand never make pairs.  What is
left over is settled over its alike pairs, a group's in one task up to a stated number, beyond it in rounds.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as c
from ..sources.shared import dealt, written

GROUP = ["document_id", "flag_code"]
#: Comparisons for each row, at most, of a join without leaders before it; alike pairs of a group that one task settles, at most.
PER_ROW, AT_ONCE = 100, 200_000


def signature(quote: Column) -> Column:
    """Different words of a quote's first 180 characters, lower-case, without accents and signs."""
    plain = F.regexp_replace(F.lower(c.fold(F.coalesce(quote, F.lit("")))), r"(?U)[^\w\s]", " ")
    plain = F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))
    return F.array_distinct(F.filter(F.split(F.substring(plain, 1, 180), " "), lambda x: x != ""))


def prefixes(sets: DataFrame, least: float) -> DataFrame:
    """(group columns, o, words, token): each set with each word of its prefix."""
    counts = sets.select(*GROUP, F.explode("words").alias("token")).groupBy(*GROUP, "token").agg(F.count("*").alias("n"))
    worded = sets.select(*GROUP, "o", F.explode("words").alias("token")).join(dealt(counts), [*GROUP, "token"])
    sorted_ = worded.groupBy(*GROUP, "o").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"]).alias("words"))  # words of one quote
    keep = F.size("words") - F.ceil(F.round(least * F.size("words"), 9)).cast("int") + 1
    return sorted_.select(*GROUP, "o", "words", F.explode(F.slice("words", F.lit(1), keep)).alias("token"))


def alike(a: Column, b: Column, least: float) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.round(least * (F.size(a) + F.size(b) - both), 9) <= both


def pairs(met: DataFrame, least: float) -> DataFrame:
    """(group columns, a, b): a before b, each alike pair once."""
    x = met.select(*GROUP, "token", F.col("o").alias("a"), F.col("words").alias("wa"))
    y = met.select(*GROUP, "token", F.col("o").alias("b"), F.col("words").alias("wb"))
    near = x.join(dealt(y), [*GROUP, "token"]).where(F.col("a") < F.col("b")).where((F.size("wb") >= F.round(least * F.size("wa"), 9)) & (F.size("wa") >= F.round(least * F.size("wb"), 9)))
    return near.where(alike(F.col("wa"), F.col("wb"), least)).select(*GROUP, "a", "b").distinct()


def leaders(met: DataFrame) -> DataFrame:
    """(group columns, o) of the sets that come first at every word of their prefix."""
    first = met.groupBy(*GROUP, "token").agg(F.min("o").alias("first"))
    return met.join(dealt(first), [*GROUP, "token"]).groupBy(*GROUP, "o").agg(F.min((F.col("o") == F.col("first")).cast("int")).alias("all")).where("all = 1").select(*GROUP, "o")


def taken(met: DataFrame, kept: DataFrame, least: float) -> DataFrame:
    """(group columns, o) of the sets that are alike to a leader at one of their words: at each word there is one leader at most."""
    lead = met.join(dealt(kept), [*GROUP, "o"], "left_semi").select(*GROUP, "token", F.col("o").alias("first"), F.col("words").alias("wl"))
    return met.join(dealt(lead), [*GROUP, "token"]).where((F.col("o") > F.col("first")) & alike(F.col("words"), F.col("wl"), least)).select(*GROUP, "o").distinct()


def greedy(edges: pd.DataFrame) -> pd.DataFrame:
    """The sets of a group that go, from its alike pairs in order: what stays takes away what is after it."""
    gone: set = set()
    key = lambda r: (r["c"], r["flag_id"], r["h"])
    pairs = sorted(((key(a), key(b), b) for a, b in zip(edges["a"], edges["b"])), key=lambda x: x[:2])
    out = []
    for a, b, row in pairs:
        if a not in gone and b not in gone:
            gone.add(b)
            out.append(row)
    return pd.DataFrame({**{g: [edges[g].iloc[0]] * len(out) for g in GROUP}, "o": out})


def settled(sets: DataFrame, least: float, per_row: int = PER_ROW, at_once: int = AT_ONCE) -> DataFrame:
    """(group columns, o) of the sets (group columns, o, words) that stay; o orders a group and is different for each."""
    met, stay = written(prefixes(sets, least), "prefixes"), None
    before = None
    while True:
        size = met.groupBy(*GROUP, "token").agg(F.count("*").alias("m")).agg(F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("pairs"), F.sum("m").alias("rows")).first()
        if not size.rows or size.pairs <= per_row * size.rows or (before is not None and size.rows > 0.9 * before):
            break
        before = size.rows
        kept = written(leaders(met), "leaders")
        gone = kept.unionByName(taken(met, kept, least))
        stay = kept if stay is None else stay.unionByName(kept)
        met = written(met.join(dealt(gone), [*GROUP, "o"], "left_anti"), "prefixes")
    left = met.select(*GROUP, "o").distinct()
    if size.pairs:  # some sets share a word of their prefixes
        edges = written(pairs(met, least), "alike")
        most = edges.groupBy(*GROUP).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most:
            gone = edges.groupBy(*GROUP).applyInPandas(greedy, sets.select(*GROUP, "o").schema) if most <= at_once else rounds(edges)
            left = left.join(dealt(gone), [*GROUP, "o"], "left_anti")
    return left if stay is None else left.unionByName(stay)


def rounds(open_: DataFrame) -> DataFrame:
    """(group columns, o) of the sets that go, from alike pairs of any number: each round what nothing open comes before stays, and what is alike to it goes."""
    gone = None
    while open_.limit(1).count():
        firsts = open_.select(*GROUP, F.col("a").alias("o")).join(dealt(open_.select(*GROUP, F.col("b").alias("o"))), [*GROUP, "o"], "left_anti").distinct()
        lost = written(open_.join(dealt(firsts.withColumnRenamed("o", "a")), [*GROUP, "a"], "left_semi").select(*GROUP, F.col("b").alias("o")).distinct(), "taken")
        gone = lost if gone is None else gone.unionByName(lost)
        open_ = open_.join(dealt(lost.withColumnRenamed("o", "b")), [*GROUP, "b"], "left_anti").join(dealt(lost.withColumnRenamed("o", "a")), [*GROUP, "a"], "left_anti")
        open_ = written(open_, "open")
    return gone


def similar_quotes(flags: DataFrame, least: float = 0.7, per_row: int = PER_ROW, at_once: int = AT_ONCE) -> DataFrame:
    """flags (document_id, flag_code, flag_id, confidence, quote) that stay: by confidence, then flag_id, one goes if a kept quote of its code shares ``least`` of their words.

    A quote without a word is like no other.  Of equal signatures only the first takes part.  Rows with one flag_id and confidence go by the hash of their
    columns; rows equal in all columns count once.  Null confidences come last.
    """
    names = flags.columns
    o = F.struct((-F.coalesce(F.col("confidence").cast("double"), F.lit(-1e300))).alias("c"), "flag_id", F.xxhash64(*names).alias("h"))
    group = lambda x: F.coalesce(F.col(x).cast("string"), F.lit("\u0000"))  # noqa: E731  null keys are a group too
    marked = written(flags.withColumns({"_words": signature(F.col("quote")), "_o": o}), "quotes")
    worded = marked.where(F.size("_words") > 0).dropDuplicates(names)
    sets = worded.select(*[group(x).alias(x) for x in GROUP], F.col("_o").alias("o"), F.col("_words").alias("words"))
    first = W.partitionBy(*GROUP, F.array_sort("words")).orderBy("o")
    sets = sets.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    stay = settled(sets, least, per_row, at_once).select(*[F.col(x).alias(f"_{x}") for x in GROUP], F.col("o").alias("_stay"))
    kept = worded.join(dealt(stay), [*[group(x) == F.col(f"_{x}") for x in GROUP], F.col("_o") == F.col("_stay")], "left_semi")
    return kept.select(*names).unionByName(marked.where(F.size("_words") == 0).select(*names))
