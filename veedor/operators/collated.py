"""Search and equality of names whatever their case and accents, by Unicode collation instead of a table of letters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Case and accents do not count.
COLLATION = "UNICODE_CI_AI"


def same(text: Column) -> Column:
    """The text under the collation: what compares, groups and joins as equal differs in case and accents alone."""
    return F.collate(text, COLLATION)


def holds(text: Column, term: str) -> Column:
    """Whether a text has a term somewhere, case and accents aside; null texts have none, and every text has the empty term."""
    return F.coalesce(F.contains(same(text), same(F.lit(term))), F.lit(False))


def search(rows: DataFrame, column: str, *terms: str) -> DataFrame:
    """Rows whose text has every term, case and accents aside."""
    return rows.where(reduce(lambda a, b: a & b, [holds(F.col(column), t) for t in terms], F.lit(True)))


def terms_in(text: Column, terms: list[str]) -> Column:
    """Those of the terms that a text has, in their order."""
    return F.array_compact(F.array(*[F.when(holds(text, t), F.lit(t)) for t in terms]))


def grouped(rows: DataFrame, name: str) -> DataFrame:
    """(name, spellings, n): rows by name, case and accents aside, under the name's least spelling; nulls are one group."""
    plain = F.collate(F.min(F.collate(name, "UTF8_BINARY")), "UTF8_BINARY")
    return rows.groupBy(same(F.col(name)).alias("_key")).agg(plain.alias(name), F.countDistinct(F.collate(name, "UTF8_BINARY")).alias("spellings"), F.count("*").alias("n")).drop("_key")
