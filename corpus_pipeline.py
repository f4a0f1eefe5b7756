"""The corpus pipeline over documents: quality rules, exact and near dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last return
the columns of documents.  Tables may be empty and have further columns with any names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veedor.llm import bpe, common, exact_dedup, mixing, repetition, simhash

#: A source's weight is its number of rows to this power, so small sources gain and the largest gives way.
MIX_POWER = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules; null and empty texts, having no words, do not.  Repeated rows are judged each, very long texts whole."""
    return repetition.passing(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id (one row of it); null counts as empty, null ids stay only where a text has no other."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints, the document with the smallest id; rows without an id stay."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of the mix: every source has its target weight for as long as all last.

    Nulls in any column, repeated rows and long texts stay as they are; a null source is a source of its own; an empty table stays empty.
    """
    if not docs.limit(1).count():
        return docs
    return mixing.arranged(docs, mixing.tempered(docs, power=MIX_POWER))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256, place) for every row: the tokens, and the hash of what they decode to; null and empty texts have none.

    ``place`` is the row's number from 0 in the order of the table given, which the mix has made.
    """
    ranks = bpe.Ranks.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    numbered = placed(docs).select(F.struct("doc_id", "place").alias("doc_id"), "text")
    both = bpe.decode(bpe.encode(numbered, ranks), ranks)
    return both.select("doc_id.doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"), "doc_id.place")


def placed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, place): rows numbered from 0 as they lie in the files of a table, which a sorted table keeps its order in; what is no table of files is written first.

    Only the files' row counts are gathered, so no row moves.
    """
    try:
        rows = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return placed(common.written(docs.select("doc_id", "text"), "tokens-in"))
    files = rows.groupBy("_file").agg(F.count("*").alias("n"))
    before = files.select("_file", (F.sum("n").over(W.orderBy(F.length("_file"), "_file")) - F.col("n")).alias("_before"))  # one row a file
    return rows.join(F.broadcast(before), "_file").select("doc_id", "text", (F.col("_before") + F.col("_row")).alias("place"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mix", mix), ("tokens", tokens)]

#: SQL has no byte-pair merges and no XXH64; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
