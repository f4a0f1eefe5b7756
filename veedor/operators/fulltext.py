"""Spanish full-text search: stems without stop words, a written inverted index with positions, and searches for all, any or a phrase.

Words are runs of letters and digits, lower-case.  A position counts all words, stop words too, so a phrase keeps its distances.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spanish
from ..sources.shared import written

#: Positions of a document that one posting holds, at most; query lexemes that are pushed into the scan, at most; words whose stems a task remembers, about; texts at once.
BLOCK, PUSHED, REMEMBERED, ROWS = 4096, 1000, 200_000, 512
WORD = r"(?U)[\p{L}\p{N}]+"


def stemmed(words: list[str], stop: frozenset[str], known: dict) -> list[str | None]:
    """The stem of each word, null for a stop word; ``known`` remembers those of a task."""
    if len(known) > REMEMBERED:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = None if w in stop else spanish.stem(w)
    return [known[w] for w in words]


def placed_words(lists: pa.Array, stop: frozenset[str], known: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, at, code, lexemes) of the words of lists that are no stop words: code is a place in lexemes.  Each different word is looked at once."""
    coded = lists.flatten().dictionary_encode()
    stems = pa.array(stemmed(coded.dictionary.to_pylist(), stop, known), pa.string()).dictionary_encode()
    code = pc.fill_null(stems.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    said = code >= 0
    return row[said], at[said], code[said], stems.dictionary


def worded(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(id_col, F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(WORD), F.lit(0)).alias("words"))


def lexemes(documents: DataFrame, id_col: str = "document_id", text_col: str = "text", stop: frozenset[str] = spanish.STOP) -> DataFrame:
    """(id, at, lexeme): each word's stem and place from 0; stop words, null and empty texts give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                row, at, code, found = placed_words(part.column(1), stop, known)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(at, pa.int32()), found.take(pa.array(code))], [id_col, "at", "lexeme"])

    return worded(documents, id_col, text_col).mapInArrow(run, f"{id_col} {documents.schema[id_col].dataType.simpleString()}, at int, lexeme string")


def postings(documents: DataFrame, stop: frozenset[str] = spanish.STOP) -> DataFrame:
    """(lexeme, document_id, block, positions) of documents (document_id, text): all positions of a document come from its row, so none are shuffled to meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                row, at, code, found = placed_words(part.column(1), stop, known)
                order = np.lexsort((at, code, row))
                row, at, code = row[order], at[order], code[order]
                block = at // BLOCK
                new = (row[1:] != row[:-1]) | (code[1:] != code[:-1]) | (block[1:] != block[:-1])
                begin = np.flatnonzero(np.concatenate([[True], new])) if len(row) else np.zeros(0, np.int64)
                positions = pa.ListArray.from_arrays(pa.array(np.append(begin, len(row)), pa.int32()), pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([found.take(pa.array(code[begin])), part.column(0).take(pa.array(row[begin])), pa.array(block[begin], pa.int32()), positions], ["lexeme", "document_id", "block", "positions"])

    return worded(documents, "document_id", "text").mapInArrow(run, f"lexeme string, document_id {documents.schema['document_id'].dataType.simpleString()}, block int, positions array<int>")


def build(documents: DataFrame, path: str, stop: frozenset[str] = spanish.STOP) -> DataFrame:
    """Write postings (lexeme, document_id, block, positions) of documents (document_id, text), sorted by lexeme; return them.

    A row has at most BLOCK positions, and ranges of lexemes split at documents too, so the commonest lexeme is spread over files.
    """
    rows = written(postings(documents, stop), "postings")  # the ranges are sampled first: texts are read once
    rows.repartitionByRange("lexeme", "document_id").sortWithinPartitions("lexeme", "document_id", "block").write.parquet(path)
    return load(documents.sparkSession, path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def search(postings: DataFrame, queries: DataFrame, stop: frozenset[str] = spanish.STOP) -> DataFrame:
    """(query_id, document_id, hits) for queries (query_id, mode, text), each query_id once.

    mode ``all``: documents with every lexeme of the text, ``any``: with one at least, ``phrase``: with all in the text's order and distances.
    hits: occurrences of the lexemes, or of the phrase.  A query of stop words alone, or without words, finds nothing; so does an unknown mode.
    Queries of any number go at once; the lexemes of few are pushed into the scan of the postings.
    """
    asked = lexemes(queries, "query_id", stop=stop).join(queries.select("query_id", "mode"), "query_id")
    wanted = asked.select("lexeme").distinct()
    some = [r.lexeme for r in wanted.limit(PUSHED + 1).collect()]
    scan = postings.where(F.col("lexeme").isin(some)) if len(some) <= PUSHED else postings.join(wanted, "lexeme", "left_semi")
    single = asked.where("mode <> 'phrase'").groupBy("query_id", "mode", "lexeme").agg(F.count("*").alias("_"))
    sizes = single.groupBy("query_id").agg(F.count("*").alias("n"))
    met = single.join(scan.groupBy("lexeme", "document_id").agg(F.sum(F.size("positions")).alias("hits")), "lexeme").groupBy("query_id", "mode", "document_id").agg(F.count("*").alias("found"), F.sum("hits").alias("hits"))
    whole = met.join(sizes, "query_id").where("mode = 'any' or (mode = 'all' and found = n)").select("query_id", "document_id", "hits")
    parts = asked.where("mode = 'phrase'").select("query_id", "at", "lexeme")
    lengths = parts.groupBy("query_id").agg(F.count("*").alias("n"))
    begun = parts.join(scan, "lexeme").select("query_id", "document_id", "at", F.explode("positions").alias("place")).withColumn("start", F.col("place") - F.col("at"))
    phrases = begun.groupBy("query_id", "document_id", "start").agg(F.count("*").alias("found")).join(lengths, "query_id").where("found = n")
    return whole.unionByName(phrases.groupBy("query_id", "document_id").agg(F.count("*").alias("hits")))
