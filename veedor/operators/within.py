"""Hybrid search within documents, one document after another as its rows come, so a text is dealt once and no word is a row.

A document's queries come first, then its chunks.  Of a chunk only what scores need is kept: its counts of the words asked for, its place
among each query's nearest, and its excerpt while one of these holds it; of a document, in how many chunks each of its words is.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import vector_of

#: Words end at the white space of Spark's ``\s``; vectors' words at Python's, which is more.
SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
FURTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
COLUMNS = ["document_id", "query_id", "flag_code", "chunk_id", "score", "rank", "cluster", "excerpt"]


def counted(text: str | None) -> Counter:
    lower = (text or "").lower()
    words = Counter(SPACE.split(lower) if FURTHER_SPACE.search(lower) else lower.split())
    words.pop("", None)
    return words


def embedded(text: str | None, words: Counter) -> list[float]:
    """The text's hashed vector in single precision."""
    if text and FURTHER_SPACE.search(text):
        words = Counter(text.lower().split())
    return np.array(vector_of(words), np.float32).tolist()


@lru_cache(4_096)
def question(text: str | None) -> tuple[Counter, list[tuple[int, float]]]:
    """A query's words, and the places of its vector that are not zero."""
    words = counted(text)
    return words, [(i, x) for i, x in enumerate(embedded(text, words)) if x]


def rounded(x: float, digits: int) -> float:
    """As Spark rounds: halves of the printed number up."""
    y = abs(x) * 10**digits
    if abs(y - math.floor(y) - 0.5) < 1e-4:
        return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return round(x, digits)


def order(entry: tuple) -> tuple:
    """Best score first, then by chunk, null first."""
    score, chunk = entry[0], entry[1][0]
    return -score, chunk is not None, chunk


class Document:
    """The search of a document: ``ask`` for each query, ``read`` for each chunk, then its ``hits``."""

    def __init__(self, excerpt: int, top: int, per_ranker: int, k: int, k1: float, b: float, epsilon: float):
        self.excerpt, self.top, self.per_ranker, self.k, self.k1, self.b, self.epsilon = excerpt, top, per_ranker, k, k1, b, epsilon
        self.queries, self.texts, self.wanted = [], {}, set()  # queries; different texts with their words, places that are not zero, and nearest chunks
        self.n = self.texts_read = self.length = 0
        self.df, self.postings = Counter(), defaultdict(list)

    def ask(self, query_id, flag_code, query: str | None, clusters: list | None) -> None:
        self.queries.append((query_id, flag_code, query, clusters))
        if query not in self.texts:
            words, places = question(query)
            self.texts[query] = words, places, []
            self.wanted |= words.keys()

    def read(self, chunk_id, text: str | None, cluster: str | None) -> None:
        words = counted(text)
        length = words.total()
        shown = text if text is None or len(text) <= self.excerpt else text[: self.excerpt] + "..."
        chunk = (chunk_id, cluster, shown, self.n)
        self.n += 1
        self.texts_read += text is not None
        self.length += length
        self.df.update(words.keys())
        for w in self.wanted & words.keys():
            self.postings[w].append((words[w], length, chunk))
        v = embedded(text, words)
        for _, places, nearest in self.texts.values():
            dot = 0.0
            for i, x in places:
                dot += v[i] * x
            nearest.append((rounded(dot, 6), chunk))
            if len(nearest) > 4 * self.per_ranker:
                nearest[:] = nsmallest(self.per_ranker, nearest, key=order)

    def lexical(self) -> list[dict]:
        """For each different text: chunks with their Okapi score; a word's negative idf becomes epsilon times the average one."""
        idf = lambda f: math.log(self.n - f + 0.5) - math.log(f + 0.5)
        mean = sum(idf(f) * c for f, c in Counter(self.df.values()).items()) / len(self.df) if self.df else 0.0
        parts = {}
        for w, rows in self.postings.items():
            x = idf(self.df[w])
            x = self.epsilon * mean if x < 0 else x
            parts[w] = [(x * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / (self.length / self.texts_read))), chunk) for tf, length, chunk in rows]
        out = {}
        for text, (words, _, _) in self.texts.items():
            sums: dict = {}
            for w, times in words.items():
                for part, chunk in parts.get(w, ()):
                    sums[chunk[3]] = (sums[chunk[3]][0] if chunk[3] in sums else 0.0) + times * part, chunk
            found = ((rounded(s, 6), chunk) for s, chunk in sums.values())
            out[text] = nsmallest(self.per_ranker, (x for x in found if x[0] > 0), key=order)
        return out

    def hits(self) -> Iterator[tuple]:
        """(query_id, flag_code, chunk_id, score, rank, cluster, excerpt): ranks fused by their reciprocals, in the query's clusters if it names some."""
        fused = {}
        for text, by_words in self.lexical().items():
            sums: dict = {}
            for best in (nsmallest(self.per_ranker, self.texts[text][2], key=order), by_words):
                for rank, (_, chunk) in enumerate(best, 1):
                    sums[chunk[3]] = (sums[chunk[3]][0] if chunk[3] in sums else 0.0) + 1.0 / (self.k + rank), chunk
            fused[text] = sorted(((rounded(s, 8), chunk) for s, chunk in sums.values() if chunk[0] is not None), key=order)
        for query_id, flag_code, query, clusters in self.queries:
            if clusters is not None:
                allowed = (x for x in fused[query] if not clusters or (x[1][1] is not None and x[1][1] in clusters))
                for rank, (score, chunk) in zip(range(1, self.top + 1), allowed):
                    yield query_id, flag_code, chunk[0], score, rank, chunk[1], chunk[2]


def search(chunks: DataFrame, queries: DataFrame, excerpt: int, top: int = 5, per_ranker: int = 20, k: int = 60, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(document_id, query_id, flag_code, chunk_id, score, rank, cluster, excerpt), see ``retrieval.retrieve``; rows without a document or a query id are in none."""
    asked = queries.where("document_id is not null and query_id is not null").select("document_id", F.lit(0).alias("kind"), "query_id", "flag_code", "query", "clusters")
    read = chunks.where("document_id is not null").select("document_id", F.lit(1).alias("kind"), "chunk_id", "text", "cluster")
    rows = asked.unionByName(read, allowMissingColumns=True).repartition("document_id").sortWithinPartitions("document_id", "kind")
    kinds = {f.name: f.dataType for f in rows.schema} | {"score": T.DoubleType(), "rank": T.IntegerType(), "excerpt": T.StringType()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, doc, out, schema = None, None, [], None

        def sent() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
            return batch

        for whole in batches:
            own = {f.name: f.type for f in whole.schema} | {"score": pa.float64(), "rank": pa.int32(), "excerpt": whole.schema.field("text").type}
            schema = pa.schema([(c, own[c]) for c in COLUMNS])
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                for at, kind, query_id, flag_code, query, clusters, chunk_id, text, cluster in zip(*[batch.column(c).to_pylist() for c in ("document_id", "kind", "query_id", "flag_code", "query", "clusters", "chunk_id", "text", "cluster")]):
                    if at != now:
                        if doc:
                            out.extend((now, *hit) for hit in doc.hits())
                        now, doc = at, None
                    if kind == 0:
                        doc = doc or Document(excerpt, top, per_ranker, k, k1, b, epsilon)
                        doc.ask(query_id, flag_code, query, clusters)
                    elif doc:  # nobody asks of other documents
                        doc.read(chunk_id, text, cluster)
                    if len(out) >= 2_000:
                        yield sent()
        if doc:
            out.extend((now, *hit) for hit in doc.hits())
        if out:
            yield sent()

    return rows.mapInArrow(run, T.StructType([T.StructField(c, kinds[c]) for c in COLUMNS]))
