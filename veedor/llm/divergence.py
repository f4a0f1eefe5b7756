"""Source divergence audit: how far the term distributions of a language's sources lie apart, and each source's typical terms.

Terms are runs of ASCII letters and code points from U+0080 on, A-Z lower-cased.  A group is a (lang, source) pair; null text,
lang and source are ''.  Every language keeps the terms of at least ``least_docs`` of its documents.  A group (and a language)
gives a kept term that occurs ``count`` times in it p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)), all in whole
numbers.  The distance of two groups is the sum of |p - q| over all kept terms.

Distances are two-dimensional group-block tiling.  A group's counts are packed into one vector for each vocabulary chunk.
Groups of a language are numbered and cut into blocks; each vector travels to every (block, block) tile of its block.  A tile
goes through its chunks one after another and adds to its submatrix of pairs, so it holds one chunk of two blocks, whatever
the vocabulary or the number of groups.  Terms that no group of a tile has differ by the same amount each and are added as a product.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, slices, strings, summed, words, written

SCALE, SMOOTH = 1_000_000_000, 5
#: Groups in a block, and kept terms in a vocabulary chunk (about; terms are dealt to chunks by hash).
BLOCK, CHUNK = 16, 16_384
NOT_A_TERM = np.zeros(256, bool)
NOT_A_TERM[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
COUNTS = "lang string, source string, term string, n long, d long"


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, d): occurrences of each term in each group, and the group's documents that hold it.

    Every group that occurs has one more row, with the empty term, so a group of null, empty or termless texts is there too.  Each
    row of ``docs`` is a document, repeated rows and equal ids included; other columns are not read.  An empty table gives no rows.
    A text is cut into pieces of some MB for counting, so a very long one needs a few bytes for each of its own.
    """

    def part(lang: pa.Array, source: pa.Array, term: pa.Array, n: np.ndarray, d: np.ndarray) -> pa.Table:
        return pa.table({"lang": lang, "source": source, "term": term, "n": pa.array(n), "d": pa.array(d)})

    def of(batch: pa.RecordBatch) -> Iterator[pa.Table]:
        names = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["lang", "source"])
        lang, source = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
        pair = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        _, first, group = np.unique(pair, return_index=True, return_inverse=True)
        names = names.take(pa.array(first))
        lang, source = names.field("lang"), names.field("source")
        none = np.zeros(len(first), np.int64)
        yield part(lang, source, pa.array([""] * len(first)), none, none)
        w = words(batch.column(2), fold=True, white=NOT_A_TERM, hashed=False)
        doc = np.repeat(np.arange(batch.num_rows), w.counts)
        last, held = -1, pa.array([], pa.string())  # a text that a piece has cut, and its terms so far
        for a, b, found in strings(w):
            terms = found.dictionary
            k = len(terms)
            key, n = np.unique(doc[a:b] * k + found.indices.to_numpy(), return_counts=True)
            at, code = key // k, key % k
            d = np.ones(len(key), np.int64)
            if at[0] == last:
                d[at == last] = ~pc.is_in(terms.take(pa.array(code[at == last])), held).to_numpy(zero_copy_only=False)
            new = terms.take(pa.array(code[(at == at[-1]) & (d == 1)]))
            last, held = at[-1], pa.concat_arrays([held, new]) if at[-1] == last else new
            order = np.argsort(group[at] * k + code, kind="stable")
            both = (group[at] * k + code)[order]
            cut = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
            which = pa.array(both[cut] // k)
            yield part(lang.take(which), source.take(which), terms.take(pa.array(both[cut] % k)), np.add.reduceat(n[order], cut), np.add.reduceat(d[order], cut))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from summed((t for batch in slices(batches, most=1 << 20) for t in of(batch)), ["lang", "source", "term"])

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    return rows.mapInArrow(run, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def vocabulary(counts: DataFrame, least_docs: int = 30) -> DataFrame:
    """(lang, term, n_lang, chunk, at) of the kept terms: n_lang occurrences in the language, place ``at`` in vocabulary chunk ``chunk``."""
    terms = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("d").alias("d")).where(F.col("d") >= least_docs)
    sizes = terms.groupBy("lang").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = terms.join(sizes, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), "chunks").cast("int")).repartition("lang", "chunk")  # not by lang alone
    return dealt.select("lang", "term", "n_lang", "chunk", (F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1).alias("at"))


def share(count: str, total: str, kept: str):
    """p of a count in a total over ``kept`` terms, as SQL; in decimals, so that no product overflows."""
    return F.expr(f"1 + cast({count} + {SMOOTH} as decimal(20,0)) * cast({SCALE} as decimal(10,0)) div cast({total} + {SMOOTH} * {kept} as decimal(20,0))")


def shares(count: np.ndarray, total: int, kept: int) -> np.ndarray:
    """The same over an array: a long division, three decimals at a time, so that nothing passes 64 bits below 9e15 occurrences."""
    down = total + SMOOTH * kept
    if down > (2**63 - 1) // 1000:
        raise OverflowError(f"{down} occurrences in one group")
    left, out = count.astype(np.int64) + SMOOTH, np.zeros(len(count), np.int64)
    out, left = left // down, left % down
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // down, left % down
    return out + 1


def groups(counts: DataFrame, cells: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, g, total, kept, n_all): every group's number within its language and its occurrences of kept terms; the language's kept terms and their occurrences."""
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n_lang").alias("n_all"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    mine = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kept", "n_all"])
    return mine.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)


def distances(cells: DataFrame, every: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, source, item, value): the distance of each ordered pair of a language's sources.

    cells: (lang, source, chunk, at, n); every: as ``groups`` returns.
    """
    spread = every.groupBy("lang").agg(F.floor(F.max("g") / block).alias("last"))
    numbered = every.join(spread, "lang").withColumn("block", F.floor(F.col("g") / block).cast("int"))
    vectors = cells.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("at", "n")).alias("v"))  # at most one chunk's terms
    heads = numbered.select("lang", "source", "block", "g", "last", "total", "kept", F.lit(-1).alias("chunk"), F.lit(None).cast("array<int>").alias("at"), F.lit(None).cast("array<bigint>").alias("n"))
    held = vectors.join(numbered, ["lang", "source"]).select("lang", "source", "block", "g", "last", "total", "kept", "chunk", F.col("v.at").alias("at"), F.col("v.n").alias("n"))
    tiles = held.union(heads).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), "last"))).select(
        "lang", F.least("block", "other").cast("int").alias("i"), F.greatest("block", "other").cast("int").alias("j"), "chunk", "block", F.pmod("g", F.lit(block)).cast("int").alias("slot"), "source", "total", "kept", "at", "n"
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            plain = [batch.column(i).to_pylist() for i in range(9)]
            at, n = batch.column(9), batch.column(10)
            for r, row in enumerate(zip(*plain)):
                yield *row, at[r], n[r]

    def settle(lang: str, i: int, j: int, mine: Iterator[tuple]) -> pa.RecordBatch:
        names: dict[tuple[int, int], tuple[str, int, int]] = {}
        sums = np.zeros((block, block), np.int64)
        base = np.zeros((2, block), np.int64)
        covered = kept = 0
        for chunk, part in groupby(mine, lambda row: row[3]):
            if chunk < 0:
                for _, _, _, _, b, slot, source, total, kept, _, _ in part:
                    names[b, slot] = source, total, kept
                    if kept:
                        base[int(b != i), slot] = shares(np.zeros(1, np.int64), total, kept)[0]
                continue
            held = [(b, slot, at.values.to_numpy(), n.values.to_numpy(), total, kept) for _, _, _, _, b, slot, _, total, kept, at, n in part]
            places = np.unique(np.concatenate([h[2] for h in held]))
            covered += len(places)
            p = np.repeat(base[:, :, None], len(places), axis=2)
            for b, slot, at, n, total, kept in held:
                p[int(b != i), slot, np.searchsorted(places, at)] = shares(n, total, kept)
            for low in range(0, len(places), 4096):
                rest = p[int(i != j), :, low : low + 4096]
                for s in range(block):
                    sums[s] += np.abs(rest - p[0, s, low : low + 4096]).sum(axis=1)
        sums += (kept - covered) * np.abs(base[0][:, None] - base[int(i != j)][None, :])
        out: list[tuple[str, str, str, int]] = []
        for (b, s), (source, _, _) in names.items():
            for (c, t), (item, _, _) in names.items():
                if (b, c) == (i, j) and (b, s) != (c, t):
                    out += [(lang, source, item, int(sums[s, t]))] + [(lang, item, source, int(sums[s, t]))] * (i != j)
        return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out) if out else [[]] * 4, [pa.string()] * 3 + [pa.int64()])], ["lang", "source", "item", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lang, i, j), mine in groupby(rows(batches), lambda row: row[:3]):
            yield settle(lang, i, j, mine)

    dealt = tiles.repartition("lang", "i", "j").sortWithinPartitions("lang", "i", "j", "chunk")
    return dealt.mapInArrow(run, "lang string, source string, item string, value long")


def typical(cells: DataFrame, every: DataFrame, top: int = 50) -> DataFrame:
    """(lang, source, item, value, rank): each group's first ``top`` terms by how far its p exceeds the language's; equal values by term."""
    more = cells.join(every, ["lang", "source"]).withColumn("value", share("n", "total", "kept") - share("n_lang", "n_all", "kept")).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    return more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", "source", F.col("term").alias("item"), "value", "rank")


def report(docs: DataFrame, least_docs: int = 30, top: int = 50, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): the distances to all other sources of the language, and the typical terms.

    part ``pair``: item is another source, value the distance, every rank.  part ``term``: item is a kept term that occurs in the
    group with p above the language's, value the difference, ranks to ``top``.  Ranks go by value descending, then item in byte
    order, so ties are settled.  Null text, lang and source count as ''; a group without kept terms has the smoothed share of every
    term, and a language that keeps none has distances of 0.  An empty table gives no rows.  Columns other than text, lang and
    source are not read, so extra ones cannot clash.
    """
    counts = written(counted(docs), "group-counts")
    terms = written(vocabulary(counts, least_docs), "kept-terms")
    cells = written(counts.join(terms, ["lang", "term"]).select("lang", "source", "chunk", "at", "term", "n", "n_lang"), "group-cells")
    every = written(groups(counts, cells, terms), "groups")
    discard(counts, terms)
    pairs = distances(cells, every, block).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    both = pairs.withColumn("part", F.lit("pair")).unionByName(typical(cells, every, top).withColumn("part", F.lit("term")))
    return both.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
