"""Near-dedup by SimHash: pigeonhole blocks, joins on blocks, verified Hamming distances, components.

Two 64-bit fingerprints that differ in at most ``distance`` bits agree in all but ``distance`` of any blocks that
the 64 bits are cut into.  Each distinct fingerprint is dealt out under every choice of blocks to agree in; fingerprints
that meet are compared bit by bit, and only the links of a spanning forest of each meeting leave the task.
A meeting of over LIMIT fingerprints is dealt again, by a finer cut of the bits in which they may differ, after
which a meeting has at most 2**13 distinct fingerprints whatever the input; so no task holds an unbounded group,
no link is lost, and nothing grows with the square of a group of copies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, TH, discard, keyed, raw_text, slices, text_key, written

#: Most fingerprints that one task compares with each other; also the most that a second dealing can bring together.
LIMIT = 8_192
GAP = re.compile(rb"[\x20\x09-\x0D]")


def fingerprint(text: bytes, size: int = 3, seed: int = 42, piece: int = 1 << 20) -> int:
    """SimHash of a text whose A-Z are lower-cased: the majority of the bits of its shingles' XXH64; 0 without a word.

    A long text is worked on in pieces of about ``piece`` bytes, each with the last words of the one before.
    """
    total, n, carry, at = np.zeros(64, np.int64), 0, [], 0
    digest = xxhash.xxh64_intdigest

    def add(words: list[bytes], runs: int) -> None:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = zip(starts[:runs].tolist(), ends[len(words) - runs :].tolist())
        h = np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, runs)
        for low in range(0, runs, 65_536):
            bits = np.unpackbits(h[low : low + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total[:] += bits.sum(axis=0, dtype=np.int64)

    while at < len(text):
        end = GAP.search(text, min(at + piece, len(text)))
        end = end.end() if end else len(text)
        words = carry + text[at:end].split()
        at = end
        runs = len(words) - size + 1
        if runs > 0:
            add(words, runs)
            n += runs
            carry = words[runs:]
        else:
            carry = words
    if not n:
        if not carry:
            return 0
        add(carry, 1)
        n = 1
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, th, fp) for every row; fp holds the 64 bits as a signed long.  Null is as an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, offsets = raw_text(batch.column(2))
            low = FOLD[raw].tobytes()
            fps = np.array([fingerprint(low[a:b], size, seed) for a, b in zip(offsets[:-1], offsets[1:])], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "th", "fp"])

    return keyed(docs, id_col, text_col).mapInArrow(run, f"doc_id long, th {TH}, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(blocks: int, distance: int, bits: list[int] = range(64)) -> list[int]:
    """For each choice of blocks to differ in, the mask of the bits in which fingerprints must agree; bits are cut evenly."""
    cuts = [list(c) for c in np.array_split(np.array(bits), blocks)]
    free = [sum(1 << int(b) for b in c) for c in cuts]
    return [(2**64 - 1) & ~sum(free[i] for i in chosen) for chosen in combinations(range(blocks), distance)]


def _finer(mask: int, distance: int) -> list[int]:
    """Masks that each leave at most 13 of the bits that mask leaves free."""
    bits = [b for b in range(64) if not mask >> b & 1]
    blocks = distance + 1
    found = masks(blocks, distance, bits)
    while any(64 - m.bit_count() > 13 for m in found):
        blocks += 1
        found = masks(blocks, distance, bits)
    return found


def forest(fps: np.ndarray, distance: int) -> np.ndarray:
    """Links of a spanning forest of the graph in which fingerprints within ``distance`` bits are joined; two columns."""
    parent = np.arange(len(fps))
    links = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fps) - 1):
        near = np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= distance) + i + 1
        for j in near[parent[near] != root(i)] if len(near) else ():
            a, b = root(i), root(int(j))
            if a != b:
                parent[b] = a
                links.append((i, j))
    at = np.array(links, np.int64).reshape(-1, 2)
    return fps.view(np.int64)[at]


def _met(distance: int, limit: int, last_dealing: bool = False):
    """Over rows sorted by (mask, key): links of each meeting as (0, fp, fp), rows of too large ones as (1, fp, mask); in the last dealing these are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = np.zeros((0, 3), np.int64), None  # the meeting that may go on in the next batch; the last too large one

        def out(parts: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            kinds = np.repeat(np.array([k for k, _ in parts], np.int64), [len(x) for _, x in parts])
            rows = np.concatenate([np.zeros((0, 2), np.int64), *(x for _, x in parts)])
            return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(rows[:, 0].copy()), pa.array(rows[:, 1].copy())], ["kind", "a", "b"])

        for batch in batches:
            x = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("mask", "key", "fp")], 1)
            x = np.concatenate([held, x])
            if not len(x):
                continue
            cut = np.flatnonzero((x[1:, 0] != x[:-1, 0]) | (x[1:, 1] != x[:-1, 1])) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(x)]])
            parts, held, last = [], held[:0], len(starts) - 1
            worth = ends - starts > 1
            worth[[0, last]] = True
            for i in np.flatnonzero(worth):
                part = x[starts[i] : ends[i]]
                meeting = (int(part[0, 0]), int(part[0, 1]))
                if len(part) > limit or large == meeting:
                    if last_dealing:
                        raise RuntimeError(f"over {limit} fingerprints meet after the last dealing")
                    large = meeting
                    parts.append((1, part[:, [2, 0]]))
                elif i == last:
                    held = part.copy()
                else:
                    parts.append((0, forest(part[:, 2].copy().view(np.uint64), distance)))
            yield out(parts)
        yield out([(0, forest(held[:, 2].copy().view(np.uint64), distance))])

    return run


def links(fps: DataFrame, distance: int = 3, blocks: int = 6, limit: int = LIMIT) -> DataFrame:
    """(a, b): links between distinct fingerprints; together they connect all that a chain of ``distance`` bits connects."""
    choices = [signed(m) for m in masks(blocks, distance)]

    def meet(rows: DataFrame, most: int, last: bool) -> DataFrame:
        dealt = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))).repartition(F.col("mask"), F.col("key"))
        return dealt.sortWithinPartitions("mask", "key", "fp").mapInArrow(_met(distance, most, last), "kind long, a long, b long")

    first = written(meet(fps.select("fp", F.explode(F.array(*map(F.lit, choices))).alias("mask")), limit, False), "meetings")
    return first.where("kind = 0").unionByName(meet(_again(first, distance, blocks), 1 << 13, True)).select("a", "b").distinct()


def _again(first: DataFrame, distance: int, blocks: int) -> DataFrame:
    """(fp, mask): the rows of too large meetings by finer masks, each once though the finer masks of two choices can be the same."""
    finer = F.create_map(*[x for m in masks(blocks, distance) for x in (F.lit(signed(m)), F.array(*[F.lit(signed(f)) for f in _finer(m, distance)]))])
    return first.where("kind = 1").select(F.col("a").alias("fp"), F.explode(finer[F.col("b")]).alias("mask")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): for every node of an edge, the smallest node that it is connected with.

    Large stars and small stars by turns (Kiveris et al. 2014), each round written to the shared folder; the
    number of rounds grows with the logarithm of the longest path.
    """
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large = large.unionByName(least.where("u != m").select("u", F.col("m").alias("v"))).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        before, now = now, written(small.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(before)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, distance: int = 3, blocks: int = 6) -> DataFrame:
    """(doc_id, th, fp, component_id) for every row.

    Fingerprints link at ``distance`` or fewer differing bits; component_id is the smallest id reachable over
    links.  Null and empty texts have fingerprint zero and link like any other.  Rows with null ids take part and
    link others; the component_id of a component of none but such rows is null.
    """
    rows = written(fingerprints(docs, id_col, text_col, size), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = written(components(links(nodes.select("fp"), distance, blocks)), "components")
    of = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(of.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp")  # AQE splits the rows of a fingerprint that very many have


def report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row: nulls, repeats and long texts as ``near_duplicates`` takes them."""
    rows = near_duplicates(docs, **options)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component, that of its smallest id, and the rows without an id; all columns as they were.

    Null and empty texts have fingerprint zero, so of all of them one row stays.  Rows that repeat the smallest id with another
    text of the component stay too, as no id is smaller; very long texts count whole; an empty table stays empty.
    """
    rows = near_duplicates(docs, id_col, text_col, **options)
    gone = written(rows.where("doc_id != component_id").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct(), "dropped")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.struct(*[docs[n] for n in docs.columns]).alias("_row"), F.col(id_col).cast("long").alias("_own"), text_key(text).alias("_text"))
    return own.join(gone, (F.col("_own") == F.col("_id")) & (F.col("_text") == F.col("_th")), "left_anti").select("_row.*")
