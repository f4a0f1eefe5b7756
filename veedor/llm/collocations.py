"""Phrase collocation mining: phrases of two to four words that occur far more often than their parts let expect.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends and those into words at spaces and tabs.  All
counts are per language and cover every text.

1. Words are counted exactly.  A two-row count-min sketch of all phrases gives upper bounds: a cell whose sum stays below
   ``least`` rules out every phrase in it, and a phrase is ruled out with any of its parts.
2. What is left are candidates: all frequent phrases and some others.  They are dealt to shards by their first two words, at most
   about PER_SHARD of them to each, and so are the words of texts in which a shard's candidates may stand: a text's run of
   words goes to a shard once, however many of the shard's candidates overlap in it.
3. Each shard's candidates compile into an Aho-Corasick automaton over guarded strings (a space before, between and after
   words, ``\\n`` between runs), which a text scan matches only at word borders and within pieces.  A shard's texts are dealt to
   several tasks, each of which builds the automaton and counts all overlapping matches; the sums are exact.
4. Thresholds and scores are joins and windows over the sums, in decimals where products could pass 64 bits.

The sketch is at most 2 ** (MOST_BITS + 1) bits (128 MiB) where tasks hold it.  Over some tens of GB of text its cells fill and
bounds loosen: more phrases are scanned, in more shards, and the result stays the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import exchange
from .common import Words, discard, grams, mix, pieces_of, slices, strings, summed, words, written

LONGEST = 4
SCALE = 2_000_000
MOST_BITS = 29
#: Candidates of an automaton, about; and words that one task scans, about.
PER_SHARD, PER_PART = 128_000, 4_000_000
#: Places of the sketch, at most: a place adds up what comes to it as it comes, and holds its own cells alone; more would make blobs of a few values.
MOST_PLACES = 4096
#: Bytes that part pieces, and bytes that part words.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BREAKS = np.zeros(256, bool)
BREAKS[list(PIECE_ENDS)] = True
GAPS = BREAKS.copy()
GAPS[[32, 9]] = True
SALT = np.array([0x8CB92BA72F3D8DD7, 0x2545F4914F6CDD1D], np.uint64)
ROWS = "lang string, shard int, part int, kind int, blob binary"
CANDIDATE, TEXT = 0, 1


class Phrases:
    """The words of a batch of (lang, text), and where phrases begin."""

    def __init__(self, batch: pa.RecordBatch):
        self.words = w = words(batch.column(1), fold=True, white=GAPS)
        n = len(w.starts)
        self.new = np.zeros(n, bool)  # a piece begins here
        if n:
            self.new[w.first[:-1][w.counts > 0]] = True
            last = np.flatnonzero(BREAKS[w.raw])
            at = np.searchsorted(last, w.starts)
            self.new[1:] |= at[1:] != at[:-1]
        begin = np.append(np.flatnonzero(self.new), n)
        self.left = np.repeat(begin[1:], np.diff(begin)) - np.arange(n)  # words to the piece's end
        lang = batch.column(0).dictionary_encode()
        self.langs = lang.dictionary.to_pylist()
        self.lang = np.repeat(lang.indices.to_numpy(), w.counts)
        self._seeds = np.array([xxhash.xxh64_intdigest(x.encode()) | 1 for x in self.langs], np.uint64)

    def hashes(self, k: int, at: np.ndarray) -> np.ndarray:
        """Of the phrases of k words that begin at the places ``at``, with their language."""
        return mix(grams(self.words.hashes, k, k)[at] + self._seeds[self.lang[at]])


def cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(h ^ SALT[row]) >> np.uint64(64 - bits)


def spelled(w: Words, at: np.ndarray, new: np.ndarray) -> Iterator[bytes]:
    """The words at the places ``at`` as guarded strings, `` a b \\n c d ``; where ``new`` says so, another run begins.  Yielded in parts that follow one another; a place's part holds it whole."""
    lengths = w.ends[at] - w.starts[at]
    for a, b in pieces_of(np.cumsum(lengths), 1 << 21):
        lead = np.where(new[a:b], 3, 1)  # ' \n ' or ' '
        lead[0] = 1
        sizes = lengths[a:b]
        inside = np.cumsum(sizes) - sizes
        to = np.cumsum(lead + sizes) - sizes
        out = np.full(int(to[-1] + sizes[-1]), 32, np.uint8)
        out[to[1:][new[a + 1 : b]] - 2] = 10
        each = np.arange(int(sizes.sum()))
        out[each + np.repeat(to - inside, sizes)] = w.raw[each + np.repeat(w.starts[at[a:b]] - inside, sizes)]
        yield (b" \n" if a and new[a] else b"") + out.tobytes()
    yield b" "


class Sketch:
    """Which cells of the two rows hold ``least`` or more phrases."""

    def __init__(self, heavy: np.ndarray, bits: int):
        self.heavy, self.bits = heavy, bits

    def holds(self, h: np.ndarray) -> np.ndarray:
        """Whether each hash may be that of a frequent phrase."""
        ok = np.ones(len(h), bool)
        for row in range(2):
            at = np.flatnonzero(ok)
            c = cells(h[at], row, self.bits).astype(np.int64) + (row << self.bits)
            ok[at] = (self.heavy[c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1
        return ok

    def shares(self) -> list[int]:
        """Heavy cells of each row."""
        half = len(self.heavy) // 2
        ones = np.array([bin(x).count("1") for x in range(256)], np.int64)
        return [int((np.bincount(part, minlength=256) * ones).sum()) for part in (self.heavy[:half], self.heavy[half:])]


def prepared(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, phrase, n) of all single words of rows (lang, text)."""

    def of(batch: pa.RecordBatch) -> Iterator[pa.Table]:
        p = Phrases(batch)
        names = pa.array(p.langs, pa.string())
        for a, b, found in strings(p.words):
            k = len(found.dictionary)
            key, n = np.unique(p.lang[a:b].astype(np.int64) * k + found.indices.to_numpy(), return_counts=True)
            yield pa.table({"lang": names.take(pa.array(key // k)), "phrase": found.dictionary.take(pa.array(key % k)), "n": pa.array(n)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from summed((t for batch in slices(batches, most=1 << 20) for t in of(batch)), ["lang", "phrase"])

    return rows.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def sketched(rows: DataFrame, n_words: int, least: int, most_bits: int = MOST_BITS) -> Sketch:
    """The sketch of all phrases of rows (lang, text): cell sums are made where cells live, and only one bit of each comes to the driver."""
    bits = min(max(16, (3 * n_words // 16).bit_length()), most_bits)
    places = min(exchange.places_for(rows.sparkSession, 6 * n_words), MOST_PLACES, 1 << (bits - 9))
    shift, width = np.uint64(63 - bits), (2 << bits) // places

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[exchange.Part]:
        held, size = [], 0

        def flushed() -> exchange.Part:
            cell, n = np.unique(np.concatenate(held), return_counts=True)
            return 0, [cell.astype(np.uint64) << shift, n.astype(np.uint32)]

        for batch in slices(batches, most=1 << 20):
            p = Phrases(batch)
            for k in range(2, LONGEST + 1):
                at = np.flatnonzero(p.left >= k)
                for low in range(0, len(at), 1 << 20):
                    h = p.hashes(k, at[low : low + (1 << 20)])
                    for row in range(2):
                        held.append((cells(h, row, bits) + np.uint64(row << bits)).astype(np.uint32))
                        size += len(h)
                    if size > 3_000_000:
                        yield flushed()
                        held, size = [], 0
        if held:
            yield flushed()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from exchange.dealt(parts(batches), places, thin=lambda c: [((c[0] >> shift) & np.uint64(width - 1)).astype(np.uint32), c[1]])

    def settle(place: int, held: Iterator[exchange.Row]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(width, np.int64)
        for _, _, n, blob in held:
            cell, count = exchange.unpacked(blob, n, ["u4", "u4"])
            sums[cell] += count
        yield exchange.rows([(place, 0, 0, width, np.packbits(sums >= least, bitorder="little").tobytes())])

    heavy = np.zeros((2 << bits) // 8, np.uint8)
    for place, blob in exchange.met(rows.mapInArrow(run, exchange.ROWS), places, settle).select("place", "blob").toLocalIterator():
        heavy[place * width // 8 : (place + 1) * width // 8] = np.frombuffer(blob, np.uint8)
    return Sketch(heavy, bits)


def dealt(rows: DataFrame, sketch: Sketch, shards: int, parts: int) -> DataFrame:
    """Rows (lang, shard, part, kind, blob): each task's candidates, once, and the runs of words that a shard's candidates may cover.

    A candidate's part is one of ``parts`` by its hash, so that many tasks may make them distinct; a text's part is that of the task.
    """
    sent = rows.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        sketch, seen = sent.value, np.zeros(0, np.uint64)
        part = TaskContext.get().partitionId() % parts
        held: dict[tuple[str, int, int, int], list[bytes]] = {}
        sizes: dict[tuple[str, int, int, int], int] = {}
        total = 0

        def given(keys: list[tuple[str, int, int, int]]) -> pa.RecordBatch:
            out = [(*key, press.compress(b"\n".join(held.pop(key)))) for key in keys]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()])], ["lang", "shard", "part", "kind", "blob"])

        for batch in slices(batches, most=1 << 21):
            p = Phrases(batch)
            n = len(p.left)
            may, hashes = np.zeros((LONGEST + 1, n + 1), bool), {}
            may[1, :n] = True
            for k in range(2, LONGEST + 1):  # a phrase may be frequent if its first and last k - 1 words may
                at = np.flatnonzero((p.left >= k) & may[k - 1, :-1] & may[k - 1, 1:])
                h = p.hashes(k, at)
                ok = sketch.holds(h)
                may[k, at[ok]] = True
                hashes[k] = at[ok], h[ok]
            at, head = hashes[2]
            if not len(at):
                continue
            shard = np.zeros(n, np.int64)
            shard[at] = p.lang[at].astype(np.int64) * shards + ((head >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
            length = 2 + may[3, at] + (may[3, at] & may[4, at])
            # candidates that the task has not given out yet
            begin = np.concatenate([a for a, _ in hashes.values()])
            size = np.repeat(list(hashes), [len(a) for a, _ in hashes.values()])
            h, first = np.unique(np.concatenate([x for _, x in hashes.values()]), return_index=True)
            fresh = ~np.isin(h, seen, assume_unique=True)
            seen = np.concatenate([seen, h[fresh]])
            begin, size, slot = begin[first[fresh]], size[first[fresh]], ((h[fresh] >> np.uint64(8)) % np.uint64(parts)).astype(np.int64)
            for kind, b, s, group in ((CANDIDATE, begin, size, shard[begin] * parts + slot), (TEXT, at, length, shard[at] * parts + part)):
                order = np.argsort(group, kind="stable")
                b, s, group = b[order], s[order], group[order]
                cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(b) else []
                for low, high in zip(cut, [*cut[1:], len(b)]):
                    runs = np.cumsum(s[low:high]) - s[low:high]
                    place = np.arange(int(s[low:high].sum())) + np.repeat(b[low:high] - runs, s[low:high])
                    new = np.zeros(len(place), bool)
                    if kind == TEXT:
                        place = np.unique(place)
                        new = p.new[place]
                        new[1:] |= place[1:] != place[:-1] + 1
                    else:
                        new[runs] = True
                    where, slice_ = divmod(int(group[low]), parts)
                    lang, number = divmod(where, shards)
                    key = (p.langs[lang], number, slice_, kind)
                    text = b"".join(spelled(p.words, place, new))
                    held.setdefault(key, []).append(text)
                    sizes[key] = sizes.get(key, 0) + len(text)
                    total += len(text)
                    if sizes[key] > 1 << 20:
                        total -= sizes.pop(key)
                        yield given([key])
            if total > 1 << 26:
                yield given(list(held))
                sizes, total = {}, 0
        if held:
            yield given(list(held))
        exchange.trim()

    return rows.mapInArrow(run, ROWS)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, bytes]]:
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        plain = [batch.column(i).to_pylist() for i in range(4)]
        for row in zip(*plain, batch.column(4)):
            yield *row[:4], expand.decompress(row[4].as_buffer())


def candidates(found: DataFrame) -> DataFrame:
    """The distinct candidates of each language and shard, as rows of kind CANDIDATE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for (lang, shard, _), mine in groupby(rows_of(batches), lambda row: row[:3]):
            phrases = set()
            for row in mine:
                phrases.update(row[4].split(b"\n"))
            whole = sorted(phrases)
            out = [press.compress(b"\n".join(whole[a:b])) for a, b in pieces_of(np.cumsum([len(x) for x in whole]), 1 << 20)]
            n = len(out)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array([shard] * n, pa.int32()), pa.array([-1] * n, pa.int32()), pa.array([CANDIDATE] * n, pa.int32()), pa.array(out)], ["lang", "shard", "part", "kind", "blob"])

    return found.where(F.col("kind") == CANDIDATE).repartition("lang", "shard", "part").sortWithinPartitions("lang", "shard", "part").mapInArrow(run, ROWS)


def scanned(found: DataFrame, known: DataFrame, parts: int) -> DataFrame:
    """(lang, phrase, n): how often each candidate occurs; a candidate that occurs has a row for each part it occurs in."""
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    sent = known.drop("part").withColumn("part", F.explode(every)).select(found.columns).union(found.where(F.col("kind") == TEXT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lang, _, _), mine in groupby(rows_of(batches), lambda row: row[:3]):
            automaton, phrases, counts = ahocorasick.Automaton(), [], None
            for _, _, _, kind, blob in mine:
                if kind == CANDIDATE:
                    for phrase in blob.split(b"\n"):
                        automaton.add_word(phrase.decode("latin-1"), len(phrases))
                        phrases.append(phrase)
                    continue
                if counts is None:
                    automaton.make_automaton()
                    counts = np.zeros(len(phrases), np.int64)
                counts += np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(blob.decode("latin-1"))), np.int64), minlength=len(phrases))
            if counts is not None:
                for low in range(0, len(phrases), 50_000):
                    at = low + np.flatnonzero(counts[low : low + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([phrases[i][1:-1].decode() for i in at.tolist()], pa.string()), pa.array(counts[at])], ["lang", "phrase", "n"])
            del automaton
            exchange.trim()

    return sent.repartition("lang", "shard", "part").sortWithinPartitions("lang", "shard", "part", "kind").mapInArrow(run, "lang string, phrase string, n long")


def counted(docs: DataFrame, least: int = 30, text_col: str = "text", lang_col: str = "lang", most_bits: int = MOST_BITS, per_shard: int = PER_SHARD) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, n) of every word and every phrase of two to four words that occurs ``least`` times or more, (lang, n) of each language's words).

    Null text is empty, a null language is ``und``; texts without words and empty tables give no rows.  Every row counts, repeated ones
    too; columns other than the two are not read.  Very long texts are handled in parts of some MB but for a few arrays of a number a word.
    """
    rows = prepared(docs, text_col, lang_col)
    spark = docs.sparkSession
    single = written(word_counts(rows), "words")
    langs = written(single.groupBy("lang").agg(F.sum("n").alias("n")), "lang-words")
    n_words = langs.agg(F.sum("n")).first()[0] or 0
    sketch = sketched(rows, n_words, least, most_bits)
    heavy = sketch.shares()
    likely = heavy[0] + 3 * n_words * heavy[0] * heavy[1] // (1 << 2 * sketch.bits)  # the frequent, and those that share both cells with some
    shards = -(-likely // per_shard) or 1
    parts = -(-max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_words // PER_PART) // shards)
    found = written(dealt(rows, sketch, shards, parts), "phrases-met", "uncompressed")
    known = written(candidates(found), "candidates", "uncompressed")
    sums = scanned(found, known, parts).groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    phrases = written(sums.withColumn("words", F.size(F.split("phrase", " "))).select("lang", "phrase", "words", "n"), "phrase-counts")
    words = written(single.where(F.col("n") >= least).select("lang", "phrase", F.lit(1).alias("words"), "n"), "word-counts")
    discard(single, found, known)
    return phrases.union(words), langs


def part(phrase, first: int, length: int):
    """``length`` words of a phrase from word ``first`` (from 1)."""
    return F.array_join(F.slice(phrase, first, length), " ")


def mined(docs: DataFrame, least: int = 30, top: int = 2000, inside: int = 80, text_col: str = "text", lang_col: str = "lang", **bounds: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` collocations.

    a, l, r: occurrences of the phrase, and of its two parts at the cut with the lowest score floor(SCALE a / (l + r)) (equal scores: the
    shortest first part); n: the language's words.  A phrase with at least ``inside`` percent of its occurrences within one longer
    frequent phrase is left out.  Ranks go by score and a, descending, then the phrase in byte order, so ties are settled.
    Nulls, very long texts, repeated rows, empty tables and other columns: as in ``counted``.
    """
    counts, langs = counted(docs, least, text_col, lang_col, **bounds)
    phrases = counts.where("words > 1").withColumn("w", F.split("phrase", " "))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("n").alias("a"), "k", part(F.col("w"), 1, F.col("k")).alias("left"), part(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    lefts = counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    rights = counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    score = F.expr(f"cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0)) div cast(l + r as decimal(20,0))")
    cut = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"]).withColumn("score", score)
    best = cut.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best"))
    longer = phrases.where("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    longer = longer.withColumn("from", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    held = longer.groupBy("lang", part(F.col("w"), F.col("from"), F.col("size")).alias("phrase")).agg(F.max("n").alias("most"))
    kept = best.join(held, ["lang", "phrase"], "left").where(f"most is null or cast(100 as decimal(3,0)) * most < cast({inside} as decimal(3,0)) * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "best.*").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(langs, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
