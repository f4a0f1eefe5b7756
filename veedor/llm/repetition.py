"""Quality rules by suffix arrays: longest-common-prefix intervals give every text's maximal repeated word runs.

A batch of texts shares one suffix array over words, built by prefix doubling; the text's number is the first
part of each rank, so runs of different texts never compare equal.  A suffix's longest common prefix with its
neighbours is the longest run that starts there and occurs again in the text; the union of all such runs of at
least ``min_words`` words are the spans of maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import TH, Words, keyed, raw_text, slices, span_hashes, words

#: Words of a batch (one long text, as batches are small) from which memory counts more than time.
LONG = 1 << 18
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def repeats(w: Words) -> np.ndarray:
    """For each word, the length of the longest run starting there that occurs again in the same text."""
    n = len(w.hashes)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    if n > LONG:
        return long_repeats(w)
    text = np.repeat(np.arange(len(w.first) - 1), w.counts)
    end = np.repeat(w.first[1:], w.counts)
    order = np.lexsort((w.hashes, text))
    fresh = np.ones(n, bool)
    fresh[1:] = (text[order][1:] != text[order][:-1]) | (w.hashes[order][1:] != w.hashes[order][:-1])
    rank = np.empty(n, np.int64)  # of a group of equal prefixes: the place of its first suffix in the suffix array
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels, width = [rank], 1
    active = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    suffix = order
    repeated = active
    while len(active):
        far = active + width
        second = np.where(far < end[active], rank[np.minimum(far, n - 1)], -1)
        by = np.lexsort((second, rank[active]))
        f, s = rank[active][by], second[by]
        at = np.arange(len(by))
        new_first = np.ones(len(by), bool)
        new_first[1:] = f[1:] != f[:-1]
        new = new_first.copy()
        new[1:] |= s[1:] != s[:-1]
        group, part = np.maximum.accumulate(np.where(new_first, at, 0)), np.maximum.accumulate(np.where(new, at, 0))
        rank = rank.copy()
        rank[active[by]] = f + part - group
        suffix[f + at - group] = active[by]
        sizes = np.bincount(part, minlength=len(by))[part]
        active = np.sort(active[by][sizes > 1])
        levels.append(rank)
        width *= 2
    # longest common prefixes of neighbours, from the widest level down
    left, right = suffix[:-1], suffix[1:]
    same = levels[0][left] == levels[0][right]
    left, right = left[same], right[same]
    lcp = np.zeros(len(left), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        a, b = left + lcp, right + lcp
        inside = (a < end[left]) & (b < end[right])
        equal = inside & (levels[j][np.minimum(a, n - 1)] == levels[j][np.minimum(b, n - 1)])
        lcp[equal] += 1 << j
    np.maximum.at(out, left, lcp)
    np.maximum.at(out, right, lcp)
    return out


def long_repeats(w: Words) -> np.ndarray:
    """As ``repeats``, for very long texts: two ranks of 32 bits at a time, and longest common prefixes from the finished suffix array by Kasai's pass."""
    n = len(w.hashes)
    text = np.repeat(np.arange(len(w.first) - 1, dtype=np.int32), w.counts)
    end = w.first[1:].astype(np.int32)
    _, word = np.unique(w.hashes, return_inverse=True)
    word = word.astype(np.int32)
    key = text.astype(np.int64) << 32 | word
    suffix = np.argsort(key, kind="stable").astype(np.int32)
    fresh = np.ones(n, bool)
    fresh[1:] = key[suffix[1:]] != key[suffix[:-1]]
    del key
    at = np.arange(n, dtype=np.int32)
    rank = np.empty(n, np.int32)
    rank[suffix] = np.maximum.accumulate(np.where(fresh, at, 0))
    del fresh
    width, active = 1, np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1).astype(np.int32)
    while len(active):
        far = np.minimum(active + np.int32(width), n).astype(np.int32) if width < n else np.full(len(active), n, np.int32)
        second = np.where(far < end[text[active]], rank[np.minimum(far, n - 1)], -1)
        key = rank[active].astype(np.int64) << 32 | (second + 1)
        del far, second
        by = np.argsort(key, kind="stable").astype(np.int32)
        key = key[by]
        new_first, new = np.ones(len(by), bool), np.ones(len(by), bool)
        new_first[1:] = key[1:] >> 32 != key[:-1] >> 32
        new[1:] = key[1:] != key[:-1]
        first = (key >> 32).astype(np.int32)
        del key
        at = np.arange(len(by), dtype=np.int32)
        group, part = np.maximum.accumulate(np.where(new_first, at, 0)), np.maximum.accumulate(np.where(new, at, 0))
        mine = active[by]
        suffix[first + at - group] = mine
        rank[mine] = first + part - group
        active = np.sort(mine[np.bincount(part, minlength=len(by))[part] > 1])
        width *= 2
    before = np.full(n, -1, np.int32)  # the suffix that stands before each
    before[suffix[1:]] = suffix[:-1]
    before[text[before] != text] = -1
    del rank, suffix
    ends, words_, far, out = memoryview(end[text]), memoryview(word), memoryview(before), np.zeros(n, np.int32)
    run, k = memoryview(out), 0
    for i in range(n):
        j = far[i]
        if j < 0:
            k = 0
            continue
        most = ends[i] - max(i, j)
        while k < most and words_[i + k] == words_[j + k]:
            k += 1
        run[i] = k
        k = k - 1 if k else 0
    longest = out.copy()
    some = np.flatnonzero(before >= 0)
    np.maximum.at(longest, before[some], out[some])
    return longest.astype(np.int64)


def covered(w: Words, run: np.ndarray, least: int) -> np.ndarray:
    """For each text, how many words lie in repeated runs of at least ``least`` words."""
    n = len(run)
    mark = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(run >= least)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + run[at], -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(mark[:n]) > 0)])
    return inside[w.first[1:]] - inside[w.first[:-1]]


def longest_of(w: Words, run: np.ndarray) -> np.ndarray:
    """For each text, its longest repeated run."""
    top = np.zeros(len(w.first) - 1, np.int64)
    some = np.flatnonzero(w.counts)
    if len(some):
        top[some] = np.maximum.reduceat(run, w.first[some])
    return top


def repeated_lines(raw: np.ndarray, offsets: np.ndarray, w: Words) -> np.ndarray:
    """For each text, how many of its lines with a word equal an earlier line of it."""
    texts = len(offsets) - 1
    if not len(raw):
        return np.zeros(texts, np.int64)
    breaks = np.flatnonzero(raw == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(raw)]
    text = np.searchsorted(offsets, starts, side="right") - 1
    stops = np.minimum(np.concatenate([starts[1:], [len(raw)]]), offsets[text + 1])
    ends_break = raw[stops - 1] == 10
    stops = np.where((stops > starts) & ends_break, stops - 1, stops)
    has = np.searchsorted(w.starts, stops) > np.searchsorted(w.starts, starts)
    starts, stops, text = starts[has], stops[has], text[has]
    h = span_hashes(raw, starts, stops)
    order = np.lexsort((stops - starts, h, text))
    t, x, k = text[order], h[order], (stops - starts)[order]
    again = (t[1:] == t[:-1]) & (x[1:] == x[:-1]) & (k[1:] == k[:-1])
    return np.bincount(t[1:][again], minlength=texts)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 4, window: int = 8) -> DataFrame:
    """One row per row: doc_id, th, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, longest_repeat.

    n_repeat_words: words in ``window``-word windows found twice or more; n_covered: words in maximal repeats of at
    least ``min_words`` words; longest_repeat in words.  Null and empty texts have zeros; whole texts count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            column = batch.column(2)
            raw, offsets = raw_text(column)
            w = words(column)
            longest = repeats(w)
            total = lambda flag: (s := np.concatenate([[0], np.cumsum(flag)]))[offsets[1:]] - s[offsets[:-1]]
            depth = np.zeros(len(raw) + 1, np.int8)
            depth[w.starts] += 1
            depth[w.ends] -= 1
            inside = np.cumsum(depth[: len(raw)], dtype=np.int8) > 0
            top = longest_of(w, longest)
            figures = [w.counts, total(inside & ((raw & 0xC0) != 0x80)), total(SYMBOLS[raw]), repeated_lines(raw, offsets, w), covered(w, longest, window), covered(w, longest, min_words), top]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in figures)], FIGURES)

    return keyed(docs, id_col, text_col).mapInArrow(run, f"doc_id long, th {TH}, " + ", ".join(f"{n} long" for n in FIGURES[2:]))


FIGURES = ["doc_id", "th", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat"]


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 4, max_covered: float = 0.4, max_repeat: int = 120) -> DataFrame:
    """The measures with base_failed and kept.

    base_failed: fewer than 20 words, or over 30 % of words in repeated 8-word windows.  The method fails a text
    when maximal repeats of ``min_words`` words or more cover over ``max_covered`` of it, or one has over ``max_repeat`` words.
    Null and empty texts have no words and fail; repeated rows each get a row; very long texts count whole; an empty table gives none.
    """
    m = measured(docs, id_col, text_col, min_words)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    method = (F.col("n_covered") > max_covered * F.col("n_words")) | (F.col("longest_repeat") > max_repeat)
    return m.withColumn("base_failed", base).withColumn("kept", ~base & ~method)


def passing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that pass (see ``judged``), all columns as they were, whatever their names."""
    kind = StructType([StructField("_row", docs.schema)])
    limits = {"min_words": 4, "max_covered": 0.4, "max_repeat": 120} | options

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            text = pc.struct_field(whole.column(0), text_col)
            for batch in slices([pa.RecordBatch.from_arrays([whole.column(0), text], ["_row", "text"])]):
                w = words(batch.column(1))
                longest = repeats(w)
                n, top = w.counts, longest_of(w, longest)
                base = (n >= 20) & (100 * covered(w, longest, 8) <= 30 * n)
                ok = base & (covered(w, longest, limits["min_words"]) <= limits["max_covered"] * n) & (top <= limits["max_repeat"])
                yield batch.filter(pa.array(ok)).select(["_row"])

    return docs.select(F.struct(*[docs[n] for n in docs.columns]).alias("_row")).mapInArrow(run, kind).select("_row.*")
