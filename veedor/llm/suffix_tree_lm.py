"""Language-model scores from a probabilistic suffix tree over words.

Tokens are words with A-Z lower-cased and one end after each text.  The tree's root is the add-one unigram; a
node is a context of up to ``max_context`` tokens.  A context keeps its own probability for each next token with which
it was seen ``least_count`` times, whatever the size of the corpus, so the tree grows with the corpus; all counts are
over the whole training corpus.  A context is retained if its next-token distribution diverges from its longest
retained suffix's by more than the entries cost (see ``diverges``).  Retained distributions are smoothed by absolute
discounting into that suffix; a token is scored in the longest retained suffix of what stands before it.

As an entry's probability is known when the tree is made, a text's score is a sum of weights of its tokens and runs of
tokens: a run that is an entry corrects what its suffix and the way back say, a run that is a retained context adds the
log of the way back.  Counts, entries, weights and questions about weights all travel as packed blobs dealt by hash
(see ``exchange``): a task sums what it has seen before it sends, so a hot run is one value a flush, and places grow
with the corpus.  Weights of tokens of at least ``least_head`` and of runs of at least ``least_sent`` relative
frequency, at most 1 / frequency of them, are broadcast; a text asks for the others.  Bitmaps of fixed size keep back
runs that can have no entry or weight; a full one costs time and loses nothing.

Tokens and runs are told apart by 64-bit hashes; a question about a weight carries the first 48 bits of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import Words, discard, mix, slices, tally, words

#: The end's hash; no word has it unless by a chance of 2**-64.
END = np.uint64(0x0EAD_0F7E_C7E4_D001)
DISCOUNT = 0.75
_RUN = np.uint64(0x9FB21C651E98DF25)
#: Most values that a task holds of what it sums before it sends, and most questions of one flush.
HELD, ASKED = 1_000_000, 1_000_000
#: Most texts of a flush.
TEXTS = 60_000

# Kinds of packed rows, with their columns.
RUN, TOKEN, PRIOR, WEIGHT, ASK_TOKEN, ASK_RUN, HEADER, REPLY = range(8)
KINDS = {
    RUN: ["u8", "u8", "i8", "f8"],  # p, s, n, log probability of the last token in the suffix
    TOKEN: ["u8", "i8", "f8"],  # hash, n, weight
    PRIOR: ["u8", "i8", "f8", "f8"],  # hash, n, log probability of the last token, own weight as an entry
    WEIGHT: ["u8", "i8", "f8"],  # as TOKEN, for runs
    ASK_TOKEN: ["u4", "u2", "u2"],  # 32 and 16 bits of a hash, text's number in the flush
    ASK_RUN: ["u4", "u2", "u2"],
    HEADER: ["i8", "u1", "i8", "i8", "f8", "f8", "i8"],  # id, whether there is one, tokens, known, base, score, questions
    REPLY: ["u2", "u4", "u4", "f8", "f8"],  # text's number, questions, known, base, score
}


class Index:
    """Where hashes stand among sorted distinct ones: by their first bits beyond what all share, then step by step in a bucket of about one."""

    def __init__(self, sorted_values: np.ndarray):
        n = len(sorted_values)
        self.least = sorted_values[0] if n else np.uint64(0)
        span = int(sorted_values[-1]) - int(sorted_values[0]) if n else 0
        self.shift = np.uint64(max(0, span.bit_length() - n.bit_length()))
        self.buckets = np.uint64((span >> int(self.shift)) + 1)
        self.values = np.append(sorted_values, np.uint64(2**64 - 1))
        self.starts = np.append(np.searchsorted((sorted_values - self.least) >> self.shift, np.arange(int(self.buckets), dtype=np.uint64)), n).astype(np.int32)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each x, -1 where it is not one."""
        at = self.starts[np.minimum((x - self.least) >> self.shift, self.buckets)].astype(np.int64)
        met = self.values[at]
        out = np.where(met == x, at, -1)
        left = np.flatnonzero(met < x)
        while len(left):
            at[left] += 1
            met = self.values[at[left]]
            hit = met == x[left]
            out[left[hit]] = at[left[hit]]
            left = left[met < x[left]]
        out[out == len(self.values) - 1] = -1
        return out


def sequence(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, begins, text): each text as an end to start from, its words and an end; begins marks what starts a text."""
    texts = len(w.first) - 1
    n = len(w.hashes) + 2 * texts
    text = np.repeat(np.arange(texts), w.counts + 2)
    hashes = np.full(n, END, np.uint64)
    begins = np.zeros(n, bool)
    begins[w.first[:-1] + 2 * np.arange(texts)] = True
    inner = ~begins
    inner[w.first[1:] + 2 * np.arange(texts) + 1] = False
    hashes[inner] = w.hashes
    return hashes, begins, text


def diverges(gain: np.ndarray, entries: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The divergence test: the log-likelihood gain over the suffix exceeds half a log of the count for each entry (BIC), and 0.005 nats a token."""
    return (gain > 0.5 * entries * np.log(np.maximum(total, 2))) & (gain > 0.005 * total)


def sequence_tokens(w: Words) -> np.ndarray:
    """The counted tokens of some texts: all words, and an end for each text."""
    return np.concatenate([w.hashes, np.full(len(w.first) - 1, END, np.uint64)])


def longer(p: np.ndarray, s: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the runs of ``length`` tokens whose runs without the last and without the first token have hashes p and s."""
    return mix(p * _RUN + s + np.uint64(length))


def runs(hashes: np.ndarray, begins: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For lengths 2..most: (ends, hashes, p, s) of the runs within a text."""
    place = np.arange(len(hashes)) - np.maximum.accumulate(np.where(begins, np.arange(len(hashes)), 0))
    out, key = [], hashes
    for length in range(2, most + 1):
        p, s = key[:-1], key[1:]
        key = np.concatenate([key[:1], longer(p, s, length)])
        ends = np.flatnonzero(place >= length - 1)
        out.append((ends, key[ends], p[ends - 1], s[ends - 1]))
    return out


def tally_runs(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[exchange.Part]:
    """(RUN, [s, p, n]): how often each run (hash, p, s) occurs, summed over a task, given out whenever more than HELD are held."""
    held, size = [], 0

    def merged():
        key, p, s, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(key)
        begin = exchange.groups(key[order])
        at = order[begin]
        return key[at], p[at], s[at], np.add.reduceat(n[order], begin)

    for key, p, s in parts:
        if len(key):
            held.append((key, p, s, np.ones(len(key), np.int64)))
            size += len(key)
        if size > HELD:
            x = merged()
            held, size = [x], len(x[0])
            if size > HELD // 2:
                yield RUN, [x[2], x[1], x[3]]
                held, size = [], 0
    if held:
        x = merged()
        yield RUN, [x[2], x[1], x[3]]


def parts_of(batches: Iterator[pa.RecordBatch], *kinds: int) -> Iterator[exchange.Part]:
    return exchange.unfolded(batches, {k: KINDS[k] for k in kinds})


def counted(learn: DataFrame, places: int) -> tuple[int, int, DataFrame]:
    """(number of tokens, of different ones, a table of PRIOR rows of all of them); lp and own are filled in later."""

    def unigrams(batches):
        found = tally((sequence_tokens(words(b.column(1), fold=True)).view(np.int64) for b in slices(batches)), "h", HELD)
        return exchange.dealt(((RUN, [b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()]) for b in found), places)

    def settle(place, held):
        h, n = exchange.gathered(held, {RUN: ["u8", "i8"]})[RUN]
        order = np.argsort(h)
        begin = exchange.groups(h[order])
        h, n = h[order][begin], np.add.reduceat(n[order], begin)
        blob = exchange.packed([h, n, np.zeros(len(h)), np.zeros(len(h))])
        yield pa.RecordBatch.from_arrays([pa.array([n.sum()]), pa.array([PRIOR], pa.int32()), pa.array([0]), pa.array([len(h)], pa.int32()), pa.array([blob])], ["n_tokens", *exchange.NAMES[1:]])

    table = exchange.written(exchange.met(learn.mapInArrow(unigrams, exchange.ROWS), places, settle, "n_tokens long, kind int, flush long, n int, blob binary"), "tokens")
    n, v = (int(x) for x in table.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first())
    return n, v, table


def grown(learn: DataFrame, max_context: int, least_count: int, least_context: float, least_pair: float, filter_bits: int) -> tuple[int, int, DataFrame]:
    """(number of tokens, of different ones, a table of TOKEN rows of all tokens and WEIGHT rows of the runs that have a weight), from (doc_id, text).

    Weights are natural logs; a token's is without its own probability.
    """
    spark = learn.sparkSession
    n, v, tokens = counted(learn, exchange.places_for(spark, 0))
    prior = tokens
    places, floor = exchange.places_for(spark, n), max(float(least_count), least_pair * n)
    rate, levels = np.log(n + v + 1), []
    for length in range(2, max_context + 2):
        first = length == 2

        def priors(batches, first=first):
            for _, (h, m, lp, own) in parts_of(batches, PRIOR):
                yield h, m, np.log(m + 1.0) - rate if first else lp, own

        sent = spark.sparkContext.broadcast(exchange.bitmap(lambda b, priors=priors: (h[m >= floor] for h, m, _, _ in priors(b)), prior, filter_bits))

        def found(batches, sent=sent, length=length):
            for b in slices(batches):
                hashes, begins, _ = sequence(words(b.column(1), fold=True))
                _, key, p, s = runs(hashes, begins, length)[-1]
                # no run is seen more often than a run inside it
                ok = exchange.in_bitmap(sent.value, s)
                ok[ok] = exchange.in_bitmap(sent.value, p[ok])
                yield key[ok], p[ok], s[ok]

        def with_suffix(place, held):
            """Sums the runs that end alike and finds the probability of each in its suffix."""
            (s, p, m), (h, lp) = exchange.gathered(held, {RUN: ["u8", "u8", "i8"], PRIOR: ["u8", "f8"]}).values()
            key = mix(s * _RUN + p)
            order = np.argsort(key)
            begin = exchange.groups(key[order])
            if not len(begin):
                return
            m = np.add.reduceat(m[order], begin)
            often = m >= floor
            begin, m = order[begin[often]], m[often]
            s, p = s[begin], p[begin]
            order = np.argsort(h)
            at = Index(h[order]).find(s)
            s, p, m, at = s[at >= 0], p[at >= 0], m[at >= 0], at[at >= 0]
            if len(s):
                yield exchange.rows([(place, RUN, 0, len(s), exchange.packed([p, s, m, lp[order][at]]))])

        dealt_runs = learn.mapInArrow(lambda b, found=found: exchange.dealt(tally_runs(found(b)), places), exchange.ROWS)
        suffixes = prior.mapInArrow(lambda b, priors=priors: exchange.dealt(((PRIOR, [h[m >= floor], lp[m >= floor]]) for h, m, lp, _ in priors(b)), places), exchange.ROWS)
        seen = exchange.written(exchange.met(dealt_runs.unionByName(suffixes), places, with_suffix), "runs")
        def entered(place, held, length=length, first=first):
            """The divergence test of each context: its entries, and the weights of the runs one shorter."""
            (p, s, m, suffix), (h, total, own) = exchange.gathered(held, {RUN: KINDS[RUN], PRIOR: ["u8", "i8", "f8"]}).values()
            order = np.argsort(h)
            h, total, own = h[order], total[order], own[order]
            back = np.zeros(len(h))
            at = Index(h).find(p)
            ok = at >= 0
            ok[ok] = total[at[ok]] >= least_context * n
            order = np.flatnonzero(ok)[np.lexsort((s[ok], p[ok]))]
            p, s, m, suffix, at = p[order], s[order], m[order], suffix[order], at[order]
            if len(p):
                begin = exchange.groups(p)
                size, whole, x = np.diff(np.append(begin, len(p))), total[at[begin]].astype(float), m.astype(float)
                each = np.repeat(whole, size)
                kept, mass = np.add.reduceat(x, begin), np.add.reduceat(np.exp(suffix), begin)
                gain = np.add.reduceat(x * (np.log(x / each) - suffix), begin)
                rest = np.maximum(whole - kept, 0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = gain + np.where(rest > 0, rest * np.log(rest / whole / np.maximum(1 - mass, 1e-12)), 0)
                retained = diverges(gain, size, whole)
                way = np.where(retained, np.log(1 - (kept - DISCOUNT * size) / whole), 0.0)
                back[at[begin]] = way
                way, retained = np.repeat(way, size), np.repeat(retained, size)
                lp = np.where(retained, np.log((x - DISCOUNT) / each + np.exp(way + suffix)), suffix)
                new = longer(p, s, length)
                order = np.argsort(new)
                yield exchange.rows([(place, PRIOR, 0, len(p), exchange.packed([c[order] for c in (new, m, lp, np.where(retained, lp - way - suffix, 0.0))]))])
            w = own + back
            use = np.ones(len(w), bool) if first else w != 0
            if use.any():
                yield exchange.rows([(place, TOKEN if first else WEIGHT, 0, int(use.sum()), exchange.packed([h[use], total[use], w[use]]))])

        entries = seen.mapInArrow(lambda b: exchange.dealt(((RUN, c) for _, c in parts_of(b, RUN)), places), exchange.ROWS)
        contexts = prior.mapInArrow(lambda b, priors=priors: exchange.dealt(((PRIOR, [h, m, own]) for h, m, _, own in priors(b)), places), exchange.ROWS)
        prior = exchange.written(exchange.met(entries.unionByName(contexts), places, entered), "entries")
        levels.append(prior)
        sent.unpersist()
        discard(seen, *([] if length > 2 else [tokens]))

    def last(batches):
        for _, (h, m, _, own) in parts_of(batches, PRIOR):
            use = own != 0
            if use.any():
                yield exchange.rows([(0, WEIGHT, 0, int(use.sum()), exchange.packed([h[use], m[use], own[use]]))])

    table = prior.mapInArrow(last, exchange.ROWS)
    for level in levels:
        table = table.unionByName(level.where(F.col("kind") != PRIOR))
    table = exchange.written(table, "weights")
    discard(*levels)
    return n, v, table


def frequent(table: DataFrame, kind: int, least: float) -> tuple[Index, np.ndarray, np.ndarray]:
    """Hashes, counts and weights in base 10 of the rows of a kind seen at least ``least`` times."""

    def chosen(batches):
        for _, (h, m, w) in parts_of(batches, kind):
            use = m >= least
            yield pa.RecordBatch.from_arrays([pa.array(h[use].view(np.int64)), pa.array(m[use]), pa.array(w[use])], ["h", "n", "w"])

    top = table.mapInArrow(chosen, "h long, n long, w double").toArrow()
    h, m, w = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy(), top.column("w").to_numpy()
    order = np.argsort(h)
    return Index(h[order]), m[order], w[order] / np.log(10)


def asking(batches: Iterator[pa.RecordBatch], sent, lengths: int, places: int) -> Iterator[pa.RecordBatch]:
    """Of texts (doc_id, text) what the broadcast weights say, as HEADER rows, and the questions that are left."""
    (head, counts, weights), (top, _, top_weights), mask = sent.value
    logs, figures, asks, size, texts, flush = np.log10(counts + 1.0), [], [], 0, 0, TaskContext.get().partitionId() << 24

    def out() -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*figures)]
        questions = np.zeros(texts, np.int64)
        for _, _, text in asks:
            questions += np.bincount(text, minlength=texts)
        yield exchange.rows([(flush % places, HEADER, flush, texts, exchange.packed([*columns, questions]))])
        for kind in (ASK_TOKEN, ASK_RUN):
            mine = [(h, t) for k, h, t in asks if k == kind]
            if mine:
                h, t = (np.concatenate(x) for x in zip(*mine))
                yield from exchange.dealt(iter([(kind, [h, t.astype(np.uint16)])]), places, flush, thin=lambda c: [(c[0] >> np.uint64(32)).astype(np.uint32), (c[0] >> np.uint64(16)).astype(np.uint16), c[1]])

    for batch in slices(batches):
        n = batch.num_rows
        hashes, begins, text = sequence(words(batch.column(1), fold=True))
        tokens = head.find(hashes)
        use, known = ~begins, (tokens >= 0) & ~begins
        total = lambda where, x: np.bincount(text[where], x, n)
        base = total(known, logs[tokens[known]])
        score = base + total(known, weights[tokens[known]])
        rare = np.flatnonzero(use & ~known)
        asks.append((ASK_TOKEN, hashes[rare], text[rare] + texts))
        size += len(rare)
        for ends, key, _, _ in runs(hashes, begins, lengths):
            may = exchange.in_bitmap(mask, key)  # all runs with a weight
            ends, key = ends[may], key[may]
            at = top.find(key)
            score += total(ends[at >= 0], top_weights[at[at >= 0]])
            may = at < 0
            asks.append((ASK_RUN, key[may], text[ends[may]] + texts))
            size += int(may.sum())
        ids = batch.column(0)
        valid = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
        count = lambda where: np.bincount(text[where], minlength=n).astype(np.int64)
        figures.append((ids.fill_null(0).to_numpy(zero_copy_only=False), valid, count(use), count(known), base, score))
        texts += n
        if size > ASKED or texts > TEXTS - 5_000:
            yield from out()
            figures, asks, size, texts, flush = [], [], 0, 0, flush + 1
    if texts:
        yield from out()


def answered(place: int, rows: Iterator[exchange.Row]) -> Iterator[pa.RecordBatch]:
    """The sums of what a place's weights say to each flush's questions; HEADER rows pass."""
    parts, models = {TOKEN: [], WEIGHT: []}, {}
    for kind, flush, n, blob in rows:
        if kind in parts:
            parts[kind].append((kind, flush, n, blob))
        elif kind == HEADER:
            yield exchange.rows([(0, HEADER, flush, n, blob.to_pybytes())])
        else:
            if kind not in models:  # weights come before questions
                own = TOKEN if kind == ASK_TOKEN else WEIGHT
                h, m, w = exchange.gathered(parts.pop(own), {own: KINDS[own]})[own]
                order = np.argsort(h)
                models[kind] = (Index(h[order] >> np.uint64(16)), np.log10(m[order] + 1.0), w[order])
            h, logs, w = models[kind]
            high, low, text = exchange.unpacked(blob, n, KINDS[kind])
            at = h.find(high.astype(np.uint64) << np.uint64(16) | low)
            hit, text = at >= 0, text.astype(np.int64)
            asked = np.bincount(text)
            some = np.flatnonzero(asked)
            sums = lambda x: np.bincount(text[hit], x[at[hit]], len(asked))[some]  # noqa: E731, B023
            score = sums(w)
            known, base = (np.bincount(text[hit], minlength=len(asked))[some], sums(logs)) if kind == ASK_TOKEN else (np.zeros(len(some), np.int64), np.zeros(len(some)))
            columns = [some.astype(np.uint16), asked[some].astype(np.uint32), known.astype(np.uint32), base, base + score]
            yield exchange.rows([(0, REPLY, flush, len(some), exchange.packed(columns))])


def summed(whole: float):
    """The figures of a flush's texts, from its header and all replies."""

    def settle(flush: int, rows: Iterator[exchange.Row]) -> Iterator[pa.RecordBatch]:
        _, _, n, blob = next(rows)  # the header comes first
        ids, valid, tokens, known, base, score, questions = exchange.unpacked(blob, n, KINDS[HEADER])
        for _, _, n, blob in rows:
            text, asked, own, b, w = exchange.unpacked(blob, n, KINDS[REPLY])
            questions[text] -= asked
            known[text] += own
            base[text] += b
            score[text] += w
        if questions.any():
            raise RuntimeError("replies do not fit the questions: a task that ran again gave its rows in another order")
        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=valid == 0), pa.array(tokens), pa.array(known), pa.array(base - tokens * whole), pa.array(score - tokens * whole)], SCORES)

    return settle


SCORES = ["doc_id", "n_tokens", "n_known", "base_score", "score"]


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_context: int = 2, least_head: float = 1e-6, least_context: float = 0.0, least_pair: float = 0.0, least_count: int = 2, least_sent: float = 1e-6, filter_bits: int = 1 << 28) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Trained on rows whose crc32(id as text) mod 7 is not 2; rows with a null id train too.  Scores are log10
    probabilities: base_score by the add-one unigram, score by the tree.  Null and empty texts are one end, very long
    ones count whole.  With no training row every token has probability 1 / 1.  Repeated rows each count and each get
    a row; an empty table gives none.  Other columns of docs are not looked at.
    ``least_context`` and ``least_pair`` add floors of relative frequency for contexts and entries; ``least_head``,
    ``least_sent`` and ``filter_bits`` only say how weights travel.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n, v, table = grown(rows.where(~held), max_context, least_count, least_context, least_pair, filter_bits)
    spark = docs.sparkSession
    places = exchange.places_for(spark, n)
    floors = {TOKEN: max(1.0, least_head * n), WEIGHT: max(1.0, least_sent * n)}

    def rare(batches):
        for kind, (h, m, w) in parts_of(batches, TOKEN, WEIGHT):
            use = m < floors[kind]
            yield kind, [h[use], m[use], w[use] / np.log(10)]

    mask = exchange.bitmap(lambda b: (c[0] for _, c in parts_of(b, WEIGHT)), table, filter_bits)
    sent = spark.sparkContext.broadcast((frequent(table, TOKEN, floors[TOKEN]), frequent(table, WEIGHT, floors[WEIGHT]), mask))
    asks = rows.mapInArrow(lambda b: asking(b, sent, max_context + 1, places), exchange.ROWS)
    both = asks.unionByName(table.mapInArrow(lambda b: exchange.dealt(rare(b), places), exchange.ROWS))
    replies = exchange.met(both, places, answered)
    out = exchange.met(replies, places, summed(float(np.log10(n + v + 1))), "doc_id long, n_tokens long, n_known long, base_score double, score double", by="flush")
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
