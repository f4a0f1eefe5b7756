"""Personal data: patterns, and information-theoretic sanitisation of the terms around them.

Patterns find protected entities.  After Sanchez and Batet's C-sanitisation, a term reveals an entity as far as
their pointwise mutual information, estimated from co-occurrence over the whole corpus, covers the entity's
information content: disclosure = PMI(t; e) / -log2 p(e), which is 1 when t never occurs without e.  Terms near an
entity whose disclosure reaches ``generalise`` are replaced by a class of words, from ``remove`` on they are taken out.
An entity is protected as itself and as what it shares with others (an address's domain, a number's first digits), so
an entity of one text has evidence too; a term goes by the larger disclosure.  Pairs seen together in fewer than ``support``
texts are no evidence.  Only texts that hold the entity change.

Beside the four base kinds, credentials (a key's name, a sign and a value) are entities too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TH, bitmap, in_bitmap, keyed, raw_text, same_row, slices, tally, words, written

KINDS = ["email", "ip", "card", "phone", "secret", "term_general", "term_remove"]
#: Kinds below BASE are those of the contract, kinds below ENTITY are protected; the others are terms.
BASE, ENTITY = 4, 5
#: Each is linear in the text: possessive repeats, and no start inside a run that a start before it has covered.
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SECRET = re.compile(
    r"(?<![A-Za-z0-9])(?:api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|secret|token|passw(?:or)?d)[\x20\t]{0,3}[:=][\x20\t]{0,3}[\"']?(?P<value>[A-Za-z0-9+/_.=~-]{16,}+)[\"']?",
    re.IGNORECASE | re.ASCII,
)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LUHN = [sum(divmod(2 * d, 10)) for d in range(10)]


def luhn(digits: str) -> bool:
    return (sum(map(int, digits[-1::-2])) + sum(_LUHN[int(d)] for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain.rest: each holds one @, so each @ is tried once, with all it can have on its left."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL_END.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all base matches, by kind and start; ends are exclusive, in code points."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if any(d in text for d in "0123456789"):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((1, *m.span()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((3, *m.span()))
    return out


def secret_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of credentials: the whole assignment, if its value has letters and digits."""
    found = (m for m in SECRET.finditer(text) if any(c.isdigit() for c in m["value"]) and any(c.isalpha() for c in m["value"])) if "=" in text or ":" in text else ()
    return [(BASE, *m.span()) for m in found]


def cleaned(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Entities replaced by their kind in brackets, general terms by the class of word they are, removed terms by nothing; of overlapping spans the first counts."""
    parts, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: s[1:]):
        if end <= at:
            continue
        word = text[start:end]
        parts.append(text[at : max(at, start)])
        if kind < ENTITY:
            parts.append(f"[{KINDS[kind].upper()}]")
        elif KINDS[kind] == "term_general":
            parts.append("[NUMBER]" if word.strip(".,;:").isdigit() else "[NAME]" if word[:1].isupper() else "[WORD]")
        at = end
    return "".join([*parts, text[at:]])


def protected(kind: int, text: str) -> list[str]:
    """An entity's names: itself, and its domain, network, issuer, area or key's name."""
    text = text.lower()
    digits = "".join(c for c in text if c.isdigit())
    shared = (text.rpartition("@")[2], text.rpartition(".")[0], digits[:6], digits[:5], re.split("[ \t:=]", text, maxsplit=1)[0])[kind]
    return [f"{KINDS[kind]}:{text}", f"{KINDS[kind]}~{shared}"]


#: Entities of a text whose surroundings are looked at together.
TOGETHER = 8_192


class Around:
    """The words of a text that lie within ``window`` words of its entities and overlap none, in code points."""

    def __init__(self, text: str, spans: list[tuple[int, int, int]], starts: np.ndarray, ends: np.ndarray, window: int, together: int):
        self.text, self.spans, self.window, self.together = text, spans, window, together
        at = np.array([s[1:] for s in spans], np.int64).reshape(-1, 2)
        self.low, self.high = np.searchsorted(ends, at[:, 0], side="right"), np.searchsorted(starts, at[:, 1])
        edges = np.zeros(len(starts) + 1, np.int64)
        np.add.at(edges, self.low, 1)
        np.add.at(edges, np.maximum(self.high, self.low), -1)
        self.taken = np.cumsum(edges[:-1]) > 0

    def pieces(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(entity, word): an entity's hashes with the numbers of its words, for ``together`` entities at a time."""
        step = np.arange(self.window)
        for a in range(0, len(self.spans), self.together):
            names = [protected(kind, self.text[x:y]) for kind, x, y in self.spans[a : a + self.together]]
            hashes = np.array([[xxhash.xxh64_intdigest(n) - (1 << 63) for n in two] for two in names], np.int64)
            low, high = self.low[a : a + self.together, None], self.high[a : a + self.together, None]
            word = np.concatenate([low - self.window + step, high + step], axis=1)
            ok = (word >= 0) & (word < len(self.taken))
            ok[ok] = ~self.taken[word[ok]]
            of = np.nonzero(ok)[0]
            yield hashes[of].T.ravel(), np.tile(word[ok], 2)


def distinct(*columns: np.ndarray) -> list[np.ndarray]:
    """Each combination of the columns' values once."""
    order = np.lexsort(columns)
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return [c[new] for c in columns]


def texts_of(batch: pa.RecordBatch) -> Iterator[tuple[int, str, list[tuple[int, int, int]], np.ndarray, np.ndarray, np.ndarray]]:
    """(row, text, entities, word starts, word ends, word hashes) of each text; words are worked out where there are entities."""
    w, offsets, after = None, None, None
    for i, text in enumerate(batch.column(2).to_pylist()):
        spans = base_spans(text) + secret_spans(text)
        if not spans:
            yield i, text, spans, None, None, None
            continue
        if w is None:
            w, (_, offsets) = words(batch.column(2), fold=True), raw_text(batch.column(2))
            after = np.flatnonzero((w.raw & 0xC0) == 0x80)  # bytes that begin no code point
        low, high = w.first[i], w.first[i + 1]
        skipped = np.searchsorted(after, offsets[i])
        point = lambda at: at - offsets[i] - (np.searchsorted(after, at) - skipped)  # noqa: B023, E731
        yield i, text, spans, point(w.starts[low:high]), point(w.ends[low:high]), w.hashes[low:high].view(np.int64)


SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
SPANS = "array<struct<kind:int,start:int,end:int>>"
#: Rows of texts (base and clean, with doc_id and th), and rows of counts: n texts have term t around entity e, or have e (t is null).  Counts with a
#: ``text`` are of one text in pieces and may repeat.
FOUND = ["doc_id long", f"th {TH}", f"base {SPANS}", "clean binary", "e long", "t long", "n long", "text long"]


def _spans(rows: list[list[tuple[int, int, int]]]) -> pa.Array:
    flat = np.array([x for s in rows for x in s], np.int32).reshape(-1, 3)
    values = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(SPAN))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in rows])]).astype(np.int32)), values)


def _found(batches: Iterator[pa.RecordBatch], window: int, together: int) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in FOUND]
    th = pa.struct([("a", pa.int64()), ("b", pa.int64())])
    held: list[list[np.ndarray]] = []  # (e, t, n); t of an entity's own count is in other rows
    size = number = 0
    own: list[list[np.ndarray]] = []

    def counts(e: np.ndarray, t: np.ndarray | None, n: np.ndarray, text: int | None) -> pa.RecordBatch:
        m = len(e)
        none = [pa.nulls(m, k) for k in (pa.int64(), th, pa.list_(SPAN), pa.binary())]
        return pa.RecordBatch.from_arrays([*none, pa.array(e), pa.nulls(m, pa.int64()) if t is None else pa.array(t), pa.array(n), pa.nulls(m, pa.int64()) if text is None else pa.array(np.full(m, text))], names)

    def summed(parts: list[list[np.ndarray]], keys: int) -> list[np.ndarray]:
        columns = [np.concatenate(c) for c in zip(*parts)]
        order = np.lexsort(columns[:keys])
        columns = [c[order] for c in columns]
        new = np.zeros(len(order), bool)
        new[:1] = True
        for c in columns[:keys]:
            new[1:] |= c[1:] != c[:-1]
        begin = np.flatnonzero(new)
        return [*(c[begin] for c in columns[:keys]), np.add.reduceat(columns[keys], begin)]

    def flushed() -> Iterator[pa.RecordBatch]:
        if held:
            e, t, n = summed(held, 2)
            yield counts(e, t, n, None)
        if own:
            e, n = summed(own, 1)
            yield counts(e, None, n, None)

    for batch in slices(batches):
        base, clean, few = [], [], []
        for i, text, spans, starts, ends, hashes in texts_of(batch):
            base.append(spans)
            clean.append(hashlib.sha256(cleaned(text, spans).encode()).digest())
            if not spans:
                continue
            near = Around(text, spans, starts, ends, window, together)
            if len(spans) <= together:
                e, word = next(near.pieces())
                few.append((np.full(len(e), i), e, hashes[word]))
                continue
            number += 1
            key = (TaskContext.get().partitionId() << 32) + number
            for e, word in near.pieces():
                e, t = distinct(e, hashes[word])
                yield counts(e, t, np.ones(len(e), np.int64), key)
                e = np.unique(e)
                yield counts(e, None, np.ones(len(e), np.int64), key)
        if few:
            i, e, t = distinct(*(np.concatenate(c) for c in zip(*few)))
            held.append([e, t, np.ones(len(e), np.int64)])
            _, e = distinct(i, e)
            own.append([e, np.ones(len(e), np.int64)])
            size += len(held[-1][0])
            if size > 1_000_000:
                held, own = [summed(held, 2)], [summed(own, 1)]
                size = len(held[0][0])
                if size > 500_000:
                    yield from flushed()
                    held, own, size = [], [], 0
        n = batch.num_rows
        key = pa.StructArray.from_arrays([batch.column(1).field(k) for k in range(2)], fields=list(th))  # as in the rows of counts
        yield pa.RecordBatch.from_arrays([batch.column(0), key, _spans(base), pa.array(clean, pa.binary()), *[pa.nulls(n, pa.int64())] * 4], names)
    yield from flushed()


def disclosing(found: DataFrame, rows: DataFrame, total: int, support: int, generalise: float, filter_bits: int) -> DataFrame:
    """(e, t, disclosure) of the pairs that reach ``generalise``; counts are numbers of texts, over all rows."""
    counts = found.where("e is not null").select("e", "t", "n", "text")
    once = counts.where("text is null").select("e", "t", "n").unionByName(counts.where("text is not null").dropDuplicates(["text", "e", "t"]).select("e", "t", "n"))
    entities = once.where("t is null").groupBy("e").agg(F.sum("n").alias("n_e"))
    pairs = once.where("t is not null").groupBy("e", "t").agg(F.sum("n").alias("n_et"))
    pairs = written(pairs.where(F.col("n_et") >= support), "pairs")
    # Only terms of such pairs are counted; a fixed bitmap finds them, and passes a few others that the join drops.
    sent = rows.sparkSession.sparkContext.broadcast(bitmap(pairs.select("t").distinct(), filter_bits))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        """Of each batch the candidate terms, once for each text that has them."""
        for batch in slices(batches):
            w = words(batch.column(2), fold=True)
            hit = np.flatnonzero(in_bitmap(sent.value, w.hashes, filter_bits))
            text, h = np.searchsorted(w.first, hit, side="right") - 1, w.hashes[hit]
            order = np.lexsort((h, text))
            h, text = h[order], text[order]
            once = np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])]) if len(h) else np.zeros(0, bool)
            yield h[once].view(np.int64)

    n_t = rows.select("doc_id", "th", "text").mapInArrow(lambda b: tally(terms(b), "t"), "t long, n long").groupBy("t").agg(F.sum("n").alias("n_t"))
    joined = pairs.join(n_t, "t").join(entities, "e")
    pmi = F.log2(F.col("n_et") * F.lit(float(total)) / F.col("n_t") / F.col("n_e"))
    content = F.log2(F.lit(float(total)) / F.col("n_e"))
    return joined.where(content > 0).select("e", "t", (pmi / content).alias("disclosure")).where(F.col("disclosure") >= generalise)


def pair_key(e: np.ndarray, t: np.ndarray) -> np.ndarray:
    """One value for a pair, for the bitmap; the same as ``pair_column``."""
    t = t.view(np.uint64)
    return e.view(np.uint64) ^ ((t << np.uint64(23)) | (t >> np.uint64(41)))


def pair_column() -> Column:
    return F.col("e").bitwiseXOR(F.shiftleft("t", 23).bitwiseOR(F.shiftrightunsigned("t", 41)))


def searched(docs: DataFrame, id_col: str, text_col: str, window: int, support: int, generalise: float, remove: float, filter_bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keyed rows, entities of every row, (doc_id, th, terms) of rows with terms)."""
    rows, together = keyed(docs, id_col, text_col), TOGETHER
    table = written(rows.mapInArrow(lambda b: _found(b, window, together), ", ".join(FOUND)), "entities")
    found = table.where("clean is not null").select("doc_id", "th", "base", "clean")
    pairs = written(disclosing(table, rows, found.count(), support, generalise, filter_bits), "disclosing")
    # Terms of pairs that disclose are looked up in the texts again: a fixed bitmap finds them, and passes a few others that the join drops.
    sent = rows.sparkSession.sparkContext.broadcast(bitmap(pairs.select(pair_column().alias("p")), filter_bits))

    def told_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            held = []
            for i, text, spans, starts, ends, hashes in texts_of(batch):
                for e, word in Around(text, spans, starts, ends, window, together).pieces() if spans else ():
                    t = hashes[word]
                    hit = np.flatnonzero(in_bitmap(sent.value, pair_key(e, t), filter_bits))
                    held.append((np.full(len(hit), i), e[hit], t[hit], starts[word[hit]], ends[word[hit]]))
            if held:
                i, e, t, start, end = (np.concatenate(c) for c in zip(*held))
                at = pa.array(i)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(e), pa.array(t), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["doc_id", "th", "e", "t", "start", "end"])

    near = rows.select("doc_id", "th", "text").mapInArrow(told_in, f"doc_id long, th {TH}, e long, t long, start int, end int")
    told = near.join(pairs, ["e", "t"]).groupBy("doc_id", "th", "start", "end").agg(F.max("disclosure").alias("d"))
    kind = F.when(F.col("d") >= remove, ENTITY + 1).otherwise(ENTITY)
    return rows, found, told.groupBy("doc_id", "th").agg(F.collect_list(F.struct(kind.alias("kind"), "start", "end")).alias("terms"))


def spans_of(base, terms):
    return F.array_sort(F.concat(base, F.coalesce(terms, F.array().cast("array<struct<kind:int,start:int,end:int>>"))))


def detected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 12, support: int = 3, generalise: float = 0.6, remove: float = 0.9, filter_bits: int = 1 << 24) -> DataFrame:
    """(doc_id, th, spans) for every row; spans: array of (kind, start, end), kind an index of KINDS, base ones first.

    Null and empty texts have no spans.  Rows with one id and one text have the same spans; very long texts count whole;
    an empty table gives no row; other columns are not looked at.  ``filter_bits`` bounds the bitmap of candidate terms; a full one costs time and loses nothing.
    """
    _, found, terms = searched(docs, id_col, text_col, window, support, generalise, remove, filter_bits)
    return same_row(found, terms, "left").select("doc_id", "th", spans_of(F.col("base"), F.col("terms")).alias("spans"))


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches (_, _, text, spans) with their sanitised texts."""
    for batch in slices(batches):
        spans = ([(s["kind"], s["start"], s["end"]) for s in x or []] for x in batch.column(3).to_pylist())
        yield batch, [cleaned(text, s) for text, s in zip(batch.column(2).to_pylist(), spans)]


def said(spans):
    """kind:start:end of spans in order, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 12, support: int = 3, generalise: float = 0.6, remove: float = 0.9, filter_bits: int = 1 << 24) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_term, n_spans, sanitised_sha256) for every row: nulls, repeats and long texts as ``detected`` takes them.

    sanitised_sha256 is the hash of what ``sanitised`` gives.  Only texts with terms are joined with them; a bitmap of fixed size finds these, a full one costs time and loses nothing.
    """
    rows, found, terms = searched(docs, id_col, text_col, window, support, generalise, remove, filter_bits)
    terms = written(same_row(terms, found.select("doc_id", "th", "base").dropDuplicates(["doc_id", "th"]), "inner").select("doc_id", "th", spans_of(F.col("base"), F.col("terms")).alias("spans")), "terms")
    sent = rows.sparkSession.sparkContext.broadcast(bitmap(terms.select("th.a"), filter_bits))

    def with_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            key = batch.column(1).field(0).to_numpy(zero_copy_only=False).view(np.uint64)
            hit = np.flatnonzero(in_bitmap(sent.value, key, filter_bits))
            if len(hit):
                yield batch.take(pa.array(hit))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _cleaned(batches):
            digests = pa.array([hashlib.sha256(x.encode()).digest() for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), digests], ["doc_id", "th", "spans", "told"])

    changed = same_row(rows.mapInArrow(with_terms, f"doc_id long, th {TH}, text string"), terms, "inner")
    changed = changed.mapInArrow(hashed, f"doc_id long, th {TH}, spans array<struct<kind:int,start:int,end:int>>, told binary").dropDuplicates(["doc_id", "th"])
    both = same_row(found, changed, "left").select("doc_id", F.coalesce("spans", F.array_sort("base")).alias("spans"), F.lower(F.hex(F.coalesce("told", "clean"))).alias("sanitised_sha256"))
    count = lambda low, high, name: F.size(F.filter("spans", lambda s: s["kind"].between(low, high))).cast("long").alias(name)
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    return both.select(
        "doc_id", *[count(k, k, f"n_{KINDS[k]}") for k in range(BASE)], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"),
        count(BASE, BASE, "n_secret"), count(ENTITY, ENTITY + 1, "n_term"), F.size("spans").cast("long").alias("n_spans"), "sanitised_sha256",
    )


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, text): entities replaced by their kind in brackets, general terms by the class of word they are, removed terms by nothing.

    Null texts become empty; repeated rows each get a row; other columns are not looked at.
    """
    rows = keyed(docs, id_col, text_col)
    spans = detected(docs, id_col, text_col, **options).dropDuplicates(["doc_id", "th"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _cleaned(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return same_row(rows, spans, "left").mapInArrow(run, "doc_id long, text string")
