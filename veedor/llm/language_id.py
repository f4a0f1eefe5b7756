"""Language identification by hierarchical discrimination: the language family first, then the language within it.

A text's features are its byte n-grams (one to four bytes, after lower-casing, with everything that is no letter as a space), dealt by
hash to DIMS places: the square root of each place's share.  Families are a parameter; a language that it does not name joins the
family whose texts resemble its own most.  Linear support vector machines with squared hinge loss, trained by dual coordinate
descent, decide: one family against the rest, and within a family every two languages against each other.  Each is
fitted on four fifths of its texts and calibrated to a probability on the others.

Training texts are a bounded sample, ``per_lang`` a language at most, chosen by a hash of the text.  Each machine is trained
by a task of its own, over at most all sampled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import bounded, discard, mix, raw_text, slices, text_key, written

DIMS_BITS = 14
DIMS = 1 << DIMS_BITS
LONGEST = 4
#: Languages whose sample shares are broadcast; more are joined by shuffle.
MOST_LANGS = 10_000
#: Texts that are turned into features at once: a dense row of DIMS numbers each.
ROWS_AT_ONCE = 256
#: Families of languages, by two-letter code.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ast", "ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "uralic": ["et", "fi", "hu"],
    "celtic": ["br", "cy", "ga", "gd"],
    "turkic": ["az", "kk", "ky", "tr", "uz"],
    "semitic": ["am", "ar", "he", "mt"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "austronesian": ["id", "jv", "ms", "tl"],
}
SPACED = np.arange(256, dtype=np.uint8)
SPACED[: ord("a")] = 32
SPACED[[*range(ord("A"), ord("Z") + 1)]] = [*range(ord("a"), ord("z") + 1)]
SPACED[ord("z") + 1 : 128] = 32
STEP = 0x9E3779B97F4A7C15
SALT = np.array([k * 0xD1B54A32D192ED03 % 2**64 for k in range(LONGEST)], np.uint64)


def features(column: pa.Array) -> np.ndarray:
    """A row of DIMS float32 for each text, of length 1, or 0 for a text without letters.  Bytes are hashed a piece at a time, so a long text takes no more."""
    raw, offsets = raw_text(column)
    n = len(offsets) - 1
    out = np.zeros(n * DIMS, np.float32)
    piece = 1 << 18
    for low in range(0, len(raw), piece):
        b = SPACED[raw[max(low - LONGEST + 1, 0) : low + piece]].astype(np.uint64)
        skip = min(low, LONGEST - 1)  # bytes of the piece before: n-grams count in the piece that has their last byte
        end = np.arange(low - skip, low - skip + len(b))
        text = np.searchsorted(offsets, end, side="right") - 1
        h, at = np.zeros(len(b), np.uint64), np.arange(len(b))
        letters = np.zeros(len(b), bool)
        for k in range(LONGEST):  # h: the k + 1 bytes that end here
            h[k:] = h[k:] + b[: len(b) - k] * np.uint64(pow(STEP, k, 2**64)) if k else b
            letters[k:] |= b[: len(b) - k] != 32
            ok = letters & (at >= k) & (at >= skip) & (text[np.maximum(at - k, 0)] == text)
            bucket = (mix(h[ok] + SALT[k]) >> np.uint64(64 - DIMS_BITS)).astype(np.int64)
            first = int(text[0]) * DIMS
            found = np.bincount(text[ok] * DIMS + bucket - first)
            out[first : first + len(found)] += found
    out = np.sqrt(out.reshape(n, DIMS))
    norm = np.sqrt(np.square(out).sum(axis=1, dtype=np.float64))
    return out / np.maximum(norm, 1e-12).astype(np.float32)[:, None]


@dataclass
class Model:
    """weights: (machines, DIMS); bias, slope and shift of each.  A machine is (family, None) against the rest, or (a, b) within a family."""

    machines: list[tuple[str, str | None]]
    weights: np.ndarray
    bias: np.ndarray
    slope: np.ndarray
    shift: np.ndarray
    family: dict[str, str]

    def chances(self, x: np.ndarray) -> np.ndarray:
        """Each machine's probability of its first class for each row of features."""
        return 1 / (1 + np.exp(-np.clip((x @ self.weights.T + self.bias) * self.slope + self.shift, -40, 40)))

    def predicted(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score): the likeliest family, in it the language with most votes (then the larger sum of probabilities, then the first by name); the score is the product of both chances."""
        p = self.chances(x) if len(self.machines) else np.zeros((len(x), 0))
        names = sorted(self.family)
        families = sorted(set(self.family.values()))
        at = {m: i for i, m in enumerate(self.machines)}
        if len(families) > 1:
            share = np.stack([p[:, at[f, None]] for f in families], axis=1) + 1e-9
            share /= share.sum(axis=1, keepdims=True)
        else:
            share = np.ones((len(x), 1))
        chosen = np.argmax(share, axis=1)
        lang, score = np.zeros(len(x), np.int64), share[np.arange(len(x)), chosen]
        for f, family in enumerate(families):
            rows = np.flatnonzero(chosen == f)
            mine = [name for name in names if self.family[name] == family]
            votes, sums = np.zeros((len(rows), len(mine))), np.zeros((len(rows), len(mine)))
            for i, a in enumerate(mine):
                for j in range(i + 1, len(mine)):
                    q = p[rows, at[a, mine[j]]]
                    votes[:, i] += q >= 0.5
                    votes[:, j] += q < 0.5
                    sums[:, i] += q
                    sums[:, j] += 1 - q
            best = np.argmax(votes * len(mine) + sums, axis=1)
            lang[rows] = np.array([names.index(m) for m in mine])[best]
            if len(mine) > 1:
                score[rows] *= sums[np.arange(len(rows)), best] / (len(mine) - 1)
        return np.array(names)[lang], np.clip(score, 0, 1)


def svm(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dims: int, c: float = 4.0, epochs: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss over sparse rows (places, values) and classes -1 and 1, by dual coordinate descent; both classes weigh the same."""
    w, bias = np.zeros(dims), 0.0
    alpha = np.zeros(len(y))
    cost = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1))) * c
    square = np.array([1.0 + float(v @ v) for _, v in x]) + 1 / (2 * cost)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(y)):
            at, v = x[i]
            slope = y[i] * (float(w[at] @ v) + bias) - 1 + alpha[i] / (2 * cost[i])
            new = max(alpha[i] - slope / square[i], 0.0)
            step = (new - alpha[i]) * y[i]
            if step:
                w[at] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def calibrated(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the logistic curve through margins of classes -1 and 1, by Newton's method, with smoothed targets; both classes weigh the same, so a rare one is not judged by its rarity."""
    up, down = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    weight = np.where(y > 0, len(y) / (2 * max(up, 1)), len(y) / (2 * max(down, 1)))
    theta = np.array([4.0, 0.0])
    one = np.stack([margin, np.ones(len(margin))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(one @ theta, -30, 30)))
        step = np.linalg.solve(one.T @ (one * (weight * p * (1 - p))[:, None]) + np.diag([0.01, 0.01]), one.T @ (weight * (p - target)) + 0.01 * (theta - [4.0, 0.0]))
        theta = theta - step
        if np.abs(step).max() < 1e-6:
            break
    return float(max(theta[0], 0.1)), float(theta[1])


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def sampled(docs: DataFrame, text_col: str, lang_col: str, per_lang: int) -> DataFrame:
    """(lang, r, at, v): features of at most ``per_lang`` texts with a letter of each language: those with the least hashes, equal texts once."""
    text = F.lower(F.col(text_col).cast("string"))
    rows = docs.where(F.col(lang_col).isNotNull() & has_letter(F.col(text_col).cast("string"))).select(F.col(lang_col).cast("string").alias("lang"), text_key(text).alias("th"), text.alias("text"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = (F.lit(per_lang + 8 * per_lang**0.5 + 100.0) / F.col("n")).alias("share")  # of evenly spread hashes: fewer than per_lang below it is beyond chance
    shares = bounded(written(sizes.select(F.col("lang").alias("_l"), share), "language-shares"), MOST_LANGS)  # so that no text moves before it is chosen
    few = rows.join(shares, F.col("lang") == F.col("_l")).where(F.col("th.a") / 2.0**64 + 0.5 <= F.col("share"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for low in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(low, ROWS_AT_ONCE)
                x = features(part.column(3))
                at = [np.flatnonzero(r) for r in x]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(at, pa.list_(pa.int32())), pa.array([r[a] for r, a in zip(x, at)], pa.list_(pa.float32()))], ["lang", "a", "b", "at", "v"])

    vectors = few.select("lang", "th.a", "th.b", "text").mapInArrow(run, "lang string, a long, b long, at array<int>, v array<float>").dropDuplicates(["lang", "a", "b"])
    r = F.row_number().over(Window.partitionBy("lang").orderBy("a", "b"))
    return vectors.withColumn("r", r).where(F.col("r") <= per_lang).select("lang", "r", "at", "v")


def family_of(sample: DataFrame, families: dict[str, list[str]]) -> dict[str, str]:
    """The family of each sampled language; unnamed ones join the family whose mean features are nearest, or make one if no family is named."""
    known = {code: family for family, codes in families.items() for code in codes}
    parts = sample.select("lang", F.posexplode("at").alias("i", "place"), "v").select("lang", "place", F.expr("v[i]").alias("v")).groupBy("lang", "place").agg(F.sum("v").alias("v"))
    means: dict[str, np.ndarray] = {}
    for lang, place, v in parts.toLocalIterator():  # at most DIMS numbers a language
        means.setdefault(lang, np.zeros(DIMS))[place] = v
    means = {lang: m / np.linalg.norm(m) for lang, m in sorted(means.items())}
    out = {lang: known[lang.split("-")[0].split("_")[0].lower()] for lang in means if lang.split("-")[0].split("_")[0].lower() in known}
    named = sorted(set(out.values()))
    centre = {f: reduce(np.add, [means[lang] for lang in out if out[lang] == f]) for f in named}
    for lang, m in means.items():
        if lang not in out:
            out[lang] = max(named, key=lambda f: float(m @ centre[f]) / np.linalg.norm(centre[f])) if named else "all"
    return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_lang: int = 500, families: dict[str, list[str]] | None = None) -> Model:
    """A model from labelled texts.  Rows with a null language or a text without letters are not used; repeated texts count once; ties of the hash
    are equal texts.  A long text gives the same bounded features.  An empty table gives a model that knows no language.  The driver
    holds DIMS numbers a machine: some 130 kB for each family and each two languages of one.
    """
    sample = written(sampled(docs, text_col, lang_col, per_lang), "language-sample")
    family = family_of(sample, FAMILIES if families is None else families)
    names = sorted(set(family.values()))
    jobs: list[tuple[str, str | None, str, int]] = []  # (first, second, language, class)
    if len(names) > 1:
        jobs += [(f, None, lang, 1 if family[lang] == f else -1) for f in names for lang in family]
    langs = sorted(family)
    for i, a in enumerate(langs):
        for b in langs[i + 1 :]:
            if family[a] == family[b]:
                jobs += [(a, b, a, 1), (a, b, b, -1)]
    if not jobs:
        discard(sample)
        none = np.zeros(0)
        return Model([], np.zeros((0, DIMS), np.float32), none, none, none, family)
    spark = docs.sparkSession
    wanted = spark.createDataFrame(jobs, "first string, second string, lang string, y int")

    def trained(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["lang", "r"])
        y = rows["y"].to_numpy().astype(float)
        x = [(np.asarray(at), np.asarray(v, np.float64)) for at, v in zip(rows["at"], rows["v"])]
        apart = rows["r"].to_numpy() % 5 == 0
        apart = apart if len(set(y[apart])) == 2 else np.zeros(len(y), bool)
        w, bias = svm([r for r, out in zip(x, apart) if not out], y[~apart], DIMS)
        check = apart if apart.any() else ~apart
        slope, shift = calibrated(np.array([float(w[at] @ v) + bias for (at, v), use in zip(x, check) if use]), y[check])
        return pd.DataFrame([{"first": rows["first"].iloc[0], "second": rows["second"].iloc[0], "w": w.astype(np.float32).tobytes(), "bias": bias, "slope": slope, "shift": shift}])

    machines = wanted.join(sample, "lang").groupBy("first", "second").applyInPandas(trained, "first string, second string, w binary, bias double, slope double, shift double")
    got = sorted(machines.collect(), key=lambda r: (r["first"], r["second"] or ""))
    discard(sample)
    column = lambda c: np.array([r[c] for r in got])
    return Model([(r["first"], r["second"]) for r in got], np.stack([np.frombuffer(r["w"], np.float32) for r in got]), column("bias"), column("slope"), column("shift"), family)


def predicted(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the text, if not given; at least one) of every row, with ``lang_pred`` and ``score`` (0 to 1), in place of columns of those names.

    Null texts and texts without a letter are ``und`` with score 0, and so is every text if the model knows no language.  Whole texts are read,
    very long ones a piece at a time; ties go as ``Model.predicted`` states.  Repeated rows each get their row; an empty table gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score") and (keep is not None or c != text_col)]
    text = F.col(text_col).cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.when(has_letter(text), F.lower(text)).alias("text"))
    out = StructType([rows.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in slices(batches):
            for low in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(low, ROWS_AT_ONCE)
                x = features(part.column(1))
                known = (np.abs(x).sum(axis=1) > 0) & bool(model.family)
                lang, score = np.full(part.num_rows, "und", object), np.zeros(part.num_rows)
                if known.any():
                    lang[known], score[known] = model.predicted(x[known])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang.tolist(), pa.string()), pa.array(score)], ["row", "lang_pred", "score"])

    return rows.mapInArrow(run, out).select("row.*", "lang_pred", "score")
