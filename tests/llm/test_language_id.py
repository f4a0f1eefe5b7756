import numpy as np
import pyarrow as pa

from veedor.llm import language_id
from veedor.llm.common import mix

VOICES = {  # syllables that a language's words are made of; the first two pairs share most of theirs
    "es": ["cion", "ar", "el", "la", "os", "que", "ñ", "llo"],
    "pt": ["cion", "ar", "el", "la", "os", "que", "ã", "lho"],
    "de": ["sch", "ung", "ein", "er", "der", "ich", "ü", "keit"],
    "nl": ["sch", "ung", "een", "er", "der", "ij", "uu", "heid"],
    "zz": ["kwa", "mba", "ndo", "ngu", "zi", "tu", "wa", "li"],
    "zy": ["kwa", "mba", "ndo", "ngu", "ki", "pu", "wa", "ri"],
}


def texts(lang, n, seed, words=12):
    rng = np.random.default_rng([seed, *lang.encode()])
    word = lambda: "".join(rng.choice(VOICES[lang], rng.integers(1, 4)))
    return [" ".join(word() for _ in range(words)) + ". 12" for _ in range(n)]


def rows(n, seed):
    return [(t, lang) for lang in VOICES for t in texts(lang, n, seed)]


def brute_features(text):
    raw = bytes(b if 97 <= b <= 122 or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in text.encode())
    out = np.zeros(language_id.DIMS)
    for k in range(language_id.LONGEST):
        for end in range(k, len(raw)):
            gram = raw[end - k : end + 1]
            if gram.strip(b" "):
                h = sum(b * pow(language_id.STEP, j, 2**64) for j, b in enumerate(reversed(gram))) % 2**64
                out[int(mix(np.array([h], np.uint64) + language_id.SALT[k])[0]) >> (64 - language_id.DIMS_BITS)] += 1
    out = np.sqrt(out)
    return out / (np.linalg.norm(out) or 1)


def brute_predicted(model, x):
    """The language and score of one row of features, machine by machine."""
    p = {m: 1 / (1 + np.exp(-((model.weights[i] @ x + model.bias[i]) * model.slope[i] + model.shift[i]))) for i, m in enumerate(model.machines)}
    families = sorted(set(model.family.values()))
    share = {f: p[f, None] for f in families} if len(families) > 1 else {families[0]: 1.0}
    family = max(families, key=lambda f: share[f])
    mine = sorted(lang for lang, f in model.family.items() if f == family)
    chance = {a: [p[a, b] if a < b else 1 - p[b, a] for b in mine if b != a] for a in mine}
    best = max(mine, key=lambda a: (sum(q >= 0.5 for q in chance[a]), sum(chance[a])))
    return best, share[family] / sum(share.values()) * (np.mean(chance[best]) if len(mine) > 1 else 1)


def test_features_of_whole_texts_and_long_ones():
    long = "Sch ß! ñandú " * 40_000
    column = pa.array(["", None, "Año  9", "sch", long])
    x = language_id.features(column)
    for i in (0, 2, 3):
        assert np.allclose(x[i], brute_features(column[i].as_py() or ""), atol=1e-6)
    assert not x[1].any()
    assert np.allclose(x[4], brute_features("Sch ß! ñandú " * 400), atol=5e-3) and abs(np.linalg.norm(x[4]) - 1) < 1e-5


def test_languages_within_learned_and_named_families(spark):
    model = language_id.fit(spark.createDataFrame(rows(80, 1), "text string, lang string"), families={"romance": ["es", "pt"], "germanic": ["de", "nl"], "bantu": ["zz"]})
    assert model.family == {"es": "romance", "pt": "romance", "de": "germanic", "nl": "germanic", "zz": "bantu", "zy": "bantu"}
    assert len(model.machines) == 3 + 3
    held = rows(40, 2)
    got = language_id.predicted(spark.createDataFrame(held, "text string, lang string"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    by_text = {r.text: r for r in language_id.predicted(spark.createDataFrame(held, "text string, lang string"), model, keep=["text"]).collect()}
    for text, _ in held[::7]:
        lang, score = brute_predicted(model, brute_features(text))
        assert by_text[text].lang_pred == lang and abs(by_text[text].score - score) < 1e-4


def test_odd_rows(spark):
    none = language_id.fit(spark.createDataFrame([], "text string, lang string"))
    one = language_id.fit(spark.createDataFrame([("hello you", "en"), (None, "de"), ("42", "de"), ("x", None)], "text string, lang string"))
    asked = spark.createDataFrame([(1, "hello", "a", 0.5), (2, None, "b", 0.5), (3, "", "c", 0.5), (4, "12!", "d", 0.5), (4, "12!", "d", 0.5), (5, "ü", "e", 0.5)], "id int, text string, lang_pred string, score double")
    assert sorted((r.id, r.lang_pred, r.score) for r in language_id.predicted(asked, one).collect()) == [(1, "en", 1), (2, "und", 0), (3, "und", 0), (4, "und", 0), (4, "und", 0), (5, "en", 1)]
    assert {r.lang_pred for r in language_id.predicted(asked, none).collect()} == {"und"}
    assert language_id.predicted(asked.limit(0), one).count() == 0


def test_the_sample_is_bounded_and_does_not_depend_on_order(spark):
    df = spark.createDataFrame(rows(60, 3) * 2, "text string, lang string")
    a = {(r.lang, r.r, tuple(r["at"])) for r in language_id.sampled(df, "text", "lang", 25).collect()}
    b = {(r.lang, r.r, tuple(r["at"])) for r in language_id.sampled(df.orderBy("text").repartition(7), "text", "lang", 25).collect()}
    assert a == b and len(a) == 25 * len(VOICES)
