"""Spanish stems against listed ones, and searches of the inverted index against brute force."""

import random
import re

import pytest

from veedor.functions.spanish import STOP, stem
from veedor.operators import fulltext as ft

#: From the published sample vocabulary of the algorithm.
STEMS = {
    "che": "che", "checa": "chec", "checar": "chec", "checo": "chec", "checoslovaquia": "checoslovaqui", "chedraoui": "chedraoui", "chefs": "chefs", "cheliabinsk": "cheliabinsk", "chelo": "chel", "chemical": "chemical",
    "cheque": "chequ", "cheques": "chequ", "cheraw": "cheraw", "chesca": "chesc", "chester": "chest", "chetumal": "chetumal", "chica": "chic", "chicago": "chicag", "chicas": "chic", "chicharrones": "chicharron", "chico": "chic",
    "torre": "torr", "torreón": "torreon", "torres": "torr", "torso": "tors", "torturados": "tortur", "tos": "tos", "toser": "tos", "total": "total", "totalidad": "total", "totalmente": "total", "toxicidad": "toxic", "tóxico": "toxic",
    "tóxicos": "toxic", "trabaja": "trabaj", "trabajaba": "trabaj", "trabajadores": "trabaj", "trabajando": "trabaj", "trabajar": "trabaj", "trabajo": "trabaj", "haciéndola": "hac", "biología": "biolog", "solución": "solucion", "institución": "institu", "preferencia": "preferent",
    "rápidamente": "rapid", "lentamente": "lent", "activamente": "activ", "responsabilidad": "respons", "llegue": "lleg", "lleguemos": "lleg", "averigüéis": "averigü", "construyeron": "constru", "": "", "a": "a", "ñ": "ñ",
}


@pytest.mark.parametrize("word", STEMS)
def test_stem(word):
    assert stem(word) == STEMS[word]


def brute(docs, queries):
    lex = lambda text: [(i, stem(w)) for i, w in enumerate(re.findall(r"\w+", (text or "").lower().replace("_", " "))) if w not in STOP]
    out = set()
    for q, mode, text in queries:
        asked = lex(text)
        for d, body in docs:
            held = lex(body)
            counts = {w: sum(x == w for _, x in held) for _, w in asked}
            places = set(held)
            starts = {i - j for i, x in held for j, w in asked if x == w}
            n = {"all": sum(counts.values()) if asked and all(counts.values()) else 0, "any": sum(counts.values()), "phrase": sum(bool(asked) and all((s + j, w) in places for j, w in asked) for s in starts)}.get(mode, 0)
            if n:
                out.add((q, d, n))
    return out


def test_searches_against_brute_force(spark, tmp_path, monkeypatch):
    rand = random.Random(4)
    words = "la licitación licitaciones de contrato contratos contratar y plazo plazos obra obras público pública 12".split()
    text = lambda n: rand.choice([" ", ", ", "\n"]).join(rand.choice(words).title() if rand.random() < 0.2 else rand.choice(words) for _ in range(n))
    docs = [(i, text(rand.randint(0, 40))) for i in range(60)] + [(99, None), (100, "")]
    queries = [(i, ["all", "any", "phrase", "?"][i % 4], text(rand.randint(0, 4))) for i in range(60)] + [(200, "all", "la de y"), (201, "phrase", None)]
    monkeypatch.setattr(ft, "BLOCK", 7)
    index = ft.build(spark.createDataFrame(docs, "document_id long, text string"), str(tmp_path / "index"))
    asked = spark.createDataFrame(queries, "query_id long, mode string, text string")
    want = brute(docs, queries)
    assert {tuple(r) for r in ft.search(index, asked).collect()} == want and len(want) > 200
    monkeypatch.setattr(ft, "PUSHED", 2)
    assert {tuple(r) for r in ft.search(index, asked).collect()} == want
    assert ft.search(index, asked.limit(0)).count() == 0


def test_empty_index_and_repeated_words(spark, tmp_path):
    none = ft.build(spark.createDataFrame([], "document_id long, text string"), str(tmp_path / "none"))
    asked = spark.createDataFrame([(1, "any", "obra")], "query_id long, mode string, text string")
    assert ft.search(none, asked).count() == 0
    one = ft.build(spark.createDataFrame([(5, "obra " * 10_000)], "document_id long, text string"), str(tmp_path / "one"))
    assert one.count() == 3 and [tuple(r) for r in ft.search(one, asked).collect()] == [(1, 5, 10_000)]
    twice = spark.createDataFrame([(1, "phrase", "obra obra")], "query_id long, mode string, text string")
    assert [tuple(r) for r in ft.search(one, twice).collect()] == [(1, 5, 9_999)]


def test_postings_of_a_document_need_no_shuffle(spark):
    """All positions of a document are put together where its row lies, blocks too; each different word is stemmed once a task."""
    docs = spark.createDataFrame([(1, "Torres de la torre; torres " + "río " * 5000), (2, None), (3, "")], "document_id long, text string")
    rows = ft.postings(docs)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {(r.lexeme, r.document_id, r.block): r.positions for r in rows.collect()}
    assert got == {(stem("torre"), 1, 0): [0, 3, 4], (stem("río"), 1, 0): list(range(5, 4096)), (stem("río"), 1, 1): list(range(4096, 5005))}
