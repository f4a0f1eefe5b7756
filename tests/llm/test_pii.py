import hashlib
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veedor.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            odd = [int(d) for d in digits[::-1]]
            total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(odd))
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and total % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((k, *m.span()))
    return out


def secrets(text):
    """Assignments to a key's name of 16 or more signs with a letter and a digit."""
    out = []
    for m in re.finditer(r"(?i)(?<![a-z0-9])(api_key|token|password) {0,3}[:=] {0,3}[\"']?([a-z0-9+/_.=~-]{16,})[\"']?", text):
        if re.search("[0-9]", m[2]) and re.search("[a-z]", m[2], re.I):
            out.append((4, *m.span()))
    return out


def replaced(text, spans):
    """The text sign by sign: the first sign of a span says what it was."""
    out, at = "", 0
    for k, a, b in sorted(spans, key=lambda x: x[1:]):
        if b > at:
            said = f"[{pii.KINDS[k].upper()}]" if k < 5 else "[NUMBER]" if text[a:b].strip(".,;:").isdigit() else "[NAME]" if text[a].isupper() else "[WORD]"
            out, at = out + text[at:a] + (said if k < 6 else ""), b
    return out + text[at:]


def test_credentials():
    for text in ['x token = "04dbebab91ab85687d33" y', "API_KEY: abcdefghij0123456789", "password=short1", "a token = aaaaaaaaaaaaaaaaaaaaaaa", "tokens = 04dbebab91ab85687d33", "the token: 04dbebab91ab85687d33, é token='A1b2C3d4E5f6G7h8'"]:
        assert pii.secret_spans(text) == secrets(text)
    assert pii.protected(4, 'Token = "04db"') == ['secret:token = "04db"', "secret~token"]
    assert pii.secret_spans("token=" * 100_000) == [] and pii.secret_spans("token " * 100_000) == []


def test_base_spans_match_the_patterns():
    @settings(max_examples=1500, deadline=None)
    @given(st.text("ab@.1250+-() %_é,\n4", max_size=60))
    def run(text):
        assert pii.base_spans(text) == plain(text)

    run()
    for text in ["a@b.c@d.e", "x@@y.z", "1.2.3.4.5.6.7.8", "999.1.1.1.1", "4111 1111-1111 1111", "+1 (269) 555-3296 x", "a@b..c", "00001.2.3.4", "é@b.c a.b@c.d."]:
        assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "a.b@" * 80_000, "+1" * 100_000, "1." * 100_000, "+1(" * 80_000])
def test_long_texts_take_linear_time(text):
    pii.base_spans(text)


def corpus():
    r = random.Random(2)
    plainwords = [f"word{i}" for i in range(30)]
    text = lambda *x: " ".join([*r.choices(plainwords, k=8), *x, *r.choices(plainwords, k=8)])
    rows = [(i, text("surgeon", "ana@hospital.example", "lima") if i % 4 == 0 else text("surgeon") if i % 4 == 1 and i < 30 else text("lima" if i % 3 else "x")) for i in range(80)]
    return rows + [(100, None), (101, ""), (None, "call +51 1 555 0000 or ana@hospital.example"), (4, rows[4][1]), (102, "192.168.0.1 host 4111111111111111"), (103, 'a token = "04dbebab91ab85687d33" Lima b')]


def test_disclosure_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, spans string")
    options = {"window": 3, "support": 3, "generalise": 0.2, "remove": 0.6}
    got = sorted(map(str, map(tuple, pii.report(docs, **options).collect())))
    near, n_t, n_e, n_et = [], {}, {}, {}
    entities = lambda t: plain(t) + secrets(t)
    for _, t in rows:
        t = t or ""
        places = [m.span() for m in re.finditer(r"\S+", t)]
        here = []
        for k, a, b in entities(t):
            own = [i for i, p in enumerate(places) if p[1] > a and p[0] < b]
            every = {i for _, x, y in entities(t) for i, p in enumerate(places) if p[1] > x and p[0] < y}
            for i in [*range(max(0, own[0] - 3), own[0]), *range(own[-1] + 1, min(len(places), own[-1] + 4))]:
                if i not in every:
                    here += [(name, t[slice(*places[i])].lower(), places[i]) for name in pii.protected(k, t[a:b])]
        near.append(here)
        for w in {w.lower() for w in t.split()}:
            n_t[w] = n_t.get(w, 0) + 1
        for e in {e for e, _, _ in here}:
            n_e[e] = n_e.get(e, 0) + 1
        for p in {(e, w) for e, w, _ in here}:
            n_et[p] = n_et.get(p, 0) + 1
    want = []
    for (i, t), here in zip(rows, near):
        best = {}
        for e, w, place in here:
            if n_et[e, w] >= 3:
                d = math.log2(n_et[e, w] * len(rows) / n_t[w] / n_e[e]) / math.log2(len(rows) / n_e[e])
                best[place] = max(best.get(place, 0), d)
        base, secret = plain(t or ""), secrets(t or "")
        extra = sorted((6 if d >= 0.6 else 5, *p) for p, d in best.items() if d >= 0.2)
        say = lambda spans: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        want.append((i, *(sum(k == x for x, _, _ in base) for k in range(4)), hashlib.sha256(say(base).encode()).hexdigest(), say(base + secret + extra), len(secret), len(extra), len(base + secret + extra), hashlib.sha256(replaced(t or "", base + secret + extra).encode()).hexdigest()))
    assert got == sorted(map(str, want))
    assert any("term_general" in x for x in got) and any("term_remove" in x for x in got)


def test_sanitised_text(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitised(docs, window=3, generalise=0.3, remove=0.6).collect()}
    assert len(got) == len({i for i, _ in corpus()})
    assert "[EMAIL]" in got[0] and "@" not in got[0] and "surgeon" not in got[0]
    assert got[102] == "[IP] host [CARD]" and got[100] == "" and got[1] == dict(corpus())[1]
    assert pii.report(docs.limit(0)).count() == 0


def test_an_entity_of_one_text_has_evidence_by_what_it_shares(spark):
    """Each address stands in one text; their domain, and the word that goes with it, in several."""
    rows = [(i, f"filler{i} text acme person{i}@acme.example more filler{i}") for i in range(5)] + [(50 + i, f"filler{i} text other{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert all("acme" not in got[i] and "[EMAIL]" in got[i] for i in range(5)) and all(got[i] == t for i, t in rows if i >= 50)
    assert pii.protected(0, "A.b@X.org") == ["email:a.b@x.org", "email~x.org"] and pii.protected(1, "10.1.2.3")[1] == "ip~10.1.2"


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 400_000 + "a@b.org " + "word " * 10), (2, "x")], "doc_id long, text string")
    assert [(r.doc_id, r.n_email) for r in pii.report(docs).orderBy("doc_id").collect()] == [(1, 1), (2, 0)]


def test_a_long_text_of_many_entities_takes_linear_time_and_bounded_memory():
    """A log of addresses: each has 24 words around it, and most are there once."""
    import time
    import tracemalloc

    import pyarrow as pa
    from pyspark import TaskContext

    class Here:
        partitionId = staticmethod(lambda: 0)  # noqa: N815

    def run(lines):
        text = " ".join(f"10.{i // 65536 % 256}.{i // 256 % 256}.{i % 256} user{i % 97} said ok" for i in range(lines))
        kind = pa.struct([("a", pa.int64()), ("b", pa.int64())])
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([{"a": 1, "b": 2}], kind), pa.array([text])], ["doc_id", "th", "text"])
        tracemalloc.start()
        began, rows = time.process_time(), 0
        for out in pii._found(iter([batch]), 12, pii.TOGETHER):
            rows += out.num_rows
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return len(text), rows, time.process_time() - began, peak

    held = TaskContext._taskContext
    TaskContext._taskContext = Here()
    try:
        half, whole = run(95_000), run(190_000)
    finally:
        TaskContext._taskContext = held
    assert whole[0] > 5_000_000 and whole[1] > 1.9 * half[1]
    assert whole[2] < 3.5 * half[2] + 2 and whole[3] < 500 << 20


def test_a_text_in_pieces_counts_as_one(spark, monkeypatch):
    """With two entities at a time each pair still counts once a text, so spans stay the same."""
    rows = corpus() + [(200 + i, "surgeon ana@hospital.example lima ana@hospital.example surgeon 1.2.3.4 ana@hospital.example x ana@hospital.example") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    options = {"window": 3, "support": 3, "generalise": 0.2, "remove": 0.6}
    want = sorted(map(str, pii.report(docs, **options).collect()))
    monkeypatch.setattr(pii, "TOGETHER", 2)
    assert sorted(map(str, pii.report(docs, **options).collect())) == want
