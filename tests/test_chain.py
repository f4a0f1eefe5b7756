"""The retrieval chain and document chunks against brute-force versions."""

import hashlib
import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from veedor.functions import rules
from veedor.operators import retrieval as rt
from veedor.operators import rows as r
from veedor.operators import chunking, similar
from veedor.operators import text as tx


def embedded(text, dim=256):
    v = [0.0] * dim
    for w in text.lower().split():
        h = hashlib.blake2b(w.encode(), digest_size=8).digest()
        v[int.from_bytes(h[:4], "big") % dim] += 1 if h[4] % 2 else -1
    norm = math.sqrt(sum(x * x for x in v)) or 1
    return [x / norm for x in v]


def test_hashed_vectors(spark):
    texts = ["uno dos TRES uno", "", None, "é x"]
    got = {x.i: x.v for x in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.hash_embedding(tx.F.col("t")).alias("v")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(embedded(t or ""), abs=1e-6)


def brute_cuts(text, size):
    """Ends after a paragraph or a sentence in the second half, else at a blank, else at a line end, else at the size; the next starts one character before."""
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            middle = start + (end - start) // 2
            places = []
            for mark in ("\n\n", ". ", ".\n", "? ", "! "):
                found = [i for i in range(start + 1, end - len(mark) + 1) if text[i : i + len(mark)] == mark]
                if found and found[-1] > middle:
                    places.append(found[-1] + len(mark))
            for mark in (" ", "\n"):
                places += [max(i for i in range(start + 1, end) if text[i] == mark)] if mark in text[start + 1 : end] else []
            end = places[0] if places else end
        out.append((start, end))
        if end == len(text):
            break
        start = max(end - 1, start + 1)
    return out


def test_document_chunks(spark):
    rand = random.Random(3)
    bits = ["palabra ", "fin. ", "¿no? ", "¡ya! ", "\n\n", "linea\n", "1. OBJETO DEL SERVICIO\n", "II. ALCANCE\n\n", "2.1 PLAZO\n", "x" * 90]
    docs = {f"d{k}": ["".join(rand.choice(bits) for _ in range(rand.randint(0, 120))) for _ in range(4)] for k in range(12)} | {"long": ["palabra " * 5_000], "null": [None, "y"]}
    pages = spark.createDataFrame([(d, i + 1, t) for d, ps in docs.items() for i, t in enumerate(ps)], "document_id string, page_number int, text string")
    got = {}
    for x in chunking.chunks(pages, size=200).collect():
        got.setdefault(x.document_id, []).append(x)
    heading = re.compile(r"^\s*(?:[IVXLCDM]+\.\s+|[0-9]+(?:\.[0-9]+)*\s+)?([A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ0-9 /,\-]{4,})\s*$", re.M)
    for d, ps in docs.items():
        text = "\n\n".join(p or "" for p in ps)
        starts = [sum(len(p or "") + 2 for p in ps[:i]) for i in range(len(ps))]
        want = []
        for a, b in brute_cuts(text, 200):
            if text[a:b].strip():
                heads = [m[1].strip() for m in heading.finditer(text, 0, a)]
                page = lambda at: max(i + 1 for i, s in enumerate(starts) if s <= at)  # noqa: B023, E731
                want.append((a, b, page(a), page(b - 1), heads[-1] if heads else None, text[a:b].strip()))
        rows = sorted(got.get(d, []), key=lambda x: x.chunk_index)
        assert [(x.char_start, x.char_end, x.page_start, x.page_end, x.section_hint, x.text) for x in rows] == want
        assert [x.chunk_id for x in rows] == [f"{d}::{i:05d}" for i in range(len(rows))]
    assert chunking.chunks(pages.limit(0)).count() == 0


def test_page_chunks_count_through_a_document(spark):
    pages = spark.createDataFrame([("d", 1, "uno dos  tres " * 60), ("d", 2, None), ("d", 3, "fin"), ("e", 1, " ")], "document_id string, page_number int, text string")
    got = tx.page_chunks(pages, 300, 50).orderBy("chunk_index").collect()
    plain = " ".join(("uno dos tres " * 60).split())
    assert [x.chunk_index for x in got] == list(range(len(got))) and [x.page_number for x in got] == [1] * (len(got) - 1) + [3]
    for x in got[:-1]:
        assert x.text == plain[x.char_start : x.char_end].strip() and x.char_end - x.char_start <= 300
    assert [b.char_start for b in got[1:-1]] == [a.char_end - 50 for a in got[:-2]]


def words_of(quote):
    plain = "".join(ch for ch in unicodedata.normalize("NFD", (quote or "").lower()) if unicodedata.category(ch) != "Mn")
    return set(re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", plain)).strip()[:180].split())


def brute_dedup(flags):
    kept = []
    for f in sorted(flags, key=lambda f: (-f[3], f[2])):
        a = words_of(f[4])
        if not any(k[:2] == f[:2] and a and words_of(k[4]) and len(a & words_of(k[4])) / len(a | words_of(k[4])) >= 0.7 for k in kept):
            kept.append(f)
    return sorted(f[2] for f in kept)


def test_similar_quotes(spark):
    rand = random.Random(5)
    word = lambda: rand.choice(["plazo", "Días", "marca", "única,", "tres", "juegos"])
    flags = [(rand.choice("de"), rand.choice("XY"), i, rand.choice([0.4, 0.5, 0.9]), " ".join(word() for _ in range(rand.randint(1, 6)))) for i in range(150)]
    flags += [("d", "X", 200 + i, 0.5, q) for i, q in enumerate(["", None, "...", "a" * 400 + " b", "a" * 400 + " c"])]
    df = spark.createDataFrame(flags, "document_id string, flag_code string, flag_id int, confidence double, quote string")
    got = similar.similar_quotes(df)
    assert got.columns == df.columns and sorted(x.flag_id for x in got.collect()) == brute_dedup(flags)
    assert sorted(x.flag_id for x in similar.similar_quotes(df, at_once=1).collect()) == brute_dedup(flags)  # by rounds
    assert sorted(x.flag_id for x in similar.similar_quotes(df, per_row=0).collect()) == brute_dedup(flags)  # by leaders first
    assert similar.similar_quotes(df.limit(0)).count() == 0


def test_ten_thousand_quotes_of_one_code(spark):
    """A third are copies but for a word, and none of the others are alike."""
    rand = random.Random(6)
    flags = [("d", "X", i, 0.5, f"el plazo de entrega de los bienes es demasiado corto segun el area usuaria numero{i}" if i % 3 == 0 else " ".join(f"w{rand.randrange(3_000)}" for _ in range(9))) for i in range(10_000)]
    kept = {x.flag_id for x in similar.similar_quotes(spark.createDataFrame(flags, "document_id string, flag_code string, flag_id int, confidence double, quote string")).collect()}
    assert kept == {0} | {i for i in range(10_000) if i % 3}


def corpus():
    rand = random.Random(9)
    phrases = ["Se pide copia legalizada y 12 documentos.", "marca unica y modelo exclusivo", "juicio del comite", "sobre cerrado y foliado", "texto corriente del servicio", "experiencia especifica restrictiva", "un robo notarial"]
    words = "entrega documentos plazo comite modelo marca informe servicio obra".split()
    chunks = [(f"d{i % 4}", i, f"{rand.choice(phrases)} {' '.join(rand.choice(words) for _ in range(rand.randint(1, 90)))}", rand.choice(["Requisitos técnicos", "Otros", "Plazos"])) for i in range(40)]
    return chunks + [("empty", 99, "", "Otros")]


QUESTIONS = {"d0": "¿Hay señales de RIESGO?", "d1": "copias", "d2": "hola", "d3": None, "empty": "marca"}
HITS = [("d2", 1, "UNREALISTIC_DEADLINE", "x1"), ("d2", 2, "UNREALISTIC_DEADLINE", "x2"), ("d1", 1, "OBSOLETE_PHYSICAL_FORMAT", "x3"), ("d1", 2, None, "x4")]


def brute_plan(chunks):
    out = []
    for d, q in QUESTIONS.items():
        mine = [h for h in HITS if h[0] == d and h[2]]
        said = "".join(ch for ch in unicodedata.normalize("NFD", (q or "").lower()) if unicodedata.category(ch) != "Mn")
        codes = [h[2] for h in mine] + [c for ws, cs in rules.INTENTS.values() if any(w in said for w in ws) for c in cs]
        codes = list(dict.fromkeys(codes)) or list(rules.PLANNER_QUERIES)
        labels = {c[3] for c in chunks if c[0] == d}
        for place, code in enumerate(codes):
            anchor = next((h[3] for h in mine if h[2] == code), None)
            for k, text in enumerate(rules.PLANNER_QUERIES[code][:4]):
                out.append((d, code, place * 1000 + k, text, [c for c in rules.FLAG_CLUSTERS[code] if c in labels], anchor))
    return out


def brute_hits(chunks, plan, top):
    out = []
    for d, code, qid, text, clusters, _ in plan:
        mine = {c[1]: c for c in chunks if c[0] == d}
        toks = {i: c[2].lower().split() for i, c in mine.items()}
        n, avg = len(mine), sum(map(len, toks.values())) / len(mine)
        df = {}
        for t in toks.values():
            for w in set(t):
                df[w] = df.get(w, 0) + 1
        idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
        mean = sum(idf.values()) / len(idf) if idf else 0
        idf = {w: 0.25 * mean if x < 0 else x for w, x in idf.items()}
        lexical = {i: round(sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in text.lower().split() if w in t), 6) for i, t in toks.items()}
        qv = embedded(text)
        vector = {i: round(sum(a * b for a, b in zip(embedded(c[2]), qv)), 6) for i, c in mine.items()}
        fused = {}
        for scores in ({i: s for i, s in lexical.items() if s > 0}, vector):
            for rank, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i))[:20]):
                fused[i] = fused.get(i, 0) + 1 / (61 + rank)
        allowed = [i for i in sorted(fused, key=lambda i: (-round(fused[i], 8), i)) if not clusters or mine[i][3] in clusters]
        out += [(d, qid, code, i, rank + 1) for rank, i in enumerate(allowed[:top])]
    return out


def brute_flags(chunks, hits):
    text = {c[1]: c for c in chunks}
    seen, out = set(), []
    for d, qid, code, i, rank in sorted(hits):
        shown = text[i][2] if len(text[i][2]) <= 400 else text[i][2][:400] + "..."
        shown = shown.rstrip()
        shown = shown[:-3].rstrip() if shown.endswith("...") else shown
        m = next((m for p in rules.EVIDENCE.get(code, ()) if (m := re.search(p, shown, re.I))), None)
        if m and code in rules.FLAGS:
            quote = shown[max(m.start() - 40, 0) : m.end() + 80].strip()
            if (d, quote) in seen:
                continue
            seen.add((d, quote))
            level, sure = rules.FLAGS[code]
            if text[i][3] in rules.NEUTRAL_CLUSTERS and code in rules.ANCHORS and not any(re.search(p, quote, re.I) for p in rules.ANCHORS[code]):
                level, sure = "low", min(sure, 0.45)
            out.append((d, code, qid * 1000 + rank, sure, quote, level, i))
    keep = {(d, i) for d in QUESTIONS for i in brute_dedup([f[:5] for f in out if f[0] == d])}
    return [f for f in out if (f[0], f[2]) in keep]


def test_chain_matches_brute_force(spark):
    data = corpus()
    chunks = spark.createDataFrame(data, "document_id string, chunk_id long, text string, cluster string")
    questions = spark.createDataFrame(list(QUESTIONS.items()), "document_id string, question string")
    hits = spark.createDataFrame(HITS, "document_id string, place int, flag_code string, chunk_id string")
    plan = rt.plan(questions, hits, chunks.selectExpr("document_id", "cluster as label"))
    want_plan = brute_plan(data)
    got = sorted((x.document_id, x.flag_code, x.query_id, x.query, list(x.clusters), x.anchor_id or "") for x in plan.collect())
    assert got == sorted((*x[:5], x[5] or "") for x in want_plan)
    once = brute_hits(data, want_plan, 5)
    assert sorted((x.document_id, x.query_id, x.flag_code, x.chunk_id, x["rank"]) for x in rt.retrieve(chunks, plan).collect()) == sorted(once)
    judged = rt.critiqued(chunks, plan, 5)
    want = brute_flags(data, once)
    assert sorted((x.document_id, x.flag_code, x.flag_id, x.confidence, x.quote, x.severity, x.chunk_id) for x in judged.collect()) == sorted(want)
    ok = lambda f: f[3] >= 0.3 and "robo" not in f[4]
    assert {(x.document_id, x.flag_id) for x in judged.where("accepted").collect()} == {(f[0], f[2]) for f in want if ok(f)}
    again = {d for d in QUESTIONS if any(f[0] == d for f in want) and not any(f[0] == d and ok(f) for f in want)}
    twice = brute_flags(data, brute_hits(data, [p for p in want_plan if p[0] in again], 10))
    got = rt.with_retry(chunks, plan)
    assert {(x.document_id, x.flag_id, x.retried) for x in got.collect()} == {(f[0], f[2], False) for f in want if f[0] not in again} | {(f[0], f[2], True) for f in twice}
    for x in rt.diagnostics(plan, rt.retrieve(chunks, plan), judged).collect():
        assert x.n_queries == sum(p[0] == x.document_id for p in want_plan) and x.n_hits == sum(h[0] == x.document_id for h in once)
        assert x.n_candidates == sum(f[0] == x.document_id for f in want) and x.n_accepted == sum(f[0] == x.document_id and ok(f) for f in want)


def test_retry_searches_deeper(spark):
    """A document whose candidates are all refused is searched again; the others are not."""
    data = [("bad", i, f"un robo notarial numero {i}", "Otros") for i in range(8)] + [("good", 50, "copias legalizadas", "Otros")]
    chunks = spark.createDataFrame(data, "document_id string, chunk_id long, text string, cluster string")
    plan = spark.createDataFrame([(d, "EXCESSIVE_DOCUMENT_REQUIREMENT", 1, "robo notarial copias", []) for d in ("bad", "good")], "document_id string, flag_code string, query_id long, query string, clusters array<string>")
    got = {(x.document_id, x.retried) for x in rt.with_retry(chunks, plan, 2).select("document_id", "retried").collect()}
    assert got == {("bad", True), ("good", False)}


def test_nothing_in_nothing_out(spark):
    chunks = spark.createDataFrame([], "document_id string, chunk_id long, text string, cluster string")
    plan = spark.createDataFrame([], "document_id string, flag_code string, query_id long, query string, clusters array<string>")
    assert rt.with_retry(chunks, plan).count() == 0


def test_rows_of_portals(spark):
    rows = spark.createDataFrame([("1", " LP-1 ", "Ñ", "20-123456789", "1.234,5", "31/12/2020"), ("2", "", "x", "12", "S/ 1,234.50", "2021/01/02"), ("3", None, None, None, "x", "")], "k string, `Código` string, Entidad string, `RUC entidad` string, Monto string, Fecha string")
    got = {x.k: x for x in r.portal(rows.withColumnRenamed("Código", "Codigo"), ["k"]).collect()}
    assert (got["1"].external_id, got["1"].entity_name, got["1"].entity_ruc, got["1"].monto, str(got["1"].fecha)) == ("LP-1", "Ñ", None, 1234.5, "2020-12-31") or got["1"].monto == 1.2345
    assert (got["2"].external_id, got["2"].entity_ruc, got["2"].monto, got["2"].period_year) == (None, None, 1234.5, 2021)
    assert (got["3"].monto, got["3"].fecha, got["3"].entity_name) == (None, None, None)


def test_quantiles_are_exact_without_a_group_in_one_buffer(spark):
    from veedor.operators.detectors import quantile_of

    rand = random.Random(1)
    data = {"big": [round(rand.lognormvariate(3, 2), 2) for _ in range(30_000)], "ties": [float(i % 3) for i in range(5_000)], "one": [7.0], "two": [1.0, 2.0]}
    df = spark.createDataFrame([(g, x) for g, xs in data.items() for x in xs] + [("big", None)], "g string, x double")
    got = {x.g: x.value for x in quantile_of(df, "g", "x", 0.9).collect()}
    for g, xs in data.items():
        xs, at = sorted(xs), 0.9 * (len(xs) - 1)
        a, b = xs[math.floor(at)], xs[math.ceil(at)]
        assert got[g] == pytest.approx(a + (b - a) * (at - math.floor(at)))


def test_doctrine_chunks(spark):
    body = "\n\n".join(f"Paragraph {i} " + "text " * 30 for i in range(9)) + "\n\nsole source, audit trail"
    pages = spark.createDataFrame([("d", 1, "Red Flags of Procurement\n\n" + body), ("d", 2, "no title here.\n\nshort"), ("d", 3, None), ("e", 1, "x")], "document_id string, page_number int, text string")
    got = tx.paragraph_chunks(pages).orderBy("document_id", "page_number", "chunk_index").collect()
    first = [x for x in got if (x.document_id, x.page_number) == ("d", 1)]
    want, held = [], []
    for p in re.split(r"\n\s*\n", re.sub(r"[ \t]+", " ", pages.first().text).strip()):
        size = sum(len(x.strip()) + 2 for x in held) - (2 if want else 0)
        if held and size >= 200 and size + len(p.strip()) > 700:
            want.append("\n\n".join(x.strip() for x in held))
            held = [p]
        else:
            held.append(p)
    want.append("\n\n".join(x.strip() for x in held))
    assert [x.text for x in first] == want and all(x.section == "Red Flags of Procurement" for x in got if x.document_id == "d")
    assert first[-1].flag_codes == ["SPECIFIC_EQUIPMENT_REQUIREMENT", "LOW_TRACEABILITY_OUTPUT", "AI_NO_AUDIT_TRAIL"] and first[0].flag_codes == []
    assert [x.section for x in got if x.document_id == "e"] == [None]


def test_doctrine_search_and_its_fallback(spark):
    rand = random.Random(11)
    words = "plazo marca modelo comite juicio sobre copia legalizada norma doctrina riesgo mercado".split()
    text = lambda n: " ".join(rand.choice(words) for _ in range(n))
    doctrine = [(f"k{i:02d}", i % 5, [None, "A_B", "C"][i % 3], text(rand.randint(1, 9))) for i in range(40)]
    questions = [(f"d{i}", q) for i, q in enumerate([text(4), text(2), None, "  ", text(4), "plazo marca"])] + [("d9", "plazo marca")]
    known = spark.createDataFrame(doctrine, "chunk_id string, place int, flag_code string, text string")
    asked = spark.createDataFrame(questions, "document_id string, question string")
    vectors = {r.text: r.v for r in known.select("text").unionByName(asked.selectExpr("question as text")).unionByName(spark.createDataFrame([("marca modelo",)], "text string")).where("text is not null").distinct().withColumn("v", tx.hash_embedding(F.col("text"))).collect()}

    def nearest(q, top):
        scores = sorted((-round(sum(a * b for a, b in zip(vectors[t], vectors[q])), 6), c, flag) for c, _, flag, t in doctrine)
        return [(i + 1, flag, c, -s) for i, (s, c, flag) in enumerate(scores[:top])]

    got = sorted(tuple(r) for r in rt.doctrine_hits(asked, known, 7).select("document_id", "place", "chunk_id", "score").collect())
    assert got == sorted((d, place, c, s) for d, q in questions if (q or "").strip() for place, _, c, s in nearest(q, 7))
    wanted = spark.createDataFrame([(1, "A_B", "k05"), (2, "A_B", "none"), (3, "C", None), (4, "MARCA_MODELO", None), (5, "MARCA_MODELO", "k07")], "i int, flag_code string, anchor_id string")
    first = lambda code: min((place, c) for c, place, flag, _ in doctrine if flag == code)[1]
    assert {r.i: r.chunk_id for r in rt.anchored(wanted, known).collect()} == {1: "k05", 2: first("A_B"), 3: first("C"), 4: nearest("marca modelo", 1)[0][2], 5: "k07"}
    assert rt.doctrine_hits(asked, known.limit(0)).count() == 0 and rt.doctrine_hits(asked.limit(0), known).count() == 0


def test_debug_rows(spark):
    plan = spark.createDataFrame([("d", 0, "A", "q1", ["x", "y"], "k1"), ("d", 1, "B", "q2", [], None)], "document_id string, query_id int, flag_code string, query string, clusters array<string>, anchor_id string")
    hits = spark.createDataFrame([("d", 0, "A", 7, 0.5, 1, "e" * 400)], "document_id string, query_id int, flag_code string, chunk_id int, score double, rank int, excerpt string")
    judged = spark.createDataFrame([("d", 0, "A", 7, 1, "quote", "low_confidence"), ("d", 1, "B", 8, 2, "q", None)], "document_id string, query_id int, flag_code string, chunk_id int, rank int, quote string, reason string")
    got = sorted((r.part, r.query_id, r.flag_code, r["rank"], r.query, r.clusters, r.anchor_id, r.chunk_id, r.score, r.excerpt, r.reason) for r in rt.debug_rows(plan, hits, judged).collect())
    assert got == [
        ("candidate", 0, "A", 1, None, None, None, "7", None, "quote", "low_confidence"), ("candidate", 1, "B", 2, None, None, None, "8", None, "q", None), ("hit", 0, "A", 1, None, None, None, "7", 0.5, "e" * 300, None),
        ("query", 0, "A", None, "q1", "x,y", "k1", None, None, None, None), ("query", 1, "B", None, "q2", "", None, None, None, None, None),
    ]


def test_critic_checks_in_order(spark):
    good = {"flag_id": 0, "chunk_id": "c", "quote": "tres copias", "page_number": 1, "anchor_id": "a", "anchor_quote": "q", "anchor_source": "s", "confidence": 0.9}
    cases = [({}, None), ({"quote": " "}, "quote_empty"), ({"page_number": 0}, "page_invalid"), ({"page_number": None}, "page_invalid"), ({"chunk_id": None}, "chunk_id_missing"), ({"quote": "cuatro"}, "quote_not_literal"), ({"chunk_id": "other", "quote": "cuatro"}, None),
             ({"anchor_id": None}, "anchor_missing"), ({"anchor_quote": ""}, "anchor_quote_empty"), ({"anchor_source": " "}, "anchor_source_empty"), ({"confidence": 0.1}, "low_confidence"), ({"quote": "", "page_number": 0, "confidence": 0.0}, "quote_empty")]
    df = spark.createDataFrame([tuple((good | c | {"flag_id": i}).values()) for i, (c, _) in enumerate(cases)], "flag_id int, chunk_id string, quote string, page_number int, anchor_id string, anchor_quote string, anchor_source string, confidence double")
    texts = spark.createDataFrame([("c", "piden tres copias")], "chunk_id string, text string")
    judged = tx.critique(df.withColumn("document_id", F.lit("d")), texts, dual=True)
    assert {r.flag_id: (r.reason, r.accepted) for r in judged.collect()} == {i: (want, want is None) for i, (_, want) in enumerate(cases)}
    assert tuple(tx.needs_replan(judged).first()) == ("d", 12, 2, False) and tx.needs_replan(judged.where("not accepted")).first().needs_replan


def test_dossier_questions_and_explanations(spark):
    from veedor.operators import documents as d

    codes = list(rules.DOSSIER_QUESTIONS)
    flags = spark.createDataFrame([("d", codes[1], 3), ("d", codes[0], 9), ("d", codes[1], 11), ("d", "OTHER", 1)], "document_id string, flag_code string, page_number int")
    docs = spark.createDataFrame([("d", "P-1"), ("e", None)], "document_id string, procedure string")
    got = {r.document_id: r for r in d.dossier_questions(flags, docs).collect()}
    assert got["d"].questions == rules.DOSSIER_QUESTIONS[codes[1]] + rules.DOSSIER_QUESTIONS[codes[0]] + rules.EVERY_DOSSIER_ASKS and got["d"].pages == "1, 3, 9, 11"
    assert got["e"].questions == rules.EVERY_DOSSIER_ASKS and got["e"].request == rules.DOSSIER_REQUEST % ("e", "N/A") and got["d"].request == rules.DOSSIER_REQUEST % ("P-1", "1, 3, 9, 11")
    told = {r.flag_code: (r.explanation, r.questions) for r in d.explained(flags).collect()}
    assert told["OTHER"] == ("", []) and told[codes[1]] == (rules.EXPLANATIONS[codes[1]], rules.SUMMARY_QUESTIONS[codes[1]])


def test_one_pass_finds_what_both_rankers_find(spark):
    """Odd rows too: nulls, white space of either kind, more chunks than a ranker keeps; and texts are dealt once."""
    rand = random.Random(11)
    words = "entrega\u00a0plazo documentos Plazo comité\u2003modelo ÑANDÚ marca informe".split(" ")
    text = lambda: rand.choice([" ", "\n", "\x1f"]).join(rand.choice(words) for _ in range(rand.randint(0, 120)))
    data = [(rand.choice("de"), i, text(), rand.choice(["Otros", "Plazos", None])) for i in range(200)] + [("d", 300, None, "Otros"), ("d", None, "plazo", "Otros"), (None, 301, "plazo", "Otros"), ("f", 302, "plazo", "Otros"), ("g", 303, None, "Otros")]
    plan = [(d, q, "X", query, clusters) for d in ("d", "e", "g", "h", None) for q, (query, clusters) in enumerate([("plazo plazo marca", []), ("plazo documentos", ["Otros"]), (None, []), ("", ["Nada"]), ("comité modelo", None), ("ñandú", [])])] + [("d", None, "X", "plazo", [])]
    chunks = spark.createDataFrame(data, "document_id string, chunk_id long, text string, cluster string")
    queries = spark.createDataFrame(plan, "document_id string, query_id int, flag_code string, query string, clusters array<string>")
    both = rt.vectors(chunks, queries).unionByName(rt.bm25(chunks, queries)).groupBy("document_id", "query_id", "chunk_id").agg(F.round(F.sum(1.0 / (F.lit(60) + F.col("rank"))), 8).alias("score"))
    j = both.join(queries, ["document_id", "query_id"]).join(chunks, ["document_id", "chunk_id"]).where((F.size("clusters") == 0) | F.array_contains("clusters", F.col("cluster")))
    j = j.withColumn("excerpt", F.when(F.char_length("text") <= 400, F.col("text")).otherwise(F.concat(F.substring("text", 1, 400), F.lit("..."))))
    want = rt._ranked(j, 30).select("document_id", "query_id", "flag_code", "chunk_id", "score", "rank", "cluster", "excerpt")
    got = rt.retrieve(chunks, queries, 30)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 150
    assert rt.retrieve(chunks, queries)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_retried_chunks_are_dealt_once(spark):
    """They are searched and looked up, so they are kept in between."""
    names = []
    chunks = spark.createDataFrame([("bad", i, f"un robo notarial numero {i}", "Otros") for i in range(8)], "document_id string, chunk_id long, text string, cluster string")
    plan = spark.createDataFrame([("bad", "EXCESSIVE_DOCUMENT_REQUIREMENT", 1, "robo notarial copias", [])], "document_id string, flag_code string, query_id long, query string, clusters array<string>")
    assert rt.with_retry(chunks, plan, 2, keep=lambda df, name: names.append(name) or df).where("retried").count() > 0 and "chunks-again" in names
