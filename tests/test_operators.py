"""Operators on small hand-made rows: what the SQL comparison does not reach."""

import datetime

from pyspark.sql import functions as F

from veedor.functions import columns as c
from veedor.functions import rules
from veedor.operators import changes as ch
from veedor.operators import detectors as d
from veedor.operators import chunking, similar
from veedor.operators import text as tx


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_columns(spark):
    assert [one(spark, x, c.amount) for x in ("S/ 1,234.50", "1234,5", "1.5", "abc", None)] == [1234.5, 1234.5, 1.5, None, None]
    assert [one(spark, x, c.date) for x in ("2024-02-14", "14/02/2024", "2024-02-14T10:00:00Z", "20240214", "x", None)] == [datetime.date(2024, 2, 14)] * 4 + [None, None]
    assert [one(spark, x, c.ruc) for x in ("20-123456789", "123", None)] == ["20123456789", None, None]
    assert [one(spark, x, c.sector) for x in ("SEGURO SOCIAL DE SALUD", "AUTORIDAD NACIONAL DEL AGUA (ANA)", "MUNICIPALIDAD DISTRITAL DE MIRAFLORES", None)] == ["salud", "ambiente", "otros", "otros"]
    assert one(spark, "La corrupción y el fraude", c.banned_terms) == ["corrupcion", "fraude"]
    assert one(spark, "co-\nmo  va \n\n\n\nfin ", c.clean_text) == "como va\n\nfin"
    assert [one(spark, x, lambda s: c.bucket(s, *c.SCALES["dossier"]), "int") for x in (0, 14, 15, 30, 60, 100)] == ["SIN_SENALES", "SIN_SENALES", "BAJO", "MEDIO", "ALTO", "CRITICO"]


def test_change_detection_cycle(spark):
    rows = [("1", 10.0, "2024-01-01"), ("2", 20.0, "2024-01-01"), (None, 1.0, "x")]
    snap = lambda r: spark.createDataFrame(r, "key string, monto double, fecha string").withColumn("hash", ch.contract_hash(F.col("key"), F.col("monto"), F.col("fecha"), F.lit(None), F.lit("m")))
    empty = spark.createDataFrame([], "key string, hash string")
    first = ch.detect(snap(rows), empty)
    assert {(r.key, r.change) for r in first.collect()} == {("1", "new"), ("2", "new"), (None, "failed")}
    registry = ch.commit(empty, first.where("change = 'new'"))
    assert {r.change for r in ch.detect(snap(rows[:2]), registry).collect()} == {"unchanged"}
    assert {(r.key, r.change) for r in ch.detect(snap([("1", 11.0, "2024-01-01"), ("2", 20.0, "2024-01-01T05:00")]), registry).collect()} == {("1", "modified"), ("2", "unchanged")}


def contract(i, **more):
    base = {"external_id": f"c{i}", "suppkey": 1, "ruc": "20000000001", "empresa": "A", "estado": "ACTIVO", "condicion": "HABIDO", "entidad_ruc": "e1", "entidad": "E", "cliente_ruc": "k1", "monto": "100.00", "fecha": datetime.date(2024, 1, 1 + i), "anio": 2024, "modalidad": "Directa", "region": "LIMA", "ubigeo": "150101", "inicio": datetime.date(2024, 1, 1), "max_trabajadores": 1, "tipo": "SAC"}
    return base | more


def frame(spark, rows):
    return spark.createDataFrame(rows).withColumn("monto", F.col("monto").cast("decimal(18,2)"))


def test_detectors_at_their_thresholds(spark):
    won = frame(spark, [contract(i) for i in range(3)])
    assert d.split_contracts(won, days=2).count() == 1 and d.split_contracts(won, days=1).count() == 0
    assert d.captive_client(won, min_contracts=3).first().pct_concentrado == 100.0 and d.captive_client(won, min_contracts=4).count() == 0
    assert d.inactive_supplier(won).count() == 0 and d.inactive_supplier(won.withColumn("condicion", F.lit("NO HABIDO"))).first().n_contratos == 3
    assert d.new_company(won, min_amount=99).first().dias_min == 0 and d.new_company(won, min_amount=100).count() == 0
    assert d.amount_outlier(won).count() == 0  # no deviation, no baseline


def test_shared_key_counts_pairs(spark):
    won = frame(spark, [contract(0), contract(1), contract(2, suppkey=2, ruc="20000000002", empresa="B", monto="50.00")])
    companies = spark.createDataFrame([(1, "20000000001", "A", "h"), (2, "20000000002", "B", "h")], "suppkey long, ruc string, empresa string, address_hash string")
    r = d.shared_key(won, companies, "address_hash").first()
    assert (r.n_empresas, r.empresas, r.monto_cluster) == (2, "A,B", 300.0)  # 2 x (100 + 50) over the cross product of 2 and 1 contracts
    assert d.shared_key(won, companies, "address_hash", dedup_contracts=True).first().monto_cluster == 250.0


def test_chunks_keep_pages_and_headings(spark):
    pages = [("d", 1, "1 OBJETO DEL SERVICIO\n" + "palabra " * 120), ("d", 2, "2.1 PLAZO DE ENTREGA\nDiez dias."), ("e", 1, ""), ("f", 1, None)]
    df = spark.createDataFrame(pages, "document_id string, page_number int, text string")
    got = chunking.chunks(df, size=300).orderBy("chunk_id").collect()
    assert {r.document_id for r in got} == {"d"} and got[0].page_start == 1 and got[-1].page_end == 2
    assert all(len(r.text) <= 300 for r in got) and got[-1].section_hint == "OBJETO DEL SERVICIO"
    assert tx.page_chunks(df, 300, 50).where("document_id = 'd' and page_number = 1").count() >= 4


def test_boilerplate_is_stripped(spark):
    pages = [("d", i, f"CABECERA\ntexto {i}\nmas\n\nPIE {i if i == 4 else ''}".strip()) for i in range(1, 5)]
    df = spark.createDataFrame(pages, "document_id string, page_number int, text string")
    found = tx.boilerplate(df)
    assert {r.line for r in found.collect()} == {"CABECERA", "PIE"}
    assert tx.strip_boilerplate(df, found).where("page_number = 1").first().text == "texto 1\nmas"


def test_rules_scores_and_quotes(spark):
    pages = spark.createDataFrame([("d", 2, "Presentar informe de 500 páginas en formato A3"), ("d", 4, "Camioneta 4x4 y certificación ISO 9001"), ("d", 5, "base de datos estructurada")], "document_id string, page_number int, text string")
    flags = tx.page_flags(pages).collect()
    assert {(r.flag_code, r.page_number) for r in flags} == {("EXCESSIVE_DOCUMENT_REQUIREMENT", 2), ("OBSOLETE_PHYSICAL_FORMAT", 2), ("SPECIFIC_EQUIPMENT_REQUIREMENT", 4), ("EXCESSIVE_CERTIFICATION_REQUIREMENT", 4)}
    rows = [("a", "medium", "x", "y"), ("b", "high", "x", "y"), ("b", "high", "", "y"), ("b", "medium", "x", "y"), ("c", "low", "x", "y"), ("c", "low", "x", "y")]
    df = spark.createDataFrame(rows, "document_id string, severity string, anchor_quote string, evidence_quote string")
    context = spark.createDataFrame([("a", False), ("b", True), ("c", True), ("z", True)], "document_id string, has_key boolean")
    assert {r.document_id: (r.score, r.active) for r in tx.score(df, context).collect()} == {"a": (50, False), "b": (100, True), "c": (60, False), "z": (0, False)}


def test_similar_quotes(spark):
    rows = [("d", "F", 1, 0.9, "uno dos tres cuatro"), ("d", "F", 2, 0.8, "UNO dos trés cuatro"), ("d", "G", 3, 0.5, "uno dos tres cuatro"), ("d", "F", 4, 0.1, None)]
    df = spark.createDataFrame(rows, "document_id string, flag_code string, flag_id int, confidence double, quote string")
    assert sorted(r.flag_id for r in similar.similar_quotes(df).collect()) == [1, 3, 4]


def test_all_hits_of_a_hot_document_are_kept(spark, tmp_path):
    from veedor.plans import reads

    docs = spark.range(10_050).select(F.col("id").alias("doc_id"), F.lit("one | two").alias("text"), F.lit("hot").alias("source"), F.lit("en").alias("lang"), F.lit(9).cast("long").alias("n_chars"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert sum(r.n for r in reads.k9(spark, str(tmp_path)).collect()) == 10_050


def test_physical_presentation_and_single_supplier(spark):
    texts = ["Presentar la documentación en forma física", "Mesa de partes virtual", "Solo podrán participar empresas con experiencia en el sector salud", "Contrato anterior con ministerio", "entrega digital"]
    pages = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "document_id string, page_number int, text string")
    got = {(r.rule_id, r.flag_code, r.severity, r.score, r.page_number) for r in tx.page_flags(pages).collect()}
    assert got == {("TDR-R007", "PHYSICAL_PRESENTATION_REQUIRED", "medium", 15, 0), ("TDR-R007", "PHYSICAL_PRESENTATION_REQUIRED", "medium", 15, 1), ("TDR-R008", "SINGLE_SUPPLIER_CONTEXT", "medium", 15, 2), ("TDR-R008", "SINGLE_SUPPLIER_CONTEXT", "medium", 15, 3)}


def test_vector_search_beyond_the_sent_queries(spark):
    import random

    r = random.Random(4)
    rows = [(i, [r.choice([-1.0, 0.5, 0.25, 1.0]) for _ in range(4)]) for i in range(200)]
    v = spark.createDataFrame(rows, "chunk_id long, v array<double>").repartition(5)
    q = v.where("chunk_id % 20 = 0").selectExpr("chunk_id as query_id", "v as q")
    want = []
    for i, x in rows[::20]:
        best = sorted((-sum(a * b for a, b in zip(x, y)), j) for j, y in rows)[:3]
        want += [(i, j, -s, k + 1) for k, (s, j) in enumerate(best)]
    for sent in (0, 20_000):
        assert sorted(tuple(x) for x in tx.vector_top(v, q, 3, sent=sent).select("query_id", "chunk_id", "score", "rank").collect()) == sorted(want)
    assert tx.vector_top(v, q.limit(0), 3).count() == 0 == tx.vector_top(v.limit(0), q, 3).count()


def test_case_records_have_defaults(spark):
    from veedor.operators import releases as rel
    from veedor.sources import readers

    rows = [
        {"ocid": "a", "buyer": {"name": "", "id": None}, "tender": {"title": "", "description": "obra", "value": {"amount": 5.0}, "numberOfTenderers": 0}, "awards": [{"date": "2024-02-03T00:00", "suppliers": [{"id": "s1"}, {"id": ""}, {"id": None}]}]},
        {"ocid": None, "tender": {"numberOfTenderers": 7, "tenderPeriod": {"startDate": "2023-01-02T10:00"}}, "awards": [{"value": {"amount": 3.0}}]},
    ]
    import json

    schema = ", ".join(readers.RELEASE.split(",\n"))
    df = spark.createDataFrame([(json.dumps(x),) for x in rows], "j string").select(F.from_json("j", schema).alias("r")).select("r.*")
    got = [tuple(r) for r in rel.case_record(df, "2000-01-01").collect()]
    assert got[0] == ("a", "", "", "obra", 5.0, 5.0, "2000-01-01", "2024-02-03", 3, ["s1"], "OCDS/OECE")
    assert got[1] == ("", "", "", "", 0.0, 3.0, "2023-01-02", "2000-01-01", 7, [], "OCDS/OECE")
    said = spark.createDataFrame([("S", "E", 2.5), (None, "", None)], "s string, e string, m double").select(rel.won_sentence(F.col("s"), F.col("e"), F.col("m")).alias("q"))
    assert [r.q for r in said.collect()] == ["S gano contrato con E por 2.50.", "Proveedor no identificado gano contrato con entidad no identificada."]


def test_lookups_and_summaries(spark):
    from veedor.operators import documents as dc

    found = dc.register_lookup(spark.createDataFrame([("1",), ("2",), (None,)], "ruc string"), spark.createDataFrame([("1", "A", "ACTIVO", None, "15")], "ruc string, razon_social string, estado string, condicion string, ubigeo string"))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [("1", "A", "ACTIVO", "", "15"), ("2", "", "NO_ENCONTRADO", "", ""), (None, "", "NO_ENCONTRADO", "", "")]))
    cases = spark.createDataFrame([("x", "t"), ("y", "u")], "ocid string, title string")
    dossiers = spark.createDataFrame([("x", "ALTO", 40, 2)], "ocid string, risk_level string, total_score int, total_flags int")
    flags = spark.createDataFrame([("x", 1, "low", "uno", 3), ("x", 2, "high", "dos", 4)], "ocid string, flag_id int, severity string, evidence_quote string, page_number int")
    assert sorted(tuple(r) for r in dc.demo_cases(cases, dossiers, flags).collect()) == [("x", "t", "ALTO", 40, 2, "dos", 4), ("y", "u", "SIN_DATOS", 0, 0, None, None)]
    rows = [("d", 2, "B", "b", None, 9, 0.5, ["q2", "q1"]), ("d", 1, "A", "a", "why", 1, 0.8, ["q1"]), ("d", 3, "C", "c", "", 2, 0.65, None)]
    f = spark.createDataFrame(rows, "document_id string, flag_id int, flag_code string, flag_name string, explanation string, page_number int, confidence double, questions array<string>")
    got = {r.document_id: r for r in dc.synthesis(f, spark.createDataFrame([("d",), ("e",), ("d",)], "document_id string")).collect()}
    assert (got["d"].n, got["d"].level, got["d"].questions) == (3, "high", "q1,q2") and "(A, B, C)" in got["d"].summary
    assert got["d"].summary.endswith("- a: why (pag. 1)\n- b:  (pag. 9)\n- c:  (pag. 2)")
    assert (got["e"].n, got["e"].level, got["e"].questions, got["e"].summary) == (0, "low", "", dc.NO_FLAGS)
    texts = spark.createDataFrame([("The cat with",), ("the",), (None,)], "text string")
    assert tx.token_search(texts, "The", "with").count() == 1


def test_a_supplier_of_many_clients_is_not_monogamous(spark, monkeypatch):
    """Clients are counted over all of a supplier's contracts: grouped by client, each had one and the limit dropped none."""
    from veedor.plans import signals, star

    rows = [("a", "A", "c", y, 10) for y in (2001, 2002, 2002)] + [("b", "B", f"c{k}", y, 10) for k in range(531) for y in (2001, 2001, 2002)]
    monkeypatch.setattr(star, "won", lambda spark, sf: spark.createDataFrame(rows, "ruc string, empresa string, cliente_ruc string, anio int, monto int").withColumn("monto", F.col("monto").cast("decimal(18,2)")))
    got = signals.QUERIES["f10_monogamous_supplier"](spark, "")
    assert [tuple(r) for r in got.collect()] == [("a", "A", 3, 1, 2, 30.0, "c")]


def test_dossiers_ask_and_every_document_has_one(spark):
    flags = [("d", "LOW_TRACEABILITY_OUTPUT", "low", 10, 10), ("d", "SUBJECTIVE_EVALUATION_CRITERIA", "medium", 15, 2), ("d", "LOW_TRACEABILITY_OUTPUT", "low", 10, 2), ("d", "UNKNOWN", "high", 1, 1)]
    documents = spark.createDataFrame([("d", "AS-1"), ("e", None)], "document_id string, procedure string")
    got = {r.document_id: r for r in tx.dossiers(spark.createDataFrame(flags, "document_id string, flag_code string, severity string, score int, page_number int"), documents).collect()}
    d, e, q = got["d"], got["e"], rules.DOSSIER_QUESTIONS
    assert (d.total_flags, d.n_low, d.n_medium, d.n_high, d.total_score, d.pages, d.risk_level) == (4, 2, 1, 1, 36, 3, "MEDIO")
    assert d.questions == q["LOW_TRACEABILITY_OUTPUT"] + q["SUBJECTIVE_EVALUATION_CRITERIA"] + rules.EVERY_DOSSIER_ASKS and d.request == rules.DOSSIER_REQUEST % ("AS-1", "1, 2, 10")
    assert (e.total_flags, e.total_score, e.pages, e.risk_level, e.questions, e.request) == (0, 0, 0, "SIN_SENALES", rules.EVERY_DOSSIER_ASKS, rules.DOSSIER_REQUEST % ("e", "N/A"))
