"""Queries over the star schema for metrics, patterns and investigative reads, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import groups
from ..operators import metrics as m
from ..operators import patterns as p
from ..operators.detectors import few
from . import star
from .signals import DOSSIER_SQL, dossier_tables
from .star import sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def both(spark, sf):
    return star.companies(spark, sf), star.won(spark, sf)


DIV = """div AS (SELECT ruc, coalesce(c, 0)::BIGINT AS diversity_clients, coalesce(n, 0)::BIGINT AS total_contracts, round(coalesce(m, 0), 2)::DOUBLE AS total_won
  FROM company LEFT JOIN (SELECT ruc, count(DISTINCT entidad_ruc) AS c, count(*) AS n, sum(monto) AS m FROM won GROUP BY ruc) USING (ruc))"""
FIRST = "fst AS (SELECT ruc, (min(fecha) - any_value(inicio))::BIGINT AS days_to_first_contract FROM won GROUP BY ruc)"
V2 = """v2 AS (SELECT c.ruc, (CASE WHEN estado = 'BAJA' OR condicion = 'NO HABIDO' THEN 30 ELSE 0 END + CASE WHEN NOT is_ruc_complete THEN 20 ELSE 0 END + CASE WHEN is_generic THEN 15 ELSE 0 END
  + CASE WHEN deuda_coactiva OR omisiones THEN 25 ELSE 0 END + CASE WHEN max_trabajadores <= 2 THEN 20 ELSE 0 END + CASE WHEN diversity_clients = 1 THEN 10 ELSE 0 END + CASE WHEN days_to_first_contract BETWEEN 0 AND 364 THEN 20 ELSE 0 END)::INT AS risk_score_v2
  FROM company c JOIN div USING (ruc) LEFT JOIN fst USING (ruc))"""


@query("m1_client_diversity", sql(f", {DIV} SELECT * FROM div"))
def m1(spark, sf):
    return m.client_diversity(*both(spark, sf))


@query("m2_supplier_concentration", sql(""", y AS (SELECT entidad_ruc, anio, ruc, sum(monto) AS m FROM won GROUP BY ALL), s AS (SELECT entidad_ruc, anio, max(m) AS t, sum(m) AS a FROM y GROUP BY ALL)
SELECT entidad_ruc, round(avg(round(t::DOUBLE / a::DOUBLE, 8)), 4) AS avg_concentration, count(*) AS years FROM s GROUP BY entidad_ruc"""))
def m2(spark, sf):
    return m.supplier_concentration(star.won(spark, sf))


@query("m3_geo_coverage", sql("SELECT ruc, count(DISTINCT region) AS geographic_coverage FROM won GROUP BY ruc"))
def m3(spark, sf):
    return m.geo_coverage(star.won(spark, sf))


@query("m4_risk_score", sql(f""", {DIV} SELECT c.ruc, (CASE WHEN estado = 'BAJA' OR condicion = 'NO HABIDO' THEN 30 ELSE 0 END + CASE WHEN NOT is_ruc_complete THEN 20 ELSE 0 END
 + CASE WHEN diversity_clients = 1 AND total_contracts >= 3 THEN 15 ELSE 0 END + CASE WHEN is_generic THEN 15 ELSE 0 END)::INT AS risk_score FROM company c JOIN div USING (ruc)"""))
def m4(spark, sf):
    return m.risk_score(*both(spark, sf))


@query("m5_days_to_first", sql(f", {FIRST} SELECT * FROM fst"))
def m5(spark, sf):
    return m.days_to_first(*both(spark, sf))


@query("m6_risk_score_v2", sql(f", {DIV}, {FIRST}, {V2} SELECT * FROM v2"))
def m6(spark, sf):
    return m.risk_score_v2(*both(spark, sf))


@query("m7_metrics_summary", sql(f""", {DIV}, {FIRST}, {V2} SELECT count(*) AS companies, round(avg(risk_score_v2), 4) AS avg_score, round(avg(diversity_clients), 4) AS avg_diversity, max(risk_score_v2) AS max_score,
 count(*) FILTER (risk_score_v2 >= 50) AS n_high FROM v2 JOIN div USING (ruc)"""))
def m7(spark, sf):
    return m.summary(m.risk_score_v2(*both(spark, sf)), m.client_diversity(*both(spark, sf)))


@query("d1_same_address_as", sql("SELECT a.ruc AS ruc_a, b.ruc AS ruc_b, a.address_hash AS via FROM company a JOIN company b ON a.address_hash = b.address_hash AND a.ruc < b.ruc WHERE NOT a.is_generic AND NOT b.is_generic"))
def d1(spark, sf):
    return m.same_attribute(star.companies(spark, sf).where("not is_generic"), "address_hash")


@query("d2_same_repr_as", sql("SELECT a.ruc AS ruc_a, b.ruc AS ruc_b, a.person_id AS via FROM company a JOIN company b ON a.person_id = b.person_id AND a.ruc < b.ruc"))
def d2(spark, sf):
    return m.same_attribute(star.companies(spark, sf), "person_id")


CLASSES = """, k AS (SELECT DISTINCT ruc, {0} AS value FROM company WHERE {1}), s AS (SELECT value, min(ruc) AS class_id, count(*) AS members FROM k GROUP BY value HAVING count(*) > 1)
SELECT ruc, value AS {0}, class_id, members FROM k JOIN s USING (value)"""


@query("d1_address_classes", sql(CLASSES.format("address_hash", "NOT is_generic")))
def d1_classes(spark, sf):
    return groups.classes(star.companies(spark, sf).where("not is_generic"), "ruc", "address_hash")


@query("d2_representative_classes", sql(CLASSES.format("person_id", "true")))
def d2_classes(spark, sf):
    return groups.classes(star.companies(spark, sf), "ruc", "person_id")


@query("g3_components", f"""WITH RECURSIVE {star.SQL.strip()}, near AS (SELECT DISTINCT a.ruc AS a, b.ruc AS b FROM company a JOIN company b ON a.person_id = b.person_id OR (a.address_hash = b.address_hash AND NOT a.is_generic AND NOT b.is_generic)),
reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b), c AS (SELECT a AS ruc, min(b) AS component FROM reach GROUP BY a)
SELECT ruc, component, count(*) OVER (PARTITION BY component) AS members FROM c""")
def g3_components(spark, sf):
    c = star.companies(spark, sf).withColumn("home", F.when(~F.col("is_generic"), F.col("address_hash")))
    return groups.shared_components(c, "ruc", "person_id", "home")


COUNTS = """SELECT 'Company' AS label, count(*) AS n FROM company UNION ALL SELECT 'PublicEntity', count(*) FROM entity UNION ALL SELECT 'Contract', count(*) FROM contract
UNION ALL SELECT 'Address', count(DISTINCT address_hash) FROM company UNION ALL SELECT 'Person', count(DISTINCT person_id) FROM company UNION ALL SELECT 'WON', count(*) FROM won"""


def graph_tables(spark, sf):
    c = star.companies(spark, sf)
    return {"Company": c, "PublicEntity": star.entities(spark, sf), "Contract": star.contracts(spark, sf), "Address": c.select("address_hash").distinct(), "Person": c.select("person_id").distinct(), "WON": star.won(spark, sf)}


@query("d3_graph_counts", sql(COUNTS))
def d3(spark, sf):
    return m.counts(graph_tables(spark, sf))


# Edges between persons, companies, parties and entities, derived from keys: 40 persons.
EDGES = """
committee AS (SELECT external_id, lpad((tender_id % 40)::VARCHAR, 8, '0') AS person_id FROM contract WHERE tender_id % 5 = 0),
family AS (SELECT lpad(k::VARCHAR, 8, '0') AS person_id, lpad(((k + 5) % 40)::VARCHAR, 8, '0') AS relative_id FROM range(40) t(k) WHERE k % 5 = 0),
represents AS (SELECT ruc, person_id AS rep_id FROM company),
donation AS (SELECT ruc, 'party' || (suppkey % 3) AS party, DATE '1996-01-01' + (suppkey % 700)::INT AS donated FROM company WHERE suppkey % 9 = 0),
governs AS (SELECT 'party' || (nationkey % 3) AS party, entidad_ruc FROM entity),
sanction AS (SELECT lpad(k::VARCHAR, 8, '0') AS person_id, DATE '1997-01-01' + (k * 10)::INT AS desde, DATE '1998-12-31' AS hasta FROM range(40) t(k) WHERE k % 8 = 0),
official AS (SELECT lpad(k::VARCHAR, 8, '0') AS person_id, entidad_ruc FROM range(40) t(k) JOIN entity ON nationkey = k % 25),
stake AS (SELECT lpad((suppkey * 7 % 40)::VARCHAR, 8, '0') AS person_id, ruc FROM company WHERE suppkey % 5 = 0)"""


def edges(spark, sf) -> dict:
    company, entity, contract = star.companies(spark, sf), star.entities(spark, sf), star.contracts(spark, sf)
    person = lambda k: F.lpad(k.cast("string"), 8, "0")
    k, people = F.col("id"), spark.range(40)
    return {
        "committee": contract.where("tender_id % 5 = 0").select("external_id", person(F.col("tender_id") % 40).alias("person_id")),
        "family": people.where("id % 5 = 0").select(person(k).alias("person_id"), person((k + 5) % 40).alias("relative_id")),
        "represents": company.select("ruc", F.col("person_id").alias("rep_id")),
        "donation": company.where("suppkey % 9 = 0").select("ruc", F.concat(F.lit("party"), (F.col("suppkey") % 3).cast("string")).alias("party"), F.date_add(F.lit("1996-01-01").cast("date"), (F.col("suppkey") % 700).cast("int")).alias("donated")),
        "governs": entity.select(F.concat(F.lit("party"), (F.col("nationkey") % 3).cast("string")).alias("party"), "entidad_ruc"),
        "sanction": people.where("id % 8 = 0").select(person(k).alias("person_id"), F.date_add(F.lit("1997-01-01").cast("date"), (k * 10).cast("int")).alias("desde"), F.lit("1998-12-31").cast("date").alias("hasta")),
        "official": people.join(entity, F.col("nationkey") == k % 25).select(person(k).alias("person_id"), "entidad_ruc"),
        "stake": company.where("suppkey % 5 = 0").select(person(F.col("suppkey") * 7 % 40).alias("person_id"), "ruc"),
    }


def esql(body: str) -> str:
    return sql(f", {EDGES.strip()}\n{body}")


@query("p1_family_conflict", esql("SELECT c.external_id, c.person_id, relative_id, w.ruc, round(w.monto, 2)::DOUBLE AS monto FROM committee c JOIN family USING (person_id) JOIN represents r ON relative_id = rep_id JOIN won w ON w.external_id = c.external_id AND w.ruc = r.ruc"))
def p1(spark, sf):
    e = edges(spark, sf)
    return p.family_conflict(e["committee"], e["family"], e["represents"], star.won(spark, sf))


@query("p2_electoral_return", esql("SELECT ruc, party, entidad_ruc, count(*) AS n_contratos, round(sum(monto), 2)::DOUBLE AS monto_total FROM donation JOIN governs USING (party) JOIN won USING (ruc, entidad_ruc) WHERE fecha > donated GROUP BY ALL HAVING sum(monto) > 0"))
def p2(spark, sf):
    e = edges(spark, sf)
    return p.electoral_return(e["donation"], e["governs"], star.won(spark, sf))


@query("p3_ghost_company", sql("SELECT address_hash, count(DISTINCT ruc) AS n_empresas, count(*) AS n_contratos, round(sum(monto), 2)::DOUBLE AS monto_total FROM won WHERE inicio > (fecha - INTERVAL 12 MONTH)::DATE GROUP BY address_hash HAVING count(DISTINCT ruc) > 1"))
def p3(spark, sf):
    return p.address_cluster(star.won(spark, sf), min_companies=1)


@query("p4_market_concentration", sql(""", r AS (SELECT entidad_ruc, entidad, ruc, empresa, count(*) AS n_contratos, sum(monto) AS m FROM won WHERE fecha >= DATE '2001-08-01' - INTERVAL 36 MONTH GROUP BY ALL),
s AS (SELECT *, round(m::DOUBLE / (sum(m) OVER (PARTITION BY entidad_ruc))::DOUBLE, 4) AS cuota FROM r)
SELECT entidad_ruc, entidad, ruc, empresa, n_contratos, round(m, 2)::DOUBLE AS monto_total, cuota FROM s WHERE cuota > 0.012 AND n_contratos >= 3"""))
def p4(spark, sf):
    return m.market_share(star.won(spark, sf), "2001-08-01", min_share=0.012)


@query("p5_committee_bias", esql("SELECT committee.person_id, ruc, count(DISTINCT external_id) AS veces FROM committee JOIN won USING (external_id) GROUP BY committee.person_id, ruc HAVING count(DISTINCT external_id) >= 3"))
def p5(spark, sf):
    return p.committee_bias(edges(spark, sf)["committee"], star.won(spark, sf))


@query("p6_sanctioned_rep", esql("SELECT external_id, ruc, rep_id, fecha, round(monto, 2)::DOUBLE AS monto FROM represents JOIN sanction ON rep_id = sanction.person_id JOIN won USING (ruc) WHERE fecha BETWEEN desde AND hasta"))
def p6(spark, sf):
    e = edges(spark, sf)
    return p.sanctioned_representative(e["represents"], e["sanction"], star.won(spark, sf))


@query("p7_short_window", "SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS external_id, (l_shipdate::DATE - o_orderdate::DATE)::BIGINT AS dias FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate::DATE - o_orderdate::DATE >= 0 AND l_shipdate::DATE - o_orderdate::DATE < 5")
def p7(spark, sf):
    line, orders = star.read(spark, sf, "lineitem"), star.read(spark, sf, "orders")
    calls = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("external_id"), F.to_date("o_orderdate").alias("called"), F.to_date("l_shipdate").alias("fecha"))
    return p.short_window(calls)


@query("p8_declared_conflict", esql("SELECT s.person_id, ruc, entidad_ruc, count(*) AS n_contratos, round(sum(monto), 2)::DOUBLE AS monto_total FROM stake s JOIN official USING (person_id) JOIN won USING (ruc, entidad_ruc) GROUP BY ALL"))
def p8(spark, sf):
    e = edges(spark, sf)
    return p.declared_conflict(e["stake"], e["official"], star.won(spark, sf))


def graph_edges(spark, sf):
    c = star.companies(spark, sf)
    return c.select(F.col("ruc").alias("a"), F.col("person_id").alias("b")).unionByName(c.where("not is_generic").select(F.col("ruc").alias("a"), F.col("address_hash").alias("b")))


@query("p9_subgraph", "WITH RECURSIVE " + star.SQL.strip() + """, e AS (SELECT ruc AS a, person_id AS b FROM company UNION SELECT ruc, address_hash FROM company WHERE NOT is_generic),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), walk(node, depth) AS (SELECT '20000000001', 0 UNION SELECT u.b, depth + 1 FROM walk JOIN u ON node = u.a WHERE depth < 4)
SELECT node, min(depth)::INT AS depth FROM walk GROUP BY node""")
def p9(spark, sf):
    return p.subgraph(graph_edges(spark, sf), "20000000001", 4)


@query("p9_subgraph_at", "WITH RECURSIVE " + star.SQL.strip() + """, e AS (SELECT ruc AS a, person_id AS b FROM company WHERE inicio <= DATE '1997-06-01' UNION SELECT ruc, address_hash FROM company WHERE NOT is_generic AND (suppkey % 4 > 0 OR DATE '1996-12-31' >= DATE '1997-06-01')),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), walk(node, depth) AS (SELECT '20000000001', 0 UNION SELECT u.b, depth + 1 FROM walk JOIN u ON node = u.a WHERE depth < 4)
SELECT node, min(depth)::INT AS depth FROM walk GROUP BY node""")
def p9_at(spark, sf):
    """As p9_subgraph at a day: companies have their representative from their start on, and every fourth left its address in 1996."""
    c = star.companies(spark, sf)
    never = F.lit(None).cast("date")
    people = c.select(F.col("ruc").alias("a"), F.col("person_id").alias("b"), F.col("inicio").alias("desde"), never.alias("hasta"))
    homes = c.where("not is_generic").select(F.col("ruc").alias("a"), F.col("address_hash").alias("b"), never.alias("desde"), F.when(F.col("suppkey") % 4 == 0, F.lit("1996-12-31").cast("date")).alias("hasta"))
    return p.subgraph(people.unionByName(homes), "20000000001", 4, "1997-06-01")


REL = """, rel AS (
  SELECT ruc, 'MIEMBRO_COMITE' AS kind, 10 AS place, person_id AS other FROM won JOIN committee USING (external_id) SEMI JOIN (SELECT 1) ON true
  UNION ALL SELECT ruc, 'REPRESENTANTE_DE', 20, person_id FROM company UNION ALL SELECT c.ruc, 'FAMILIAR_DE', 30, relative_id FROM company c JOIN family f ON f.person_id = c.person_id
  UNION ALL SELECT a.ruc, 'DIRECCION_COMPARTIDA', 40, b.ruc FROM company a JOIN company b ON a.address_hash = b.address_hash AND a.ruc <> b.ruc UNION ALL SELECT ruc, 'OTRO', 5, 'x' FROM company)"""
REL = REL.replace(" SEMI JOIN (SELECT 1) ON true", "").replace("person_id AS other FROM won JOIN committee", "committee.person_id AS other FROM won JOIN committee")


def relations(spark, sf):
    e, c = edges(spark, sf), star.companies(spark, sf)
    kind = lambda df, k, place, other, n=F.lit(1): df.select("ruc", F.lit(k).alias("kind"), F.lit(place).alias("place"), other.alias("other"), n.cast("long").alias("n"))
    won = star.won(spark, sf).select("external_id", "ruc")
    out = kind(won.join(e["committee"], "external_id"), "MIEMBRO_COMITE", 10, F.col("person_id"))
    out = out.unionByName(kind(c, "REPRESENTANTE_DE", 20, F.col("person_id"))).unionByName(kind(c.join(e["family"], "person_id"), "FAMILIAR_DE", 30, F.col("relative_id")))
    return out.unionByName(kind(p.shared_address(c), "DIRECCION_COMPARTIDA", 40, F.col("other"), F.col("n"))).unionByName(kind(c, "OTRO", 5, F.lit("x")))


@query("p10_coi_score", esql(REL + """ SELECT ruc, least(sum(CASE kind WHEN 'MIEMBRO_COMITE' THEN 25 WHEN 'REPRESENTANTE_DE' THEN 20 WHEN 'FAMILIAR_DE' THEN 30 WHEN 'MONOPOLIO_PROVEEDOR' THEN 15 WHEN 'DIRECCION_COMPARTIDA' THEN 10 ELSE 0 END), 100)::INT AS coi_score,
 array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds FROM rel GROUP BY ruc"""))
def p10(spark, sf):
    return p.coi_score(relations(spark, sf))


@query("p11_coi_signals", esql(REL + " SELECT ruc, kind, min(place)::INT AS place, min(other) AS other FROM rel WHERE kind <> 'OTRO' GROUP BY ruc, kind"))
def p11(spark, sf):
    return p.coi_signals(relations(spark, sf))


FLAGGED = f"{DOSSIER_SQL.strip()}, cf AS (SELECT ruc, external_id, oc.monto, f.flag_code, f.severity, f.score, oc.ocid FROM flag f JOIN oc ON f.doc_id = oc.ocid)"


def company_flags(spark, sf):
    flags, _, contracts = dossier_tables(spark, sf)
    return flags.join(contracts, "ocid").select("ruc", "external_id", "monto", "flag_code", "severity", "score", "ocid")


@query("g1_flags_for_company", sql(f", {FLAGGED} SELECT ruc, count(DISTINCT ocid || ':' || flag_code) AS n_flags, array_to_string(list_sort(list(DISTINCT ocid || ':' || flag_code)), ',') AS flags FROM cf GROUP BY ruc"))
def g1(spark, sf):
    one = company_flags(spark, sf).withColumn("f", F.concat_ws(":", "ocid", "flag_code"))
    return one.groupBy("ruc").agg(F.countDistinct("f").alias("n_flags"), F.array_join(F.array_sort(F.collect_set("f")), ",").alias("flags"))


@query("g2_high_risk_suppliers", sql(f""", {FLAGGED}, k AS (SELECT ruc, count(DISTINCT ocid || ':' || flag_code) AS n_flags FROM cf GROUP BY ruc HAVING count(DISTINCT ocid || ':' || flag_code) >= 2),
a AS (SELECT ruc, count(*) AS n_contracts, round(sum(monto), 2)::DOUBLE AS amount FROM won GROUP BY ruc) SELECT ruc, n_flags, n_contracts, amount FROM k LEFT JOIN a USING (ruc) ORDER BY n_flags DESC, amount DESC, ruc LIMIT 50"""))
def g2(spark, sf):
    k = g1(spark, sf).where("n_flags >= 2").select("ruc", "n_flags")
    a = star.won(spark, sf).groupBy("ruc").agg(F.count("*").alias("n_contracts"), F.round(F.sum("monto"), 2).cast("double").alias("amount"))
    return k.join(a, "ruc", "left").orderBy(F.desc("n_flags"), F.desc("amount"), "ruc").limit(50)


@query("g3_community", esql("SELECT a.ruc, array_to_string(list_sort(list(DISTINCT b.ruc)), ',') AS companies, array_to_string(list_sort(list(DISTINCT a.rep_id)), ',') AS persons, count(DISTINCT b.ruc) AS n_companies FROM represents a JOIN represents b ON a.rep_id = b.rep_id AND a.ruc <> b.ruc GROUP BY a.ruc"))
def g3(spark, sf):
    return p.community(edges(spark, sf)["represents"])


CAROUSEL = """, s AS (SELECT DISTINCT rep_id, entidad_ruc, ruc FROM represents JOIN won USING (ruc)), am AS (SELECT ruc, count(*) AS n, sum(monto) AS m FROM won GROUP BY ruc),
car AS (SELECT rep_id, entidad_ruc, count(DISTINCT ruc) AS n_companies, array_to_string(list_sort(list(DISTINCT ruc)), ',') AS companies, sum(n)::BIGINT AS n_contracts, round(sum(m), 2)::DOUBLE AS amount FROM s JOIN am USING (ruc) GROUP BY ALL HAVING count(DISTINCT ruc) > 1)"""


@query("g4_carousel", esql(CAROUSEL + " SELECT * FROM car"))
def g4(spark, sf):
    return p.carousel(edges(spark, sf)["represents"], star.won(spark, sf))


PATHS = """, link AS (SELECT person_id AS a, 'ES_FUNCIONARIO_DE' AS kind, entidad_ruc AS b, true AS to_buyer FROM official UNION ALL SELECT person_id, 'FAMILIAR_DE', relative_id, false FROM family),
path AS (SELECT ruc, rep_id AS person, b AS buyer, 2 AS length, concat_ws('>', rep_id, kind, b) AS path FROM represents JOIN link ON rep_id = a WHERE to_buyer
UNION ALL SELECT ruc, rep_id, y.b, 3, concat_ws('>', rep_id, x.kind, x.b, y.kind, y.b) FROM represents JOIN link x ON rep_id = x.a JOIN link y ON x.b = y.a WHERE NOT x.to_buyer AND y.to_buyer)"""


def paths(spark, sf):
    e = edges(spark, sf)
    links = e["official"].select(F.col("person_id").alias("a"), F.lit("ES_FUNCIONARIO_DE").alias("kind"), F.col("entidad_ruc").alias("b"), F.lit(True).alias("to_buyer")).unionByName(e["family"].select(F.col("person_id").alias("a"), F.lit("FAMILIAR_DE").alias("kind"), F.col("relative_id").alias("b"), F.lit(False).alias("to_buyer")))
    return p.conflict_paths(e["represents"], links)


@query("g5_conflict_paths", esql(PATHS + " SELECT * FROM path"))
def g5(spark, sf):
    return paths(spark, sf)


@query("g6_company_summary", sql("SELECT ruc, empresa, count(DISTINCT external_id) AS n_contracts, count(DISTINCT entidad_ruc) AS n_buyers, round(sum(monto), 2)::DOUBLE AS amount, array_to_string(list_sort(list(DISTINCT entidad)), ',') AS buyers FROM won GROUP BY ruc, empresa"))
def g6(spark, sf):
    """An external_id starts with its tender's, so different ids are told apart where tenders lie; buyers are a set of at most 25, not a second distinct count, which would send each contract three times."""
    return star.won(spark, sf).groupBy("ruc", "empresa").agg(F.countDistinct("tender_id", "external_id").alias("n_contracts"), F.size(F.collect_set("entidad_ruc")).cast("long").alias("n_buyers"), F.round(F.sum("monto"), 2).cast("double").alias("amount"), F.array_join(F.array_sort(F.collect_set("entidad")), ",").alias("buyers"))


@query("g7_node_counts", sql(f"SELECT label, n FROM ({COUNTS}) WHERE label <> 'WON' ORDER BY n DESC, label"))
def g7(spark, sf):
    return m.counts({k: v for k, v in graph_tables(spark, sf).items() if k != "WON"}).orderBy(F.desc("n"), "label")


@query("g8_enrich_dossier", esql(", " + FLAGGED + CAROUSEL + PATHS + """, fl AS (SELECT ruc, count(DISTINCT ocid || ':' || flag_code) AS n_flags FROM cf GROUP BY ruc), co AS (SELECT a.ruc, count(DISTINCT b.ruc) AS n_companies FROM represents a JOIN represents b ON a.rep_id = b.rep_id AND a.ruc <> b.ruc GROUP BY a.ruc),
z AS (SELECT c.ruc, coalesce(n_flags >= 2, false) AS f, coalesce(n_companies >= 2, false) AS g, c.ruc IN (SELECT unnest(string_split(companies, ',')) FROM car) AS k, c.ruc IN (SELECT ruc FROM path) AS h FROM company c LEFT JOIN fl USING (ruc) LEFT JOIN co USING (ruc))
SELECT ruc, least(50, 15 * f::INT + 10 * g::INT + 20 * k::INT + 25 * h::INT)::INT AS boost, concat_ws(',', CASE WHEN f THEN 'multiple_flags' END, CASE WHEN g THEN 'community' END, CASE WHEN k THEN 'carousel' END, CASE WHEN h THEN 'conflict_path' END) AS signals FROM z"""))
def g8(spark, sf):
    cars = g4(spark, sf).select(F.explode(F.split("companies", ",")).alias("ruc"))
    return p.enrich(star.companies(spark, sf), g1(spark, sf).select("ruc", "n_flags"), g3(spark, sf), cars, paths(spark, sf))


@query("g10_api_company", sql(f", {DIV}, {FIRST}, {V2} SELECT ruc, total_contracts, total_won, risk_score_v2 FROM div JOIN v2 USING (ruc)"))
def g10(spark, sf):
    return m.client_diversity(*both(spark, sf)).join(m.risk_score_v2(*both(spark, sf)), "ruc").select("ruc", "total_contracts", "total_won", "risk_score_v2")


@query("g11_api_flag_aggregate", f"WITH {DOSSIER_SQL.strip().split(', oc AS')[0]} SELECT flag_code, count(*) AS n, array_to_string(list_sort(list(DISTINCT doc_id))[1:5], ',') AS ocids FROM flag GROUP BY flag_code")
def g11(spark, sf):
    flags, _, _ = dossier_tables(spark, sf)
    return flags.groupBy("flag_code").agg(F.count("*").alias("n")).join(few(flags, "flag_code", "ocid", 5, "ocids"), "flag_code")
