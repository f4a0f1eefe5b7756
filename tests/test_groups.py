"""Classes, pairs behind a number, and components, against brute force."""

import random

from veedor.operators import groups as g
from veedor.operators import metrics as m
from veedor.operators import patterns as p


def brute_components(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    out = {}
    for x in parent:
        out.setdefault(root(x), set()).add(x)
    return {x: min(c) for c in out.values() for x in c}


def test_components(spark):
    rand = random.Random(2)
    path = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(120)]
    rand.shuffle(path)
    edges = path + [("hub", f"leaf{i}") for i in range(500)] + [(f"x{rand.randint(0, 80)}", f"x{rand.randint(0, 80)}") for _ in range(60)] + [("self", "self")]
    df = spark.createDataFrame(edges + [(None, "a"), ("b", None)] + edges[:50], "a string, b string")
    assert {r.node: r.component for r in g.components(df).collect()} == brute_components(edges)
    assert g.components(df.limit(0)).count() == 0


def test_classes_and_pairs_of_a_hot_value(spark):
    rows = [(f"c{i:04d}", "hot") for i in range(3000)] + [("a", "x"), ("b", "x"), ("a", "x"), ("c", "x"), ("d", "y"), (None, "x"), ("e", None)]
    df = spark.createDataFrame(rows, "ruc string, home string")
    got = g.classes(df, "ruc", "home")
    assert got.count() == 3003 and {tuple(r) for r in got.where("home = 'x'").collect()} == {("a", "x", "a", 3), ("b", "x", "a", 3), ("c", "x", "a", 3)}
    linked = g.pairs(df, "ruc", "home", 1000)
    assert linked.count() == 2999 + 3 and {tuple(r) for r in linked.where("home = 'x'").collect()} == {("a", "b", "x"), ("a", "c", "x"), ("b", "c", "x")}
    assert {(r.component, r.members) for r in g.shared_components(df, "ruc", "home").collect()} == {("c0000", 3000), ("a", 3), ("d", 1), ("e", 1)}


def test_shared_components_join_by_any_attribute(spark):
    rand = random.Random(8)
    rows = [(f"r{i:03d}", rand.choice([None, *(f"h{k}" for k in range(60))]), f"v{rand.randint(0, 70)}") for i in range(90)]
    got = {r.ruc: (r.component, r.members) for r in g.shared_components(spark.createDataFrame(rows, "ruc string, home string, rep string"), "ruc", "home", "rep").collect()}
    want = brute_components([e for a, b, c in rows for e in ((a, a), (a, "~1" + (b or a)), (a, "~2" + c))])
    want = {a: want[a] for a, _, _ in rows}
    assert got == {a: (c, sum(x == c for x in want.values())) for a, c in want.items()}


def test_community_counts_others_once(spark):
    rand = random.Random(3)
    rows = sorted({(f"c{rand.randint(0, 30):02d}", f"p{rand.randint(0, 12)}") for _ in range(60)} | {(f"z{i}", "hot") for i in range(40)})
    df = spark.createDataFrame(rows, "ruc string, rep_id string")
    want = {}
    for ruc, rep in rows:
        mine = [r for c, r in rows if c == ruc]
        others = sorted({c for c, r in rows if r in mine and c != ruc})
        if others:
            want[ruc] = (",".join(others), ",".join(sorted(r for r in mine if any(x != ruc and y == r for x, y in rows))), len(others))
    assert {r.ruc: (r.companies, r.persons, r.n_companies) for r in p.community(df).collect()} == want
    short = {r.ruc: (r.companies, r.n_companies) for r in p.community(df, listed=3).collect()}
    assert short == {c: (",".join(x.split(",")[:3]), n) for c, (x, _, n) in want.items()}


def test_shared_address(spark):
    rows = [("a", "h"), ("b", "h"), ("b", "h"), ("c", "h"), ("d", "x")]
    got = sorted(map(tuple, p.shared_address(spark.createDataFrame(rows, "ruc string, address_hash string")).collect()))
    assert got == [("a", "b", 3), ("b", "a", 2), ("b", "a", 2), ("c", "a", 3)]


def test_a_subgraph_at_a_date(spark):
    edges = [("a", "b", None, None), ("b", "c", "2020-01-01", "2020-12-31"), ("c", "d", "2021-01-01", None), ("a", "e", None, "2019-12-31")]
    df = spark.createDataFrame(edges, "a string, b string, desde string, hasta string").selectExpr("a", "b", "cast(desde as date) as desde", "cast(hasta as date) as hasta")
    at = lambda day: {r.node: r.depth for r in p.subgraph(df, "a", 9, day).collect()}
    assert at("2020-12-31") == {"a": 0, "b": 1, "c": 2} and at("2019-12-31") == {"a": 0, "b": 1, "e": 1} and at("2021-06-01") == {"a": 0, "b": 1}
    assert at(None) == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 1}


def test_same_attribute_gives_all_pairs_of_a_hot_value(spark):
    """Every pair, also of a value that over 1,000 share, and as often as a company is given."""
    rows = [(f"c{i:04d}", "hot") for i in range(1300)] + [("a", "x"), ("b", "x"), ("a", "x"), ("c", "y"), (None, "x"), ("e", None)]
    got = m.same_attribute(spark.createDataFrame(rows, "ruc string, home string"), "home")
    assert got.where("via = 'hot'").count() == got.where("via = 'hot'").distinct().count() == 1300 * 1299 // 2
    assert [tuple(r) for r in got.where("via <> 'hot'").collect()] == [("a", "b", "x")] * 2


def test_community_lists_all_others_of_a_hot_representative(spark):
    rows = [(f"c{i:04d}", "hot") for i in range(1100)] + [("c0000", "p"), ("z", "p")]
    got = {r.ruc: r for r in p.community(spark.createDataFrame(rows, "ruc string, rep_id string")).where("ruc in ('c0000', 'c0007')").collect()}
    assert got["c0007"].companies == ",".join(f"c{i:04d}" for i in range(1100) if i != 7) and got["c0007"].n_companies == 1099
    assert got["c0000"].companies == ",".join([*(f"c{i:04d}" for i in range(1, 1100)), "z"]) and got["c0000"].persons == "hot,p"


def test_family_conflict_never_meets_all_companies_of_a_representative(spark):
    """No join goes by the relative alone, which would give each contract once for every company that the relative represents."""
    committee = spark.createDataFrame([(f"x{i}", "a") for i in range(200)], "external_id string, person_id string")
    family = spark.createDataFrame([("a", "b")], "person_id string, relative_id string")
    represents = spark.createDataFrame([(f"c{i}", "b") for i in range(500)] + [("c1", "z")], "ruc string, rep_id string")
    won = spark.createDataFrame([(f"x{i}", f"c{i}" if i % 2 else "other", 1.5) for i in range(200)], "external_id string, ruc string, monto double")
    got = p.family_conflict(committee, family, represents, won)
    assert sorted(map(tuple, got.collect())) == sorted((f"x{i}", "a", "b", f"c{i}", 1.5) for i in range(1, 200, 2))
    joins = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert len(joins) == 3 and all(any(k in line for k in ("external_id", "person_id", "ruc")) for line in joins)
