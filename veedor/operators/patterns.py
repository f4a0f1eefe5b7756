"""Relationship patterns: conflicts of interest as joins over typed edges (source, target, kind, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import fresh_path
from .detectors import few, money, names
from .groups import classes, two_least


def family_conflict(committee: DataFrame, family: DataFrame, represents: DataFrame, won: DataFrame) -> DataFrame:
    """A committee member's relative represents the company that won the committee's contract.

    Contracts meet their winners first, so a contract never meets all companies of a representative.
    """
    related = committee.join(family, "person_id").join(won.select("external_id", "ruc", "monto"), "external_id")
    own = represents.select("ruc", F.col("rep_id").alias("relative_id"))
    return related.join(own, ["ruc", "relative_id"]).select("external_id", "person_id", "relative_id", "ruc", money(F.col("monto")).alias("monto"))


def electoral_return(donations: DataFrame, governs: DataFrame, won: DataFrame) -> DataFrame:
    """A donor wins from an entity that its party governs, after the donation."""
    later = donations.join(governs, "party").join(won.select("ruc", "entidad_ruc", "fecha", "monto"), ["ruc", "entidad_ruc"]).where(F.col("fecha") > F.col("donated"))
    return later.groupBy("ruc", "party", "entidad_ruc").agg(F.count("*").alias("n_contratos"), money(F.sum("monto")).alias("monto_total")).where("monto_total > 0")


def address_cluster(won: DataFrame, months: int = 12, min_companies: int = 5) -> DataFrame:
    """More than min_companies at one address that won within months of their start."""
    young = won.where(F.col("inicio") > F.add_months("fecha", -months))
    return young.groupBy("address_hash").agg(F.countDistinct("ruc").alias("n_empresas"), F.count("*").alias("n_contratos"), money(F.sum("monto")).alias("monto_total")).where(F.col("n_empresas") > min_companies)


def committee_bias(committee: DataFrame, won: DataFrame, times: int = 3) -> DataFrame:
    per = committee.join(won.select("external_id", "ruc"), "external_id").groupBy("person_id", "ruc").agg(F.countDistinct("external_id").alias("veces"))
    return per.where(F.col("veces") >= times)


def sanctioned_representative(represents: DataFrame, sanctions: DataFrame, won: DataFrame) -> DataFrame:
    """Contracts within a sanction of the winner's representative: an equi-join with an interval."""
    joined = represents.join(sanctions, F.col("rep_id") == F.col("person_id")).join(won.select("ruc", "external_id", "fecha", "monto"), "ruc")
    return joined.where(F.col("fecha").between(F.col("desde"), F.col("hasta"))).select("external_id", "ruc", "rep_id", "fecha", money(F.col("monto")).alias("monto"))


def short_window(calls: DataFrame, days: int = 5) -> DataFrame:
    """(external_id, called, fecha): days between call and contract under ``days``."""
    gap = F.datediff("fecha", "called")
    return calls.where((gap >= 0) & (gap < days)).select("external_id", gap.cast("long").alias("dias"))


def declared_conflict(stakes: DataFrame, officials: DataFrame, won: DataFrame) -> DataFrame:
    joined = stakes.join(officials, "person_id").join(won.select("ruc", "entidad_ruc", "monto"), ["ruc", "entidad_ruc"])
    return joined.groupBy("person_id", "ruc", "entidad_ruc").agg(F.count("*").alias("n_contratos"), money(F.sum("monto")).alias("monto_total"))


def valid_at(edges: DataFrame, as_of) -> DataFrame:
    """Edges whose validity (desde, hasta, both included; null: open) holds a date."""
    day = F.lit(as_of).cast("date")
    return edges.where(F.coalesce(F.col("desde") <= day, F.lit(True)) & F.coalesce(F.col("hasta") >= day, F.lit(True)))


def subgraph(edges: DataFrame, start: str, max_depth: int, as_of=None) -> DataFrame:
    """(node, depth): what lies within max_depth steps of start over edges (a, b) either way, at its least depth; with ``as_of`` only over edges (a, b, desde, hasta) valid at that date.

    A breadth-first frontier: nodes reached before are anti-joined, so no node is expanded twice and no paths are kept.
    """
    spark = edges.sparkSession
    edges = edges if as_of is None else valid_at(edges, as_of)

    def kept(df: DataFrame) -> DataFrame:
        """Written to the shared folder, so that a level does not work out the levels before it again."""
        path = fresh_path(spark, "frontier")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    both = kept(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    frontier = spark.createDataFrame([(start, 0)], "node string, depth int")
    seen = frontier
    for depth in range(1, max_depth + 1):
        near = frontier.join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        frontier = kept(near.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return seen


#: Points of a relation's kind.
COI_POINTS = {"MIEMBRO_COMITE": 25, "REPRESENTANTE_DE": 20, "FAMILIAR_DE": 30, "MONOPOLIO_PROVEEDOR": 15, "DIRECCION_COMPARTIDA": 10}


def shared_address(companies: DataFrame) -> DataFrame:
    """(ruc, other, n): each company's other companies at its address: how many, and the least; no pairs are made."""
    total = companies.groupBy("address_hash").agg(F.count("*").alias("total"))
    own = companies.groupBy("address_hash", "ruc").agg(F.count("*").alias("own"))
    j = companies.select("ruc", "address_hash").join(total, "address_hash").join(own, ["address_hash", "ruc"]).join(two_least(companies, "address_hash", "ruc"), "address_hash")
    return j.where("total > own").select("ruc", F.when(F.col("first") == F.col("ruc"), F.col("second")).otherwise(F.col("first")).alias("other"), (F.col("total") - F.col("own")).alias("n"))


def coi_score(relations: DataFrame, points: dict[str, int] = COI_POINTS, cap: int = 100) -> DataFrame:
    """(ruc, coi_score, kinds) of relations (ruc, kind, place, other, n): the points of each of its n, added and capped."""
    table = F.create_map(*[F.lit(x) for kv in points.items() for x in kv])
    return relations.groupBy("ruc").agg(F.least(F.sum(F.coalesce(table[F.col("kind")], F.lit(0)) * F.col("n")), F.lit(cap)).cast("int").alias("coi_score"), names("kind").alias("kinds"))


def coi_signals(relations: DataFrame, points: dict[str, int] = COI_POINTS) -> DataFrame:
    """The first relation of each kind that has points, by its place; ``other`` is the least of the n it stands for."""
    first = relations.where(F.col("kind").isin(*points)).groupBy("ruc", "kind").agg(F.min(F.struct("place", "other")).alias("x"))
    return first.select("ruc", "kind", F.col("x.place").alias("place"), F.col("x.other").alias("other"))


def community(represents: DataFrame, listed: int | None = None) -> DataFrame:
    """(ruc, companies, persons, n_companies): for each company the others that share a representative, all or the first ``listed`` of them, and their number.

    A company with one representative takes both from that class; only those with several join the classes' members, to count none twice.
    """
    own = classes(represents, "ruc", "rep_id")
    reps = own.groupBy("ruc").agg(names("rep_id").alias("persons"), F.count("*").alias("n_reps"))
    one = own.join(reps.where("n_reps = 1").select("ruc"), "ruc")
    heads = few(own, "rep_id", "ruc", listed + 1, "heads") if listed else own.groupBy("rep_id").agg(names("ruc").alias("heads"))
    others = F.array_remove(F.split("heads", ","), F.col("ruc"))
    single = one.join(heads, "rep_id").select("ruc", F.array_join(F.slice(others, 1, listed) if listed else others, ",").alias("companies"), (F.col("members") - 1).alias("n_companies"))
    many = own.join(reps.where("n_reps > 1").select("ruc"), "ruc").select("ruc", "rep_id").join(own.select("rep_id", F.col("ruc").alias("other")), "rep_id").where("ruc <> other").select("ruc", "other").distinct()
    several = many.groupBy("ruc").agg(F.count("*").alias("n_companies")).join(few(many, "ruc", "other", listed, "companies") if listed else many.groupBy("ruc").agg(names("other").alias("companies")), "ruc").select("ruc", "companies", "n_companies")
    return single.unionByName(several).join(reps, "ruc").select("ruc", "companies", "persons", "n_companies")


def carousel(represents: DataFrame, won: DataFrame) -> DataFrame:
    """A person behind several companies that sell to one buyer; the amount counts a company's contract once for each buyer of the person's companies, as the signal defines it."""
    sells = represents.join(won.select("ruc", "entidad_ruc").distinct(), "ruc")
    per = sells.groupBy("rep_id", "entidad_ruc").agg(F.countDistinct("ruc").alias("n_companies"), names("ruc").alias("companies")).where("n_companies > 1")
    amount = won.groupBy("ruc").agg(F.count("*").alias("n"), F.sum("monto").alias("m"))
    fan = sells.join(amount, "ruc").groupBy("rep_id", "entidad_ruc").agg(F.sum("n").alias("n_contracts"), money(F.sum("m")).alias("amount"))
    return per.join(fan, ["rep_id", "entidad_ruc"])


def conflict_paths(represents: DataFrame, links: DataFrame, limit: int | None = None) -> DataFrame:
    """Paths supplier - person - (one or two links) - buyer; links (a, kind, b) end at buyers or lead to other persons."""
    one = represents.join(links.where("to_buyer"), F.col("rep_id") == F.col("a")).select("ruc", F.col("rep_id").alias("person"), F.col("b").alias("buyer"), F.lit(2).alias("length"), F.concat_ws(">", "rep_id", "kind", "b").alias("path"))
    first, second = links.where("not to_buyer").alias("x"), links.where("to_buyer").alias("y")
    two = represents.join(first, F.col("rep_id") == F.col("x.a")).join(second, F.col("x.b") == F.col("y.a")).select("ruc", F.col("rep_id").alias("person"), F.col("y.b").alias("buyer"), F.lit(3).alias("length"), F.concat_ws(">", "rep_id", "x.kind", "x.b", "y.kind", "y.b").alias("path"))
    out = one.unionByName(two)
    return out.orderBy("length", "path", "ruc").limit(limit) if limit else out


def enrich(companies: DataFrame, flags: DataFrame, groups: DataFrame, carousels: DataFrame, paths: DataFrame, cap: int = 50) -> DataFrame:
    """15 for two flags or more, 10 for a community of three or more, 20 for a carousel, 25 for a path to a buyer; capped."""
    has = lambda df, name: df.select("ruc").distinct().withColumn(name, F.lit(True))
    j = companies.select("ruc").join(flags, "ruc", "left").join(groups.select("ruc", "n_companies"), "ruc", "left").join(has(carousels, "carousel"), "ruc", "left").join(has(paths, "path"), "ruc", "left")
    rules = [(F.col("n_flags") >= 2, 15, "multiple_flags"), (F.col("n_companies") >= 2, 10, "community"), (F.col("carousel"), 20, "carousel"), (F.col("path"), 25, "conflict_path")]
    score = F.least(F.lit(cap), sum((F.when(c, p).otherwise(0) for c, p, _ in rules), F.lit(0))).cast("int")
    return j.select("ruc", score.alias("boost"), F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, _, n in rules])), ",").alias("signals"))
