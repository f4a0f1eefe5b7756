"""Companies that share something, as classes with members and as connected components: rows grow with companies, never with pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def classes(rows: DataFrame, member: str, value: str) -> DataFrame:
    """(member, value, class_id, members) of values that two or more different members share; class_id is the least member.

    A member has a row for each value it shares; its links by that value are members - 1.  Null members and values share nothing.
    """
    own = rows.select(member, value).where(F.col(member).isNotNull() & F.col(value).isNotNull()).distinct()
    sizes = own.groupBy(value).agg(F.min(member).alias("class_id"), F.count("*").alias("members")).where("members > 1")
    return own.join(sizes, value).select(member, value, "class_id", "members")


def pairs(rows: DataFrame, member: str, value: str, most: int) -> DataFrame:
    """(a, b, value), a before b: all pairs of the members of a class of at most ``most``; of a larger class each member with its least one.

    Either way members of a class are connected, so no link between classes is lost; the full pairs of a class of n would be n (n - 1) / 2.
    """
    own = classes(rows, member, value)
    small = own.where(F.col("members") <= most).select(value, F.col(member).alias("a"))
    full = small.join(small.withColumnRenamed("a", "b"), value).where("a < b").select("a", "b", value)
    star = own.where((F.col("members") > most) & (F.col(member) != F.col("class_id"))).select(F.col("class_id").alias("a"), F.col(member).alias("b"), value)
    return full.unionByName(star)


def all_pairs(rows: DataFrame, member: str, value: str, per: int = 1000) -> DataFrame:
    """(a, b, value), a before b: every pair of rows with one value, as often as rows repeat; null members and values have none.

    The rows of a value are dealt over as many parts as it has ``per`` rows, so the pairs of a hot one are made by several tasks; what is
    sent on is the pairs' number / ``per``.
    """
    own = rows.select(member, value).where(F.col(member).isNotNull() & F.col(value).isNotNull())
    sizes = own.groupBy(value).agg(F.ceil(F.count("*") / per).cast("int").alias("_parts"))
    dealt = own.join(sizes, value)
    left = dealt.select(value, F.pmod(F.xxhash64(member), "_parts").cast("int").alias("_part"), F.col(member).alias("a"))
    right = dealt.select(value, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.col(member).alias("b"))
    return left.join(right, [value, "_part"]).where("a < b").select("a", "b", value)


def two_least(rows: DataFrame, value: str, member: str) -> DataFrame:
    """(value, first, second): the two least different members of a value; second is null where there is one."""
    own = rows.select(value, member).distinct()
    first = own.groupBy(value).agg(F.min(member).alias("first"))
    second = own.join(first, value).where(F.col(member) > F.col("first")).groupBy(value).agg(F.min(member).alias("second"))
    return first.join(second, value, "left")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable over edges (a, b) either way; nodes are strings.

    Large-star and small-star rounds: each hangs a node's neighbours on the least of them, so a hot node's edges are
    read and written once a round, by equi-joins that can be split, and rounds are few (about the logarithm of the longest path).
    Each round is a written table.  Edges with a null end are no edges; a node with an edge to itself alone is its own component.
    """
    rows = edges.where("a is not null and b is not null").select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))
    nodes = rows.select(F.col("a").alias("node")).unionByName(rows.select(F.col("b").alias("node"))).distinct()
    links = written(rows.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        links = written(small.where("u <> v").distinct(), "small-star")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def shared_components(companies: DataFrame, member: str, *attributes: str) -> DataFrame:
    """(member, component, members): companies connected by any chain of shared attributes; component is the least member.

    Companies and attribute values are the nodes, so a value that a third of the companies have adds an edge for each, not pairs.
    """
    node = lambda kind, c: F.concat(F.lit(f"{kind}\u0001"), F.col(c).cast("string"))
    edges = None
    for i, attribute in enumerate(attributes):
        one = companies.select(node("0", member).alias("a"), node(str(i + 1), attribute).alias("b"))
        edges = one if edges is None else edges.unionByName(one)
    alone = companies.select(node("0", member).alias("a"), node("0", member).alias("b"))
    found = components(edges.unionByName(alone)).where(F.col("node").startswith("0\u0001"))
    cut = lambda c: F.substring(c, 3, 1 << 30)
    own = written(found.select(cut(F.col("node")).alias(member), cut(F.col("component")).alias("component")), "components")  # the least node of a component is a member: members come first
    return own.join(own.groupBy("component").agg(F.count("*").alias("members")), "component").select(member, "component", "members")
