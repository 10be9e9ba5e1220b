"""p3: pairwise matches to groups, by stripping and compressing the graph before solving its core.

Rounds of two steps shrink the graph: vertices of degree one hang on their neighbour and go; chains
of degree-two vertices are ranked by pointer doubling, hang on one of their ends and leave one edge
between the ends.  When a round removes little, large-star/small-star contraction solves the core,
and labels return to the removed vertices in the opposite order.

Degrees and neighbours come from algebraic aggregates, and edges are removed by joins on both ends
together, so no task has to hold a hub's whole neighbourhood.  Every step's result is checkpointed.
Joins are told to merge: a broadcast in each of many steps would pile up on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators.components import FEW_EDGES, labels_of, named_groups, star_labels
from sievework.operators.hot_keys import folded
from sievework.partitioning import checkpointed, release, shuffle_width

#: Rounds of stripping and compressing go on while they remove at least this share of the edges.
WORTHWHILE = 0.1
MAX_ROUNDS = 20


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("e")).select("e.x", "e.y")


def _degrees(edges: DataFrame) -> DataFrame:
    """(x, n, a, b): each vertex with its degree and its smallest and largest neighbour."""
    return _both_ways(edges).groupBy("x").agg(F.count("*").alias("n"), F.min("y").alias("a"), F.max("y").alias("b"))


def _together(first: DataFrame, *more: DataFrame) -> DataFrame:
    """A union that has no more partitions than a shuffle, however often it is repeated."""
    for df in more:
        first = first.unionByName(df)
    return first.coalesce(shuffle_width(first.sparkSession))


def _pair(x: str | Column, y: str | Column) -> list[Column]:
    return [F.least(x, y).alias("u"), F.greatest(x, y).alias("v")]


def _strip(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges without those of degree-one vertices, and (x, parent) of the vertices removed."""
    leaves = _degrees(edges).where("n = 1").select("x", F.col("a").alias("p"))
    # two leaves may be each other's neighbour: the larger one goes
    gone = checkpointed(leaves.groupBy(*_pair("x", "p")).agg(F.max("x").alias("x")))
    rest = edges.join(gone.select("u", "v").hint("merge"), ["u", "v"], "left_anti")
    parent = F.when(F.col("x") == F.col("u"), F.col("v")).otherwise(F.col("u"))
    return checkpointed(rest), gone.select("x", parent.alias("parent"))


def _compress(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Edges with every chain of degree-two vertices replaced by one, and (x, parent) of the vertices removed."""
    two = checkpointed(_degrees(edges).where("n = 2 AND a <> b").select("x", "a", "b"))
    if two.isEmpty():
        return edges, None
    # a step (x, y) walks from the chain vertex x to its neighbour y; the walk ends behind the chain
    steps = two.select(F.explode(F.array(F.struct("x", F.col("a").alias("y")), F.struct("x", F.col("b").alias("y")))).alias("s")).select("s.x", "s.y")
    inner = two.select(F.col("x").alias("y"), "a", "b")
    onward = steps.join(inner.hint("merge"), "y", "left").select(
        "x", "y", F.when(F.col("a").isNull(), F.lit(None)).when(F.col("a") == F.col("x"), F.col("b")).otherwise(F.col("a")).alias("z"), F.least("x", "y").alias("low")
    )
    # (x, y): the step; (px, py): the step that its pointer has reached, py null-free while inside; end: the chain's end once known
    walk = onward.select("x", "y", F.when(F.col("z").isNotNull(), F.col("y")).alias("px"), F.col("z").alias("py"), F.when(F.col("z").isNull(), F.col("y")).alias("end"), "low", F.lit(1).cast("bigint").alias("rank"))
    walk = checkpointed(walk)
    before = None
    while True:
        state = walk.agg(F.count("px").alias("open"), F.sum(F.when(F.col("px").isNotNull(), F.col("low").cast("decimal(38,0)"))).alias("low")).first()
        if not state.open or (state.open, state.low) == before:
            break
        before = (state.open, state.low)
        ahead = walk.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("px").alias("qx"), F.col("py").alias("qy"), F.col("end").alias("q_end"), F.col("low").alias("q_low"), F.col("rank").alias("q_rank"))
        moving = walk.where("px IS NOT NULL").join(ahead.hint("merge"), ["px", "py"]).select("x", "y", F.col("qx").alias("px"), F.col("qy").alias("py"), F.col("q_end").alias("end"), F.least("low", "q_low").alias("low"), (F.col("rank") + F.col("q_rank")).alias("rank"))
        last, walk = walk, checkpointed(_together(walk.where("px IS NULL"), moving))
        release(last)
    # what is still walking goes round a cycle: its smallest vertex stands for it
    ends = walk.groupBy("x").agg(F.min("end").alias("a"), F.max("end").alias("b"), F.min("low").alias("low"))
    ends = checkpointed(ends.where("a IS NOT NULL OR x <> low").select("x", "a", "b", F.coalesce("a", "low").alias("parent")))
    touched = two.select(F.explode(F.array(F.struct(*_pair("x", "a")), F.struct(*_pair("x", "b")))).alias("e")).select("e.u", "e.v").distinct()
    rest = edges.join(touched.hint("merge"), ["u", "v"], "left_anti").unionByName(ends.where("a < b").select(F.col("a").alias("u"), F.col("b").alias("v"))).distinct()
    return checkpointed(rest), ends.select("x", "parent")


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(x, label) of every vertex of the edges (u, v: bigint): equal labels mean linked, directly or not.

    Rounds of stripping and compressing go on while they pay and the core has more than ``few``
    edges; one is made in any case.  The core is solved in one task if it has no more edges than
    ``FEW_EDGES``, else by contraction.  Null ends, loops, and repeated or reversed edges are allowed and say nothing new; a vertex with
    nothing but loops has no row, nor has an empty edge list any.
    """
    edges = checkpointed(edges.where("u <> v").select(*_pair("u", "v")).distinct())
    left = edges.count()
    removed = []
    for _ in range(MAX_ROUNDS):
        if not left:
            break
        edges, leaves = _strip(edges)
        edges, inner = _compress(edges)
        removed += [leaves, *([inner] if inner is not None else [])]
        now = edges.count()
        done = now > (1 - WORTHWHILE) * left or now <= few
        left = now
        if done:
            break
    labels = (labels_of if few else star_labels)(edges) if left else edges.select(F.col("u").alias("x"), F.col("v").alias("label"))
    for step in reversed(removed):
        # a parent that no label reached is the last vertex of its component: it labels itself
        known = labels.withColumnRenamed("x", "parent")
        named = step.join(known.hint("merge"), "parent", "left").select("x", "parent", F.coalesce("label", "parent").alias("label"), F.col("label").isNull().alias("new"))
        roots = named.where("new").select(F.col("parent").alias("x"), "label").distinct()
        labels = checkpointed(_together(labels, named.select("x", "label"), roots))
    return labels


def account_ties(candidates: DataFrame, contacts: DataFrame, hosts: DataFrame) -> DataFrame:
    """(a, b, is_name): accounts tied by a candidate, by an unlisted domain of candidates, or by a contact point.

    A candidate's smallest account stands for the row, so each row and value costs one tie per
    account.  Null lists, accounts, domains and points are left out.
    """
    listed = hosts.select(folded("host").alias("host")).where("host IS NOT NULL").distinct()
    rows = candidates.select(F.array_distinct(F.filter("accounts", lambda x: x.isNotNull())).alias("accounts"), "shared_domains").where(F.size("accounts") > 0).withColumn("hub", F.array_min("accounts"))
    members = rows.select(F.explode("accounts").alias("a"), F.col("hub").alias("b"), F.lit(True).alias("is_name")).where("a <> b")
    domains = rows.select(F.col("hub").alias("a"), F.explode(F.transform("shared_domains", lambda x: folded(x["domain"]))).alias("host")).where("host IS NOT NULL")
    by_domain = domains.join(listed, "host", "left_anti").select("a", F.concat(F.lit("domain "), "host").alias("b"), F.lit(False).alias("is_name"))
    points = contacts.where(F.col("account").isNotNull()).select(F.col("account").alias("a"), F.explode(F.array_distinct(F.transform("contact_points", folded))).alias("point")).where("point IS NOT NULL")
    points = points.withColumn("host", F.when(F.col("point").contains("@"), F.substring_index("point", "@", -1)))
    by_point = points.join(listed, "host", "left_anti").select("a", F.concat(F.lit("contact "), "point").alias("b"), F.lit(False).alias("is_name"))
    return members.unionByName(by_domain).unionByName(by_point)


def account_groups(candidates: DataFrame, contacts: DataFrame, hosts: DataFrame) -> DataFrame:
    """(account, group_account) of every account in a group of two or more."""
    return named_groups(account_ties(candidates, contacts, hosts), "account", components)
