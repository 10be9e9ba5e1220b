"""Connected components: by large-star and small-star contraction, and in one task where the edges are few."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.partitioning import checkpointed, release

#: Edges that one task may solve: two numbers each, 16 MB in all.
FEW_EDGES = 1 << 20


def _contracted(pairs: DataFrame) -> bool:
    """Whether every vertex hangs on one other that hangs on none: then each star is a component."""
    ends = pairs.select("x", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(pairs.select(F.col("y").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def star_labels(edges: DataFrame) -> DataFrame:
    """(x, label) of all vertices of the edges, by large-star and small-star until only stars are left."""
    pairs = checkpointed(edges.select(F.greatest("u", "v").alias("x"), F.least("u", "v").alias("y")).distinct())
    while not _contracted(pairs):
        # large star: every larger neighbour of x hangs on the smallest of x and its neighbours
        both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least.hint("merge"), "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        # small star: every smaller neighbour of x, and x itself, hangs on the smallest
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least.hint("merge"), "x").select(F.explode(F.array(F.struct("x", F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("e")).select("e.x", "e.y")
        before, pairs = pairs, checkpointed(small.where("x <> y").distinct())
        release(before)
    return pairs.select("x", F.col("y").alias("label")).unionByName(pairs.select(F.col("y").alias("x"), F.col("y").alias("label")).distinct())


def _solve(batches):
    rows = [(b["u"].to_numpy(), b["v"].to_numpy()) for b in batches if b.num_rows]
    if not rows:
        return
    u, v = map(np.concatenate, zip(*rows))
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        if (x == y).all():
            break
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], ["x", "label"])


def labels_of(edges: DataFrame, n: int | None = None) -> DataFrame:
    """(x, label) of all vertices of the edges (u, v: bigint), of which there are n: in one task up to ``FEW_EDGES``, else by contraction."""
    if (edges.count() if n is None else n) > FEW_EDGES:
        return star_labels(edges)
    return edges.select("u", "v").coalesce(1).mapInArrow(_solve, "x bigint, label bigint")


def named_groups(ties: DataFrame, name: str = "account", solve: Callable[[DataFrame], DataFrame] = labels_of) -> DataFrame:
    """(name, group_name) of all names that ties (a: name, b: any key) link to another name.

    ``ties`` has columns a (a name), b (a name or key) and is_name (whether b is a name too); names
    and keys are told apart, so equal spellings don't clash.  The group's smallest name stands for
    it.  Ids are numbered exactly, without hashing.
    """
    ties = checkpointed(ties.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b", "is_name").distinct())
    nodes = ties.select(F.col("a").alias("node"), F.lit(True).alias("is_name")).unionByName(ties.select(F.col("b").alias("node"), "is_name")).distinct()
    nodes = checkpointed(nodes.withColumn("id", F.monotonically_increasing_id()))
    left = nodes.where("is_name").select(F.col("node").alias("a"), F.col("id").alias("u"))
    right = nodes.select(F.col("node").alias("b"), "is_name", F.col("id").alias("v"))
    edges = checkpointed(ties.join(left.hint("merge"), "a").join(right.hint("merge"), ["b", "is_name"]).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels = solve(edges)
    named = checkpointed(nodes.where("is_name").join(labels.withColumnRenamed("x", "id").hint("merge"), "id").select("node", "label"))
    heads = named.groupBy("label").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1")
    return named.join(heads.hint("merge"), "label").select(F.col("node").alias(name), F.col("head").alias(f"group_{name}"))
