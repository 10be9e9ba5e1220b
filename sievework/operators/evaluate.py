"""Measures of rankings, probabilities and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators.ranges import numbered, running


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """(auc): share of (positive, negative) pairs in the right order, ties half; 0.5 if a class is empty.

    Counts are taken by distinct score first; the running sum over scores goes by ranges.  Null scores
    and labels are left out.
    """
    tally = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("double")).alias("p"), F.sum((1 - F.col(label).cast("int")).cast("double")).alias("n"))
    parts = running(tally, [F.asc("s")], F.col("n"), "below").select("p", "n", (F.col("p") * (F.col("below") + F.col("n") / 2)).alias("won"))
    total = parts.agg(F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return total.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("won") / (F.col("p") * F.col("n"))).otherwise(0.5).alias("auc"))


def losses(rows: DataFrame, p: str, label: str) -> DataFrame:
    """(log_loss, brier) of probabilities strictly between 0 and 1."""
    y = F.col(label).cast("double")
    return rows.agg((-F.avg(F.when(y > 0, F.ln(F.col(p))).otherwise(F.ln(1 - F.col(p))))).alias("log_loss"), F.avg((F.col(p) - y) * (F.col(p) - y)).alias("brier"))


def calibration(rows: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """(bin, rows, predicted, observed, gap): equal bins [i/bins, (i+1)/bins), empty ones with nulls.

    Edges are compared as i / bins themselves, never as floor(p * bins).
    """
    spark = rows.sparkSession
    index = F.lit(0)
    for i in range(1, bins):
        index = F.when(F.col(p) >= F.lit(i / bins), F.lit(i)).otherwise(index)
    found = rows.groupBy(index.alias("bin")).agg(F.count("*").alias("rows"), F.avg(p).alias("predicted"), F.avg(F.col(label).cast("double")).alias("observed"))
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select("bin", F.coalesce("rows", F.lit(0)).alias("rows"), "predicted", "observed", F.abs(F.col("predicted") - F.col("observed")).alias("gap"))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    """(ece): the gaps weighted by the bins' rows."""
    return bins.agg((F.sum(F.col("rows") * F.coalesce("gap", F.lit(0.0))) / F.sum("rows")).alias("ece"))


def precision_at(ranked: DataFrame, hit: str, depths: tuple[int, ...], rank: str = "rank") -> DataFrame:
    """(depth, hits, of): hits among the first rows, of min(depth, rows)."""
    top = ranked.where(F.col(rank) <= max(depths)).agg(*(x for k in depths for x in (F.sum(F.when(F.col(rank) <= k, F.col(hit).cast("bigint")).otherwise(0)).alias(f"h{k}"), F.sum((F.col(rank) <= k).cast("bigint")).alias(f"n{k}"))))
    each = F.array(*(F.struct(F.lit(k).alias("depth"), F.coalesce(f"h{k}", F.lit(0)).alias("hits"), F.coalesce(f"n{k}", F.lit(0)).alias("of")) for k in depths))
    return top.select(F.explode(each).alias("x")).select("x.*")


def overlaps(truth: DataFrame, proposed: DataFrame, truth_id: str, proposed_id: str, member: str = "account") -> DataFrame:
    """(truth_id, proposed_id, held, missing, extra): counts for every pair of groups that share a member.

    Both inputs hold one row for each member of a group.
    """
    t, p = truth.select(truth_id, member).distinct(), proposed.select(proposed_id, member).distinct()
    nt, np_ = t.groupBy(truth_id).agg(F.count("*").alias("nt")), p.groupBy(proposed_id).agg(F.count("*").alias("np"))
    both = t.join(p, member).groupBy(truth_id, proposed_id).agg(F.count("*").alias("held"))
    return both.join(nt, truth_id).join(np_, proposed_id).select(truth_id, proposed_id, "held", (F.col("nt") - F.col("held")).alias("missing"), (F.col("np") - F.col("held")).alias("extra"))


def outcomes(truth: DataFrame, matched: DataFrame, truth_id: str) -> DataFrame:
    """(truth_id, outcome): recovered if some group holds all members and no others, partial if any overlaps, else missed."""
    whole = matched.groupBy(truth_id).agg(F.max(((F.col("missing") == 0) & (F.col("extra") == 0)).cast("int")).alias("whole"))
    label = F.when(F.col("whole") == 1, "recovered").when(F.col("whole") == 0, "partial").otherwise("missed")
    return truth.select(truth_id).distinct().join(whole, truth_id, "left").select(truth_id, label.alias("outcome"))


def false_groupings(proposed: DataFrame, truth: DataFrame, proposed_id: str, truth_id: str, member: str = "account") -> DataFrame:
    """(proposed_id, false_grouping): whether a group touches two true groups or anyone outside them."""
    joined = proposed.join(truth.select(member, truth_id), member, "left")
    return joined.groupBy(proposed_id).agg(((F.countDistinct(truth_id) > 1) | F.max(F.col(truth_id).isNull())).alias("false_grouping"))


def class_statistics(rows: DataFrame, label: str, score: str) -> DataFrame:
    """(label, rows, mean, median, zeros) of every class; null scores don't count in the means, null labels are a class."""
    return rows.groupBy(label).agg(F.count("*").alias("rows"), F.avg(score).alias("mean"), F.median(score).alias("median"), F.sum((F.col(score) == 0).cast("bigint")).alias("zeros"))


def external(rows: DataFrame, order: str) -> DataFrame:
    """The rows of an external set with running ids ext_0001, ext_0002, ... in a total order."""
    return numbered(rows, [F.asc(order)], "_n").withColumn("external_id", F.format_string("ext_%04d", "_n")).drop("_n")


def worst_bin(bins: DataFrame) -> DataFrame:
    """(bin, gap): the bin with the largest gap, the first of equals; no row if all bins are empty."""
    best = bins.where("gap IS NOT NULL").agg(F.min(F.struct((-F.col("gap")).alias("gap"), "bin")).alias("b")).where("b IS NOT NULL")
    return best.select("b.bin", (-F.col("b.gap")).alias("gap"))


def overlap_sets(truth: DataFrame, proposed: DataFrame, truth_id: str, proposed_id: str, member: str = "account") -> DataFrame:
    """(truth_id, proposed_id, member, side): for every pair of groups that share a member, who is held by both, missing from the proposal or extra in it.

    One row for each member of a pair, so no group is gathered in one row.
    """
    t, p = truth.select(truth_id, member).distinct(), proposed.select(proposed_id, member).distinct()
    pairs = t.join(p, member).select(truth_id, proposed_id).distinct()
    left = pairs.join(t, truth_id).withColumn("in_t", F.lit(True))
    right = pairs.join(p, proposed_id).withColumn("in_p", F.lit(True))
    both = left.join(right, [truth_id, proposed_id, member], "full")
    return both.select(truth_id, proposed_id, member, F.when(F.col("in_p").isNull(), "missing").when(F.col("in_t").isNull(), "extra").otherwise("held").alias("side"))
