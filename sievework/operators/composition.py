"""Shares of classes, beside external base rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import rules


def per_mille(counts: DataFrame, value: str) -> DataFrame:
    """The rows with their share of the total in thousandths, in integers rounded half up; 0 if the total is 0."""
    total = counts.agg(F.coalesce(F.sum(value), F.lit(0)).alias("_of"))
    share = F.when(F.col("_of") > 0, F.floor((1000 * F.col(value) + F.floor(F.col("_of") / 2)) / F.col("_of"))).otherwise(0)
    return counts.crossJoin(F.broadcast(total)).withColumn("per_mille", share.cast("bigint")).drop("_of")


def placed_rates(taxonomy: DataFrame, rates: DataFrame, key: str = "scam_category") -> DataFrame:
    """Every row of the taxonomy with the rates of its key, null where there are none; a rate for an unknown key is refused."""
    unknown = rates.join(taxonomy, key, "left_anti").select(key).limit(1).collect()
    if unknown:
        raise ValueError(f"no such category: {unknown[0][0]!r}")
    return taxonomy.join(rates, key, "left")


def uncovered(placed: DataFrame, rates: DataFrame) -> DataFrame:
    """(category): classes of the posts that no external category is projected to."""
    own = placed.select(F.col("scam_category").alias("category")).where("category IS NOT NULL").distinct()
    return own.join(rates.select("category"), "category", "left_anti")


def shares(placed: DataFrame) -> DataFrame:
    """(category, posts, per_mille) of all classes, in integers rounded half up; without posts all are 0."""
    n = placed.groupBy(F.col("scam_category").alias("category")).agg(F.count("*").alias("posts"))
    every = placed.sparkSession.createDataFrame([(c,) for c in rules.CLASSES], "category string").join(n, "category", "left")
    return per_mille(every.select("category", F.coalesce("posts", F.lit(0)).alias("posts")), "posts")


def base_rates(spark) -> DataFrame:
    """(category, reports, per_mille) of the classes by the published extract."""
    known = rules.taxonomy(spark).where("scam_category IS NOT NULL").groupBy(F.col("scam_category").alias("category")).agg(F.coalesce(F.sum("reports"), F.lit(0)).alias("reports"))
    return per_mille(known, "reports")


def compared(placed: DataFrame) -> DataFrame:
    """(category, posts, per_mille, base, difference): shares against base rates, largest share first."""
    base = base_rates(placed.sparkSession).select("category", F.col("per_mille").alias("base"))
    return shares(placed).join(base, "category", "left").withColumn("difference", F.col("per_mille") - F.coalesce("base", F.lit(0))).orderBy(F.desc("per_mille"), "category")
