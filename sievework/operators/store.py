"""Keyed stores: upsert, deletion, reuse by digest, and small ranked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.operators.ranges import running


def upserted(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Stored rows with those of the same key replaced by fresh ones, and the new ones added."""
    rest = [c for c in stored.columns if c != key]
    s, f = stored.select(key, F.struct(*rest).alias("s")), fresh.select(key, F.struct(*rest).alias("f"))
    chosen = F.when(F.col("f").isNotNull(), F.col("f")).otherwise(F.col("s"))
    return s.join(f, key, "full").select(key, chosen.alias("x")).select(key, *(F.col(f"x.{c}").alias(c) for c in rest))


def kept(stored: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Stored rows whose key is still present."""
    return stored.join(present.select(key).distinct(), key, "left_semi")


def missing(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Wanted rows whose key isn't there; empty when references hold."""
    return wanted.join(there.select(key).distinct(), key, "left_anti").select(*wanted.columns)


def actions(stored: DataFrame, fresh: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, action): reused where digests agree, computed where they don't or are new, removed where nothing is fresh."""
    both = stored.select(key, F.col(digest).alias("s"), F.lit(True).alias("in_s")).join(fresh.select(key, F.col(digest).alias("f"), F.lit(True).alias("in_f")), key, "full")
    return both.select(key, F.when(F.col("in_f").isNull(), "removed").when(F.col("s") == F.col("f"), "reused").otherwise("computed").alias("action"))


def check_related(stored: DataFrame, fresh: DataFrame, key: str, replace: bool = False) -> None:
    """Refuse to update a store that shares no key with the fresh rows."""
    if not replace and not stored.isEmpty() and stored.join(fresh, key, "left_semi").isEmpty():
        raise ValueError("the store and the records share no key; ask for a replacement to go on")


def top(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows with their rank; only those k meet in one task."""
    first = rows.orderBy(*order).limit(k)
    return first.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), *rows.columns)


def upper_median(rows: DataFrame, column: str) -> DataFrame:
    """(upper_median): the value at place n // 2 of the sorted values, by counts of distinct values."""
    tally = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("c"))
    half = tally.agg(F.floor(F.sum("c") / 2).alias("half"))
    placed = running(tally, [F.asc(column)], F.col("c"), "before").crossJoin(F.broadcast(half))
    return placed.where(F.col("before") + F.col("c") > F.col("half")).agg(F.min(column).alias("upper_median"))
