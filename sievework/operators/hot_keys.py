"""p4: per-key results when a few keys hold most rows.

Counts are algebraic aggregates, so Spark combines them on the map side in bounded hash tables that
spill: what is shuffled is one compact state for each (key, member) and partition, however hot a key
is.  Distinct items need no exchange of their rows either: 64-bit hashes of the items are counted
first, and only rows of items that occur more than once, few as deliveries are rarely repeated, are
made distinct row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.partitioning import checkpointed

#: Hashes of repeated items that are broadcast (8 MB); with more of them all rows are made distinct.
FEW_REPEATED = 1 << 20


def folded(value: Column | str) -> Column:
    """Outer blanks removed, lower-cased, trailing dots removed."""
    c = F.col(value) if isinstance(value, str) else value
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"\.+$", "")


def leading_member(rows: DataFrame, key: str, member: str, item: str) -> DataFrame:
    """(key, member): for every key the member with the most distinct items, ties to the smallest name.

    Where ``key`` is an array, a row speaks for each of its distinct keys.  Null keys and members are
    left out, items that are null don't count but keep their member in the running; repeated rows
    count once.  An empty input gives no rows.
    """
    keys = F.array_distinct(key) if isinstance(rows.schema[key].dataType, T.ArrayType) else F.array(key)
    own = rows.where(F.col(member).isNotNull()).select(keys.alias("_keys"), F.col(member).alias("_member"), F.col(item).alias("_item"), F.xxhash64(item).alias("_hash"))
    repeated = checkpointed(own.groupBy("_hash").agg(F.count("*").alias("n")).where("n > 1").select("_hash"))
    each = lambda df: df.select(F.explode("_keys").alias("_key"), "_member", "_item").where("_key IS NOT NULL")
    tally = lambda df: df.groupBy("_key", "_member").agg(F.count("_item").alias("n"))
    if repeated.count() <= FEW_REPEATED:
        few = F.broadcast(repeated)
        once = tally(each(own.join(few, "_hash", "left_anti")))
        counted = once.unionByName(tally(each(own.join(few, "_hash", "left_semi")).distinct())).groupBy("_key", "_member").agg(F.sum("n").alias("n"))
    else:
        counted = tally(each(own).distinct())
    best = counted.groupBy("_key").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("_member").alias("who"))).alias("best"))
    return best.select(F.col("_key").alias(key), F.col("best.who").alias(member))


def leading_accounts(post_domains: DataFrame) -> DataFrame:
    """(domain, account): the account with the most distinct posts linking to each folded domain.

    Null lists, null links, null domains and null accounts are left out; a domain that folds to an
    empty string is kept as such; the same link twice in a post counts once.
    """
    rows = post_domains.select("post_id", "account", F.transform("links", lambda x: folded(x["domain"])).alias("domain"))
    return leading_member(rows, "domain", "account", "post_id")
