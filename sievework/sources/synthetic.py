"""A deterministic corpus of invented posts for trying the engine at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TOPICS = ("bike", "desk", "flat", "phone", "ticket", "course", "lamp", "guitar")
_GROUPS = ("forsale", "jobs", "housing", "hobbies")


def _draw(seed: int, salt: str, n: int) -> Column:
    """A number below n that depends on the seed, the salt and the row's id only."""
    return F.pmod(F.xxhash64(F.lit(f"{seed}|{salt}"), F.col("id")), F.lit(n))


def background(spark: SparkSession, rows: int, seed: int = 1, accounts: int = 1000) -> DataFrame:
    """Ordinary posts in the corpus contract; more rows leave the earlier ones as they are."""
    if rows < 0:
        raise ValueError("rows must not be negative")
    pick = lambda names, salt: F.get(F.array(*map(F.lit, names)), _draw(seed, salt, len(names)).cast("int"))
    stamp = F.timestamp_seconds(F.lit(1_700_000_000) + _draw(seed, "time", 365 * 86_400))
    link = F.concat(F.lit("https://site-"), _draw(seed, "site", 5000).cast("string"), F.lit(".example/"), F.col("id").cast("string"))
    topic = pick(_TOPICS, "topic")
    return spark.range(rows).select(
        F.format_string("syn_b_%010d", "id").alias("post_id"),
        F.format_string("syn_user_%06d", _draw(seed, "account", accounts)).alias("account"),
        pick(_GROUPS, "group").alias("subreddit"),
        F.concat(F.lit("About a "), topic).alias("title"),
        F.concat(F.lit("I have a "), topic, F.lit(" for "), _draw(seed, "price", 900).cast("string"), F.lit(" and will answer questions.")).alias("body"),
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.when(_draw(seed, "linked", 3) == 0, F.array(link)).otherwise(F.array().cast("array<string>")).alias("links"),
    )
