"""Placement of posts in classes, and votes over placements."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import rules
from sievework.functions.text import phrases_in, sentences


def class_pattern(phrases: tuple[str, ...]) -> str:
    """One pattern for all phrases of a class; longer phrases don't matter, any match counts.  A look at the first letter spares most places the rest."""
    first = "".join(sorted({p[0] for p in phrases}))
    return rf"(?=[{first}])(?<![0-9a-z])(?:" + "|".join(r"\s+".join(re.escape(w) for w in p.split()) for p in phrases) + r")(?![0-9a-z])"


def _classes(text: Column) -> Column:
    hits = [F.when(text.rlike("(?U)" + class_pattern(p)), F.lit(c)) for c, p in rules.CATEGORY_PHRASES.items()]
    return F.array_compact(F.array(*hits))


def placements(posts: DataFrame) -> DataFrame:
    """(post_id, account, scam_category, also_matched): the first class with a phrase in title or body, else Other.

    A phrase has no sentence end inside, so matching the whole text equals matching its sentences.
    Null texts count as empty.
    """
    low = posts.select("post_id", "account", F.lower(F.concat_ws(" . ", "title", "body")).alias("low"))
    found = low.select("post_id", "account", _classes(F.col("low")).alias("classes"))
    return found.select("post_id", "account", F.coalesce(F.get("classes", F.lit(0)), F.lit(rules.OTHER)).alias("scam_category"), F.slice("classes", 2, len(rules.CLASSES)).alias("also_matched"))


def evidence(posts: DataFrame) -> DataFrame:
    """(post_id, category, field, sentence, phrases): sentences with phrases of each class."""
    each = posts.select("post_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), sentences(f).alias("sentences")) for f in ("title", "body")))).alias("x"))
    lines = each.select("post_id", "x.field", F.posexplode("x.sentences").alias("pos", "sentence"))
    every = F.array(*(F.struct(F.lit(c).alias("category"), phrases_in(F.col("sentence"), p).alias("phrases")) for c, p in rules.CATEGORY_PHRASES.items()))
    return lines.select("post_id", "field", "pos", "sentence", F.explode(every).alias("c")).where(F.size("c.phrases") > 0).select("post_id", "c.category", "field", "pos", "sentence", "c.phrases")


def agreed(votes: DataFrame, by: str, category: str = "scam_category") -> DataFrame:
    """(by, placed, top, majority): strict majority of the placed votes, at least two of them; ``Other`` doesn't vote.

    Each row is one vote.  Ties have no majority.
    """
    tally = votes.where((F.col(category) != rules.OTHER) & F.col(by).isNotNull()).groupBy(by, category).agg(F.count("*").alias("n"))
    best = tally.groupBy(by).agg(F.sum("n").alias("placed"), F.max(F.struct("n", F.col(category).alias("c"))).alias("top"))
    return best.select(by, "placed", F.col("top.n").alias("top"), F.when((F.col("placed") >= 2) & (2 * F.col("top.n") > F.col("placed")), F.col("top.c")).alias("majority"))
