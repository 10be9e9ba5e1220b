"""A report extract: compressed CSV with bilingual headers, and its base rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Beginnings of the bilingual headers, by the name each column gets.
HEADERS = {"number": "Number ID", "received": "Date Received", "category": "Fraud and Cybercrime Thematic Categories"}


def read(spark: SparkSession, path: str, headers: dict[str, str] | None = None) -> DataFrame:
    """The extract's columns whose header begins as stated, stripped; others are left out.

    A byte-order mark is dropped, compressed files are read as they are.  A header that begins no
    column, or two, is refused.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    chosen = []
    for name, begin in (headers or HEADERS).items():
        found = [c for c in raw.columns if c.lstrip("\ufeff").strip().startswith(begin)]
        if len(found) != 1:
            raise ValueError(f"{len(found)} columns begin with {begin!r}")
        chosen.append(F.trim(F.col(f"`{found[0]}`")).alias(name))
    return raw.select(*chosen)


def base_rates(rows: DataFrame, category: str = "category") -> DataFrame:
    """(category, reports, base_rate), most reports first; null and blank categories are left out."""
    n = rows.where(F.trim(category) != "").groupBy(category).agg(F.count("*").alias("reports"))
    total = n.agg(F.sum("reports").alias("of"))
    return n.crossJoin(F.broadcast(total)).select(category, "reports", F.round(F.col("reports") / F.col("of"), 6).alias("base_rate")).orderBy(F.desc("reports"), category)


def survey(rows: DataFrame) -> DataFrame:
    """(reports, categories, first, last, longest): facts of an extract; ``longest`` shows that no column holds free text."""
    longest = F.max(F.greatest(*(F.coalesce(F.length(c), F.lit(0)) for c in rows.columns)))
    return rows.agg(F.count("*").alias("reports"), F.countDistinct("category").alias("categories"), F.min("received").alias("first"), F.max("received").alias("last"), longest.alias("longest"))
