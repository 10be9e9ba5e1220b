"""The p queries of the operators in this subpackage, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import groups, knn, near_dup, packing, repetition, spans, sql, tokens

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, d, "corpus"), threshold=0.5, shingle=3, least_words=15)


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class of equal titles and bodies that each post belongs to."""
    return near_dup.classes(_table(spark, d, "corpus"))


def p1_class_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Classes of different texts that match, with their similarity: with ``p1_classes``, every matching pair of posts."""
    pairs = near_dup.class_pairs(_table(spark, d, "corpus"), threshold=0.5, shingle=3, least_words=15)
    return pairs.select(F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b"), "similarity").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return knn.close_pairs(knn.usable(_table(spark, d, "content_embeddings"), 256), 256, k=5, within=0.12)


def p2_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The 5 nearest other posts, however far, of every post whose number is divisible by 50, with their cosine distance."""
    rows = knn.usable(_table(spark, d, "content_embeddings"), 256)
    asked = rows.where(F.regexp_extract("post_id", r"(\d+)$", 1).cast("bigint") % 50 == 0)
    return knn.search(asked, rows, 256, k=5)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.account_groups(*(_table(spark, d, n) for n in ("campaign_candidates", "post_contacts", "shared_hosts")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(_table(spark, d, "corpus"), 160)


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    return spans.shares(_table(spark, d, "corpus"), 160)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(_table(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(tokens.token_counts(_table(spark, d, "documents")), 2048)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p7_containers(spark, d), 2048)


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every text decoded again from its ids by raw bytes, and whether it is the same; null texts come back empty."""
    documents = _table(spark, d, "documents")
    again = tokens.texts_of(tokens.token_ids(documents)).withColumnRenamed("text", "decoded")
    both = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(again, "doc_id")
    return both.select("doc_id", F.length("decoded").alias("characters"), (F.col("text") == F.col("decoded")).alias("same"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.cases(_table(spark, d, "documents"), 0.3)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.shares(_table(spark, d, "documents"))


def p8_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """The path of every document over the isolation forest."""
    return repetition.anomalies(_table(spark, d, "documents"), 0.3)


def p8_quality(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of the forest's paths alone."""
    return repetition.quality(_table(spark, d, "documents"), 0.3)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_classes, p1_class_pairs, p2_found, p2_nearest, p3_found, p5_found, p5_shares, p6_ids, p6_round_trip, p7_containers, p7_fill, p8_found, p8_shares, p8_anomalies, p8_quality)}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ALL)
