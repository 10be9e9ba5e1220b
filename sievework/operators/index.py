"""What a stored table of vectors is, and how a query reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_store(rows: DataFrame, model: str, dimensions: int, recipe: str) -> None:
    """Refuse a table that holds rows of another model, width or recipe."""
    other = rows.where(~(F.col("model").eqNullSafe(model) & F.col("dimensions").eqNullSafe(dimensions) & F.col("recipe").eqNullSafe(recipe))).select("model", "dimensions", "recipe").first()
    if other is not None:
        raise ValueError(f"the table holds rows of {tuple(other)}")


def facts(rows: DataFrame) -> DataFrame:
    """(rows, keys, models, widths) of a table of vectors."""
    return rows.agg(F.count("*").alias("rows"), F.countDistinct("post_id").alias("keys"), F.countDistinct("model").alias("models"), F.countDistinct("dimensions").alias("widths"))


def scans(df: DataFrame) -> list[str]:
    """The scan nodes of a query's physical plan, with their pushed filters."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [line.strip() for line in text.splitlines() if line.strip().startswith(("(", "PushedFilters", "ReadSchema")) and any(k in line for k in ("Scan", "Pushed", "ReadSchema"))]
