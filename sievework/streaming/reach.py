"""Streaming forms of two operators: reach of domains in windows, and a keyed store kept up to date.

The batch operators are the contract; these carry them to unbounded inputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievework.operators.hot_keys import folded
from sievework.operators.store import upserted


def windowed_reach(posts: DataFrame, time: str = "received_at", late: str = "2 days", width: str = "1 day") -> DataFrame:
    """(window, domain, posts, accounts): reach of every domain in tumbling windows; rows later than ``late`` are dropped.

    Distinct counts are estimates (2 %), since exact ones would keep every id in the state.
    """
    each = posts.withWatermark(time, late).select(time, "post_id", "account", F.explode(F.array_distinct(F.transform("links", lambda x: folded(x["domain"])))).alias("domain"))
    counted = each.where("domain IS NOT NULL").groupBy(F.window(time, width), "domain")
    return counted.agg(F.approx_count_distinct("post_id", 0.02).alias("posts"), F.approx_count_distinct("account", 0.02).alias("accounts"))


def keep_store(fresh: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], key: str, checkpoint: str) -> StreamingQuery:
    """Upsert every micro-batch into a keyed store; ``write`` gets the batch's number, so that a repeated one can be told."""

    def step(batch: DataFrame, number: int) -> None:
        write(upserted(read(), batch.dropDuplicates([key]), key), number)

    return fresh.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
