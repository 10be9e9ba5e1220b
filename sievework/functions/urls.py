"""Links to registrable domains."""

from __future__ import annotations

from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.sources.suffixes import Rules, ascii_host, is_address

LINK = "link string, scheme string, host string, domain string, unresolved string"


def parse_link(link: str) -> tuple[str, str | None, str | None]:
    """(scheme, host, reason why there is no host)."""
    try:
        parts = urlparse(link)
        host = parts.hostname
    except ValueError:
        return "", None, "malformed"
    if not host:
        return parts.scheme, None, "no_host" if parts.scheme else "relative"
    return parts.scheme, host, None


def resolve(link: str, rules: Rules) -> dict[str, str | None]:
    """One link: exactly one of domain and unresolved is set."""
    scheme, host, reason = parse_link(link)
    domain = None
    if host is not None:
        name = None if is_address(host) else ascii_host(host)
        domain = rules.registrable(name) if name else None
        if domain is None:
            reason = "address" if is_address(host) else "invalid_host" if name is None else "public_suffix"
    return {"link": link, "scheme": scheme, "host": host, "domain": domain, "unresolved": reason}


def link_udf(rules: Rules):
    """An Arrow UDF from a link to its struct; distinct links of a batch are parsed once."""

    @F.pandas_udf(LINK)
    def resolved(links: pd.Series) -> pd.DataFrame:
        codes, distinct = pd.factorize(links)
        rows = [resolve(x, rules) for x in distinct]
        table = pd.DataFrame(rows, columns=["link", "scheme", "host", "domain", "unresolved"]).astype(object)
        return table.reindex(codes).reset_index(drop=True)

    return resolved


def resolve_links(posts: DataFrame, rules: Rules) -> DataFrame:
    """(post_id, account, domains, links): every post with its links resolved, in their order.

    A null list counts as empty and null links are skipped.  ``domains`` is sorted and distinct.
    """
    each = posts.select("post_id", F.posexplode("links").alias("pos", "link")).where("link IS NOT NULL")
    done = each.select("post_id", "pos", link_udf(rules)("link").alias("x"))
    lists = done.groupBy("post_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("pos", "x"))), lambda s: s["x"]).alias("links"))
    one = posts.groupBy("post_id").agg(F.max("account").alias("account"))
    whole = one.join(lists, "post_id", "left").withColumn("links", F.coalesce("links", F.array().cast(f"array<struct<{LINK.replace(' string', ':string')}>>")))
    return whole.select("post_id", "account", domains_of("links").alias("domains"), "links")


def domains_of(links: str | Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(links, lambda x: x["domain"]), lambda d: d.isNotNull())))


def register(spark: SparkSession, rules: Rules, name: str = "resolve_link") -> None:
    """Make the link UDF callable from SQL."""
    spark.udf.register(name, link_udf(rules))
