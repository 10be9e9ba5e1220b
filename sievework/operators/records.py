"""Candidates as whole records: members, what they share, how close in time and content, and what holds them together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.rules import OTHER
from sievework.functions.vectors import cross_group_nearest
from sievework.operators.candidates import check_parameters, moment, quorum, timing
from sievework.operators.score import domain_links, withheld_domains
from sievework.partitioning import checkpointed

#: Posts, and rows of evidence, up to which a group is nested in one record.
MOST = 100_000
#: Names of the three corroborations, in their order.
NAMES = {"temporal": "temporal proximity", "similar": "content similarity", "agreed": "category agreement"}


def evidence(members: DataFrame, post_domains: DataFrame, contacts: DataFrame, hosts: DataFrame) -> DataFrame:
    """(group, kind, value, account, post_id, spelling): where two accounts or more of a group use the same unlisted thing.

    ``members`` holds (group, account); an account may belong to several groups.  Null accounts and
    values and listed domains and e-mail hosts are left out; repeated rows count once.
    """
    listed = withheld_domains(hosts)
    links = domain_links(post_domains).join(listed, "domain", "left_anti")
    links = links.select(F.lit("registration").alias("kind"), F.col("domain").alias("value"), "account", "post_id", F.col("domain").alias("spelling"))
    each = contacts.select("post_id", "account", F.explode("matches").alias("m")).where("m.value IS NOT NULL")
    points = each.withColumn("domain", F.when(F.col("m.kind") == "email", F.lower(F.substring_index("m.value", "@", -1)))).join(listed, "domain", "left_anti")
    points = points.select("m.kind", "m.value", "account", "post_id", F.col("m.found_as").alias("spelling"))
    used = checkpointed(links.unionByName(points).join(members.distinct(), "account").distinct())
    wide = used.groupBy("group", "kind", "value").agg(F.min("account").alias("lo"), F.max("account").alias("hi")).where("lo <> hi").select("group", "kind", "value")
    return used.join(wide, ["group", "kind", "value"]).select("group", "kind", "value", "account", "post_id", "spelling")


def sizes(own: DataFrame, shared: DataFrame) -> DataFrame:
    """(group, accounts, posts, rows): counts of every group, however large."""
    counts = own.groupBy("group").agg(F.countDistinct("account").alias("accounts"), F.countDistinct("post_id").alias("posts"))
    return counts.join(shared.groupBy("group").agg(F.count("*").alias("rows")), "group", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def _set(column: str) -> Column:
    return F.array_sort(F.collect_set(column))


def _listed(rows: DataFrame, entry: Column, name: str) -> DataFrame:
    return rows.groupBy("group").agg(F.array_sort(F.collect_list(entry)).alias(name))


def records(members: DataFrame, posts: DataFrame, post_domains: DataFrame, contacts: DataFrame, hosts: DataFrame, placed: DataFrame, vectors: DataFrame, window_hours: int = 24, threshold: float = 0.5, most: int = MOST) -> DataFrame:
    """One record for each group with a post, in the contract of candidate records, its id being the group's name.

    A group with more than ``most`` posts or rows of evidence has its accounts, posts, shared_domains
    and shared_contact_points null, as no row could hold them: ``evidence`` and ``sizes`` have them row
    by row.  Everything else is counted for all groups.  Posts without a readable stamp or vector have
    no part in timing and similarity; a group that shares nothing has empty lists.
    """
    check_parameters(window_hours, threshold)
    own = checkpointed(posts.select("post_id", "account", "created_at", moment("created_at").alias("moment")).join(members.distinct(), "account"))
    shared = checkpointed(evidence(members, post_domains, contacts, hosts))
    small = sizes(own, shared).where((F.col("posts") <= most) & (F.col("rows") <= most)).select("group")
    nested = shared.join(small, "group")
    lists = own.join(small, "group").groupBy("group").agg(_set("account").alias("accounts"), _set("post_id").alias("posts"))
    used = nested.groupBy("group", "kind", "value").agg(_set("account").alias("accounts"), _set("post_id").alias("posts"), _set("spelling").alias("spellings"))
    domains = _listed(used.where("kind = 'registration'"), F.struct(F.col("value").alias("domain"), "accounts", "posts"), "shared_domains")
    points = _listed(used.where("kind <> 'registration'"), F.struct("kind", "value", "accounts", "posts", "spellings"), "shared_contact_points")

    times = timing(shared.select(F.col("group").alias("group_account"), "kind", "value", "account").distinct(), own.select("account", "moment").distinct()).withColumnRenamed("group_account", "group")
    times = checkpointed(times)
    corroboration = _listed(times.join(small, "group"), F.struct("kind", "value", "closest_seconds", "span_seconds"), "corroboration")
    timely = (F.col("span_seconds") <= window_hours * 3600).cast("bigint")
    timed = times.groupBy("group").agg(F.struct(F.lit(window_hours * 3600).cast("bigint").alias("window_seconds"), F.count("*").alias("pieces"), F.sum(timely).alias("corroborated"), F.min("closest_seconds").alias("closest_seconds")).alias("timing"))

    near = checkpointed(cross_group_nearest(own.join(vectors, "post_id"), "group", "account"))
    writers = own.select("group", "post_id", "account")
    of = lambda name, who: writers.select("group", F.col("post_id").alias(name), F.col("account").alias(who))
    pairs = near.select("group", F.col("post_id").alias("post"), "nearest", "distance").join(of("post", "account"), ["group", "post"]).join(of("nearest", "nearest_account"), ["group", "nearest"])
    similarity = _listed(pairs.join(small, "group"), F.struct("post", "account", "nearest", "nearest_account", "distance"), "similarity")
    compared = near.groupBy("group").agg(F.sum((F.col("distance") <= threshold).cast("bigint")).alias("corroborated"), F.min("distance").alias("closest_distance"))
    # every post is a piece, compared or not: only if all of them are near is the content alike
    alike = own.groupBy("group").agg(F.countDistinct("post_id").alias("pieces")).join(compared, "group", "left")
    alike = alike.select("group", F.struct(F.lit(float(threshold)).alias("threshold"), "pieces", F.coalesce("corroborated", F.lit(0)).alias("corroborated"), "closest_distance").alias("content_similarity"))

    votes = own.select("group", "post_id").join(placed.select("post_id", "scam_category"), "post_id").groupBy("group", "scam_category").agg(F.count("*").alias("count"))
    tally = votes.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct((F.col("scam_category") == OTHER).alias("o"), (-F.col("count")).alias("c"), F.col("scam_category").alias("name")))), lambda x: F.struct(x["name"].alias("name"), (-x["c"]).alias("count"))).alias("tally"))

    out = own.groupBy("group").agg(F.min("created_at").alias("first_seen"))
    for part in (lists, domains, points, corroboration, timed, similarity, alike, tally):
        out = out.join(part, "group", "left")
    out = out.join(small.withColumn("_small", F.lit(True)), "group", "left").withColumnRenamed("group", "candidate_id")
    nothing = F.struct(F.lit(window_hours * 3600).cast("bigint").alias("window_seconds"), *(F.lit(0).cast("bigint").alias(n) for n in ("pieces", "corroborated", "closest_seconds")))
    kinds = dict(out.dtypes)
    empty = lambda c: F.when(F.col("_small"), F.coalesce(c, F.array().cast(kinds[c]))).alias(c)
    whole = checkpointed(out.select("candidate_id", "first_seen", "accounts", "posts", *map(empty, ("shared_domains", "shared_contact_points", "corroboration", "similarity")), F.coalesce("timing", nothing).alias("timing"), "content_similarity", F.struct(F.struct("tally").alias("category")).alias("cohesion")))
    held = quorum(whole)
    split = lambda wanted: F.filter(F.array(*(F.when(F.col(c) == wanted, F.lit(n)) for c, n in NAMES.items())), lambda x: x.isNotNull())
    cohesion = F.struct(split(False).alias("against"), F.col("cohesion.category").alias("category"), split(True).alias("corroborating"), F.col("retained").alias("retained"))
    return whole.join(held, "candidate_id").withColumn("cohesion", cohesion).drop("retained", *NAMES)


def rollup(records_: DataFrame) -> DataFrame:
    """(system, candidates, accounts): all candidates, those that the quorum keeps, and those it removes, with their distinct accounts."""
    each = records_.select("candidate_id", F.col("cohesion.retained").alias("retained"), F.explode("accounts").alias("account"))
    named = each.select("candidate_id", "account", F.explode(F.array(F.lit("baseline"), F.when(F.col("retained"), "retained").otherwise("removed"))).alias("system"))
    return named.groupBy("system").agg(F.countDistinct("candidate_id").alias("candidates"), F.countDistinct("account").alias("accounts"))
