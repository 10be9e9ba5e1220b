"""Groups of accounts behind shared infrastructure, and what corroborates them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions.rules import OTHER
from sievework.operators.classify import agreed
from sievework.operators.closest import likeness
from sievework.operators.components import named_groups
from sievework.operators.ranges import numbered
from sievework.operators.score import domain_links, withheld_domains
from sievework.partitioning import checkpointed

#: Corroborations that hold a candidate, of three.
QUORUM = 2


def check_parameters(window_hours: int, threshold: float) -> None:
    if window_hours < 1:
        raise ValueError("the window must be at least an hour")
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie above 0 and not above 1")


def moment(stamp: Column | str) -> Column:
    """Epoch microseconds of an RFC 3339 stamp; null without an offset or if it can't be read."""
    s = F.regexp_replace(F.upper(F.trim(stamp)), " ", "T")
    return F.when(s.rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.unix_micros(F.try_to_timestamp(F.regexp_replace(s, "Z$", "+00:00"))))


def pieces(post_domains: DataFrame, contacts: DataFrame, hosts: DataFrame, keep_listed: bool = False) -> DataFrame:
    """(kind, value, account): what each account reaches, without listed domains and e-mail hosts."""
    listed = withheld_domains(hosts)
    links = domain_links(post_domains).where("account IS NOT NULL").select(F.lit("registration").alias("kind"), F.col("domain").alias("value"), "account", F.col("domain").alias("host"))
    points = contacts.where("account IS NOT NULL").select("account", F.explode("matches").alias("m")).where("m.value IS NOT NULL")
    points = points.select(F.concat(F.lit("contact "), "m.kind").alias("kind"), F.col("m.value").alias("value"), "account", F.when(F.col("m.kind") == "email", F.lower(F.substring_index("m.value", "@", -1))).alias("host"))
    both = links.unionByName(points)
    kept = both if keep_listed else both.join(listed.withColumnRenamed("domain", "host"), "host", "left_anti")
    return kept.select("kind", "value", "account").distinct()


def groups(reached: DataFrame) -> DataFrame:
    """(account, group_account): accounts tied by anything that two of them reach."""
    return named_groups(reached.select(F.col("account").alias("a"), F.concat("kind", F.lit(" "), "value").alias("b"), F.lit(False).alias("is_name")))


def timing(shared: DataFrame, moments: DataFrame) -> DataFrame:
    """(group_account, kind, value, closest_seconds, span_seconds) of every shared piece.

    The pool of a piece is every post of every account that reaches it.  The closest gap between two
    accounts lies between neighbours in time, so one ordered pass finds it; 0 if there is none.
    """
    pool = shared.join(moments, "account").where("moment IS NOT NULL")
    w = Window.partitionBy("group_account", "kind", "value").orderBy("moment", "account")
    gap = pool.withColumn("before", F.lag(F.struct("moment", "account")).over(w))
    cross = F.when(F.col("before.account") != F.col("account"), F.col("moment") - F.col("before.moment"))
    out = gap.groupBy("group_account", "kind", "value").agg(F.min(cross).alias("closest"), (F.max("moment") - F.min("moment")).alias("span"))
    seconds = lambda c: F.floor(F.coalesce(c, F.lit(0)) / 1_000_000).cast("bigint")
    return out.select("group_account", "kind", "value", seconds(F.col("closest")).alias("closest_seconds"), seconds(F.col("span")).alias("span_seconds"))


def candidates(posts: DataFrame, post_domains: DataFrame, contacts: DataFrame, hosts: DataFrame, placed: DataFrame, vectors: DataFrame | None = None, window_hours: int = 24, threshold: float = 0.5) -> DataFrame:
    """One row for each group of two accounts or more, numbered in order of strength.

    Columns: candidate_id, first_seen, accounts, posts (counts), pieces, corroborated, closest_seconds,
    similar (whether all posts are within the threshold of another account's), majority, retained.
    """
    check_parameters(window_hours, threshold)
    reached = checkpointed(pieces(post_domains, contacts, hosts))
    members = checkpointed(groups(reached))
    own = checkpointed(posts.join(members, "account").select("group_account", "account", "post_id", "created_at", moment("created_at").alias("moment")))
    wide = reached.groupBy("kind", "value").agg(F.min("account").alias("lo"), F.max("account").alias("hi")).where("lo <> hi").select("kind", "value")
    shared = reached.join(wide, ["kind", "value"]).join(members, "account")
    times = timing(shared, own.select("account", "moment"))
    timed = times.groupBy("group_account").agg(F.count("*").alias("pieces"), F.sum((F.col("span_seconds") <= window_hours * 3600).cast("bigint")).alias("corroborated"), F.min("closest_seconds").alias("closest_seconds"))
    votes = agreed(own.join(placed.select("post_id", "scam_category"), "post_id"), "group_account").select("group_account", "majority")
    size = own.groupBy("group_account").agg(F.countDistinct("account").alias("accounts"), F.countDistinct("post_id").alias("posts"), F.min("created_at").alias("first_seen"))
    out = size.join(timed, "group_account", "left").join(votes, "group_account", "left")
    if vectors is not None:
        like = likeness(own.select("group_account", "account", "post_id").join(vectors, "post_id"), size.select("group_account", "posts"), "group_account", "account", threshold)
        out = out.join(like, "group_account", "left")
    else:
        out = out.withColumns({"similar": F.lit(False), "closest_distance": F.lit(None).cast("double")})
    timely, similar = F.coalesce(F.col("corroborated") > 0, F.lit(False)), F.coalesce("similar", F.lit(False))
    held = timely.cast("int") + similar.cast("int") + F.col("majority").isNotNull().cast("int") >= QUORUM
    # dealing to ranges reads its input twice
    keyed = checkpointed(out.withColumns({"timely": timely, "similar": similar, "held": held}))
    order = [F.desc("timely"), F.desc("similar"), F.desc("accounts"), F.desc("posts"), F.asc("group_account")]
    named = numbered(keyed, order, "number").withColumn("candidate_id", F.format_string("cc-%02d", "number"))
    return named.select("candidate_id", "group_account", "first_seen", "accounts", "posts", F.coalesce("pieces", F.lit(0)).alias("pieces"), F.coalesce("corroborated", F.lit(0)).alias("corroborated"), "closest_seconds", "similar", "closest_distance", "majority", F.col("held").alias("retained"))


def quorum(records: DataFrame) -> DataFrame:
    """(candidate_id, temporal, similar, agreed, retained): corroborations of candidate records, and whether ``QUORUM`` of them hold.

    A missing part corroborates nothing.  Classes agree if two posts or more are placed and one class
    has more than half of them.
    """
    votes = F.filter("cohesion.category.tally", lambda x: x["name"] != OTHER)
    total = F.aggregate(votes, F.lit(0).cast("bigint"), lambda a, x: a + x["count"])
    most = F.array_max(F.transform(votes, lambda x: x["count"]))
    sure = lambda c: F.coalesce(c, F.lit(False))
    s = F.col("content_similarity")
    parts = {"temporal": sure(F.col("timing.corroborated") > 0), "similar": sure((s["pieces"] > 0) & (s["corroborated"] == s["pieces"])), "agreed": sure((total >= 2) & (2 * most > total))}
    held = records.select("candidate_id", *(c.alias(n) for n, c in parts.items()))
    return held.withColumn("retained", sum((F.col(n).cast("int") for n in parts), F.lit(0)) >= QUORUM)


def filter_effect(unfiltered: DataFrame, filtered: DataFrame) -> DataFrame:
    """(before, after, changed): groups without and with the filter, and how many of the former aren't groups of the latter.

    Groups are told apart by their size and a sum of their members' hashes, so no group is collected.
    """
    mark = lambda df: groups(df).groupBy("group_account").agg(F.count("*").alias("n"), F.sum(F.xxhash64("account").cast("decimal(38,0)")).alias("h"))
    before, after = checkpointed(mark(unfiltered)), checkpointed(mark(filtered))
    gone = before.join(after, ["group_account", "n", "h"], "left_anti")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(before, "before").crossJoin(count(after, "after")).crossJoin(count(gone, "changed"))


def survey(posts: DataFrame, unfiltered: DataFrame, filtered: DataFrame, members: DataFrame) -> DataFrame:
    """(account, state): in candidate, alone (reaches something unlisted), silenced (only listed things) or unreachable."""
    flag = lambda df, name: df.select("account").distinct().withColumn(name, F.lit(True))
    rows = posts.where("account IS NOT NULL").select("account").distinct()
    for df, name in ((members, "grouped"), (filtered, "some"), (unfiltered, "any")):
        rows = rows.join(flag(df, name), "account", "left")
    return rows.select("account", F.when(F.col("grouped"), "in candidate").when(F.col("some"), "alone").when(F.col("any"), "silenced").otherwise("unreachable").alias("state"))
