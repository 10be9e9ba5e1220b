"""Policy score: published signals, each present or not, summed and normalised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions import rules
from sievework.functions.text import affirmed_of, phrases_in, sentences
from sievework.operators.classify import agreed, placements
from sievework.operators.hot_keys import folded
from sievework.operators.lookalike import lookalikes
from sievework.operators.ranges import numbered
from sievework.partitioning import checkpointed


def domain_links(post_domains: DataFrame) -> DataFrame:
    """(post_id, account, domain): distinct folded domains of every post; null domains left out."""
    each = F.array_distinct(F.transform("links", lambda x: folded(x["domain"])))
    return post_domains.select("post_id", "account", F.explode(each).alias("domain")).where("domain IS NOT NULL").distinct()


def withheld_domains(hosts: DataFrame) -> DataFrame:
    """(domain): folded hosts that anybody may use."""
    return hosts.select(folded("host").alias("domain")).where("domain IS NOT NULL").distinct()


def normalised(points: Column, published: int = rules.PUBLISHED_POINTS) -> Column:
    """100 * points / published, rounded half up in integers."""
    return F.floor((200 * points + published) / (2 * published)).cast("int")


def frequency(links: DataFrame, withheld: DataFrame) -> DataFrame:
    """(post_id): posts with an unlisted domain that two accounts or more reach."""
    kept = links.join(withheld, "domain", "left_anti")
    wide = kept.groupBy("domain").agg(F.min("account").alias("a"), F.max("account").alias("b")).where("a <> b").select("domain")
    return kept.join(wide, "domain", "left_semi").select("post_id").distinct()


def lookalike(links: DataFrame) -> DataFrame:
    """(post_id): posts with a domain that another one resembles; listed domains included."""
    pairs = lookalikes(links)
    either = pairs.select(F.explode(F.array("a", "b")).alias("domain")).distinct()
    return links.join(either, "domain", "left_semi").select("post_id").distinct()


def conflict(links: DataFrame, placed: DataFrame, withheld: DataFrame) -> DataFrame:
    """(post_id): placed posts with an unlisted domain whose posts agree on another class."""
    votes = links.join(withheld, "domain", "left_anti").join(placed.select("post_id", "scam_category"), "post_id")
    majority = agreed(votes, "domain").where("majority IS NOT NULL").select("domain", "majority")
    return votes.where(F.col("scam_category") != rules.OTHER).join(majority, "domain").where("majority <> scam_category").select("post_id").distinct()


def content(posts: DataFrame) -> DataFrame:
    """(post_id, signal): content signals with a phrase that isn't negated.  Only sentences with a phrase reach Python."""
    each = posts.select("post_id", F.explode(F.concat(sentences("title"), sentences("body"))).alias("sentence"))
    every = F.array(*(F.struct(F.lit(s).alias("signal"), phrases_in(F.col("sentence"), p).alias("phrases")) for s, p in rules.SIGNAL_PHRASES.items()))
    some = each.select("post_id", "sentence", F.explode(every).alias("x")).where(F.size("x.phrases") > 0)
    fired = some.select("post_id", "x.signal", affirmed_of("sentence", "x.phrases").alias("p"))
    return fired.where(F.size("p") > 0).select("post_id", "signal").distinct()


def signals(posts: DataFrame, post_domains: DataFrame, hosts: DataFrame) -> DataFrame:
    """(post_id, signal): the signals of every post, each once."""
    # each is read several times below, and a filter on the class would otherwise match all patterns again
    links, withheld = checkpointed(domain_links(post_domains)), withheld_domains(hosts)
    placed = checkpointed(placements(posts).select("post_id", "scam_category"))
    named = lambda df, s: df.select("post_id", F.lit(s).alias("signal"))
    links_of = [named(conflict(links, placed, withheld), "category_conflict"), named(frequency(links, withheld), "domain_frequency"), named(lookalike(links), "domain_lookalike")]
    out = content(posts)
    for df in links_of:
        out = out.unionByName(df)
    return out


def scores(posts: DataFrame, post_domains: DataFrame, hosts: DataFrame) -> DataFrame:
    """(post_id, account, score, points, signals) of every post; one without signals has 0."""
    weight = F.create_map(*(F.lit(x) for pair in rules.WEIGHTS.items() for x in pair))
    hits = signals(posts, post_domains, hosts).groupBy("post_id").agg(F.sum(weight[F.col("signal")]).alias("points"), F.array_sort(F.collect_set("signal")).alias("signals"))
    rows = posts.select("post_id", "account").join(hits, "post_id", "left")
    points = F.coalesce("points", F.lit(0)).cast("int")
    return rows.select("post_id", "account", normalised(points).alias("score"), points.alias("points"), F.coalesce("signals", F.array().cast("array<string>")).alias("signals"))


def queue(scored: DataFrame, depth: int = 50) -> DataFrame:
    """(rank, post_id, account, score, points): the first posts by score, points and id."""
    if depth < 1:
        raise ValueError("depth must be at least 1")
    order = (F.desc("score"), F.desc("points"), F.asc("post_id"))
    top = scored.select("post_id", "account", "score", "points").orderBy(*order).limit(depth)
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "post_id", "account", "score", "points")


def ranked(scored: DataFrame) -> DataFrame:
    """All scored posts with their rank in the queue's order."""
    return numbered(scored, [F.desc("score"), F.desc("points"), F.asc("post_id")], "rank")


def facts(scored: DataFrame, links: DataFrame, withheld: DataFrame) -> DataFrame:
    """One row: posts, those with signals, those in conflict, the highest score; domains that can tie posts together, and those withheld."""
    own = scored.agg(F.count("*").alias("posts"), F.sum((F.col("points") > 0).cast("bigint")).alias("with_signals"), F.sum(F.array_contains("signals", "category_conflict").cast("bigint")).alias("conflicting"), F.max("score").alias("highest"))
    domains = links.select("domain").distinct().join(withheld.withColumn("listed", F.lit(True)), "domain", "left")
    count = lambda c, n: F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).alias(n)
    return own.crossJoin(F.broadcast(domains.agg(count(F.col("listed").isNull(), "associated"), count(F.col("listed").isNotNull(), "withheld"))))


#: The parts of the four kinds of evidence, told apart by which of them are there.
EVIDENCE = {
    "domain_frequency": ("domain", "posts", "accounts"),
    "domain_lookalike": ("domain", "other"),
    "category_conflict": ("domain", "post_category", "domain_category", "majority", "placed"),
    "content": ("field", "phrases", "sentence"),
}
_PARTS = {"domain": "string", "posts": "bigint", "accounts": "bigint", "other": "string", "post_category": "string", "domain_category": "string", "majority": "bigint", "placed": "bigint", "field": "string", "phrases": "array<string>", "sentence": "string"}


def _shaped(rows: DataFrame, signal: Column) -> DataFrame:
    return rows.select("post_id", signal.alias("signal"), *((F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t)).alias(c) for c, t in _PARTS.items()))


def evidence(posts: DataFrame, post_domains: DataFrame, hosts: DataFrame) -> DataFrame:
    """(post_id, signal, parts): every piece of evidence behind every signal of a post; parts of another kind are null.

    A repeated sentence of a field is one piece.  Null texts, lists and domains give none.
    """
    links, withheld = checkpointed(domain_links(post_domains)), withheld_domains(hosts)
    placed = checkpointed(placements(posts).select("post_id", "scam_category"))
    kept = links.join(withheld, "domain", "left_anti")
    wide = kept.groupBy("domain").agg(F.countDistinct("post_id").alias("posts"), F.countDistinct("account").alias("accounts")).where("accounts >= 2")
    frequent = kept.select("post_id", "domain").distinct().join(wide, "domain")
    pairs = lookalikes(links).select(F.explode(F.array(F.struct(F.col("a").alias("domain"), F.col("b").alias("other")), F.struct(F.col("b").alias("domain"), F.col("a").alias("other")))).alias("p")).select("p.*")
    alike = links.select("post_id", "domain").distinct().join(pairs, "domain")
    votes = kept.select("post_id", "domain").distinct().join(placed.where(F.col("scam_category") != rules.OTHER), "post_id")
    agree = agreed(votes, "domain").where("majority IS NOT NULL").select("domain", F.col("majority").alias("domain_category"), F.col("top").alias("majority"), "placed")
    against = votes.join(agree, "domain").where("scam_category <> domain_category").withColumnRenamed("scam_category", "post_category")

    each = posts.select("post_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), sentences(f).alias("sentences")) for f in ("title", "body")))).alias("x"))
    each = each.select("post_id", "x.field", F.explode(F.array_distinct("x.sentences")).alias("sentence"))
    every = F.array(*(F.struct(F.lit(n).alias("signal"), phrases_in(F.col("sentence"), p).alias("phrases")) for n, p in rules.SIGNAL_PHRASES.items()))
    some = each.select("*", F.explode(every).alias("x")).where(F.size("x.phrases") > 0)
    said = some.select("post_id", "field", "sentence", "x.signal", affirmed_of("sentence", "x.phrases").alias("phrases")).where(F.size("phrases") > 0)
    out = _shaped(said, F.col("signal"))
    for rows, name in ((frequent, "domain_frequency"), (alike, "domain_lookalike"), (against, "category_conflict")):
        out = out.unionByName(_shaped(rows, F.lit(name)))
    return out


def line(signal: str = "signal") -> Column:
    """A piece of evidence as one line, by its kind."""
    text = {
        "domain_frequency": F.format_string("%s: %d posts, %d accounts", "domain", "posts", "accounts"),
        "domain_lookalike": F.format_string("%s resembles %s", "domain", "other"),
        "category_conflict": F.format_string("%s: %s, but %d of %d are %s", "domain", "post_category", "majority", "placed", "domain_category"),
    }
    out = F.format_string("%s: %s in: %s", "field", F.array_join("phrases", ", "), "sentence")
    for name, value in text.items():
        out = F.when(F.col(signal) == name, value).otherwise(out)
    return out


def score_records(posts: DataFrame, post_domains: DataFrame, hosts: DataFrame) -> DataFrame:
    """(post_id, account, score, points, published_points, published_signals, signals) with the evidence of every hit.

    A post holds the evidence of its own links and sentences only, so no list outgrows a post.
    """
    weight = F.create_map(*(F.lit(x) for pair in rules.WEIGHTS.items() for x in pair))
    place = F.create_map(*(F.lit(x) for i, n in enumerate(rules.WEIGHTS) for x in (n, i)))
    found = evidence(posts, post_domains, hosts).groupBy("post_id", "signal").agg(F.array_sort(F.collect_list(F.struct(*_PARTS))).alias("evidence"))
    hits = found.groupBy("post_id").agg(F.array_sort(F.collect_list(F.struct(place[F.col("signal")].alias("o"), "signal", weight[F.col("signal")].alias("weight"), "evidence"))).alias("s"))
    rows = posts.select("post_id", "account").join(hits, "post_id", "left")
    signals_ = F.transform("s", lambda x: F.struct(x["signal"].alias("signal"), x["weight"].alias("weight"), x["evidence"].alias("evidence")))
    kind = "array<struct<signal:string,weight:int,evidence:array<struct<" + ",".join(f"{c}:{t}" for c, t in _PARTS.items()) + ">>>>"
    points = F.coalesce(F.aggregate("s", F.lit(0), lambda a, x: a + x["weight"]), F.lit(0))
    return rows.select("post_id", "account", normalised(points).alias("score"), points.alias("points"), F.lit(rules.PUBLISHED_POINTS).alias("published_points"), F.lit(len(rules.WEIGHTS)).alias("published_signals"), F.coalesce(signals_.cast(kind), F.array().cast(kind)).alias("signals"))


def check_scores(scored: DataFrame) -> DataFrame:
    """(check, faults): score records that their own evidence doesn't bear out."""
    weight = F.create_map(*(F.lit(x) for pair in rules.WEIGHTS.items() for x in pair))
    points = F.aggregate("signals", F.lit(0), lambda a, x: a + x["weight"])
    order = F.transform("signals", lambda x: F.array_position(F.array(*map(F.lit, rules.WEIGHTS)), x["signal"]))
    shape = lambda x, e: F.array_compact(F.array(*(F.when(e[c].isNotNull(), F.lit(c)) for c in _PARTS)))
    due = lambda x: F.coalesce(*(F.when(x["signal"] == n, F.array(*map(F.lit, ps))) for n, ps in EVIDENCE.items() if n != "content"), F.array(*map(F.lit, EVIDENCE["content"])))
    checks = {
        "points": points != F.col("points"),
        "score": normalised(points) != F.col("score"),
        "published": (F.col("published_points") != rules.PUBLISHED_POINTS) | (F.col("published_signals") != len(rules.WEIGHTS)),
        "weight": F.exists("signals", lambda x: F.coalesce(F.try_element_at(weight, x["signal"]) != x["weight"], F.lit(True))),
        "order": order != F.array_sort(F.array_distinct(order)),
        "no_evidence": F.exists("signals", lambda x: F.coalesce(F.size(x["evidence"]) == 0, F.lit(True))),
        "shape": F.exists("signals", lambda x: F.exists(x["evidence"], lambda e: F.size(F.array_except(shape(x, e), due(x))) + F.size(F.array_except(due(x), shape(x, e))) > 0)),
    }
    each = scored.agg(*(F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("bigint")), F.lit(0)).alias(n) for n, c in checks.items()))
    return each.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("faults")) for n in checks))).alias("x")).select("x.*")


def read_scores(scored: DataFrame) -> DataFrame:
    """Score records, refused if any breaks a check."""
    broken = [f"{r.check}: {r.faults}" for r in check_scores(scored).collect() if r.faults]
    if broken:
        raise ValueError("score records contradict their evidence: " + ", ".join(broken))
    return scored
