"""Queries over groups of accounts: pieces, components, timing, votes, quorum, evaluation and drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import candidates as C
from sievework.operators import classify, evaluate, graph, records, store
from sievework.operators.ranges import numbered
from sievework.plans.domains import PLACED, POSTS, WITH, posts
from sievework.plans.posts import MATCHES
from sievework.plans.registry import query, table

#: What each account reaches, with the host that may be listed.
REACHED = f"""{WITH}, m AS ({MATCHES}), reached AS (
    SELECT DISTINCT kind, value, account FROM (
        SELECT 'registration' AS kind, domain AS value, account, domain AS host FROM links WHERE account IS NOT NULL
        UNION ALL SELECT 'contact ' || kind, value, account, CASE WHEN kind = 'email' THEN lower(regexp_extract(value, '[^@]*$')) END FROM m WHERE account IS NOT NULL AND value IS NOT NULL)
    WHERE host IS NULL OR host NOT IN (SELECT domain FROM listed))"""
MEMBERS = f"""{REACHED.replace("WITH posts", "WITH RECURSIVE posts")}, tie AS (SELECT DISTINCT a.account AS x, b.account AS y FROM reached a JOIN reached b USING (kind, value)),
    closure(x, y) AS (SELECT x, y FROM tie UNION SELECT c.x, t.y FROM closure c JOIN tie t ON c.y = t.x),
    members AS (SELECT x AS account, min(y) AS group_account FROM closure GROUP BY x HAVING count(*) > 1)"""
#: Posts with the instant of their stamp; a stamp without an offset has none.
_STAMP = "replace(upper(trim(created_at)), ' ', 'T')"
MOMENTS = f"moments AS (SELECT post_id, account, created_at, CASE WHEN regexp_matches({_STAMP}, '(Z|[+-]\\d\\d:?\\d\\d)$') THEN epoch_us(TRY_CAST(regexp_replace(regexp_replace({_STAMP}, 'Z$', '+00:00'), '([+-]\\d\\d)(\\d\\d)$', '\\1:\\2') AS TIMESTAMPTZ)) END AS moment FROM posts)"
SHARED = "shared AS (SELECT r.kind, r.value, r.account, m.group_account FROM reached r JOIN members m USING (account) JOIN (SELECT kind, value FROM reached GROUP BY ALL HAVING count(DISTINCT account) > 1) w USING (kind, value))"
TIMES = """pool AS (SELECT s.group_account, s.kind, s.value, o.account, o.moment FROM shared s JOIN moments o USING (account) WHERE o.moment IS NOT NULL),
    gaps AS (SELECT *, lag(moment) OVER w AS before, lag(account) OVER w AS who FROM pool WINDOW w AS (PARTITION BY group_account, kind, value ORDER BY moment, account)),
    times AS (SELECT group_account, kind, value, CAST(coalesce(min(CASE WHEN who <> account THEN moment - before END), 0) // 1000000 AS BIGINT) AS closest_seconds, CAST((max(moment) - min(moment)) // 1000000 AS BIGINT) AS span_seconds FROM gaps GROUP BY group_account, kind, value)"""


def _reached(spark: SparkSession, d: str, keep_listed: bool = False) -> DataFrame:
    return C.pieces(*(table(spark, d, n) for n in ("post_domains", "post_contacts", "shared_hosts")), keep_listed)


def _shared(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    reached = _reached(spark, d)
    members = C.groups(reached)
    wide = reached.groupBy("kind", "value").agg(F.min("account").alias("lo"), F.max("account").alias("hi")).where("lo <> hi").select("kind", "value")
    return reached.join(wide, ["kind", "value"]).join(members, "account"), members


def _moments(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).select("post_id", "account", "created_at", C.moment("created_at").alias("moment"))


@query("set01_reached_pieces", f"{REACHED} SELECT kind, value, account FROM reached")
def set01(spark: SparkSession, d: str) -> DataFrame:
    return _reached(spark, d)


@query("agg06_account_groups", f"{MEMBERS} SELECT account, group_account FROM members")
def agg06(spark: SparkSession, d: str) -> DataFrame:
    return C.groups(_reached(spark, d))


@query("dat01_moments", f"{WITH}, {MOMENTS} SELECT post_id, moment FROM moments")
def dat01(spark: SparkSession, d: str) -> DataFrame:
    return _moments(spark, d).select("post_id", "moment")


@query("win01_timing", f"{MEMBERS}, {MOMENTS}, {SHARED}, {TIMES} SELECT group_account, kind, value, closest_seconds, span_seconds FROM times")
def win01(spark: SparkSession, d: str) -> DataFrame:
    shared, _ = _shared(spark, d)
    return C.timing(shared, _moments(spark, d).select("account", "moment"))


@query("agg08_timing_summary", f"{MEMBERS}, {MOMENTS}, {SHARED}, {TIMES} SELECT group_account, count(*) AS pieces, CAST(sum((span_seconds <= 86400)::INT) AS BIGINT) AS corroborated, min(closest_seconds) AS closest_seconds FROM times GROUP BY group_account")
def agg08(spark: SparkSession, d: str) -> DataFrame:
    return win01(spark, d).groupBy("group_account").agg(F.count("*").alias("pieces"), F.sum((F.col("span_seconds") <= 86400).cast("bigint")).alias("corroborated"), F.min("closest_seconds").alias("closest_seconds"))


@query("agg07_group_sizes", f"{MEMBERS} SELECT group_account, count(DISTINCT p.account) AS accounts, count(DISTINCT post_id) AS posts, min(created_at) AS first_seen FROM posts p JOIN members USING (account) GROUP BY group_account")
def agg07(spark: SparkSession, d: str) -> DataFrame:
    own = posts(spark, d).join(C.groups(_reached(spark, d)), "account")
    return own.groupBy("group_account").agg(F.countDistinct("account").alias("accounts"), F.countDistinct("post_id").alias("posts"), F.min("created_at").alias("first_seen"))


@query(
    "win03_candidates",
    f"""{MEMBERS}, {PLACED}, {MOMENTS}, {SHARED}, {TIMES},
    t AS (SELECT group_account, count(*) AS pieces, CAST(sum((span_seconds <= 86400)::INT) AS BIGINT) AS corroborated FROM times GROUP BY group_account),
    z AS (SELECT group_account, count(DISTINCT p.account) AS accounts, count(DISTINCT post_id) AS posts, min(created_at) AS first_seen FROM posts p JOIN members USING (account) GROUP BY group_account),
    n AS (SELECT group_account, scam_category, count(*) AS n FROM placed JOIN members USING (account) WHERE scam_category <> 'Other' GROUP BY ALL),
    v AS (SELECT group_account, CASE WHEN sum(n) >= 2 AND 2 * max(n) > sum(n) THEN arg_max(scam_category, n) END AS majority FROM n GROUP BY group_account)
    SELECT format('cc-{{:02d}}', row_number() OVER (ORDER BY coalesce(corroborated, 0) > 0 DESC, accounts DESC, posts DESC, group_account)) AS candidate_id, group_account, first_seen, accounts, posts, coalesce(pieces, 0) AS pieces, majority, coalesce(corroborated, 0) > 0 AND majority IS NOT NULL AS retained
    FROM z LEFT JOIN t USING (group_account) LEFT JOIN v USING (group_account)""",
)
def win03(spark: SparkSession, d: str) -> DataFrame:
    p = posts(spark, d)
    found = C.candidates(p, *(table(spark, d, n) for n in ("post_domains", "post_contacts", "shared_hosts")), classify.placements(p))
    return found.select("candidate_id", "group_account", "first_seen", "accounts", "posts", "pieces", "majority", "retained")


@query("agg09_candidates_with_vectors")
def agg09(spark: SparkSession, d: str) -> DataFrame:
    """The whole assembly with content similarity; its parts have SQL of their own."""
    from sievework.plans.posts import _usable

    p = posts(spark, d)
    return C.candidates(p, *(table(spark, d, n) for n in ("post_domains", "post_contacts", "shared_hosts")), classify.placements(p), _usable(spark, d))


@query("agg12_system_rollup", f"{MEMBERS} SELECT count(DISTINCT group_account) AS candidates, count(*) AS accounts FROM members")
def agg12(spark: SparkSession, d: str) -> DataFrame:
    return C.groups(_reached(spark, d)).agg(F.countDistinct("group_account").alias("candidates"), F.count("*").alias("accounts"))


@query("agg13_filter_effect")
def agg13(spark: SparkSession, d: str) -> DataFrame:
    """Groups with listed domains and hosts let in, and how many of them the filter changes.

    Unfiltered groups grow nearly as large as the corpus, which is beyond a transitive closure in SQL.
    """
    return C.filter_effect(_reached(spark, d, True), _reached(spark, d))


@query(
    "flt06_account_survey",
    f"{MEMBERS}, everything AS (SELECT account FROM links WHERE account IS NOT NULL UNION SELECT account FROM m WHERE account IS NOT NULL AND value IS NOT NULL), a AS (SELECT DISTINCT account FROM posts WHERE account IS NOT NULL) SELECT CASE WHEN account IN (SELECT account FROM members) THEN 'in candidate' WHEN account IN (SELECT account FROM reached) THEN 'alone' WHEN account IN (SELECT account FROM everything) THEN 'silenced' ELSE 'unreachable' END AS state, count(*) AS accounts FROM a GROUP BY 1",
)
def flt06(spark: SparkSession, d: str) -> DataFrame:
    reached = _reached(spark, d)
    return C.survey(posts(spark, d), _reached(spark, d, True), reached, C.groups(reached)).groupBy("state").agg(F.count("*").alias("accounts"))


@query("flt05_evidence_lines", f"{REACHED} SELECT account, CASE WHEN kind = 'registration' THEN 'links ' || value ELSE 'publishes ' || value END AS line FROM reached")
def flt05(spark: SparkSession, d: str) -> DataFrame:
    return _reached(spark, d).select("account", F.concat(F.when(F.col("kind") == "registration", "links ").otherwise("publishes "), "value").alias("line")).distinct()


@query("rul09_evidence_type", f"{MEMBERS}, {SHARED} SELECT group_account, CASE WHEN bool_or(kind = 'registration') AND bool_or(kind <> 'registration') THEN 'both' WHEN bool_or(kind = 'registration') THEN 'domain' ELSE 'contact' END AS evidence FROM shared GROUP BY group_account")
def rul09(spark: SparkSession, d: str) -> DataFrame:
    shared, _ = _shared(spark, d)
    link, point = F.bool_or(F.col("kind") == "registration"), F.bool_or(F.col("kind") != "registration")
    return shared.groupBy("group_account").agg(F.when(link & point, "both").when(link, "domain").otherwise("contact").alias("evidence"))


ACCOUNTS = "ca AS (SELECT DISTINCT candidate_id, account FROM (SELECT candidate_id, unnest(accounts) AS account FROM campaign_candidates) WHERE account IS NOT NULL), truth AS (SELECT DISTINCT a.candidate_id AS campaign_id, a.account FROM ca a JOIN campaign_candidates c USING (candidate_id) WHERE c.cohesion.retained)"


def _accounts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "campaign_candidates").select("candidate_id", "cohesion.retained", F.explode("accounts").alias("account")).where("account IS NOT NULL").distinct()
    return rows.where("retained").select(F.col("candidate_id").alias("campaign_id"), "account").distinct(), rows.select("candidate_id", "account").distinct()


@query("join08_overlaps", f"WITH {ACCOUNTS}, b AS (SELECT campaign_id, candidate_id, count(*) AS held FROM truth JOIN ca USING (account) GROUP BY ALL) SELECT campaign_id, candidate_id, held, (SELECT count(*) FROM truth t WHERE t.campaign_id = b.campaign_id) - held AS missing, (SELECT count(*) FROM ca p WHERE p.candidate_id = b.candidate_id) - held AS extra FROM b")
def join08(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.overlaps(*_accounts(spark, d), "campaign_id", "candidate_id")


@query("join08_overlap_sets", f"WITH {ACCOUNTS}, b AS (SELECT DISTINCT campaign_id, candidate_id FROM truth JOIN ca USING (account)) SELECT campaign_id, candidate_id, coalesce(t.account, p.account) AS account, CASE WHEN p.account IS NULL THEN 'missing' WHEN t.account IS NULL THEN 'extra' ELSE 'held' END AS side FROM (SELECT b.*, account FROM b JOIN truth USING (campaign_id)) t FULL JOIN (SELECT b.*, account FROM b JOIN ca USING (candidate_id)) p USING (campaign_id, candidate_id, account)")
def join08s(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.overlap_sets(*_accounts(spark, d), "campaign_id", "candidate_id")


@query("agg17_outcomes", f"WITH {ACCOUNTS}, others AS (SELECT * FROM ca WHERE candidate_id NOT IN (SELECT campaign_id FROM truth)), b AS (SELECT campaign_id, candidate_id, count(*) AS held FROM truth JOIN others USING (account) GROUP BY ALL), w AS (SELECT campaign_id, bool_or(held = (SELECT count(*) FROM truth t WHERE t.campaign_id = b.campaign_id) AND held = (SELECT count(*) FROM others p WHERE p.candidate_id = b.candidate_id)) AS whole FROM b GROUP BY campaign_id) SELECT campaign_id, CASE WHEN whole THEN 'recovered' WHEN whole IS NOT NULL THEN 'partial' ELSE 'missed' END AS outcome FROM (SELECT DISTINCT campaign_id FROM truth) LEFT JOIN w USING (campaign_id)")
def agg17(spark: SparkSession, d: str) -> DataFrame:
    truth, proposed = _accounts(spark, d)
    others = proposed.join(truth.select(F.col("campaign_id").alias("candidate_id")).distinct(), "candidate_id", "left_anti")
    return evaluate.outcomes(truth, evaluate.overlaps(truth, others, "campaign_id", "candidate_id"), "campaign_id")


@query("agg18_false_groupings", f"WITH {ACCOUNTS} SELECT candidate_id, count(DISTINCT campaign_id) > 1 OR bool_or(campaign_id IS NULL) AS false_grouping FROM ca LEFT JOIN truth USING (account) GROUP BY candidate_id")
def agg18(spark: SparkSession, d: str) -> DataFrame:
    truth, proposed = _accounts(spark, d)
    return evaluate.false_groupings(proposed, truth, "candidate_id", "campaign_id")


@query("join09_owning_campaigns", f"WITH {ACCOUNTS} SELECT candidate_id, string_agg(DISTINCT campaign_id, ',' ORDER BY campaign_id) AS campaigns FROM ca JOIN truth USING (account) GROUP BY candidate_id")
def join09(spark: SparkSession, d: str) -> DataFrame:
    truth, proposed = _accounts(spark, d)
    return proposed.join(truth, "account").groupBy("candidate_id").agg(F.array_join(F.array_sort(F.collect_set("campaign_id")), ",").alias("campaigns"))


_ONCE = "c AS (SELECT candidate_id, any_value(len(accounts)) AS accounts, any_value(len(posts)) AS posts, any_value(cohesion.retained) AS retained FROM campaign_candidates GROUP BY candidate_id)"


def _once(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "campaign_candidates").dropDuplicates(["candidate_id"])
    return rows.select("candidate_id", F.size("accounts").alias("accounts"), F.size("posts").alias("posts"), "cohesion.retained")


@query("top02_candidate_order", f"WITH {_ONCE} SELECT row_number() OVER (ORDER BY retained DESC, accounts DESC, posts DESC, candidate_id) AS rank, candidate_id FROM c")
def top02(spark: SparkSession, d: str) -> DataFrame:
    return numbered(_once(spark, d), [F.desc("retained"), F.desc("accounts"), F.desc("posts"), F.asc("candidate_id")], "rank").select("rank", "candidate_id")


@query("agg19_precision", f"WITH {_ONCE}, r AS (SELECT retained, row_number() OVER (ORDER BY accounts DESC, posts DESC, candidate_id) AS rank FROM c) SELECT depth, CAST(sum((retained AND rank <= depth)::INT) AS BIGINT) AS hits, CAST(sum((rank <= depth)::INT) AS BIGINT) AS of FROM r, (VALUES (5), (10), (20), (50)) k(depth) GROUP BY depth")
def agg19(spark: SparkSession, d: str) -> DataFrame:
    ranked = store.top(_once(spark, d), [F.desc("accounts"), F.desc("posts"), F.asc("candidate_id")], 50)
    return evaluate.precision_at(ranked, "retained", (5, 10, 20, 50))


@query("agg11_quorum", """WITH c AS (SELECT DISTINCT candidate_id, coalesce(timing.corroborated > 0, false) AS t, coalesce(content_similarity.pieces > 0 AND content_similarity.corroborated = content_similarity.pieces, false) AS s,
    coalesce(list_aggregate(list_transform(list_filter(cohesion.category.tally, lambda x: x.name <> 'Other'), lambda x: x.count), 'sum') >= 2 AND 2 * list_aggregate(list_transform(list_filter(cohesion.category.tally, lambda x: x.name <> 'Other'), lambda x: x.count), 'max') > list_aggregate(list_transform(list_filter(cohesion.category.tally, lambda x: x.name <> 'Other'), lambda x: x.count), 'sum'), false) AS k FROM campaign_candidates)
    SELECT candidate_id, t AS temporal, s AS similar, k AS agreed, t::INT + s::INT + k::INT >= 2 AS retained FROM c""")
def agg11(spark: SparkSession, d: str) -> DataFrame:
    """The quorum applied to the stored records: what corroborates each candidate, and whether that keeps it."""
    return C.quorum(table(spark, d, "campaign_candidates")).distinct()


@query("agg20_host_census", "SELECT kind, count(*) AS rows, count(DISTINCT host) AS hosts FROM shared_hosts GROUP BY kind")
def agg20(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "shared_hosts").groupBy("kind").agg(F.count("*").alias("rows"), F.countDistinct("host").alias("hosts"))


@query("join10_within_evidence", f"WITH {ACCOUNTS}, x AS (SELECT DISTINCT c.candidate_id, s.domain AS domain, a.account FROM (SELECT candidate_id, unnest(shared_domains) AS s FROM campaign_candidates) c, unnest(s.accounts) a(account)) SELECT x.candidate_id, domain, count(*) AS members FROM x JOIN ca USING (candidate_id, account) WHERE domain IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def join10(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "campaign_candidates").select("candidate_id", F.explode("shared_domains").alias("s"))
    x = s.select("candidate_id", "s.domain", F.explode("s.accounts").alias("account")).where("domain IS NOT NULL").distinct()
    return x.join(_accounts(spark, d)[1], ["candidate_id", "account"]).groupBy("candidate_id", "domain").agg(F.count("*").alias("members")).where("members > 1")


@query("set02_held_missing_extra", "WITH c AS (SELECT DISTINCT candidate_id, list_sort(list_distinct(list_filter(accounts, lambda x: x IS NOT NULL))) AS a, list_sort(list_distinct(list_filter(flatten(list_transform(coalesce(shared_domains, []), lambda s: s.accounts)), lambda x: x IS NOT NULL))) AS s FROM campaign_candidates) SELECT candidate_id, array_to_string(list_sort(list_intersect(a, s)), ',') AS held, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(s, x))), ',') AS missing FROM c")
def set02(spark: SparkSession, d: str) -> DataFrame:
    s = F.flatten(F.transform(F.coalesce("shared_domains", F.array().cast("array<struct<domain:string,accounts:array<string>,posts:array<string>>>")), lambda x: F.coalesce(x["accounts"], F.array().cast("array<string>"))))
    c = table(spark, d, "campaign_candidates").select("candidate_id", F.array_distinct(F.array_compact("accounts")).alias("a"), F.array_compact(s).alias("s"))
    join = lambda x: F.array_join(F.array_sort(x), ",")
    return c.select("candidate_id", join(F.array_intersect("a", "s")).alias("held"), join(F.array_except("a", "s")).alias("missing")).distinct()


@query("set03_silenced_domains", f"{WITH} SELECT account FROM links WHERE account IS NOT NULL EXCEPT SELECT account FROM links ANTI JOIN listed USING (domain)")
def set03(spark: SparkSession, d: str) -> DataFrame:
    from sievework.plans.domains import links, listed

    all_ = links(spark, d).where("account IS NOT NULL")
    return all_.select("account").subtract(all_.join(listed(spark, d), "domain", "left_anti").select("account"))


@query("set04_all_accounts", f"WITH p AS ({POSTS}) SELECT account FROM p WHERE account IS NOT NULL UNION SELECT account FROM post_contacts WHERE account IS NOT NULL UNION SELECT account FROM post_domains WHERE account IS NOT NULL")
def set04(spark: SparkSession, d: str) -> DataFrame:
    own = [table(spark, d, n).select("account") for n in ("corpus", "post_contacts", "post_domains")]
    return own[0].union(own[1]).union(own[2]).where("account IS NOT NULL").distinct()


@query("agg10_extraction_recall")
def agg10(spark: SparkSession, d: str) -> DataFrame:
    """Published contact points against those read from the posts; the reader is tested by itself."""
    from sievework.functions import contacts

    published = table(spark, d, "post_contacts").select("post_id", F.explode("matches").alias("m")).select("post_id", F.lower("m.value").alias("value")).distinct()
    found = contacts.extract(posts(spark, d)).select("post_id", F.explode("matches").alias("m")).select("post_id", F.lower("m.value").alias("value")).distinct()
    return contacts.recall(published, found)


#: Groups are the stored candidates' accounts: many, overlapping and of all sizes.
_RECORDS = f"""{WITH}, {PLACED}, {MOMENTS}, m AS ({MATCHES}),
    mem AS (SELECT DISTINCT candidate_id AS g, account FROM (SELECT candidate_id, unnest(accounts) AS account FROM campaign_candidates) WHERE account IS NOT NULL),
    own AS (SELECT g, p.post_id, p.account, p.created_at FROM posts p JOIN mem USING (account)),
    ev AS (SELECT g, 'registration' AS kind, domain AS value, account, post_id, domain AS spelling FROM links ANTI JOIN listed USING (domain) JOIN mem USING (account)
        UNION SELECT g, kind, value, account, post_id, found_as FROM m JOIN mem USING (account) WHERE value IS NOT NULL AND (kind <> 'email' OR lower(regexp_extract(value, '[^@]*$')) NOT IN (SELECT domain FROM listed))),
    sh AS (SELECT ev.* FROM ev JOIN (SELECT g, kind, value FROM ev GROUP BY ALL HAVING count(DISTINCT account) > 1) w USING (g, kind, value)),
    gaps AS (SELECT g, kind, value, account, moment, lag(moment) OVER w AS before, lag(account) OVER w AS who FROM (SELECT DISTINCT g, kind, value, account FROM sh) JOIN (SELECT DISTINCT account, moment FROM moments WHERE moment IS NOT NULL) USING (account) WINDOW w AS (PARTITION BY g, kind, value ORDER BY moment, account)),
    times AS (SELECT g, kind, value, CAST(coalesce(min(CASE WHEN who <> account THEN moment - before END), 0) // 1000000 AS BIGINT) AS closest_seconds, CAST((max(moment) - min(moment)) // 1000000 AS BIGINT) AS span_seconds FROM gaps GROUP BY g, kind, value),
    e AS (SELECT DISTINCT post_id, embedding::DOUBLE[] AS v FROM content_embeddings WHERE dimensions = 256 AND len(embedding) = 256 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
    near AS (SELECT a.g, a.post_id AS post, min(1 - list_dot_product(x.v, y.v) / sqrt(list_dot_product(x.v, x.v)) / sqrt(list_dot_product(y.v, y.v))) AS distance FROM own a JOIN e x ON x.post_id = a.post_id JOIN own b ON a.g = b.g AND a.account <> b.account JOIN e y ON y.post_id = b.post_id GROUP BY ALL)"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    from sievework.plans.posts import _usable

    p = posts(spark, d)
    members = table(spark, d, "campaign_candidates").select(F.col("candidate_id").alias("group"), F.explode("accounts").alias("account")).where("account IS NOT NULL")
    return records.records(members, p, *(table(spark, d, n) for n in ("post_domains", "post_contacts", "shared_hosts")), classify.placements(p), _usable(spark, d))


@query("agg07_candidate_members", f"{_RECORDS} SELECT g AS candidate_id, min(created_at) AS first_seen, string_agg(DISTINCT account, ',' ORDER BY account) AS accounts, string_agg(DISTINCT post_id, ',' ORDER BY post_id) AS posts FROM own GROUP BY g")
def agg07m(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("candidate_id", "first_seen", F.array_join("accounts", ",").alias("accounts"), F.array_join("posts", ",").alias("posts"))


@query("agg07_shared_things", f"{_RECORDS} SELECT g AS candidate_id, kind, value, string_agg(DISTINCT account, ',' ORDER BY account) AS accounts, string_agg(DISTINCT post_id, ',' ORDER BY post_id) AS posts, string_agg(DISTINCT spelling, ' | ' ORDER BY spelling) AS spellings FROM sh GROUP BY ALL")
def agg07s(spark: SparkSession, d: str) -> DataFrame:
    found = _records(spark, d)
    links = found.select("candidate_id", F.explode("shared_domains").alias("x")).select("candidate_id", F.lit("registration").alias("kind"), F.col("x.domain").alias("value"), "x.accounts", "x.posts", F.array("x.domain").alias("spellings"))
    points = found.select("candidate_id", F.explode("shared_contact_points").alias("x")).select("candidate_id", "x.*")
    return links.unionByName(points).select("candidate_id", "kind", "value", F.array_join("accounts", ",").alias("accounts"), F.array_join("posts", ",").alias("posts"), F.array_join("spellings", " | ").alias("spellings"))


@query("win01_candidate_timing", f"{_RECORDS} SELECT g AS candidate_id, kind, value, closest_seconds, span_seconds FROM times")
def win01c(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("candidate_id", F.explode("corroboration").alias("x")).select("candidate_id", "x.*")


@query("agg09_candidate_similarity", f"{_RECORDS} SELECT g AS candidate_id, post, round(distance, 6) AS distance FROM near")
def agg09s(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("candidate_id", F.explode("similarity").alias("x")).select("candidate_id", "x.post", F.round("x.distance", 6).alias("distance"))


_COHESION = f"""{_RECORDS}, t AS (SELECT g, count(*) AS pieces, CAST(sum((span_seconds <= 86400)::INT) AS BIGINT) AS timely FROM times GROUP BY g), l AS (SELECT g, CAST(sum((distance <= 0.5)::INT) AS BIGINT) AS near, min(distance) AS closest FROM near GROUP BY g),
    n AS (SELECT g, scam_category AS name, count(*) AS n FROM own JOIN placed USING (post_id) GROUP BY ALL), v AS (SELECT g, string_agg(name || ' ' || n, ', ' ORDER BY name = 'Other', n DESC, name) AS tally, coalesce(sum(n) FILTER (name <> 'Other') >= 2 AND 2 * max(n) FILTER (name <> 'Other') > sum(n) FILTER (name <> 'Other'), false) AS agreed FROM n GROUP BY g),
    z AS (SELECT g, count(DISTINCT post_id) AS posts FROM own GROUP BY g),
    c AS (SELECT g AS candidate_id, coalesce(pieces, 0) AS pieces, coalesce(timely, 0) AS timely, posts, coalesce(near, 0) AS near, round(closest, 6) AS closest, tally, coalesce(timely, 0) > 0 AS t, coalesce(near, 0) = posts AS s, agreed AS k FROM z LEFT JOIN t USING (g) LEFT JOIN l USING (g) LEFT JOIN v USING (g)),
    kept AS (SELECT *, t::INT + s::INT + k::INT >= 2 AS retained FROM c)"""


@query("snk02_candidate_cohesion", f"{_COHESION} SELECT candidate_id, pieces, timely, posts, near, closest, tally, concat_ws(', ', CASE WHEN t THEN 'temporal proximity' END, CASE WHEN s THEN 'content similarity' END, CASE WHEN k THEN 'category agreement' END) AS corroborating, concat_ws(', ', CASE WHEN NOT t THEN 'temporal proximity' END, CASE WHEN NOT s THEN 'content similarity' END, CASE WHEN NOT k THEN 'category agreement' END) AS against, retained FROM kept")
def snk02(spark: SparkSession, d: str) -> DataFrame:
    c, t = F.col("content_similarity"), F.col("timing")
    tally = F.array_join(F.transform("cohesion.category.tally", lambda x: F.concat_ws(" ", x["name"], x["count"].cast("string"))), ", ")
    names = lambda n: F.array_join(f"cohesion.{n}", ", ").alias(n)
    return _records(spark, d).select("candidate_id", t["pieces"].alias("pieces"), t["corroborated"].alias("timely"), c["pieces"].alias("posts"), c["corroborated"].alias("near"), F.round(c["closest_distance"], 6).alias("closest"), tally.alias("tally"), names("corroborating"), names("against"), "cohesion.retained")


@query("agg12_candidate_rollup", f"{_COHESION}, x AS (SELECT DISTINCT candidate_id, account, retained FROM kept JOIN own ON g = candidate_id) SELECT system, count(DISTINCT candidate_id) AS candidates, count(DISTINCT account) AS accounts FROM (SELECT 'baseline' AS system, candidate_id, account FROM x UNION ALL SELECT CASE WHEN retained THEN 'retained' ELSE 'removed' END, candidate_id, account FROM x) GROUP BY system")
def agg12c(spark: SparkSession, d: str) -> DataFrame:
    return records.rollup(_records(spark, d))


@query("grf02_nodes", f"{MEMBERS}, {SHARED} SELECT 'account' AS kind, account AS name, group_account FROM members UNION ALL SELECT 'post', post_id, group_account FROM posts JOIN members USING (account) UNION ALL SELECT DISTINCT kind, value, group_account FROM shared")
def grf02(spark: SparkSession, d: str) -> DataFrame:
    shared, members = _shared(spark, d)
    return graph.nodes(members, posts(spark, d), shared)


@query("grf03_edges", f"{MEMBERS}, {SHARED} SELECT 'wrote' AS relation, account AS source, post_id AS target, group_account FROM posts JOIN members USING (account) UNION ALL SELECT DISTINCT 'shares', account, value, group_account FROM shared")
def grf03(spark: SparkSession, d: str) -> DataFrame:
    shared, members = _shared(spark, d)
    return graph.edges(members, posts(spark, d), shared)


@query("p4_hot_share", f"{WITH}, n AS (SELECT domain, count(*) AS n FROM links GROUP BY domain) SELECT domain, n AS links, round(n / (SELECT sum(n) FROM n), 6) AS share FROM n")
def p4_hot_share(spark: SparkSession, d: str) -> DataFrame:
    """Links of every domain and its share of all of them."""
    from sievework.plans.domains import links

    n = links(spark, d).groupBy("domain").agg(F.count("*").alias("links"))
    total = n.agg(F.sum("links").alias("of"))
    return n.crossJoin(F.broadcast(total)).select("domain", "links", F.round(F.col("links") / F.col("of"), 6).alias("share"))


