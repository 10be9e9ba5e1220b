"""Queries over links, domains, hosts and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import rules, urls
from sievework.functions.text import NEGATORS
from sievework.operators import classify, hot_keys, lookalike, score
from sievework.plans.registry import query, table
from sievework.sources.suffixes import SMALL_RULES, Rules, classify_rules, digest, registrable, rule_rows, survey

#: The folded spelling in the oracle's dialect.
FOLD = "regexp_replace(lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')), '\\.+$', '')"
#: Posts once each.
POSTS = "SELECT DISTINCT post_id, account, subreddit, title, body, created_at, links FROM corpus WHERE post_id IS NOT NULL"
LINKS = f"SELECT DISTINCT post_id, account, {FOLD.format('x.domain')} AS domain FROM (SELECT post_id, account, unnest(links) AS x FROM post_domains) WHERE x.domain IS NOT NULL"
LISTED = f"SELECT DISTINCT {FOLD.format('host')} AS domain FROM shared_hosts WHERE host IS NOT NULL"
WITH = f"WITH posts AS ({POSTS}), links AS ({LINKS}), listed AS ({LISTED})"


def posts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "corpus").where("post_id IS NOT NULL")
    return rows.select("post_id", "account", "subreddit", "title", "body", "created_at", "links").dropDuplicates(["post_id"])


def links(spark: SparkSession, d: str) -> DataFrame:
    return score.domain_links(table(spark, d, "post_domains"))


def listed(spark: SparkSession, d: str) -> DataFrame:
    return score.withheld_domains(table(spark, d, "shared_hosts"))


@query("p4_found", f"{WITH}, c AS (SELECT domain, account, count(post_id) AS n FROM links WHERE account IS NOT NULL GROUP BY ALL) SELECT domain, account FROM c QUALIFY row_number() OVER (PARTITION BY domain ORDER BY n DESC, account) = 1")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return hot_keys.leading_accounts(table(spark, d, "post_domains"))


@query("agg01_domain_reach", f"{WITH} SELECT domain, count(DISTINCT post_id) AS posts, count(DISTINCT account) AS accounts FROM links GROUP BY domain")
def agg01(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d).groupBy("domain").agg(F.countDistinct("post_id").alias("posts"), F.countDistinct("account").alias("accounts"))


@query("flt01_withheld", f"{WITH} SELECT domain, post_id FROM links ANTI JOIN listed USING (domain)")
def flt01(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d).join(listed(spark, d), "domain", "left_anti").select("domain", "post_id").distinct()


@query("flt03_shared_by_two", f"{WITH} SELECT domain, count(DISTINCT account) AS accounts FROM links GROUP BY domain HAVING count(DISTINCT account) >= 2")
def flt03(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d).groupBy("domain").agg(F.countDistinct("account").alias("accounts")).where("accounts >= 2")


@query(
    "join05_lookalikes",
    f"""{WITH}, d AS (SELECT DISTINCT domain, split_part(domain, '.', 1) AS label, CASE WHEN strpos(domain, '.') > 0 THEN substr(domain, strpos(domain, '.') + 1) ELSE '' END AS suffix FROM links)
    SELECT x.domain AS a, y.domain AS b FROM d x JOIN d y ON x.suffix = y.suffix AND x.domain < y.domain AND abs(length(x.label) - length(y.label)) <= 1 AND damerau_levenshtein(x.label, y.label) = 1""",
)
def join05(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalikes(links(spark, d))


#: Every distinct link with what it is stored to resolve to.
STORED_LINKS = f"SELECT DISTINCT x.link AS link, x.scheme AS scheme, x.host AS host, {FOLD.format('x.domain')} AS domain, x.unresolved AS unresolved FROM (SELECT unnest(links) AS x FROM post_domains) WHERE x.link IS NOT NULL"


def _link_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "post_domains").select("post_id", F.explode("links").alias("x")).select("post_id", "x.link").where("link IS NOT NULL")


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    one = _link_rows(spark, d).select("link").distinct()
    return one.select(urls.link_udf(Rules.parse(SMALL_RULES))("link").alias("x")).select("x.*")


@query("url05_registrable", "SELECT DISTINCT x.host AS host, " + FOLD.format("x.domain") + " AS domain FROM (SELECT unnest(links) AS x FROM post_domains) WHERE x.host IS NOT NULL")
def url05(spark: SparkSession, d: str) -> DataFrame:
    """The native expression over every host of the links; the oracle reads the domains stored with them."""
    hosts = table(spark, d, "post_domains").select(F.explode("links").alias("x")).select("x.host").where("host IS NOT NULL").distinct()
    return hosts.select("host", registrable("host", Rules.parse(SMALL_RULES)).alias("domain"))


@query("url01_resolved_links", f"SELECT link, domain, unresolved FROM ({STORED_LINKS})")
def url01(spark: SparkSession, d: str) -> DataFrame:
    """Every link resolved anew; the oracle reads what is stored beside it."""
    return _resolved(spark, d).select("link", "domain", "unresolved")


@query("url02_unresolved_reasons", f"SELECT coalesce(unresolved, 'resolved') AS reason, count(*) AS links FROM ({STORED_LINKS}) GROUP BY 1")
def url02(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).groupBy(F.coalesce("unresolved", F.lit("resolved")).alias("reason")).agg(F.count("*").alias("links"))


@query("url06_link_hosts", "SELECT x.scheme AS scheme, x.host AS host, count(*) AS links, count(DISTINCT post_id) AS posts FROM (SELECT post_id, unnest(links) AS x FROM post_domains) WHERE x.unresolved IS NULL AND x.link IS NOT NULL GROUP BY ALL")
def url06(spark: SparkSession, d: str) -> DataFrame:
    """Hosts of the resolved links, parsed anew."""
    named = _link_rows(spark, d).join(_resolved(spark, d).where("unresolved IS NULL").select("link", "scheme", "host"), "link")
    return named.groupBy("scheme", "host").agg(F.count("*").alias("links"), F.countDistinct("post_id").alias("posts"))


@query("url07_label_suffix", f"{WITH} SELECT DISTINCT domain, split_part(domain, '.', 1) AS label, CASE WHEN strpos(domain, '.') > 0 THEN substr(domain, strpos(domain, '.') + 1) ELSE '' END AS suffix FROM links")
def url07(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d).select("domain").distinct().select("domain", F.substring_index("domain", ".", 1).alias("label"), F.regexp_extract("domain", r"^[^.]*\.?(.*)$", 1).alias("suffix"))


@query("src06_suffix_kinds", "SELECT * FROM (VALUES ('plain', 4 + 1), ('wildcard', 2), ('exception', 2)) t(kind, rules)")
def src06(spark: SparkSession, d: str) -> DataFrame:
    return rule_rows(spark, SMALL_RULES).groupBy("kind").agg(F.count("*").alias("rules"))


@query("src07_suffix_survey", "SELECT * FROM (VALUES ('plain','ICANN',4),('wildcard','ICANN',2),('exception','ICANN',2),('plain','PRIVATE',1)) t(kind, section, rules)")
def src07(spark: SparkSession, d: str) -> DataFrame:
    return survey(rule_rows(spark, SMALL_RULES))


@query("src08_rules_digest", "SELECT sha256(concat_ws(chr(10), 'co.uk', 'com', 'github.io', 'net', 'org', '*.ck', '*.jp', '!city.kawasaki.jp', '!www.ck')) AS digest")
def src08(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(reversed(SMALL_RULES.splitlines())) if "===" not in t], "line long, text string")
    return digest(classify_rules(lines))


@query("src10_shared_hosts", f"SELECT {FOLD.format('host')} AS host, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, CAST(max(added) AS VARCHAR) AS last_updated FROM shared_hosts WHERE host IS NOT NULL GROUP BY 1")
def src10(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "shared_hosts").where("host IS NOT NULL")
    kinds = F.array_join(F.array_sort(F.collect_set("kind")), ",")
    return rows.groupBy(hot_keys.folded("host").alias("host")).agg(F.when(F.count("kind") > 0, kinds).alias("kinds"), F.max("added").cast("string").alias("last_updated"))


@query("agg27_domain_facts", f"{WITH} SELECT (SELECT count(*) FROM links) AS links, (SELECT count(DISTINCT domain) FROM links) AS domains, (SELECT count(DISTINCT post_id) FROM links) AS posts, (SELECT count(*) FROM (SELECT DISTINCT domain FROM links) SEMI JOIN listed USING (domain)) AS listed")
def agg27(spark: SparkSession, d: str) -> DataFrame:
    all_ = links(spark, d).join(listed(spark, d).withColumn("l", F.lit(True)), "domain", "left")
    return all_.agg(F.count("*").alias("links"), F.countDistinct("domain").alias("domains"), F.countDistinct("post_id").alias("posts"), F.countDistinct(F.when(F.col("l"), F.col("domain"))).alias("listed"))


def _class_sql() -> str:
    text = "lower(concat_ws(' . ', title, body))"
    words = lambda p: "|".join(r"\s+".join(w.replace("'", "''") for w in x.split()) for x in p)
    whens = " ".join(f"WHEN regexp_matches({text}, '(^|[^0-9a-z])({words(p)})($|[^0-9a-z])') THEN '{c}'" for c, p in rules.CATEGORY_PHRASES.items())
    return f"CASE {whens} ELSE 'Other' END"


PLACED = f"placed AS (SELECT post_id, account, {_class_sql()} AS scam_category FROM posts)"


@query("rul06_placements", f"{WITH}, {PLACED} SELECT post_id, scam_category FROM placed")
def rul06(spark: SparkSession, d: str) -> DataFrame:
    return classify.placements(posts(spark, d)).select("post_id", "scam_category")


@query("str04_class_evidence")
def str04(spark: SparkSession, d: str) -> DataFrame:
    """Sentences and phrases behind the placements; SQL has no look-behind to split sentences."""
    return classify.evidence(posts(spark, d)).withColumn("phrases", F.array_join("phrases", ","))


VOTES = "votes AS (SELECT l.domain, l.post_id, p.scam_category FROM links l ANTI JOIN listed USING (domain) JOIN placed p USING (post_id))"
MAJORITY = "majority AS (SELECT domain, sum(n) AS placed, max(n) AS top, CASE WHEN sum(n) >= 2 AND 2 * max(n) > sum(n) THEN arg_max(scam_category, n) END AS majority FROM (SELECT domain, scam_category, count(*) AS n FROM votes WHERE scam_category <> 'Other' GROUP BY ALL) GROUP BY domain)"


def _votes(spark: SparkSession, d: str) -> DataFrame:
    placed = classify.placements(posts(spark, d)).select("post_id", "scam_category")
    return links(spark, d).join(listed(spark, d), "domain", "left_anti").join(placed, "post_id")


@query("agg03_domain_tally", f"{WITH}, {PLACED}, {VOTES} SELECT domain, scam_category, count(*) AS posts FROM votes GROUP BY ALL")
def agg03(spark: SparkSession, d: str) -> DataFrame:
    return _votes(spark, d).groupBy("domain", "scam_category").agg(F.count("*").alias("posts"))


@query("agg04_domain_majority", f"{WITH}, {PLACED}, {VOTES}, {MAJORITY} SELECT domain, CAST(placed AS BIGINT) AS placed, top, majority FROM majority")
def agg04(spark: SparkSession, d: str) -> DataFrame:
    return classify.agreed(_votes(spark, d), "domain")


@query("agg05_tally_order", f"{WITH}, {PLACED}, {VOTES} SELECT domain, string_agg(scam_category || ' ' || n, ', ' ORDER BY (scam_category = 'Other'), n DESC, scam_category) AS tally FROM (SELECT domain, scam_category, count(*) AS n FROM votes GROUP BY ALL) GROUP BY domain")
def agg05(spark: SparkSession, d: str) -> DataFrame:
    tally = agg03(spark, d)
    entry = F.struct((F.col("scam_category") == rules.OTHER).alias("o"), (-F.col("posts")).alias("m"), "scam_category")
    return tally.groupBy("domain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.concat_ws(" ", x["scam_category"], (-x["m"]).cast("string"))), ", ").alias("tally"))


@query("rul01_domain_frequency", f"{WITH}, k AS (SELECT * FROM links ANTI JOIN listed USING (domain)) SELECT DISTINCT post_id FROM k WHERE domain IN (SELECT domain FROM k GROUP BY domain HAVING count(DISTINCT account) >= 2)")
def rul01(spark: SparkSession, d: str) -> DataFrame:
    return score.frequency(links(spark, d), listed(spark, d))


@query(
    "rul02_domain_lookalike",
    f"""{WITH}, d AS (SELECT DISTINCT domain, split_part(domain, '.', 1) AS label, CASE WHEN strpos(domain, '.') > 0 THEN substr(domain, strpos(domain, '.') + 1) ELSE '' END AS suffix FROM links),
    near AS (SELECT DISTINCT x.domain FROM d x JOIN d y ON x.suffix = y.suffix AND x.domain <> y.domain AND abs(length(x.label) - length(y.label)) <= 1 AND damerau_levenshtein(x.label, y.label) = 1)
    SELECT DISTINCT post_id FROM links SEMI JOIN near USING (domain)""",
)
def rul02(spark: SparkSession, d: str) -> DataFrame:
    return score.lookalike(links(spark, d))


@query("rul03_category_conflict", f"{WITH}, {PLACED}, {VOTES}, {MAJORITY} SELECT DISTINCT v.post_id FROM votes v JOIN majority m USING (domain) WHERE m.majority IS NOT NULL AND v.scam_category <> 'Other' AND v.scam_category <> m.majority")
def rul03(spark: SparkSession, d: str) -> DataFrame:
    return score.conflict(links(spark, d), classify.placements(posts(spark, d)), listed(spark, d))


_WS = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def _sentences_sql(field: str) -> str:
    return f"list_filter(string_split(regexp_replace(regexp_replace(coalesce({field}, ''), '^{_WS}|{_WS}$', '', 'g'), '([.!?]){_WS}', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_SIGNAL_ROWS = ", ".join(f"({_quoted(s)}, {_quoted(p)}, {_quoted('(^|[^0-9a-z])' + _WS.join(p.split()) + '($|[^0-9a-z])')})" for s, ps in rules.SIGNAL_PHRASES.items() for p in ps)
#: A phrase counts where no negator stands before it in its sentence, nor the word no right before it.
CONTENT = f"""ph(signal, phrase, pattern) AS (VALUES {_SIGNAL_ROWS}),
    se AS (SELECT DISTINCT post_id, lower(unnest({_sentences_sql("title")} || {_sentences_sql("body")})) AS s FROM posts),
    oc AS (SELECT post_id, signal, phrase, string_split(regexp_replace(s, pattern, '\\1' || chr(2) || '\\2', 'g'), chr(2)) AS parts FROM se, ph WHERE regexp_matches(s, pattern)),
    be AS (SELECT post_id, signal, unnest(list_transform(range(1, len(parts)), lambda i: regexp_extract_all(replace(array_to_string(parts[1:i], chr(2)), chr(2), ' ' || phrase || ' '), '[a-z0-9]+(?:[''’-][a-z0-9]+)*'))) AS w FROM oc),
    content AS (SELECT DISTINCT post_id, signal FROM be WHERE len(w) = 0 OR (w[-1] <> 'no' AND NOT list_has_any(w, [{", ".join(map(_quoted, NEGATORS))}])))"""


@query("rul04_content_signals", f"{WITH}, {CONTENT} SELECT post_id, signal FROM content")
def rul04(spark: SparkSession, d: str) -> DataFrame:
    return score.content(posts(spark, d))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return score.scores(posts(spark, d), table(spark, d, "post_domains"), table(spark, d, "shared_hosts"))


SCORES = f"""{WITH}, {PLACED}, {VOTES}, {MAJORITY}, {CONTENT}, kept AS (SELECT * FROM links ANTI JOIN listed USING (domain)),
    dn AS (SELECT DISTINCT domain, split_part(domain, '.', 1) AS label, CASE WHEN strpos(domain, '.') > 0 THEN substr(domain, strpos(domain, '.') + 1) ELSE '' END AS suffix FROM links),
    near AS (SELECT DISTINCT x.domain FROM dn x JOIN dn y ON x.suffix = y.suffix AND x.domain <> y.domain AND abs(length(x.label) - length(y.label)) <= 1 AND damerau_levenshtein(x.label, y.label) = 1),
    hits AS (SELECT post_id, signal FROM content UNION SELECT post_id, 'domain_frequency' FROM kept WHERE domain IN (SELECT domain FROM kept GROUP BY domain HAVING count(DISTINCT account) >= 2)
        UNION SELECT post_id, 'domain_lookalike' FROM links SEMI JOIN near USING (domain)
        UNION SELECT v.post_id, 'category_conflict' FROM votes v JOIN majority m USING (domain) WHERE m.majority IS NOT NULL AND v.scam_category <> 'Other' AND v.scam_category <> m.majority),
    weight(signal, weight) AS (VALUES ('category_conflict', 20), ('domain_frequency', 30), ('domain_lookalike', 20), ('guaranteed_return', 25), ('payment_request', 20), ('urgency_language', 15)),
    sums AS (SELECT post_id, sum(weight) AS points, string_agg(signal, ',' ORDER BY signal) AS signals FROM hits JOIN weight USING (signal) GROUP BY post_id),
    scores AS (SELECT p.post_id, p.account, CAST((200 * coalesce(points, 0) + 130) // 260 AS INTEGER) AS score, CAST(coalesce(points, 0) AS INTEGER) AS points, coalesce(signals, '') AS signals FROM posts p LEFT JOIN sums USING (post_id))"""


@query("agg14_policy_scores", f"{SCORES} SELECT post_id, account, score, points, signals FROM scores")
def agg14(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).withColumn("signals", F.array_join("signals", ","))


@query("top01_review_queue", f"{SCORES} SELECT row_number() OVER (ORDER BY score DESC, points DESC, post_id) AS rank, post_id, account, score, points FROM scores ORDER BY rank LIMIT 50")
def top01(spark: SparkSession, d: str) -> DataFrame:
    return score.queue(_scores(spark, d), 50)


@query("win04_queue_rank", f"{SCORES} SELECT row_number() OVER (ORDER BY score DESC, points DESC, post_id) AS rank, post_id FROM scores")
def win04(spark: SparkSession, d: str) -> DataFrame:
    """The place of every post in the queue, not only of the first."""
    return score.ranked(_scores(spark, d)).select("rank", "post_id")


@query("agg29_score_facts", f"{SCORES} SELECT count(*) AS posts, CAST(sum((points > 0)::INT) AS BIGINT) AS with_signals, CAST(sum(contains(signals, 'category_conflict')::INT) AS BIGINT) AS conflicting, max(score) AS highest, (SELECT count(DISTINCT domain) FROM kept) AS associated, (SELECT count(DISTINCT domain) FROM links SEMI JOIN listed USING (domain)) AS withheld FROM scores")
def agg29(spark: SparkSession, d: str) -> DataFrame:
    return score.facts(_scores(spark, d), links(spark, d), listed(spark, d))


def _score_records(spark: SparkSession, d: str) -> DataFrame:
    return score.score_records(posts(spark, d), table(spark, d, "post_domains"), table(spark, d, "shared_hosts"))


_LINES = f"""{SCORES}, fs AS (SELECT DISTINCT post_id, 'title' AS field, unnest({_sentences_sql("title")}) AS sentence FROM posts UNION SELECT DISTINCT post_id, 'body', unnest({_sentences_sql("body")}) FROM posts),
    fo AS (SELECT post_id, field, sentence, signal, phrase, string_split(regexp_replace(lower(sentence), pattern, '\\1' || chr(2) || '\\2', 'g'), chr(2)) AS parts FROM fs, ph WHERE regexp_matches(lower(sentence), pattern)),
    fb AS (SELECT post_id, field, sentence, signal, phrase, unnest(list_transform(range(1, len(parts)), lambda i: regexp_extract_all(replace(array_to_string(parts[1:i], chr(2)), chr(2), ' ' || phrase || ' '), '[a-z0-9]+(?:[''’-][a-z0-9]+)*'))) AS w FROM fo),
    fa AS (SELECT DISTINCT post_id, field, sentence, signal, phrase FROM fb WHERE len(w) = 0 OR (w[-1] <> 'no' AND NOT list_has_any(w, [{", ".join(map(_quoted, NEGATORS))}]))),
    reach AS (SELECT domain, count(DISTINCT post_id) AS posts, count(DISTINCT account) AS accounts FROM kept GROUP BY domain HAVING count(DISTINCT account) >= 2)
    SELECT post_id, signal, field || ': ' || string_agg(phrase, ', ' ORDER BY phrase) || ' in: ' || sentence AS line FROM fa GROUP BY post_id, signal, field, sentence
    UNION ALL SELECT DISTINCT post_id, 'domain_frequency', domain || ': ' || posts || ' posts, ' || accounts || ' accounts' FROM kept JOIN reach USING (domain)
    UNION ALL SELECT DISTINCT l.post_id, 'domain_lookalike', x.domain || ' resembles ' || y.domain FROM links l JOIN dn x USING (domain) JOIN dn y ON x.suffix = y.suffix AND x.domain <> y.domain AND abs(length(x.label) - length(y.label)) <= 1 AND damerau_levenshtein(x.label, y.label) = 1
    UNION ALL SELECT DISTINCT v.post_id, 'category_conflict', domain || ': ' || v.scam_category || ', but ' || top || ' of ' || placed || ' are ' || m.majority FROM votes v JOIN majority m USING (domain) WHERE m.majority IS NOT NULL AND v.scam_category <> 'Other' AND v.scam_category <> m.majority"""


@query("rul05_evidence_lines", _LINES)
def rul05(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of evidence of all four kinds, as its line."""
    found = score.evidence(posts(spark, d), table(spark, d, "post_domains"), table(spark, d, "shared_hosts"))
    return found.select("post_id", "signal", score.line().alias("line"))


@query("src12_score_checks", "SELECT unnest(['points', 'score', 'published', 'weight', 'order', 'no_evidence', 'shape']) AS \"check\", 0::BIGINT AS faults")
def src12(spark: SparkSession, d: str) -> DataFrame:
    """Points and scores of all records derived again from their evidence; a whole set has no fault."""
    return score.check_scores(_score_records(spark, d))


@query("mth03_normalised", "SELECT range AS points, CAST((200 * range + 130) // 260 AS INTEGER) AS score FROM range(131)")
def mth03(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(131).select(F.col("id").alias("points"), score.normalised(F.col("id")).alias("score"))


@query("rul07_taxonomy_projection", """SELECT * FROM (VALUES (NULL, 3, 10415), ('Bills, Invoicing and Collections', 6, 3897), ('Extortion', 1, 32779), ('Identity and Account Takeover', 4, 108701),
    ('Impersonating an Institution', 3, 42189), ('Investment and Money Offers', 5, 26130), ('Merchandise and Goods', 3, 42018), ('Other', 1, 10675), ('Phishing', 4, 36771),
    ('Prizes, Appeals and Psychics', 5, 5769), ('Relationships and Second Contacts', 3, 16818), ('Work and Payroll', 2, 14199)) t(scam_category, categories, reports)""")
def rul07(spark: SparkSession, d: str) -> DataFrame:
    """The oracle holds the published totals of each class."""
    return rules.taxonomy(spark).groupBy("scam_category").agg(F.count("*").alias("categories"), F.sum("reports").alias("reports"))


@query(
    "agg16_composition",
    f"""{WITH}, {PLACED}, n AS (SELECT scam_category AS category, count(*) AS posts FROM placed GROUP BY 1), t AS (SELECT count(*) AS of FROM placed)
    SELECT c.category, coalesce(n.posts, 0) AS posts, CAST((1000 * coalesce(n.posts, 0) + t.of // 2) // t.of AS BIGINT) AS per_mille FROM (VALUES {",".join(f"('{c}')" for c in rules.CLASSES)}) c(category) LEFT JOIN n USING (category), t""",
)
def agg16(spark: SparkSession, d: str) -> DataFrame:
    from sievework.operators.composition import shares

    return shares(classify.placements(posts(spark, d)))


_BASE = "b(category, reports) AS (VALUES ('Bills, Invoicing and Collections', 3897), ('Extortion', 32779), ('Identity and Account Takeover', 108701), ('Impersonating an Institution', 42189), ('Investment and Money Offers', 26130), ('Merchandise and Goods', 42018), ('Other', 10675), ('Phishing', 36771), ('Prizes, Appeals and Psychics', 5769), ('Relationships and Second Contacts', 16818), ('Work and Payroll', 14199))"


@query(
    "agg16_against_base_rates",
    f"""{WITH}, {PLACED}, {_BASE}, n AS (SELECT scam_category AS category, count(*) AS posts FROM placed GROUP BY 1),
    s AS (SELECT category, coalesce(posts, 0) AS posts, CAST((1000 * coalesce(posts, 0) + sum(posts) OVER () // 2) // sum(posts) OVER () AS BIGINT) AS per_mille, CAST((1000 * reports + sum(reports) OVER () // 2) // sum(reports) OVER () AS BIGINT) AS base FROM b LEFT JOIN n USING (category))
    SELECT category, posts, per_mille, base, per_mille - base AS difference FROM s""",
)
def agg16b(spark: SparkSession, d: str) -> DataFrame:
    from sievework.operators.composition import compared

    return compared(classify.placements(posts(spark, d)))
