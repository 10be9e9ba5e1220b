"""Queries over posts, contacts, stored vectors and records' integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import contacts, rules, text, vectors
from sievework.operators import store
from sievework.operators.hot_keys import folded
from sievework.operators.ranges import numbered
from sievework.plans.domains import FOLD, LISTED, POSTS, listed, posts
from sievework.plans.registry import query, table
from sievework.sources import contracts

MATCHES = "SELECT DISTINCT post_id, account, m.kind AS kind, m.value AS value, m.found_as AS found_as, m.field AS field FROM (SELECT post_id, account, unnest(matches) AS m FROM post_contacts)"


def matches(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "post_contacts").select("post_id", "account", F.explode("matches").alias("m")).select("post_id", "account", "m.*").distinct()


@query("src01_corpus_scan", "SELECT post_id, account, subreddit, length(title) AS title_chars, length(body) AS body_chars, created_at, len(links) AS links FROM (SELECT DISTINCT post_id, account, subreddit, title, body, created_at, links FROM corpus)")
def src01(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "corpus").select("post_id", "account", "subreddit", "title", "body", "created_at", "links").distinct()
    return rows.select("post_id", "account", "subreddit", F.length("title").alias("title_chars"), F.length("body").alias("body_chars"), "created_at", F.when(F.col("links").isNotNull(), F.size("links")).alias("links"))


@query("src04_typed_faults", f"WITH p AS ({POSTS}) SELECT count(*) AS posts, sum((account IS NULL OR trim(account) = '')::INT)::BIGINT AS no_account, sum((title IS NULL OR trim(title) = '')::INT)::BIGINT AS no_title, sum((body IS NULL OR trim(body) = '')::INT)::BIGINT AS no_body, sum((links IS NULL)::INT)::BIGINT AS no_links, sum((len(links) <> len(list_distinct(links)))::INT)::BIGINT AS repeated_links FROM p")
def src04(spark: SparkSession, d: str) -> DataFrame:
    blank = lambda c: F.sum((F.col(c).isNull() | (F.trim(c) == "")).cast("bigint"))
    repeated = F.sum((F.size("links") != F.size(F.array_distinct("links"))).cast("bigint"))
    return posts(spark, d).agg(F.count("*").alias("posts"), blank("account").alias("no_account"), blank("title").alias("no_title"), blank("body").alias("no_body"), F.sum(F.col("links").isNull().cast("bigint")).alias("no_links"), repeated.alias("repeated_links"))


@query("src05_repeated_keys", "SELECT post_id, count(*) AS n FROM corpus GROUP BY post_id HAVING count(*) > 1")
def src05(spark: SparkSession, d: str) -> DataFrame:
    return contracts.repeated(table(spark, d, "corpus"), "post_id")


@query(
    "src13_candidate_faults",
    """SELECT sum((len(list_distinct(list_filter(accounts, lambda x: x IS NOT NULL))) < 2)::INT)::BIGINT AS few_accounts,
    sum((len(list_filter(corroboration, lambda c: c.span_seconds < c.closest_seconds)) > 0)::INT)::BIGINT AS span_below_gap,
    sum((len(cohesion.against) + len(cohesion.corroborating) <> 3)::INT)::BIGINT AS not_three, sum((cohesion.retained <> (len(cohesion.corroborating) >= 2))::INT)::BIGINT AS quorum_broken,
    count(DISTINCT timing.window_seconds) AS windows FROM campaign_candidates""",
)
def src13(spark: SparkSession, d: str) -> DataFrame:
    return contracts.candidate_faults(table(spark, d, "campaign_candidates"))


_CHECKS = {
    "few_accounts": "len(list_distinct(accounts)) < 2",
    "repeated_accounts": "len(list_distinct(accounts)) + (len(list_filter(accounts, lambda x: x IS NULL)) > 0)::INT < len(accounts)",
    "null_accounts": "len(list_filter(accounts, lambda x: x IS NULL)) > 0",
    "no_posts": "len(posts) = 0",
    "repeated_posts": "len(list_distinct(posts)) < len(posts)",
    "nothing_shared": "len(shared_domains) = 0 AND len(shared_contact_points) = 0",
    "domain_of_one": "len(list_filter(shared_domains, lambda s: len(list_distinct(s.accounts)) < 2)) > 0",
    "domain_of_others": "len(list_filter(shared_domains, lambda s: NOT list_has_all(accounts, list_filter(s.accounts, lambda a: a IS NOT NULL)))) > 0",
    "domain_in_other_posts": "len(list_filter(shared_domains, lambda s: NOT list_has_all(posts, s.posts))) > 0",
    "repeated_domains": "len(list_distinct(list_transform(shared_domains, lambda s: s.domain))) + (len(list_filter(shared_domains, lambda s: s.domain IS NULL)) > 0)::INT < len(shared_domains)",
    "point_of_one": "len(list_filter(shared_contact_points, lambda s: len(list_distinct(s.accounts)) < 2)) > 0",
    "point_in_other_posts": "len(list_filter(shared_contact_points, lambda s: NOT list_has_all(posts, s.posts))) > 0",
    "pieces_miscounted": "timing.pieces <> len(corroboration)",
    "more_timely_than_pieces": "timing.corroborated > timing.pieces",
    "closest_not_least": "timing.closest_seconds <> list_min(list_transform(corroboration, lambda c: c.closest_seconds))",
    "timely_miscounted": "timing.corroborated <> len(list_filter(corroboration, lambda c: c.span_seconds <= timing.window_seconds))",
    "span_below_gap": "len(list_filter(corroboration, lambda c: c.span_seconds < c.closest_seconds)) > 0",
    "no_window": "timing.window_seconds < 3600",
    "similar_to_own": "len(list_filter(similarity, lambda x: x.account = x.nearest_account)) > 0",
    "similar_of_others": "len(list_filter(similarity, lambda x: NOT list_contains(posts, x.post) OR NOT list_contains(posts, x.nearest))) > 0",
    "distance_out_of_range": "len(list_filter(similarity, lambda x: x.distance < 0 OR x.distance > 2)) > 0",
    "near_miscounted": "content_similarity.corroborated <> len(list_filter(similarity, lambda x: x.distance <= content_similarity.threshold))",
    "not_three": "len(cohesion.against) + len(cohesion.corroborating) <> 3",
    "for_and_against": "list_has_any(cohesion.against, cohesion.corroborating)",
    "quorum_broken": "cohesion.retained <> (len(cohesion.corroborating) >= 2)",
    "class_twice": "len(list_distinct(list_transform(cohesion.category.tally, lambda t: t.name))) < len(cohesion.category.tally)",
    "empty_class": "len(list_filter(cohesion.category.tally, lambda t: t.count < 1)) > 0",
}


@query("src13_candidate_checks", " UNION ALL ".join(f"SELECT '{n}' AS \"check\", CAST(coalesce(sum(coalesce({c}, false)::INT), 0) AS BIGINT) AS faults FROM campaign_candidates" for n, c in _CHECKS.items()))
def src13c(spark: SparkSession, d: str) -> DataFrame:
    return contracts.candidate_checks(table(spark, d, "campaign_candidates"))


@query("src15_vector_models", "SELECT model, dimensions, count(*) AS rows, sum((NOT regexp_full_match(coalesce(text_sha256, ''), '[0-9a-f]{64}'))::INT)::BIGINT AS bad_digests FROM content_embeddings GROUP BY ALL")
def src15(spark: SparkSession, d: str) -> DataFrame:
    bad = ~F.coalesce("text_sha256", F.lit("")).rlike("^[0-9a-f]{64}$")
    return table(spark, d, "content_embeddings").groupBy("model", "dimensions").agg(F.count("*").alias("rows"), F.sum(bad.cast("bigint")).alias("bad_digests"))


@query("src16_missing_vectors", f"WITH p AS ({POSTS}) SELECT post_id FROM p ANTI JOIN (SELECT DISTINCT post_id FROM content_embeddings WHERE embedding IS NOT NULL) USING (post_id)")
def src16(spark: SparkSession, d: str) -> DataFrame:
    return store.missing(posts(spark, d).select("post_id"), table(spark, d, "content_embeddings").where("embedding IS NOT NULL"), "post_id")


_STORED = "stored AS (SELECT DISTINCT post_id, model, text_sha256 FROM content_embeddings WHERE dimensions = 128 AND post_id IS NOT NULL), fresh AS (SELECT DISTINCT post_id, model, text_sha256 FROM content_embeddings WHERE dimensions = 256 AND post_id IS NOT NULL)"


def _stored_fresh(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "content_embeddings").where("post_id IS NOT NULL")
    return tuple(rows.where(F.col("dimensions") == n).select("post_id", "model", "text_sha256").distinct() for n in (128, 256))


@query("snk06_upsert", f"WITH {_STORED} SELECT post_id, coalesce(f.model, s.model) AS model, coalesce(f.text_sha256, s.text_sha256) AS text_sha256 FROM stored s FULL JOIN fresh f USING (post_id)")
def snk06(spark: SparkSession, d: str) -> DataFrame:
    return store.upserted(*_stored_fresh(spark, d), "post_id")


@query("snk07_delete_absent", f"WITH p AS ({POSTS}) SELECT DISTINCT post_id, model FROM content_embeddings SEMI JOIN p USING (post_id)")
def snk07(spark: SparkSession, d: str) -> DataFrame:
    return store.kept(table(spark, d, "content_embeddings"), posts(spark, d), "post_id").select("post_id", "model").distinct()


@query("sto03_reuse", f"WITH {_STORED} SELECT action, count(*) AS rows FROM (SELECT CASE WHEN f.post_id IS NULL THEN 'removed' WHEN s.text_sha256 = f.text_sha256 THEN 'reused' ELSE 'computed' END AS action FROM stored s FULL JOIN fresh f ON s.post_id = f.post_id) GROUP BY 1")
def sto03(spark: SparkSession, d: str) -> DataFrame:
    return store.actions(*_stored_fresh(spark, d), "post_id", "text_sha256").groupBy("action").agg(F.count("*").alias("rows"))


@query("sto04_unrelated", f"WITH {_STORED} SELECT count(*) AS shared FROM stored s SEMI JOIN fresh f USING (post_id)")
def sto04(spark: SparkSession, d: str) -> DataFrame:
    stored, fresh = _stored_fresh(spark, d)
    return stored.join(fresh, "post_id", "left_semi").agg(F.count("*").alias("shared"))


@query("flt02_kept_contacts", f"WITH m AS ({MATCHES}), listed AS ({LISTED}) SELECT DISTINCT kind, value FROM m WHERE value IS NOT NULL AND (kind <> 'email' OR regexp_extract(lower(value), '[^@]*$') NOT IN (SELECT domain FROM listed))")
def flt02(spark: SparkSession, d: str) -> DataFrame:
    m = matches(spark, d).where("value IS NOT NULL").withColumn("domain", F.when(F.col("kind") == "email", F.lower(F.substring_index("value", "@", -1))))
    return m.join(listed(spark, d), "domain", "left_anti").select("kind", "value").distinct()


@query("flt07_unknown_posts", f"WITH p AS ({POSTS}), n AS (SELECT DISTINCT candidate_id, list_filter(accounts, lambda x: x IS NOT NULL) AS accounts, unnest(posts) AS post_id FROM campaign_candidates) SELECT DISTINCT candidate_id, n.post_id, CASE WHEN p.post_id IS NULL THEN 'unknown' ELSE 'another author' END AS fault FROM n LEFT JOIN p USING (post_id) WHERE p.post_id IS NULL OR p.account IS NULL OR NOT list_contains(accounts, p.account)")
def flt07(spark: SparkSession, d: str) -> DataFrame:
    """Posts that candidates name but that don't exist or were written by nobody of theirs."""
    named = table(spark, d, "campaign_candidates").select("candidate_id", F.array_compact("accounts").alias("accounts"), F.explode("posts").alias("post_id"))
    return contracts.foreign_posts(named, posts(spark, d))


@query("join01_post_records", f"WITH p AS ({POSTS}) SELECT p.post_id, coalesce(len(l.domains), 0) AS domains, coalesce(len(c.contact_points), 0) AS contact_points FROM p JOIN (SELECT DISTINCT post_id, domains FROM post_domains) l USING (post_id) JOIN (SELECT DISTINCT post_id, contact_points FROM post_contacts) c USING (post_id)")
def join01(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).alias(c)
    domains = table(spark, d, "post_domains").select("post_id", "domains").distinct()
    points = table(spark, d, "post_contacts").select("post_id", "contact_points").distinct()
    return posts(spark, d).select("post_id").join(domains, "post_id").join(points, "post_id").select("post_id", n("domains"), n("contact_points"))


@query("join04_posts_to_candidates", f"WITH p AS ({POSTS}), c AS (SELECT post AS post_id, string_agg(DISTINCT candidate_id, ',' ORDER BY candidate_id) AS candidates FROM (SELECT candidate_id, unnest(posts) AS post FROM campaign_candidates) GROUP BY 1) SELECT post_id, coalesce(candidates, '') AS candidates FROM p LEFT JOIN c USING (post_id)")
def join04(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "campaign_candidates").select("candidate_id", F.explode("posts").alias("post_id"))
    lists = named.groupBy("post_id").agg(F.array_join(F.array_sort(F.collect_set("candidate_id")), ",").alias("candidates"))
    return posts(spark, d).select("post_id").join(lists, "post_id", "left").select("post_id", F.coalesce("candidates", F.lit("")).alias("candidates"))


@query("agg02_contact_reach", f"WITH m AS ({MATCHES}) SELECT kind, value, count(DISTINCT account) AS accounts, count(DISTINCT post_id) AS posts, string_agg(DISTINCT found_as, ' | ' ORDER BY found_as) AS spellings FROM m GROUP BY kind, value")
def agg02(spark: SparkSession, d: str) -> DataFrame:
    return contacts.reach_counts(table(spark, d, "post_contacts")).withColumn("spellings", F.array_join("spellings", " | "))


@query("agg28_contact_facts", f"WITH m AS ({MATCHES}), v AS (SELECT kind, value, count(DISTINCT account) AS n FROM m GROUP BY kind, value), u AS (SELECT DISTINCT post_id, unread FROM post_contacts) SELECT (SELECT count(*) FROM v WHERE kind = 'email') AS addresses, (SELECT count(*) FROM v WHERE kind = 'telegram') AS handles, (SELECT count(*) FROM v WHERE kind = 'email' AND value LIKE '%.example') AS reserved, (SELECT count(*) FROM v WHERE starts_with(value, 'syn_')) AS marked, (SELECT count(*) FROM v WHERE n > 1) AS shared, (SELECT coalesce(sum(len(unread)), 0)::BIGINT FROM u) AS unread")
def agg28(spark: SparkSession, d: str) -> DataFrame:
    v = matches(spark, d).groupBy("kind", "value").agg(F.countDistinct("account").alias("n"))
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    facts = v.agg(n(F.col("kind") == "email").alias("addresses"), n(F.col("kind") == "telegram").alias("handles"), n((F.col("kind") == "email") & F.col("value").endswith(".example")).alias("reserved"), n(F.col("value").startswith("syn_")).alias("marked"), n(F.col("n") > 1).alias("shared"))
    unread = table(spark, d, "post_contacts").select("post_id", "unread").distinct().agg(F.coalesce(F.sum(F.when(F.col("unread").isNotNull(), F.size("unread"))), F.lit(0)).cast("bigint").alias("unread"))
    return facts.crossJoin(F.broadcast(unread))


@query("agg30_distinct_words", f"WITH p AS ({POSTS}) SELECT subreddit, count(DISTINCT w) AS words FROM (SELECT subreddit, unnest(regexp_extract_all(lower(coalesce(body, '')), '[\\p{{L}}\\p{{N}}]+')) AS w FROM p) GROUP BY subreddit")
def agg30(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words of every subreddit; distinct pairs come first, so that a hot subreddit is no task of its own."""
    words = F.regexp_extract_all(F.lower(F.coalesce("body", F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)
    pairs = posts(spark, d).select("subreddit", F.explode(F.array_distinct(words)).alias("w")).distinct()
    return pairs.groupBy("subreddit").agg(F.count("*").alias("words"))


@query("top04_contacts_by_reach", f"WITH m AS ({MATCHES}), r AS (SELECT kind, value, count(DISTINCT account) AS accounts FROM m GROUP BY ALL) SELECT row_number() OVER (ORDER BY accounts DESC, kind, value) AS rank, kind, value, accounts FROM r")
def top04(spark: SparkSession, d: str) -> DataFrame:
    r = matches(spark, d).groupBy("kind", "value").agg(F.countDistinct("account").alias("accounts"))
    return numbered(r, [F.desc("accounts"), F.asc("kind"), F.asc("value")], "rank")


@query("str05_word_counts", f"WITH p AS ({POSTS}) SELECT post_id, len(regexp_extract_all(coalesce(title, ''), '[\\p{{L}}\\p{{N}}]+')) AS title_words, len(regexp_extract_all(coalesce(body, ''), '[\\p{{L}}\\p{{N}}]+')) AS body_words FROM p")
def str05(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).select("post_id", text.word_count("title").alias("title_words"), text.word_count("body").alias("body_words"))


@query("str01_sentence_counts", f"WITH p AS ({POSTS}) SELECT post_id, len(list_filter(string_split(regexp_replace(regexp_replace(coalesce(body, ''), '^[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+|[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+$', '', 'g'), '([.!?])[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')) AS sentences FROM p")
def str01(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).select("post_id", F.size(text.sentences("body")).alias("sentences"))


def _spaced(phrase: str) -> str:
    return "\\s+".join(w.replace("'", "''") for w in phrase.split())


_ALL_PHRASES = ", ".join(f"('{p.replace(chr(39), chr(39) * 2)}', '(^|[^0-9a-z]){_spaced(p)}($|[^0-9a-z])')" for ps in rules.CATEGORY_PHRASES.values() for p in ps)


@query("str02_phrase_hits", f"WITH p AS ({POSTS}), f(phrase, pattern) AS (VALUES {_ALL_PHRASES}), b AS (SELECT post_id, regexp_replace(lower(coalesce(body, '')), '([^0-9a-z])', '\\1\\1', 'g') AS t FROM p) SELECT post_id, phrase, len(regexp_extract_all(t, pattern)) AS hits FROM b, f WHERE regexp_matches(t, pattern)")
def str02(spark: SparkSession, d: str) -> DataFrame:
    """Every phrase of every class in every body, with the number of places it begins at."""
    phrases = tuple(sorted({p for ps in rules.CATEGORY_PHRASES.values() for p in ps}))
    found = text.phrase_counts(F.coalesce("body", F.lit("")), phrases)
    return posts(spark, d).select("post_id", F.explode(found).alias("x")).select("post_id", "x.phrase", F.col("x.hits").cast("bigint").alias("hits"))


@query("str07_contact_points")
def str07(spark: SparkSession, d: str) -> DataFrame:
    """Contact points read from posts; the scanner keeps state that SQL can't."""
    return contacts.extract(posts(spark, d)).select("post_id", F.explode("matches").alias("m")).select("post_id", "m.*")


@query("str11_unread_reasons")
def str11(spark: SparkSession, d: str) -> DataFrame:
    return contacts.extract(posts(spark, d)).select(F.explode("unread").alias("u")).groupBy("u.reason").agg(F.count("*").alias("n"))


@query("str09_handle_fold", f"WITH m AS ({MATCHES}) SELECT DISTINCT found_as, lower(translate(found_as, '0134578', 'oieastb')) AS folded FROM m WHERE kind = 'telegram'")
def str09(spark: SparkSession, d: str) -> DataFrame:
    return matches(spark, d).where("kind = 'telegram'").select("found_as", F.lower(F.translate("found_as", "0134578", "oieastb")).alias("folded")).distinct()


_EMBEDDED = "array_to_string(list_filter([title, body] || coalesce(links, []), lambda x: x IS NOT NULL), chr(10))"


@query("str12_text_digests", f"WITH p AS ({POSTS}) SELECT post_id, sha256({_EMBEDDED}) AS digest FROM p")
def str12(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).select("post_id", F.sha2(vectors.embedded_text(), 256).alias("digest"))


@query("str13_embedded_text", f"WITH p AS ({POSTS}) SELECT post_id, {_EMBEDDED} AS text FROM p")
def str13(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).select("post_id", vectors.embedded_text().alias("text"))


@query("vec01_embeddings")
def vec01(spark: SparkSession, d: str) -> DataFrame:
    """Hashed embeddings of all posts; the hash is not one that SQL has."""
    e = posts(spark, d).select("post_id", vectors.embedding(vectors.embedded_text()).alias("embedding"))
    return e.select("post_id", F.size("embedding").alias("width"), F.round(vectors.dot("embedding", "embedding"), 4).alias("norm"))


@query("vec03_width_faults", "SELECT dimensions, count(*) AS rows, sum((embedding IS NULL)::INT)::BIGINT AS missing, sum((len(embedding) <> dimensions)::INT)::BIGINT AS wrong_width FROM content_embeddings GROUP BY dimensions")
def vec03(spark: SparkSession, d: str) -> DataFrame:
    wrong = F.sum((F.size("embedding") != F.col("dimensions")).cast("bigint") * F.col("embedding").isNotNull().cast("bigint"))
    t = table(spark, d, "content_embeddings")
    return t.groupBy("dimensions").agg(F.count("*").alias("rows"), F.sum(F.col("embedding").isNull().cast("bigint")).alias("missing"), wrong.alias("wrong_width"))


@query("vec02_candidate_distances", "WITH s AS (SELECT DISTINCT x.post AS post, x.nearest AS nearest FROM (SELECT unnest(similarity) AS x FROM campaign_candidates) WHERE x.post IS NOT NULL AND x.nearest IS NOT NULL), e AS (SELECT DISTINCT post_id, embedding FROM content_embeddings WHERE dimensions = 256 AND len(embedding) = 256 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0) SELECT post, nearest, round(1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS distance FROM s JOIN e a ON a.post_id = s.post JOIN e b ON b.post_id = s.nearest")
def vec02(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "campaign_candidates").select(F.explode("similarity").alias("x")).select("x.post", "x.nearest").where("post IS NOT NULL AND nearest IS NOT NULL").distinct()
    e = _usable(spark, d)
    both = s.join(e.select(F.col("post_id").alias("post"), F.col("embedding").alias("a")), "post").join(e.select(F.col("post_id").alias("nearest"), F.col("embedding").alias("b")), "nearest")
    return both.select("post", "nearest", F.round(vectors.cosine_distance("a", "b"), 6).alias("distance")).where("distance IS NOT NULL")


def _usable(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "content_embeddings").where((F.col("dimensions") == 256) & (F.size("embedding") == 256) & F.exists("embedding", lambda x: x != 0))
    return e.select("post_id", "embedding").dropDuplicates(["post_id"])


@query(
    "join06_cross_account_nearest",
    """WITH e AS (SELECT DISTINCT post_id, embedding::DOUBLE[] AS v FROM content_embeddings WHERE dimensions = 256 AND len(embedding) = 256 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
    m AS (SELECT DISTINCT c.candidate_id, x.post_id, o.account, e.v FROM (SELECT candidate_id, unnest(posts) AS post_id FROM campaign_candidates) x JOIN campaign_candidates c USING (candidate_id) JOIN (SELECT DISTINCT post_id, account FROM corpus WHERE account IS NOT NULL) o ON o.post_id = x.post_id JOIN e ON e.post_id = x.post_id),
    p AS (SELECT a.candidate_id, a.post_id, b.post_id AS nearest, 1 - list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) AS d FROM m a JOIN m b ON a.candidate_id = b.candidate_id AND a.account <> b.account)
    SELECT candidate_id, post_id, round(min(d), 6) AS distance FROM p GROUP BY candidate_id, post_id""",
)
def join06(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "campaign_candidates").select("candidate_id", F.explode("posts").alias("post_id")).distinct()
    rows = named.join(posts(spark, d).select("post_id", "account").where("account IS NOT NULL"), "post_id").join(_usable(spark, d), "post_id")
    return vectors.cross_group_nearest(rows, "candidate_id", "account").select("candidate_id", "post_id", F.round("distance", 6).alias("distance"))


_KNN = "SELECT a.vec_id, b.vec_id AS nearest, 1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0"


@query("join07_nearest_vectors", f"WITH p AS ({_KNN}), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), nearest) AS rank FROM p) SELECT vec_id, nearest, round(d, 6) AS distance, rank FROM r WHERE rank <= 5")
def join07(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return vectors.nearest_of(rows.where("vec_id % 50 = 0"), rows, 5, "vec_id").withColumn("distance", F.round("distance", 6))


@query("agg26_embedding_facts", f"WITH p AS ({POSTS}), n AS (SELECT account, len(regexp_extract_all(coalesce(body, ''), '[\\p{{L}}\\p{{N}}]+')) AS w FROM p) SELECT min(w) AS fewest, (SELECT w FROM n ORDER BY w LIMIT 1 OFFSET (SELECT count(*) // 2 FROM n)) AS upper_median, count(DISTINCT account) AS accounts FROM n")
def agg26(spark: SparkSession, d: str) -> DataFrame:
    n = posts(spark, d).select("account", text.word_count("body").alias("w"))
    return store.upper_median(n, "w").crossJoin(F.broadcast(n.agg(F.min("w").alias("fewest"), F.countDistinct("account").alias("accounts"))))


@query("arr01_sorted_links", f"WITH p AS ({POSTS}) SELECT post_id, array_to_string(list_sort(list_distinct(list_filter(links, lambda x: x IS NOT NULL))), ' ') AS links FROM p WHERE links IS NOT NULL")
def arr01(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).where("links IS NOT NULL").select("post_id", F.array_join(F.array_sort(F.array_distinct(F.array_compact("links"))), " ").alias("links"))


@query("map01_accounts_by_point", f"WITH c AS (SELECT DISTINCT account, {FOLD.format('p')} AS point FROM (SELECT account, unnest(contact_points) AS p FROM post_contacts) WHERE account IS NOT NULL AND p IS NOT NULL) SELECT point, string_agg(account, ',' ORDER BY account) AS accounts FROM c GROUP BY point")
def map01(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "post_contacts").where("account IS NOT NULL").select("account", F.explode("contact_points").alias("p")).where("p IS NOT NULL")
    return c.groupBy(folded("p").alias("point")).agg(F.array_join(F.array_sort(F.collect_set("account")), ",").alias("accounts"))
