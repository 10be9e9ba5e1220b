"""Queries over measures, folds, windows and plain relational shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions import rules, text
from sievework.operators import candidates as C
from sievework.operators import classify, composition, evaluate, model, store
from sievework.plans.domains import PLACED, POSTS, WITH, posts
from sievework.plans.groups import MOMENTS
from sievework.plans.registry import query, table
from sievework.sources import extract

_P = "(l_discount * 100 + 1) / 12"
_ROWS = f"r AS (SELECT {_P} AS p, (l_linestatus = 'O')::INT AS y FROM lineitem)"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(((F.col("l_discount") * 100 + 1) / 12).alias("p"), (F.col("l_linestatus") == "O").cast("int").alias("y"))


@query("agg21_auc", f"WITH {_ROWS}, k AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM r), s AS (SELECT sum(CASE WHEN y = 1 THEN rk END) AS t, sum(y) AS p, sum(1 - y) AS n FROM k) SELECT round((t - p * (p + 1) / 2.0) / (p * n), 9) AS auc FROM s")
def agg21(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.auc(_rows(spark, d), "p", "y").select(F.round("auc", 9).alias("auc"))


@query("agg22_losses", f"WITH {_ROWS} SELECT round(-avg(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier FROM r")
def agg22(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.losses(_rows(spark, d), "p", "y").select(F.round("log_loss", 6).alias("log_loss"), F.round("brier", 6).alias("brier"))


@query("agg23_calibration", f"WITH {_ROWS}, b AS (SELECT range::INT AS bin, range / 10.0 AS low, (range + 1) / 10.0 AS high FROM range(10)) SELECT bin, count(p) AS rows, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed, round(abs(avg(p) - avg(y)), 6) AS gap FROM b LEFT JOIN r ON p >= CAST(low AS DOUBLE) AND p < CAST(high AS DOUBLE) GROUP BY bin")
def agg23(spark: SparkSession, d: str) -> DataFrame:
    bins = evaluate.calibration(_rows(spark, d), "p", "y")
    return bins.select("bin", "rows", *(F.round(c, 6).alias(c) for c in ("predicted", "observed", "gap")))


_BINS = f"WITH {_ROWS}, b AS (SELECT range::INT AS bin, range / 10.0 AS low, (range + 1) / 10.0 AS high FROM range(10)), g AS (SELECT bin, count(p) AS n, abs(avg(p) - avg(y)) AS gap FROM b LEFT JOIN r ON p >= CAST(low AS DOUBLE) AND p < CAST(high AS DOUBLE) GROUP BY bin)"


@query("agg23_calibration_error", f"{_BINS} SELECT round(sum(n * coalesce(gap, 0)) / sum(n), 6) AS ece, (SELECT bin FROM g WHERE gap IS NOT NULL ORDER BY gap DESC, bin LIMIT 1) AS worst_bin, (SELECT round(max(gap), 6) FROM g) AS worst_gap FROM g")
def agg23e(spark: SparkSession, d: str) -> DataFrame:
    bins = evaluate.calibration(_rows(spark, d), "p", "y")
    worst = evaluate.worst_bin(bins).select(F.col("bin").alias("worst_bin"), F.round("gap", 6).alias("worst_gap"))
    return evaluate.expected_calibration_error(bins).select(F.round("ece", 6).alias("ece")).crossJoin(F.broadcast(worst))


@query("agg24_class_statistics", f"WITH p AS ({POSTS}), w AS (SELECT subreddit, len(regexp_extract_all(coalesce(body, ''), '[\\p{{L}}\\p{{N}}]+')) AS n FROM p) SELECT subreddit, count(*) AS rows, round(avg(n), 6) AS mean, median(n) AS median, CAST(sum((n = 0)::INT) AS BIGINT) AS zeros FROM w GROUP BY 1")
def agg24(spark: SparkSession, d: str) -> DataFrame:
    rows = posts(spark, d).select("subreddit", text.word_count("body").alias("n"))
    return evaluate.class_statistics(rows, "subreddit", "n").withColumn("mean", F.round("mean", 6))


@query("agg25_standardised", "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean_l_quantity, round(CASE WHEN stddev_pop(l_quantity) > 0 THEN stddev_pop(l_quantity) ELSE 1 END, 6) AS scale_l_quantity FROM lineitem GROUP BY 1")
def agg25(spark: SparkSession, d: str) -> DataFrame:
    s = model.standardised(table(spark, d, "lineitem"), ("l_quantity",), "l_returnflag")
    return s.select("l_returnflag", F.round("mean_l_quantity", 6).alias("mean_l_quantity"), F.round("scale_l_quantity", 6).alias("scale_l_quantity"))


@query("agg15_base_rates", "SELECT source AS category, count(*) AS reports, round(count(*) / sum(count(*)) OVER (), 6) AS base_rate FROM documents WHERE trim(source) <> '' GROUP BY 1")
def agg15(spark: SparkSession, d: str) -> DataFrame:
    return extract.base_rates(table(spark, d, "documents").select(F.col("source").alias("category")))


@query("mth01_sigmoid", "SELECT range AS x, round(1 / (1 + exp(-CAST(range AS DOUBLE))), 9) AS y FROM range(-40, 41)")
def mth01(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(-40, 41).select(F.col("id").alias("x"), F.round(model.sigmoid(F.col("id").cast("double")), 9).alias("y"))


@query("rul08_weights", "SELECT * FROM (VALUES ('category_conflict', 20), ('domain_frequency', 30), ('domain_lookalike', 20), ('guaranteed_return', 25), ('payment_request', 20), ('urgency_language', 15)) t(signal, weight)")
def rul08(spark: SparkSession, d: str) -> DataFrame:
    return rules.weights(spark)


@query("dat02_delays", f"WITH posts AS ({POSTS}), {MOMENTS}, r AS (SELECT post_id, min(received_at) AS received_at FROM corpus GROUP BY post_id) SELECT post_id, CAST((epoch_us(received_at) - moment) // 1000000 AS BIGINT) AS seconds FROM moments JOIN r USING (post_id) WHERE moment IS NOT NULL")
def dat02(spark: SparkSession, d: str) -> DataFrame:
    """Seconds from every stamp that can be read, in whatever spelling, to the first delivery."""
    first = table(spark, d, "corpus").groupBy("post_id").agg(F.min("received_at").alias("received_at"))
    rows = posts(spark, d).select("post_id", C.moment("created_at").alias("moment")).where("moment IS NOT NULL").join(first, "post_id")
    received = F.unix_micros(F.col("received_at").cast("timestamp"))
    return rows.select("post_id", F.floor((received - F.col("moment")) / 1_000_000).cast("bigint").alias("seconds"))


@query("str14_durations", """WITH s AS (SELECT DISTINCT c.closest_seconds AS seconds FROM (SELECT unnest(corroboration) AS c FROM campaign_candidates) UNION SELECT DISTINCT c.span_seconds FROM (SELECT unnest(corroboration) AS c FROM campaign_candidates))
    SELECT seconds, trim(CASE WHEN seconds IS NULL THEN NULL WHEN seconds >= 86400 THEN concat(seconds // 86400, ' d', CASE WHEN seconds % 86400 >= 3600 THEN concat(' ', seconds % 86400 // 3600, ' h') ELSE '' END)
    WHEN seconds >= 3600 THEN concat(seconds // 3600, ' h', CASE WHEN seconds % 3600 >= 60 THEN concat(' ', seconds % 3600 // 60, ' min') ELSE '' END)
    WHEN seconds >= 60 THEN concat(seconds // 60, ' min', CASE WHEN seconds % 60 > 0 THEN concat(' ', seconds % 60, ' s') ELSE '' END) ELSE concat(seconds, ' s') END) AS gap FROM s""")
def str14(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "campaign_candidates").select(F.explode("corroboration").alias("c")).select(F.explode(F.array("c.closest_seconds", "c.span_seconds")).alias("seconds")).distinct()
    return c.select("seconds", text.duration("seconds").alias("gap"))


@query("join02_dimension", f"{WITH}, {PLACED}, n AS (SELECT scam_category, count(*) AS posts FROM placed GROUP BY 1), c(scam_category, categories) AS (VALUES ('Bills, Invoicing and Collections', 6), ('Extortion', 1), ('Identity and Account Takeover', 4), ('Impersonating an Institution', 3), ('Investment and Money Offers', 5), ('Merchandise and Goods', 3), ('Other', 1), ('Phishing', 4), ('Prizes, Appeals and Psychics', 5), ('Relationships and Second Contacts', 3), ('Work and Payroll', 2), (NULL, 3)) SELECT c.scam_category, categories, posts FROM c LEFT JOIN n USING (scam_category)")
def join02(spark: SparkSession, d: str) -> DataFrame:
    """Every external category, placed or dropped, with the posts of its class: a small dimension, broadcast as such."""
    n = classify.placements(posts(spark, d)).groupBy("scam_category").agg(F.count("*").alias("posts"))
    return composition.placed_rates(rules.taxonomy(spark), n).groupBy("scam_category").agg(F.count("*").alias("categories"), F.max("posts").alias("posts"))


@query("join03_lookup", f"{WITH}, {PLACED}, n AS (SELECT DISTINCT candidate_id, unnest(posts) AS post_id FROM campaign_candidates) SELECT candidate_id, post_id, account, scam_category FROM n JOIN placed USING (post_id)")
def join03(spark: SparkSession, d: str) -> DataFrame:
    """Author and class of every post that a candidate names."""
    named = table(spark, d, "campaign_candidates").select("candidate_id", F.explode("posts").alias("post_id")).distinct()
    return named.join(classify.placements(posts(spark, d)).select("post_id", "account", "scam_category"), "post_id").select("candidate_id", "post_id", "account", "scam_category")


@query("join13_semi_anti", f"WITH p AS ({POSTS}), e AS (SELECT post_id FROM content_embeddings WHERE embedding IS NOT NULL), k AS (SELECT unnest(posts) AS post_id FROM campaign_candidates) SELECT side, count(*) AS posts FROM (SELECT 'with vector' AS side, post_id FROM p SEMI JOIN e USING (post_id) UNION ALL SELECT 'without vector', post_id FROM p ANTI JOIN e USING (post_id) UNION ALL SELECT 'named', post_id FROM p SEMI JOIN k USING (post_id) UNION ALL SELECT 'not named', post_id FROM p ANTI JOIN k USING (post_id)) GROUP BY side")
def join13(spark: SparkSession, d: str) -> DataFrame:
    p = posts(spark, d).select("post_id")
    e = table(spark, d, "content_embeddings").where("embedding IS NOT NULL")
    k = table(spark, d, "campaign_candidates").select(F.explode("posts").alias("post_id"))
    sides = [store.kept(p, e, "post_id"), store.missing(p, e, "post_id"), store.kept(p, k, "post_id"), store.missing(p, k, "post_id")]
    counted = [df.agg(F.count("*").alias("posts")).select(F.lit(name).alias("side"), "posts") for df, name in zip(sides, ("with vector", "without vector", "named", "not named"))]
    return counted[0].union(counted[1]).union(counted[2]).union(counted[3])


@query("join12_external_labels", "WITH d AS (SELECT printf('ext_%04d', row_number() OVER (ORDER BY doc_id)) AS external_id, doc_id, lang FROM documents) SELECT external_id, doc_id, coalesce(lang = 'en', false) AS label FROM d")
def join12e(spark: SparkSession, d: str) -> DataFrame:
    """Texts of an external set under running ids, paired with their labels again by them."""
    rows = table(spark, d, "documents").select("doc_id", F.coalesce(F.col("lang") == "en", F.lit(False)).alias("label"))
    return evaluate.external(rows, "doc_id").select("external_id", "doc_id", "label")


@query("join12_document_posts", f"WITH p AS ({POSTS}) SELECT doc_id, account FROM documents d JOIN p USING (post_id)")
def join12(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "post_id").join(posts(spark, d).select("post_id", "account"), "post_id").select("doc_id", "account")


@query("win07_share_of_total", f"WITH p AS ({POSTS}), n AS (SELECT subreddit, count(*) AS posts FROM p GROUP BY 1) SELECT subreddit, posts, CAST((1000 * posts + sum(posts) OVER () // 2) // sum(posts) OVER () AS BIGINT) AS per_mille FROM n")
def win07(spark: SparkSession, d: str) -> DataFrame:
    return composition.per_mille(posts(spark, d).groupBy("subreddit").agg(F.count("*").alias("posts")), "posts")


_TRUTH = "truth AS (SELECT account, min(candidate_id) AS campaign FROM (SELECT candidate_id, unnest(accounts) AS account FROM campaign_candidates WHERE cohesion.retained) WHERE account IS NOT NULL GROUP BY account), place AS (SELECT account, dense_rank() OVER (ORDER BY campaign) - 1 AS place FROM truth)"


def _truth(spark: SparkSession, d: str, most: int | None = None) -> DataFrame:
    rows = table(spark, d, "campaign_candidates").where("cohesion.retained").select("candidate_id", F.explode("accounts").alias("account")).where("account IS NOT NULL")
    named = rows.groupBy("account").agg(F.min("candidate_id").alias("campaign"))
    ids = named.select("campaign").distinct().withColumn("place", F.row_number().over(Window.orderBy("campaign")) - 1)
    return named.join(ids, "campaign").select("account", "place")


@query("ml02_labels", f"WITH p AS ({POSTS}), {_TRUTH} SELECT post_id, account IN (SELECT account FROM truth) AS label FROM p WHERE account IS NOT NULL")
def ml02(spark: SparkSession, d: str) -> DataFrame:
    flagged = _truth(spark, d).select("account", F.lit(True).alias("l"))
    return posts(spark, d).where("account IS NOT NULL").join(flagged, "account", "left").select("post_id", F.coalesce("l", F.lit(False)).alias("label"))


@query("win06_folds", f"WITH p AS ({POSTS}), {_TRUTH}, a AS (SELECT DISTINCT account FROM p WHERE account IS NOT NULL AND account NOT IN (SELECT account FROM truth)) SELECT account, CAST(place AS INTEGER) AS fold, true AS label FROM place UNION ALL SELECT account, CAST((row_number() OVER (ORDER BY account) - 1) % (SELECT max(place) + 1 FROM place) AS INTEGER), false FROM a")
def win06(spark: SparkSession, d: str) -> DataFrame:
    return model.folds(posts(spark, d), _truth(spark, d))


@query("ml01_features", f"WITH p AS ({POSTS}), l AS (SELECT DISTINCT post_id, coalesce(len(domains), 0) AS registrable_domains, coalesce(len(list_filter(links, lambda x: x.unresolved IS NOT NULL)), 0) AS unresolved_links FROM post_domains), c AS (SELECT DISTINCT post_id, coalesce(len(list_distinct(contact_points)) + (len(list_filter(contact_points, lambda x: x IS NULL)) > 0)::INT, 0) AS contact_points FROM post_contacts) SELECT post_id, len(regexp_extract_all(coalesce(title, ''), '[\\p{{L}}\\p{{N}}]+')) AS title_words, len(regexp_extract_all(coalesce(body, ''), '[\\p{{L}}\\p{{N}}]+')) AS body_words, coalesce(len(links), 0) AS links, coalesce(registrable_domains, 0) AS registrable_domains, coalesce(unresolved_links, 0) AS unresolved_links, coalesce(contact_points, 0) AS contact_points, len(list_filter(regexp_extract_all(concat_ws(' ', title, body), '[\\p{{L}}\\p{{N}}]+'), lambda w: regexp_matches(w, '\\p{{Nd}}'))) AS words_with_digits FROM p LEFT JOIN l USING (post_id) LEFT JOIN c USING (post_id)")
def ml01(spark: SparkSession, d: str) -> DataFrame:
    return model.features(posts(spark, d), table(spark, d, "post_domains"), table(spark, d, "post_contacts")).drop("account")


@query("ml05_confidences")
def ml05(spark: SparkSession, d: str) -> DataFrame:
    """Confidences of all posts, each by the fit of the campaigns it isn't held out with: one fit for each campaign."""
    folds = model.folds(posts(spark, d), _truth(spark, d))
    rows = model.features(posts(spark, d), table(spark, d, "post_domains"), table(spark, d, "post_contacts")).join(folds, "account")
    return model.confidences(rows)


@query("ml06_model_evaluation")
def ml06(spark: SparkSession, d: str) -> DataFrame:
    """AUC, log loss and Brier of the confidences beside a constant base rate."""
    from sievework.partitioning import checkpointed

    rows = checkpointed(ml05(spark, d).withColumn("y", F.col("label").cast("int")))
    base = rows.agg(F.avg("y").alias("base"))
    flat = rows.crossJoin(F.broadcast(base))
    name = lambda df, n: df.select(F.lit(n).alias("model"), "*")
    fitted = evaluate.auc(rows, "confidence", "y").crossJoin(evaluate.losses(rows, "confidence", "y"))
    constant = evaluate.auc(flat, "base", "y").crossJoin(evaluate.losses(flat, "base", "y"))
    return name(fitted, "fitted").unionByName(name(constant, "base rate"))
