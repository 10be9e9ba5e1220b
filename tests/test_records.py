import pytest
from pyspark.sql import functions as F

from sievework.functions import contacts, rules
from sievework.operators import candidates, composition, evaluate, graph, records, score
from sievework.sources import contracts
from sievework.sources.suffixes import SMALL_RULES, classify_rules, digest, read_rules, rule_rows, survey

POSTS = "post_id string, account string, subreddit string, title string, body string, created_at string, links array<string>, domain string"
LINKS = "post_id string, account string, domains array<string>, links array<struct<link:string,scheme:string,host:string,domain:string,unresolved:string>>"
CONTACTS = "post_id string, account string, contact_points array<string>, matches array<struct<kind:string,value:string,found_as:string,field:string>>, unread array<struct<found_as:string,field:string,reason:string>>"


def world(spark):
    body = "Guaranteed returns for all. We do not say assured profit."
    posts = [
        ("p1", "a", None, "Trading signals", body, "2026-01-01T00:00:00Z", None, "clash"),
        ("p2", "b", None, "Signal group", "Join the signal desk.", "2026-01-01T01:30:00+00:00", [], "clash"),
        ("p3", "b", None, None, None, "no stamp", None, None),
        ("p4", "c", None, "Roles", "Apply now, shifts available.", None, None, None),
        ("p5", None, None, "x", "y", None, None, None),
    ]
    link = lambda d: (f"https://{d}/", "https", d, d, None)
    links = [("p1", "a", [], [link("Shop.example"), link("listed.example")]), ("p2", "b", [], [link("shop.example. ")]), ("p4", "c", [], [link("shap.example"), None]), ("p3", "b", None, None), ("p1", "a", [], [link("Shop.example"), link("listed.example")])]
    contacts = [("p1", "a", [], [("telegram", "desk_one", "@desk_one", "body"), ("email", "x@listed.example", "x@listed.example", "body")], []), ("p2", "b", [], [("telegram", "desk_one", "@Desk_One", "body")], []), ("p4", "c", None, None, None)]
    hosts = spark.createDataFrame([(" LISTED.example",), (None,)], "host string")
    vectors = [("p1", [1.0, 0.0]), ("p2", [1.0, 0.1]), ("p4", [0.0, 0.0])]
    return spark.createDataFrame(posts, POSTS), spark.createDataFrame(links, LINKS), spark.createDataFrame(contacts, CONTACTS), hosts, spark.createDataFrame(vectors, "post_id string, embedding array<float>")


def test_whole_records(spark):
    posts, links, points, hosts, vectors = world(spark)
    placed = posts.select("post_id", F.when(F.col("post_id").isin("p1", "p2"), "Investment and Money Offers").otherwise("Other").alias("scam_category"))
    members = spark.createDataFrame([("g", "a"), ("g", "b"), ("g", "a"), ("h", "c"), ("h", "nobody"), ("none", "nobody"), ("i", "b"), ("i", "c")], "group string, account string")
    got = {r.candidate_id: r for r in records.records(members, posts, links, points, hosts, placed, vectors).collect()}
    assert set(got) == {"g", "h", "i"}
    g = got["g"]
    assert (g.accounts, g.posts, g.first_seen) == (["a", "b"], ["p1", "p2", "p3"], "2026-01-01T00:00:00Z")
    assert [(d.domain, d.accounts, d.posts) for d in g.shared_domains] == [("shop.example", ["a", "b"], ["p1", "p2"])]
    assert [(p.kind, p.value, p.spellings) for p in g.shared_contact_points] == [("telegram", "desk_one", ["@Desk_One", "@desk_one"])]
    assert sorted((c.kind, c.closest_seconds, c.span_seconds) for c in g.corroboration) == [("registration", 5400, 5400), ("telegram", 5400, 5400)]
    assert (g.timing.pieces, g.timing.corroborated, g.timing.closest_seconds) == (2, 2, 5400)
    assert sorted((s.post, s.nearest, s.nearest_account) for s in g.similarity) == [("p1", "p2", "b"), ("p2", "p1", "a")]
    assert (g.content_similarity.pieces, g.content_similarity.corroborated) == (3, 2)
    assert (g.cohesion.corroborating, g.cohesion.against, g.cohesion.retained) == (["temporal proximity", "category agreement"], ["content similarity"], True)
    assert [(t.name, t["count"]) for t in g.cohesion.category.tally] == [("Investment and Money Offers", 2), ("Other", 1)]
    h = got["h"]
    assert (h.shared_domains, h.corroboration, h.similarity, h.cohesion.retained) == ([], [], [], False)
    assert {r.check: r.faults for r in contracts.candidate_checks(records.records(members.where("group = 'g'"), posts, links, points, hosts, placed, vectors)).collect() if r.faults} == {}
    totals = {r.system: (r.candidates, r.accounts) for r in records.rollup(records.records(members, posts, links, points, hosts, placed, vectors)).collect()}
    assert totals == {"baseline": (3, 3), "retained": (1, 2), "removed": (2, 2)}


def test_records_too_large_to_nest_keep_their_counts(spark):
    posts, links, points, hosts, vectors = world(spark)
    placed = posts.select("post_id", F.lit("Other").alias("scam_category"))
    members = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "c")], "group string, account string")
    got = {r.candidate_id: r for r in records.records(members, posts, links, points, hosts, placed, vectors, most=2).collect()}
    assert got["g"].accounts is None and got["g"].shared_domains is None and got["g"].timing.pieces == 2
    assert got["h"].accounts == ["c"]
    assert records.evidence(members, links, points, hosts).count() == 4
    assert records.records(members.limit(0), posts, links, points, hosts, placed, vectors).collect() == []


def test_evidence_and_score_records(spark):
    posts, links, hosts = (world(spark)[i] for i in (0, 1, 3))
    found = {(r.post_id, r.signal): r for r in score.evidence(posts, links, hosts).collect()}
    assert set(found) == {("p1", "guaranteed_return"), ("p1", "domain_frequency"), ("p2", "domain_frequency"), ("p1", "domain_lookalike"), ("p2", "domain_lookalike"), ("p4", "domain_lookalike")}
    assert (found["p1", "domain_frequency"].posts, found["p1", "domain_frequency"].accounts) == (2, 2)
    assert found["p1", "guaranteed_return"].phrases == ["guaranteed"] and found["p1", "guaranteed_return"].field == "body"
    whole = score.score_records(posts, links, hosts)
    got = {r.post_id: (r.points, r.score, [s.signal for s in r.signals]) for r in whole.collect()}
    assert got["p1"] == (75, score_of(75), ["domain_frequency", "domain_lookalike", "guaranteed_return"]) and got["p3"] == (0, 0, [])
    plain = {r.post_id: (r.points, r.score) for r in score.scores(posts, links, hosts).collect()}
    assert plain == {k: v[:2] for k, v in got.items()}
    assert score.read_scores(whole).count() == 5
    for broken in (whole.withColumn("points", F.col("points") + 1), whole.withColumn("signals", F.reverse("signals")), whole.withColumn("signals", F.transform("signals", lambda x: x.withField("evidence", F.slice(x["evidence"], 1, 0)))), whole.withColumn("signals", F.transform("signals", lambda x: x.withField("signal", F.lit("unknown"))))):
        with pytest.raises(ValueError):
            score.read_scores(broken)


def score_of(points):
    return (200 * points + rules.PUBLISHED_POINTS) // (2 * rules.PUBLISHED_POINTS)


def test_quorum_of_missing_parts(spark):
    kind = "candidate_id string, timing struct<corroborated:bigint>, content_similarity struct<pieces:bigint,corroborated:bigint>, cohesion struct<category:struct<tally:array<struct<name:string,count:bigint>>>>"
    rows = [("none", None, None, None), ("two", (1,), (2, 2), (([("Other", 5)],),)), ("tie", (1,), (0, 0), (([("Phishing", 2), ("Extortion", 2)],),)), ("votes", (0,), (3, 3), (([("Phishing", 3), ("Extortion", 1), ("Other", 9)],),))]
    assert {r.candidate_id: r.retained for r in candidates.quorum(spark.createDataFrame(rows, kind)).collect()} == {"none": False, "two": True, "tie": False, "votes": True}


def test_rules_of_a_file(spark, tmp_path):
    (tmp_path / "rules.txt").write_text(SMALL_RULES)
    rows = read_rules(spark, str(tmp_path / "rules.txt"))
    assert sorted(rows.collect()) == sorted(rule_rows(spark, SMALL_RULES).collect())
    assert {(r.kind, r.section): r.rules for r in survey(rows).collect()} == {("plain", "ICANN"): 4, ("wildcard", "ICANN"): 2, ("exception", "ICANN"): 2, ("plain", "PRIVATE"): 1}
    turned = classify_rules(spark.createDataFrame(list(enumerate(reversed(SMALL_RULES.splitlines()))), "line long, text string"))
    assert digest(rows).first() == digest(turned).first()


def test_rates_of_a_taxonomy(spark):
    taxonomy = spark.createDataFrame([("x", "A"), ("y", "A"), ("z", None)], "category string, scam_category string")
    rates = spark.createDataFrame([("A", 3)], "scam_category string, posts int")
    assert sorted((r.category, r.posts) for r in composition.placed_rates(taxonomy, rates).collect() if r.posts) == [("x", 3), ("y", 3)]
    with pytest.raises(ValueError):
        composition.placed_rates(taxonomy, spark.createDataFrame([("B", 3)], "scam_category string, posts int"))
    counts = spark.createDataFrame([("a", 1), ("b", 2), ("c", 0)], "k string, n int")
    assert {r.k: r.per_mille for r in composition.per_mille(counts, "n").collect()} == {"a": 333, "b": 667, "c": 0}
    assert composition.per_mille(counts.where("n < 0"), "n").collect() == []
    assert {r.per_mille for r in composition.per_mille(counts.where("n = 0"), "n").collect()} == {0}


def test_overlap_sets_and_worst_bin(spark):
    truth = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "z")], "t string, account string")
    proposed = spark.createDataFrame([("p", "b"), ("p", "c"), ("q", "x")], "p string, account string")
    assert {tuple(r) for r in evaluate.overlap_sets(truth, proposed, "t", "p").collect()} == {("t", "p", "a", "missing"), ("t", "p", "b", "held"), ("t", "p", "c", "extra")}
    bins = spark.createDataFrame([(0, 1, None), (1, 4, 0.25), (2, 4, 0.25), (3, 2, 0.1)], "bin int, rows int, gap double")
    assert tuple(evaluate.worst_bin(bins).first()) == (1, 0.25)
    assert evaluate.worst_bin(bins.where("gap IS NULL")).collect() == []
    rows = spark.createDataFrame([("b", 2.0), ("a", 0.0), ("a", None), (None, 4.0)], "k string, v double")
    assert {tuple(r) for r in evaluate.class_statistics(rows, "k", "v").collect()} == {("b", 1, 2.0, 2.0, 0), ("a", 2, 0.0, 0.0, 1), (None, 1, 4.0, 4.0, 0)}
    assert [r.external_id for r in evaluate.external(rows.select("k").where("k IS NOT NULL").distinct(), "k").orderBy("k").collect()] == ["ext_0001", "ext_0002"]


def test_pages_of_large_groups_count(spark, monkeypatch):
    monkeypatch.setattr(graph, "MOST_NODES", 3)
    nodes = spark.createDataFrame([("post", f"p{i}", "big") for i in range(5)] + [("account", "a", "small")], "kind string, name string, group_account string")
    edges = spark.createDataFrame([("wrote", "a", "p1", "big")], "relation string, source string, target string, group_account string")
    got = {r.group_account: r.html for r in graph.pages(nodes, edges).collect()}
    assert "<li>post: 5</li><li>wrote: 1</li>" in got["big"] and "<svg" in got["small"]


def test_reach_counts_equal_the_lists(spark):
    _, _, contacts_, _, _ = world(spark)
    listed = {(r.kind, r.value): (len(r.accounts), len(r.posts), r.spellings) for r in contacts.reach(contacts_).collect()}
    counted = {(r.kind, r.value): (r.accounts, r.posts, r.spellings) for r in contacts.reach_counts(contacts_).collect()}
    assert listed == counted and len(counted) == 2
