import itertools
import json
import random

import numpy as np
import pytest

from sievework.functions import contacts, text, urls, vectors
from sievework.operators import candidates, evaluate, graph, hot_keys, lookalike, model, score, store
from sievework.partitioning import labels
from sievework.plans import reports
from sievework.sources import contracts
from sievework.sources.suffixes import SMALL_RULES, Rules, registrable

RULES = Rules.parse(SMALL_RULES + "рф\n")


def test_labels_fill_every_partition(spark):
    for n in (1, 4, 7):
        df = spark.createDataFrame([(x,) for x in labels(n)], "x int").repartition(n, "x")
        assert df.rdd.glom().map(len).collect() == [1] * n


@pytest.mark.parametrize(
    "host,want",
    [("example.com", "example.com"), ("foo.ck", None), ("www.ck", "www.ck"), ("a.city.kawasaki.jp", "city.kawasaki.jp"), ("a.b.nothing.unlisted", "nothing.unlisted"), ("example", None), ("shop.xn--p1ai", "shop.xn--p1ai"), ("github.io", None), ("a.b.x.github.io", "x.github.io")],
)
def test_registrable(spark, host, want):
    assert RULES.registrable(host) == want
    assert spark.createDataFrame([(host,)], "h string").select(registrable("h", RULES)).first()[0] == want


@pytest.mark.parametrize(
    "link,domain,reason",
    [
        ("https://vantage-ledger.example/entry", "vantage-ledger.example", None), ("/r/example/comments/abc", None, "relative"), ("mailto:someone@x.example", None, "no_host"), ("https://co.uk/pricing", None, "public_suffix"),
        ("http://192.0.2.1/pay", None, "address"), ("http://1.2.3.4.5/", None, "address"), (f"http://{'a' * 300}.com/", None, "invalid_host"), ("http://[::1/pay", None, "malformed"), ("//EXAMPLE.CO.UK./x", "example.co.uk", None), ("https://shop.рф/", "shop.xn--p1ai", None), ("http://exa mple.com", None, "invalid_host"),
    ],
)
def test_links(link, domain, reason):
    got = urls.resolve(link, RULES)
    assert (got["domain"], got["unresolved"]) == (domain, reason)


def test_resolve_links_keeps_order_and_nulls(spark):
    rows = [("p", "a", ["https://b.com/1", None, "https://a.com", "https://b.com/1"]), ("q", None, None), ("r", "x", [])]
    out = {r.post_id: r for r in urls.resolve_links(spark.createDataFrame(rows, "post_id string, account string, links array<string>"), RULES).collect()}
    assert [x.link for x in out["p"].links] == ["https://b.com/1", "https://a.com", "https://b.com/1"]
    assert out["p"].domains == ["a.com", "b.com"] and out["q"].links == [] and out["r"].domains == []


@pytest.mark.parametrize(
    "body,want",
    [
        ("@s.y.n._.v.a.n.t.a.g.e.l.e.d.g.e.r", "syn_vantageledger"), ("@s y n _ v a n t a g e l e d g e r, or ask", "syn_vantageledger"), ("@syn_v4ntag3ledger", "syn_vantageledger"), ("write i n t a k e @vantage-ledger.example now", "intake@vantage-ledger.example"),
        ("desk@gr4vy.io", "desk@gr4vy.io"), ("Desk@GRAVY.io.", "Desk@gravy.io"), ("email me @ t o n i g h t at 8", "tonight"),
    ],
)
def test_contact_values(body, want):
    assert [m["value"] for m in contacts.scan_post(None, body, None)["matches"]] == [want]


@pytest.mark.parametrize("body,reason", [("5 0 0 @syn_vantageledger usdt", "no_domain"), ("see @ 9", "handle_too_short"), ("email me @ home about it", "prose"), ("nobody@localhost", "no_domain"), ("@", "no_name"), ("@" + "a" * 40, "handle_too_long"), ("@1abcdef.gh", "handle_character"), ("x@" + "a" * 250 + ".example", "address_too_long")])
def test_contact_faults(body, reason):
    assert [u["reason"] for u in contacts.scan_post(None, body, None)["unread"]] == [reason]


def test_contact_links(spark):
    links = ["mailto:a@b.example", "https://t.me/syn_someone/5", "https://t.me/+abc", "http://[::1/", "https://page.example/@x", None]
    rows = [("p", "acc", None, "no contact", links), ("q", None, "t", None, None)]
    out = {r.post_id: r for r in contacts.extract(spark.createDataFrame(rows, "post_id string, account string, title string, body string, links array<string>")).collect()}
    assert out["p"].contact_points == ["a@b.example", "syn_someone"]
    assert [u.reason for u in out["p"].unread] == ["invite_link", "malformed"]
    assert out["q"].matches == [] and out["q"].unread == []


def test_negation():
    assert text.affirmed("Returns are guaranteed", "guaranteed")
    assert not text.affirmed("Nothing here is guaranteed", "guaranteed")
    assert not text.affirmed("There is no guaranteed return", "guaranteed")
    assert text.affirmed("No fuss, guaranteed", "guaranteed")
    assert text.affirmed("no guaranteed sum but a guaranteed place", "guaranteed")


def test_sentences(spark):
    df = spark.createDataFrame([("One. Two!  Three? x.y ",), (None,), (" \n ",)], "t string")
    assert [r[0] for r in df.select(text.sentences("t")).collect()] == [["One.", "Two!", "Three?", "x.y"], [], []]


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_lookalikes(spark):
    r = random.Random(0)
    names = {"".join(r.choice("abc") for _ in range(r.randrange(1, 6))) for _ in range(80)}
    domains = [f"{n}.{s}" for n in names for s in ("com", "co.uk") if r.random() < 0.8] + ["plain", None]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(domains)], "domain string, variant int")
    want = {(a, b) for a in domains for b in domains if a and b and a < b and "." in a and "." in b and a.partition(".")[2] == b.partition(".")[2] and osa(a.partition(".")[0], b.partition(".")[0]) == 1}
    assert {tuple(x) for x in lookalike.lookalikes(df).collect()} == want


def test_leading_member(spark):
    rows = [("d", "b", "1", 0), ("d", "a", "2", 0), ("d", "b", "1", 0), ("e", None, "1", 0), (None, "a", "1", 0), ("f", "z", None, 0)]
    df = spark.createDataFrame(rows, "domain string, account string, post_id string, n int")
    assert {tuple(r) for r in hot_keys.leading_member(df, "domain", "account", "post_id").collect()} == {("d", "a"), ("f", "z")}
    links = "array<struct<link:string,domain:string>>"
    posts = spark.createDataFrame([("p", "a", [("l", " X.example. "), ("l", "x.EXAMPLE"), ("l", None)]), ("q", "b", None), ("r", None, [("l", "y.example")])], f"post_id string, account string, links {links}")
    assert [tuple(r) for r in hot_keys.leading_accounts(posts).collect()] == [("x.example", "a")]
    assert hot_keys.leading_accounts(posts.limit(0)).collect() == []


def test_leading_member_with_a_hot_key(spark):
    df = spark.range(60_000).selectExpr("if(id % 3 = 0, concat('k', id % 500), 'hot') AS domain", "concat('a', id % 97) AS account", "cast(id AS string) AS post_id")
    pdf = df.toPandas().groupby(["domain", "account"]).post_id.nunique().reset_index().sort_values(["domain", "post_id", "account"], ascending=[True, False, True]).drop_duplicates("domain")
    assert {tuple(r) for r in hot_keys.leading_member(df, "domain", "account", "post_id").collect()} == set(zip(pdf.domain, pdf.account))


def test_leading_member_with_and_without_few_repeats(spark, monkeypatch):
    df = spark.range(4_000).selectExpr("concat('k', id % 7) AS domain", "concat('a', id % 11) AS account", "cast(id % 900 AS string) AS post_id")
    found = []
    for few in (hot_keys.FEW_REPEATED, 0):
        monkeypatch.setattr(hot_keys, "FEW_REPEATED", few)
        found.append(sorted(map(tuple, hot_keys.leading_member(df, "domain", "account", "post_id").collect())))
    assert found[0] == found[1] and len(found[0]) == 7


def test_foreign_posts(spark):
    named = spark.createDataFrame([("c", ["a"], "p"), ("c", ["a"], "q"), ("c", ["a"], "x"), ("d", None, "p"), ("c", ["a"], "x")], "candidate_id string, accounts array<string>, post_id string")
    posts = spark.createDataFrame([("p", "a"), ("q", "b")], "post_id string, account string")
    assert {tuple(r) for r in contracts.foreign_posts(named, posts).collect()} == {("c", "q", "another author"), ("c", "x", "unknown"), ("d", "p", "another author")}


def test_durations(spark):
    want = {0: "0 s", 59: "59 s", 60: "1 min", 61: "1 min 1 s", 3600: "1 h", 3661: "1 h 1 min", 86_400: "1 d", 90_061: "1 d 1 h", 86_401: "1 d", None: None}
    df = spark.createDataFrame([(k,) for k in want], "seconds bigint")
    assert {r.seconds: r.gap for r in df.select("seconds", text.duration("seconds").alias("gap")).collect()} == want
    assert [reports.duration(k) for k in (0, 61, 90_061)] == ["0 s", "1 min 1 s", "1 d 1 h"]


def test_timing(spark):
    shared = spark.createDataFrame([("a", "g", "k", "v"), ("b", "g", "k", "v"), ("c", "g", "k", "lone")], "account string, group_account string, kind string, value string")
    moments = spark.createDataFrame([("a", 0), ("a", 3_600_000_000), ("b", 5_400_000_000), ("b", 16_200_000_000), ("c", 1), ("b", None)], "account string, moment bigint")
    got = {r.value: (r.closest_seconds, r.span_seconds) for r in candidates.timing(shared, moments).collect()}
    assert got == {"v": (1800, 16_200), "lone": (0, 0)}


def test_parameters_are_refused():
    for hours, threshold in ((0, 0.5), (24, 0), (24, 1.5)):
        with pytest.raises(ValueError):
            candidates.check_parameters(hours, threshold)


def test_measures(spark):
    r = np.random.default_rng(0)
    s, y = r.integers(0, 8, 200) / 10 + 0.05, r.integers(0, 2, 200)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "p double, y int")
    won = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert abs(evaluate.auc(df, "p", "y").first().auc - won) < 1e-12
    assert evaluate.auc(df.where("y = 1"), "p", "y").first().auc == 0.5
    assert evaluate.auc(df.limit(0), "p", "y").first().auc == 0.5
    loss = evaluate.losses(df, "p", "y").first()
    assert abs(loss.brier - ((s - y) ** 2).mean()) < 1e-12
    assert abs(loss.log_loss + np.where(y == 1, np.log(s), np.log(1 - s)).mean()) < 1e-12
    bins = evaluate.calibration(df, "p", "y")
    assert bins.count() == 10 and bins.agg({"rows": "sum"}).first()[0] == 200
    edge = evaluate.calibration(spark.createDataFrame([(0.3, 1), (0.7, 0), (0.29999, 1)], "p double, y int"), "p", "y").where("rows > 0").orderBy("bin").collect()
    assert [(b.bin, b.rows) for b in edge] == [(2, 1), (3, 1), (7, 1)]
    ranked = spark.createDataFrame([(1, True), (2, False), (3, True)], "rank int, hit boolean")
    assert [tuple(x) for x in evaluate.precision_at(ranked, "hit", (2, 5)).collect()] == [(2, 1, 2), (5, 2, 3)]


def test_outcomes(spark):
    truth = spark.createDataFrame([("t1", "a"), ("t1", "b"), ("t2", "c"), ("t2", "d"), ("t3", "e")], "t string, account string")
    proposed = spark.createDataFrame([("p1", "a"), ("p1", "b"), ("p2", "c"), ("p2", "x")], "p string, account string")
    matched = evaluate.overlaps(truth, proposed, "t", "p")
    assert {tuple(r) for r in matched.collect()} == {("t1", "p1", 2, 0, 0), ("t2", "p2", 1, 1, 1)}
    assert dict(map(tuple, evaluate.outcomes(truth, matched, "t").collect())) == {"t1": "recovered", "t2": "partial", "t3": "missed"}
    assert dict(map(tuple, evaluate.false_groupings(proposed, truth, "p", "t").collect())) == {"p1": False, "p2": True}


def test_distributed_fit_equals_local(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = [(i, f"a{i}", bool(v), i % 3, *map(int, x)) for i, (v, x) in enumerate(zip(r.integers(0, 2, 60), r.integers(0, 9, (60, 2))))]
    df = spark.createDataFrame(rows, "post_id bigint, account string, label boolean, fold int, f1 int, f2 int")
    monkeypatch.setattr(model, "STEPS", 5)
    fit = lambda n: {r.held: np.array([r.bias, *r.weights]) for r in model.fit_folds(df, ("f1", "f2"), n).collect()}
    far = fit(1)
    monkeypatch.setattr(model, "STEPS", 5)
    x, y = np.array([r_[4:] for r_ in rows], float), np.array([r_[2] for r_ in rows], float)
    for held, got in far.items():
        keep = np.array([r_[3] for r_ in rows]) != held
        w, b, *_ = model.train(x[keep], y[keep], np.ones(keep.sum()))
        assert np.allclose(got, [b, *w], atol=1e-9)


def test_fits_of_many_folds_equal_one_by_one():
    r = np.random.default_rng(3)
    x, y, n, fold = r.integers(0, 5, (300, 3)).astype(float), r.integers(0, 2, 300).astype(float), r.integers(1, 4, 300).astype(float), r.integers(0, 23, 300)
    x[:, 2] = np.where(fold == 7, x[:, 2], 2)  # no spread once fold 7 is held out
    held = np.array([0, 7, 22])
    for got, f in zip(zip(*model.train_held(x, y, n, fold, held)), held):
        keep = fold != f
        want = [*model.train(x[keep][:, :2], y[keep], n[keep])]
        if f == 7:
            assert got[3][2] == 1 and abs(got[0][2]) < 1e-12
            got = (got[0][:2], got[1], got[2][:2], got[3][:2])
        else:
            want = [*model.train(x[keep], y[keep], n[keep])]
        for a, b in zip(got, want):
            assert np.allclose(a, b, atol=1e-11)


def test_a_fold_for_each_campaign(spark, tmp_path):
    from sievework.plans import registry

    post = [(f"p{i:02}", f"a{i // 2:02}", "s", "word " * (i % 7), "word 1 " * (i % 5), "2024", []) for i in range(40)]
    spark.createDataFrame(post, "post_id string, account string, subreddit string, title string, body string, created_at string, links array<string>").write.parquet(f"{tmp_path}/corpus.parquet")
    spark.createDataFrame([], "post_id string, domains array<string>, links array<struct<unresolved: string>>").write.parquet(f"{tmp_path}/post_domains.parquet")
    spark.createDataFrame([], "post_id string, contact_points array<string>").write.parquet(f"{tmp_path}/post_contacts.parquet")
    spark.createDataFrame([(f"c{i}", [f"a{i:02}"], (True,)) for i in range(8)], "candidate_id string, accounts array<string>, cohesion struct<retained: boolean>").write.parquet(f"{tmp_path}/campaign_candidates.parquet")
    queries = registry.queries()
    folds = {r.account: r.fold for r in queries["win06_folds"](spark, str(tmp_path)).collect()}
    got = queries["ml05_confidences"](spark, str(tmp_path)).collect()
    assert len(got) == 40 and len(set(folds.values())) == 8
    assert {r.account: r.fold for r in got} == folds


def test_odd_links_are_scanned(spark):
    links = ["http://exa]mple.com", "https://user@[::1/x", "http://\u2100.example", "mail\nto:anna@b.example", "https://t\n.me/anna_b", "https://plain.example"]
    rows = [(str(i), "a", None, None, [x]) for i, x in enumerate(links)]
    out = {r.post_id: r for r in contacts.extract(spark.createDataFrame(rows, "post_id string, account string, title string, body string, links array<string>")).collect()}
    assert [[u.reason for u in out[str(i)].unread] for i in range(6)] == [["malformed"]] * 3 + [[]] * 3
    assert [out[str(i)].contact_points for i in range(3, 6)] == [["anna@b.example"], ["anna_b"], []]


def test_embedding():
    v = vectors.embed("Hello world\nhello")
    assert abs(float((v.astype(float) ** 2).sum()) - 1) < 1e-6 and vectors.embed(" .. ") is None


def test_cross_group_nearest(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 7)
    r = np.random.default_rng(2)
    x = r.standard_normal((40, 8))
    rows = [("g", f"p{i:02}", f"a{i % 5}", v.tolist()) for i, v in enumerate(x)] + [("g", "zero", "a9", [0.0] * 8), ("h", "one", "a", x[0].tolist())]
    got = {r_.post_id: (r_.nearest, r_.distance) for r_ in vectors.cross_group_nearest(spark.createDataFrame(rows, "grp string, post_id string, account string, embedding array<double>"), "grp", "account").collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for i in range(40):
        d, j = min((1 - u[i] @ u[j], j) for j in range(40) if j % 5 != i % 5)
        assert got[f"p{i:02}"][0] == f"p{j:02}" and abs(got[f"p{i:02}"][1] - d) < 1e-9
    assert len(got) == 40


def test_contracts(spark, tmp_path):
    good = {"campaign_id": "c", "accounts": ["a"], "posts": []}
    path = tmp_path / "truth.jsonl"
    path.write_text(json.dumps(good) + "\n\n")
    assert contracts.read(spark, str(path), "truth").count() == 1
    for bad in ({**good, "label": 1}, {"campaign_id": "c"}, []):
        path.write_text(json.dumps(bad) + "\n")
        with pytest.raises(Exception, match="truth|FAILFAST|MALFORMED"):
            contracts.read(spark, str(path), "truth").collect()
    df = spark.createDataFrame([("b", 1, None), ("a", 2, 0.5)], "category string, reports bigint, base_rate double")
    contracts.write(df, str(tmp_path / "out"), ["category"])
    again = contracts.read(spark, str(tmp_path / "out"), "base-rates")
    assert contracts.read_back_equal(df, again)
    assert contracts.provenance(spark, str(path)).first().bytes == path.stat().st_size
    with pytest.raises(ValueError):
        contracts.refuse_shared_paths({"in": "x", "out": "./x"})
    with pytest.raises(ValueError):
        contracts.refuse_repeated(spark.createDataFrame([("a",), ("a",)], "k string"), "k")


def test_store(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, v string")
    new = spark.createDataFrame([("b", "z"), ("c", "w")], "k string, v string")
    assert {tuple(r) for r in store.upserted(old, new, "k").collect()} == {("a", "x"), ("b", "z"), ("c", "w")}
    assert dict(map(tuple, store.actions(old, new, "k", "v").collect())) == {"a": "removed", "b": "computed", "c": "computed"}
    with pytest.raises(ValueError):
        store.check_related(old, spark.createDataFrame([("q", "x")], "k string, v string"), "k")
    n = spark.createDataFrame([(x,) for x in (5, 1, 1, 9)], "w int")
    assert store.upper_median(n, "w").first()[0] == 5


def test_scores_of_empty_tables(spark):
    posts = spark.createDataFrame([("p", "a", None, "Guaranteed! Act now.")], "post_id string, account string, title string, body string")
    domains = spark.createDataFrame([], f"post_id string, account string, domains array<string>, links array<struct<{urls.LINK.replace(' string', ':string')}>>")
    hosts = spark.createDataFrame([], "host string")
    row = score.scores(posts, domains, hosts).first()
    assert (row.points, row.score, row.signals) == (40, 31, ["guaranteed_return", "urgency_language"])
    assert score.queue(score.scores(posts.limit(0), domains, hosts)).collect() == []


def test_pages(spark, tmp_path):
    (tmp_path / "old.html").write_text("x")
    nodes = spark.createDataFrame([("account", "a<b", "g"), ("post", "p", "g")], "kind string, name string, group_account string")
    edges = spark.createDataFrame([("wrote", "a<b", "p", "g")], "relation string, source string, target string, group_account string")
    written = graph.write_pages(nodes, edges, str(tmp_path))
    assert len(written) == 1 and not (tmp_path / "old.html").exists()
    assert "a&lt;b" in (tmp_path / "g.html").read_text()
