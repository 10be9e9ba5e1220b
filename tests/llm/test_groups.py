import random
from collections import defaultdict

from sievework.llm import groups as G


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    out = defaultdict(set)
    for x in parent:
        out[find(x)].add(x)
    return sorted(map(sorted, out.values()))


def partition(rows):
    out = defaultdict(set)
    for r in rows:
        out[r.label].add(r.x)
    return sorted(map(sorted, out.values()))


def test_all_shapes(spark):
    r = random.Random(3)
    e = [(i, i + 1) for i in range(100, 140)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(300, 300 + i) for i in range(1, 30)]
    e += [(400 + i, 400 + j) for i in range(6) for j in range(i)] + [(405, 500), (500, 501), (501, 402), (600, 601), (7, 7)]
    e += [(700 + i, 700 + r.randrange(i)) for i in range(1, 60)] + [(r.randrange(1000, 1080), r.randrange(1000, 1080)) for _ in range(70)]
    ids = list(range(1200))
    r.shuffle(ids)
    e = [(ids[a], ids[b]) for a, b in e]
    rows = [*e, *[(b, a) for a, b in e[:20]], (None, 5), (5, None)]
    assert partition(G.components(spark.createDataFrame(rows, "u bigint, v bigint"), few=0).collect()) == brute(e)


def test_hub_and_giant_component(spark):
    r = random.Random(9)
    e = [(0, i) for i in range(1, 3000)] + [(r.randrange(3000), r.randrange(5000, 5200)) for _ in range(2000)] + [(9000 + i, 9001 + i) for i in range(0, 40, 2)]
    assert partition(G.components(spark.createDataFrame(e, "u bigint, v bigint")).collect()) == brute(e)


def test_empty(spark):
    assert G.components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def test_account_ties(spark):
    dom = "array<struct<domain:string,accounts:array<string>,posts:array<string>>>"
    d = lambda *names: [(n, None, None) for n in names]
    candidates = spark.createDataFrame(
        [("c1", ["b", "a", None, "a"], d("Shop.Example. ")), ("c2", ["c"], d("shop.example")), ("c3", ["d"], d("listed.example")), ("c4", ["e"], d("listed.example", None)), ("c5", None, None), ("c6", [None], d("shop.example")), ("c1", ["b", "a", None, "a"], d("Shop.Example. "))],
        f"candidate_id string, accounts array<string>, shared_domains {dom}",
    )
    contacts = spark.createDataFrame([("f", [" X@own.example"]), ("g", ["x@OWN.example."]), ("h", ["y@listed.example", None]), ("i", ["y@listed.example"]), (None, ["x@own.example"]), ("j", None)], "account string, contact_points array<string>")
    hosts = spark.createDataFrame([("LISTED.example",), (None,), ("listed.example. ",)], "host string")
    found = {tuple(r) for r in G.account_groups(candidates, contacts, hosts).collect()}
    assert found == {("a", "a"), ("b", "a"), ("c", "a"), ("f", "f"), ("g", "f")}
