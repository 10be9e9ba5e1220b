import random

from sievework.llm import spans as S

SCHEMA = "post_id string, body string, key string, `group` int"


def brute(posts, n):
    where = {}
    for i, b in posts.items():
        for p in range(len(b) - n + 1):
            where.setdefault(b[p : p + n], set()).add(i)
    out = set()
    for i, b in posts.items():
        hit = [False] * (len(b) + 1)
        for p in range(len(b) - n + 1):
            if len(where[b[p : p + n]]) > 1:
                hit[p : p + n] = [True] * n
        hit[len(b)] = False
        a = None
        for p, h in enumerate(hit):
            if h and a is None:
                a = p
            elif not h and a is not None:
                out.add((i, a, p))
                a = None
    return out


def test_matches_brute_force(spark):
    for seed, n in ((0, 16), (1, 40), (2, 160)):
        r = random.Random(seed)
        letters = "ab cdé😀" if seed else "ab"
        text = lambda k: "".join(r.choice(letters) for _ in range(k))
        shared = [text(r.randrange(n - 2, 3 * n)) for _ in range(8)]
        posts = {}
        for i in range(40):
            parts = [text(r.randrange(0, n)) for _ in range(3)]
            for _ in range(r.randrange(0, 3)):
                s = r.choice(shared)
                parts.insert(r.randrange(len(parts)), s[r.randrange(0, 4) :])
            posts[f"p{i}"] = "".join(parts)
        posts |= {"same1": "z" * 3 * n, "same2": "z" * (2 * n), "self": "q" * 3 * n, "short": "x", "empty": ""}
        rows = [(i, b, "k", 0) for i, b in posts.items()]
        rows += [("self", posts["self"], "k", 0), ("p0", posts["p0"], "k", 0), ("none", None, "k", 0), (None, posts["p1"] * 2, "k", 0)]
        found = [tuple(x) for x in S.shared_spans(spark.createDataFrame(rows, SCHEMA).repartition(3), n).collect()]
        assert len(found) == len(set(found))
        assert set(found) == brute(posts, n)


def test_long_text_and_empty_table(spark):
    r = random.Random(5)
    long = "".join(r.choice("abcdefgh ") for _ in range(300_000))
    found = {tuple(x) for x in S.shared_spans(spark.createDataFrame([("a", long, "", 0), ("b", "!" + long[1000:2000], "", 0)], SCHEMA)).collect()}
    assert found == {("a", 1000, 2000), ("b", 1, 1001)}
    assert S.shared_spans(spark.createDataFrame([], SCHEMA)).collect() == []
    assert S.shares(spark.createDataFrame([("a", None, "", 0)], SCHEMA)).first().share == 0
