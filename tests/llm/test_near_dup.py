import random
import re

import numpy as np

from sievework.llm import near_dup as N

SCHEMA = "post_id string, title string, body string, key bigint, rank int"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(rows, t, n, least):
    sets = {}
    for post, title, body, *_ in rows:
        if post is None or len(words(body)) < least:
            continue
        w = words(title) + words(body)
        s = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        if s:
            sets[post] = s
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def edited(r, base, share):
    w = list(base)
    for _ in range(int(len(w) * share)):
        i = r.randrange(len(w))
        w[i : i + 1] = r.choice(([], [f"x{r.randrange(99)}"], [w[i], "more"]))
    return w


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        base = [r.choice(vocabulary) for _ in range(r.randrange(10, 60))]
        for j in range(r.randrange(1, 4)):
            text = " ".join(base if j == 0 else edited(r, base, r.random() * 0.3))
            rows.append((f"p{i}_{j}", r.choice((None, "", "A title")), text, i, j))
    rows += [("dup", "T", rows[0][2], 0, 0), ("dup", "T", rows[0][2], 0, 0), ("dup2", "T", rows[0][2], 1, 1)]
    rows += [("null", None, None, None, None), (None, "x", rows[0][2], 0, 0), ("blank", "", " \n ", 0, 0), ("long", "l", " ".join(r.choice(vocabulary) for _ in range(30_000)), 0, 0), ("emoji", "é", "ÀÉ 😀 " * 30, 0, 0)]
    return rows


def test_matches_brute_force(spark):
    for seed, (t, n, least) in enumerate(((0.5, 3, 15), (0.8, 5, 0), (0.3, 2, 5))):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        found = [tuple(r) for r in N.near_duplicates(df, t, n, least).collect()]
        assert len(found) == len(set(found))
        assert set(found) == brute(rows, t, n, least)


def test_large_class_of_copies_stays_linear(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(f"c{i:04}", "t", text, 0, 0) for i in range(400)] + [("other", "t", text + " tail", 0, 0)]
    found = {tuple(r) for r in N.near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.5, 3, 15).collect()}
    d = N.DELEGATES
    assert len(found) == d * (d - 1) // 2 + (400 - d) + d
    assert {x for p in found for x in p} == {r[0] for r in rows}


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], SCHEMA), 0.5, 3, 15).collect() == []


def test_sets_beyond_16_bits(spark):
    common, few, more = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("c", 50_002), ("x", 20_000), ("y", 30_000)))
    for bodies in ((f"{common} {few}", f"{common} {more}"), (f"{common} {more}", f"{common} {few}")):
        df = spark.createDataFrame([(p, None, b) for p, b in zip("ab", bodies)], "post_id string, title string, body string")
        assert [tuple(r) for r in N.near_duplicates(df, threshold=0.5, shingle=3, least_words=15).collect()] == [("a", "b")]


def test_hot_lists_are_cut_without_loss(spark, monkeypatch):
    rows = corpus(7)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(N, "LIST_ROWS", 2)
    h, count, key = np.array([5, 6], np.uint64), np.array([9, 1]), np.array([1, 2])
    assert np.bincount(N._slices(h, count, key)[0]).tolist() == [5, 1]
    found = {tuple(r) for r in N.near_duplicates(df, 0.5, 3, 15).collect()}
    assert found == brute(rows, 0.5, 3, 15)


def test_slices_of_a_list_meet():
    r = np.random.default_rng(0)
    h, key = np.full(300, 77, np.uint64), r.integers(-1 << 62, 1 << 62, 300)
    row, lists = N._slices(h, np.full(300, 5 * N.LIST_ROWS), key)
    at = [set() for _ in h]
    for i, v in zip(row, lists):
        at[i].add(int(v))
    assert all(a & b for a in at for b in at)
    assert max(np.unique(lists, return_counts=True)[1]) < 300


def test_each_order_drops_pairs(spark):
    r = random.Random(3)
    phrases = [" ".join(f"w{r.randrange(400)}" for _ in range(6)) for _ in range(60)]
    rows = [(f"p{i:03}", None, " ".join(r.choice(phrases) for _ in range(r.randrange(8, 30))), 0, 0) for i in range(300)]
    n = N.filtered_pairs(spark.createDataFrame(rows, SCHEMA), 0.5, 3, 15).first()
    assert n.order_1 > n.order_2 > n.order_3 > 0


def test_prefixes_of_every_order_hold_what_is_due():
    r = np.random.default_rng(5)
    for t in (0.3, 0.5, 0.8):
        for _ in range(300):
            common, x, y = int(r.integers(5, 900)), *r.integers(0, 500, 2).tolist()
            if common < t * (common + x + y):
                continue
            tokens = r.integers(0, 1 << 63, common + x + y).astype(np.uint64)
            sets = [np.sort(tokens[: common + x]), np.sort(np.append(tokens[:common], tokens[common + x :]))]
            at = np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
            size = np.diff(at)
            words, to = N._bitmaps(np.concatenate(sets), at, t)
            maps = N._Maps(size, words, to[:-1])
            most = N._due(size[:1], size[1:], t)
            for k in (0, 1):
                assert maps.apart(np.array([0]), np.array([1]), k)[0] <= most[0]


def test_classes_and_pairs_say_all(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(f"c{i:03}", "t", text, 0, 0) for i in range(80)] + [(f"o{i}", "t", text + f" tail{i}", 0, 0) for i in range(3)] + [("c000", "t", text, 9, 9), (None, "t", text, 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    own = {r.post_id: r.class_id for r in N.classes(df).collect()}
    pairs = {frozenset((r.a, r.b)) for r in N.class_pairs(df, 0.5, 3, 15).collect()}
    ids = sorted(own)
    found = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if own[a] == own[b] or frozenset((own[a], own[b])) in pairs}
    assert found == brute(rows, 0.5, 3, 15)
