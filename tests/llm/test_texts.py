import random
import unicodedata

import numpy as np
import pytest

from sievework.llm import packing as P
from sievework.llm import repetition as R
from sievework.llm import tokens as T

SCHEMA = "doc_id bigint, text string, ids string, words int"


def test_ids_and_round_trip(spark):
    r = random.Random(1)
    texts = {1: None, 2: "", 3: " \n\t ", 4: "Hello  world's 😀 <|endoftext|>\r\n\n x", 5: "".join(r.choice("ab é\n  1,") for _ in range(60_000)), 6: "a" * 40_000, 7: " " * 30_000 + "x"}
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in texts.items()] + [(4, texts[4], "x", 0)], SCHEMA)
    rows = T.token_ids(df).collect()
    content = T.read_ranks()
    plain = T.encoding(content)
    assert len(rows) == len(texts) + 1
    for row in rows:
        assert row.ids == plain.encode_ordinary(texts[row.doc_id] or "")
        assert T.decode(content, row.ids) == (texts[row.doc_id] or "")
    assert {r.doc_id: r.n_tokens for r in T.token_counts(df).collect()} == {r.doc_id: len(r.ids) for r in rows}
    assert {r.doc_id: r.text for r in T.texts_of(T.token_ids(df)).collect()} == {i: t or "" for i, t in texts.items()}
    assert T.token_ids(spark.createDataFrame([], SCHEMA)).collect() == []


def test_pieces_join_to_the_same_ids():
    content = T.read_ranks()
    own = T.encoding(content)
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice(["a", "B1", " ", "\n", "'s", ".", "é", " ", "\x1c", "中"]) for _ in range(200))
        assert [i for p in T.pieces(text, 7) for i in own.encode_ordinary(p)] == own.encode_ordinary(text)


@pytest.mark.parametrize("seed", range(6))
def test_bound_and_packing(seed):
    r = np.random.default_rng(seed)
    sizes = r.integers(1, r.integers(20, 101), 60)
    bin_ = P.best_fit_decreasing(sizes, 100)
    used = np.bincount(bin_, weights=sizes)
    assert used.max() <= 100
    assert P.lower_bound(sizes, 100) <= len(used)
    assert P.lower_bound(np.full(7, 51), 100) == 7
    assert P.lower_bound(np.full(7, 34), 100) == 4


def test_packed(spark):
    r = random.Random(4)
    sizes = [(i, r.choice((0, 5, 99, 700, 2048, 2049, 5000, 1025))) for i in range(500)] + [(900, None), (901, 10_240), (3, 7)]
    out = P.packed(spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint"), 2048).collect()
    used, whole, starts = {}, {}, {}
    for x in out:
        used[x.container] = used.get(x.container, 0) + x.tokens
        whole[x.doc_id] = whole.get(x.doc_id, 0) + x.tokens
        starts.setdefault(x.doc_id, []).append((x.start, x.tokens))
    want = {}
    for i, n in sizes:
        want[i] = want.get(i, 0) + (n or 0)
    assert max(used.values()) <= 2048
    assert all(x.certified for x in out if x.container.startswith("full")) and {x.certified for x in out} <= {True, False}
    assert whole == want
    split = [i for i, s in starts.items() if len(s) > 1 and i != 3]
    assert all(want[i] > 2048 for i in split)
    assert all(sorted(s)[k][0] == k * 2048 for i, s in starts.items() if i != 3 for k in range(len(s)))
    assert len(used) <= -(-sum(want.values()) // 2048) * 1.1 + 2
    assert P.packed(spark.createDataFrame([], "doc_id bigint, n_tokens bigint"), 2048).collect() == []
    assert P.fill(P.packed(spark.createDataFrame([], "doc_id bigint, n_tokens bigint"))).first().containers == 0


def share(text, run=8):
    w, cur = [], ""
    for c in (text or "").lower() + " ":
        if unicodedata.category(c)[0] in "LN":
            cur += c
        elif cur:
            w.append(cur)
            cur = ""
    seen, hit = set(), [0] * len(w)
    for i in range(len(w) - run + 1):
        k = tuple(w[i : i + run])
        if k in seen:
            hit[i : i + run] = [1] * run
        seen.add(k)
    return len(w), sum(hit)


def documents(n=400, seed=0):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(n):
        w = [r.choice(vocabulary) for _ in range(r.randrange(0, 200))]
        if i % 4 == 0 and w:
            phrase = w[: r.randrange(5, 30)]
            w += phrase * r.randrange(1, 12)
        rows.append((i, " ".join(w), "x", 0))
    return rows + [(1000, None, "x", 0), (1001, "", "x", 0), (1002, "é😀 " * 50, "x", 0), (1003, "same words over and over again and then " * 5000, "x", 0), (1000, None, "x", 0)]


def test_shares_and_cases(spark):
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    truth = {i: share(t) for i, t, *_ in rows}
    assert {r.doc_id: (r.words, r.repeated) for r in R.shares(df).collect()} == truth
    found = {r.doc_id for r in R.cases(df, 0.3).collect()}
    want = {i for i, (n, k) in truth.items() if n and k >= 0.3 * n}
    assert found <= want
    assert len(found) >= 0.98 * len(want)


def test_paths_of_all_documents(spark):
    df = spark.createDataFrame(documents(seed=3), SCHEMA).repartition(3)
    truth = {i: share(t) for i, t, *_ in documents(seed=3)}
    rows = {r.doc_id: r for r in R.anomalies(df, 0.3).collect()}
    assert set(rows) == set(truth) and rows[1003].path == 0.0
    found = {r.doc_id for r in R.cases(df, 0.3).collect()}
    assert found <= {i for i, r in rows.items() if r.anomalous}
    q = R.quality(spark.createDataFrame([d for d in documents(seed=3) if d[0] < 1000], SCHEMA), 0.3).first()
    assert q.documents == 400 and q.hits <= q.anomalous and q.recall >= 0.98 and q.precision > 0.5


def test_threshold_from_given_labels(spark):
    df = spark.createDataFrame(documents(seed=4), SCHEMA)
    labelled = spark.createDataFrame([(i, bool(n and k >= 0.3 * n)) for i, (n, k) in {i: share(t) for i, t, *_ in documents(seed=4)}.items() if i % 2], "doc_id bigint, is_case boolean")
    want = {i for i, t, *_ in documents(seed=4) if share(t)[1] >= 0.3 * max(1, share(t)[0])}
    found = {r.doc_id for r in R.cases(df, 0.3, labelled=labelled).collect()}
    assert found <= want and len(found) >= 0.98 * len(want)


def test_planted_texts_are_cases():
    for n in (16, 40, 333):
        words, again = share(R._planted(" ".join(f"v{i}" for i in range(n)), 0.3, 8))
        assert 0.3 <= again / words < 0.6
    assert R._planted("too few words", 0.3, 8) is None


def test_cases_of_small_and_empty_tables(spark):
    assert R.cases(spark.createDataFrame([], SCHEMA), 0.3).collect() == []
    one = [(1, "a b c d e f g h " * 9, "x", 0)]
    assert [r.doc_id for r in R.cases(spark.createDataFrame(one, SCHEMA), 0.3).collect()] == [1]


def test_forest_isolates_outliers():
    r = np.random.default_rng(0)
    plain = r.normal(0, 0.05, (500, 4))
    forest = R.grow(plain)
    assert R.paths(forest, np.full((1, 4), 0.9))[0] < np.percentile(R.paths(forest, plain), 5)
