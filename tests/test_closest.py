import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions.vectors import cross_group_nearest
from sievework.operators import candidates, closest

KIND = "w string, post_id string, g string, embedding array<float>"


def brute(rows, posts, threshold):
    out = {}
    for w in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == w and r[2] is not None and any(r[3])]
        if len({r[2] for r in own}) < 2:
            continue
        x = np.array([r[3] for r in own], dtype=np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        g = np.array([r[2] for r in own])
        d = np.where(g[:, None] == g, np.inf, 1 - x @ x.T)
        near = {r[1] for r, v in zip(own, d.min(1)) if v <= threshold}
        out[w] = (d.min(), len(near) == posts[w])
    return out


def rows_of(kind, rng):
    """Groups of all sizes: clustered, structureless, on a line, equal vectors, one account, and one without some vectors."""
    out = []
    for w, n in (("big", 400), ("whole", 300), ("small", 15), ("two", 2), ("one", 30)):
        centres = rng.normal(size=(8, 12))
        for i in range(n):
            v = centres[i % 8] + 0.05 * rng.normal(size=12) if kind == "clusters" else rng.normal(size=12)
            if kind == "line":
                v = np.array([1.0, i * 1e-3] + [0.0] * 10)
            if kind == "equal":
                v = centres[0]
            g = "a" if w == "one" else f"a{i // 8 % 9}" if kind == "clusters" else f"a{rng.integers(9)}"
            out.append((w, f"{w}{i}", g if w != "two" else f"a{i}", [0.0] * 12 if w == "big" and i < 3 else [float(x) for x in v]))
    return [*out, ("big", "nobody", None, [1.0] * 12), out[-1]]


@pytest.mark.parametrize(("kind", "last", "threshold"), [("clusters", 16_384, 0.02), ("noise", 16_384, 0.5), ("line", 16_384, 0.02), ("equal", 0, 0.02), ("clusters", 0, 0.5)])
def test_likeness_against_brute_force(spark, monkeypatch, kind, last, threshold):
    for name, value in {"ONE_TASK": 20, "LEAF_ROWS": 40, "FITTED": 300, "FIRST_PAIRS": 2, "SENT": 64, "LAST_PAIRS": last, "LEADING": 3}.items():
        monkeypatch.setattr(closest, name, value)
    rows = rows_of(kind, np.random.default_rng(3))
    posts = {w: len({r[1] for r in rows if r[0] == w}) for w in {r[0] for r in rows}}
    found = closest.likeness(spark.createDataFrame(rows, KIND), spark.createDataFrame(list(posts.items()), "w string, posts bigint"), "w", "g", threshold).collect()
    due = brute(rows, posts, threshold)
    assert len(found) == len(due) and {r.w for r in found} == set(due)
    for r in found:
        assert abs(r.closest_distance - due[r.w][0]) < 1e-9 and r.similar == due[r.w][1], (r, due[r.w])


def test_likeness_of_nothing(spark):
    none = spark.createDataFrame([], KIND)
    assert closest.likeness(none, spark.createDataFrame([], "w string, posts bigint"), "w", "g", 0.5).collect() == []


def test_a_large_group_is_not_copied_for_its_blocks(spark):
    """A group's vectors are shuffled about once, however many blocks it has."""
    n, rng = 6000, np.random.default_rng(5)
    posts = spark.createDataFrame([(f"p{i}", f"a{i % 700}", "2026-01-01T00:00:00Z") for i in range(n)], "post_id string, account string, created_at string")
    link = [("https://x.example/", "https", "x.example", "x.example", None)]
    links = spark.createDataFrame([(f"p{i}", f"a{i}", [], link) for i in range(700)], "post_id string, account string, domains array<string>, links array<struct<link:string,scheme:string,host:string,domain:string,unresolved:string>>")
    contacts = spark.createDataFrame([], "post_id string, account string, matches array<struct<kind:string,value:string,found_as:string,field:string>>")
    x = rng.normal(size=(n, 64)).astype(np.float32)
    x[1::2] = x[::2] + 0.1 * rng.normal(size=(n // 2, 64))
    vectors = spark.createDataFrame([(f"p{i}", v.tolist()) for i, v in enumerate(x)], "post_id string, embedding array<float>")
    placed = posts.select("post_id", F.lit("Other").alias("scam_category"))
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(store.executorList(False).apply(i).totalShuffleWrite() for i in range(store.executorList(False).size()))
    before = written()
    got = candidates.candidates(posts, links, contacts, spark.createDataFrame([], "host string"), placed, vectors).collect()
    assert written() - before < 5 * x.nbytes
    due = cross_group_nearest(posts.withColumn("w", F.lit("w")).join(vectors, "post_id"), "w", "account").agg(F.min("distance").alias("d"), F.max("distance").alias("far")).first()
    assert [(r.accounts, r.posts, r.similar) for r in got] == [(700, n, due.far <= 0.5)]
    assert abs(got[0].closest_distance - due.d) < 1e-12
