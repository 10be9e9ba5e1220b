import numpy as np

from sievework.llm import knn as K

SCHEMA = "post_id string, dimensions int, embedding array<float>, key string, distance double"


def rows(n=600, seed=0):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, 256)).astype(np.float32)
    for i in range(0, n, 3):
        x[i + 1] = x[i] + r.standard_normal(256) * r.uniform(0.1, 0.6)
    x[30:40] = x[30]
    return x


def brute(x, ids, k, within):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    d = np.round(1 - u @ u.T, 12)
    out = set()
    for i, a in enumerate(ids):
        near = sorted((d[i, j], b) for j, b in enumerate(ids) if j != i and d[i, j] <= within)[:k]
        out |= {tuple(sorted((a, b))) for _, b in near}
    return out


def test_recall_and_exact_distances(spark):
    x = rows()
    ids = [f"p{i:04}" for i in range(len(x))]
    data = [(i, 256, v.tolist(), "k", 0.0) for i, v in zip(ids, x)]
    data += data[:5]
    data += [("null", 256, None, "k", 0.0), ("zero", 256, [0.0] * 256, "k", 0.0), ("short", 256, [1.0] * 255, "k", 0.0), ("old", 128, [1.0] * 128, "k", 0.0), (None, 256, x[0].tolist(), "k", 0.0), ("nan", 256, [float("nan")] * 256, "k", 0.0)]
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    found = {tuple(r) for r in K.close_pairs(K.usable(df, 256), 256, 5, 0.12).collect()}
    truth = brute(x, ids, 5, 0.12)
    assert found <= truth
    assert len(found) >= 0.98 * len(truth)


def clustered(n=3000, seed=4, centres=40):
    r = np.random.default_rng(seed)
    c = r.standard_normal((centres, 256))
    return (c[r.integers(0, centres, n)] + r.standard_normal((n, 256)) * r.uniform(0.2, 1.0, (n, 1))).astype(np.float32)


def nearest(x, k):
    u = K._unit(x)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    near = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return near, 1 - np.take_along_axis(s, near, 1)


def recall(got, x, ids, k):
    near, distance = nearest(x, k)
    hits = total = 0
    for i, a in enumerate(ids):
        if a in got:
            total += k
            hits += sum(d <= distance[i, -1] + 1e-9 for _, d in got[a])
            assert len(got[a]) == k
    return hits / total


def table(spark, x, ids):
    df = spark.createDataFrame([(i, 256, v.tolist(), "k", 0.0) for i, v in zip(ids, x)], SCHEMA).repartition(4)
    return K.usable(df, 256)


def by_post(rows):
    got = {}
    for r in rows:
        got.setdefault(r.post_id, []).append((r.nearest, r.distance))
    return got


def test_nearest_at_any_distance(spark, monkeypatch):
    monkeypatch.setattr(K, "CELL_ROWS", 30)
    # vectors without any structure are what cells serve worst
    for x, least in ((rows(1500, 4), 0.9), (clustered(), 0.95)):
        ids = [f"p{i:04}" for i in range(len(x))]
        df = table(spark, x, ids)
        got = by_post(K.search(df.where("substr(post_id, 4) % 5 = 0"), df).collect())
        assert set(got) == {i for i in ids if int(i[2:]) % 5 == 0}
        assert recall(got, x, ids, 5) >= least
        # distances are exact
        u = K._unit(x)
        for a, near in got.items():
            assert np.allclose([d for _, d in near], [1 - u[int(a[1:])] @ u[int(b[1:])] for b, _ in near], atol=1e-6)


def test_neighbours_of_all_at_any_distance(spark):
    x = clustered(400, 5, 10)
    ids = [f"p{i:04}" for i in range(len(x))]
    got = by_post(K.neighbours(table(spark, x, ids), 256, 5).collect())
    assert set(got) == set(ids) and recall(got, x, ids, 5) == 1.0


def test_dense_and_many_cells(spark, monkeypatch):
    monkeypatch.setattr(K, "CELL_ROWS", 20)
    r = np.random.default_rng(8)
    x = clustered(1200, 6, 20)
    x[:500] = x[0] + r.standard_normal((500, 256)).astype(np.float32) * 0.15  # a third in one place
    for i in range(500, 1200, 2):
        x[i + 1] = x[i] + r.standard_normal(256) * 0.3
    ids = [f"p{i:04}" for i in range(len(x))]
    found = {tuple(r) for r in K.close_pairs(table(spark, x, ids), 256, 5, 0.12).collect()}
    truth = brute(x, ids, 5, 0.12)
    assert len(found & truth) >= 0.95 * len(truth)


def test_cells_of_two_levels(monkeypatch):
    monkeypatch.setattr(K, "MAX_CELLS", 32)
    x = K._unit(clustered(4000, 7, 200)).astype(np.float32)
    cells = K.fit(x, 200, 0.12)
    assert (len(cells.first), len(cells.second)) == (32, 7)
    home = K._in_steps(cells, x, 1)[:, 0]
    assert len(np.unique(home)) > 2 * len(np.unique(home // 7))
    # the first probe is the nearest of all cells, and rows at the distance meet
    centre = (cells.first[:, None, :] + cells.second[None, :, :]).reshape(224, -1)
    best = ((x[:300, None, :] - centre[None]) ** 2).sum(2).argmin(1)
    assert (home[:300] == best).mean() > 0.95
    r = np.random.default_rng(1)
    away = r.standard_normal(x[:500].shape)
    away -= (away * x[:500]).sum(1, keepdims=True) * x[:500]
    away /= np.linalg.norm(away, axis=1)[:, None]
    y = (0.88 * x[:500] + np.sqrt(1 - 0.88**2) * away).astype(np.float32)
    a, b = K._in_steps(cells, x[:500], cells.probes), K._in_steps(cells, y, cells.probes)
    assert ((a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)).mean() >= 0.95


def test_slices_of_a_dense_cell_hold_all():
    x = K._unit(np.concatenate([np.tile(rows(90)[:1], (900, 1)) + np.random.default_rng(2).standard_normal((900, 256)) * 0.01, rows(90)])).astype(np.float32)
    cells = K.fit(x, 20, 0.12)
    assert cells.slices.max() > 1
    home = K._home(K._in_steps(cells, x, 1)[:, 0], np.arange(len(x)) << 9, cells)
    who, place = K._visits(K._in_steps(cells, x, 1), cells)
    visited = set(zip(who.tolist(), place.tolist()))
    assert all((i, int(h)) in visited for i, h in enumerate(home))
    assert np.unique(home, return_counts=True)[1].max() < 900


def test_bit_planes_give_the_inner_product():
    for d in (256, 100):
        u = K._unit(np.random.default_rng(3).standard_normal((200, d))).astype(np.float32)
        code, scale, bits, correction = K._codes(u)
        q, b = np.divmod(np.arange(200 * 200), 200)
        plain = ((code * scale[:, None]) @ (np.where(u > 0, 1, -1) / (np.sqrt(d) * correction)[:, None]).T).ravel()
        assert np.allclose(K.Queries(code, scale).estimate(q, K._words(bits)[b], correction[b]), plain, atol=1e-4)


def test_codes_bound_any_distance():
    x = np.concatenate([rows(402, 5), clustered(400, 2)])
    u = K._unit(x).astype(np.float32) @ K.rotation(256)
    key = np.arange(len(u))
    code, scale, bits, correction = K._codes(u)
    s = K._unit(x) @ K._unit(x).T
    for within in (0.12, 0.5, 2.0):
        pairs = {tuple(p) for p in K._near(K.Queries(code, scale), key, bits, key, correction, within, 5)}
        np.fill_diagonal(s, -9)
        due = [(i, j) for i in key for j in np.argsort(-s[i])[:5] if s[i, j] >= 1 - within]
        assert sum(p in pairs for p in due) >= 0.99 * len(due) > 0


def test_equal_vectors_stay_linear(spark):
    data = [(f"p{i:04}", 256, [1.0, 2.0] * 128, "k", 0.0) for i in range(300)]
    found = K.neighbours(K.usable(spark.createDataFrame(data, SCHEMA), 256), 256, 5, 0.12).collect()
    assert len(found) == 300 * 5
    assert all(r.distance == 0 and r.nearest != r.post_id for r in found)


def test_estimate_is_unbiased_and_bounded():
    turn = K.rotation(256)
    r = np.random.default_rng(1)
    a = K._unit(r.standard_normal((300, 256))) @ turn
    b = K._unit(r.standard_normal((300, 256))) @ turn
    scale = np.abs(b).sum(1) / 16
    est = (a @ np.sign(b).T) / 16 / scale
    error = est - a @ b.T
    assert abs(error.mean()) < 0.002
    assert np.abs(error).max() < 5.5 * 0.76 / np.sqrt(255)


def test_empty_table(spark):
    assert K.close_pairs(K.usable(spark.createDataFrame([], SCHEMA), 256)).collect() == []
