"""p2: the most similar vectors of every vector, by randomly rotated one-bit codes.

Every vector is normalised and rotated by one fixed random orthogonal matrix.  Its code is the sign
of each coordinate (packed, 1 bit a dimension) with one correction scalar, the inner product of the
vector with its own code.  For a query q and a code c, <c, q> / scalar estimates the cosine without
bias, with a standard error of sqrt(1-s^2)/s * sqrt(1-cos^2) / sqrt(D-1).  A query is held in eight
bit planes, so that estimates are sums of bit counts over packed words.

1. Spherical k-means on a bounded sample (``SAMPLE`` rows) partitions the space.  Beyond ``MAX_CELLS``
   cells, each is divided again by a second codebook, of the sample's residuals, so cells keep their
   size up to ``MAX_CELLS`` squared of them; all vectors are indexed, none only sampled.
2. A vector stays in its own cell as a query and sends its code to its nearest cells, so two vectors
   meet if either probes the other's cell.  How many it probes is calibrated on the sample's rows
   moved by the distance.  A cell of much more than its share is cut into slices.
3. In a cell, the number of equal signs, then estimates with error bounds leave those vectors that
   can be among the k nearest and within the distance; only these are reranked with the full vectors.

``search`` serves distances that leave nothing to prune by: queries visit many cells with their full
vector, and a cell's vectors are reranked in the order of their estimates as long as bounds ask for.
Equal vectors form a class that is indexed once; the posts come back at the end.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.partitioning import labels, spread

SAMPLE = 16_384
MAX_CELLS = 4_096
CELL_ROWS = 500
#: Cells a code visits: the first number by which so many of the sample's moved rows meet their origin.
PROBES = (8, 12, 16, 24, 32, 48, 64)
MEET = 0.97
#: Cells that a query of ``search`` visits, at least, and as a share of all.
SEARCH_PROBES = 32
SEARCH_SHARE = 0.02
#: A cell is cut into slices of about this many times a cell's mean rows.
DENSE = 4
#: Standard errors by which an estimate may miss.
SIGMAS = 4.0
#: What 8-bit coordinates add to an estimate's error, at most.
_ROUNDING = 4e-3
_ROUNDS = 4


def usable(rows: DataFrame, dimensions: int, key: str = "post_id", vector: str = "embedding", width: str | None = "dimensions") -> DataFrame:
    """(post_id, embedding) of the rows with a vector of the full width that isn't all zero and has no null, NaN or infinite number."""
    v = F.col(vector)
    fine = F.col(key).isNotNull() & (F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(3e38))) & F.exists(v, lambda x: x != 0)
    if width:
        fine = (F.col(width) == dimensions) & fine
    return rows.where(fine).select(F.col(key).alias("post_id"), v.cast("array<float>").alias("embedding"))


@functools.lru_cache(maxsize=2)
def rotation(dimensions: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every process."""
    q, r = np.linalg.qr(np.random.default_rng(20240521).standard_normal((dimensions, dimensions)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _matrix(column: pa.Array | pa.ChunkedArray, dimensions: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        return np.concatenate([_matrix(c, dimensions) for c in column.chunks] or [np.zeros((0, dimensions), np.float32)])
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dimensions)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def fit_cells(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids of a spherical k-means, begun at random distinct rows."""
    sample = np.unique(sample, axis=0)
    rng = np.random.default_rng(7)
    centre = sample[rng.permutation(len(sample))[:cells]]
    for _ in range(_ROUNDS if len(centre) < len(sample) else 0):
        own = np.concatenate([(sample[i : i + 2048] @ centre.T).argmax(1) for i in range(0, len(sample), 2048)])
        order = np.argsort(own, kind="stable")
        first = np.searchsorted(own[order], np.arange(len(centre)))
        full = np.diff(np.append(first, len(sample))) > 0
        total = np.add.reduceat(sample[order], first[full])
        size = np.sqrt((total * total).sum(1, keepdims=True))
        centre[full] = np.where(size > 0, total / np.maximum(size, 1e-12), centre[full])
    return centre.astype(np.float32)


class Cells(NamedTuple):
    """Centroids, the second codebook (one zero row if there is none), slices of each first-level cell, and probes of a code."""

    first: np.ndarray
    second: np.ndarray
    slices: np.ndarray
    probes: int


def nearest_cells(cells: Cells, x: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the ``width`` nearest cells of unit vectors, the nearest first."""
    c1, c2 = len(cells.first), len(cells.second)
    near = x @ cells.first.T - 0.5 * (cells.first**2).sum(1)
    few = min(c1, max(8, width)) if c2 > 1 else min(c1, width)
    top = np.argpartition(near, c1 - few, axis=1)[:, -few:]
    rows = np.arange(len(x))[:, None]
    if c2 == 1:
        return top[rows, np.argsort(-near[rows, top], axis=1, kind="stable")]
    # |x - a - b|^2 without what doesn't depend on the cell
    second = x @ cells.second.T - 0.5 * (cells.second**2).sum(1)
    cross = cells.first @ cells.second.T
    score = near[rows, top][:, :, None] + second[:, None, :] - cross[top]
    score, number = score.reshape(len(x), -1), (top[:, :, None] * c2 + np.arange(c2)).reshape(len(x), -1)
    best = np.argpartition(score, score.shape[1] - width, axis=1)[:, -width:] if width < score.shape[1] else np.tile(np.arange(score.shape[1]), (len(x), 1))
    return number[rows, best[rows, np.argsort(-score[rows, best], axis=1, kind="stable")]]


def _in_steps(cells: Cells, x: np.ndarray, width: int) -> np.ndarray:
    step = max(1, (1 << 22) // max(len(cells.first), 8 * len(cells.second)))  # a batch against thousands of cells is too much at once
    return np.concatenate([nearest_cells(cells, x[i : i + step], width) for i in range(0, len(x), step)] or [np.zeros((0, width), np.int64)])


def fit(sample: np.ndarray, wanted: int, within: float) -> Cells:
    """Cells for a sample of unit vectors, so many as wanted as far as two codebooks of ``MAX_CELLS`` go."""
    first = fit_cells(sample, min(MAX_CELLS, wanted))
    second = np.zeros((1, sample.shape[1]), np.float32)
    if wanted > len(first) == MAX_CELLS:
        own = np.concatenate([(sample[i : i + 2048] @ first.T).argmax(1) for i in range(0, len(sample), 2048)])
        # centroids shrink to the means of their rows, so that residuals have no direction in common
        size = np.bincount(own, weights=(sample * first[own]).sum(1), minlength=len(first)) / np.maximum(1, np.bincount(own, minlength=len(first)))
        first = (first * np.where(size > 0, size, 1.0)[:, None]).astype(np.float32)
        second = _plain_means(sample - first[own], min(MAX_CELLS, -(-wanted // len(first))))
    cells = Cells(first, second, np.ones(len(first), np.int64), PROBES[0])
    home = _in_steps(cells, sample, 1)[:, 0]
    mass = np.bincount(home // len(second), minlength=len(first))
    cells = cells._replace(slices=np.maximum(1, -(-mass * len(first) // (DENSE * max(1, len(sample))))))
    if within >= 1:
        return cells
    # rows moved in random directions to the distance: who meets, by either's probes?
    rng = np.random.default_rng(3)
    x = sample[rng.permutation(len(sample))[:2048]]
    away = rng.standard_normal(x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    away /= np.sqrt((away**2).sum(1, keepdims=True))
    y = ((1 - within) * x + np.sqrt(1 - (1 - within) ** 2) * away).astype(np.float32)
    most = min(PROBES[-1], len(first) * len(second))
    a, b = _in_steps(cells, x, most), _in_steps(cells, y, most)
    place = np.minimum(np.where(a == b[:, :1], np.arange(most), most).min(1), np.where(b == a[:, :1], np.arange(most), most).min(1))
    return cells._replace(probes=next((p for p in PROBES if (place < p).mean() >= MEET), PROBES[-1]))


def _plain_means(rows: np.ndarray, n: int) -> np.ndarray:
    """Centroids of k-means by Euclidean distance."""
    centre = rows[np.random.default_rng(9).permutation(len(rows))[:n]].copy()
    for _ in range(_ROUNDS):
        own = np.concatenate([(rows[i : i + 2048] @ centre.T - 0.5 * (centre**2).sum(1)).argmax(1) for i in range(0, len(rows), 2048)])
        order = np.argsort(own, kind="stable")
        count = np.bincount(own, minlength=len(centre))
        full = count > 0
        centre[full] = np.add.reduceat(rows[order], (np.cumsum(count) - count)[full]) / count[full][:, None]
    return centre.astype(np.float32)


def _cells(vectors: DataFrame, dimensions: int, within: float) -> Cells:
    n = vectors.count()
    share = max(1, int((1 << 30) * min(1.0, SAMPLE / max(1, n))))
    wanted = max(1, n // CELL_ROWS)

    def run(batches):
        rows = [_unit(_matrix(b["embedding"], dimensions)).astype(np.float32) for b in batches if b.num_rows]
        if rows:
            c = fit(np.concatenate(rows), wanted, within)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (c.first, c.second, c.slices, np.int64(c.probes))], ["first", "second", "slices", "probes"])

    chosen = vectors.where(F.pmod(F.xxhash64("post_id"), F.lit(1 << 30)) < share).select("embedding")
    rows = chosen.repartition(1).mapInArrow(run, "first binary, second binary, slices binary, probes binary").collect()
    flat = lambda name, kind: np.frombuffer(b"".join(r[name] for r in rows), kind)
    return Cells(flat("first", np.float32).reshape(-1, dimensions), flat("second", np.float32).reshape(-1, dimensions), flat("slices", np.int64), int(flat("probes", np.int64)[0]) if rows else 0)


def _turned(cells: Cells, turn: np.ndarray) -> Cells:
    return cells._replace(first=cells.first @ turn, second=cells.second @ turn)


def _place(cell: np.ndarray, slice_: np.ndarray, cells: Cells) -> np.ndarray:
    """Number of a slice of a cell."""
    return slice_ * (len(cells.first) * len(cells.second)) + cell


def _bucket(place: np.ndarray, parts: int) -> np.ndarray:
    return ((place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _home(cell: np.ndarray, key: np.ndarray, cells: Cells) -> np.ndarray:
    return _place(cell, (key >> 7) % cells.slices[cell // len(cells.second)], cells)


def _visits(probes: np.ndarray, cells: Cells) -> tuple[np.ndarray, np.ndarray]:
    """Rows, and the places they visit: all slices of the cells they probe."""
    flat, who = probes.ravel(), np.repeat(np.arange(len(probes)), probes.shape[1])
    times = cells.slices[flat // len(cells.second)]
    slice_ = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(who, times), _place(np.repeat(flat, times), slice_, cells)


def _binary(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int32() if i == 0 else pa.binary()) for i, x in enumerate(list(zip(*rows)) or [()] * len(names))], names)


_CODED = "bucket int, cell binary, key binary, code binary, scale binary, cell_b binary, key_b binary, bits binary, scale_b binary"


def _codes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """8-bit coordinates and their unit, packed signs and their correction scalars, of rotated unit vectors."""
    scale = (np.abs(y).max(1) / 127).astype(np.float32)
    return np.rint(y / scale[:, None]).astype(np.int8), scale, np.packbits(y > 0, axis=1), (np.abs(y).sum(1) / np.sqrt(y.shape[1])).astype(np.float32)


def _encode(dimensions: int, shared, marks: list[int]):
    parts = len(marks)
    names = [c.split()[0] for c in _CODED.split(", ")]

    def run(batches):
        turn = rotation(dimensions)
        cells = _turned(shared.value, turn)
        for batch in batches:
            key, first = np.unique(batch["key"].to_numpy(), return_index=True)
            y = _unit(_matrix(batch["embedding"].take(pa.array(first)), dimensions)).astype(np.float32) @ turn
            if not len(key):
                continue
            probes = _in_steps(cells, y, min(cells.probes, len(cells.first) * len(cells.second)))
            home = _home(probes[:, 0], key, cells)
            who, flat = _visits(probes, cells)
            code, scale, bits, correction = _codes(y)
            to_h, to_b = _bucket(home, parts), _bucket(flat, parts)
            rows = []
            for p in np.union1d(to_h, to_b):
                h, b = np.flatnonzero(to_h == p), np.flatnonzero(to_b == p)
                w = who[b]
                rows.append((marks[p], *(x.tobytes() for x in (home[h], key[h], code[h], scale[h], flat[b], key[w], bits[w], correction[w]))))
            yield _binary(rows, names)

    return run


def _words(bits: np.ndarray) -> np.ndarray:
    """Packed bytes as 64-bit words, filled up with zeros."""
    return np.ascontiguousarray(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))).view(np.uint64)


class Queries:
    """Rotated vectors in eight bit planes of their 8-bit coordinates."""

    def __init__(self, code: np.ndarray, scale: np.ndarray):
        up = (code.astype(np.int16) + 128).astype(np.uint8)
        self.planes = np.stack([_words(np.packbits(up >> j & 1, axis=1)) for j in range(8)], axis=1)
        self.total, self.scale, self.size = code.sum(axis=1, dtype=np.int64), scale, code.shape[1]

    def unequal(self, q: slice, words: np.ndarray) -> np.ndarray:
        """Signs in which queries and codes differ, for all pairs: the top plane against the codes."""
        out = np.zeros((len(range(*q.indices(len(self.scale)))), len(words)), np.uint16)
        for w in range(words.shape[1]):
            out += np.bitwise_count(self.planes[q, 7, w][:, None] ^ words[:, w][None, :])
        return out

    def estimate(self, q: np.ndarray, words: np.ndarray, correction: np.ndarray) -> np.ndarray:
        """Estimated cosines of pairs, from bit counts of the packed codes against each plane."""
        counts = np.bitwise_count(self.planes[q] & words[:, None, :]).sum(axis=2, dtype=np.int64)
        inside = counts @ (1 << np.arange(8)) - 128 * np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        return (2 * inside - self.total[q]) * self.scale[q] / (np.sqrt(self.size) * correction)


def bounds(estimate: np.ndarray, correction: np.ndarray, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest cosine for which a pair's estimate lies within ``SIGMAS`` standard errors."""
    spread = SIGMAS * np.sqrt(np.maximum(1 - correction.astype(np.float64) ** 2, 0)) / correction / np.sqrt(dimensions - 1)
    root = spread * np.sqrt(np.maximum(1 + spread**2 - estimate**2, 0))
    return (estimate - root) / (1 + spread**2) - _ROUNDING, (estimate + root) / (1 + spread**2) + _ROUNDING


def _most_unequal(dimensions: int, within: float) -> int:
    """Signs in which two vectors within the distance may differ: each does with a probability of the angle over pi."""
    p = np.arccos(1 - within) / np.pi
    return int(dimensions * p + SIGMAS * np.sqrt(dimensions * p * (1 - p)) + 4)


def _kth(q: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
    """For each row, the k-th largest value of its query, -inf where it has fewer; queries are sorted."""
    order = np.lexsort((-value, q))
    v = value[order]
    start = np.searchsorted(q, q)
    at = start + k - 1
    has = (at < len(q)) & (q[np.minimum(at, len(q) - 1)] == q) if len(q) else np.zeros(0, np.bool_)
    return np.where(has, v[np.minimum(at, max(0, len(q) - 1))], -np.inf) if len(q) else value


def _near(query: Queries, qkey: np.ndarray, bits: np.ndarray, bkey: np.ndarray, correction: np.ndarray, within: float, k: int):
    """Pairs of keys whose estimate leaves it open that they are within the distance and among the k nearest."""
    words = _words(bits)
    most = _most_unequal(query.size, within) if within < 1 else query.size
    out = []
    for i in range(0, len(qkey), 512):
        q, b = np.nonzero(query.unequal(slice(i, i + 512), words) <= most)
        q = q + i
        differ = qkey[q] != bkey[b]
        q, b = q[differ], b[differ]
        for c in _parts_of(q, 1 << 16):
            low, high = bounds(query.estimate(q[c], words[b[c]], correction[b[c]]), correction[b[c]], query.size)
            fine = high >= 1 - within
            own, other, low, high = q[c][fine], b[c][fine], low[fine], high[fine]
            keep = high >= _kth(own, low, k)
            out.append(np.stack([qkey[own[keep]], bkey[other[keep]]], 1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _parts_of(q: np.ndarray, rows: int):
    """Slices of a sorted array of about so many rows, none of which ends inside a run of equals."""
    a = 0
    while a < len(q):
        b = len(q) if a + rows >= len(q) else int(np.searchsorted(q, q[a + rows], side="left"))
        if b <= a:
            b = int(np.searchsorted(q, q[a], side="right"))
        yield slice(a, b)
        a = b


def _held(batches, kinds) -> list[list[np.ndarray]]:
    """Columns of each bucket of packed rows."""
    held: dict[int, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            held.setdefault(row.pop("bucket"), []).append(list(row.values()))
    for bucket in list(held):
        yield [np.concatenate([np.frombuffer(x, kind) for x in col]) for col, kind in zip(zip(*held.pop(bucket)), kinds)]


def _by_place(place: np.ndarray, key: np.ndarray, place_b: np.ndarray, key_b: np.ndarray):
    """Rows of either side of each place that both have, every key once."""
    order, order_b = np.lexsort((key, place)), np.lexsort((key_b, place_b))
    at, at_b = place[order], place_b[order_b]
    for c in np.intersect1d(place, place_b):
        h = order[np.searchsorted(at, c) : np.searchsorted(at, c, side="right")]
        b = order_b[np.searchsorted(at_b, c) : np.searchsorted(at_b, c, side="right")]
        yield h[np.unique(key[h], return_index=True)[1]], b[np.unique(key_b[b], return_index=True)[1]]


def _meet(dimensions: int, within: float, k: int, marks: list[int]):
    parts = len(marks)
    kinds = (np.int64, np.int64, np.int8, np.float32, np.int64, np.int64, np.uint8, np.float32)

    def run(batches):
        for cell, key, code, scale, cell_b, key_b, bits, correction in _held(batches, kinds):
            code, bits = code.reshape(-1, dimensions), bits.reshape(-1, (dimensions + 7) // 8)
            found = [_near(Queries(code[h], scale[h]), key[h], bits[b], key_b[b], correction[b], within, k) for h, b in _by_place(cell, key, cell_b, key_b)]
            pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            if len(pairs):
                pairs = np.unique(np.sort(pairs, axis=1), axis=0)
                group = pairs[:, 0] % parts
                own = np.unique(group)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([marks[g] for g in own], pa.int32()), *(pa.array([pairs[group == g, i] for g in own], pa.list_(pa.int64())) for i in (0, 1))], ["group", "a", "b"]
                )

    return run


def _packed_vectors(dimensions: int, marks: list[int]):
    """Distinct vectors of a batch, packed by group."""
    parts = len(marks)

    def run(batches):
        for batch in batches:
            key, first = np.unique(batch["key"].to_numpy(), return_index=True)
            x = _matrix(batch["embedding"].take(pa.array(first)), dimensions)
            group = key % parts
            own = np.unique(group)
            # bytes of equal significance lie together: the codec of the shuffle makes more of them
            flat = lambda v: np.ascontiguousarray(v.view(np.uint8).reshape(v.size, 4).T).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([marks[g] for g in own], pa.int32()), *(pa.array(v, pa.binary()) for v in ([key[group == g].tobytes() for g in own], [flat(x[group == g]) for g in own]))], ["group", "key", "vector"])

    return run


def _unpack(vectors: pa.Table, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    keys = [np.frombuffer(x, np.int64) for x in vectors["key"].to_pylist()]
    rows = [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view(np.float32).reshape(-1, dimensions) for x in vectors["vector"].to_pylist()]
    if not keys:
        return np.zeros(0, np.int64), np.zeros((0, dimensions), np.float32)
    key, first = np.unique(np.concatenate(keys), return_index=True)
    return key, np.concatenate(rows)[first]


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([x.flatten().to_numpy() for x in column.chunks] or [np.zeros(0, np.int64)])


def _attach(dimensions: int, marks: list[int]):
    parts = len(marks)

    def run(vectors: pa.Table, pairs: pa.Table) -> pa.Table:
        out = []
        if pairs.num_rows:
            both = np.unique(np.stack([_flat(pairs["a"]), _flat(pairs["b"])], 1), axis=0)
            key, x = _unpack(vectors, dimensions)
            at = np.searchsorted(key, both[:, 0])
            target = both[:, 1] % parts
            for g in np.unique(target):
                mine = target == g
                row, local = np.unique(at[mine], return_inverse=True)
                out.append((marks[g], key[row].tobytes(), x[row].tobytes(), local.astype(np.int32).tobytes(), both[mine, 1].tobytes()))
        kinds = (pa.int32(), *[pa.binary()] * 4)
        return pa.table([pa.array(list(v), kind) for v, kind in zip(list(zip(*out)) or [()] * 5, kinds)], ["group", "key", "vector", "local", "b"])

    return run


def _rerank(dimensions: int, within: float):
    def run(vectors: pa.Table, rows: pa.Table) -> pa.Table:
        a, b, d = [], [], []
        if rows.num_rows:
            key, x = _unpack(vectors, dimensions)
            for r in rows.to_pylist():
                left = np.frombuffer(r["key"], np.int64)
                y = _unit(np.frombuffer(r["vector"], np.float32).reshape(-1, dimensions))
                local, partner = np.frombuffer(r["local"], np.int32), np.frombuffer(r["b"], np.int64)
                z = _unit(x[np.searchsorted(key, partner)])
                distance = 1 - np.einsum("ij,ij->i", y[local], z)
                keep = distance <= within + 1e-9
                a.append(left[local[keep]]), b.append(partner[keep]), d.append(np.maximum(distance[keep], 0.0))
        cat = lambda v, kind: np.concatenate(v) if v else np.zeros(0, kind)
        return pa.table([pa.array(cat(a, np.int64)), pa.array(cat(b, np.int64)), pa.array(cat(d, np.float64))], ["a", "b", "distance"])

    return run


_SOUGHT = "bucket int, cell binary, key binary, vector binary, bits binary, scale binary, cell_q binary, key_q binary, vector_q binary"


def _deal(dimensions: int, shared, marks: list[int], width: int):
    """Rows of the index to their own cells, with code and vector; queries to the cells they visit, with their vector."""
    parts = len(marks)
    names = [c.split()[0] for c in _SOUGHT.split(", ")]

    def run(batches):
        turn = rotation(dimensions)
        cells = _turned(shared.value, turn)
        for batch in batches:
            key, first = np.unique(batch["key"].to_numpy(), return_index=True)
            asked = batch["asked"].to_numpy(zero_copy_only=False)[first].astype(np.bool_)
            x = _matrix(batch["embedding"].take(pa.array(first)), dimensions)
            y = _unit(x).astype(np.float32) @ turn
            step = [y[i : i + 4096] for i in range(0, len(y), 4096)]
            for i, y in zip(range(0, len(key), 4096), step):
                k, v, ask = key[i : i + 4096], x[i : i + 4096], np.flatnonzero(asked[i : i + 4096])
                home = _home(_in_steps(cells, y, 1)[:, 0], k, cells)
                who, flat = _visits(_in_steps(cells, y[ask], width), cells)
                _, _, bits, correction = _codes(y)
                to_h, to_b = _bucket(home, parts), _bucket(flat, parts)
                rows = []
                for p in np.union1d(to_h, to_b):
                    h, b = np.flatnonzero(to_h == p), np.flatnonzero(to_b == p)
                    q = ask[who[b]]
                    rows.append((marks[p], *(z.tobytes() for z in (home[h], k[h], v[h], bits[h], correction[h], flat[b], k[q], v[q]))))
                yield _binary(rows, names)

    return run


def _nearest_in_cell(query: Queries, x: np.ndarray, qkey: np.ndarray, z: np.ndarray, bits: np.ndarray, correction: np.ndarray, bkey: np.ndarray, k: int):
    """The k nearest of a cell's vectors for every query, those with the best estimates first, then all that the bounds leave open."""
    words = _words(bits)
    for i in range(0, len(qkey), 64):
        n = len(qkey[i : i + 64])
        q, b = np.repeat(np.arange(n), len(bkey)), np.tile(np.arange(len(bkey)), n)
        differ = qkey[i + q] != bkey[b]
        q, b = q[differ], b[differ]
        estimate = query.estimate(i + q, words[b], correction[b])
        low, high = bounds(estimate, correction[b], query.size)
        cosine = np.full(len(q), -np.inf)
        first = estimate >= _kth(q, estimate, k)
        cosine[first] = np.einsum("ij,ij->i", x[i + q[first]], z[b[first]])
        rest = ~first & (high >= np.maximum(_kth(q, cosine, k), _kth(q, low, k)))
        cosine[rest] = np.einsum("ij,ij->i", x[i + q[rest]], z[b[rest]])
        keep = cosine >= np.maximum(_kth(q, cosine, k) - 1e-12, -2)
        yield qkey[i + q[keep]], bkey[b[keep]], np.maximum(1 - cosine[keep], 0.0)


def _seek(dimensions: int, k: int):
    kinds = (np.int64, np.int64, np.float32, np.uint8, np.float32, np.int64, np.int64, np.float32)

    def run(batches):
        for cell, key, vector, bits, correction, cell_q, key_q, vector_q in _held(batches, kinds):
            vector, vector_q, bits = vector.reshape(-1, dimensions), vector_q.reshape(-1, dimensions), bits.reshape(-1, (dimensions + 7) // 8)
            for h, b in _by_place(cell, key, cell_q, key_q):
                x, z = _unit(vector_q[b]), _unit(vector[h])
                code, scale, _, _ = _codes(x.astype(np.float32) @ rotation(dimensions))
                for found in _nearest_in_cell(Queries(code, scale), x, key_q[b], z, bits[h], correction[h], key[h], k):
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in found], ["a", "b", "distance"])

    return run


def search(asked: DataFrame, vectors: DataFrame, dimensions: int = 256, k: int = 5) -> DataFrame:
    """(post_id, nearest, distance): for every post of ``asked`` its k nearest other posts of ``vectors``, however far.

    ``asked`` holds post_ids of ``vectors``.  Each query visits the ``SEARCH_PROBES`` nearest cells,
    or ``SEARCH_SHARE`` of all if that is more; what its cells hold is found exactly but for the odds
    of ``SIGMAS`` standard errors.  Ties go to the smaller post_id; null and unknown ids have no rows.
    """
    wanted = asked.select("post_id").distinct().withColumn("asked", F.lit(True))
    keyed = vectors.join(wanted, "post_id", "left").select("post_id", F.xxhash64("embedding").alias("key"), "embedding", F.coalesce("asked", F.lit(False)).alias("asked"))
    return _named(keyed.where("asked").select("post_id", "key").distinct(), keyed, _class_search(keyed, vectors, dimensions, k), k)


def _class_search(keyed: DataFrame, vectors: DataFrame, dimensions: int, k: int) -> DataFrame:
    """(a, b, distance): the k nearest distinct vectors b of every vector a that some row asks for."""
    spark = keyed.sparkSession
    cells = _cells(vectors, dimensions, 2.0)
    if not len(cells.first):
        return spark.createDataFrame([], "a bigint, b bigint, distance double")
    marks = labels(spread(vectors))
    every = len(cells.first) * len(cells.second)
    width = min(every, max(SEARCH_PROBES, int(SEARCH_SHARE * every)))
    dealt = keyed.select("key", "embedding", "asked").mapInArrow(_deal(dimensions, spark.sparkContext.broadcast(cells), marks, width), _SOUGHT)
    found = dealt.repartition(len(marks), "bucket").mapInArrow(_seek(dimensions, k), "a bigint, b bigint, distance double")
    return found.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("distance", "b"))).where(F.col("r") <= k).drop("r")


def class_neighbours(vectors: DataFrame, dimensions: int, k: int, within: float) -> DataFrame:
    """(a, b, distance) of distinct vectors by class key: exact distances of the candidates that the codes leave.

    From a distance of 1 on codes leave too much, so every vector is a query of ``search``.
    """
    spark = vectors.sparkSession
    keyed = vectors.select(F.xxhash64("embedding").alias("key"), "embedding")
    if within >= 1:
        return _class_search(keyed.withColumn("asked", F.lit(True)), vectors, dimensions, k).where(F.col("distance") <= within + 1e-9)
    marks = labels(spread(vectors))
    parts = len(marks)
    shared = spark.sparkContext.broadcast(_cells(vectors, dimensions, within))
    if not len(shared.value.first):
        return spark.createDataFrame([], "a bigint, b bigint, distance double")
    coded = keyed.mapInArrow(_encode(dimensions, shared, marks), _CODED).repartition(parts, "bucket")
    pairs = coded.mapInArrow(_meet(dimensions, within, k, marks), "group int, a array<bigint>, b array<bigint>").repartition(parts, "group")
    grouped = keyed.mapInArrow(_packed_vectors(dimensions, marks), "group int, key binary, vector binary").repartition(parts, "group").groupBy("group")
    attached = grouped.cogroup(pairs.groupBy("group")).applyInArrow(_attach(dimensions, marks), "group int, key binary, vector binary, local binary, b binary").repartition(parts, "group")
    return grouped.cogroup(attached.groupBy("group")).applyInArrow(_rerank(dimensions, within), "a bigint, b bigint, distance double")


def _named(asked: DataFrame, keyed: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Posts for class keys: the k nearest posts of those asked for (post_id, key), from (a, b, distance) seen from a."""
    # of a class of equal vectors, no more than k + 1 members can be among anyone's k nearest
    who = keyed.select("post_id", "key").distinct().withColumn("salt", F.pmod(F.xxhash64("post_id"), F.lit(64)))
    few = who.withColumn("r", F.row_number().over(Window.partitionBy("key", "salt").orderBy("post_id"))).where(F.col("r") <= k + 1)
    first = few.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("post_id"))).where(F.col("r") <= k + 1).select("key", F.col("post_id").alias("nearest"))
    listed = pairs.join(first.withColumnRenamed("key", "b"), "b").select("a", "nearest", "distance")
    listed = listed.unionByName(first.select(F.col("key").alias("a"), "nearest", F.lit(0.0).alias("distance")))
    best = listed.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("distance", "nearest"))).where(F.col("r") <= k + 1)
    lists = best.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("distance", "nearest"))).alias("list"))
    named = asked.join(lists.withColumnRenamed("a", "key"), "key")
    others = named.select("post_id", F.slice(F.filter("list", lambda x: x["nearest"] != F.col("post_id")), 1, k).alias("list"))
    return others.select("post_id", F.explode("list").alias("n")).select("post_id", "n.nearest", "n.distance")


def neighbours(vectors: DataFrame, dimensions: int = 256, k: int = 5, within: float = 2.0) -> DataFrame:
    """(post_id, nearest, distance): for every post up to k nearest other posts within a cosine distance.

    ``vectors`` holds (post_id, embedding) as ``usable`` gives them; a post counts once.  Ties go to
    the smaller post_id.  Posts with equal vectors are each other's neighbours at distance 0.
    """
    pairs = class_neighbours(vectors, dimensions, k, within)
    both = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct("b", "a").cast("struct<a:bigint,b:bigint>"))).alias("p"), "distance").select("p.a", "p.b", "distance").groupBy("a", "b").agg(F.min("distance").alias("distance"))
    keyed = vectors.select("post_id", F.xxhash64("embedding").alias("key"))
    return _named(keyed.distinct(), keyed, both, k)


def close_pairs(vectors: DataFrame, dimensions: int = 256, k: int = 5, within: float = 0.12) -> DataFrame:
    """(post_a, post_b): posts within the distance of which one is among the k nearest of the other."""
    near = neighbours(vectors, dimensions, k, within)
    return near.select(F.least("post_id", "nearest").alias("post_a"), F.greatest("post_id", "nearest").alias("post_b")).distinct()
