"""p5: long exact spans shared between records, by level-wise doubling.

A character is shared if it lies in a window of ``length`` characters that another record holds
verbatim.  Windows grow over three levels, a quarter, a half and the whole of the length; only what
is repeated at one level is extended to the next.

* Level 1: of every window of the full length, the quarter-length piece with the smallest hash is
  its anchor.  The choice depends on the window's content alone, so equal windows have equal anchors
  at the same place, and only one position in about thirty is sent.
* Level 2: a window holds its anchor's extension to half the length on the left or on the right.
  Anchors whose extension is repeated in another record survive.
* Level 3: all full windows around a surviving half are hashed and compared.

Records are spread over groups by id, as many as the input's bytes ask for.  A hash is sent once per group, so a span that a third of all
records share costs as many rows as there are groups, not records.  Hashes have 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import kernels as K
from sievework.partitioning import label_of, labels, spread


class _Block:
    """Texts of a block laid end to end, with running hashes."""

    def __init__(self, texts: list[str]):
        cp, self.at = K.join(texts)
        self.sums = K.running(cp)
        self.inverse = K.powers(len(cp) + 1)[1]
        self.size = np.diff(self.at) - 1
        self.total = len(cp)

    def hashes(self, start: np.ndarray, n: int) -> np.ndarray:
        return K.mix((self.sums[start + n] - self.sums[start]) * self.inverse[start] + np.uint64(n))

    def anchors(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the anchors of all windows of the length, and the hashes of their pieces."""
        piece = length // 4
        n = self.total - piece
        if n < length - piece + 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        s = self.sums
        h = K.mix((s[piece : piece + n] - s[:n]) * self.inverse[:n] + np.uint64(piece))
        w = length - piece + 1
        least = K.sliding(np.minimum, h, w)
        # windows that run into the next text choose nothing
        start = np.zeros(self.total + 1, np.int32)
        whole = self.size >= length
        np.add.at(start, self.at[:-1][whole], 1)
        np.add.at(start, (self.at[:-1] + self.size - length + 1)[whole], -1)
        inside = np.cumsum(start[: len(least)]) > 0
        chosen = np.zeros(n + w - 1, np.uint64)
        chosen[w - 1 : w - 1 + len(least)] = np.where(inside, least, np.uint64(0))
        top = K.sliding(np.maximum, chosen, w)
        at = np.flatnonzero((h == top[:n]) & (top[:n] != 0))
        return at, h[at]

    def halves(self, at: np.ndarray, length: int):
        """Hash of the half-length window ending a quarter behind each anchor and of the one beginning at it, 0 where it leaves the text."""
        half, piece = length // 2, length // 4
        doc = np.searchsorted(self.at, at, side="right") - 1
        left_ok = at - piece >= self.at[doc]
        right_ok = at + half <= self.at[doc] + self.size[doc]
        left = np.where(left_ok, self.hashes(np.maximum(at - piece, 0), half), np.uint64(0))
        right = np.where(right_ok, self.hashes(np.minimum(at, self.total - half), half), np.uint64(0))
        return doc, left, right


def _rows_of(table: pa.Table, length: int):
    """Keys, ids and texts of a group, one for each post, in blocks."""
    key = table["key"].to_numpy()
    _, first = np.unique(key, return_index=True)
    table = table.take(pa.array(first))
    key, ids, texts = table["key"].to_numpy(), table["post_id"].to_pylist(), table["body"].to_pylist()
    for a, b in K.blocks(texts):
        yield key[a:b], ids[a:b], _Block(texts[a:b])


_MAIL = "to int, kind int, origin int, x binary, y binary, z binary"
_NAMES = ["to", "kind", "origin", "x", "y", "z"]
_KINDS = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())


def _mail(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(list(v), k) for v, k in zip(list(zip(*rows)) or [()] * 6, _KINDS)], _NAMES)


def _bucket_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _slices_of(number: np.ndarray):
    """Each number that occurs in a sorted array, with its slice."""
    own, first = np.unique(number, return_index=True)
    yield from zip(own.tolist(), map(slice, first.tolist(), [*first[1:].tolist(), len(number)]))


def _group_number(table: pa.Table, marks: dict[int, int]) -> int:
    return marks[table["group"][0].as_py()]


def _two_records(h: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, and whether more than one record holds each."""
    order = np.argsort(h, kind="stable")
    h, key = h[order], key[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    if not len(first):
        return h, np.zeros(0, np.bool_)
    return h[first], np.minimum.reduceat(key, first) != np.maximum.reduceat(key, first)


def _send_anchors(length: int, marks: list[int]):
    """A group's distinct anchors with their two extensions, to the buckets of the anchors' hashes."""
    parts, numbers = len(marks), {m: i for i, m in enumerate(marks)}

    def run(texts: pa.Table) -> pa.Table:
        origin = _group_number(texts, numbers)
        found = []
        for key, _, block in _rows_of(texts, length):
            at, h = block.anchors(length)
            doc, left, right = block.halves(at, length)
            found.append((h, left, right, key[doc]))
        h, left, right, key = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.uint64)] * 4
        # what two records of this group hold is known here: at each of the levels
        wide = lambda v: h << np.uint64(32) | v & np.uint64(0xFFFFFFFF)
        many = np.stack([_grouped_test(v, key) for v in (h, wide(left), wide(right))])
        # anchors are smallest hashes: only mixed again do they spread over the buckets
        bucket = _bucket_of(K.mix(h), parts)
        order = np.lexsort((right, left, h, bucket))
        h, left, right, many, bucket = h[order], left[order], right[order], many[:, order], bucket[order]
        start = np.append(True, (h[1:] != h[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])) if len(h) else np.zeros(0, np.bool_)
        h, left, right, many, bucket = h[start], left[start], right[start], many[:, start], bucket[start]
        rows = []
        for p, s in _slices_of(bucket):
            halves = np.stack([left[s].astype(np.uint32), right[s].astype(np.uint32)])
            rows.append((marks[p], 1, origin, h[s].astype(np.uint32).tobytes(), halves.tobytes(), np.packbits(many[:, s]).tobytes()))
        return _mail(rows)

    return run


def _grouped_test(value: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each row, whether its value occurs with more than one owner."""
    if not len(value):
        return np.zeros(0, np.bool_)
    order = np.argsort(value, kind="stable")
    v, o = value[order], owner[order]
    new = np.append(True, v[1:] != v[:-1])
    start = np.flatnonzero(new)
    many = np.minimum.reduceat(o, start) != np.maximum.reduceat(o, start)
    out = np.empty(len(v), np.bool_)
    out[order] = many[np.cumsum(new) - 1]
    return out


def _collect(batches) -> list[dict]:
    return [row for batch in batches for row in batch.to_pylist()]


def _repeated_anchors(marks: list[int]):
    """Buckets of anchors: those repeated at a quarter and then at half the length, back to their groups."""

    def run(batches):
        rows = [r for r in _collect(batches) if r["kind"] == 1]
        if not rows:
            return
        size = [len(r["x"]) // 4 for r in rows]
        h = np.concatenate([np.frombuffer(r["x"], np.uint32) for r in rows]).astype(np.uint64)
        halves = np.concatenate([np.frombuffer(r["y"], np.uint32).reshape(2, -1) for r in rows], axis=1)
        many = np.concatenate([np.unpackbits(np.frombuffer(r["z"], np.uint8), count=3 * n).astype(np.bool_).reshape(3, -1) for r, n in zip(rows, size)], axis=1)
        origin = np.repeat(np.array([r["origin"] for r in rows], np.int64), size)

        def repeated(value: np.ndarray, twice: np.ndarray, group: np.ndarray) -> np.ndarray:
            """Whether more than one record has the value: two groups, or two records of one."""
            both = np.flatnonzero(twice)
            return _grouped_test(np.append(value, value[both]), np.append(group * 2, group[both] * 2 + 1))[: len(value)]

        live = repeated(h, many[0], origin)
        h, halves, many, origin = h[live], halves[:, live], many[:, live], origin[live]
        out = []
        for side in (0, 1):
            value = h << np.uint64(32) | halves[side].astype(np.uint64)
            keep = repeated(value, many[1 + side], origin) & (halves[side] != 0)
            group, value = origin[keep], value[keep]
            order = np.lexsort((value, group))
            group, value = group[order], value[order]
            for g, s in _slices_of(group):
                out.append((marks[g], 2 + side, -1, np.unique(value[s]).tobytes(), b"", b""))
        if out:
            yield from _mail(out).to_batches()

    return run


def _received(mail: pa.Table, kind: int) -> np.ndarray:
    if not mail.num_rows:
        return np.zeros(0, np.uint64)
    own = [x for x, k in zip(mail["x"].to_pylist(), mail["kind"].to_pylist()) if k == kind]
    return np.unique(np.frombuffer(b"".join(own), np.uint64))


def _is_in(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), np.bool_)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _send_windows(length: int, marks: list[int]):
    """Full windows around the surviving halves: distinct hashes to their buckets, their places to the own group."""
    parts, numbers = len(marks), {m: i for i, m in enumerate(marks)}
    half, piece = length // 2, length // 4

    def run(texts: pa.Table, mail: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _mail([])
        origin = _group_number(texts, numbers)
        survivors = _received(mail, 2), _received(mail, 3)
        hashes, owners, rows = [], [], []
        for key, _, block in _rows_of(texts, length) if len(survivors[0]) or len(survivors[1]) else ():
            at, h = block.anchors(length)
            doc, left, right = block.halves(at, length)
            low = (h & np.uint64(0xFFFFFFFF)) << np.uint64(32)
            mark = np.zeros(block.total + 1, np.int32)
            begin, end = block.at[doc], block.at[doc] + block.size[doc] - length + 1
            for value, known, reach in ((left, survivors[0], (half + piece, piece)), (right, survivors[1], (half, 0))):
                hit = _is_in(low | (value & np.uint64(0xFFFFFFFF)), known) & (value != 0)
                first, last = np.maximum(at[hit] - reach[0], begin[hit]), np.minimum(at[hit] - reach[1] + 1, end[hit])
                fine = first < last
                np.add.at(mark, first[fine], 1)
                np.add.at(mark, last[fine], -1)
            inside = np.concatenate([[False], np.cumsum(mark)[:-1] > 0, [False]])
            edge = np.flatnonzero(inside[1:] != inside[:-1])
            first, last = edge[0::2], edge[1::2]
            if not len(first):
                continue
            start = np.flatnonzero(inside[1:-1])
            owner = np.searchsorted(block.at, start, side="right") - 1
            hashes.append(block.hashes(start, length))
            owners.append(key[owner])
            whose = np.searchsorted(block.at, first, side="right") - 1
            places = np.stack([key[whose], first - block.at[whose], last - block.at[whose]])
            rows.append((marks[origin], 5, origin, places.tobytes(), b"", b""))
        if hashes:
            h, many = _two_records(np.concatenate(hashes), np.concatenate(owners))
            for p, s in _slices_of(_bucket_of(h, parts)):
                rows.append((marks[p], 4, origin, h[s].tobytes(), np.packbits(many[s]).tobytes(), b""))
        return _mail(rows)

    return run


def _repeated_windows(marks: list[int]):
    """Buckets of full windows: the repeated ones back to their groups; places pass through."""

    def run(batches):
        rows = _collect(batches)
        out = [tuple(r[n] for n in _NAMES) for r in rows if r["kind"] == 5]
        rows = [r for r in rows if r["kind"] == 4]
        if rows:
            own = [np.frombuffer(r["x"], np.uint64) for r in rows]
            many = [np.unpackbits(np.frombuffer(r["y"], np.uint8), count=len(x)).astype(np.bool_) for r, x in zip(rows, own)]
            # a group sends a hash once: twice in all, or marked by one group, is two records
            everything = np.sort(np.concatenate([*own, *[x[m] for x, m in zip(own, many)]]))
            shared = np.unique(everything[1:][everything[1:] == everything[:-1]])
            for r, x in zip(rows, own):
                hit = x[_is_in(x, shared)]
                if len(hit):
                    out.append((marks[r["origin"]], 6, -1, hit.tobytes(), b"", b""))
        if out:
            yield from _mail(out).to_batches()

    return run


def _merge(length: int):
    """Maximal runs of shared characters of the group's texts."""

    def run(texts: pa.Table, mail: pa.Table) -> pa.Table:
        shared = _received(mail, 6)
        out: list[tuple[list, np.ndarray, np.ndarray]] = []
        if len(shared) and texts.num_rows:
            places = np.concatenate([np.frombuffer(x, np.int64).reshape(3, -1) for x, k in zip(mail["x"].to_pylist(), mail["kind"].to_pylist()) if k == 5], axis=1)
            wanted = texts.filter(pa.array(np.isin(texts["key"].to_numpy(), places[0])))
            order = np.argsort(places[0], kind="stable")
            places = places[:, order]
            for key, ids, block in _rows_of(wanted, length):
                mark = np.zeros(block.total + 1, np.int32)
                a, b = np.searchsorted(places[0], key), np.searchsorted(places[0], key, side="right")
                which = np.concatenate([np.arange(x, y) for x, y in zip(a, b)])
                base = np.repeat(block.at[:-1], b - a)
                np.add.at(mark, base + places[1][which], 1)
                np.add.at(mark, base + places[2][which], -1)
                start = np.flatnonzero(np.cumsum(mark) > 0)
                start = start[_is_in(block.hashes(start, length), shared)]
                if not len(start):
                    continue
                # a window continues a run if it begins inside or right behind the last one
                new = np.append(True, start[1:] > start[:-1] + length)
                first = start[new]
                last = start[np.append(np.flatnonzero(new)[1:], len(start)) - 1] + length
                doc = np.searchsorted(block.at, first, side="right") - 1
                out.append(([ids[i] for i in doc], first - block.at[doc], last - block.at[doc]))
        ids = [x for o in out for x in o[0]]
        cat = lambda i: np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64)
        return pa.table([pa.array(ids, pa.string()), pa.array(cat(1), pa.int64()), pa.array(cat(2), pa.int64())], ["post_id", "span_start", "span_end"])

    return run


def _once_per_batch(batches):
    for batch in batches:
        _, first = np.unique(batch["key"].to_numpy(), return_index=True)
        yield batch.take(pa.array(np.sort(first)))


def shared_spans(corpus: DataFrame, length: int = 160) -> DataFrame:
    """(post_id, span_start, span_end): maximal runs of characters that lie in shared windows.

    Positions are Unicode code points from 0, the end exclusive.  Null ids and null, empty or
    shorter bodies have no spans; a post delivered twice counts once and doesn't share with itself.
    ``length`` is a multiple of 4.
    """
    if length < 8 or length % 4:
        raise ValueError("length must be a multiple of 4, at least 8")
    marks = labels(spread(corpus))
    parts = len(marks)
    texts = corpus.select(F.col("post_id").cast("string").alias("post_id"), F.col("body").cast("string").alias("body")).where(F.col("post_id").isNotNull() & (F.length("body") >= length))
    texts = texts.withColumn("key", F.xxhash64("post_id"))
    texts = texts.mapInArrow(_once_per_batch, texts.schema)
    group = label_of(F.pmod("key", F.lit(parts)), marks).alias("group")
    grouped = texts.select(group, "key", "post_id", "body").repartition(parts, "group").groupBy("group")
    anchors = grouped.applyInArrow(_send_anchors(length, marks), _MAIL).repartition(parts, "to")
    survivors = anchors.mapInArrow(_repeated_anchors(marks), _MAIL)
    windows = grouped.cogroup(survivors.groupBy("to")).applyInArrow(_send_windows(length, marks), _MAIL).repartition(parts, "to")
    repeated = windows.mapInArrow(_repeated_windows(marks), _MAIL)
    return grouped.cogroup(repeated.groupBy("to")).applyInArrow(_merge(length), "post_id string, span_start bigint, span_end bigint")


def shares(corpus: DataFrame, length: int = 160) -> DataFrame:
    """(post_id, characters, shared_characters, share) of every post; null and empty bodies have 0 of each."""
    spans = shared_spans(corpus, length).groupBy("post_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared"))
    posts = corpus.where(F.col("post_id").isNotNull()).groupBy(F.col("post_id").cast("string").alias("post_id")).agg(F.max(F.coalesce(F.length("body"), F.lit(0))).cast("bigint").alias("characters"))
    shared = F.coalesce("shared", F.lit(0).cast("bigint"))
    return posts.join(spans, "post_id", "left").select("post_id", "characters", shared.alias("shared_characters"), F.when(F.col("characters") > 0, shared / F.col("characters")).otherwise(0.0).alias("share"))
