"""p1: near-duplicate records, by prefix filtering under several global token orders.

Tokens are runs of consecutive words; two records match when the Jaccard similarity of their token
sets reaches a threshold t, that is, when they have o = ceil(t/(1+t) (|x|+|y|)) tokens in common.
For any total order of all tokens, let P(x) and P(y) be the first p and q tokens of the sets.  The
prefix that ends earlier holds all common tokens up to its end, so a match has at least
o - max(|x|-p, |y|-q) tokens in P(x) and P(y) both.  This holds for every order, hence a pair has to
pass under each of them before any set is moved or compared.

1. A bounded count sketch over all records ranks tokens by frequency (two rows of counters, summed
   over all rows of the table; its size doesn't depend on the input).
2. Order 1, rare tokens first, drives an inverted join: each distinct text sends the tokens of its
   shortest sufficient prefix (one common token) to token buckets, with its set's size and a parity
   bitmap of each of its prefixes under orders 2 (ascending hash) and 3 (descending hash).  A hot
   token's list is cut into slices; each pair of slices is a list of its own, in any bucket.
3. In a bucket, texts with a common token are paired.  Two bitmaps differ in at most as many bits as
   the prefixes differ in tokens, which bounds the common prefix tokens from above: pairs that cannot
   reach the number due under order 2, then under order 3, go.
4. The pairs left visit the group of their first text, which is added, then that of the second,
   where the sets are compared exactly.

Copies of one text form a class and are processed once; ``near_duplicates`` links a class's members.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sievework.llm import kernels as K
from sievework.partitioning import label_of, labels, planned_bytes, shuffle_width, spread

SKETCH_BITS = 18
SKETCH_ROWS = 2
#: 64-bit words of a prefix bitmap for sets of up to ``BITMAP_TOKENS`` tokens; both double together.
BITMAP_WORDS = 6
BITMAP_TOKENS = 200
#: Rows of a token's list that are paired in one place; a longer list is cut into slices.
LIST_ROWS = 4_096
#: Input bytes for which a token bucket is made.
BUCKET_BYTES = 32 << 20
#: Members of a class of copies that are paired one by one; the others are tied to one of them.
DELEGATES = 32
#: Parts in which the members of one class are handled.
SALTS = 64
_SEEDS = (0x51ED270B, 0x7FEB352D)
_BIT = (np.uint64(1), np.uint64(0x9E3779B97F4A7C15))
_SKETCH_BLOCKS = 16


def _text_rows(title: pa.ChunkedArray | pa.Array, body: pa.ChunkedArray | pa.Array) -> tuple[list[str], list[str]]:
    return [x or "" for x in title.to_pylist()], [x or "" for x in body.to_pylist()]


def _within_texts(doc: np.ndarray, order: np.ndarray) -> np.ndarray:
    """A sorting permutation, sorted once more by text: narrow numbers make that a radix sort."""
    d = doc[order]
    return order[np.argsort(d.astype(np.uint16) if len(d) and doc[-1] < 65536 else d, kind="stable")]


def token_sets(titles: list[str], bodies: list[str], shingle: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct token hashes of every record and their offsets; a record with too short a body has none."""
    parts, counts = [], []
    for a, b in K.blocks(bodies):
        body_h, body_at = K.words(bodies[a:b])
        title_h, title_at = K.words(titles[a:b])
        nt, nb = np.diff(title_at), np.diff(body_at)
        at = np.zeros(b - a + 1, np.int64)
        np.cumsum(nt + nb, out=at[1:])
        h = np.empty(at[-1], np.uint64)
        h[np.repeat(at[:-1] - title_at[:-1], nt) + np.arange(len(title_h))] = title_h
        h[np.repeat(at[:-1] + nt - body_at[:-1], nb) + np.arange(len(body_h))] = body_h
        s, to = K.runs_of(h, at, shingle)
        doc = np.repeat(np.arange(b - a), np.diff(to))
        keep = nb[doc] >= least_words
        s, doc = s[keep], doc[keep]
        order = _within_texts(doc, np.argsort(s))
        s, doc = s[order], doc[order]
        first = np.ones(len(s), np.bool_)
        first[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
        parts.append(s[first])
        counts.append(np.bincount(doc[first], minlength=b - a))
    at = np.zeros(len(bodies) + 1, np.int64)
    if parts:
        np.cumsum(np.concatenate(counts), out=at[1:])
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), at


def _cells(tokens: np.ndarray, row: int) -> np.ndarray:
    return (K.mix(tokens + np.uint64(_SEEDS[row])) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _frequency(sketch: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Count-min estimate of how many records hold each token."""
    return np.minimum.reduce([sketch[r][_cells(tokens, r)] for r in range(SKETCH_ROWS)])


def ranks(count: np.ndarray, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Place of every token in its own set under order 1: rare tokens first, ties by a hash."""
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    h = K.mix(tokens ^ np.uint64(_SEEDS[1]))
    key = np.minimum(count, (1 << 32) - 1).astype(np.uint64) << np.uint64(32) | h >> np.uint64(32)
    by = _within_texts(doc, np.argsort(key, kind="stable"))
    out = np.empty(len(tokens), np.int64)
    out[by] = np.arange(len(tokens)) - np.repeat(at[:-1], n)
    return out


def _prefix_lengths(n: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Prefix that has one token in common with a match, as the larger of a pair and as the smaller (never longer)."""
    ceil = lambda x: np.ceil(np.round(x, 9)).astype(np.int64)
    return n - ceil(t * n) + 1, n - ceil(2 * t / (1 + t) * n) + 1


def _long_prefix(n: np.ndarray, t: float) -> np.ndarray:
    """Prefix under orders 2 and 3: longer than one common token needs, so that many are due in it."""
    return np.ceil((1 - 0.3 * t) * n).astype(np.int64)


def _due(na: np.ndarray, nb: np.ndarray, t: float) -> np.ndarray:
    """Most tokens by which two long prefixes of a match may differ."""
    p, q = _long_prefix(na, t), _long_prefix(nb, t)
    common = np.ceil(np.round(t / (1 + t) * (na + nb), 9)).astype(np.int64) - np.maximum(na - p, nb - q)
    return p + q - 2 * common


def sketch_of(texts: DataFrame, shingle: int, least_words: int) -> np.ndarray:
    """The count sketch over all rows: 2 x 2^18 counters, whatever the input's size."""
    size = 1 << SKETCH_BITS

    def count(batches):
        total = np.zeros((SKETCH_ROWS, size), np.int64)
        for batch in batches:
            tokens, _ = token_sets(*_text_rows(batch["title"], batch["body"]), shingle, least_words)
            for r in range(SKETCH_ROWS):
                total[r] += np.bincount(_cells(tokens, r), minlength=size)
        # counters as narrow as a block's largest allows
        flat = [x.astype(np.min_scalar_type(x.max())) for x in total.reshape(_SKETCH_BLOCKS, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(_SKETCH_BLOCKS), pa.int32()), pa.array([x.tobytes() for x in flat], pa.binary())], ["block", "counts"])

    def add(table: pa.Table) -> pa.Table:
        one = SKETCH_ROWS * size // _SKETCH_BLOCKS
        total = sum((np.frombuffer(x, f"u{len(x) // one}").astype(np.uint64) for x in table["counts"].to_pylist()), np.zeros(one, np.uint64))
        return pa.table({"block": table["block"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, counts binary"
    rows = texts.select("title", "body").mapInArrow(count, schema).groupBy("block").applyInArrow(add, schema).collect()
    out = np.zeros((_SKETCH_BLOCKS, SKETCH_ROWS * size // _SKETCH_BLOCKS), np.uint64)
    for r in rows:
        out[r.block] = np.frombuffer(r.counts, np.uint64)
    return out.reshape(SKETCH_ROWS, size).astype(np.int64)


def _level(n: np.ndarray) -> np.ndarray:
    """How often a set's bitmaps are doubled for its size."""
    return np.ceil(np.log2(np.maximum(n, BITMAP_TOKENS) / BITMAP_TOKENS)).astype(np.int64)


def _bitmaps(tokens: np.ndarray, at: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Parity bitmaps of the prefixes under orders 2 and 3, all sets' words end to end, and the sets' offsets in them.

    Tokens are sorted within a set, so that these orders are their places from either end.
    """
    n = np.diff(at)
    width = BITMAP_WORDS << _level(n)
    to = np.concatenate([[0], np.cumsum(2 * width)])
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(tokens)) - at[:-1][doc]
    prefix = _long_prefix(n, t)[doc]
    h = K.mix(tokens ^ np.uint64(_SEEDS[0]))
    bits = (64 * width[doc]).astype(np.uint64)
    total = np.zeros(64 * to[-1], np.uint8)
    for k, inside in enumerate((place < prefix, place >= n[doc] - prefix)):
        # each order has bits of its own, so that what one misses by chance the other drops
        own, bit = doc[inside], ((h[inside] * _BIT[k] >> np.uint64(24)) % bits[inside]).astype(np.int64)
        np.bitwise_xor.at(total, 64 * (to[own] + k * width[own]) + bit, 1)
    return np.packbits(total, bitorder="little").view(np.uint64), to


class _Maps:
    """Bitmaps of the texts of a bucket at every level, the longer ones folded down to the shorter."""

    def __init__(self, size: np.ndarray, words: np.ndarray, to: np.ndarray):
        self.level = _level(size)
        self.rows: dict[int, np.ndarray] = {}
        self.place = {}
        for level in range(int(self.level.max(initial=0)), -1, -1):
            own = np.flatnonzero(self.level == level)
            width = BITMAP_WORDS << level
            found = words[to[own][:, None] + np.arange(2 * width)].reshape(-1, 2, width)
            longer = self.rows.get(level + 1)
            who = own
            if longer is not None:
                # a place modulo m follows from the place modulo 2 m: the halves of a parity bitmap are added
                found = np.concatenate([found, longer[:, :, :width] ^ longer[:, :, width:]])
                who = np.concatenate([own, self.who])
            self.rows[level], self.who = found, who
            place = np.zeros(len(size), np.int64)
            place[who] = np.arange(len(who))
            self.place[level] = place

    def apart(self, a: np.ndarray, b: np.ndarray, order: int) -> np.ndarray:
        """Bits in which the prefixes of each pair differ under an order."""
        level = np.minimum(self.level[a], self.level[b])
        top = int(level.max(initial=0))
        if not top:
            return self._count(a, b, order, 0)
        out = np.empty(len(a), np.int64)
        for v in np.unique(level):
            own = level == v
            out[own] = self._count(a[own], b[own], order, int(v))
        return out

    def _count(self, a, b, order, level):
        rows, place = self.rows[level][:, order], self.place[level]
        return np.bitwise_count(rows[place[a]] ^ rows[place[b]]).sum(axis=1, dtype=np.int64)


def _slices(h: np.ndarray, count: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (by index) and list hashes: a hot token's rows go to one list for each slice that theirs meets."""
    parts = np.maximum(1, -(-count // LIST_ROWS))
    row = np.repeat(np.arange(len(h)), parts)
    first = np.cumsum(parts) - parts
    other = (np.arange(len(row)) - first[row]).astype(np.uint64)
    g = parts[row].astype(np.uint64)
    own = K.mix(key[row].astype(np.uint64)) % g
    block = np.minimum(own, other) * g + np.maximum(own, other) + np.uint64(1)
    return row, np.where(g > 1, K.mix(h[row] + block * np.uint64(0x9E3779B97F4A7C15)), h[row])


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, end), one behind the other."""
    n = end - start
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _low3(h: np.ndarray) -> bytes:
    """Three bytes of each hash: enough inside a bucket, where two tokens that look alike cost a comparison and no result."""
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def _prefix_rows(t: float, shingle: int, least_words: int, shared, marks: list[int]):
    """Batches of texts to rows (bucket, and packed arrays of the prefix tokens and of the texts they come from)."""
    parts = len(marks)

    def run(batches):
        sketch = shared.value
        for batch in batches:
            key = batch["key"].to_numpy()
            _, first = np.unique(key, return_index=True)
            batch = batch.take(pa.array(first))
            key = batch["key"].to_numpy()
            for a in range(0, len(key), 30_000):
                yield from one(sketch, key[a : a + 30_000], batch.slice(a, 30_000))

    def one(sketch, key, batch):
        tokens, at = token_sets(*_text_rows(batch["title"], batch["body"]), shingle, least_words)
        if not len(tokens):
            return
        n = np.diff(at)
        doc = np.repeat(np.arange(len(n)), n)
        count = _frequency(sketch, tokens)
        rank = ranks(count, tokens, at)
        large, small = _prefix_lengths(n, t)
        keep = rank < large[doc]
        early = rank < small[doc]
        row, h = _slices(K.mix(tokens[keep]), count[keep], key[doc[keep]])
        doc_o, early = doc[keep][row], early[keep][row]
        bucket = (h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        maps, to = _bitmaps(tokens, at, t)
        o = np.lexsort((~early, doc_o, bucket))
        h, doc_o, early, bucket = h[o].astype(np.uint32), doc_o[o], early[o], bucket[o]
        own, first = np.unique(bucket, return_index=True)
        edge = np.append(first, len(bucket))
        out = []
        for i, p in enumerate(own.tolist()):
            s = slice(edge[i], edge[i + 1])
            who, local = np.unique(doc_o[s], return_inverse=True)
            counts = np.stack([np.bincount(local[early[s]], minlength=len(who)), np.bincount(local[~early[s]], minlength=len(who))]).astype(np.uint32)
            words = maps[_ranges(to[who], to[who + 1])]
            out.append((marks[p], _low3(h[s]), counts.tobytes(), key[who].tobytes(), n[who].astype(np.uint32).tobytes(), words.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if i == 0 else pa.binary()) for i, x in enumerate(zip(*out))], ["bucket", "token", "counts", "key", "size", "bits"])

    return run


_PREFIX = "bucket int, token binary, counts binary, key binary, size binary, bits binary"


def _meetings(t: float, rows: list[dict], tally: list[int]):
    """Pairs of places in a bucket's list of keys that pass under every order, in chunks; the keys come first.

    ``tally`` adds up the pairs met under order 1, and those left by order 2 and by order 3.
    """
    token, who, early, base, keys, sizes, maps, at = [], [], [], 0, [], [], [], [np.zeros(1, np.int64)]
    for r in rows:
        token.append(np.frombuffer(r["token"], np.uint8).reshape(-1, 3) @ np.array([1, 1 << 8, 1 << 16], np.uint32))
        keys.append(np.frombuffer(r["key"], np.int64))
        counts = np.frombuffer(r["counts"], np.uint32).reshape(2, -1).T.ravel()
        who.append(np.repeat(np.arange(len(counts), dtype=np.int32) // 2 + base, counts))
        early.append(np.repeat(np.arange(len(counts)) % 2 == 0, counts))
        sizes.append(np.frombuffer(r["size"], np.uint32).astype(np.int64))
        maps.append(np.frombuffer(r["bits"], np.uint64))
        at.append(2 * (BITMAP_WORDS << _level(sizes[-1])))
        base += len(keys[-1])
    token, who, early, keys, sizes, maps = map(np.concatenate, (token, who, early, keys, sizes, maps))
    # one entry for each text, wherever its copies came from
    keys, first, same = np.unique(keys, return_index=True, return_inverse=True)
    yield keys
    sizes, maps, who = sizes[first], _Maps(sizes[first], maps, np.cumsum(np.concatenate(at))[first]), same[who]
    order = np.lexsort((sizes[who], token))
    token, who, early = token[order], who[order], early[order]
    end = np.searchsorted(token, token, side="right")
    live = np.arange(len(token))
    shift = 0
    while len(live):
        shift += 1
        live = live[live + shift < end[live]]
        # the earlier row has the smaller set, and its token has to be in the shorter prefix
        a, b = live[early[live]], live[early[live]] + shift
        a, b = who[a], who[b]
        ok = (a != b) & (sizes[a] >= t * sizes[b] - 1e-9)
        a, b = a[ok], b[ok]
        tally[0] += len(a)
        most = _due(sizes[a], sizes[b], t)
        for k in (0, 1):
            ok = maps.apart(a, b, k) <= most
            a, b, most = a[ok], b[ok], most[ok]
            tally[1 + k] += len(a)
        if len(a):
            yield np.minimum(a, b).astype(np.int64) << 32 | np.maximum(a, b)


def _buckets(batches):
    held: dict[int, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            held.setdefault(row["bucket"], []).append(row)
    for b in list(held):
        yield held.pop(b)


def _pair_up(t: float, marks: list[int]):
    """Packed prefix rows of whole buckets to candidate pairs, grouped by the first text's group."""
    parts = len(marks)

    def run(batches):
        for rows in _buckets(batches):
            yield from bucket(rows)

    def bucket(rows):
        found = _meetings(t, rows, [0, 0, 0])
        keys = next(found)
        seen: list[np.ndarray] = []
        pending = 0
        for chunk in found:
            seen.append(chunk)
            pending += len(chunk)
            if pending > 1 << 21:
                seen, pending = [np.unique(np.concatenate(seen))], 0
        if not seen:
            return
        pairs = np.unique(np.concatenate(seen))
        a, b = keys[pairs >> 32], keys[pairs & 0xFFFFFFFF]
        group = a % parts
        order = np.lexsort((b, a, group))
        a, b, group = a[order], b[order], group[order]
        own, first = np.unique(group, return_index=True)
        edge = np.append(first, len(group))
        yield pa.RecordBatch.from_arrays(
            [pa.array([marks[g] for g in own], pa.int32()), *(pa.array([x[i:j] for i, j in zip(edge, edge[1:])], pa.list_(pa.int64())) for x in (a, b))], ["group", "a", "b"]
        )

    return run


def _count_meetings(t: float):
    def run(batches):
        tally = [0, 0, 0]
        for rows in _buckets(batches):
            for _ in _meetings(t, rows, tally):
                pass
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in tally], ["order_1", "order_2", "order_3"])

    return run


_TEXTS = pa.schema([("key", pa.int64()), ("title", pa.string()), ("body", pa.string())])


def _packed_texts(marks: list[int]):
    """The distinct texts of a batch by group, compressed together: far smaller than what the shuffle's codec makes of single rows."""
    parts = len(marks)

    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            key = batch["key"].to_numpy()
            _, first = np.unique(key, return_index=True)
            group = key[first] % parts
            order = np.argsort(group, kind="stable")
            first, group = first[order], group[order]
            own, start = np.unique(group, return_index=True)
            blobs = []
            for i, j in zip(start, np.append(start[1:], len(group))):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, _TEXTS, options=options) as out:
                    out.write_table(pa.Table.from_batches([batch.take(pa.array(first[i:j]))]).cast(_TEXTS))
                blobs.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array([marks[g] for g in own], pa.int32()), pa.array(blobs, pa.binary())], ["group", "texts"])

    return run


def _unpacked(packed: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in packed["texts"].to_pylist()] or [_TEXTS.empty_table()])


def _lists(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([x.flatten().to_numpy() for x in column.chunks] or [np.zeros(0, np.int64)])


def _wanted(texts: pa.Table, keys: np.ndarray) -> pa.Table:
    """The texts of one group that are wanted, each once, sorted by key."""
    if not len(keys):
        return _TEXTS.empty_table()
    texts = _unpacked(texts)
    own, first = np.unique(texts["key"].to_numpy(), return_index=True)
    return texts.take(pa.array(first[np.isin(own, keys)]))


def _attach(marks: list[int]):
    """Group of the first text: send it on to the groups of its partners.

    Words compress, hashes don't: a text is half as long as its token set.
    """
    parts = len(marks)

    def run(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        names, row, target, partners = ["group", "a", "title", "body", "b"], [], [], []
        rows = _wanted(texts, _lists(pairs["a"]))
        if rows.num_rows:
            both = np.unique(np.stack([_lists(pairs["a"]), _lists(pairs["b"])], 1), axis=0)
            keys = rows["key"].to_numpy()
            edge = np.searchsorted(both[:, 0], keys), np.searchsorted(both[:, 0], keys, side="right")
            for i in range(len(keys)):
                own = both[edge[0][i] : edge[1][i], 1]
                group = own % parts
                for g in np.unique(group):
                    row.append(i), target.append(marks[g]), partners.append(own[group == g])
        sent = rows.take(pa.array(row, pa.int64()))
        return pa.table([pa.array(target, pa.int32()), sent["key"], sent["title"], sent["body"], pa.array(partners, pa.list_(pa.int64()))], names)

    return run


def _verify(t: float, shingle: int, least_words: int):
    """Group of the second text: compare the sets."""

    def run(texts: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if rows.num_rows:
            own = _wanted(texts, _lists(rows["b"]))
            tokens, at = token_sets(*_text_rows(own["title"], own["body"]), shingle, least_words)
            sent, to = token_sets(*_text_rows(rows["title"], rows["body"]), shingle, least_words)
            place = {k: i for i, k in enumerate(own["key"].to_pylist())}
            for r, (a, partners) in enumerate(zip(rows["a"].to_pylist(), rows["b"].to_pylist())):
                x = sent[to[r] : to[r + 1]]
                for b in partners:
                    i = place.get(b)
                    if i is None or at[i] == at[i + 1] or not len(x):
                        continue
                    if a == b:
                        found.append((a, b, 1.0))
                        continue
                    y = tokens[at[i] : at[i + 1]]
                    both = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
                    similarity = both / (len(x) + len(y) - both)
                    if similarity >= t - 1e-12:
                        found.append((a, b, similarity))
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(list(x), k) for x, k in zip(list(zip(*found)) or [()] * 3, kinds)], ["a", "b", "similarity"])

    return run


def _keyed(corpus: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return corpus.where(F.col("post_id").isNotNull()).select("post_id", F.xxhash64(blank("title"), F.lit("\n"), blank("body")).alias("key"), blank("title").alias("title"), blank("body").alias("body"))


def members(corpus: DataFrame) -> DataFrame:
    """(key, post_id, rank): the class of equal texts that each post belongs to.

    rank numbers the first ``DELEGATES`` members of a class by post_id from 1 and is null for the
    rest.  Ranks are taken in salted parts first, so no task sorts a whole hot class.
    """
    all_ = _keyed(corpus).select("key", "post_id").distinct().withColumn("salt", F.pmod(F.xxhash64("post_id"), F.lit(SALTS)))
    part = all_.withColumn("r", F.row_number().over(Window.partitionBy("key", "salt").orderBy("post_id")))
    few = part.where(F.col("r") <= DELEGATES)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("post_id")))
    rest = part.where(F.col("r") > DELEGATES).select("key", "post_id", F.lit(None).cast("int").alias("rank"))
    return ranked.select("key", "post_id", F.when(F.col("rank") <= DELEGATES, F.col("rank")).alias("rank")).unionByName(rest)


def classes(corpus: DataFrame) -> DataFrame:
    """(post_id, class_id): the class of equal titles and bodies of every post, by a hash of both; null post_ids are left out."""
    return _keyed(corpus).select("post_id", F.col("key").alias("class_id")).distinct()


def _filtered(keyed: DataFrame, threshold: float, shingle: int, least_words: int) -> DataFrame:
    """Packed prefix rows of all texts, dealt to token buckets."""
    spark = keyed.sparkSession
    shared = spark.sparkContext.broadcast(sketch_of(keyed, shingle, least_words))
    # a text's bitmaps go to each bucket that it has tokens in, so buckets are few and large
    marks = labels(max(1, shuffle_width(spark) // 2, (planned_bytes(keyed) or 0) // BUCKET_BYTES))
    return keyed.select("key", "title", "body").mapInArrow(_prefix_rows(threshold, shingle, least_words, shared, marks), _PREFIX).repartition(len(marks), "bucket")


def filtered_pairs(corpus: DataFrame, threshold: float = 0.8, shingle: int = 5, least_words: int = 0) -> DataFrame:
    """One row (order_1, order_2, order_3): pairs that meet under order 1, and those that each further order leaves.

    A pair counts once for each token that it meets by.
    """
    found = _filtered(_keyed(corpus), threshold, shingle, least_words).mapInArrow(_count_meetings(threshold), "order_1 bigint, order_2 bigint, order_3 bigint")
    return found.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in found.columns))


def class_pairs(corpus: DataFrame, threshold: float = 0.8, shingle: int = 5, least_words: int = 0, repeated: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b, similarity) of distinct texts, by class key, at or above the threshold.

    ``repeated`` may name classes (column ``key``) for which the row (key, key, 1.0) shall be
    returned if their texts are long enough to count.
    """
    keyed = _keyed(corpus)
    marks = labels(spread(corpus))
    parts = len(marks)
    texts = keyed.select("key", "title", "body")
    pairs = _filtered(keyed, threshold, shingle, least_words).mapInArrow(_pair_up(threshold, marks), "group int, a array<bigint>, b array<bigint>")
    group = label_of(F.pmod("key", F.lit(parts)), marks).alias("group")
    if repeated is not None:
        pairs = pairs.unionByName(repeated.select(group, F.array("key").alias("a"), F.array("key").alias("b")))
    grouped = texts.mapInArrow(_packed_texts(marks), "group int, texts binary").repartition(parts, "group").groupBy("group")
    attached = grouped.cogroup(pairs.repartition(parts, "group").groupBy("group")).applyInArrow(_attach(marks), "group int, a bigint, title string, body string, b array<bigint>")
    return grouped.cogroup(attached.repartition(parts, "group").groupBy("group")).applyInArrow(_verify(threshold, shingle, least_words), "a bigint, b bigint, similarity double")


def near_duplicates(corpus: DataFrame, threshold: float = 0.8, shingle: int = 5, least_words: int = 0) -> DataFrame:
    """Pairs (post_a, post_b) of posts whose title and body are similar, the smaller id first.

    Null and blank texts have no tokens and match nothing; null post_ids are left out; a post
    delivered twice counts once.  Members of a class of equal texts are paired with one another and
    with those of similar classes for the first ``DELEGATES`` ids; every further copy gets one pair
    with the last of these, so a class of n copies gives O(n) rows and no post loses its link.
    ``classes`` and ``class_pairs`` say the rest: which posts are copies, and which texts match.
    """
    who = members(corpus)
    many = who.where(F.col("rank") == 2).select("key")
    verified = class_pairs(corpus, threshold, shingle, least_words, many)
    # slot 0 pairs ranked members one by one; the further copies lie in slots 1 to SALTS, tied to the last ranked member
    slots = F.when((F.col("a") == F.col("b")) & (F.col("rank") == DELEGATES), F.sequence(F.lit(0), F.lit(SALTS))).otherwise(F.array(F.lit(0)))
    left = who.where(F.col("rank").isNotNull()).select(F.col("key").alias("a"), F.col("post_id").alias("x"), "rank")
    slot = F.when(F.col("rank").isNotNull(), 0).otherwise(1 + F.pmod(F.xxhash64("post_id"), F.lit(SALTS))).cast("int")
    right = who.select(F.col("key").alias("b"), F.col("post_id").alias("y"), slot.alias("slot"))
    pairs = verified.select("a", "b").join(left, "a").select("b", "x", F.explode(slots).alias("slot")).join(right, ["b", "slot"]).where("x <> y")
    return pairs.select(F.least("x", "y").alias("post_a"), F.greatest("x", "y").alias("post_b")).distinct()
