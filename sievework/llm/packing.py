"""p7: items into containers of fixed capacity, by bound-certified repacking.

Items are spread over blocks of bounded size and packed there by best-fit decreasing.  Lower bounds
from dual feasible functions certify a block whose container count they equal.  A block with a gap
keeps its full containers and gives up the loosest ones; the items of all blocks with gaps are
dealt to new blocks together and packed again, for a bounded number of rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.partitioning import checkpointed

#: Items of a block, about; bounds what one task holds.
BLOCK_ITEMS = 20_000
ROUNDS = 3
#: Share of a block's containers, the loosest first, that go back into the pool beside those with a gap.
LOOSEST = 0.1
_STEPS = 64


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """A number of containers that no packing of the positive sizes can undercut.

    The best of three families of dual feasible functions over the histogram of sizes: the identity,
    for each threshold k the function that rounds sizes above capacity - k up and those below k down
    to nothing, and the step functions x -> floor((k + 1) x) / k.
    """
    hist = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    hist[0] = 0
    value = np.arange(capacity + 1, dtype=np.int64)
    total = hist * value
    best = -(-int(total.sum()) // capacity)
    count, mass = np.cumsum(hist), np.cumsum(total)
    k = np.arange(1, capacity // 2 + 1)
    big = count[capacity] - count[capacity - k]
    middle = mass[capacity - k] - mass[k - 1]
    best = max(best, int((big + -(-middle // capacity)).max(initial=0)))
    for k in range(1, _STEPS + 1):
        scaled = (k + 1) * value
        # in units of 1 / (k * capacity); a size that is a multiple of 1 / (k + 1) stays what it is
        u = np.where(scaled % capacity == 0, value * k, scaled // capacity * capacity)
        best = max(best, -(-int((hist * u).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of every item: largest items first, each into the fullest container that has room."""
    order = np.argsort(-sizes, kind="stable")
    out = np.empty(len(sizes), np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set while some container has exactly r left
    n = 0
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            bin_ = open_[room].pop()
            if not open_[room]:
                rooms &= ~(1 << room)
        else:
            room, bin_ = capacity, n
            n += 1
        out[i] = bin_
        left = room - size
        open_[left].append(bin_)
        rooms |= 1 << left
    return out


_PACKED = "doc_id bigint, piece int, start bigint, tokens bigint, block bigint, bin bigint, bins bigint, bound bigint, pooled boolean"
_NAMES = [c.split()[0] for c in _PACKED.split(", ")]


def _pack(capacity: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending")])
        size = table["tokens"].to_numpy()
        bin_ = best_fit_decreasing(size, capacity)
        bins = int(bin_.max()) + 1
        bound = max(1, lower_bound(size, capacity))
        pooled = np.zeros(len(size), np.bool_)
        if bins > bound and not last:
            free = capacity - np.bincount(bin_, weights=size, minlength=bins).astype(np.int64)
            loose = np.argsort(-free, kind="stable")[: min(bins, max(bins - bound + 1, int(np.ceil(LOOSEST * bins))))]
            pooled = np.isin(bin_, loose[free[loose] > 0])
        n = len(size)
        return pa.table([table["doc_id"], table["piece"], table["start"], table["tokens"], table["block"], pa.array(bin_), pa.array(np.full(n, bins)), pa.array(np.full(n, bound)), pa.array(pooled)], _NAMES)

    return run


def _blocked(items: DataFrame, n: int, round_: int) -> DataFrame:
    blocks = max(1, -(-n // BLOCK_ITEMS))
    return items.select("doc_id", "piece", "start", "tokens", F.pmod(F.xxhash64("doc_id", "piece", "start", F.lit(round_)), F.lit(blocks)).alias("block"))


def packed(sizes: DataFrame, capacity: int = 2048, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, piece, start, tokens, container, certified): where every item, or piece of one, lies.

    ``sizes`` holds (doc_id, n_tokens).  An item above the capacity is cut into full pieces, each a
    container of its own, and a remainder that is packed like an item; others stay whole.  Items of
    size 0 or null take no room and lie in some container of their block.  Items of one id are told
    apart only if their sizes differ; equal ones stay separate rows.  An empty input gives no rows.
    ``certified`` says that the block a container was packed in had as many containers as its lower
    bound; a full piece always is.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    n = F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("bigint")
    whole = (n / capacity).cast("bigint")
    rest = F.when((n % capacity > 0) | (n == 0), F.array(F.struct(whole.cast("int").alias("piece"), (whole * capacity).alias("start"), (n % capacity).alias("tokens")))).otherwise(F.array().cast("array<struct<piece:int,start:bigint,tokens:bigint>>"))
    full = F.when(whole > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), whole - 1), lambda i: F.struct(i.cast("int").alias("piece"), (i * capacity).alias("start"), F.lit(capacity).cast("bigint").alias("tokens")))).otherwise(F.array().cast("array<struct<piece:int,start:bigint,tokens:bigint>>"))
    cut = checkpointed(sizes.select("doc_id", F.explode(F.concat(full, rest)).alias("p")).select("doc_id", "p.*"))
    key = ["doc_id", "piece", "start", "tokens"]
    done = cut.where(F.col("tokens") == capacity).select(*key, F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("container"), F.lit(True).alias("certified"))
    items = cut.where(F.col("tokens") < capacity)
    left = items.count()
    for r in range(rounds):
        if not left:
            break
        last = r == rounds - 1
        out = checkpointed(_blocked(items, left, r).groupBy("block").applyInArrow(_pack(capacity, last), _PACKED))
        name = F.concat(F.lit(f"{r}-"), F.col("block"), F.lit("-"), F.col("bin"))
        done = done.unionByName(out.where("NOT pooled").select(*key, name.alias("container"), (F.col("bins") == F.col("bound")).alias("certified")))
        items = out.where("pooled").select(*key)
        left = items.count()
    return done


def fill(packing: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, their lower bound by volume, tokens, and the share of free space."""
    one = packing.groupBy("container").agg(F.sum("tokens").alias("used"))
    total = one.agg(F.count("*").alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.max("used").alias("fullest"))
    return total.select("containers", F.ceil(F.col("tokens") / capacity).alias("bound"), "tokens", "fullest", F.when(F.col("containers") > 0, 1 - F.col("tokens") / (F.col("containers") * capacity)).alias("free_share"))
