"""Vectors: cosine distance, hashed n-gram embedding, exact nearest neighbours."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIMENSIONS = 256
_TOKEN = re.compile(r"[^\W_]+")


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine; null if either vector is all zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, 1 - dot(a, b) / size)


def embedded_text(title: str = "title", body: str = "body", links: str = "links") -> Column:
    """The text that is embedded: title, body and links, a line each; nulls are skipped."""
    return F.concat_ws("\n", title, body, links)


def embed(text: str, dimensions: int = DIMENSIONS) -> np.ndarray | None:
    """Unit vector of damped, signed, hashed words and pairs of neighbouring words in a line; None without words."""
    counts: dict[str, int] = {}
    for line in text.split("\n"):
        words = _TOKEN.findall(line.lower())
        for feature in (*words, *("\x1f".join(p) for p in zip(words, words[1:]))):
            counts[feature] = counts.get(feature, 0) + 1
    out = np.zeros(dimensions)
    for feature, n in counts.items():
        h = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "big")
        out[h % dimensions] += (-1 if h >> 63 else 1) * (1 + np.log(n))
    size = np.linalg.norm(out)
    return (out / size).astype(np.float32) if size else None


def _embed_each(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else embed(t) for t in text], dtype=object)


def embedding(text: Column | str) -> Column:
    """Embedding of every text; null for a null text or one without words."""
    return F.pandas_udf(_embed_each, "array<float>")(text)


#: Rows of a block of a group that meets the group's other blocks.
BLOCK_ROWS = 1000


def cross_group_nearest(vectors: DataFrame, within: str, group: str, key: str = "post_id", vector: str = "embedding") -> DataFrame:
    """(within, key, nearest, distance): the closest row of another group among those that share ``within``; ties to the smallest key.

    A large ``within`` is dealt into blocks, and every pair of blocks is one matrix product, so a
    task holds two blocks however large the whole is.  All-zero vectors and null groups have no
    neighbours.
    """
    rows = vectors.where(F.col(group).isNotNull() & F.exists(vector, lambda x: x != 0)).select(F.col(within).alias("w"), F.col(key).alias("k"), F.col(group).alias("g"), F.col(vector).cast("array<double>").alias("v"))
    size = rows.groupBy("w").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("n"))
    dealt = rows.join(size, "w").withColumn("own", F.pmod(F.xxhash64("k"), F.col("n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    left = dealt.select("w", "k", "g", "v", F.col("own").alias("i"), every.alias("j"))
    right = dealt.select("w", "k", "g", "v", every.alias("i"), F.col("own").alias("j"))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if a.num_rows and b.num_rows:
            b = b.sort_by("k")
            x, y = (_unit(np.stack(t["v"].to_numpy())) for t in (a, b))
            codes = {g: i for i, g in enumerate(sorted({*a["g"].to_pylist(), *b["g"].to_pylist()}))}
            ga, gb = (np.array([codes[g] for g in t["g"].to_pylist()]) for t in (a, b))
            d = np.where(ga[:, None] == gb[None, :], np.inf, 1 - x @ y.T)
            near = np.round(d, 12).argmin(1)
            names, keys, w = b["k"].to_pylist(), a["k"].to_pylist(), a["w"][0].as_py()
            out = [(w, keys[i], float(d[i, j]), names[j]) for i, j in enumerate(near) if np.isfinite(d[i, j])]
        return pa.table([pa.array(list(c), t) for c, t in zip(list(zip(*out)) or [()] * 4, (a.schema.field("w").type, a.schema.field("k").type, pa.float64(), a.schema.field("k").type))], ["w", "k", "d", "k2"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("w", "k")]
    again = right.toDF("w2", "k", "g", "v", "i2", "j2")
    met = left.groupBy("w", "i", "j").cogroup(again.groupBy("w2", "i2", "j2"))
    pairs = met.applyInArrow(best, f"w {kinds[0]}, k {kinds[1]}, d double, k2 {kinds[1]}")
    chosen = pairs.groupBy("w", "k").agg(F.min(F.struct("d", "k2")).alias("best"))
    return chosen.select(F.col("w").alias(within), F.col("k").alias(key), F.col("best.k2").alias("nearest"), F.col("best.d").alias("distance"))


def nearest_of(queries: DataFrame, vectors: DataFrame, k: int, key: str, vector: str = "embedding") -> DataFrame:
    """(key, nearest, distance, rank): the exact k nearest other rows of a bounded set of queries, by one pass over all rows.

    Queries are checked to be few (10,000 at most) and sent to all tasks; each partition of the rows
    keeps its k best for each query, and only those are ranked together.
    """
    few = queries.select(key, vector).limit(10_001).toPandas()
    if len(few) > 10_000:
        raise ValueError("queries of nearest_of are sent to every task; use an index for more than 10,000")
    spark = queries.sparkSession
    ids = few[key].tolist()
    unit = _unit(np.stack(few[vector].values)) if len(few) else np.zeros((0, 1))
    shared = spark.sparkContext.broadcast((ids, unit))
    kind = queries.schema[key].dataType.simpleString()

    def best(batches):
        own, q = shared.value
        held: list[list] = [[] for _ in own]
        for pdf in batches:
            if not len(pdf) or not len(own):
                continue
            x = _unit(np.stack(pdf[vector].values))
            d = 1 - q @ x.T
            names = pdf[key].values
            take = min(k + 1, len(names))
            near = np.argpartition(d, take - 1, axis=1)[:, :take]
            for i in range(len(own)):
                edge = d[i, near[i]].max()
                for j in np.flatnonzero(d[i] <= edge):
                    held[i].append((d[i, j], names[j]))
                held[i] = sorted(x for x in held[i] if x[1] != own[i])[:k]
        rows = [(own[i], n, float(d)) for i, x in enumerate(held) for d, n in x]
        yield pd.DataFrame(rows, columns=[key, "nearest", "distance"])

    partial = vectors.select(key, vector).mapInPandas(best, f"{key} {kind}, nearest {kind}, distance double")
    ranked = partial.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.round("distance", 9), "nearest")))
    return ranked.where(F.col("rank") <= k)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)
