"""Logistic regression by batch gradient descent, one fold left out at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import word_count
from sievework.operators.ranges import numbered
from sievework.partitioning import checkpointed, labels, shuffle_width

STEPS, RATE, PENALTY = 400, 0.5, 0.01
FEATURES = ("title_words", "body_words", "links", "registrable_domains", "unresolved_links", "contact_points", "words_with_digits")


def features(posts: DataFrame, post_domains: DataFrame, contacts: DataFrame) -> DataFrame:
    """(post_id, account, the seven counts); what a post lacks counts 0."""
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    links = post_domains.dropDuplicates(["post_id"]).select("post_id", n("domains").alias("registrable_domains"), n(F.filter("links", lambda x: x["unresolved"].isNotNull())).alias("unresolved_links"))
    points = contacts.dropDuplicates(["post_id"]).select("post_id", n(F.array_distinct("contact_points")).alias("contact_points"))
    text = F.concat_ws(" ", "title", "body")
    digits = F.size(F.filter(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), 1), lambda w: w.rlike(r"\p{Nd}")))
    own = posts.select("post_id", "account", word_count("title").alias("title_words"), word_count("body").alias("body_words"), n("links").alias("links"), digits.alias("words_with_digits"))
    rows = own.join(links, "post_id", "left").join(points, "post_id", "left")
    return rows.select("post_id", "account", *(F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in FEATURES))


def folds(accounts: DataFrame, truth: DataFrame) -> DataFrame:
    """(account, fold, label): planted accounts take their group's place, the others are dealt by name.

    ``truth`` holds (account, place) with places from 0.  The k-th other account by name goes to
    fold k mod n.  Names are numbered by range partitions, not in one task.
    """
    n = truth.agg((F.max("place") + 1).alias("n")).first().n
    if not n:
        raise ValueError("no planted group, hence no folds")
    others = accounts.select("account").distinct().where("account IS NOT NULL").join(truth, "account", "left_anti")
    dealt = numbered(others, [F.asc("account")], "k").select("account", ((F.col("k") - 1) % n).cast("int").alias("fold"), F.lit(False).alias("label"))
    return truth.select("account", F.col("place").cast("int").alias("fold"), F.lit(True).alias("label")).unionByName(dealt)


def standardised(rows: DataFrame, columns: tuple[str, ...], by: str) -> DataFrame:
    """(by, then mean_c and scale_c for each column): population figures; no spread gives scale 1."""
    spread = lambda c: F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0)
    return rows.groupBy(by).agg(*(x for c in columns for x in (F.avg(c).alias(f"mean_{c}"), spread(c).alias(f"scale_{c}"))))


def train(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """(weights, bias, means, scales) after a fixed number of full steps from zero; row i counts n[i] times."""
    if len(set(y.tolist())) < 2:
        raise ValueError("both classes are needed")
    share = n / n.sum()
    mean = share @ x
    scale = np.sqrt(share @ (x - mean) ** 2)
    scale = np.where(scale > 0, scale, 1.0)
    z, w, b = (x - mean) / scale, np.zeros(x.shape[1]), 0.0
    for _ in range(STEPS):
        error = (1 / (1 + np.exp(-(z @ w + b))) - y) * share
        w, b = w - RATE * (z.T @ error + PENALTY * w), b - RATE * error.sum()
    return w, b, mean, scale


def sigmoid(t: Column) -> Column:
    """The logistic function without overflow on either side."""
    return F.when(t >= 0, 1 / (1 + F.exp(-t))).otherwise(F.exp(t) / (1 + F.exp(t)))


def train_held(x: np.ndarray, y: np.ndarray, n: np.ndarray, fold: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(weights, biases, means, scales), a row for each held fold: what ``train`` gives on the rows of all other folds.

    The fits take their steps together: a fit's sums run over the patterns of all rows, each
    counted without its rows in the held fold.
    """
    k = x.shape[1]
    held = np.sort(held)
    pattern, inverse = np.unique(np.column_stack([x, y]), axis=0, return_inverse=True)
    inverse = inverse.ravel()
    total = np.bincount(inverse, n, len(pattern))
    x, y = pattern[:, :k], pattern[:, k]
    at = np.minimum(np.searchsorted(held, fold), len(held) - 1)
    mine = np.flatnonzero(held[at] == fold)
    mine = mine[np.argsort(at[mine], kind="stable")]
    first = np.searchsorted(at[mine], np.arange(len(held) + 1))
    mean, scale, size = np.empty((len(held), k)), np.empty((len(held), k)), np.empty(len(held))
    for i in range(len(held)):
        own = mine[first[i] : first[i + 1]]
        rest = total.copy()
        np.subtract.at(rest, inverse[own], n[own])
        if len(np.unique(y[rest > 0])) < 2:
            raise ValueError("both classes are needed")
        size[i] = rest.sum()
        mean[i] = rest @ x / size[i]
        scale[i] = np.sqrt(rest @ (x - mean[i]) ** 2 / size[i])
    scale = np.where(scale > 0, scale, 1.0)
    # a pattern's share that stays when a fold is held out, where that isn't all
    row, col = np.divmod(np.unique(inverse[mine] * len(held) + at[mine]), len(held))
    out = np.zeros(len(row))
    np.add.at(out, np.searchsorted(row * len(held) + col, inverse[mine] * len(held) + at[mine]), n[mine])
    stays = 1 - out / total[row]
    # sums around the middle of all rows keep their digits
    middle = total @ x / total.sum()
    z = np.column_stack([x - middle, np.ones(len(x))])
    step = max(64, 65_536 // len(held))
    cuts = [(i, min(i + step, len(z)), *np.searchsorted(row, (i, i + step))) for i in range(0, len(z), step)]
    shift = mean - middle
    w, b = np.zeros((len(held), k)), np.zeros(len(held))
    for _ in range(STEPS):
        slope = w / scale
        line = np.column_stack([slope, b - (slope * shift).sum(1)]).T
        g = np.zeros((k + 1, len(held)))
        for i, j, f, t in cuts:
            error = z[i:j] @ -line
            with np.errstate(over="ignore"):
                np.exp(error, out=error)
            error += 1
            np.reciprocal(error, out=error)
            error -= y[i:j, None]
            error *= total[i:j, None]
            error[row[f:t] - i, col[f:t]] *= stays[f:t]
            g += z[i:j].T @ error
        g /= size
        w, b = w - RATE * ((g[:k].T - shift * g[k][:, None]) / scale + PENALTY * w), b - RATE * g[k]
    return w, b, mean, scale


def fit_folds(rows: DataFrame, columns: tuple[str, ...] = FEATURES, local_rows: int = 2_000_000) -> DataFrame:
    """(held, bias, weights, means, scales): one fit for each fold on the rows of the others.

    Rows with equal features and label train alike, so they are counted first.  While that leaves at
    most ``local_rows`` rows, each task has all of them and fits its share of the folds; beyond it
    every step sums the gradients of all folds over the partitions, which gives the same fit.
    """
    counted = checkpointed(rows.groupBy("fold", "label", *columns).agg(F.count("*").alias("rows")))
    if counted.count() > local_rows:
        return _fit_distributed(counted, columns)
    spark = counted.sparkSession
    marks = labels(shuffle_width(spark))
    names = ["fold", "label", "rows", *columns]

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([np.stack([c.cast(pa.float64()).to_numpy() for c in batch.columns]).tobytes()], pa.binary())], ["packed"])

    def fit(table: pa.Table) -> pa.Table:
        data = np.concatenate([np.frombuffer(p, np.float64).reshape(len(names), -1) for p in table["packed"].to_pylist()], 1)
        fold = data[0].astype(np.int64)
        part = marks.index(table["part"][0].as_py())
        held = np.unique(fold)[part :: len(marks)]
        if not len(held):
            return pa.table([pa.array([], t) for t in _KINDS], _NAMES)
        w, b, mean, scale = train_held(np.ascontiguousarray(data[3:].T), data[1], data[2], fold, held)
        return pa.table([pa.array(list(v), t) for v, t in zip((held, b, w, mean, scale), _KINDS)], _NAMES)

    packed = counted.select("fold", F.col("label").cast("int").alias("label"), "rows", *columns).mapInArrow(pack, "packed binary")
    parts = packed.select(F.explode(F.array(*map(F.lit, marks))).alias("part"), "packed")
    return parts.repartition(len(marks), "part").groupBy("part").applyInArrow(fit, _FIT)


_KINDS = (pa.int32(), pa.float64(), *[pa.list_(pa.float64())] * 3)
_NAMES = ["held", "bias", "weights", "means", "scales"]
_FIT = "held int, bias double, weights array<double>, means array<double>, scales array<double>"


def _fit_distributed(counted: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    spark, k = counted.sparkSession, len(columns)
    n = F.col("rows")
    own = counted.groupBy("fold").agg(F.sum("rows").alias("n"), *(F.sum(n * F.col(c)).alias(f"s{i}") for i, c in enumerate(columns)), *(F.sum(n * F.col(c) * F.col(c)).alias(f"q{i}") for i, c in enumerate(columns))).toPandas()
    names = own["fold"].to_numpy()
    rest = lambda c: own[c].sum() - own[c].to_numpy(np.float64)
    size = rest("n")
    mean = np.stack([rest(f"s{i}") / size for i in range(k)], 1)
    scale = np.sqrt(np.maximum(np.stack([rest(f"q{i}") / size for i in range(k)], 1) - mean**2, 0))
    scale = np.where(scale > 0, scale, 1.0)
    w, b = np.zeros((len(names), k)), np.zeros(len(names))
    for _ in range(STEPS):

        def gradients(batches, w=w, b=b):
            total = np.zeros((len(names), k + 1))
            for pdf in batches:
                x, y, m, fold = pdf[list(columns)].to_numpy(np.float64), pdf["label"].to_numpy(np.float64), pdf["rows"].to_numpy(np.float64), pdf["fold"].to_numpy()
                for i, name in enumerate(names):
                    z = (x - mean[i]) / scale[i]
                    error = (1 / (1 + np.exp(-(z @ w[i] + b[i]))) - y) * m * (fold != name)
                    total[i, :k] += z.T @ error
                    total[i, k] += error.sum()
            yield pd.DataFrame({"i": range(len(names)), "g": list(total)})

        parts = counted.mapInPandas(gradients, "i int, g array<double>").collect()
        total = np.zeros((len(names), k + 1))
        for r in parts:
            total[r.i] += r.g
        total /= size[:, None]
        w, b = w - RATE * (total[:, :k] + PENALTY * w), b - RATE * total[:, k]
    return spark.createDataFrame([(int(f), float(b[i]), w[i].tolist(), mean[i].tolist(), scale[i].tolist()) for i, f in enumerate(names)], _FIT)


def confidences(rows: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """(post_id, account, label, fold, confidence): every row scored by the fit that hasn't seen its fold."""
    fits = fit_folds(rows, columns)
    z = F.col("bias")
    for i, c in enumerate(columns):
        z = z + F.col("weights")[i] * (F.col(c) - F.col("means")[i]) / F.col("scales")[i]
    scored = rows.join(fits.withColumnRenamed("held", "fold"), "fold")
    return scored.select("post_id", "account", "label", "fold", F.round(sigmoid(z), 12).alias("confidence"))
