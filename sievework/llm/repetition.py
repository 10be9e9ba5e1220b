"""p8: repetition inside a single document.

A word is repeated if it lies in a run of ``RUN`` consecutive words that also begins at an earlier
word of the same text.  ``shares`` measures that for every document.  ``cases`` finds the documents
with a large share through an isolation forest over rule statistics that look at a text's bytes
only: how far it can be compressed, how far below what its length lets expect, and its length.  The
forest is grown on the ordinary documents of a bounded labelled sample; short mean paths over its
random splits mark anomalies, by a threshold calibrated on the sample's labelled cases.  Only the
anomalies are split into words and measured exactly; a text beyond the compressor's window is
always one.  ``anomalies`` gives every document's path, and ``quality`` what the paths alone are worth.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import kernels as K

RUN = 8
#: Documents of the labelled sample, about: those whose hashed id falls under a cut.
SAMPLE = 6_000
TREES = 100
TREE_ROWS = 256
#: The threshold lies above the longest path of the sample's cases by this share of the distance to the longest path of all.
MARGIN = 0.1
#: Bytes over which the compressor finds repeats; longer texts are measured in any case.
WINDOW = 60_000
_FEATURES = 3
_CODEC = "lz4_raw"


def _first_seen(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each value is the first of its kind in its text."""
    doc = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
    mixed = K.mix(h + doc * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(mixed, kind="stable")
    v = mixed[order]
    out = np.empty(len(h), np.bool_)
    out[order] = np.append(True, v[1:] != v[:-1]) if len(v) else True
    return out


def _per_text(flag: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def repeated_words(h: np.ndarray, at: np.ndarray, run: int = RUN) -> np.ndarray:
    """Repeated words of every text, from its words' hashes."""
    runs, to = K.runs_of(h, at, run)
    again = ~_first_seen(runs, to)
    start = np.flatnonzero(again)
    doc = np.searchsorted(to, start, side="right") - 1
    place = start - to[doc] + at[doc]
    mark = np.zeros(len(h) + 1, np.int32)
    mark[place] += 1  # places are distinct, and so are the ends
    mark[place + run] -= 1
    return _per_text(np.cumsum(mark[:-1]) > 0, at)


def statistics(texts: list[str]) -> np.ndarray:
    """Rule statistics of every text: size compressed to size, both in bytes of the lower-cased text, and the logarithm of the size."""
    codec = pa.Codec(_CODEC)
    plain = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    size = np.maximum(1, np.fromiter(map(len, plain), np.float64, len(plain)))
    packed = np.fromiter((len(codec.compress(x, asbytes=True)) if x else 1 for x in plain), np.float64, len(plain))
    return np.column_stack([packed / size, np.log2(size)])


def usual_ratio(rows: np.ndarray) -> np.ndarray:
    """Median compression of texts by half powers of two of their size, the nearest known one where there is none."""
    place = np.minimum((2 * rows[:, 1]).astype(np.int64), 63)
    out = np.full(64, np.nan)
    for p in np.unique(place):
        out[p] = np.median(rows[place == p, 0])
    known = np.flatnonzero(~np.isnan(out))
    return np.interp(np.arange(64), known, out[known]) if len(known) else np.ones(64)


def features(rows: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """What the forest sees: compression, compression against the usual one of the size, size."""
    return np.column_stack([rows[:, 0], rows[:, 0] / usual[np.minimum((2 * rows[:, 1]).astype(np.int64), 63)], rows[:, 1]])


def grow(rows: np.ndarray, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An isolation forest as arrays (trees x nodes): feature or -1, split value, path length of a leaf.

    Nodes are numbered as in a heap; a leaf's length adds what its rows would need to be told apart.
    """
    rng = np.random.default_rng(seed)
    size = min(TREE_ROWS, len(rows))
    depth = max(1, int(np.ceil(np.log2(max(2, size)))))
    nodes = 2 ** (depth + 1) - 1
    feature, value, length = np.full((TREES, nodes), -1, np.int64), np.zeros((TREES, nodes)), np.zeros((TREES, nodes))
    for t in range(TREES):
        todo = [(0, 0, rows[rng.choice(len(rows), size, replace=False)])]
        while todo:
            node, level, own = todo.pop()
            spread = np.flatnonzero(own.max(0) > own.min(0)) if len(own) else []
            if level == depth or not len(spread):
                length[t, node] = level + _rest(len(own))
                continue
            f = int(rng.choice(spread))
            cut = rng.uniform(own[:, f].min(), own[:, f].max())
            feature[t, node], value[t, node] = f, cut
            left = own[:, f] < cut
            todo += [(2 * node + 1, level + 1, own[left]), (2 * node + 2, level + 1, own[~left])]
    return feature, value, length


def _rest(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def paths(forest: tuple[np.ndarray, np.ndarray, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Mean path length of every row; short ones are anomalies."""
    feature, value, length = forest
    total = np.zeros(len(rows))
    every = np.arange(len(rows))
    for f, v, n in zip(feature, value, length):
        node = np.zeros(len(rows), np.int64)
        while True:
            inner = f[node] >= 0
            if not inner.any():
                break
            right = rows[every, np.maximum(f[node], 0)] >= v[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        total += n[node]
    return total / len(feature)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in batch.column(1).to_pylist()]


def _measure(run: int):
    def f(batches):
        for batch in batches:
            texts = _texts(batch)
            words, again = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for a, b in K.blocks(texts):
                h, at = K.words(texts[a:b])
                words[a:b], again[a:b] = np.diff(at), repeated_words(h, at, run)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(again)], ["doc_id", "words", "repeated"])

    return f


def _pair(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def shares(documents: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, words, repeated, share) of every document; one without words has share 0, null texts count as empty."""
    out = _pair(documents).mapInArrow(_measure(run), "doc_id bigint, words bigint, repeated bigint")
    return out.withColumn("share", F.when(F.col("words") > 0, F.col("repeated") / F.col("words")).otherwise(0.0))


def _planted(text: str, least: float, run: int) -> str | None:
    """The text with about the smallest repetition that makes it a case, in its least visible form: short runs of the first half strewn over the second."""
    words = text.split()
    half = len(words) // 2
    times = int(np.ceil(least / (1 - least) * len(words) / run)) + 1
    if half < run:
        return None
    begin = np.linspace(0, half - run, times).astype(int)
    place = np.linspace(half, len(words), times + 1).astype(int)
    out = words[:half]
    for at, a, b in zip(begin, place, place[1:]):
        out += words[a:b] + words[at : at + run]
    return " ".join(out)


def fit(documents: DataFrame, least: float, run: int = RUN, labelled: DataFrame | None = None) -> tuple[tuple, np.ndarray, float]:
    """A forest, the usual compression by size, and the longest path that may be a case.

    They come from a bounded sample of labelled rows.  ``labelled`` (doc_id, is_case) names them;
    without it a sample of the documents is labelled by the rule.  Each of the sample's ordinary texts
    also gives a planted case with the smallest share that counts, so the threshold never rests on
    what cases the sample happens to hold.
    """
    n = documents.count()
    cut = max(1, int((1 << 30) * min(1.0, SAMPLE / max(1, n))))
    sample = _pair(documents).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < cut)
    known, by_rule = F.lit(None).cast("boolean"), labelled is None
    if labelled is not None:
        sample = sample.join(labelled.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("is_case").cast("boolean").alias("known")), "doc_id")
        known = F.col("known")

    def label(batches):
        for batch in batches:
            texts = _texts(batch)
            for a, b in K.blocks(texts):
                own = texts[a:b]
                case = np.array([bool(x) for x in batch.column(2).slice(a, b - a).to_pylist()])
                if by_rule:
                    h, at = K.words(own)
                    case = repeated_words(h, at, run) >= least * np.maximum(np.diff(at), 1) - 1e-9
                made = [p for t, c in zip(own, case) if not c and (p := _planted(t, least, run))]
                h, at = K.words(made)
                made = [p for p, c in zip(made, repeated_words(h, at, run) >= least * np.diff(at)) if c]
                rows = np.column_stack([np.append(case, np.full(len(made), 2)), np.concatenate([statistics(own), statistics(made)])])
                yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.float64).tolist(), pa.list_(pa.float64()))], ["row"])

    rows = np.array([r.row for r in sample.select("doc_id", "text", known.alias("known")).mapInArrow(label, "row array<double>").collect()]).reshape(-1, 3)
    rows = rows[rows[:, 2] <= np.log2(WINDOW)]
    kind, rows = rows[:, 0], rows[:, 1:]
    plain, case = rows[kind == 0], rows[kind > 0]
    if not len(plain):
        # nothing ordinary to tell cases from: no path is too long
        return grow(np.zeros((1, _FEATURES))), np.ones(64), np.inf
    usual = usual_ratio(plain)
    plain, case = features(plain, usual), features(case, usual)
    forest = grow(plain)
    longest = paths(forest, plain).max()
    reach = paths(forest, case).max() if len(case) else longest
    return forest, usual, float(reach + MARGIN * max(0.0, longest - reach))


def _path_lengths(texts: list[str], forest: tuple, usual: np.ndarray) -> np.ndarray:
    """Mean path of every text; 0 for one beyond the window, as no statistic speaks for it."""
    rows = statistics(texts)
    return np.where(rows[:, 1] > np.log2(WINDOW), 0.0, paths(forest, features(rows, usual)))


def cases(documents: DataFrame, least: float = 0.3, run: int = RUN, labelled: DataFrame | None = None) -> DataFrame:
    """(doc_id) of the documents of whose words at least the given share is repeated.

    Null, empty and wordless texts are no cases.  The sample bounds what is fitted, not what is
    searched: every document gets its path, and every document up to the threshold is measured.
    """
    forest, usual, threshold = fit(documents, least, run, labelled)
    shared = documents.sparkSession.sparkContext.broadcast((forest, usual))

    def search(batches):
        for batch in batches:
            texts = _texts(batch)
            near = np.flatnonzero(_path_lengths(texts, *shared.value) <= threshold)
            hit = np.zeros(len(texts), np.bool_)
            few = [texts[i] for i in near]
            for a, b in K.blocks(few):
                h, at = K.words(few[a:b])
                size = np.diff(at)
                hit[near[a:b]] = (size >= run) & (repeated_words(h, at, run) >= least * size - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hit))], ["doc_id"])

    return _pair(documents).mapInArrow(search, "doc_id bigint")


def anomalies(documents: DataFrame, least: float = 0.3, run: int = RUN, labelled: DataFrame | None = None) -> DataFrame:
    """(doc_id, path, anomalous) of every document: its mean path length over the forest, and whether that is a case's.

    Null and empty texts count as texts of no bytes; a text beyond the window has path 0.
    """
    forest, usual, threshold = fit(documents, least, run, labelled)
    shared = documents.sparkSession.sparkContext.broadcast((forest, usual))

    def measure(batches):
        for batch in batches:
            path = _path_lengths(_texts(batch), *shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(path), pa.array(path <= threshold)], ["doc_id", "path", "anomalous"])

    return _pair(documents).mapInArrow(measure, "doc_id bigint, path double, anomalous boolean")


def quality(documents: DataFrame, least: float = 0.3, run: int = RUN) -> DataFrame:
    """One row (documents, cases, anomalous, hits, precision, recall): the paths alone against the exact shares of all documents."""
    exact = shares(documents, run).select("doc_id", ((F.col("words") > 0) & (F.col("share") >= least - 1e-9)).alias("is_case"))
    both = anomalies(documents, least, run).join(exact, "doc_id")
    count = lambda c: F.count(F.when(c, 1))
    hit = F.col("anomalous") & F.col("is_case")
    one = both.agg(F.count("*").alias("documents"), count(F.col("is_case")).alias("cases"), count(F.col("anomalous")).alias("anomalous"), count(hit).alias("hits"))
    share = lambda n: F.when(F.col(n) > 0, F.col("hits") / F.col(n)).otherwise(1.0)
    return one.select("*", share("anomalous").alias("precision"), share("cases").alias("recall"))
