"""Where rows go: shuffle width, labels that fill every partition, and checkpoint folders."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shuffle_width(spark: SparkSession) -> int:
    """The session's shuffle partitions: the one knob that an operator's task sizes follow."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bytes of a plan's input for which a group of its own is made, for small inputs and at most.
_GROUP_BYTES = (2 << 20, 64 << 20)


def planned_bytes(df: DataFrame) -> int | None:
    """The optimizer's estimate of the plan's size, from file sizes and column widths; None where it knows none."""
    found = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return found if found < 1 << 60 else None


def spread(df: DataFrame) -> int:
    """How many groups the rows of ``df`` are dealt to when each group is held by one task.

    At least the shuffle width, and more where the input's bytes ask for it: a group has 2 MB of the
    input, growing with the root of the input's size to 64 MB (from about 128 GB on).  So a task's
    memory is bounded whatever the session's width is, while groups exchange few messages.
    """
    size = planned_bytes(df) or 0
    least, most = _GROUP_BYTES
    one = min(most, max(least, int(least * (size / (128 << 20)) ** 0.5)))
    return max(shuffle_width(df.sparkSession), -(-size // one))


def _rotl(x: int, r: int) -> int:
    return (x << r | x >> (32 - r)) & 0xFFFFFFFF


def _spark_hash_int(x: int) -> int:
    """Spark's ``hash`` of one int column: 32-bit MurmurHash3 with seed 42, as a signed number."""
    k = _rotl(x * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
    h = (_rotl(42 ^ k, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= 4
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * by & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def labels(parts: int) -> Sequence[int]:
    """``parts`` ints of which ``repartition(parts, label)`` sends one into each partition.

    Plain numbers 0..n-1 would leave a third of the partitions empty and overfill others.  With
    thousands of them that evens out over the tasks, and the numbers themselves are taken.
    """
    if parts > 4096:
        return range(parts)
    found: dict[int, int] = {}
    x = 0
    while len(found) < parts:
        found.setdefault(_spark_hash_int(x) % parts, x)
        x += 1
    return [found[i] for i in range(parts)]


def label_of(number: Column, marks: Sequence[int]) -> Column:
    """The label of a group number from 0 on."""
    if isinstance(marks, range):
        return number.cast("int")
    return F.element_at(F.array(*map(F.lit, marks)), (number + 1).cast("int"))


_written: list[tuple[SparkSession, str]] = []
_registered: list = []


def _checkpoint_dir(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        # unset only in local mode, as in tests: one folder for each application
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors and the driver share")
        own = [path for s, path in _written if s.sparkContext.applicationId == spark.sparkContext.applicationId]
        at = own[0].rsplit("/", 1)[0] if own else "file://" + tempfile.mkdtemp(prefix="sievework-checkpoint-")
    return at


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder in ``spark.checkpoint.dir``, so that its lineage ends there.

    A table, rather than ``checkpoint()``, also ends what the optimizer carries along: orderings and
    partitionings of earlier steps otherwise pile up over an iteration until planning takes longer
    than running.  The tables are removed when the driver's Python exits, or by ``release``.
    """
    spark = df.sparkSession
    path = f"{_checkpoint_dir(spark)}/sievework-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _registered:
        _registered.append(atexit.register(_remove_written))
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def release(df: DataFrame) -> None:
    """Remove a table of ``checkpointed`` that nothing reads any more, such as an earlier step of an iteration."""
    path = getattr(df, "_written_at", None)
    for i, (spark, known) in enumerate(_written):
        if known == path:
            _delete(spark, path)
            del _written[i]
            return


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _remove_written() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone by now
            return
