"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import math
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``, as a Java class.
SPACE = r"[\x20\x09-\x0D]"

_written: list[tuple[SparkSession, str]] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only on one machine, if none is set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lacunar-checkpoint-")
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again.

    This cuts lineage and survives lost executors: the rows then live in the
    shared store, not in an executor. The table goes when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lacunar-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return


#: A key of over one in so many rows is hot; by their rows, fewer keys than this can be.
SHARE = 1000


def meet(rows: DataFrame, groups: DataFrame, on: list[str], size: str) -> DataFrame:
    """The inner join of rows with groups: one row for each key that is wanted, with its number of rows as ``size``.

    Hot keys are broadcast, fewer than SHARE rows, so that their rows stay where
    they are read. The other keys are shuffled; none of them can fill a task.
    Both tables are read more than once, so they should be written ones.
    """
    limit = rows.count() / SHARE
    hot = groups.where(F.col(size) > limit)
    if hot.isEmpty():
        return rows.join(groups, on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(groups.where(F.col(size) <= limit), on)
    return rows.join(F.broadcast(hot), on).unionByName(rest)


def parts(df: DataFrame, per_part_mb: float = 16.0, least: int = 8) -> int:
    """A partition count in proportion to the files that df is read from.

    Where a source has no known size, the session's shuffle partitions.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    if not sizes or max(sizes) >= 1 << 60:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(sum(sizes) / (per_part_mb * 1e6)))


def _hash_int(x: np.ndarray) -> np.ndarray:
    """Spark's hash of an int column (32-bit Murmur3 with seed 42), by which it deals rows."""
    turn = lambda v, k: v << np.uint32(k) | v >> np.uint32(32 - k)
    v = turn(x.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = turn(np.uint32(42) ^ v, 13) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> np.uint32(shift)) * np.uint32(factor)
    return (h ^ h >> np.uint32(16)).astype(np.int32)


def labels(n: int) -> np.ndarray:
    """n int labels, of which repartition(n, label) deals each to a partition of its own."""
    out = np.full(n, -1, np.int32)
    start, step = 0, 4 * n + 64
    while (out < 0).any():
        x = np.arange(start, start + step, dtype=np.int32)
        out[_hash_int(x).astype(np.int64) % n] = x
        start += step
    return out


def _release() -> None:
    """Gives memory that is free inside a Python worker back to the machine."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Has the session hand at most so many rows at once to Python workers, where it would hand over more.

    Both the executor and its workers hold whole batches, of whole texts here.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def tidy(run: Callable) -> Callable:
    """The function of a mapInArrow that leaves its worker small.

    Workers live on between tasks and stages; what a task leaves in their pools
    would add to the memory that the next stage needs.
    """

    def over(batches):
        try:
            yield from run(batches)
        finally:
            _release()

    return over


def tidy_group(run: Callable) -> Callable:
    """As tidy, for the function of one group."""

    def over(t):
        try:
            return run(t)
        finally:
            _release()

    return over


def tidy_pair(run: Callable) -> Callable:
    """As tidy, for the function of two groups of one key."""

    def over(t, d):
        try:
            return run(t, d)
        finally:
            _release()

    return over


def chunked(texts: Iterable[bytes], limit: int) -> Iterator[list[bytes]]:
    """Lists of some texts of about so many bytes, whole texts each."""
    part: list[bytes] = []
    size = 0
    for t in texts:
        if part and size + len(t) > limit:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def crc_mod(doc_id: str | Column, k: int) -> Column:
    """crc32 of the id's decimal text, modulo k (null id: the empty text's)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % k


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """A uniform number in [0, 1) that depends on the values and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") * F.lit(2.0**-53)
