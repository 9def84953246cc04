"""What the training-data operators share: tables, the shared folder, packing of arrays into rows."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import import_here


#: Estimates beyond this are no estimates.
UNKNOWN_BYTES = 1 << 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder (tests); on a cluster, whose
    executors could not all reach such a folder, this raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='emberlog-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written as Parquet in the shared folder and read again: a cut in the lineage that
    outlives executors. The files go when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def parts_for(df: DataFrame, bytes_each: int, projected: bool = False) -> int:
    """Partitions of about ``bytes_each`` of the files that are scanned (with ``projected``, of the plan's
    estimate for its columns), at least the session's shuffle partitions: grows in proportion to the
    input. Where the plan has no estimate (rows that aren't read from files), the texts' bytes are summed."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    sizes = [plan] if projected else [leaves.apply(i) for i in range(leaves.size())]
    size = sum(int(str(x.stats().sizeInBytes())) for x in sizes)
    if size > UNKNOWN_BYTES:
        texts = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema if f.dataType.simpleString() in ("string", "binary")]
        size = df.agg(F.sum(sum(texts, F.lit(8))).alias("n")).first().n or 0
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(size / bytes_each))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, by position of their first occurrence, so that further columns whose
    names clash (or differ in case only) don't matter."""
    import_here(df.sparkSession)
    at = [next(i for i, c in enumerate(df.columns) if c == n) for n in names]
    plain = df.toDF(*(f"_c{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"_c{i}").alias(n) for i, n in zip(at, names)))


def documents_like(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text", "lang", "source", "n_chars")


# -- packed exchanges: numpy arrays as binary columns, one row per destination -----------------


def group_bounds(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array, and their first positions with the length appended."""
    if not len(sorted_keys):
        return sorted_keys, np.zeros(1, np.int64)
    begin = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    return sorted_keys[begin], np.append(begin, len(sorted_keys))


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Cuts of ``values`` at ``bounds`` as a binary array, without copying per row."""
    values = np.ascontiguousarray(values)
    offsets = (np.asarray(bounds) * values.itemsize).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)]
    ).cast(pa.binary())


def _restarted(steps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Running sums of ``steps`` that begin anew in each cut of ``counts`` values."""
    if not len(steps):
        return steps
    total = np.cumsum(steps)
    begin = (np.cumsum(counts) - counts)[counts > 0]
    return total - np.repeat(total[begin] - steps[begin], counts[counts > 0])


def encode_ascending(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Each cut of ``values`` (ascending non-negative integers) as its differences, seven bits a byte:
    what a value costs depends on its distance to the one before, not on how far the cut reaches."""
    if not len(values):
        return pa.array([b""] * (len(bounds) - 1), pa.binary())
    step = np.diff(values, prepend=values.dtype.type(0))
    begin = bounds[:-1][bounds[:-1] < bounds[1:]]
    step[begin] = values[begin]
    most, size = int(step.max()), np.ones(len(step), np.uint8)
    for k in range(1, 9):
        if most >> 7 * k == 0:
            break
        size += step >= 1 << 7 * k
    stop = np.cumsum(size, dtype=np.int64)
    out = np.zeros(stop[-1], np.uint8)
    out[stop - size] = step & 127 | np.where(size > 1, 128, 0)
    for k in range(1, int(size.max())):
        some = np.flatnonzero(size > k)
        out[stop[some] - size[some] + k] = step[some] >> 7 * k & 127 | np.where(size[some] > k + 1, 128, 0)
    return binaries(out, np.concatenate(([0], stop))[bounds])


def decode_ascending(cuts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The values of all cuts, and how many each has."""
    raw = np.frombuffer(b"".join(cuts), np.uint8)
    last = np.flatnonzero(raw < 128)
    counts = np.diff(np.searchsorted(last, np.cumsum([0, *map(len, cuts)])))
    first = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
    size = last - first + 1
    step = np.zeros(len(last), np.int64)
    for k in range(int(size.max(initial=0))):
        some = np.flatnonzero(size > k)
        step[some] |= (raw[first[some] + k] & 127).astype(np.int64) << 7 * k
    return _restarted(step, counts), counts


def joined(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    """All binaries of a column as one array."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x is not None), kind)
