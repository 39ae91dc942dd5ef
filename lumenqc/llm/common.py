"""What the training-data operators share: table loading and written intermediate tables."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


Kept = TypeVar("Kept")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, and in it one of this application.

    Where the session names none, a local master (tests) gets a temporary one; on a cluster that is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named}/lumenqc-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables and files of this application: to be called once results are written elsewhere."""
    discard(spark, shared_dir(spark))


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends here and a lost executor costs a re-read only."""
    path = path or new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_kept: dict[Hashable, object] = {}


def sole(key: Hashable, make: Callable[[], Kept]) -> Kept:
    """What ``make`` gives, kept in this Python process until another key is asked for: a worker that serves several operators
    holds the tables of one at a time."""
    if key not in _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc else keeps what was freed
            trim(0)
        _kept[key] = make()
    return _kept[key]


def nothing_kept() -> None:
    """Gives back what an operator before kept in this Python process: for those that keep nothing."""
    sole("nothing", dict)


def listed(texts: pa.Array) -> list[str]:
    """Texts without nulls as a list, several times faster than ``to_pylist``."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what is made of one stays small."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def let(value: Column, body) -> Column:
    """``body(value)`` with value evaluated once a row, also where the optimiser moves the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def is_small(df: DataFrame, rows: int = 500_000, size: int = 64 << 20) -> bool:
    """Whether ``df`` was counted to have so few rows, of so many bytes (as JSON) together, that it may be broadcast."""
    n = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("b")).first()
    return n.n <= rows and (n.b or 0) <= size


def joined(left: DataFrame, right: DataFrame, key: str, how: str = "left", rows: int = 500_000, shares: int = 10_000) -> DataFrame:
    """``left`` joined with ``right`` by ``key``, of which ``left`` may hold very common values.

    A small ``right`` is broadcast.  Else keys with over a ``shares``-th of the left rows, of which there are fewer than
    ``shares``, meet their right rows where they are, if those are small; all others are shuffled.
    """
    if is_small(right, rows):
        return left.join(F.broadcast(right), key, how)
    total = left.count()
    hot = written(left.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * shares > total).select(key), "hot-keys")
    common = right.join(F.broadcast(hot), key, "left_semi")
    if not is_small(common, rows):
        return left.join(right, key, how)
    here = left.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(common), key, how)
    return here.unionByName(left.join(F.broadcast(hot), key, "left_anti").join(right, key, how))


def without(docs: DataFrame, gone: DataFrame, key: str, rows: int = 2_000_000) -> DataFrame:
    """``docs`` without the rows whose ``key`` is in ``gone``; these keys are broadcast if they were counted to be few."""
    gone = written(gone.select(key).distinct(), "gone")
    return docs.join(F.broadcast(gone) if is_small(gone, rows) else gone, key, "left_anti")


def lots(texts: list[str | None], most: int = 2_000_000) -> Iterator[list[str | None]]:
    """``texts`` in order, in lists of about ``most`` characters, so that what is made of them stays small."""
    lot, size = [], 0
    for t in texts:
        lot.append(t)
        size += len(t or "")
        if size >= most:
            yield lot
            lot, size = [], 0
    if lot:
        yield lot
