"""What the operators of this subpackage share: tables, shared scratch space, numbers."""

from __future__ import annotations

import atexit
import ctypes
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longleaf.session import shared_dir

#: White space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of a batch between Spark and Python: whole texts are long, and a worker holds a few batches at once.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS, unless they are smaller already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    try:
        drop(spark, path)
    except Exception:  # the session may be gone; the folder is the cluster's to clear
        pass


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, []
        small_batches(spark)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/longleaf-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.kept.append((out, path))
        atexit.register(_drop_at_exit, self.spark, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables, which nothing reads any more."""
        for table in tables:
            for pair in [p for p in self.kept if p[0] is table]:
                drop(self.spark, pair[1])
                self.kept.remove(pair)


def sized(table: DataFrame, most: int) -> DataFrame:
    """A kept table as the other side of a join: broadcast up to so many rows; beyond, dealt by a shuffle of its own.

    Spark splits a skewed partition of a merge join only where both sides come straight from a shuffle. A kept table
    does; an aggregate, whose partitioning the join would share, doesn't.
    """
    return F.broadcast(table) if table.count() <= most else table.hint("merge")


def release() -> None:
    """Give memory that a finished task has freed back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps what it likes
        pass


def fold(column: str, of: int):
    """crc32 of the id as text, modulo a number of folds; null ids are in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % of, F.lit(0))


def hash01(column):
    """A number in [0, 1) that depends on the value alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(7), column), 11) / float(1 << 53)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def whole_groups(frames, keys: list[str]):
    """Frames of whole groups from frames sorted by keys: (frame, where each group begins and the last ends)."""
    rest = None
    for f in frames:
        f = f if rest is None else pd.concat([rest, f], ignore_index=True)
        starts = _starts(f, keys)
        if len(starts) > 1:
            yield f.iloc[: starts[-1]], starts
        rest = f.iloc[starts[-1] :].reset_index(drop=True) if len(starts) else None
    if rest is not None and len(rest):
        yield rest, np.array([0, len(rest)])


def _starts(f: pd.DataFrame, keys: list[str]) -> np.ndarray:
    new = np.ones(len(f), bool)
    if len(f) > 1:
        new[1:] = np.logical_or.reduce([f[k].to_numpy()[1:] != f[k].to_numpy()[:-1] for k in keys])
    return np.flatnonzero(new)


def check_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
