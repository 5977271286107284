"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: bounds what a Python worker holds at a time.
BATCH_ROWS = 2000
BATCH_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Long documents go to Python in batches of bounded size."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the session's checkpoint folder, which all executors share."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        import tempfile

        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="rillflow-")
        spark.conf.set("spark.checkpoint.dir", top) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return f"{top.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """`df` as a table in the shared folder: cuts lineage, survives lost executors."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, purpose: str) -> DataFrame:
    """`df`, or a table of it if a task that runs again may meet its rows in another order."""
    return written(df, purpose) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def scan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's size, without running it; where it has none, 16 MB a partition."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 56 else df.rdd.getNumPartitions() << 24


def parts(size: int, target: int, least: int = 1) -> int:
    return max(least, math.ceil(size / target))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_KEPT: dict = {}


def kept(shared, make):
    """What a worker made of a broadcast value: it keeps one such thing, whichever operator's it is."""
    key = getattr(shared, "_path", None) or id(shared)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drops what the worker has kept, in operators that keep nothing."""
    _KEPT.clear()


def fold(key: Column, modulus: int) -> Column:
    """crc32 of an id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer over unsigned integers (wraps)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated ranges start..start+length."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
