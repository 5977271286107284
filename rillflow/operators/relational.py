"""Relational operators that differ from Spark's defaults: unnesting, placement, order of NULLs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unnest(df: DataFrame, columns: list[str], preserve_nulls: bool = False, depth: int = 1) -> DataFrame:
    """Lists in lockstep: the longest wins, shorter ones are padded with NULL, other columns repeat.

    A row whose lists are all empty goes, and one whose lists are all NULL too unless `preserve_nulls`.
    `depth` unnests nested lists as often.
    """
    out = df
    for _ in range(depth):
        live = [c for c in columns if isinstance(out.schema[c].dataType, T.ArrayType)]
        if not live:
            break
        zipped = F.arrays_zip(*[F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType)).alias(c) for c in live])
        if preserve_nulls:
            none = F.lit(True)
            for c in live:
                none = none & F.col(c).isNull()
            zipped = F.when(none, F.array(F.struct(*[F.lit(None).cast(out.schema[c].dataType.elementType).alias(c) for c in live]))).otherwise(zipped)
        names = out.columns
        out = out.withColumn("_each_", F.explode(zipped)).select(*[F.col("_each_").getField(c).alias(c) if c in live else F.col(c) for c in names])
    return out


def unnest_struct(df: DataFrame, column: str) -> DataFrame:
    """A struct's fields as columns `column.field`, in its place."""
    parts: list[Column] = []
    for f in df.schema.fields:
        if f.name == column:
            parts += [F.col(column)[x.name].alias(f"{column}.{x.name}") for x in f.dataType.fields]
        else:
            parts.append(F.col(f"`{f.name}`"))
    return df.select(*parts)


def placed(df: DataFrame, parallelism: int | None, keys: list[str] | None = None) -> DataFrame:
    """By key if there is one, else evenly; one partition for 1."""
    if not parallelism:
        return df
    if parallelism == 1:
        return df.coalesce(1)
    return df.repartition(parallelism, *keys) if keys else df.repartition(parallelism)


def rebatched(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of `rows`, the last one shorter; at most that many are held."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        while size + b.num_rows >= rows:
            cut = rows - size
            yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks().to_batches()[0]
            held, size, b = [], 0, b.slice(cut)
        if b.num_rows:
            held.append(b)
            size += b.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def ascending(c: str | Column) -> Column:
    """Order with NULLs last, as in the pipeline dialect."""
    return (F.col(c) if isinstance(c, str) else c).asc_nulls_last()


def descending(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).desc_nulls_first()


def all_values(c: str) -> Column:
    """Aggregate: all values of a group with NULLs, which collect_list drops."""
    return F.transform(F.collect_list(F.struct(F.col(c).alias("v"))), lambda s: s["v"])


def aligned_union(*frames: DataFrame) -> DataFrame:
    """UNION ALL by position; the change kind is added where a branch lacks it."""
    from rillflow.rowkind import OP, with_op

    some = any(OP in f.columns for f in frames)
    ready = []
    for f in frames:
        f = with_op(f) if some else f
        ready.append(f.select(*[c for c in f.columns if c != OP], OP) if some else f)
    out = ready[0]
    for f in ready[1:]:
        out = out.unionAll(f)
    return out
