"""Operators on changelog rows: deduplication, versions, upserts, incremental aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillflow.rowkind import DELETE, INSERT, OP, UPDATE


def _last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; NULL equals NULL. The rank limit is pushed below the shuffle."""
    name = "_rank_"
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) == 1).drop(name)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep-last per primary key; `order` gives the position of rows, ascending."""
    return _last(df, keys, [F.col(c).desc_nulls_last() for c in order])


def latest_version(df: DataFrame, keys: list[str], version: str, deleted: str | None = None, ties: list[str] = ()) -> DataFrame:
    """The highest version per key, ties to the later row; keys whose winner is deleted go."""
    out = _last(df, keys, [F.col(c).desc_nulls_last() for c in (version, *ties)])
    return out.where(F.coalesce(F.col(deleted).cast("int"), F.lit(0)) == 0) if deleted else out


def landed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Landing-table deduplication within an epoch: the last row per key and change kind."""
    return keep_last(df, [*keys, OP], order)


# Comparisons that may guard an update.
GUARDS = ("=", ">", ">=", "<", "<=", "!=", "<>")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: list[str], on_conflict: str = "update", update_where: dict[str, str] | None = None) -> DataFrame:
    """`current` after `changes`: keep-last per key, deletes remove, others insert or replace.

    `on_conflict="nothing"` keeps existing rows; `update_where` replaces a row only where the new value
    of each column compares so with the old one. Without columns beside the key nothing is replaced.
    """
    columns = current.columns
    last = keep_last(changes, keys, order)
    rest = [c for c in columns if c not in keys]
    new = last.select(*[F.col(k).alias(f"_n_{k}") for k in columns], F.col(OP).alias("_n_op"), F.lit(True).alias("_is_new"))
    old = current.withColumn("_is_old", F.lit(True))
    joined = old.join(new, [old[k].eqNullSafe(new[f"_n_{k}"]) for k in keys], "full_outer")
    fresh = F.col("_is_new") & F.col("_is_old").isNull()
    replace = F.coalesce(F.col("_is_new") & F.col("_is_old"), F.lit(False)) & F.lit(on_conflict == "update" and bool(rest))
    for c, op in (update_where or {}).items():
        if op not in GUARDS:
            raise ValueError(f"update_where knows {', '.join(GUARDS)}, not {op}")
        replace = replace & F.coalesce(F.expr(f"`_n_{c}` {op} `{c}`"), F.lit(False))
    take = F.coalesce(fresh, F.lit(False)) | replace
    gone = F.coalesce(F.col("_n_op") == DELETE, F.lit(False))
    return joined.where(~gone).select(*[F.when(take, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def replacing_rows(df: DataFrame, version: str = "insert_time") -> DataFrame:
    """Append-only form of changes: `is_deleted` instead of the change kind, and a version."""
    out = df.withColumn("is_deleted", F.when(F.col(OP) == DELETE, 1).otherwise(0).cast("tinyint")).drop(OP)
    return out if version in out.columns else out.withColumn(version, F.current_timestamp())


# ---- incremental aggregates ------------------------------------------------------------------------

SENTINEL = "key"


def _measures(aggregates: dict[str, dict]) -> list[tuple[str, str, Column]]:
    """(column, how two states merge, state of a batch)."""
    if not aggregates:
        raise ValueError("an incremental aggregate needs at least one column")
    minus = F.col(OP) == DELETE
    one = F.when(minus, -1).when(F.col(OP) == UPDATE, 0).otherwise(1)
    out = []
    for name, spec in aggregates.items():
        fn, source = spec["fn"], spec.get("from")
        x = F.col(source or name)
        signed = F.when(minus, -x).otherwise(x)
        kind = spec.get("type")
        typed = (lambda c: c.cast(kind)) if kind else (lambda c: c)  # noqa: B023
        if fn == "count":
            out.append((name, "add", typed(F.sum(one if source is None else F.when(x.isNotNull(), one)))))
        elif fn == "sum":
            out.append((name, "add", typed(F.sum(signed))))
        elif fn == "avg":
            out += [(f"{name}_sum", "add", typed(F.sum(signed))), (f"{name}_count", "add", F.sum(F.when(x.isNotNull(), one)))]
        elif fn in ("min", "max"):
            out.append((name, fn, typed((F.min if fn == "min" else F.max)(x))))
        else:
            raise ValueError(f"no incremental aggregate {fn}")
    return out


def batch_aggregate(df: DataFrame, group_by: list[str], aggregates: dict[str, dict]) -> DataFrame:
    """Signed state of one batch: inserts add, deletes subtract, an update counts 0 and adds its whole value.

    `aggregates`: name -> {"fn": count | sum | avg | min | max, "from": column, "type": type}. Without
    groups the row has a sentinel `key`. Minima and maxima don't take rows back.
    """
    measures = _measures(aggregates)
    keys = [F.col(g) for g in group_by] or [F.lit("value").alias(SENTINEL)]
    return df.groupBy(*keys).agg(*[state.alias(name) for name, _, state in measures])


def merge_aggregate(current: DataFrame | None, batch: DataFrame, group_by: list[str], aggregates: dict[str, dict]) -> DataFrame:
    """Both states as one: additive columns add, minima and maxima compare."""
    if current is None:
        return batch
    keys = group_by or [SENTINEL]
    how = {"add": F.sum, "min": F.min, "max": F.max}
    return current.unionByName(batch).groupBy(*keys).agg(*[how[kind](name).alias(name) for name, kind, _ in _measures(aggregates)])


def captured_rows(df: DataFrame, code: str = "op") -> DataFrame:
    from rillflow.rowkind import from_captured

    return df.withColumn(OP, from_captured(F.col(code))).drop(code)


__all__ = ["INSERT", "UPDATE", "DELETE", "keep_last", "latest_version", "landed", "upsert", "replacing_rows", "batch_aggregate", "merge_aggregate", "captured_rows"]
