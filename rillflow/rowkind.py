"""Change kinds of rows: one short string column beside the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The column's name, its values, and the change codes of captured database logs.
OP = "_gs_op"
INSERT, UPDATE, DELETE = "i", "u", "d"
CAPTURED = {"c": INSERT, "r": INSERT, "u": UPDATE, "d": DELETE}
LABELS = {INSERT: "INSERT", UPDATE: "UPDATE", DELETE: "DELETE"}


def with_op(df: DataFrame, op: str = INSERT) -> DataFrame:
    """`df` with the change kind, a constant where it has none."""
    return df if OP in df.columns else df.withColumn(OP, F.lit(op))


def from_captured(code: Column) -> Column:
    """Change kind of a captured-log code; no code is an insert."""
    out = F.when(code.isNull(), INSERT)
    for c, op in CAPTURED.items():
        out = out.when(code == c, op)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown change code "), code)))


def to_captured(op: Column) -> Column:
    return F.when(op == UPDATE, "u").when(op == DELETE, "d").otherwise("c")
