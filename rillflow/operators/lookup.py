"""Dynamic tables: named sets of strings, filled by a branch of a pipeline and asked by another.

A check of a scalar or of an array becomes a join against the set; Spark broadcasts a set that its
statistics or, at run time, its size in bytes show to be small.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CHECK = re.compile(r"dynamic_table_check\s*\(", re.I)


class DynamicTable:
    """A set of strings: kept as a DataFrame, or as a Parquet table at `path` that survives restarts."""

    def __init__(self, spark: SparkSession, name: str, path: str | None = None):
        self.spark, self.name, self.path = spark, name, path
        self._rows = spark.createDataFrame([], "value string")

    def rows(self) -> DataFrame:
        if self.path is None:
            return self._rows
        try:
            return self.spark.read.schema("value string").parquet(self.path).distinct()
        except Exception as e:  # the table isn't there before the first append
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], "value string")
            raise

    def append(self, values: DataFrame) -> None:
        """Adds the values of a frame of one string column; NULLs don't count."""
        if len(values.columns) != 1 or not isinstance(values.schema.fields[0].dataType, T.StringType):
            raise ValueError(f"the dynamic table {self.name} is filled from one string column")
        new = values.toDF("value").where("value is not null").distinct()
        if self.path is None:
            self._rows = self._rows.union(new).distinct().checkpoint() if self.spark.sparkContext.getCheckpointDir() else self._rows.union(new).distinct()
        else:
            new.join(self.rows(), "value", "left_anti").write.mode("append").parquet(self.path)


def check(df: DataFrame, table: DataFrame, column: str, into: str) -> DataFrame:
    """`df` with a boolean column `into`: whether `column`, or any element of it, is in `table`.

    NULL gives NULL, an empty array false, NULL elements are skipped. One row of `df` stays one row.
    """
    values = table.select(F.col(table.columns[0]).alias("_value_")).where("_value_ is not null").distinct()
    if not isinstance(df.schema[column].dataType, T.ArrayType):
        joined = df.join(values.withColumn("_in_", F.lit(True)), F.col(column).cast("string") == F.col("_value_"), "left")
        return joined.withColumn(into, F.when(F.col(column).isNull(), None).otherwise(F.coalesce("_in_", F.lit(False)))).drop("_value_", "_in_")
    # Arrays: the distinct arrays are judged, by their own elements, and joined back by what they hold.
    lists = df.select(F.col(column).alias("_list_")).where("_list_ is not null").distinct()
    each = lists.select("_list_", F.explode(F.array_distinct("_list_")).alias("_value_")).withColumn("_value_", F.col("_value_").cast("string"))
    hits = each.join(values, "_value_", "left_semi").select("_list_").distinct().withColumn("_in_", F.lit(True))
    joined = df.join(hits, F.col(column) == F.col("_list_"), "left")
    return joined.withColumn(into, F.when(F.col(column).isNull(), None).otherwise(F.coalesce("_in_", F.lit(False)))).drop("_list_", "_in_")


def checks(sql: str) -> list[tuple[str, str]]:
    """(table, value expression) of each call of dynamic_table_check in `sql`."""
    from rillflow.functions.sqltext import expand, literal

    found: list[tuple[str, str]] = []

    def note(args: list[str]) -> str:
        name = literal(args[0]) if len(args) == 2 else None
        if name is None:
            raise ValueError("dynamic_table_check takes a table's name as a literal, and a value")
        found.append((name, args[1]))
        return "true"

    expand(sql, {"dynamic_table_check": note})
    return found
