"""Sinks: writers of one batch; streams call them by `foreachBatch`, where a batch id is the epoch.

A sink with a primary key first keeps the last row of each key, unless `deduplicate` is false. Upserts
go to Parquet snapshots, a folder an epoch: the newest one whose write was committed counts. Appending
sinks note the epochs that they have written, so that a replayed batch changes nothing.
"""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.operators import changelog
from rillflow.plans.spec import Node, SpecError
from rillflow.rowkind import LABELS, OP, to_captured
from rillflow.streaming.retry import retried


def ordered_keep_last(df: DataFrame, node: Node) -> DataFrame:
    """Keep-last in a batch: by `order_by` if the sink names it, else by the rows' place in the batch."""
    if not node.primary_key or node.options.get("deduplicate") is False:
        return df
    order = node.options.get("order_by")
    if order:
        return changelog.keep_last(df, node.primary_key, order if isinstance(order, list) else [order])
    placed = df.withColumn("_place_", F.monotonically_increasing_id())
    return changelog.keep_last(placed, node.primary_key, ["_place_"]).drop("_place_")


class Sink:
    def __init__(self, spark: SparkSession, node: Node):
        self.spark, self.node, self.options = spark, node, node.options

    def write(self, batch: DataFrame, epoch: int) -> None:
        raise NotImplementedError


class Blackhole(Sink):
    def write(self, batch, epoch):
        batch.write.format("noop").mode("overwrite").save()


class Print(Sink):
    """Rows as JSON behind their change kind; one in `sample_every`, of the first `num_records_before_stop` of the run (unset: all)."""

    def write(self, batch, epoch):
        # A sink is opened for each batch; Pipeline.run drops the count.
        seen = self.options.get("_seen", 0)
        every, most = int(self.options.get("sample_every", 1)), self.options.get("num_records_before_stop")
        rows = batch.select(F.col(OP), F.to_json(F.struct(*[c for c in batch.columns if c != OP]), {"ignoreNullFields": "false"}).alias("row"))
        if most is not None:
            rows = rows.limit(max(0, int(most) - seen))
        for r in rows.toLocalIterator():
            if seen % every == 0:
                print(f"{LABELS.get(r[OP], 'INSERT')} {r.row}")
            seen += 1
        self.options["_seen"] = seen


class Memory(Sink):
    """Batches kept by sink name, for tests."""

    batches: dict[str, list[DataFrame]] = {}

    def write(self, batch, epoch):
        out = batch.drop(OP) if self.options.get("exclude_gs_op") else batch
        self.batches.setdefault(self.node.name, []).append(self.spark.createDataFrame(out.collect(), out.schema))


class Epochs:
    """Marks of the epochs that were appended to a folder; readers don't see them."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.top = f"{path.rstrip('/')}/_epochs"
        self._fs = self._path(self.top).getFileSystem(spark._jsc.hadoopConfiguration())

    def done(self, epoch: int) -> bool:
        return self._fs.exists(self._path(f"{self.top}/{epoch}"))

    def mark(self, epoch: int) -> None:
        self._fs.create(self._path(f"{self.top}/{epoch}"), True).close()


class Files(Sink):
    def write(self, batch, epoch):
        epochs = Epochs(self.spark, self.options["path"])
        if epochs.done(epoch):
            return
        writer = batch.write.mode("append").format(self.options.get("format", "parquet"))
        if self.options.get("partition_by"):
            writer = writer.partitionBy(*self.options["partition_by"])
        writer.save(self.options["path"])
        epochs.mark(epoch)


class Webhook(Sink):
    """Rows as JSON, one request a row or a batch of `batch_size`; `payload_version` 1 adds the change kind."""

    def write(self, batch, epoch):
        body = F.to_json(F.struct(*[c for c in batch.columns if c != OP]), {"ignoreNullFields": "false"})
        options = dict(self.options)

        def send(rows):
            post_rows(options, ((r[OP], r.row) for r in rows))

        batch.select(F.col(OP), body.alias("row")).foreachPartition(send)


def payload(options: dict, op: str, row: str):
    value = json.loads(row)
    return {"metadata": {"op": op}, "data": value} if int(options.get("payload_version", 0)) == 1 else value


def post(options: dict, body) -> bytes:
    request = urllib.request.Request(options["url"], json.dumps(body).encode(), {"Content-Type": "application/json", **(options.get("headers") or {})})

    def once() -> bytes:
        with urllib.request.urlopen(request, timeout=float(options.get("timeout", 30))) as answer:
            return answer.read()

    return retried(once, attempts=options.get("attempts"))


def post_rows(options: dict, rows) -> None:
    size = 1 if options.get("one_row_per_request") else int(options.get("batch_size", 1000))
    held: list = []

    def flush() -> None:
        if held:
            try:
                post(options, held[0] if options.get("one_row_per_request") else held)
            except Exception:
                if not options.get("skip_on_error"):
                    raise
            held.clear()

    for op, row in rows:
        held.append(payload(options, op, row))
        if len(held) >= size:
            flush()
    flush()


class Snapshot:
    """A table of one Parquet folder an epoch: the newest one that was committed is the table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _committed(self) -> list[int]:
        if not self._fs.exists(self._at("")):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at(""))]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdecimal() and self._fs.exists(self._at(f"{n}/_SUCCESS")))

    def epoch(self) -> int | None:
        """The last epoch that was written."""
        return (self._committed() or [None])[-1]

    def read(self) -> DataFrame | None:
        n = self.epoch()
        return None if n is None else self.spark.read.parquet(f"{self.path}/v{n}")

    def write(self, df: DataFrame, epoch: int) -> None:
        before = self._committed()
        df.write.mode("overwrite").parquet(f"{self.path}/v{epoch}")
        for n in before:
            if n != epoch:
                self._fs.delete(self._at(f"v{n}"), True)


class Upsert(Sink):
    """Relational upserts into a snapshot at `path`."""

    def write(self, batch, epoch):
        last = ordered_keep_last(batch, self.node)
        table = Snapshot(self.spark, self.options["path"])
        done = table.epoch()
        if done is not None and epoch <= done:
            return  # a replay
        current = table.read()
        if current is None:
            current = last.drop(OP).limit(0)
        o = self.options
        table.write(changelog.upsert(current, last, self.node.primary_key, self.node.primary_key, o.get("on_conflict", "update"), o.get("update_where")), epoch)


class Aggregate(Sink):
    """Incremental aggregates: signed states of a batch are merged into the table; a replayed epoch is left out."""

    def write(self, batch, epoch):
        o = self.options
        groups, measures = list(o.get("group_by") or {}), o.get("aggregate") or {}
        table = Snapshot(self.spark, o["path"])
        done = table.epoch()
        if done is not None and epoch <= done:
            return
        if self.node.primary_key and o.get("deduplicate") is not False:
            batch = changelog.landed(batch.withColumn("_place_", F.monotonically_increasing_id()), self.node.primary_key, ["_place_"]).drop("_place_")
        table.write(changelog.merge_aggregate(table.read(), changelog.batch_aggregate(batch, groups, measures), groups, measures), epoch)


class Replacing(Sink):
    """Append-only rows with `is_deleted` and a version, or inserts and deletes apart; Parquet at `path`."""

    def write(self, batch, epoch):
        epochs = Epochs(self.spark, self.options["path"])
        if self.options.get("append_only_mode", True):
            if epochs.done(epoch):
                return
            batch = ordered_keep_last(batch, self.node)
            out = changelog.replacing_rows(batch, self.options.get("version_column_name", "insert_time"))
            out.write.mode("append").parquet(self.options["path"])
            epochs.mark(epoch)
        else:
            Upsert(self.spark, self.node).write(batch, epoch)


def kafka_rows(batch: DataFrame, node: Node) -> DataFrame:
    """key, value and headers of records: JSON, the key from the primary key, the change code in `dbz.op`."""
    rest = [c for c in batch.columns if c != OP]
    key = F.to_json(F.struct(*node.primary_key)) if node.primary_key else F.lit(None).cast("string")
    value = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})
    return batch.select(key.cast("binary").alias("key"), value.cast("binary").alias("value"), F.array(F.struct(F.lit("dbz.op").alias("key"), to_captured(F.col(OP)).cast("binary").alias("value"))).alias("headers"))


class Kafka(Sink):
    def write(self, batch, epoch):
        o = self.options
        rows = kafka_rows(ordered_keep_last(batch, self.node), self.node)
        rows.write.format("kafka").option("kafka.bootstrap.servers", o.get("bootstrap_servers", "localhost:9092")).option("topic", o["topic"]).option("includeHeaders", "true").save()


WRITERS: dict[str, type[Sink]] = {"blackhole": Blackhole, "print": Print, "memory": Memory, "file": Files, "webhook": Webhook, "postgres": Upsert, "postgres_aggregate": Aggregate, "clickhouse": Replacing, "kafka": Kafka}


#: Sinks whose target holds decimals of any size; others take them as text or native decimals.
WIDE_DECIMALS = frozenset(("postgres", "postgres_aggregate", "clickhouse", "memory", "print", "blackhole", "file", "webhook"))


def checked_decimals(df: DataFrame, node: Node) -> None:
    """A wide decimal (metadata `decimal_arb`) goes only to sinks that can hold it."""
    wide = [f.name for f in df.schema.fields if (f.metadata or {}).get("decimal_arb")]
    if wide and node.kind not in WIDE_DECIMALS:
        raise SpecError(f"{node.name}: a {node.kind} sink can't hold the wide decimals {', '.join(wide)}")


def open_sink(spark: SparkSession, node: Node, plugins: dict[str, Callable] | None = None) -> Sink:
    make = (plugins or {}).get(node.kind) or WRITERS.get(node.kind)
    if make is None:
        raise SpecError(f"{node.name}: no sink of type {node.kind}")
    if node.kind in ("postgres", "postgres_aggregate") and "path" not in node.options:
        node.options["path"] = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), node.options.get("schema", "public"), node.options.get("table") or node.options["agg_table"])
    return make(spark, node)
