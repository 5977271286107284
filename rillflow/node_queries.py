"""Queries that run whole pipelines: sources, transforms and sinks as nodes of a specification, read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.operators import relational
from rillflow.plans.pipeline import Pipeline, Plugins
from rillflow.plans.spec import Node
from rillflow.queries import _CHANGES, _I, _KINDS, _ONES, _SIGNED, _query
from rillflow.rowkind import OP
from rillflow.sources import connect, sinks
from rillflow.streaming.state import MemoryState


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        import tempfile

        top = "file://" + tempfile.mkdtemp(prefix="rillflow-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _file(path: str, kind: str = "parquet", **more) -> dict:
    return {"type": "file", "format": kind, "path": path, "mode": {"type": "bounded"}, **more}


def _table(sf_dir: str, name: str, **more) -> dict:
    return _file(f"{sf_dir}/{name}.parquet", **more)


# ---- sources ---------------------------------------------------------------------------------------

_NATION = f"SELECT n_nationkey::BIGINT AS n_nationkey, n_name, {_I} FROM nation"


def _reread(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        path = _folder(spark, kind)
        writer = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name").write.format({"ndjson": "json"}.get(kind, kind))
        writer.option("header", "true").save(path)
        spec = {"sources": {"n": _file(path, kind, schema={"n_nationkey": "int64", "n_name": "utf8"})}, "transforms": {"t": {"type": "sql", "primary_key": "n_nationkey", "sql": "SELECT n_nationkey, n_name FROM n"}}, "sinks": {"k": {"type": "blackhole", "from": "t"}}}
        return Pipeline(spark, spec).frames()["t"]

    return query


for _kind in ("csv", "ndjson", "orc"):
    _query(f"{_kind}_file_source", _NATION)(_reread(_kind))


@_query("partitioned_file_source", f"SELECT n_nationkey, n_name, n_regionkey, {_I} FROM nation WHERE n_regionkey = 2")
def partitioned_file_source(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "hive")
    spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").write.partitionBy("n_regionkey").parquet(path)
    return connect.open_source(spark, Node("n", "file", _file(path, filter="n_regionkey = 2")), False)


@_query("continuous_file_source", f"SELECT o_orderkey, o_totalprice * 2 AS twice, {_I} FROM orders WHERE o_totalprice > 1000")
def continuous_file_source(spark: SparkSession, d: str) -> DataFrame:
    """A stream over a folder, run until all files are read, into files."""
    source, out = _folder(spark, "arriving"), _folder(spark, "arrived")
    spark.read.parquet(f"{d}/orders.parquet").repartition(3).write.parquet(source)
    spec = {"sources": {"o": {"type": "file", "format": "parquet", "path": source}}, "transforms": {"t": {"type": "sql", "primary_key": "o_orderkey", "sql": "SELECT o_orderkey, o_totalprice * 2 AS twice FROM o WHERE o_totalprice > 1000"}}, "sinks": {"k": {"type": "file", "from": "t", "path": out}}}
    Pipeline(spark, spec).run("available_now", checkpoint=_folder(spark, "progress"))
    return spark.read.parquet(out)


@_query("hybrid_source", f"SELECT n_nationkey, {_I} FROM nation")
def hybrid_source(spark: SparkSession, d: str) -> DataFrame:
    """Two bounded phases, one epoch each."""
    out = _folder(spark, "phases")
    phases = [_table(d, "nation", filter=f) | {"source_type": "file"} for f in ("n_nationkey < 12", "n_nationkey >= 12")]
    spec = {"sources": {"h": {"type": "hybrid", "bounded_sources": phases}}, "transforms": {"t": {"type": "sql", "primary_key": "n_nationkey", "sql": "SELECT n_nationkey FROM h"}}, "sinks": {"k": {"type": "file", "from": "t", "path": out}}}
    Pipeline(spark, spec, state=MemoryState()).run("available_now")
    return spark.read.parquet(out)


@_query("kafka_json_records", f"SELECT event_id, user_id, {_KINDS}, 3::INT AS part FROM events WHERE event_id > 10")
def kafka_json_records(spark: SparkSession, d: str) -> DataFrame:
    """Records as the Kafka sink writes them, decoded as the Kafka source does, with the source's filter."""
    rows = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id", "user_id", _KINDS)
    sent = sinks.kafka_rows(rows, Node("k", "kafka", {"topic": "t"}, primary_key=["event_id"]))
    records = sent.select("value", "headers", F.lit(3).alias("partition"), F.lit(0).cast("bigint").alias("offset"), F.timestamp_seconds(F.lit(0)).alias("timestamp"))
    node = Node("s", "kafka", {"schema": {"event_id": "int64", "user_id": "int64"}, "include_metadata": True, "filter": "event_id > 10"})
    return connect.decoded(records, node).select("event_id", "user_id", OP, F.col("__kafka_partition").alias("part"))


@_query("replacing_source", f"SELECT user_id, event_id, {_I} FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_type <> 'error'")
def replacing_source(spark: SparkSession, d: str) -> DataFrame:
    """Versions of a key merged as the ClickHouse source merges them; deleted winners go."""
    history = spark.read.parquet(f"{d}/events.parquet").selectExpr("user_id", "event_id", "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_deleted")
    return connect.shaped_history(history, Node("c", "clickhouse", {"version_column": "event_id", "columns": ["user_id", "event_id"]}, primary_key=["user_id"]))


@_query("memory_source", f"SELECT r_regionkey, r_name, {_I} FROM region")
def memory_source(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/region.parquet").select("r_regionkey", "r_name")
    return connect.open_source(spark, Node("m", "memory", {"data": rows}), False)


# ---- transforms ------------------------------------------------------------------------------------


@_query("dynamic_table_pipeline", f"SELECT c_custkey, c_name, {_I} FROM customer WHERE c_acctbal > 5000 AND c_nationkey < 12")
def dynamic_table_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """A table that one branch fills and another asks."""
    spec = {
        "sources": {"c": _table(d, "customer")},
        "transforms": {
            "rich": {"type": "dynamic_table", "backend_type": "InMemory", "sql": "SELECT CAST(c_custkey AS string) AS k FROM c WHERE c_acctbal > 5000"},
            "t": {"type": "sql", "primary_key": "c_custkey", "parallelism": 3, "sql": "SELECT c_custkey, c_name FROM c WHERE dynamic_table_check('rich', c_custkey) AND c_nationkey < 12"},
        },
        "sinks": {"k": {"type": "blackhole", "from": "t"}},
    }
    return Pipeline(spark, spec).frames()["t"]


@_query("stored_dynamic_table", f"SELECT n_nationkey, {_I} FROM nation WHERE n_regionkey IN (0, 2)")
def stored_dynamic_table(spark: SparkSession, d: str) -> DataFrame:
    """A table that outlives its pipeline: filled by one, asked by the next."""
    state, fill = _folder(spark, "tables"), "SELECT CAST(r_regionkey AS string) AS k FROM r WHERE r_regionkey IN (0, 2)"
    table = {"type": "dynamic_table", "backend_type": "Postgres", "backend_entity_name": "chosen"}
    first = {"sources": {"r": _table(d, "region")}, "transforms": {"chosen": table | {"sql": fill}}, "sinks": {"k": {"type": "blackhole", "from": "r"}}}
    Pipeline(spark, first, state_path=state).run()
    then = {"sources": {"n": _table(d, "nation")}, "transforms": {"chosen": table, "t": {"type": "sql", "primary_key": "n_nationkey", "sql": "SELECT n_nationkey FROM n WHERE dynamic_table_check('chosen', n_regionkey)"}}, "sinks": {"k": {"type": "blackhole", "from": "t"}}}
    return Pipeline(spark, then, state_path=state).frames()["t"]


@_query("script_transform", f"SELECT n_nationkey, upper(n_name) || '!' AS n_name, n_regionkey, {_I} FROM nation WHERE n_regionkey > 0")
def script_transform(spark: SparkSession, d: str) -> DataFrame:
    script = "def process(row):\n    if row['n_regionkey'] == 0:\n        return None\n    return {**row, 'n_name': row['n_name'].upper() + '!'}\n"
    spec = {"sources": {"n": _table(d, "nation")}, "transforms": {"t": {"type": "sql", "primary_key": "n_nationkey", "sql": "SELECT n_nationkey, n_name, n_regionkey FROM n"}, "s": {"type": "script", "language": "python", "from": "t", "script": script}}, "sinks": {"k": {"type": "blackhole", "from": "s"}}}
    return Pipeline(spark, spec).frames()["s"]


@_query("plugin_nodes", f"SELECT (3 * id)::BIGINT AS id, (7 * 3 * id)::BIGINT AS x, {_I} FROM (SELECT unnest(range(50)) AS id)")
def plugin_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Source, transform, function, preprocessor, side output and sink of the user's."""
    p, out = Plugins(), _folder(spark, "plugin")
    p.sources["own.numbers"] = lambda s, node, streaming: s.range(node.options["n"])
    p.transforms["own.triple"] = lambda df, o: df.withColumn("id", F.col("id") * 3)
    p.functions["seven_times"] = (lambda x: None if x is None else 7 * x, "bigint", ["times7"])
    p.preprocessors.append(lambda text: text.replace("$COUNT", "50"))
    p.side_outputs["s"] = [lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/side")]

    class Own(sinks.Sink):
        def write(self, batch, epoch):
            batch.write.mode("overwrite").parquet(f"{out}/main")

    p.sinks["own.files"] = Own
    text = "sources:\n  s: {type: own.numbers, n: $COUNT}\ntransforms:\n  d: {type: own.triple, from: s}\n  t: {type: sql, primary_key: id, sql: 'SELECT id, times7(id) AS x FROM d'}\nsinks:\n  k: {type: own.files, from: t}\n"
    Pipeline(spark, text, p).run()
    main, side = spark.read.parquet(f"{out}/main"), spark.read.parquet(f"{out}/side")
    return main.join(side.select((F.col("id") * 3).alias("id")), "id", "left_semi")


@_query("unnest_struct", f"SELECT n_nationkey, n_name AS name, n_regionkey AS region FROM nation")
def unnest_struct(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("s"))
    return relational.unnest_struct(rows, "s").toDF("n_nationkey", "name", "region")


# ---- sinks -----------------------------------------------------------------------------------------

_EVENTS = f"SELECT event_id, user_id, event_type, CAST(value AS decimal(18,2)) AS amount, CASE event_type WHEN 'error' THEN 'd' WHEN 'view' THEN 'u' ELSE 'i' END AS {OP} FROM e"


def _epochs(spark: SparkSession, d: str, sink: dict) -> None:
    """Events of odd, then of even ids into a sink, the second epoch twice."""
    p = Pipeline(spark, {"sources": {"e": _table(d, "events")}, "transforms": {"t": {"type": "sql", "primary_key": "event_id", "sql": _EVENTS}}, "sinks": {"k": {"from": "t", **sink}}})
    rows = p.session.own(connect.open_source(spark, p.spec.sources["e"], False))
    for epoch, part in ((1, "event_id % 2 = 1"), (2, "event_id % 2 = 0"), (2, "event_id % 2 = 0")):
        p._write({"e": rows.where(part)}, epoch)


@_query(
    "upsert_sink",
    f"""WITH n AS (SELECT * FROM {_CHANGES} WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
    o AS (SELECT * FROM (SELECT * FROM {_CHANGES} WHERE event_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE {OP} <> 'd')
    SELECT coalesce(n.user_id, o.user_id) AS user_id, CASE WHEN n.user_id IS NULL THEN o.event_id ELSE n.event_id END AS event_id FROM o FULL JOIN n ON o.user_id = n.user_id WHERE coalesce(n.{OP}, 'i') <> 'd'""",
)
def upsert_sink(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "upserts")
    _epochs(spark, d, {"type": "postgres", "primary_key": "user_id", "order_by": "event_id", "path": path})
    return sinks.Snapshot(spark, path).read().select("user_id", "event_id")


@_query("aggregate_sink", f"SELECT event_type, {_SIGNED}::DOUBLE AS total, {_ONES} AS n FROM {_CHANGES} GROUP BY event_type")
def aggregate_sink(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "aggregates")
    _epochs(spark, d, {"type": "postgres_aggregate", "group_by": {"event_type": {}}, "aggregate": {"total": {"fn": "sum", "from": "amount", "type": "decimal(28,2)"}, "n": {"fn": "count"}}, "path": path})
    return sinks.Snapshot(spark, path).read().select("event_type", F.col("total").cast("double").alias("total"), "n")


@_query("replacing_sink", f"SELECT event_id, CASE WHEN {OP} = 'd' THEN 1 ELSE 0 END AS gone FROM {_CHANGES}")
def replacing_sink(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "replacing")
    _epochs(spark, d, {"type": "clickhouse", "primary_key": "event_id", "path": path})
    return spark.read.parquet(path).select("event_id", F.col("is_deleted").cast("int").alias("gone"))


@_query("several_sinks", f"SELECT event_id, {OP}, 'a' AS sink FROM {_CHANGES} UNION ALL SELECT event_id, {OP}, 'b' FROM {_CHANGES}")
def several_sinks(spark: SparkSession, d: str) -> DataFrame:
    """One transform, two sinks; what they share is computed once."""
    a, b = _folder(spark, "a"), _folder(spark, "b")
    spec = {"sources": {"e": _table(d, "events")}, "transforms": {"t": {"type": "sql", "primary_key": "event_id", "sql": _EVENTS}}, "sinks": {"x": {"type": "file", "from": "t", "path": a}, "y": {"type": "file", "from": "t", "path": b, "partition_by": ["event_type"]}}}
    Pipeline(spark, spec).run()
    rows = [spark.read.parquet(p).select("event_id", OP, F.lit(n).alias("sink")) for n, p in (("a", a), ("b", b))]
    return rows[0].unionAll(rows[1])


@_query("memory_sink", "SELECT r_regionkey, r_name FROM region")
def memory_sink(spark: SparkSession, d: str) -> DataFrame:
    spec = {"sources": {"r": _table(d, "region")}, "transforms": {"t": {"type": "sql", "primary_key": "r_regionkey", "sql": "SELECT r_regionkey, r_name FROM r"}}, "sinks": {"kept_regions": {"type": "memory", "from": "t", "exclude_gs_op": True}}}
    sinks.Memory.batches.pop("kept_regions", None)
    Pipeline(spark, spec).run()
    return sinks.Memory.batches.pop("kept_regions")[0]
