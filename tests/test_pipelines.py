import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from rillflow.operators import changelog, lookup, relational
from rillflow.plans import spec, validate
from rillflow.plans.pipeline import Pipeline, Plugins, Session, handler, narrow_sql
from rillflow.rowkind import OP
from rillflow.sources import connect, sinks
from rillflow.streaming.retry import retried
from rillflow.streaming.state import MemoryState, SqliteState

YAML = """
sources:
  raw.orders:
    type: file
    format: csv
    path: {path}
    mode: {{type: bounded}}
transforms:
  large:
    type: sql
    primary_key: id
    sql: |
      SELECT id, amount * 2 AS twice FROM raw.orders AS o WHERE o.amount > 10
  seen:
    type: dynamic_table
    backend_type: InMemory
    sql: SELECT CAST(id AS string) AS id FROM raw.orders WHERE amount > 100
  vip:
    type: sql
    primary_key: id
    sql: SELECT * FROM raw.orders WHERE dynamic_table_check('seen', id)
sinks:
  a: {{type: memory, from: large, primary_key: id}}
  b: {{type: memory, from: vip, exclude_gs_op: true}}
"""


@pytest.fixture
def orders(tmp_path):
    d = tmp_path / "orders"
    d.mkdir()
    (d / "a.csv").write_text("id,amount\n1,5\n2,50\n3,500\n")
    return d


def kept(name):
    return [tuple(r) for df in sinks.Memory.batches.pop(name, []) for r in df.collect()]


def test_yaml_to_sinks(spark, orders):
    sinks.Memory.batches.clear()
    p = Pipeline(spark, YAML.format(path=orders))
    p.run()
    assert sorted(kept("a")) == [(2, 100, "i"), (3, 1000, "i")]
    assert kept("b") == [(3, 500)]
    assert "Filter" in p.explain()["large"]


def test_stream_picks_up_new_files_and_resumes(spark, orders, tmp_path):
    sinks.Memory.batches.clear()
    text = "sources:\n  o: {type: file, format: csv, path: %s, schema: {id: int64, amount: int64}}\nsinks:\n  s: {type: memory, from: o}\n" % orders
    for n in range(2):
        Pipeline(spark, text).run("available_now", checkpoint=str(tmp_path / "cp"))
        assert len(kept("s")) == (3 if n == 0 else 1)
        (orders / f"later{n}.csv").write_text("id,amount\n9,9\n")


@pytest.mark.parametrize("sql", ["SELECT a.id FROM t AS a JOIN t AS b ON a.id = b.id", "SELECT id, count(*) AS n FROM t GROUP BY id", "SELECT id FROM t ORDER BY id", "SELECT id FROM t LIMIT 1", "SELECT DISTINCT id FROM t", "SELECT id FROM t UNION SELECT id FROM t", "SELECT id FROM (SELECT id FROM t ORDER BY id) AS x", "SELECT row_number() OVER (ORDER BY id) AS n FROM t"])
def test_stateful_sql_is_rejected(spark, sql):
    df = spark.createDataFrame([(1,)], "id int")
    with pytest.raises(validate.UnsupportedPlan):
        narrow_sql(Session(spark), sql, {"t": df})


@pytest.mark.parametrize("sql, want", [("SELECT id FROM t", [(1, "d")]), ("SELECT * FROM t", [(1, "d")]), (f"SELECT id, 'u' AS {OP} FROM t", [(1, "u")]), ("SELECT x FROM (SELECT id + 1 AS x FROM t) AS y", [(2, "d")]), ("WITH w AS (SELECT id FROM t) SELECT id FROM w", [(1, "d")]), ("SELECT id FROM t UNION ALL SELECT 5 AS id", [(1, "d"), (5, "i")]), ("SELECT id, (SELECT 7) AS z FROM t", [(1, 7, "d")]), ("SELECT explode(array(id, 2)) AS e FROM t", [(1, "d"), (2, "d")])])
def test_change_kinds_are_carried(spark, sql, want):
    df = spark.createDataFrame([(1, "d")], f"id int, {OP} string")
    assert sorted(map(tuple, narrow_sql(Session(spark), sql, {"t": df}).collect())) == want


BASE = {"sources": {"s": {"type": "memory", "rows": [], "schema": "id int"}}, "transforms": {}, "sinks": {"k": {"type": "print", "from": "s"}}}


@pytest.mark.parametrize("change", [
    {"sinks": {"k": {"type": "print", "from": "zz"}}}, {"sinks": {"k": {"type": "odd", "from": "s"}}}, {"transforms": {"t": {"type": "sql", "sql": "SELECT 1 AS id FROM s"}}},
    {"transforms": {"a": {"type": "sql", "primary_key": "id", "sql": "SELECT id FROM b"}, "b": {"type": "sql", "primary_key": "id", "sql": "SELECT id FROM a"}}, "sinks": {"k": {"type": "print", "from": "a"}}},
    {"transforms": {"t": {"type": "sql", "primary_key": "id", "sql": "SELECT id FROM s WHERE dynamic_table_check('no', id)"}}, "sinks": {"k": {"type": "print", "from": "t"}}},
    {"transforms": {"s": {"type": "sql", "primary_key": "id", "sql": "SELECT id FROM s"}}}, {"odd": {}}, {"sinks": {}},
])
def test_bad_specifications(change):
    with pytest.raises(spec.SpecError):
        spec.load({**BASE, **change})


def test_lookup_nulls_arrays_and_persistence(spark, tmp_path):
    t = lookup.DynamicTable(spark, "t", str(tmp_path / "t"))
    assert t.rows().count() == 0
    t.append(spark.createDataFrame([("a",), ("a",), (None,)], "v string"))
    t.append(spark.createDataFrame([("a",), ("b",)], "v string"))
    assert sorted(r.value for r in lookup.DynamicTable(spark, "t", str(tmp_path / "t")).rows().collect()) == ["a", "b"]
    df = spark.createDataFrame([(1, "a", ["z", "b"]), (2, "z", []), (3, None, None), (4, "b", [None])], "i int, s string, l array<string>")
    assert [r.c for r in lookup.check(df, t.rows(), "s", "c").orderBy("i").collect()] == [True, False, None, True]
    assert [r.c for r in lookup.check(df, t.rows(), "l", "c").orderBy("i").collect()] == [True, False, None, False]
    with pytest.raises(ValueError):
        t.append(spark.createDataFrame([(1,)], "v int"))


def test_unnest(spark):
    df = spark.createDataFrame([(1, [1, 2], ["x"]), (2, [], []), (3, None, None), (4, None, ["y"])], "i int, a array<int>, b array<string>")
    assert sorted(map(tuple, relational.unnest(df, ["a", "b"]).collect()), key=str) == sorted([(1, 1, "x"), (1, 2, None), (4, None, "y")], key=str)
    assert (3, None, None) in [tuple(r) for r in relational.unnest(df, ["a", "b"], True).collect()]
    nested = spark.createDataFrame([(1, [[1], [2, 3]])], "i int, a array<array<int>>")
    assert [r.a for r in relational.unnest(nested, ["a"], depth=2).collect()] == [1, 2, 3]
    assert relational.unnest_struct(spark.sql("SELECT 1 AS i, named_struct('x', 2) AS s"), "s").columns == ["i", "s.x"]


def test_upsert_guards_and_nulls(spark):
    current = spark.createDataFrame([(1, 5), (2, 5), (None, 1)], "id int, v int")
    changes = spark.createDataFrame([(1, 9, "u", 1), (1, 3, "u", 2), (2, 7, "d", 3), (None, 8, "i", 4), (4, 4, "i", 5)], f"id int, v int, {OP} string, seq int")
    got = lambda **k: sorted(map(tuple, changelog.upsert(current, changes, ["id"], ["seq"], **k).collect()), key=str)
    assert got() == sorted([(1, 3), (None, 8), (4, 4)], key=str)
    assert got(update_where={"v": ">"}) == sorted([(1, 5), (None, 8), (4, 4)], key=str)
    assert got(on_conflict="nothing") == sorted([(1, 5), (None, 1), (4, 4)], key=str)
    with pytest.raises(ValueError):
        got(update_where={"v": "like"})
    with pytest.raises(ValueError):
        changelog.batch_aggregate(changes, [], {})


def test_sinks_replay_is_harmless(spark, tmp_path):
    node = spec.Node("x", "postgres_aggregate", {"path": str(tmp_path / "agg"), "group_by": {"id": {}}, "aggregate": {"n": {"fn": "count"}, "v": {"fn": "sum"}}})
    batch = spark.createDataFrame([(1, 5, "i"), (1, 2, "d"), (2, 1, "i")], f"id int, v int, {OP} string")
    sink = sinks.open_sink(spark, node)
    for epoch in (1, 1, 2):
        sink.write(batch, epoch)
    assert sorted(map(tuple, sinks.Snapshot(spark, str(tmp_path / "agg")).read().collect())) == [(1, 0, 6), (2, 2, 2)]
    up = sinks.open_sink(spark, spec.Node("u", "postgres", {"path": str(tmp_path / "up")}, primary_key=["id"]))
    up.write(batch, 1)
    up.write(batch.where(f"{OP} = 'i'"), 2)
    up.write(batch.limit(0), 2)
    assert sorted(map(tuple, sinks.Snapshot(spark, str(tmp_path / "up")).read().collect())) == [(1, 5), (2, 1)]
    rows = sinks.kafka_rows(batch, spec.Node("k", "kafka", {}, primary_key=["id"])).collect()
    assert json.loads(rows[0]["value"]) == {"id": 1, "v": 5} and rows[1]["headers"][0]["value"] == b"d" and rows[0]["headers"][0]["value"] == b"c"


class Echo(http.server.BaseHTTPRequestHandler):
    seen: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.seen.append(body)
        rows = [{**r, "more": r["id"] * 10} for r in (body if isinstance(body, list) else [body])]
        out = json.dumps(rows if isinstance(body, list) else rows[0]).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(out)

    def log_message(self, *args):
        pass


def test_handler_and_webhook(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Echo)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    df = spark.createDataFrame([(1, "a", "i"), (2, None, "d")], f"id int, gone string, {OP} string")
    for one in (True, False):
        got = handler(df, {"url": url, "one_row_per_request": one, "schema_override": {"gone": None, "more": "int64"}})
        assert sorted(map(tuple, got.select("id", "more", OP).collect())) == [(1, 10, "i"), (2, 20, "d")]
    Echo.seen.clear()
    sinks.open_sink(spark, spec.Node("w", "webhook", {"url": url, "one_row_per_request": True, "payload_version": 1})).write(df.limit(0), 1)
    assert Echo.seen == []
    server.shutdown()


def test_hybrid_phases_resume(spark, tmp_path):
    sinks.Memory.batches.clear()
    phases = [{"source_type": "memory", "rows": [(1,)], "schema": "id int"}, {"source_type": "memory", "rows": [(2,)], "schema": "id int"}]
    raw = {"sources": {"h": {"type": "hybrid", "bounded_sources": phases}}, "sinks": {"hk": {"type": "memory", "from": "h"}}}
    state = SqliteState(str(tmp_path / "s.db"))
    Pipeline(spark, raw, state=state).run("available_now")
    Pipeline(spark, raw, state=SqliteState(str(tmp_path / "s.db"))).run("available_now")
    assert kept("hk") == [(1, "i"), (2, "i")]


def test_plugins(spark):
    sinks.Memory.batches.clear()
    seen = []
    p = Plugins()
    p.sources["my.source"] = lambda s, node, streaming: s.range(node.options["n"])
    p.transforms["my.double"] = lambda df, o: df.withColumn("id", F.col("id") * 2)
    p.functions["triple"] = (lambda x: None if x is None else 3 * x, "bigint", ["thrice"])
    p.preprocessors.append(lambda t: t.replace("$N", "3"))
    p.side_outputs["s"] = [lambda df, epoch: seen.append((df.count(), epoch))]
    text = "sources:\n  s: {type: my.source, n: $N}\ntransforms:\n  d: {type: my.double, from: s}\n  t: {type: sql, primary_key: id, sql: 'SELECT id, thrice(id) AS x FROM d'}\n  p: {type: script, from: t, script: \"def process(r):\\n  return None if r['id'] == 0 else r\"}\nsinks:\n  m: {type: memory, from: p}\n  b: {type: blackhole, from: p}\n"
    Pipeline(spark, text, p).run()
    assert sorted(kept("m")) == [(2, 6, "i"), (4, 12, "i")] and seen == [(3, 1)]


def test_sources(spark, tmp_path):
    spark.range(4).selectExpr("id", "id % 2 AS dt").write.partitionBy("dt").parquet(str(tmp_path / "hive"))
    spark.range(3).write.json(str(tmp_path / "deep" / "x" / "y"))
    read = lambda path, **o: connect.open_source(spark, spec.Node("f", "file", {"path": str(path), "format": "parquet", **o}), False)
    assert read(tmp_path / "hive", filter="dt = 1").count() == 2 and OP in read(tmp_path / "hive").columns
    assert read(tmp_path / "deep", format="ndjson").count() == 3
    history = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (2, 1, 0), (2, 1, 0), (3, 5, 1), (3, 6, 0)], "id int, ver int, is_deleted tinyint")
    got = connect.shaped_history(history, spec.Node("c", "clickhouse", {"version_column": "ver"}, primary_key=["id"]))
    assert sorted(map(tuple, got.collect())) == [(2, 1, "i"), (3, 6, "i")]
    assert connect.jdbc_options(spec.Node("j", "jdbc", {"range_column": "id", "range_start": 0, "range_end": 10}), "jdbc:x", "t")["numPartitions"] == "8"
    assert connect.schema_ddl({"a": "Int64", "b": "Decimal128(10,2)", "c": "Decimal256(60,2)", "d": "List<Utf8>"}) == "`a` bigint, `b` decimal(10,2), `c` string, `d` array<string>"
    records = spark.createDataFrame([(bytearray(b'{"id": 1}'), 0, 7, [("dbz.op", bytearray(b"d"))]), (bytearray(b'{"id": 2}'), 0, 8, None)], "value binary, partition int, offset bigint, headers array<struct<key:string,value:binary>>").withColumn("timestamp", F.lit(0).cast("timestamp"))
    rows = connect.decoded(records, spec.Node("k", "kafka", {"schema": {"id": "int64"}, "include_metadata": True}))
    assert [(r.id, r[OP], r["__kafka_offset"]) for r in rows.orderBy("id").collect()] == [(1, "d", 7), (2, "i", 8)]


def test_state_and_retries(tmp_path):
    for s in (MemoryState(), SqliteState(str(tmp_path / "k.db"))):
        assert s.get("a") is None
        s.put("a", {"x": 1})
        s.put("a", [2])
        assert s.get("a") == [2]
    calls = []

    def fails():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("later")
        return "done"

    waits = []
    assert retried(fails, sleep=waits.append) == "done" and waits == [0.1, 0.2]
    with pytest.raises(OSError):
        retried(lambda: (_ for _ in ()).throw(OSError("no")), attempts=2, sleep=waits.append)
    assert spec.seconds("500ms") == 0.5 and spec.seconds("2m") == 120


def test_print_sink_prints_all_rows_unless_told(spark, capsys):
    rows = spark.range(1500).selectExpr("cast(id AS int) AS id", f"'i' AS {OP}")

    def printed(**options):
        p = Pipeline(spark, BASE | {"sinks": {"k": {"type": "print", "from": "s"} | options}})
        for epoch in range(2):
            p._write({"s": rows}, epoch)
        return len(capsys.readouterr().out.splitlines())

    assert printed() == 3000
    assert printed(num_records_before_stop=1600) == 1600
    assert printed(num_records_before_stop=1600, sample_every=10) == 160
