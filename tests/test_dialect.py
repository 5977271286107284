import pyarrow as pa
import pytest

from rillflow.functions.dialect import prepared, time_pattern
from rillflow.operators.relational import rebatched
from rillflow.plans.pipeline import Pipeline, Plugins, Session, _carried, narrow_sql
from rillflow.plans.spec import Node, SpecError
from rillflow.rowkind import OP
from rillflow.sources import connect
from rillflow.streaming.state import MemoryState


@pytest.mark.parametrize(
    "sql, want",
    [
        ("SELECT id, unnest(xs) AS x FROM t", "SELECT id, explode(xs) AS x FROM t"),
        ("SELECT unnest(unnest(xs)) AS x FROM t", "SELECT explode(flatten(xs)) AS x FROM t"),
        ("SELECT c FROM t CROSS JOIN UNNEST(xs) AS u(c)", "SELECT c FROM t  LATERAL VIEW explode(xs) u AS c "),
        ("SELECT [1, 2][1], a[2], m['k'], s.xs[1], f(x)[2], ARRAY[a]", "SELECT try_element_at(array(1, 2), 1), try_element_at(a, 2), m['k'], try_element_at(s.xs, 1), try_element_at(f(x), 2), array(a)"),
        ("SELECT x FROM t ORDER BY a DESC, b, c NULLS FIRST LIMIT 1", "SELECT x FROM t ORDER BY a DESC NULLS FIRST, b NULLS LAST, c NULLS FIRST LIMIT 1"),
        ("SELECT CAST(x AS DECIMAL(100, 18)), y::NUMERIC(50, 3), CAST(z AS DECIMAL(38, 2))", "SELECT rf_decimal_cast(cast(x AS string), 100, 18), rf_decimal_cast(cast(y AS string), 50, 3), CAST(z AS DECIMAL(38, 2))"),
        ("SELECT '[1] unnest(x) ORDER BY y'", "SELECT '[1] unnest(x) ORDER BY y'"),
    ],
)
def test_forms(sql, want):
    assert prepared(sql) == want


def test_time_patterns():
    assert time_pattern("%Y-%m-%dT%H:%M:%S") == "yyyy-MM-dd'T'HH:mm:ss" and time_pattern("100%% %j") == "100% DDD"
    with pytest.raises(ValueError):
        time_pattern("%Q")


def test_change_kinds_stay_out_of_subqueries():
    flat = lambda s: " ".join(s.split()).replace(" ,", ",")
    assert flat(_carried("SELECT id, (SELECT max(id) FROM t) AS m FROM t")) == f"select id, (SELECT max(id) FROM t) AS m, {OP} FROM t"
    assert flat(_carried("SELECT a FROM (SELECT a FROM t) AS x WHERE a IN (SELECT b FROM u)")) == f"select a, {OP} FROM (select a, {OP} FROM t) AS x WHERE a IN (SELECT b FROM u)"


def test_wide_columns_are_marked_and_unsupported_uses_are_errors(spark):
    df = spark.createDataFrame([(1, "3.50"), (2, None)], "id int, v string")
    out = narrow_sql(Session(spark), "SELECT id, CAST(v AS DECIMAL(60, 4)) + 1 AS w FROM t", {"t": df})
    assert sorted((r.id, r.w) for r in out.collect()) == [(1, "4.5000"), (2, None)]
    assert "decimal_arb" in out.schema["w"].metadata
    with pytest.raises(Exception):  # noqa: B017
        narrow_sql(Session(spark), "SELECT id, sum(w) OVER (PARTITION BY id) AS s FROM (SELECT id, CAST(v AS DECIMAL(60, 4)) AS w FROM t) AS x", {"t": df})
    some = narrow_sql(Session(spark), "SELECT id FROM (SELECT id, CAST(v AS DECIMAL(60, 4)) AS w FROM t) AS x WHERE w BETWEEN 3 AND 20 AND w IN (3.5, 7)", {"t": df})
    assert [r.id for r in some.collect()] == [1]


def test_batches_of_a_size():
    whole = pa.RecordBatch.from_pydict({"x": list(range(23))})
    for cuts in ([23], [1, 9, 13], [0, 5, 5, 5, 8]):
        at, parts = 0, []
        for n in cuts:
            parts.append(whole.slice(at, n))
            at += n
        out = list(rebatched(iter(parts), 5))
        assert [b.num_rows for b in out] == [5, 5, 5, 5, 3] and [x for b in out for x in b.column(0).to_pylist()] == list(range(23))


def test_plugin_state_drain_policy_and_hybrid_start(spark):
    spec = {"sources": {"s": {"type": "memory", "rows": [(1,)], "schema": "id int"}}, "sinks": {"k": {"type": "blackhole", "from": "s"}}}
    store, plugins = MemoryState(), Plugins()
    p = Pipeline(spark, spec, plugins, state=store)
    plugins.state("a").put("n", 3)
    assert plugins.state("a").get("n") == 3 and plugins.state("b").get("n") is None

    class Query:
        calls: list = []

        def processAllAvailable(self):
            self.calls.append("drain")

        def stop(self):
            self.calls.append("stop")

    for policy in ("auto", "drain", "fast"):
        p.stop(Query(), policy)
    assert Query.calls == ["drain", "stop", "drain", "stop", "stop"]
    with pytest.raises(SpecError):
        p.stop(Query(), "slow")
    assert connect.kafka_options(Node("k", "kafka", {"topic": "t", "starting_timestamp": 5}))["startingTimestamp"] == "5"
