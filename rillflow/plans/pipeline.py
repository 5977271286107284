"""Pipelines: a specification compiled to DataFrames and run as a batch, once over what is there, or for good."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rillflow.functions import dialect, library, scalars, wide
from rillflow.operators import lookup
from rillflow.operators.relational import placed, rebatched
from rillflow.plans import validate
from rillflow.plans.spec import Node, Spec, SpecError, load, seconds
from rillflow.rowkind import INSERT, OP, with_op
from rillflow.sources import connect, sinks
from rillflow.streaming.state import MemoryState, Scoped

#: Settings of the caller's session that a pipeline's own session takes over.
CONF = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.adaptive.enabled")


class Plugins:
    """User-supplied sources, transforms, sinks, functions, preprocessors and side outputs, by name."""

    def __init__(self):
        self.sources: dict[str, Callable] = {}
        self.transforms: dict[str, Callable] = {}
        self.sinks: dict[str, Callable] = {}
        self.functions: dict[str, tuple] = {}
        self.preprocessors: list[Callable[[str], str]] = []
        self.side_outputs: dict[str, list[Callable[[DataFrame, int], None]]] = {}
        self.state: Callable[[str], Scoped] | None = None  # set by the pipeline that runs them

    def kinds(self) -> dict[str, object]:
        return {**self.sources, **self.transforms, **self.sinks}


class Session:
    """A Spark session of its own; SQL text is in the pipeline dialect, whose private functions are registered as texts name them."""

    def __init__(self, spark: SparkSession, plugins: Plugins | None = None):
        self.plugins = plugins or Plugins()
        self.spark = spark.newSession()
        for key in CONF:
            value = spark.conf.get(key, None)
            if value is not None:
                self.spark.conf.set(key, value)
        for name, (f, kind, aliases) in self.plugins.functions.items():
            for n in (name, *aliases):
                self.spark.udf.register(n, f if hasattr(f, "returnType") else scalars.vectorised(f, StructType.fromDDL(f"x {kind}").fields[0].dataType, 0))

    def sql(self, text: str) -> DataFrame:
        """Anything that Spark SQL has, with the library's names."""
        return self.spark.sql(library.ready(self.spark, dialect.by_types(self.spark, library.rewritten(text, library.TYPED))))

    def view(self, name: str, df: DataFrame) -> str:
        """Registers `df`; a dotted name becomes one word in the session."""
        plain = name.replace(".", "__")
        self.own(df).createOrReplaceTempView(plain)
        return plain

    def own(self, df: DataFrame) -> DataFrame:
        """A frame of another session in this one."""
        if df.sparkSession is self.spark:
            return df
        return DataFrame(self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, df._jdf.logicalPlan()), self.spark)


def narrow_sql(session: Session, text: str, inputs: dict[str, DataFrame], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Pipeline SQL over named inputs: stateless plans only, change kinds carried along.

    `dynamic_table_check` becomes a column that a join against the table made beforehand.
    """
    asked = lookup.checks(text) if tables else []
    names: dict[str, str] = {}
    for name, df in inputs.items():
        df = with_op(session.own(df))
        for n, (table, value) in enumerate(asked):
            df = lookup.check(df.withColumn(f"_value_{n}", F.expr(library.ready(session.spark, library.rewritten(value)))), session.own(tables[table]), f"_value_{n}", f"_check_{n}").drop(f"_value_{n}")
        names[name] = session.view(f"in_{name}", df)
    count = iter(range(len(asked)))
    sql = library.rewritten(text, library.TYPED | ({"dynamic_table_check": lambda args: f"`_check_{next(count)}`"} if asked else {}))
    for name, view in sorted(names.items(), key=lambda x: -len(x[0])):
        sql = renamed(sql, name, view)
    sql = dialect.by_types(session.spark, sql, any(wide.concerns("", session.spark.table(v)) for v in names.values()))
    validate.check(session.spark.sql(library.ready(session.spark, sql)))
    df = session.spark.sql(_carried(sql))
    hidden = [c for c in df.columns if c.startswith("_check_")]
    if wide.concerns(sql) or any(wide.concerns("", session.spark.table(v)) for v in names.values()):
        df = wide.marked(df, wide.Plan(df, _carried(sql)).columns())
    return with_op(df.drop(*hidden))


def renamed(sql: str, name: str, view: str) -> str:
    """`sql` with table `name` (dotted or not) read from `view`."""
    from rillflow.functions.sqltext import tokens

    parts, out, at = tokens(sql), [], 0
    want = name.lower().split(".")
    while at < len(parts):
        k, have = at, []
        for n, w in enumerate(want):
            if n and not (k < len(parts) and parts[k] == ("other", ".")):
                break
            k += 1 if n else 0
            if k < len(parts) and parts[k][0] in ("word", "quoted") and parts[k][1].strip('"`').lower() == w:
                have.append(w)
                k += 1
        behind = "".join(out).rstrip()
        last = behind.split()[-1].lower() if behind.split() else ""
        if have == want and (last in ("from", "join") or behind.endswith(",")) and not (k < len(parts) and parts[k][1] in (".", "(")) and last in ("from", "join"):
            after = next((t for t in parts[k:] if t[0] != "space"), ("other", ";"))
            plain = after[0] in ("word", "quoted") and after[1].lower() not in ("where", "union", "group", "order", "limit", "having", "lateral", "cross", "join", "inner", "left", "on", "window")
            out.append(view if plain or after[1].lower() == "as" else f"{view} AS `{want[-1]}`")
            at = k
        else:
            out.append(parts[at][1])
            at += 1
    return "".join(out)


def _carried(sql: str) -> str:
    """Adds the change kind to the SELECT lists of the query, its derived tables and its CTEs; subqueries in expressions keep theirs."""
    from rillflow.functions.dialect import Group, _solid, _text, _tree, _word

    def level(nodes: list) -> str:
        """One bracket's SELECTs, which UNION may join."""
        starts = [k for k, n in enumerate(nodes) if _word(n) == "select"]
        unions = any(_word(n) == "union" for n in nodes)
        at, out = 0, ""
        for n, start in enumerate(starts):
            stop = starts[n + 1] if n + 1 < len(starts) else len(nodes)
            end = next((k for k in range(start, stop) if _word(nodes[k]) == "union"), stop)
            source = next((k for k in range(start, end) if _word(nodes[k]) == "from" and not _distinct(nodes, k)), -1)
            listed = nodes[start + 1 : source if source >= 0 else end]
            out += inside(nodes[at:start]) + "select"
            out += inside(listed)
            words = [x for x in listed if not (not isinstance(x, Group) and x[0] == "space")]
            named = any(not isinstance(x, Group) and x[1].strip('`"') == OP for x in listed)
            star = any(x == ("other", "*") and (k + 1 == len(words) or words[k + 1] == ("other", ",")) and (not k or words[k - 1] in (("other", ","), ("other", "."))) for k, x in enumerate(words))
            if source >= 0 and not named and not star and not (words and _word(words[0]) == "distinct"):
                out += f", {OP} "
            elif source < 0 and unions and not named:
                # A branch of a union that reads no table inserts.
                out += f" , '{INSERT}' AS {OP} "
            out += inside(nodes[source:end], True) if source >= 0 else ""
            at = end
        return out + inside(nodes[at:])

    def inside(nodes: list, tables: bool = False) -> str:
        out = ""
        for k, n in enumerate(nodes):
            if isinstance(n, Group):
                before = _word(nodes[b]) if (b := _solid(nodes, k - 1, -1)) >= 0 and k else ""
                first = _word(n[f]) if (f := _solid(n, 0)) >= 0 else ""
                # FROM (SELECT ...), or WITH x AS (SELECT ...) outside of a SELECT list.
                deep = first in ("select", "with") and (before in ("from", "join") or (before == "as" and not tables))
                out += n.opening + (level(n) if deep else _text(n)) + (")" if n.opening == "(" else "]")
            else:
                out += n[1]
        return out

    return level(_tree(sql))


def _distinct(nodes: list, at: int) -> bool:
    """Whether the FROM at `at` is that of IS [NOT] DISTINCT FROM."""
    from rillflow.functions.dialect import _solid, _word

    before = _solid(nodes, at - 1, -1)
    two = _solid(nodes, before - 1, -1) if before > 0 else -1
    return before >= 0 and _word(nodes[before]) == "distinct" and two >= 0 and _word(nodes[two]) in ("is", "not")


def script(df: DataFrame, process: Callable[[dict], dict | list | None], schema: str | None = None) -> DataFrame:
    """`process` on each row as a dict: a dict replaces it, a list makes several rows, None drops it; missing columns are NULL."""
    kind = df.schema if schema is None else None
    ddl = schema or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind.fields)
    if OP in df.columns and OP not in ddl:
        ddl += f", `{OP}` string"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for row in b.to_pylist():
                op = row.get(OP)
                made = process(row)
                for r in made if isinstance(made, list) else [] if made is None else [made]:
                    rows.append({OP: op, **r} if op is not None else r)
            yield pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in arrow} for r in rows], arrow)

    return df.mapInArrow(run, ddl)


def handler(df: DataFrame, options: dict) -> DataFrame:
    """Rows through an HTTP endpoint; `schema_override` adds, retypes (a type) or removes (null) columns.

    Answers are rows in the order sent; those beyond the rows sent are inserts.
    """
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for name, kind in (options.get("schema_override") or {}).items():
        if kind is None:
            fields.pop(name, None)
        else:
            fields[name] = connect.schema_ddl({name: kind}).split(" ", 1)[1]
    ddl = ", ".join(f"`{n}` {k}" for n, k in fields.items())
    asked = F.to_json(F.struct(*[c for c in df.columns if c != OP]), {"ignoreNullFields": "false"})
    rows = df.select(F.col(OP), asked.alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rebatched(batches, int(options.get("batch_size", 1000))):
            ops, bodies = b.column(0).to_pylist(), b.column(1).to_pylist()
            sent = [sinks.payload(options, o, r) for o, r in zip(ops, bodies)]
            if options.get("one_row_per_request"):
                got = [json.loads(sinks.post(options, s)) for s in sent]
            else:
                got = json.loads(sinks.post(options, sent)) if sent else []
            got = [g.get("data", g) if int(options.get("payload_version", 0)) == 1 else g for g in got]
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(g) for g in got], pa.string()), pa.array((ops + [INSERT] * len(got))[: len(got)], pa.string())], ["row", "op"])

    made = rows.mapInArrow(run, "row string, op string")
    body = ", ".join(f"`{n}` {k}" for n, k in fields.items() if n != OP)
    return made.select(F.from_json("row", body).alias("_row_"), F.col("op").alias(OP)).select("_row_.*", OP) if ddl else made


class Pipeline:
    def __init__(self, spark: SparkSession, raw: str | dict | Spec, plugins: Plugins | None = None, state=None, state_path: str | None = None):
        self.plugins = plugins or Plugins()
        self.session = Session(spark, self.plugins)
        self.spec = raw if isinstance(raw, Spec) else load(raw, self.plugins.preprocessors, self.plugins.kinds())
        self.state = state or MemoryState()
        #: A plugin's part of the store, which outlives a restart where the store does.
        self.plugins.state = lambda name: Scoped(self.state, name)
        self.tables = {n: lookup.DynamicTable(self.session.spark, n, f"{state_path}/{t.options.get('backend_entity_name', n)}" if state_path and str(t.options.get("backend_type", "")).lower() == "postgres" else None) for n, t in self.spec.transforms.items() if t.kind == "dynamic_table"}

    def outputs(self, frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """All nodes' frames from those of the sources. Dynamic tables are filled before what asks them."""
        frames = dict(frames)
        for name in self.spec.order:
            frames[name] = self._transform(self.spec.transforms[name], frames)
        return frames

    def _transform(self, t: Node, frames: dict[str, DataFrame]) -> DataFrame:
        o = t.options
        if t.kind == "dynamic_table":
            table = self.tables[t.name]
            if o.get("sql"):
                rows = narrow_sql(self.session, o["sql"], {i: frames[i] for i in t.inputs}).drop(OP)
                table.append(rows.select(F.col(rows.columns[0]).cast("string")) if len(rows.columns) == 1 else rows)
            return table.rows()
        if t.kind == "sql":
            tables = {n: self.tables[n].rows() for n in o["_checks"]}
            df = narrow_sql(self.session, o["sql"], {i: placed(frames[i], o.get("parallelism"), t.primary_key if set(t.primary_key) <= set(frames[i].columns) else None) for i in t.inputs}, tables)
            missing = [k for k in t.primary_key if k not in df.columns]
            if missing:
                raise SpecError(f"{t.name}: its primary key {', '.join(missing)} isn't selected")
            return df
        source = frames[t.inputs[0]]
        if t.kind == "script":
            process = o["script"] if callable(o["script"]) else _compiled(t.name, o)
            return script(source, process, connect.schema_ddl(o["schema"]) if o.get("schema") else None)
        if t.kind == "handler":
            return handler(source, o)
        return with_op(self.plugins.transforms[t.kind](source, o))

    # ---- running ----

    def _write(self, frames: dict[str, DataFrame], epoch: int) -> None:
        for name, hooks in self.plugins.side_outputs.items():
            for hook in hooks:
                hook(frames[name], epoch)
        out = self.outputs(frames)
        shared = [i for i in {s.options["from"] for s in self.spec.sinks.values()} if sum(s.options["from"] == i for s in self.spec.sinks.values()) > 1]
        for i in shared:
            out[i] = out[i].persist()
        for s in self.spec.sinks.values():
            df = out[s.options["from"]]
            missing = [k for k in s.primary_key if k not in df.columns]
            if missing:
                raise SpecError(f"{s.name}: its primary key {', '.join(missing)} isn't there")
            sinks.checked_decimals(df, s)
            sinks.open_sink(self.session.spark, s, self.plugins.sinks).write(df, epoch)
        for i in shared:
            out[i].unpersist()

    def frames(self) -> dict[str, DataFrame]:
        """Every node as a batch, unwritten."""
        return self.outputs({n: self.session.own(connect.open_source(self.session.spark, s, False, self.plugins.sources)) for n, s in self.spec.sources.items()})

    def sample(self, node: str, n: int = 10) -> list[dict]:
        """A few rows of a node, as live inspection shows them."""
        return [json.loads(r) for r in self.frames()[node].limit(n).toJSON().collect()]

    def explain(self) -> dict[str, list[str]]:
        """Dry run: node names of each transform's analysed plan."""
        return {n: validate.node_names(df) for n, df in self.frames().items()}

    def run(self, mode: str = "batch", checkpoint: str | None = None, poll: str = "5s"):
        """`batch` reads all sources to their end. `available_now` and `continuous` stream one source; the latter returns the query."""
        for s in self.spec.sinks.values():
            s.options.pop("_seen", None)
        if mode == "batch":
            self._write({n: self.session.own(connect.open_source(self.session.spark, s, False, self.plugins.sources)) for n, s in self.spec.sources.items()}, (self.state.get("epoch") or 0) + 1)
            self.state.put("epoch", (self.state.get("epoch") or 0) + 1)
            return None
        if len(self.spec.sources) != 1:
            raise SpecError("a stream has one source; use batch mode for more")
        (name, source), = self.spec.sources.items()
        base = self.state.get("epoch") or 0
        if source.kind == "hybrid":
            source, base = self._bounded_phases(name, source, mode), self.state.get("epoch") or 0
            if source is None:
                return None
        if mode == "available_now" and source.kind not in ("file", *self.plugins.sources):
            raise SpecError(f"{name}: a job ends only with bounded sources")
        stream = connect.open_source(self.session.spark, source, True, self.plugins.sources)

        def each(batch: DataFrame, epoch: int) -> None:
            self._write({name: self.session.own(batch)}, base + epoch + 1)

        writer = stream.writeStream.foreachBatch(each)
        if checkpoint:
            writer = writer.option("checkpointLocation", checkpoint)
        query = writer.trigger(availableNow=True).start() if mode == "available_now" else writer.trigger(processingTime=f"{seconds(poll)} seconds").start()
        if mode == "available_now":
            query.awaitTermination()
        return query

    def stop(self, query, policy: str = "auto") -> None:
        """Ends a running query: `drain` first works off what has arrived, `fast` doesn't, `auto` drains bounded sources only."""
        if policy not in ("auto", "drain", "fast"):
            raise SpecError(f"no drain policy {policy}")
        if policy == "drain" or (policy == "auto" and all(connect.bounded(s) for s in self.spec.sources.values())):
            query.processAllAvailable()
        query.stop()

    def _bounded_phases(self, name: str, source: Node, mode: str) -> Node | None:
        """Runs the bounded phases that aren't done yet; the unbounded source, or None for a job."""
        phases = len(source.options["bounded_sources"])
        for n in range(self.state.get(f"{name}.phase") or 0, phases):
            if n == phases - 1 and self.state.get(f"{name}.since") is None:
                # What arrives while the last phase is read belongs to the unbounded source.
                self.state.put(f"{name}.since", int(time.time() * 1000))
            epoch = (self.state.get("epoch") or 0) + 1
            self._write({name: self.session.own(with_op(connect.hybrid_source(self.session.spark, source, False, n)))}, epoch)
            self.state.put("epoch", epoch)
            self.state.put(f"{name}.phase", n + 1)
        after = source.options.get("unbounded_source")
        return None if mode == "available_now" or not after else Node(name, after["source_type"], {"starting_timestamp": self.state.get(f"{name}.since"), **after}, primary_key=source.primary_key)


def _compiled(name: str, options: dict) -> Callable:
    """A Python script that defines `process`; JavaScript has no engine here."""
    if options.get("language", "python") != "python":
        raise SpecError(f"{name}: scripts are Python; there is no engine for {options['language']}")
    space: dict = {}
    exec(options["script"], space)  # noqa: S102
    return space["process"]
