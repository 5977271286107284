"""Sources: what a node of a specification reads, as a batch or as a stream.

Kafka, Avro and JDBC need their jars on the class path; without them Spark names the missing format.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.operators.changelog import latest_version
from rillflow.plans.spec import FORMATS, Node, SpecError
from rillflow.rowkind import DELETE, INSERT, OP, from_captured, with_op

# Declared types of the pipeline dialect and Spark's.
TYPES = {
    "boolean": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)",
    "float16": "float", "float32": "float", "float64": "double", "utf8": "string", "string": "string", "largeutf8": "string", "binary": "binary", "largebinary": "binary",
    "date32": "date", "date64": "date", "timestamp": "timestamp", "null": "void",
}


def schema_ddl(declared: dict[str, str]) -> str:
    """A declared schema as DDL; every field may be NULL."""
    out = []
    for name, kind in declared.items():
        k = kind.strip().lower().replace(" ", "")
        if k.startswith("decimal128") or k.startswith("decimal("):
            args = k[k.index("(") + 1 : -1] if "(" in k else "38,9"
            spark = f"decimal({args})" if int(args.split(",")[0]) <= 38 else "string"
        elif k.startswith("decimal"):
            spark = "string"
        elif k.startswith("timestamp"):
            spark = "timestamp" if "," in k and "none" not in k else "timestamp_ntz" if "(" in k else "timestamp"
        elif k.startswith("list<"):
            spark = f"array<{schema_ddl({'x': kind.strip()[5:-1]}).split(' ', 1)[1]}>"
        elif k in TYPES:
            spark = TYPES[k]
        else:
            raise SpecError(f"{name}: unknown type {kind}")
        out.append(f"`{name}` {spark}")
    return ", ".join(out)


def file_source(spark: SparkSession, node: Node, streaming: bool) -> DataFrame:
    """CSV, JSON lines, Parquet, ORC or Avro under a folder with subfolders or `key=value` partitions."""
    o = node.options
    kind = FORMATS.get(str(o.get("format", "")).lower())
    if not kind:
        raise SpecError(f"{node.name}: unknown file format {o.get('format')}")
    options = {"header": "true", "inferSchema": "true"} if kind == "csv" else {}
    if kind in ("parquet", "orc"):
        options["mergeSchema"] = "true"
    plain = spark.read.options(**options).format(kind)
    plain = plain.schema(schema_ddl(o["schema"])) if o.get("schema") else plain
    if "partitioned" in o and not o["partitioned"]:
        plain = plain.option("recursiveFileLookup", "true")
    found = _discovered(spark, plain, o["path"], kind, options, o)
    if streaming:
        reader = spark.readStream.format(kind).options(**options).schema(found.schema)
        if o.get("batch_files"):
            reader = reader.option("maxFilesPerTrigger", int(o["batch_files"]))
        found = reader.load(o["path"])
    out = with_op(wide_marked(found, o.get("schema") or {}))
    return out.where(o["filter"]) if o.get("filter") else out


def wide_marked(df: DataFrame, declared: dict[str, str]) -> DataFrame:
    """`df` whose columns of declared decimals beyond 38 digits, held as text, say so in their metadata."""
    wide = {}
    for name, kind in declared.items():
        k = kind.strip().lower().replace(" ", "")
        if k.startswith("decimal") and schema_ddl({name: kind}).endswith(" string"):
            wide[name] = k[k.index("(") + 1 : -1] if "(" in k else ""
    return df.select(*[F.col(f"`{c}`").alias(c, metadata={"decimal_arb": wide[c]}) if c in wide else F.col(f"`{c}`") for c in df.columns]) if wide else df


def _discovered(spark: SparkSession, reader, path: str, kind: str, options: dict, o: dict) -> DataFrame:
    """Partition columns where folders are named so; else every file below the folder."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(top) and system.getFileStatus(top).isDirectory():
        folders = [f.getPath().getName() for f in system.listStatus(top) if f.isDirectory() and not f.getPath().getName().startswith(("_", "."))]
        if folders and not all("=" in f for f in folders):
            return reader.option("recursiveFileLookup", "true").load(path)
    return reader.load(path)


def jdbc_options(node: Node, url: str, table: str) -> dict[str, str]:
    """A bounded read in half-open ranges of one column."""
    o = node.options
    out = {"url": url, "dbtable": table}
    if o.get("range_column"):
        out |= {"partitionColumn": o["range_column"], "lowerBound": str(o["range_start"]), "upperBound": str(o["range_end"]), "numPartitions": str(o.get("parallelism", 8))}
    for k in ("user", "password", "driver"):
        if k in o:
            out[k] = str(o[k])
    return out


def database_source(spark: SparkSession, node: Node, streaming: bool) -> DataFrame:
    """`columns`, `filter`, `start_at`; versions of a key are merged if `version_column` is named; `is_deleted` gives the change kind."""
    o = node.options
    table = o.get("table_name") or o.get("table")
    df = spark.read.format("jdbc").options(**jdbc_options(node, o["url"], table)).load()
    return shaped_history(df, node)


def shaped_history(df: DataFrame, node: Node) -> DataFrame:
    o = node.options
    if o.get("filter"):
        df = df.where(o["filter"])
    if o.get("start_at") is not None:
        df = df.where(F.col(o.get("range_column") or df.columns[0]) >= F.lit(o["start_at"]))
    if o.get("version_column"):
        df = latest_version(df, node.primary_key, o["version_column"], "is_deleted" if "is_deleted" in df.columns else None)
    if "is_deleted" in df.columns:
        df = df.withColumn(OP, F.when(F.col("is_deleted").cast("int") == 1, DELETE).otherwise(INSERT)).drop("is_deleted")
    df = with_op(df)
    return df.select(*o["columns"], OP) if o.get("columns") else df


def kafka_options(node: Node) -> dict[str, str]:
    o = node.options
    start = {"earliest": "earliest", "latest": "latest"}.get(str(o.get("start_at", o.get("starting_offsets", "earliest"))).lower(), None) or str(o["starting_offsets"])
    since = o.get("starting_timestamp")
    first = {"startingOffsets": start} if since is None else {"startingTimestamp": str(since)}
    return {"kafka.bootstrap.servers": str(o.get("bootstrap_servers", "localhost:9092")), "subscribe": o["topic"], **first, "includeHeaders": "true"}


def decoded(records: DataFrame, node: Node) -> DataFrame:
    """Kafka records as rows: JSON against a declared schema, or Avro; change kinds from the `dbz.op` header; `include_metadata`."""
    o = node.options
    header = F.filter("headers", lambda h: h["key"] == "dbz.op")
    code = F.get(header, 0)["value"].cast("string")
    if o.get("data_format", "json") == "json":
        body = F.from_json(F.col("value").cast("string"), schema_ddl(o["schema"]), {"mode": "FAILFAST"})
    else:
        from pyspark.sql.avro.functions import from_avro

        # Five bytes of the registry's framing stand before the record.
        body = from_avro(F.expr("substring(value, 6)"), o["avro_schema"])
    metadata = [F.col("partition").alias("__kafka_partition"), F.col("offset").alias("__kafka_offset"), F.unix_millis("timestamp").alias("__kafka_timestamp")] if o.get("include_metadata") else []
    out = records.select(body.alias("_body_"), from_captured(code).alias(OP), *metadata).select("_body_.*", *[c for c in ("__kafka_partition", "__kafka_offset", "__kafka_timestamp") if metadata], OP)
    return out.where(o["filter"]) if o.get("filter") else out


def kafka_source(spark: SparkSession, node: Node, streaming: bool) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return decoded(reader.format("kafka").options(**kafka_options(node)).load(), node)


def memory_source(spark: SparkSession, node: Node, streaming: bool) -> DataFrame:
    """A DataFrame, or rows and a schema, given in the specification."""
    o = node.options
    df = o["data"] if isinstance(o.get("data"), DataFrame) else spark.createDataFrame(o.get("rows", []), o["schema"])
    return with_op(df)


def hybrid_source(spark: SparkSession, node: Node, streaming: bool, phase: int | None = None) -> DataFrame:
    """The bounded phases in order; the unbounded one is started by the runner when they are done."""
    phases = node.options["bounded_sources"]
    if phase is not None:
        phases = phases[phase : phase + 1]
    frames = [open_source(spark, Node(node.name, p["source_type"], p, primary_key=node.primary_key), False) for p in phases]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


READERS: dict[str, Callable[[SparkSession, Node, bool], DataFrame]] = {
    "file": file_source, "memory": memory_source, "jdbc": database_source, "clickhouse": database_source, "kafka": kafka_source, "hybrid": hybrid_source,
}


def open_source(spark: SparkSession, node: Node, streaming: bool, plugins: dict | None = None) -> DataFrame:
    read = (plugins or {}).get(node.kind) or READERS.get(node.kind)
    if read is None:
        raise SpecError(f"{node.name}: no source of type {node.kind}")
    return with_op(read(spark, node, streaming))


def bounded(node: Node) -> bool:
    """Whether a source ends by itself."""
    mode = node.options.get("mode")
    kind = mode.get("type") if isinstance(mode, dict) else mode
    return node.kind in ("memory", "jdbc", "clickhouse", "hybrid") or (node.kind == "file" and kind == "bounded") or bool(node.options.get("bounded"))
