"""Queries over the test tables, one or more an operator, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions import decimals
from rillflow.operators import changelog, lookup, relational
from rillflow.plans.pipeline import Pipeline, Session, narrow_sql
from rillflow.rowkind import OP

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "labels", "embeddings")


def _query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _pipeline(spark: SparkSession, sf_dir: str, table: str, sql: str, key: str) -> DataFrame:
    spec = {
        "sources": {table: {"type": "file", "format": "parquet", "path": f"{sf_dir}/{table}.parquet", "mode": {"type": "bounded"}}},
        "transforms": {"out": {"type": "sql", "primary_key": key, "sql": sql}},
        "sinks": {"kept": {"type": "memory", "from": "out"}},
    }
    return Pipeline(spark, spec).frames()["out"]


def _session(spark: SparkSession, sf_dir: str, *tables: str) -> Session:
    s = Session(spark)
    for t in tables:
        s.spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return s


def _narrow(name: str, table: str, key: str, sql: str, oracle: str | None = None) -> None:
    """A pipeline's SQL transform; unless given, its twin is the same text with a constant change kind."""
    _query(name, oracle or sql.replace(" FROM ", f", 'i' AS {OP} FROM ", 1))(lambda spark, d: _pipeline(spark, d, table, sql, key))


def _wide(name: str, tables: str, sql: str, oracle: str | None = None) -> None:
    """Session SQL: everything that Spark plans, with the function library."""
    _query(name, oracle or sql)(lambda spark, d: _session(spark, d, *tables.split()).sql(sql))


# ---- pipeline SQL ----------------------------------------------------------------------------------

_narrow("flagship_filter_project", "events", "event_id", "SELECT event_id, user_id, value * 1.1 AS v FROM events WHERE event_type = 'purchase'", f"SELECT event_id, user_id, value * 1.1::DOUBLE AS v, 'i' AS {OP} FROM events WHERE event_type = 'purchase'")
_narrow("predicates", "lineitem", "l_orderkey", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS size FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity BETWEEN 5 AND 40 AND l_linestatus IS NOT NULL AND NOT l_returnflag = 'R'")
_narrow("like_and_distinct_from", "part", "p_partkey", "SELECT p_partkey, p_name || '-' || p_brand AS label FROM part WHERE p_name LIKE '%a%' AND p_size IS DISTINCT FROM 7")
_narrow("derived_table_and_cte", "orders", "o_orderkey", "WITH w AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 1000) SELECT o_orderkey, c FROM (SELECT o_orderkey, o_custkey AS c FROM w) AS x WHERE c % 2 = 0", f"SELECT o_orderkey, o_custkey AS c, 'i' AS {OP} FROM orders WHERE o_totalprice > 1000 AND o_custkey % 2 = 0")
_narrow("union_all", "orders", "o_orderkey", "SELECT o_orderkey, 'low' AS band FROM orders WHERE o_totalprice < 1000 UNION ALL SELECT o_orderkey, 'high' AS band FROM orders WHERE o_totalprice > 5000", f"SELECT o_orderkey, 'low' AS band, 'i' AS {OP} FROM orders WHERE o_totalprice < 1000 UNION ALL SELECT o_orderkey, 'high', 'i' FROM orders WHERE o_totalprice > 5000")
_narrow("unnest_words", "part", "p_partkey", "SELECT p_partkey, explode(_gs_split_string_to_array(p_name, ' ')) AS word FROM part", f"SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, 'i' AS {OP} FROM part")
_narrow("casts", "lineitem", "l_orderkey", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS bigint) AS q, TRY_CAST(l_returnflag AS int) AS bad FROM lineitem")
_narrow("json_functions", "events", "event_id", "SELECT event_id, json_value(props, '$.k') AS k, json_exists(props, '$.zz') AS has_zz, is_json(props, 'OBJECT') AS ok, json_query(props, '$.k') AS nested FROM events", f"SELECT event_id, json_extract_string(props, '$.k') AS k, false AS has_zz, true AS ok, NULL::VARCHAR AS nested, 'i' AS {OP} FROM events")
_narrow("json_constructors", "nation", "n_nationkey", "SELECT n_nationkey, json_array(n_nationkey, n_name) AS a, json_object('key', n_nationkey, 'name', n_name) AS o, json_string(n_name) AS s FROM nation", f"""SELECT n_nationkey, '[' || n_nationkey || ',"' || n_name || '"]' AS a, '{{"key":' || n_nationkey || ',"name":"' || n_name || '"}}' AS o, '"' || n_name || '"' AS s, 'i' AS {OP} FROM nation""")
_narrow("text_functions", "part", "p_partkey", "SELECT p_partkey, split_index(p_name, ' ', 0) AS head, locate('a', p_name) AS at, instr(p_name, 'e') AS e, translate(p_brand, '#', '') AS brand, uppercase(p_name) AS up, charlength(p_name) AS n FROM part", f"SELECT p_partkey, string_split(p_name, ' ')[1] AS head, strpos(p_name, 'a')::BIGINT AS at, strpos(p_name, 'e')::BIGINT AS e, replace(p_brand, '#', '') AS brand, upper(p_name) AS up, length(p_name) AS n, 'i' AS {OP} FROM part")
_narrow("regex_functions", "part", "p_partkey", "SELECT p_partkey, regexp_extract(p_brand, '([0-9])([0-9]*)') AS digits, regexp_count(p_name, '[aeiou]') AS vowels, regexp_replace(p_name, '[aeiou]', '$') AS masked, regexp_extract(p_name, '(') AS bad FROM part", f"SELECT p_partkey, nullif(regexp_extract(p_brand, '([0-9])([0-9]*)', 0), '') AS digits, len(regexp_extract_all(p_name, '[aeiou]'))::BIGINT AS vowels, regexp_replace(p_name, '[aeiou]', '$', 'g') AS masked, NULL::VARCHAR AS bad, 'i' AS {OP} FROM part")
_narrow("number_texts", "orders", "o_orderkey", "SELECT o_orderkey, bin(o_orderkey) AS b, _gs_conv_base(o_orderkey, 10, 16) AS h, _gs_byte_to_hex(_gs_hex_to_byte('0a0b')) AS x, elt(2, 'a', o_orderstatus) AS s FROM orders", f"SELECT o_orderkey, bin(o_orderkey) AS b, lower(hex(o_orderkey)) AS h, '0a0b' AS x, o_orderstatus AS s, 'i' AS {OP} FROM orders")
_narrow("url_functions", "pages", "page_id", "SELECT page_id, parse_url(url, 'HOST') AS host, url_decode(url_encode(url)) AS url FROM pages", f"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, url, 'i' AS {OP} FROM pages")
_narrow("array_functions", "nation", "n_nationkey", "SELECT n_nationkey, array_element(_gs_generate_series(n_nationkey, n_nationkey + 4, 2), 2) AS second, size(array_remove_all(make_array(1, 2, 1), 1)) AS kept, array_has_any(make_array(n_regionkey), make_array(1, 2)) AS hit FROM nation", f"SELECT n_nationkey, (n_nationkey + 2)::BIGINT AS second, 1 AS kept, n_regionkey IN (1, 2) AS hit, 'i' AS {OP} FROM nation")
_narrow("hash_functions", "nation", "n_nationkey", "SELECT n_nationkey, md5(n_name) AS m, sha2(n_name, 256) AS s FROM nation", f"SELECT n_nationkey, md5(n_name) AS m, sha256(n_name) AS s, 'i' AS {OP} FROM nation")
_query("own_hashes")(lambda spark, d: _pipeline(spark, d, "nation", "SELECT n_nationkey, _gs_xxhash(n_name) AS x, _gs_keccak256(n_name) AS k, uuid7() AS u FROM nation", "n_nationkey"))


@_query("dynamic_table_lookup", f"SELECT o_orderkey, o_custkey, 'i' AS {OP} FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def dynamic_table_lookup(spark: SparkSession, d: str) -> DataFrame:
    s = _session(spark, d, "orders", "customer")
    table = lookup.DynamicTable(s.spark, "rich")
    table.append(s.spark.table("customer").where("c_acctbal > 5000").select(F.col("c_custkey").cast("string").alias("value")))
    return narrow_sql(s, "SELECT o_orderkey, o_custkey FROM orders WHERE dynamic_table_check('rich', o_custkey)", {"orders": s.spark.table("orders").withColumn(OP, F.lit("i"))}, {"rich": table.rows()})


@_query("dynamic_table_any_element", "SELECT p_partkey, bool_or(w IN (SELECT lower(n_name) FROM nation UNION SELECT string_split(p_name, ' ')[1] FROM part)) AS hit FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY p_partkey")
def dynamic_table_any_element(spark: SparkSession, d: str) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet")
    heads = part.select(F.get(F.split("p_name", " "), 0).alias("value"))
    names = spark.read.parquet(f"{d}/nation.parquet").select(F.lower("n_name").alias("value"))
    words = part.select("p_partkey", F.split("p_name", " ").alias("words"))
    return lookup.check(words, names.union(heads), "words", "hit").select("p_partkey", "hit")


# ---- changelog -------------------------------------------------------------------------------------

_KINDS = f"CASE event_type WHEN 'error' THEN 'd' WHEN 'view' THEN 'u' ELSE 'i' END AS {OP}"


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id", "user_id", "ts", "cast(value AS decimal(18,2)) AS amount", "event_type", _KINDS)


_CHANGES = f"(SELECT event_id, user_id, ts, value::DECIMAL(18,2) AS amount, event_type, {_KINDS} FROM events)"


@_query("keep_last", f"SELECT event_id, user_id, amount::DOUBLE AS amount, {OP} FROM {_CHANGES} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def keep_last(spark: SparkSession, d: str) -> DataFrame:
    return changelog.keep_last(_changes(spark, d), ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", F.col("amount").cast("double").alias("amount"), OP)


@_query("latest_version", f"SELECT event_id, user_id FROM (SELECT * FROM {_CHANGES} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE {OP} <> 'd'")
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    versions = _changes(spark, d).withColumn("gone", F.when(F.col(OP) == "d", 1).otherwise(0))
    return changelog.latest_version(versions, ["user_id"], "ts", "gone", ["event_id"]).select("event_id", "user_id")


@_query("landing_dedup", f"SELECT event_id, user_id, {OP} FROM {_CHANGES} QUALIFY row_number() OVER (PARTITION BY user_id, {OP} ORDER BY event_id DESC) = 1")
def landing_dedup(spark: SparkSession, d: str) -> DataFrame:
    return changelog.landed(_changes(spark, d), ["user_id"], ["event_id"]).select("event_id", "user_id", OP)


@_query(
    "upsert_merge",
    f"""WITH n AS (SELECT user_id, event_id, amount, {OP} FROM {_CHANGES} WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
    o AS (SELECT user_id, event_id, amount FROM {_CHANGES} WHERE event_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
    SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.event_id, o.event_id) AS event_id, (CASE WHEN n.user_id IS NOT NULL THEN n.amount ELSE o.amount END)::DOUBLE AS amount
    FROM o FULL JOIN n ON o.user_id = n.user_id WHERE coalesce({OP}, 'i') <> 'd'""",
)
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """All events: those of odd ids are the table, those of even ids the changes."""
    changes = _changes(spark, d).select("user_id", "event_id", "amount", OP)
    current = changelog.keep_last(changes.where("event_id % 2 = 1"), ["user_id"], ["event_id"]).drop(OP)
    return changelog.upsert(current, changes.where("event_id % 2 = 0"), ["user_id"], ["event_id"]).withColumn("amount", F.col("amount").cast("double"))


_SIGNED = f"sum(CASE WHEN {OP} = 'd' THEN -amount ELSE amount END)"
_ONES = f"sum(CASE {OP} WHEN 'd' THEN -1 WHEN 'u' THEN 0 ELSE 1 END)::BIGINT"


@_query("incremental_aggregate", f"SELECT event_type, {_SIGNED}::DOUBLE AS total, {_ONES} AS n, min(amount)::DOUBLE AS low, max(amount)::DOUBLE AS high, {_SIGNED}::DOUBLE AS mean_sum, {_ONES} AS mean_count FROM {_CHANGES} GROUP BY event_type")
def incremental_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Two batches merged one after the other."""
    measures = {"total": {"fn": "sum", "from": "amount", "type": "decimal(28,2)"}, "n": {"fn": "count"}, "low": {"fn": "min", "from": "amount"}, "high": {"fn": "max", "from": "amount"}, "mean": {"fn": "avg", "from": "amount", "type": "decimal(28,2)"}}
    rows, state = _changes(spark, d), None
    for part in (rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")):
        state = changelog.merge_aggregate(state, changelog.batch_aggregate(part, ["event_type"], measures), ["event_type"], measures)
    return state.withColumns({c: F.col(c).cast("double") for c in ("total", "low", "high", "mean_sum")})


@_query("global_aggregate", f"SELECT 'value' AS key, {_ONES} AS n FROM {_CHANGES}")
def global_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return changelog.batch_aggregate(_changes(spark, d), [], {"n": {"fn": "count"}})


@_query("replacing_rows", f"SELECT event_id, CASE WHEN {OP} = 'd' THEN 1 ELSE 0 END AS is_deleted FROM {_CHANGES}")
def replacing_rows(spark: SparkSession, d: str) -> DataFrame:
    return changelog.replacing_rows(_changes(spark, d), "ts").select("event_id", F.col("is_deleted").cast("int").alias("is_deleted"))


@_query("script_rows", f"SELECT n_nationkey, n_name || '_x' AS n_name, 'i' AS {OP} FROM nation WHERE n_regionkey <> 0 UNION ALL SELECT n_nationkey + 100, n_name, 'i' FROM nation WHERE n_regionkey = 1")
def script_rows(spark: SparkSession, d: str) -> DataFrame:
    from rillflow.plans.pipeline import script

    def process(row: dict):
        if row["n_regionkey"] == 0:
            return None
        one = {"n_nationkey": row["n_nationkey"], "n_name": row["n_name"] + "_x"}
        return [one, {"n_nationkey": row["n_nationkey"] + 100, "n_name": row["n_name"]}] if row["n_regionkey"] == 1 else one

    return script(spark.read.parquet(f"{d}/nation.parquet").withColumn(OP, F.lit("i")), process, "n_nationkey int, n_name string")


@_query("unnest_lockstep", "WITH l AS (SELECT n_regionkey AS r, range(0, n_regionkey) AS a, range(10, 10 + n_regionkey + 1) AS b FROM (SELECT DISTINCT n_regionkey FROM nation)) SELECT r, i - 1 AS k, a[i] AS a, b[i] AS b FROM (SELECT *, unnest(range(1, len(b) + 1)) AS i FROM l)")
def unnest_lockstep(spark: SparkSession, d: str) -> DataFrame:
    lists = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_regionkey").cast("bigint").alias("r")).distinct()
    series = lambda a, n: F.transform(F.sequence(F.lit(0), F.lit(20)), lambda x: x.cast("bigint") + a)
    lists = lists.withColumn("a", F.slice(series(0, 0), 1, F.col("r").cast("int"))).withColumn("b", F.slice(series(10, 0), 1, (F.col("r") + 1).cast("int"))).withColumn("k", F.slice(series(0, 0), 1, (F.col("r") + 1).cast("int")))
    return relational.unnest(lists, ["k", "a", "b"])


# ---- session SQL -----------------------------------------------------------------------------------

_wide("group_having", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS decimal(18,2))) AS double) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 1")
_wide("filtered_aggregate", "orders", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 1000) AS n, count(DISTINCT o_custkey) AS c FROM orders GROUP BY o_orderstatus")
_wide("rollup", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_wide("cube", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
_wide("grouping_sets", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
_wide("select_distinct", "orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
_wide("inner_join", "orders customer", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
_wide("using_join", "nation region", "SELECT n_name, r_name FROM nation JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) AS r USING (n_regionkey)")
_wide("left_join", "customer orders", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
_wide("full_join", "supplier customer", "SELECT s.s_suppkey AS s, c.c_custkey AS c FROM supplier AS s FULL JOIN customer AS c ON s.s_suppkey = c.c_custkey + 50")
_wide("semi_and_anti", "customer orders", "SELECT c_custkey, 'has' AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT c_custkey, 'none' AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
_wide("theta_join", "nation region", "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey < r_regionkey")
_wide("scalar_subquery", "orders", "SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
_wide("set_operations", "orders customer", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 EXCEPT SELECT c_custkey AS k FROM customer WHERE c_nationkey = 3")
_wide("union_distinct", "nation region", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey AS k FROM region")
_wide("ranking_windows", "customer", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS rk, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS dr, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS nt FROM customer")
_wide("frame_windows", "orders", "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS decimal(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS double) AS run, count(*) OVER (PARTITION BY o_custkey) AS n, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, max(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS last FROM orders")
_wide("top_k", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
_wide("ordered_lists", "nation", "SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
_wide("json_aggregates", "nation", "SELECT n_regionkey, json_objectagg_null_on_null(n_name, n_nationkey) AS o FROM nation GROUP BY n_regionkey", """SELECT n_regionkey, '{' || string_agg('"' || n_name || '":' || n_nationkey, ',' ORDER BY n_name) || '}' AS o FROM nation GROUP BY n_regionkey""")
_wide("statistics_aggregates", "part", "SELECT p_type, round(avg(p_size), 6) AS a, round(stddev_samp(p_size), 6) AS s, bool_or(p_size > 40) AS big, min(p_name) AS first FROM part GROUP BY p_type", "SELECT p_type, round(avg(p_size), 6) AS a, round(stddev_samp(p_size), 6) AS s, bool_or(p_size > 40) AS big, min(p_name) AS first FROM part GROUP BY p_type")


# ---- wide decimals ---------------------------------------------------------------------------------


_MEAN = "sum(l_extendedprice::DECIMAL(18,2))"


@_query("decimal_sum_avg", f"""SELECT l_returnflag, {_MEAN}::DECIMAL(38,2)::VARCHAR AS s, min(l_extendedprice::DECIMAL(18,2))::VARCHAR AS low, max(l_extendedprice::DECIMAL(18,2))::VARCHAR AS high,
    (((({_MEAN} * 1000)::DECIMAL(38,0)::HUGEINT // count(*)) + CASE WHEN 2 * (({_MEAN} * 1000)::DECIMAL(38,0)::HUGEINT % count(*)) > count(*) OR (2 * (({_MEAN} * 1000)::DECIMAL(38,0)::HUGEINT % count(*)) = count(*) AND (({_MEAN} * 1000)::DECIMAL(38,0)::HUGEINT // count(*)) % 2 = 1) THEN 1 ELSE 0 END)::DECIMAL(34,0) * 0.001::DECIMAL(4,3))::DECIMAL(38,3)::VARCHAR AS mean
    FROM lineitem GROUP BY l_returnflag""")
def decimal_sum_avg(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", F.col("l_extendedprice").cast("decimal(18,2)").alias("p"))
    return decimals.aggregated(rows, ["l_returnflag"], {"s": ("sum", "p", 18, 2), "low": ("min", "p", 18, 2), "high": ("max", "p", 18, 2), "mean": ("avg", "p", 18, 2)})


@_query("wide_decimal_aggregates", "SELECT n_regionkey, (sum(n_nationkey)::HUGEINT::VARCHAR || repeat('0', 40) || '.00') AS s, (min(n_nationkey)::VARCHAR || CASE WHEN min(n_nationkey) > 0 THEN repeat('0', 40) ELSE '' END || '.00') AS low, (max(n_nationkey)::VARCHAR || repeat('0', 40) || '.00') AS high FROM nation GROUP BY n_regionkey")
def wide_decimal_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """Values of up to 44 digits."""
    s = _session(spark, d, "nation")
    rows = s.sql("SELECT n_regionkey, decimal_arb_mul(to_decimal_arb_from_int(n_nationkey, 20, 0), '10000000000000000000000000000000000000000.00') AS v FROM nation")
    return decimals.aggregated(rows, ["n_regionkey"], {"s": ("sum", "v", 63, 2), "low": ("min", "v", 63, 2), "high": ("max", "v", 63, 2)})


_wide("decimal_arithmetic", "part", "SELECT p_partkey, decimal_arb_mul(CAST(CAST(p_retailprice AS decimal(12,2)) AS string), '3.25') AS m, decimal_arb_add(CAST(p_size AS string), '0.50') AS a, decimal_arb_gt(CAST(p_size AS string), '9.5') AS g FROM part", "SELECT p_partkey, (p_retailprice::DECIMAL(12,2) * 3.25::DECIMAL(4,2))::DECIMAL(20,4)::VARCHAR AS m, (p_size + 0.50)::DECIMAL(12,2)::VARCHAR AS a, p_size > 9.5 AS g FROM part")


# ---- forms of the dialect --------------------------------------------------------------------------

_I = f"'i' AS {OP}"
_narrow("unnest_list", "part", "p_partkey", "SELECT p_partkey, unnest(_gs_split_string_to_array(p_name, ' ')) AS word FROM part WHERE p_size > 5", f"SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, {_I} FROM part WHERE p_size > 5")
_narrow("unnest_two_lists", "nation", "n_nationkey", "SELECT n_nationkey, unnest([n_regionkey, n_nationkey, 7]) AS a, unnest([n_name, 'x']) AS b FROM nation", f"SELECT n_nationkey, unnest([n_regionkey, n_nationkey, 7]) AS a, unnest([n_name, 'x']) AS b, {_I} FROM nation")
_narrow("unnest_nested", "nation", "n_nationkey", "SELECT n_nationkey, unnest(unnest([[n_regionkey, 1], [2]])) AS a FROM nation", f"SELECT n_nationkey, unnest([n_regionkey, 1, 2]) AS a, {_I} FROM nation")
_narrow("unnest_in_derived_table", "nation", "n_nationkey", f"SELECT n_nationkey, md5(repeat(item, 3)) AS h, {OP} FROM (SELECT n_nationkey, unnest(make_array(n_name, 'z')) AS item, {OP} FROM nation WHERE n_regionkey > 0) AS t", f"SELECT n_nationkey, md5(repeat(item, 3)) AS h, {_I} FROM (SELECT n_nationkey, unnest([n_name, 'z']) AS item FROM nation WHERE n_regionkey > 0)")
_narrow("cross_join_unnest", "part", "p_partkey", "SELECT p_partkey, u.word FROM part CROSS JOIN UNNEST(_gs_split_string_to_array(p_name, ' ')) AS u(word) WHERE length(u.word) > 4", f"SELECT p_partkey, word, {_I} FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) WHERE length(word) > 4")
_narrow("cross_join_unnest_structs", "nation", "n_nationkey", "SELECT n_nationkey, f0, f1 FROM nation CROSS JOIN UNNEST(_gs_zip_arrays([n_regionkey, 9], [n_name, 'x'])) AS z(f0, f1)", f"SELECT n_nationkey, unnest([n_regionkey, 9]) AS f0, unnest([n_name, 'x']) AS f1, {_I} FROM nation")
_narrow("whole_division", "orders", "o_orderkey", "SELECT o_orderkey, o_orderkey / 7 AS q, (o_orderkey / 3) / 2 AS twice, -o_orderkey / 2 AS neg, o_orderkey % 7 AS r, o_totalprice / 2 AS half FROM orders", f"SELECT o_orderkey, (o_orderkey // 7)::BIGINT AS q, ((o_orderkey // 3) // 2)::BIGINT AS twice, (-(o_orderkey // 2))::BIGINT AS neg, o_orderkey % 7 AS r, o_totalprice / 2 AS half, {_I} FROM orders")
_narrow("subscripts", "part", "p_partkey", "SELECT p_partkey, _gs_split_string_to_array(p_name, ' ')[1] AS head, [p_size, 9][2] AS nine, [p_size][5] AS none, map('k', p_brand)['k'] AS brand, named_struct('s', p_size)['s'] AS s, named_struct('l', [p_size, 3]).l[1] AS l FROM part", f"SELECT p_partkey, string_split(p_name, ' ')[1] AS head, 9 AS nine, NULL::INT AS none, p_brand AS brand, p_size AS s, p_size AS l, {_I} FROM part")
_narrow("concatenation", "customer", "c_custkey", "SELECT c_custkey, concat(c_name, nullif(c_mktsegment, 'BUILDING'), c_nationkey) AS t, c_name || '-' || c_mktsegment AS u, concat_ws('/', c_name, 'x') AS w, array_join(concat(['a'], [c_name]), ',') AS l FROM customer", f"SELECT c_custkey, concat(c_name, nullif(c_mktsegment, 'BUILDING'), c_nationkey) AS t, c_name || '-' || c_mktsegment AS u, concat_ws('/', c_name, 'x') AS w, 'a,' || c_name AS l, {_I} FROM customer")
_narrow("subqueries_in_expressions", "nation", "n_nationkey", "SELECT n_nationkey, (SELECT max(n_nationkey) FROM nation) AS top FROM nation WHERE n_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey = 3)", f"SELECT n_nationkey, (SELECT max(n_nationkey) FROM nation) AS top, {_I} FROM nation WHERE n_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey = 3)")
_narrow("wide_casts", "part", "p_partkey", "SELECT p_partkey, CAST(p_size AS DECIMAL(60, 20)) AS a, TRY_CAST(p_name AS DECIMAL(50, 2)) AS b, p_size::DECIMAL(40, 3) AS c FROM part", f"SELECT p_partkey, p_size::VARCHAR || '.' || repeat('0', 20) AS a, NULL::VARCHAR AS b, p_size::VARCHAR || '.000' AS c, {_I} FROM part")
_wide("null_order", "nation", "SELECT n_nationkey, row_number() OVER (ORDER BY nullif(n_regionkey, 3), n_nationkey) AS up, row_number() OVER (ORDER BY nullif(n_regionkey, 3) DESC, n_nationkey) AS down FROM nation", "SELECT n_nationkey, row_number() OVER (ORDER BY nullif(n_regionkey, 3) NULLS LAST, n_nationkey) AS up, row_number() OVER (ORDER BY nullif(n_regionkey, 3) DESC NULLS FIRST, n_nationkey) AS down FROM nation")
_wide("ordered_array_agg", "nation", "SELECT n_regionkey, array_join(array_agg(n_name ORDER BY n_nationkey DESC), ',') AS names, size(array_agg(nullif(n_nationkey, 3))) AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey DESC) AS names, count(*)::INT AS n FROM nation GROUP BY n_regionkey")
_wide("natural_join", "nation region", "SELECT n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) AS n NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) AS r")
_wide("right_and_cross_join", "nation region", "SELECT r.r_regionkey AS r, count(n.n_nationkey) AS n, 'right' AS k FROM nation AS n RIGHT JOIN region AS r ON n.n_regionkey = r.r_regionkey AND n.n_nationkey < 9 GROUP BY r.r_regionkey UNION ALL SELECT r.r_regionkey AS r, count(*) AS n, 'cross' AS k FROM nation AS n CROSS JOIN region AS r GROUP BY r.r_regionkey")
_wide("offset_windows", "customer", "SELECT c_custkey, lead(c_custkey) OVER w AS next, first_value(c_custkey) OVER w AS head, last_value(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tail, nth_value(c_custkey, 2) OVER w AS second, round(percent_rank() OVER w, 9) AS p, round(cume_dist() OVER w, 9) AS c FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)")
_wide("more_aggregates", "orders", "SELECT o_orderpriority, approx_distinct(o_orderstatus) AS kinds, bool_and(o_totalprice > 0) AS pos, round(corr(o_totalprice, o_custkey), 6) AS r, round(var_pop(o_totalprice) / 1000, 3) AS v, count(DISTINCT o_custkey) AS c, min(o_orderkey) AS low FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, count(DISTINCT o_orderstatus) AS kinds, bool_and(o_totalprice > 0) AS pos, round(corr(o_totalprice, o_custkey), 6) AS r, round(var_pop(o_totalprice) / 1000, 3) AS v, count(DISTINCT o_custkey) AS c, min(o_orderkey) AS low FROM orders GROUP BY o_orderpriority")

# ---- function library: groups that the queries above don't reach -----------------------------------

_narrow("text_built_ins", "part", "p_partkey", "SELECT p_partkey, starts_with(p_name, 'a') AS sw, ends_with(p_name, 'e') AS ew, left(p_name, 3) AS l, right(p_name, 3) AS r, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '*') AS rp, btrim('  x ') AS bt, repeat('ab', 3) AS rep, replace(p_brand, '#', '_') AS re, reverse(p_brand) AS rev, split_part(p_name, ' ', 2) AS sp, substring(p_name, 2, 4) AS sub, ascii(p_name) AS asc_, chr(65) AS ch, strpos(p_name, 'e') AS at, position('a' IN p_name) AS pos, to_hex(p_size) AS hx, overlay(p_brand PLACING 'xx' FROM 1 FOR 2) AS ov, initcap('ab cd') AS ic, encode(p_brand, 'hex') AS eh, CAST(decode('6162', 'hex') AS string) AS dh, length(uuid()) AS u FROM part", f"SELECT p_partkey, starts_with(p_name, 'a') AS sw, ends_with(p_name, 'e') AS ew, left(p_name, 3) AS l, right(p_name, 3) AS r, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '*') AS rp, 'x' AS bt, 'ababab' AS rep, replace(p_brand, '#', '_') AS re, reverse(p_brand) AS rev, split_part(p_name, ' ', 2) AS sp, substring(p_name, 2, 4) AS sub, ascii(p_name) AS asc_, 'A' AS ch, strpos(p_name, 'e') AS at, strpos(p_name, 'a') AS pos, lower(to_hex(p_size)) AS hx, 'xx' || substr(p_brand, 3) AS ov, 'Ab Cd' AS ic, lower(hex(p_brand)) AS eh, 'ab' AS dh, 36 AS u, {_I} FROM part")
_narrow("text_aliases", "part", "p_partkey", "SELECT p_partkey, startswith(p_name, 'a') AS sw, endswith(p_name, 'e') AS ew, lowercase(p_brand) AS lo, regexp(p_name, '^a') AS rx, similar(p_name, 'e$') AS si, hex(p_size) AS hx FROM part", f"SELECT p_partkey, starts_with(p_name, 'a') AS sw, ends_with(p_name, 'e') AS ew, lower(p_brand) AS lo, regexp_matches(p_name, '^a') AS rx, regexp_matches(p_name, 'e$') AS si, lower(to_hex(p_size)) AS hx, {_I} FROM part")
_narrow("time_built_ins", "orders", "o_orderkey", "SELECT o_orderkey, to_char(o_orderdate, '%Y-%m-%d') AS d, date_format(o_orderdate, '%d/%m/%y at %H:%M') AS e, extract(year FROM o_orderdate) AS y, CAST(CAST(date_trunc('month', o_orderdate) AS date) AS string) AS m, now() > TIMESTAMP '2020-01-01 00:00:00' AS n, today() >= DATE '2020-01-01' AS t, current_date() >= DATE '2020-01-01' AS cd, current_time() IS NOT NULL AS ct FROM orders", f"SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%d/%m/%y at %H:%M') AS e, extract(year FROM o_orderdate) AS y, date_trunc('month', o_orderdate)::DATE::VARCHAR AS m, true AS n, true AS t, true AS cd, true AS ct, {_I} FROM orders")
_narrow("conditional_built_ins", "customer", "c_custkey", "SELECT c_custkey, greatest(c_custkey, 50) AS g, least(c_custkey, 50) AS l, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS c, nvl(nullif(c_nationkey, 3), -1) AS n, nvl2(nullif(c_nationkey, 3), 'a', 'b') AS m, ifnull(nullif(c_nationkey, 4), -2) AS i FROM customer", f"SELECT c_custkey, greatest(c_custkey, 50) AS g, least(c_custkey, 50) AS l, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS c, coalesce(nullif(c_nationkey, 3), -1) AS n, CASE WHEN c_nationkey = 3 THEN 'b' ELSE 'a' END AS m, coalesce(nullif(c_nationkey, 4), -2) AS i, {_I} FROM customer")
_narrow("number_built_ins", "customer", "c_custkey", "SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, round(power(c_custkey, 2), 3) AS p, round(sqrt(c_custkey), 9) AS s, mod(c_custkey, 7) AS m, round(ln(c_custkey + 1), 9) AS l, sign(c_acctbal) AS sg FROM customer", f"SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r, floor(c_acctbal)::BIGINT AS f, ceil(c_acctbal)::BIGINT AS c, round(power(c_custkey, 2), 3) AS p, round(sqrt(c_custkey), 9) AS s, c_custkey % 7 AS m, round(ln(c_custkey + 1), 9) AS l, sign(c_acctbal)::DOUBLE AS sg, {_I} FROM customer")
_L = "[1, n_regionkey, 2, 1, 1]"
_narrow("array_built_ins", "nation", "n_nationkey", f"SELECT n_nationkey, array_join(transform(array_remove({_L}, 1), x -> CAST(x AS string)), ',') AS rm, array_join(transform(array_remove_n({_L}, 1, 2), x -> CAST(x AS string)), ',') AS rn, array_join(transform(array_replace([7, 1, 1], 1, 5), x -> CAST(x AS string)), ',') AS rp, array_join(transform(array_replace_n([1, 1, 1], 1, 5, 2), x -> CAST(x AS string)), ',') AS rpn, array_join(transform(array_replace_all([1, 2, 1], 1, 5), x -> CAST(x AS string)), ',') AS ra, array_position([4, 9, n_regionkey + 100], 9) AS pos, array_position([4], 9) AS nopos, array_join(transform(array_positions([1, 2, 1], 1), x -> CAST(x AS string)), ',') AS poss, array_has([n_regionkey], 1) AS has, array_has_all([1, 2, n_regionkey], [1, 2]) AS all_, size(array_append([1], 2)) AS ap, element_at(array_prepend([1], 9), 1) AS pre, array_min([n_regionkey, 2]) AS mi, array_max([n_regionkey, 2]) AS ma, cardinality(array_distinct([1, n_regionkey, 1])) AS di, array_join(transform(array_sort([3, 1, 2]), x -> CAST(x AS string)), ',') AS so, size(to_large_list([1, 2])) AS la FROM nation", f"SELECT n_nationkey, n_regionkey || ',2,1,1' AS rm, CASE WHEN n_regionkey = 1 THEN '2,1,1' ELSE n_regionkey || ',2,1' END AS rn, '7,5,1' AS rp, '5,5,1' AS rpn, '5,2,5' AS ra, 2::BIGINT AS pos, NULL::BIGINT AS nopos, '1,3' AS poss, n_regionkey = 1 AS has, true AS all_, 2 AS ap, 9 AS pre, least(n_regionkey, 2) AS mi, greatest(n_regionkey, 2) AS ma, CASE WHEN n_regionkey = 1 THEN 1 ELSE 2 END AS di, '1,2,3' AS so, 2 AS la, {_I} FROM nation")
_Z = "_gs_zip_arrays([1, 2, n_regionkey], ['a', 'b', 'c'])"
_narrow("struct_arrays", "nation", "n_nationkey", f"SELECT n_nationkey, array_join(array_struct_field(array_filter({_Z}, 'f0', 1), 'f1'), ',') AS f, array_filter_first({_Z}, 'f0', 2).f1 AS first, array_filter_first({_Z}, 'f0', 77).f1 AS none, array_join(array_struct_field(array_filter_in({_Z}, 'f0', [1, 2]), 'f1'), ',') AS fin, array_enumerate([n_name, 'q'])[2].index AS idx, array_enumerate([n_name, 'q'])[1].value AS val, _gs_map_to_array_struct(map('k', n_name))[1].key AS k, _gs_map_to_array_struct(map('k', n_name))[1].value AS v, array_join(transform(_gs_generate_series(5, 1, -2), x -> CAST(x AS string)), ',') AS down, size(_gs_generate_series(1, 5, -1)) AS empty FROM nation", f"SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'a,c' ELSE 'a' END AS f, 'b' AS first, NULL::VARCHAR AS none, CASE WHEN n_regionkey IN (1, 2) THEN 'a,b,c' ELSE 'a,b' END AS fin, 1::BIGINT AS idx, n_name AS val, 'k' AS k, n_name AS v, '5,3,1' AS down, 0 AS empty, {_I} FROM nation")
_narrow("bytes_and_hashes", "nation", "n_nationkey", "SELECT n_nationkey, _gs_xxhash('') AS x, _gs_keccak256('') AS k, _gs_keccak256('0xzz') AS bad, _gs_byte_to_hex(_gs_from_base58('2NEpo7TZRRrLZSi2U')) AS b58, _gs_byte_to_hex(_gs_from_base58('0')) AS nob58, _gs_byte_to_hex(reverse_bytes32(_gs_hex_to_byte(concat(repeat('00', 31), 'ff')))) AS rev, _gs_byte_to_hex(coalesce_meta(nullif(_gs_hex_to_byte('00'), _gs_hex_to_byte('00')), _gs_hex_to_byte('0x0b'))) AS cm, _gs_byte_to_hex(unhex('4A')) AS un, _gs_conv_base('-255', 10, 16) AS cb FROM nation", f"SELECT n_nationkey, '99aa06d3014798d86001c324468d497f' AS x, '0xc5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470' AS k, NULL::VARCHAR AS bad, lower(hex('Hello World!')) AS b58, '' AS nob58, 'ff' || repeat('00', 31) AS rev, '0b' AS cm, '4a' AS un, '-ff' AS cb, {_I} FROM nation")
_narrow("uuid7_over_partitions", "lineitem", "l_orderkey", "SELECT l_orderkey, l_linenumber, length(uuid7()) AS n, substring(uuid7(), 15, 1) AS version FROM lineitem", f"SELECT l_orderkey, l_linenumber, 36 AS n, '7' AS version, {_I} FROM lineitem")
_narrow("more_regex_functions", "part", "p_partkey", "SELECT p_partkey, regexp_substr(p_brand, '[0-9]+') AS s, regexp_instr(p_name, 'e') AS i, array_join(regexp_extract_all(p_name, '([a-z])[aeiou]', 1), '') AS all_, regexp_count(p_name, 'zz') AS none, instr(p_name, 'e', -1) AS back FROM part", f"SELECT p_partkey, nullif(regexp_extract(p_brand, '[0-9]+'), '') AS s, strpos(p_name, 'e')::BIGINT AS i, array_to_string(regexp_extract_all(p_name, '([a-z])[aeiou]', 1), '') AS all_, 0::BIGINT AS none, (CASE WHEN strpos(p_name, 'e') = 0 THEN 0 ELSE length(p_name) - strpos(reverse(p_name), 'e') + 1 END)::BIGINT AS back, {_I} FROM part")
_narrow("more_json_functions", "nation", "n_nationkey", """SELECT n_nationkey, json_quote(n_name) AS q, json_unquote(json_quote(n_name)) AS u, json_array_absent_on_null(n_nationkey, NULL, 'x') AS a, json_object_absent_on_null('k', n_nationkey, 'n', NULL) AS o, json(concat('{"b": 1, "a": ', n_nationkey, '}')) AS j, parse_json('[1, 2 ]') AS p, try_parse_json('{oops') AS t, is_json('[1]', 'ARRAY') AS ia, is_json('1', 'OBJECT') AS io, json_query('{"a": {"b": [1]}}', '$.a') AS jq, json_value('{"a": [10, 20]}', '$.a[1]') AS jv, json_exists('{"a": 1}', '$.a') AS e, _gs_json_objects_to_clickhouse_tuples('[{"a": "x", "b": 1}]', ['a', 'b', 'c']) AS ch FROM nation""", f"""SELECT n_nationkey, '"' || n_name || '"' AS q, n_name AS u, '[' || n_nationkey || ',"x"]' AS a, '{{"k":' || n_nationkey || '}}' AS o, '{{"a":' || n_nationkey || ',"b":1}}' AS j, '[1,2]' AS p, NULL::VARCHAR AS t, true AS ia, false AS io, '{{"b":[1]}}' AS jq, '20' AS jv, true AS e, '[(''x'', 1, null)]' AS ch, {_I} FROM nation""")
_wide("more_json_aggregates", "nation", "SELECT n_regionkey, json_arrayagg_null_on_null(nullif(n_regionkey, 1)) AS an, json_arrayagg_absent_on_null(nullif(n_regionkey, 1)) AS aa, json_objectagg_absent_on_null(n_name, nullif(n_regionkey, 1)) AS oa FROM nation GROUP BY n_regionkey", """SELECT n_regionkey, '[' || string_agg(coalesce(nullif(n_regionkey, 1)::VARCHAR, 'null'), ',') || ']' AS an, '[' || coalesce(string_agg(nullif(n_regionkey, 1)::VARCHAR, ','), '') || ']' AS aa, '{' || coalesce(string_agg('"' || n_name || '":' || nullif(n_regionkey, 1), ',' ORDER BY n_name), '') || '}' AS oa FROM nation GROUP BY n_regionkey""")

_D = "to_decimal_arb_from_int(p_size, 80, 2)"
_narrow("decimal_comparisons", "part", "p_partkey", f"SELECT p_partkey, decimal_arb_eq({_D}, '10') AS eq, decimal_arb_neq({_D}, '10.0') AS neq, decimal_arb_lt({_D}, '9.5') AS lt, decimal_arb_lte({_D}, '10') AS lte, decimal_arb_gt({_D}, '10') AS gt, decimal_arb_gte({_D}, '10.00') AS gte, decimal_arb_to_sort_key({_D}) < decimal_arb_to_sort_key('20.00') AS key FROM part", f"SELECT p_partkey, p_size = 10 AS eq, p_size <> 10 AS neq, p_size < 9.5 AS lt, p_size <= 10 AS lte, p_size > 10 AS gt, p_size >= 10 AS gte, p_size < 20 AS key, {_I} FROM part")
_narrow("decimal_operations", "part", "p_partkey", f"SELECT p_partkey, decimal_arb_to_string({_D}) AS t, decimal_arb_sub({_D}, '0.5') AS s, decimal_arb_div({_D}, '4') AS d, decimal_arb_mod({_D}, '7') AS m, decimal_arb_neg({_D}) AS n, decimal_arb_abs(decimal_arb_neg({_D})) AS a, decimal_arb_rescale({_D}, 90, 4) AS r, decimal_arb_restamp({_D}, {_D}) AS rs, decimal_arb_greatest({_D}, '10.00', NULL) AS g, decimal_arb_least({_D}, '10.00') AS l FROM part", f"SELECT p_partkey, p_size::DECIMAL(12,2)::VARCHAR AS t, (p_size::DECIMAL(12,2) - 0.50)::DECIMAL(12,2)::VARCHAR AS s, (p_size * 0.25::DECIMAL(4,2))::DECIMAL(20,2)::VARCHAR || repeat('0', 16) AS d, (p_size % 7)::DECIMAL(12,2)::VARCHAR AS m, (-p_size)::DECIMAL(12,2)::VARCHAR AS n, p_size::DECIMAL(12,2)::VARCHAR AS a, p_size::DECIMAL(14,4)::VARCHAR AS r, p_size::DECIMAL(12,2)::VARCHAR AS rs, greatest(p_size, 10)::DECIMAL(12,2)::VARCHAR AS g, least(p_size, 10)::DECIMAL(12,2)::VARCHAR AS l, {_I} FROM part")
_narrow("decimal_conversions", "part", "p_partkey", f"SELECT p_partkey, to_decimal_arb_from_string('12.5', 80, 2) AS s, try_to_decimal_arb_from_string('x', 80, 2) AS t, to_decimal_arb_from_decimal128(CAST(p_size AS decimal(10,2))) AS f, to_decimal_arb_from_decimal256(CAST(p_size AS decimal(38,1))) AS g, CAST(decimal_arb_to_decimal128('2.345', 10, 2) AS string) AS d, decimal_arb_to_decimal256('2.355', 60, 2) AS e, decimal_arb_cast_numeric({_D}, {_D}) AS c, decimal_arb_cast_wide_decimal('1.005', to_decimal_arb_from_string('1.005', 80, 2)) AS w, decimal_arb_try_cast_wide_decimal('123', try_to_decimal_arb_from_string('123', 3, 2)) AS x, legacy_wide_int_to_decimal_arb(_gs_hex_to_byte(concat(repeat('00', 31), '2a'))) AS i FROM part", f"SELECT p_partkey, '12.50' AS s, NULL::VARCHAR AS t, p_size::DECIMAL(10,2)::VARCHAR AS f, p_size::DECIMAL(20,1)::VARCHAR AS g, '2.34' AS d, '2.36' AS e, p_size::DECIMAL(12,2)::VARCHAR AS c, '1.01' AS w, NULL::VARCHAR AS x, '42' AS i, {_I} FROM part")
_narrow("decimal_arrays", "part", "p_partkey", f"SELECT p_partkey, decimal_arb_array_min([{_D}, '10.00', NULL]) AS mi, decimal_arb_array_max([{_D}, '10.00']) AS ma, array_join(decimal_arb_array_sort(['10.00', '2', '-3.5']), ',') AS so, array_join(decimal_arb_array_sort(['10.00', '2', '-3.5'], 'DESC'), ',') AS de FROM part", f"SELECT p_partkey, least(p_size, 10)::DECIMAL(12,2)::VARCHAR AS mi, greatest(p_size, 10)::DECIMAL(12,2)::VARCHAR AS ma, '-3.5,2,10.00' AS so, '10.00,2,-3.5' AS de, {_I} FROM part")

_W = "CAST(p_size AS DECIMAL(80, 20))"
_narrow("wide_operators", "part", "p_partkey", f"SELECT p_partkey, a + b AS s, a - 1 AS d, a * '2.50' AS m, a % 7 AS r, -a AS n, a > 10 AS gt, a = 10 AS eq, a <> 10 AS ne, a IN (1, 2, 3) AS among, a / 4 AS q FROM (SELECT p_partkey, {_W} AS a, CAST(p_partkey AS DECIMAL(50, 1)) AS b FROM part) AS t WHERE a >= 3", f"SELECT p_partkey, (p_size + p_partkey)::VARCHAR || '.' || repeat('0', 20) AS s, (p_size - 1)::VARCHAR || '.' || repeat('0', 20) AS d, (p_size * 2.5::DECIMAL(3,1))::DECIMAL(20,1)::VARCHAR || repeat('0', 21) AS m, (p_size % 7)::VARCHAR || '.' || repeat('0', 20) AS r, '-' || p_size::VARCHAR || '.' || repeat('0', 20) AS n, p_size > 10 AS gt, p_size = 10 AS eq, p_size <> 10 AS ne, p_size IN (1, 2, 3) AS among, (p_size * 0.25::DECIMAL(3,2))::DECIMAL(20,2)::VARCHAR || repeat('0', 18) AS q, {_I} FROM part WHERE p_size >= 3")
_wide("wide_sql_aggregates", "part", f"SELECT p_brand, sum(a) AS s, min(a) AS low, max(a) AS high, avg(a) AS mean, count(a) AS n FROM (SELECT p_brand, CAST(p_size AS DECIMAL(60, 2)) AS a FROM part) AS t GROUP BY p_brand", "SELECT p_brand, sum(p_size)::VARCHAR || '.00' AS s, min(p_size)::VARCHAR || '.00' AS low, max(p_size)::VARCHAR || '.00' AS high, ((sum(p_size)::HUGEINT * 1000 // count(*) + CASE WHEN 2 * (sum(p_size)::HUGEINT * 1000 % count(*)) > count(*) OR (2 * (sum(p_size)::HUGEINT * 1000 % count(*)) = count(*) AND (sum(p_size)::HUGEINT * 1000 // count(*)) % 2 = 1) THEN 1 ELSE 0 END)::DECIMAL(30,0) * 0.001::DECIMAL(4,3))::DECIMAL(34,3)::VARCHAR AS mean, count(*) AS n FROM part GROUP BY p_brand")
_wide("wide_order", "part", "SELECT p_partkey, row_number() OVER (ORDER BY a DESC, p_partkey) AS place FROM (SELECT p_partkey, CAST(p_size - 20 AS DECIMAL(60, 5)) AS a FROM part) AS t ORDER BY a, p_partkey LIMIT 20", "SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS place FROM part ORDER BY p_size, p_partkey LIMIT 20")

from rillflow import node_queries  # noqa: E402, F401
