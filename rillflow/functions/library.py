"""The function library of pipeline SQL: each name with the Spark expression that it stands for."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import SparkSession

from rillflow.functions import decimals, dialect, scalars
from rillflow.functions.sqltext import Macro, expand, literal, quote


def _template(text: str, least: int, defaults: tuple[str, ...] = ()) -> Macro:
    """`{0}`, `{1}` ... are the arguments; missing ones take their defaults."""
    most = least + len(defaults)

    def build(args: list[str]) -> str:
        if not least <= len(args) <= most:
            raise ValueError(f"{least} to {most} arguments are asked for, not {len(args)}")
        full = [f"({a})" for a in args] + list(defaults[len(args) - least :])
        return "(" + text.format(*full) + ")"

    return build


def _field(args: list[str]) -> str:
    name = literal(args[1])
    if name is None:
        raise ValueError("the field's name is a string literal")
    return "`" + name.replace("`", "``") + "`"


def _zip(args: list[str]) -> str:
    if not 2 <= len(args) <= 4:
        raise ValueError("_gs_zip_arrays takes 2 to 4 arrays")
    same = " AND ".join(f"size({args[0]}) = size({a})" for a in args[1:])
    struct = ", ".join(f"'f{k}', get({a}, i)" for k, a in enumerate(args))
    some = " OR ".join(f"({a}) IS NULL" for a in args)
    return f"(CASE WHEN {some} THEN NULL WHEN {same} THEN transform({args[0]}, (x, i) -> named_struct({struct})) ELSE raise_error('arrays of unequal lengths') END)"


def _pairs(name: str, absent: bool) -> Macro:
    def build(args: list[str]) -> str:
        if len(args) % 2:
            raise ValueError(f"{name} takes keys and values in pairs")
        return f"rf_json_object({_struct(args)}, {str(absent).lower()})"

    return build


def _struct(args: list[str]) -> str:
    if not args:
        return "'{}'"
    inner = ", ".join(f"'a{k:04d}', {a}" for k, a in enumerate(args))
    return f"to_json(named_struct({inner}), map('ignoreNullFields', 'false'))"


def _json_value(args: list[str]) -> str:
    if len(args) not in (2, 7):
        raise ValueError("json_value takes 2 or 7 arguments")
    if len(args) == 2:
        return f"rf_json_value({args[0]}, {args[1]}, 'NULL', CAST(NULL AS STRING), 'NULL', CAST(NULL AS STRING))"
    text, path, returning, on_empty, empty, on_error, error = args
    if (literal(returning) or "").upper() not in ("STRING", "VARCHAR", "CHAR"):
        raise ValueError("json_value returns STRING, VARCHAR or CHAR")
    return f"rf_json_value({text}, {path}, {on_empty}, CAST({empty} AS STRING), {on_error}, CAST({error} AS STRING))"


def _json_query(args: list[str]) -> str:
    if len(args) not in (2, 6):
        raise ValueError("json_query takes 2 or 6 arguments")
    if len(args) == 2:
        return f"rf_json_query({args[0]}, {args[1]}, 'WITHOUT ARRAY', 'NULL', 'NULL')"
    text, path, returning, wrapper, on_empty, on_error = args
    if (literal(returning) or "").upper() not in ("STRING", "ARRAY"):
        raise ValueError("json_query returns STRING or ARRAY")
    return f"rf_json_query({text}, {path}, {wrapper}, {on_empty}, {on_error})"


def _parse_url(args: list[str]) -> str:
    """Parts in any case; the path of a bare host is /."""
    part = literal(args[1])
    part = quote(part.upper()) if part is not None else f"upper({args[1]})"
    rest = "".join(f", {a}" for a in args[2:])
    url = args[0]
    plain = f"try_parse_url({url}, {part}{rest})"
    if len(args) == 3:
        return f"try_url_decode({plain})"
    return f"(CASE WHEN {part} = 'PATH' AND try_parse_url({url}, 'HOST') IS NOT NULL THEN coalesce(nullif({plain}, ''), '/') ELSE {plain} END)"


def _variadic(name: str) -> Macro:
    return lambda args: f"{name}(array({', '.join(args)}))"


def _ordered(op: str) -> Macro:
    return _template(f"rf_decimal_compare({{0}}, {{1}}) {op} 0", 2)


def _wide_integer(args: list[str]) -> str:
    kind = args[1] if len(args) > 1 else "'u256'"
    return f"rf_decimal_from_bytes32({args[0]}, {kind})"


_TYPED = re.compile(r"rf_decimal_(?:try_)?(?:from_string|cast)\(.*,\s*\(?(\d+)\)?,\s*\(?(\d+)\)?(?:,[^,]*)?\)\)?", re.S)


def _wide_cast(fn: str) -> Macro:
    """`(value, precision, scale)`, or `(value, fallback)` where the fallback is a conversion from text that names both."""

    def build(args: list[str]) -> str:
        if len(args) == 3:
            return f"{fn}({', '.join(args)})"
        typed = _TYPED.fullmatch(args[1].strip().lstrip("(")) if len(args) == 2 else None
        if not typed:
            raise ValueError("a cast to a wide decimal takes a precision and a scale, or a conversion from text as its fallback")
        return f"{fn}(cast({args[0]} AS string), {typed[1]}, {typed[2]})"

    return build


def _numbered(a: list[str]) -> str:
    """Elements with the number of their value's occurrences so far (NULLs count as equal)."""
    return f"transform({a[0]}, (x, i) -> named_struct('x', x, 'k', CASE WHEN x <=> ({a[1]}) THEN size(filter(slice({a[0]}, 1, i + 1), y -> y <=> ({a[1]}))) END))"


def _removed_n(args: list[str]) -> str:
    if len(args) != 3:
        raise ValueError("array_remove_n takes an array, a value and a number")
    return f"transform(filter({_numbered(args)}, s -> s.k IS NULL OR s.k > ({args[2]})), s -> s.x)"


def _replaced(args: list[str]) -> str:
    if len(args) != 4:
        raise ValueError("array_replace takes an array, a value and its replacement; array_replace_n a number too")
    return f"transform({_numbered(args)}, s -> CASE WHEN s.k <= ({args[3]}) THEN {args[2]} ELSE s.x END)"


def _encoded(args: list[str]) -> str:
    """encode(x, 'hex' | 'base64'); other names are character sets, as in Spark."""
    how = (literal(args[1]) or "").lower()
    return {"hex": f"lower(hex({args[0]}))", "base64": f"replace(rtrim('=', base64(cast({args[0]} AS binary))), '\r\n', '')"}.get(how, f"encode({', '.join(args)})")


def _decoded(args: list[str]) -> str:
    how = (literal(args[1]) or "").lower() if len(args) == 2 else ""
    return {"hex": f"unhex({args[0]})", "base64": f"unbase64({args[0]})"}.get(how, f"decode({', '.join(args)})")


def _agg(fn: str, absent: bool, pairs: bool) -> Macro:
    flag = str(absent).lower()
    if pairs:
        return _template(f"{fn}(collect_list(to_json(named_struct('k', {{0}}, 'v', {{1}}), map('ignoreNullFields', 'false'))), {flag})", 2)
    return _template(f"{fn}(collect_list(to_json(named_struct('v', {{0}}), map('ignoreNullFields', 'false'))), {flag})", 1)


MACROS: dict[str, Macro] = {
    # time
    "now": _template("current_timestamp()", 0), "today": _template("current_date()", 0), "uuid7": lambda a: "rf_uuid7(monotonically_increasing_id())",
    # arrays
    "_gs_split_string_to_array": _template("split({0}, concat('\\\\Q', {1}, '\\\\E'))", 1, ("' '",)),
    "_gs_generate_series": _template("CASE WHEN {2} = 0 THEN raise_error('a series needs a step') WHEN ({2} > 0) = ({0} <= {1}) OR {0} = {1} THEN sequence(cast({0} AS bigint), cast({1} AS bigint), cast({2} AS bigint)) ELSE cast(array() AS array<bigint>) END", 2, ("1",)),
    "_gs_zip_arrays": _zip,
    "array_enumerate": _template("transform({0}, (x, i) -> named_struct('index', cast(i AS bigint), 'value', x))", 1),
    "array_filter": lambda a: f"filter({a[0]}, x -> x.{_field(a)} <=> ({a[2]}))",
    "array_filter_first": lambda a: f"get(filter({a[0]}, x -> x.{_field(a)} <=> ({a[2]})), 0)",
    "array_filter_in": lambda a: f"filter({a[0]}, x -> array_contains({a[2]}, x.{_field(a)}))",
    "array_struct_field": lambda a: f"transform({a[0]}, x -> cast(x.{_field(a)} AS string))",
    "to_large_list": _template("{0}", 1), "_gs_map_to_array_struct": _template("map_entries({0})", 1),
    "array_has": _template("array_contains({0}, {1})", 2), "array_has_any": _template("arrays_overlap({0}, {1})", 2), "array_has_all": _template("size(array_except({1}, {0})) = 0", 2),
    "make_array": lambda a: f"array({', '.join(a)})", "array_element": _template("try_element_at({0}, cast({1} AS int))", 2),
    "array_remove": _template("CASE WHEN array_position({0}, {1}) > 0 THEN concat(slice({0}, 1, cast(array_position({0}, {1}) AS int) - 1), slice({0}, cast(array_position({0}, {1}) AS int) + 1, size({0}))) ELSE {0} END", 2),
    "array_remove_all": _template("filter({0}, x -> NOT (x <=> {1}))", 2), "array_replace_all": _template("transform({0}, x -> CASE WHEN x <=> {1} THEN {2} ELSE x END)", 3),
    "array_positions": _template("filter(transform({0}, (x, i) -> CASE WHEN x <=> {1} THEN cast(i + 1 AS bigint) END), p -> p IS NOT NULL)", 2),
    "array_position": _template("nullif(array_position({0}, {1}), 0)", 2), "array_agg": dialect.ordered_list,
    "array_remove_n": _removed_n, "array_replace": lambda a: _replaced([*a, "1"]), "array_replace_n": lambda a: _replaced(a),
    "approx_distinct": _template("approx_count_distinct({0})", 1),
    # hashes and bytes
    "_gs_xxhash": _template("rf_xxhash128({0})", 1), "_gs_keccak256": _template("rf_keccak256({0})", 1), "_gs_conv_base": _template("rf_conv_base(cast({0} AS string), cast({1} AS int), cast({2} AS int))", 3),
    "_gs_from_base58": _template("rf_from_base58({0})", 1),
    "_gs_hex_to_byte": _template("CASE WHEN regexp_replace({0}, '^0x', '') RLIKE '^([0-9a-fA-F]{{2}})*$' THEN unhex(regexp_replace({0}, '^0x', '')) ELSE X'' END", 1),
    "_gs_byte_to_hex": _template("lower(hex({0}))", 1), "coalesce_meta": lambda a: f"coalesce({', '.join(a)})",
    "reverse_bytes32": _template("unhex(array_join(reverse(regexp_extract_all(hex({0}), '(..)', 1)), ''))", 1),
    "_gs_json_objects_to_clickhouse_tuples": _template("rf_tuples({0}, {1})", 2),
    # text
    "regexp_extract": _template("rf_regexp_extract({0}, {1}, {2})", 2, ("0",)), "regexp_extract_all": _template("rf_regexp_extract_all({0}, {1}, {2})", 2, ("1",)),
    "regexp_substr": _template("rf_regexp_substr({0}, {1})", 2), "regexp_count": _template("rf_regexp_count({0}, {1})", 2),
    "regexp_instr": _template("rf_regexp_instr({0}, {1}, {2}, {3})", 2, ("1", "1")), "regexp_replace": _template("rf_regexp_replace({0}, {1}, {2})", 3),
    "locate": _template("cast(locate({0}, {1}, {2}) AS bigint)", 2, ("1",)), "instr": lambda a: f"cast(instr({a[0]}, {a[1]}) AS bigint)" if len(a) == 2 else f"rf_instr({a[0]}, {a[1]}, {a[2]}, {a[3] if len(a) > 3 else '1'})",
    "bin": _template("CASE WHEN {0} < 0 AND {0} > -9223372036854775808 THEN concat('-', bin(-({0}))) WHEN {0} < 0 THEN concat('-', bin({0})) ELSE bin({0}) END", 1),
    "elt": lambda a: "(CASE " + " ".join(f"WHEN ({a[0]}) = {k} THEN cast({v} AS string)" for k, v in enumerate(a[1:], 1)) + " END)",
    "parse_url": _parse_url, "split": _template("CASE WHEN {1} = '' THEN split({0}, '') ELSE split({0}, concat('\\\\Q', {1}, '\\\\E')) END", 2),
    "split_index": _template("CASE WHEN {2} < 0 THEN NULL WHEN {1} = '' THEN get(array({0}), {2}) ELSE get(split({0}, concat('\\\\Q', {1}, '\\\\E')), {2}) END", 3),
    "translate": _template("CASE WHEN {1} IS NULL THEN {0} ELSE translate({0}, {1}, coalesce({2}, '')) END", 3), "translate3": _template("CASE WHEN {1} IS NULL THEN {0} ELSE translate({0}, {1}, coalesce({2}, '')) END", 3),
    "url_decode": _template("try_url_decode({0})", 1), "starts_with": _template("startswith({0}, {1})", 2), "ends_with": _template("endswith({0}, {1})", 2),
    "lowercase": _template("lower({0})", 1), "uppercase": _template("upper({0})", 1), "charlength": _template("char_length({0})", 1), "similar": _template("{0} RLIKE {1}", 2), "regexp": _template("{0} RLIKE {1}", 2),
    "to_hex": _template("lower(hex({0}))", 1), "hex": _template("lower(hex({0}))", 1),
    "concat": lambda a: "concat(" + ", ".join(f"coalesce(cast({x} AS string), '')" for x in a) + ")",
    "strpos": _template("instr({0}, {1})", 2), "to_char": dialect.time_text, "date_format": dialect.time_text, "dateformat": dialect.time_text,
    "encode": lambda a: _encoded(a), "decode": lambda a: _decoded(a), "overlay": lambda a: f"overlay({', '.join(a)})",
    # JSON
    "json_quote": _template("rf_json_quote({0})", 1), "json_unquote": _template("rf_json_unquote({0})", 1), "json_exists": _template("rf_json_exists({0}, {1}, {2})", 2, ("'FALSE'",)),
    "json_array": lambda a: f"rf_json_array({_struct(a)}, false)", "json_array_absent_on_null": lambda a: f"rf_json_array({_struct(a)}, true)",
    "json_object": _pairs("json_object", False), "json_object_absent_on_null": _pairs("json_object_absent_on_null", True),
    "json": _template("rf_parse_json({0})", 1), "parse_json": lambda a: f"rf_parse_json({a[0]})", "try_parse_json": lambda a: f"rf_try_parse_json({a[0]})", "json_query": _json_query, "json_value": _json_value,
    "is_json": _template("rf_is_json({0}, {1})", 1, ("'VALUE'",)), "json_string": _template("rf_json_string(to_json(named_struct('v', {0}), map('ignoreNullFields', 'false')))", 1),
    "json_arrayagg_null_on_null": _agg("rf_json_arrayagg", False, False), "json_arrayagg_absent_on_null": _agg("rf_json_arrayagg", True, False),
    "json_objectagg_null_on_null": _agg("rf_json_objectagg", False, True), "json_objectagg_absent_on_null": _agg("rf_json_objectagg", True, True),
    # wide decimals
    "decimal_arb_to_string": _template("{0}", 1), "decimal_arb_rescale": _template("rf_decimal_from_string({0}, {1}, {2})", 3), "decimal_arb_restamp": _template("{0}", 2),
    "decimal_arb_greatest": _variadic("rf_decimal_greatest"), "decimal_arb_least": _variadic("rf_decimal_least"), "decimal_arb_array_min": _template("rf_decimal_least({0})", 1), "decimal_arb_array_max": _template("rf_decimal_greatest({0})", 1),
    "decimal_arb_array_sort": _template("rf_decimal_sort({0}, {1}, {2})", 1, ("'ASC'", "'NULLS FIRST'")),
    **{f"decimal_arb_{op}": _template(f"rf_decimal_{op}({{0}}, {{1}})", 2) for op in ("add", "sub", "mul", "div", "mod")},
    "decimal_arb_neg": _template("rf_decimal_neg({0})", 1), "decimal_arb_abs": _template("rf_decimal_abs({0})", 1),
    **{f"decimal_arb_{name}": _ordered(op) for name, op in (("eq", "="), ("neq", "<>"), ("lt", "<"), ("lte", "<="), ("gt", ">"), ("gte", ">="))},
    "decimal_arb_to_sort_key": _template("rf_decimal_key({0})", 1), "to_decimal_arb_from_string": _template("rf_decimal_from_string({0}, {1}, {2})", 3, ("''",)), "try_to_decimal_arb_from_string": _template("rf_decimal_try_from_string({0}, {1}, {2})", 3, ("''",)),
    "to_decimal_arb_from_decimal128": _template("cast({0} AS string)", 1), "to_decimal_arb_from_decimal256": _template("cast({0} AS string)", 1), "to_decimal_arb_from_int": _template("rf_decimal_from_string(cast({0} AS string), {1}, {2})", 3),
    "decimal_arb_to_decimal128": lambda a: f"cast(rf_decimal_native({a[0]}, {a[1]}, {a[2]}) AS decimal({a[1]}, {a[2]}))", "decimal_arb_to_decimal256": _template("rf_decimal_native({0}, {1}, {2})", 3),
    "decimal_arb_cast_numeric": _template("{0}", 2), "decimal_arb_cast_wide_decimal": _wide_cast("rf_decimal_cast"), "decimal_arb_try_cast_wide_decimal": _wide_cast("rf_decimal_try_cast"),
    "legacy_wide_int_to_decimal_arb": _wide_integer,
}


_OWN = re.compile(r"\brf_\w+")


def ready(spark: SparkSession, sql: str) -> str:
    """`sql`, after the private UDFs that it names are registered in this session."""
    known = spark.__dict__.setdefault("_rillflow_udfs", set())
    for name in set(_OWN.findall(sql)) - known:
        if name == "rf_uuid7":
            udf = scalars.vectorised(scalars.uuid7, scalars.S, 0).asNondeterministic()
        elif name in scalars.SCALARS or name in decimals.SCALARS:
            udf = scalars.vectorised(*(scalars.SCALARS.get(name) or decimals.SCALARS[name]))
        else:
            continue
        spark.udf.register(name, udf)
        known.add(name)
    return sql


def register(spark: SparkSession) -> None:
    """All private UDFs behind the library, in this session."""
    ready(spark, " ".join([*scalars.SCALARS, *decimals.SCALARS, "rf_uuid7"]))


#: Calls that `dialect.by_types` decides on: of text or of arrays.
TYPED: dict[str, Macro] = {"concat": lambda a: f"concat({', '.join(a)})"}


def rewritten(sql: str, more: dict[str, Callable[[list[str]], str]] | None = None) -> str:
    """Pipeline SQL as Spark SQL, but for what depends on types: with TYPED as `more`, `dialect.by_types` does that part."""
    return expand(dialect.prepared(sql), {**MACROS, **(more or {})})
