import pytest

from rillflow.functions import decimals, library, scalars, sqltext


@pytest.fixture(scope="module")
def ask(spark):
    library.register(spark)

    def run(text):
        return spark.sql("SELECT " + library.rewritten(text) + " AS v").first().v

    return run


CASES = [
    ("regexp_extract('a12b', '([0-9])([0-9])')", "12"), ("regexp_extract('a12b', '([0-9])([0-9])', 2)", "2"), ("regexp_extract('ab', '[0-9]')", None), ("regexp_extract('ab', '(')", None),
    ("regexp_extract_all('a1b2', '([0-9])')", ["1", "2"]), ("regexp_substr('ab12', '[0-9]+')", "12"), ("regexp_count('banana', 'an')", 2), ("regexp_instr('banana', 'an', 3)", 4), ("regexp_instr('banana', 'an', 1, 3)", 0),
    ("regexp_replace('abc', 'b', '$1')", "a$1c"), ("regexp_replace(cast(null as string), 'b', 'x')", None), ("locate('b', 'abcb', 3)", 4), ("instr('abcabc', 'b')", 2), ("instr('abcabc', 'b', -1)", 5), ("instr('abcabc', 'b', 1, 2)", 5), ("instr('abcabc', 'b', 0)", 0),
    ("bin(-5)", "-101"), ("bin(5)", "101"), ("elt(2, 'a', 3)", "3"), ("elt(9, 'a')", None), ("split('a.b', '.')", ["a", "b"]), ("split('ab', '')", ["a", "b"]), ("split_index('a.b', '.', 1)", "b"), ("split_index('ab', '', 0)", "ab"), ("split_index('ab', ',', 5)", None),
    ("translate('abc', 'ab', cast(null as string))", "c"), ("translate('abc', cast(null as string), 'x')", "abc"), ("url_decode('a%zz')", None), ("url_decode('a+b%20c')", "a b c"), ("url_encode('a b')", "a+b"),
    ("parse_url('http://h/p?q=1&r=a%20b#f', 'query', 'r')", "a b"), ("parse_url('http://h', 'PATH')", "/"), ("parse_url('%%', 'HOST')", None), ("concat('a', cast(null as string), 1)", "a1"),
    ("_gs_split_string_to_array('a b')", ["a", "b"]), ("_gs_split_string_to_array('a|b', '|')", ["a", "b"]), ("_gs_generate_series(1, 3)", [1, 2, 3]), ("_gs_generate_series(3, 1)", []), ("_gs_generate_series(3, 1, -1)", [3, 2, 1]),
    ("array_remove(make_array(1, 2, 1), 1)", [2, 1]), ("array_remove_all(make_array(1, 2, 1), 1)", [2]), ("array_positions(make_array(1, 2, 1), 1)", [1, 3]), ("array_position(make_array(1), 2)", None), ("array_element(make_array(5, 6), 2)", 6), ("array_element(make_array(5), 3)", None),
    ("array_has_all(make_array(1, 2), make_array(2))", True), ("array_struct_field(make_array(named_struct('k', 1)), 'k')", ["1"]),
    ("_gs_xxhash('')", "99aa06d3014798d86001c324468d497f"), ("_gs_keccak256('')", "0xc5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"), ("_gs_keccak256('abc')", "0x4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45"), ("_gs_keccak256('0xzz')", None),
    ("_gs_conv_base('-ff', 16, 10)", "-255"), ("_gs_conv_base('9', 8, 10)", None),
    ("_gs_byte_to_hex(_gs_from_base58('2g'))", "61"), ("_gs_byte_to_hex(_gs_from_base58('0'))", ""), ("_gs_byte_to_hex(_gs_hex_to_byte('0xAb'))", "ab"), ("_gs_byte_to_hex(_gs_hex_to_byte('F'))", ""), ("_gs_byte_to_hex(reverse_bytes32(unhex('0102')))", "0201"),
    ("_gs_json_objects_to_clickhouse_tuples('[{\"a\":\"x\",\"b\":1},{\"a\":null}]', array('a', 'b'))", "[('x', 1), (null, null)]"), ("_gs_json_objects_to_clickhouse_tuples(cast(null as string), array('a'))", "[]"),
    ("json_value('{\"a\":{\"b\":[1,\"x\"]}}', '$.a.b[1]')", "x"), ("json_value('{\"a\":[1]}', '$.a')", None), ("json_value('{\"a\":null}', '$.a', 'STRING', 'DEFAULT', 'missing', 'NULL', NULL)", "missing"), ("json_value('{', '$.a')", None),
    ("json_query('{\"a\":{\"b\":[1,2]}}', '$.a')", '{"b":[1,2]}'), ("json_query('{\"a\":1}', '$.a')", None), ("json_query('{\"a\":1}', '$.a', 'STRING', 'WITH CONDITIONAL ARRAY', 'NULL', 'NULL')", "[1]"), ("json_query('x', '$', 'STRING', 'WITHOUT ARRAY', 'NULL', 'EMPTY OBJECT')", "{}"),
    ("json_exists('{\"a\":1}', '$.a')", True), ("json_exists('{\"a\":null}', '$.a')", False), ("json_exists('x', '$.a', 'UNKNOWN')", None), ("json_exists('x', '$.a', 'TRUE')", True), ("json_exists('{\"a b\":1}', '$[\"a b\"]')", True),
    ("json_array(1, 'a', '[1]', cast(null as string))", '[1,"a",[1],null]'), ("json_array_absent_on_null(1, cast(null as int))", "[1]"), ("json_array()", "[]"), ("json_object('b', 1, 'a', '{\"x\":2}')", '{"a":{"x":2},"b":1}'), ("json_object_absent_on_null('a', cast(null as int))", "{}"),
    ("json('{\"b\": 1, \"a\": [ ]}')", '{"a":[],"b":1}'), ("json(' ')", None), ("try_parse_json('{')", None), ("is_json('[1]', 'ARRAY')", True), ("is_json(cast(null as string))", False), ("is_json('1', 'OBJECT')", False), ("json_quote('a/\"é')", '"a\\/\\"\\u00e9"'), ("json_unquote('\"a\\\\u0062\"')", "ab"), ("json_unquote('x')", "x"), ("json_string('a')", '"a"'), ("json_string(cast(null as string))", None),
    ("decimal_arb_add('1.10', '2')", "3.10"), ("decimal_arb_mul('1.5', '-2.25')", "-3.375"), ("decimal_arb_div('1', '3')", "0.333333333333333333"), ("decimal_arb_div('-1', '-8')", "0.125000000000000000"), ("decimal_arb_mod('-7', '3')", "-1"), ("decimal_arb_sub('1', '1.0')", "0.0"),
    ("decimal_arb_lt('9', '10')", True), ("decimal_arb_eq('1.0', '1')", True), ("decimal_arb_greatest('9', cast(null as string), '10')", "10"), ("decimal_arb_array_sort(array('10', null, '9'))", [None, "9", "10"]),
    ("to_decimal_arb_from_string('1.5', 100, 3)", "1.500"), ("try_to_decimal_arb_from_string('1.55', 100, 1)", None), ("decimal_arb_cast_wide_decimal('-1.25', 80, 1)", "-1.3"), ("decimal_arb_to_decimal256('1.25', 76, 1)", "1.2"), ("legacy_wide_int_to_decimal_arb(unhex(repeat('ff', 32)), 'i256')", "-1"),
    ("decimal_arb_abs('-" + "9" * 80 + "')", "9" * 80),
]


@pytest.mark.parametrize("sql, want", CASES)
def test_values(ask, sql, want):
    assert ask(sql) == want


@pytest.mark.parametrize("sql", ["json('{')", "json_value('{}', 'a')", "json_query('{}', '$..a')", "_gs_generate_series(1, 2, 0)", "_gs_zip_arrays(array(1), array(1, 2))", "decimal_arb_div('1', '0')", "to_decimal_arb_from_string('100', 2, 0)", "regexp_instr('a', 'a', 0)", "json_object(cast(null as string), 1)"])
def test_errors(ask, sql):
    with pytest.raises(Exception):  # noqa: B017
        ask(sql)


def test_rows_and_aggregates(spark, ask):
    assert ask("_gs_zip_arrays(array(1, 2), array('a', 'b'))") == [(1, "a"), (2, "b")]
    assert ask("array_enumerate(array('a'))") == [(0, "a")]
    rows = "(SELECT array(named_struct('k', 'a', 'n', 1), named_struct('k', 'b', 'n', 2), named_struct('k', cast(null as string), 'n', 3)) AS s)"
    q = lambda e: spark.sql(f"SELECT {library.rewritten(e)} AS v FROM {rows}").first().v
    assert [r.n for r in q("array_filter(s, 'k', 'b')")] == [2] and [r.n for r in q("array_filter(s, 'k', cast(null as string))")] == [3]
    assert q("array_filter_first(s, 'k', 'a')").n == 1 and q("array_filter_first(s, 'k', 'z')") is None and [r.n for r in q("array_filter_in(s, 'k', array('a', 'b'))")] == [1, 2]
    table = "VALUES (1, 'a', 1), (1, 'b', null), (2, 'c', 3) AS t(g, k, v)"
    got = spark.sql(library.rewritten(f"SELECT g, json_objectagg_null_on_null(k, v) AS o, json_objectagg_absent_on_null(k, v) AS p, json_arrayagg_absent_on_null(v) AS q FROM {table} GROUP BY g ORDER BY g")).collect()
    assert [tuple(r) for r in got] == [(1, '{"a":1,"b":null}', '{"a":1}', "[1]"), (2, '{"c":3}', '{"c":3}', "[3]")]
    assert len(ask("uuid7()")) == 36 and ask("uuid7()")[14] == "7"


def test_text_is_rewritten_outside_strings_only():
    assert sqltext.expand("SELECT 'bin(1)', t.bin, \"bin(1)\" -- bin(1)\n, BIN( a ) FROM bin", library.MACROS).count("CASE") == 1
    assert sqltext.expand("f(g(1, 'a,)'), [2, 3])", {"f": lambda a: "|".join(a), "g": lambda a: "+".join(a)}) == "1+'a,)'|[2, 3]"
    assert sqltext.literal("'it''s'") == "it's" and sqltext.literal("a") is None and sqltext.literal("'a' || 'b'") is None


def test_wide_sums_and_order(spark):
    big = 10**60
    rows = [("a", f"{big}.25"), ("a", f"-{big - 1}.50"), ("a", None), ("b", "-0.01"), ("c", None)]
    df = spark.createDataFrame(rows, "g string, d string")
    assert {r.g: r.s for r in decimals.sums(df, ["g"], {"s": ("d", 63, 2)}).collect()} == {"a": "0.75", "b": "-0.01", "c": None}
    assert {r.g: r.m for r in decimals.averages(df, ["g"], {"m": ("d", 63, 2)}).collect()} == {"a": "0.375", "b": "-0.010", "c": None}
    values = ["-10", "-9.5", "-9.49", "-0.1", "0", "0.0001", "9", "9.5", "10", f"{big}", f"-{big}"]
    keyed = spark.createDataFrame([(v,) for v in values], "d string")
    got = [r.d for r in keyed.orderBy(decimals.order_key(keyed.d)).collect()]
    assert got == sorted(values, key=lambda v: decimals.rescaled(decimals.parsed(v), 4)[0])
    assert tuple(keyed.agg(decimals.minimum(keyed.d), decimals.maximum(keyed.d)).first()) == (f"-{big}", f"{big}")
    keys = sorted(values[:9], key=lambda v: decimals.sort_key_bytes(decimals.text(decimals.rescaled(decimals.parsed(v), 4))))
    assert keys == values[:9]
