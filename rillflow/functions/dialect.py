"""Forms of the pipeline dialect that Spark SQL writes otherwise: unnesting, lists, subscripts from 1, order of NULLs, casts to wide decimals, whole-number division.

All but the last are rewrites of the text by its brackets. Whether `/` divides whole numbers, and whether
`concat` joins text, depends on types: there the analysed plan says which places of the text to change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillflow.functions import wide
from rillflow.functions.sqltext import quote, tokens

# Words that end a FROM clause, an ORDER BY list, and that a bracket after them doesn't subscript.
_AFTER_FROM = frozenset("where group having order limit offset union intersect except window qualify".split())
_AFTER_ORDER = frozenset("limit offset rows range groups union intersect except fetch".split())
_NO_OPERAND = frozenset("select in and or not when then else case by on where from having between like is distinct union all any some values limit as array".split())
_WHOLE = frozenset(("byte", "short", "integer", "long"))


class Group(list):
    """What stands between a bracket and its partner."""

    def __init__(self, opening: str, items: list):
        super().__init__(items)
        self.opening = opening


def _tree(sql: str) -> list:
    stack: list[list] = [[]]
    for token in tokens(sql):
        if token[0] == "other" and token[1] in "([":
            stack.append(Group(token[1], []))
        elif token[0] == "other" and token[1] in ")]" and len(stack) > 1:
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(token)
    while len(stack) > 1:
        done = stack.pop()
        stack[-1].append(done)
    return stack[0]


def _text(nodes) -> str:
    return "".join(n.opening + _text(n) + (")" if n.opening == "(" else "]") if isinstance(n, Group) else n[1] for n in nodes)


def _word(node) -> str:
    return node[1].lower() if not isinstance(node, Group) and node[0] == "word" else ""


def _space(node) -> bool:
    return not isinstance(node, Group) and node[0] == "space"


def _solid(nodes, at: int, step: int = 1) -> int:
    """The next position from `at` on that is no white space, or -1."""
    while 0 <= at < len(nodes):
        if not _space(nodes[at]):
            return at
        at += step
    return -1


def _split(nodes) -> list[list]:
    parts: list[list] = [[]]
    for n in nodes:
        if n == ("other", ","):
            parts.append([])
        else:
            parts[-1].append(n)
    return parts


def _operand(out: list) -> int:
    """Where the expression begins that a subscript after `out` belongs to; -1: there is none."""
    at = _solid(out, len(out) - 1, -1)
    if at < 0:
        return -1
    n = out[at]
    if isinstance(n, Group):
        if at and _word(out[at - 1]) and _word(out[at - 1]) not in _NO_OPERAND:
            at -= 1
    elif n[0] == "word" and n[1].lower() in _NO_OPERAND or n[0] not in ("word", "quoted", "raw"):
        return -1
    while at >= 2 and out[at - 1] == ("other", ".") and (isinstance(out[at - 2], Group) or out[at - 2][0] in ("word", "quoted", "raw")):
        at -= 2
        if isinstance(out[at], Group) and at and _word(out[at - 1]) and _word(out[at - 1]) not in _NO_OPERAND:
            at -= 1
    return at


def _subscripts(nodes) -> list:
    """`[a, b]` as array(a, b), `x[n]` counted from 1; keys of maps and structs stay."""
    out: list = []
    for n in nodes:
        if not isinstance(n, Group):
            out.append(n)
            continue
        n = Group(n.opening, _subscripts(n))
        if n.opening == "(":
            out.append(n)
            continue
        at = _operand(out)
        if at < 0:
            if out and _word(out[-1]) == "array":
                out.pop()
            out.append(("raw", f"array({_text(n)})"))
        elif [x[0] for x in n if not _space(x) and not isinstance(x, Group)] == ["string"] and len([x for x in n if not _space(x)]) == 1:
            out[at:] = [("raw", _text([*out[at:], n]))]
        else:
            out[at:] = [("raw", f"try_element_at({_text(out[at:]).strip()}, {_text(n)})")]
    return out


def _null_order(nodes) -> list:
    """NULLs come last in ascending and first in descending order, unless the text says so."""
    nodes = [Group(n.opening, _null_order(n)) if isinstance(n, Group) else n for n in nodes]
    out, at = [], 0
    while at < len(nodes):
        out.append(nodes[at])
        by = _solid(nodes, at + 1)
        if _word(nodes[at]) != "order" or by < 0 or _word(nodes[by]) != "by":
            at += 1
            continue
        end = next((k for k in range(by, len(nodes)) if _word(nodes[k]) in _AFTER_ORDER or nodes[k] == ("other", ";")), len(nodes))
        out += nodes[at + 1 : by + 1]
        for k, item in enumerate(_split(nodes[by + 1 : end])):
            words = [_word(x) for x in item if not _space(x)]
            tail = [] if not words or "nulls" in words else [("raw", " NULLS FIRST" if words[-1] == "desc" else " NULLS LAST")]
            last = _solid(item, len(item) - 1, -1) + 1
            out += ([("other", ",")] if k else []) + item[:last] + tail + item[last:]
        at = end
    return out


def _wide_casts(nodes) -> list:
    """CAST(x AS DECIMAL(p, s)) and x::DECIMAL(p, s) beyond 38 digits give canonical text."""
    out: list = []
    at = 0
    while at < len(nodes):
        n = nodes[at]
        if not isinstance(n, Group):
            kind = _solid(nodes, at + 1)
            size = _wide(nodes, kind) if n == ("other", "::") and kind >= 0 else None
            if size:
                begin = _operand(out)
                out[begin:] = [("raw", f"rf_decimal_cast(cast({_text(out[begin:])} AS string), {size[0]}, {size[1]})")]
                at = size[2] + 1
                continue
            out.append(n)
            at += 1
            continue
        n = Group(n.opening, _wide_casts(n))
        before = _solid(out, len(out) - 1, -1)
        name = _word(out[before]) if before >= 0 else ""
        by = next((k for k in range(len(n) - 1, -1, -1) if _word(n[k]) == "as"), -1)
        size = _wide(n, _solid(n, by + 1)) if name in ("cast", "try_cast") and by >= 0 else None
        if size:
            out[before:] = [("raw", f"{'rf_decimal_cast' if name == 'cast' else 'rf_decimal_try_cast'}(cast({_text(n[:by]).strip()} AS string), {size[0]}, {size[1]})")]
        else:
            out.append(n)
        at += 1
    return out


def _wide(nodes, at: int) -> tuple[int, int, int] | None:
    """(precision, scale, last position) of a type DECIMAL(p, s) with more than 38 digits."""
    if at < 0 or _word(nodes[at]) not in ("decimal", "numeric"):
        return None
    size = _solid(nodes, at + 1)
    if size < 0 or not isinstance(nodes[size], Group):
        return None
    numbers = [int(_text(x)) for x in _split(nodes[size])]
    return (numbers[0], numbers[1] if len(numbers) > 1 else 0, size) if numbers[0] > 38 else None


def _unnested(nodes, count: list[int]) -> list:
    """unnest() in SELECT lists and CROSS JOIN UNNEST() as generators; lists of one SELECT in lockstep."""
    nodes = [Group(n.opening, _unnested(n, count)) if isinstance(n, Group) else n for n in nodes]
    nodes = _joined(nodes, count)
    starts = [k for k, n in enumerate(nodes) if _word(n) == "select"]
    for start in reversed(starts):
        end = next((k for k in range(start + 1, len(nodes)) if _word(nodes[k]) in ("from", "union", "intersect", "except")), len(nodes))
        found = [k for k in range(start + 1, end) if _word(nodes[k]) == "unnest" and _solid(nodes, k + 1) >= 0 and isinstance(nodes[_solid(nodes, k + 1)], Group)]
        if not found:
            continue
        whole = [k for k in found if (b := _solid(nodes, k - 1, -1)) >= 0 and (b == start or nodes[b] == ("other", ",")) and ((a := _solid(nodes, _solid(nodes, k + 1) + 1)) < 0 or a >= end or nodes[a] == ("other", ",") or _word(nodes[a]) == "as" or nodes[a][0] in ("word", "quoted"))]
        if len(found) == 1 == len(whole):
            k = found[0]
            arg, depth = _depth(nodes[_solid(nodes, k + 1)])
            nodes[k : _solid(nodes, k + 1) + 1] = [("raw", f"explode({'flatten(' * depth}{arg}{')' * depth})")]
            continue
        count[0] += 1
        name = f"_unnest{count[0]}"
        lists = []
        for n, k in reversed(list(enumerate(found))):
            group = _solid(nodes, k + 1)
            arg, depth = _depth(nodes[group])
            lists.insert(0, f"coalesce({'flatten(' * depth}{arg}{')' * depth}, array())")
            nodes[k : group + 1] = [("raw", f"{name}.c{n}")]
        begin = next(k for k in range(start + 1, len(nodes)) if _word(nodes[k]) == "from")
        stop = next((k for k in range(begin, len(nodes)) if _word(nodes[k]) in _AFTER_FROM or nodes[k] == ("other", ";")), len(nodes))
        nodes.insert(stop, ("raw", f" LATERAL VIEW inline(arrays_zip({', '.join(lists)})) {name} AS {', '.join(f'c{n}' for n in range(len(found)))} "))
    return nodes


def _depth(group: Group) -> tuple[str, int]:
    """The argument below unnest(unnest(...)), and how often its lists are flattened first."""
    depth = 0
    while True:
        k = _solid(group, 0)
        inner = _solid(group, k + 1) if k >= 0 else -1
        if k >= 0 and inner >= 0 and isinstance(group[inner], Group) and (_word(group[k]) == "unnest") and _solid(group, inner + 1) < 0:
            group, depth = group[inner], depth + 1
        elif k >= 0 and group[k][0] == "raw" and group[k][1].startswith("explode(") and _solid(group, k + 1) < 0:
            return group[k][1][len("explode(") : -1], depth + 1
        else:
            return _text(group).strip(), depth


def _joined(nodes, count: list[int]) -> list:
    """`CROSS JOIN UNNEST(x) AS t(c)`, and the same after a comma, as lateral views."""
    out, at = [], 0
    while at < len(nodes):
        group = _solid(nodes, at + 1)
        before = _solid(out, len(out) - 1, -1)
        in_from = any(_word(n) == "from" for n in out) and not any(_word(n) in _AFTER_FROM for n in out[max(k for k, n in enumerate(out) if _word(n) == "from") :]) if out else False
        crossed = before >= 0 and _word(out[before]) == "join" and (b := _solid(out, before - 1, -1)) >= 0 and _word(out[b]) == "cross"
        if _word(nodes[at]) != "unnest" or group < 0 or not isinstance(nodes[group], Group) or not (crossed or (in_from and before >= 0 and out[before] == ("other", ","))):
            out.append(nodes[at])
            at += 1
            continue
        del out[_solid(out, before - 1, -1) if crossed else before :]
        count[0] += 1
        name, columns, at = f"_unnest{count[0]}", [], group + 1
        k = _solid(nodes, at)
        if k >= 0 and _word(nodes[k]) == "as":
            k = _solid(nodes, k + 1)
        if k >= 0 and not isinstance(nodes[k], Group) and nodes[k][0] in ("word", "quoted") and _word(nodes[k]) not in _AFTER_FROM | {"cross", "join", "left", "inner"}:
            name, at = nodes[k][1], k + 1
            k = _solid(nodes, at)
            if k >= 0 and isinstance(nodes[k], Group):
                columns, at = [_text(c).strip() for c in _split(nodes[k])], k + 1
        columns = columns or [name]
        out.append(("raw", f" LATERAL VIEW {'inline' if len(columns) > 1 else 'explode'}({_text(nodes[group])}) {name} AS {', '.join(columns)} "))
    return out


def prepared(sql: str) -> str:
    """`sql` with the forms that need no types as Spark writes them."""
    return _text(_unnested(_null_order(_subscripts(_wide_casts(_tree(sql)))), [0]))


# Strftime fields and the same in Spark's patterns.
_TIME_FIELDS = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "p": "a", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy", "%": "%", "z": "xx", "Z": "VV"}


def time_pattern(strftime: str) -> str:
    """A pattern of `%` fields as one of Spark's."""
    out, plain, at = [], "", 0

    def flush() -> None:
        nonlocal plain
        if plain:
            out.append("'" + plain.replace("'", "''") + "'" if any(c.isalpha() or c in "'[]{}#" for c in plain) else plain)
        plain = ""

    while at < len(strftime):
        c = strftime[at]
        if c != "%":
            plain += c
            at += 1
            continue
        field = strftime[at + 1 : at + 2]
        if field not in _TIME_FIELDS:
            raise ValueError(f"unsupported field %{field} in {strftime}")
        if field == "%":
            plain += "%"
        else:
            flush()
            out.append(_TIME_FIELDS[field])
        at += 2
    flush()
    return "".join(out)


def ordered_list(args: list[str]) -> str:
    """`array_agg(v [ORDER BY k [DESC] [NULLS ...], ...])`: all values of a group, NULLs too."""
    nodes = _tree(args[0])
    order = next((k for k, n in enumerate(nodes) if _word(n) == "order"), -1)
    if order < 0:
        return f"transform(collect_list(named_struct('v', {args[0]})), s -> s.v)"
    keys = [nodes[_solid(nodes, order + 1) + 1 :], *(_tree(a) for a in args[1:])]
    fields, rules = [], ""
    for n, key in reversed(list(enumerate(keys))):
        words = [_word(x) for x in key if not _space(x)]
        end = next((k for k, x in enumerate(key) if _word(x) in ("asc", "desc", "nulls")), len(key))
        up = -1 if "desc" in words else 1
        first = words[-1] == "first" if "nulls" in words else up < 0
        fields.insert(0, f", 'k{n}', {_text(key[:end]).strip()}")
        rules = f"WHEN l.k{n} IS NULL AND r.k{n} IS NOT NULL THEN {-1 if first else 1} WHEN r.k{n} IS NULL AND l.k{n} IS NOT NULL THEN {1 if first else -1} WHEN l.k{n} < r.k{n} THEN {-up} WHEN l.k{n} > r.k{n} THEN {up} {rules}"
    value = _text(nodes[:order]).strip()
    return f"transform(array_sort(collect_list(named_struct('v', {value}{''.join(fields)})), (l, r) -> CASE {rules}ELSE 0 END), s -> s.v)"


def time_text(args: list[str]) -> str:
    """to_char of a time by `%` fields; other patterns are Spark's own."""
    from rillflow.functions.sqltext import literal

    pattern = literal(args[1])
    if pattern is None or "%" not in pattern:
        return f"to_char({', '.join(args)})"
    return f"date_format({args[0]}, {quote(time_pattern(pattern))})"


def halves(text: str, operators: frozenset[str]) -> tuple[str, str, str, int] | None:
    """(left, operator, right, the operator's place) of the last of `operators` outside of brackets and CASE that stands between two operands."""
    found, at, depth, before = None, 0, 0, None
    for kind, part in tokens(text):
        word = part.lower() if kind == "word" else ""
        depth += (part in "([" and kind == "other") + (word == "case") - (part in ")]" and kind == "other") - (word == "end")
        operand = before is not None and (before[0] != "other" or before[1] in ")]") and not (before[0] == "word" and before[1].lower() in _NO_OPERAND)
        if not depth and (part if kind == "other" else word) in operators and operand:
            found = (at, len(part), part)
        if kind != "space":
            before = (kind, part)
        at += len(part)
    if not found:
        return None
    at, size, part = found
    return text[:at].strip(), part, text[at + size :].strip(), at


# ---- by types --------------------------------------------------------------------------------------

_SUBQUERIES = frozenset(("ScalarSubquery", "ListQuery", "Exists"))


def _spots(df: DataFrame, sql: str) -> list[tuple[int, int, str]]:
    """Places of `sql` to change: (start, stop, new text), of operators on whole numbers and concatenations of text."""
    out: dict[int, tuple[int, int, str]] = {}

    def span(e) -> tuple[int, int] | None:
        o = e.origin()
        if o.startIndex().isEmpty() or o.sqlText().isEmpty() or o.sqlText().get() != sql:
            return None
        return int(o.startIndex().get()), int(o.stopIndex().get()) + 1

    def expression(e) -> None:
        name = e.getClass().getSimpleName()
        if name == "Divide":
            sides = [e.left(), e.right()]
            if all(x.getClass().getSimpleName() == "Cast" and x.child().dataType().typeName() in _WHOLE for x in sides):
                here = span(e)
                cut = here and halves(sql[here[0] : here[1]], frozenset("*/%"))
                if cut and cut[1] == "/":
                    at = here[0] + cut[3]
                    out[at] = (at, at + 1, " div ")
        elif name == "Concat" and e.dataType().typeName() == "string":
            here = span(e)
            if here and sql[here[0] : here[0] + 7].lower() == "concat(":
                out[here[0]] = (here[0], here[0] + 7, "concat_ws('', ")
        if name in _SUBQUERIES:
            plan(e.plan())
        children = e.children()
        for k in range(children.size()):
            expression(children.apply(k))

    def plan(p) -> None:
        if p.nodeName() == "View":
            return
        found = p.expressions()
        for k in range(found.size()):
            expression(found.apply(k))
        if p.nodeName() == "WithCTE":
            for k in range(p.cteDefs().size()):
                plan(p.cteDefs().apply(k))
        children = p.children()
        for k in range(children.size()):
            plan(children.apply(k))

    plan(df._jdf.queryExecution().analyzed())
    return list(out.values())


def _patched(sql: str, spots: list[tuple[int, int, str]]) -> str:
    for start, stop, new in sorted(spots, reverse=True):
        sql = sql[:start] + new + sql[stop:]
    return sql


def _analysed(spark: SparkSession, sql: str) -> DataFrame:
    """The plan of a text that still has operators between wide decimals: by lenient rules text and text may be added."""
    from rillflow.functions.library import ready

    strict = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        return spark.sql(ready(spark, sql))
    finally:
        spark.conf.set("spark.sql.ansi.enabled", strict)


def by_types(spark: SparkSession, sql: str, wide_columns: bool = False) -> str:
    """`sql` with wide decimals' operators as functions, `/` between whole numbers as `div`, and `concat` of text skipping NULLs.

    `wide_columns`: a table that it reads has wide decimals.
    """
    from rillflow.functions.library import ready

    while wide_columns or wide.concerns(sql):
        spots = [(*place, new) for place, new in wide.Plan(_analysed(spark, sql), sql).spots.items()]
        if not spots:
            break
        sql = _patched(sql, spots)
    while ("other", "/") in (parts := tokens(sql)) or any(t[1].lower() == "concat" for t in parts):
        spots = _spots(spark.sql(ready(spark, sql)), sql)
        if not spots:
            break
        sql = _patched(sql, spots)
    return sql
