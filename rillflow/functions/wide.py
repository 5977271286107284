"""Wide decimals in SQL: operators, comparisons, aggregates and order of expressions that the analysed plan shows to be such.

A wide decimal is canonical text. What is one is known from where it comes: a conversion, arithmetic on
one, or a column whose metadata say so. Their places in the text of a statement are rewritten, innermost
first, until none is left; what has no rewrite is an error rather than arithmetic on doubles.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.functions.decimals import limbs_sql, type_of

Type = tuple[int, int]
METADATA = "decimal_arb"

# Spark's names of operators, and what they are called here.
_ARITHMETIC = {"Add": "add", "Subtract": "sub", "Multiply": "mul", "Divide": "div", "Remainder": "mod"}
_COMPARED = {"EqualTo": "=", "EqualNullSafe": "<=>", "LessThan": "<", "LessThanOrEqual": "<=", "GreaterThan": ">", "GreaterThanOrEqual": ">="}
_TERMS, _FACTORS, _COMPARISONS = frozenset("+-"), frozenset("*/%"), frozenset(("=", "==", "<>", "!=", "<=>", "<=", ">=", "<", ">"))
_TYPED = ("rf_decimal_cast", "rf_decimal_try_cast", "rf_decimal_from_string", "rf_decimal_try_from_string")
_SAME = ("rf_decimal_neg", "rf_decimal_abs")
_FIRST_OF = ("rf_decimal_greatest", "rf_decimal_least")
_WHOLE = {"byte": 3, "short": 5, "integer": 10, "long": 19}
#: Type of operands that show none.
UNKNOWN: Type = (58, 20)


def _name(e) -> str:
    return e.getClass().getSimpleName()


def _children(e) -> list:
    found = e.children()
    return [found.apply(k) for k in range(found.size())]


def _value_start(before: str) -> int:
    """Where the column, call or bracket begins that ends `before`; -1 if it is part of a longer expression."""
    from rillflow.functions.dialect import _operand, _solid, _text, _tree
    from rillflow.functions.sqltext import tokens

    level, at = [0], 0
    for kind, part in tokens(before):
        at += len(part)
        if kind == "other" and part in "([":
            level.append(at)
        elif kind == "other" and part in ")]" and len(level) > 1:
            level.pop()
    nodes = _tree(before[level[-1] :])
    first = _operand(nodes)
    if first < 0:
        return -1
    left = _solid(nodes, first - 1, -1) if first else -1
    if left >= 0 and not isinstance(nodes[left], list) and nodes[left][0] == "other" and nodes[left][1] != ",":
        return -1
    return level[-1] + len(_text(nodes[:first]))


class Plan:
    """Types of the wide decimals of an analysed plan, and the rewrites that its text needs."""

    def __init__(self, df: DataFrame, sql: str):
        self.sql = sql
        self.types: dict[int, Type] = {}
        self.spots: dict[tuple[int, int], str] = {}
        self.root = df._jdf.queryExecution().analyzed()
        self._walk(self.root)

    # ---- types ----

    def type(self, e) -> Type | None:
        name = _name(e)
        if name == "AttributeReference":
            known = self.types.get(e.exprId().id())
            if known is None and e.metadata().contains(METADATA):
                found = [int(x) for x in e.metadata().getString(METADATA).split(",") if x.strip()]
                known = (found[0], found[1] if len(found) > 1 else 0) if found else UNKNOWN
            return known
        if name == "Alias":
            return self.type(_children(e)[0])
        if name == "Cast":
            # A cast that analysis put in says nothing; one in the text to another type than text ends it.
            here = self.span(e)
            text = self.sql[here[0] : here[1]] if here else ""
            told = re.match(r"(try_)?cast\b", text, re.I) or "::" in text
            return None if told and e.dataType().typeName() != "string" else self.type(_children(e)[0])
        if name == "PythonUDF":
            fn, args = e.name(), _children(e)
            if fn in _TYPED:
                return tuple(int(str(self._bare(x))) if str(self._bare(x)).isdecimal() else UNKNOWN[k] for k, x in enumerate(args[1:3]))
            if fn in _SAME:
                return self.type(args[0]) or UNKNOWN
            if fn.removeprefix("rf_decimal_") in _ARITHMETIC.values():
                return type_of(fn.removeprefix("rf_decimal_"), self.operand(args[0]), self.operand(args[1]))
            if fn in _FIRST_OF or fn == "rf_decimal_from_bytes32":
                return UNKNOWN if fn in _FIRST_OF else (78, 0)
            if fn in ("rf_decimal_total", "rf_decimal_mean"):
                return 16 + UNKNOWN[0], int(str(self._bare(args[-1]))) + (fn == "rf_decimal_mean")
            return None
        if name in ("Coalesce", "If", "CaseWhen"):
            found = [t for t in map(self.type, _children(e)) if t]
            return max(found, key=lambda t: t[0]) if found else None
        if name == "AggregateExpression":
            inner = e.aggregateFunction()
            return self.type(_children(inner)[0]) if _name(inner) in ("MinBy", "MaxBy", "First", "Last", "AnyValue") else None
        return None

    def _bare(self, e):
        while _name(e) == "Cast":
            e = _children(e)[0]
        return e

    def operand(self, e) -> Type:
        """The type of an operand, wide or not."""
        known = self.type(e)
        if known:
            return known
        e = self._bare(e)
        kind = e.dataType().typeName()
        if _name(e) == "Literal" and kind == "string":
            digits = re.sub(r"[^\d.]", "", str(e))
            return max(1, len(digits.replace(".", ""))), len(digits.partition(".")[2])
        if kind in _WHOLE:
            return _WHOLE[kind], 0
        m = re.fullmatch(r"decimal\((\d+),(-?\d+)\)", kind)
        return (int(m[1]), int(m[2])) if m else UNKNOWN

    # ---- places ----

    def span(self, e) -> tuple[int, int] | None:
        o = e.origin()
        if o.startIndex().isEmpty() or o.sqlText().isEmpty() or o.sqlText().get() != self.sql:
            return None
        return int(o.startIndex().get()), int(o.stopIndex().get()) + 1

    def _operand(self, e, text: str) -> str:
        return text if self.type(e) else f"cast({text} AS string)"

    def _rewrite(self, e) -> str | None:
        from rillflow.functions.dialect import Group, _split, _text, _tree, halves

        name, here = _name(e), self.span(e)
        parts = _children(e)
        text = self.sql[here[0] : here[1]] if here else ""
        if name in ("Sum", "Average", "Min", "Max") and parts and self.type(parts[0]) and here:
            return self._aggregate(name, self.type(parts[0]), here)
        if not any(self.type(x) for x in parts):
            return None
        if here is None:
            if name in _ARITHMETIC or name in ("LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual", "UnaryMinus", "Abs", "In"):
                raise ValueError(f"unsupported on wide decimals: {e}")
            return None
        if name == "SortOrder":
            kind = self.type(e.child())
            value = re.sub(r"(\s+(asc|desc))?(\s+nulls\s+(first|last))?\s*$", "", text, flags=re.I)
            return f"rf_decimal_key(rf_decimal_cast({value}, {max(kind)}, {kind[1]}))" + text[len(value) :]
        if name in _ARITHMETIC or name in _COMPARED:
            cut = halves(text, _TERMS if name in ("Add", "Subtract") else _FACTORS if name in _ARITHMETIC else _COMPARISONS)
            told = re.fullmatch(r"(.*\S)\s+is\s+(not\s+)?distinct\s+from\s+(.*)", text, re.I | re.S) if name == "EqualNullSafe" else None
            if not cut and not told:
                raise ValueError(f"unsupported on wide decimals: {text}")
            a, b = (self._operand(x, t) for x, t in zip(parts, (told[1], told[3]) if told else (cut[0], cut[2])))
            if name in _ARITHMETIC:
                return f"rf_decimal_{_ARITHMETIC[name]}({a}, {b})"
            if name == "EqualNullSafe":
                both = f"coalesce(rf_decimal_compare({a}, {b}) = 0, ({a}) IS NULL AND ({b}) IS NULL)"
                return f"(NOT {both})" if told and not told[2] else both
            return f"(rf_decimal_compare({a}, {b}) {'<>' if cut[1] in ('<>', '!=') else _COMPARED[name]} 0)"
        if name == "UnaryMinus":
            return f"rf_decimal_neg({text.strip()[1:].strip()})"
        if name == "Abs":
            return f"rf_decimal_abs({_text(next(n for n in _tree(text) if isinstance(n, Group)))})"
        if name == "In":
            # The place of a predicate begins behind its value.
            told = re.fullmatch(r"\s*(not\s+)?in\s*(\(.*\))\s*", text, re.I | re.S)
            start = _value_start(self.sql[: here[0]]) if told else -1
            if start < 0:
                raise ValueError(f"unsupported on wide decimals: {text}")
            value = self._operand(parts[0], self.sql[start : here[0]].strip())
            others = _split(next(n for n in _tree(told[2]) if isinstance(n, Group)))
            tests = " OR ".join(f"rf_decimal_compare({value}, {self._operand(x, _text(o).strip())}) = 0" for x, o in zip(parts[1:], others))
            self.spots[start, here[1]] = f"({'NOT ' if told[1] else ''}({tests}))"
        return None

    def _aggregate(self, name: str, kind: Type, here: tuple[int, int]) -> str:
        from rillflow.functions.dialect import Group, _text, _tree

        nodes = _tree(self.sql[here[0] : here[1]])
        at = next(k for k, n in enumerate(nodes) if isinstance(n, Group))
        value, tail = _text(nodes[at]).strip(), _text(nodes[at + 1 :])
        if value.lower().startswith("distinct ") or (re.search(r"\bover\b", tail, re.I) and name in ("Sum", "Average")):
            raise ValueError(f"unsupported on wide decimals: {self.sql[here[0]:here[1]]}")
        if name in ("Min", "Max"):
            return f"{name.lower()}_by({value}, rf_decimal_key(rf_decimal_cast({value}, {max(kind)}, {kind[1]}))){tail}"
        p, s = kind
        limbs = [f"cast(sum({x}){tail} AS string)" for x in limbs_sql(f"rf_decimal_cast({value}, {max(p, s)}, {s})", p)]
        total = f"rf_decimal_total(array({', '.join(limbs)}), {s})"
        return total if name == "Sum" else f"rf_decimal_mean({total}, count({value}){tail}, {s})"

    def _between(self, e) -> bool:
        from rillflow.functions.dialect import halves

        bounds, values = [], []

        def look(x) -> None:
            if _name(x) == "CommonExpressionDef":
                values.append(_children(x)[0])
            if _name(x) in ("GreaterThanOrEqual", "LessThanOrEqual"):
                bounds.append(x)
            for y in _children(x):
                look(y)

        look(e)
        parts = [y for x in bounds for y in _children(x)]
        parts[:1] = values[:1] or parts[:1]
        if not any(self.type(x) for x in parts):
            return False
        here = self.span(e)
        told = re.fullmatch(r"\s*(not\s+)?between\s+(.*)", self.sql[here[0] : here[1]], re.I | re.S) if here else None
        start = _value_start(self.sql[: here[0]]) if told else -1
        cut = halves(told[2], frozenset(["and"])) if told else None
        if start < 0 or not cut or len(parts) != 4:
            raise ValueError("unsupported on wide decimals: this BETWEEN")
        value, low, high = (self._operand(x, t) for x, t in zip((parts[0], parts[1], parts[3]), (self.sql[start : here[0]].strip(), cut[0], cut[2])))
        self.spots[start, here[1]] = f"({'NOT ' if told[1] else ''}(rf_decimal_compare({value}, {low}) >= 0 AND rf_decimal_compare({value}, {high}) <= 0))"
        return True

    def _expression(self, e) -> bool:
        """Notes the innermost rewrites below and at `e`; whether there was one."""
        if _name(e) == "Between" and self._between(e):
            return True
        if _name(e) in ("ScalarSubquery", "ListQuery", "Exists"):
            self._walk(e.plan())
        below = [self._expression(x) for x in _children(e)]
        if _name(e) == "AggregateExpression" and any(below):
            return True
        if any(below):
            return True
        before = len(self.spots)
        new = self._rewrite(e)
        if new is not None:
            self.spots[self.span(e)] = new
        return len(self.spots) > before

    def _walk(self, plan) -> None:
        if plan.nodeName() == "View":
            return
        if plan.nodeName() == "WithCTE":
            for k in range(plan.cteDefs().size()):
                self._walk(plan.cteDefs().apply(k))
        children = plan.children()
        for k in range(children.size()):
            self._walk(children.apply(k))
        found = plan.expressions()
        for k in range(found.size()):
            e = found.apply(k)
            self._expression(e)
            if _name(e) == "Alias" and (kind := self.type(e)):
                self.types[e.exprId().id()] = kind
        # Operators that only rename what is below: a CTE's or a union's columns by position.
        if plan.nodeName() in ("Union", "CTERelationRef", "SubqueryAlias"):
            self._carried(plan)

    def _carried(self, plan) -> None:
        out, below = plan.output(), plan.children()
        if plan.nodeName() == "Union" and below.size():
            first = below.apply(0).output()
            for k in range(out.size()):
                kind = self.type(first.apply(k))
                if kind:
                    self.types[out.apply(k).exprId().id()] = kind

    def columns(self) -> dict[str, Type]:
        """Wide decimals among the plan's columns."""
        out = self.root.output()
        found = {out.apply(k).name(): self.type(out.apply(k)) for k in range(out.size())}
        return {n: t for n, t in found.items() if t}


def concerns(sql: str, df: DataFrame | None = None) -> bool:
    return "rf_decimal_" in sql or (df is not None and any((f.metadata or {}).get(METADATA) is not None for f in df.schema.fields))


def marked(df: DataFrame, types: dict[str, Type]) -> DataFrame:
    """`df` whose wide decimals say so in their columns' metadata."""
    return df.select(*[F.col(f"`{c}`").alias(c, metadata={METADATA: f"{types[c][0]},{types[c][1]}"}) if c in types else F.col(f"`{c}`") for c in df.columns]) if types else df
