"""Exact decimals beyond 38 digits: canonical text, its scale being the number of fraction digits.

Arithmetic is on integers scaled by powers of ten. Sums, extremes and order stay inside Spark: sums by
limbs of 18 digits in DECIMAL(38, 0), order by a text key that sorts as the numbers do.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The largest precision, the least scale of a quotient.
MOST_DIGITS, QUOTIENT_SCALE = 65_535, 18
_NUMBER = re.compile(r"\s*([+-]?)(\d*)(?:\.(\d*))?(?:[eE]([+-]?\d+))?\s*")

Value = tuple[int, int]


def parsed(text: str) -> Value:
    """(unscaled integer, scale)."""
    m = _NUMBER.fullmatch(text)
    if not m or not (m[2] or m[3]):
        raise ValueError(f"no decimal: {text[:80]}")
    whole, part, shift = m[2] or "", m[3] or "", int(m[4] or 0)
    n, scale = int(whole + part), len(part) - shift
    if scale < 0:
        n, scale = n * 10**-scale, 0
    return (-n if m[1] == "-" else n), scale


def text(v: Value) -> str:
    n, s = v
    digits = str(abs(n)).rjust(s + 1, "0")
    if len(digits) > MOST_DIGITS + 1:
        raise ValueError("a decimal of more than 65535 digits")
    sign = "-" if n < 0 else ""
    return f"{sign}{digits[:-s]}.{digits[-s:]}" if s else sign + digits


def half_even(n: int, d: int) -> int:
    q, r = divmod(n, d)
    twice = 2 * abs(r)
    return q + (1 if twice > abs(d) or (twice == abs(d) and q % 2) else 0)


def half_away(n: int, d: int) -> int:
    q = (2 * abs(n) + abs(d)) // (2 * abs(d))
    return q if (n < 0) == (d < 0) else -q


def rescaled(v: Value, scale: int, rounding=None) -> Value:
    """At another scale; without a rounding, lost digits are an error."""
    n, s = v
    if scale >= s:
        return n * 10 ** (scale - s), scale
    d = 10 ** (s - scale)
    if rounding:
        return rounding(n, d), scale
    if n % d:
        raise ValueError(f"{text(v)} needs more than {scale} fraction digits")
    return n // d, scale


def fits(v: Value, precision: int) -> Value:
    if abs(v[0]) >= 10**precision:
        raise ValueError(f"{text(v)} needs more than {precision} digits")
    return v


def declared(precision: int, scale: int) -> None:
    if not (1 <= precision <= MOST_DIGITS and 0 <= scale <= precision):
        raise ValueError(f"no decimal type ({precision}, {scale})")


def _aligned(a: str, b: str) -> tuple[int, int, int]:
    x, y = parsed(a), parsed(b)
    s = max(x[1], y[1])
    return rescaled(x, s)[0], rescaled(y, s)[0], s


def add(a: str, b: str) -> str:
    x, y, s = _aligned(a, b)
    return text((x + y, s))


def sub(a: str, b: str) -> str:
    x, y, s = _aligned(a, b)
    return text((x - y, s))


def mul(a: str, b: str) -> str:
    x, y = parsed(a), parsed(b)
    return text((x[0] * y[0], x[1] + y[1]))


def div(a: str, b: str) -> str:
    (x, s), (y, t) = parsed(a), parsed(b)
    if not y:
        raise ZeroDivisionError("division by zero")
    scale = max(s, QUOTIENT_SCALE)
    n, d = x * 10 ** (scale - s + t), y
    return text((half_even(n, d) if d > 0 else half_even(-n, -d), scale))


def mod(a: str, b: str) -> str:
    x, y, s = _aligned(a, b)
    if not y:
        raise ZeroDivisionError("division by zero")
    return text((int(math.copysign(1, x)) * (abs(x) % abs(y)) if x else 0, s))


def neg(a: str) -> str:
    n, s = parsed(a)
    return text((-n, s))


def absolute(a: str) -> str:
    n, s = parsed(a)
    return text((abs(n), s))


def compare(a: str, b: str) -> int:
    x, y, _ = _aligned(a, b)
    return (x > y) - (x < y)


def greatest(values: list[str | None]) -> str | None:
    return _extreme(values, max)


def least(values: list[str | None]) -> str | None:
    return _extreme(values, min)


def _extreme(values: list[str | None] | None, pick) -> str | None:
    held = [parsed(v) for v in values or [] if v is not None]
    if not held:
        return None
    s = max(v[1] for v in held)
    return text((pick(rescaled(v, s)[0] for v in held), s))


def sorted_array(values: list[str | None], order: str, nulls: str) -> list[str | None]:
    held = [v for v in values if v is not None]
    s = max((parsed(v)[1] for v in held), default=0)
    held.sort(key=lambda v: rescaled(parsed(v), s)[0], reverse=order.upper().startswith("DESC"))
    none = [None] * (len(values) - len(held))
    return none + held if nulls.upper().endswith("FIRST") else held + none


def from_string(a: str, precision: int, scale: int) -> str:
    declared(precision, scale)
    return text(fits(rescaled(parsed(a), scale), precision))


def try_from_string(a: str, precision: int, scale: int) -> str | None:
    try:
        return from_string(a, precision, scale)
    except ValueError:
        return None


def cast_wide(a: str, precision: int, scale: int) -> str:
    """SQL cast: half away from zero, then it must fit."""
    declared(precision, scale)
    return text(fits(rescaled(parsed(a), scale, half_away), precision))


def try_cast_wide(a: str, precision: int, scale: int) -> str | None:
    try:
        return cast_wide(a, precision, scale)
    except ValueError:
        return None


def to_decimal(a: str, precision: int, scale: int) -> str:
    """To a native decimal: half even, then it must fit."""
    return text(fits(rescaled(parsed(a), scale, half_even), precision))


def sort_key_bytes(a: str) -> bytes:
    n = parsed(a)[0]
    magnitude = abs(n).to_bytes((abs(n).bit_length() + 7) // 8, "big")
    key = len(magnitude).to_bytes(4, "big") + magnitude
    return b"\x00" + bytes(255 - b for b in key) if n < 0 else b"\x01" + key


def from_bytes32(data: bytes, kind: str) -> str:
    """A big-endian 32-byte integer, `u256` or `i256`."""
    if len(data) != 32:
        raise ValueError("an integer of 32 bytes is asked for")
    return str(int.from_bytes(data, "big", signed=kind == "i256"))


S = T.StringType()
SCALARS = {
    "rf_decimal_add": (add, S, 2), "rf_decimal_sub": (sub, S, 2), "rf_decimal_mul": (mul, S, 2), "rf_decimal_div": (div, S, 2), "rf_decimal_mod": (mod, S, 2),
    "rf_decimal_neg": (neg, S, 1), "rf_decimal_abs": (absolute, S, 1), "rf_decimal_compare": (compare, T.IntegerType(), 2), "rf_decimal_greatest": (greatest, S, 1),
    "rf_decimal_least": (least, S, 1), "rf_decimal_sort": (sorted_array, T.ArrayType(S), 1), "rf_decimal_from_string": (from_string, S, 3),
    "rf_decimal_try_from_string": (try_from_string, S, 3), "rf_decimal_cast": (cast_wide, S, 3), "rf_decimal_try_cast": (try_cast_wide, S, 3),
    "rf_decimal_native": (to_decimal, S, 3), "rf_decimal_key": (sort_key_bytes, T.BinaryType(), 1), "rf_decimal_from_bytes32": (from_bytes32, S, 2),
}


# ---- inside Spark ----------------------------------------------------------------------------------


def order_key(c: Column) -> Column:
    """Text that sorts as the canonical decimals do, whatever their scales: sign, number of whole digits, digits."""
    body = F.regexp_replace(c, "^-", "")
    whole = F.regexp_replace(F.substring_index(body, ".", 1), "^0+", "")
    part = F.rtrim(F.regexp_extract(body, r"\.(\d*)", 1), F.lit("0"))
    key = F.concat(F.lpad(F.length(whole).cast("string"), 5, "0"), whole, part)
    # Backwards for negative ones: nines' complement, then a mark above all digits.
    back = F.concat(F.translate(key, "0123456789", "9876543210"), F.lit("~"))
    negative = c.startswith("-") & F.regexp_replace(body, "[0.]", "").__ne__("")
    return F.when(negative, F.concat(F.lit("0"), back)).otherwise(F.concat(F.lit("1"), key))


def limbs(c: Column, precision: int, scale: int) -> list[Column]:
    """18 digits at a time from the left, signed; of texts at the declared scale."""
    n = math.ceil(precision / 18)
    digits = F.lpad(F.regexp_replace(c, "[-.]", ""), 18 * n, "0")
    sign = F.when(c.startswith("-"), -1).otherwise(1)
    return [F.substring(digits, 1 + 18 * k, 18).cast("decimal(20,0)") * sign for k in range(n)]


#: Sums of decimals of up to so many digits stay exact in Spark's own type: it adds ten digits.
NATIVE_DIGITS = 28


def limbs_sql(c: str, precision: int) -> list[str]:
    """As `limbs`, as SQL text."""
    n = math.ceil(precision / 18)
    digits = f"lpad(regexp_replace({c}, '[-.]', ''), {18 * n}, '0')"
    return [f"cast(substring({digits}, {1 + 18 * k}, 18) AS decimal(20,0)) * CASE WHEN startswith({c}, '-') THEN -1 ELSE 1 END" for k in range(n)]


def total(limb_sums: list, scale: int) -> str | None:
    if limb_sums[0] is None:
        return None
    n = 0
    for v in limb_sums:
        n = n * 10**18 + int(v)
    return text((n, scale))


def mean(total: str, n: int, scale: int) -> str:
    """At one more fraction digit, half even."""
    x, s = parsed(total)
    return text((half_even(x * 10 ** (scale + 1 - s), n), scale + 1))


SCALARS |= {"rf_decimal_total": (total, S, 1), "rf_decimal_mean": (mean, S, 1)}


def aggregated(df: DataFrame, groups: list[str], columns: dict[str, tuple[str, str, int, int]]) -> DataFrame:
    """Per group, `name -> (sum | avg | min | max, column, precision, scale)` as text, in one aggregation with partial results before the shuffle.

    A column is a native decimal or canonical text. Means have one more fraction digit, half even. Up to 28 digits
    Spark's decimals are exact and do the work; beyond, sums go by limbs of 18 digits and extremes by a key that
    sorts as the numbers do. Without values: NULL.
    """
    parts: list[Column] = []
    named: list[Column] = []
    for name, (fn, column, p, s) in columns.items():
        c = F.col(column)
        native = p <= NATIVE_DIGITS and (fn != "avg" or p + s + 13 <= 38)
        number = c.cast(T.DecimalType(min(p, 38), s if native else 0)) if native else c.cast("string")
        if fn in ("min", "max"):
            best = (F.min if fn == "min" else F.max)(number) if native else (minimum if fn == "min" else maximum)(number)
            parts.append(best.alias(name))
            named.append(F.col(name).cast("string").alias(name))
            continue
        if native:
            parts.append(F.sum(number).alias(f"{name}__0"))
        else:
            parts += [F.sum(x).alias(f"{name}__{k}") for k, x in enumerate(limbs(number, p, s))]
        parts.append(F.count(column).alias(f"{name}__n"))
        if native:
            total = F.col(f"{name}__0")
            named.append((total.cast("string") if fn == "sum" else _mean(total, F.col(f"{name}__n"), p, s)).alias(name))
        else:
            values = [F.col(f"{name}__{k}") for k in range(math.ceil(p / 18))]
            named.append((_joined(values, s) if fn == "sum" else _wide_mean(values, F.col(f"{name}__n"), s)).alias(name))
    return df.groupBy(*groups).agg(*parts).select(*groups, *named)


def sums(df: DataFrame, groups: list[str], columns: dict[str, tuple[str, int, int]]) -> DataFrame:
    """Per group, `name -> (column, precision, scale)`: the exact sum as text, NULL without values."""
    return aggregated(df, groups, {n: ("sum", *c) for n, c in columns.items()})


def averages(df: DataFrame, groups: list[str], columns: dict[str, tuple[str, int, int]]) -> DataFrame:
    """Exact mean at one more fraction digit, half even."""
    return aggregated(df, groups, {n: ("avg", *c) for n, c in columns.items()})


def _mean(total: Column, n: Column, precision: int, scale: int) -> Column:
    """Whole-number division with remainder, so that nothing is rounded twice."""
    whole, wide = T.DecimalType(38, 0), T.DecimalType(38, scale + 1)
    top = F.abs((total * F.lit(10 ** (scale + 1)).cast(T.DecimalType(scale + 2, 0))).cast(whole))
    rest = F.when(n > 0, top % n.cast(T.DecimalType(20, 0)))
    q = ((top - rest) / n.cast(T.DecimalType(20, 0))).cast(whole)
    up = (2 * rest > n) | ((2 * rest == n) & (q % 2 == 1))
    q = (q + F.when(up, 1).otherwise(0)).cast(whole)
    digits = F.lpad(q.cast("string"), F.greatest(F.length(q.cast("string")), F.lit(scale + 2)), F.lit("0"))
    text_ = F.concat(F.substr(digits, F.lit(1), F.length(digits) - (scale + 1)), F.lit("."), F.substr(digits, F.length(digits) - scale))
    return F.when((total < 0) & (q > 0), F.concat(F.lit("-"), text_)).otherwise(text_)


def _wide_mean(parts: list[Column], n: Column, scale: int) -> Column:
    from rillflow.functions.scalars import vectorised

    return vectorised(mean, S, 1)(_joined(parts, scale), n, F.lit(scale))


def _joined(parts: list[Column], scale: int) -> Column:
    from rillflow.functions.scalars import vectorised

    return vectorised(total, S, 1)(F.array(*[p.cast("string") for p in parts]), F.lit(scale))


def minimum(c: Column) -> Column:
    return F.min_by(c, order_key(c))


def maximum(c: Column) -> Column:
    return F.max_by(c, order_key(c))


# Result types: (precision, scale) of operands -> of the result, capped at the largest precision.
def type_of(op: str, a: tuple[int, int], b: tuple[int, int] = (1, 0)) -> tuple[int, int]:
    (p1, s1), (p2, s2) = a, b
    i1, i2, s = p1 - s1, p2 - s2, max(s1, s2)
    p, s = {
        "add": (max(i1, i2) + s + 1, s), "sub": (max(i1, i2) + s + 1, s), "mul": (p1 + p2 + 1, s1 + s2),
        "div": (i1 + s2 + max(s1, QUOTIENT_SCALE), max(s1, QUOTIENT_SCALE)), "mod": (min(i1, i2) + s, s),
        "sum": (p1 + 16, s1), "avg": (p1 + 1, s1 + 1), "min": a, "max": a,
    }[op]
    return min(p, MOST_DIGITS), s
