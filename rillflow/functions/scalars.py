"""Functions that built-ins don't express, over single values; `register` makes Arrow UDFs of them."""

from __future__ import annotations

import base64
import functools
import json
import os
import re
import time

import pyarrow as pa
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- hashes and encodings --------------------------------------------------------------------------

# Fixed values of Keccak-f[1600]: rotation of each lane by x + 5 y.
_ROTATIONS = (0, 1, 62, 28, 27, 36, 44, 6, 55, 20, 3, 10, 43, 25, 39, 41, 45, 15, 21, 8, 18, 2, 61, 56, 14)
_MASK = (1 << 64) - 1


def _round_constants() -> list[int]:
    """From the degree-8 linear feedback shift register of the specification."""
    out, r = [], 1
    for _ in range(24):
        c = 0
        for j in range(7):
            if r & 1:
                c |= 1 << ((1 << j) - 1)
            r = (r << 1) ^ (0x171 if r & 0x80 else 0)
        out.append(c)
    return out


_ROUNDS = _round_constants()


def _rotated(x: int, n: int) -> int:
    return ((x << n) | (x >> (64 - n))) & _MASK if n else x


def keccak256(data: bytes) -> bytes:
    """The original Keccak with padding 01, not SHA3-256."""
    rate = 136
    data += b"\x01" + b"\0" * (-(len(data) + 1) % rate)
    data = data[:-1] + bytes([data[-1] | 0x80])
    s = [0] * 25
    for at in range(0, len(data), rate):
        for k in range(rate // 8):
            s[k] ^= int.from_bytes(data[at + 8 * k : at + 8 * k + 8], "little")
        for constant in _ROUNDS:
            c = [s[x] ^ s[x + 5] ^ s[x + 10] ^ s[x + 15] ^ s[x + 20] for x in range(5)]
            d = [c[x - 1] ^ _rotated(c[(x + 1) % 5], 1) for x in range(5)]
            b = [0] * 25
            for x in range(5):
                for y in range(5):
                    b[y + 5 * ((2 * x + 3 * y) % 5)] = _rotated(s[x + 5 * y] ^ d[x], _ROTATIONS[x + 5 * y])
            s = [b[k] ^ (~b[k - k % 5 + (k + 1) % 5] & b[k - k % 5 + (k + 2) % 5]) & _MASK for k in range(25)]
            s[0] ^= constant
    return b"".join(x.to_bytes(8, "little") for x in s[:4])


def keccak_text(text: str) -> str | None:
    if text.startswith("0x"):
        try:
            raw = bytes.fromhex(text[2:]) if re.fullmatch(r"[0-9a-fA-F]*", text[2:]) else None
        except ValueError:
            raw = None
        if raw is None:
            return None
    else:
        raw = text.encode()
    return "0x" + keccak256(raw).hex()


def xxhash128(text: str) -> str:
    return xxhash.xxh3_128_hexdigest(text.encode())


_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def from_base58(text: str | None) -> bytes:
    """Invalid text and NULL give no bytes."""
    n = 0
    for c in text or "":
        k = _BASE58.find(c)
        if k < 0:
            return b""
        n = 58 * n + k
    zeros = len(text or "") - len((text or "").lstrip("1"))
    return b"\0" * zeros + n.to_bytes((n.bit_length() + 7) // 8, "big")


def conv_base(number: str, source: int, target: int) -> str | None:
    """Integers of any size; lower-case digits, sign kept, NULL for bad input."""
    if not (2 <= source <= 36 and 2 <= target <= 36) or "_" in number or number != number.strip():
        return None
    try:
        n = int(number, source)
    except ValueError:
        return None
    digits, out, m = "0123456789abcdefghijklmnopqrstuvwxyz", "", abs(n)
    while m:
        m, r = divmod(m, target)
        out = digits[r] + out
    return ("-" if n < 0 else "") + (out or "0")


def uuid7(_: int) -> str:
    n = (time.time_ns() // 1_000_000) << 80 | int.from_bytes(os.urandom(10), "big")
    n = (n & ~(0xF << 76)) | 7 << 76
    n = (n & ~(0x3 << 62)) | 2 << 62
    h = f"{n:032x}"
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


# ---- regular expressions: an invalid pattern gives NULL --------------------------------------------


@functools.lru_cache(1024)
def _pattern(p: str) -> re.Pattern | None:
    try:
        return re.compile(p)
    except re.error:
        return None


def regexp_extract(text: str, pattern: str, group: int) -> str | None:
    p = _pattern(pattern)
    m = p.search(text) if p and 0 <= group <= p.groups else None
    return m[group] if m else None


def regexp_extract_all(text: str, pattern: str, group: int) -> list | None:
    p = _pattern(pattern)
    return [m[group] for m in p.finditer(text)] if p and 0 <= group <= p.groups else None


def regexp_substr(text: str, pattern: str) -> str | None:
    return regexp_extract(text, pattern, 0)


def regexp_count(text: str, pattern: str) -> int | None:
    p = _pattern(pattern)
    return sum(1 for _ in p.finditer(text)) if p else None


def regexp_instr(text: str, pattern: str, start: int, occurrence: int) -> int | None:
    if start < 1 or occurrence < 1:
        raise ValueError("regexp_instr counts start and occurrence from 1")
    p = _pattern(pattern)
    if p is None:
        return None
    for n, m in enumerate(p.finditer(text, start - 1)):
        if n == occurrence - 1:
            return m.start() + 1
    return 0


def regexp_replace(text: str, pattern: str, replacement: str) -> str | None:
    p = _pattern(pattern)
    return p.sub(lambda _: replacement, text) if p else None


def instr(text: str, part: str, start: int, occurrence: int) -> int | None:
    """From 1; a negative start searches backwards from the end, a start of 0 finds nothing."""
    if occurrence < 1:
        return None
    if start == 0:
        return 0
    if start > 0:
        at = start - 1
        for n in range(occurrence):
            found = text.find(part, at)
            if found < 0:
                return 0
            at = found + 1
        return at
    last = len(text) + start
    for n in range(occurrence):
        found = text.rfind(part, 0, last + len(part)) if last >= 0 else -1
        if found < 0:
            return 0
        last = found - 1
    return found + 1


# ---- JSON ------------------------------------------------------------------------------------------


def _bad(name: str):
    raise ValueError(f"{name} is no JSON")


_DECODER = json.JSONDecoder(parse_constant=_bad)
#: Texts of at most so many characters are kept with what they parse to, for the other functions of a batch.
KEPT_CHARS = 4096


@functools.lru_cache(20_000)
def _parsed(text: str):
    return _DECODER.decode(text)


def parsed(text: str):
    """The value of a JSON text, not to be changed."""
    return _parsed(text) if len(text) <= KEPT_CHARS else _DECODER.decode(text)


def dumped(value) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False, sort_keys=True)


def _in_order(value) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


_STEP = re.compile(r"\.([^.\[]+)|\[(\d+)\]|\['([^']*)'\]|\[\"([^\"]*)\"\]")


@functools.lru_cache(1024)
def json_path(path: str) -> tuple:
    """Steps of `$`, `.key`, `[n]`, `['key']`; anything else is an error."""
    steps, at = [], 1
    if not path.startswith("$"):
        raise ValueError(f"a JSON path starts with $: {path}")
    while at < len(path):
        m = _STEP.match(path, at)
        if not m or (m[1] is not None and (m[1].startswith("*") or "*" in m[1])):
            raise ValueError(f"unsupported JSON path: {path}")
        steps.append(int(m[2]) if m[2] is not None else next(k for k in (m[1], m[3], m[4]) if k is not None))
        at = m.end()
    return tuple(steps)


def _found(text: str, path: str) -> tuple[str, object]:
    """(kind, value): kind is error, missing, null, scalar or nested."""
    steps = json_path(path)
    try:
        value = parsed(text)
    except ValueError:
        return "error", None
    for s in steps:
        if isinstance(s, int) and isinstance(value, list) and s < len(value):
            value = value[s]
        elif isinstance(s, str) and isinstance(value, dict) and s in value:
            value = value[s]
        else:
            return "missing", None
    return ("null" if value is None else "nested" if isinstance(value, (dict, list)) else "scalar"), value


def _scalar(value) -> str:
    return value if isinstance(value, str) else dumped(value)


def json_exists(text: str, path: str, on_error: str) -> bool | None:
    kind, _ = _found(text, path)
    if kind == "error":
        mode = on_error.upper()
        if mode == "ERROR":
            raise ValueError(f"invalid JSON: {text[:80]}")
        return {"FALSE": False, "TRUE": True, "UNKNOWN": None}[mode]
    return kind in ("scalar", "nested")


def json_value(text: str, path: str, on_empty: str, empty: str | None, on_error: str, error: str | None) -> str | None:
    kind, value = _found(text, path)
    if kind == "scalar":
        return _scalar(value)
    mode, default, what = (on_error, error, "invalid JSON") if kind == "error" else (on_empty, empty, "no scalar at the path")
    mode = mode.upper()
    if mode == "ERROR":
        raise ValueError(f"{what}: {text[:80]}")
    return default if mode == "DEFAULT" else None


def json_query(text: str, path: str, wrapper: str, on_empty: str, on_error: str) -> str | None:
    kind, value = _found(text, path)
    how = wrapper.upper()
    if kind in ("nested", "scalar"):
        if "UNCONDITIONAL" in how or ("CONDITIONAL" in how and kind == "scalar"):
            return "[" + dumped(value) + "]"
        if kind == "nested":
            return dumped(value)
    mode = (on_error if kind == "error" else on_empty).upper()
    if mode == "ERROR":
        raise ValueError(f"no JSON object or array at {path}: {text[:80]}")
    return {"NULL": None, "EMPTY ARRAY": "[]", "EMPTY OBJECT": "{}"}[mode]


def parse_json(text: str) -> str | None:
    return dumped(parsed(text)) if text.strip() else None


def try_parse_json(text: str) -> str | None:
    try:
        return parse_json(text)
    except ValueError:
        return None


def is_json(text: str | None, kind: str) -> bool:
    if text is None:
        return False
    try:
        value = parsed(text)
    except ValueError:
        return False
    return {"VALUE": True, "OBJECT": isinstance(value, dict), "ARRAY": isinstance(value, list), "SCALAR": not isinstance(value, (dict, list))}[kind.upper()]


_ESCAPES = {'"': '\\"', "\\": "\\\\", "/": "\\/", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def json_quote(text: str) -> str:
    return '"' + "".join(_ESCAPES.get(c) or (c if ord(c) < 128 else f"\\u{ord(c):04x}") for c in text) + '"'


def json_unquote(text: str) -> str:
    if len(text) < 2 or text[0] != '"' or text[-1] != '"':
        return text
    try:
        value = json.loads(text)
    except ValueError:
        return text
    return value if isinstance(value, str) else text


def _embedded(value):
    """Text that holds a JSON object or array is taken as JSON."""
    if isinstance(value, str) and value[:1] in ("{", "["):
        try:
            return parsed(value)
        except ValueError:
            return value
    return value


def json_array(struct: str, absent: bool) -> str:
    """From a JSON object of the arguments in order."""
    values = [_embedded(v) for v in json.loads(struct).values()]
    return _in_order([v for v in values if not (absent and v is None)])


def json_object(struct: str, absent: bool) -> str:
    values = list(json.loads(struct).values())
    out = {}
    for k, v in zip(values[::2], values[1::2]):
        if k is None:
            raise ValueError("a key of json_object is NULL")
        if not (absent and v is None):
            out[k if isinstance(k, str) else _scalar(k)] = _embedded(v)
    return dumped(out)


def json_string(struct: str) -> str | None:
    value = json.loads(struct)["v"]
    return None if value is None else _in_order(value)


def json_arrayagg(items: list[str] | None, absent: bool) -> str | None:
    if not items:
        return None
    values = [_embedded(json.loads(x)["v"]) for x in items]
    values = [v for v in values if not (absent and v is None)]
    return _in_order(values)


def json_objectagg(items: list[str] | None, absent: bool) -> str | None:
    if not items:
        return None
    out = {}
    for x in items:
        row = json.loads(x)
        k, v = row["k"], row["v"]
        if k is None:
            raise ValueError("a key of a JSON object is NULL")
        k = k if isinstance(k, str) else _scalar(k)
        if absent and v is None:
            continue
        if k in out:
            raise ValueError(f"the key {k} comes twice in a JSON object")
        out[k] = _embedded(v)
    return dumped(out)


def tuples(text: str | None, keys: list[str] | None) -> str:
    """`[('a', null, 1), ...]` from an array of objects; text is quoted as it is."""
    if text is None or keys is None:
        return "[]"

    def shown(v) -> str:
        if v is None:
            return "null"
        return f"'{v}'" if isinstance(v, str) else dumped(v)

    return "[" + ", ".join("(" + ", ".join(shown(row.get(k) if isinstance(row, dict) else None) for k in keys) + ")" for row in parsed(text)) + "]"


def base64_text(data: bytes) -> str:
    return base64.b64encode(data).decode()


# ---- registration ----------------------------------------------------------------------------------

S, L, B, X, Y = T.StringType(), T.LongType(), T.BooleanType(), T.BinaryType(), T.ArrayType(T.StringType())

#: Private name -> (function, result, number of leading arguments whose NULL gives NULL).
SCALARS = {
    "rf_keccak256": (keccak_text, S, 1), "rf_xxhash128": (xxhash128, S, 1), "rf_from_base58": (from_base58, X, 0), "rf_conv_base": (conv_base, S, 3),
    "rf_regexp_extract": (regexp_extract, S, 3), "rf_regexp_extract_all": (regexp_extract_all, Y, 3), "rf_regexp_substr": (regexp_substr, S, 2),
    "rf_regexp_count": (regexp_count, L, 2), "rf_regexp_instr": (regexp_instr, L, 4), "rf_regexp_replace": (regexp_replace, S, 3), "rf_instr": (instr, L, 4),
    "rf_json_exists": (json_exists, B, 2), "rf_json_value": (json_value, S, 2), "rf_json_query": (json_query, S, 2), "rf_parse_json": (parse_json, S, 1),
    "rf_try_parse_json": (try_parse_json, S, 1), "rf_is_json": (is_json, B, 0), "rf_json_quote": (json_quote, S, 1), "rf_json_unquote": (json_unquote, S, 1),
    "rf_json_array": (json_array, S, 1), "rf_json_object": (json_object, S, 1), "rf_json_string": (json_string, S, 1), "rf_json_arrayagg": (json_arrayagg, S, 0),
    "rf_json_objectagg": (json_objectagg, S, 0), "rf_tuples": (tuples, S, 0),
}


def vectorised(f, kind: T.DataType, strict: int):
    """An Arrow UDF of a function of values; a NULL in the first `strict` arguments gives NULL."""
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)

    def run(*columns: pa.Array) -> pa.Array:
        values = [c.to_pylist() for c in columns]
        if not any(c.null_count for c in columns[:strict]):
            return pa.array(list(map(f, *values)), arrow)
        return pa.array([None if None in row[:strict] else f(*row) for row in zip(*values)], arrow)

    return F.arrow_udf(run, kind)
