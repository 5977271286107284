"""Rewriting calls in SQL text: functions of the pipeline dialect become Spark expressions.

The names exist inside pipeline SQL only, so they shadow no built-in of the session, and templates
keep expressions inside Catalyst whatever the types of their arguments.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

_TOKEN = re.compile(
    r"(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<string>'(?:[^'\\]|''|\\.)*')|(?P<quoted>\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`)"
    r"|(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)|(?P<word>[A-Za-z_][A-Za-z_0-9]*)|(?P<other>::|\|\||<=>|[<>!=]=|<>|.)",
    re.S,
)

Macro = Callable[[list[str]], str]


def tokens(sql: str) -> list[tuple[str, str]]:
    return [(m.lastgroup, m[0]) for m in _TOKEN.finditer(sql)]


def literal(text: str) -> str | None:
    """The value of an argument that is a plain string literal."""
    text = text.strip()
    if len(text) >= 2 and text[0] == text[-1] == "'" and tokens(text) == [("string", text)]:
        return re.sub(r"\\(.)", r"\1", text[1:-1].replace("''", "'"))
    return None


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def expand(sql: str, macros: Mapping[str, Macro]) -> str:
    """`sql` with every call of a macro replaced, innermost first. Names are case-insensitive; qualified ones aren't touched."""
    out, _ = _expand(tokens(sql), 0, macros, None)
    return out


def _expand(ts: list[tuple[str, str]], at: int, macros: Mapping[str, Macro], closing: str | None) -> tuple[str, int]:
    parts: list[str] = []
    while at < len(ts):
        kind, text = ts[at]
        if closing and text == closing and kind == "other":
            return "".join(parts), at
        if kind == "other" and text == "(":
            inner, at = _expand(ts, at + 1, macros, ")")
            parts.append(f"({inner})")
            at += 1
            continue
        if kind == "word" and text.lower() in macros and not (parts and parts[-1].rstrip().endswith(".")):
            opening = at + 1
            while opening < len(ts) and ts[opening][0] == "space":
                opening += 1
            if opening < len(ts) and ts[opening] == ("other", "("):
                args, at = _arguments(ts, opening + 1, macros)
                parts.append(macros[text.lower()](args))
                continue
        parts.append(text)
        at += 1
    return "".join(parts), at


def _arguments(ts: list[tuple[str, str]], at: int, macros: Mapping[str, Macro]) -> tuple[list[str], int]:
    args: list[list[tuple[str, str]]] = [[]]
    depth = 0
    while True:
        if at >= len(ts):
            raise ValueError("unbalanced parentheses in SQL text")
        kind, text = ts[at]
        if kind == "other":
            if text in "([":
                depth += 1
            elif text in ")]":
                if not depth:
                    break
                depth -= 1
            elif text == "," and not depth:
                args.append([])
                at += 1
                continue
        args[-1].append(ts[at])
        at += 1
    out = [_expand(a, 0, macros, None)[0].strip() for a in args]
    return ([] if out == [""] else out), at + 1
