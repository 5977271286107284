"""Pipeline specifications: YAML or dicts with sources, transforms and sinks, checked and ordered."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from rillflow.functions.sqltext import tokens

SOURCES = ("file", "memory", "jdbc", "clickhouse", "kafka", "hybrid")
TRANSFORMS = ("sql", "script", "handler", "dynamic_table")
SINKS = ("print", "blackhole", "memory", "webhook", "postgres", "postgres_aggregate", "clickhouse", "kafka", "file")
FORMATS = {"csv": "csv", "json": "json", "ndjson": "json", "jsonl": "json", "parquet": "parquet", "avro": "avro", "orc": "orc"}
_SPAN = re.compile(r"\s*(\d+(?:\.\d+)?)\s*(ms|s|m|h)\s*")


class SpecError(ValueError):
    pass


@dataclass
class Node:
    name: str
    kind: str
    options: dict
    inputs: list[str] = field(default_factory=list)
    primary_key: list[str] = field(default_factory=list)


@dataclass
class Spec:
    sources: dict[str, Node]
    transforms: dict[str, Node]
    sinks: dict[str, Node]
    order: list[str]


def seconds(text: str | float | int) -> float:
    """A span such as 500ms, 10s, 2m."""
    if isinstance(text, (int, float)):
        return float(text)
    m = _SPAN.fullmatch(text)
    if not m:
        raise SpecError(f"no span of time: {text}")
    return float(m[1]) * {"ms": 0.001, "s": 1, "m": 60, "h": 3600}[m[2]]


def _keys(options: dict) -> list[str]:
    raw = options.get("primary_key")
    return [k.strip() for k in (raw if isinstance(raw, list) else (raw or "").split(",")) if k.strip()]


def tables(sql: str, known: set[str]) -> list[str]:
    """Names of nodes that `sql` reads: `name` or `schema.name`, quoted or not, outside of strings."""
    parts = [t for t in tokens(sql) if t[0] not in ("space", "string")]
    words = [x.strip('"`') if k in ("word", "quoted") else x for k, x in parts]
    out, at = [], 0
    lower = {k.lower(): k for k in known}
    while at < len(words):
        pair = ".".join(words[at : at + 3 : 2]).lower() if words[at + 1 : at + 2] == ["."] else None
        name = lower.get(pair) if pair in lower else lower.get(words[at].lower()) if not (at and words[at - 1] == ".") else None
        if name and name not in out and _after_from(words, at):
            out.append(name)
        at += 1
    return out


def _after_from(words: list[str], at: int) -> bool:
    before = words[at - 1].lower() if at else ""
    if before in ("from", "join"):
        return True
    # FROM a, b
    k = at - 1
    while k > 0 and words[k] == ",":
        k -= 1
        while k > 0 and words[k].lower() not in ("from", "select", "where", "(", ","):
            k -= 1
    return k >= 0 and bool(words) and words[k].lower() == "from" and at > k and before == ","


def load(raw: str | dict, preprocessors: list[Callable[[str], str]] = (), plugins: dict[str, object] | None = None) -> Spec:
    """From YAML text, the path of a YAML file, or a dict."""
    if isinstance(raw, str):
        text = open(raw, encoding="utf-8").read() if "\n" not in raw and os.path.exists(raw) else raw
        for p in preprocessors:
            text = p(text)
        try:
            import yaml
        except ImportError as e:
            raise SpecError("YAML needs the yaml module; a dict does without") from e
        raw = yaml.safe_load(text)
    if not isinstance(raw, dict):
        raise SpecError("a pipeline is a mapping of sources, transforms and sinks")
    unknown = set(raw) - {"sources", "transforms", "sinks", "name", "description"}
    if unknown:
        raise SpecError(f"unknown sections: {', '.join(sorted(unknown))}")
    sections = {}
    plugins = plugins or {}
    for section, kinds in (("sources", SOURCES), ("transforms", TRANSFORMS), ("sinks", SINKS)):
        nodes = {}
        for name, options in (raw.get(section) or {}).items():
            kind = (options or {}).get("type")
            if kind not in kinds and kind not in plugins:
                raise SpecError(f"{section}.{name}: unknown type {kind}")
            nodes[name] = Node(name, kind, options, primary_key=_keys(options))
        sections[section] = nodes
    if not sections["sources"] or not sections["sinks"]:
        raise SpecError("a pipeline has at least one source and one sink")
    return _linked(**sections)


def _linked(sources: dict[str, Node], transforms: dict[str, Node], sinks: dict[str, Node]) -> Spec:
    from rillflow.operators.lookup import checks

    twice = (sources.keys() & transforms.keys()) | (sinks.keys() & (sources.keys() | transforms.keys()))
    if twice:
        raise SpecError(f"names come twice: {', '.join(sorted(twice))}")
    known = {*sources, *transforms}
    filled = {n for n, t in transforms.items() if t.kind == "dynamic_table"}
    graph: dict[str, set[str]] = {}
    for t in transforms.values():
        sql = t.options.get("sql")
        if t.kind == "sql" and not sql:
            raise SpecError(f"{t.name}: a sql transform has sql")
        if t.kind == "sql" and not t.primary_key:
            raise SpecError(f"{t.name}: a sql transform has a primary_key")
        t.inputs = tables(sql, known - {t.name} - filled) if sql else [t.options["from"]] if "from" in t.options else []
        if t.kind != "dynamic_table" and not t.inputs:
            raise SpecError(f"{t.name}: it reads no source or transform")
        asked = [n for n, _ in checks(sql)] if sql and t.kind == "sql" else []
        for n in asked:
            if n not in filled:
                raise SpecError(f"{t.name}: there is no dynamic table {n}")
        t.options = {**t.options, "_checks": asked}
        graph[t.name] = {*t.inputs, *asked}
    for s in sinks.values():
        if "from" not in s.options:
            raise SpecError(f"{s.name}: a sink has from")
        s.inputs = [s.options["from"]]
    for n in [*transforms.values(), *sinks.values()]:
        for i in n.inputs:
            if i not in known:
                raise SpecError(f"{n.name}: there is no {i}")
    for t in transforms.values():
        for n in t.options["_checks"]:
            own = transforms[n].inputs
            if own and set(own) != set(t.inputs):
                raise SpecError(f"{t.name}: the dynamic table {n} is filled from {own[0]}, not from {t.inputs[0]}")
    used = {i for n in [*transforms.values(), *sinks.values()] for i in n.inputs}
    lone = [n for n in known - used - filled]
    if lone:
        raise SpecError(f"nothing reads {', '.join(sorted(lone))}")
    try:
        order = [n for n in TopologicalSorter(graph).static_order() if n in transforms]
    except CycleError as e:
        raise SpecError(f"transforms form a cycle: {' -> '.join(e.args[1])}") from e
    # Dynamic tables come as early as their inputs allow.
    return Spec(sources, transforms, sinks, order)
