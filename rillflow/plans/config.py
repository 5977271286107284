"""Settings in layers: defaults, then a YAML file, then variables `RILLFLOW__SECTION__NAME` of the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping

DEFAULTS: dict = {
    "job_mode": False,
    "print_sink": {"sample_every": 1},
    "kafka_source": {"bootstrap_servers": "localhost:9092", "schema_registry_url": "http://localhost:18081"},
    "clickhouse_source": {"url": "http://localhost:8123", "user": "default", "password": "", "database": "default"},
    "checkpoint": {"dir": None},
    "file_source": {"poll_interval": "5s"},
}
PREFIX = "RILLFLOW__"


def _merged(below: dict, above: Mapping) -> dict:
    out = dict(below)
    for k, v in above.items():
        out[k] = _merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), dict) else v
    return out


def settings(path: str | None = None, environment: Mapping[str, str] | None = None) -> dict:
    import yaml

    out = DEFAULTS
    if path:
        with open(path, encoding="utf-8") as f:
            out = _merged(out, yaml.safe_load(f) or {})
    for name, value in (os.environ if environment is None else environment).items():
        if name.startswith(PREFIX):
            layer: object = yaml.safe_load(value)
            for part in reversed(name[len(PREFIX) :].lower().split("__")):
                layer = {part: layer}
            out = _merged(out, layer)
    return out
