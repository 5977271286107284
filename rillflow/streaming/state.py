"""A small key-value store for what a runner must remember across restarts."""

from __future__ import annotations

import json
import sqlite3


class MemoryState:
    def __init__(self):
        self._held: dict[str, str] = {}

    def get(self, key: str):
        return json.loads(self._held[key]) if key in self._held else None

    def put(self, key: str, value) -> None:
        self._held[key] = json.dumps(value)


class SqliteState:
    def __init__(self, path: str):
        self._db = sqlite3.connect(path)
        self._db.execute("CREATE TABLE IF NOT EXISTS state (key TEXT PRIMARY KEY, value TEXT)")

    def get(self, key: str):
        row = self._db.execute("SELECT value FROM state WHERE key = ?", (key,)).fetchone()
        return json.loads(row[0]) if row else None

    def put(self, key: str, value) -> None:
        with self._db:
            self._db.execute("INSERT INTO state VALUES (?, ?) ON CONFLICT (key) DO UPDATE SET value = excluded.value", (key, json.dumps(value)))


class Scoped:
    """A plugin's own part of a store: its keys are seen by it alone."""

    def __init__(self, store, name: str):
        self._store, self._name = store, name

    def get(self, key: str):
        return self._store.get(f"plugin.{self._name}.{key}")

    def put(self, key: str, value) -> None:
        self._store.put(f"plugin.{self._name}.{key}", value)
