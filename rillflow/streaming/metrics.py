"""Telemetry of frames and queries: row counts and event-time lag by `observe`, progress by a listener."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from rillflow.rowkind import DELETE, OP, UPDATE


def observed(df: DataFrame, name: str, event_time: str | None = None) -> tuple[DataFrame, Observation]:
    """`df` and what an action on it counts: rows by change kind, the latest event time. Nothing is dropped for being late."""
    seen = Observation(name)
    counts = [F.count(F.lit(1)).alias("rows")]
    if OP in df.columns:
        counts += [F.count_if(F.col(OP) == UPDATE).alias("updates"), F.count_if(F.col(OP) == DELETE).alias("deletes")]
    if event_time:
        counts.append(F.max(event_time).alias("latest"))
    return df.observe(seen, *counts), seen


class Progress(StreamingQueryListener):
    """Keeps the last progress of each query."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.ended: list[str] = []

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        self.rows[str(event.progress.id)] = self.rows.get(str(event.progress.id), 0) + event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.append(str(event.id))
