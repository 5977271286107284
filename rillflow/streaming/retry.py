"""Retries with exponential backoff."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar
from urllib.error import HTTPError

Result = TypeVar("Result")


def retried(task: Callable[[], Result], attempts: int | None = None, first: float = 0.1, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Result:
    """Runs `task` until it succeeds; with `attempts`, that often at most. Errors of the caller's input aren't retried."""
    wait, n = first, 0
    while True:
        n += 1
        try:
            return task()
        except (OSError, TimeoutError) as e:
            # Of the answers 4xx only these two ask for another try.
            if isinstance(e, HTTPError) and 400 <= e.code < 500 and e.code not in (408, 429):
                raise
            if attempts is not None and n >= int(attempts):
                raise
            sleep(wait)
            wait = min(most, 2 * wait)
