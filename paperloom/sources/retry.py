"""Retries on the driver with a fixed schedule, on transient errors only."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import TypeVar

T = TypeVar("T")

#: Seconds to wait before each further try: for a page that a reader waits for, and for a batch.
PAGE = (0.25, 1.0, 3.0)
BATCH = (2.0, 5.0, 10.0, 20.0, 30.0)
TRANSIENT = ("connection", "timeout", "timed out", "terminated", "reset", "unavailable")


def is_transient(error: BaseException) -> bool:
    text = str(error).lower()
    return isinstance(error, (ConnectionError, TimeoutError)) or any(t in text for t in TRANSIENT)


def with_retry(f: Callable[[], T], delays: Sequence[float] = PAGE, transient: Callable[[BaseException], bool] = is_transient, sleep: Callable[[float], None] = time.sleep) -> T:
    """f's result; after a transient error f is tried again after each delay, any other error leaves at once."""
    for delay in delays:
        try:
            return f()
        except Exception as e:
            if not transient(e):
                raise
            sleep(delay)
    return f()
