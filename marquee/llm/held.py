"""Memory of Python workers, which Spark reuses across stages and keeps while they are idle.

One large cache per worker: tasks of an operator share it, the next operator's tasks drop it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from typing import Any

import pyarrow as pa

_HELD: dict[tuple, Any] = {}


def held(key: tuple, build: Callable[[], Any]) -> Any:
    """What ``build`` made for ``key``, kept until another operator needs the room."""
    if key not in _HELD:
        free_held()
        _HELD[key] = build()
    return _HELD[key]


def free_held() -> None:
    """For tasks that keep nothing but need the room: Spark reuses workers across stages."""
    _HELD.clear()
    _give_back()


def tidy(run: Callable) -> Callable:
    """A task function that returns its freed memory to the system when it ends."""
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()
    return whole


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)
