"""Memory of Python workers, which Spark keeps and hands from one operator's tasks to the next one's.

Some operators keep bounded tables of what they have computed in a worker (ids of words, distances of windows). They
register how to empty them here, and every operator names itself when a task of its starts: the tables of all
others are emptied then, and freed memory goes back to the system.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_KEPT: dict[str, Callable[[], None]] = {}
_LAST: list[str] = []


def keep(owner: str, empty: Callable[[], None]) -> None:
    """Register how to empty what ``owner`` keeps in this process."""
    _KEPT[owner] = empty


def start(owner: str) -> None:
    """Called by each task: empties what other owners keep if the last task was another's."""
    if _LAST == [owner]:
        return
    _LAST[:] = [owner]
    for name, empty in _KEPT.items():
        if name != owner:
            empty()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim is not None:
        trim(0)
