"""What a Python worker keeps from task to task: the memory of one operator at a time.

Spark hands its workers from stage to stage, so what each operator left behind would add up.
"""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa

_HELD: dict[str, dict] = {}


def _give_back() -> None:
    """Hand freed memory to the system, where the C library offers that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def held(owner: str) -> dict:
    """This worker's memory for ``owner``, empty at first; that of any other operator is let go."""
    mine = _HELD.get(owner)
    if mine is None:
        _HELD.clear()
        _give_back()
        mine = _HELD[owner] = {}
    return mine
