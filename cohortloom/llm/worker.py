"""What a Python worker keeps from one task to the next.

Spark gives a worker that has ended a task to any later stage, also of other operators.  Objects that are dear to make are
kept for later tasks of the same operator, and go with the first task of another one, which needs the memory itself.
"""

from __future__ import annotations

import gc
from collections.abc import Callable

import pyarrow as pa

_KEPT: dict[tuple[str, str], object] = {}


def let_go(but: str | None = None) -> None:
    """Drop what operators other than ``but`` have kept in this worker."""
    others = [k for k in _KEPT if k[0] != but]
    for k in others:
        del _KEPT[k]
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()


def kept(operator: str, key: str, make: Callable[[], object]) -> object:
    """The object with this key, made once in a worker."""
    let_go(operator)
    if (operator, key) not in _KEPT:
        _KEPT[operator, key] = make()
    return _KEPT[operator, key]
