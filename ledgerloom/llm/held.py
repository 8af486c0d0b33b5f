"""What a Python worker keeps between tasks.

Spark reuses its workers for stage after stage.  A worker keeps one object, so
the model or tokenizer of an earlier stage goes when the next stage's comes.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import TypeVar

import pyarrow as pa

T = TypeVar("T")

_held: dict = {}


def held(key: Hashable, make: Callable[[], T]) -> T:
    """The worker's object of this key, made on first use; it replaces that of any other key."""
    if key not in _held:
        _held.clear()
        gc.collect()
        give_back()
        _held[key] = make()
    return _held[key]


def give_back() -> None:
    """Give free memory back to the system, so that an idle worker leaves it to the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library can do that
    if trim is not None:
        trim(0)
