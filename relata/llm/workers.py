"""What a Python worker keeps from task to task.

Spark uses a worker again for later tasks, also of other stages, so values kept
in a module would stay beside those of the next operator.  Here at most one
operator's values are kept: another operator's first task in the same worker
gives them back to the system.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

_KEPT: dict[Hashable, Any] = {}


def release() -> None:
    """Forget what is kept, and return its memory."""
    if not _KEPT:
        return
    _KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def kept(owner: Hashable, make: Callable[[], Any]) -> Any:
    """The value kept for ``owner``; made now, in place of any other's, if there is none."""
    if owner not in _KEPT:
        release()
        _KEPT[owner] = make()
    return _KEPT[owner]
