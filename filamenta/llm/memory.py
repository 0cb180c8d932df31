"""Python workers are shared by all stages of a job and live on; what a task has freed goes back to the machine here."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def give_back() -> None:
    """Returns freed memory of Arrow's pool and, where the C library can, of the heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
