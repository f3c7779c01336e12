"""Memory of the Python workers."""

from __future__ import annotations

import pyarrow as pa


def release() -> None:
    """Give freed memory back to the system.  Workers are kept between tasks, and what a large
    batch leaves in their allocators would count against the executor."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
