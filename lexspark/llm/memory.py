"""Memory of Python workers, which go on from task to task."""

from __future__ import annotations

import ctypes


def trim() -> None:
    """Give memory that has been freed back to the system, where the C library can; called at the end of tasks that
    held many words or arrays, so that workers do not keep their peak through later stages."""
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)
