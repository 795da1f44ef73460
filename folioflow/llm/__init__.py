"""Operators for preparing training text: duplicates, privacy, licences, tokens, languages, neighbours."""

import ctypes

import pyarrow

#: Fixed value: glibc's name of the size from which memory is mapped and so goes back when it is freed.
_M_MMAP_THRESHOLD = -3
_LARGE = 1 << 20


def _give_memory_back() -> None:
    """Python workers live on from stage to stage beside the JVM, so large arrays and Arrow batches go back to the system as soon
    as they are freed: by default glibc raises the size from which they do, and Arrow's own pool keeps what it had."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:
        mallopt(_M_MMAP_THRESHOLD, _LARGE)
    pyarrow.set_memory_pool(pyarrow.system_memory_pool())


_give_memory_back()
