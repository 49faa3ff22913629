"""What a Python worker remembers from task to task, one kind at a time.

Workers live longer than the stages they work for. A kind of task that keeps a memory claims the worker first; all kinds
that don't keep one release it. So what one stage remembers is gone as soon as another kind runs in the same worker.
"""

from __future__ import annotations

from collections.abc import Callable

_held: dict[str, Callable[[], None]] = {}


def claim(name: str, forget: Callable[[], None]) -> None:
    """Forget what others remember in this worker; `forget` empties this memory when another kind of task comes."""
    release(name)
    _held[name] = forget


def release(but: str | None = None) -> None:
    """Forget all memories of this worker, but one."""
    others = [n for n in _held if n != but]
    for name in others:
        _held.pop(name)()
    if others or not _held:
        _give_back()


def _give_back() -> None:
    """Return to the system what this worker has freed but still holds."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library's own; others have none
    if trim is not None:
        trim(0)
