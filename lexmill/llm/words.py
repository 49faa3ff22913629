"""Codes of a text's words, for a whole text at once."""

from __future__ import annotations

import numpy as np

_random = np.random.default_rng(20250101)
#: A random number for every byte; none for white space, so that it adds nothing to a word.
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_BYTES = np.where(_SPACE, np.uint64(0), _random.integers(1, 1 << 63, 256, dtype=np.uint64))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_powers = np.ones(1, np.uint64)


def _to_power(n: int) -> np.ndarray:
    """The first powers of _STEP, n at least."""
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(2 * n, _STEP))), dtype=np.uint64)
    return _powers


def lowered(text: str | None) -> bytes:
    """A text as UTF-8 with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)


def word_codes(data: bytes) -> np.ndarray:
    """64-bit codes of the words of a text in UTF-8, in order. Words are separated by ASCII white space.

    A word's code is a polynomial in its bytes' random numbers, so equal words have equal codes wherever they stand.
    """
    found = np.frombuffer(data, np.uint8)
    if not len(found):
        return np.empty(0, np.uint64)
    space = _SPACE[found]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = np.diff(np.append(starts, len(found)))  # with the white space behind
    within = np.arange(starts[0], len(found)) - np.repeat(starts, lengths)
    codes = np.add.reduceat(_BYTES[found[starts[0] :]] * _to_power(int(lengths.max()))[within], starts - starts[0])
    codes = (codes ^ (codes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return codes ^ (codes >> np.uint64(29))
