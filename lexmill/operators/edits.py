"""Edit distances and common subsequences of many pairs of texts at once, by tables whose rows are bits.

A pair is (asked, text). The asked text's characters are bits in blocks of 64, the text's are the columns. A block's column
needs that of the block before it and its own column before it; so in one step each block does the column behind that which
the block before it did, and all blocks of some thousand pairs make a step together. Bits before an asked text's first fill
its first block. Where there are few pairs, integers of any length do the same, pair by pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np

#: Blocks that make a step together, at most; the least number of pairs that do; and steps whose characters are looked up at once.
BLOCKS, PAIRS, STEPS = 2048, 10, 16
#: Columns of pairs that are held at once, at most.
HELD = 500_000

_U = np.uint64


@lru_cache(4)
def _places(text: str) -> dict[str, int]:
    """For each character the bits of its places. A region is compared with many stretches, so the last ones are kept; none may be changed."""
    found: dict[str, int] = {}
    for i, c in enumerate(text):
        found[c] = found.get(c, 0) | 1 << i
    return found


def common(a: str, b: str) -> int:
    """The length of the longest common subsequence. The rows of the table are bits of an integer."""
    places, full = _places(a), (1 << len(a)) - 1
    row = full
    for same in map(places.get, b, repeat(0)):
        hit = row & same
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def nearest_end(asked: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """(end, edits) of the stretch of a text that takes the fewest edits to become what is asked; the first of equals.

    It may begin anywhere, or, anchored, at the beginning of the text. A column of the table is two integers: where it rises, where it falls.
    """
    size = len(asked)
    places, full, top = _places(asked), (1 << size) - 1, size - 1
    rises, falls, edits, best, at = full, 0, size, size, 0
    if not size:
        return 0, 0
    for end, same in enumerate(map(places.get, text, repeat(0)), 1):
        flat = (((same & rises) + rises) ^ rises) | same
        up = falls | (full & ~(flat | rises))
        down = rises & flat
        if up >> top:
            edits += 1
        elif down >> top & 1:
            edits -= 1
            if edits < best:
                best, at = edits, end
        up, down = (up << 1 | anchored) & full, down << 1 & full
        rises, falls = down | (full & ~(same | falls | up)), up & (same | falls)
    return at, best


def nearest_ends(pairs: list[tuple[str, str]], anchored: bool = False) -> list[tuple[int, int]]:
    """`nearest_end` of each pair."""
    found: list[tuple[int, int]] = [(0, 0)] * len(pairs)
    for chosen, blocks in _alike([(len(a), len(b)) for a, b in pairs]):
        if len(chosen) < PAIRS:
            for k in chosen:
                found[k] = nearest_end(*pairs[k], anchored)
            continue
        columns = _Columns([pairs[k] for k in chosen], blocks, not anchored)
        sizes, edits = columns.sizes, np.cumsum(_edit_steps(columns, anchored), 0, dtype=np.int32)
        edits[np.arange(len(edits))[:, None] >= columns.lengths] = 1 << 30
        ends = np.argmin(edits, 0)
        least = sizes + edits[ends, np.arange(len(chosen))]
        for k, end, edit, size in zip(chosen, (ends + 1).tolist(), least.tolist(), sizes.tolist(), strict=True):
            found[k] = (end, edit) if edit < size else (0, size)
    return found


def commons(pairs: list[tuple[str, str, tuple[int, ...]]]) -> list[list[int]]:
    """`common` of an asked text and each of some beginnings of a text, given by their lengths."""
    found: list[list[int]] = [[]] * len(pairs)
    for chosen, blocks in _alike([(len(a), len(b)) for a, b, _ in pairs]):
        if len(chosen) < PAIRS:
            for k in chosen:
                a, b, ends = pairs[k]
                found[k] = [common(a, b[:end]) for end in ends]
            continue
        grown = np.cumsum(_common_steps(_Columns([pairs[k][:2] for k in chosen], blocks, False)), 0, dtype=np.int32)
        ends = [pairs[k][2] for k in chosen]
        counts = [len(e) for e in ends]
        at = np.array([x for e in ends for x in e], np.int64) - 1
        values = iter(np.where(at < 0, 0, grown[np.maximum(at, 0), np.repeat(np.arange(len(chosen)), counts)]).tolist())
        for k, count in zip(chosen, counts, strict=True):
            found[k] = [next(values) for _ in range(count)]
    return found


def _alike(sizes: list[tuple[int, int]]) -> Iterator[tuple[list[int], int]]:
    """Numbers of pairs of like sizes that go together, and the blocks of the longest asked text among them."""
    asked, text = np.array(sizes, np.int64).reshape(-1, 2).T
    need = (asked + 63) // 64
    # pairs without a character have no steps
    order = np.lexsort((text, np.where(text > 0, need, 0)))
    chosen: list[int] = []
    first = 0
    for k, blocks, length in zip(order.tolist(), need[order].tolist(), text[order].tolist(), strict=True):
        blocks *= length > 0
        if chosen and ((len(chosen) + 1) * blocks > BLOCKS or (len(chosen) + 1) * length > HELD or blocks > (2 * first if len(chosen) * blocks < BLOCKS // 8 else first + first // 4)):
            yield chosen, before
            chosen = []
        if not chosen:
            first = blocks
        chosen.append(k)
        before = blocks
        if not blocks:
            yield chosen, 0
            chosen = []
    if chosen:
        yield chosen, before


class _Columns:
    """Pairs as columns: for each step the bits of the places of each pair's characters, by block."""

    def __init__(self, pairs: list[tuple[str, str]], blocks: int, filled: bool):
        """With filled, the bits before an asked text's first are places of every character, else of none."""
        self.pairs, self.blocks = len(pairs), blocks
        kinds: dict[str, int] = {}
        kind = np.array([kinds.setdefault(a, len(kinds)) for a, _ in pairs])
        sizes, bits = np.array([len(a) for a in kinds]), np.arange(64 * blocks)
        letters = _codes(kinds, len(bits), str.rjust)
        # letters as numbers, the frequent ones next to each other; 0: in no asked text
        often = np.bincount(letters.reshape(-1))
        order = np.argsort(-often, kind="stable")[: np.count_nonzero(often)]
        known = np.zeros(len(often) + 1, np.int64)
        known[order] = np.arange(1, len(order) + 1)
        width = int(known.max()) + 2  # the last: what is before an asked text's first
        places = known[letters]
        places[bits < len(bits) - sizes[:, None]] = width - 1
        places += np.arange(len(kinds))[:, None] * width + (bits >> 6) * (len(kinds) * width)
        self.table = np.zeros((blocks, len(kinds) * width), _U)
        np.add.at(self.table.reshape(-1), places.reshape(-1), np.tile(np.left_shift(_U(1), (bits & 63).astype(_U)), len(kinds)))
        by_kind = self.table.reshape(blocks, len(kinds), width)
        before = by_kind[:, :, -1].copy()
        if filled:
            by_kind |= before[:, :, None]
        self.before = before[:, kind]
        self.sizes, self.lengths = sizes[kind], np.array([len(b) for _, b in pairs])
        self.steps = int(self.lengths.max())
        # the characters of the texts as places in the table, a column each, with as many columns of none around them as blocks wait
        self.texts = np.zeros((self.steps + 2 * blocks, self.pairs), np.int64)
        self.texts[blocks : blocks + self.steps] = known.take(_codes([b for _, b in pairs], self.steps, str.ljust), mode="clip").T
        self.texts += kind * width

    def __iter__(self) -> Iterator[np.ndarray]:
        """For each step the bits by block and pair: block b is b columns behind the first. The array is used again."""
        held = np.empty((STEPS, self.blocks, self.pairs), _U)
        for low in range(0, self.steps + self.blocks - 1, STEPS):
            count = min(STEPS, self.steps + self.blocks - 1 - low)
            for b in range(self.blocks):
                at = low - b + self.blocks
                held[:count, b] = self.table[b].take(self.texts[at : at + count], mode="clip")
            yield from held[:count]


def _codes(texts: Iterable[str], length: int, fill: Callable[[str, int, str], str]) -> np.ndarray:
    """The characters of texts, a row each, filled up to a length."""
    return np.frombuffer("".join([fill(t, length, "\0") for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, length)


def _edit_steps(columns: _Columns, anchored: bool) -> np.ndarray:
    """By how much each column's last edit distance differs from that of the column before."""
    blocks, pairs = columns.blocks, columns.pairs
    new = lambda rows: np.zeros((rows, pairs), _U)
    begin, every = ~columns.before, ~_U(0)
    # the rows that rise, those that don't fall, and work space
    rises, kept, flat, reached, level, down = begin.copy(), new(blocks), new(blocks), new(blocks), new(blocks), new(blocks)
    # what each block passes on to the next: whether its last row doesn't rise, and whether it falls; two of each, by turns
    levels, downs = [new(blocks + 1), new(blocks + 1)], [new(blocks + 1), new(blocks + 1)]
    levels[0][0] = levels[1][0] = int(not anchored)
    turns = [(levels[k][:-1], downs[k][:-1], levels[1 - k][1:], downs[1 - k][1:], levels[1 - k][-1], downs[1 - k][-1]) for k in (0, 1)]
    deltas = np.empty((columns.steps + blocks - 1, pairs), _U)
    one, last = _U(1), _U(63)
    and_, or_, xor, add, shift, unshift, invert = np.bitwise_and, np.bitwise_or, np.bitwise_xor, np.add, np.left_shift, np.right_shift, np.invert
    for step, same in enumerate(columns):
        if step < blocks:  # this block begins: what it did before had no characters
            rises[step], kept[step] = begin[step], every
        level_in, down_in, level_out, down_out, level_last, down_last = turns[step & 1]
        or_(same, down_in, reached)
        and_(reached, rises, flat)
        add(flat, rises, flat)
        xor(flat, rises, flat)
        or_(flat, reached, flat)
        and_(rises, flat, down)
        or_(flat, rises, level)
        and_(level, kept, level)
        invert(flat, flat)
        and_(flat, kept, flat)
        unshift(level, last, level_out)
        unshift(down, last, down_out)
        shift(level, one, level)
        or_(level, level_in, level)
        shift(down, one, down)
        or_(down, down_in, down)
        or_(level, flat, kept)
        and_(level, flat, rises)
        or_(rises, down, rises)
        add(level_last, down_last, deltas[step])
    return 1 - deltas[blocks - 1 :].view(np.int64)


def _common_steps(columns: _Columns) -> np.ndarray:
    """By how much each column's longest common subsequence is longer than that of the column before."""
    blocks, pairs = columns.blocks, columns.pairs
    row, hit, total = np.full((blocks, pairs), ~_U(0)), np.empty((blocks, pairs), _U), np.empty((blocks, pairs), _U)
    over = [np.zeros((blocks + 1, pairs), _U), np.zeros((blocks + 1, pairs), _U)]
    turns = [(over[k][:-1], over[1 - k][1:], over[1 - k][-1]) for k in (0, 1)]
    grown = np.empty((columns.steps + blocks - 1, pairs), _U)
    last = _U(63)
    and_, or_, xor, add, unshift, invert = np.bitwise_and, np.bitwise_or, np.bitwise_xor, np.add, np.right_shift, np.invert
    for step, same in enumerate(columns):
        if step < blocks:
            row[step] = ~_U(0)
        came, goes, end = turns[step & 1]
        and_(row, same, hit)
        add(row, hit, total)
        add(total, came, total)
        invert(total, same)  # what was looked up is not used again
        and_(same, row, same)
        or_(same, hit, same)
        unshift(same, last, goes)
        xor(row, hit, row)
        or_(row, total, row)
        grown[step] = end
    return grown[blocks - 1 :].view(np.int64)
