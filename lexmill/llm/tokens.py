"""Token ids of whole texts by the `tokenizers` library, with a bounded memory of words already encoded.

Byte-level and word-end BPE never merge across a white-space boundary, so a batch of texts is cut at single spaces, and
each distinct unit of the batch is encoded once; the ids of a text are the ids of its units in order. A unit of plain
letters, digits, marks and line breaks is put together from these, which the pre-tokenizer separates anyway. Most units
are letters and then marks: these are parted and looked up as arrays, and only new words go to the library. Texts
where a space touches other white space, where the cut could differ, and those with strings of special tokens, which
the library takes as such (with `plain_specials`, as plain text), are encoded whole.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexmill.llm import memory

#: Words that one Python worker remembers, some 60 bytes each; when it holds more, the half met last stays.
WORDS = 1_000_000
#: Entries in each of the two generations of its memory of other units, some 150 bytes each. When the young one is full it
#: becomes the old one, whose entries live on if they are met again.
CACHE = 50_000
#: Bytes of text that are encoded at a time, and characters that the library encodes whole at a time: its own result takes
#: some 100 bytes a token.
GROUP, WHOLE = 4 << 20, 1 << 18

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_EVERY_LETTER = "".join(filter(re.compile(f"[{_LETTERS}]").match, map(chr, range(256))))
_MARKS = "-.,;:!?#$%&*|()"
#: What a unit may be put together from: runs of letters, of digits or of marks, and single line breaks.
_PIECE = re.compile(rf"[{_LETTERS}]+|[0-9]+|[{_MARKS}]+|\n(?!\s)")
#: Stands before a unit that no space precedes.
_INNER = "\x01"
_WORD = f"^{_INNER}?[{_LETTERS}]+$"
#: What keeps a text from being cut at its spaces, but for special tokens.
_UNEVEN = r"[\x01\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|  | \n|\n[ \n]"

#: Byte-level BPE spells byte b as chr(b) where that is visible, and the others as chr(256), chr(257), ... in order.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_SPELLING = {b: chr(256 + i) for i, b in enumerate(_HIDDEN)}
_PROBES = "a Word, Élan. straße!! íñ THE*** x|y Zzqqxv.\nÍsland 2024 a1b22 ###".split(" ")

_encoders: dict[tuple[str, bool], Encoder] = {}


def _packed(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def _joined(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of `ids`, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    small = np.int32 if max(total, len(ids)) < 1 << 31 else np.int64
    places = np.arange(total, dtype=small)
    places += np.repeat((starts - (ends - sizes)).astype(small), sizes)
    return ids[places]


class _Words:
    """Ids of words met before. A word is found by a hash of its bytes, and then compared; one of two with the same hash is not kept."""

    _factors = np.random.default_rng(0).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)

    def __init__(self):
        self.hashes, self.rows = np.empty(0, np.uint64), np.empty(0, np.int64)  # by hash: a word's row
        self.words = pa.array([], pa.string())
        self.ids, self.ends, self.met = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.time = 0

    @classmethod
    def _hashed(cls, words: pa.Array) -> np.ndarray:
        """Hashes of words, of which none is empty."""
        _, offsets, data = words.buffers()
        ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1]
        letters = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1)
        starts = ends[:-1] - ends[0]
        letters *= cls._factors[(np.arange(len(letters)) - np.repeat(starts, np.diff(ends))) % len(cls._factors)]
        return np.add.reduceat(letters, starts)

    def _keep(self, rows: np.ndarray) -> None:
        sizes = np.diff(self.ends, prepend=0)[rows]
        self.ids = _joined(self.ids, self.ends[rows] - sizes, sizes)
        self.ends, self.met, self.words = np.cumsum(sizes), self.met[rows], self.words.take(pa.array(rows))
        found = self._hashed(self.words)
        self.rows = np.argsort(found)
        self.hashes = found[self.rows]

    def encoded(self, words: pa.Array, encode) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and their sizes; `encode` gives those of new words so."""
        if not len(words):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        if len(self.words) > WORDS:
            self._keep(np.sort(np.argsort(self.met, kind="stable")[-WORDS // 2 :]))
        self.time += 1
        hashes = self._hashed(words)
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        rows = np.full(len(words), -1)
        if len(self.hashes):
            at = np.minimum(at, len(self.hashes) - 1)
            rows[order] = np.where(self.hashes[at] == hashes[order], self.rows[at], -1)
        held = np.flatnonzero(rows >= 0)
        same = pc.equal(self.words.take(pa.array(rows[held])), words.take(pa.array(held))).to_numpy(zero_copy_only=False)
        rows[held[~same]] = -1
        self.met[rows[held[same]]] = self.time
        new = np.flatnonzero(rows < 0)
        fresh = words.take(pa.array(new))
        ids, sizes = map(np.asarray, encode(fresh.to_pylist()))
        # the new ones behind those that are held
        rows[new] = len(self.words) + np.arange(len(new))
        every = np.concatenate((self.ends, (self.ends[-1] if len(self.ends) else 0) + np.cumsum(sizes)))
        self.ids, self.ends, self.met = np.concatenate((self.ids, ids)), every, np.concatenate((self.met, np.full(len(new), self.time)))
        self.words = pa.concat_arrays([self.words, fresh])
        first = np.unique(hashes[new], return_index=True)[1]  # in the order of the hashes
        first = first[~np.isin(hashes[new][first], hashes[held])] if len(held) else first
        places = np.searchsorted(self.hashes, hashes[new][first])
        self.hashes, self.rows = np.insert(self.hashes, places, hashes[new][first]), np.insert(self.rows, places, rows[new][first])
        taken = self.ends[rows] - np.where(rows > 0, self.ends[rows - 1], 0)
        return _joined(self.ids, self.ends[rows] - taken, taken), taken


class Encoder(dict):
    """Encodes texts to ids, as bytes of little-endian unsigned 32-bit integers.

    As a dict it holds the ids of units met before, but for words: of what follows a space, or of _INNER and what follows no space.
    """

    def __init__(self, path: str, plain_specials: bool = False):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain_specials
        self.tokenize = self.library.model.tokenize
        with open(path, encoding="utf-8") as found:
            read = json.load(found)
        self.lower = "Lowercase" in json.dumps(read.get("normalizer"))
        special = [re.escape(x["content"]) for x in read.get("added_tokens") or []]
        self.uneven = "(?i)" + "|".join([_UNEVEN, *special])
        self.old: dict[str, bytes] = {}
        self.words = _Words()
        # pieces may go to the model at once, past the normaliser and pre-tokeniser, if that gives the same
        self.direct = True
        probes = [f" {u}" for u in _PROBES]
        self.direct = self.encode(probes) == self.whole(probes)
        self.forget()

    def whole(self, texts: list[str]) -> list[bytes]:
        out, at, size = [], 0, 0
        for i, text in enumerate(texts, 1):
            size += len(text)
            if size >= WHOLE or i == len(texts):
                out += [_packed(e.ids) for e in self.library.encode_batch_fast(texts[at:i], add_special_tokens=False)]
                at, size = i, 0
        return out

    def forget(self) -> None:
        self.clear()
        self.old = {}
        self.words = _Words()

    def __missing__(self, unit: str) -> bytes:
        if (found := self.old.get(unit)) is None and (found := self._composed(unit)) is None:
            found = self.whole([unit[1:] if unit[:1] == _INNER else f" {unit}"])[0]
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[unit] = found
        return found

    def _composed(self, unit: str) -> bytes | None:
        """Ids of a unit, put together from pieces; None if they don't cover it."""
        inner = unit[:1] == _INNER
        text = unit[1:] if inner else unit
        if inner and not text:
            return b""
        pieces = _PIECE.findall(text)
        if not pieces or not self.direct or pieces[0] == "\n" and not inner or sum(map(len, pieces)) != len(text):
            return None
        if len(pieces) == 1:
            return self._ids(text, not inner)
        return b"".join([self[p if i == 0 and not inner else _INNER + p] for i, p in enumerate(pieces)])

    def _ids(self, piece: str, spaced: bool) -> bytes:
        """Ids of a piece by the library's model."""
        if self.lower:
            if piece == "\n":
                return b""
            if piece[0].isdigit() and len(piece) > 1:
                return b"".join([self._ids(d, spaced) for d in piece])
            if piece != (small := piece.lower()):
                return self[small if spaced else _INNER + small]
        if not piece.isascii() or piece == "\n":
            piece = piece.encode().decode("latin-1").translate(_SPELLING)
        return _packed([t.id for t in self.tokenize(_SPELLING[32] + piece if spaced and not self.lower else piece)])

    def _new(self, words: list[str]) -> tuple[array, array]:
        """Ids of words, each of which may stand behind _INNER, by the library's model, and how many each has."""
        space, ids, sizes = "" if self.lower else _SPELLING[32], array("I"), array("q")
        for word in words:
            spelled = word.lstrip(_INNER)
            before = space if len(spelled) == len(word) else ""
            if not spelled.isascii():
                spelled = spelled.encode().decode("latin-1").translate(_SPELLING)
            found = [t.id for t in self.tokenize(before + spelled)]
            ids.extend(found)
            sizes.append(len(found))
        return ids, sizes

    def _known(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units, one after the other, and how many each has."""
        units = units.cast(pa.string())
        stems = pc.ascii_rtrim(units, _MARKS)
        plain = pc.match_substring_regex(stems, _WORD) if self.direct else pa.array([False] * len(units))
        stems = stems.filter(plain)
        if self.lower:
            stems = pc.ascii_ltrim(pc.utf8_lower(stems), _INNER)
        stems = stems.dictionary_encode()
        marks = pc.utf8_ltrim(units.filter(plain), _INNER + _EVERY_LETTER).dictionary_encode()
        others = [self[_INNER + m] for m in marks.dictionary.to_pylist()]
        n_marks = len(others)
        others += map(self.__getitem__, units.filter(pc.invert(plain)).to_pylist())
        ids, sizes = self.words.encoded(stems.dictionary, self._new)
        n_words = len(sizes)
        ids = np.concatenate((ids, np.frombuffer(b"".join(others), "<u4")))
        sizes = np.concatenate((sizes, np.fromiter(map(len, others), np.int64, len(others)) // 4))
        starts = np.cumsum(sizes) - sizes
        # two parts of each unit: a word and its marks, or what is no word and nothing
        plain = plain.to_numpy(zero_copy_only=False)
        parts = np.full((len(units), 2), -1)
        parts[plain, 0] = stems.indices.to_numpy()
        parts[plain, 1] = n_words + marks.indices.to_numpy()
        parts[~plain, 0] = n_words + n_marks + np.arange(len(units) - plain.sum())
        starts, sizes = np.append(starts, 0), np.append(sizes, 0)  # the last part, -1, is nothing
        return _joined(ids, starts[parts.ravel()], sizes[parts.ravel()]), sizes[parts].sum(axis=1)

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        uneven = pc.match_substring_regex(texts, self.uneven)
        out = self._cut(texts.filter(pc.invert(uneven)))
        if pc.any(uneven).as_py():
            cut, whole = iter(out), iter(self.whole(texts.filter(uneven).to_pylist()))
            out = [next(whole if odd else cut) for odd in uneven.to_pylist()]
        return out

    def _cut(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts that may be cut at their spaces."""
        if not len(texts):
            return []
        lines = pc.replace_substring(pc.binary_join_element_wise(_INNER, texts, ""), "\n", f" {_INNER}\n {_INNER}")
        units = pc.split_pattern(lines, " ")
        coded = units.flatten().dictionary_encode()
        known, sizes = self._known(coded.dictionary)
        which = coded.indices.to_numpy()
        lengths = sizes[which]
        ends = np.cumsum(lengths)
        ids = _joined(known, (np.cumsum(sizes) - sizes)[which], lengths).tobytes()
        offsets = units.offsets.to_numpy()
        cuts = (4 * np.append(0, ends)[offsets - offsets[0]]).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def encoder(path: str, plain_specials: bool = False) -> Encoder:
    """The encoder of this Python process for a tokenizer file."""
    key = path, plain_specials
    if key not in _encoders:
        _encoders.clear()  # one vocabulary at a time in a worker
        _encoders[key] = Encoder(path, plain_specials)
    memory.claim("tokens", _encoders[key].forget)
    return _encoders[key]


def encode_column(texts: pa.Array, path: str, plain_specials: bool = False) -> list[bytes]:
    """Ids of an Arrow column of texts; null counts as empty."""
    return encoder(path, plain_specials).encode(texts.fill_null(""))


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about GROUP bytes, as distinct words are fewer in these."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GROUP:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)
