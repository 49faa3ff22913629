"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

White space is marked: a text is `▁` and the text with `▁` for every space. The encoder picks the segmentation into
pieces with the largest sum of scores (of equal ones the first found from the left); characters that no piece covers
become byte pieces. The decoder turns markers into spaces, drops the leading one and joins byte pieces.

No piece holds a marker behind another character, or a line break, so a text falls apart at single spaces and line
breaks, and each distinct part is solved once per Python worker, within a bounded memory.

Defined results: a null text counts as empty and has no ids; whole texts are used, however long; a text with a literal
`▁` decodes with a space there; bytes that are no UTF-8 decode as U+FFFD; ids out of range are refused. The column
functions keep every row and column of their input, repeated rows and null ids too.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import memory

MARKER = "▁"
#: Entries in each of the two generations of one Python worker's memory of parts.
CACHE = 600_000
#: Stands before a part that no space precedes.
_INNER = "\x01"
#: Added to the lowest score for a character without a piece.
UNKNOWN_PENALTY = 10.0


class Pieces:
    """A vocabulary: pieces that may match text, with scores; byte pieces; and what every id decodes to."""

    def __init__(self, normal: list[tuple[str, int, float]], byte_ids: list[int], texts: list[bytes]):
        self.byte_ids, self.texts = byte_ids, texts
        self.scores = dict((i, s) for _, i, s in normal)
        self.unknown = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.base, self.check, self.value = _double_array(sorted((p.encode(), i) for p, i, _ in normal))

    @staticmethod
    def load(path: str) -> Pieces:
        """The pieces of a sentencepiece model file with byte fallback."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        normal, byte_ids, texts = [], [0] * 256, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[1:-1], 16)] = i
                texts.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                texts.append(b"")
            else:
                normal.append((piece, i, model.get_score(i)))
                texts.append(piece.replace(MARKER, " ").encode())
        return Pieces(normal, byte_ids, texts)


def _double_array(keys: list[tuple[bytes, int]]) -> tuple[array, array, array]:
    """base, check and value of a double-array trie: the child of node s by byte c is base[s] + c if check[that] = s."""
    size = 1 << 10
    base, check, value = array("i", [0] * size), array("i", [-1] * size), array("i", [-1] * size)
    check[0] = 0
    low_place = 1  # the search for room starts here; it moves on where the array has become crowded
    todo = [(0, 0, len(keys), 0)]  # node, its keys, depth
    while todo:
        node, low, high, depth = todo.pop()
        if len(keys[low][0]) == depth:
            value[node] = keys[low][1]
            low += 1
        if low == high:
            continue
        children, at = [], low
        while at < high:
            byte, start = keys[at][0][depth], at
            while at < high and keys[at][0][depth] == byte:
                at += 1
            children.append((byte, start, at))
        place = first = low_place
        while True:
            if place + 256 >= len(check):
                grow = len(check)
                base.extend([0] * grow)
                check.extend([-1] * grow)
                value.extend([-1] * grow)
            if all(check[place + c] < 0 for c, _, _ in children):
                break
            place += 1
        if place - first > 50:
            low_place = place - 25
        base[node] = place
        for c, start, end in children:
            check[place + c] = node
            todo.append((place + c, start, end, depth + 1))
    return base, check, value


class Codec(dict):
    """Encodes and decodes; as a dict it holds the ids of parts met before, as little-endian unsigned 32-bit integers."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces
        self.base, self.check, self.value = pieces.base.tolist(), pieces.check.tolist(), pieces.value.tolist()
        self.old: dict[str, bytes] = {}

    def best(self, text: str) -> list[int]:
        """Ids of the best segmentation of a marked text."""
        data = text.encode("utf-8", "surrogatepass")
        n = len(data)
        base, check, value, scores, unknown = self.base, self.check, self.value, self.pieces.scores, self.pieces.unknown
        total, back, which = [None] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        total[0] = 0.0
        for start in range(n):
            if (so_far := total[start]) is None:
                continue
            lead = data[start]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            node, single = 0, False
            for end in range(start, n):
                there = base[node] + data[end]
                if not base[node] or check[there] != node:
                    break
                node = there
                if (piece := value[node]) >= 0:
                    score = so_far + scores[piece]
                    single = single or end + 1 - start == width
                    if total[end + 1] is None or score > total[end + 1]:
                        total[end + 1], back[end + 1], which[end + 1] = score, start, piece
            if not single:
                end, score = start + width, so_far + unknown
                if total[end] is None or score > total[end]:
                    total[end], back[end], which[end] = score, start, -1
        out, end = [], n
        while end:
            start = back[end]
            out += [which[end]] if which[end] >= 0 else [self.pieces.byte_ids[b] for b in reversed(data[start:end])]
            end = start
        return out[::-1]

    def __missing__(self, part: str) -> bytes:
        if (found := self.old.get(part)) is None:
            marked = part[1:] if part[:1] == _INNER else MARKER + part
            found = np.array(self.best(marked.replace(" ", MARKER)), "<u4").tobytes()
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[part] = found
        return found

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _INNER in text or text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text or MARKER in text:
            return np.array(self.best((" " + text).replace(" ", MARKER)), "<u4").tobytes()
        if "\n" in text:
            text = text.replace("\n", f" {_INNER}\n {_INNER}")
        return b"".join(map(self.__getitem__, text.split(" ")))

    def decode(self, ids: bytes) -> str:
        found = b"".join(map(self.pieces.texts.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return found.removeprefix(b" ").decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    if shared.value is None:
        raise ValueError("no pieces")
    key = shared.id if hasattr(shared, "id") else id(shared)
    if key not in _codecs:
        _codecs.clear()  # one vocabulary at a time in a worker
        _codecs[key] = Codec(shared.value)
    memory.claim("unigram", _codecs.clear)
    return _codecs[key]


def columns(spark: SparkSession, pieces: Pieces) -> tuple:
    """Two column functions: a text to its ids (binary, little-endian unsigned 32-bit), and ids back to the text."""
    shared = spark.sparkContext.broadcast(pieces)  # its size is that of the vocabulary

    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(shared)
        for batch in texts:
            yield pa.array([codec.encode(t) for t in batch.to_pylist()], pa.binary())

    def decode(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(shared)
        for batch in ids:
            yield pa.array([codec.decode(x or b"") for x in batch.to_pylist()], pa.string())

    encode.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    decode.__annotations__ = {"ids": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(encode, "binary"), F.arrow_udf(decode, "string")


def count_ids(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
