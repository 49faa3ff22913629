"""Spelling variants: words one edit apart, found by Bloom-guided neighbourhoods.

1. `occurrences` counts the words of whole texts, summed up within tasks before the shuffle; `vocabulary` keeps the
   distinct words that occur often enough.
2. `bloom` puts the vocabulary into blocked Bloom filters, one for each length, which are broadcast: BITS bits a word, at most
   MOST_BYTES in all, however large the vocabulary is.
3. `candidates` probes every deletion from a word, and every replacement of a letter by one that comes after it, against the filter of the
   length that results; the other edits are these, seen from the other word. Hashes of edits are made from
   sums over the word, without making the edited words, so a very long word costs its length times the alphabet. Only
   positives become rows.
4. `near` joins them with the vocabulary, which removes false positives, and gives every pair in both directions.
5. `variants` takes the most frequent near word as form where it is frequent enough, and follows forms to the root by
   pointer jumping.

With more words than MOST_BYTES have room for, more false positives are shuffled; the result stays exact.

Defined results: a null text has no words; a null id is written as the empty string; rows that repeat an id count as often
as they stand; only A-Z are lower-cased; ties between near words go to the smallest in code-point order; an empty
table gives an empty result; extra columns are left out, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill import session
from lexmill.llm import memory

#: Letters of a word, as a class of a pattern.
LETTERS = "A-Za-zÀ-ÿ"
#: Bits of a filter for each word, and bytes of all filters at most.
BITS, MOST_BYTES = 16, 64 << 20
#: Words of this length and longer share a filter.
LONGEST = 48
#: Distinct words that a task holds before it passes their counts on; edits that are probed at a time.
HELD, PROBED = 200_000, 1 << 20
#: Blocks of a filter (8 lanes of 32 bits) that one task makes.
SEGMENT = 256

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LANES = np.random.default_rng(20250101).integers(0, 1 << 31, 8, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def occurrences(docs: DataFrame, least_length: int, damage: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: maximal runs of letters of at least `least_length` code points, lower-cased, with their number.

    With `damage`, let h be the crc32 of `<id>:<word>`; where it divides h, code point h % length is deleted first.
    """
    runs = re.compile(f"[{LETTERS}]{{{least_length},}}")

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.release()
        counts: Counter = Counter()
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_buffer()
                if data is None:
                    continue
                found = Counter(runs.findall(data.to_pybytes().translate(_LOWER).decode("utf-8", "replace")))
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                for word, n in found.items():
                    if damage and (h := zlib.crc32(word.encode(), start)) % damage == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    counts[word] += n
                if len(counts) >= HELD:
                    yield batch_of(counts)
                    counts = Counter()
        yield batch_of(counts)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, least_length: int = 7, least_count: int = 2, damage: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of the words that occur at least `least_count` times, as a table."""
    return session.cut(occurrences(docs, least_length, damage, id_col, text_col).filter(F.col("n") >= least_count), "vocabulary")


def _points(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row for each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), length).astype(np.uint64)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _BASE, np.uint64))), dtype=np.uint64)


def _mixed(sums: np.ndarray) -> np.ndarray:
    x = (sums ^ (sums >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _block(codes: np.ndarray, blocks: int) -> np.ndarray:
    return ((codes >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def _lane_bit(codes: np.ndarray, lane: int) -> np.ndarray:
    """The bit of a code in a lane of its block."""
    return np.uint32(1) << ((codes.astype(np.uint32) * _LANES[lane]) >> np.uint32(27))


def _by_length(words: list[str]) -> dict[int, list[int]]:
    found: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        found.setdefault(len(word), []).append(i)
    return found


class Filters:
    """Blocked Bloom filters by length; a task loads those that it probes."""

    def __init__(self, parts: dict[int, Broadcast]):
        self.parts = parts
        self.open: dict[int, np.ndarray] = {}

    def __getstate__(self) -> dict[int, Broadcast]:
        return self.parts

    def __setstate__(self, parts: dict[int, Broadcast]) -> None:
        self.parts, self.open = parts, {}

    def hits(self, length: int, codes: np.ndarray) -> np.ndarray:
        """Indices of the codes that the filter of a length may hold."""
        shard = min(length, LONGEST)
        if shard not in self.parts:
            return np.empty(0, np.int64)
        if shard not in self.open:
            self.open[shard] = np.frombuffer(self.parts[shard].value, "<u4").reshape(-1, 8)
        lanes = self.open[shard]
        left = np.arange(len(codes))
        block = _block(codes, len(lanes))
        for lane in range(8):
            left = left[lanes[block[left], lane] & _lane_bit(codes[left], lane) != 0]
        return left


def bloom(words: DataFrame) -> Filters:
    """Filters of the column `word`. The driver holds MOST_BYTES at most."""
    spark = words.sparkSession
    shard = F.least(F.length("word"), F.lit(LONGEST)).alias("shard")
    counts = {r[0]: r[1] for r in words.groupBy(shard).count().collect()}  # at most LONGEST rows
    fits = min(1.0, MOST_BYTES * 8 / (BITS * max(1, sum(counts.values()))))
    blocks = {s: max(1, int(n * fits * BITS / 256)) for s, n in counts.items()}

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.release()
        for batch in batches:
            words = batch.column(0).to_pylist()
            for length, at in _by_length(words).items():
                codes = _mixed((_points([words[i] for i in at], length) * _powers(length)[:length]).sum(axis=1, dtype=np.uint64))
                s = min(length, LONGEST)
                segment = _block(codes, blocks[s]) // SEGMENT
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s, np.int32)), pa.array(segment.astype(np.int32)), pa.array(codes.view(np.int64))], names=["shard", "segment", "code"])

    def segment(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, number = key[0].as_py(), key[1].as_py()
        lanes = np.zeros((min(SEGMENT, blocks[s] - number * SEGMENT), 8), "<u4")
        for batch in batches:
            codes = batch.column(batch.schema.get_field_index("code")).to_numpy(zero_copy_only=False).view(np.uint64)
            block = _block(codes, blocks[s]) - number * SEGMENT
            for lane in range(8):
                np.bitwise_or.at(lanes[:, lane], block, _lane_bit(codes, lane))
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([number], pa.int32()), pa.array([lanes.tobytes()], pa.binary())], names=["shard", "segment", "bits"])

    coded = words.select("word").mapInArrow(code, "shard int, segment int, code long")
    made = coded.groupBy("shard", "segment").applyInArrow(segment, "shard int, segment int, bits binary").collect()
    parts: dict[int, list[tuple[int, bytes]]] = {}
    for r in made:
        parts.setdefault(r["shard"], []).append((r["segment"], bytes(r["bits"])))
    return Filters({s: spark.sparkContext.broadcast(b"".join(bits for _, bits in sorted(found))) for s, found in parts.items()})


def edits(points: np.ndarray, letters: np.ndarray, filters: Filters) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word, position, letter) of the edits of words of one length that the filters may hold; letter 0 is a deletion.

    One deletion of each run of equal letters is tried, and replacements by letters that come after the one at hand.
    """
    m, length = points.shape
    powers = _powers(length)
    terms = points * powers[:length]
    total = terms.sum(axis=1, dtype=np.uint64)

    # without letter i: the sum before it, and the sum after it with powers one lower
    lower = np.zeros_like(points)
    lower[:, 1:] = points[:, 1:] * powers[: length - 1]
    without = np.cumsum(terms, axis=1, dtype=np.uint64) - terms + (lower.sum(axis=1, dtype=np.uint64)[:, None] - np.cumsum(lower, axis=1, dtype=np.uint64))
    first = np.ones(points.shape, bool)
    first[:, 1:] = points[:, 1:] != points[:, :-1]
    word, at = np.nonzero(first)
    found = filters.hits(length - 1, _mixed(without[word, at]))
    yield word[found], at[found], np.zeros(len(found), np.uint64)

    step = max(1, PROBED // max(1, m * len(letters)))
    for start in range(0, length, step):
        own = points[:, start : start + step]
        word, at, which = np.nonzero(letters[None, None, :] > own[:, :, None])
        letter = letters[which]
        codes = _mixed(total[word] + (letter - own[word, at]) * powers[start + at])
        found = filters.hits(length, codes)
        yield word[found], start + at[found], letter[found]


def candidates(words: DataFrame, filters: Filters) -> DataFrame:
    """word, n, edit: edits of words that the filters may hold, each once."""
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("x")).distinct().collect()  # letters of an alphabet
    alphabet = np.array(sorted(ord(r["x"]) for r in letters if r["x"]), np.uint64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.release()
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for length, same in _by_length(words).items():
                many = max(1, PROBED // (8 * length))
                for a in range(0, len(same), many):
                    rows = same[a : a + many]
                    for word, at, letter in edits(_points([words[i] for i in rows], length), alphabet, filters):
                        of, new = [rows[i] for i in word.tolist()], []
                        for i, p, x in zip(of, at.tolist(), letter.tolist(), strict=True):
                            new.append(words[i][:p] + (chr(x) if x else "") + words[i][p + 1 :])
                        yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in of], pa.string()), pa.array([n[i] for i in of], pa.int64()), pa.array(new, pa.string())], names=["word", "n", "edit"])

    dealt = words.select("word", "n").repartition(session.n_partitions(words.sparkSession), "word")  # a small table, with much work for each row
    return dealt.mapInArrow(task, "word string, n long, edit string")


def near(words: DataFrame) -> DataFrame:
    """word, other, other_n: all pairs of words that are one edit apart, in both directions."""
    found = candidates(words, bloom(words)).withColumnRenamed("n", "word_n")
    pairs = session.cut(found.join(words.select(F.col("word").alias("edit"), F.col("n").alias("edit_n")), "edit"), "near")
    return pairs.select("word", F.col("edit").alias("other"), F.col("edit_n").alias("other_n")).unionAll(pairs.select(F.col("edit").alias("word"), F.col("word").alias("other"), F.col("word_n").alias("other_n")))


def roots(forms: DataFrame) -> DataFrame:
    """word, root from word, form: where following forms ends. As a form is more frequent than its word, there are no rings."""
    now = session.cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        now = session.cut(now.join(step, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not now.filter("moved").head(1):
            return now.select("word", "root")


def variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of a `vocabulary`.

    form is the most frequent near word, if it is at least `factor` times as frequent.
    """
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other")))
    found = near(words).groupBy(F.col("word").alias("of")).agg(F.count("*").alias("near_words"), best.alias("best"))
    rows = words.join(found, F.col("word") == F.col("of"), "left")
    enough = -F.col("best.n") >= factor * F.col("n")
    rows = rows.select("word", "n", F.coalesce("near_words", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n"))
    rows = session.cut(rows, "forms")
    ends = roots(rows.filter("form IS NOT NULL")).withColumnRenamed("word", "of")
    return rows.join(ends, F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
