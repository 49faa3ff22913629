"""Best-fit packing of pieces into sequences by the linear grouping scheme.

`pieces` encodes documents and cuts those that are longer than a sequence. `plan` works on the counts of the lengths
alone, at most one row per length, however many documents there are: it rounds large lengths up within groups of equal
cardinality, fills sequences by the best configuration of the few rounded sizes, puts the actual lengths in their
place, and then puts the small ones where they fit best. Its result is a short list of runs: the pieces of one length
with ordinals from `first` to before `last` go to consecutive sequences. `pack` numbers the pieces of each length
in Spark and looks their run up.

Defined results: a null text counts as empty (its document is the end id alone); ids may be null or repeated; pieces
with a null length, or one below 1 or above the capacity, get null sequence_id and offset; an empty table gives an
empty result; `pack` keeps all columns of its input, and refuses only those that it adds, by a ClashingColumn error.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.expressions import refuse_columns
from lexmill.functions.ordinals import gapless
from lexmill.llm.tokens import encode_column, grouped

#: Groups of equal cardinality that the large lengths are rounded in, and the share of the capacity that a large length
#: is over. All settings are planned, until one needs no more sequences than the tokens fill, and the best is taken. By
#: the last, no two large ones share a sequence, so none is worse than best-fit decreasing.
SETTINGS = ((512, 0.2), (1024, 0.34), (2048, 0.2), (512, 0.5))


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids (binary, little-endian unsigned 32-bit) of every piece.

    A document is its ids and end_id. One that is longer than `capacity` is cut so that all pieces but the first are full.
    """
    end = np.array([end_id], "<u4").tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches):
            doc, piece, start, length, ids = [], [], [], [], []
            for i, found in zip(batch.column(0).to_pylist(), encode_column(batch.column(1), tokenizer), strict=True):
                found += end
                n = len(found) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    doc.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    ids.append(found[4 * a : 4 * b])
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(task, "doc_id long, piece int, start long, length long, ids binary")


def _configuration(sizes: list[int], most: list[int], room: int) -> list[int]:
    """How many of each size fill `room` best, none more often than `most`. Sums are bits of an integer."""
    reach, states = 1, []
    limit = (1 << room + 1) - 1
    for g, size in enumerate(sizes):
        for _ in range(min(most[g], room // size)):
            states.append((g, reach))
            reach |= reach << size & limit
    left, use = reach.bit_length() - 1, [0] * len(sizes)
    for g, before in reversed(states):
        if not before >> left & 1:
            use[g] += 1
            left -= sizes[g]
    return use


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first, last, sequence, per_sequence, offset) and the number of sequences, from counts of lengths."""
    least = -(-sum(x * n for x, n in counts.items() if n > 0 and 1 <= x <= capacity) // capacity)
    best = None
    for groups, share in SETTINGS:
        made = _plan(counts, capacity, groups, share)
        if best is None or made[1] < best[1]:
            best = made
        if best[1] == least:
            break
    return best


def _plan(counts: dict[int, int], capacity: int, most_groups: int, large_share: float) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    runs: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0
    lengths = sorted((x for x, n in counts.items() if n > 0 and 1 <= x <= capacity), reverse=True)
    if capacity in lengths:
        runs.append((capacity, 0, counts[capacity], 0, 1, 0))
        sequences = counts[capacity]
        lengths.remove(capacity)
    large = [x for x in lengths if x > large_share * capacity]

    # groups of equal cardinality, each with its items as segments (length, first ordinal, count)
    share = -(-sum(counts[x] for x in large) // most_groups)
    groups: list[list[tuple[int, int, int]]] = []
    room = 0
    for x in large:
        at = 0
        while at < counts[x]:
            if not room:
                groups.append([])
                room = share
            n = min(room, counts[x] - at)
            groups[-1].append((x, at, n))
            at, room = at + n, room - n
    sizes = [g[0][0] for g in groups]
    demand = [sum(n for _, _, n in g) for g in groups]

    def take(g: int, n: int) -> list[tuple[int, int, int]]:
        out = []
        while n:
            x, at, have = groups[g].pop(0)
            m = min(n, have)
            out.append((x, at, m))
            if have > m:
                groups[g].insert(0, (x, at + m, have - m))
            n -= m
        return out

    spaces: dict[int, list[tuple[int, int, int]]] = {}  # by room left: ranges of sequences (first, count, used)
    keys: list[int] = []

    def free(first: int, n: int, used: int) -> None:
        if n and used < capacity:
            if capacity - used not in spaces:
                spaces[capacity - used] = []
                insort(keys, capacity - used)
            spaces[capacity - used].append((first, n, used))

    for g, size in enumerate(sizes):
        while demand[g]:
            rest = _configuration(sizes[g:], [demand[g] - 1, *demand[g + 1 :]], capacity - size)
            rest[0] += 1
            times = min(demand[g + i] // n for i, n in enumerate(rest) if n)
            slots = []
            for i, n in enumerate(rest):
                for _ in range(n):
                    slots.append(take(g + i, times))
                demand[g + i] -= n * times
            done = 0
            while done < times:
                step = min(slot[0][2] for slot in slots)
                used = 0
                for slot in slots:
                    x, at, n = slot[0]
                    runs.append((x, at, at + step, sequences + done, 1, used))
                    used += x
                    slot[0] = (x, at + step, n - step)
                    if n == step:
                        slot.pop(0)
                free(sequences + done, step, used)
                done += step
            sequences += times

    for x in lengths[len(large) :]:
        at, left = 0, counts[x]
        while left:
            k = bisect_left(keys, x)
            if k == len(keys):
                n = -(-left // (capacity // x))
                free(sequences, n, 0)
                sequences += n
                continue
            space = keys[k]
            first, n, used = spaces[space].pop()
            if not spaces[space]:
                del spaces[space], keys[k]
            each = space // x
            full = min(n, left // each)
            if full:
                runs.append((x, at, at + full * each, first, each, used))
                free(first, full, used + each * x)
                at, left = at + full * each, left - full * each
            if full < n and left:  # fewer than `each` are left
                runs.append((x, at, at + left, first + full, left, used))
                free(first + full, 1, used + left * x)
                full, at, left = full + 1, at + left, 0
            free(first + full, n - full, used)
    return runs, sequences


def pack(rows: DataFrame, capacity: int, order: list[str], length_col: str = "length") -> DataFrame:
    """`rows` with sequence_id and offset. `order` names columns that tell the rows of a length apart.

    `rows` is read twice, so give it as a table. The lengths' counts (at most `capacity` rows) go to the driver; the
    runs, whose number depends on the capacity only, are broadcast.
    """
    refuse_columns(rows, "sequence_id", "offset")
    spark = rows.sparkSession
    own = rows.columns
    length = F.col(length_col)
    fits = length.between(1, capacity)
    counts = {r[0]: r[1] for r in rows.filter(fits).groupBy(length.cast("int").alias("n")).count().collect()}
    runs, _ = plan(counts, capacity)
    # the columns of `rows` travel in one struct, so that no name of theirs can clash
    held = rows.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), length.alias("length"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    table = spark.createDataFrame(runs, "of long, first long, last long, sequence long, each long, at long")
    keys = [f"o{i}" for i in range(len(order))]
    numbered = gapless(held, ["length"], list(keys), keys, "ordinal", salts=64)
    found = numbered.join(F.broadcast(table), (F.col("length") == F.col("of")) & (F.col("ordinal") >= F.col("first")) & (F.col("ordinal") < F.col("last")), "left")
    sequence = F.expr("sequence + (ordinal - first) div each").alias("sequence_id")
    return found.select("row.*", sequence, (F.col("at") + (F.col("ordinal") - F.col("first")) % F.col("each") * F.col("length")).alias("offset"))
