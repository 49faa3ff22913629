"""Cost-balanced packing: descending pieces go to the sequence of the lowest attention cost that has room.

A piece of n tokens costs LINEAR * n + QUADRATIC * n * n, as a document attends to itself only. `pieces` encodes documents
and cuts them to at most `longest` tokens. `plan` works on the counts of the lengths alone: sequences of equal cost and
filling are one group, which takes as many pieces of a length at once as it has sequences. Descending lengths go to the
group of the lowest cost that has room; when none has room for a length, a piece is cut to fill the roomiest group,
and what is left of it is placed as a shorter piece later. There are as many full sequences as the tokens fill, and one
of each power of two that the rest is made of, so in the end every sequence is full and nothing is padded. `pack`
numbers the pieces of each length and looks up what the plan says.

Pieces are numbered without a shuffle of their ids: the task that encodes a piece gives its number among those of its
length in that task, and a small table says how many are in the tasks before.

Defined results: a null text counts as empty (its document is the end id alone); ids may be null or repeated, each row is
a document of its own; an empty table gives an empty result; extra columns are left out, whatever their names.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill import session
from lexmill.llm.tokens import encode_column, grouped

#: Cost of a token by itself, and of a token attending to one of its piece: 6 x the width of a model of 1,024 to 1.
LINEAR, QUADRATIC = 6144, 1
#: Rows of the table of numbers by task and length that are broadcast at most (some 40 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def cost(length: int) -> int:
    return LINEAR * length + QUADRATIC * length * length


def pieces(docs: DataFrame, tokenizer: str, end_id: int, longest: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, doc_tokens, ids (binary, little-endian unsigned 32-bit), task and number of every piece.

    A document is its ids and end_id. One that is longer than `longest` is cut into pieces of nearly equal lengths.
    `number` counts the pieces of a length within a task, so write the result before it is read twice.
    """
    end = np.array([end_id], "<u4").tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, seen = TaskContext.get().partitionId(), Counter()
        for batch in grouped(batches):
            doc, start, length, total, number, ids = [], [], [], [], [], []
            for i, found in zip(batch.column(0).to_pylist(), encode_column(batch.column(1), tokenizer), strict=True):
                found += end
                n = len(found) // 4
                parts = -(-n // longest)
                cuts = [n * k // parts for k in range(parts + 1)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    doc.append(i)
                    start.append(a)
                    length.append(b - a)
                    total.append(n)
                    number.append(seen[b - a])
                    ids.append(found[4 * a : 4 * b])
                    seen[b - a] += 1
            columns = [pa.array(doc, pa.int64()), *(pa.array(x, pa.int64()) for x in (start, length, total)), pa.array(ids, pa.binary()), pa.array([place] * len(doc), pa.int32()), pa.array(number, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "doc_tokens", "ids", "task", "number"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(task, "doc_id long, start long, length long, doc_tokens long, ids binary, task int, number long")


class _Groups:
    """Groups of sequences (cost, first, count, used, room): those with room for the length at hand by cost, the others by room."""

    def __init__(self, capacity: int) -> None:
        self.open: list[tuple[int, int, int, int, int]] = []
        self.closed: dict[int, list[tuple[int, int, int, int, int]]] = defaultdict(list)
        self.rooms: list[int] = []
        self.least = capacity + 1

    def put(self, cost_: int, first: int, count: int, used: int, room: int) -> None:
        group = (cost_, first, count, used, room)
        if not count or not room:
            return
        if room >= self.least:
            heapq.heappush(self.open, group)
            return
        if not self.closed[room]:
            insort(self.rooms, room)
        heapq.heappush(self.closed[room], group)

    def reach(self, length: int) -> None:
        """From now on the pieces have this length, at most that of those before."""
        self.least = length
        at = bisect_left(self.rooms, length)
        for room in self.rooms[at:]:
            for group in self.closed.pop(room):
                heapq.heappush(self.open, group)
        del self.rooms[at:]

    def cheapest(self) -> tuple[int, int, int, int, int] | None:
        """The group of the lowest cost with room for the length at hand, taken out."""
        return heapq.heappop(self.open) if self.open else None

    def roomiest(self) -> tuple[int, int, int, int, int]:
        """Of the groups that lack the room, the one that lacks least, at the lowest cost, taken out."""
        room = self.rooms[-1]
        group = heapq.heappop(self.closed[room])
        if not self.closed[room]:
            self.rooms.pop()
        return group


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """Runs (of, first, last, from_, n, sequence, offset), from counts of lengths.

    Of the pieces of length `of` numbered from `first` to before `last`, n tokens from `from_` on go to consecutive
    sequences from `sequence` on, at `offset`. Their number depends on the capacity and the lengths, hardly on the counts.
    """
    total = sum(x * n for x, n in counts.items())
    full, rest = divmod(total, capacity)
    groups = _Groups(capacity)
    groups.put(0, 0, full, 0, capacity)
    for bit in range(rest.bit_length()):
        if rest >> bit & 1:
            groups.put(0, full, 1, 0, 1 << bit)
            full += 1
    # segments (-length now, length as cut, first number, start within the piece, count)
    queue = [(-x, x, 0, 0, n) for x, n in counts.items() if n]
    heapq.heapify(queue)
    runs = []
    while queue:
        length, of, first, start, count = heapq.heappop(queue)
        length = -length
        groups.reach(length)
        while count:
            found = groups.cheapest()
            fits = found is not None
            had, sequence, many, used, room = found or groups.roomiest()
            n, m = min(length, room), min(count, many)
            runs.append((of, first, first + m, start, n, sequence, used))
            groups.put(had + cost(n), sequence, m, used + n, room - n)
            groups.put(had, sequence + m, many - m, used, room)
            if not fits:
                heapq.heappush(queue, (n - length, of, first, start + n, m))
            first, count = first + m, count - m
    return runs


def pack(rows: DataFrame, capacity: int) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id and offset of every piece as it was placed.

    `rows` are `pieces`, written as a table. The lengths' counts (at most one for each length up to the longest) go to
    the driver; the runs are broadcast.
    """
    spark = rows.sparkSession
    by_task = rows.groupBy("length", "task").count()
    counts = {r[0]: r[1] for r in by_task.groupBy("length").agg(F.sum("count")).collect()}
    runs = spark.createDataFrame(plan(counts, capacity), "of long, first long, last long, from_ long, n long, sequence long, at long")
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = session.cut(by_task.select(F.col("length").alias("of_length"), F.col("task").alias("of_task"), before.alias("before")), "numbers")
    if before.count() <= BROADCAST_ROWS:
        before = F.broadcast(before)
    numbered = rows.join(before, (F.col("length") == F.col("of_length")) & (F.col("task") == F.col("of_task")))
    numbered = numbered.withColumn("ordinal", F.col("before") + F.col("number"))
    placed = numbered.join(F.broadcast(runs), (F.col("length") == F.col("of")) & (F.col("ordinal") >= F.col("first")) & (F.col("ordinal") < F.col("last")))
    ids = F.substring("ids", (4 * F.col("from_") + 1).cast("int"), (4 * F.col("n")).cast("int"))
    return placed.select("doc_id", (F.col("start") + F.col("from_")).alias("start"), F.col("n").alias("length"), ids.alias("ids"), "doc_tokens", (F.col("sequence") + F.col("ordinal") - F.col("first")).alias("sequence_id"), F.col("at").alias("offset"))
