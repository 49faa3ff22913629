"""Audit of how filters interact: what each removes in every order, from one pass over the texts.

1. `flagged` makes a narrow row of every document: its part, the mask of the filters that its text fails, and a hash.
2. `repeats` is a counting Bloom prepass. Every text has CELLS cells in one bucket of counters; the counters of all tasks
   are merged by adding up, and those that were met twice or more are kept as bits. A text with a cell that was met once
   is unique for certain. Only the others are shuffled, as whole texts, for the smallest id of each text.
3. Rows whose id isn't the smallest of their text fail the duplicate filter. The masks are counted by part, and as masks are
   disjoint, all figures of all orders are sums of these counts: at most 32 a part.

The sketch has 8 counters a row, up to MOST_BUCKETS of 4 kB each (128 MB), so its broadcast is bounded; with more than
some 130 million rows it clears fewer texts, and the result stays exact.

Defined results: a null text counts as empty, and empty texts equal each other; a row without an id is no duplicate and
makes none, and has no labels; rows that repeat id and text are no duplicates of each other; a null part is the
empty string; a document with several labels is good (toxic) if one of them says so; an empty table gives an empty result;
extra columns are left out, whatever their names.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill import session

#: Counters in a bucket, bits of one of Spark's bitmaps; counters of a text; buckets at most.
BUCKET, CELLS, MOST_BUCKETS = 32_768, 4, 32_768
#: The letter of the duplicate filter, the last bit of a mask.
DUPLICATE = "E"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[ \x09-\x0D]"), "")


#: Filters by letter: what a text must hold to fail.
FAILS = {
    "A": lambda text, words: F.size(words) < 100,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
    "C": lambda text, words: 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text),
    "D": lambda text, words: text.rlike(r"[#$%&*|]"),
}
LETTERS = "".join(FAILS) + DUPLICATE


def _bit(letter: str) -> int:
    return 1 << LETTERS.index(letter)


def flagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """id, part, mask (of the filters but the duplicate filter) and text_hash of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def mask(words: Column) -> Column:
        bits = [F.when(fails(F.col("text"), words), F.lit(_bit(letter))).otherwise(F.lit(0)) for letter, fails in FAILS.items()]
        return sum(bits[1:], bits[0])

    masks = F.get(F.transform(F.array(_words(F.col("text"))), mask), F.lit(0))
    return rows.select("id", "part", masks.alias("mask"), F.xxhash64("text").alias("text_hash"))


def _bucket(hashed: Column, buckets: int) -> Column:
    return F.pmod(F.shiftright(hashed, 20), F.lit(buckets))


def _cells(hashed: Column) -> list[Column]:
    """The counters of a text within its bucket: 15 bits each of a second hash."""
    mixed = F.xxhash64(hashed, F.lit(1))
    return [F.shiftright(mixed, 15 * i).bitwiseAND(F.lit(BUCKET - 1)) for i in range(CELLS)]


def sketch(rows: DataFrame) -> tuple[DataFrame, int]:
    """(bucket, twice) with a bit for every counter that was met twice or more, and the number of buckets."""
    buckets = min(MOST_BUCKETS, 8 * rows.count() // BUCKET + 1)
    cells = rows.select(_bucket(F.col("text_hash"), buckets).alias("bucket"), F.explode(F.array_distinct(F.array(*_cells(F.col("text_hash"))))).alias("cell"))
    counters = cells.groupBy("bucket", "cell").count()
    bits = counters.filter("count > 1").groupBy("bucket").agg(F.bitmap_construct_agg("cell").alias("twice"))
    return session.cut(bits, "counting-bloom"), buckets


def possible_repeats(rows: DataFrame, found: tuple[DataFrame, int]) -> DataFrame:
    """The rows (with text_hash) whose counters were all met twice or more. The sketch is at most MOST_BUCKETS bitmaps."""
    bits, buckets = found
    probed = rows.withColumn("lexmill_bucket", _bucket(F.col("text_hash"), buckets)).join(F.broadcast(bits), F.col("lexmill_bucket") == F.col("bucket"))
    for cell in _cells(F.col("text_hash")):
        byte = F.conv(F.hex(F.substring("twice", (F.shiftright(cell, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        probed = probed.filter(F.getbit(byte, cell.bitwiseAND(F.lit(7)).cast("int")) == 1)
    return probed.drop("lexmill_bucket", "bucket", "twice")


def smallest_ids(docs: DataFrame, found: tuple[DataFrame, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """first_id and first_hash of every text that may repeat: the smallest id, by the whole text."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return possible_repeats(rows, found).groupBy("text").agg(F.min("id").alias("first_id")).select("first_id", F.xxhash64("text").alias("first_hash"))


def _tally(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic of rows (id, part, mask); several rows of a part and mask are to be added up."""
    none = F.lit(0).cast("long")
    plain = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), none.alias("good"), none.alias("toxic"))
    marked = rows.filter("id IS NOT NULL").join(marks, F.col("id") == F.col("of"))
    return plain.unionByName(marked.groupBy("part", "mask").agg(none.alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")))


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask, n, good and toxic: documents of every part by the filters that they fail. `docs` is read twice."""
    rows = session.cut(flagged(docs, id_col, text_col, part_col), "flags")
    found = sketch(rows)
    first = (F.col("id") == F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    again = possible_repeats(rows.filter("id IS NOT NULL"), found).join(smallest_ids(docs, found, id_col, text_col), first, "left_anti")
    says = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias("good" if c == "quality" else c)
    marks = labels.filter("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("of")).agg(says("quality"), says("toxic"))
    moved = session.cut(_tally(session.cut(again, "repeats"), marks), "moved")
    out = moved.select("part", "mask", *[(-F.col(c)).alias(c) for c in ("n", "good", "toxic")])
    into = moved.withColumn("mask", F.col("mask") + _bit(DUPLICATE))
    return _tally(rows, marks).unionByName(out).unionByName(into).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of the filters and step, with counts of documents, from `mask_counts`.

    shapley is what a filter removes, summed over all orders: of n! orders, a filter comes first among the k that a document
    fails in n! / k.
    """
    steps = []
    for order in map("".join, permutations(letters)):
        before = 0
        for step, letter in enumerate(order, 1):
            steps.append({"filter_order": order, "step": step, "own": _bit(letter), "before": before})
            before |= _bit(letter)
    orders = len(steps) // len(letters)
    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # at most 2 ** letters
    rows = by_part.select("part", "masks", F.inline(F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,own:int,before:int>>")))
    own, before = F.col("own"), F.col("before")

    def total(of: str, holds) -> Column:
        return F.aggregate("masks", F.lit(0).cast("long"), lambda done, m: done + F.when(holds(m["mask"]), m[of]).otherwise(F.lit(0)))

    def hits(bits: Column):
        return lambda mask: mask.bitwiseAND(bits) != 0

    removed = lambda mask: (mask.bitwiseAND(before) == 0) & hits(own)(mask)
    shares = F.aggregate("masks", F.lit(0).cast("long"), lambda done, m: done + F.when(hits(own)(m["mask"]), m["n"] * F.floor(F.lit(orders) / F.bit_count(m["mask"]))).otherwise(F.lit(0)))
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda mask: mask.bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda mask: hits(own)(mask) & hits(before)(mask)).alias("redundant"),
        total("n", lambda mask: mask == own).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        shares.alias("shapley"),
    )
