"""Exact dedup by content sort, in DataFrame functions only.

The rows are dealt into ranges of (content key, id, salt) by splitters taken from a sample, sorted within each range, and
each row's whole normalised text is compared with its neighbour's. The content key is a short prefix and a 64-bit hash
of the text, so the splitters stay small however long the texts are; after the key the whole text decides the order,
so equal texts are adjacent. As the id is part of the splitters, a text that a third of all rows share is spread over
many ranges, and as the row's number is too, so are rows that repeat text and id: runs that touch the edge of a range are
joined with those of the same text in other ranges (at most two runs per range). Give the rows as a table, so that a task
that runs again numbers them as before.

Defined results: a null text counts as empty, empty texts equal each other; only A-Z are lower-cased; a null id comes
after all ids, so it never stays while another row of its group has an id; of rows with equal text and equal id
exactly one stays; an empty table gives an empty result; extra columns are left out, whatever their names.
"""

from __future__ import annotations

import json
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill import session

#: Code points of a text in its content key.
PREFIX = 32
#: Sampled rows per range, from which the splitters are taken.
SAMPLED = 40


def normalise(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _splitters(keys: DataFrame, ranges: int) -> list:
    """At most ranges - 1 ascending splitters from a sample of about SAMPLED rows per range."""
    n = keys.count()
    if not n or ranges < 2:
        return []
    share = min(1.0, SAMPLED * ranges / n)
    step = F.greatest(F.lit(1), F.floor(F.size("s") / ranges))
    chosen = keys.sample(share, 17).agg(F.sort_array(F.collect_list("key")).alias("s")).select(F.filter("s", lambda x, i: (i > 0) & (i % step == 0)).alias("s"))
    return chosen.first()["s"]


def _range_of(key: Column, splitters: list, kind: str) -> Column:
    """Number of splitters at or below the key, by a coarse and a fine step of about sqrt(n) comparisons each."""
    if not splitters:
        return F.lit(0)
    fine = max(1, int(len(splitters) ** 0.5))
    literal = lambda rows: F.from_json(F.lit(_json(rows)), f"array<{kind}>")
    coarse = F.size(F.filter(literal(splitters[fine - 1 :: fine]), lambda s: s <= key))
    near = F.slice(literal(splitters), coarse * fine + 1, F.lit(fine))
    return (coarse * fine + F.size(F.filter(near, lambda s: s <= key))).cast("int")


def _json(rows: list) -> str:
    return json.dumps([r.asDict() for r in rows])


def _dealt(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """id, norm, prefix, hash and the range of every row, and the number of ranges."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), normalise(F.col(text_col)).alias("norm"))
    salt = F.xxhash64(F.monotonically_increasing_id())
    rows = rows.withColumn("key", F.struct(F.substring("norm", 1, PREFIX).alias("prefix"), F.xxhash64("norm").alias("hash"), "id", salt.alias("salt")))
    splitters = _splitters(rows.select("key"), session.n_partitions(docs.sparkSession))
    place = _range_of(F.col("key"), splitters, "struct<prefix:string,hash:bigint,id:bigint,salt:bigint>")
    return rows.select("id", "norm", "key.prefix", "key.hash", place.alias("range")), len(splitters) + 1


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (of the normalised text in UTF-8).

    keep: `min` or `max`, the id that stays of each group of equal texts.
    """
    rows, ranges = _dealt(docs, id_col, text_col)
    rows = rows.repartitionById(ranges, "range")

    in_range = Window.partitionBy("range").orderBy("prefix", "hash", "norm", "id")
    before, after = F.lag("norm").over(in_range), F.lead("norm").over(in_range)
    same_id = F.lag("id").over(in_range).eqNullSafe(F.col("id"))
    marked = rows.select("id", "range", F.sha2("norm", 256).alias("sha"), "norm", before.alias("before"), after.alias("after"), same_id.alias("same_id"), F.row_number().over(in_range).alias("at"))
    edge = F.when(F.col("before").isNull() | F.col("after").isNull(), F.col("norm"))
    starts = F.coalesce(F.col("before") != F.col("norm"), F.lit(True)).cast("int")
    # rows that repeat text and id follow each other: the first of them may stay
    repeats = F.coalesce((F.col("before") == F.col("norm")) & F.col("same_id"), F.lit(False))
    marked = marked.select("id", "range", "sha", "at", starts.alias("starts"), edge.alias("edge"), repeats.alias("repeats"))
    marked = marked.withColumn("run", F.sum("starts").over(Window.partitionBy("range").orderBy("at")))
    marked = session.cut(marked.drop("starts", "at"), "content-sort")

    best = F.min if keep == "min" else F.max
    runs = marked.groupBy("range", "run").agg(best("id").alias("keep_id"), F.count("*").alias("n"), F.max("edge").alias("edge"))
    edges = runs.filter(F.col("edge").isNotNull())
    # of rows that repeat the id that stays, in several ranges, the first range's stays
    if keep == "min":
        first = F.min(F.struct(F.col("keep_id").isNull().alias("none"), "keep_id", "range"))
    else:
        first = F.max(F.struct(F.col("keep_id").isNotNull().alias("some"), "keep_id", (-F.col("range")).alias("range")))
    whole = edges.groupBy("edge").agg(first.alias("first"), F.sum("n").alias("whole_n"))
    whole = whole.select("edge", F.col("first.keep_id").alias("whole_id"), F.abs("first.range").alias("keep_range"), "whole_n")
    edges = edges.join(whole, "edge").select(F.col("range").alias("_range"), F.col("run").alias("_run"), "whole_id", "whole_n", "keep_range")
    runs = runs.drop("edge").join(edges, (F.col("range") == F.col("_range")) & (F.col("run") == F.col("_run")), "left")
    runs = runs.select("range", "run", F.coalesce("whole_id", "keep_id").alias("keep_id"), F.coalesce("whole_n", "n").alias("group_size"), F.coalesce("keep_range", "range").alias("keep_range"))
    found = marked.join(runs, ["range", "run"])
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & ~F.col("repeats") & (F.col("range") == F.col("keep_range"))
    return found.select("id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))
