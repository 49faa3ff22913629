"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once per row, however often it stands in the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Values that `running_sums` adds up at a time.
BLOCK = 256


def running_sums(values: Column) -> Column:
    """For every element of an array of numbers, the sum of those before it; empty for an empty array, null for a null one.

    An array that grows by an element is copied each time, so blocks are summed up on their own, and then their totals:
    the work for each element does not grow with the array.
    """
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("total"), F.array().cast("array<bigint>").alias("before"))

    def grown(done: Column, value: Column) -> Column:
        return F.struct((done["total"] + value).alias("total"), F.concat(done["before"], F.array(done["total"])).alias("before"))

    def sums(xs: Column) -> Column:
        return F.aggregate(xs, start, grown)

    def joined(blocks: Column) -> Column:
        offsets = sums(F.transform(blocks, lambda b: b["total"]))["before"]
        return F.flatten(F.zip_with(blocks, offsets, lambda b, o: F.transform(b["before"], lambda x: x + o)))

    longs = values.cast("array<bigint>")
    places = F.when(F.size(longs) > 0, F.sequence(F.lit(0), F.floor((F.size(longs) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(values.isNotNull(), let(longs, lambda xs: let(F.transform(places, lambda i: sums(F.slice(xs, i * BLOCK + 1, F.lit(BLOCK)))), joined)))


class ClashingColumn(ValueError):
    """An input has a column of a name that the operator adds."""


def refuse_columns(rows: DataFrame, *added: str) -> None:
    """Refuse an input that has a column, in whatever case, of a name to be added."""
    taken = {c.lower() for c in rows.columns} & {a.lower() for a in added}
    if taken:
        raise ClashingColumn(f"the input has a column {sorted(taken)[0]!r}, which is to be added")
