"""Gapless numbering without a single task: salted ranks plus the offsets of the salts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill import session
from lexmill.functions.expressions import refuse_columns

#: Sub-groups that each key is dealt into, at least; as many as there are shuffle partitions, if these are more. The
#: table of offsets has at most keys x sub-groups rows.
LEAST_SALTS = 64


def gapless(df: DataFrame, keys: list[str], order: list[Column | str], salt_on: list[str], out: str = "ordinal", salts: int | None = None) -> DataFrame:
    """Number the rows of each key from 0 without gaps.

    Each key is split into `salts` sub-groups by a hash of `salt_on`, each is ranked by `order` on its own, and the
    sizes of the sub-groups before it are added. A key that holds a third of all rows is ranked by `salts` tasks.
    Rows that tie on `order` within a sub-group get their numbers in any order. Null keys form a group of their own.
    Columns named `lexmill_salt`, `lexmill_rank` or as `out` are refused.
    """
    refuse_columns(df, out, "lexmill_salt", "lexmill_rank")
    salts = salts or max(LEAST_SALTS, session.n_partitions(df.sparkSession))
    salted = df.withColumn("lexmill_salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)).cast("int"))
    sizes = salted.groupBy(*keys, "lexmill_salt").agg(F.count("*").alias("size"))
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("size").over(by.orderBy("lexmill_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    named = [F.col(k).alias(f"lexmill_key{i}") for i, k in enumerate(keys)]
    offsets = sizes.select(*named, F.col("lexmill_salt").alias("lexmill_of"), before.alias("lexmill_before"))
    match = F.col("lexmill_salt") == F.col("lexmill_of")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"lexmill_key{i}"))
    ranked = salted.withColumn("lexmill_rank", F.row_number().over(Window.partitionBy(*keys, "lexmill_salt").orderBy(*order)))
    joined = ranked.join(offsets, match)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("lexmill_before") + F.col("lexmill_rank") - 1).cast("long").alias(out))
