"""How well extracted metadata matches what is known."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.expressions import let

#: Similarity from which titles count as equal.
TITLE_THRESHOLD = 0.8


def _ratio(found: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in found:
        pairs = zip(a.to_pylist(), b.to_pylist(), strict=True)
        yield pa.array([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in pairs], pa.float64())


_ratio.__annotations__ = {"found": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}


def title_similarity(found: Column, known: Column) -> Column:
    """Share of matching blocks of two titles, but for case and white space; 0 if either is empty."""
    plain = lambda t: F.lower(F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), r"\s+", " ")))
    return F.arrow_udf(_ratio, "double")(plain(found), plain(known))


def plain_name(name: Column) -> Column:
    """A name in lower case, with plain hyphens and single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(name, r"[\x{2010}-\x{2014}\x{2212}]", "-")), r"\s+", " "))


def _parted(name: Column) -> Column:
    """A plain name with its family name, its given names and the first of these; null where it has no comma."""
    halves = lambda n: F.split(n, ",", 2)
    given = lambda n: F.trim(F.replace(F.get(halves(n), F.lit(1)), F.lit("."), F.lit("")))
    with_given = lambda n: let(given(n), lambda g: F.struct(n.alias("name"), F.trim(halves(n)[0]).alias("family"), g.alias("given"), F.split(g, " ")[0].alias("first")))
    return let(plain_name(name), lambda n: F.when(n.contains(","), with_given(n)).otherwise(F.struct(n.alias("name"), *[F.lit(None).cast("string").alias(c) for c in ("family", "given", "first")])))


def _alike(x: Column, y: Column) -> Column:
    alike = x["given"].startswith(y["given"]) | y["given"].startswith(x["given"]) | (x["first"] == y["first"])
    return (x["name"] == y["name"]) | F.coalesce((x["family"] == y["family"]) & alike, F.lit(False))


def names_match(a: Column, b: Column) -> Column:
    """Equal names, or two of the form `Family, Given` with one family name whose given names are one the beginning of the other, or have the first word in common.

    Dots are left out of given names, so an initial is the beginning of a name.
    """
    return let(F.struct(_parted(a).alias("x"), _parted(b).alias("y")), lambda p: _alike(p["x"], p["y"]))


def author_score(found: Column, known: Column) -> Column:
    """Share of the known names that a found one matches, each found one once, in order. Without known names: 1 if none was found, else 0.

    Every name is parted once, and looked up once.
    """
    start = F.struct(F.transform(F.coalesce(found, F.array().cast("array<string>")), _parted).alias("left"), F.lit(0).alias("hits"))

    def step(done: Column, name: Column) -> Column:
        def without(at: Column) -> Column:
            others = F.filter(done["left"], lambda _, i: i != at - 1)
            return F.struct(F.when(at > 0, others).otherwise(done["left"]).alias("left"), (done["hits"] + F.when(at > 0, 1).otherwise(0)).alias("hits"))

        return let(F.array_position(F.transform(done["left"], lambda f: _alike(f, name)), True), without)

    none = F.coalesce(F.size(known), F.lit(0)) <= 0
    return F.when(none, F.when(F.coalesce(F.size(found), F.lit(0)) <= 0, 1.0).otherwise(0.0)).otherwise(F.aggregate(F.transform(known, _parted), start, step, lambda done: done["hits"] / F.size(known)))


def authors_match(found: Column, known: Column) -> Column:
    """Whether every known name has a match of its own."""
    return author_score(found, known) == 1.0


def years_match(found: Column, known: Column) -> Column:
    """Equal years, as trimmed text; true where none is known."""
    return F.when(known.isNull(), True).otherwise(F.coalesce(F.trim(found.cast("string")) == F.trim(known.cast("string")), F.lit(False)))


def report(rows: DataFrame, **others: Column) -> DataFrame:
    """documents, extraction_rate, and accuracies over the extracted, of rows with extracted, title_similarity, authors_ok, year_ok; and `others`, aggregates by name."""
    over = lambda c: F.avg(F.when(F.col("extracted"), c.cast("double")))
    return rows.agg(
        F.count("*").alias("documents"),
        F.avg(F.col("extracted").cast("double")).alias("extraction_rate"),
        over(F.col("title_similarity") >= TITLE_THRESHOLD).alias("title_accuracy"),
        over(F.col("authors_ok")).alias("author_accuracy"),
        over(F.col("year_ok")).alias("year_accuracy"),
        *[c.alias(name) for name, c in others.items()],
    )
