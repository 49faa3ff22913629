"""The title of a text, and the places of its headings, by folds over its lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.expressions import let, running_sums

# Bounds of a title's length, and the words at the head of a text among which it is looked for.
SHORTEST, LONGEST, HEAD_WORDS, LONG_LINE = 10, 300, 300, 60
_METADATA = r"(?i)\bvol(?:ume)?\.?\s*\d+|\bissue\s*\d+|\bpp\.?\s*\d+|@|http|\buniversity\b|\binstitute\b|\bdepartment\b"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _scored(text: Column, place: Column, header: bool, isolated: Column, seq: Column) -> Column:
    """A candidate: order (minus its score), seq (to break ties), text and reasons."""
    words, size = _words(text), F.length(text)
    capital = F.size(F.filter(words, lambda w: (F.upper(F.substring(w, 1, 1)) == F.substring(w, 1, 1)) & (F.lower(F.substring(w, 1, 1)) != F.substring(w, 1, 1))))
    titled = (F.size(words) >= 3) & (capital / F.size(words) >= 0.7)
    meta = text.rlike(_METADATA) | text.rlike(r"^\d{4}\s|^\w+\s+\d{4}")
    zero = F.lit(0.0)
    score = F.lit(0.5 + 0.3) if header else F.lit(0.5)
    for step in (
        F.when(place == 0, 0.15).when(place == 1, 0.05).otherwise(zero),
        F.when(isolated, 0.1).otherwise(zero),
        F.when(size.between(30, 150), 0.1).when((size < 20) | (size > 200), -0.1).otherwise(zero),
        F.when(titled, 0.05).otherwise(zero),
        F.when(meta, -0.3).otherwise(zero),
    ):
        score = score + step
    score = F.greatest(zero, F.least(F.lit(1.0), score))
    reasons = F.concat_ws(
        "; ",
        F.lit("markdown header") if header else F.lit(None).cast("string"),
        F.when(place == 0, "first content"),
        F.when(isolated, "isolated line"),
        F.when(size.between(30, 150), "good length"),
        F.when(titled, "title case"),
        F.when(meta, "likely metadata"),
    )
    return F.struct((-score).alias("order"), seq.cast("int").alias("seq"), text.alias("text"), F.when(reasons == "", "base score").otherwise(reasons).alias("why"))


def _fits(text: Column) -> Column:
    return F.length(text).between(SHORTEST, LONGEST)


def _headers(lines: Column) -> Column:
    def candidate(line: Column, i: Column) -> Column:
        after = F.trim(F.coalesce(F.get(lines, i + 1), F.lit("")))
        text = F.trim(F.regexp_extract(F.trim(line), r"^#{1,3}\s+(.+)$", 1))
        return F.when(_fits(text), _scored(text, F.when(i < 5, 0).otherwise(1), True, (after == "") | after.startswith("#"), i))

    return F.filter(F.transform(lines, candidate), lambda c: c.isNotNull())


def _groups(lines: Column) -> Column:
    """Paragraphs among the first words: blank lines, headings and long lines end one."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"), F.lit(0).alias("words"), F.lit(False).alias("over"))

    def closed(s: Column) -> Column:
        return F.when(s["held"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["held"])))

    def step(s: Column, raw: Column) -> Column:
        line = F.trim(raw)
        ends, n = (line == "") | line.startswith("#"), F.size(_words(line))
        over = s["over"] | ~ends & (s["words"] + n > HEAD_WORDS)
        held = F.when(s["held"] == "", line).otherwise(F.concat(s["held"], F.lit(" "), line))
        long = F.length(line) > LONG_LINE
        return (
            F.when(over, s.withField("over", F.lit(True)))
            .when(ends, F.struct(closed(s).alias("out"), F.lit("").alias("held"), s["words"].alias("words"), F.lit(False).alias("over")))
            .otherwise(F.struct(F.when(long, F.concat(s["out"], F.array(held))).otherwise(s["out"]).alias("out"), F.when(long, "").otherwise(held).alias("held"), (s["words"] + n).alias("words"), F.lit(False).alias("over")))
        )

    return F.aggregate(lines, start, step, closed)


def title(text: Column) -> Column:
    """value, confidence, alternatives and reasoning of a text's title.

    Candidates are headings of levels 1 to 3 and the first paragraphs; the margin to the second bears on the confidence.
    """
    paragraphs = lambda groups: F.filter(F.transform(groups, lambda g, i: F.when(_fits(g), _scored(g, i, False, F.lit(True), i + 1_000_000))), lambda c: c.isNotNull())
    found = let(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda lines: F.array_sort(F.concat(_headers(lines), let(_groups(lines), paragraphs))))
    empty = F.trim(F.coalesce(text, F.lit(""))) == ""

    def chosen(c: Column) -> Column:
        best, second = F.get(c, F.lit(0)), F.get(c, F.lit(1))
        margin = F.least(3 * (second["order"] - best["order"]), F.lit(1.0))
        confidence = F.when(second.isNotNull(), -best["order"] * (0.7 + 0.3 * margin)).otherwise(-best["order"] * 0.9)
        return F.struct(
            best["text"].alias("value"),
            F.coalesce(F.bround(confidence, 2), F.lit(0.0)).alias("confidence"),
            F.transform(F.slice(c, 2, 3), lambda x: x["text"]).alias("alternatives"),
            F.when(empty, "no text content to extract title from").otherwise(F.coalesce(best["why"], F.lit("no valid title candidates found"))).alias("reasoning"),
        )

    return let(found, chosen)


def headings(text: Column) -> Column:
    """level, title and start (in characters) of the headings outside of fenced blocks."""

    def found(lines: Column) -> Column:
        fences = F.transform(lines, lambda line: F.trim(line).rlike("^```|^~~~").cast("int"))
        starts = running_sums(F.transform(lines, lambda line: F.length(line) + 1))
        rows = F.arrays_zip(lines.alias("line"), fences.alias("fence"), running_sums(fences).alias("before"), starts.alias("start"))
        # a line is in a block where an odd number of fences stands before it
        open_lines = F.filter(rows, lambda r: (r["fence"] == 0) & (r["before"] % 2 == 0) & r["line"].rlike(r"^#{1,6}\s+\S"))
        mark = lambda line: F.regexp_extract(line, r"^(#{1,6})\s+\S", 1)
        return F.transform(open_lines, lambda r: F.struct(F.length(mark(r["line"])).alias("level"), F.trim(F.regexp_replace(r["line"], r"^#{1,6}\s+", "")).alias("title"), r["start"].cast("int").alias("start")))

    return let(F.split(text, "\n", -1), found)
