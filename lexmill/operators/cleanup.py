"""Clean-up of extracted text, as column expressions on whole texts. Null stays null."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.expressions import let

# Blocks of scripts that count as recognition errors, and how many of their characters condemn a line.
FOREIGN = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{0600}-\x{06FF}\x{0E00}-\x{0E7F}\x{0900}-\x{097F}]"
MOST_FOREIGN = 4
# Words of picture descriptions that say nothing, and the length below which one says nothing.
NOISE = ["logo", "seal", "icon", "watermark", "decorative", "cover art", "book cover"]
LEAST_DESCRIPTION = 20
# How often a line must repeat, and lines that may.
REPEATS = 3
STRUCTURE = r"^(#{1,6}\s|[-*+]\s|\d+\.\s|[>|])"
# What publishers put before a text, searched for in so many lines.
BOILERPLATE = [
    "your use of the jstor archive",
    "jstor is a not-for-profit",
    "collaborating with jstor",
    "see discussions, stats",
    "researchgate.net/publication",
    "this paper can be downloaded free of charge",
    "this open-access article is brought to you",
    "electronic copy available at",
]
HEAD_LINES = 50
FRAGMENT = r"^https?://|^\d{4}$|^[\d,]+$|^(CITATIONS|READS|REFERENCES)$|View project"
# Tags that are stripped, their text kept.
TAGS = "sub|math|u|small|mark|span|div|table|tbody|thead|tfoot|tr|td|th|caption|colgroup|col|p|ul|ol|li|dl|dt|dd|a|img|pre|code|blockquote|section|article|header|footer|nav|aside|main|figure|figcaption|h[1-6]|hr"
# Endings before which a hyphen at a line's end is a break.
ENDINGS = "tion sion ment ness ing ence ance ous ious able ible ful less ity ive ally ately ly al ual ure er ed es ize ise ory ary".split()

_SPACE = r"[\s\x1c-\x1f\x85\x{a0}]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _joined(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def _strip(line: Column) -> Column:
    return F.regexp_replace(line, rf"^{_SPACE}+|{_SPACE}+$", "")


def drop_foreign_lines(text: Column) -> Column:
    """Leave out lines with four or more characters of scripts that stand for recognition errors."""
    return _joined(F.filter(_lines(text), lambda line: F.regexp_count(line, F.lit(FOREIGN)) < MOST_FOREIGN))


def picture_descriptions(text: Column) -> Column:
    """Turn the extractor's picture descriptions into quotes; leave out those that say nothing."""
    shape = r"^Image /page/\d+/\w+/\d+ description:\s*(.*)$"

    def line(raw: Column) -> Column:
        stripped = _strip(raw)
        said = _strip(F.regexp_extract(stripped, shape, 1))
        noise = F.length(said) < LEAST_DESCRIPTION
        for word in NOISE:
            noise = noise | F.lower(said).contains(word)
        return F.when(~stripped.rlike(shape), raw).when(~noise, F.concat(F.lit("> [Figure] "), said))

    return _joined(F.filter(F.transform(_lines(text), line), lambda x: x.isNotNull()))


def _key(line: Column) -> Column:
    return F.regexp_replace(_strip(line), rf"{_SPACE}+", " ")


def drop_repeated_lines(text: Column) -> Column:
    """Leave out all lines whose text, but for white space, stands three times or more and is no markdown structure.

    The keys are sorted, so a key is frequent if it equals the one two places on: no join, no shuffle.
    """
    keyed = F.transform(_lines(text), lambda line: F.struct(line.alias("line"), _key(line).alias("key")))

    def frequent(lines: Column) -> Column:
        keys = F.transform(F.filter(lines, lambda x: (x["key"] != "") & ~x["key"].rlike(STRUCTURE)), lambda x: x["key"])
        return let(F.array_sort(keys), lambda k: F.array_distinct(F.filter(k, lambda key, i: key == F.get(k, i + (REPEATS - 1)))))

    def without(lines: Column, gone: Column) -> Column:
        return F.transform(F.filter(lines, lambda x: ~F.array_contains(gone, x["key"])), lambda x: x["line"])

    return F.when(text.isNotNull(), _joined(let(keyed, lambda lines: let(frequent(lines), lambda gone: without(lines, gone)))))


def strip_boilerplate(text: Column) -> Column:
    """Leave out what publishers put into the first 50 lines.

    If the first line of content comes after the last line of boilerplate, all before it goes; else only the lines of
    boilerplate and the fragments of metadata before the first content. Then leading blank lines go. A text without
    boilerplate stays as it is.
    """

    def kind(line: Column, i: Column) -> Column:
        boiler = F.lit(False)
        for said in BOILERPLATE:
            boiler = boiler | F.lower(line).contains(said)
        stripped = _strip(line)
        # 3: boilerplate, 2: fragment, 1: blank, 0: content
        return F.when(i >= HEAD_LINES, 0).when(boiler, 3).when(stripped == "", 1).when(stripped.rlike(FRAGMENT), 2).otherwise(0)

    def trimmed(kept: Column) -> Column:
        said = F.filter(F.transform(kept, lambda line, i: F.when(_strip(line) != "", i)), lambda i: i.isNotNull())
        return F.when(F.size(said) == 0, F.array().cast("array<string>")).otherwise(F.slice(kept, F.element_at(said, 1) + 1, F.greatest(F.size(kept), F.lit(1))))

    def kept(lines: Column, head: Column) -> Column:
        last = F.size(head) - F.array_position(F.reverse(head), 3)  # place of the last line of boilerplate, from 0
        content = F.array_position(head, 0) - 1  # -1 if there is none

        def cut(at: Column) -> Column:
            limit = F.when(at["content"] < 0, F.size(head)).otherwise(at["content"])
            stays = lambda line, i: (i >= HEAD_LINES) | ~((F.get(head, i) == 3) | (F.get(head, i) == 2) & (i < limit))
            return F.when(at["content"] > at["last"], F.slice(lines, (at["content"] + 1).cast("int"), F.size(lines))).otherwise(F.filter(lines, stays))

        return let(F.struct(last.alias("last"), content.alias("content")), cut)

    def cleaned(both: Column) -> Column:
        return F.when(~F.array_contains(both["head"], 3), text).otherwise(_joined(let(kept(both["lines"], both["head"]), trimmed)))

    kinds = lambda lines: F.transform(F.slice(lines, 1, HEAD_LINES), kind)
    return let(let(_lines(text), lambda lines: F.struct(lines.alias("lines"), kinds(lines).alias("head"))), cleaned)


def coerce_html(text: Column) -> Column:
    """Emphasis becomes asterisks, numbered superscripts brackets, breaks spaces; other known tags go, their text stays."""
    for pattern, by in (
        (r"(?s)<(?:i|em)>(.*?)</(?:i|em)>", "*$1*"),
        (r"(?s)<(?:b|strong)>(.*?)</(?:b|strong)>", "**$1**"),
        (r"<sup>(\d+)\.?</sup>", "[$1]"),
        (r"(?s)<sup>(.*?)</sup>", "$1"),
        (r"(?i)<br\s*/?>", " "),
        (rf"</?(?:{TAGS})(?:\s[^>]*)?>", ""),
    ):
        text = F.regexp_replace(text, pattern, by)
    return text


def dehyphenate(text: Column) -> Column:
    """Join words cut at line ends; the hyphen goes where a known ending follows. One pass, no word list."""
    endings = "|".join(ENDINGS)
    return F.regexp_replace(text, rf"(?U)(\w+)(?:-\n\s*(?=(?:{endings}))|(-)\n\s*)([a-z]\w*)", "$1$2$3")


#: Words that a word list for dehyphenation may have: it is broadcast to the tasks.
MOST_WORDS = 2_000_000
_BROKEN = re.compile(r"(\w+)-\n\s*([a-z]\w*)")


def dehyphenator(spark: SparkSession, path: str) -> Callable[[Column], Column]:
    """A column function that joins words cut at line ends by a word list, a word per line.

    The hyphen goes where the joined word is listed; it stays where the hyphenated one is; else known endings decide, as in
    `dehyphenate`. Lists of over MOST_WORDS words are refused.
    """
    listed = spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).filter("word <> ''").distinct().limit(MOST_WORDS + 1)
    words = frozenset(listed.toArrow()["word"].to_pylist())
    if len(words) > MOST_WORDS:
        raise ValueError(f"a word list may have {MOST_WORDS} words")
    shared = spark.sparkContext.broadcast(words)

    def joined(m: re.Match) -> str:
        plain, hyphened = m[1] + m[2], f"{m[1]}-{m[2]}"
        if plain.lower() in shared.value:
            return plain
        return hyphened if hyphened.lower() in shared.value or not m[2].startswith(tuple(ENDINGS)) else plain

    def task(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([None if t is None else _BROKEN.sub(joined, t) for t in batch.to_pylist()], pa.string())

    task.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(task, "string")


_BLANK, _SOLID = r"[\s\x1c-\x1f\x85\x{a0}]*", r"[^\s\x1c-\x1f\x85\x{a0}]"


def is_structural(line: Column) -> Column:
    """Whether a line, but for white space around it, stands for itself: blank, heading, item, fence, table, quote or rule."""
    return line.rlike(rf"^{_BLANK}(?:$|#|[-*+]\s{_BLANK}{_SOLID}|\d+\.\s{_BLANK}{_SOLID}|```|~~~|\||>|[-*_]{{3,}}{_BLANK}$)")


#: Stand around lines that stay as they are; Unicode has set them apart for such use, and texts don't hold them.
_KEEP, _KEPT = "\ufdd0", "\ufdd1"


def reflow(text: Column) -> Column:
    """Join the lines of a paragraph by spaces; structural lines and fenced blocks stay as they are.

    The text is cut before its fences, so every second part is a fenced block. Lines that stay are marked, and line breaks
    that touch no mark become spaces: linear in the length of the text.
    """

    def line(raw: Column) -> Column:
        kept = F.concat(F.lit(_KEEP), raw, F.lit(_KEPT))
        # without white space around it, and of several spaces the first
        return F.when(is_structural(raw), kept).otherwise(F.regexp_replace(raw, rf"^{_SPACE}+|{_SPACE}+$|(?<= ) +", ""))

    def part(raw: Column, i: Column) -> Column:
        block = F.concat(F.lit(_KEEP), F.replace(raw, F.lit("\n"), F.lit(f"{_KEPT}\n{_KEEP}")), F.lit(_KEPT))
        return F.when(i % 2 == 1, block).otherwise(_joined(F.transform(_lines(raw), line)))

    parts = F.split(F.concat(F.lit("\n"), text), rf"(?md)(?=^[\s\x1c-\x1f\x85\x{{a0}}&&[^\n]]*(?:```|~~~))", -1)
    marked = F.regexp_replace(F.array_join(F.transform(parts, part), ""), f"(?<!{_KEPT})\n(?!{_KEEP})", " ")
    return F.substr(F.translate(marked, _KEEP + _KEPT, ""), F.lit(2))


def clean_artifacts(text: Column) -> Column:
    """Lines of foreign script, picture descriptions, repeated lines, boilerplate: in this order."""
    return strip_boilerplate(drop_repeated_lines(picture_descriptions(drop_foreign_lines(text))))


def clean_markdown(text: Column) -> Column:
    return reflow(dehyphenate(coerce_html(text)))
