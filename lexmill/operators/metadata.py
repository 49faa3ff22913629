"""Bibliographic metadata: names, dates, citation keys and heuristics on text, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill import session
from lexmill.functions.expressions import let

# Words that a title's key word may not be.
TITLE_STOP_WORDS = """
a an the and or but if then else when at by for with about against between into through during before after above below
to from up down in out on off over under again further once here there where why how all each few more most other some
such no nor not only own same so than too very can will just should now of is are was were be been being have has had
having do does did doing would could might must shall
""".split()
MONTHS = r"(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan\.?|Feb\.?|Mar\.?|Apr\.?|May\.?|Jun\.?|Jul\.?|Aug\.?|Sep(?:t)?\.?|Oct\.?|Nov\.?|Dec\.?)"
YEAR = r"((?:19|20)\d{2})"
FIRST_YEAR, LAST_YEAR = 1900, 2027
DATE_LINES = 30
# Signs of a kind of document and their weights.
KINDS = [
    (r"\bdissertation\b", "thesis", 0.9),
    (r"\bthesis\b", "thesis", 0.9),
    (r"\bphd\b.*\b(?:candidate|student)\b", "thesis", 0.8),
    (r"in partial fulfillment", "thesis", 0.85),
    (r"\bmaster'?s?\s+(?:thesis|degree)\b", "thesis", 0.85),
    (r"\bproceedings\b", "paper-conference", 0.85),
    (r"\bconference\b.*\bpaper\b", "paper-conference", 0.8),
    (r"\bworkshop\b.*\bpaper\b", "paper-conference", 0.75),
    (r"\baccepted\s+(?:at|to)\s+\w+\s+\d{4}\b", "paper-conference", 0.7),
    (r"^chapter\s+\d+", "chapter", 0.9),
    (r"\bin:\s+\w+", "chapter", 0.6),
    (r"\beditors?:\s+", "chapter", 0.5),
    (r"\btechnical\s+report\b", "report", 0.9),
    (r"\btr-\d+", "report", 0.8),
    (r"\bworking\s+paper\b", "report", 0.75),
    (r"\bwhite\s+paper\b", "report", 0.7),
    (r"\bisbn\b", "book", 0.8),
    (r"\bpublisher:\s+", "book", 0.6),
    (r"\bjournal\s+of\b", "article-journal", 0.8),
    (r"\bvol(?:ume)?\.?\s*\d+", "article-journal", 0.6),
    (r"\bissue\s*\d+", "article-journal", 0.5),
    (r"\bpp\.?\s*\d+", "article-journal", 0.5),
]
DEFAULT_KIND, DEFAULT_KIND_CONFIDENCE = "article-journal", 0.4
KIND_CHARS = 3000

# Kinds of bibliographic items.
CSL_TYPES = """
article article-journal article-magazine article-newspaper bill book broadcast chapter classic collection dataset
document entry entry-dictionary entry-encyclopedia event figure graphic hearing interview legal_case legislation
manuscript map motion_picture musical_score pamphlet paper-conference patent performance periodical
personal_communication post post-weblog regulation report review review-book software song speech standard thesis
treaty webpage
""".split()
# Fields of an item that hold names, dates and strings (or numbers), and others that are known.
CSL_NAMES = "author chair collection-editor compiler composer container-author contributor curator director editor editorial-director executive-producer guest host illustrator interviewer narrator organizer original-author performer producer recipient reviewed-author script-writer series-creator translator".split()
CSL_DATES = "accessed available-date event-date issued original-date submitted".split()
CSL_STRINGS = """
abstract annote archive archive_collection archive_location archive-place authority call-number chapter-number
citation-number citation-label citation-key collection-number collection-title container-title container-title-short
dimensions division DOI edition event event-title event-place first-reference-note-number genre ISBN ISSN issue
jurisdiction keyword language locator medium note number number-of-pages number-of-volumes original-publisher
original-publisher-place original-title page page-first part part-title PMCID PMID printing publisher publisher-place
references reviewed-genre reviewed-title scale section shortTitle journalAbbreviation source status supplement title
title-short URL version volume volume-title volume-title-short year-suffix
""".split()
CSL_OTHERS = ["categories", "custom"]

#: Letters that fold to two.
_PAIRS = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th"}
_SINGLES = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ı": "i"}


def _folds() -> dict[str, str]:
    table = dict(_SINGLES)
    for point in range(0xC0, 0x250):
        parts = unicodedata.normalize("NFD", chr(point))
        if len(parts) > 1 and parts[0].isascii():
            table[chr(point)] = parts[0]
    return table


FOLDS = _folds()


def ascii_fold(text: Column) -> Column:
    """Latin letters without diacritics; other characters stay."""
    for pair, by in _PAIRS.items():
        text = F.replace(text, F.lit(pair), F.lit(by))
    return F.translate(text, "".join(FOLDS), "".join(FOLDS.values()))


def capitalize(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substr(word, F.lit(2))))


def key_author(name: Column) -> Column:
    """Letters of a folded family name."""
    return F.regexp_replace(ascii_fold(F.coalesce(name, F.lit(""))), "[^a-zA-Z]", "")


def key_title_word(title: Column) -> Column:
    """The first word of over two letters that is no stop word, capitalised; '' if there is none."""
    words = F.regexp_extract_all(ascii_fold(F.coalesce(title, F.lit(""))), F.lit("[a-zA-Z]+"), F.lit(0))
    good = F.filter(words, lambda w: (F.length(w) > 2) & ~F.lower(w).isin(TITLE_STOP_WORDS))
    return F.coalesce(capitalize(F.get(good, F.lit(0))), F.lit(""))


def citekey(family: Column, year: Column, title: Column, record: Column) -> Column:
    """AuthorYearWord; `unknown-` and eight hex digits of the record's hash where neither author nor title gives a part."""
    author, word = key_author(family), key_title_word(title)
    known = F.concat(author, F.coalesce(year.cast("string"), F.lit("")), word)
    return F.when((author != "") | (word != ""), known).otherwise(F.concat(F.lit("unknown-"), F.substring(F.sha2(record, 256), 1, 8)))


def _suffix(i: Column) -> Column:
    """'' for 0, then a to z, then 1, 2, ..."""
    return F.when(i == 0, F.lit("")).when(i <= 26, F.chr(i + 96)).otherwise((i - 26).cast("string"))


def unique_citekeys(rows: DataFrame, base: str, order: list[str], taken: DataFrame | None = None, out: str = "citekey") -> DataFrame:
    """Give rows with the same base key the suffixes '', a to z, 1, 2, ... in order, so that all keys differ, also from those that `taken` (citekey) holds.

    The first row of a base key gets it as it is, if it is free; the suffixes go past every key that is taken or that is
    some row's base key. It is what a loop gives that adds the first rows of all bases before the others. Keys that two
    bases with numbers reach (`K1` and 1, `K` and 11) are found when all have one; the later rows go on from there. A
    frequent base key is numbered by ranges, never by one task. Rows that tie on `order` get their suffixes in any order;
    null base keys stay null.
    """
    own = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(base).alias("base"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    keys = [f"o{i}" for i in range(len(order))]
    done, todo = None, own
    while True:
        given = session.cut(_suffixed(todo, keys, taken), "citekeys")
        given = given if done is None else done.unionByName(given)
        again = given.filter("key is not null").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
        if done is None and again.isEmpty():
            return given.select("row.*", F.col("key").alias(out))
        met = given.join(again.withColumn("met", F.lit(True)), "key", "left")
        first = F.row_number().over(Window.partitionBy("key").orderBy(*keys)) == 1
        judged = session.cut(met.withColumn("stays", F.col("met").isNull() | F.col("key").isNull() | first).drop("met"), "citekeys")
        done, todo = judged.filter("stays").drop("stays"), judged.filter("not stays").drop("stays", "key")
        if todo.isEmpty():
            return done.select("row.*", F.col("key").alias(out))
        used = done.filter("key is not null").select(F.col("key").alias("citekey"))
        taken = used if taken is None else used.union(taken.select("citekey"))


def _suffixed(rows: DataFrame, keys: list[str], taken: DataFrame | None) -> DataFrame:
    """`rows` with key: its base and the next suffix that neither a taken key nor a base has."""
    numbered, bases = _in_order(rows, keys)
    used = bases.select(F.col("base").alias("citekey"))
    blocked = bases.select("base", F.lit(-1).cast("long").alias("place")).limit(0)
    if taken is not None:
        held = taken.select("citekey").filter("citekey is not null").distinct()
        blocked, used = held.select(F.col("citekey").alias("base"), F.lit(0).cast("long").alias("place")), used.union(held)
    # a used key is in the way of what it is with a suffix: all but its last letter, or all but some digits at its end
    digits = F.length(F.regexp_extract("citekey", "([0-9]*)$", 1))
    cuts = F.when(F.col("citekey").rlike("[a-z]$"), F.array(F.lit(1))).when(digits > 0, F.sequence(F.lit(1), F.least(digits, F.lit(9))))
    roots = used.distinct().select("citekey", F.explode(cuts).alias("n")).filter(F.length("citekey") > F.col("n"))
    tail = F.expr("substring(citekey, length(citekey) - n + 1, n)")
    place = F.when(tail.rlike("^[a-z]$"), (F.ascii(tail) - 96).cast("long")).when(~tail.startswith("0"), tail.try_cast("long") + 26)
    found = roots.select(F.expr("substring(citekey, 1, length(citekey) - n)").alias("base"), place.alias("place")).filter("place is not null")
    blocked = blocked.union(found).join(bases, "base", "left_semi").distinct()
    # the i-th free place is i and the number of blocked places, less the blocked ones before each, that are not above i
    shift = blocked.select("base", (F.col("place") - F.row_number().over(Window.partitionBy("base").orderBy("place")) + 1).alias("at"))
    steps = shift.groupBy("base", "at").agg(F.count("*").alias("n"))
    steps = steps.withColumn("skipped", F.sum("n").over(Window.partitionBy("base").orderBy("at")))
    steps = steps.groupBy("base").agg(F.array_sort(F.collect_list(F.struct("at", "skipped"))).alias("steps"))
    passed = F.filter("steps", lambda s: s["at"] <= F.col("place"))
    skipped = F.coalesce(F.get(passed, F.size(passed) - 1)["skipped"], F.lit(0))
    with_steps = numbered.join(steps.withColumnRenamed("base", "of"), F.col("base") == F.col("of"), "left")
    return with_steps.select("row", "base", *keys, F.concat("base", _suffix(F.col("place") + skipped)).alias("key"))


def _in_order(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """`rows` with place: the number of each row among those of its base, in order of the keys, from 0; and all bases.

    Sampled ranges of (base, keys) are numbered on their own, and what the ranges before hold of a base is added.
    """
    n = session.n_partitions(rows.sparkSession)
    dealt = rows.repartitionByRange(n, "base", *keys).withColumn("range", F.spark_partition_id())
    dealt = session.cut(dealt, "ranges")
    sizes = dealt.groupBy("base", "range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("base").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("base", "range", before.alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("base", "range").orderBy(*keys)))
    joined = ranked.join(offsets.withColumnsRenamed({"base": "b", "range": "r"}), F.col("base").eqNullSafe(F.col("b")) & (F.col("range") == F.col("r")))
    return joined.withColumn("place", F.col("before") + F.col("rank") - 1).drop("b", "r", "before", "rank", "range"), sizes.filter("base is not null").select("base").distinct()


def csl_year(record: Column) -> Column:
    """The year of a CSL-JSON string, null unless it is a number."""
    return F.get_json_object(record, "$.issued.date-parts[0][0]").try_cast("int")


def partial_date(year: Column, month: Column, day: Column) -> Column:
    """YYYY-MM-DD, YYYY-MM or YYYY, as far as it is known."""
    return (
        F.when(year.isNull(), F.lit(None).cast("string"))
        .when(month.isNotNull() & day.isNotNull(), F.format_string("%04d-%02d-%02d", year, month, day))
        .when(month.isNotNull(), F.format_string("%04d-%02d", year, month))
        .otherwise(year.cast("string"))
    )


def initials(given: Column) -> Column:
    """'John Robert' to 'J.R.', 'Jean-Pierre' to 'J.-P.'; initials stay."""

    def short(part: Column) -> Column:
        kept = F.when(part.endswith("."), part).otherwise(F.concat(part, F.lit(".")))
        is_initial = (F.length(part) == 1) | (F.length(part) == 2) & part.endswith(".")
        return F.when(is_initial, kept).otherwise(F.concat(F.upper(F.substring(part, 1, 1)), F.lit(".")))

    parts = F.filter(F.split(F.coalesce(given, F.lit("")), r"\s+"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.array_join(F.transform(F.filter(F.split(p, "-"), lambda h: h != ""), short), "-")), "")


def author(family: Column, given: Column, literal: Column, particle: Column) -> Column:
    """'Family, G.' with a particle before it, or the literal as it is; null without either."""
    name = F.when(particle.isNotNull(), F.concat_ws(" ", particle, family)).otherwise(family)
    short = initials(given)
    personal = F.when(short != "", F.concat(name, F.lit(", "), short)).otherwise(name)
    return F.when(literal.isNotNull(), literal).when(family.isNotNull(), personal)


def authors(people: Column) -> Column:
    """An array of CSL names as one string, joined by '; '; null if none has a name."""
    each = F.transform(people, lambda p: author(p["family"], p["given"], p["literal"], p["non-dropping-particle"]))
    joined = F.array_join(F.filter(each, lambda a: a.isNotNull() & (a != "")), "; ")
    return F.when(joined != "", joined)


def contributors(people: Column, editors: Column) -> Column:
    """The authors as one string, or the editors where there are no authors."""
    return F.when(F.coalesce(F.size(people), F.lit(0)) > 0, authors(people)).otherwise(authors(editors))


def plain_authors(people: Column) -> Column:
    """`Given Family` names joined by '; ', as an update by hand stores them; null if none has a name."""
    each = F.transform(people, lambda p: F.when(p["family"].isNotNull(), F.concat_ws(" ", p["given"], p["family"])).otherwise(p["literal"]))
    joined = F.array_join(F.filter(each, lambda a: a.isNotNull()), "; ")
    return F.when(joined != "", joined)


def author_list(names: Column) -> Column:
    """The names of a string joined by semicolons; null and blank strings have none."""
    return F.filter(F.transform(F.split(F.coalesce(names, F.lit("")), ";"), lambda n: F.trim(n)), lambda n: n != "")


def utc_time(text: Column) -> Column:
    """A time as ISO-8601 in UTC, of a timestamp or of a string with or without a zone."""
    return F.date_format(F.to_utc_timestamp(text.cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def tagged(fields: Column, source: Column) -> Column:
    """A map of strings with `_metadata_source` set; what stood there goes."""
    others = F.map_filter(fields, lambda k, _: k != "_metadata_source")
    return F.map_concat(others, F.create_map(F.lit("_metadata_source"), source))


def extraction_seconds(pages: Column, has_text: Column, base: int = 300, most: int = 7200) -> Column:
    """Seconds that a document's extraction may take: five a page where it has text, 45 where it has none, within bounds."""
    asked = F.when(has_text, F.greatest(F.lit(900), pages * 5)).otherwise(F.greatest(F.lit(1800), pages * 45))
    return F.least(F.greatest(F.lit(base), asked), F.lit(most))


def parse_filename(stem: Column) -> Column:
    """author, year and title of a file name without its ending, by four patterns in turn, else the name as the title."""
    none, part = F.lit(None).cast("string"), lambda p, i: F.regexp_extract(stem, p, i)
    dashed = r"^(.+?)\s*[-\x{2013}]\s*(\d{4})\s*[-\x{2013}]\s*(.+)$"
    underscored = r"^([A-Za-z][A-Za-z\s]*)_(\d{4})_(.+)$"
    joined = r"^([A-Z][a-z]+(?:\s+(?:et\s+al\.?|and|&)\s+[A-Z][a-z]+)*)(\d{4})(.*)$"
    untimed = r"^([A-Z][A-Za-z\s]*?)\s*[-\x{2013}]\s*(.+)$"
    cleaned = lambda a: F.trim(F.regexp_replace(a, r"(?i)\s+et\s+al\.?\s*$", ""))

    def found(who: Column, year: Column, title: Column) -> Column:
        return F.struct(F.when(who != "", who).alias("author"), year.cast("int").alias("year"), F.when(title != "", title).alias("title"))

    rest = F.trim(F.replace(F.regexp_replace(part(joined, 3), r"^[_\-\s]+", ""), F.lit("_"), F.lit(" ")))
    few = F.size(F.split(F.trim(part(untimed, 1)), r"\s+")) <= 4
    return (
        F.when(stem.rlike(dashed), found(cleaned(part(dashed, 1)), part(dashed, 2), F.trim(part(dashed, 3))))
        .when(stem.rlike(underscored), found(F.trim(part(underscored, 1)), part(underscored, 2), F.trim(F.replace(part(underscored, 3), F.lit("_"), F.lit(" ")))))
        .when(stem.rlike(joined), found(F.trim(part(joined, 1)), part(joined, 2), rest))
        .when(stem.rlike(untimed) & few, found(cleaned(part(untimed, 1)), none, F.trim(part(untimed, 2))))
        .otherwise(found(none, none, F.replace(stem, F.lit("_"), F.lit(" "))))
    )


def _first(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found)


def year_in(text: Column) -> Column:
    """The year of the first date in a text: ISO, month names, slashes, or bare."""
    return F.coalesce(
        _first(text, rf"\b{YEAR}-\d{{1,2}}(?:-\d{{1,2}})?\b"),
        _first(text, rf"(?i)\b{MONTHS}\s+\d{{1,2}}?,?\s*{YEAR}\b"),
        _first(text, rf"(?i)\b{MONTHS}\s+{YEAR}\b"),
        _first(text, rf"\b\d{{1,2}}/(?:\d{{1,2}}/)?{YEAR}\b"),
        _first(text, rf"\b{YEAR}\b"),
    )


def publication_year(text: Column) -> Column:
    """value, confidence, alternatives and reasoning of the year of publication, from the first 30 lines."""

    def candidates(line: Column, i: Column) -> Column:
        s = F.trim(line)
        labelled = lambda words: year_in(F.when(s.rlike(rf"(?i)(?:{words})[\s:]+(.+)"), F.regexp_extract(s, rf"(?i)(?:{words})[\s:]+(.+)", 1)))
        fall = F.greatest(F.lit(0.35), 0.55 - i * 0.03)
        rows = [
            (labelled("published|date|dated"), F.lit(0.9), "explicit label"),
            (labelled("received|accepted"), F.lit(0.85), "received/accepted date"),
            (_first(s, rf"[\x{{A9}}\x{{AE}}]\s*{YEAR}"), F.lit(0.85), "copyright symbol"),
            (_first(s, rf"(?i)copyright\s+{YEAR}"), F.lit(0.8), "copyright text"),
            (F.when(i < 15, _first(s, rf"\b{YEAR}-\d{{1,2}}(?:-\d{{1,2}})?\b")), F.when(i < 10, 0.7).otherwise(0.5), "ISO date"),
            (F.when(i < 10, _first(s, rf"(?<!\d){YEAR}(?!\d)")), fall, "standalone year"),
        ]
        made = [F.struct((-score).alias("order"), i.alias("line"), F.lit(p).alias("rule"), year.alias("year"), F.lit(why).alias("why")) for p, (year, score, why) in enumerate(rows)]
        return F.filter(F.array(*made), lambda c: c["year"].isNotNull() & c["year"].cast("int").between(FIRST_YEAR, LAST_YEAR))

    empty = F.trim(F.coalesce(text, F.lit(""))) == ""
    return let(F.array_sort(F.flatten(F.transform(F.slice(F.split(text, "\n", -1), 1, DATE_LINES), candidates))), lambda found: _dated(found, empty))


def _dated(found: Column, empty: Column) -> Column:
    best, second = F.get(found, F.lit(0)), F.get(found, F.lit(1))
    margin = second["order"] - best["order"]
    confidence = F.when(second.isNotNull(), -best["order"] * (0.8 + 0.2 * F.least(margin * 2, F.lit(1.0)))).otherwise(-best["order"] * 0.9)
    others = F.slice(F.array_except(F.array_distinct(F.transform(found, lambda c: c["year"])), F.array(best["year"])), 1, 3)
    return F.struct(
        best["year"].alias("value"),
        F.coalesce(F.bround(confidence, 2), F.lit(0.0)).alias("confidence"),
        F.coalesce(others, F.array().cast("array<string>")).alias("alternatives"),
        F.when(empty, "no text content").otherwise(F.coalesce(best["why"], F.lit("no date patterns found"))).alias("reasoning"),
    )


def document_kind(text: Column) -> Column:
    """value and confidence of the kind of document, by signs in the first 3,000 characters; the highest score wins."""
    empty = F.trim(F.coalesce(text, F.lit(""))) == ""
    return let(F.lower(F.substring(text, 1, KIND_CHARS)), lambda head: _kind(head, empty))


def _kind(head: Column, empty: Column) -> Column:
    scored = []
    for kind in dict.fromkeys(k for _, k, _ in KINDS):
        mine = F.array(*[F.struct((-F.lit(w)).alias("order"), F.lit(i).alias("at"), head.rlike(f"(?im){p}").alias("hit")) for i, (p, k, w) in enumerate(KINDS) if k == kind])
        scored.append(let(F.array_sort(F.filter(mine, lambda m: m["hit"])), _scorer(kind)))
    return let(F.array_sort(F.filter(F.array(*scored), lambda s: s["order"].isNotNull())), lambda kinds: _best_kind(F.get(kinds, F.lit(0)), empty))


def _scorer(kind: str) -> Callable[[Column], Column]:
    def scored(hits: Column) -> Column:
        top, total = -F.get(hits, F.lit(0))["order"], F.aggregate(hits, F.lit(0.0), lambda s, m: s - m["order"])
        score = F.when(F.size(hits) > 1, F.least(F.lit(0.95), top + 0.2 * (total - top))).otherwise(top)
        return F.struct((-score).alias("order"), (-top).alias("top"), F.get(hits, F.lit(0))["at"].alias("at"), F.lit(kind).alias("kind"))

    return scored


def _best_kind(best: Column, empty: Column) -> Column:
    confidence = F.coalesce(F.bround(-best["order"], 2), F.lit(DEFAULT_KIND_CONFIDENCE))
    return F.struct(F.coalesce(best["kind"], F.lit(DEFAULT_KIND)).alias("value"), F.when(empty, DEFAULT_KIND_CONFIDENCE / 2).otherwise(confidence).alias("confidence"))


def review_reasons(title: Column, people: Column, date: Column, kind: Column, threshold: float = 0.7) -> Column:
    """Why a record should be looked at: title, date and kind have value and confidence, people is an array of such. Empty if it need not.

    Confidences are shown with two digits, ties rounded up.
    """
    low = lambda field, name: F.when(field["value"].isNull(), F.lit(f"{name} could not be extracted")).when(field["confidence"] < threshold, F.format_string(f"{name} confidence %.2f below threshold {threshold:.2f}", field["confidence"]))
    none = F.coalesce(F.size(people), F.lit(0)) <= 0
    mean = F.round(F.aggregate(people, F.lit(0.0), lambda total, p: total + p["confidence"]) / F.size(people), 6)
    all_low = F.forall(people, lambda p: p["confidence"] < threshold)
    by = F.when(none, "no authors could be extracted").when(all_low, F.format_string(f"authors average confidence %.2f below threshold {threshold:.2f}", mean))
    of_kind = F.when(kind["confidence"] < threshold * 0.7, F.format_string("document type confidence %.2f is low", kind["confidence"]))
    return F.filter(F.array(low(title, "title"), by, low(date, "date"), of_kind), lambda x: x.isNotNull())


def overall_confidence(title: Column, people: Column, date: Column, kind: Column) -> Column:
    """The lowest confidence of all fields, rounded to two digits."""
    fields = F.least(title["confidence"], date["confidence"], kind["confidence"])
    return F.bround(F.least(fields, F.array_min(F.transform(people, lambda p: p["confidence"]))), 2)


def wants_second_opinion(title: Column, people: Column, date: Column, threshold: float = 0.7) -> Column:
    """Whether title, date or all authors fall short of the threshold; no authors fall short too."""
    return (title["confidence"] < threshold) | (date["confidence"] < threshold) | F.forall(people, lambda p: p["confidence"] < threshold) | people.isNull()


def merged(field: Column, other: Column, by: str = "llm") -> Column:
    """A second extractor's value where it has one, with the confidence and alternatives of the first; else the field as it is."""
    said = F.format_string("LLM extraction (heuristic: %s)", F.coalesce(field["value"], F.lit("None")))
    has = F.coalesce(other, F.lit("")) != ""
    pick = lambda new, name: F.when(has, new).otherwise(field[name]).alias(name)
    return F.struct(pick(other, "value"), field["confidence"].alias("confidence"), F.when(has, by).otherwise("heuristic").alias("source"), field["alternatives"].alias("alternatives"), pick(said, "reasoning"))


def merged_people(people: Column, others: Column, by: str = "llm") -> Column:
    """A second extractor's names where it has any, each with the mean confidence of the first's (0.3 if it found none)."""
    mean = F.when(F.coalesce(F.size(people), F.lit(0)) > 0, F.aggregate(people, F.lit(0.0), lambda total, p: total + p["confidence"]) / F.size(people)).otherwise(0.3)
    named = F.filter(others, lambda n: F.coalesce(n, F.lit("")) != "")
    made = F.transform(named, lambda n: F.struct(n.alias("value"), mean.alias("confidence"), F.lit(by).alias("source")))
    mine = F.transform(people, lambda p: F.struct(p["value"].alias("value"), p["confidence"].alias("confidence"), F.lit("heuristic").alias("source")))
    return F.when(F.coalesce(F.size(named), F.lit(0)) > 0, made).otherwise(mine)


def csl_issues(record: Column) -> Column:
    """What is wrong with a CSL-JSON string: messages that start with `error: ` or `warning: `; empty if nothing is.

    Errors are a string that is no JSON object, a missing or unknown type, and fields of a wrong kind; a missing id, fields
    that the schema does not know, and missing recommended ones are warnings, which are not looked for where there is an error.
    """
    return F.when(record.isNull(), F.array(F.lit("error: no record"))).otherwise(let(F.try_parse_json(record), _csl_issues))


def _csl_issues(v: Column) -> Column:
    kind_of = lambda path: F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, path, "variant")), "^[A-Z]+", 0)
    has = lambda name: F.try_variant_get(v, f"$['{name}']", "variant").isNotNull()
    item = F.try_variant_get(v, "$.type", "string")
    fatal = [
        F.when(~has("type"), "error: missing required field: type"),
        F.when(has("type") & (kind_of("$.type") != "STRING"), "error: type is no string"),
        F.when((kind_of("$.type") == "STRING") & ~item.isin(CSL_TYPES), F.concat(F.lit("error: invalid item type: "), item)),
    ]
    for name in CSL_NAMES:
        fatal.append(F.when(has(name) & (kind_of(f"$['{name}']") != "ARRAY"), f"error: {name} is no array"))
    for name in CSL_DATES:
        fatal.append(F.when(has(name) & (kind_of(f"$['{name}']") != "OBJECT"), f"error: {name} is no object"))
    for name in CSL_STRINGS:
        fatal.append(F.when(has(name) & ~kind_of(f"$['{name}']").isin("STRING", "BIGINT", "DECIMAL"), f"error: {name} is no string"))
    known = ["type", "id", *CSL_NAMES, *CSL_DATES, *CSL_STRINGS]
    extra = F.filter(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), lambda k: ~k.isin(known) & ~k.isin(CSL_OTHERS))
    lenient = [
        F.when(~has("id"), "warning: 'id' is a required property"),
        F.when(F.size(extra) > 0, F.concat(F.lit("warning: additional properties: "), F.array_join(F.array_sort(extra), ", "))),
        F.when(~has("title"), "warning: missing recommended field 'title'"),
        F.when(~has("author") & ~has("editor"), "warning: missing author or editor"),
        F.when(~has("issued"), "warning: missing publication date (issued)"),
    ]
    there = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    no_object = v.isNull() | ~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return F.when(no_object, F.array(F.lit("error: no JSON object"))).otherwise(let(there(fatal), lambda errors: F.when(F.size(errors) > 0, errors).otherwise(there(lenient))))


def is_fatal(issues: Column) -> Column:
    return F.exists(issues, lambda i: i.startswith("error: "))


def valid_citekey(key: Column) -> Column:
    """Letters, digits, underscores and hyphens only, one at least."""
    return F.coalesce(key.rlike(r"(?U)^[\w-]+$"), F.lit(False))


_NAMES = "array<struct<family:string,given:string,literal:string,`non-dropping-particle`:string>>"
_PROCESSED = f"struct<title:string,author:{_NAMES},editor:{_NAMES},issued:struct<`date-parts`:array<array<string>>>>"


def processed(record: Column, given_key: Column) -> Column:
    """A CSL-JSON string's indexed fields: error (null if it is sound), citekey, title, authors, issued_date, issued_year, warnings.

    The key is the given one, which must be valid, else it is made of author, year and title.
    """
    return let(F.struct(F.from_json(record, _PROCESSED).alias("r"), csl_issues(record).alias("issues")), lambda both: _processed(record, both["r"], both["issues"], given_key))


def _processed(record: Column, r: Column, issues: Column, given_key: Column) -> Column:
    parts = F.get(r["issued"]["date-parts"], F.lit(0))
    part = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    first = F.get(F.when(F.coalesce(F.size(r["author"]), F.lit(0)) > 0, r["author"]).otherwise(r["editor"]), F.lit(0))
    key = F.coalesce(given_key, citekey(F.coalesce(first["family"], first["literal"]), part(0), r["title"], record))
    error = F.when(is_fatal(issues), F.concat(F.lit("invalid CSL-JSON: "), F.array_join(issues, "; "))).when(given_key.isNotNull() & ~valid_citekey(given_key), F.concat(F.lit("invalid citekey format: "), given_key))
    ok = lambda c: F.when(error.isNull(), c)
    return F.struct(
        error.alias("error"),
        ok(key).alias("citekey"),
        ok(r["title"]).alias("title"),
        ok(contributors(r["author"], r["editor"])).alias("authors"),
        ok(partial_date(part(0), part(1), part(2))).alias("issued_date"),
        ok(part(0)).alias("issued_year"),
        F.when(error.isNull(), issues).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


def edit_errors(status: Column, new_key: Column, old_key: Column, record: Column, taken: Column) -> Column:
    """What is wrong with a record that was edited by hand: its state, a key that another has (`taken`), its CSL-JSON."""
    from lexmill.operators.catalog import STATUSES

    own = F.array(
        F.when(status.isNull(), "missing required field: status").when(~status.isin(list(STATUSES)), F.format_string("invalid status '%s'", status)),
        F.when(new_key.isNotNull() & ~new_key.eqNullSafe(old_key) & F.coalesce(taken, F.lit(False)), F.format_string("citekey '%s' already exists", new_key)),
    )
    of_record = F.when(record.isNotNull(), F.transform(F.filter(csl_issues(record), lambda i: i.startswith("error: ")), lambda i: F.concat(F.lit("CSL-JSON: "), F.substr(i, F.lit(8)))))
    return F.concat(F.filter(own, lambda x: x.isNotNull()), F.coalesce(of_record, F.array().cast("array<string>")))


def with_error_comments(text: Column, errors: Column) -> Column:
    """An edited text with its errors before it as comment lines; `without_comments` takes them away."""
    head = F.concat(F.lit("// Errors, to be mended:\n"), F.array_join(F.transform(errors, lambda e: F.concat(F.lit("//   - "), e, F.lit("\n"))), ""), F.lit("//\n\n"))
    return F.when(F.size(errors) > 0, F.concat(head, text)).otherwise(text)


def without_comments(text: Column) -> Column:
    """An edited text without its comment lines, trimmed; null if nothing is left."""
    kept = F.trim(F.regexp_replace(F.array_join(F.filter(F.split(text, "\n", -1), lambda line: ~F.trim(line).startswith("//")), "\n"), r"^\s+|\s+$", ""))
    return F.when(kept != "", kept)


def offers_new_key(old: Column, new: Column, old_key: Column, new_key: Column) -> Column:
    """Whether title, author or date of a CSL-JSON string changed while the key did not."""
    changed = F.lit(False)
    for field in ("title", "author", "issued"):
        changed = changed | ~F.get_json_object(old, f"$.{field}").eqNullSafe(F.get_json_object(new, f"$.{field}"))
    return F.coalesce(old.isNotNull() & new.isNotNull() & old_key.eqNullSafe(new_key) & changed, F.lit(False))


def updated_by_hand(record: Column) -> Column:
    """The indexed fields of a record given by hand: title, authors as `Given Family`, the year as the date, and issued_year.

    A title of another kind is stored as its JSON, and authors of another kind as none, as this path checks nothing.
    """
    r = F.from_json(record, _PROCESSED)
    year = F.get(F.get(r["issued"]["date-parts"], F.lit(0)), F.lit(0))
    return F.struct(r["title"].alias("title"), plain_authors(r["author"]).alias("authors"), year.alias("issued_date"), csl_year(record).alias("issued_year"))


def needs_review(title: Column, authors_: Column, date: Column, kind: Column, threshold: float = 0.7) -> Column:
    """Names of the fields whose confidence is below the threshold; the kind's threshold is 0.7 of it."""
    checks = (("title", title, threshold), ("authors", authors_, threshold), ("date", date, threshold), ("type", kind, 0.7 * threshold))
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(0.0)) < t, F.lit(name)) for name, c, t in checks]), lambda x: x.isNotNull())


def upgrade(source: Column, old_key: Column, new_key: Column, useful: Column | None = None) -> Column:
    """What extraction may do with metadata: keep what is given (or where nothing useful was found), upgrade file-name guesses, ask where the key would change."""
    useful = F.lit(True) if useful is None else useful
    return F.when(source.isin("EXPLICIT", "ZOTERO") | ~useful, "keep").when(old_key.isNull() | (old_key == new_key), "upgrade").otherwise("review")


def upgraded(rows: DataFrame) -> DataFrame:
    """Apply `upgrade` to documents with source, citekey, new_key, new_title, new_authors, new_date, new_year, useful and reasons.

    An upgrade takes the new fields, and asks for review where there are reasons; where the key would change the old fields
    stay, and the state says why.
    """
    rows = rows.withColumn("action", upgrade(F.col("source"), F.col("citekey"), F.col("new_key"), F.col("useful")))
    take = F.col("action") == "upgrade"
    why = F.format_string("Text extraction suggests different metadata (citekey would change from @%s to @%s).", "citekey", "new_key")
    return rows.withColumns(
        {
            "title": F.when(take, F.coalesce("new_title", "title")).otherwise(F.col("title")),
            "authors": F.when(take, F.coalesce("new_authors", "authors")).otherwise(F.col("authors")),
            "issued_date": F.when(take, F.coalesce("new_date", "issued_date")).otherwise(F.col("issued_date")),
            "issued_year": F.when(take, F.coalesce("new_year", "issued_year")).otherwise(F.col("issued_year")),
            "error_message": F.when(F.col("action") == "review", why).when(take & (F.size("reasons") > 0), F.array_join("reasons", "; ")).otherwise(F.col("error_message")),
            "status": F.when((F.col("action") == "review") | take & (F.size("reasons") > 0), "needs_review").otherwise(F.col("status")),
            "citekey": F.when(take, F.coalesce("citekey", "new_key")).otherwise(F.col("citekey")),
            "source": F.when(take, "TEXT_EXTRACTED").otherwise(F.col("source")),
        }
    )
