"""Full-text search: tokens, query clean-up and the parts of BM25; `search_index` stores and searches an index."""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Lower bound of a phrase's inverse document frequency.
LEAST_IDF = 1e-6


def _plain(point: int) -> str:
    """The base letter of a Latin letter with diacritics, else ''."""
    parts = unicodedata.normalize("NFD", chr(point))
    return parts[0] if len(parts) > 1 and all(unicodedata.combining(c) for c in parts[1:]) else ""


_ACCENTED = [p for p in range(0xC0, 0x250) if _plain(p) and chr(p) == chr(p).lower()]
FOLD_FROM = "".join(map(chr, _ACCENTED))
FOLD_TO = "".join(map(_plain, _ACCENTED))
_FOLDS = {p: _plain(p) for p in _ACCENTED}

# Words that a query drops outside of quotes.
STOP_WORDS = """
a an and are as at be been but by can do does for from had has have he her his how i if in into is it its may me my no
not of on or our she so than that the their them then there these they this to us was we what when where which while
who why will with would you your
""".split()
# Characters that a query may not hold; each becomes a space.
DROPPED = "?!.,;:[]{}()^~\\'-+"


class QueryError(ValueError):
    """A query that can't be searched for."""


@dataclass(frozen=True)
class Operand:
    """One operand of a disjunction: a phrase of one or more terms; with `prefix`, the last term may go on."""

    terms: tuple[str, ...]
    prefix: bool = False


def fold(text: Column) -> Column:
    """Lower case without Latin diacritics."""
    return F.translate(F.lower(text), FOLD_FROM, FOLD_TO)


def tokens(text: Column) -> Column:
    """Array of terms: maximal runs of letters, digits and private-use characters. Null counts as empty."""
    return _cut(fold(F.coalesce(text, F.lit(""))))


def unfolded(text: Column) -> Column:
    """`tokens` that keep their diacritics: with `folded` for each, the same, as folding turns letters into letters."""
    return _cut(F.lower(F.coalesce(text, F.lit(""))))


def unfolded_text(text: Column) -> Column:
    """`unfolded` as one text, with a space between two."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _BETWEEN, " "))


_BETWEEN = r"[^\p{L}\p{N}\p{Co}]+"


def _cut(text: Column) -> Column:
    return F.array_remove(F.split(text, _BETWEEN), "")


def folded(token: str) -> str:
    return token if token.isascii() else token.translate(_FOLDS)


def all_folded(found: list[str]) -> list[str]:
    """`folded` for each token, at once."""
    return " ".join(found).translate(_FOLDS).split(" ") if found else []


def sanitize(query: str) -> list[str]:
    """The operands of a raw query: quoted phrases, in quotes, and words that are no stop words.

    Raises QueryError if nothing is left.
    """
    text = query.translate({ord(c): " " for c in DROPPED})
    if text.count('"') % 2:
        text = text.replace('"', " ")
    found: list[str] = []
    for i, part in enumerate(text.split('"')):
        found += [f'"{part}"'] if i % 2 else [w for w in part.split() if w.lower() not in STOP_WORDS]
    if not found:
        raise QueryError("nothing is left of the query")
    return found


def sanitize_column(query: Column) -> Column:
    """`sanitize` for a column of queries, as the operands joined by OR; null where nothing is left."""
    text = F.translate(query, DROPPED, " " * len(DROPPED))
    odd = (F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))) % 2 == 1
    text = F.when(odd, F.replace(text, F.lit('"'), F.lit(" "))).otherwise(text)
    words = lambda part: F.filter(F.split(F.trim(part), r"\s+"), lambda w: (w != "") & ~F.lower(w).isin(STOP_WORDS))
    parts = F.transform(F.split(text, '"', -1), lambda p, i: F.when(i % 2 == 1, F.array(F.concat(F.lit('"'), p, F.lit('"')))).otherwise(words(p)))
    joined = F.array_join(F.flatten(parts), " OR ")
    return F.when(joined != "", joined)


def operands(parts: list[str]) -> list[Operand]:
    """Phrases of sanitised parts. Raises QueryError on characters that no term can hold."""
    found = []
    for part in parts:
        quoted = part.startswith('"')
        body = part.strip('"')
        prefix = not quoted and body.endswith("*")
        body = body.rstrip("*") if prefix else body
        if not quoted and re.search(r"[/@#$%&=<>|]", body) or prefix and not body:
            raise QueryError(f"can't search for {part}")
        terms = tuple(t for t in re.split(r"[^\w]|_", folded(body.lower())) if t)
        found.append(Operand(terms, prefix))
    return found


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index: term, id, tf and positions (from 0). A document's occurrences are joined before the shuffle."""
    spread = docs.select(id_col, F.posexplode(tokens(F.col(text_col))).alias("position", "term"))
    return spread.groupBy("term", id_col).agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"))


def document_frequency(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term, df (documents that hold it) and cf (occurrences). Every task sums up its terms before the shuffle."""
    cut = docs.select(tokens(F.col(text_col)).alias("tokens"))
    # all tokens, then the distinct ones
    spread = cut.select(F.size("tokens").alias("n"), F.posexplode(F.concat("tokens", F.array_distinct("tokens"))).alias("at", "term"))
    count = lambda test: F.sum(F.when(test, 1).otherwise(0))
    return spread.groupBy("term").agg(count(F.col("at") >= F.col("n")).alias("df"), count(F.col("at") < F.col("n")).alias("cf"))


def impact(tf: Column, length: Column, mean: Column) -> Column:
    """What an occurrence count adds to a score, but for the weight of its phrase; of columns or of arrays."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def idf(documents: int, df: int) -> float:
    return max(math.log((documents - df + 0.5) / (df + 0.5)), LEAST_IDF)
