"""Cutting markdown into sections and chunks, and embedding them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 1500, 200
SEPARATORS = ("\n\n", "\n", ". ", " ")
_HEADING = re.compile(r"(#{1,4})\s+(.*\S)\s*$")


def sections(text: str) -> Iterator[tuple[str, str]]:
    """(path, body) of every section with text; the path is `H1 > H2 > H3 > H4`, empty levels left out."""
    path, body, fenced = ["", "", "", ""], [], False
    for line in text.split("\n"):
        fenced ^= line.lstrip().startswith(("```", "~~~"))
        found = None if fenced else _HEADING.match(line)
        if found:
            if "".join(body).strip():
                yield " > ".join(filter(None, path)), "\n".join(body).strip()
            level = len(found[1])
            path[level - 1 :] = [found[2], *[""] * (4 - level)]
            body = []
        body.append(line)
    if "".join(body).strip():
        yield " > ".join(filter(None, path)), "\n".join(body).strip()


def _parts(text: str, size: int, separators: tuple[str, ...]) -> list[str]:
    """Pieces of at most `size` characters, cut at the coarsest separator that does it."""
    if len(text) <= size:
        return [text]
    for at, separator in enumerate(separators, 1):
        if separator in text:
            *cut, last = text.split(separator)
            found: list[str] = []
            for part in [part + separator for part in cut] + [last]:
                if len(part) <= size:
                    found.append(part)
                else:
                    found += _parts(part, size, separators[at:])
            return found
    return [text[i : i + size] for i in range(0, len(text), size)]


def split(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Chunks of at most `size` characters; each begins with up to `overlap` characters of whole pieces before it."""
    chunks, parts = [], _parts(text, size, SEPARATORS)
    first = total = 0  # the chunk holds the parts from `first` on, of so many characters
    for at, part in enumerate(parts):
        n = len(part)
        if first < at and total + n > size:
            chunks.append("".join(parts[first:at]).strip())
            while first < at and (total > overlap or total + n > size):
                total -= len(parts[first])
                first += 1
        total += n
    chunks.append("".join(parts[first:]).strip())
    return [c for c in chunks if c]


def chunk(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """chunk_id, id, chunk_index, section and text. Blank and null texts have no chunks. The id is a hash of both keys."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pieces = [(path, piece) for path, body in sections(text or "") for piece in split(body, size, overlap)]
                rows += [(key, i, path, piece) for i, (path, piece) in enumerate(pieces)]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["key", "chunk_index", "section", "text"])

    cut = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text")).mapInArrow(task, "key string, chunk_index long, section string, text string")
    identity = F.sha2(F.concat_ws("|", "key", F.col("chunk_index").cast("string")), 256)
    return cut.select(identity.alias("chunk_id"), F.col("key").cast(docs.schema[id_col].dataType).alias(id_col), "chunk_index", "section", "text")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("long")


def hashed_vector(text: str, dim: int) -> list[float]:
    """The default embedder: signed feature hashing of words, of length 1. A learned model may take its place."""
    out = np.zeros(dim, np.float64)
    for word in text.lower().split():
        h = xxhash.xxh3_64_intdigest(word)
        out[h % dim] += 1 if h >> 63 else -1
    return (out / (np.linalg.norm(out) or 1)).astype(np.float32).tolist()


#: Texts that a model gets at a time.
MODEL_BATCH = 32


def embed(rows: DataFrame, text_col: str = "text", dim: int = 768, prefix: str = "search_document: ", embedder: Callable[[str, int], list[float]] = hashed_vector, out: str = "embedding", errors: str | None = None) -> DataFrame:
    """`rows` with a vector of every text; null texts get null.

    An embedder with a method `many` (texts, dim) is asked for MODEL_BATCH texts at a time. With `errors`, a column of that
    name tells what an embedder raised on a text, whose vector is null then; without, the query fails.
    """
    kind = pa.struct([("vector", pa.list_(pa.float32())), ("error", pa.string())])

    def vectors(texts: list[str]) -> list[dict]:
        try:
            return [{"vector": v, "error": None} for v in (embedder.many(texts, dim) if hasattr(embedder, "many") else [embedder(t, dim) for t in texts])]
        except Exception as why:  # noqa: BLE001  whatever a model raises belongs to its texts
            if errors is None:
                raise
            return vectors(texts[:1]) + vectors(texts[1:]) if len(texts) > 1 else [{"vector": None, "error": f"{type(why).__name__}: {why}"}]

    def task(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            known = [prefix + t for t in batch.drop_null().to_pylist()]
            made = iter([v for i in range(0, len(known), MODEL_BATCH) for v in vectors(known[i : i + MODEL_BATCH])])
            yield pa.array([{"vector": None, "error": None} if t is None else next(made) for t in batch.to_pylist()], kind)

    task.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    found = rows.withColumn(out, F.arrow_udf(task, "struct<vector:array<float>,error:string>")(F.col(text_col)))
    if errors is not None:
        found = found.withColumn(errors, F.col(out)["error"])
    return found.withColumn(out, F.col(out)["vector"])


def checked_dimension(vector: Column, dim: int) -> Column:
    """The vector, if it has `dim` components; else the query fails."""
    return F.when(F.assert_true(F.size(vector) == dim).isNull(), vector)
