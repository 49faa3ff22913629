"""Language ID by multilingual mixture inference.

`fit` counts hashed letter trigrams of each language over a bounded sample of labelled documents. `classify` sees every
document as a mixture of the languages: expectation-maximisation estimates the proportions from the trigrams'
likelihoods, until no share moves. A set of languages is selected for every document: the likeliest single one, and as
long as the penalised likelihood rises, the one that raises it most. The predicted language is the strongest of that
set; the score is its share in the likeliest mixture of the set.

Defined results: a null text, or one without a letter, is `und` with score 0 and no languages; so is every text if the
model has learned no language; languages fit a text unless equally likely trigrams explain it better, by more than
UNFIT; whole texts are used, however long; equal shares go to the language that sorts first;
documents with a null language or a null id aren't learned from; `classify` keeps every row and column of its input,
repeated rows too, and refuses only a column that has the name it adds, by a ClashingColumn error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.expressions import refuse_columns
from lexmill.llm import memory

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
#: Documents that each language is learned from, about (a share of the labelled ones, chosen by a hash of their ids).
PER_LANGUAGE = 2000
SMOOTHING = 0.1
#: Price in log-likelihood of each further language, times the logarithm of the number of trigrams.
PENALTY = 2.0
#: Log-likelihood by which equally likely trigrams must explain a text better before its languages don't fit.
UNFIT = PENALTY * float(np.log(BUCKETS))
#: A mixture is found when ROUND steps of EM move no share by this.
TOLERANCE, ROUND = 1e-4, 10
UNDETERMINED = "und"

_LETTER = re.compile(r"[^\W\d_]")
_SPACES = np.array([not chr(b).isalpha() for b in range(128)])
RESULT = "lang string, score double, languages array<string>, shares array<double>, fits boolean"
_ARROW = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string())), ("shares", pa.list_(pa.float64())), ("fits", pa.bool_())])


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # bucket x language


def trigrams(text: str) -> np.ndarray:
    """Hashed trigrams of the lower-cased letters; all else is one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    points = np.where(_SPACES[np.minimum(points, 127)] & (points < 128), np.uint32(32), points)
    gap = points == 32
    points = points[~(gap & np.concatenate(([True], gap[:-1])))]
    points = np.concatenate(([np.uint32(32)], points, [np.uint32(32)])).astype(np.uint32)
    mixed = points[:-2] * np.uint32(0x9E3779B1) + points[1:-1] * np.uint32(0x85EBCA77) + points[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x27D4EB2F)
    return (mixed >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from rows with an id, a text and a language. Only counts by language and bucket leave the executors."""
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("id is not null and lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, PER_LANGUAGE / n))])
    place = F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 30)) / (1 << 30)
    sample = rows.filter(place < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.release()
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in found:
                    found[lang] = np.zeros(BUCKETS, np.int64)
                found[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, n in found.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(n[used], pa.int64())], names=["lang", "bucket", "n"])

    counts = sample.select("text", "lang").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts")).toArrow().to_pylist()
    languages = sorted(r["lang"] for r in table)
    n = np.zeros((BUCKETS, len(languages)))
    for r in table:
        n[[c["bucket"] for c in r["counts"]], languages.index(r["lang"])] = [c["n"] for c in r["counts"]]
    n += SMOOTHING
    return Model(languages, np.log(n / n.sum(axis=0)).astype(np.float32))


def _em(pi: np.ndarray, p: np.ndarray, n: np.ndarray, doc: np.ndarray, starts: np.ndarray, total: np.ndarray, steps: int) -> np.ndarray:
    for _ in range(steps):
        part = p * pi[doc]
        part *= (n / part.sum(axis=1))[:, None]
        pi = np.add.reduceat(part, starts) / total[:, None]
    return pi


def _likelihood(pi: np.ndarray, p: np.ndarray, n: np.ndarray, doc: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(n * np.log((p * pi[doc]).sum(axis=1)), starts)


def infer(model: Model, texts: list[str | None]) -> list[dict]:
    """The mixture of every text."""
    out = [{"lang": UNDETERMINED, "score": 0.0, "languages": [], "shares": [], "fits": False} for _ in texts]
    places = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if model.languages else []
    for i in range(0, len(places), 64):
        _infer(model, texts, places[i : i + 64], out)
    return out


def _mixtures(pi: np.ndarray, which: np.ndarray, p: np.ndarray, n: np.ndarray, starts: np.ndarray, sizes: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Likeliest mixtures of the documents `which`, from their proportions `pi`, and the log-likelihoods; a share of 0 stays 0."""
    pi, value, left = pi.copy(), np.empty(len(which)), np.arange(len(which))
    while len(left):
        some = which[left]
        doc = np.repeat(np.arange(len(some)), sizes[some])
        begin = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
        at = np.arange(len(doc)) - begin[doc] + starts[some][doc]
        rest = (p[at], n[at], doc, begin)
        new = _em(pi[left], *rest, total[some], ROUND)
        value[left] = _likelihood(new, *rest)
        moved = np.abs(new - pi[left]).max(axis=1) >= TOLERANCE
        pi[left] = new
        left = left[moved]
    return pi, value


def _infer(model: Model, texts: list[str | None], places: list[int], out: list[dict]) -> None:
    used, counts = [], []
    for i in places:
        n = np.bincount(trigrams(texts[i]), minlength=BUCKETS)
        used.append(np.flatnonzero(n))
        counts.append(n[used[-1]])
    sizes = np.array([len(x) for x in used])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    n = np.concatenate(counts).astype(np.float64)
    log_p = model.log_p[np.concatenate(used)].astype(np.float64)
    p, total = np.exp(log_p), np.add.reduceat(n, starts)
    alone = np.add.reduceat(n[:, None] * log_p, starts)  # log-likelihood under each language
    pi = np.exp(5 * (alone - alone.max(axis=1, keepdims=True)) / total[:, None]) + 1e-3
    pi /= pi.sum(axis=1, keepdims=True)
    facts = (p, n, starts, sizes, total)
    pi, most = _mixtures(pi, np.arange(len(places)), *facts)

    price = PENALTY * np.log(total)
    chosen = np.arange(len(model.languages)) == alone.argmax(axis=1)[:, None]
    best, shares = alone.max(axis=1), chosen.astype(np.float64)
    # no set is likelier than the mixture of all languages: where that gains less than a further language costs, one is best
    open_ = np.flatnonzero(most - best > price)
    while len(open_):
        value, add, mix = np.full(len(open_), -np.inf), np.zeros(len(open_), int), shares[open_]
        for j in range(len(model.languages)):
            able = np.flatnonzero(~chosen[open_, j])
            if len(able):
                trial = chosen[open_[able]]
                trial[:, j] = True
                start = np.where(trial, np.maximum(pi[open_[able]], 1e-3), 0.0)
                found_mix, found = _mixtures(start / start.sum(axis=1, keepdims=True), open_[able], *facts)
                better = found > value[able]
                value[able[better]], add[able[better]], mix[able[better]] = found[better], j, found_mix[better]
        rises = value - best[open_] > price[open_]
        open_, add, value, mix = open_[rises], add[rises], value[rises], mix[rises]
        chosen[open_, add], best[open_], shares[open_] = True, value, mix

    fits = best + UNFIT >= -total * np.log(BUCKETS)
    for k, i in enumerate(places):
        which = [int(j) for j in np.argsort(-shares[k], kind="stable") if chosen[k, j]]
        out[i] = {"lang": model.languages[which[0]], "score": float(min(1.0, shares[k, which[0]])), "languages": [model.languages[j] for j in which], "shares": [float(shares[k, j]) for j in which], "fits": bool(fits[k])}


def classify(docs: DataFrame, model: Model, text_col: str = "text", out: str = "language") -> DataFrame:
    """`docs` with a struct column of lang, score, languages and their shares, and whether these fit."""
    refuse_columns(docs, out)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 bytes x BUCKETS x languages

    def task(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory.release()
        for batch in texts:
            yield pa.array(infer(shared.value, batch.to_pylist()), _ARROW)

    task.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    judge = F.arrow_udf(task, RESULT)
    return docs.withColumn(out, judge(F.col(text_col)))


def learned_from(id_col: str = "doc_id", rest: int = 1) -> Column:
    """Whether a document may be learned from: crc32 of its id as text, modulo 3, is not `rest`."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != rest, F.lit(False))
