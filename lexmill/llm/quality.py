"""Quality classifier by naive Bayes support vectors.

The features of a text are indicators of n-grams: hashed words and word pairs, and runs of up to four character classes
(so `THE!!`, `of%%%` or `a | b` look alike in any language), and, in steps, the shares of words that repeat their
predecessor and of words seen before. Each indicator is scaled by the log ratio of its smoothed counts in the two
classes, a linear model with hinge loss is fitted by dual coordinate descent, and a logistic curve over cross-fitted
margins turns margins into probabilities.

The fit uses at most SAMPLE labelled documents (the first by a hash of their ids), in one task; the scoring is a narrow
map over all documents.

Defined results: a null text counts as empty, which has no features and the score of the bare intercept; labels with a
null id or label are ignored, repeated ones count as the lowest, and of documents that repeat an id the smallest text
is learned from; without labels every score is 0.5, with one class alone
it is that class's smoothed share; `classify` keeps every row and column of its input, repeated rows too, and refuses
only a column that has the name it adds, by a ClashingColumn error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.expressions import refuse_columns
from lexmill.llm import memory
from lexmill.llm.words import lowered, word_codes

#: Labelled documents that the classifier is fitted on, at most.
SAMPLE = 8192
BITS = 18
#: A feature in fewer of the sampled documents than this has no weight.
LEAST = 3
COST = 1.0
EPOCHS = 10

_CLASS = bytes(ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else ord("a") if b >= 128 or 97 <= b <= 122 else 32 if b <= 32 else b for b in range(256))


def _bucket(codes: np.ndarray, salt: int) -> np.ndarray:
    mixed = (codes.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str | None) -> np.ndarray:
    """Distinct buckets of a text's n-grams, ascending."""
    codes = word_codes(lowered(text))
    if not len(codes):
        return np.empty(0, np.int64)
    pairs = (codes[:-1] << np.uint64(31)) ^ codes[1:]
    classes = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(_CLASS), np.uint8)
    classes = classes[np.concatenate(([True], classes[1:] != classes[:-1]))].astype(np.uint64)
    runs = [_bucket(classes, 3)]
    window = classes
    for k in range(1, 4):
        window = (window[:-1] << np.uint64(8)) | classes[k:]
        runs.append(_bucket(window, 3 + k))
    repeated = int(16 * np.mean(codes[:-1] == codes[1:])) if len(codes) > 1 else 0
    known = int(16 * (1 - len(np.unique(codes)) / len(codes)))
    steps = np.concatenate((np.arange(repeated + 1), 100 + np.arange(known + 1)))
    seen = np.zeros(1 << BITS, bool)
    for found in (_bucket(codes, 1), _bucket(pairs, 2), _bucket(steps, 9), *runs):
        seen[found] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    weights: np.ndarray  # of each bucket, with the count ratio in it
    ratios: np.ndarray  # log-count ratios; they scale a text's length to 1
    bias: float
    slope: float
    intercept: float

    def margin(self, found: np.ndarray) -> float:
        length = float(np.sqrt((self.ratios[found] ** 2).sum()))
        return (float(self.weights[found].sum()) / length if length else 0.0) + self.bias

    def score(self, text: str | None) -> float:
        at = self.slope * self.margin(features(text)) + self.intercept
        return float(1 / (1 + np.exp(-np.clip(at, -30, 30))))


def _descend(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Log-count ratios, then dual coordinate descent for hinge loss: weights (with the ratios in them), ratios, bias."""
    size = 1 << BITS
    counts = [np.bincount(np.concatenate([r for r, k in zip(rows, y, strict=True) if k == s] or [np.empty(0, np.int64)]), minlength=size) for s in (1, -1)]
    ratios = np.log((counts[0] + 1) / ((y == 1).sum() + 2)) - np.log((counts[1] + 1) / ((y == -1).sum() + 2))
    ratios[counts[0] + counts[1] < LEAST] = 0
    rows = [r[ratios[r] != 0] for r in rows]
    values = [ratios[r] for r in rows]
    values = [v / (np.sqrt((v * v).sum()) or 1) for v in values]
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    norms = np.array([float((v * v).sum()) + 1 for v in values])  # the bias is a feature that is always 1
    # the rarer class weighs as much as the other
    most = COST * len(y) / (2 * np.where(y == 1, (y == 1).sum(), (y == -1).sum()))
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            gradient = y[i] * (float(w[rows[i]] @ values[i]) + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return w * ratios, ratios, bias


def _logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the probability of y = 1 over margins, by damped Newton steps on smoothed targets."""
    up, down = (y == 1).sum(), (y == -1).sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x, theta = np.stack((margins, np.ones_like(margins)), axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        theta = theta - np.linalg.solve(hessian, x.T @ (p - target) + 1e-4 * (theta - [1, 0]))
    return float(theta[0]), float(theta[1])


def fit_rows(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """Fit on feature rows and labels 0 or 1."""
    zero = np.zeros(1 << BITS)
    y = np.where(labels == 1, 1, -1)
    if not len(y) or abs(y.sum()) == len(y):
        share = ((y == 1).sum() + 1) / (len(y) + 2)
        return Model(zero, zero, 0.0, 0.0, float(np.log(share / (1 - share))))
    fold, margins = np.arange(len(y)) % 3, np.zeros(len(y))
    for k in range(3):
        mine = [i for i in range(len(y)) if fold[i] != k]
        if abs(y[mine].sum()) < len(mine):
            part = Model(*_descend([rows[i] for i in mine], y[mine]), 1.0, 0.0)
            margins[fold == k] = [part.margin(rows[i]) for i in np.flatnonzero(fold == k)]
    return Model(*_descend(rows, y), *_logistic(margins, y))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on the labelled documents; `labels` has an id and a label."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter("id is not null and label is not null")
    known = known.groupBy("id").agg(F.min((F.col("label") >= 1).cast("int")).alias("label"))
    known = known.orderBy(F.xxhash64(F.col("id").cast("string"), F.lit("quality")), "id").limit(SAMPLE)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(known), "id").groupBy("id").agg(F.min("label").alias("label"), F.min("text").alias("text"))  # at most SAMPLE rows

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.release()
        for batch in batches:
            found = [features(t).astype("<i4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1).cast(pa.int32()), pa.array(found, pa.binary())], names=["id", "label", "found"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["id"], r["label"], r["found"]) for b in batches for r in b.to_pylist())
        model = fit_rows([np.frombuffer(r[2], "<i4").astype(np.int64) for r in rows], np.array([r[1] for r in rows], int))
        yield pa.RecordBatch.from_pylist([{"weights": model.weights.astype("<f4").tobytes(), "ratios": model.ratios.astype("<f4").tobytes(), "rest": [model.bias, model.slope, model.intercept]}], schema=pa.schema([("weights", pa.binary()), ("ratios", pa.binary()), ("rest", pa.list_(pa.float64()))]))

    rows = sample.mapInArrow(extract, "id string, label int, found binary").repartition(1)
    made = rows.mapInArrow(train, "weights binary, ratios binary, rest array<double>").collect()
    if not made:
        return fit_rows([], np.empty(0, int))
    return Model(np.frombuffer(made[0]["weights"], "<f4"), np.frombuffer(made[0]["ratios"], "<f4"), *made[0]["rest"])


def classify(docs: DataFrame, model: Model, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """`docs` with the probability of label 1."""
    refuse_columns(docs, out)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 8 bytes x 2**BITS

    def task(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory.release()
        for batch in texts:
            yield pa.array([shared.value.score(t) for t in batch.to_pylist()], pa.float64())

    task.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(out, F.arrow_udf(task, "double")(F.col(text_col)))


def learned_from(id_col: str = "doc_id", rest: int = 2) -> Column:
    """Whether a label may be learned from: crc32 of its id as text, modulo 4, is not `rest`."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != rest, F.lit(False))
