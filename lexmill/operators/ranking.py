"""Ranked lists: fusion, caps per document, reranking and collapses."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators import fulltext, search_index, vector

RRF_K = 60
#: Candidates that each side of a hybrid search gives, as a multiple of k, and the weight of the full-text side.
POOL, FULLTEXT_WEIGHT = 3, 0.5
#: Candidates that reranking looks at, at least, and results of one document that it lets in.
LEAST_POOL, PER_DOCUMENT = 100, 3


def ranked(rows: DataFrame, score: Column, tie: str) -> DataFrame:
    """A list (already cut to a few rows) with its rank, from 1. Longer lists should be cut first."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(score, tie)).cast("long"))


def rrf(lists: list[tuple[DataFrame, str, float]], k: int, id_col: str = "doc_id") -> DataFrame:
    """Reciprocal-rank fusion of lists (rows of id and rank, method, weight): id, score, methods, rank.

    A row gets weight / (60 + rank) from every list it is in; ties keep the order of first sight, earlier lists first.
    """
    parts = None
    for i, (rows, method, weight) in enumerate(lists):
        part = rows.select(id_col, (weight / (RRF_K + F.col("rank"))).alias("part"), F.lit(method).alias("method"), F.struct(F.lit(i).alias("list"), "rank").alias("seen"))
        parts = part if parts is None else parts.unionByName(part)
    fused = parts.groupBy(id_col).agg(F.sum("part").alias("score"), F.array_sort(F.collect_set("method")).alias("methods"), F.min("seen").alias("seen"))
    best = fused.orderBy(F.desc("score"), "seen").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "seen")).cast("long")).drop("seen")


def by_vector(vectors: DataFrame, query: list[float], k: int, vec_id: str = "vec_id") -> DataFrame:
    """The k nearest vectors with score (1 - distance) and methods."""
    near = vector.knn(vectors, query, k, id_col=vec_id)
    return near.select(vec_id, (1 - F.col("distance")).alias("score"), F.array(F.lit("vector")).alias("methods"))


def by_text(index: search_index.Index, query: str, k: int, within: DataFrame | None = None) -> DataFrame:
    """The k best full-text hits with score (the better, the larger) and methods."""
    hits = search_index.bm25(index, query, k, within)
    return hits.select(index.id_col, (-F.col("bm25")).alias("score"), F.array(F.lit("fts")).alias("methods"))


def hybrid(index: search_index.Index, vectors: DataFrame, text: str, query: list[float], k: int, vec_id: str = "vec_id") -> DataFrame:
    """Fusion of the nearest vectors and the best full-text hits; vectors alone where the text can't be searched for."""
    doc_id = index.id_col
    near = vector.knn(vectors, query, POOL * k, id_col=vec_id).select(F.col(vec_id).alias(doc_id), "distance")
    lists = [(ranked(near, F.col("distance"), doc_id), "vector", 1.0)]
    try:
        hits = search_index.bm25(index, text, POOL * k)
        lists.append((ranked(hits, F.col("bm25"), doc_id), "fts", FULLTEXT_WEIGHT))
    except fulltext.QueryError:
        pass
    return rrf(lists, k, doc_id)


def cap_per_document(rows: DataFrame, group: str, score: str, tie: str, most: int = PER_DOCUMENT) -> DataFrame:
    """The `most` best rows of every group; all rows if there is but one group.

    `rows` is a cut list (a pool for reranking), so the count of its groups is a small window.
    """
    few = rows.withColumn("_low", F.min(group).over(Window.partitionBy(F.lit(0)))).withColumn("_high", F.max(group).over(Window.partitionBy(F.lit(0))))
    rows = few.withColumn("_single", (F.col("_low") == F.col("_high")) & (F.count(group).over(Window.partitionBy(F.lit(0))) == F.count("*").over(Window.partitionBy(F.lit(0)))))
    order = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return rows.withColumn("_at", F.row_number().over(order)).filter(F.col("_single") | (F.col("_at") <= most)).drop("_at", "_low", "_high", "_single")


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def overlap_score(text: Column, query: str) -> Column:
    """The default scorer: distinct query terms in the text, less half of those missing. A model may take its place."""
    terms = F.array(*[F.lit(t) for o in fulltext.operands(fulltext.sanitize(query)) for t in o.terms])
    terms = F.array_distinct(terms)
    found = F.size(F.array_intersect(fulltext.tokens(text), terms))
    return found - 0.5 * (F.size(terms) - found)


#: Pairs of a question and a text that a model scores at a time.
MODEL_PAIRS = 16


def model_score(text: Column, query: str, load: Callable[[], Callable[[list[tuple[str, str]]], Sequence[float]]], pairs: int = MODEL_PAIRS) -> Column:
    """What a model says of (query, text) for each row, for `rerank`: `load` gives the model, once per task, and it gets `pairs` at a time.

    Texts of like length are scored together, as models fill the shorter ones of a batch up. A null text is scored as an empty one.
    """

    def task(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            order, scores = sorted(range(len(texts)), key=lambda i: len(texts[i])), [0.0] * len(texts)
            for at in range(0, len(order), pairs):
                chosen = order[at : at + pairs]
                found = list(model([(query, texts[i]) for i in chosen]))
                if len(found) != len(chosen):
                    raise ValueError(f"{len(chosen)} pairs were given, and {len(found)} scores came back")
                for i, value in zip(chosen, found, strict=True):
                    scores[i] = float(value)
            yield pa.array(scores, pa.float64())

    task.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(task, "double")(text)


def pool_size(k: int) -> int:
    return max(LEAST_POOL, POOL * k)


def rerank(rows: DataFrame, k: int, scorer: Callable[[Column], Column], text: str, group: str | None, score: str, tie: str) -> DataFrame:
    """The k best rows by the scorer's sigmoid, after the cap per document."""
    if group:
        rows = cap_per_document(rows, group, score, tie)
    return rows.withColumn("rerank_score", sigmoid(scorer(F.col(text)))).orderBy(F.desc("rerank_score"), F.desc(score), tie).limit(k)


def collapse(rows: DataFrame, key: str, keep: list[str], rank: str = "rank") -> DataFrame:
    """Distinct keys in the order of first sight, with a new rank per `keep`; null keys are left out."""
    first = rows.filter(F.col(key).isNotNull()).groupBy(*keep, key).agg(F.min(rank).alias("_first"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*(keep or [F.lit(0)])).orderBy("_first", key)).cast("long")).drop("_first")


def sources(rows: DataFrame, key: Column, rank: str = "rank") -> DataFrame:
    """source, chunks and first_rank of every source."""
    return rows.groupBy(key.alias("source")).agg(F.count("*").alias("chunks"), F.min(rank).cast("long").alias("first_rank"))
