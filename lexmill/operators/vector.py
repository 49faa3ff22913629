"""Exact nearest neighbours over array columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that one block holds at most, and vectors that a part holds about.
BLOCK, PART = 4096, 50_000


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def _as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity; null if a vector is null, zero or of another length."""
    a, b = _as_double(a), _as_double(b)
    dot = _sum(F.zip_with(a, b, lambda x, y: x * y))
    norms = F.sqrt(_sum(F.transform(a, lambda x: x * x))) * F.sqrt(_sum(F.transform(b, lambda x: x * x)))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), 1 - dot / norms)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(_as_double(a), _as_double(b), lambda x, y: (x - y) * (x - y))))


def l1_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_as_double(a), _as_double(b), lambda x, y: F.abs(x - y)))


METRICS = {"cosine": cosine_distance, "l2": l2_distance, "l1": l1_distance}


def literal_vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def knn(vectors: DataFrame, query: list[float], k: int, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows nearest to one query vector, as `vectors` with distance; ties go to the smaller id.

    A filter put before this call narrows the candidates; one put after it narrows the k found, and may leave fewer.
    """
    distance = METRICS[metric](F.col(vector_col), literal_vector(query))
    return vectors.withColumn("distance", distance).filter("distance is not null").orderBy("distance", id_col).limit(k)


def vector_of(vectors: DataFrame, key: object, id_col: str = "vec_id", vector_col: str = "embedding") -> list[float]:
    """One stored vector, for use as a query."""
    found = vectors.filter(F.col(id_col) == key).select(vector_col).first()
    if found is None:
        raise LookupError(f"no vector {key!r}")
    return [float(x) for x in found[0]]


def knn_many(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id and distance (cosine) of the k nearest of every query, exactly, the query's own id left out.

    Up to BLOCK queries are broadcast, and every task keeps its best k for each. More are dealt out in blocks of that size,
    and the vectors in parts of about PART; each block meets each part in one task.
    """
    spark = vectors.sparkSession
    rows = queries.select(F.col(id_col).cast("long").alias("id"), _as_double(F.col(vector_col)).alias("v")).filter(F.col("v").isNotNull())
    base = vectors.select(F.col(id_col).cast("long").alias("id"), _as_double(F.col(vector_col)).alias("v")).filter(F.col("v").isNotNull())
    blocks = -(-rows.count() // BLOCK)
    schema = "query_id long, id long, distance double"
    if blocks <= 1:
        asked = rows.limit(BLOCK).toArrow()
        shared = spark.sparkContext.broadcast(asked)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _nearest(shared.value, pa.Table.from_batches([batch]), k).to_batches()

        found = base.mapInArrow(task, schema)
    else:
        parts = max(1, -(-base.count() // PART))
        asked = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        held = base.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        found = asked.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInArrow(lambda q, x: _nearest(q, x, k), schema)
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "distance")


def _nearest(asked: pa.Table, held: pa.Table, k: int) -> pa.Table:
    """The k nearest of some vectors (id, v) for each of some queries (id, v)."""
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])

    def unit(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, v = np.array(rows["id"].to_pylist(), np.int64), np.array(rows["v"].to_pylist(), float)
        norms = np.linalg.norm(v, axis=1) if len(v) else np.empty(0)
        return ids[norms > 0], v[norms > 0] / norms[norms > 0, None]

    if not len(asked) or not len(held):
        return schema.empty_table()
    (asked_ids, q), (ids, v) = unit(asked), unit(held)
    if not len(q) or not len(v):
        return schema.empty_table()
    distance = 1 - q @ v.T
    distance[asked_ids[:, None] == ids[None, :]] = np.inf
    best = np.lexsort((np.broadcast_to(ids, distance.shape), distance), axis=1)[:, :k]
    near = np.take_along_axis(distance, best, axis=1)
    keep = np.isfinite(near)
    return pa.table([np.repeat(asked_ids, best.shape[1]).reshape(best.shape)[keep], ids[best][keep], near[keep]], schema=schema)


def centroids(vectors: DataFrame, label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """Component means per label, as rows of label, dim and mean."""
    parts = vectors.select(label_col, F.posexplode(_as_double(F.col(vector_col))).alias("dim", "x"))
    return parts.groupBy(label_col, "dim").agg(F.avg("x").alias("mean"))
