"""Exact nearest neighbours that read part of the vectors: clusters with bounds.

`build` fits centres on a sample, files every vector with its nearest centre, and notes each cluster's radius. By the triangle
inequality no member is nearer to a query than the centre's distance less the radius. A search reads the clusters with the
smallest bounds until they hold enough vectors, and then those whose bound the k-th best so far doesn't beat. So the result
is that of a full scan; how much is read depends on how well the vectors cluster.

For cosine, vectors are clustered by their directions, where the distance is half the square of the Euclidean one; an
L1 distance is at least the Euclidean one.

Defined results: vectors that are null, of another dimension or (for cosine) zero are in no cluster, as no search finds
them; an empty table makes an index without clusters; all columns of the table are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import session
from lexmill.functions.expressions import refuse_columns
from lexmill.operators import vector

#: Vectors that centres are fitted on at most, clusters at most (their centres go to the driver), and rounds of fitting.
SAMPLE, MOST_CLUSTERS, ROUNDS = 20_000, 4096, 5
#: Slack of bounds for rounding, as a share of the radius and the distance.
SLACK = 1e-6


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str
    metric: str
    dim: int
    vector_col: str
    schema: str
    clusters: list[tuple[int, list[float], float, int]]  # cluster, centre, radius, vectors

    def rows(self, clusters: list[int]) -> DataFrame:
        """The vectors of some clusters."""
        if not clusters:
            return self.spark.createDataFrame([], self.schema)
        read = self.spark.read.schema(f"{self.schema}, lexmill_cluster int").option("basePath", f"{self.path}/vectors")
        return read.parquet(*[f"{self.path}/vectors/lexmill_cluster={c}" for c in clusters]).drop("lexmill_cluster")


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def _point(v: Column, metric: str) -> Column:
    """Where a vector lies among the centres."""
    v = v.cast("array<double>")
    return F.transform(v, lambda x: x / _norm(v)) if metric == "cosine" else v


def build(vectors: DataFrame, path: str, metric: str = "cosine", dim: int | None = None, vector_col: str = "embedding") -> Index:
    """Write an index of `vectors` for a metric (`cosine`, `l2` or `l1`) to `path`. `dim` is that of the first vector, if it isn't given."""
    refuse_columns(vectors, "lexmill_cluster", "lexmill_point", "lexmill_vector")
    spark = vectors.sparkSession
    if dim is None:
        first = vectors.filter(F.size(vector_col) > 0).select(F.size(vector_col)).first()
        dim = first[0] if first else 0
    whole = (F.size(vector_col) == dim) & F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(whole)
    rows = rows.filter(_norm(F.col(vector_col).cast("array<double>")) > 0) if metric == "cosine" else rows
    placed = session.cut(rows.withColumn("lexmill_point", _point(F.col(vector_col), metric)), "points")
    n = placed.count()
    schema = ", ".join(f"`{c}` {t}" for c, t in vectors.dtypes)
    clusters: list[tuple[int, list[float], float, int]] = []
    if n:
        k = max(1, min(MOST_CLUSTERS, int(n**0.5)))
        sample = placed.sample(min(1.0, SAMPLE / n), 17) if n > SAMPLE else placed
        points = sample.select(array_to_vector("lexmill_point").alias("lexmill_vector"))
        model = KMeans(k=k, maxIter=ROUNDS, seed=17, initMode="random", featuresCol="lexmill_vector", predictionCol="lexmill_cluster").fit(points)
        found = model.transform(placed.withColumn("lexmill_vector", array_to_vector("lexmill_point"))).drop("lexmill_vector")
        found.repartition("lexmill_cluster").drop("lexmill_point").write.partitionBy("lexmill_cluster").parquet(f"{path}/vectors")
        centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "of int, centre array<double>")
        away = vector.l2_distance(F.col("lexmill_point"), F.col("centre"))
        stored = spark.read.schema(f"{schema}, lexmill_cluster int").parquet(f"{path}/vectors").withColumn("lexmill_point", _point(F.col(vector_col), metric))
        sizes = stored.join(F.broadcast(centres), F.col("lexmill_cluster") == F.col("of"))  # MOST_CLUSTERS rows
        sizes.groupBy("of").agg(F.first("centre").alias("centre"), F.max(away).alias("radius"), F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/clusters")
        clusters = _clusters(spark, path)
    spark.createDataFrame([(metric, dim, vector_col, schema)], "metric string, dim int, vector_col string, schema string").coalesce(1).write.parquet(f"{path}/index")  # last: without it the index isn't whole
    return Index(spark, path, metric, dim, vector_col, schema, clusters)


def _clusters(spark: SparkSession, path: str) -> list[tuple[int, list[float], float, int]]:
    return [(r["of"], list(r["centre"]), r["radius"], r["n"]) for r in spark.read.parquet(f"{path}/clusters").collect()]  # MOST_CLUSTERS rows


def opened(spark: SparkSession, path: str) -> Index | None:
    """The index at a path; None if there is no whole one."""
    store, place = session.files(spark, f"{path}/index/_SUCCESS")
    if not store.exists(place):
        return None
    told = spark.read.parquet(f"{path}/index").first()
    store, place = session.files(spark, f"{path}/clusters")
    return Index(spark, path, told["metric"], told["dim"], told["vector_col"], told["schema"], _clusters(spark, path) if store.exists(place) else [])


def bounds(index: Index, query: list[float]) -> list[tuple[float, int, int]]:
    """(least distance, cluster, vectors) of every cluster, the smallest first."""
    q = [float(x) for x in query]
    size = sum(x * x for x in q) ** 0.5
    if len(q) != index.dim or index.metric == "cosine" and not size:
        return []
    point = [x / size for x in q] if index.metric == "cosine" else q
    found = []
    for cluster, centre, radius, n in index.clusters:
        away = sum((x - c) ** 2 for x, c in zip(point, centre, strict=True)) ** 0.5
        least = max(0.0, away - radius - SLACK * (away + radius))
        found.append((least * least / 2 if index.metric == "cosine" else least, cluster, n))
    return sorted(found)


def clusters_read(index: Index, query: list[float], k: int, id_col: str = "vec_id") -> list[int]:
    """The clusters that a search has to read: those whose bound the k-th best of the first ones doesn't beat."""
    order = bounds(index, query)
    first, held = [], 0
    while len(first) < len(order) and held < k:
        first.append(order[len(first)][1])
        held += order[len(first) - 1][2]
    if len(first) == len(order):
        return first
    worst = vector.knn(index.rows(first), query, k, index.metric, id_col, index.vector_col).agg(F.max("distance")).first()[0]
    return [c for least, c, _ in order if c in set(first) or least <= worst * (1 + SLACK) + SLACK]


def knn(index: Index, query: list[float], k: int, id_col: str = "vec_id") -> DataFrame:
    """The k nearest rows with distance, as `vector.knn` over the whole table gives them."""
    return vector.knn(index.rows(clusters_read(index, query, k, id_col)), query, k, index.metric, id_col, index.vector_col)
