"""Search queries over the given tables, and the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill import session
from lexmill.operators import fulltext, output, quality, ranking, search_index, vector, vector_index
from lexmill.sources import store

#: The queries that are asked: a stored vector, and texts in the corpus's own words.
VECTOR_ID = 0
WORDS = "Ererthe, nd ou the ered?"
PHRASE = '"of the" erer'
TWICE = "ered ered nd"
PREFIX = "ere* nd"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    session.tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stable(spark: SparkSession, kind: str, path: str) -> str:
    """A place below the shared folder for what is built from the present files at a path; other applications find it there."""
    state = f"{path} {session.fingerprint(spark, path)}"
    return f"{session.shared_dir(spark)}/lexmill/{kind}-{hashlib.sha256(state.encode()).hexdigest()[:32]}"


_indexes: dict[tuple[str, str, str], search_index.Index] = {}


def _index(spark: SparkSession, sf_dir: str) -> search_index.Index:
    """The full-text index of `documents`, built once for each state of the table's files, below the shared folder."""
    path = f"{sf_dir}/documents.parquet"
    key = spark.sparkContext.applicationId, path, session.fingerprint(spark, path)
    if key not in _indexes:
        _indexes[key] = search_index.build_index(_read(spark, sf_dir, "documents"), _stable(spark, "index", path))
    return _indexes[key]


def _knn(metric: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _read(spark, sf_dir, "embeddings")
        found = vector.knn(rows, vector.vector_of(rows, VECTOR_ID), 10, metric)
        return found.select("vec_id", "label", (F.round("distance", 6) + 0.0).alias("distance"))

    return query


def _knn_bounded(metric: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The same by clusters with bounds; their index is built once for each state of the table's files."""
        rows, path = _read(spark, sf_dir, "embeddings"), f"{sf_dir}/embeddings.parquet"
        place = _stable(spark, f"vectors-{metric}", path)
        index = vector_index.opened(spark, place)
        if index is None:
            index = vector_index.build(rows, f"{place}-{uuid.uuid4().hex}" if session.files(spark, place)[0].exists(session.files(spark, place)[1]) else place, metric)
        found = vector_index.knn(index, vector.vector_of(rows, VECTOR_ID), 10)
        return found.select("vec_id", "label", (F.round("distance", 6) + 0.0).alias("distance"))

    return query


_COSINE = "1 - list_sum(list_transform(list_zip(e.v, q.v), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(e.v, lambda x: x * x))) * sqrt(list_sum(list_transform(q.v, lambda x: x * x))))"
_VECTORS = f"e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v FROM e WHERE vec_id = {VECTOR_ID})"


_DISTANCES = {
    "cosine": _COSINE,
    "l2": "sqrt(list_sum(list_transform(list_zip(e.v, q.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))",
    "l1": "list_sum(list_transform(list_zip(e.v, q.v), lambda p: abs(p[1] - p[2])))",
}


def _knn_sql(distance: str) -> str:
    return f"WITH {_VECTORS}, d AS (SELECT vec_id, label, {distance} AS distance FROM e, q) SELECT vec_id, label, round(distance, 6) + 0.0 AS distance FROM d ORDER BY d.distance, vec_id LIMIT 10"


def knn_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter comes after the limit, so fewer than ten rows may be left."""
    return _knn("cosine")(spark, sf_dir).filter("label < 5")


def knn_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    found = vector.knn(rows.filter("label < 5"), vector.vector_of(rows, VECTOR_ID), 10)
    return found.select("vec_id", "label", (F.round("distance", 6) + 0.0).alias("distance"))


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    return vector.knn_many(rows, rows.filter("vec_id % 100 = 0"), 5)


def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every row whose id is divisible by 100, against all rows."""
    return _batch(spark, sf_dir).select("query_id", "rank", "vec_id", (F.round("distance", 6) + 0.0).alias("distance"))


_BATCH_SQL = f"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT q.vec_id AS query_id, q.label AS own, e.vec_id, e.label, {_COSINE} AS distance
  FROM e JOIN e q ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
"""


def knn_label_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest label among the five nearest; ties go to the smaller label."""
    labels = _read(spark, sf_dir, "embeddings").select("vec_id", "label")
    votes = _batch(spark, sf_dir).join(labels, "vec_id").groupBy("query_id", "label").agg(F.count("*").alias("votes"))
    best = Window.partitionBy("query_id").orderBy(F.desc("votes"), "label")
    return votes.withColumn("at", F.row_number().over(best)).filter("at = 1").select("query_id", F.col("label").alias("voted"), "votes")


def centroid_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector.centroids(_read(spark, sf_dir, "embeddings"))
    return found.select("label", F.col("dim").cast("long").alias("dim"), F.round("mean", 6).alias("mean"))


_TOKENS = f"list_filter(regexp_split_to_array(translate(lower(coalesce(text, '')), '{fulltext.FOLD_FROM}', '{fulltext.FOLD_TO}'), '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+'), lambda t: t <> '')"


def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    terms = fulltext.tokens(F.col("text"))
    return docs.select("doc_id", F.size(terms).cast("long").alias("terms"), F.sha2(F.array_join(terms, " "), 256).alias("terms_sha256"))


def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.document_frequency(_read(spark, sf_dir, "documents"))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = _read(spark, sf_dir, "documents").select(F.size(fulltext.tokens(F.col("text"))).alias("n"))
    return lengths.agg(F.count("*").alias("documents"), F.sum("n").alias("terms"), F.round(F.avg("n"), 6).alias("mean_terms"))


def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build the full-text index, and read its statistics back."""
    index = search_index.build_index(_read(spark, sf_dir, "documents"), session.scratch_path(spark, "fulltext"))
    words = index.blocks().filter(F.col("term") != search_index.EVERY)
    found = words.agg(F.sum("n").alias("postings"), F.countDistinct("term").alias("terms"), F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)).alias("occurrences"))
    return found.withColumn("documents", F.lit(index.documents).cast("long"))


def postings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index with the first position of every posting."""
    found = search_index.inverted(_read(spark, sf_dir, "documents"))
    return found.select("term", "doc_id", "tf", F.element_at("positions", 1).cast("long").alias("first_position"))


def _bm25(text: str, k: int = 10, within: str | None = None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        narrowed = _read(spark, sf_dir, "documents").filter(within) if within else None
        found = search_index.bm25(_index(spark, sf_dir), text, k, within=narrowed)
        return found.select("doc_id", F.round("bm25", 6).alias("bm25"))

    return query


def bm25_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index to which the benchmark's texts were added, in which documents got other texts, and from which others were removed.

    Four commits: all documents; those of src2 read backwards; without those of src4; and the benchmark's texts, under negative ids.
    """
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    kept = store.Store(spark, session.scratch_path(spark, "changed"))
    kept.change(lambda s: search_index.added(kept, s, "index", docs))
    changed = docs.filter("source = 'src2'")

    def reread(state: store.State) -> dict[str, store.Table]:
        tables = search_index.removed(kept, state, "index", changed)
        new = search_index.segment(kept, state, "index", changed.withColumn("text", F.reverse("text")))
        return tables | {"index": tables.get("index", state.table("index")).plus(new)}

    kept.change(reread)
    kept.change(lambda s: search_index.removed(kept, s, "index", docs.filter("source = 'src4'")))
    kept.change(lambda s: search_index.added(kept, s, "index", _read(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), "text")))
    kept.change(lambda s: search_index.merged(kept, s, "index"))
    return search_index.bm25(search_index.opened(kept), WORDS, 20).select("doc_id", F.round("bm25", 6).alias("bm25"))


_CHANGED = """
WITH tok AS (SELECT *, {tokens} AS t FROM (
  SELECT doc_id, CASE WHEN source = 'src2' THEN reverse(text) ELSE text END AS text, source FROM documents WHERE source IS DISTINCT FROM 'src4'
  UNION ALL SELECT -1 - item_id, text, NULL FROM benchmark)),"""


def _count(phrase: tuple[str, ...]) -> str:
    if phrase[-1].endswith("*"):
        return f"len(list_filter(t, lambda x: starts_with(x, '{phrase[0][:-1]}')))"
    if len(phrase) == 1:
        return f"len(list_filter(t, lambda x: x = '{phrase[0]}'))"
    same = " AND ".join(f"t[i + {j}] = '{w}'" for j, w in enumerate(phrase))
    return f"len(list_filter(range(1, len(t) + 1), lambda i: {same}))"


def _bm25_sql(phrases: list[tuple[str, ...]], k: int = 10, within: str = "true", tail: str = "") -> str:
    tf = ", ".join(f"{_count(p)} AS tf{i}" for i, p in enumerate(phrases))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(phrases)))
    idf = lambda i: f"(CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{i} + 0.5) / (df{i} + 0.5)) END)"
    score = " + ".join(f"{idf(i)} * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / mean))" for i in range(len(phrases)))
    hit = " OR ".join(f"tf{i} > 0" for i in range(len(phrases)))
    return f"""
WITH tok AS (SELECT *, {_TOKENS} AS t FROM documents),
f AS (SELECT * EXCLUDE (t), len(t) AS dl, {tf} FROM tok),
s AS (SELECT count(*) AS n, avg(dl) AS mean, {df} FROM f),
hits AS (SELECT doc_id, text, source, -({score}) AS bm25 FROM f, s WHERE ({hit}) AND ({within}) ORDER BY bm25, doc_id LIMIT {k})
""" + (tail or "SELECT doc_id, round(bm25, 6) AS bm25 FROM hits")


_WORD_PHRASES = [("ererthe",), ("nd",), ("ou",), ("ered",)]


def sanitize_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts as full-text queries."""
    rows = _read(spark, sf_dir, "benchmark")
    return rows.select("item_id", fulltext.sanitize_column(F.col("text")).alias("query"))


_SANITIZE_SQL = f"""
WITH a AS (SELECT item_id, translate(text, '{fulltext.DROPPED.replace("'", "''")}', '{" " * len(fulltext.DROPPED)}') AS x FROM benchmark),
b AS (SELECT item_id, CASE WHEN (length(x) - length(replace(x, '"', ''))) % 2 = 1 THEN replace(x, '"', ' ') ELSE x END AS x FROM a),
p AS (SELECT item_id, unnest(string_split(x, '"')) AS part, generate_subscripts(string_split(x, '"'), 1) AS i FROM b),
w AS (SELECT item_id, i, CASE WHEN i % 2 = 0 THEN ['"' || part || '"'] ELSE
  list_filter(regexp_split_to_array(part, '\\s+'), lambda y: y <> '' AND lower(y) NOT IN ({", ".join(f"'{s}'" for s in fulltext.STOP_WORDS)})) END AS words FROM p)
SELECT item_id, nullif(array_to_string(flatten(list(words ORDER BY i)), ' OR '), '') AS query FROM w GROUP BY item_id
"""


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: nearest vectors and best full-text hits, fused by reciprocal rank."""
    vectors = _read(spark, sf_dir, "embeddings")
    found = ranking.hybrid(_index(spark, sf_dir), vectors, WORDS, vector.vector_of(vectors, VECTOR_ID), 10)
    return found.select("doc_id", F.round("score", 9).alias("score"), F.array_join("methods", "+").alias("methods"), "rank")


_HYBRID_SQL = _bm25_sql(_WORD_PHRASES, 30).rstrip() + f""",
{_VECTORS},
d AS (SELECT vec_id, {_COSINE} AS distance FROM e, q ORDER BY distance, vec_id LIMIT 30),
l AS (SELECT vec_id AS doc_id, 'vector' AS method, 1.0 AS weight, 0 AS list, row_number() OVER (ORDER BY distance, vec_id) AS r FROM d
  UNION ALL SELECT doc_id, 'fts', 0.5, 1, row_number() OVER (ORDER BY bm25, doc_id) FROM hits),
g AS (SELECT doc_id, sum(weight / (60 + r)) AS score, string_agg(DISTINCT method, '+' ORDER BY method) AS methods, min(list * 1000000 + r) AS seen FROM l GROUP BY doc_id),
o AS (SELECT *, row_number() OVER (ORDER BY score DESC, seen) AS rank FROM g)
SELECT doc_id, round(score, 9) AS score, methods, rank FROM o WHERE rank <= 10
"""
_HYBRID_SQL = _HYBRID_SQL.replace("SELECT doc_id, round(bm25, 6) AS bm25 FROM hits,", ",")


def retrievers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five of each mode, a retriever's function each, with their methods, and the documents' sources where there are any."""
    vectors, index = _read(spark, sf_dir, "embeddings"), _index(spark, sf_dir)
    asked = vector.vector_of(vectors, VECTOR_ID)
    by_mode = {
        "vector": lambda k: ranking.by_vector(vectors, asked, k).withColumnRenamed("vec_id", "doc_id"),
        "fts": lambda k: ranking.by_text(index, WORDS, k),
        "hybrid": lambda k: ranking.hybrid(index, vectors, WORDS, asked, k).select("doc_id", "score", "methods"),
    }
    found = None
    for mode, retrieve in by_mode.items():
        part = retrieve(5).withColumn("mode", F.lit(mode))
        found = part if found is None else found.unionByName(part)
    sources = _read(spark, sf_dir, "documents").filter("source <> 'src1'").select("doc_id", "source")
    named = F.broadcast(found).join(sources, "doc_id", "left")  # 15 rows
    return named.select("mode", "doc_id", F.round("score", 6).alias("score"), F.array_join("methods", "+").alias("methods"), "source")


def mode_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two modes' lists against rows of the query's label: the nearest first, and the nearest last. Some queries can't be answered."""
    labels = _read(spark, sf_dir, "embeddings").select("vec_id", "label")
    run = _batch(spark, sf_dir).select("query_id", F.col("vec_id").alias("doc_id"), "rank")
    asked = labels.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label", F.when(F.col("vec_id") % 300 == 200, True).alias("unanswerable"))
    asked = quality.answerable(asked).drop("unanswerable")
    grades = labels.select(F.col("label").alias("topic"), F.col("vec_id").alias("doc_id"), F.lit(1).alias("grade"))
    runs = {"first": run.join(asked.select("query_id"), "query_id", "left_semi"), "last": run.join(asked.select("query_id"), "query_id", "left_semi").withColumn("rank", 6 - F.col("rank"))}
    found = quality.mode_comparison(runs, grades, 3, asked.select("query_id", F.col("label").alias("topic"), F.col("query_id").alias("without")))
    return found.select("mode", "queries", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "mrr", "ndcg")])


_MODES_SQL = _BATCH_SQL + """
, m AS (SELECT 'first' AS mode, query_id, own, vec_id, rank FROM r WHERE rank <= 5 AND query_id % 300 <> 200 UNION ALL SELECT 'last', query_id, own, vec_id, 6 - rank FROM r WHERE rank <= 5 AND query_id % 300 <> 200),
n AS (SELECT label, count(*) - 1 AS relevant FROM e GROUP BY 1), h AS (SELECT m.mode, m.query_id, any_value(n.relevant) AS relevant, count(*) FILTER (e.label = m.own AND rank <= 3) AS hits,
  min(rank) FILTER (e.label = m.own) AS first, sum(1 / log2(rank + 1)) FILTER (e.label = m.own AND rank <= 3) AS gain FROM m JOIN e USING (vec_id) JOIN n ON n.label = m.own GROUP BY 1, 2),
x AS (SELECT mode, hits / 3 AS precision, CASE WHEN relevant = 0 THEN 0 ELSE hits / relevant END AS recall, coalesce(1 / first, 0) AS mrr,
  coalesce(gain / (CASE least(relevant, 3) WHEN 1 THEN 1 WHEN 2 THEN 1 + 1 / log2(3) ELSE 1.5 + 1 / log2(3) END), 0) AS ndcg FROM h)
SELECT mode, count(*) AS queries, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM x GROUP BY 1
"""


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per query of the batch with its metrics and its results in order, as JSON."""
    labels = _read(spark, sf_dir, "embeddings").select("vec_id", "label")
    found = _batch(spark, sf_dir).select("query_id", F.col("vec_id").alias("doc_id"), "rank", F.round(1 - F.col("distance"), 3).alias("score"))
    asked = labels.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("label "), F.col("label")).alias("text"))
    metrics = found.groupBy("query_id").agg(F.count("*").alias("found"))
    log = output.run_log(asked, found.withColumn("score", F.format_string("%.3f", "score")), metrics)
    return log.select("query_id", F.to_json(F.struct("text", "metrics", "results")).alias("json"))


_LOG_SQL = _BATCH_SQL + """
SELECT query_id, '{"text":"label ' || any_value(own) || '","metrics":{"found":' || count(*) || '},"results":[' || string_agg('{"rank":' || rank || ',"doc_id":' || vec_id || ',"score":"' || printf('%.3f', round(1 - distance, 3)) || '"}', ',' ORDER BY rank) || ']}' AS json
FROM r WHERE rank <= 5 GROUP BY query_id
"""


def _pool(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    hits = search_index.bm25(_index(spark, sf_dir), WORDS, ranking.pool_size(k))
    return F.broadcast(hits).join(docs.select("doc_id", "source", "text"), "doc_id").withColumn("score", -F.col("bm25"))


def per_doc_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best hits of every source."""
    return ranking.cap_per_document(_pool(spark, sf_dir, 10), "source", "score", "doc_id").select("source", "doc_id", F.round("score", 6).alias("score"))


def rerank_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pool(spark, sf_dir, 10)
    found = ranking.rerank(rows, 10, lambda text: ranking.overlap_score(text, WORDS), "text", "source", "score", "doc_id")
    return found.select("doc_id", F.round("rerank_score", 6).alias("rerank_score"))


def chunk_to_doc_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits collapsed to their sources, in the order of first sight."""
    hits = ranking.ranked(_pool(spark, sf_dir, 10), F.col("bm25"), "doc_id")
    return ranking.collapse(hits, "source", []).select("source", "rank")


def source_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = ranking.ranked(_pool(spark, sf_dir, 10), F.col("bm25"), "doc_id")
    return ranking.sources(hits, F.coalesce("source", F.col("doc_id").cast("string")))


_RANKED = ", h AS (SELECT *, row_number() OVER (ORDER BY bm25, doc_id) AS r FROM hits)\n"
_OVERLAP = "len(list_filter(['ererthe', 'nd', 'ou', 'ered'], lambda w: list_contains(t, w)))"

QUERIES = {
    "knn_cosine": _knn("cosine"),
    "knn_l2": _knn("l2"),
    "knn_l1": _knn("l1"),
    "knn_bounded_cosine": _knn_bounded("cosine"),
    "knn_bounded_l2": _knn_bounded("l2"),
    "knn_bounded_l1": _knn_bounded("l1"),
    "knn_postfilter": knn_postfilter,
    "knn_prefilter": knn_prefilter,
    "knn_batch": knn_batch,
    "knn_label_vote": knn_label_vote,
    "centroid_by_label": centroid_by_label,
    "tokenize_terms": tokenize_terms,
    "doc_freq": document_frequency,
    "corpus_stats": corpus_stats,
    "postings": postings_summary,
    "fulltext_index": index_statistics,
    "sanitize_queries": sanitize_queries,
    "bm25_or": _bm25(WORDS),
    "bm25_docfilter": _bm25(WORDS, within="source = 'src3'"),
    "bm25_phrase": _bm25(PHRASE),
    "bm25_dup_operand": _bm25(TWICE),
    "bm25_prefix": _bm25(PREFIX, 20),
    "bm25_after_changes": bm25_after_changes,
    "hybrid_search": hybrid_search,
    "per_doc_cap": per_doc_cap,
    "rerank_pool": rerank_pool,
    "retrievers": retrievers,
    "mode_comparison": mode_comparison,
    "run_log": run_log,
    "chunk_to_doc_collapse": chunk_to_doc_collapse,
    "source_aggregation": source_aggregation,
}

ORACLE_SQL = {
    **{f"knn_{m}": _knn_sql(d) for m, d in _DISTANCES.items()},
    **{f"knn_bounded_{m}": _knn_sql(d) for m, d in _DISTANCES.items()},
    "knn_postfilter": f"SELECT * FROM ({_knn_sql(_COSINE)}) WHERE label < 5",
    "knn_prefilter": f"WITH {_VECTORS}, d AS (SELECT vec_id, label, {_COSINE} AS distance FROM e, q WHERE label < 5) SELECT vec_id, label, round(distance, 6) + 0.0 AS distance FROM d ORDER BY d.distance, vec_id LIMIT 10",
    "knn_batch": _BATCH_SQL + "SELECT query_id, rank, vec_id, round(distance, 6) + 0.0 AS distance FROM r WHERE rank <= 5",
    "knn_label_vote": _BATCH_SQL + ", v AS (SELECT query_id, label, count(*) AS votes FROM r WHERE rank <= 5 GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) AS k FROM v) SELECT query_id, label AS voted, votes FROM w WHERE k = 1",
    "centroid_by_label": "WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) SELECT label, CAST(dim AS BIGINT) AS dim, round(avg(v), 6) AS mean FROM x GROUP BY 1, 2",
    "tokenize_terms": f"WITH x AS (SELECT doc_id, {_TOKENS} AS t FROM documents) SELECT doc_id, CAST(len(t) AS BIGINT) AS terms, sha256(array_to_string(t, ' ')) AS terms_sha256 FROM x",
    "doc_freq": f"WITH x AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, CAST(count(*) AS BIGINT) AS cf FROM x GROUP BY term",
    "corpus_stats": f"WITH x AS (SELECT len({_TOKENS}) AS n FROM documents) SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS terms, round(avg(n), 6) AS mean_terms FROM x",
    "postings": f"WITH a AS (SELECT doc_id, {_TOKENS} AS t FROM documents), x AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS p FROM a) SELECT term, doc_id, count(*) AS tf, CAST(min(p) AS BIGINT) AS first_position FROM x GROUP BY 1, 2",
    "fulltext_index": f"WITH x AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) SELECT count(DISTINCT (doc_id, term)) AS postings, count(DISTINCT term) AS terms, count(*) AS occurrences, (SELECT count(*) FROM documents) AS documents FROM x",
    "sanitize_queries": _SANITIZE_SQL,
    "bm25_or": _bm25_sql(_WORD_PHRASES),
    "bm25_docfilter": _bm25_sql(_WORD_PHRASES, within="source = 'src3'"),
    "bm25_phrase": _bm25_sql([("of", "the"), ("erer",)]),
    "bm25_dup_operand": _bm25_sql([("ered",), ("ered",), ("nd",)]),
    "bm25_prefix": _bm25_sql([("ere*",), ("nd",)], 20),
    "bm25_after_changes": _CHANGED.format(tokens=_TOKENS) + _bm25_sql(_WORD_PHRASES, 20).split("FROM documents),", 1)[1],
    "hybrid_search": _HYBRID_SQL,
    "per_doc_cap": _bm25_sql(_WORD_PHRASES, 100, tail="SELECT source, doc_id, round(-bm25, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY bm25, doc_id) AS k FROM hits) WHERE k <= 3"),
    "rerank_pool": _bm25_sql(_WORD_PHRASES, 100, tail=f"""
, c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY bm25, doc_id) AS k FROM hits),
o AS (SELECT doc_id, bm25, {_OVERLAP.replace("(t, w)", "(" + _TOKENS + ", w)")} AS n FROM c WHERE k <= 3)
SELECT doc_id, round(1 / (1 + exp(-(n - 0.5 * (4 - n)))), 6) AS rerank_score FROM o ORDER BY n DESC, bm25, doc_id LIMIT 10"""),
    "retrievers": _bm25_sql(_WORD_PHRASES, 15).rstrip().removesuffix("SELECT doc_id, round(bm25, 6) AS bm25 FROM hits") + f""",
{_VECTORS},
d AS (SELECT vec_id, {_COSINE} AS distance FROM e, q ORDER BY distance, vec_id LIMIT 15),
v AS (SELECT vec_id AS doc_id, distance, row_number() OVER (ORDER BY distance, vec_id) AS r FROM d), h AS (SELECT doc_id, bm25, row_number() OVER (ORDER BY bm25, doc_id) AS r FROM hits),
l AS (SELECT doc_id, 'vector' AS method, 1.0 / (60 + r) AS part, r AS seen FROM v UNION ALL SELECT doc_id, 'fts', 0.5 / (60 + r), 1000000 + r FROM h),
g AS (SELECT doc_id, sum(part) AS score, string_agg(DISTINCT method, '+' ORDER BY method) AS methods, min(seen) AS seen FROM l GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY score DESC, seen) AS r FROM g),
a AS (SELECT 'vector' AS mode, doc_id, 1 - distance AS score, 'vector' AS methods FROM v WHERE r <= 5 UNION ALL SELECT 'fts', doc_id, -bm25, 'fts' FROM h WHERE r <= 5 UNION ALL SELECT 'hybrid', doc_id, score, methods FROM o WHERE r <= 5)
SELECT mode, doc_id, round(score, 6) AS score, methods, source FROM a LEFT JOIN (SELECT doc_id, source FROM documents WHERE source <> 'src1') USING (doc_id)""",
    "mode_comparison": _MODES_SQL,
    "run_log": _LOG_SQL,
    "chunk_to_doc_collapse": _bm25_sql(_WORD_PHRASES, 100, tail=_RANKED + "SELECT source, row_number() OVER (ORDER BY min(r), source) AS rank FROM h WHERE source IS NOT NULL GROUP BY source"),
    "source_aggregation": _bm25_sql(_WORD_PHRASES, 100, tail=_RANKED + "SELECT coalesce(source, CAST(doc_id AS VARCHAR)) AS source, count(*) AS chunks, min(r) AS first_rank FROM h GROUP BY 1"),
}
