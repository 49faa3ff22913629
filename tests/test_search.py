import math
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill import session
from lexmill.operators import catalog, fulltext, quality, ranking, search_index, vector

TEXTS = ["the cat sat on the mat", "a cat and a dog", "dogs chase cats", "Café CAT cat cat", "", None, "mat cat mat", "prefix prefixes predict"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


@pytest.fixture(scope="module")
def index(spark, docs):
    return search_index.build_index(docs, session.scratch_path(spark, "test"))


@pytest.mark.parametrize("query", ["cat", "cat dog mat", '"the mat" cat', "cat cat dog", "pre*", "cafe", "zebra", '"cat cat" "cat cat cat"', "do* ma*"])
def test_bm25_equals_fts5(index, query):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(text)")
    db.executemany("INSERT INTO t(rowid, text) VALUES (?, ?)", [(i + 1, t or "") for i, t in enumerate(TEXTS)])
    want = {r - 1: s for r, s in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (" OR ".join(fulltext.sanitize(query)),))}
    got = {r.doc_id: r.bm25 for r in search_index.bm25(index, query, 20).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9, abs_tol=1e-9) for i in want)


def test_bm25_filter_comes_before_the_limit(docs, index):
    assert [r.doc_id for r in search_index.bm25(index, "cat", 2, within=docs.filter("doc_id < 2")).collect()] == [1, 0]


def test_index_is_opened_again(spark, docs, index):
    """What is at a path is opened, not built again; an empty table makes an index without hits."""
    path = index.store.path
    assert search_index.build_index(docs.limit(1), path).documents == len(TEXTS)
    assert search_index.bm25(search_index.open_index(spark, path), "cat mat", 9).collect() == search_index.bm25(index, "cat mat", 9).collect()
    empty = search_index.build_index(spark.createDataFrame([], "doc_id long, text string"), session.scratch_path(spark, "test"))
    assert search_index.bm25(empty, "cat", 9).count() == 0 and search_index.bm25(empty, '"cat mat"', 9).count() == 0


def test_knn(spark):
    random = np.random.default_rng(0)
    v = random.normal(size=(200, 6))
    df = spark.createDataFrame([(i, x.tolist(), i % 2) for i, x in enumerate(v)] + [(900, None, 0), (901, [0.0] * 6, 0)], "vec_id long, embedding array<float>, label int")
    near = {"cosine": 1 - v @ v[0] / np.linalg.norm(v, axis=1) / np.linalg.norm(v[0]), "l2": np.linalg.norm(v - v[0], axis=1), "l1": np.abs(v - v[0]).sum(axis=1)}
    for metric, d in near.items():
        got = [r.vec_id for r in vector.knn(df.filter("vec_id < 900"), v[0].tolist(), 5, metric).collect()]
        assert got == np.argsort(d)[:5].tolist()
    limited = vector.knn(df, v[0].tolist(), 10).filter("label = 0")
    assert limited.count() == int((np.argsort(near["cosine"])[:10] % 2 == 0).sum())
    many = vector.knn_many(df, df.filter("vec_id % 50 = 0"), 3).toPandas()
    for q, found in many.groupby("query_id"):
        d = 1 - v @ v[q] / np.linalg.norm(v, axis=1) / np.linalg.norm(v[q])
        d[q] = np.inf
        assert found.sort_values("rank").vec_id.tolist() == np.argsort(d)[:3].tolist()


def test_rrf_ties_keep_the_first_list(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "doc_id long, rank long")
    b = spark.createDataFrame([(3, 1), (2, 2)], "doc_id long, rank long")
    got = ranking.rrf([(a, "vector", 1.0), (b, "fts", 1.0)], 10).orderBy("rank").collect()
    assert [(r.doc_id, r.methods) for r in got] == [(2, ["fts", "vector"]), (1, ["vector"]), (3, ["fts"])]
    assert got[0].score == pytest.approx(2 / 62) and ranking.rrf([(a, "v", 1.0), (b, "f", 1.0)], 1).count() == 1


def test_hybrid_falls_back_to_vectors(spark, index):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert {tuple(r.methods) for r in ranking.hybrid(index, vectors, "the of", [1.0, 0.0], 5).collect()} == {("vector",)}
    assert any("fts" in r.methods for r in ranking.hybrid(index, vectors, "dog", [1.0, 0.0], 5).collect())


def test_cap_rerank_collapse(spark):
    rows = spark.createDataFrame([(i, "d" if i < 5 else f"e{i}", float(10 - i), "cat " * i) for i in range(8)], "id long, doc string, score double, text string")
    assert ranking.cap_per_document(rows, "doc", "score", "id").filter("doc = 'd'").count() == 3
    best = ranking.rerank(rows, 2, lambda t: F.length(t).cast("double"), "text", "doc", "score", "id").collect()
    assert [r.id for r in best] == [7, 6] or all(r.rerank_score == 1.0 for r in best)
    ranked = rows.withColumn("rank", F.col("id") + 1)
    assert [tuple(r) for r in ranking.collapse(ranked, "doc", []).orderBy("rank").collect()] == [("d", 1), ("e5", 2), ("e6", 3), ("e7", 4)]
    s = spark.createDataFrame([(0.0,), (800.0,), (-800.0,)], "x double").select(ranking.sigmoid(F.col("x"))).collect()
    assert [r[0] for r in s] == [0.5, 1.0, 0.0]


def test_metrics(spark):
    run = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("z", "a", 1)], "query_id string, doc_id string, rank long")
    grades = spark.createDataFrame([("q", "b", 2), ("q", "x", 1)], "query_id string, doc_id string, grade int")
    got = {r.query_id: r for r in quality.retrieval_metrics(run, grades, 5).collect()}
    q = got["q"]
    assert (q.precision, q.recall, q.mrr) == (0.2, 0.5, 0.5)
    assert q.ndcg == pytest.approx((2 / math.log2(3)) / (2 + 1 / math.log2(3)))
    assert (got["z"].precision, got["z"].recall, got["z"].mrr, got["z"].ndcg) == (0, 0, 0, 0)


def test_catalog(spark):
    rows = spark.createDataFrame([("ab1", "X_y%", 2000), ("ab2", "x", None), ("c", None, 2001)], "id string, title string, year int")
    assert [r.id for r in catalog.listing(rows, contains={"title": "_Y%"}).collect()] == ["ab1"]
    assert [r.id for r in catalog.listing(rows, missing=["year"], prefix={"title": "X"}).collect()] == ["ab2"]
    with pytest.raises(catalog.CatalogError):
        catalog.listing(rows, equals={"year": 1}, missing=["year"])
    assert [catalog.by_partial_id(rows, s, "id")[0] for s in ("ab", "ab1", "c", "z")] == ["ambiguous", "found", "found", "not found"]
    new = spark.createDataFrame([("c", None, 1999), ("n", "t", 1)], "id string, title string, year int")
    assert {tuple(r) for r in catalog.coalesce_update(rows, new, "id", ["title", "year"]).collect()} == {("ab1", "X_y%", 2000), ("ab2", "x", None), ("c", None, 1999)}
    assert [r.title for r in catalog.suggestions(rows, "title", "x").collect()] == ["x"]
    moved = catalog.next_states(spark.createDataFrame([("pending", "extracted"), ("ready", "failed")], "status string, event string"), "status", "event")
    assert [r.next_status for r in moved.collect()] == ["ready", "ready"]


def test_ordinals_are_gapless(spark):
    from lexmill.functions.ordinals import gapless

    rows = spark.range(1000).selectExpr("id", "IF(id < 700, NULL, id % 3) AS key")
    got = gapless(rows, ["key"], ["id"], ["id"]).toPandas()
    for _, part in got.groupby(got.key.fillna(-1)):
        assert sorted(part.ordinal) == list(range(len(part)))
    assert sorted(r.ordinal for r in gapless(rows, [], ["id"], ["id"]).collect()) == list(range(1000))


def test_a_model_scores_pairs_in_batches(spark):
    """Loaded once a task, sixteen pairs at a time, of like lengths; scores come back to their rows, and null is empty."""
    from lexmill.operators import ranking

    def load():
        seen = []

        def model(pairs):
            seen.append(len(pairs))
            assert len(pairs) <= 16 and all(q == "asked" for q, _ in pairs)
            return [len(t) + len(seen) / 1000 for _, t in pairs]

        return model

    rows = spark.createDataFrame([(i, None if i == 7 else "x" * (i * 37 % 50)) for i in range(50)], "i long, t string").coalesce(1)
    got = {r.i: r.s for r in rows.withColumn("s", ranking.model_score(F.col("t"), "asked", load)).collect()}
    assert [int(got[i]) for i in range(50)] == [0 if i == 7 else i * 37 % 50 for i in range(50)]
    assert max(round(s % 1 * 1000) for s in got.values()) == 4
    best = ranking.rerank(rows.withColumn("score", F.lit(0.0)), 2, lambda t: ranking.model_score(t, "asked", lambda: lambda pairs: [len(t) / 10 for _, t in pairs]), "t", None, "score", "i").collect()
    assert [len(r.t) for r in best] == [49, 48]


def test_grades_of_topics_give_what_grades_of_queries_do(spark):
    """A query leaves its own document out; queries without a topic, or with one that has no documents, have no relevant ones."""
    topics = {i: (None if i == 9 else "few" if i in (3, 4) else "none" if i == 5 else "ab"[i % 2]) for i in range(40)}
    graded = [(topics[d], d, d % 3) for d in range(40) if d != 5] + [("a", 2, 1)]
    asked = [(q, topics[q], q) for q in range(0, 12)] + [(100, "none", None)]
    run = [(q, (7 * q + 3 * r) % 40, r) for q, _, _ in asked for r in range(1, 9)]
    by_topic = spark.createDataFrame(graded, "topic string, doc_id long, grade int")
    asked_of = spark.createDataFrame(asked, "query_id long, topic string, without long")
    by_query = spark.createDataFrame([(q, d, g) for q, t, w in asked for u, d, g in graded if t and t == u and d != w], "query_id long, doc_id long, grade int")
    runs = spark.createDataFrame(run, "query_id long, doc_id long, rank long")
    rows = lambda found: {r.query_id: [round(x, 9) for x in r[1:]] for r in found.collect()}
    for k in (1, 3, 5):
        want = rows(quality.retrieval_metrics(runs, by_query, k))
        assert rows(quality.retrieval_metrics(runs, by_topic, k, asked=asked_of)) == want and len(want) == 13


def test_postings_are_made_of_few_tokens_at_once(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(search_index, "MOST_TOKENS", 5)
    lists = [["a", "b"], [], ["c"] * 9, ["a"] * 3, ["b"] * 2, [], ["d"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([0] * 7), pa.array(lists, pa.list_(pa.string()))], names=["id", "salt", "tokens"])
    parts = list(search_index._few_tokens([batch, batch.slice(2, 4)]))
    assert [p.column(2).to_pylist() for p in parts[:4]] == [lists[:2], lists[2:3], lists[3:6], lists[6:]]
    assert [x for p in parts for x in p.column(0).to_pylist()] == [*range(7), 2, 3, 4, 5]
    made = [r for p in search_index._postings([], 1.0)([batch]) for r in p.to_pylist()]
    assert sorted((r["term"], r["id"], r["tf"]) for r in made if r["term"]) == [("a", 0, 1), ("a", 3, 3), ("b", 0, 1), ("b", 4, 2), ("c", 2, 9), ("d", 6, 1)]


def test_ranges_grow_with_the_documents(spark):
    assert [search_index._ranges(spark, n) for n in (1, 1000, 10_000, 400_000)] == [1, 3, 4, 100]


def test_postings_are_shuffled_as_lists(spark, tmp_path):
    """A row for each term and task, not one for each posting, and none for a task's share of the text."""
    docs = spark.range(0, 3000, numPartitions=2).select(F.col("id").alias("doc_id"), F.lit("one two three four two").alias("text"))

    def records() -> int:
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = records()
    index = search_index.build_index(docs, str(tmp_path / "index"))
    assert records() - before < 6000  # 15,000 postings, and the documents dealt out
    found = index.blocks().filter("term = 'two'").selectExpr("sum(n)", "min(tfs[0])", "max(array_max(tfs))", "min(to_json(positions[0]))").first()
    assert tuple(found) == (3000, 2, 2, "[1,4]") and index.documents == 3000


def test_blocks_of_a_term_hold_its_best_postings_first_over_all_batches(monkeypatch):
    import pyarrow as pa

    names = ["range", "term", "id", "length", "tf", "positions"]
    rows = [(1, t, i, 40, 1 + (7 * i) % 5, list(range(1 + (7 * i) % 5))) for t in ("a", "b", "c") for i in range(300 if t == "b" else 3)]
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
    postings = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    monkeypatch.setattr(search_index, "LISTED", 50)
    lists = [r for p in search_index._in_lists(postings.slice(i, 20) for i in range(0, len(rows), 20)) for r in p.to_pylist()]
    assert len(lists) < 12 and sum(len(r["ids"]) for r in lists) == len(rows)
    lists.sort(key=lambda r: r["term"])
    sent = pa.RecordBatch.from_pylist(lists, schema=pa.schema([("range", pa.int32()), ("term", pa.string()), ("ids", pa.list_(pa.int64())), *[(c, pa.list_(pa.int32())) for c in ("lengths", "tfs", "places")]]))
    for held, sizes in ((1_000_000, [3, 256, 44, 3]), (60, None)):
        monkeypatch.setattr(search_index, "MOST_HELD", held)
        blocks = [r for p in search_index._in_blocks(40.0)(sent.slice(i, 2) for i in range(0, len(sent), 2)) for r in p.to_pylist()]
        assert sizes is None or [b["n"] for b in blocks] == sizes
        back = sorted((b["term"], *x) for b in blocks for x in zip(b["ids"], b["lengths"], b["tfs"], map(tuple, b["positions"]), strict=True))
        assert back == sorted((t, i, n, tf, tuple(p)) for _, t, i, n, tf, p in rows)
        assert all(b["tfs"] == sorted(b["tfs"], reverse=True) and b["top"] == pytest.approx(search_index.impact(b["tfs"][0], 40, 40.0)) for b in blocks)


def test_postings_of_ids_that_do_not_repeat_are_not_shuffled(spark):
    rows = [(i, text) for i, text in enumerate(TEXTS)]

    def found(rows, how):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return how(df), sorted(((r.term, r.doc_id, r.tf, r.positions) for r in how(df).collect()), key=str)

    made, got = found(rows, search_index.inverted)
    assert got == found(rows, fulltext.postings)[1] and ("cat", 3, 3, [1, 2, 3]) in got
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    # rows of one id, and those without, are one document
    odd = [*rows, (3, "cat new"), (None, "cat"), (None, "a cat"), (9, "cat")]
    assert found(odd, search_index.inverted)[1] == found(odd, fulltext.postings)[1]
    assert found([], search_index.inverted)[1] == []


def test_lists_are_packed_for_the_shuffle():
    """And come back the same, also from parts of a batch and from an empty one."""
    import pyarrow as pa

    rows = [(i, f"t{i}", [f"d{i}"] * i, [-i] * i, [i, 1 << 30][:i], list(range(3 * i))) for i in range(5)]
    kinds = (pa.int32(), pa.string(), pa.list_(pa.string()), *[pa.list_(pa.int32())] * 3)
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["range", "term", "ids", "lengths", "tfs", "places"])
    for part in (batch, batch.slice(2), batch.slice(1, 3), batch.slice(0, 1), batch.slice(0, 0)):
        packed = search_index._packed(part)
        assert [pa.types.is_binary(c.type) for c in packed.columns] == [False] * 3 + [True] * 3
        assert search_index._unpacked(packed).to_pylist() == part.to_pylist()
        assert search_index._unpacked(packed.slice(1)).to_pylist() == part.slice(1).to_pylist()


def test_texts_of_tokens_are_the_tokens(spark):
    texts = [None, "", "  ", "..", "One, two  three.", "İstanbul\tÉtÉ ΣΑΣ\n", "x\x00y", "日本 ½ a_b", "  lead and end "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    want = {r.id: r.tokens for r in rows.select("id", fulltext.unfolded(F.col("text")).alias("tokens")).collect()}
    made = rows.select("id", F.lit(0).alias("salt"), fulltext.unfolded_text(F.col("text")).alias("tokens")).toArrow().to_batches()
    assert {r["id"]: r["tokens"] for b in made for r in search_index._tokens(b).to_pylist()} == want
    assert fulltext.all_folded(["été", "", "x", "İ"]) == [fulltext.folded(t) for t in ("été", "", "x", "İ")] and fulltext.all_folded([]) == []
