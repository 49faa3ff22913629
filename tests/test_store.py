"""Commits over several tables, and the full-text index in segments: crashes, two writers, what is written, and what is read."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill import session
from lexmill.engine import Library
from lexmill.operators import fulltext, search_index
from lexmill.sources import store as stores
from lexmill.sources.store import Conflict, Store, Table

ROW = "doc_id long, text string"


@pytest.fixture
def store(spark):
    return Store(spark, session.scratch_path(spark, "store"))


def rows_of(store, state=None):
    return sorted(tuple(r) for r in store.read(state or store.state(), "t", ROW, "doc_id").collect())


def put(store, rows):
    df = store.spark.createDataFrame(rows, ROW)
    return store.change(lambda s: {"t": store.upsert(s, "t", df, "doc_id")})


def test_rows_of_every_version(spark, store):
    assert store.state().version == 0 and rows_of(store) == []
    put(store, [(1, "a"), (2, "b")])
    first = store.state()
    put(store, [(2, "B"), (3, None)])
    store.change(lambda s: {"t": store.without(s, "t", spark.createDataFrame([(1,), (9,), (None,)], "doc_id long"), "doc_id")})
    assert rows_of(store) == [(2, "B"), (3, None)] and rows_of(store, first) == [(1, "a"), (2, "b")]
    put(store, [(1, "again")])
    assert rows_of(store) == [(1, "again"), (2, "B"), (3, None)]
    assert store.change(lambda s: None).version == 4 and store.versions() == [1, 2, 3, 4]


def test_second_writer_does_its_work_again(store):
    put(store, [(1, "a")])
    seen = []

    def work(state):
        seen.append(state.version)
        if len(seen) == 1:  # another one is faster
            put(Store(store.spark, store.path), [(2, "b")])
        return {"t": store.upsert(state, "t", store.spark.createDataFrame([(3, f"after {state.version}")], ROW), "doc_id")}

    store.change(work)
    assert seen == [1, 2] and rows_of(store) == [(1, "a"), (2, "b"), (3, "after 2")]
    with pytest.raises(Conflict):
        store.commit(store.state(1), {"t": Table()})
    assert len(rows_of(store)) == 3


def test_newer_schema_is_refused(store, monkeypatch):
    monkeypatch.setattr(stores, "SCHEMA", 3)
    put(store, [(1, "a")])
    monkeypatch.setattr(stores, "SCHEMA", 2)
    with pytest.raises(stores.UnknownSchema):
        store.state()


def test_parts_are_merged(store, monkeypatch):
    """After many changes there are few parts and lists, the rows are those of a plain table, and old folders go."""
    monkeypatch.setattr(stores, "KEPT", 2)
    want, chance = {}, random.Random(0)
    for turn in range(9):
        rows = [(chance.randrange(12), f"{turn}") for _ in range(2)]
        want |= dict(rows)
        put(store, list(dict(rows).items()))
        store.change(lambda s: None if (t := store.merged(s, "t", ROW, "doc_id")) is None else {"t": t})
    table = store.state().table("t")
    assert rows_of(store) == sorted(want.items()) and len(table.parts) <= 2 * stores.FANOUT and len(table.gone) <= stores.LISTS
    assert len(store.versions()) == 2
    files, place = session.files(store.spark, f"{store.path}/t")
    held = {p.path for v in store.versions() for p in store.state(v).table("t").parts}
    assert {f"t/{f.getPath().getName()}" for f in files.listStatus(place)} == held


class Stop(Exception):
    pass


def test_a_crash_at_any_step_leaves_the_state_before_or_after(spark, monkeypatch):
    """Embedding writes chunks, vectors, index and states: it is stopped at each write in turn."""
    lib = Library(spark, session.scratch_path(spark, "library"), dim=16)
    body = " and the rest of the text goes on and on, so that it is long enough to be taken as it is."
    lib.add(spark.createDataFrame([(f"/in/{i}.md", f"# T{i}\nword{i} common" + body, f"Key{i}", '{"type":"book","title":"T","author":[{"family":"F"}]}') for i in range(3)], "original_path string, text string, citekey string, csl_json string"))
    one = lib.documents.orderBy("citekey").first().doc_id
    lib.update(lib.documents.filter(F.col("doc_id") == one).selectExpr("doc_id", "'failed' AS status"))
    lib.embed()
    before = lib.store.state()
    lib.update(spark.createDataFrame([(one, "ready")], "doc_id string, status string"))
    ready = lib.store.state()
    whole, steps, stopped = Store.put, [], 0
    for at in (0, 2, 4, 5, 9):

        def stopping(self, base, name, rows, at=at):
            if len(steps) == at:
                raise Stop(name)
            steps.append(name)
            return whole(self, base, name, rows)

        steps.clear()
        monkeypatch.setattr(Store, "put", stopping)
        try:
            lib.embed()
        except Stop:
            pass
        now = Library(spark, lib.store.path, dim=16)
        if now.store.state().version > ready.version:  # it was done, and stopped while small parts were merged, or not at all
            break
        stopped += 1
        assert now.store.state() == ready and now.chunks.count() == 2 and now.index.documents == 2
        assert now.search("common", 5, "fts").count() == 2
    monkeypatch.setattr(Store, "put", whole)
    assert stopped >= 3 and before.version < ready.version
    now = Library(spark, lib.store.path, dim=16)
    assert now.chunks.count() == now.index.documents == now.search("common", 5, "fts").count() == 3 and now.embed().count() == 0


# the index

WORDS = "alpha beta gamma delta epsilon zeta eta theta".split()


def random_docs(chance, ids):
    return [(i, " ".join(chance.choice(WORDS[: 1 + chance.randrange(8)]) for _ in range(chance.randrange(30))) or None) for i in ids]


QUERIES = ["alpha theta", "beta beta eta nothing", '"alpha alpha" th*']


@pytest.mark.parametrize("prune", [1, 10**9])
def test_hits_are_those_of_a_new_index(spark, store, monkeypatch, prune):
    """After adds, changes, removals and merges, with tiny blocks, and with a bound or without."""
    monkeypatch.setattr(search_index, "BLOCK", 4)
    monkeypatch.setattr(search_index, "PRUNE_FROM", prune)
    monkeypatch.setattr(search_index, "LEAST_RANGE", 20)
    chance, held = random.Random(1), {}
    for turn in range(4):
        rows = dict(random_docs(chance, chance.sample(range(300), 120 if turn == 0 else 20)))
        old = [(i, held[i]) for i in rows if i in held] + ([] if turn % 2 else [(i, held[i]) for i in chance.sample(sorted(held), min(5, len(held))) if i not in rows])
        new = spark.createDataFrame(list(rows.items()), ROW)

        def work(state, old=old, new=new):
            tables = search_index.removed(store, state, "index", spark.createDataFrame(old, ROW)) if old else {}
            return tables | {"index": tables.get("index", state.table("index")).plus(search_index.segment(store, state, "index", new))}

        store.change(work)
        for i, _ in old:
            held.pop(i)
        held |= rows
        store.change(lambda s: search_index.merged(store, s, "index"))
    index = search_index.opened(store)
    plain = search_index.build_index(spark.createDataFrame(list(held.items()), ROW), session.scratch_path(spark, "plain"))
    assert index.documents == plain.documents == len(held) and index.mean_length == pytest.approx(plain.mean_length)
    within = spark.createDataFrame([(i,) for i in held if i % 3], "doc_id long")
    for query in QUERIES:
        for narrow in (None, within)[: 1 + (query == "alpha theta")]:
            got, want = [[(r.doc_id, round(r.bm25, 9)) for r in search_index.bm25(x, query, 7, narrow).collect()] for x in (index, plain)]
            assert got == want, query


def test_a_small_change_writes_little(spark, store):
    """Adding 1 % of the documents writes about 1 % of the index, whatever stands there."""
    chance = random.Random(2)
    docs = [(i, " ".join(f"w{chance.randrange(3000)}" for _ in range(60))) for i in range(6060)]
    bytes_of = lambda p: session.files(spark, f"{store.path}/{p.path}")[0].getContentSummary(session.files(spark, f"{store.path}/{p.path}")[1]).getLength()
    store.change(lambda s: search_index.added(store, s, "index", spark.createDataFrame(docs[:6000], ROW)))
    store.change(lambda s: search_index.added(store, s, "index", spark.createDataFrame(docs[6000:], ROW)))
    first, second = store.state().table("index").parts
    assert second.rows == 60 and bytes_of(second) <= 0.03 * bytes_of(first)
    assert search_index.opened(store).documents == 6060


def test_a_frequent_word_reads_a_tenth(spark, monkeypatch):
    monkeypatch.setattr(search_index, "PRUNE_FROM", 1)
    monkeypatch.setattr(search_index, "BLOCK", 64)
    chance = random.Random(3)
    docs = spark.createDataFrame([(i, "common " * chance.randrange(1, 12) + " ".join(f"w{chance.randrange(500)}" for _ in range(chance.randrange(5, 80)))) for i in range(6000)], ROW)
    index = search_index.build_index(docs, session.scratch_path(spark, "frequent"))
    for query in ("common", "common w17"):
        asked = fulltext.operands(fulltext.sanitize(query))
        plan = search_index.plan(index, asked, 10)
        whole = search_index.Plan(plan.weights, dict.fromkeys(plan.weights, 0.0))
        read, held = [p.blocks(index).agg(F.sum("n")).first()[0] for p in (plan, whole)]
        got, want = [[(r.id, round(r.score, 9)) for r in p.scored(index, asked, None).orderBy(F.desc("score"), "id").limit(10).collect()] for p in (plan, whole)]
        assert got == want and (read <= held / 10 or query != "common")


def test_a_prefix_reads_the_files_of_its_range(spark, monkeypatch):
    monkeypatch.setattr(search_index, "LEAST_RANGE", 50)
    monkeypatch.setattr(session, "n_partitions", lambda spark: 8)
    docs = spark.createDataFrame([(i, " ".join(f"{a}{(i * 7 + k) % 50}" for k, a in enumerate("abcdefghijklmnop"))) for i in range(600)], ROW)
    index = search_index.build_index(docs, session.scratch_path(spark, "prefix"))
    asked = fulltext.operands(["c1*"])
    wanted = {("c1", True)}
    some, every = index.blocks(index.ranges_of(wanted)), index.blocks()
    assert 1 <= len(some.inputFiles()) <= 3 < len(every.inputFiles())
    assert some.filter("term LIKE 'c1%'").count() == every.filter("term LIKE 'c1%'").count() > 0
    want = {i for i in range(600) if str((i * 7 + 2) % 50).startswith("1")}
    assert {r.doc_id for r in search_index.bm25(index, asked, 1000).collect()} == want


def test_stored_rows_that_no_new_one_repeats_are_not_shuffled(spark):
    """A filter of the new keys leaves all stored rows that match and few others; nulls, repeats and an empty side are as in a join."""
    from lexmill.operators import catalog

    stored = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("p"), "id").alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    stored = stored.union(spark.createDataFrame([(-1, None, None), (-2, "p7", None)], "doc_id long, path string, digest string"))
    new = spark.createDataFrame([("p7", "x"), ("q", None), (None, "y"), ("p39999", None), ("p39999", None)], "path string, digest string")
    left = catalog.may_match(stored, "path", new, "path")
    assert {(7, "p7"), (-2, "p7"), (39_999, "p39999")} <= {(r.doc_id, r.path) for r in left.collect()} and left.count() < 2_000
    many = spark.range(0, 80_000, 2).select(F.concat(F.lit("p"), "id").alias("path"))
    kept = catalog.may_match(stored, "path", many, "path")
    assert kept.join(many, "path").count() == stored.join(many, "path").count() == 20_000 and kept.count() < 23_000
    assert catalog.may_match(stored, "path", new.limit(0), "path").count() == 0
    numbers = spark.createDataFrame([(3,), (5,)], "k int")
    assert {3, 5} <= {r.doc_id for r in catalog.may_match(stored, "doc_id", numbers, "k").collect()}
    found = {(r.path, r.digest): (r.reason, r.stored_key) for r in catalog.duplicate_reason(new, stored, "path", "digest", "doc_id").collect()}
    assert found == {("p7", "x"): ("path", -2), ("q", None): (None, None), (None, "y"): (None, None), ("p39999", None): ("path", 39_999)}


def test_filter_is_given_up_beyond_its_bound(spark, monkeypatch):
    from lexmill.operators import catalog

    monkeypatch.setattr(catalog, "MOST_BLOCKS", 1)
    rows = spark.range(10).withColumnRenamed("id", "k")
    assert catalog.may_match(rows, "k", spark.range(5), "id").count() == 10
