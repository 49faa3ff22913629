import pytest
from pyspark.sql import functions as F
import hashlib
import json
import sqlite3

from lexmill.sources import files, records, sqlite
from lexmill.streaming import ingest


def test_files_are_hashed_and_placed(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"one")
    (tmp_path / "b").write_bytes(b"x")
    rows = {r.original_path.rsplit("/", 1)[-1]: r for r in files.acquire(spark, str(tmp_path), "s").collect()}
    digest = hashlib.sha256(b"one").hexdigest()
    assert rows["a.PDF"].storage_path == f"s/{digest[:2]}/{digest[2:4]}/{digest}.pdf" and rows["a.PDF"].mime_type == "application/pdf"
    assert rows["b"].mime_type == "application/octet-stream"


def test_front_matter(spark):
    texts = ["---\nbibliography: a.json\n---\nx", "---\ntitle: t\nbibliography: [b.json, c.json]\n---", "---\nbibliography:\n  - 'd.json'\n  - e\n---", "none", "---\ntitle: x\n---"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(files.front_matter_entry(df.t)).collect()] == ["a.json", "b.json", "d.json", None, None]


def test_records_last_key_stays(spark, tmp_path):
    items = [{"id": "x", "title": "old"}, {"id": "x", "title": "new", "issued": {"date-parts": [[2020, "5"]]}}, {"id": "y", "citation-key": "k", "type": "book"}]
    (tmp_path / "l.json").write_text(json.dumps(items))
    rows = {r.key: r for r in records.csl_records(spark, str(tmp_path / "l.json")).collect()}
    assert set(rows) == {"x", "k"} and rows["x"].title == "new" and rows["x"].issued["date-parts"] == [["2020", "5"]]


def test_regions(spark):
    text = "a\n<!-- feature:table-x id:t1 -->\n|1|\n<!-- /feature -->\nb\n<!-- feature:list id:l1 -->\nopen"
    df = spark.createDataFrame([(1, text), (2, "")], "k int, t string")
    assert [tuple(r) for r in records.regions(df, "k", "t").collect()] == [(1, 0, "table-x", "t1", "|1|")]
    assert df.filter("k = 1").select(records.without_annotations(df.t)).first()[0] == "a\n|1|\nb\nopen"


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (a INTEGER PRIMARY KEY, b TEXT, c REAL)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, None if i == 3 else f"v{i}", i / 2) for i in range(1, 11)])
    sqlite.register(spark)
    df = spark.read.format("sqlite").option("path", path).option("table", "t").option("partitions", 3).load()
    assert df.dtypes == [("a", "bigint"), ("b", "string"), ("c", "double")]
    assert sorted(tuple(r) for r in df.collect()) == [(i, None if i == 3 else f"v{i}", i / 2) for i in range(1, 11)]


def test_ingest_takes_each_content_once(spark, tmp_path):
    source, store, check = (str(tmp_path / n) for n in ("in", "store", "check"))
    long = "A sentence that is long enough. " * 10
    for rows in ([(1, long), (2, long), (3, "x")], [(4, long), (5, long + "!")]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
        ingest.ingest(spark, source, store, check, "doc_id long, text string").awaitTermination(60)
    got = sorted((r.doc_id, r.status) for r in spark.read.parquet(store).collect())
    assert got == [(1, "ready"), (3, "needs_review"), (5, "ready")]
    # the store isn't read: its rows may be elsewhere by then; nulls and rows without an id are contents as all others
    away = str(tmp_path / "elsewhere")
    spark.createDataFrame([(None, long), (None, None), (7, ""), (None, "new"), (8, "new")], "doc_id long, text string").write.mode("append").parquet(source)
    ingest.ingest(spark, source, away, check, "doc_id long, text string").awaitTermination(60)
    assert sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{away}/part-*").collect()) == [(7, ""), (8, "new")]


@pytest.mark.parametrize("folder", [False, True])
def test_ingested_takes_a_table_of_one_file_or_of_many(spark, tmp_path, folder):
    from lexmill.plans import records as plans

    rows = [(i, f"text {i % 7}") for i in range(20)]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if folder:
        made.write.parquet(f"{tmp_path}/sf/documents.parquet")
    else:
        made.coalesce(1).write.parquet(f"{tmp_path}/one")
        (tmp_path / "sf").mkdir()
        next((tmp_path / "one").glob("*.parquet")).rename(tmp_path / "sf" / "documents.parquet")
    assert sorted(r.doc_id for r in plans.ingested(spark, f"{tmp_path}/sf").collect()) == list(range(7))


def test_ingest_goes_on_after_a_stop(spark, tmp_path):
    """A run that fails in the middle of a batch leaves no rows and no state behind; the next one takes all."""
    source, store, check = (str(tmp_path / n) for n in ("in", "store", "check"))
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string").write.parquet(source)
    stream = ingest.once(ingest.prepare(spark.readStream.schema("doc_id long, text string").parquet(source)), "doc_id")
    broken = stream.withColumn("text", F.when(F.col("text") == "b", F.raise_error(F.lit("stopped"))).otherwise(F.col("text")))
    writer = broken.writeStream.format("parquet").option("path", store).option("checkpointLocation", check).trigger(availableNow=True)
    with pytest.raises(Exception, match="stopped"):
        writer.start().awaitTermination(120)
    ingest.ingest(spark, source, store, check, "doc_id long, text string").awaitTermination(120)
    assert sorted((r.doc_id, r.text) for r in spark.read.parquet(store).collect()) == [(1, "a"), (2, "b")]


def test_extract(spark):
    from lexmill.sources import extract

    rows = [("a.txt", b"word " * 30), ("b.HTML", b"<style>x</style><p>A &amp; B</p><p>c</p>"), ("c.txt", b"\xff"), ("d.pdf", b"%PDF"), ("e.txt", None), (None, b"x")]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {r.path: r for r in extract.extract(df).collect()}
    assert got["a.txt"].status == "ready" and got["b.HTML"].text == "A & B\nc" and got["b.HTML"].status == "needs_review"
    assert got["c.txt"].error.startswith("UnicodeDecodeError") and got["d.pdf"].status == "failed" and got["e.txt"].text == "" and got[None].status == "failed"
    mine = extract.extract(df.filter("path = 'd.pdf'"), [((".pdf",), lambda data: "pdf " * 50), *extract.DEFAULTS]).first()
    assert mine.status == "ready" and mine.error is None


def test_extractors_that_hang_crash_and_leak(spark):
    """Each costs its own file only: the process is killed or ends, the others' texts come, and fall-backs are asked."""
    from lexmill.sources import extract

    def plug_in(data):
        import os
        import time

        if data == b"hang":
            time.sleep(600)
        if data == b"crash":
            os._exit(3)
        if data == b"leak":
            held = []
            while True:
                held.append(bytearray(1 << 24))
        if data == b"bad":
            raise ValueError("no good")
        return None if data == b"none" else f"{os.getpid()} " + data.decode() * 30

    kinds = ["hang", "crash", "leak", "bad", "none", "fine one ", "fine two ", "fine three "]
    rows = [(f"{i}-{k.strip()}.pdf", k.encode()) for i, k in enumerate(kinds)] + [("x.zip", b"z"), ("hang.pdx", b"hang")]
    df = spark.createDataFrame(rows, "path string, content binary").coalesce(1)
    handlers = [((".pdf", ".pdx"), plug_in), *extract.DEFAULTS]
    got = {r.path: r for r in extract.extract(df, handlers, 1.5, [((".pdf",), lambda data: "plain " * 30)], 1 << 28).collect()}
    ways = {p: (r.way, r.status, r.error) for p, r in got.items()}
    assert ways["0-hang.pdf"] == ("fallback", "ready", "no text within 1.5 seconds")
    assert ways["1-crash.pdf"] == ("fallback", "ready", "the extractor's process ended with code 3")
    assert ways["2-leak.pdf"][:2] == ("fallback", "ready") and ways["2-leak.pdf"][2].startswith("MemoryError")
    assert ways["3-bad.pdf"] == ("fallback", "ready", "ValueError: no good") and ways["4-none.pdf"] == ("fallback", "ready", "no text")
    assert ways["x.zip"] == (None, "failed", "no extractor takes this kind of file") and ways["hang.pdx"] == (None, "failed", "no text within 1.5 seconds")
    fine = [got[f"{i}-{k.strip()}.pdf"] for i, k in enumerate(kinds) if i > 4]
    assert all(r.way == "extractor" and r.status == "ready" and r.error is None for r in fine)
    assert len({r.text.split()[0] for r in fine}) == 1  # one process for all of them


def test_crash_is_tried_again_and_processes_are_renewed(spark, tmp_path):
    from lexmill.sources import extract

    mark = str(tmp_path / "mark")

    def once(data):
        import os

        if not os.path.exists(mark):
            open(mark, "w").close()
            os._exit(9)
        return f"{os.getpid()} " + "text " * 30

    df = spark.createDataFrame([(f"{i}.a", b"x") for i in range(6)], "path string, content binary").coalesce(1)
    got = {r.path: r for r in extract.extract(df, [((".a",), once)], 20, renewed=2).collect()}
    assert got["0.a"].way == "retry" and got["0.a"].error.endswith("code 9") and all(got[f"{i}.a"].way == "extractor" for i in range(1, 6))
    assert len({r.text.split()[0] for r in got.values()}) == 3


def test_extracted_pages(spark):
    from lexmill.plans import registry
    from lexmill.sources import extract

    sf_dir = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        make = extract.DEFAULTS[1][1]
        want[r.url + (".page" if r.page_id % 7 == 0 else ".html")] = (hashlib.sha256(make((r.html or "").encode()).encode()).hexdigest(), "fallback" if r.page_id % 7 == 0 else "extractor")
    assert {r.path: (r.text_sha256, r.way) for r in registry.QUERIES["extracted_pages"](spark, sf_dir).collect()} == want


def _database(path):
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (a INTEGER PRIMARY KEY, b TEXT COLLATE NOCASE, c REAL, d NUMERIC)")
        texts = ["abc", "ABC", "", None, "a%c", "ümlaut", "zabc", "abcd"]
        db.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(3 * i - 20, texts[i % 8], None if i % 5 == 0 else i / 4, str(i)) for i in range(40)])
        db.execute("CREATE TABLE w (k TEXT, j INTEGER, v TEXT, PRIMARY KEY (k, j)) WITHOUT ROWID")
        db.executemany("INSERT INTO w VALUES (?, ?, ?)", [(f"k{i % 7}", i, f"v{i}") for i in range(50)])
        db.execute("CREATE VIEW s AS SELECT a, b FROM t")
        db.execute("CREATE TABLE r (rowid TEXT, x INTEGER)")
        db.executemany("INSERT INTO r VALUES (?, ?)", [("same", i) for i in range(9)])


def test_sqlite_filters_are_pushed_and_give_what_spark_gives(spark, tmp_path):
    path = str(tmp_path / "x.db")
    _database(path)
    sqlite.register(spark)
    df = spark.read.format("sqlite").option("path", path).option("table", "t").option("partitions", 3).load()
    held = spark.createDataFrame(df.collect(), df.schema)
    assert held.count() == 40
    pushed = ["a = 4", "a <=> 4", "a > 10 AND a <= 61", "a IN (1, 4, 7, 9)", "b = 'abc'", "b <> 'abc'", "b >= 'abc'", "b < 'ab'", "b LIKE 'ab%'", "b LIKE '%bc'", "NOT b LIKE '%bc'", "contains(b, '%')", "b IS NULL", "b IS NOT NULL AND c < 2.5", "NOT a IN (1, 4)", "startswith(b, 'ü')", "c = 2.5", "c >= 9"]
    for asked in pushed:
        got = df.filter(asked)
        assert sorted(map(str, got.collect())) == sorted(map(str, held.filter(asked).collect())), asked
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert ") Filter " not in plan, asked  # all is decided by the scan
    for asked in ["d = '7'", "d > '3'", "b = '' OR a = 4", "upper(b) = 'ABC'", "startswith(b, '')", "c = double('NaN')", "a IN (" + ",".join(map(str, range(600))) + ")"]:
        assert sorted(map(str, df.filter(asked).collect())) == sorted(map(str, held.filter(asked).collect())), asked
        assert ") Filter " in df.filter(asked)._jdf.queryExecution().executedPlan().toString(), asked


def test_sqlite_tables_without_row_ids_and_pruned_columns(spark, tmp_path):
    path = str(tmp_path / "x.db")
    _database(path)
    sqlite.register(spark)
    read = lambda table, parts=4: spark.read.format("sqlite").option("path", path).option("table", table).option("partitions", parts)
    w = read("w").load()
    assert w.rdd.getNumPartitions() == 4 and sorted(r.j for r in w.collect()) == list(range(50))
    assert sorted(r.j for r in w.filter("k = 'k3' AND j > 20").collect()) == [24, 31, 38, 45]
    assert read("s").load().count() == 40 and sorted(r.x for r in read("r").load().collect()) == list(range(9))
    only = read("t").schema("b string").load()
    assert only.columns == ["b"] and only.filter("b = 'ABC'").count() == 5
    assert len(sqlite.SqliteReader({"path": path, "table": "w", "partitions": "20"}, w.schema).partitions()) <= 8  # no more than the values of the key's first column


def test_files_are_copied_into_the_store_once(spark, tmp_path):
    """Empty files and copies too; what is there stays, and half a file of another run is replaced."""
    source, base = tmp_path / "in", tmp_path / "store"
    source.mkdir()
    held = {"a.txt": b"one", "b.TXT": b"one", "c.pdf": bytes(range(256)) * 500, "empty.md": b"", ".hidden": b"", "_x": b"y"}
    for name, data in held.items():
        (source / name).write_bytes(data)
    rows = files.store(spark, str(source), str(base)).collect()
    assert sorted(r.original_path.rsplit("/", 1)[-1] for r in rows) == ["a.txt", "b.TXT", "c.pdf", "empty.md"]
    for r in rows:
        data = held[r.original_path.rsplit("/", 1)[-1]]
        path = r.storage_path.removeprefix("file:").replace("//", "/")
        assert open(path, "rb").read() == data and r.length == len(data) and r.content_hash == hashlib.sha256(data).hexdigest()
    assert len([p for p in base.rglob("*") if p.is_file()]) == 3
    assert not any(r.copied for r in files.store(spark, str(source), str(base)).collect())
    big = next(r for r in rows if r.length == 128_000)
    open(big.storage_path.removeprefix("file:").replace("//", "/"), "wb").write(b"half")
    again = files.store(spark, str(source), str(base)).collect()
    assert [r.original_path.rsplit("/", 1)[-1] for r in again if r.copied] == ["c.pdf"]
    assert files.acquire(spark, str(source / "empty.md")).first().length == 0
