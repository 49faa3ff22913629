import re

import pytest
from pyspark.sql import functions as F

from lexmill.engine import Library
from lexmill.functions import sql
from lexmill.operators import catalog, titles


def one(spark, make, value):
    return spark.createDataFrame([(value,)], "c string").select(make(F.col("c"))).first()[0]


def test_title(spark):
    text = "Journal of X, vol. 3\n\n# Deep Learning For Cats And Dogs Today\n\nSome text that goes on here.\n"
    found = one(spark, titles.title, text)
    assert found.value == "Deep Learning For Cats And Dogs Today" and found.confidence == 1.0
    assert found.reasoning == "markdown header; first content; isolated line; good length; title case"
    assert one(spark, titles.title, "A single line title here").confidence == 0.68
    assert one(spark, titles.title, None).reasoning == "no text content to extract title from"
    assert one(spark, titles.title, "short").value is None


def test_headings(spark):
    found = one(spark, titles.headings, "# A\n```\n# no\n```\nx\n### B b ")
    assert [tuple(h) for h in found] == [(1, "A", 0), (3, "B b", 19)]


LONG = " The rest of the text goes on and on, so that it is long enough to be taken as it is."


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    lib = Library(spark, str(tmp_path_factory.mktemp("library")), dim=64)
    rows = [("/in/Doe - 2020 - Cats.md", "# Cats\nThe cat sat on the mat." + LONG, None, None), ("/in/b.md", "# Dogs\nA dog barks at night." + LONG, "Dog2021", '{"type":"book","id":"x","title":"Dogs","author":[{"family":"Roe","given":"R."}]}'), ("/in/copy.md", "# Cats\nThe cat sat on the mat." + LONG, None, None)]
    lib.said = {r.original_path: r for r in lib.add(spark.createDataFrame(rows, "original_path string, text string, citekey string, csl_json string")).collect()}
    lib.embedded = {r.doc_id: r for r in lib.embed().collect()}
    return lib


def test_library_takes_up_documents_once(spark, library):
    said = library.said
    assert {p: r.outcome for p, r in said.items()} == {"/in/Doe - 2020 - Cats.md": "added", "/in/b.md": "added", "/in/copy.md": "content"}
    assert said["/in/copy.md"].doc_id == said["/in/Doe - 2020 - Cats.md"].doc_id
    keys = {r.citekey: r for r in library.documents.collect()}
    assert keys["Dog2021"].source == "EXPLICIT" and keys["Dog2021"].authors == "Roe, R." and keys["Dog2021"].title == "Dogs"
    assert keys["Doe2020Cats"].source == "FILENAME" and keys["Doe2020Cats"].status == "needs_review" and "citekey would change" in keys["Doe2020Cats"].error_message


def test_library_search_and_answers(library):
    library.update(library.get("@Doe2020Cats").selectExpr("doc_id", "'ready' AS status"))
    library.embed()
    for mode in ("hybrid", "vector", "fts"):
        found = library.search("cat mat", 1, mode).first()
        assert found.citekey == "Doe2020Cats" and found.methods
    assert library.search("dog", 1, rerank=True).first().citekey == "Dog2021"
    dog = library.get("@Dog2021").first().doc_id
    assert [r.doc_id for r in library.search("cat mat night", 1, "fts", doc_ids=[dog]).collect()] == [dog]
    assert library.search("cat mat", 1, "vector", doc_ids=[dog]).count() == 0
    answer = library.ask("cat mat", lambda m, temperature: iter([m[1]["content"][:29], str(temperature)]), 1, mode="fts")
    assert answer.text == "Context:\n[@Doe2020Cats, §Cats" + "0.3" and len(answer.chunks) == 1
    with pytest.raises(catalog.ClientFailed):
        library.ask("cat mat", lambda m, t: 1 / 0, 1, mode="fts")
    with pytest.raises(catalog.CatalogError):
        library.search("x", 0)
    with pytest.raises(catalog.CatalogError):
        library.search("x", 1, "other")


def test_library_states(spark, library):
    """Only what waits is embedded; a failure stays pending; new text makes embeddings stale; deletion keeps other chunks."""
    dog = library.get("@Dog2021").first().doc_id
    assert library.embed().count() == 0
    library.reextract(spark.createDataFrame([(dog, "A dog sleeps." + LONG, None)], "doc_id string, text string, error string"))
    assert library.get("@Dog2021").first().embedding_status == "stale"

    class Failing:
        def __call__(self, text, dim):
            if "sleeps" in text:
                raise ValueError("no")
            return [1.0] * dim

    whole = library.embedder
    library.embedder = Failing()
    got = {r.doc_id: r.failed for r in library.embed().collect()}
    assert got == {dog: True} and library.get("@Dog2021").first().embedding_status == "pending"
    library.embedder = whole
    assert [(r.failed, r.chunks) for r in library.embed().collect()] == [(False, 1)]
    assert library.search("sleeps", 1, "fts").first().doc_id == dog
    kind, chunks = library.chunks_of("@Dog2021")
    assert kind == "whole" and chunks.count() == 1
    again = Library(spark, library.store.path, dim=64)
    assert again.documents.count() == 2 and again.search("sleeps", 1).first().doc_id == dog
    again.fail(spark.createDataFrame([("/in/lost.pdf", "gone", "missing"), ("/in/b.md", "gone", "missing")], "path string, error_message string, error_code string"))
    assert again.list(5, equals={"status": "failed"}).first().original_path == "/in/lost.pdf"
    again.delete(again.get("@Dog2021").select("doc_id"))
    assert again.documents.count() == 2 and {r.doc_id for r in again.chunks.select("doc_id").collect()} == {again.get("@Doe2020Cats").first().doc_id}
    with pytest.raises(catalog.NotFound) as why:
        again.get("@Doe2020Cat")
    assert why.value.details["suggestions"] == ["Doe2020Cats"]


def test_sql_functions(spark):
    sql.register(spark)
    assert tuple(spark.sql("SELECT token_estimate('123456789'), sigmoid(0D), section_path('a', '', 'c', NULL)").first()) == (2, 0.5, "a > c")
    assert [tuple(r) for r in spark.sql("SELECT * FROM chunks('# A\nx\n## B\ny')").collect()] == [(0, "A", "# A\nx"), (1, "A > B", "## B\ny")]


def test_headings_against_a_loop(spark):
    def plain(text):
        out, at, fenced = [], 0, False
        for line in text.split("\n"):
            fence, mark = bool(re.match("```|~~~", line.strip(" "))), re.match(r"(#{1,6})\s+\S", line)
            if mark and not fenced and not fence:
                out.append((len(mark[1]), re.sub(r"^#{1,6}\s+", "", line).strip(" "), at))
            at, fenced = at + len(line) + 1, fenced ^ fence
        return out

    texts = ["", "# A\n```\n# no\n```\n## B c \nx\n~~~\n# n", "#x\n####### y\n###### z\n#  q", "\n\n# \n# a" * 400, "  ```\n# x\n```\n# y", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("t", titles.headings(df.t).alias("h")).collect():
        assert (r.h is None) if r.t is None else [tuple(x) for x in r.h] == plain(r.t)
