import json

import pytest
from pyspark.sql import functions as F

from lexmill.operators import accuracy, catalog, output


def test_markdown_and_json(spark):
    rows = spark.createDataFrame([(1, "K", "T", "d1", 0.5, "S", 0, "x" * 301), (2, None, None, "0123456789", 0.25, None, 3, "a\nb")], "rank long, citekey string, title string, doc_id string, score double, section string, chunk_index int, text string")
    want = "### Results (2 chunks from 2 documents)\n\n1. **@K** | score: 0.500 | *T*\n   Section: S\n   Chunk 0\n   > " + "x" * 297 + "...\n\n2. **01234567** | score: 0.250\n   Chunk 3\n   > a\n   > b\n"
    assert output.results_markdown(rows).first().markdown == want
    assert json.loads(output.json_rows(rows, "rank", "citekey").orderBy("json").collect()[1].json) == {"rank": 2}


def test_csl_record(spark):
    df = spark.createDataFrame([("book", "T", ["Doe, Jane", "Jane van Doe", "WHO", "", None, "X,"], "2020"), (None, "", [], "n/a")], "k string, t string, a array<string>, y string")
    first, second = (json.loads(r[0]) for r in df.select(output.csl_record(F.col("k"), F.col("t"), F.col("a"), F.col("y"))).collect())
    assert first == {"type": "book", "title": "T", "author": [{"family": "Doe", "given": "Jane"}, {"family": "Doe", "given": "Jane van"}, {"literal": "WHO"}, {"literal": "X"}], "issued": {"date-parts": [[2020]]}}
    assert second == {"type": "article-journal"}


def test_accuracy(spark):
    rows = [(True, "A  Title", "a title", ["Doe, J."], ["Doe, Jane"], True), (True, "x", "a title", ["Roe, J."], ["Doe, Jane"], False), (False, None, "t", [], ["Doe, J"], False)]
    df = spark.createDataFrame(rows, "extracted boolean, t string, k string, a array<string>, b array<string>, year_ok boolean")
    df = df.withColumn("title_similarity", accuracy.title_similarity(F.col("t"), F.col("k"))).withColumn("authors_ok", accuracy.authors_match(F.col("a"), F.col("b")))
    r = accuracy.report(df).first()
    assert (r.documents, r.title_accuracy, r.author_accuracy, r.year_accuracy) == (3, 0.5, 0.5, 0.5) and r.extraction_rate == pytest.approx(2 / 3)


def test_text_pages(spark):
    chunks = spark.createDataFrame([(d, i, "S" if i % 2 else None, f"c{i}") for d, n in (("long", 60), ("short", 2)) for i in range(n)], "doc string, chunk_index long, section string, chunk_text string")
    asked = [("a", "short", 7, 9, "K", "T", "whole text"), ("b", "long", 1, 2, None, "T", None), ("c", "long", 58, None, None, "", None), ("d", "long", None, None, "K", None, None), ("e", "long", 60, 61, "K", None, None), ("f", "none", None, None, None, None, None), ("g", None, 0, 1, None, None, None)]
    asked = spark.createDataFrame(asked, "request string, doc string, start long, end long, citekey string, title string, text string")
    rows = output.text_pages(catalog.text_slices(chunks, asked, ["doc"]), ["request", "doc"]).collect()
    got = {r.request: (r.kind, r.markdown) for r in rows}
    assert got["a"] == ("whole", "## @K\n*2 chunks*\n\nwhole text")
    assert got["b"] == ("range", "## T\n*Chunks 1–2 of 60 total*\n\n### S\n*[Chunk 1]*\n\nc1\n\n*[Chunk 2]*\n\nc2\n")
    assert got["c"] == ("range", "## Document long\n*Chunks 58–59 of 60 total*\n\n*[Chunk 58]*\n\nc58\n\n### S\n*[Chunk 59]*\n\nc59\n")
    kind, text = got["d"]
    assert kind == "preview" and text.startswith("## @K\n*60 chunks total*\n\n### Sections\n- S\n\n### Preview (first 20 chunks)\n\n*[Chunk 0]*\n\nc0\n\n**S**\n*[Chunk 1]*\n\nc1\n") and "c20" not in text
    assert got["e"] == ("invalid", "Error: no chunks 60 to 61 of 60")
    assert got["f"] == ("none", "## Document none\n\nNo text content available for this document.")
    assert got["g"][0] == "none" and len(rows) == 7


def test_document_table(spark):
    schema = "place long, total long, citekey string, title string, authors string, status string, embedding_status string"
    rows = spark.createDataFrame([(2, 1234, None, None, None, "failed", None), (1, 1234, "K", "t" * 41, "a" * 26, "ready", "current")], schema)
    want = "### Documents (showing 2 of 1,234)\n\n| Citekey | Title | Authors | Status | Embeddings |\n|---------|-------|---------|--------|------------|\n| @K | " + "t" * 37 + "... | " + "a" * 22 + "... | ready | current |\n|  |  |  | failed |  |"
    assert output.document_table(rows).first().markdown == want
    assert output.document_table(rows.limit(0)).first().markdown == "No documents in the library."
    lines = spark.range(1).select(output.error_line(F.lit("x")), output.error_line(F.lit("x"), True), output.no_results(F.lit("q"))).first()
    assert lines[0] == "Error: x" and lines[1] == "⚠ USER-FACING ERROR: x" and lines[2].startswith('No results found for "q".')
