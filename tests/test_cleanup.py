import pytest
from pyspark.sql import functions as F

from lexmill.operators import chunking, cleanup, context, fulltext, metadata, quality
from lexmill.plans import texts


def one(spark, make, *values, types="string"):
    schema = ", ".join(f"c{i} {types}" for i in range(len(values)))
    return spark.createDataFrame([tuple(values)], schema).select(make(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a\n名前何語\nb", "a\nb"),
        ("名前は stays", "名前は stays"),
        ("Привет мир", "Привет мир"),
        ("", ""),
        (None, None),
    ],
)
def test_foreign_lines(spark, text, want):
    assert one(spark, cleanup.drop_foreign_lines, text) == want


def test_picture_descriptions(spark):
    head = "Image /page/3/Figure/1 description: "
    text = f"x\n{head}A bar graph showing growth\n{head}a university LOGO on white\n{head}short\ny"
    assert one(spark, cleanup.picture_descriptions, text) == "x\n> [Figure] A bar graph showing growth\ny"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("w\na\n w \nb\nw", "a\nb"),
        ("w\na\nw", "w\na\nw"),
        ("- i\n- i\n- i\n\n\n\n", "- i\n- i\n- i\n\n\n\n"),
        ("a  b\na b\na\tb\nc", "c"),
        ("", ""),
        (None, None),
    ],
)
def test_repeated_lines(spark, text, want):
    assert one(spark, cleanup.drop_repeated_lines, text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("\n\nplain", "\n\nplain"),
        ("Your use of the JSTOR archive\nhttp://x\n\n1999\nText", "Text"),
        ("Text\nSee discussions, stats\nmore", "Text\nmore"),
        ("READS\nText\nElectronic copy available at x\n\nmore", "Text\n\nmore"),
        ("See discussions, stats", ""),
        ("\n" * 50 + "See discussions, stats", "\n" * 50 + "See discussions, stats"),
        (None, None),
    ],
)
def test_boilerplate(spark, text, want):
    assert one(spark, cleanup.strip_boilerplate, text) == want


def test_html(spark):
    text = "<p class='x'>a <i>b\nc</i> <strong>d</strong><sup>12.</sup> x<sup>n</sup><BR/>1 < 2 <keep></p>"
    assert one(spark, cleanup.coerce_html, text) == "a *b\nc* **d**[12] xn 1 < 2 <keep>"


@pytest.mark.parametrize(("text", "want"), [("informa-\ntion", "information"), ("well-\n  known", "well-known"), ("A-\nBc", "A-\nBc"), ("é-\ning", "éing"), ("a-b", "a-b")])
def test_dehyphenate(spark, text, want):
    assert one(spark, cleanup.dehyphenate, text) == want


def test_reflow(spark):
    text = "# H\na\n  b  \n\n- x\nc\n```\nd\ne\n```\nf\ng"
    assert one(spark, cleanup.reflow, text) == "# H\na b\n\n- x\nc\n```\nd\ne\n```\nf g"
    assert one(spark, cleanup.reflow, "") == "" and one(spark, cleanup.reflow, None) is None


def test_chunks(spark):
    text = "intro\n# A\n## B\n" + "word " * 700 + "\n# C\n\n"
    df = spark.createDataFrame([(1, text), (2, " \n"), (3, None)], "doc_id long, text string")
    rows = chunking.chunk(df).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows))) and {r.doc_id for r in rows} == {1}
    assert rows[0].section == "" and "A > B" in {r.section for r in rows} and all(len(r.text) <= chunking.SIZE for r in rows)
    vectors = chunking.embed(df, dim=8).collect()
    assert vectors[2].embedding is None and abs(sum(x * x for x in vectors[0].embedding) - 1) < 1e-5


def test_metadata(spark):
    assert one(spark, metadata.key_author, "Müller-Lüdenßtein") == "MullerLudensstein"
    assert one(spark, metadata.key_title_word, "The of Ætiology") == "Aetiology"
    assert one(spark, metadata.initials, "Jean-Pierre j. R.") == "J.-P.j.R."
    stems = {"Doe et al. - 2019 - On X": ("Doe", 2019, "On X"), "Doe_2019_On_X": ("Doe", 2019, "On X"), "Doe2019b": ("Doe", 2019, "b"), "Doe2019": ("Doe", 2019, None), "Doe - On X": ("Doe", None, "On X"), "a_b": (None, None, "a b")}
    for stem, want in stems.items():
        assert tuple(one(spark, metadata.parse_filename, stem)) == want
    assert tuple(one(spark, metadata.publication_year, "Title\nPublished: 3 May 2019\n© 2020"))[:3] == ("2019", 0.74, ["2020"])
    assert one(spark, metadata.publication_year, None)["reasoning"] == "no text content"
    assert tuple(one(spark, metadata.document_kind, "A PhD thesis, a dissertation")) == ("thesis", 0.95)
    assert tuple(one(spark, metadata.document_kind, "")) == ("article-journal", 0.2)


def test_unique_keys(spark):
    rows = spark.createDataFrame([(i, "K") for i in range(30)] + [(99, "L")], "id long, base string")
    taken = spark.createDataFrame([("K",), ("Kb",)], "citekey string")
    got = {r.id: r.citekey for r in metadata.unique_citekeys(rows, "base", ["id"], taken).collect()}
    letters = [f"K{c}" for c in "acdefghijklmnopqrstuvwxyz"]
    assert [got[i] for i in range(30)] == [*letters, "K1", "K2", "K3", "K4", "K5"] and got[99] == "L"


def test_quality(spark):
    assert one(spark, quality.gate, "x") == "too short" and one(spark, quality.gate, None) == "too short"
    assert one(spark, quality.gate, "\x00" * 50 + "x" * 100) == "unprintable" and one(spark, quality.gate, "x" * 100) == "ok"
    assert one(spark, quality.word_error_rate, "a b *c*", "a x c d") == pytest.approx(2 / 3)
    assert one(spark, quality.character_error_rate, "", "x") == 0
    assert one(spark, quality.detected, "table-x", "a\n|b|c|") is True and one(spark, quality.detected, "odd", "x") is None
    assert one(spark, quality.detected, "code-block", "```\nx") is False


def test_context(spark):
    assert one(spark, context.block, "k", "s", "t") == "[@k, §s] t" and one(spark, context.block, None, "", "t") == "[unknown source] t"
    rows = spark.createDataFrame([("k", None, "b", 2), (None, "s", "a", 1)], "key string, section string, text string, rank long")
    said = []
    answer = context.ask(rows, "q?", lambda m: said.append(m) or iter(["x", "y"]), "sys")
    assert answer.text == "xy" and said[0][1]["content"] == f"Context:\n[unknown source, §s] a{context.RULE}[@k] b\n\nQuestion: q?"
    assert context.ask(rows.limit(0), "q?", None, "sys").chunks == []


def test_sanitize(spark):
    cases = {"What is the actor-network?": ["actor", "network"], '"grounded theory" and method': ['"grounded theory"', "method"], 'odd " quote': ["odd", "quote"]}
    for query, want in cases.items():
        assert fulltext.sanitize(query) == want and one(spark, fulltext.sanitize_column, query) == " OR ".join(want)
    for bad in ("the of", "", "?!"):
        with pytest.raises(fulltext.QueryError):
            fulltext.sanitize(bad)
        assert one(spark, fulltext.sanitize_column, bad) is None
    with pytest.raises(fulltext.QueryError):
        fulltext.operands(["a@b"])


def test_word_errors_of_large_vocabularies_and_accents(spark, tmp_path):
    words = [f"w{i}" for i in range(20_002)]
    assert one(spark, quality.word_error_rate, " ".join(words), " ".join(["new", *words[1:-1]])) == pytest.approx(2 / 20_002)
    for a, b, n in (("a b c", "a x c d", 2), ("", "a b", 2), ("a b", "", 2), ("a b c d", "b c d a", 2), ("a", "a", 0)):
        assert quality._distance(a.split(), b.split()) == n
    spark.createDataFrame([(1, "caf\u00e9 noir"), (2, "caf\u00e8 noir")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r.wer for r in texts.word_errors(spark, str(tmp_path)).collect()] == [0.5]


def test_split_takes_time_by_the_text_not_by_the_pieces_held():
    import time

    from lexmill.operators import chunking

    text = "a " * 300_000
    began = time.process_time()
    found = chunking.split(text)
    assert time.process_time() - began < 2.5
    # 1,500 characters of pieces of two, then 100 pieces of them again
    assert {len(c) for c in found[:-1]} == {1499} and len(found) == 1 + -(-(len(text) - 1500) // 1300)
    assert chunking.split("one. two\nthree four", 9, 4) == ["one. two", "three", "four"]
