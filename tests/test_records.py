import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lexmill.functions.expressions import running_sums
from lexmill.operators import accuracy, alignment, catalog, cleanup, edits, metadata, people
from lexmill.sources import files, records, sqlite


def loop_keys(bases, taken):
    """One after another, the first rows of all bases before the others."""
    used, first, out = set(taken), {}, {}
    for i, b in enumerate(bases):
        first.setdefault(b, i)
    early = [i for b, i in first.items() if b not in used]
    for i in early + [i for i in range(len(bases)) if i not in set(early)]:
        b = bases[i]
        names = [b, *(b + chr(96 + k) for k in range(1, 27)), *(b + str(k) for k in range(1, 400))]
        out[i] = next(n for n in names if n not in used)
        used.add(out[i])
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_keys_are_those_of_a_loop(spark, seed):
    """Bases that are each other's suffixed keys, and taken keys in their way."""
    r = random.Random(seed)
    bases = [r.choice(["K", "Ka", "Kaa", "K1", "K2", "J", "J9", "Jb"]) for _ in range(150)] + ["K"] * 30
    taken = [r.choice(["K", "Ka", "Kc", "K3", "K12", "J", "Ja", "Jab", "K1000"]) for _ in range(6)] if seed else []
    df = spark.createDataFrame([(i, b, "x") for i, b in enumerate(bases)], "i long, base string, place string").repartition(5)
    got = metadata.unique_citekeys(df, "base", ["i"], spark.createDataFrame([(t,) for t in taken], "citekey string") if taken else None)
    assert got.columns == ["i", "base", "place", "citekey"]
    got = {x.i: x.citekey for x in got.collect()}
    assert len(set(got.values())) == len(bases) and not set(got.values()) & set(taken)
    assert got == loop_keys(bases, taken)


def test_keys_that_two_numbered_bases_reach(spark):
    """`K` and 11 is `K1` and 1: all keys differ, whoever gets it; null bases stay null."""
    bases = ["K"] * 45 + ["K1"] * 45 + [None, None]
    df = spark.createDataFrame(list(enumerate(bases)), "i long, base string")
    got = [x.citekey for x in metadata.unique_citekeys(df, "base", ["i"]).collect()]
    assert got.count(None) == 2 and len({k for k in got if k}) == 90
    assert metadata.unique_citekeys(df.limit(0), "base", ["i"]).count() == 0


def test_people(spark):
    def found(*texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        return [r.a for r in df.select("i", people.authors(F.col("t")).alias("a")).orderBy("i").collect()]

    by, between, looks, turned, *none = found(
        "A Title\n\nby Jane van der Berg, Bob Stone\nSue Lake\n",
        "A Title\n\nJohn Smith¹, Mary A. Jones²\nDepartment of Things\n\nAbstract\nx",
        "A Title\nSmith, J. and Doe, K. (MIT) a@b.org\nplain words that go on in a row",
        "By Dr. Stone, Bob; de la Cruz, Maria Elena; MIT; John Q. Public Jr.\nIntroduction to Things",
        None,
        " \n",
        "no names in here",
        "A Title\n" + "University of Somewhere\n" + "X" * 201 + "\n# Head Line Here\n1. First Point",
    )
    assert [(a["value"], a["confidence"]) for a in by] == [("van der Berg, Jane", 0.9), ("Stone, Bob", 0.9), ("Lake, Sue", 0.9)]
    assert [a["value"] for a in between] == ["Smith, John", "Jones, Mary"] and between[0]["reasoning"] == "between title and abstract"
    assert looks[0]["reasoning"] == "author-like patterns" and [a["value"] for a in looks] == ["Smith", "Doe"]
    assert [a["value"] for a in turned] == ["Stone, Bob", "de la Cruz, Maria", "Public, John"]
    assert none == [[], [], [], []]


def test_authors_of_long_lines(spark):
    """Groups that Java repeats by recursion ended the executor here."""
    texts = ["By " + "Aaa bbb " * 20_000, "By " + "dr " * 20_000 + "Karl May", "By Karl May" + " jr" * 20_000, "By Karl " + "von " * 20_000 + "May", "By Karl May III"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [[a["value"] for a in r.a] for r in df.select("i", people.authors(F.col("t")).alias("a")).orderBy("i").collect()]
    assert got == [["bbb, Aaa"], ["May, Karl"], ["May, Karl"], ["von " * 20_000 + "May, Karl"], ["May, Karl"]]


def test_similarity_is_that_of_the_longest_common_subsequence():
    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before, row = row, [0]
            for j, y in enumerate(b):
                row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
        return row[-1]

    r = random.Random(4)
    for _ in range(200):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randrange(30))) for _ in range(2))
        want = 2 * common(a, b) / (len(a) + len(b)) if a or b else 1.0
        assert math.isclose(alignment.similarity(a, b), want)


def test_alignment(spark):
    words = " ".join(f"alpha{i} beta{i * 7 % 13} gamma" for i in range(12))
    other = " ".join(f"delta{i} epsilon{i * 5 % 11}" for i in range(15))
    text = f"Some front matter\n# Frist Heading\n{words.replace('beta', 'bta')}\n```\n# no heading\n```\n## Second\n{other} tail end\n"
    regions = [(1, 0, "heading-h1", "h1", "# First Heading"), (1, 1, "paragraph", "p1", words), (1, 2, "heading-h2", "h2", "## Second"), (1, 3, "paragraph", "p2", other), (1, 4, "paragraph", "p3", "nothing of the kind zzz qqq"), (2, 0, "list", "l", "- x")]
    df = spark.createDataFrame(regions, "doc_id long, place long, feature string, region_id string, content string")
    got = {r.region_id: r for r in alignment.align(spark.createDataFrame([(1, text)], "doc_id long, text string"), df).collect()}
    assert got["h1"].matched == "# Frist Heading" and got["h1"].start == text.index("# Frist") and got["h2"].similarity == 1.0
    assert got["p1"].matched == words.replace("beta", "bta") and 0.9 < got["p1"].similarity < 1 and got["p1"].coverage == 1.0
    assert got["p2"].matched == other and got["p2"].similarity == 1.0 and got["p2"].start == text.index("delta0")
    assert got["p3"].failure and got["l"].failure == "extracted text is empty"


def test_author_scores_count_each_name_once(spark):
    rows = [(["Doe, J."], ["Doe, Jane", "Doe, John"], 0.5), ([], [], 1.0), (["x"], [], 0.0), (None, ["a"], 0.0), (["Jane Doe"], ["Doe, Jane"], 0.0), (["DOE–ROE, Jane B."], ["doe-roe, jane c."], 1.0)]
    df = spark.createDataFrame([(a, b, w) for a, b, w in rows], "a array<string>, b array<string>, w double")
    assert all(r.s == r.w for r in df.withColumn("s", accuracy.author_score(F.col("a"), F.col("b"))).collect())


def test_author_scores_part_each_name_once(spark):
    """What a name is compared by is made once for it, not again for each comparison."""
    df = spark.createDataFrame([(["Doe, J."], ["Doe, Jane", None, "Roe"])], "a array<string>, b array<string>")
    found = df.select(accuracy.author_score(F.col("a"), F.col("b")).alias("s"), accuracy.names_match(F.element_at("a", 1), F.element_at("b", 1)).alias("m"), accuracy.names_match(F.element_at("a", 1), F.element_at("b", 2)).alias("n"))
    row = found.first()
    assert (round(row.s, 6), row.m, row.n) == (0.333333, True, None)
    assert str(df.select(accuracy.author_score(F.col("a"), F.col("b")).alias("s"))._jdf.queryExecution().optimizedPlan()).count("regexp_replace") <= 4


def test_word_list(spark, tmp_path):
    (tmp_path / "words").write_text("cooperate\nwell-known\nExample\n")
    join = cleanup.dehyphenator(spark, str(tmp_path / "words"))
    texts = ["they co-\noperate", "a well-\nknown exam-\nple", "sta-\ntion", "x-\nray", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    assert [r[0] for r in df.orderBy("i").select(join("t")).collect()] == ["they cooperate", "a well-known example", "station", "x-ray", None]


def test_bounds_and_slices(spark):
    assert catalog.clamped_limit(0) == 1 and catalog.clamped_limit(1000) == 100 and catalog.checked_limit(100) == 100
    for bad in (0, 101):
        with pytest.raises(catalog.CatalogError):
            catalog.checked_limit(bad)
    chunks = spark.range(60).withColumnRenamed("id", "chunk_index")
    for start, end in ((-1, 2), (5, 4), (60, 61)):
        with pytest.raises(catalog.CatalogError):
            catalog.text_slice(chunks, 60, start, end)
    docs = spark.createDataFrame([("ab1", "K1"), ("ab2", "K2")], "doc_id string, citekey string")
    with pytest.raises(catalog.Ambiguous):
        catalog.resolve(docs, "ab")


def test_sources_refuse_what_they_cannot_read(spark, tmp_path):
    for bad in ("https://example.org/x.pdf", "file:///x.pdf"):
        with pytest.raises(ValueError):
            files.acquire(spark, bad)
    with pytest.raises(FileNotFoundError):
        files.acquire(spark, str(tmp_path / "none"))
    (tmp_path / "o.json").write_text('{"id": "x"}')
    with pytest.raises(ValueError):
        records.csl_records(spark, str(tmp_path / "o.json"))


def test_a_locked_database_is_read_from_a_copy(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (a INTEGER PRIMARY KEY)")
        db.executemany("INSERT INTO t VALUES (?)", [(i,) for i in range(20)])
    sqlite.register(spark)
    writer = sqlite3.connect(path, isolation_level=None)
    writer.execute("BEGIN EXCLUSIVE")
    df = spark.read.format("sqlite").option("path", path).option("table", "t").load()
    assert df.count() == 20 and df.rdd.getNumPartitions() > 1
    writer.execute("ROLLBACK")
    writer.close()


def test_running_sums(spark):
    r = random.Random(1)
    rows = [([],), ([5],), ([1] * 256,), ([1] * 257,), ([r.randrange(9) for _ in range(1000)],), (None,)]
    for values, sums in spark.createDataFrame(rows, "a array<int>").select("a", running_sums(F.col("a"))).collect():
        assert sums == (None if values is None else [sum(values[:i]) for i in range(len(values))])


def test_nearest_end_is_that_of_the_whole_table():
    def plain_table(asked, text, anchored):
        row = list(range(len(asked) + 1))
        best = (row[-1], 0)
        for j, c in enumerate(text, 1):
            before, row = row, [j if anchored else 0]
            for i, a in enumerate(asked):
                row.append(min(before[i] + (a != c), before[i + 1] + 1, row[i] + 1))
            best = min(best, (row[-1], j))
        return best[1], best[0]

    r = random.Random(6)
    for _ in range(300):
        asked, text = "".join(r.choice("abc") for _ in range(r.randrange(1, 20))), "".join(r.choice("abcd") for _ in range(r.randrange(40)))
        for anchored in (False, True):
            assert alignment.nearest_end(asked, text, anchored) == plain_table(asked, text, anchored)


def test_alignment_of_damaged_texts_against_all_windows():
    """Letters changed, lost and doubled, lines joined, every fifth region left out: places are as good as the best window of words."""
    r = random.Random(8)
    for _ in range(6):
        words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(150)]
        lines = [" ".join(r.choice(words) for _ in range(r.randrange(3, 30))) for _ in range(20)]

        def hurt(line):
            return "".join(c if c == " " or r.random() > 0.12 else r.choice(["", c + c, "z"]) for c in line)

        kept = [(i, hurt(line)) for i, line in enumerate(lines) if i % 5 != 4]
        text = "".join(line + (" " if i % 3 else "\n") for i, line in kept)
        begins, at = {}, 0
        for i, line in kept:
            begins[i], at = at, at + len(line) + 1
        found = alignment.align_document([{"region_id": str(i), "content": line} for i, line in enumerate(lines)], text)
        page = text.split()
        for i, got in enumerate(found):
            if i % 5 == 4:
                assert got.get("failure") or got["similarity"] < 0.7  # a left out region may pass for another text above the least similarity
                continue
            asked, n = lines[i], len(lines[i].split())
            best = max(alignment.similarity(asked, " ".join(page[a:b])) for a in range(len(page)) for b in range(a + max(1, n - 3), min(len(page), a + n + 3) + 1))
            assert got["similarity"] >= best - 0.05 and abs(got["start"] - begins[i]) <= 12


def test_alignment_of_odd_texts():
    """Texts of one letter, regions of marks, null and repeated regions, headings in another order."""
    assert [f.get("failure") for f in alignment.align_document([{"region_id": "a", "content": None}, {"region_id": "b", "content": "***"}], "x")] == ["no sufficiently similar region"] * 2
    same = alignment.align_document([{"region_id": str(i), "content": "one two"} for i in range(3)], "one two\none two\nelse")
    assert [f.get("start") for f in same] == [0, 8, None]
    swapped = alignment.align_document([{"region_id": t, "content": t} for t in ("# B", "under b", "# A", "under a")], "# A\nunder a\n# B\nunder b")
    assert [f["start"] for f in swapped] == [12, 16, 0, 4]
    big = alignment.align_document([{"region_id": "r", "content": "a" * 30_000}], "a" * 20_000 + " " + "a" * 20_000)
    assert len(big) == 1


def test_keys_of_suggestions_are_never_broadcast(spark, capsys):
    rng = random.Random(3)
    names = sorted({"Name#00" + "".join(rng.choice("0123") for _ in range(3)) for _ in range(50)} | {"", "a", "ab"})
    asked = [n[:i] + rng.choice(["", "x", "xy"]) + n[i + 1 :] for n in names for i in (0, 3, 8)] + [None]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    left, right = spark.createDataFrame([(a,) for a in asked], "asked string"), spark.createDataFrame([(n,) for n in names], "name string")
    for most, edits in ((3, 2), (1, 2), (2, 1), (2, 0)):
        found = catalog.suggestions_for(left, right, "asked", "name", most, edits)
        near = {a: sorted((distance(a, n), n) for n in names) for a in set(asked) - {None}}
        want = {(a, d, n, i + 1) for a in near for i, (d, n) in enumerate(near[a][:most]) if d <= edits}
        assert {(r["asked"], r["distance"], r["name"], r["place"]) for r in found.collect()} == want
        capsys.readouterr()
        found.explain()
        assert "SortMergeJoin [key" in (plan := capsys.readouterr().out) and "BroadcastHashJoin [key" not in plan


def test_no_window_of_a_region_is_searched_twice(monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
    line = lambda: " ".join(rng.choice(words) for _ in range(12))
    lines, searched, window = [line() for _ in range(20)], [], alignment._Text.window
    monkeypatch.setattr(alignment._Text, "window", lambda self, asked, about, slack: searched.append((asked, about)) or window(self, asked, about, slack))
    alignment.align_document([{"region_id": str(i), "content": line()} for i in range(6)], "\n".join(lines))
    assert searched and len(searched) == len(set(searched))


def test_alignment_looks_for_marks_only_where_there_are_some(monkeypatch):
    class Counted:
        def __init__(self, pattern):
            self.pattern, self.calls = pattern, 0

        def sub(self, *args):
            self.calls += 1
            return self.pattern.sub(*args)

    counted = Counted(alignment._MARKS)
    monkeypatch.setattr(alignment, "_MARKS", counted)
    lines = [" ".join(f"Word{i}x{j}" for j in range(50)) for i in range(20)] + ["a **Bold** ~~x~~ _ ~ # `c` ___ end"]
    found = alignment.align_document([{"region_id": str(i), "content": line} for i, line in enumerate(lines)], "\n".join(lines))
    assert [f["similarity"] for f in found] == [1.0] * 21 and found[-1]["matched"] == " ".join(lines[-1].split())
    assert alignment.plain(lines[-1]) == "a bold x ~ c end" and alignment.plain("  A\tB\n") == "a b"
    assert counted.calls < 40  # about 2,000 words


def test_edits_of_many_pairs_are_those_of_each_pair():
    r = random.Random(12)
    make = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    pairs = []
    for size in [1, 2, 63, 64, 65, 128, 129, 200, 300, 700] * 15:
        asked = make(size, "abcdefgh é\0")
        near = make(r.randrange(50), "abcdefgh") + "".join(c for c in asked if r.random() > 0.1) + make(r.randrange(90), "abcxyz\U0001f600\ud800")
        pairs.append((asked, near if r.random() > 0.05 else ""))
    pairs += [("a" * 5000, "ba" * 3000), ("ab", "")]
    for anchored in (False, True):
        assert edits.nearest_ends(pairs, anchored) == [edits.nearest_end(a, b, anchored) for a, b in pairs]
    tries = [(a, b, tuple(r.randrange(len(b) + 1) for _ in range(r.randrange(1, 4)))) for a, b in pairs]
    assert edits.commons(tries) == [[edits.common(a, b[:end]) for end in ends] for a, b, ends in tries]
    assert edits.nearest_ends([]) == edits.commons([]) == []


def test_documents_aligned_side_by_side(monkeypatch):
    """Windows of all documents are searched together, none twice, and the results are those of each document alone, searched window by window."""
    r = random.Random(13)
    words = ["".join(r.choice("abcdefghijklmnopé") for _ in range(r.randrange(2, 9))) for _ in range(200)]
    documents = []
    for d in range(40):
        lines = [" ".join(r.choice(words) for _ in range(r.randrange(1, 40))) for _ in range(r.randrange(3, 25))]
        regions, text = [], "" if d % 9 else "# front\n~~~\n# no heading\n~~~\n**İ** _  Σας\n"
        for i, line in enumerate(lines):
            regions += [{"region_id": f"h{i}", "content": f"# H{i}"}, {"region_id": f"p{i}", "content": line}]
            hurt = "".join(c if c == " " or r.random() > 0.15 else r.choice(["", c + c, "z"]) for c in line) if i % 4 else line
            text += "" if i % 7 == 6 else (" " if i % 3 == 2 else f"\n## H{i}\n") + hurt
        documents.append((regions[:: -1 if d % 10 == 9 else 1], text))
    documents += [([{"region_id": "r", "content": "x"}], None), ([], "text"), (documents[3][0], documents[5][1])]
    alone, window = [], alignment._Text.window
    calls, searched, together = [], [], alignment._searched
    monkeypatch.setattr(alignment._Text, "window", lambda self, asked, about, slack: calls.append(asked) or window(self, asked, about, slack))
    with monkeypatch.context() as m:
        m.setattr(alignment, "FEW", 10**9)
        for regions, text in documents:
            alone.append(alignment.align_document(regions, text))
    one_by_one = len(calls)
    calls.clear()
    monkeypatch.setattr(alignment, "_searched", lambda wanted: together([searched.append((id(w[0]), *w[1:])) or w for w in wanted]))
    assert alignment.align_documents(documents) == alone
    assert one_by_one > 500 and len(calls) < one_by_one / 20
    assert len(set(searched)) >= one_by_one
