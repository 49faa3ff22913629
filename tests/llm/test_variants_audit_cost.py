"""Spelling variants, filter audit and cost-balanced packing against plain Python, with odd rows."""

import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_queries import SF, docs, encoded, rows_of  # noqa: F401  docs is a fixture
from test_text_operators import none  # noqa: F401  a fixture

from lexmill import session
from lexmill.llm import cost_packing, filter_audit, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = "doc_id long, text string, lang string, word string, n long, mask int, task int, bucket int, length long, id string"


def with_clashes(spark, rows):
    return spark.createDataFrame([(i, t, x, "clash", 1, 2, 3, 4, 5, "clash") for i, t, x in rows], CLASH)


# spelling variants


def brute_variants(rows, damage):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 7
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = defaultdict(set)
    masks = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            masks[w[:k], w[k + 1 :]].add(w)
            if (cut := w[:k] + w[k + 1 :]) in words:
                near[w].add(cut)
                near[cut].add(w)
    for same in masks.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        if best and words[best] >= 10 * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return sorted(out)


def variants_of(df, damage):
    words = spelling.vocabulary(df, damage=damage)
    return sorted(tuple(r) for r in spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_op11(spark, docs):  # noqa: F811
    got = sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows_of(spark, "op11_spelling_variants"))
    want = brute_variants([(d["doc_id"], d["text"]) for d in docs], 31)
    assert got == want and sum(r[1] is not None for r in got) > 0


def test_variants_of_odd_rows(spark, none):  # noqa: F811
    """Nulls, repeated rows, chains of forms, ties, upper-case letters beyond A-Z, runs of equal letters, and words of thousands of letters."""
    huge = "abcdefgh" * 700
    rows = [
        *[(i, "letters " * 120 + "Letterx " * 11 + "lettexx", "x") for i in (1, 1, 2)],
        (3, None, None),
        (None, "mississippi missisippi misssissippi ÀÉÎÕÜßa àéîõüßa Straßen STRASSEN", "x"),
        (None, "mississippi missisippi misssissippi ÀÉÎÕÜßa àéîõüßa Straßen STRASSEN", "x"),
        (4, "", ""),
        (5, f"{huge} {huge} {huge}x {huge}x {huge[:99]}Z{huge[100:]} {huge[:99]}Z{huge[100:]}", "x"),
        (6, "tie-ing: lettera letterb " * 3 + "aaaaaaaa aaaaaaa " * 2 + "short words are out", "x"),
        (7, "num1234bers_letters×letters÷letters", "x"),
    ]
    df = with_clashes(spark, rows)
    for damage in (0, 3):
        got = variants_of(df, damage)
        assert got == brute_variants([(i, t) for i, t, _ in rows], damage)
    by_word = {r[0]: r for r in variants_of(df, 0)}
    assert by_word["lettexx"][1:3] == ("letterx", "letters") and by_word[huge][4] == 2
    assert variants_of(none, 31) == []


def test_full_filters_lose_no_pair(spark, monkeypatch):
    """Filters far too small for the vocabulary let more through, and lose nothing."""
    rows = [(i, " ".join(f"{a}{b}etters{c}" for a in "abcdef" for b in "ghijk" for c in "lmnop"), "x") for i in (1, 2)]
    want = brute_variants([(i, t) for i, t, _ in rows], 0)
    monkeypatch.setattr(spelling, "MOST_BYTES", 64)
    assert variants_of(with_clashes(spark, rows), 0) == want


# filter audit


def brute_audit(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    fails = []
    for i, t, part in rows:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        f = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t))
        f += "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * (i is not None and first[t] < i)
        fails.append((part or "", f, i in good, i in toxic))
    out = {}
    for part in {x[0] for x in fails}:
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = [x for x in fails if x[0] == part]
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                shapley[letter] += len(gone)
                every = [x for x in fails if x[0] == part and letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                out[part, order, step] = (len(left), len(gone), len(every) - len(gone), sum(x[1] == letter for x in every), sum(x[2] for x in gone), sum(x[3] for x in gone), letter)
        for key in [k for k in out if k[0] == part]:
            out[key] = (*out[key][:6], shapley[out[key][6]])
    return out


def audit_of(counts):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.audit(counts).collect()}


def test_audit_of_odd_rows(spark, none):  # noqa: F811
    words = " ".join(f"word{i}" for i in range(120))
    long = " ".join(f"w{i % 30_000}" for i in range(60_000))
    texts = [None, "", words, words.upper(), words + " #", words, "a b\x0bc\td\x0c" * 30, long, long, "É" * 9 + "AB", words + " x", None]
    rows = [(i, t, ("en", None, "", "de")[i % 4]) for i, t in enumerate(texts)]
    rows += [(2, words, "en"), (None, words, "en"), (None, None, None), (None, "alone", "en"), (2, "same id", "en"), (40, "same id", "fr"), (41, long, "en")]
    labels = [(2, 1, 0), (2, 0, 1), (5, 1, 1), (8, None, 1), (None, 1, 1), (41, 1, None), (99, 1, 1), (40, 1, 0)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert audit_of(filter_audit.mask_counts(with_clashes(spark, rows), marks)) == brute_audit(rows, labels)
    empty = spark.createDataFrame([], CLASH)
    assert audit_of(filter_audit.mask_counts(empty, marks)) == {}
    assert audit_of(filter_audit.mask_counts(with_clashes(spark, rows), marks.limit(0))) == brute_audit(rows, [])


def test_sketch_clears_only_unique_texts(spark):
    """With one small bucket and with many, no repeat is cleared; most unique texts are."""
    df = spark.range(20_000).selectExpr("id AS doc_id", "concat('text ', IF(id % 10 = 0, id % 1000, id)) AS text", "'x' AS lang")
    rows = session.cut(filter_audit.flagged(df), "flags")
    found = filter_audit.sketch(rows)
    possible = filter_audit.possible_repeats(rows, found)
    repeats = {r[0] for r in rows.groupBy("text_hash").agg({"id": "count"}).filter("`count(id)` > 1").collect()}
    held = {r.text_hash for r in possible.collect()}
    assert repeats <= held and len(held) <= len(repeats) + 0.02 * 20_000
    assert found[1] == 8 * 20_000 // filter_audit.BUCKET + 1


def test_repeats_in_a_full_sketch(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "BUCKET", 4)
    monkeypatch.setattr(filter_audit, "MOST_BUCKETS", 1)
    rows = [(i, f"text {i % 37}", "x") for i in range(90)]
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_of(filter_audit.mask_counts(with_clashes(spark, rows), marks)) == brute_audit(rows, [])


# cost-balanced packing


def check_cost_packing(got, ids, capacity):
    """Every id lies in one piece, sequences are full or powers of two, and the quadratic cost of full ones is nearly equal."""
    parts, places = defaultdict(list), defaultdict(list)
    for r in got:
        whole = ids[r.doc_id]
        assert r.doc_tokens == len(whole) and r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length].tobytes())
        parts[r.doc_id].append((r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    assert set(parts) == set(ids)
    for i, held in parts.items():
        at = 0
        for start, length in sorted(held):
            assert start == at and length > 0
            at += length
        assert at == len(ids[i])
    squares = []
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at == capacity or at < capacity and at & (at - 1) == 0
        squares += [sum(n * n for _, n in held)] if at == capacity else []
    assert len(places) <= -(-sum(map(len, ids.values())) // capacity) + capacity.bit_length()
    return squares


def test_op13(spark, docs):  # noqa: F811
    squares = check_cost_packing(rows_of(spark, "op13_cost_packing"), encoded("byte_bpe_50k.json", docs, 0), 1024)
    assert max(squares) <= 1.25 * np.mean(squares)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 300), max_size=64), st.sampled_from([1, 7, 64, 100]))
def test_plan_fills_every_sequence(counts, capacity):
    """Each token of each piece is placed once, whatever the lengths; places don't overlap."""
    placed, used = defaultdict(list), defaultdict(list)
    for of, first, last, start, n, sequence, at in cost_packing.plan(counts, capacity):
        assert n > 0
        for k in range(last - first):
            placed[of, first + k].append((start, n))
            used[sequence + k].append((at, n))
    assert sorted(placed) == sorted((x, k) for x, n in counts.items() for k in range(n))
    for (of, _), held in placed.items():
        assert sum(n for _, n in held) == of and [s for s, _ in sorted(held)] == list(np.cumsum([0, *(n for _, n in sorted(held))])[:-1])
    for held in used.values():
        assert [a for a, _ in sorted(held)] == list(np.cumsum([0, *(n for _, n in sorted(held))])[:-1])
    totals = sorted(sum(n for _, n in held) for held in used.values())
    total = sum(x * n for x, n in counts.items())
    assert sum(totals) == total and [t for t in totals if t < capacity] == [1 << b for b in range(20) if total % capacity >> b & 1]
    assert len(used) == (max(used) + 1 if used else 0)


@pytest.mark.parametrize("broadcast", [cost_packing.BROADCAST_ROWS, 0])
def test_cost_packing_of_odd_rows(spark, none, monkeypatch, broadcast):  # noqa: F811
    """Nulls, empty and long texts, repeated and missing ids, and many tasks; with the table of numbers broadcast or shuffled."""
    monkeypatch.setattr(cost_packing, "BROADCAST_ROWS", broadcast)
    long = " ".join(f"word{i}" for i in range(9_000))
    rows = [(i, t, "x") for i, t in enumerate([None, "", long, "a", "a", long + " end", "é 漢 😀"] * 6)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = with_clashes(spark, rows).repartition(7)
    made = session.cut(cost_packing.pieces(df, path, 0, 128), "pieces")
    got = cost_packing.pack(made, 256).selectExpr("doc_id", "start", "length", "crc32(ids) AS ids_crc32", "doc_tokens", "sequence_id", "offset").collect()
    check_cost_packing(got, encoded("byte_bpe_50k.json", [{"doc_id": i, "text": t} for i, t, _ in rows], 0), 256)
    repeated = with_clashes(spark, [(None, long, "x"), (None, long, "x"), (1, "a", "x"), (1, "a", "x")])
    placed = cost_packing.pack(session.cut(cost_packing.pieces(repeated, path, 0, 128), "pieces"), 256).collect()
    assert sum(r.length for r in placed) == sum(r.doc_tokens for r in placed if r.start == 0) and sum(r.start == 0 for r in placed) == 4
    assert cost_packing.pack(session.cut(cost_packing.pieces(none, path, 0, 128), "pieces"), 256).count() == 0
