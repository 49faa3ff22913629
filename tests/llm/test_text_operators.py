"""Operators on texts, against brute force and on edge cases: nulls, empty and long texts, ties, repeats, empty tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pyspark.sql import functions as F

import corpus_pipeline
from lexmill import session
from lexmill.functions.expressions import ClashingColumn
from lexmill.llm import chat, exact_dedup, hnsw, language, near_dedup, packing, quality, sharding, token_file, tokens, unigram
from lexmill.llm.tokens import Encoder

DOCS = "doc_id long, text string, id string, key string"
LONG = " ".join(f"word{i % 997} tail{i % 89}" for i in range(20_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, long and repeated texts, a repeated row, and extra columns with names that operators use."""
    rows = [(1, "Alpha beta gamma delta epsilon zeta eta theta"), (2, "alpha BETA gamma delta epsilon zeta eta theta"), (3, None), (4, ""), (5, LONG), (6, LONG + " end"), (7, "x"), (7, "x"), (None, "alpha beta"), (8, "  \n\t "), (9, "Ünïcode ▁ text\nmit Zeilen  und  Räumen")]
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


# chat formatting

EVENTS = "conv_id long, message_id long, seq long, role string, kind string, text string"


def test_chat_folds_events(spark):
    rows = [(1, 1, 1, "user", "message", "hi"), (1, 2, 2, "assistant", "delta", "He"), (1, 2, 3, "assistant", "delta", "llo"), (1, 2, 4, "assistant", "regenerate", "New"), (1, 2, 5, "assistant", "delta", " one"), (1, 1, 6, "user", "edit", "hey"), (2, 1, None, None, None, None)]
    got = {(r.conv_id, r.message_id): (r.role, r.text) for r in chat.fold(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == {(1, 1): ("user", "hey"), (1, 2): ("assistant", "New one"), (2, 1): ("", "")}
    assert chat.render(chat.fold(spark.createDataFrame([], EVENTS))).count() == 0


def test_chat_streams_fold_back(spark):
    """Streams of long, empty and null texts fold into the same messages; ties on seq go by role and text."""
    long = "x é😀\n" * 700
    rows = [(1, 10, 1, "user", long), (1, 11, 2, "assistant", ""), (1, 12, 3, "assistant", None), (1, 13, 3, "assistant", "b"), (2, 14, None, None, "y" * 512), (None, 15, 1, "user", "y" * 513)]
    log = chat.streamed(spark.createDataFrame(rows, "conv_id long, message_id long, seq long, role string, text string"))
    assert log.filter("kind = 'delta'").count() == 7 + 1 + 1 + 1 + 1 + 2
    got = {r.message_id: (r.role, r.text) for r in chat.fold(log.repartition(5)).collect()}
    assert got == {m: (role or "", text or "") for _, m, _, role, text in rows}
    out = chat.render(chat.fold(log))
    r = out.filter("conv_id = 1").select(chat.parse(out.formatted).alias("turns"), chat.masked_text(out.formatted, out.loss_spans).alias("loss")).first()
    assert [t.text for t in r.turns] == [long, "", "", "b"] and r.loss == "b"


def test_chat_of_a_long_conversation(spark):
    """Time must not grow with the square of the turns: 60,000 of them."""
    rows = spark.range(60_000).selectExpr("1L AS conv_id", "id AS message_id", "id AS seq", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('<turn ', id) AS text")
    out = chat.render(chat.fold(chat.streamed(rows)))
    r = out.select("n_turns", F.size("loss_spans").alias("spans"), F.length(chat.masked_text(out.formatted, out.loss_spans)).alias("n")).first()
    assert (r.n_turns, r.spans, r.n) == (60_000, 30_000, sum(len(f"<turn {i}") for i in range(1, 60_000, 2)))


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|turn|>a<|text|>b<|end|>", "\\", "\\<", "[\\", "", "a\nb", "<\\|end|>", "é" * 5]
    rows = [(1, i, i, "assistant" if i % 2 else "us<er", "message", t) for i, t in enumerate(nasty)]
    out = chat.render(chat.fold(spark.createDataFrame(rows, EVENTS)))
    r = out.select("n_turns", "formatted", chat.parse(out.formatted).alias("turns"), chat.masked_text(out.formatted, out.loss_spans).alias("loss")).first()
    assert [(t.role, t.text) for t in r.turns] == [("assistant" if i % 2 else "us<er", t) for i, t in enumerate(nasty)]
    assert r.loss == "".join(nasty[1::2]) and "</s>" not in r.formatted and "[INST]" not in r.formatted


# token ids and files


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@settings(max_examples=300, deadline=None)
@given(text=st.lists(st.sampled_from(["don't", "'s", "a", "İx", "<|endoftext|>", "x.", "foo!?", "é", "\n", "", "12", "a1", "x-y", "x\ny", "|", "a\n\nb", "½", "日本", "́a", "Straße,", "\x01", "Σ", "\t"]), max_size=9).map(" ".join) | st.text(max_size=20))
def test_encoder_equals_library(name, text):
    """Against a fresh tokenizer, with its defaults; strings of special tokens are among the texts."""
    texts = [text, f"a {text}", f"{text} b <|startoftext|>"]
    assert _encoder(name).encode(texts) == [np.array(fresh(name).encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_encoder_with_plain_specials():
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"), plain_specials=True)
    assert np.frombuffer(encoder.encode(["a <|endoftext|> b"])[0], "<u4").max() < 50256


def fresh(name):
    if ("fresh", name) not in _known:
        _known["fresh", name] = Tokenizer.from_file(public_tokenizers.path(name))
    return _known["fresh", name]


_known = {}


def _encoder(name):
    if name not in _known:
        _known[name] = Encoder(public_tokenizers.path(name))
    return _known[name]


@given(ids=st.lists(st.integers(0, 2**32 - 1) | st.integers(100, 140), max_size=700))
@settings(max_examples=100, deadline=None)
def test_segments_round_trip(ids):
    ids = np.array(ids, np.uint32)
    assert (token_file.unpack_segment(token_file.pack_segment(ids)) == ids).all()


def test_token_files(spark, odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    place = session.scratch_path(spark, "test")
    token_file.write(odd, place, path, 1)
    got = sorted(((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in token_file.read(spark, place).collect()), key=lambda r: r[1])
    encoder, at = _encoder("word_bpe_49k.json"), 0
    assert [r[0] for r in got] == sorted((i for i, _ in texts_of(odd)), key=lambda i: -1 if i is None else i)
    assert Counter((i, ids) for i, _, _, ids in got) == Counter((i, encoder.whole([t])[0] + b"\x01\0\0\0") for i, t in texts_of(odd))
    for _, start, n, ids in got:
        assert start == at and len(ids) == 4 * n
        at += n
    empty = session.scratch_path(spark, "test")
    token_file.write(none, empty, path, 1)
    assert token_file.read(spark, empty).count() == 0


# packing


def best_fit_decreasing(counts, capacity):
    room = []
    for x in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        k = min((i for i in range(len(room)) if room[i] >= x), key=lambda i: room[i], default=None)
        if k is None:
            room.append(capacity - x)
        else:
            room[k] -= x
    return len(room)


@given(counts=st.dictionaries(st.integers(1, 64), st.integers(0, 40), max_size=30))
@settings(max_examples=200, deadline=None)
def test_plan_places_every_piece_once(counts):
    runs, sequences = packing.plan(counts, 64)
    spots, places = defaultdict(list), Counter()
    for length, first, last, sequence, each, offset in runs:
        for i in range(first, last):
            places[length, i] += 1
            spots[sequence + (i - first) // each].append((offset + (i - first) % each * length, length))
    assert places == Counter((x, i) for x, n in counts.items() for i in range(n))
    assert set(spots) <= set(range(sequences))
    for held in spots.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    assert sequences <= best_fit_decreasing(counts, 64)


def test_packing(spark, odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = session.cut(packing.pieces(odd, path, 0, 128), "test")
    got = packing.pack(rows, 128, ["doc_id", "piece", "start"]).collect()
    whole = Counter(len(_encoder("byte_bpe_50k.json").whole([t])[0]) // 4 + 1 for _, t in texts_of(odd))
    assert sum(r.length for r in got) == sum(n * k for n, k in whole.items())
    assert all(r.piece == 0 or r.length == 128 for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in held) <= 128 and sorted(held)[0][0] == 0 for held in by.values())
    with pytest.raises(ClashingColumn):
        packing.pack(rows.withColumn("Offset", F.lit(1)), 128, ["doc_id"])
    named = rows.selectExpr("*", "1 AS ordinal", "2 AS first", "3 AS `row`", "4 AS o0", "5 AS lexmill_salt")
    assert packing.pack(session.cut(named, "test"), 128, ["doc_id", "piece", "start"]).columns == [*named.columns, "sequence_id", "offset"]
    assert packing.pack(session.cut(packing.pieces(none, path, 0, 128), "test"), 128, ["doc_id"]).count() == 0
    bad = spark.createDataFrame([(1, None), (2, 0), (3, 129), (4, 5)], "doc_id long, length long")
    assert {r.doc_id for r in packing.pack(bad, 128, ["doc_id"]).collect() if r.sequence_id is None} == {1, 2, 3}


# exact dedup


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(spark, odd, none, keep):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = defaultdict(list)
    for i, t in texts_of(odd):
        groups[t.translate(lower)].append(i)
    got = exact_dedup.content_groups(odd, keep=keep).collect()
    best = min if keep == "min" else max
    want = Counter()
    for t, ids in groups.items():
        keep_id = best((i for i in ids if i is not None), default=None)
        want.update((i, keep_id, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    assert Counter((r.id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.content_groups(none).count() == 0


def test_exact_dedup_of_a_hot_text(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'hot Text', concat('t', id % 500)) AS text")
    got = exact_dedup.content_groups(rows, keep="max")
    hot = got.filter("group_size = 1000")
    assert hot.count() == 1000 and hot.filter("kept").select("id").first()[0] == 2997
    assert got.filter("kept").count() == 1 + rows.filter("doc_id % 3 <> 0").select("text").distinct().count()


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup_of_rows_that_repeat_text_and_id(spark, keep, tmp_path):
    odd = "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 5 ELSE id % 700 END"
    spark.range(9000).selectExpr(f"CAST({odd} AS BIGINT) AS doc_id", "IF(id % 3 = 0, NULL, IF(id % 3 = 1, 'hot Text', concat('t', id % 500))) AS text").write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    dealt, ranges = exact_dedup._dealt(rows, "doc_id", "text")
    sizes = [r["count"] for r in dealt.groupBy("range").count().collect()]
    assert len(sizes) == ranges > 3 and max(sizes) < 2 * 9000 / ranges
    got = exact_dedup.content_groups(rows, keep=keep)
    hot = [(r.id, r.keep_id, r.n) for r in got.filter("group_size = 3000 AND kept").groupBy("id", "keep_id").agg(F.count("*").alias("n")).collect()]
    assert sorted(hot, key=str) == [(5, 5, 1), (None, None, 1)]
    assert got.count() == 9000 and got.filter("kept").count() == rows.select(F.coalesce("text", F.lit(""))).distinct().count()


# near dedup


def brute_components(rows):
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", t.translate(lower))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    lowest = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        lowest[find(k)].append(i)
    return [(i, len(sets[k]), min((x for x in lowest[find(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows)]


def test_near_dedup(spark, odd, none):
    got = near_dedup.near_duplicates(odd).collect()
    want = [(i, n, c) for i, n, c in brute_components(texts_of(odd))]
    assert Counter((r.id, r.n_shingles, r.component_id) for r in got) == Counter(want)
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_dedup_of_a_large_group(spark):
    """Variants of one text at all similarities around the threshold."""
    random = np.random.default_rng(3)
    base, rows = [f"w{i}" for i in range(60)], []
    for i in range(150):
        words = list(base)
        for k in random.choice(60, random.integers(0, 5), replace=False):
            words[k] = f"x{random.integers(0, 8)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted((r.id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect())
    assert got == sorted(brute_components(rows))


def test_near_dedup_without_ids_and_with_repeated_ids(spark):
    """Near copies with null ids and under one id, against brute force; one row of each component is kept."""
    words = lambda tag, n=60: [f"{tag}{i}" for i in range(n)]
    near = lambda tag, k: " ".join(words(tag)[:-1] + [f"end{k}"])
    rows = [(None, near("a", 1)), (None, near("a", 2)), (None, near("a", 2)), (None, near("b", 1)), (5, near("b", 2)), (7, near("c", 1)), (7, near("c", 2)), (7, near("c", 2)), (9, near("c", 3)), (None, " ".join(words("d")))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_dedup.near_duplicates(df).collect()
    assert Counter((r.id, r.n_shingles, r.component_id) for r in got) == Counter(brute_components(rows))
    assert Counter(r.id for r in got if r.kept) == {None: 2, 5: 1, 7: 1}
    kept = [(r.doc_id, r.text[0]) for r in corpus_pipeline.without_near_copies(spark, df, "").collect()]
    assert Counter(kept) == {(None, "a"): 1, (5, "b"): 1, (7, "c"): 1, (None, "d"): 1}


def test_estimate_is_near_the_similarity(spark):
    a, b = np.arange(0, 4000, dtype=np.uint64), np.arange(500, 4500, dtype=np.uint64)
    mix = lambda x: (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    planes = [near_dedup.bit_planes(near_dedup.minima(np.unique(mix(x)))).tolist() for x in (a, b)]
    df = spark.createDataFrame([tuple(planes)], "a array<long>, b array<long>")
    assert abs(df.select(near_dedup.estimate(df.a, df.b)).first()[0] - 3500 / 4500) < 0.15


# sentencepiece


def test_unigram_is_the_best_segmentation():
    pieces = unigram.Pieces([("▁a", 3, -1.0), ("ab", 4, -2.5), ("b", 5, -1.0), ("a", 6, -2.0), ("▁", 7, -3.0), ("bc", 8, -1.5), ("c", 9, -4.0), ("é", 10, -2.0)], list(range(100, 356)), [b""] * 400)
    codec, table = unigram.Codec(pieces), {"▁a": -1.0, "ab": -2.5, "b": -1.0, "a": -2.0, "▁": -3.0, "bc": -1.5, "c": -4.0, "é": -2.0}

    def best(text):
        if not text:
            return 0.0
        found = [table[p] + best(text[len(p) :]) for p in table if text.startswith(p)]
        if text[0] not in table:
            found.append(pieces.unknown + best(text[1:]))
        return max(found)

    for text in ["a", "ab", "abc", "a bc ab", "aé", "xa", "b a  c", "aab bcab"]:
        marked = ("▁" + text).replace(" ", "▁")
        ids = np.frombuffer(codec.encode(text), "<u4").tolist()
        score = sum(pieces.scores[i] for i in ids if i < 100) + pieces.unknown * text.count("x")
        assert score == best(marked), text


def test_unigram_round_trip(spark, odd, none):
    encode, decode = unigram.columns(spark, unigram.Pieces.load(public_tokenizers.path("piece_bpe_32k.model")))
    got = odd.withColumn("ids", encode("text")).withColumn("back", decode("ids")).collect()
    assert all(r.back == (r.text or "").replace("▁", " ") for r in got)
    assert none.withColumn("ids", encode("text")).count() == 0


# language and quality


def test_language(spark, odd, none):
    train = spark.createDataFrame([(i, t, lang) for i in range(30) for t, lang in ((f"the cat and the dog were in the house {i}", "en"), (f"der Hund und die Katze waren in dem Haus {i}", "de"))], "doc_id long, text string, lang string")
    model = language.fit(train)
    assert model.languages == ["de", "en"]
    mixed = "the cat and the dog were in the house " * 3 + "der Hund und die Katze waren in dem Haus " * 3
    docs = spark.createDataFrame([(1, "the dog and the cat in the house"), (2, "und der Hund in dem Haus"), (3, "123 !!"), (4, None), (5, ""), (6, mixed)], "doc_id long, text string")
    got = {r.doc_id: r.language for r in language.classify(docs, model).collect()}
    assert [got[i].lang for i in range(1, 6)] == ["en", "de", "und", "und", "und"]
    assert sorted(got[6].languages) == ["de", "en"] and all(0 <= r.score <= 1 for r in got.values())
    assert language.classify(odd, model).count() == odd.count() and language.classify(none, model).count() == 0
    assert {r.language.lang for r in language.classify(odd, language.fit(train.limit(0))).collect()} == {"und"}


@pytest.fixture(scope="module")
def four():
    """A model of four languages with words of their own."""
    words = {lang: [f"{a}{b}{c}" for a in sounds for b in "aeiou" for c in sounds] for lang, sounds in (("de", "bdf"), ("en", "ghk"), ("es", "lmn"), ("fr", "prs"))}
    n = np.full((language.BUCKETS, 4), language.SMOOTHING)
    for k, lang in enumerate(sorted(words)):
        n[:, k] += 2000 * np.bincount(language.trigrams(" ".join(words[lang])), minlength=language.BUCKETS)
    return language.Model(sorted(words), np.log(n / n.sum(axis=0)).astype(np.float32)), {lang: " ".join(w) for lang, w in words.items()}


def test_every_language_of_a_text_is_selected(four):
    model, text = four
    small = (text["en"] + " ") * 98 + (text["de"] + " ") * 2
    got = language.infer(model, [" ".join(text.values()), small, text["fr"], " ".join([text["de"], text["es"], text["fr"]])])
    assert [sorted(r["languages"]) for r in got] == [["de", "en", "es", "fr"], ["de", "en"], ["fr"], ["de", "es", "fr"]]
    assert got[1]["lang"] == "en" and got[1]["shares"][1] == pytest.approx(0.02, abs=0.005)


def test_language_stage_keeps_clean_texts(spark, four, monkeypatch):
    """Texts in three and four languages at equal parts and very short ones stay; texts in no learned language go."""
    model, text = four
    monkeypatch.setattr(language, "fit", lambda docs: model)
    rows = [" ".join([text["de"], text["es"], text["fr"]]), " ".join(text.values()), "gig", "hi", "Привет мир, это русский текст для проверки", "xq zvjw wqyx zzwq jjxw", "12"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.known_language(spark, docs, "").collect()) == [0, 1, 2, 3]


def test_mixture_is_the_likeliest():
    """EM against a grid over the proportions of two languages."""
    random = np.random.default_rng(1)
    p = random.random((50, 2)).astype(np.float32)
    n, doc, starts = random.integers(1, 9, 50).astype(np.float32), np.zeros(50, int), np.array([0])
    pi = language._em(np.array([[0.5, 0.5]], np.float32), p, n, doc, starts, n.sum(keepdims=True), 400)
    grid = max((float((n * np.log(p @ np.array([x, 1 - x]))).sum()), x) for x in np.linspace(0, 1, 2001))
    assert abs(pi[0, 0] - grid[1]) < 0.01


def test_quality(spark, odd, none):
    rows = [(i, f"Some plain sentence number {i}, with words that go on." if i % 3 else f"BUY!! NOW!! {i}!! WIN!! CASH!!") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.quality_score for r in quality.classify(docs, model).collect()}
    assert all((got[i] >= 0.7) == (i % 3 > 0) for i in range(200, 300))
    assert all(0 <= r.quality_score <= 1 for r in quality.classify(odd, model).collect()) and quality.classify(none, model).count() == 0
    assert quality.fit(docs, labels.limit(0)).score("x") == pytest.approx(0.5)
    assert quality.fit(docs, labels.filter("quality = 1")).score("x") > 0.9


# sharding


def test_sharding(spark, odd, none):
    rows = spark.range(1000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN concat('pair', id DIV 10) ELSE concat('t', id) END AS text")
    got = sharding.shard_texts(rows, 8).join(rows.withColumnRenamed("doc_id", "id"), "id").collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == 1000 and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    groups = defaultdict(set)
    for r in got:
        groups[r.text].add(r.shard)
    pairs = [g for t, g in groups.items() if t.startswith("pair")]
    assert sum(len(g) > 1 for g in pairs) <= 0.1 * len(pairs)
    found = sharding.shard_texts(odd, 4).collect()
    assert Counter((r.id, r.size, r.text_crc32) for r in found) == Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts_of(odd))
    assert sharding.shard_texts(none, 4).count() == 0


# nearest neighbours


def test_hnsw_recall_and_edges(spark):
    random = np.random.default_rng(5)
    v = random.normal(size=(3000, 16)) * random.uniform(0.5, 2, (3000, 1))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000 + i, v[0].tolist()) for i in range(40)]
    odd = [(9001, None), (9002, []), (9003, [0.0] * 16), (9004, [float("nan")] * 16), (9005, [None] * 16), (None, v[1].tolist()), (9006, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(5)
    got = hnsw.nearest(df, df.filter("vec_id % 20 = 0 OR vec_id > 9000"), 10).toPandas()
    ids, table = np.array([i for i, _ in rows]), np.array([x for _, x in rows])
    hits = total = 0
    for q, found in got[got.query_id != 9006].groupby("query_id"):
        scores = table @ table[ids == q][0]
        scores[ids == q] = -np.inf
        best = np.lexsort((ids, -scores))[:10]
        found = found.sort_values("rank")
        assert found["rank"].tolist() == list(range(1, 11))
        assert np.allclose(found["score"], [scores[ids == x][0] for x in found["vec_id"]])
        hits, total = hits + len(set(found.vec_id) & set(ids[best].tolist())), total + 10
    assert hits / total >= 0.9 and got.query_id.nunique() == sum(i % 20 == 0 for i, _ in rows)
    assert hnsw.nearest(df.limit(0), df, 10).count() == 0


def exact_nearest(ids, table, q, k):
    """(vec_id, score) of the k best for row q, every row with its id left out, ties to the smaller id."""
    scores = table @ table[q]
    some = [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[q]][:k]
    return [(int(ids[i]), float(scores[i])) for i in some]


def test_hnsw_recall_over_six_orders_of_length(spark):
    """One vector far longer than the others, and lengths that spread over six orders of magnitude."""
    random = np.random.default_rng(9)
    for lengths in (np.where(np.arange(1500) == 3, 1e4, 1.0), 10.0 ** random.uniform(-3, 3, 1500)):
        table = random.normal(size=(1500, 24)) * lengths[:, None]
        ids = np.arange(1500)
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(table)], "vec_id long, embedding array<double>")
        got = hnsw.nearest(df, df.filter("vec_id % 20 = 0"), 20).toPandas()
        hits = sum(len(set(found.vec_id) & {i for i, _ in exact_nearest(ids, table, q, 20)}) for q, found in got.groupby("query_id"))
        assert hits >= 0.9 * 20 * 75


def test_hnsw_of_repeated_rows(spark):
    """A group of equal vectors whose ids repeat: twins of a query with other ids take all places."""
    v = [3.0, 4.0]
    rows = [(1, v)] * 30 + [(i, v) for i in range(2, 9)] * 2 + [(100 + i, [1.0, i / 50]) for i in range(50)]
    got = hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame([(1, v), (1, v), (1, [1.0, 0.0])], "vec_id long, embedding array<double>"), 5).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r.rank):
        by[r.score].append((r["rank"], r.vec_id))
    assert by[25.0] == [(1, 2), (2, 2), (3, 3), (4, 3), (5, 4)] and by[3.0] == [(1, 2), (2, 2), (3, 3), (4, 3), (5, 4)]


@pytest.mark.parametrize("size,groups,most", [(2, 300, 12), (5, 150, 16)])
def test_sharding_keeps_groups_where_all_are_linked(spark, size, groups, most):
    """Every text stands `size` times: hardly more groups are split than counts that are one apart ask for."""
    rows = spark.createDataFrame([(i, f"text {i % groups}", "x", "x") for i in range(size * groups)], DOCS)
    got = sharding.shard_texts(rows, 16).join(rows.select(F.col("doc_id").alias("of"), "text"), F.col("id") == F.col("of")).select("shard", "text").collect()
    sizes, held = Counter(r.shard for r in got), defaultdict(set)
    for r in got:
        held[r.text].add(r.shard)
    assert len(got) == size * groups and max(sizes.values()) - min(sizes.values()) <= 1
    assert sum(len(x) > 1 for x in held.values()) <= most


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 4), st.integers(1, 9)), st.integers(1, 6), max_size=20))
def test_whole_moves_even_out(counts):
    total = sum(x * n for (_, x), n in counts.items())
    targets = [total // 5 + (s < total % 5) for s in range(5)]
    moves, cuts = sharding._whole_moves(counts, targets)
    load = [sum(x * n for (i, x), n in counts.items() if i == s) for s in range(5)]
    used = defaultdict(set)
    for i, x, first, last, to in moves:
        load[i], load[to] = load[i] - x * (last - first), load[to] + x * (last - first)
    for i, x, first, last, nodes in cuts:
        assert last == first + 1 and 0 < nodes <= x
        load[i] -= nodes
    for i, x, first, last, _ in [*moves, *cuts]:
        assert 0 <= first < last <= counts[i, x] and not used[i, x] & set(range(first, last))
        used[i, x] |= set(range(first, last))
    assert all(n <= t for n, t in zip(load, targets, strict=True))


def test_texts_encoded_whole_go_to_the_library_in_small_parts(monkeypatch):
    encoder = _encoder("byte_bpe_50k.json")
    texts = [f"two  spaces {i} " * 500 for i in range(200)]
    given, library = [], encoder.library

    class Counted:
        def encode_batch_fast(self, part, **how):
            given.append(sum(map(len, part)))
            return library.encode_batch_fast(part, **how)

    monkeypatch.setattr(encoder, "library", Counted())
    got = encoder.encode(texts)
    assert sum(given) == sum(map(len, texts)) and max(given) < (1 << 18) + len(max(texts, key=len))
    assert got[:3] == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts[:3]]
    assert len(got) == len(texts) and encoder.whole([]) == []


def test_a_search_is_no_broader_than_its_queries_need(monkeypatch):
    random = np.random.default_rng(5)
    v = np.repeat(random.normal(size=(60, 16)), 25, axis=0) + 0.1 * random.normal(size=(1500, 16))
    row = hnsw._graph_row(v, np.arange(1500), np.ones(1500, int)) | {"dim": 16}
    used, search = Counter(), hnsw.Graph.search
    monkeypatch.setattr(hnsw.Graph, "search", lambda self, query, entry, level, breadth, seen, stamp: used.update([breadth]) or search(self, query, entry, level, breadth, seen, stamp))
    queries = [(i, v[i]) for i in range(0, 1500, 5)]
    found = hnsw._search_graph(row, queries, 20)
    assert max(used) == hnsw.LEAST_BREADTH < hnsw.ROOT_BREADTH * 1500**0.5  # a full share of the 20 best is found with this
    exact = [set(sorted((j for j in range(1500) if j != i), key=lambda j, x=x: -(v[j] @ x))[:20]) for i, x in queries]
    assert np.mean([len(e & {j for _, j in f}) / 20 for e, f in zip(exact, found, strict=True)]) >= 0.97
    assert hnsw._search_graph(row, queries[::-1], 20) == found[::-1]
    used.clear()
    hnsw._search_graph(row, queries[:3], 20)  # few queries: as broad as vectors without structure need it
    assert set(used) == {194}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize(("most", "hashes"), [(1_000_000, None), (40, None), (1_000_000, 7)])
def test_words_are_looked_up_as_arrays(name, most, hashes, monkeypatch):
    """None goes through the memory of units, whatever marks follow it; also when words are forgotten, or share their hashes."""
    encoder, asked, missing = Encoder(public_tokenizers.path(name)), [], Encoder.__missing__
    monkeypatch.setattr(tokens, "WORDS", most, raising=False)
    if hashes:
        monkeypatch.setattr(tokens._Words, "_hashed", classmethod(lambda cls, words: np.array([sum(w.encode()) % hashes for w in words.to_pylist()], np.uint64)))
    monkeypatch.setattr(Encoder, "__missing__", lambda self, unit: asked.append(unit) or missing(self, unit))
    random = np.random.default_rng(3)
    word = lambda: "".join(random.choice(list("abeistÄßéñ"), random.integers(1, 9)))
    pool = [word() for _ in range(150)]
    for _ in range(4):
        texts = ["\n".join(" ".join(random.choice(pool).title() + random.choice(["", "", ".", ",", "?!", "***"]) for _ in range(9)) for _ in range(5)) for _ in range(12)]
        assert encoder.encode(texts) == [np.array(fresh(name).encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        pool[::3] = [word() for _ in pool[::3]]
    assert len(asked) < 10  # marks and line breaks
    assert len(encoder.words.words) > 100
