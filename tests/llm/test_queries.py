"""The registered queries and the pipeline over the smallest given tables, against plain Python on the same rows."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from test_text_operators import best_fit_decreasing, brute_components
from tokenizers import Tokenizer

import corpus_pipeline
from lexmill import session
from lexmill.llm import exact_dedup, language, near_dedup, packing, quality, registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()


def rows_of(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def held_out(doc_id, modulus, rest):
    return zlib.crc32(str(doc_id).encode()) % modulus == rest


def encoded(name, docs, end):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    return {d["doc_id"]: np.array([*library.encode(d["text"] or "", add_special_tokens=False).ids, end], "<u4") for d in docs}


def test_op2(spark, docs):
    ids, at, want = encoded("word_bpe_49k.json", docs, 1), 0, {}
    for d in sorted(ids):
        want[d] = (at, len(ids[d]), zlib.crc32(ids[d].tobytes()))
        at += len(ids[d])
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows_of(spark, "op2_token_binary")} == want


def test_op3(spark, docs):
    got = rows_of(spark, "op3_sharding")
    texts = {d["doc_id"]: (d["text"] or "").encode() for d in docs}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len(t) + 1, zlib.crc32(t)) for i, t in texts.items()}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    sizes = [len(slots[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    shards = defaultdict(set)
    for r in got:
        shards[texts[r.doc_id]].add(r.shard)
    groups = Counter(texts.values())
    fits = [t for t, n in groups.items() if 1 < n <= min(sizes)]
    assert sum(len(shards[t]) > 1 for t in fits) <= 0.05 * len(fits)  # labels move towards neighbours, a few may be cut


def test_op4(spark):
    table = pq.read_table(f"{SF}/embeddings.parquet", columns=["vec_id", "embedding"]).to_pydict()
    ids, v = np.array(table["vec_id"]), np.array(table["embedding"], float)
    got = defaultdict(dict)
    for r in rows_of(spark, "op4_hnsw_search"):
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    asked = [i for i in ids if i % 20 == 0]
    assert sorted(got) == sorted(asked)
    hits = 0
    for q in asked:
        scores = v @ v[ids == q][0]
        best = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
        assert sorted(got[q]) == list(range(1, len(best) + 1))
        assert all(math.isclose(s, scores[ids == i][0], rel_tol=1e-12) for i, s in got[q].values())
        order = [got[q][k] for k in sorted(got[q])]
        assert order == sorted(order, key=lambda x: (-x[1], x[0]))
        hits += len({i for i, _ in got[q].values()} & set(ids[best].tolist()))
    assert hits >= 0.9 * 20 * len(asked)


def check_packing(got, ids):
    """Pieces, places and the number of sequences, against the ids of every document."""
    lengths, places = Counter(), defaultdict(list)
    seen = Counter()
    for r in got:
        whole = ids[r.doc_id]
        first = len(whole) % 2048 or 2048
        start = 0 if r.piece == 0 else first + 2048 * (r.piece - 1)
        length = min(first, len(whole)) if r.piece == 0 else 2048
        assert (r.start, r.length, r.ids_crc32) == (start, length, zlib.crc32(whole[start : start + length].tobytes()))
        seen[r.doc_id] += 1
        lengths[r.length] += 1
        places[r.sequence_id].append((r.offset, r.length))
    assert seen == {i: -(-len(x) // 2048) for i, x in ids.items()}
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= best_fit_decreasing(lengths, 2048)


def test_op5(spark, docs):
    check_packing(rows_of(spark, "op5_best_fit_packing"), encoded("byte_bpe_50k.json", docs, 0))


def test_op6(spark, docs):
    got = rows_of(spark, "op6_minhash_dedup")
    want = brute_components([(d["doc_id"], d["text"] or "") for d in docs])
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_op7(spark, docs):
    texts = {d["doc_id"]: d["text"] or "" for d in docs}
    for r in rows_of(spark, "op7_sentencepiece"):
        assert r.round_trip == ("▁" not in texts[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].replace("▁", " ").encode()).hexdigest()
        assert (r.n_tokens > 0) == (texts[r.doc_id] != "")


def test_op9(spark, docs):
    """Flags of held-out documents, `und` for texts without letters, and the languages of held-out ones; a model made by plain counts agrees."""
    got = {r.doc_id: r for r in rows_of(spark, "op9_language_id")}
    assert sorted(got) == sorted(d["doc_id"] for d in docs)
    counts = defaultdict(lambda: np.full(language.BUCKETS, language.SMOOTHING))
    for d in docs:
        if not held_out(d["doc_id"], 3, 1) and d["lang"] and d["text"]:
            counts[d["lang"]] += np.bincount(language.trigrams(d["text"]), minlength=language.BUCKETS)
    log_p = {x: np.log(n / n.sum()) for x, n in counts.items()}
    right = total = agree = 0
    for d in docs:
        r = got[d["doc_id"]]
        assert r.held_out == held_out(d["doc_id"], 3, 1) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in d["text"] or ""):
            assert r.lang_pred == "und"
            continue
        n = np.bincount(language.trigrams(d["text"]), minlength=language.BUCKETS)
        agree += r.lang_pred == max(log_p, key=lambda x: float(n @ log_p[x]))
        if r.held_out and d["lang"]:
            total, right = total + 1, right + (r.lang_pred == d["lang"])
    assert right >= 0.97 * total and agree >= 0.97 * len(docs)


def test_op10(spark, docs):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    got = {r.doc_id: r for r in rows_of(spark, "op10_quality_classifier")}
    assert sorted(got) == sorted(d["doc_id"] for d in docs)
    texts = {d["doc_id"]: d["text"] for d in docs}
    learned = sorted(i for i in labels if i in texts and not held_out(i, 4, 2))
    rows = sorted((str(i), labels[i], quality.features(texts[i])) for i in learned)
    model = quality.fit_rows([f for _, _, f in rows], np.array([y for _, y, _ in rows]))
    for i, r in got.items():
        assert r.held_out == held_out(i, 4, 2) and r.predicted == (r.score >= 0.7)
        assert math.isclose(r.score, model.score(texts[i]), abs_tol=1e-4)
    judged = [i for i in labels if i in got and got[i].held_out]
    assert sum(got[i].predicted == labels[i] for i in judged) >= 0.9 * len(judged)


def test_margins_are_those_of_the_best_separation():
    """Dual coordinate descent against a grid over two weights and the bias of the same objective."""
    rows = [np.array(x) for x in ([1, 2], [1], [1, 3], [2], [3], [2, 3])]
    y = np.array([1, 1, 1, -1, -1, -1])
    least, quality.LEAST = quality.LEAST, 1
    epochs, quality.EPOCHS = quality.EPOCHS, 400
    try:
        weights, ratios, bias = quality._descend(rows, y)
    finally:
        quality.LEAST, quality.EPOCHS = least, epochs
    scaled = [ratios[r] / np.sqrt((ratios[r] ** 2).sum()) for r in rows]
    w = np.divide(weights, ratios, out=np.zeros_like(weights), where=ratios != 0)

    def objective(w, b):
        return 0.5 * (sum(w[k] ** 2 for k in (1, 2, 3)) + b * b) + quality.COST * sum(max(0.0, 1 - t * (sum(w[k] * s for k, s in zip(r, x, strict=True)) + b)) for r, x, t in zip(rows, scaled, y, strict=True))

    own = objective(w, bias)
    random = np.random.default_rng(0)
    for _ in range(3000):
        shift = random.normal(size=4) * random.choice([0.01, 0.1, 1.0])
        assert own <= objective({k: w[k] + shift[k] for k in (1, 2, 3)}, bias + shift[0]) + 1e-3


# the pipeline

ROWS = "doc_id long, text string, lang string, source string, n_chars long, row string, found string, score string, sha string, own string, `key` string, kept string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, near and exact copies, repeated rows, and columns with names that stages use."""
    words = "the cat and the dog were in the house and it was a good day for all of them so they went out to play".split()
    long = " ".join(words[i % len(words)] + ("" if i % 7 else "s") for i in range(30_000))
    base = " ".join(words * 3)
    texts = [(1, base), (2, base), (3, base.upper()), (4, base + " once more"), (4, base + " once more"), (5, None), (6, ""), (7, long), (8, long + " end"), (None, base), (9, "12 !!"), (None, None)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["clash"] * 7) for i, t in texts], ROWS)


@pytest.mark.parametrize("stage", range(4))
def test_stages_of_odd_rows(spark, odd, stage):
    name, run = corpus_pipeline.STAGES[stage]
    got = run(spark, odd, SF)
    assert got.columns == odd.columns and run(spark, odd.limit(0), SF).count() == 0
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    had = Counter((r.doc_id, r.text) for r in odd.collect())
    assert all(n <= had[k] for k, n in kept.items())
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    if name == "language_id":
        assert {k for k in had if not any(c.isalpha() for c in k[1] or "")}.isdisjoint(kept)
    if name == "exact_dedup":
        groups = {(t or "").translate(lower) for _, t in had}
        assert sum(kept.values()) == len(groups) and (1, odd.first().text) in kept and all(i is not None or not t for i, t in kept)
    if name == "minhash_near_dedup":
        rows = [(i, t or "") for i, t in had]
        empty = sum(not t.split() for _, t in rows)
        assert sum(kept.values()) == len({c for (_, t), (_, _, c) in zip(rows, brute_components(rows), strict=True) if t.split()}) + empty


def test_packing_stage_of_odd_rows(spark, odd):
    got = corpus_pipeline.packed(spark, odd, SF).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in odd.collect()} and corpus_pipeline.packed(spark, odd.limit(0), SF).count() == 0
    assert sum(r.piece == 0 for r in got) == odd.count()


def test_pipeline(spark, docs):
    """Each stage on what the one before it kept, against plain Python."""
    now, at = spark.read.parquet(f"{SF}/documents.parquet"), {d["doc_id"]: d["text"] or "" for d in docs}
    ids = set(at)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, session.cut(stage(spark, now, SF), name)
        kept = {r.doc_id for r in now.select("doc_id").collect()}
        assert kept <= ids and now.count() == len(kept)
        if name == "language_id":
            assert len(kept) >= 0.95 * len(ids)
        if name == "quality_classifier":
            labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
            good = [i for i in ids if labels.get(i) == 1]
            bad = [i for i in ids if labels.get(i) == 0]
            assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i in kept for i in bad) <= 0.1 * len(bad)
        if name == "exact_dedup":
            first = {}
            for i in sorted(ids):
                first.setdefault(at[i].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), i)
            assert kept == set(first.values())
        if name == "minhash_near_dedup":
            rows = [(i, at[i]) for i in sorted(ids)]
            assert kept == {c if t.split() else i for (i, t), (_, _, c) in zip(rows, brute_components(rows), strict=True)}
        ids = kept
        assert before.columns == now.columns
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == ids
    check_packing(packed, {i: x for i, x in encoded("byte_bpe_50k.json", docs, 0).items() if i in ids})


def test_names_are_refused(spark, odd):
    """Operators that add a column say so if the input has it, in whatever case."""
    from lexmill.functions.expressions import ClashingColumn

    model = quality.fit_rows([], np.empty(0, int))
    with pytest.raises(ClashingColumn):
        quality.classify(odd, model, out="Score")
    with pytest.raises(ClashingColumn):
        language.classify(odd, language.Model([], np.zeros((language.BUCKETS, 0), np.float32)), out="FOUND")
    assert near_dedup.near_duplicates(odd).count() == exact_dedup.content_groups(odd).count() == odd.count()
    assert packing.pieces(odd, public_tokenizers.path("byte_bpe_50k.json"), 0, 2048).filter("piece = 0").count() == odd.count()
