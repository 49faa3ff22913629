"""MinHash near-dedup with b-bit signatures, exact confirmation and connected components.

1. Every text becomes its set of distinct 5-word shingles (64-bit codes), a fingerprint of the set, BANDS band keys of
   ROWS minima each, and the low BITS bits of all minima, packed in bit planes. Texts with equal sets form a class;
   copies never become pairs.
2. Classes that share a band key are candidates. In each such bucket every class is paired with one hub. The matching
   low bits, counted by xor and bit count and corrected for chance collisions, estimate the similarity; pairs far below
   the threshold go, the others are confirmed on their full sets.
3. Links are joined to components by minimum labels and pointer jumping. Buckets that hold more than one component
   get a second hub, and its links join components of components; then what is not in a bucket's largest component is compared with all of that bucket that is in
   another component. So every pair of a bucket is compared, or both sides are connected already, and a large group of
   near copies costs its size, not its square.

Two sets with a similarity of exactly 0.75 share no band with probability 5e-6; the estimate drops a pair at the
threshold with probability below 1e-7.

Defined results: a null or wordless text has an empty set, is linked with nothing and is a component of its own; with
fewer than five words the sequence is one shingle; texts are used whole; rows that repeat an id are rows of their own;
rows without an id are compared as all others, and component_id is null where no row of the component has one; one row of
each component is kept, whatever ids repeat; an empty table gives an empty result; extra columns are left out, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill import session
from lexmill.llm import memory
from lexmill.llm.words import lowered, word_codes

WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, ROWS, BITS = 32, 4, 4
HASHES = BANDS * ROWS
#: Estimates this many standard deviations below the threshold are dropped without confirmation.
SIGMAS = 5.5
#: Classes of a bucket that are compared at a time.
BLOCK = 256

_random = np.random.default_rng(20240229)
_MULTIPLIERS = (_random.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1))[:, None]
_MASKS = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None]
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """Codes of a text's distinct shingles, ascending. Words are separated by ASCII white space; A-Z are lower-cased."""
    codes = word_codes(lowered(text))
    if not len(codes):
        return codes
    size = min(WORDS, len(codes))
    n = len(codes) - size + 1
    mixed = codes[:n] + np.uint64(size)
    for k in range(1, size):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX + codes[k : k + n]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
    return np.unique(mixed)


def minima(codes: np.ndarray) -> np.ndarray:
    """Minimum of every hash function over a non-empty set."""
    short = (codes >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(short), 2048):
        np.minimum(least, ((short[i : i + 2048] ^ _MASKS) * _MULTIPLIERS).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for k in range(ROWS):
        key = (key ^ (key >> np.uint64(31)) ^ rows[:, k]) * _MIX
    return (key ^ (key >> np.uint64(32))).view(np.int64)


def bit_planes(least: np.ndarray) -> np.ndarray:
    """The low BITS bits of the minima: for every 64 minima, one 64-bit word per bit."""
    planes = [np.packbits(((group >> np.uint32(b)) & np.uint32(1)).astype(np.uint8)).view(np.int64)[0] for group in least.reshape(-1, 64) for b in range(BITS)]
    return np.array(planes, np.int64)


def estimate(a: Column, b: Column) -> Column:
    """Collision-corrected similarity of two packed signatures, by bit counts."""
    differ = None
    for group in range(HASHES // 64):
        word = None
        for i in range(group * BITS, (group + 1) * BITS):
            plane = a[i].bitwiseXOR(b[i])
            word = plane if word is None else word.bitwiseOR(plane)
        differ = F.bit_count(word) if differ is None else differ + F.bit_count(word)
    chance = 2.0**-BITS
    return ((1 - differ / HASHES) - chance) / (1 - chance)


def _least_estimate() -> float:
    chance = 2.0**-BITS
    match = PERCENT / 100 * (1 - chance) + chance
    return PERCENT / 100 - SIGMAS * (match * (1 - match) / HASHES) ** 0.5 / (1 - chance)


def signatures(docs: DataFrame) -> DataFrame:
    """id, text_key, n_shingles, set_print (null for an empty set), bands and planes of every row of (id, text, text_key)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.release()
        for batch in batches:
            sizes, prints, bands, planes = [], [], [], []
            for text in batch.column(1).to_pylist():
                codes = shingles(text)
                sizes.append(len(codes))
                if len(codes):
                    least = minima(codes)
                    prints.append(xxhash.xxh3_128_digest(codes.tobytes()))
                    bands.append(band_keys(least))
                    planes.append(bit_planes(least))
                else:
                    prints.append(None)
                    bands.append(None)
                    planes.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(planes, pa.list_(pa.int64()))], names=["id", "text_key", "n_shingles", "set_print", "bands", "planes"])

    return docs.mapInArrow(task, "id long, text_key long, n_shingles long, set_print binary, bands array<long>, planes array<long>")


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """class and codes of the full sets of the wanted classes, from the text of one of their documents."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.release()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["class", "codes"])

    known = classes.select("class", "first").join(wanted.select("class").distinct(), "class", "left_semi")
    no_id = lambda c: F.struct(c.isNull().alias("none"), F.coalesce(c, F.lit(0)).alias("id"))
    keys = known.select(no_id(F.col("first.id")).alias("rep"), F.col("first.text_key").alias("rep_key"), "class")
    texts = docs.select(no_id(F.col("id")).alias("rep"), F.xxhash64("text").alias("rep_key"), "text").join(keys, ["rep", "rep_key"])
    # rows that repeat id and text have met by now, so one of them is taken without a further shuffle
    return texts.dropDuplicates(["rep", "rep_key"]).select("class", "text").mapInArrow(task, "class long, codes binary")


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b, part_a, part_b), the parts (a, b) of those whose full sets reach the threshold."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    both = pairs.join(sets.select(F.col("class").alias("a"), F.col("codes").alias("x")), "a").join(sets.select(F.col("class").alias("b"), F.col("codes").alias("y")), "b")
    return both.select("part_a", "part_b", "x", "y").mapInArrow(task, "a long, b long")


def _near(n: Column, m: Column, planes: Column, other: Column) -> Column:
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & (estimate(planes, other) >= _least_estimate())


def parts_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, part) of all classes that share a bucket: equal parts are connected, by confirmed links.

    Tables that only a round needs are removed when it ends.
    """
    spark = docs.sparkSession
    with session.scope(spark):
        keys = classes.select("class", F.explode("bands").alias("key"))
        # what is joined with buckets by their keys is a table, so that Spark can split the rows of a large bucket over tasks
        shared = session.cut(keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key"), "shared")
        members = session.cut(keys.join(shared, "key"), "buckets")
        sets = session.cut(_sets(docs, classes, members), "sets")
        parts = members.select("class").distinct().withColumn("part", F.col("class"))
        buckets = members.withColumn("part", F.col("class"))
        for hub in (F.min, F.max):
            with session.scope(spark):
                parts = _merged(parts, _confirm(_star(buckets, classes, hub), sets))
                buckets = _mixed(members, parts)
        return _merged(parts, _rest(buckets, classes, sets))


def _facts(classes: DataFrame, name: str) -> DataFrame:
    return classes.select(F.col("class").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("planes").alias(f"planes_{name}"))


def _pair_is_near() -> Column:
    return _near(F.col("n_a"), F.col("n_b"), F.col("planes_a"), F.col("planes_b"))


def _star(buckets: DataFrame, classes: DataFrame, hub: Callable[[Column], Column]) -> DataFrame:
    """Likely pairs (a, b, part_a, part_b) of every bucket's hub and its classes of other parts."""
    hubs = buckets.groupBy("key").agg(hub(F.struct("class", "part")).alias("hub")).select("key", F.col("hub.class").alias("a"), F.col("hub.part").alias("part_a"))
    star = buckets.join(session.cut(hubs, "hubs"), "key").filter("part <> part_a").select("a", F.col("class").alias("b"), "part_a", F.col("part").alias("part_b")).distinct()
    return session.cut(star.join(_facts(classes, "b"), "b").join(_facts(classes, "a"), "a").filter(_pair_is_near()).select("a", "b", "part_a", "part_b"), "pairs")


def _merged(parts: DataFrame, found: DataFrame) -> DataFrame:
    """The parts when those that links connect (a, b) are joined."""
    roots = components(found.distinct()).select(F.col("class").alias("part"), "label")
    return session.cut(parts.join(roots, "part", "left").select("class", F.coalesce("label", "part").alias("part")), "parts", outer=True)


def _mixed(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Members (key, class, part) of the buckets that still hold more than one part."""
    known = session.cut(members.join(parts, "class"), "known")
    open_ = known.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most")).filter("least <> most").select("key")
    return session.cut(known.join(session.cut(open_, "open"), "key"), "buckets", outer=True)


def _rest(buckets: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Parts (a, b) that a link connects, of what is not in a bucket's largest part and what is in another part of the bucket.

    Only classes with a likely partner are dealt out with their sets.
    """
    largest = buckets.groupBy("key", "part").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("part", F.struct("n", "part")).alias("largest"))
    apart = buckets.join(session.cut(largest, "largest"), "key").filter("part <> largest").join(_facts(classes, "a"), F.col("class") == F.col("a"))
    apart = session.cut(apart.select("key", "a", "n_a", "planes_a", F.col("part").alias("part_a")), "apart")
    open_ = session.cut(apart.select("key").distinct(), "open")
    others = buckets.join(open_, "key").join(_facts(classes, "b"), F.col("class") == F.col("b"))
    others = session.cut(others.select(F.col("key").alias("key_b"), "b", "n_b", "planes_b", F.col("part").alias("part_b")), "others")
    likely = (F.col("key") == F.col("key_b")) & (F.col("part_a") != F.col("part_b")) & _pair_is_near()
    asked = apart.join(others, likely, "left_semi").select("key", F.col("a").alias("class"), F.col("part_a").alias("part"), F.lit(True).alias("asked"))
    met = others.join(apart, likely, "left_semi").select(F.col("key_b").alias("key"), F.col("b").alias("class"), F.col("part_b").alias("part"), F.lit(True).alias("met"))
    rows = asked.unionByName(met, allowMissingColumns=True).groupBy("key", "class", "part").agg(F.max("asked").alias("asked"), F.max("met").alias("met"))
    return _links_in_blocks(classes, sets, session.cut(rows, "likely"))


def _links_in_blocks(classes: DataFrame, sets: DataFrame, rows: DataFrame) -> DataFrame:
    """Parts (a, b) that a link connects, of the asked and the met of other parts in their buckets (key, class, part, asked, met).

    A bucket is cut into blocks of about BLOCK classes, and every block of asked ones meets every block of met ones in
    one row; the pairs are tested inside of tasks. A pair is tested in the first bucket that it shares.
    """
    blocks = session.cut(rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "blocks")
    rows = rows.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
    facts = classes.select("class", "planes", "bands").join(sets, "class")
    rows = rows.join(facts, "class").select("key", "block", "blocks", "asked", "met", F.struct("part", "planes", "bands", "codes").alias("m"))
    whole = rows.filter("met").groupBy("key", "block").agg(F.collect_list("m").alias("members"))
    some = rows.filter("asked").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("block").alias("own"), "m")
    some = some.groupBy("key", "block", "own").agg(F.collect_list("m").alias("asked"))
    work = some.join(whole, ["key", "block"])
    return session.cut(work.select("key", "asked", "members").mapInArrow(_test_blocks, "a long, b long"), "links")


def _test_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def unpacked(rows: list[dict]) -> tuple:
        columns = (np.array([r[c] for r in rows], np.int64) for c in ("part", "planes", "bands"))
        return *columns, [np.frombuffer(r["codes"], np.uint64) for r in rows]

    for batch in batches:
        found = []
        for i in range(batch.num_rows):
            key, asked, members = (batch.column(c)[i].as_py() for c in range(3))
            part_a, planes_a, bands_a, sets_a = unpacked(asked)
            part_b, planes_b, bands_b, sets_b = unpacked(members)
            size_a, size_b = (np.array([len(x) for x in sets]) for sets in (sets_a, sets_b))
            differ = np.zeros((len(part_a), len(part_b)), np.int64)
            for group in range(HASHES // 64):
                word = np.zeros_like(differ)
                for plane in range(group * BITS, (group + 1) * BITS):
                    word |= planes_a[:, None, plane] ^ planes_b[None, :, plane]
                differ += np.bitwise_count(word.view(np.uint64))
            chance = 2.0**-BITS
            near = ((1 - differ / HASHES) - chance) / (1 - chance) >= _least_estimate()
            near &= part_a[:, None] != part_b[None, :]
            near &= 100 * np.minimum(size_a[:, None], size_b[None, :]) >= PERCENT * np.maximum(size_a[:, None], size_b[None, :])
            joined = set()
            for x, y in zip(*np.nonzero(near), strict=True):
                shared = bands_a[x] == bands_b[y]
                pair = int(part_a[x]), int(part_b[y])
                if pair in joined or bands_a[x, shared.argmax()] != key:
                    continue
                common = len(np.intersect1d(sets_a[x], sets_b[y], assume_unique=True))
                if 100 * common >= PERCENT * (size_a[x] + size_b[y] - common):
                    joined.add(pair)
                    found.append(pair)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(class, label) of all that edges (a, b) touch: the label is the smallest class reachable."""
    both = session.cut(edges.select(F.col("a").alias("class"), F.col("b").alias("to")).union(edges.select(F.col("b"), F.col("a"))), "edges")
    now = session.cut(both.groupBy("class").agg(F.least("class", F.min("to")).alias("label")), "labels")
    while True:
        offered = both.join(now, "class").select(F.col("to").alias("class"), "label")
        met = now.withColumn("was", F.col("label")).unionByName(offered, allowMissingColumns=True).groupBy("class").agg(F.min("label").alias("label"), F.min("was").alias("was"))
        met = session.cut(met, "labels")
        # a label is a class too: what that class has by now is as good
        new = met.join(met.select(F.col("class").alias("label"), F.col("label").alias("next")), "label", "left").select("class", F.coalesce("next", "label").alias("label"))
        if not met.filter("label <> was").limit(1).count():
            return met.select("class", "label")
        now = session.cut(new, "labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, text_key, n_shingles, component_id (smallest id reachable over links), kept (one row per component).

    text_key is xxhash64 of the text; with the id it tells a row's document apart from others that repeat its id. Kept is
    the row with the smallest id; of rows that repeat it, the one with the smallest text_key; of equal rows, any one.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = signatures(docs.withColumn("text_key", F.xxhash64("text"))).withColumn("row", F.monotonically_increasing_id())
    rows = session.cut(rows, "signatures")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key", "row")).alias("first")
    classes = rows.filter("set_print is not null").groupBy("set_print").agg(first, F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("planes").alias("planes"))
    classes = session.cut(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    parts = parts_of(docs, classes).join(classes.select("class", "first"), "class")
    smallest = parts.join(parts.groupBy("part").agg(F.min("first").alias("best")), "part").select("class", "best")
    whole = classes.select("class", "set_print", "first").join(smallest, "class", "left").select("set_print", F.coalesce("best", "first").alias("best"))
    out = rows.select("id", "text_key", "n_shingles", "set_print", "row").join(whole, "set_print", "left")
    alone = F.col("set_print").isNull()
    component = F.when(alone, F.col("id")).otherwise(F.col("best.id"))
    return out.select("id", "text_key", "n_shingles", component.alias("component_id"), (alone | (F.col("row") == F.col("best.row"))).alias("kept"))
