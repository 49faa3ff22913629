"""A stored full-text index: segments of sorted postings, each written once, and BM25 over them.

A segment holds the postings of the documents that came with one change. Every document's tokens are joined inside of its row,
and a term's postings inside of a batch, so one shuffle of lists brings the postings to ranges of terms, by splitters from a sample;
a term that is a splitter is dealt to all ranges that it touches. In a range the postings stand by term, those that add most to a
score first, in blocks of BLOCK; a block says what its best posting adds at most. So a search for words reads

1. the sizes and bests of the terms' blocks, without their postings,
2. the best blocks, whose k-th best document is a bound,
3. the blocks whose best posting, with the bests of all other terms, can reach the bound.

A document in a block that is left out can't be among the k best, so the hits are those of a full scan. Phrases and
prefixes need all postings of their terms; these are joined by document once, and kept while they are counted and scored.

A document that is removed stays in its segment, its id goes on the list of gone ones, and what it added to the
statistics is noted as a negative part of its segment. Segments of like size are merged. Every document has a posting of
the empty term, by which documents and tokens are counted.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill import session
from lexmill.operators.fulltext import Operand, all_folded, idf, impact, operands, sanitize, tokens, unfolded_text
from lexmill.operators.fulltext import postings as fulltext_postings
from lexmill.sources.store import Part, State, Store, Table

#: Postings of a block; documents that splitters are chosen from; documents for each range of terms at least, and about at most.
BLOCK, SAMPLE, LEAST_RANGE, MOST_RANGE = 256, 1000, 500, 4000
#: Postings from which on it pays to look for a bound first.
PRUNE_FROM = 1000 * BLOCK
#: Blocks whose sizes may be added up by the driver; of more they are added up before.
FEW_BLOCKS = 10_000
#: Rows that a Python worker gets at once when postings are put into blocks.
BATCH = 4000
#: Tokens whose postings a Python worker makes at once, unless one document has more; postings of a term that it puts in order at once.
MOST_TOKENS, MOST_HELD = 250_000, 1_000_000
#: Postings that are joined by term before the shuffle.
LISTED = 500_000
#: Partitions of documents for each core, from which on they are not dealt out anew.
PER_CORE = 4

#: The empty term, of every document.
EVERY = ""


@dataclass(frozen=True)
class Index:
    """An index as a state of its store has it."""

    store: Store
    state: State
    name: str
    id_col: str
    id_type: str

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    @property
    def segments(self) -> tuple[Part, ...]:
        return self.state.table(self.name).parts

    def _total(self, what: str) -> int:
        live = {s.seq for s in self.segments}
        less = sum(n for p in self.state.table(f"{self.name}-less").parts for s, n in p.info[what].items() if int(s) in live)
        return sum(s.info[what] for s in self.segments) - less

    @property
    def documents(self) -> int:
        return self._total("documents")

    @property
    def mean_length(self) -> float:
        return self._total("tokens") / self.documents if self.documents else 0.0

    def blocks(self, ranges: dict[int, list[int]] | None = None) -> DataFrame:
        """seq, term, n, top, base, ids, lengths, tfs and positions of blocks; only of some ranges by segment, if these are given."""
        found = []
        for s in self.segments:
            root = f"{self.store.path}/{s.path}"
            wanted = sorted(set(s.info["ranges"]) & set(ranges[s.seq])) if ranges is not None else s.info["ranges"]
            if wanted:
                rows = self.spark.read.schema(self._schema()).option("basePath", root).parquet(*[f"{root}/range={r}" for r in wanted])
                found.append(rows.drop("range").withColumns({"seq": F.lit(s.seq), "base": F.lit(s.info["base"])}))
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], f"{self._schema()}, seq int, base double").drop("range")

    def _schema(self) -> str:
        return f"term string, n int, top double, ids array<{self.id_type}>, lengths array<int>, tfs array<int>, positions array<array<int>>, range int"

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows (seq, id) of documents that aren't gone."""
        table = self.state.table(self.name)
        if not table.gone:
            return rows
        lists = self.spark.read.parquet(*[f"{self.store.path}/{g.path}" for g in table.gone])
        gone = lists.groupBy(F.col(self.id_col).alias("gone_id")).agg(F.max("seq").alias("gone_seq"))
        return rows.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("seq") < F.col("gone_seq")), "left_anti")

    def ranges_of(self, asked: set[tuple[str, bool]]) -> dict[int, list[int]]:
        """By segment, the ranges that hold terms; (term, True) stands for all that begin with it."""
        found = {}
        for s in self.segments:
            splitters = s.info["splitters"]
            hits: set[int] = set()
            for term, prefix in asked:
                last = len(splitters) if prefix and not term else bisect_right(splitters, term + chr(0x10FFFF) if prefix else term)
                hits |= set(range(bisect_left(splitters, term), last + 1))
            found[s.seq] = sorted(hits)
        return found


def _test(asked: set[tuple[str, bool]]) -> Column:
    test = F.col("term").isin(sorted(t for t, prefix in asked if not prefix))
    return reduce(lambda a, b: a | b, [F.col("term").startswith(t) for t, prefix in asked if prefix], test)


# building


def _splitters(docs: DataFrame, rows: int, ranges: int) -> tuple[list[str], float]:
    """Terms that part the postings of a sample of texts into ranges of like size, and its mean length. A frequent term stands more than once."""
    sample = docs.sample(min(1.0, SAMPLE / max(1, rows)), 17) if rows > SAMPLE else docs
    sample = sample.select(tokens(F.col("text")).alias("tokens"))
    counts = sample.select(F.size("tokens").alias("size"), F.explode(F.concat(F.array(F.lit(EVERY)), F.array_distinct("tokens"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    upto = F.sum("n").over(Window.orderBy("term"))  # the terms of SAMPLE documents
    whole = F.sum("n").over(Window.partitionBy())
    part = lambda n: F.floor(n * ranges / F.col("whole"))
    found = counts.withColumns({"upto": upto, "whole": whole}).withColumn("times", F.least(part(F.col("upto")), F.lit(ranges - 1)) - part(F.col("upto") - F.col("n")))
    found = found.filter((F.col("times") > 0) | (F.col("term") == EVERY)).orderBy("term").collect()
    every = next((r for r in found if r["term"] == EVERY), None)
    return [r["term"] for r in found for _ in range(r["times"])], max(1.0, every["size"] / every["n"]) if every else 1.0


def _ranges(spark: SparkSession, documents: int) -> int:
    """Ranges of terms for so many documents: as many as there are partitions, or more, so that none has too much to sort."""
    return max(min(session.n_partitions(spark), 1 + documents // LEAST_RANGE), documents // MOST_RANGE)


def _few_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (id, salt, tokens) in parts of at most MOST_TOKENS, or of one document."""
    for batch in batches:
        ends, at = np.asarray(batch.column(2).offsets), 0
        while at < len(batch):
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] + MOST_TOKENS, "right")) - 1)
            yield batch.slice(at, upto - at)
            at = upto


def _tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(id, salt, text of unfolded tokens with a space between) as (id, salt, tokens)."""
    found = pc.split_pattern(batch.column(2).cast(pa.string()), " ")
    flat = found.flatten()
    sizes = np.diff(np.asarray(found.offsets))
    sizes[pc.equal(batch.column(2), "").to_numpy(zero_copy_only=False)] = 0
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), flat.filter(pc.not_equal(flat, "")))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["id", "salt", "tokens"])


def _postings(splitters: list[str], base: float):
    """A task: documents (id, salt, unfolded tokens) to postings (range, term, id, length, tf, positions, impact), joined within each document."""
    splits = np.array(splitters, object)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few_tokens(batches):
            ids, salt, lists = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            offsets = np.asarray(lists.offsets)
            sizes = np.diff(offsets)
            docs = np.repeat(np.arange(len(ids)), sizes)
            coded = lists.flatten().dictionary_encode()
            # each distinct token is folded once
            accented = pc.invert(pc.string_is_ascii(coded.dictionary))
            plain = pc.replace_with_mask(coded.dictionary, accented, pa.array(all_folded(coded.dictionary.filter(accented).to_pylist()), pa.string()))
            plain = pa.concat_arrays([plain, pa.array([EVERY])]).dictionary_encode()
            names, of = plain.dictionary, plain.indices.to_numpy().astype(np.int64)
            codes = of[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.int64)
            places = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            order = np.argsort(docs * len(names) + codes, kind="stable")
            code, doc = codes[order], docs[order]
            starts = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1]))) if len(order) else np.empty(0, np.int64)
            tf = np.diff(np.append(starts, len(order)))
            # and the empty term of every document
            code, doc = np.append(code[starts], np.full(len(ids), of[-1])), np.append(doc[starts], np.arange(len(ids)))
            ends = np.concatenate((starts, [len(order)], np.full(len(ids), len(order))))
            tf = np.append(tf, np.zeros(len(ids), np.int64))
            length = sizes[doc]
            found = names.to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(splits, found, "left"), np.searchsorted(splits, found, "right")
            where = low[code] + salt[doc] % (high - low + 1)[code]
            added = impact(tf, length, base)
            positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places[order], pa.int32()))
            columns = [pa.array(where, pa.int32()), names.take(pa.array(code)), ids.take(pa.array(doc)), pa.array(length, pa.int32()), pa.array(tf, pa.int32()), positions, pa.array(added, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["range", "term", "id", "length", "tf", "positions", "impact"])

    return task


def _dealt(splitters: list[str]):
    """A task: postings (term, id, salt, length, tf, positions) with the range that each goes to, instead of the salt."""
    splits = np.array(splitters, object)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column("term").dictionary_encode()
            found, code = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
            low, high = np.searchsorted(splits, found, "left"), np.searchsorted(splits, found, "right")
            where = low[code] + batch.column("salt").to_numpy() % (high - low + 1)[code]
            names = ["term", "id", "length", "tf", "positions"]
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), *map(batch.column, names)], names=["range", *names])

    return task


def _many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have LISTED rows; none is empty."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(map(len, held)) >= LISTED:
            yield _one(held)
            held = []
    if held:
        yield _one(held)


def _in_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings (range, term, id, length, tf, positions) as (range, term, ids, lengths, tfs, places): a row for each term and range of LISTED postings, with all positions in a row."""
    for batch in _many(batches):
        coded = batch.column("term").dictionary_encode()
        key = batch.column("range").to_numpy().astype(np.int64) * len(coded.dictionary) + coded.indices.to_numpy()
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
        at = pa.array(order)
        ids, lengths, tfs, positions = (batch.column(c).take(at) for c in ("id", "length", "tf", "positions"))
        ends = np.append(first, len(order))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (ids, lengths, tfs)]
        places = pa.ListArray.from_arrays(pa.array(np.asarray(positions.offsets)[ends], pa.int32()), positions.values)
        heads = pa.array(order[first])
        yield pa.RecordBatch.from_arrays([batch.column("range").take(heads), batch.column("term").take(heads), *lists, places], names=["range", "term", "ids", "lengths", "tfs", "places"])


def _packed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Lists of postings whose lengths, tfs and places are bytes of 32-bit integers, which Spark moves at once and not one by one."""
    columns = {name: batch.column(name) for name in batch.schema.names}
    for name in ("lengths", "tfs", "places"):
        ends = np.asarray(columns[name].offsets).astype(np.int64)
        data = pa.py_buffer(np.ascontiguousarray(columns[name].flatten().to_numpy(), "<i4"))
        columns[name] = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer((4 * (ends - ends[0])).astype(np.int32)), data])
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _unpacked(batch: pa.RecordBatch) -> pa.RecordBatch:
    """What `_packed` was made of."""
    columns = {name: batch.column(name) for name in batch.schema.names}
    for name in ("lengths", "tfs", "places"):
        _, ends, data = columns[name].cast(pa.binary()).buffers()
        ends = np.frombuffer(ends, np.int32)[batch.column(name).offset :][: len(batch) + 1] // 4 if len(batch) else np.zeros(1, np.int32)
        values = np.frombuffer(data or b"", "<i4", int(ends[-1] - ends[0]), 4 * int(ends[0])).astype(np.int32, copy=False)
        columns[name] = pa.ListArray.from_arrays(pa.array(ends - ends[0]), pa.array(values))
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _blocks_of(batch: pa.RecordBatch, base: float) -> pa.RecordBatch:
    """Lists of postings that stand by range and term as blocks: a term's postings, the best first, BLOCK at most."""
    term, where = batch.column("term").dictionary_encode().indices.to_numpy(), batch.column("range").to_numpy()
    head = np.append(True, (term[1:] != term[:-1]) | (where[1:] != where[:-1]))
    group = np.repeat(np.cumsum(head) - 1, np.diff(np.asarray(batch.column("ids").offsets)))
    ids, lengths, tfs = (batch.column(c).flatten() for c in ("ids", "lengths", "tfs"))
    tf = tfs.to_numpy()
    added = impact(tf, lengths.to_numpy(), base)
    order = pc.sort_indices(pa.table({"group": group, "added": -added, "id": ids}), [("group", "ascending"), ("added", "ascending"), ("id", "ascending")])
    positions = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tf)), pa.int32()), batch.column("places").flatten())
    runs = np.bincount(group)
    blocks = -(-runs // BLOCK)
    starts = np.repeat(np.cumsum(runs) - runs, blocks) + BLOCK * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    ends = np.append(starts, len(group))
    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), c.take(order)) for c in (ids, lengths, tfs, positions)]
    rows = pa.array(np.repeat(np.flatnonzero(head), blocks))
    top = pa.array(added[order.to_numpy()[starts]])
    return pa.RecordBatch.from_arrays([batch.column("range").take(rows), batch.column("term").take(rows), pa.array(np.diff(ends), pa.int32()), top, *lists], names=["range", "term", "n", "top", "ids", "lengths", "tfs", "positions"])


def _in_blocks(base: float):
    """A task: sorted lists of postings to blocks. A term's lists are put in order together, or MOST_HELD postings of it at once."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the lists of the last term, which may go on
        for batch in batches:
            if not len(batch):
                continue
            term, where = batch.column("term").dictionary_encode().indices.to_numpy(), batch.column("range").to_numpy()
            others = np.flatnonzero((term != term[-1]) | (where != where[-1]))
            last = int(others[-1]) + 1 if len(others) else 0
            name = lambda b: (b.column("range")[0].as_py(), b.column("term")[0].as_py())
            if held and (last or name(held[0]) != name(batch)):
                yield _blocks_of(_one([*held, batch.slice(0, last)]), base)
                held = []
            elif last:
                yield _blocks_of(_one([batch.slice(0, last)]), base)
            held.append(batch.slice(last))
            if sum(len(b.column("ids").flatten()) for b in held) >= MOST_HELD:
                yield _blocks_of(_one(held), base)
                held = []
        if held:
            yield _blocks_of(_one(held), base)

    return task


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Batches as one, from its first value on."""
    whole = pa.concat_arrays([b.to_struct_array() for b in batches if len(b)])
    return pa.RecordBatch.from_struct_array(whole.take(pa.array(np.arange(len(whole)))))


def _salt() -> Column:
    """By which a document's postings of a term in many ranges are dealt out."""
    return F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("salt")


def _lists(id_type: str) -> str:
    return f"range int, term string, ids array<{id_type}>, lengths binary, tfs binary, places binary"


def _write(store: Store, base: State, name: str, rows: DataFrame, id_type: str, splitters: list[str], mean: float, id_col: str) -> Part | None:
    """Packed lists of postings (range, term, ids, lengths, tfs, places) as a segment."""
    spark, blocks = store.spark, _in_blocks(mean)
    # a task writes one range, so it needs no sort by it
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH), "spark.sql.maxConcurrentOutputFileWriters": "2"}
    kept = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        dealt = rows.repartitionById(len(splitters) + 1, "range").sortWithinPartitions("term", "range")  # first by what differs in a partition
        made = dealt.mapInArrow(lambda batches: blocks(map(_unpacked, batches)), f"range int, term string, n int, top double, ids array<{id_type}>, lengths array<int>, tfs array<int>, positions array<array<int>>")
        path = store.folder(name)
        made.write.partitionBy("range").parquet(f"{store.path}/{path}")
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    files, place = session.files(spark, f"{store.path}/{path}")
    ranges = sorted(int(f.getPath().getName().removeprefix("range=")) for f in files.listStatus(place) if f.isDirectory() and f.getPath().getName().startswith("range="))
    if not ranges:
        return None
    first = [r for r in ranges if r <= bisect_right(splitters, EVERY)]
    written = spark.read.schema(f"term string, n int, lengths array<int>, range int").option("basePath", f"{store.path}/{path}").parquet(*[f"{store.path}/{path}/range={r}" for r in first])
    total = written.filter(F.col("term") == EVERY).agg(F.sum("n").alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tokens")).first()
    info = {"documents": total["n"], "tokens": total["tokens"], "splitters": splitters, "ranges": ranges, "base": mean, "id_col": id_col, "id_type": id_type}
    return Part(path, base.version + 1, total["n"], info)


def _unfolded(rows: DataFrame, n: int) -> DataFrame:
    """id, salt and the text of unfolded tokens of n rows (id, text), dealt out anew if partitions are few for the cores."""
    spark = rows.sparkSession
    most = session.n_partitions(spark)
    if rows.rdd.getNumPartitions() < min(most, PER_CORE * spark.sparkContext.defaultParallelism) and n > LEAST_RANGE:
        rows = rows.repartition(most, "id")
    return rows.select("id", _salt(), unfolded_text(F.col("text")).alias("tokens"))


def inverted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`fulltext.postings`: term, id, tf and positions. Postings of an id are made where its text is, without a shuffle; only rows whose ids repeat, null ones too, meet."""
    again = session.cut(docs.groupBy(F.col(id_col).alias("again")).agg(F.count("*").alias("rows")).filter("rows > 1"), "again")
    n, kind = docs.count(), docs.schema[id_col].dataType.simpleString()
    rows, repeated = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), None
    if not again.isEmpty():
        same = F.col("id").eqNullSafe(F.col("again"))
        rows, repeated = rows.join(again, same, "left_anti"), rows.join(again, same, "left_semi")
    postings = _postings([], 1.0)
    made = _unfolded(rows, n).mapInArrow(lambda batches: postings(map(_tokens, batches)), f"range int, term string, id {kind}, length int, tf int, positions array<int>, impact double")
    found = made.filter(F.col("term") != EVERY).select("term", F.col("id").alias(id_col), F.col("tf").cast("long").alias("tf"), "positions")
    return found if repeated is None else found.unionByName(fulltext_postings(repeated, "id", "text").withColumnRenamed("id", id_col))


def segment(store: Store, base: State, name: str, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Part | None:
    """A segment of documents, to be committed after `base`. Ids should be unique; null texts count as empty."""
    n = docs.count()
    if not n:
        return None
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    splitters, mean = _splitters(rows.select("text"), n, _ranges(store.spark, n))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = _unfolded(rows, n)
    postings = _postings(splitters, mean)
    made = rows.mapInArrow(lambda batches: map(_packed, _in_lists(postings(map(_tokens, batches)))), _lists(kind))
    return _write(store, base, name, made, kind, splitters, mean, id_col)


def added(store: Store, base: State, name: str, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, Table]:
    """The index's tables with documents that it doesn't hold."""
    return {name: base.table(name).plus(segment(store, base, name, docs, id_col, text_col))}


def removed(store: Store, base: State, name: str, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, Table]:
    """The index's tables without documents, given as they were added."""
    index = opened(store, name, base)
    if not index.segments:
        return {}
    gone = store.without(base, name, docs, id_col)
    every = index.live(_spread(index.blocks(index.ranges_of({(EVERY, False)})).filter(F.col("term") == EVERY)))
    texts = docs.select(F.col(id_col).alias("of"), tokens(F.col(text_col)).alias("tokens"))
    own = every.select("seq", "id").join(texts, F.col("id") == F.col("of"))
    terms = own.select("seq", F.size("tokens").alias("size"), F.explode(F.concat(F.array(F.lit(EVERY)), F.array_distinct("tokens"))).alias("term"))
    less = store.put(base, f"{name}-less", terms.groupBy("seq", "term").agg(F.count("*").alias("n"), F.sum("size").alias("size")).repartitionByRange("term").sortWithinPartitions("term"))
    if less is None:
        return {}
    sums = store.spark.read.parquet(f"{store.path}/{less.path}").filter(F.col("term") == EVERY).collect()  # a row for each segment
    info = {"documents": {str(r["seq"]): r["n"] for r in sums}, "tokens": {str(r["seq"]): r["size"] for r in sums}}
    return {name: gone, f"{name}-less": base.table(f"{name}-less").plus(Part(less.path, less.seq, less.rows, info))}


def merged(store: Store, base: State, name: str) -> dict[str, Table] | None:
    """The index's tables with crowded segments merged, without what is gone from them; None if there is nothing to do."""
    table = base.table(name)
    crowd = store.crowded(table)
    if not crowd:
        return None
    index = opened(store, name, State(base.version, {name: Table(tuple(crowd), table.gone)}))
    rows = index.live(_spread(index.blocks()))
    # their splitters are samples of like size, so every so many of all of them part the whole
    every = sorted(t for s in crowd for t in s.info["splitters"])
    ranges = _ranges(store.spark, sum(s.rows for s in crowd))
    splitters = [every[i * len(every) // ranges] for i in range(1, ranges)] if every else []
    mean = max(1.0, sum(s.info["tokens"] for s in crowd) / sum(s.rows for s in crowd))
    dealt = _dealt(splitters)
    rows = rows.select("term", "id", _salt(), "length", "tf", "positions")
    made = rows.mapInArrow(lambda batches: map(_packed, _in_lists(dealt(batches))), _lists(index.id_type))
    part = _write(store, base, name, made, index.id_type, splitters, mean, index.id_col)
    left = Table(tuple(s for s in table.parts if s not in crowd), table.gone).plus(part).minus(None)
    live = {s.seq for s in left.parts}
    less = base.table(f"{name}-less")
    return {name: left, f"{name}-less": Table(tuple(p for p in less.parts if live & {int(s) for s in p.info["documents"]}))}


def opened(store: Store, name: str = "index", state: State | None = None) -> Index:
    state = store.state() if state is None else state
    parts = state.table(name).parts
    info = parts[0].info if parts else {"id_col": "doc_id", "id_type": "bigint"}
    return Index(store, state, name, info["id_col"], info["id_type"])


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", name: str = "index") -> Index:
    """An index of its own at a path: what stands there already is opened."""
    store = Store(docs.sparkSession, path)
    return opened(store, name, store.change(lambda s: None if name in s.tables else added(store, s, name, docs, id_col, text_col)))


def open_index(spark: SparkSession, path: str, name: str = "index") -> Index:
    return opened(Store(spark, path), name)


# searching


def _spread(blocks: DataFrame) -> DataFrame:
    """seq, term, id, length, tf, positions: a row for each posting of blocks."""
    return blocks.select("seq", "term", F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("lengths").alias("length"), F.col("tfs").alias("tf"), F.col("positions").alias("positions"))))


def _spread_counts(blocks: DataFrame) -> DataFrame:
    """The same without positions, which are not read then."""
    return blocks.select("seq", "term", F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("lengths").alias("length"), F.col("tfs").alias("tf"))))


def term_counts(index: Index, terms: set[str]) -> dict[str, tuple[int, float]]:
    """df and top (what a posting adds at most, at the index's mean length) of the terms that are held, from the sizes of blocks."""
    asked = {(t, False) for t in terms}
    mean = F.lit(index.mean_length or 1.0)
    held = index.blocks(index.ranges_of(asked)).filter(_test(asked)).select("term", "n", (F.col("top") * F.greatest(F.lit(1.0), mean / F.col("base"))).alias("top"))
    live = [s.seq for s in index.segments]
    for part in index.state.table(f"{index.name}-less").parts:
        less = index.spark.read.parquet(f"{index.store.path}/{part.path}").filter(_test(asked) & F.col("seq").isin(live))
        held = held.unionByName(less.select("term", (-F.col("n")).alias("n"), F.lit(0.0).alias("top")))
    if index.documents * len(terms) > FEW_BLOCKS * BLOCK:
        held = held.groupBy("term").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    found: dict[str, tuple[int, float]] = {}
    for r in held.collect():
        df, top = found.get(r["term"], (0, 0.0))
        found[r["term"]] = df + r["n"], max(top, r["top"])
    return {t: x for t, x in found.items() if x[0] > 0}


def frequencies(index: Index, asked: list[Operand]) -> DataFrame:
    """id, length and tf0, tf1, ... of every document that matches an operand. Overlapping phrases count."""
    term = F.col("term")
    wanted = {(o.terms[i], o.prefix and i == len(o.terms) - 1) for o in asked for i in range(len(o.terms))}
    rows = index.live(_spread(index.blocks(index.ranges_of(wanted)).filter(_test(wanted))))

    def matches(operand: Operand, i: int) -> Column:
        last = operand.prefix and i == len(operand.terms) - 1
        return term.startswith(operand.terms[i]) if last else term == operand.terms[i]

    def begins(operand: Operand, i: int) -> Column:
        """Where a phrase would begin for its i-th term to stand where it does."""
        return F.flatten(F.collect_list(F.when(matches(operand, i), F.transform("positions", lambda p: p - i))))

    sums: list[Column] = []
    for o in asked:
        if not o.terms:
            sums.append(F.lit(0).cast("long"))
        elif len(o.terms) == 1:
            sums.append(F.sum(F.when(matches(o, 0), F.col("tf")).otherwise(0)))
        else:
            sums.append(F.size(reduce(F.array_intersect, [begins(o, i) for i in range(len(o.terms))])).cast("long"))
    return rows.groupBy("id").agg(F.first("length").alias("length"), *[c.alias(f"tf{i}") for i, c in enumerate(sums)])


@dataclass(frozen=True)
class Plan:
    """What a search for words reads: by term, its weight and the least that a block's best posting must add."""

    weights: dict[str, float]
    least: dict[str, float]
    few: bool = False  # fewer than PRUNE_FROM postings, which one task joins

    def blocks(self, index: Index) -> DataFrame:
        found = index.blocks(index.ranges_of({(t, False) for t in self.weights}))
        scale = F.greatest(F.lit(1.0), F.lit(index.mean_length or 1.0) / F.col("base"))
        tests = [(F.col("term") == t) & (F.col("top") * scale >= least) for t, least in sorted(self.least.items())]
        return found.filter(reduce(lambda a, b: a | b, tests, F.lit(False)))

    def scored(self, index: Index, asked: list[Operand], within: DataFrame | None) -> DataFrame:
        """id and score of the documents in these blocks."""
        rows = index.live(_spread_counts(self.blocks(index)))
        if within is not None:
            rows = rows.join(within.select(F.col(index.id_col).alias("id")).distinct(), "id", "left_semi")
        tfs = [F.max(F.when(F.col("term") == t, F.col("tf")).otherwise(0)).alias(f"tf{i}") for i, t in enumerate(self.weights)]
        found = (rows.coalesce(1) if self.few else rows).groupBy("id").agg(F.first("length").alias("length"), *tfs)
        at = {t: i for i, t in enumerate(self.weights)}
        adds = lambda t: F.when(F.col(f"tf{at[t]}") > 0, self.weights[t] * impact(F.col(f"tf{at[t]}"), F.col("length"), F.lit(index.mean_length or 1.0))).otherwise(0.0)
        return found.select("id", reduce(lambda a, b: a + b, [adds(o.terms[0]) for o in asked if o.terms and o.terms[0] in at], F.lit(0.0)).alias("score"))


def plan(index: Index, asked: list[Operand], k: int, within: DataFrame | None = None) -> Plan:
    """Which blocks a search for single words must read for the k best."""
    times: dict[str, int] = {}
    for o in asked:
        for t in o.terms:
            times[t] = times.get(t, 0) + 1
    counts = term_counts(index, set(times)) if times else {}
    weights = {t: idf(index.documents, counts[t][0]) for t in times if t in counts}
    postings = sum(df for df, _ in counts.values())
    whole = Plan(weights, dict.fromkeys(weights, 0.0), postings < PRUNE_FROM)
    if whole.few:
        return whole
    # the blocks whose best postings add most
    scale = F.greatest(F.lit(1.0), F.lit(index.mean_length or 1.0) / F.col("base"))
    weigh = reduce(lambda c, t: c.when(F.col("term") == t, F.lit(times[t] * weights[t])), weights, F).otherwise(0.0)
    heads = whole.blocks(index).select("term", "n", (F.col("top") * scale).alias("top"), weigh.alias("weight"))
    best = heads.orderBy(F.desc(F.col("top") * F.col("weight"))).limit(2 + 2 * (k // BLOCK)).collect()
    first = {t: min(r["top"] for r in best if r["term"] == t) for t in {r["term"] for r in best}}
    top = Plan(weights, first).scored(index, asked, within).orderBy(F.desc("score")).limit(k).agg(F.count("*").alias("n"), F.min("score").alias("score")).first()
    if top["n"] < k:
        return whole
    bests = {t: times[t] * weights[t] * counts[t][1] for t in weights}
    bound = top["score"] * (1 - 1e-9)
    return Plan(weights, {t: max(0.0, (bound - sum(b for o, b in bests.items() if o != t)) / (times[t] * weights[t]) * (1 - 1e-9)) for t in weights})


def bm25(index: Index, query: str | list[Operand], k: int, within: DataFrame | None = None) -> DataFrame:
    """id, bm25 (negative, smaller is better) of the k best documents that match any operand; ties go to the smaller id.

    Each operand of a repeated phrase counts again. `within`, a table with the id column, narrows the hits before the
    limit; document frequencies and lengths are of all documents.
    """
    asked = operands(sanitize(query)) if isinstance(query, str) else query
    if all(len(o.terms) <= 1 and not o.prefix for o in asked):
        hits = plan(index, asked, k, within).scored(index, asked, within)
    else:
        rows = session.cut(frequencies(index, asked), "hits")
        found = rows.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(asked))]).first()
        mean, score, hit = F.lit(index.mean_length or 1.0), F.lit(0.0), F.lit(False)
        for i in range(len(asked)):
            tf = F.col(f"tf{i}")
            score = score + F.when(tf > 0, idf(index.documents, found[f"df{i}"]) * impact(tf, F.col("length"), mean)).otherwise(0.0)
            hit = hit | (tf > 0)
        hits = rows.filter(hit).select("id", score.alias("score"))
        if within is not None:
            hits = hits.join(within.select(F.col(index.id_col).alias("id")).distinct(), "id", "left_semi")
    return hits.select(F.col("id").alias(index.id_col), (-F.col("score")).alias("bm25")).orderBy("bm25", index.id_col).limit(k)
