"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph per shard.

Vectors are dealt into shards by a hash; equal vectors of a shard are one node, which stands for the smallest of their
ids (as many as a query could want). A shard's vectors are parted by their lengths, so that none is more than SPAN times
as long as another of its part, and each part has a graph of its own. It is built by one task and stored as a row of flat arrays:
the vectors, the ids of each node, and the neighbours of every node on every level. Queries go to all shards, many at
a time, so that a task loads a shard once, and the shards' best are merged per query.

Largest inner product becomes nearest by a further coordinate that gives all vectors of a graph the same length, so
that the graph is navigated by one measure. As lengths in a graph differ little, single precision is enough for that,
whatever the lengths of all; scores are inner products of the original vectors in double precision.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take no part, as query or
candidate; vectors are compared with those of their own dimension only; ids may repeat (each row is a candidate, but a
query skips the rows with its own id); queries that repeat id and vector are asked once, those that repeat the id alone
one by one; null ids are left out; ties go to the smaller id; with fewer than k candidates all are returned; an empty
table gives an empty result; extra columns are left out, whatever their names.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill import session
from lexmill.llm import memory

#: Neighbours per node and level (twice as many on level 0), and the breadth of search while building.
DEGREE, BUILD_BREADTH = 16, 96
#: Breadth of a search: at least so many, and at most so many times the square root of the graph's nodes, as vectors without
#: structure need more of a larger graph. `tests/llm/hnsw_recall.py` measures the recall at SHARD_ROWS.
LEAST_BREADTH, ROOT_BREADTH = 96, 5.0
#: Between these, the least that finds this share of the k best nodes of so many of a task's queries, by a full scan for them.
ENOUGH, PROBES = 0.98, 48
#: Nodes whose neighbours a search looks at together, the most promising ones: fewer and larger steps for the same breadth.
WIDTH = 8
#: Shards at least, and vectors per shard on average at most: this bounds a task's memory and time at any size.
LEAST_SHARDS, SHARD_ROWS = 8, 8_192
#: The longest vector of a graph is less than this many times as long as the shortest, by their largest components.
SPAN = 4.0
#: Queries that meet a shard in one task; the shard is copied once for so many.
BLOCK = 16_384

_INDEX = "dim int, shard int, band int, vectors binary, ids binary, id_starts binary, neighbours binary, levels binary, entry int"


def valid(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


class Graph:
    """The graph of one shard as flat arrays: `neighbours[level_start[level] + node * degree(level)]`, -1 where empty."""

    def __init__(self, vectors: np.ndarray, neighbours: np.ndarray, levels: np.ndarray, entry: int):
        self.vectors, self.levels, self.entry = vectors, levels, entry
        n, top = len(vectors), int(levels.max(initial=0))
        self.tables, at = [], 0
        for level in range(top + 1):
            degree = 2 * DEGREE if level == 0 else DEGREE
            self.tables.append(neighbours[at : at + n * degree].reshape(n, degree))
            at += n * degree

    @staticmethod
    def empty(vectors: np.ndarray) -> Graph:
        n = len(vectors)
        draw = np.random.default_rng(n).random(n)
        levels = np.floor(-np.log(np.maximum(draw, 1e-12)) / math.log(DEGREE)).astype(np.int32)
        size = n * (2 * DEGREE + DEGREE * int(levels.max(initial=0)))
        return Graph(vectors, np.full(size, -1, np.int32), levels, 0)

    def search(self, query: np.ndarray, entry: int, level: int, breadth: int, seen: np.ndarray, stamp: int) -> list[tuple[float, int]]:
        """The `breadth` nearest nodes found on a level, as (similarity, node), unordered."""
        table, vectors = self.tables[level], self.vectors
        first = float(vectors[entry] @ query)
        seen[entry] = stamp
        open_, found = [(-first, entry)], [(first, entry)]
        while open_:
            nodes = []
            while open_ and len(nodes) < WIDTH and (len(found) < breadth or -open_[0][0] >= found[0][0]):
                nodes.append(heapq.heappop(open_)[1])
            if not nodes:
                break
            near = table[nodes].ravel()
            near = near[near >= 0]
            near = near[seen[near] != stamp]
            if not len(near):
                continue
            if len(nodes) > 1:
                near.sort()
                near = near[np.append(True, near[1:] != near[:-1])]
            seen[near] = stamp
            scores = vectors[near] @ query
            if len(found) >= breadth:
                better = scores > found[0][0]
                near, scores = near[better], scores[better]
            for s, x in zip(scores.tolist(), near.tolist(), strict=True):
                if len(found) < breadth:
                    heapq.heappush(found, (s, x))
                    heapq.heappush(open_, (-s, x))
                elif s > found[0][0]:
                    heapq.heapreplace(found, (s, x))
                    heapq.heappush(open_, (-s, x))
        return found

    def descend(self, query: np.ndarray, to: int) -> int:
        """The node from which the search on level `to` starts."""
        node = self.entry
        best = float(self.vectors[node] @ query)
        for level in range(int(self.levels[self.entry]), to, -1):
            moved = True
            while moved:
                moved = False
                near = self.tables[level][node]
                near = near[near >= 0]
                if len(near):
                    scores = self.vectors[near] @ query
                    k = int(scores.argmax())
                    if scores[k] > best:
                        node, best, moved = int(near[k]), float(scores[k]), True
        return node

    def _choose(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours that are nearer to the node than to each other, filled up with the nearest of the rest."""
        order = sorted(found, reverse=True)
        nodes = np.array([x for _, x in order])
        close = self.vectors[nodes] @ self.vectors[nodes].T
        chosen: list[int] = []
        for i, (s, _) in enumerate(order):
            if not chosen or float(close[i, chosen].max()) < s:
                chosen.append(i)
                if len(chosen) == most:
                    break
        if len(chosen) < most:
            taken = set(chosen)
            chosen += [i for i in range(len(order)) if i not in taken][: most - len(chosen)]
        return nodes[chosen].tolist()

    def build(self) -> Graph:
        seen = np.zeros(len(self.vectors), np.int64)
        stamp = 0
        for node in range(1, len(self.vectors)):
            query, mine, top = self.vectors[node], int(self.levels[node]), int(self.levels[self.entry])
            at = self.descend(query, mine)
            for level in range(min(mine, top), -1, -1):
                stamp += 1
                found = self.search(query, at, level, BUILD_BREADTH, seen, stamp)
                at = max(found)[1]
                table, most = self.tables[level], self.tables[level].shape[1]
                chosen = self._choose(found, DEGREE)
                table[node, : len(chosen)] = chosen
                for other in chosen:
                    row = table[other]
                    free = np.flatnonzero(row < 0)
                    if len(free):
                        row[free[0]] = node
                        continue
                    rivals = np.append(row, node)
                    scores = self.vectors[rivals] @ self.vectors[other]
                    table[other] = self._choose(list(zip(scores.tolist(), rivals.tolist(), strict=True)), most)
            if mine > top:
                self.entry = node
        return self


def build(vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The index: a row of flat arrays per shard and band of lengths. Of equal vectors, the k + 1 smallest ids are kept, each at most k times."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & valid(F.col("v")))
    shards = max(LEAST_SHARDS, -(-rows.count() // SHARD_ROWS))
    # equal vectors meet in one shard; how many of their ids a query can want is known, so each task drops the others early
    rows = rows.groupBy("v", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    twins = Window.partitionBy("v").orderBy("id")
    rows = rows.withColumn("at", F.row_number().over(twins)).filter(F.col("at") <= k + 1)
    rows = rows.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), "id", "v", "times")

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        memory.release()
        v, ids, times = np.stack(pdf["v"].to_numpy()), pdf["id"].to_numpy(), pdf["times"].to_numpy()
        bands = np.floor(np.log2(np.abs(v).max(axis=1)) / math.log2(SPAN)).astype(int)
        made = [_graph_row(v[bands == b], ids[bands == b], times[bands == b]) | {"band": int(b)} for b in np.unique(bands)]
        return pd.DataFrame(made).assign(dim=pdf["dim"].iloc[0], shard=pdf["shard"].iloc[0])

    return rows.groupBy("dim", "shard").applyInPandas(make, _INDEX)


def _graph_row(v: np.ndarray, ids: np.ndarray, times: np.ndarray) -> dict:
    """Equal vectors as one node, and the graph of the nodes."""
    order = np.lexsort((ids, *v.T[::-1]))
    v, ids, times = v[order], ids[order], times[order]
    new = np.concatenate(([True], (v[1:] != v[:-1]).any(axis=1)))
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(ids))
    mix = np.random.default_rng(len(starts)).permutation(len(starts))  # sorted insertion makes poor graphs
    nodes = v[starts][mix]
    members = [np.repeat(ids[starts[i] : ends[i]], times[starts[i] : ends[i]]) for i in mix]
    graph = Graph.empty(_level(nodes)).build()
    flat = np.concatenate([t.reshape(-1) for t in graph.tables])
    return {"vectors": nodes.astype("<f8").tobytes(), "ids": np.concatenate(members).astype("<i8").tobytes(), "id_starts": np.cumsum([0] + [len(m) for m in members]).astype("<i8").tobytes(), "neighbours": flat.astype("<i4").tobytes(), "levels": graph.levels.astype("<i4").tobytes(), "entry": graph.entry}


def _level(v: np.ndarray) -> np.ndarray:
    """Vectors, as parts of the longest, with a further coordinate that makes them equally long; in single precision."""
    v = v / np.abs(v).max()
    squares = (v * v).sum(axis=1)
    return np.concatenate((v, np.sqrt(np.maximum(squares.max() - squares, 0))[:, None]), axis=1).astype(np.float32)


def _found(graph: Graph, exact: np.ndarray, breadth: int, seen: np.ndarray, stamp: int) -> list[tuple[float, int]]:
    query = np.append(exact / np.abs(exact).max(), 0).astype(np.float32)
    return graph.search(query, graph.descend(query, 0), 0, breadth, seen, stamp)


def _enough(graph: Graph, original: np.ndarray, queries: list[tuple[int, np.ndarray]], k: int, seen: np.ndarray) -> int:
    """The breadth for these queries: measured on some of them if there are many, else the most. Stamps below 0 are used."""
    breadth, most = max(2 * k, LEAST_BREADTH), max(2 * k, LEAST_BREADTH, math.ceil(ROOT_BREADTH * len(original) ** 0.5))
    if breadth == most or len(queries) < 4 * PROBES:
        return most
    # the same ones whatever the order of rows
    order = sorted(range(len(queries)), key=lambda i: (queries[i][0], queries[i][1].tobytes()))
    probes = [queries[i][1] for i in order[:: len(order) // PROBES][:PROBES]]
    best = min(k, len(original))
    least = [np.partition(original @ x, -best)[-best] for x in probes]
    stamp = 0
    while breadth < most:
        hits = 0
        for x, score in zip(probes, least, strict=True):
            stamp -= 1
            nodes = [node for _, node in _found(graph, x, breadth, seen, stamp)]
            hits += min(best, int((original[nodes] @ x >= score - 1e-9 * abs(score)).sum()))
        if hits >= ENOUGH * best * len(probes):
            break
        breadth = min(most, math.ceil(1.4 * breadth))
    return breadth


def _search_graph(row: dict, queries: list[tuple[int, np.ndarray]], k: int, breadth: int | None = None) -> list[list[tuple[float, int]]]:
    """For every query (id, vector), its k best (minus the score, id) in a graph, other than itself, in order."""
    original = np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"])
    ids, starts = (np.frombuffer(row[c], "<i8") for c in ("ids", "id_starts"))
    graph = Graph(_level(original), np.frombuffer(row["neighbours"], "<i4"), np.frombuffer(row["levels"], "<i4"), row["entry"])
    seen, out = np.zeros(len(original), np.int64), []
    breadth = max(2 * k, breadth) if breadth else _enough(graph, original, queries, k, seen)
    for stamp, (own, exact) in enumerate(queries, 1):
        found = _found(graph, exact, breadth, seen, stamp)
        nodes = np.array([x for _, x in found])
        scores = original[nodes] @ exact
        out.append(sorted((-s, int(j)) for x, s in zip(nodes.tolist(), scores.tolist(), strict=True) for j in ids[starts[x] : starts[x + 1]] if j != own)[:k])
    return out


def search(index: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", breadth: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest over all shards. `index` is read three times, so give it as a table.

    breadth: candidates that a search of a graph holds; by default as many as the task's queries need (ENOUGH), between LEAST_BREADTH and what ROOT_BREADTH gives.
    """
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & valid(F.col("v"))).distinct()
    blocks = -(-asked.count() // BLOCK) or 1
    asked = asked.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).alias("block"), "id", F.xxhash64("v").alias("print"), "v")
    shards = index.agg(F.max("shard")).first()[0]
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards or 0))))
    copies = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def task(asked: pa.Table, graphs: pa.Table) -> pa.Table:
        memory.release()
        out: list[tuple[int, int, int, float]] = []
        if len(graphs) and len(asked):
            prints = asked["print"].to_pylist()
            mine = list(zip(asked["id"].to_pylist(), map(np.array, asked["v"].to_pylist()), strict=True))
            best: list[list[tuple[float, int]]] = [[] for _ in mine]
            for row in graphs.to_pylist():
                best = [sorted(a + b)[:k] for a, b in zip(best, _search_graph(row, mine, k, breadth), strict=True)]
            out = [(q, x, j, -s) for (q, _), x, found in zip(mine, prints, best, strict=True) for s, j in found]
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "print", "vec_id", "score"])

    groups = ["dim", "shard", "block"]
    found = asked.groupBy(*groups).cogroup(copies.groupBy(*groups)).applyInArrow(task, "query_id long, print long, vec_id long, score double")
    nearest = Window.partitionBy("query_id", "print").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Build the index over `vectors`, keep it as a table, and search it."""
    index = session.cut(build(vectors, k, id_col, vector_col), "hnsw")
    return search(index, queries, k, id_col, vector_col)
