"""Sharding by balanced label propagation.

Documents start in a shard by a hash of their place. In every round linked documents look at their neighbours' shards
and ask to move to the one where most of them are: in even rounds those with an earlier neighbour, in odd rounds those
with a later one, so that two neighbours don't trade places for ever. The numbers asked for and the room left, a table
of shards x shards rows, decide how many of each move may happen, and that many do. In the rounds a shard may take
SLACK times its share, so that groups can gather. Rounds end when two in a row move nothing.

Then the linked documents are evened out: what hangs together within a shard is a cluster, and whole clusters go from shards
that hold too many to those with room, planned on the numbers of clusters by shard and size. Only what no whole cluster can
even out is cut, from as few clusters as will do. Documents without links fill the shards up first, so that at the end
the counts are at most one apart.

Defined results: a null id or text is a row like any other (a null text has no bytes and links with nothing); rows that
repeat an id are rows of their own; empty texts are equal to each other; an empty table gives an empty result; of
shards that tie, the smaller wins; extra columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill import session
from lexmill.functions.ordinals import gapless

#: Rounds of propagation at most; what a shard may hold in them, of its share.
ROUNDS, SLACK = 8, 1.5
#: Tasks that the nodes of one group are dealt to.
SALTS = 16


def _targets(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def propagate(nodes: DataFrame, edges: DataFrame, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """(node, shard): counts of nodes per shard at most one apart, few edges (a, b) between different shards.

    `nodes` has a column node, unique and not null; edges that name no node are ignored.
    """
    spark = nodes.sparkSession
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select(F.col("b"), F.col("a"))).filter("node != to")
    both = session.cut(both.join(nodes.select("node"), "node", "left_semi"), "edges")
    n = nodes.count()
    targets = _targets(n, shards)
    start = nodes.select("node", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard"))
    linked = session.cut(both.groupBy("node").agg((F.min("to") < F.col("node")).alias("after"), (F.max("to") > F.col("node")).alias("before")), "linked")
    alone = start.join(linked, "node", "left_anti")
    now = session.cut(start.join(linked, "node"), "labels")
    sizes = _sizes(now)
    room = [int(SLACK * t) + 1 for t in targets]
    still = 0
    for turn in range(rounds):
        near = both.join(now.select(F.col("node").alias("to"), "shard"), "to").groupBy("node", "shard").agg(F.count("*").alias("votes"))
        best = Window.partitionBy("node").orderBy(F.desc("votes"), "shard")
        wish = near.withColumn("at", F.row_number().over(best)).filter("at = 1").select("node", F.col("shard").alias("to"), "votes")
        here = near.select("node", F.col("shard"), F.col("votes").alias("here"))
        asked = now.filter("before" if turn % 2 else "after").join(wish, "node").join(here, ["node", "shard"], "left").filter((F.col("to") != F.col("shard")) & (F.col("votes") > F.coalesce("here", F.lit(0))))
        asked = session.cut(asked.select("node", "shard", "to", "votes"), "asked")
        queues = {(r["shard"], r["to"]): r["count"] for r in asked.groupBy("shard", "to").count().collect()}
        allowed = {k: n for k, n in _grant(queues, [sizes.get(s, 0) for s in range(shards)], room).items() if n}
        still = 0 if allowed else still + 1
        if still == 2:
            break
        if not allowed:
            continue
        quota = spark.createDataFrame([(i, j, k) for (i, j), k in allowed.items()], "shard int, to int, allowed long")
        queue = gapless(asked, ["shard", "to"], [F.desc("votes"), "node"], ["node"], "place")
        moves = queue.join(F.broadcast(quota), ["shard", "to"]).filter("place < allowed").select("node", "to")
        now = session.cut(now.join(moves, "node", "left").select("node", F.coalesce("to", "shard").alias("shard"), "before", "after"), "labels")
        sizes = _sizes(now)
    kept, pool = _evened(now.select("node", "shard"), both, targets)
    sizes = _sizes(kept)
    pool = alone.select("node").union(pool)
    ends, at = [], 0  # of the pool's places that each shard takes
    for s in range(shards):
        at += targets[s] - sizes.get(s, 0)
        ends.append(at)
    taker = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda end: end <= F.col("place")))
    filled = gapless(pool, [], ["node"], ["node"], "place").withColumn("shard", taker)
    return kept.union(filled.select("node", "shard"))


def _sizes(rows: DataFrame) -> dict[int, int]:
    return {r["shard"]: r["count"] for r in rows.groupBy("shard").count().collect()}


def _clusters(now: DataFrame, both: DataFrame) -> DataFrame:
    """node, shard, cluster: the smallest node that is reached by links within the shard."""
    shard_of = now.select(F.col("node").alias("to"), F.col("shard").alias("to_shard"))
    inner = session.cut(both.join(now, "node").join(shard_of, "to").filter("shard = to_shard").select("node", "to"), "inner")
    labels = session.cut(now.withColumn("cluster", F.col("node")), "clusters")
    while True:
        by_node = labels.select(F.col("node").alias("of"), F.col("cluster").alias("its"))
        least = inner.join(by_node, F.col("to") == F.col("of")).groupBy(F.col("node").alias("at")).agg(F.min("its").alias("least"))
        step = labels.join(least, F.col("node") == F.col("at"), "left").select("node", "shard", F.col("cluster").alias("old"), F.least("cluster", "least").alias("mid"))
        jump = step.join(by_node, F.col("mid") == F.col("of"), "left").select("node", "shard", F.least("mid", "its").alias("cluster"), "old")  # and on to where that one is
        jump = session.cut(jump, "clusters")
        labels = jump.drop("old")
        if not jump.filter("cluster != old").head(1):
            return labels


def _evened(now: DataFrame, both: DataFrame, targets: list[int]) -> tuple[DataFrame, DataFrame]:
    """Linked nodes (node, shard) with no shard over its target, and the nodes that have to go elsewhere, from few clusters."""
    spark = now.sparkSession
    found = _clusters(now, both)
    sizes = session.cut(found.groupBy("shard", "cluster").agg(F.count("*").alias("held")), "cluster-sizes")
    # sizes that differ add up, so there are at most about the square root of twice the nodes of them in a shard
    counts = {(r["shard"], r["held"]): r["n"] for r in sizes.groupBy("shard", "held").agg(F.count("*").alias("n")).collect()}
    moves, cuts = _whole_moves(counts, targets)
    numbered = session.cut(gapless(sizes, ["shard", "held"], ["cluster"], ["cluster"], "ordinal"), "numbered")
    plan = spark.createDataFrame([(i, x, a, b, j, 0) for i, x, a, b, j in moves] + [(i, x, a, b, i, take) for i, x, a, b, take in cuts], "of int, of_size long, first long, last long, to int, take long")
    there = (F.col("shard") == F.col("of")) & (F.col("held") == F.col("of_size")) & F.col("ordinal").between(F.col("first"), F.col("last") - 1)
    changed = session.cut(numbered.join(F.broadcast(plan), there).select(F.col("cluster").alias("moved"), "to", "take"), "changed")
    rows = session.cut(found.join(changed, F.col("cluster") == F.col("moved"), "left").select("node", F.coalesce("to", "shard").alias("shard"), "cluster", F.coalesce("take", F.lit(0)).alias("take")), "evened")
    partly = gapless(rows.filter("take > 0"), ["cluster"], ["node"], ["node"], "place")
    kept = rows.filter("take = 0").select("node", "shard").union(partly.filter("place >= take").select("node", "shard"))
    return kept, partly.filter("place < take").select("node")


def _whole_moves(counts: dict[tuple[int, int], int], targets: list[int]) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int, int, int]]]:
    """Of numbers of clusters by (shard, size): moves (shard, size, first, last, to) of whole clusters, and cuts (shard, size, first, last, nodes).

    No shard is over its target when the moves are done and the nodes of the cuts are gone. Clusters are taken from the end
    of their numbers.
    """
    shards = range(len(targets))
    left = dict(counts)
    load = [sum(x * n for (i, x), n in counts.items() if i == s) for s in shards]
    by_shard = {s: sorted(x for i, x in counts if i == s) for s in shards}
    moves, cuts = [], []

    def take(i: int, x: int, n: int) -> tuple[int, int]:
        left[i, x] -= n
        if not left[i, x]:
            by_shard[i].remove(x)
        return left[i, x], left[i, x] + n

    stuck: set[int] = set()
    while over := [s for s in shards if load[s] > targets[s] and s not in stuck]:
        i = max(over, key=lambda s: load[s] - targets[s])
        j = max(shards, key=lambda s: targets[s] - load[s])
        much, room = load[i] - targets[i], targets[j] - load[j]
        small = [x for x in by_shard[i] if x <= min(much, room)]
        large = [x for x in by_shard[i] if much < x <= room]
        if not small and not large:
            stuck.add(i)
            continue
        x = small[-1] if small else large[0]
        n = max(1, min(left[i, x], much // x, room // x))
        moves.append((i, x, *take(i, x, n), j))
        load[i], load[j] = load[i] - n * x, load[j] + n * x
    for i in shards:
        while load[i] > targets[i]:
            x = next((x for x in by_shard[i] if x >= load[i] - targets[i]), by_shard[i][-1] if by_shard[i] else 0)
            n = min(x, load[i] - targets[i])
            cuts.append((i, x, *take(i, x, 1), n))
            load[i] -= n
    return moves, cuts


def _grant(queues: dict[tuple[int, int], int], sizes: list[int], targets: list[int]) -> dict[tuple[int, int], int]:
    """How many of each move may happen so that no shard passes its target: swaps first, then what the room allows."""
    granted = {k: min(n, queues.get((k[1], k[0]), 0)) for k, n in queues.items()}
    now = list(sizes)
    changed = True
    while changed:
        changed = False
        for (i, j), n in sorted(queues.items(), key=lambda x: (-x[1], x[0])):
            more = min(n - granted[i, j], targets[j] - now[j])
            if more > 0:
                granted[i, j] += more
                now[i], now[j] = now[i] - more, now[j] + more
                changed = True
    return granted


def star_links(keys: DataFrame, most: int) -> DataFrame:
    """Edges (a, b) that link the nodes with equal `key`: each with the first of its block of up to `most` nodes.

    A group that no shard can hold is cut into blocks that one can. Null keys link with nothing.
    """
    known = keys.filter("key is not null").withColumn("salt", F.pmod(F.xxhash64("node", F.lit("salt")), F.lit(SALTS)).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    sizes = known.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key", "size", salts)
    blocks = F.when(F.col("size") <= most, F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), F.ceil(2 * F.col("size") / most)))
    grouped = session.cut(known.join(sizes, ["key", "salt"]).select("node", "key", "salt", blocks.alias("block")), "groups")
    hubs = grouped.groupBy("key", "block").agg(F.min("node").alias("hub")).select("key", "block", "hub", salts)
    return grouped.join(hubs, ["key", "block", "salt"]).filter("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))


def shard_texts(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, shard, slot. Equal texts are linked; counts are at most one apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.when(F.col(text_col).isNotNull(), F.sha2(text, 256)).alias("key"))
    rows = session.cut(rows.withColumn("node", F.monotonically_increasing_id()), "rows")
    n = rows.count()
    edges = session.cut(star_links(rows.select("node", "key"), max(1, n // shards)), "stars")
    placed = propagate(rows.select("node"), edges, shards)
    out = rows.drop("key").join(placed, "node")
    return gapless(out, ["shard"], ["id", "node"], ["node"], "slot").drop("node")
