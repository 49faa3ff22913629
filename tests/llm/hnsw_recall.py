"""Recall and build time of one graph against brute force: `python tests/llm/hnsw_recall.py [rows]`.

One line per kind of vectors, graphs of `rows` vectors (SHARD_ROWS if not given), built in as many processes as there are kinds.
"""

from __future__ import annotations

import sys
import time
from concurrent.futures import ProcessPoolExecutor
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from lexmill.llm import hnsw  # noqa: E402

K, ASKED = 20, 200


def vectors(kind: str, n: int) -> np.ndarray:
    rng = np.random.default_rng(7)
    dim = int(kind.split()[-1])
    if kind.startswith("clustered"):
        return rng.standard_normal((n // 50 + 1, dim))[rng.integers(0, n // 50 + 1, n)] + 0.3 * rng.standard_normal((n, dim))
    found = rng.standard_normal((n, dim))
    return found / np.linalg.norm(found, axis=1, keepdims=True) if kind.startswith("unit") else found


def measure(kind: str, n: int) -> str:
    v = vectors(kind, n)
    began = time.time()
    row = hnsw._graph_row(v, np.arange(n), np.ones(n, int)) | {"dim": v.shape[1]}
    built = time.time() - began
    asked = list(range(0, n, max(1, n // ASKED)))
    began = time.time()
    found = hnsw._search_graph(row, [(i, v[i]) for i in asked], K)
    each = 1000 * (time.time() - began) / len(asked)
    hits = 0
    for i, mine in zip(asked, found, strict=True):
        scores = v @ v[i]
        scores[i] = -np.inf
        hits += len({j for _, j in mine} & set(np.argsort(-scores)[:K].tolist()))
    return f"{kind}: {n} vectors, recall of {K} {hits / K / len(asked):.3f}, built in {built:.0f} s, {each:.1f} ms a query"


if __name__ == "__main__":
    rows = int(sys.argv[1]) if len(sys.argv) > 1 else hnsw.SHARD_ROWS
    kinds = ["gaussian 64", "unit 64", "gaussian 128", "clustered 64"]
    with ProcessPoolExecutor(len(kinds)) as pool:
        for line in pool.map(measure, kinds, [rows] * len(kinds)):
            print(line, flush=True)
