"""Nearest vectors of all pairs against plain loops, with several pieces and spans."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadsheaf.operators import extras as X

SHAPE = "vec_id long, embedding array<float>, label int, page long"


def plain(rows, k):
    """Agreement by id and class, similarities summed in the order of the components."""
    unit = []
    for i, v, c, p in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        v = [float(np.float32(x)) for x in v]
        n = 0.0
        for x in v:
            n += x * x
        unit.append((i, [x / n**0.5 if n > 0 else x for x in v], c, p))
    near = {}
    for i, v, c, p in unit:
        for j, w, d, q in unit:
            if p != q:
                s = 0.0
                for x, y in zip(v, w):
                    s += x * y
                if s > 0:
                    near.setdefault(i, []).append((-s, j, c, d))
    out = {}
    for i, all_ in near.items():
        for s, _, c, d in sorted(all_, key=lambda x: x[:2])[:k]:
            a = out.setdefault((i, c), [0.0, 0.0])
            a[0] -= s if c is not None and c == d else 0
            a[1] -= s
    return {key: a / b for key, (a, b) in out.items()}


def some_rows(n, seed):
    """Vectors with copies, pages of many, rows that take no part, and null classes."""
    r = random.Random(seed)
    kinds = [[r.gauss(0, 1) for _ in range(6)] for _ in range(n // 3)]
    rows = [(i, r.choice(kinds) if r.random() < 0.6 else [r.gauss(0, 1) for _ in range(6)], r.choice([0, 1, 2, None]), r.choice([i, i % 9])) for i in range(n)]
    return [*rows, (None, [1.0] * 6, 1, 1), (n, None, 1, n), (n + 1, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, n), (n + 2, [float("nan")] * 6, 1, n), (n + 3, [0.0] * 6, 1, n), (n + 4, [1.0, -1.0, 0.5], 1, n), (n + 5, [], 1, n)]


@pytest.mark.parametrize("piece, span", [(16384, 262_144), (50, 120)])
def test_all_pairs_of_pieces_and_spans(spark, monkeypatch, piece, span):
    monkeypatch.setattr(X, "PIECE", piece)
    monkeypatch.setattr(X, "SPAN", span)
    rows = some_rows(260, 4)
    got = X.knn_agreement(spark.createDataFrame(rows, SHAPE).repartition(3), 4, page=F.col("page")).collect()
    want = plain(rows, 4)
    assert {(r["id"], r["c"]): pytest.approx(r["agreement"]) for r in got} == want and len(got) == len(want)


def test_best_of_pieces_in_tiles(monkeypatch):
    """Held rows and voters of several pieces, with a first bound by groups and few pairs at a time."""
    for name, v in (("TILE", 7), ("GROUPS", 4), ("PAIRS", 5)):
        monkeypatch.setattr(X, name, v)
    rng = np.random.default_rng(2)
    data = rng.integers(-2, 3, (150, 5)).astype(float)
    ids, c = np.arange(150), rng.integers(0, 3, 150)
    held = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))
    for part in np.array_split(rng.permutation(150), 3):
        part = part[X._needed(ids[part], ids[part], data[part], 3)]
        held = X._nearer((ids, c, ids, data), held, (ids[part], c[part], ids[part], data[part]), 3)
    want = [(i, s, j, c[j]) for i in range(150) for s, j in [(-a, b) for a, b in sorted((-float(data[i] @ data[j]), j) for j in range(150) if i != j and data[i] @ data[j] > 0)[:3]]]
    assert list(zip(*(x.tolist() for x in held))) == want


def test_vectors_are_moved_once(spark):
    """No side is multiplied before a shuffle: pieces meet as a product of partitions."""
    v = spark.createDataFrame([(i, [1.0, float(i)], 1) for i in range(9)], "vec_id long, embedding array<float>, label int")
    found = X.knn_agreement(v, 2)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan and "ReusedExchange" in plan
