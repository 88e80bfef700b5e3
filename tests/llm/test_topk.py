from __future__ import annotations

import math

import numpy as np
import pytest

from broadsheaf.llm import topk as T

from .helpers import SF


def by_hand(rows, k, every, scale=64.0):
    kept = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, np.floor(scale * np.asarray(v, dtype=float)).astype(np.int64)))
    size = max((len(v) for _, v in kept), default=0)
    ids = np.array([i for i, _ in kept], dtype=np.int64)
    m = np.array([np.pad(v, (0, size - len(v))) for _, v in kept]).reshape(len(kept), size)
    out = []
    for own in np.flatnonzero(ids % every == 0):  # each row is a query of its own
        score = m @ m[own]
        some = np.delete(np.arange(len(ids)), own)
        best = some[np.lexsort((ids[some], -score[some]))[:k]]
        out += [(int(ids[own]), r + 1, int(ids[j]), int(score[j])) for r, j in enumerate(best)]
    return out


def test_repeated_ids_and_rows(spark, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 8)
    r = np.random.default_rng(1)
    rows = [(int(i % 25), r.normal(size=4).tolist()) for i in range(70)] + [(0, [1.0, 2.0])] * 5 + [(20, [0.5, 0.5, 0.0, 0.0])] * 30
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(x) for x in T.top_k(frame, 6, 20).collect()) == sorted(by_hand(rows, 6, 20))


@pytest.mark.parametrize("lists", [1, 2, 5])
def test_odd_vectors(spark, monkeypatch, lists):
    monkeypatch.setattr(T, "CHUNK", 16)
    monkeypatch.setattr(T, "QUERY_CHUNK", 3)
    r = np.random.default_rng(lists)
    rows = [(int(i), r.normal(size=6).tolist()) for i in range(60)] + [(100 + i, [1.0] * 6) for i in range(30)]  # many ties
    rows += [(200, None), (201, [1.0, None]), (202, [math.nan] * 6), (203, [math.inf]), (None, [1.0]), (204, []), (205, [2.0]), (220, [-3.0] * 6)]
    frame = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<double>, chunk int, score int")
    got = sorted(tuple(x) for x in T.top_k(frame, 7, 20, lists=lists).collect())
    assert got == sorted(by_hand(rows, 7, 20))


def test_fewer_rows_than_asked(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (20, [0.5])], "vec_id long, embedding array<float>")
    assert sorted(tuple(x) for x in T.top_k(frame).collect()) == [(0, 1, 1, 8192), (0, 2, 20, 2048), (20, 1, 1, 4096), (20, 2, 0, 2048)]


def test_large_components_stay_exact(spark):
    rows = [(0, [3e9, 1.0]), (1, [3e9, 2.0]), (2, [3e9, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in T.top_k(frame, 5, 20, scale=1.0).orderBy("rank").collect()] == [(2, 9 * 10**18 + 3), (1, 9 * 10**18 + 2)]


def test_whole_table(spark):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    assert sorted(tuple(x) for x in T.top_k(frame).collect()) == sorted(by_hand(rows, 20, 20))


def test_empty_table(spark):
    assert T.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
