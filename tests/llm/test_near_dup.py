from __future__ import annotations

import random

import numpy as np

from broadsheaf.llm import near_dup as N
from broadsheaf.llm.components import components

from .helpers import SF, docs, prose


def by_hand(texts, threshold=0.8):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            same = (texts[i] or "") == (texts[j] or "")
            both = len(sets[i] & sets[j])
            if same or both and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def corpus():
    texts = [None, "", " ", "one two", "One two", "one two three four five six", prose(1, 300), prose(1, 300) + " tail", prose(2, 100)]
    base = prose(4, 250).split()
    for k in range(60):
        r = random.Random(k)
        w = base[:]
        for _ in range(r.randint(0, 14)):
            w[r.randrange(len(w))] = f"w{r.random():.5f}"
        texts.append(" ".join(w))
    return texts


def test_classes_against_brute_force(spark):
    texts = corpus()
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == by_hand(texts)


def test_groups_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_TEXTS", 16)
    texts = corpus()
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == by_hand(texts)


def test_repeated_and_null_ids(spark):
    rows = N.near_duplicates(docs(spark, ["a b c d e f", "a b c d e f", "x y z", "a b c d e f"], [7, 7, 7, None])).collect()
    assert len(rows) == 4 and sum(r["kept"] for r in rows) == 3
    assert {(r["doc_id"], r["class_id"], r["class_rows"]) for r in rows} == {(7, 7, 3), (None, 7, 3), (7, 7, 1)}


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**62, 400).astype(np.uint64)
    w, v = rng.random(400) * 3, rng.random(400) * 3
    s = N.signatures(np.concatenate([x, x]), np.concatenate([w, v]), np.array([0, 400, 800]), 2048)
    assert abs((s[0] == s[1]).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.05
    plain = N.signatures(np.concatenate([x, x[:300]]), None, np.array([0, 400, 700, 700]), 2048)
    assert abs((plain[0] == plain[1]).mean() - 0.75) < 0.05 and not plain[2].any()


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    got = dict(components(e, "a", "b").collect())
    assert got == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys((90, 95, 100), 90)}


def test_whole_table(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id")
    texts = [r["text"] for r in d.collect()]
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(d).collect()}
    assert [got[i] for i in range(len(texts))] == by_hand(texts)


def test_empty_table(spark):
    assert N.near_duplicates(docs(spark, ["x"]).limit(0)).count() == 0
