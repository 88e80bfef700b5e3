from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from broadsheaf.llm import quality_gam as G

from .helpers import docs, prose


def junk(k):
    return " ".join([f"w{k}"] * 60) if k % 2 else prose(k, 60).upper() + " !!!"


def labelled(spark, n=400):
    texts = [junk(i) if i % 3 == 0 else prose(i, 80) for i in range(n)] + [None, ""]
    labels = spark.createDataFrame([(i, None if i % 50 == 0 else int(i % 3 != 0), 7) for i in range(n)], "doc_id long, quality int, words int")
    return docs(spark, texts), labels


def test_held_out_accuracy(spark):
    d, labels = labelled(spark)
    rows = {r["doc_id"]: r for r in G.score(d, labels).collect()}
    assert len(rows) == 402
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(r["predicted"], int(i % 3 != 0)) for i, r in rows.items() if r["held_out"] and i < 400]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_held_out_labels_do_not_matter(spark):
    d, labels = labelled(spark, 200)
    flipped = labels.selectExpr("doc_id", "case when pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0 then 1 - quality else quality end as quality")
    a, b = ({r["doc_id"]: r["score"] for r in G.score(d, x).collect()} for x in (labels, flipped))
    assert a == b


def test_features_against_counts():
    t = "The the cat | sat!\nA 12 ÉÉ $5"
    x = dict(zip(G.FEATURES, G.features(pa.array([t, "", "a a a"]))[0]))
    assert np.isclose(x["words"], np.log1p(9)) and np.isclose(x["distinct"], 8 / 9) and np.isclose(x["repeated"], 1 / 9)
    assert np.isclose(x["bars"], 1 / 9) and np.isclose(x["shouts"], 1 / 9) and np.isclose(x["symbols"], 1 / 9) and np.isclose(x["lines"], 1 / 9)
    assert np.isclose(x["digits"], 3 / len(t.encode())) and np.isclose(x["upper"], 2 / 13)
    y = dict(zip(G.FEATURES, G.features(pa.array([t, "", "a a a"]))[2]))
    assert np.isclose(y["repeated"], 2 / 3) and np.isclose(y["top_word"], 1) and np.isclose(y["repeated_pairs"], 0.5)


def test_pairs_learn_interactions():
    r = np.random.default_rng(1)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = G.fit(x, y, rounds=20, pair_rounds=80, n_pairs=2)
    assert ((m.score(x) > 0.5) == y).mean() > 0.9


def test_scores_are_table_sums():
    r = np.random.default_rng(2)
    x = r.random((500, 2))
    m = G.fit(x, (x[:, 0] > 0.4).astype(float), rounds=10, pair_rounds=5, n_pairs=1)
    for row, got in zip(x[:20], m.logit(x[:20])):
        want = m.intercept + sum(t[np.searchsorted(c, v)] for c, t, v in zip(m.cuts, m.tables, row))
        want += sum(t[np.searchsorted(cf, row[f]), np.searchsorted(cg, row[g])] for f, g, cf, cg, t in m.pairs)
        assert np.isclose(got, want)


def test_no_labels_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in G.score(docs(spark, ["a", None]), none).collect()} == {0.5}
    assert G.score(docs(spark, ["a"]).limit(0), none).count() == 0
