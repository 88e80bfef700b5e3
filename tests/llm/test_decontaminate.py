from __future__ import annotations

import random

from broadsheaf.llm import decontaminate as D

from .helpers import SF, docs, prose


def test_lcs_against_a_table():
    for seed in range(100):
        r = random.Random(seed)
        a, b = [r.randint(0, 4) for _ in range(r.randint(1, 12))], [r.randint(0, 5) for _ in range(r.randint(0, 14))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert D.lcs(a, b) == t[-1][-1]


def test_planted_passages_and_paraphrases(spark):
    items = [prose(100 + k, 30, 300) for k in range(8)]
    texts = [prose(k, 200, 300) for k in range(40)] + [None, "", "short"]
    planted = set()
    for k, item in enumerate(items[:5]):
        w = item.split()
        texts[k] = prose(60 + k, 70) + " " + item.upper() + " " + prose(80 + k, 55)
        loose = [x for i, x in enumerate(w) if i % 7]  # a paraphrase: every seventh word is missing
        texts[k + 10] = prose(61 + k, 33) + " " + " ".join(loose) + " " + prose(81 + k, 90)
        planted |= {(k, k), (k + 10, k)}
    bench = spark.createDataFrame([(i, t, None) for i, t in enumerate(items)] + [(99, None, 1), (98, "", 2)], "item_id long, text string, doc_id long")
    rows = D.leaks(docs(spark, texts), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == planted
    assert all(r["lcs"] >= 0.6 and r["answer"] >= 0.5 for r in rows)


def test_given_answers_must_occur(spark):
    item = prose(7, 30)
    text = prose(8, 60) + " " + item + " " + prose(9, 60)
    bench = spark.createDataFrame([(1, item, "zebra"), (2, item, item.split()[3])], "item_id long, text string, answer string")
    assert [r["item_id"] for r in D.leaks(docs(spark, [text]), bench).collect()] == [2]


def test_whole_table_against_exact_search(spark):
    d, b = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    held = {r["doc_id"]: " " + " ".join(D.bare(r["text"])) + " " for r in d.collect()}
    want = {(i, r["item_id"]) for i, t in held.items() for r in b.collect() if f" {' '.join(D.bare(r['text']))} " in t}
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(d, b).collect()}
    assert want <= got and len(got - want) <= 0.02 * len(want) + 1


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(D, "ITEM_BLOCK", 3)
    items = [prose(200 + k, 25) for k in range(7)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = D.leaks(docs(spark, [prose(3, 50) + " " + t + " " + prose(4, 50) for t in items]), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(i, i) for i in range(7)}


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert D.leaks(docs(spark, ["x"]).limit(0), bench).count() == 0
    assert D.leaks(docs(spark, ["x"]), bench.limit(0)).count() == 0


def test_short_items_do_not_hang_on_the_rank(spark):
    words = [x.strip(".,") for x in prose(1, 3000, 900).split()]
    items = [" ".join(words[8 * k : 8 * k + 8]) for k in range(150)]
    texts = [prose(500 + k, 40, 50) + " " + " ".join(words[1200 + 7 * k : 1207 + 7 * k]) + " " + t + " " + " ".join(words[2200 + 3 * k : 2220 + 3 * k]) for k, t in enumerate(items)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for rank in (2, 96):
        assert {(i, i) for i in range(150)} <= {(r["doc_id"], r["item_id"]) for r in D.leaks(docs(spark, texts), bench, rank=rank).collect()}


def test_candidates_by_words_are_all_there(spark):
    vocab = prose(3, 60, 30).split()
    items = [" ".join(vocab[k : k + 1 + 3 * k]) for k in range(7)]
    texts = [prose(20 + k, n, 30).replace(",", "") + " " + " ".join(vocab[k : k + 25]) for k, n in enumerate((1, 15, 16, 40, 90, 300))]
    want = set()
    for d, t in enumerate(texts):
        w = D.bare(t)
        for i, item in enumerate(map(D.bare, items)):
            for begin in range(0, max(1, len(w) - 16), 16):
                around = w[max(0, begin - len(item)) : begin + 32 + len(item)]
                names = {x: k for k, x in enumerate(set(w + item))}
                end = set(item[-max(1, round(0.25 * len(item))) :])
                if len(end & set(around)) >= 0.5 * len(end) and D.lcs([names[x] for x in item], [names[x] for x in around]) >= 0.6 * len(item):
                    want.add((d, i))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in D.leaks(docs(spark, texts), bench).collect()} == want and want


def test_an_item_in_a_third_of_the_rows(spark):
    rare = [f"w{k}x" for k in range(7200)]
    items = [prose(900, 15, 300)] + [" ".join(rare[20 * k : 20 * k + 20]) for k in range(360)]
    rare = random.Random(1).sample(rare, len(rare))
    texts = [prose(k, 150, 90) + " " + " ".join(rare[20 * k : 20 * k + 20] + (items[0].split() if k % 3 == 0 else []) + rare[20 * k + 20 : 20 * k + 40]) + " " + prose(k + 500, 150, 90) for k in range(360)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r["doc_id"] for r in D.leaks(docs(spark, texts), bench).where("item_id = 0").collect()}
    assert got == set(range(0, 360, 3))
