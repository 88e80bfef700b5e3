"""The whole retrieval, and the pipeline's stages, against plain loops over all pairs."""

from __future__ import annotations

import corpus_pipeline as C
from broadsheaf.llm import decontaminate as D
from broadsheaf.llm import pii
from broadsheaf.llm.packing import pack

from .helpers import SF, docs, prose
from .test_near_dup import by_hand


def bare(text):
    return [w for w in (x.strip(D.TRIM) for x in (text or "").lower().split()) if w]


def table_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def leaks_by_hand(texts, items, least_lcs=0.6, least_answer=0.5):
    """Pairs of a text's and an item's number with a passage around which the item's words and answer are."""
    out = set()
    for d, text in enumerate(texts):
        raw = [w.strip(D.TRIM) for w in (text or "").lower().split()]
        halves = -(-len(raw) // 16)
        for i, item in enumerate(items):
            want = bare(item)
            held = set(want)
            if not want or sum(w in set(raw) for w in want) < least_lcs * len(want):
                continue
            answer = set(want[-max(1, round(0.25 * len(want))) :])
            for p in range(max(halves - 1, 1)):
                around = raw[max(0, p * 16 - len(want)) : p * 16 + 32 + len(want)]
                here = set(around)
                if len(answer & here) < least_answer * len(answer) or sum(w in here for w in want) < least_lcs * len(want):
                    continue
                if table_lcs(want, [w for w in around if w in held]) >= least_lcs * len(want):
                    out.add((d, i))
                    break
    return out


def planted():
    items = [prose(100 + i, n) for i, n in enumerate((8, 12, 20, 40, 75, 130))] + ["", " ?! "]
    texts = [None, "", prose(1, 500), " ".join(prose(2, 9000).split()[:9000])]
    for i, item in enumerate(items[:6]):
        w = item.split()
        texts.append(f"{prose(i, 90)} {item} {prose(50 + i, 70)}")  # verbatim
        texts.append(f"{prose(i, 33)} {' '.join(x for k, x in enumerate(w) if k % 4)} {prose(60 + i, 300)}")  # three words of four
        texts.append(f"{prose(i, 33)} {' '.join(w[: len(w) // 2])} {prose(70 + i, 50)}")  # the first half alone
        texts.append(" ".join(w[::-1]))  # backwards
    return texts + texts[4:6], items


def test_leaks_against_all_pairs(spark):
    texts, items = planted()
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(docs(spark, texts), bench).collect()}
    want = leaks_by_hand(texts, items)
    assert got == want and len(want) >= 14


def test_leaks_of_the_table(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    b = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    want = {(d[x]["doc_id"], b[y]["item_id"]) for x, y in leaks_by_hand([r["text"] for r in d], [r["text"] for r in b])}
    assert got == want


def test_stages_against_loops(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = d.orderBy("doc_id").collect()
    first = by_hand([r["text"] for r in rows])
    once = C.near_duplicates(spark, d, SF)
    assert sorted(r["doc_id"] for r in once.collect()) == [rows[i]["doc_id"] for i in range(len(rows)) if first[i] == i]

    leaked = {x for x, _ in leaks_by_hand([r["text"] for r in rows], [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])}
    assert sorted(r["doc_id"] for r in C.decontamination(spark, d, SF).collect()) == [r["doc_id"] for i, r in enumerate(rows) if i not in leaked]

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in C.quality(spark, d, SF).collect()}
    right = [(x in kept) == bool(y) for x, y in labels.items() if y is not None]
    assert sum(right) >= 0.95 * len(right)


def test_pieces_of_the_pipeline_are_whole(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    masked = C.personal_data(spark, d, SF)
    assert {r["doc_id"]: r["text"] for r in masked.collect()} == {r["doc_id"]: r["text"] for r in pii.pseudonymise(d, pii.session_key(spark)).collect()}
    pieces = C.pack(spark, masked, SF).collect()
    assert sorted(r[:5] for r in pieces) == sorted(r[:5] for r in pack(masked).collect())
    used = {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 4096


def test_clashing_names_pass_through(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").orderBy("item_id").first()["text"]
    rows = [(1, f"before {item} after", 7, 7, 7, 7, 7), (2, "a clean text of its own", 8, 8, 8, 8, 8), (2, "a clean text of its own", 8, 8, 8, 8, 8)]
    d = spark.createDataFrame(rows, "doc_id long, text string, __own int, __id int, __hash int, __key int, __leaked int")
    for stage, n in ((C.near_duplicates, 2), (C.decontamination, 2), (C.personal_data, 3)):
        got = stage(spark, d, SF)
        assert got.columns == d.columns and got.count() == n and all(r["__own"] == r["__key"] == r["doc_id"] + 6 for r in got.collect())
