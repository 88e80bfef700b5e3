from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from broadsheaf.llm import packing as P
from broadsheaf.llm.wordtok import Encoder, default_path

from .helpers import SF, docs, prose


@given(st.lists(st.text(max_size=40), max_size=8))
@settings(max_examples=150, deadline=None)
def test_encoder_equals_the_library(texts):
    enc = Encoder.of(default_path())
    ids, at, first, last = enc.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        want = enc.tok.encode(t, add_special_tokens=False)
        assert ids[at[i] : at[i + 1]].tolist() == want.ids
        assert list(zip(first[at[i] : at[i + 1]].tolist(), last[at[i] : at[i + 1]].tolist())) == want.offsets


def test_encoder_on_long_and_odd_texts():
    enc = Encoder.of(default_path())
    texts = ["aaaa" * 40, "q7" * 200, "İstanbul ΑΣ", "don't I'LL 's 'sx ''s", "日本語", "x́ é", "", "\x1c a", "<|endoftext|>", prose(1, 3000)]
    ids, at, _, _ = enc.encode(pa.array(texts), spots=False)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]


def fewest(items: list[int], c: int) -> int:
    best = [len(items)]

    def put(i: int, bins: list[int]) -> None:
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= c and bins[j] not in bins[:j]:
                bins[j] += items[i]
                put(i + 1, bins)
                bins[j] -= items[i]
        put(i + 1, [*bins, items[i]])

    put(0, [])
    return best[0] if items else 0


@pytest.mark.parametrize("seed", range(60))
def test_reduction_keeps_the_optimum(seed):
    r = random.Random(seed)
    c = r.choice([10, 20, 50])
    items = sorted((r.randint(1, c) for _ in range(r.randint(1, 9))), reverse=True)
    counts = dict(Counter(items))
    out = P.Solution(counts)
    P.reduce_dominated(counts, c, out)
    left = sorted((x for x, n in counts.items() for _ in range(n)), reverse=True)
    assert out.sequences + fewest(left, c) == fewest(items, c)
    whole = P.solve(Counter(items), c)
    fill = Counter()
    for length, _, n, q, seq, _ in whole.runs:
        for i in range(n):
            fill[seq + i // q] += length
    assert sum(fill.values()) == sum(items) and max(fill.values()) <= c and len(fill) == whole.sequences


def check(spark, frame, capacity):
    rows = P.pack(frame, capacity).toPandas()
    g = rows.sort_values(["sequence_id", "offset"])
    assert (g.groupby("sequence_id")["length"].cumsum() - g["length"] == g["offset"]).all()
    assert rows.groupby("sequence_id")["length"].sum().max() <= capacity
    return rows


def test_round_trip_with_odd_rows(spark):
    texts = [None, "", "a b c", prose(3, 50), prose(3, 50), "word " * 90, "日本 x"]
    frame = docs(spark, texts, [0, 1, 2, 3, 3, None, 6])
    rows = check(spark, frame, 32)
    enc = Encoder.of(default_path())
    want = []
    for i, t in zip([0, 1, 2, 3, 3, None, 6], texts):
        ids = np.array([*enc.tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(-1 if i is None else i, p, p * 32, len(ids[p * 32 : p * 32 + 32]), zlib.crc32(ids[p * 32 : p * 32 + 32].tobytes())) for p in range(-(-len(ids) // 32))]
    got = rows.fillna(-1)[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(int).values.tolist()
    assert sorted(map(tuple, got)) == sorted(want)


def test_whole_table_is_packed_tightly(spark):
    rows = check(spark, spark.read.parquet(f"{SF}/documents.parquet"), 4096)
    assert rows["sequence_id"].nunique() <= -(-rows["length"].sum() // 4096) * 1.01 + 1


def test_empty_table(spark):
    assert P.pack(docs(spark, ["x"]).limit(0)).count() == 0
