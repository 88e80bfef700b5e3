from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from broadsheaf.llm import repeats as R

from .helpers import docs, prose


def by_hand(texts, length):
    seen = Counter()
    for t in texts:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for t in texts:
        b = (t or "").encode()
        covered = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        runs = sum(1 for i, c in enumerate(covered) if c and (not i or not covered[i - 1]))
        out.append((len(b), sum(covered), runs, hashlib.sha256(bytes(x for x, c in zip(b, covered) if not c)).hexdigest()))
    return out


def corpus():
    passage, other = prose(1, 90), prose(2, 30)
    near = prose(3, 200).split()
    texts = [prose(10, 40) + passage + prose(11, 40), passage[7:] + "é" * 50, prose(12, 60), None, "", "ab" * 700, "x" * 900, other, other, prose(13, 20) + other[:-1] + prose(14, 20), passage + passage, "ß" * 260]
    for k in range(25):
        r = random.Random(k)
        w = near[:]
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"w{r.random():.5f}"
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("classes", [1500, 4])
def test_against_brute_force(spark, monkeypatch, classes):
    monkeypatch.setattr(R, "GROUP_CLASSES", classes)
    texts = corpus()
    got = R.remove_repeats(docs(spark, texts)).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got}
    assert [got[i] for i in range(len(texts))] == by_hand(texts, 400)


def test_kept_bytes(spark):
    texts = corpus()
    rows = R.strip_repeats(docs(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]


@pytest.mark.parametrize("seed", range(40))
def test_intervals_against_substrings(seed):
    r = random.Random(seed)
    n, length = r.randint(1, 70), r.randint(1, 12)
    s = np.array([r.choice([0, 1, 2]) for _ in range(n)])
    sa, group = R.intervals(s, length)
    of = np.empty(n, int)
    of[sa] = group
    for i in range(n - length + 1):
        for j in range(n - length + 1):
            assert (of[i] == of[j]) == (s[i : i + length].tolist() == s[j : j + length].tolist())


def test_anchors_are_told_by_content():
    a, b = np.frombuffer(prose(1, 300).encode(), np.uint8), np.frombuffer((prose(5, 37) + prose(1, 300)).encode(), np.uint8)
    x, y = (dict.fromkeys(R.regions(z, np.array([0, len(z)]))[3].tolist()) for z in (a, b))
    assert set(list(x)[1:-1]) <= set(y)


def test_empty_table(spark):
    assert R.remove_repeats(docs(spark, ["x"]).limit(0)).count() == 0
