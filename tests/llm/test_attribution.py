from __future__ import annotations

import numpy as np
import pytest

from broadsheaf.llm import attribution as A
from broadsheaf.llm.wordtok import Encoder, default_path

from .helpers import docs, prose


def by_hand(text, rule):
    spans = Encoder.of(default_path()).tok.encode(text, add_special_tokens=False).offsets
    ends = A.sentences(text).tolist()
    sections = list(zip([0, *ends[:-1]], ends))
    whole, crossing, share = ([0.0] * len(sections) for _ in range(3))
    for a, b in spans:
        parts = [max(0, min(b, e) - max(a, s)) for s, e in sections]
        if sum(p > 0 for p in parts) > 1:
            for i, p in enumerate(parts):
                crossing[i] += p > 0
        for i, p in enumerate(parts):
            share[i] += p / (b - a)
        own = next(i for i, (s, e) in enumerate(sections) if s <= a < e) if rule != "most" else max(range(len(parts)), key=lambda i: (parts[i], -i))
        whole[own] += 1
    return sections, whole, crossing, share


@pytest.mark.parametrize("rule", A.RULES)
def test_against_brute_force(spark, rule):
    texts = ["One. Two... three?! four.,five\nsix", prose(5, 120), "...,;!", "é.é ß! 日本.", None, ""]
    got = A.token_counts(docs(spark, texts), rule).toPandas().sort_values(["doc_id", "section"])
    for i, t in enumerate(texts):
        rows = got[got.doc_id == i]
        if not t:
            assert rows[["section", "n_tokens"]].values.tolist() == [[-1, 0]]
            continue
        sections, whole, crossing, share = by_hand(t, rule)
        assert rows[["begin", "finish"]].values.tolist() == [list(s) for s in sections]
        assert rows["n_crossing"].tolist() == crossing
        want = whole if rule != "share" else share
        assert np.allclose(rows["tokens"], want)


def test_uncovered_characters_count_for_no_section():
    count, cross, share = A.attribute(np.array([0, 3, 8]), np.array([2, 7, 9]), np.array([1, 4]), np.array([2, 6]), "share")
    assert share.tolist() == pytest.approx([0.5, 0.5, 0.5 + 0.5 + 1])
    assert cross.tolist() == [1, 1, 2]


def test_unknown_rule(spark):
    with pytest.raises(ValueError):
        A.token_counts(docs(spark, ["a"]), "last")


def test_empty_table(spark):
    assert A.token_counts(docs(spark, ["x"]).limit(0)).count() == 0
