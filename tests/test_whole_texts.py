"""Queries over whole texts: nothing after a prefix is left out."""

from __future__ import annotations

import random
import time

import pytest

from broadsheaf.functions import distance as X
from broadsheaf.registry import queries


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    """Documents whose readings differ only late, and short ones."""
    d = tmp_path_factory.mktemp("whole")
    texts = ["x" * 500 + " memory elm", "alpha beta " * 90 + "mimic emblem\nñandú me", "a me", "me", "", "?", None]
    rows = [(i, t, "en", f"source_{i}", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/nation.parquet").write.parquet(f"{d}/nation.parquet")
    spark.read.parquet("/root/testdata/sf0.001/region.parquet").write.parquet(f"{d}/region.parquet")
    return str(d), texts


def test_whole_edits_against_a_table():
    for seed in range(300):
        r = random.Random(seed)
        a, b = ("".join(r.choice("abñ") for _ in range(r.randint(0, 90))) for _ in range(2))
        assert X.whole_edits(a, b) == X.edits(a, b)


def test_whole_edits_of_words_and_of_long_readings():
    """Words beside each other count only where no other alignment can need less; a reading of 400,000 letters takes no table."""
    r = random.Random(8)
    for _ in range(400):
        a = " ".join("".join(r.choice("mern") for _ in range(r.randint(0, 4))) for _ in range(r.randint(0, 12)))
        for b in (a.replace("m", "rn"), a.replace("e", "c"), a[1:] + " m", "".join(r.choice([c, c, c, "m", " "]) for c in a)):
            assert X.whole_edits(a, b) == X.edits(a, b)
    text = " ".join(r.choice(["moment", "of", "mere", "time", "corn"]) for _ in range(80_000))
    began = time.monotonic()
    assert X.whole_edits(text.replace("m", "rn"), text.replace("e", "c")) == 2 * text.count("m") + text.count("e")
    assert time.monotonic() - began < 10


def test_edits_late_in_a_text(spark, whole):
    d, texts = whole
    pairs = {r["doc_id"]: r for r in queries()["q_pair_metrics"](spark, d).collect()}
    hats = {r["doc_id"]: r for r in queries()["q_hat3"](spark, d).collect()}
    for i, a in enumerate(texts):
        if a is None:
            assert pairs[i]["cer_a"] == 0 and hats[i]["a"] == 0  # as the SQL of the shorter queries has it
            continue
        b, c, n = a.replace("m", "rn"), a.replace("e", "c"), max(len(a), 1)
        e, ab, ac, bc = X.edits(a, b), X.edits(a, b) / n, X.edits(a, c) / n, X.edits(b, c) / n
        assert [pairs[i][k] for k in ("cer_a", "cer_b", "cer_sym")] == pytest.approx([e / max(len(b), 1), e / n, 2 * e / max(len(a) + len(b), 1)], abs=1e-8)
        assert [hats[i][k] for k in "abc"] == pytest.approx([max(x / 2, 0) for x in (ab + ac - bc, ab + bc - ac, ac + bc - ab)], abs=1e-8)
    assert pairs[0]["cer_a"] > 0


def test_words_and_pairs_late_in_a_text_and_in_short_ones(spark, whole):
    d, texts = whole
    dice = {r["doc_id"]: r["dice"] for r in queries()["q_dice"](spark, d).collect()}
    grams = {r["doc_id"]: (r["kept"], r["lost"]) for r in queries()["q_kept_lost_ngrams"](spark, d).collect()}
    # 1: alpha beta 90 times (2 pairs, words 180 of 184 the same in both readings); then mimic emblem ñandú me
    assert grams[1] == (2, 4) and dice[1] == pytest.approx(181 / 184, abs=1e-8)
    assert grams[2] == (0, 1) and dice[2] == 0.5
    assert grams[3] == grams[4] == grams[5] == (0, 0) and dice[3] == 0 and dice[4] == dice[5] == 1


def test_status_of_whole_texts(spark, whole):
    got = {r["status"]: r["pages"] for r in queries()["q_text_status"](spark, whole[0]).collect()}
    assert got == {"ok": 2, "short": 3, "empty": 2}
