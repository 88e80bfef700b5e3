from __future__ import annotations

import random
from datetime import date

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from broadsheaf.functions import distance as X
from broadsheaf.functions import language as G
from broadsheaf.functions import text as T
from broadsheaf.functions.special import gamma_p, gamma_quantile
from broadsheaf.functions.time import Buckets, date_of_day, day_number
from broadsheaf.operators import skew as S


def table(a, b, free=False):
    d = [[j if not free else 0 for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(d[-1][j - 1] + (x != y), d[-1][j] + 1, row[-1] + 1))
        d.append(row)
    return min(d[-1]) if free else d[-1][-1]


@given(st.text("abc", max_size=9), st.text("abc", max_size=9))
@settings(max_examples=200, deadline=None)
def test_distances(a, b):
    assert X.edits(a, b) == table(a, b) and X.infix(a, b) == table(a, b, True)
    s, i, d = X.split_edits(a, b)
    assert s + i + d == table(a, b) and len(a) - d == len(b) - i


def test_hat():
    assert X.hat(3, [(0, 1, 0.3), (0, 2, 0.4), (1, 2, 0.5)]) == pytest.approx([0.1, 0.2, 0.3])
    assert X.hat(2, [(0, 1, 0.3)]) is None and X.hat(3, [(0, 1, 0.3)]) is None
    assert X.hat(3, [(0, 1, 0.0), (0, 2, 0.5), (1, 2, 0.9)])[0] == 0


def test_boxes_and_orders():
    assert X.iou((0, 0, 2, 2), (1, 0, 2, 2)) == pytest.approx(1 / 3)
    assert X.match_boxes([(0, 0, 2, 2), (5, 5, 2, 2)], [(0.9, (5, 5, 2, 2)), (0.8, (0, 0, 2, 2)), (0.7, (0, 0, 2, 2))]) == [(1, 0), (0, 1)]
    assert X.order_agreement([(0, 0), (1, 1), (2, 2)]) == (1.0, 1.0) and X.order_agreement([(0, 2), (1, 1), (2, 0)]) == (-1.0, 0.0)
    assert X.xy_cut([(60, 0, 40, 10), (0, 0, 40, 10), (0, 20, 40, 10), (60, 20, 40, 10)]) == [1, 2, 0, 3]


def test_gamma_functions():
    assert gamma_p(np.array([1.0, 2.0]), np.array([1.0, 3.0])) == pytest.approx([1 - np.exp(-1), 1 - 4 * np.exp(-3)])
    a = np.array([0.3, 1.0, 7.5, 200.0])
    for p in (0.05, 0.5, 0.95):
        assert gamma_p(a, gamma_quantile(np.full(4, p), a, np.ones(4))) == pytest.approx([p] * 4)


def test_prior_recovers_its_parameters():
    r = np.random.default_rng(5)
    e = r.uniform(5, 50, 3000)
    o = r.poisson(r.gamma(4, 1.5 / 4, 3000) * e)
    alpha, mean = S.fit_prior(o.astype(float), e, 1.0)
    assert alpha == pytest.approx(4, rel=0.15) and mean == pytest.approx(1.5, rel=0.05)


def test_score_covers_the_truth(spark):
    r = np.random.default_rng(1)
    lift = {f"p{i}": x for i, x in enumerate(r.gamma(8, 1 / 8, 20))}
    rows = [(p, b, 500, int(r.poisson(500 * 0.05 * x))) for p, x in lift.items() for b in range(48)]
    cells = spark.createDataFrame(rows, "place_id string, bucket int, pages long, hits long")
    got = S.score(S.reference_rates(cells.select("place_id", "bucket", "hits"), cells.select("place_id", "bucket", "pages")), Buckets("month", date(1900, 1, 1), date(1903, 12, 31))).collect()
    assert len(got) == 20 and all(x["low"] < x["estimate"] < x["high"] for x in got)
    order = sorted(got, key=lambda x: x["estimate"])
    assert lift[order[0]["place_id"]] < 1 < lift[order[-1]["place_id"]]


@given(st.dates(date(1700, 1, 1), date(1990, 1, 1)), st.integers(0, 20000), st.sampled_from(["day", "week", "month", "year"]))
@settings(max_examples=100, deadline=None)
def test_bucket_keys_cover_the_range(start, days, unit):
    end = date.fromordinal(start.toordinal() + days)
    b = Buckets(unit, start, end)
    assert len(b) >= 1 and b.key(end) - b.key(start) == len(b) - 1


def test_buckets(spark):
    assert Buckets.auto(date(1850, 1, 1), date(1900, 1, 1)).unit == "year" and Buckets.auto(date(1850, 1, 1), date(1850, 3, 1)).unit == "day"
    assert Buckets("day", date(1850, 1, 1), date(1860, 1, 1)).coarser(10, 2000).unit == "month"
    with pytest.raises(ValueError):
        Buckets("year", date(1850, 1, 1), date(1860, 1, 1)).coarser(10, 5)
    d = spark.createDataFrame([(date(1736, 5, 1),), (date(1963, 12, 31),)], "d date").select("d", date_of_day(day_number(F.col("d"))).alias("e"))
    assert all(r["d"] == r["e"] for r in d.collect())


def test_normalise_is_idempotent():
    raw = "Die ſonne ﬁel  auf\tdie Wie-\n  sen.\n\n\nEnde\x07 "
    once = T.normalise(raw)
    assert once == "Die sonne fiel auf die Wiesen.\nEnde" and T.normalise(once) == once


def test_snippets():
    t = "x " * 100 + "the gold rush & silver" + " y" * 100
    assert T.snippets(t, {"gold", "silver"}) == ["… " + "x " * 37 + "x the <mark>gold</mark> rush &amp; <mark>silver</mark>" + " y" * 40 + " …"] or "<mark>gold</mark> rush &amp; <mark>silver</mark>" in T.snippets(t, {"gold", "silver"})[0]


def test_garbage_and_near_misses():
    assert [w for w in ("hello", "xxxxz", "bcdf", "aeiou", "a..;", "heLLo", "III", "tooo") if G.is_garbage(w)] == ["xxxxz", "bcdf", "aeiou", "a..;", "heLLo", "tooo"]
    near = G.near_misses(["the"], {"the", "then"})
    assert near["tho"] == "the" and "then" not in near and near["th"] == "the"


def test_char_model_prefers_its_language():
    r = random.Random(1)
    text = " ".join(r.choice(G.FUNCTION_WORDS["en"]) for _ in range(3000))
    m = G.CharModel(text)
    assert m.bits("the and that from") < m.bits("zqx vbn wqp") and m.bits("") is None
    assert sum(m.p("th", c) for c in sorted(set(text))) == pytest.approx(1, abs=0.05)
