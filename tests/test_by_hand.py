"""Queries without SQL against plain loops."""

from __future__ import annotations

import hashlib
import html
import math
import random
import re
import unicodedata
from collections import Counter, defaultdict
from datetime import datetime

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from broadsheaf.catalogue.campaigns import CELL, sizes
from broadsheaf.functions import distance as X
from broadsheaf.functions import text as T
from broadsheaf.functions.time import next_run
from broadsheaf.operators import windows as V
from broadsheaf.registry import queries

SF = "/root/testdata/sf0.001"


def test_allocate_steps(spark):
    cells = defaultdict(list)
    for r in sizes(spark, SF).collect():
        cells[tuple(r[c] for c in CELL)].append((r["lccn"], r["pages"]))
    want = {}
    for cell, titles in cells.items():
        titles.sort(key=lambda t: (hashlib.sha256(f"s2{t[0]}".encode()).hexdigest(), t[0]))
        if len(titles) <= 8:
            left, taken = dict(titles), Counter()
            while sum(taken.values()) < 8 and any(left.values()):
                for t, _ in titles:
                    if left[t] and sum(taken.values()) < 8:
                        left[t] -= 1
                        taken[t] += 1
        else:
            step = sum(n for _, n in titles) / 8
            start = int(hashlib.sha256("|".join(["s2", *map(str, cell)]).encode()).hexdigest()[:8], 16) % 1000 / 1000.0 * step
            taken, end = Counter(), 0
            for t, n in titles:
                below = [max(0, math.ceil((x - start) / step)) for x in (end, end + n)]
                taken[t] += below[1] - below[0]
                end += n
        want |= {(*cell, t): n for t, n in taken.items() if n}
    got = {tuple(r[c] for c in (*CELL, "lccn")): r["take"] for r in queries()["q_allocate_steps"](spark, SF).collect()}
    assert got == want


def test_leases(spark):
    per = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/events.parquet").collect():
        if r["user_id"] is not None:
            per[r["user_id"] % 50].append((r["ts"], {"signup": "send", "purchase": "delete"}.get(r["event_type"], "receive")))
    want = Counter()
    for rows in per.values():
        there, until, tries = False, 0.0, 0
        for ts, action in sorted(rows, key=lambda x: x[0]):
            now = int(ts.timestamp())
            if action == "send" and not there:
                there, until, tries = True, 0, 0
            elif action == "delete":
                there = False
            elif action == "receive" and there and now >= until:
                tries += 1
                there, until = tries <= 5, now + 6 * 3600
                want["delivered" if there else "dead"] += 1
    assert {r["state"]: r["n"] for r in queries()["q_stream_leases"](spark, SF).collect()} == dict(want)


def test_normalised(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r["text"] for r in queries()["q_normalised"](spark, SF).collect()}
    for i, raw in texts.items():
        chars = [c for c in unicodedata.normalize("NFC", raw).replace("ſ", "s") if c in "\n\t" or unicodedata.category(c) != "Cc"]
        plain = "".join(T.LIGATURES.get(c, c) for c in chars)
        plain = re.sub(r"([^\W\d_])[-⸗¬‐][ \t]*\n\s*(?=[^\W\d_])", r"\1", plain)
        lines = [" ".join(line.split()) for line in plain.split("\n")]
        assert got[i] == "\n".join(line for line in lines if line), i
    assert T.normalise("ﬁn  de-\n sieſs\x07\n\n x") == "fin desiess\nx"


def test_snippets(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries()["q_snippets"](spark, SF).collect()
    assert len(got) == 20
    for r in got:
        flat = " ".join(texts[r["doc_id"]].split())
        assert 1 <= len(r["snippets"]) <= 3
        marked = [m for s in r["snippets"] for m in re.findall("<mark>(.*?)</mark>", s)]
        assert {T.fold(m) for m in marked} <= {"this", "from"} and marked
        at = 0
        for s in r["snippets"]:
            bare = html.unescape(re.sub("</?mark>", "", s)).removeprefix("… ").removesuffix(" …")
            at = flat.index(bare, at)  # in order, and each a run of the text
            words = [T.fold(w) for w in re.findall(r"[^\W_]+", bare)]
            assert sum(w in ("this", "from") for w in words) == s.count("<mark>")



def test_numbers_range_by_range(spark, monkeypatch):
    r = random.Random(3)
    rows = [(r.choice([0.5, 0.25, r.random()]), i) for i in range(3000)]
    monkeypatch.setattr(V, "SAMPLED", 1)
    frame = spark.createDataFrame(rows, "v double, id long")
    got, n = V.numbered(frame, -F.col("v"), F.col("id"))
    order = sorted(rows, key=lambda x: (-x[0], x[1]))
    assert n == 3000 and [(x["v"], x["id"]) for x in sorted(got.collect(), key=lambda x: x["rn"])] == order
    assert V.in_ranges(frame, -F.col("v"), F.col("id")).select("part").distinct().count() > 50
    for size, tiles in ((0, 4), (3, 10), (25, 10), (40, 4)):
        some = frame.where(F.col("id") < size)
        want = [r["t"] for r in some.select("id", F.ntile(tiles).over(W.orderBy("v", "id")).alias("t")).orderBy("id").collect()]
        assert [r["t"] for r in V.tiled(some, tiles, "t", F.col("v"), F.col("id")).orderBy("id").collect()] == want


def test_rate_limit(spark):
    per = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/events.parquet").collect():
        per[None if r["user_id"] is None else str(r["user_id"] % 50)].append(r["ts"].timestamp())
    want = {}
    for key, times in per.items():
        tokens, last, told = 3.0, None, Counter()
        for t in sorted(times):
            if last is not None:
                tokens = min(3.0, tokens + (t - last) / 10800)
            last = t
            told[tokens >= 1 - 1e-9] += 1
            tokens -= tokens >= 1 - 1e-9
        want[key] = (told[True], told[False])
    assert {r["key"]: (r["allowed"], r["refused"]) for r in queries()["q_rate_limit"](spark, SF).collect()} == want


def test_schedules():
    at = datetime(2024, 2, 28, 23, 59, 30)
    cases = {"* * * * *": (2024, 2, 29, 0, 0), "30 6 * * *": (2024, 2, 29, 6, 30), "0 0 29 2 *": (2024, 2, 29, 0, 0), "*/20 5-6 * 3 *": (2024, 3, 1, 5, 0), "0 12 1 * 7": (2024, 3, 1, 12, 0), "0 12 * * 7": (2024, 3, 3, 12, 0), "59 23 28 2 *": (2025, 2, 28, 23, 59)}
    assert {k: next_run(k, at) for k in cases} == {k: datetime(*v) for k, v in cases.items()}
    assert next_run("0 0 30 2 *", at) is None
    with pytest.raises(ValueError):
        next_run("60 0 * * *", at)


def test_words_of_overlapping_tiles():
    assert X.read_twice(1280) == [] and X.read_twice(2304) == [] and X.read_twice(2000) == [(848, 1152)]
    words = [(900, 0, 950, 20), (905, 0, 955, 20), (10, 0, 60, 20), (12, 0, 62, 20), (900, 100, 950, 120)]
    assert X.without_repeats(words, 2000, 1000) == [True, False, True, True, True]
