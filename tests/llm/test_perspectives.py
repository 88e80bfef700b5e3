from __future__ import annotations

import random

from broadsheaf.llm import perspectives as V

SCHEMA = "conv_id long, turn long, role string, text string, block int, assistant string, n int"


def by_hand(rows):
    out = set()
    count = 0
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((-1 if t is None else t, r or "unknown", x or "", t))
    for c, turns in convs.items():
        turns.sort(key=lambda y: (y[0], y[1].encode(), y[2].encode()))
        for who in {y[1] for y in turns} - {"system"}:
            at = 0
            for k, (_, r, x, t) in enumerate(turns):
                role = "assistant" if r == who else "system" if r == "system" else "user"
                head = {"assistant": "<|assistant|>\n", "system": "<|system|>\n", "user": f"<|user name={r}|>\n"}[role]
                whole = head + x + "<|end|>\n"
                mask = (at + len(head), at + len(whole)) if role == "assistant" else (None, None)
                out.add((c, who, k, t, r, role, whole, at, at + len(whole), *mask, role == "assistant"))
                count += 1
                at += len(whole)
    return out, count


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def test_against_brute_force(spark):
    r = random.Random(1)
    rows = [(c, t, r.choice(["system", "ann", "bob", "eve", None]), r.choice(["hi", None, "é" * 5, "", "x\ny"])) for c in range(6) for t in range(r.randint(1, 9))]
    rows += [(9, t, r.choice(["a", "b"]), "w" * (t % 5)) for t in range(300)]  # several blocks
    rows += [(None, 1, "a", "n"), (10, 0, "system", "only"), (11, None, "a", "x"), (11, 0, "b", "y"), (12, 1, "a", "z"), (12, 1, "b", "z"), (-3, -70, "a", "neg"), (-3, 5, "b", "pos")]
    want, count = by_hand(rows)
    got = V.rotate(frame(spark, rows)).collect()
    assert len(got) == count and {tuple(x) for x in got} == want


def test_repeated_turns(spark):
    rows = [(1, 0, "a", "x"), (1, 0, "a", "x"), (1, 1, "b", "y")]
    got = V.rotate(frame(spark, rows)).collect()
    assert sorted((x["assistant"], x["segment"]) for x in got) == [(p, s) for p in "ab" for s in range(3)]


def test_plan_is_native_and_empty_table(spark):
    out = V.rotate(frame(spark, [(1, 0, "a", "x")]).limit(0))
    assert out.count() == 0 and "Python" not in out._jdf.queryExecution().executedPlan().toString()
