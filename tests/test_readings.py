"""Consensus, confusions, agreement and scripts against plain loops over small texts."""

from __future__ import annotations

import random
import time
from collections import Counter, defaultdict

import pytest

from broadsheaf.functions import distance as X
from broadsheaf.functions import readings as R
from broadsheaf.functions import scripts as S
from broadsheaf.plans import query as Q
from broadsheaf.registry import queries

SF = "/root/testdata/sf0.001"


def test_steps_and_places(monkeypatch):
    monkeypatch.setattr(R, "ROWS", 3)
    monkeypatch.setattr(R, "CELLS", 1)
    r = random.Random(5)
    for _ in range(400):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 13))) for _ in "ab")
        assert R.steps(a, b) == X.align(a, b)
        assert R.within(a, b) == X.infix(a, b)


def plain_consensus(texts):
    """Words and differences by lists of occurrences that are searched through."""
    own = [R.printed_words(t) for t in texts]
    low = [[w.lower() for w in t] for t in own]
    links, swaps, gaps = [], [], []
    for i in range(len(own)):
        for j in range(i + 1, len(own)):
            for kind, p, q in X.align(low[i], low[j]):
                if kind == "equal":
                    links.append(((i, p), (j, q)))
                elif kind == "substitute":
                    swaps += [(i, p, j, q), (j, q, i, p)]
                elif kind == "insert":
                    gaps.append((i, None, j, q))
                else:
                    gaps.append((j, None, i, p))
    beside = lambda u: {b if a == u else a for a, b in links if u in (a, b)}
    sets = [{(i, p)} for i, t in enumerate(own) for p in range(len(t))]
    of = lambda u: next(s for s in sets if u in s)
    for u, v in sorted(links, key=lambda e: (-len(beside(e[0]) & beside(e[1])), e)):
        a, b = of(u), of(v)
        if a is not b and not {i for i, _ in a} & {i for i, _ in b}:
            sets.remove(b)
            a |= b
    words = [s for s in sets if len(s) > 1]
    told, seen = [], []
    for i, p, j, q in swaps + gaps:
        s = of((j, q))
        if len(s) > 1 and i not in {k for k, _ in s} and (i, s) not in seen:
            seen.append((i, s))
            told.append((i, own[j][q], "" if p is None else own[i][p]))
    return own, words, sorted(told)


def some_texts(n, seed):
    r = random.Random(seed)
    lexicon = ["the", "moment", "of", "mere", "time", "Came,", "home", "am", "me", "see"]
    for _ in range(n):
        a = [r.choice(lexicon) for _ in range(r.randint(0, 14))]
        yield [" ".join(w.replace("m", "rn") if r.random() < p else w for w in a if r.random() > 0.1) for p in (0, 0.3, 0.6)]


def test_consensus_against_loops():
    for texts in [*some_texts(150, 7), ["", "", ""], ["a", "", "a"]]:
        own, words, told = plain_consensus(texts)
        got, differ = R.consensus(own)
        assert sorted(sorted(w.items()) for w in got) == sorted(sorted(w) for w in words)
        assert differ == told


def test_consensus_query(spark):
    """Whole texts: every reading's counts, and confusions of the readers' own making, by loops over the short ones."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = defaultdict(dict)
    for r in queries()["q_consensus"](spark, SF).collect():
        got[r["doc_id"]][r["reader"]] = (r["own"], r["held"], r["words"])
    assert got.keys() == texts.keys() and all(v.keys() == {0, 1, 2} for v in got.values())
    short = [i for i, t in texts.items() if len(t) < 900]
    assert len(short) > 20
    for i in short:
        t = texts[i]
        own, words, _ = plain_consensus([t, t.replace("m", "rn"), t.replace("e", "c")])
        assert got[i] == {k: (len(own[k]), sum(any(r == k for r, _ in w) for w in words), len(words)) for k in range(3)}
    top = queries()["q_confusions"](spark, SF).collect()
    best = {r["reader"]: (r["kind"], r["was"], r["now"]) for r in top if r["rank"] == 1}
    assert best == {1: ("sub", "m", "rn"), 2: ("sub", "e", "c")}
    counted = Counter()
    for t in texts.values():
        _, told = R.consensus([R.printed_words(x) for x in (t, t.replace("m", "rn"), t.replace("e", "c"))])
        counted.update((r, *c) for r, a, b in told for c in R.confusions(a, b))
    for reader in {k[0] for k in counted}:
        want = sorted(((k, n) for k, n in counted.items() if k[0] == reader), key=lambda x: (-x[1], x[0]))[:50]
        assert [((r["reader"], r["kind"], r["was"], r["now"]), r["n"]) for r in sorted(top, key=lambda r: r["rank"]) if r["reader"] == reader] == want


def test_long_readings():
    """Readings of 40,000 words: equal ones in place are told apart from others without a table of all pairs of words."""
    r = random.Random(3)
    text = " ".join(r.choice(["moment", "of", "mere", "time", "corn", "home", "am"]) + str(r.randrange(5000)) for _ in range(40_000))
    texts = [text, text.replace("m", "rn"), text.replace("e", "c")]
    own = [R.printed_words(t) for t in texts]
    began = time.monotonic()
    words, told = R.consensus(own)
    assert time.monotonic() - began < 10
    same = [[a == b for a, b in zip(own[i], own[j])] for i, j in ((0, 1), (0, 2), (1, 2))]
    assert len(words) == sum(map(any, zip(*same))) and all(len(set(w.values())) == 1 for w in words)
    assert Counter(k for k, _, _ in told) == Counter([1] * sum(c and not a for a, c in zip(same[0], same[1])) + [2] * sum(a and not c for a, c in zip(same[0], same[1])) + [0] * sum(z and not a for a, z in zip(same[0], same[2])))


def test_confusions_counted_by_task(spark, monkeypatch):
    """Counts handed over at every page, by pages in several tasks and with null texts, are those of all pages."""
    monkeypatch.setattr(R, "HELD", 1)
    pages = [*some_texts(60, 9), [None, "me am", "me am"], [None, None, None]]
    df = spark.createDataFrame(pages, "a string, b string, c string").repartition(3)
    got = {(r["reader"], r["kind"], r["was"], r["now"]): r["n"] for r in R.confusions_of(df, *(df[c] for c in "abc")).collect()}
    want = Counter((r, *c) for t in pages for r, a, b in plain_consensus(t)[2] for c in R.confusions(a, b))
    assert got == want and want


def test_confusions():
    assert R.confusions("modern", "rnodem") == (("sub", "m", "rn"), ("sub", "rn", "m"))
    assert R.confusions("cat", "") == (("del", "cat", ""),) and R.confusions("", "a") == (("ins", "", "a"),) and R.confusions("x", "x") == ()


def plain_place(piece, start, other):
    votes = sorted(p - start - i for i, w in enumerate(piece) if len(w) >= 4 and other.count(w) <= 2 for p, v in enumerate(other) if v == w)
    best = max(((sum(v <= x <= v + 6 for x in votes), -k) for k, v in enumerate(votes)), default=(0, 0))
    text, rate, e = " ".join(piece), None, 0
    if best[0] >= 2:
        at = start + votes[-best[1] + best[0] // 2]
        part = other[max(at - 12, 0) : max(at + len(piece) + 12, 0)]
        if part:
            e = X.infix(text, " ".join(part))
            rate = e / len(text)
    placed = rate is not None and rate <= 0.5
    if (rate is None or rate > 0.2) and len(piece) >= 20:
        h = len(piece) // 2
        (c, x), (d, y) = plain_place(piece[:h], start, other), plain_place(piece[h:], start + h, other)
        n = c + d + (1 if c and d else 0)
        if not placed or n and (x + y) / n < rate:
            return n, x + y
    return (len(text), e) if placed else (0, 0)


def test_placed_against_loops():
    r = random.Random(11)
    lexicon = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(150)]
    for _ in range(25):
        a = [r.choice(lexicon) for _ in range(r.randint(0, 130))]
        parts = [a[i : i + 30] for i in range(0, len(a), 30)]
        if r.random() < 0.5:
            r.shuffle(parts)
        b = [w if r.random() < 0.85 else w[1:] + "x" for p in parts for w in p if r.random() < 0.95]
        want = [plain_place(a[i : i + 40], i, b) for i in range(0, len(a), 40)]
        assert R.placed(a, b) == (sum(len(" ".join(a[i : i + 40])) for i in range(0, len(a), 40)), sum(c for c, _ in want), sum(e for _, e in want))


@pytest.mark.parametrize("few, side, table", [(0, 2048, 2_000_000), (0, 3, 2_000_000), (0, 2048, 50), (16, 2048, 2_000_000)])
def test_within_side_by_side(monkeypatch, few, side, table):
    """Patterns of no, one and several words of bits, with texts that are empty, longer, shorter and of other letters."""
    for name, v in (("FEW", few), ("SIDE", side), ("TABLE", table)):
        monkeypatch.setattr(R, name, v)
    r = random.Random(8)
    pairs = [("", ""), ("", "a"), ("a", ""), ("ab" * 63, "ab" * 70), ("日本" * 40, "日x本" * 30), ("\U0010ffff" * 64, "\U0010ffff")]
    for n in (1, 5, 62, 63, 64, 126, 127, 200) * 12:
        p = "".join(r.choice("abcdé") for _ in range(n))
        noisy = "".join(c if r.random() < 0.8 else r.choice(["", "a", "xy"]) for c in p)
        pairs.append((p, r.choice([noisy, p, "zz" + noisy + "abc", noisy[n // 2 :], "".join(r.choice("abq") for _ in range(r.randint(0, 90)))])))
    assert R.within_all(pairs).tolist() == [X.infix(p, t) for p, t in pairs]
    assert R.within_all([]).tolist() == []


def test_pieces_of_all_texts_are_compared_together(monkeypatch):
    """Texts together agree as each alone does, and few of their pieces are compared one at a time."""
    r = random.Random(17)
    lexicon = ["".join(r.choice("abcdefghmn") for _ in range(r.randint(2, 8))) for _ in range(2000)]
    texts = [" ".join(r.choice(lexicon) for _ in range(r.randint(0, 400))) for _ in range(60)]
    pairs = [(None, "a"), ("", None), *((t, r.choice([t, t.replace("m", "rn"), t[len(t) // 3 :] + t[: len(t) // 3], texts[0]])) for t in texts)]
    one, calls = R.within, []
    monkeypatch.setattr(R, "within", lambda p, t: calls.append(p) or one(p, t))
    want = [R.agreement(*p) for p in pairs]
    alone = len(calls)
    assert R.agreements(pairs) == want
    assert 2 * (len(calls) - alone) < alone
    calls.clear()
    long = " ".join(r.choice(lexicon) for _ in range(4000))  # 100 pieces, each way
    R.agreement(long, long.replace("m", "rn"))
    assert len(calls) < 100


def test_agreement_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries()["q_text_agreement"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, t in list(texts.items()):
        want = R.agreement(t, t.replace("m", "rn"))
        assert {m: got[i][m] for m in R.MEASURES} == want
    assert R.agreement(None, "") == dict.fromkeys(R.MEASURES)
    same = R.agreement("one of these very common sentences here", "one of these very common sentences here")
    assert same["cover_a"] == same["matched_b"] == 1.0 and same["local_cer_sym"] == 0.0


def test_japanese():
    assert [w for w, _, _ in S.japanese_tokens("ｶﾞ日本のSão Paulo がっこう、１９", {"本": "木"})] == ["ガ", "日", "木", "の", "sao", "paulo", "が", "つ", "こ", "う", "19"]
    assert S.japanese_tokens("が ゙ " + "x" * 41) == [("が", 0, 2)] and S.japanese_tokens("") == []
    assert S.find("東京 日本の日本日本", [["日", "本"], ["京"]]) == [(1, 2), (3, 5), (6, 10)]
    assert S.snippets("aaa 日本 bbb\nccc 日本", [["日", "本"]], 3, 2) == [[(False, "aa "), (True, "日本"), (False, " bb")], [(False, "cc "), (True, "日本")]]
    assert S.snippets("日本日", [["日"]], 5, 1) == [[(True, "日"), (False, "本"), (True, "日")]]


def test_latin(spark):
    rows = [("東京Ｄｅｎｖｅｒ St.、1945年 A\n Moritz Drug Co 薬", "Denver St.\nMoritz Drug Co"), ("", ""), ("日本", ""), (None, None), ("re-\npaid", "repaid")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    assert [r["x"] for r in df.select("i", S.latin_text(df["t"]).alias("x")).orderBy("i").collect()] == [w for _, w in rows]


@pytest.mark.parametrize("query, want", [("cotton harvest", "eng"), ("cotton die", "eng"), ("die", None), ("cotton OR die", None), ("cotton OR harvest", "eng"), ("zeppelin cotton", None), ("cotto*", None), ('"cotton 1900"', "eng"), ("日本", "jpn"), ("日本 cotton", None), ("cotton NOT zeppelin", "eng")])
def test_query_language(query, want):
    assert Q.language(Q.parse(query), {"cotton", "harvest"}, {"die"}) == want
