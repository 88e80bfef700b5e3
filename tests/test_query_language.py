from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from broadsheaf.functions.text import tokenise
from broadsheaf.plans.query import QueryError, matches, parse, spellings, words_of


@pytest.mark.parametrize(("query", "canonical"), [
    ("silver gold", "gold silver"), ("2 OF (silver gold bryan)", "2 OF (bryan gold silver)"), ('"cross of gold" OR fever -plague', '"cross of gold" OR (NOT plague fever)'), ('"a b"~3', '"a b"~3'),
    ("Gold?", "gold"), ("silve*", "silve*"), ("presi?ent", "presi?ent"), ("then~ocr", "then~ocr"), ("gold~1", "gold~1"), ("well-known", '"well known"'), ("(a OR b) c", "(a OR b) c"),
])
def test_canonical(query, canonical):
    node = parse(query)
    assert str(node) == canonical and str(parse(str(node))) == canonical


@pytest.mark.parametrize("query", ["", '"open', "text:gold", "gol*", "2 OF (a b)", "2 OF (a (b c) d)", "-gold", "(a", "a)", '"a b"~21', "gold~3", "silve*~1", "x" * 300, "7 OF (a b c)", "OR"])
def test_errors(query):
    with pytest.raises(QueryError):
        parse(query)


def test_modes():
    assert str(parse("cross of gold", "phrase")) == '"cross of gold"' and str(parse("a b", "any")) == "a OR b" and str(parse("a b", "near", 4)) == '"a b"~4' and str(parse("b a", "all")) == "a b"


def test_spellings_differ_by_one_confusion():
    assert spellings("them") == ["them"] + sorted({"tbem", "thcm", "thern", "tliem"})
    assert len(spellings("h" * 60)) == 32


def test_excluded_words_are_not_marked():
    assert words_of(parse("gold -silver \"big fever\"")) == {"gold", "big", "fever"}


def test_tokens_fold():
    assert tokenise("Äpfel, œuvre ſtraße Łódź x" + "y" * 50) == ["apfel", "oeuvre", "strasse", "lodz", "_"]


def near_by_hand(words, terms, slop):
    best = {i: 0 for i, w in enumerate(words) if w == terms[0]}
    for t in terms[1:]:
        best = {j: min(c + abs(j - i - 1) for i, c in best.items()) for j, w in enumerate(words) if w == t} if best else {}
        best = {j: c for j, c in best.items() if c <= slop}
    return bool(best)


def test_near_against_brute_force(spark):
    r = random.Random(2)
    pages = [[r.choice("abcdx") for _ in range(r.randint(0, 12))] for _ in range(200)]
    df = spark.createDataFrame([(i, " " + " ".join(p) + " ") for i, p in enumerate(pages)], "i int, words string")
    for q, terms, slop in (('"a b"~1', "ab", 1), ('"a b"~3', "ab", 3), ('"a b c"~2', "abc", 2), ('"c a"~2', "ca", 2)):
        got = {x["i"] for x in df.where(matches(parse(q), F.col("words"))).collect()}
        assert got == {i for i, p in enumerate(pages) if near_by_hand(p, terms, slop)}
