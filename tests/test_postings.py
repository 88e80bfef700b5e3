"""Searches from the word index against scans of the text."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from broadsheaf.engine import Engine
from broadsheaf.operators import postings as P
from broadsheaf.plans.query import Not, Term, parse
from broadsheaf.sources import corpus

SF = "/root/testdata/sf0.001"
QUERIES = ["than", "than with", "(than OR dans) -sur", "tionth*", "tions?an*", '"of the"', '"of the and"', "from~1", "modern~ocr", "2 OF (of than dans sur)", "nosuchword", 'this -"of the"']


@pytest.fixture(scope="module")
def engines(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("index"))
    pages = corpus.text_pages(spark, SF)
    P.write(P.postings(pages), f"{root}/postings")
    pages.write.partitionBy("decade").parquet(f"{root}/pages")
    whole = spark.read.parquet(f"{root}/pages")
    span = (date(1850, 1, 1), date(1900, 12, 31))
    return Engine(whole, *span), Engine(whole, *span, index=spark.read.parquet(f"{root}/postings"))


@pytest.mark.parametrize("q", QUERIES)
def test_same_pages(engines, q):
    scan, indexed = engines
    assert P.answers(parse(q))
    key = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert key(indexed.found(q)) == key(scan.found(q))
    some = {"start": date(1860, 1, 1), "end": date(1875, 6, 1), "front_page": True}
    assert key(indexed.found(q, **some)) == key(scan.found(q, **some))


def test_what_only_a_scan_answers(engines):
    scan, indexed = engines
    assert not P.answers(parse('"of was"~3')) and not P.answers(Not(Term("sur")))
    assert indexed.found('"of was"~3').count() == scan.found('"of was"~3').count()


def test_a_word_reads_no_text_and_is_pushed_down(engines):
    _, indexed = engines
    plan = P.found(indexed.index, parse("than")).groupBy("place_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(word,than)" in plan and "text" not in plan.split("ReadSchema")[1]


def test_results_and_snippets(engines):
    scan, indexed = engines
    a, b = scan.aggregate("of the", "year"), indexed.aggregate("of the", "year")
    for name in ("summary", "series", "cube", "titles"):
        assert sorted(map(str, a[name].collect())) == sorted(map(str, b[name].collect()))
    assert [(r["doc_id"], r["snippets"]) for r in scan.hits("than", 5).collect()] == [(r["doc_id"], r["snippets"]) for r in indexed.hits("than", 5).collect()]
    scan.release()
    indexed.release()
    assert not scan.kept


def test_gaps_and_empty_pages(spark):
    pages = spark.createDataFrame([(1, " a _ b a ", 1850), (2, "  ", 1850), (3, " a b ", 1850), (4, None, 1850)], "doc_id long, words string, decade int")
    index = P.postings(pages)
    assert sorted((r["doc_id"], r["word"], r["places"]) for r in index.collect()) == [(1, "a", [0, 3]), (1, "b", [2]), (3, "a", [0]), (3, "b", [1])]
    assert [r["doc_id"] for r in P.found(index, parse('"a b"')).collect()] == [3]
    assert index.where(F.lit(False)).count() == 0
