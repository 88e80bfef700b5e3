"""An index of words beside the pages: searches answered from the rows of their words, without reading text.

One row per page and word, with the page's dimensions and the word's places. Written in ranges of word and decade and sorted by them,
so the minimum and maximum of each row group keep all but a small part of the files from being read for a rare word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import GAP
from ..plans.query import FRACTIONS, And, Not, Or, Phrase, Term, spellings

TEXT = ("text", "words")


def postings(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """word, places (from 0, in order) and the dimensions of each page that has it; gaps have places but no rows."""
    dims = [c for c in pages.columns if c not in TEXT]
    spots = pages.select(*dims, F.posexplode(F.filter(F.split("words", " "), lambda w: w != "")).alias("at", "word")).where(F.col("word") != GAP)
    rest = [c for c in dims if c != key]
    return spots.groupBy(key, "word").agg(F.sort_array(F.collect_list("at")).alias("places"), *(F.first(c).alias(c) for c in rest))


def write(index: DataFrame, path: str) -> None:
    dealt = index.repartitionByRange("word", "decade").sortWithinPartitions("word", "decade")
    dealt.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def answers(node) -> bool:
    """Whether the index alone can answer: all but NEAR, and no search that only excludes."""
    if isinstance(node, Term):
        return True
    if isinstance(node, Phrase):
        return not node.slop and not any(f in t for t in node.terms for f in FRACTIONS)
    if isinstance(node, Not):
        return False
    if isinstance(node, And):
        yes = [x for x in node.of if not isinstance(x, Not)]
        return bool(yes) and all(map(answers, yes)) and all(answers(x.of) for x in node.of if isinstance(x, Not))
    return all(map(answers, node.of))


def _word(term: Term) -> Column:
    word = F.col("word")
    if term.wild:
        lead = term.text[: min(term.text.index(c) for c in "*?" if c in term.text)]
        shape = term.text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
        return word.startswith(lead) & word.like(shape)
    if term.fuzzy:
        return F.levenshtein(word, F.lit(term.text), term.fuzzy).between(0, term.fuzzy)
    if term.ocr:
        return word.isin(sorted(spellings(term.text)))
    return word == term.text


def found(index: DataFrame, node, key: str = "doc_id") -> DataFrame:
    """Dimensions of the pages that match, one row each; ``node`` as ``answers`` allows."""
    dims = [c for c in index.columns if c not in ("word", "places")]
    if isinstance(node, Term):
        rows = index.where(_word(node)).select(dims)
        return rows if not (node.wild or node.fuzzy or node.ocr) else rows.dropDuplicates([key])
    if isinstance(node, Phrase):
        out = index.where(F.col("word") == node.terms[0]).withColumn("ends", F.col("places"))
        for t in node.terms[1:]:  # the places where the phrase so far may go on
            here = index.where(F.col("word") == t).select(key, F.col("places").alias("here"))
            out = out.join(here, key).withColumn("ends", F.array_intersect(F.transform("ends", lambda x: x + 1), "here")).drop("here").where(F.size("ends") > 0)
        return out.select(dims)
    if isinstance(node, And):
        yes = [found(index, x, key) for x in node.of if not isinstance(x, Not)]
        out = reduce(lambda a, b: a.join(b.select(key), key, "left_semi"), yes)
        return reduce(lambda a, x: a.join(found(index, x.of, key).select(key), key, "left_anti"), [x for x in node.of if isinstance(x, Not)], out)
    every = reduce(DataFrame.unionByName, [found(index, x, key) for x in node.of])
    if isinstance(node, Or):
        return every.dropDuplicates([key])
    counted = every.groupBy(key).agg(F.count("*").alias("n_"), *(F.first(c).alias(c) for c in dims if c != key))
    return counted.where(F.col("n_") >= node.min).select(dims)
