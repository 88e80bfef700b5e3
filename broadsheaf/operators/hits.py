"""Page lists: orders, offsets, keyset pages, and text only for the pages shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_OFFSET = 10_000


def ordered(hits: DataFrame, k: int, newest: bool = False, offset: int = 0) -> DataFrame:
    if offset > MAX_OFFSET:
        raise ValueError(f"offset over {MAX_OFFSET}; page on with after()")
    way = [F.desc(c) if newest else F.asc(c) for c in ("day", "sort_key", "doc_id")]
    return hits.orderBy(*way).offset(offset).limit(k) if offset else hits.orderBy(*way).limit(k)


def after(day: int, sort_key: int, newest: bool = False) -> Column:
    """Pages behind a page in the order by day and sort key."""
    d, s = F.col("day"), F.col("sort_key")
    return (d < day) | ((d == day) & (s < sort_key)) if newest else (d > day) | ((d == day) & (s > sort_key))


def by_relevance(hits: DataFrame, mentions: Column, k: int) -> DataFrame:
    """Most mentions first, then oldest."""
    return hits.withColumn("score", mentions).orderBy(F.desc("score"), "day", "sort_key", "doc_id").limit(k)


def mentions(words: Column, word: str) -> Column:
    """How often a word is on a page."""
    return F.size(F.filter(F.split(words, " "), lambda t: t == word)).cast("long")
