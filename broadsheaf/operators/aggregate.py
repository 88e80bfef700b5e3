"""Aggregations over matching pages: totals, series, places, titles, languages, cube, first and last page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import Buckets

MAX_CELLS = 700_000


def total(hits: DataFrame) -> DataFrame:
    """One row: hits, first and last day, and how many days have a hit (exactly)."""
    return hits.agg(F.count("*").alias("hits"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_distinct("day").alias("days"))


def summary(hits: DataFrame, buckets: Buckets, languages: str = "lang") -> DataFrame:
    """All counts of a search in one pass over the matching pages, by grouping sets.

    One row per kind and key: total, series (bucket), places, titles, languages; with first and last day.
    """
    h = hits.select("place_id", "lccn", F.col(languages).alias("language"), "date", buckets.index(F.col("date")).alias("bucket"))
    sets = h.groupingSets([["place_id"], ["lccn"], ["language"], ["bucket"], []], "place_id", "lccn", "language", "bucket")
    g = sets.agg(F.grouping_id("place_id", "lccn", "language", "bucket").alias("g"), F.count("*").alias("hits"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    kind = F.when(F.col("g") == 7, "place").when(F.col("g") == 11, "title").when(F.col("g") == 13, "language").when(F.col("g") == 14, "series").otherwise("total")
    return g.select(kind.alias("kind"), F.coalesce("place_id", "lccn", "language", F.col("bucket").cast("string"), F.lit("")).alias("key"), "hits", "first_date", "last_date")


def series(hits: DataFrame, buckets: Buckets) -> DataFrame:
    """Hits of every bucket, zeros included."""
    counted = hits.select(buckets.index(F.col("date")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("hits"))
    spine = buckets.spine(hits.sparkSession)
    return spine.join(counted, "bucket", "left").select("bucket", buckets.first_date(F.col("bucket")).alias("start"), F.coalesce("hits", F.lit(0).cast("long")).alias("hits"))


def cube(hits: DataFrame, buckets: Buckets, place: str = "place_id") -> DataFrame:
    """Sparse counts by place and bucket."""
    return hits.select(F.col(place), buckets.index(F.col("date")).alias("bucket")).groupBy(place, "bucket").agg(F.count("*").alias("hits"))


def cube_with_totals(hits: DataFrame, buckets: Buckets) -> DataFrame:
    """The cube with its margins, in one aggregation; ``level`` tells them apart."""
    h = hits.select("place_id", buckets.index(F.col("date")).alias("bucket"))
    g = h.groupingSets([["place_id", "bucket"], ["place_id"], ["bucket"], []], "place_id", "bucket").agg(F.grouping_id("place_id", "bucket").alias("g"), F.count("*").alias("hits"))
    level = F.when(F.col("g") == 0, "cell").when(F.col("g") == 1, "place").when(F.col("g") == 2, "bucket").otherwise("total")
    return g.select(level.alias("level"), "place_id", "bucket", "hits")


def fitted_cube(hits: DataFrame, buckets: Buckets, max_cells: int = MAX_CELLS) -> tuple[DataFrame, Buckets]:
    """The cube in the finest unit that keeps places times buckets within the budget."""
    places = hits.agg(F.count_distinct("place_id")).first()[0]
    fitted = buckets.coarser(max(places, 1), max_cells)
    return cube(hits, fitted), fitted


def merge_cells(*cubes: DataFrame) -> DataFrame:
    """One cube from several: cells summed up, as three arrays in order of place and bucket."""
    both = cubes[0]
    for c in cubes[1:]:
        both = both.unionByName(c)
    summed = both.groupBy("place_id", "bucket").agg(F.sum("hits").alias("hits"))
    per = summed.groupBy("place_id").agg(F.array_sort(F.collect_list(F.struct("bucket", "hits"))).alias("cells"))  # a place's buckets
    return per.select("place_id", F.col("cells.bucket").alias("b"), F.col("cells.hits").alias("h"))


def days(hits: DataFrame, places: list[str]) -> DataFrame:
    """Hits by place and day for a few places; only days with a hit."""
    return hits.where(F.col("place_id").isin(places)).groupBy("place_id", "day").agg(F.count("*").alias("hits"))


def ranked(hits: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Counts by key, most first, ties by key."""
    g = hits.groupBy(key).agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), key)
    return g.limit(limit) if limit else g


def by_language(hits: DataFrame, array_col: str) -> DataFrame:
    """A page counts once for every language it has."""
    return hits.select(F.explode(F.array_distinct(array_col)).alias("language")).groupBy("language").agg(F.count("*").alias("hits"))


def edges(hits: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The first and the last matching page by day and sort key, in the aggregation itself."""
    row, order = F.struct("date", *columns), F.struct("day", "sort_key")
    g = hits.agg(F.min_by(row, order).alias("first"), F.max_by(row, order).alias("last"))
    return g.select(*(F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in ("first", "last") for c in ("date", *columns)))


def coverage(pages: DataFrame, buckets: Buckets) -> DataFrame:
    """Pages published by place and bucket: the denominator."""
    return cube(pages, buckets).withColumnRenamed("hits", "pages")


def rate(hits: Column, pages: Column) -> Column:
    """Hits over pages; 0 for none of either, NaN for hits where no page is known."""
    return F.when(pages > 0, hits / pages).when(hits > 0, F.lit(float("nan"))).otherwise(F.lit(0.0))


def relative(hit_cube: DataFrame, page_cube: DataFrame) -> DataFrame:
    """Hits, pages and their rate by place and bucket, aligned to places with coverage or hits."""
    j = hit_cube.join(page_cube, ["place_id", "bucket"], "full_outer")
    h, p = F.coalesce("hits", F.lit(0).cast("long")), F.coalesce("pages", F.lit(0).cast("long"))
    return j.select("place_id", "bucket", h.alias("hits"), p.alias("pages"), rate(h, p).alias("rate"))


def title_dates(pages: DataFrame) -> DataFrame:
    return pages.groupBy("lccn").agg(F.count("*").alias("pages"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
