"""The search engine over a frame of pages: the operations a client has, as methods that give DataFrames."""

from __future__ import annotations

from datetime import date

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import snippet_udf
from .functions.time import Buckets
from .operators import aggregate as A
from .operators import hits as H
from .operators import postings as P
from .plans.query import matches, parse, words_of

MAX_LIST, MAX_TITLES = 60, 500


class Engine:
    """``pages``: as ``sources.corpus.text_pages`` gives them, or the parts of an index, united. With ``index`` (``operators.postings``)
    searches are answered from the rows of their words, and text is read for the pages shown only."""

    def __init__(self, pages: DataFrame, first: date, last: date, max_cells: int = A.MAX_CELLS, index: DataFrame | None = None):
        self.pages, self.first, self.last, self.max_cells, self.index = pages, first, last, max_cells, index
        self.kept: list[DataFrame] = []

    def scope(self, start: date | None = None, end: date | None = None, **sets: list | bool) -> DataFrame:
        """Pages within a range and with values of given columns; decades are named too, so partitions are pruned."""
        return self._within(self.pages, start, end, **sets)

    def _within(self, rows: DataFrame, start: date | None = None, end: date | None = None, **sets: list | bool) -> DataFrame:
        start, end = max(start or self.first, self.first), min(end or self.last, self.last)
        if start > end:
            raise ValueError("from is after to")
        decades = sorted({max(y // 10 * 10, 1820) for y in range(start.year, end.year + 1)})
        out = rows.where(F.col("decade").isin(decades) & F.col("date").between(F.lit(start.isoformat()).cast("date"), F.lit(end.isoformat()).cast("date")))
        for name, value in sorted(sets.items()):
            if name not in self.pages.columns:
                raise ValueError(f"unknown filter {name}")
            if isinstance(value, bool):
                out = out.where(F.col(name) == value)
            elif len(value) > MAX_LIST:
                raise ValueError(f"more than {MAX_LIST} values of {name}")
            else:
                out = out.where(F.col(name).isin(sorted(value)))
        return out

    def found(self, q: str, mode: str | None = None, **filters) -> DataFrame:
        """Matching pages; from the index, where it can answer, without their text."""
        node = parse(q, mode)
        if self.index is not None and P.answers(node):
            return P.found(self._within(self.index, **filters), node)
        return self.scope(**filters).where(matches(node, F.col("words")))

    def canonical(self, q: str, mode: str | None = None, **filters) -> str:
        """One key for equal searches."""
        parts = [f"{k}={v if isinstance(v, bool | date) else ','.join(sorted(map(str, v)))}" for k, v in sorted(filters.items())]
        return "&".join([f"q={parse(q, mode)}", *parts])

    def buckets(self, unit: str | None, filters: dict) -> Buckets:
        start, end = max(filters.get("start") or self.first, self.first), min(filters.get("end") or self.last, self.last)
        return Buckets(unit, start, end) if unit else Buckets.auto(start, end)

    def aggregate(self, q: str, unit: str | None = None, **filters) -> dict[str, DataFrame]:
        """Totals, series, places, titles, languages in one pass, first and last page, and the cube that fits.

        Text is scanned once: what matches is kept without its text for all results (``release`` frees it; a lost part is
        computed again).
        """
        b = self.buckets(unit, filters)
        hits = self.found(q, **filters).drop("text", "words").persist(StorageLevel.MEMORY_AND_DISK)
        self.kept.append(hits)
        cube, fitted = A.fitted_cube(hits, b, self.max_cells)
        return {"summary": A.summary(hits, fitted), "series": A.series(hits, fitted), "edges": A.edges(hits), "cube": cube, "titles": A.ranked(hits, "lccn", MAX_TITLES)}

    def release(self) -> None:
        """Free the matching pages that results were counted from."""
        while self.kept:
            self.kept.pop().unpersist()

    def hits(self, q: str, k: int = 20, offset: int = 0, newest: bool = False, **filters) -> DataFrame:
        """Pages in order, with snippets made for the pages shown only."""
        node = parse(q)
        top = H.ordered(self.found(q, **filters), k, newest, offset)
        if "text" not in top.columns:  # at most k pages: their decades prune the partitions read for their text
            texts = self.pages.select("doc_id", "decade", "text").join(F.broadcast(top.select("doc_id", "decade")), ["doc_id", "decade"], "left_semi")
            top = H.ordered(top.join(texts.select("doc_id", "text"), "doc_id"), k, newest)
        return top.withColumn("snippets", snippet_udf(words_of(node))("text"))

    def browse(self, after: tuple[int, int] | None = None, k: int = 20, newest: bool = False, **filters) -> DataFrame:
        p = self.scope(**filters)
        return H.ordered(p.where(H.after(*after, newest)) if after else p, k, newest)

    def days(self, q: str, places: list[str], **filters) -> DataFrame:
        if len(places) > 20:
            raise ValueError("at most 20 places")
        return A.days(self.found(q, **filters), places)

    def coverage(self, unit: str | None = None, **filters) -> DataFrame:
        return A.coverage(self.scope(**filters), self.buckets(unit, filters))

    def relative(self, q: str, unit: str | None = None, **filters) -> DataFrame:
        b = self.buckets(unit, filters)
        return A.relative(A.cube(self.found(q, **filters), b), A.coverage(self.scope(**filters), b))

    def titles(self, **filters) -> DataFrame:
        return A.title_dates(self.scope(**filters))

    def places(self, **filters) -> DataFrame:
        return self.scope(**filters).groupBy("place_id", "state").agg(F.count("*").alias("pages"))

    def meta(self) -> DataFrame:
        return self.pages.agg(F.count("*").alias("pages"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_distinct("lccn").alias("titles"), F.count_distinct("place_id").alias("places"))

    def where(self, condition: Column) -> Engine:
        return Engine(self.pages.where(condition), self.first, self.last, self.max_cells, None if self.index is None else self.index.where(condition))
