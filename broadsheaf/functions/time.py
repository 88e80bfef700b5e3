"""Whole-number time: days since 1700-01-01, months, decades and bucket arithmetic."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORIGIN = date(1700, 1, 1)
FIRST_DECADE = 1820
UNITS = ("day", "week", "month", "year")


def day_number(d: Column) -> Column:
    return F.datediff(d, F.lit(ORIGIN.isoformat()).cast("date"))


def date_of_day(n: Column) -> Column:
    return F.date_add(F.lit(ORIGIN.isoformat()).cast("date"), n.cast("int"))


def ym_number(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d) - 1


def date_of_ym(n: Column) -> Column:
    return F.make_date(F.floor(n / 12).cast("int"), (F.pmod(n, F.lit(12)) + 1).cast("int"), F.lit(1))


def partition_decade(d: Column) -> Column:
    """The partition decade: early years share the first one."""
    return F.greatest(F.floor(F.year(d) / 10) * 10, F.lit(FIRST_DECADE)).cast("int")


@dataclass(frozen=True)
class Buckets:
    """Buckets of a range: years and months of the calendar, weeks of seven days from the range's first day, days."""

    unit: str
    start: date
    end: date

    @classmethod
    def auto(cls, start: date, end: date) -> Buckets:
        months = (end.year - start.year) * 12 + end.month - start.month
        return cls("year" if months > 360 else "month" if months > 36 else "week" if months > 4 else "day", start, end)

    def key(self, d: date) -> int:
        if self.unit == "year":
            return d.year
        if self.unit == "month":
            return d.year * 12 + d.month - 1
        return (d - self.start).days // (7 if self.unit == "week" else 1)

    def index(self, d: Column) -> Column:
        """Place of a date's bucket, from 0."""
        if self.unit == "year":
            return (F.year(d) - self.start.year).cast("int")
        if self.unit == "month":
            return (ym_number(d) - self.key(self.start)).cast("int")
        days = F.datediff(d, F.lit(self.start.isoformat()).cast("date"))
        return F.floor(days / (7 if self.unit == "week" else 1)).cast("int")

    def first_date(self, index: Column) -> Column:
        start = F.lit(self.start.isoformat()).cast("date")
        if self.unit == "year":
            return F.make_date((index + self.start.year).cast("int"), F.lit(1), F.lit(1))
        if self.unit == "month":
            return date_of_ym(index + self.key(self.start))
        return F.date_add(start, (index * (7 if self.unit == "week" else 1)).cast("int"))

    def __len__(self) -> int:
        return self.key(self.end) - self.key(self.start) + 1

    def coarser(self, places: int, cells: int) -> Buckets:
        """The finest unit from this one up whose cube of so many places fits; an error if years do not."""
        at = self
        while len(at) * places > cells:
            if at.unit == "year":
                raise ValueError(f"{len(at)} buckets for {places} places are more than {cells} cells")
            at = Buckets(UNITS[UNITS.index(at.unit) + 1], self.start, self.end)
        return at

    def spine(self, spark: SparkSession) -> DataFrame:
        return spark.range(len(self)).select(F.col("id").cast("int").alias("bucket"))


def _field(text: str, low: int, high: int) -> set[int]:
    """The values that a field of a schedule names: ``*``, numbers, ranges and lists, each with a step."""
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        a, _, b = span.partition("-")
        first, last = (low, high) if span == "*" else (int(a), int(b or (high if step else a)))
        if not (low <= first <= last <= high) or int(step or 1) < 1:
            raise ValueError(f"{part} is not within {low} to {high}")
        out.update(range(first, last + 1, int(step or 1)))
    return out


def next_run(schedule: str, after: datetime) -> datetime | None:
    """The first whole minute after ``after`` at which a schedule (minute, hour, day, month, weekday) runs; None if none within
    four years. Where both days are named either is enough; weekday 7 is Sunday as 0 is."""
    minute, hour, day, month, weekday = schedule.split()
    minutes, hours, days, months = _field(minute, 0, 59), _field(hour, 0, 23), _field(day, 1, 31), _field(month, 1, 12)
    weekdays = {d % 7 for d in _field(weekday, 0, 7)}
    times = [(h, m) for h in sorted(hours) for m in sorted(minutes)]
    start = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
    for n in range(4 * 366 + 1):
        d = start.date() + timedelta(days=n)
        by = (d.day in days, d.isoweekday() % 7 in weekdays)
        if d.month not in months or not (any(by) if day != "*" and weekday != "*" else all(by)):
            continue
        for h, m in times:
            if n or (h, m) >= (start.hour, start.minute):
                return datetime(d.year, d.month, d.day, h, m, tzinfo=after.tzinfo)
    return None
