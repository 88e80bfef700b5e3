"""Windows over cubes and event rows: prefix sums, trailing windows, quantile buckets, class breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dense(cube: DataFrame, buckets: int, key: str = "place_id", value: str = "hits") -> DataFrame:
    """Every bucket of every key, zeros included; the spine is generated per key, without a cross join."""
    per = cube.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", value))).alias("m"))  # one key's buckets
    return per.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0).cast("long")))).alias("bucket", value))


def prefix_sums(cube: DataFrame, key: str = "place_id", value: str = "hits") -> DataFrame:
    return cube.withColumn("cumulative", F.sum(value).over(W.partitionBy(key).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)))


def trailing(cube: DataFrame, width: int, key: str = "place_id", value: str = "hits") -> DataFrame:
    """Sums of the last ``width`` buckets; a range over bucket numbers, so gaps need no spine."""
    return cube.withColumn("window", F.sum(value).over(W.partitionBy(key).orderBy("bucket").rangeBetween(-(width - 1), 0)))


def quantile_bucket(cube: DataFrame, q: float, key: str = "place_id", value: str = "hits") -> DataFrame:
    """The first bucket by which a share ``q`` of a key's hits was reached."""
    w = W.partitionBy(key)
    c = cube.withColumn("c", F.sum(value).over(w.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))).withColumn("t", F.sum(value).over(w))
    return c.where(F.col("c") >= q * F.col("t")).groupBy(key).agg(F.min("bucket").alias("bucket"))


def breaks(rows: DataFrame, rate: str, parts: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """Class breaks over positive rates."""
    return rows.where(F.col(rate) > 0).agg(*(F.percentile(rate, F.lit(p)).alias(f"p{round(p * 100)}") for p in parts))


def share(value: str, *keys: str) -> Column:
    return F.col(value) / F.sum(value).over(W.partitionBy(*keys))


#: Ranges are RANGES times RANGES; their cuts come from SAMPLED rows for each.
RANGES, SAMPLED = 16, 16


def in_ranges(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``part``, the number of a range of the order (numbers or strings, rising).

    The cuts are taken from the rows with the least hashes, a few thousand at most; they only decide where ranges begin, so every
    row keeps its place. Rows are equal in all of ``order`` only within one range.
    """
    keys = [c.alias(f"k{i}") for i, c in enumerate(order)]
    some = rows.select(*keys).orderBy(F.xxhash64(*(f"k{i}" for i in range(len(keys))))).limit(RANGES * RANGES * SAMPLED)
    cuts = sorted({tuple(r) for r in some.collect()})
    cuts = cuts[:: max(1, len(cuts) // (RANGES * RANGES))][1:]
    if not cuts:
        return rows.withColumn("part", F.lit(0))
    key = F.struct(*keys)
    literal = lambda c: F.struct(*(F.lit(v).alias(f"k{i}") for i, v in enumerate(c)))
    blocks = [cuts[i : i + RANGES] for i in range(0, len(cuts), RANGES)]
    below = lambda a: F.size(F.filter(a, lambda c: c <= key))
    block = below(F.array(*(literal(b[0]) for b in blocks[1:]))) if len(blocks) > 1 else F.lit(0)
    placed = rows.withColumn("part", block)
    return placed.withColumn("part", F.col("part") * (RANGES + 1) + below(F.get(F.array(*(F.array(*map(literal, b)) for b in blocks)), F.col("part"))))


def before(parts: DataFrame, weight: Column) -> tuple[Column, int]:
    """For each row the sum of the ranges before its own, and the sum of all; a few hundred sums are gathered."""
    sums = {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.sum(weight).alias("n")).collect()}
    known, total = [], 0
    for i in range(max(sums, default=0) + 1):
        known.append(total)
        total += sums.get(i, 0)
    return F.get(F.array(*(F.lit(x).cast("long") for x in known)), F.col("part")), total


def numbered(rows: DataFrame, *order: Column) -> tuple[DataFrame, int]:
    """``rows`` with their number ``rn`` (from 1) in the order, sorted range by range and never in one task; and how many there are."""
    parts = in_ranges(rows, *order)
    base, n = before(parts, F.lit(1))
    return parts.withColumn("rn", base + F.row_number().over(W.partitionBy("part").orderBy(*order))).drop("part"), n


def tiled(rows: DataFrame, tiles: int, column: str, *order: Column) -> DataFrame:
    """What ntile gives over the whole table: the first tiles have one row more where they do not come out even."""
    ranked, n = numbered(rows, *order)
    small, large = divmod(n, tiles)
    rest = F.col("rn") - large * (small + 1)
    tile = F.when(rest <= 0, F.ceil(F.col("rn") / (small + 1))).otherwise(large + F.ceil(rest / max(small, 1)))
    return ranked.withColumn(column, tile.cast("int")).drop("rn")
