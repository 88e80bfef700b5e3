"""Text-quality analytics over the page summary: bands, quantiles, cross-tabs, rankings and stratified selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import windows as V

#: Cuts of the damage rate.
DAMAGED, BADLY_DAMAGED = 0.1, 0.25


def band(rate: Column, names: tuple[str, ...] = ("1 fine", "2 moderate", "3 bad"), cuts: tuple[float, ...] = (DAMAGED, BADLY_DAMAGED)) -> Column:
    """The name of the first band whose cut is not exceeded; null rates have none."""
    out = F.lit(names[-1])
    for cut, name in reversed(tuple(zip(cuts, names))):
        out = F.when(rate <= cut, name).otherwise(out)
    return F.when(rate.isNotNull(), out)


def placed() -> Column:
    return (F.col("matched") >= 0.5) & F.col("local_cer").isNotNull()


def agreement_class() -> Column:
    cer = F.col("local_cer")
    return F.when(F.col("dice").isNull(), "0 no pair").when(~F.coalesce(placed(), F.lit(False)), "1 under half placed").when(cer <= 0.1, "2 up to 0.1").when(cer <= 0.2, "3 up to 0.2").otherwise("4 above 0.2")


def loc_badness() -> Column:
    """The best signal a page has: the estimate, half the disagreement where half is placed, damage with doubt."""
    doubt = F.coalesce(1 - F.col("wc_mean"), F.col("damage_rate"))
    return F.coalesce(F.col("est_cer"), F.when(F.col("matched") >= 0.5, F.col("local_cer") / 2), (F.col("damage_rate") + doubt) / 2)


def latest_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in this order."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def round_robin(df: DataFrame, group: list[str], inner: list[str], stratum: list[str], *order: Column) -> DataFrame:
    """Ranks within an issue, a stratum and the group, so that each takes turns: issue_rank, stratum_rank, group_rank."""
    df = df.withColumn("issue_rank", F.row_number().over(W.partitionBy(*group, *inner).orderBy(*order)))
    df = df.withColumn("stratum_rank", F.row_number().over(W.partitionBy(*group, *stratum).orderBy("issue_rank", *order)))
    return df.withColumn("group_rank", F.row_number().over(W.partitionBy(*group).orderBy("stratum_rank", *order)))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation. Ranks come from counts by distinct value, put in order range by range."""
    def ranks(c: str) -> DataFrame:
        parts = V.in_ranges(df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")), F.col(c))
        inside = F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy(c).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        return parts.select(F.col(c), (V.before(parts, F.col("n"))[0] + inside + (F.col("n") + 1) / 2.0).alias(f"__{c}"))

    j = df.join(ranks(a), a).join(ranks(b), b)
    return j.agg(F.count("*").alias("pages"), F.corr(f"__{a}", f"__{b}").alias("rho"))


def proportional(sizes: DataFrame, n: int, floor: int) -> DataFrame:
    """Pages each stratum gives: its share of n rounded up, at least the floor, at most its size (column ``pages``)."""
    total = sizes.agg(F.sum("pages").alias("all"))
    return sizes.crossJoin(F.broadcast(total)).withColumn("take", F.least("pages", F.greatest(F.lit(floor), F.ceil(n * F.col("pages") / F.col("all")))).cast("long")).drop("all")


def seeded(seed: str, id_col: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string")).cast("binary"))


def draw(pool: DataFrame, strata: list[str], n: int, floor: int, seed: str, id_col: str = "doc_id") -> DataFrame:
    """A stratified sample in a repeatable order: the lowest seeded hashes of each stratum."""
    sizes = proportional(pool.groupBy(*strata).agg(F.count("*").alias("pages")), n, floor)
    ranked = pool.withColumn("k", F.row_number().over(W.partitionBy(*strata).orderBy(seeded(seed, id_col), id_col)))
    return ranked.join(sizes, strata).where("k <= take")
