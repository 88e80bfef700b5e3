"""Campaign selection: cells, seeded draws, weights, tiers, gains and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Z95 = 1.96


def damage_band(rate: Column, occurrences: Column, worst: float = 0.25, moderate: float = 0.1, least: int = 50) -> Column:
    """worst, moderate or none; rates are compared as single-precision numbers."""
    r = rate.cast("float")
    return F.when((occurrences >= least) & (r > F.lit(worst).cast("float")), "worst").when((occurrences >= least) & (r > F.lit(moderate).cast("float")), "moderate")


def allocate(sizes: DataFrame, cell: list[str], title: str, cell_pages: int, seed: str) -> DataFrame:
    """Pages each title of a cell gives (``take``), titles in seeded hash order.

    Up to ``cell_pages`` titles: one page each in turns until the cell is full or empty. More titles than pages: equal
    steps along the cumulative pages, from a seeded start.
    """
    order = F.sha2(F.concat(F.lit(seed), F.col(title).cast("string")), 256)
    w = W.partitionBy(*cell)
    s = sizes.withColumn("h", order).withColumn("titles", F.count("*").over(w)).withColumn("all", F.sum("pages").over(w)).withColumn("place", F.row_number().over(w.orderBy("h", title)))
    few = s.where(F.col("titles") <= cell_pages)
    # a turn ends where all titles with a page left have given one: every page of a title has a turn
    turns = few.withColumn("turn", F.explode(F.sequence(F.lit(1), F.least("pages", F.lit(cell_pages)).cast("int"))))
    dealt = turns.withColumn("n", F.row_number().over(w.orderBy("turn", "place"))).where(F.col("n") <= cell_pages)
    few_take = dealt.groupBy(*cell, title).agg(F.count("*").alias("take"))
    many = s.where(F.col("titles") > cell_pages)
    top = F.sum("pages").over(w.orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    step = F.col("all") / F.lit(cell_pages)
    start = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), *cell), 256), 1, 8), 16, 10).cast("long"), F.lit(1000)) / F.lit(1000.0) * step
    picks = lambda x: F.greatest(F.ceil((x - start) / step), F.lit(0))  # noqa: E731  how many picks lie below x
    many_take = many.withColumn("top", top).withColumn("take", (picks(F.col("top")) - picks(F.col("top") - F.col("pages"))).cast("long")).where("take > 0").select(*cell, title, "take")
    return few_take.unionByName(many_take)


def draw(pages: DataFrame, takes: DataFrame, strata: list[str], seed: str, id_col: str = "doc_id") -> DataFrame:
    """The ``take`` pages of each stratum with the lowest seeded hashes."""
    h = F.sha2(F.concat(F.lit(seed), F.lit("ocr"), F.col(id_col).cast("string")), 256)
    p = pages.withColumn("h", h).withColumn("k", F.row_number().over(W.partitionBy(*strata).orderBy("h", id_col)))
    return p.join(takes, strata).where("k <= take").drop("h")


def weights(picked: DataFrame, sizes: DataFrame, cell: list[str], title: str, cell_pages: int) -> DataFrame:
    """Inverse chances: of the whole cell where every page had the same chance, else of the stratum."""
    c = sizes.groupBy(*cell).agg(F.sum("pages").alias("cell_size"), F.count("*").alias("titles"))
    j = picked.join(c, cell).join(sizes.withColumnRenamed("pages", "stratum"), [*cell, title])
    return j.withColumn("weight", F.when(F.col("titles") > cell_pages, F.col("cell_size") / F.lit(cell_pages)).otherwise(F.col("stratum") / F.col("take")))


def worst_first(rows: DataFrame, width: float, batch: list[str]) -> DataFrame:
    """Tiers of damage; in a tier batches by mean damage, most first, then issue order."""
    t = rows.withColumn("tier", F.floor((1 - F.col("damage_rate")) / width).cast("int"))
    return t.withColumn("batch_mean", F.avg("damage_rate").over(W.partitionBy("tier", *batch)))


def cell_gain(pairs: DataFrame, cell: list[str], gain: str = "gain", least: int = 30, cell_pages: int = 200, min_gain: float = 0.02) -> DataFrame:
    """Per cell the mean gain with its interval, and the decision."""
    g = pairs.groupBy(*cell).agg(F.count(gain).alias("n"), F.avg(gain).alias("mean"), F.stddev_samp(gain).alias("sd"))
    half = Z95 * F.col("sd") / F.sqrt("n")
    decision = F.when((F.col("n") >= least) & (F.col("mean") + half < min_gain), "stop").when((F.col("n") >= least) & (F.col("mean") - half >= min_gain), "go")
    return g.withColumn("half", half).withColumn("decision", decision.when(F.col("n") >= cell_pages, F.when(F.col("mean") >= min_gain, "go").otherwise("stop")).otherwise("measuring"))


def by_decile(pairs: DataFrame, starts: DataFrame, value: str, id_col: str) -> DataFrame:
    """Each pair with the last bucket that begins at or before it; ``starts``: a few rows of tenth, value, id."""
    s = F.broadcast(starts.select(F.col("tenth"), F.col(value).alias("__v"), F.col(id_col).alias("__i")))
    on = (F.col("__v") > F.col(value)) | ((F.col("__v") == F.col(value)) & (F.col("__i") <= F.col(id_col)))
    return pairs.join(s, on).groupBy(*pairs.columns).agg(F.max("tenth").alias("tenth"))


def decide_wave(queued: int, published: float, gain: float | None, passed: float, low_water: int = 500, least_published: float = 0.9, least_gain: float = 0.02, least_pass: float = 0.8) -> str:
    """What the worst-first loop does next."""
    if queued > low_water:
        return "idle"
    if published < least_published:
        return "enqueue"
    return "stop" if gain is None or gain < least_gain or passed < least_pass else "next_wave"
