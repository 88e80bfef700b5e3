"""Audits of a corpus and of readers: gaps, bands, trimmed draws, retrieval and bootstrap measures, catalogue checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.distance import error_rate, iou, match_boxes


def banded(value: Column, edges: tuple[float, ...], names: tuple[str, ...]) -> Column:
    """The name of the first edge above a value, the last name beyond all; null stays null."""
    out = F.when(value.isNotNull(), names[-1])
    for edge, name in reversed(list(zip(edges, names))):
        out = F.when(value < edge, name).otherwise(out)
    return out


def latin_share(text: Column) -> Column:
    """Latin letters over all letters; null without a letter."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(text, "[^A-Za-z]", "")) / letters)


def holdings(titles: DataFrame, theirs: DataFrame, ours: DataFrame, key: str = "lccn") -> DataFrame:
    """Another library's titles by who holds them: ours, theirs_only or unknown."""
    mark = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    j = titles.join(mark(theirs, "theirs"), key, "left").join(mark(ours, "ours"), key, "left")
    return j.withColumn("bucket", F.when(F.col("ours"), "ours").when(F.col("theirs"), "theirs_only").otherwise("unknown")).drop("theirs", "ours")


def missing(images: DataFrame, texts: DataFrame, key: list[str]) -> DataFrame:
    """Pages with an image and no text."""
    return images.join(texts.select(*key).distinct(), key, "left_anti")


def trimmed(draw: DataFrame, strata: list[str], n: int, k: str = "k") -> DataFrame:
    """A draw cut to ``n`` pages, always from the stratum with most pages left (of equals the last), with a place that keeps
    every prefix in proportion.

    The pages that remain are the first ``n`` by their place ``k`` in their stratum and the stratum.
    """
    kept = draw.orderBy(k, *strata).limit(n)
    return kept.withColumn("kept", F.count("*").over(W.partitionBy(*strata))).withColumn("place", (F.col(k) - 0.5) / F.col("kept"))


def retrieval(scores: DataFrame, relevance: DataFrame, k: int, query: str = "item_id", doc: str = "doc_id") -> DataFrame:
    """Recall and nDCG at ``k`` and the reciprocal rank of the first relevant page, by query with a relevant page.

    ``scores``: query, doc, s; ``relevance``: query, doc, grade. Ties go to the smaller id. The first relevant page's rank is
    counted, so no full ranking is sorted.
    """
    top = scores.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(F.desc("s"), doc))).where(F.col("rank") <= k).select(query, doc, "rank")
    positive = relevance.where("grade > 0")
    gain = lambda rank: (F.pow(F.lit(2.0), "grade") - 1) / F.log2(rank + 1)
    ideal = positive.withColumn("r", F.row_number().over(W.partitionBy(query).orderBy(F.desc("grade")))).where(F.col("r") <= k).groupBy(query).agg(F.sum(gain(F.col("r"))).alias("idcg"))
    held = positive.join(top, [query, doc], "left").groupBy(query).agg((F.count("rank") / F.count("*")).alias("recall"), F.coalesce(F.sum(F.when(F.col("rank").isNotNull(), gain(F.col("rank")))), F.lit(0.0)).alias("dcg"))
    best = scores.join(positive.select(query, doc), [query, doc]).groupBy(query).agg(F.max(F.struct("s", (-F.col(doc)).alias("d"))).alias("best"))
    first = scores.join(best, query).where(F.struct("s", (-F.col(doc)).alias("d")) >= F.col("best")).groupBy(query).agg(F.count("*").alias("first"))
    j = held.join(ideal, query).join(first, query, "left")
    return j.select(query, "recall", F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), (F.col("dcg") / F.col("idcg")).alias("ndcg"))


def bootstrap(clusters: DataFrame, value: str, key: str, draws: int, seed: str) -> DataFrame:
    """Mean of a value over clusters with a 95 % percentile interval from ``draws`` seeded resamples of the clusters.

    ``clusters`` has one row each; the cluster of each slot of a resample is a hash of seed, draw and slot.
    """
    spark = clusters.sparkSession
    c = clusters.where(F.col(value).isNotNull()).select(F.row_number().over(W.orderBy(key)).alias("i"), F.col(value).alias("v"))  # one row a cluster
    size = c.agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    slots = spark.range(draws).select(F.col("id").alias("draw")).crossJoin(F.broadcast(size)).where("n > 0").withColumn("slot", F.explode(F.sequence(F.lit(1).cast("long"), "n")))  # one row of totals
    digest = F.sha2(F.concat_ws("|", F.lit(seed), F.col("draw").cast("string"), F.col("slot").cast("string")), 256)
    picked = slots.withColumn("i", (F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.col("n")) + 1).cast("int"))
    means = picked.join(c, "i").groupBy("draw").agg(F.avg("v").alias("m"))
    low, high = int(0.025 * (draws - 1)) + 1, int(0.975 * (draws - 1)) + 1
    edges = means.agg(F.sort_array(F.collect_list("m")).alias("m"))  # one number a draw
    return size.crossJoin(F.broadcast(edges)).select("n", "mean", F.get("m", F.lit(low - 1)).alias("low"), F.get("m", F.lit(high - 1)).alias("high"))


def histogram(rows: DataFrame, rate: str, by: list[str], bins: int = 100) -> DataFrame:
    """Counts by bin of a rate from 0 to 1 (1 in the last bin); partial sums of parts can be added up."""
    at = F.least(F.floor(F.col(rate) * bins), F.lit(bins - 1)).cast("int")
    return rows.where(F.col(rate).isNotNull()).groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))


def moves(rows: DataFrame, title: str, before: str, after: str) -> DataFrame:
    """Per title a map from what a label was and became to the pages that moved."""
    counted = rows.where(~F.col(before).eqNullSafe(F.col(after))).groupBy(title, F.concat_ws(">", F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))).alias("move")).agg(F.count("*").alias("n"))
    return counted.groupBy(title).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("move", "n")))).alias("moves"))


def findability(wanted: Column, had: Column, common: list[str], least: int = 3) -> tuple[Column, Column]:
    """Distinct content words (no function words, ``least`` letters or more) of one reading, and how many of them another has."""
    want = F.filter(F.array_distinct(F.array_except(wanted, F.array(*map(F.lit, common)))), lambda w: F.length(w) >= least)
    return F.size(want), F.size(F.array_intersect(want, had))


def tag(value: Column) -> dict[str, Column]:
    """The parts of an engine tag: family/version, then profile= and image=; null where a part is not told."""
    part = lambda pattern: F.nullif(F.regexp_extract(value, pattern, 1), F.lit(""))
    return {"family": part(r"^([^/\s]+)/\S+"), "version": part(r"^[^/\s]+/(\S+)"), "profile": part(r"(?:^|\s)profile=(\S+)"), "image": part(r"(?:^|\s)image=(\S+)")}


def checks(titles: DataFrame, places: DataFrame, title_key: str, place_key: str) -> DataFrame:
    """What must be empty in a catalogue: repeated titles and places, titles without a known place."""
    again = lambda df, key, name: df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    lost = titles.join(places.select(place_key).distinct(), place_key, "left_anti").agg(F.count("*").alias("n")).select(F.lit("unknown_place").alias("check"), "n")
    return again(titles, title_key, "repeated_title").unionByName(again(places, place_key, "repeated_place")).unionByName(lost)


def holds(rows: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """One hold for each key, empty where a part is not given: the newest."""
    named = rows.select(*[c for c in rows.columns if c not in keys], *(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys))
    rest = [c for c in named.columns if c not in keys]
    return named.groupBy(*keys).agg(F.max(F.struct(newest, *(c for c in rest if c != newest))).alias("x")).select(*keys, "x.*")


def reader_report(sample: DataFrame, readings: DataFrame, page: str, reader: str, measure: str) -> DataFrame:
    """Per reader the pages of a sample it read, those it misses, and the mean and median of a measure."""
    readers = readings.select(reader).distinct()
    want = sample.agg(F.count_distinct(page).alias("sampled"))
    got = readings.join(sample.select(page).distinct(), page, "left_semi").groupBy(reader).agg(F.count_distinct(page).alias("pages"), F.avg(measure).alias("mean"), F.median(measure).alias("median"))
    j = readers.join(got, reader, "left").crossJoin(F.broadcast(want))  # one row of totals
    zero = F.lit(0).cast("long")
    return j.select(reader, F.coalesce("pages", zero).alias("pages"), (F.col("sampled") - F.coalesce("pages", zero)).alias("missing"), "mean", "median")


def year_recall(pages: DataFrame, terms: list[str], ours: str, theirs: str, year: str = "year") -> DataFrame:
    """Per year and word the pages that have it in our reading, in another's, in either, only in the other's, and that as a share of ours.

    Both readings are columns of folded words between blanks; every word is counted in one pass.
    """
    has = lambda c, w: F.coalesce(F.col(c).contains(f" {w} "), F.lit(False))
    counts = [F.count_if(x).alias(f"{w}|{k}") for w in terms for k, x in (("a", has(ours, w)), ("b", has(theirs, w)), ("e", has(ours, w) | has(theirs, w)), ("o", has(theirs, w) & ~has(ours, w)))]
    told = F.array(*(F.struct(F.lit(w).alias("term"), *(F.col(f"`{w}|{k}`").alias(n) for k, n in (("a", "ours"), ("b", "theirs"), ("e", "either"), ("o", "only_theirs")))) for w in terms))
    rows = pages.groupBy(year).agg(*counts).select(year, F.explode(told).alias("t")).select(year, "t.*")
    return rows.withColumn("gain", F.when(F.col("ours") > 0, F.col("only_theirs") / F.col("ours")))


def year_summary(ours: DataFrame, theirs: DataFrame, key: str, measures: list[str], year: str = "year") -> DataFrame:
    """Per year our pages, those the other collection has too, their share, and of those the median of each measure in both and the
    ratio of its sums. Measures have one name in both."""
    other = theirs.select(key, F.lit(True).alias("shared"), *(F.col(m).alias(f"{m}_theirs") for m in measures))
    j = ours.select(key, year, *(F.col(m).alias(f"{m}_ours") for m in measures)).join(other, key, "left")
    held = lambda c: F.when(F.col("shared"), F.col(c))
    medians = [F.median(held(f"{m}_{side}")).alias(f"{m}_{side}") for m in measures for side in ("ours", "theirs")]
    ratios = [F.try_divide(F.sum(held(f"{m}_theirs")), F.sum(held(f"{m}_ours"))).alias(f"{m}_ratio") for m in measures]
    return j.groupBy(year).agg(F.count("*").alias("pages"), F.count("shared").alias("shared"), (F.count("shared") / F.count("*")).alias("share"), *medians, *ratios)


def write_once(before: DataFrame, after: DataFrame, key: str, released: str) -> DataFrame:
    """Changes a write-once list does not allow: rows that are gone, that were released before and changed, or of which anything but
    the release changed. ``key`` is unique in both."""
    rest = [c for c in before.columns if c not in (key, released)]
    old = before.select(F.col(key), F.lit(True).alias("was"), F.struct(*rest).alias("x"), F.col(released).alias("r"))
    new = after.select(F.col(key), F.lit(True).alias("is"), F.struct(*rest).alias("y"), F.col(released).alias("s"))
    j = old.join(new, key, "left")
    same, kept = F.col("x").eqNullSafe(F.col("y")), F.col("r").eqNullSafe(F.col("s"))
    why = F.when(F.col("is").isNull(), "deleted").when(F.col("r").isNotNull() & ~(same & kept), "already released").when(~same, "changed")
    return j.select(key, why.alias("why")).where("why is not null")


def rewritten_crop(url: Column) -> Column:
    """A picture's address on the server of tiles for one on the older image server; null for any other shape."""
    part, cut = r"[A-Za-z0-9_.-]{1,128}", "%2[Ff]"
    number = r"(?=[0-9.])[0-9]*\.?[0-9]*"
    # Both servers and the shapes of their addresses
    shape = (
        rf"^https://chroniclingamerica\.loc\.gov/iiif/2/(([A-Za-z0-9.-]+)(?:_[A-Za-z0-9.-]+)+){cut}data{cut}([A-Za-z]{{0,3}}(?:[0-9]{{8}}|[0-9]{{10}})){cut}({part}(?:{cut}{part})?){cut}"
        rf"([0-9]{{8}}(?:0[1-9]|[1-9][0-9])){cut}([0-9]{{4,8}})\.jp2/(pct:{number}(?:,{number}){{3}}/[A-Za-z0-9:,.!]+/[A-Za-z0-9:,.!]+/[A-Za-z0-9:,.!]*\.jpg)$"
    )
    at = lambda i: F.regexp_extract(url, shape, i)
    reel = F.regexp_replace(at(4), cut, ":")
    day = F.try_to_timestamp(F.substring(at(5), 1, 8), F.lit("yyyyMMdd"))
    new = F.concat(F.lit("https://tile.loc.gov/image-services/iiif/service:ndnp:"), at(2), F.lit(":batch_"), at(1), F.lit(":data:"), at(3), F.lit(":"), reel, F.lit(":"), at(5), F.lit(":"), at(6), F.lit("/"), at(7))
    return F.when(url.rlike(shape) & day.isNotNull() & ~F.concat(F.lit(":"), reel, F.lit(":")).rlike(r":\.{1,2}:"), new)


def picture_agreement(pages: DataFrame, gold: str, found: str, typed: bool = True, least: float = 0.5) -> DataFrame:
    """One row over pages with boxes of two sorts: ``gold`` has arrays of kind, x, y, w, h, ``found`` of the same and score.

    Found boxes by score take the free box they cover best; ``mean_best`` is over the best cover of every gold box. Shares of
    nothing are null; a null array is empty.
    """

    def run(wanted: pd.Series, had: pd.Series) -> pd.DataFrame:
        rows = []
        for g, f in zip(wanted, had):
            g, f = ([] if v is None else list(v) for v in (g, f))
            box = lambda b: (b["x"], b["y"], b["w"], b["h"])
            kinds = sorted({b["kind"] for b in g}, key=str) if typed else [None]
            best = matched = 0.0
            for k in kinds:
                mine, other = ([b for b in v if not typed or b["kind"] == k] for v in (g, f))
                best += sum(max((iou(box(b), box(o)) for o in other), default=0.0) for b in mine)
                matched += len(match_boxes([box(b) for b in mine], [(o["score"], box(o)) for o in other], least))
            rows.append((len(g), len(f), int(matched), best))
        return pd.DataFrame(rows, columns=["n_gold", "n_found", "n_matched", "best"])

    per = pages.select(F.pandas_udf(run, "n_gold long, n_found long, n_matched long, best double")(gold, found).alias("x")).select("x.*")
    zero = F.lit(0).cast("long")
    total = per.agg(*(F.coalesce(F.sum(c), zero).alias(c) for c in ("n_gold", "n_found", "n_matched")), F.sum("best").alias("best"))
    return total.select(
        "n_gold", "n_found", "n_matched", (F.col("n_gold") - F.col("n_matched")).alias("lost"), (F.col("n_found") - F.col("n_matched")).alias("surplus"),
        F.try_divide("best", "n_gold").alias("mean_best"), F.try_divide("n_matched", "n_found").alias("precision"), F.try_divide("n_matched", "n_gold").alias("recall"),
    )


def error_totals(rows: DataFrame, by: list[str], edits: str, size: str) -> DataFrame:
    """Per group the readings, their rate over all letters together, and the mean and median of their own rates.

    A reading of nothing has the rate 0 without edits, else 1; a group without letters has no rate together.
    """
    own = error_rate(F.col(edits), F.col(size))
    total = F.when(F.sum(size) > 0, F.sum(edits) / F.sum(size))
    return rows.groupBy(*by).agg(F.count(edits).alias("n"), total.alias("together"), F.avg(own).alias("mean"), F.median(own).alias("median"))
