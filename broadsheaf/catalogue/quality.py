"""The quality reports over the page summary (view ``s``)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import windows as V
from ..registry import register
from ..sources.corpus import signals
from ..sources.sql import SIGNALS


def D():
    return F.col("damage_rate")

BAND = "CASE WHEN damage_rate <= 0.1 THEN '1 fine' WHEN damage_rate <= 0.25 THEN '2 moderate' WHEN damage_rate IS NOT NULL THEN '3 bad' END"


def sql(body: str) -> str:
    return f"WITH {SIGNALS}{body}"


def p50(c: str, p: float = 0.5):
    return F.round(F.percentile(c, F.lit(p)), 9)


@register("q_quality_coverage", sql(""" SELECT count(*) AS pages, count(*) FILTER (decision = 'no_text') AS no_text, count(*) FILTER (decision = 'und') AS und, count(*) FILTER (decision = 'mixed') AS mixed, count(damage_rate) AS scored,
  count(dice) AS pairs, count(*) FILTER (matched >= 0.5 AND local_cer IS NOT NULL) AS placed, count(wc_mean) AS confidences, count(est_cer) AS estimates, count(*) FILTER (has_image_features) AS imaged, count(*) FILTER (ocr_runs > 0) AS ours,
  count(DISTINCT lccn) AS titles, count(DISTINCT batch) AS batches, min(date) AS first_date, max(date) AS last_date FROM s"""))
def _coverage(spark, sf_dir):
    c = F.count
    return signals(spark, sf_dir).agg(
        c("*").alias("pages"), *(F.count_if(F.col("decision") == x).alias(x) for x in ("no_text", "und", "mixed")), c("damage_rate").alias("scored"), c("dice").alias("pairs"), F.count_if(Q.placed()).alias("placed"), c("wc_mean").alias("confidences"),
        c("est_cer").alias("estimates"), F.count_if("has_image_features").alias("imaged"), F.count_if(F.col("ocr_runs") > 0).alias("ours"), F.count_distinct("lccn").alias("titles"), F.count_distinct("batch").alias("batches"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )


@register("q_quality_cube", sql(""" SELECT lang, decision, lccn, decade, count(*) AS pages, count(*) FILTER (words < 400) AS few_words, count(*) FILTER (decision = 'und' AND words >= 1000) AS und_long, count(damage_rate) AS scored, count(*) FILTER (damage_rate IS NOT NULL AND den < 50) AS weak,
  count(*) FILTER (damage_rate <= 0.1) AS fine, count(*) FILTER (damage_rate > 0.1 AND damage_rate <= 0.25) AS moderate, count(*) FILTER (damage_rate > 0.25) AS bad, count(*) FILTER (damage_rate > 0.25 AND den < 50) AS bad_weak, round(sum(damage_rate), 9) AS sum_damage, count(*) FILTER (damage_rate > 0.25 AND ocr_runs > 0) AS bad_done,
  count(*) FILTER (damage_rate > 0.25 AND den >= 50 AND ocr_runs = 0) AS strong_todo, count(*) FILTER (damage_rate > 0.25 AND den >= 50 AND ocr_runs = 0 AND dice >= 0.6) AS strong_todo_dice, round(sum(dice), 9) AS sum_dice, round(sum(local_cer) FILTER (matched >= 0.5), 9) AS sum_local_placed, round(sum(wc_mean), 9) AS sum_wc
  FROM s GROUP BY 1, 2, 3, 4"""))
def _cube(spark, sf_dir):
    den, n = F.col("den"), F.count_if
    strong = (D() > 0.25) & (den >= 50) & (F.col("ocr_runs") == 0)
    return signals(spark, sf_dir).groupBy("lang", "decision", "lccn", "decade").agg(
        F.count("*").alias("pages"), n(F.col("words") < 400).alias("few_words"), n((F.col("decision") == "und") & (F.col("words") >= 1000)).alias("und_long"), F.count("damage_rate").alias("scored"), n(D().isNotNull() & (den < 50)).alias("weak"), n(D() <= 0.1).alias("fine"),
        n((D() > 0.1) & (D() <= 0.25)).alias("moderate"), n(D() > 0.25).alias("bad"), n((D() > 0.25) & (den < 50)).alias("bad_weak"), F.round(F.sum("damage_rate"), 9).alias("sum_damage"), n((D() > 0.25) & (F.col("ocr_runs") > 0)).alias("bad_done"), n(strong).alias("strong_todo"),
        n(strong & (F.col("dice") >= 0.6)).alias("strong_todo_dice"), F.round(F.sum("dice"), 9).alias("sum_dice"), F.round(F.sum(F.when(F.col("matched") >= 0.5, F.col("local_cer"))), 9).alias("sum_local_placed"), F.round(F.sum("wc_mean"), 9).alias("sum_wc"),
    )


@register("q_quality_quantiles", sql(""" SELECT lang, count(*) AS scored, round(quantile_cont(damage_rate, 0.1), 9) AS p10, round(quantile_cont(damage_rate, 0.5), 9) AS p50, round(quantile_cont(damage_rate, 0.9), 9) AS p90, round(quantile_cont(dice, 0.5), 9) AS dice_p50,
  round(quantile_cont(local_cer, 0.5) FILTER (matched >= 0.5), 9) AS local_p50 FROM s WHERE damage_rate IS NOT NULL GROUP BY 1"""))
def _quantiles(spark, sf_dir):
    s = signals(spark, sf_dir).where("damage_rate is not null").withColumn("near", F.when(F.col("matched") >= 0.5, F.col("local_cer")))
    return s.groupBy("lang").agg(F.count("*").alias("scored"), *(p50("damage_rate", p).alias(f"p{int(p * 100)}") for p in (0.1, 0.5, 0.9)), p50("dice").alias("dice_p50"), p50("near").alias("local_p50"))


for _name, _keys in {"language_decade": ("lang", "decade"), "title": ("lccn",)}.items():

    @register(f"q_median_{_name}", sql(f" SELECT {', '.join(_keys)}, count(*) AS scored, round(median(damage_rate), 9) AS p50 FROM s WHERE damage_rate IS NOT NULL GROUP BY ALL"))
    def _median(spark, sf_dir, keys=_keys):
        return signals(spark, sf_dir).where("damage_rate is not null").groupBy(*keys).agg(F.count("*").alias("scored"), F.round(F.median("damage_rate"), 9).alias("p50"))


@register("q_batches", sql(" SELECT batch, count(*) AS pages, count(damage_rate) AS scored, count(*) FILTER (damage_rate > 0.25) AS bad, round(avg(damage_rate), 9) AS mean_damage, count(DISTINCT lccn) AS titles, min(decade) AS first_decade, max(decade) AS last_decade FROM s GROUP BY 1"))
def _batches(spark, sf_dir):
    return signals(spark, sf_dir).groupBy("batch").agg(F.count("*").alias("pages"), F.count("damage_rate").alias("scored"), F.count_if(D() > 0.25).alias("bad"), F.round(F.avg("damage_rate"), 9).alias("mean_damage"), F.count_distinct("lccn").alias("titles"), F.min("decade").alias("first_decade"), F.max("decade").alias("last_decade"))


@register("q_crosstab", sql(f""" SELECT lang, {BAND} AS band, CASE WHEN dice IS NULL THEN '0 no pair' WHEN NOT coalesce(matched >= 0.5 AND local_cer IS NOT NULL, FALSE) THEN '1 under half placed' WHEN local_cer <= 0.1 THEN '2 up to 0.1' WHEN local_cer <= 0.2 THEN '3 up to 0.2' ELSE '4 above 0.2' END AS agreement,
  count(*) AS pages, round(sum(dice), 9) AS sum_dice FROM s WHERE damage_rate IS NOT NULL GROUP BY ALL"""))
def _crosstab(spark, sf_dir):
    return signals(spark, sf_dir).where("damage_rate is not null").groupBy("lang", Q.band(D()).alias("band"), Q.agreement_class().alias("agreement")).agg(F.count("*").alias("pages"), F.round(F.sum("dice"), 9).alias("sum_dice"))


@register("q_spearman", sql(""", h AS (SELECT damage_rate, est_cer FROM s WHERE damage_rate IS NOT NULL AND est_cer IS NOT NULL),
  r AS (SELECT rank() OVER (ORDER BY damage_rate) + (count(*) OVER (PARTITION BY damage_rate) - 1) / 2 AS a, rank() OVER (ORDER BY est_cer) + (count(*) OVER (PARTITION BY est_cer) - 1) / 2 AS b FROM h) SELECT count(*) AS pages, round(corr(a, b), 6) AS rho FROM r"""))
def _spearman(spark, sf_dir):
    h = signals(spark, sf_dir).where("damage_rate is not null and est_cer is not null")
    return Q.spearman(h, "damage_rate", "est_cer").withColumn("rho", F.round("rho", 6))


@register("q_banded_medians", sql(f""", h AS (SELECT * FROM s WHERE damage_rate IS NOT NULL AND est_cer IS NOT NULL) SELECT 'all' AS grp, count(*) AS pages, round(median(est_cer), 9) AS est_p50 FROM h UNION ALL SELECT {BAND}, count(*), round(median(est_cer), 9) FROM h GROUP BY 1"""))
def _banded(spark, sf_dir):
    h = signals(spark, sf_dir).where("damage_rate is not null and est_cer is not null")
    measures = (F.count("*").alias("pages"), F.round(F.median("est_cer"), 9).alias("est_p50"))
    return h.groupBy(F.lit("all").alias("grp")).agg(*measures).unionByName(h.groupBy(Q.band(D()).alias("grp")).agg(*measures))


@register("q_word_confidence", sql(" SELECT coalesce(CASE WHEN lang <> 'fre' THEN lang END, 'not stated') AS software, count(*) AS pages, round(avg(wc_mean), 9) AS mean_wc, count(*) FILTER (wc_mean IS NULL) AS no_wc FROM s GROUP BY 1"))
def _confidence(spark, sf_dir):
    software = F.coalesce(F.when(F.col("lang") != "fre", F.col("lang")), F.lit("not stated"))
    return signals(spark, sf_dir).groupBy(software.alias("software")).agg(F.count("*").alias("pages"), F.round(F.avg("wc_mean"), 9).alias("mean_wc"), F.count_if(F.col("wc_mean").isNull()).alias("no_wc"))


CUTS = (0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5)


@register("q_reocr_outcomes", sql(f""", o AS (SELECT * FROM (SELECT doc_id // 10000000 AS page, doc_id, lang, damage_rate, regexp_extract('engine x profile=p' || (seq % 3) || ' image=y', 'profile=([^ ]+)', 1) AS profile, est_cer AS ours,
    row_number() OVER (PARTITION BY doc_id // 10000000, seq % 3 ORDER BY words DESC, doc_id) AS n FROM s WHERE est_cer IS NOT NULL AND damage_rate IS NOT NULL) WHERE n = 1)
  SELECT profile, lang, ({' + '.join(f'(damage_rate >= {c})::INT' for c in CUTS)})::INT AS bin, count(*) AS pages, round(median(damage_rate), 9) AS loc_p50, round(median(ours), 9) AS ours_p50, round(avg((ours < damage_rate)::INT), 9) AS lower_share, round(avg(ours - damage_rate), 9) AS mean_change FROM o GROUP BY ALL"""))
def _outcomes(spark, sf_dir):
    s = signals(spark, sf_dir).where("est_cer is not null and damage_rate is not null")
    engine = F.concat(F.lit("engine x profile=p"), F.pmod("seq", F.lit(3)).cast("string"), F.lit(" image=y"))
    s = s.select(F.floor(F.col("doc_id") / 10000000).alias("page"), "doc_id", "lang", "damage_rate", F.regexp_extract(engine, "profile=([^ ]+)", 1).alias("profile"), F.col("est_cer").alias("ours"), "words")
    o = Q.latest_per(s, ["page", "profile"], F.desc("words"), F.asc("doc_id"))
    bin_ = sum(((D() >= c).cast("int") for c in CUTS), F.lit(0))
    return o.groupBy("profile", "lang", bin_.alias("bin")).agg(
        F.count("*").alias("pages"), F.round(F.median("damage_rate"), 9).alias("loc_p50"), F.round(F.median("ours"), 9).alias("ours_p50"), F.round(F.avg((F.col("ours") < D()).cast("int")), 9).alias("lower_share"), F.round(F.avg(F.col("ours") - D()), 9).alias("mean_change"))


@register("q_paired_decades", sql(""" SELECT decade, count(*) AS pages, round(median(damage_rate), 9) AS loc_p50, round(median(est_cer), 9) AS ours_p50, count(*) FILTER (damage_rate > 0.25) AS bad_pages, round(median(est_cer) FILTER (damage_rate > 0.25), 9) AS ours_p50_bad
  FROM s WHERE lang = 'ger' AND damage_rate IS NOT NULL AND est_cer IS NOT NULL GROUP BY 1"""))
def _decades(spark, sf_dir):
    s = signals(spark, sf_dir).where("lang = 'ger' and damage_rate is not null and est_cer is not null")
    return s.groupBy("decade").agg(F.count("*").alias("pages"), F.round(F.median("damage_rate"), 9).alias("loc_p50"), F.round(F.median("est_cer"), 9).alias("ours_p50"), F.count_if(D() > 0.25).alias("bad_pages"), F.round(F.median(F.when(D() > 0.25, F.col("est_cer"))), 9).alias("ours_p50_bad"))


STEPS = ("any", "detected only", "before 1999", "not yet read", "enough occurrences", "enough words")


@register("q_funnel", sql(f""", t AS (SELECT *, CASE WHEN damage_rate > 0.25 THEN 'bad' WHEN damage_rate > 0.15 THEN 'upper' END AS tier FROM s WHERE lang = 'ger'), steps(step, label) AS (VALUES {', '.join(f"({i + 1}, '{x}')" for i, x in enumerate(STEPS))})
  SELECT step::INT AS step, label, count(*) FILTER (tier = 'bad') AS bad, count(*) FILTER (tier = 'upper') AS upper_moderate FROM steps LEFT JOIN t ON (step < 2 OR decision = 'detected') AND (step < 3 OR decade < 1999) AND (step < 4 OR ocr_runs = 0) AND (step < 5 OR den >= 50) AND (step < 6 OR words >= 500) GROUP BY 1, 2"""))
def _funnel(spark, sf_dir):
    """A theta join of a few steps with the pages; the steps are literals, so they are the broadcast side."""
    t = signals(spark, sf_dir).where("lang = 'ger'").withColumn("tier", F.when(D() > 0.25, "bad").when(D() > 0.15, "upper"))
    steps = spark.createDataFrame([(i + 1, x) for i, x in enumerate(STEPS)], "step int, label string")
    step = F.col("step")
    on = ((step < 2) | (F.col("decision") == "detected")) & ((step < 3) | (F.col("decade") < 1999)) & ((step < 4) | (F.col("ocr_runs") == 0)) & ((step < 5) | (F.col("den") >= 50)) & ((step < 6) | (F.col("words") >= 500))
    counted = t.join(F.broadcast(steps), on).groupBy("step").agg(F.count_if(F.col("tier") == "bad").alias("bad"), F.count_if(F.col("tier") == "upper").alias("upper_moderate"))
    zero = F.lit(0).cast("long")
    return steps.join(counted, "step", "left").select("step", "label", F.coalesce("bad", zero).alias("bad"), F.coalesce("upper_moderate", zero).alias("upper_moderate"))


ELIGIBLE = "lang = 'ger' AND decision = 'detected' AND ocr_runs = 0 AND damage_rate > 0.15 AND den >= 50 AND words >= 500"
TIER = "CASE WHEN damage_rate > 0.25 THEN 'bad' ELSE 'upper' END"


@register("q_pilot_round_robin", sql(f""", e AS (SELECT doc_id, lccn, date, edition, decade, damage_rate, {TIER} AS tier FROM s WHERE {ELIGIBLE}),
  i AS (SELECT *, row_number() OVER (PARTITION BY tier, lccn, date, edition ORDER BY damage_rate DESC, doc_id) AS issue_rank FROM e), t AS (SELECT *, row_number() OVER (PARTITION BY tier, lccn, decade ORDER BY issue_rank, damage_rate DESC, doc_id) AS stratum_rank FROM i),
  g AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY stratum_rank, damage_rate DESC, doc_id) AS group_rank FROM t) SELECT tier, group_rank::INT AS group_rank, stratum_rank::INT AS stratum_rank, doc_id, lccn, decade FROM g WHERE group_rank <= 300"""))
def _pilot(spark, sf_dir):
    e = signals(spark, sf_dir).where(ELIGIBLE).withColumn("tier", F.when(D() > 0.25, "bad").otherwise("upper"))
    return Q.round_robin(e, ["tier"], ["lccn", "date", "edition"], ["lccn", "decade"], F.desc("damage_rate"), F.asc("doc_id")).where("group_rank <= 300").select("tier", "group_rank", "stratum_rank", "doc_id", "lccn", "decade")


@register("q_eligible_strata", sql(f" SELECT {TIER} AS tier, lccn, decade, count(*) AS pages, round(avg(damage_rate), 9) AS mean_damage FROM s WHERE {ELIGIBLE} GROUP BY ALL"))
def _strata(spark, sf_dir):
    return signals(spark, sf_dir).where(ELIGIBLE).groupBy(F.when(D() > 0.25, "bad").otherwise("upper").alias("tier"), "lccn", "decade").agg(F.count("*").alias("pages"), F.round(F.avg("damage_rate"), 9).alias("mean_damage"))


@register("q_text_bands", sql(f""", b AS (SELECT doc_id, dice AS len_ratio, local_cer AS other FROM s WHERE seq % 3 = 0) SELECT lang, {BAND} AS band, ocr_runs = 0 AND den >= 50 AS eligible, CASE WHEN b.doc_id IS NULL THEN '0 none' WHEN len_ratio IS NULL OR len_ratio < 0.5 THEN '1 short' WHEN other IS NULL THEN '2 not scored' WHEN other <= 0.1 THEN '3 fine' WHEN other <= 0.25 THEN '4 moderate' ELSE '5 bad' END AS other_band, count(*) AS pages
  FROM s LEFT JOIN b USING (doc_id) WHERE damage_rate IS NOT NULL GROUP BY ALL"""))
def _text_bands(spark, sf_dir):
    s = signals(spark, sf_dir)
    b = s.where(F.pmod("seq", F.lit(3)) == 0).select("doc_id", F.col("dice").alias("len_ratio"), F.col("local_cer").alias("other"), F.lit(True).alias("pair"))
    j = s.where("damage_rate is not null").join(b, "doc_id", "left")
    other = F.when(F.col("pair").isNull(), "0 none").when(F.col("len_ratio").isNull() | (F.col("len_ratio") < 0.5), "1 short").when(F.col("other").isNull(), "2 not scored").when(F.col("other") <= 0.1, "3 fine").when(F.col("other") <= 0.25, "4 moderate").otherwise("5 bad")
    return j.groupBy("lang", Q.band(D()).alias("band"), ((F.col("ocr_runs") == 0) & (F.col("den") >= 50)).alias("eligible"), other.alias("other_band")).agg(F.count("*").alias("pages"))


@register("q_worst_pages", sql(""", l AS (SELECT lang FROM s WHERE damage_rate IS NOT NULL GROUP BY 1 HAVING count(*) >= 1000), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY damage_rate DESC, doc_id) AS rank FROM s WHERE damage_rate IS NOT NULL AND den >= 50 AND ocr_runs = 0 AND lang IN (FROM l)) SELECT lang, rank::INT AS rank, doc_id, lccn, round(damage_rate, 4) AS damage_rate FROM r WHERE rank <= 100"""))
def _worst(spark, sf_dir):
    s = signals(spark, sf_dir).where("damage_rate is not null")
    some = s.groupBy("lang").agg(F.count("*").alias("n")).where("n >= 1000").select("lang")
    r = s.where("den >= 50 and ocr_runs = 0").join(some, "lang", "left_semi").withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("damage_rate"), "doc_id")))
    return r.where("rank <= 100").select("lang", "rank", "doc_id", "lccn", F.round("damage_rate", 4).alias("damage_rate"))


BAD = "coalesce(est_cer, CASE WHEN matched >= 0.5 THEN local_cer / 2 END, (damage_rate + coalesce(1 - wc_mean, damage_rate)) / 2)"


@register("q_ocr_priority", sql(f" SELECT doc_id, lccn, round({BAD}, 6) AS badness, CASE WHEN est_cer IS NOT NULL THEN 'estimate' WHEN matched >= 0.5 AND local_cer IS NOT NULL THEN 'disagreement' WHEN wc_mean IS NOT NULL THEN 'damage and doubt' ELSE 'damage' END AS basis FROM s WHERE ocr_runs = 0 AND {BAD} IS NOT NULL ORDER BY badness DESC, doc_id LIMIT 1000"))
def _priority(spark, sf_dir):
    basis = F.when(F.col("est_cer").isNotNull(), "estimate").when(Q.placed(), "disagreement").when(F.col("wc_mean").isNotNull(), "damage and doubt").otherwise("damage")
    s = signals(spark, sf_dir).where("ocr_runs = 0").select("doc_id", "lccn", F.round(Q.loc_badness(), 6).alias("badness"), basis.alias("basis"))
    return s.where("badness is not null").orderBy(F.desc("badness"), "doc_id").limit(1000)


@register("q_image_order", sql(""", r AS (SELECT doc_id, lccn, decade, damage_rate, row_number() OVER (PARTITION BY lccn, decade ORDER BY (damage_rate + coalesce(1 - wc_mean, damage_rate)) / 2 DESC NULLS LAST, doc_id) AS stratum_rank FROM s WHERE NOT has_image_features) SELECT doc_id, lccn, stratum_rank::INT AS stratum_rank FROM r ORDER BY stratum_rank, damage_rate DESC NULLS LAST, doc_id LIMIT 500"""))
def _images(spark, sf_dir):
    worst = F.desc_nulls_last((D() + F.coalesce(1 - F.col("wc_mean"), D())) / 2)
    s = signals(spark, sf_dir).where("not has_image_features").withColumn("stratum_rank", F.row_number().over(W.partitionBy("lccn", "decade").orderBy(worst, "doc_id")))
    return s.orderBy("stratum_rank", F.desc_nulls_last("damage_rate"), "doc_id").limit(500).select("doc_id", "lccn", "stratum_rank")


@register("q_titles_by_benefit", sql(" SELECT lccn, count(*) AS pages, round(avg(damage_rate), 9) AS mean_damage, round(avg((damage_rate > 0.25)::INT), 9) AS bad_share, sum((ocr_runs > 0)::INT)::BIGINT AS read, sum(has_image_features::INT)::BIGINT AS imaged FROM s GROUP BY 1"))
def _benefit(spark, sf_dir):
    return signals(spark, sf_dir).groupBy("lccn").agg(F.count("*").alias("pages"), F.round(F.avg("damage_rate"), 9).alias("mean_damage"), F.round(F.avg((D() > 0.25).cast("int")), 9).alias("bad_share"), F.count_if(F.col("ocr_runs") > 0).alias("read"), F.count_if("has_image_features").alias("imaged"))


@register("q_stratified_draw", sql(f""", r AS (SELECT *, ntile(10) OVER (ORDER BY damage_rate DESC, doc_id) AS tenth FROM s WHERE damage_rate IS NOT NULL AND lang = 'eng'), p AS (SELECT doc_id, decade, {BAND} AS band FROM r WHERE tenth <= 4),
  a AS (SELECT decade, band, count(*) AS pages, least(count(*), greatest(30, ceil(1000 * count(*) / sum(count(*)) OVER ())))::BIGINT AS take FROM p GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY decade, band ORDER BY md5('seed-1' || doc_id), doc_id) AS k FROM p)
  SELECT doc_id, decade, band, pages, take, k::INT AS k FROM k JOIN a USING (decade, band) WHERE k <= take"""))
def _draw(spark, sf_dir):
    s = signals(spark, sf_dir).where("damage_rate is not null and lang = 'eng'")
    r = V.tiled(s, 10, "tenth", -F.col("damage_rate"), F.col("doc_id")).where("tenth <= 4").select("doc_id", "decade", Q.band(D()).alias("band"))
    return Q.draw(r, ["decade", "band"], 1000, 30, "seed-1").select("doc_id", "decade", "band", "pages", "take", "k")


@register("q_page_signals", sql(""", u AS (SELECT doc_id // 10000000 AS page, doc_id, est_cer, words, decade FROM s WHERE est_cer IS NOT NULL), latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY words DESC, doc_id) AS n FROM u) WHERE n = 1), ours AS (SELECT page, min(est_cer) AS best FROM u GROUP BY 1), runs AS (SELECT doc_id // 10000000 AS page, sum(ocr_runs) AS ocr_runs FROM s GROUP BY 1), x AS (SELECT DISTINCT page FROM u WHERE est_cer > 0.09)
  SELECT p.doc_id, p.lccn, latest.est_cer AS unit_cer, best, coalesce(runs.ocr_runs, 0)::BIGINT AS ocr_runs, latest.page IS NOT NULL AS has_unit, x.page IS NULL AS allowed FROM s p LEFT JOIN latest ON latest.page = p.doc_id // 10000000 LEFT JOIN ours ON ours.page = p.doc_id // 10000000 LEFT JOIN runs ON runs.page = p.doc_id // 10000000 LEFT JOIN x ON x.page = p.doc_id // 10000000 WHERE p.seq = 1"""))
def _page_signals(spark, sf_dir):
    """All signals of a page by left joins on its id, each chosen latest-per-key first; excluded pages are told."""
    s = signals(spark, sf_dir).withColumn("page", F.floor(F.col("doc_id") / 10000000))
    u = s.where("est_cer is not null").select("page", "doc_id", "est_cer", "words")
    latest = Q.latest_per(u, ["page"], F.desc("words"), F.asc("doc_id")).select("page", F.col("est_cer").alias("unit_cer"), F.lit(True).alias("unit"))
    ours, runs = u.groupBy("page").agg(F.min("est_cer").alias("best")), s.groupBy("page").agg(F.sum("ocr_runs").alias("runs"))
    out = u.where("est_cer > 0.09").select("page").distinct().withColumn("excluded", F.lit(True))
    j = s.where("seq = 1").join(latest, "page", "left").join(ours, "page", "left").join(runs, "page", "left").join(out, "page", "left")
    return j.select("doc_id", "lccn", "unit_cer", "best", F.coalesce("runs", F.lit(0).cast("long")).alias("ocr_runs"), F.col("unit").isNotNull().alias("has_unit"), F.col("excluded").isNull().alias("allowed"))
