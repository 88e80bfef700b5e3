"""Campaign selection and validation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import campaigns as K
from ..operators import quality as Q
from ..operators import windows as V
from ..registry import register
from ..sources.corpus import signals
from ..sources.sql import SIGNALS

BANDED = f"WITH {SIGNALS}, e AS (SELECT doc_id, lang, decade, lccn, damage_rate, est_cer, batch, CASE WHEN den >= 50 AND damage_rate::FLOAT > 0.25::FLOAT THEN 'worst' WHEN den >= 50 AND damage_rate::FLOAT > 0.1::FLOAT THEN 'moderate' END AS band FROM s), z AS (SELECT band, lang, decade, lccn, count(*) AS pages FROM e WHERE band IS NOT NULL GROUP BY ALL)"
CELL = ["band", "lang", "decade"]


def eligible(spark, sf_dir):
    return signals(spark, sf_dir).withColumn("band", K.damage_band(F.col("damage_rate"), F.col("den"))).where("band is not null")


def sizes(spark, sf_dir):
    return eligible(spark, sf_dir).groupBy(*CELL, "lccn").agg(F.count("*").alias("pages"))


@register("q_damage_bands", BANDED + " SELECT band, lang, decade, count(*) AS pages FROM e GROUP BY ALL")
def _bands(spark, sf_dir):
    return signals(spark, sf_dir).groupBy(K.damage_band(F.col("damage_rate"), F.col("den")).alias("band"), "lang", "decade").agg(F.count("*").alias("pages"))


@register("q_allocate_turns", BANDED + """, o AS (SELECT *, row_number() OVER (PARTITION BY band, lang, decade ORDER BY sha256('s1' || lccn), lccn) AS place FROM z), t AS (SELECT *, unnest(range(1, least(pages, 120)::BIGINT + 1)) AS turn FROM o), n AS (SELECT *, row_number() OVER (PARTITION BY band, lang, decade ORDER BY turn, place) AS n FROM t)
SELECT band, lang, decade, lccn, count(*) AS take FROM n WHERE n <= 120 GROUP BY ALL""")
def _turns(spark, sf_dir):
    return K.allocate(sizes(spark, sf_dir), CELL, "lccn", 120, "s1")


@register("q_campaign_draw", BANDED + """, o AS (SELECT *, row_number() OVER (PARTITION BY band, lang, decade ORDER BY sha256('s1' || lccn), lccn) AS place FROM z), t AS (SELECT *, unnest(range(1, least(pages, 120)::BIGINT + 1)) AS turn FROM o), n AS (SELECT *, row_number() OVER (PARTITION BY band, lang, decade ORDER BY turn, place) AS n FROM t),
  a AS (SELECT band, lang, decade, lccn, any_value(pages) AS pages, count(*) AS take FROM n WHERE n <= 120 GROUP BY band, lang, decade, lccn), k AS (SELECT *, row_number() OVER (PARTITION BY band, lang, decade, lccn ORDER BY sha256('s1ocr' || doc_id), doc_id) AS k FROM e WHERE band IS NOT NULL)
SELECT doc_id, band, lccn, k::INT AS k, round(pages / take, 6) AS weight FROM k JOIN a USING (band, lang, decade, lccn) WHERE k <= take""")
def _draw(spark, sf_dir):
    z = sizes(spark, sf_dir)
    takes = K.allocate(z, CELL, "lccn", 120, "s1")
    picked = K.draw(eligible(spark, sf_dir).select("doc_id", *CELL, "lccn"), takes, [*CELL, "lccn"], "s1")
    return K.weights(picked, z, CELL, "lccn", 120).select("doc_id", "band", "lccn", "k", F.round("weight", 6).alias("weight"))


@register("q_allocate_steps")
def _steps(spark, sf_dir):
    return K.allocate(sizes(spark, sf_dir), CELL, "lccn", 8, "s2")


@register("q_worst_first_tiers", BANDED + ", t AS (SELECT doc_id, damage_rate, batch, floor((1 - damage_rate) / 0.05)::INT AS tier FROM e WHERE damage_rate IS NOT NULL) SELECT doc_id, tier, round(avg(damage_rate) OVER (PARTITION BY tier, batch), 9) AS batch_mean FROM t")
def _tiers(spark, sf_dir):
    return K.worst_first(signals(spark, sf_dir).where("damage_rate is not null"), 0.05, ["batch"]).select("doc_id", "tier", F.round("batch_mean", 9).alias("batch_mean"))


@register("q_cell_gain", f"""WITH {SIGNALS}, g AS (SELECT lang, decade, count(*) AS n, avg(damage_rate - est_cer) AS m, stddev_samp(damage_rate - est_cer) AS sd FROM s WHERE damage_rate IS NOT NULL AND est_cer IS NOT NULL GROUP BY 1, 2)
SELECT lang, decade, n, round(m, 6) AS mean, round(1.96 * sd / sqrt(n), 6) AS half, CASE WHEN n >= 30 AND m + 1.96 * sd / sqrt(n) < 0.02 THEN 'stop' WHEN n >= 30 AND m - 1.96 * sd / sqrt(n) >= 0.02 THEN 'go' WHEN n >= 200 THEN CASE WHEN m >= 0.02 THEN 'go' ELSE 'stop' END ELSE 'measuring' END AS decision FROM g""")
def _gain(spark, sf_dir):
    s = signals(spark, sf_dir).where("damage_rate is not null and est_cer is not null").withColumn("gain", F.col("damage_rate") - F.col("est_cer"))
    g = K.cell_gain(s, ["lang", "decade"])
    return g.select("lang", "decade", "n", F.round("mean", 6).alias("mean"), F.round("half", 6).alias("half"), "decision")


@register("q_gain_by_decile", f"""WITH {SIGNALS}, r AS (SELECT doc_id, damage_rate, est_cer, ntile(10) OVER (ORDER BY damage_rate DESC, doc_id) AS tenth FROM s WHERE damage_rate IS NOT NULL), st AS (SELECT tenth, arg_min(damage_rate, (-damage_rate, doc_id)) AS v, arg_min(doc_id, (-damage_rate, doc_id)) AS i FROM r GROUP BY 1),
  p AS (SELECT r.doc_id, r.damage_rate - r.est_cer AS gain, max(st.tenth) AS tenth FROM r JOIN st ON st.v > r.damage_rate OR st.v = r.damage_rate AND st.i <= r.doc_id WHERE r.est_cer IS NOT NULL GROUP BY 1, 2) SELECT tenth::INT AS tenth, count(*) AS n, round(median(gain), 6) AS p50, round(avg(gain), 6) AS mean FROM p GROUP BY 1""")
def _deciles(spark, sf_dir):
    r = V.tiled(signals(spark, sf_dir).where("damage_rate is not null").select("doc_id", "damage_rate", "est_cer"), 10, "tenth", -F.col("damage_rate"), F.col("doc_id"))
    first = r.groupBy("tenth").agg(F.min_by(F.struct("damage_rate", "doc_id"), F.struct((-F.col("damage_rate")).alias("a"), "doc_id")).alias("f")).select("tenth", "f.*")
    p = r.where("est_cer is not null").select("doc_id", "damage_rate", (F.col("damage_rate") - F.col("est_cer")).alias("gain"))
    return K.by_decile(p, first, "damage_rate", "doc_id").groupBy("tenth").agg(F.count("*").alias("n"), F.round(F.median("gain"), 6).alias("p50"), F.round(F.avg("gain"), 6).alias("mean"))


@register("q_import_report", f"""WITH {SIGNALS}, b AS (SELECT * FROM (SELECT doc_id // 10000000 AS page, lang, damage_rate, row_number() OVER (PARTITION BY doc_id // 10000000 ORDER BY damage_rate, doc_id DESC) AS n FROM s WHERE damage_rate IS NOT NULL) WHERE n = 1) SELECT lang, count(*) AS pages, round(quantile_cont(damage_rate, 0.25), 6) AS q1, round(quantile_cont(damage_rate, 0.5), 6) AS q2, round(quantile_cont(damage_rate, 0.75), 6) AS q3 FROM b GROUP BY 1""")
def _report(spark, sf_dir):
    s = signals(spark, sf_dir).where("damage_rate is not null").withColumn("page", F.floor(F.col("doc_id") / 10000000))
    b = Q.latest_per(s, ["page"], F.asc("damage_rate"), F.desc("doc_id"))
    return b.groupBy("lang").agg(F.count("*").alias("pages"), *(F.round(F.percentile("damage_rate", F.lit(p)), 6).alias(n) for p, n in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))))


@register("q_prefetch_counts", f"WITH {SIGNALS}, m AS (SELECT lang, decade, batch FROM s WHERE damage_rate > 0.25) SELECT lang, decade, batch, count(*) AS pages FROM m GROUP BY GROUPING SETS ((lang), (decade), (batch), (lang, decade))")
def _prefetch(spark, sf_dir):
    m = signals(spark, sf_dir).where("damage_rate > 0.25").select("lang", "decade", "batch")
    return m.groupingSets([["lang"], ["decade"], ["batch"], ["lang", "decade"]], "lang", "decade", "batch").agg(F.count("*").alias("pages"))


@register("q_data_flow", "WITH x(stage) AS (VALUES ('view'), ('click'), ('refund')), o AS (SELECT event_type AS stage, count(*) AS n, min(ts) AS first FROM events GROUP BY 1) SELECT x.stage, CASE WHEN n IS NULL THEN 'unknown' ELSE 'observed' END AS state, n FROM x LEFT JOIN o USING (stage)")
def _flow(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"))
    x = spark.createDataFrame([("view",), ("click",), ("refund",)], "stage string")
    return x.join(e, "stage", "left").select("stage", F.when(F.col("n").isNull(), "unknown").otherwise("observed").alias("state"), "n")


@register("q_crop_pairs", """WITH a AS (SELECT conv_id, turn, regexp_replace(text, '[^ -~]', '', 'g') AS text FROM conversations WHERE role = 'user'), b AS (SELECT conv_id, turn - 1 AS turn, regexp_replace(text, '[^ -~]', '', 'g') AS text FROM conversations WHERE role = 'assistant'), j AS (SELECT conv_id, turn, coalesce(a.text, '') AS x, substring(coalesce(b.text, ''), 1, length(coalesce(a.text, ''))) AS y FROM a FULL JOIN b USING (conv_id, turn))
SELECT state, count(*) AS pairs FROM (SELECT CASE WHEN x = '' AND y = '' THEN 'no_text' WHEN x = '' OR y = '' THEN 'disagree' WHEN 1 - levenshtein(x, y) / greatest(length(x), length(y)) >= 0.3 THEN 'agree' ELSE 'disagree' END AS state FROM j) GROUP BY 1""")
def _crops(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("text", F.regexp_replace("text", "[^ -~]", ""))
    a = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("a"))
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    j = a.join(b, ["conv_id", "turn"], "full_outer").select(F.coalesce("a", F.lit("")).alias("x"), F.substring(F.coalesce("b", F.lit("")), F.lit(1), F.length(F.coalesce("a", F.lit("")))).alias("y"))
    similar = 1 - F.levenshtein("x", "y") / F.greatest(F.length("x"), F.length("y"))
    state = F.when((F.col("x") == "") & (F.col("y") == ""), "no_text").when((F.col("x") == "") | (F.col("y") == ""), "disagree").when(similar >= 0.3, "agree").otherwise("disagree")
    return j.groupBy(state.alias("state")).agg(F.count("*").alias("pairs"))
