"""Vectors, crowd answers and study analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extras as X
from ..registry import register
from ..sources.corpus import signals, table
from ..sources.sql import SIGNALS


@register("q_knn_agreement", """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / nullif(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 0)) AS e FROM embeddings), p AS (SELECT a.vec_id AS id, a.label AS c, b.vec_id AS o, b.label AS oc, list_inner_product(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, o) AS n FROM p WHERE s > 0) SELECT id, c, round(sum(CASE WHEN oc = c THEN s ELSE 0 END) / sum(s), 6) AS agreement FROM r WHERE n <= 10 GROUP BY 1, 2""")
def _knn(spark, sf_dir):
    return X.knn_agreement(table(spark, sf_dir, "embeddings"), 10).withColumn("agreement", F.round("agreement", 6))


@register("q_bank_clean", """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / nullif(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 0)) AS e FROM embeddings), p AS (SELECT a.vec_id AS id, a.label AS c, b.vec_id AS o, b.label AS oc, list_inner_product(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, o) AS n FROM p WHERE s > 0), g AS (SELECT id, c, round(sum(CASE WHEN oc = c THEN s ELSE 0 END) / sum(s), 6) AS g FROM r WHERE n <= 10 GROUP BY 1, 2) SELECT c, count(*) AS rows, count(*) FILTER (g >= 0.1 OR id % 50 = 0) AS kept FROM g GROUP BY 1""")
def _clean(spark, sf_dir):
    a = X.knn_agreement(table(spark, sf_dir, "embeddings"), 10)
    return a.groupBy("c").agg(F.count("*").alias("rows"), F.count_if((F.round("agreement", 6) >= 0.1) | (F.pmod("id", F.lit(50)) == 0)).alias("kept"))


CHOICE = {"view": "a", "click": "b", "signup": "neither", "purchase": "unsure", "error": "notext"}


def answers(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    out = F.lit(None).cast("string")
    for k, v in CHOICE.items():
        out = F.when(F.col("event_type") == k, v).otherwise(out)
    return e.select(F.pmod("event_id", F.lit(997)).alias("task"), "user_id", out.alias("choice"))


ANSWERS = "a AS (SELECT event_id % 997 AS task, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CHOICE.items()) + " END AS choice FROM events)"


@register("q_crowd_settle", f"""WITH {ANSWERS}, g AS (SELECT task, count(*) AS n, {', '.join(f"count(*) FILTER (choice = '{c}') AS n_{c}" for c in X.CHOICES)} FROM a GROUP BY 1), t AS (SELECT *, greatest({', '.join('n_' + c for c in X.CHOICES)}) AS top FROM g)
SELECT task, n, {', '.join('n_' + c for c in X.CHOICES)}, CASE WHEN n >= 3 AND 3 * top >= 2 * n THEN 'settled' WHEN n >= 7 THEN 'disputed' ELSE 'open' END AS state, CASE WHEN n >= 3 AND 3 * top >= 2 * n THEN CASE {' '.join(f"WHEN n_{c} = top THEN '{c}'" for c in X.CHOICES)} END END AS winner FROM t""")
def _settle(spark, sf_dir):
    return X.settle(answers(spark, sf_dir), "task", "choice")


@register("q_next_task", f"WITH {ANSWERS}, g AS (SELECT task, count(*) AS n FROM a GROUP BY 1) SELECT task, n FROM g WHERE task NOT IN (SELECT event_id % 997 FROM events WHERE user_id < 20) ORDER BY n DESC, md5('x' || task) LIMIT 5")
def _next(spark, sf_dir):
    a = answers(spark, sf_dir)
    done = a.where("user_id < 20").select("task").distinct()
    g = a.groupBy("task").agg(F.count("*").alias("n")).join(done, "task", "left_anti")
    return g.orderBy(F.desc("n"), F.md5(F.concat(F.lit("x"), F.col("task").cast("string")).cast("binary"))).limit(5)


@register("q_progress", f"WITH {ANSWERS}, l(c) AS (VALUES ('a'), ('b'), ('none')) SELECT c, count(task) AS answers, count(DISTINCT task) AS tasks FROM l LEFT JOIN a ON choice = c GROUP BY 1")
def _progress(spark, sf_dir):
    l = spark.createDataFrame([("a",), ("b",), ("none",)], "c string")
    return l.join(answers(spark, sf_dir), F.col("c") == F.col("choice"), "left").groupBy("c").agg(F.count("task").alias("answers"), F.count_distinct("task").alias("tasks"))


@register("q_calibration", f"""WITH {SIGNALS}, p AS (SELECT lang, damage_rate AS t, est_cer AS e FROM s WHERE damage_rate IS NOT NULL AND est_cer IS NOT NULL), r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY t) + (count(*) OVER (PARTITION BY lang, t) - 1) / 2 AS rt, rank() OVER (PARTITION BY lang ORDER BY e) + (count(*) OVER (PARTITION BY lang, e) - 1) / 2 AS re FROM p)
SELECT lang, count(*) AS n, round(avg(e - t), 6) AS bias, round(avg(abs(e - t)), 6) AS mae, round(corr(t, e), 6) AS pearson, round(corr(rt, re), 6) AS spearman FROM r GROUP BY 1""")
def _calibration(spark, sf_dir):
    c = X.calibration(signals(spark, sf_dir).where("damage_rate is not null and est_cer is not null"), "lang", "damage_rate", "est_cer")
    return c.select("lang", "n", *(F.round(x, 6).alias(x) for x in ("bias", "mae", "pearson", "spearman")))


@register("q_version_diff", "WITH a AS (SELECT event_type AS k, count(*) AS a FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS k, count(*) AS b FROM events WHERE event_id % 3 = 0 AND event_type <> 'error' GROUP BY 1) SELECT k, a, b, round(100 * (b - a) / a, 6) AS change, coalesce(abs(100 * (b - a) / a) > 33, TRUE) AS flagged FROM a FULL JOIN b USING (k)")
def _diff(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("k"), "event_id")
    n = lambda df: df.groupBy("k").agg(F.count("*").alias("n"))
    return X.version_diff(n(e.where("event_id % 2 = 0")), n(e.where("event_id % 3 = 0 and k <> 'error'")), "k", "n", 33).withColumn("change", F.round("change", 6))


@register("q_pooled", f"WITH {SIGNALS} SELECT lccn, round(sum(damage_rate * words) / sum(words) FILTER (damage_rate IS NOT NULL), 6) AS damage, round(sum(est_cer * den) / sum(den) FILTER (est_cer IS NOT NULL), 6) AS cer FROM s GROUP BY 1")
def _pooled(spark, sf_dir):
    pool = lambda x, w: F.round(F.sum(F.col(x) * F.col(w)) / F.sum(F.when(F.col(x).isNotNull(), F.col(w))), 6)
    return signals(spark, sf_dir).groupBy("lccn").agg(pool("damage_rate", "words").alias("damage"), pool("est_cer", "den").alias("cer"))


@register("q_stratified_shares", f"WITH {SIGNALS}, z AS (SELECT lang, decade, count(*) AS pages FROM s GROUP BY 1, 2) SELECT lang, decade, pages, least(greatest(round(500 * pages / sum(pages) OVER ()), 5), pages)::BIGINT AS take FROM z")
def _shares(spark, sf_dir):
    from pyspark.sql import Window as W

    z = signals(spark, sf_dir).groupBy("lang", "decade").agg(F.count("*").alias("pages"))
    return z.withColumn("take", F.least(F.greatest(F.round(500 * F.col("pages") / F.sum("pages").over(W.partitionBy())), F.lit(5)), F.col("pages")).cast("long"))


@register("q_audit_crosstab", "WITH a AS (SELECT lang, source, length(text) > 2000 AS long_text, regexp_matches(text, '[0-9]') AS figures FROM documents) SELECT lang, count(*) AS pages, count(*) FILTER (long_text) AS long_texts, count(*) FILTER (figures) AS with_figures, count(*) FILTER (long_text AND figures) AS both FROM a GROUP BY 1")
def _audit(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select("lang", (F.length("text") > 2000).alias("l"), F.col("text").rlike("[0-9]").alias("f"))
    return a.groupBy("lang").agg(F.count("*").alias("pages"), F.count_if("l").alias("long_texts"), F.count_if("f").alias("with_figures"), F.count_if(F.col("l") & F.col("f")).alias("both"))


@register("q_needs_ocr", r"""WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS t FROM documents), r AS (SELECT doc_id, text, len(list_filter(t, lambda x: regexp_matches(x, '^[A-Za-z]{2,}[.,]?$'))) / nullif(len(t), 0) AS share FROM w)
SELECT CASE WHEN trim(text) = '' THEN 'empty' WHEN length(trim(text)) < 20 THEN 'short' WHEN share < 0.3 THEN 'garbled' WHEN share < 0.75 THEN 'mixed' ELSE 'fine' END AS state, count(*) AS pages FROM r GROUP BY 1""")
def _needs(spark, sf_dir):
    t = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    share = F.size(F.filter(t, lambda x: x.rlike(r"^[A-Za-z]{2,}[.,]?$"))) / F.nullif(F.size(t), F.lit(0))
    d = table(spark, sf_dir, "documents").select("text", share.alias("share"))
    state = F.when(F.trim("text") == "", "empty").when(F.length(F.trim("text")) < 20, "short").when(F.col("share") < 0.3, "garbled").when(F.col("share") < 0.75, "mixed").otherwise("fine")
    return d.groupBy(state.alias("state")).agg(F.count("*").alias("pages"))


@register("q_load_summary", "SELECT user_id % 8 AS level, count(*) AS n, round(median(value), 6) AS p50, round(max(value), 6) AS slowest, round(avg(value), 6) AS mean, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1")
def _load(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.pmod("user_id", F.lit(8)).alias("level")).agg(F.count("*").alias("n"), F.round(F.median("value"), 6).alias("p50"), F.round(F.max("value"), 6).alias("slowest"), F.round(F.avg("value"), 6).alias("mean"), F.count_if(F.col("event_type") == "error").alias("failed"))


@register("q_hourly_spread", "WITH i AS (SELECT ts AS b, ts + to_seconds(CAST(600 + user_id % 50 * 120 AS INTEGER)) AS e, value FROM events), h AS (SELECT *, unnest(generate_series(date_trunc('hour', b), date_trunc('hour', e), INTERVAL 1 HOUR)) AS hour FROM i) SELECT hour, round(sum(value * greatest(epoch(date_trunc('second', least(e, hour + INTERVAL 1 HOUR)))::BIGINT - epoch(date_trunc('second', greatest(b, hour)))::BIGINT, 0) / (epoch(date_trunc('second', e))::BIGINT - epoch(date_trunc('second', b))::BIGINT)), 4) AS value FROM h GROUP BY 1")
def _hourly(spark, sf_dir):
    i = table(spark, sf_dir, "events").select(F.col("ts").alias("b"), (F.col("ts") + F.make_interval(secs=600 + F.pmod("user_id", F.lit(50)) * 120)).alias("e"), "value")
    return X.hourly(i, "b", "e", "value").select("hour", F.round("value", 4).alias("value"))
