"""Window functions over cubes, signals and events."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.time import Buckets
from ..operators import aggregate as A
from ..operators import quality as Q
from ..operators import windows as V
from ..registry import register
from ..sources.corpus import fact_pages, signals, table
from ..sources.sql import FACTS, SIGNALS

YEARS = Buckets("year", date(1995, 1, 1), date(2001, 12, 31))

def cube(spark, sf_dir):
    return A.cube(fact_pages(spark, sf_dir).where("price > 100000"), YEARS)


C = f"WITH {FACTS}, c AS (SELECT place_id, (year(date) - 1995)::INT AS bucket, count(*) AS hits FROM f WHERE price > 100000 GROUP BY 1, 2)"


@register("q_dense_cube", C + " SELECT p.place_id, b::INT AS bucket, coalesce(hits, 0)::BIGINT AS hits FROM (SELECT DISTINCT place_id FROM c) p CROSS JOIN range(7) r(b) LEFT JOIN c ON c.place_id = p.place_id AND c.bucket = b")
def _dense(spark, sf_dir):
    return V.dense(cube(spark, sf_dir), len(YEARS))


@register("q_prefix_sums", C + " SELECT *, sum(hits) OVER (PARTITION BY place_id ORDER BY bucket)::BIGINT AS cumulative FROM c")
def _prefix(spark, sf_dir):
    return V.prefix_sums(cube(spark, sf_dir))


@register("q_trailing", C + ' SELECT *, sum(hits) OVER (PARTITION BY place_id ORDER BY bucket RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)::BIGINT AS "window" FROM c')
def _trailing(spark, sf_dir):
    return V.trailing(cube(spark, sf_dir), 3)


@register("q_quantile_bucket", C + ", w AS (SELECT *, sum(hits) OVER (PARTITION BY place_id ORDER BY bucket) AS c, sum(hits) OVER (PARTITION BY place_id) AS t FROM c) SELECT place_id, min(bucket) AS bucket FROM w WHERE c >= 0.5 * t GROUP BY 1")
def _quantile(spark, sf_dir):
    return V.quantile_bucket(cube(spark, sf_dir), 0.5)


STATE = f"WITH {FACTS}, g AS (SELECT state, (year(date) - 1995)::INT AS bucket, count(*) AS pages, count(*) FILTER (price > 250000) AS hits FROM f GROUP BY 1, 2), w AS (SELECT state, bucket, sum(hits) OVER o AS hits, sum(pages) OVER o AS pages FROM g WINDOW o AS (PARTITION BY state ORDER BY bucket RANGE BETWEEN 2 PRECEDING AND CURRENT ROW))"


def state_rates(spark, sf_dir):
    g = fact_pages(spark, sf_dir).groupBy("state", YEARS.index(F.col("date")).alias("bucket")).agg(F.count("*").alias("pages"), F.count_if(F.col("price") > 250000).alias("hits"))
    o = W.partitionBy("state").orderBy("bucket").rangeBetween(-2, 0)
    w = g.select("state", "bucket", F.sum("hits").over(o).alias("hits"), F.sum("pages").over(o).alias("pages"))
    return w.withColumn("rate", F.round(F.when(F.col("pages") > 0, 1000 * F.col("hits") / F.col("pages")), 6))


@register("q_state_windows", STATE + " SELECT state, bucket, hits::BIGINT AS hits, pages::BIGINT AS pages, round(1000 * hits / pages, 6) AS rate FROM w")
def _states(spark, sf_dir):
    return state_rates(spark, sf_dir)


@register("q_state_breaks", STATE + ", r AS (SELECT round(1000 * hits / pages, 6) AS rate FROM w WHERE hits > 0) SELECT " + ", ".join(f"round(quantile_cont(rate, {p}), 6) AS p{round(p * 100)}" for p in (0.2, 0.4, 0.6, 0.8)) + " FROM r")
def _breaks(spark, sf_dir):
    b = V.breaks(state_rates(spark, sf_dir), "rate")
    return b.select(*(F.round(c, 6).alias(c) for c in b.columns))


@register("q_latest_per_user", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def _latest(spark, sf_dir):
    return Q.latest_per(table(spark, sf_dir, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


@register("q_ntile", f"WITH {SIGNALS} SELECT doc_id, ntile(10) OVER (ORDER BY damage_rate DESC, doc_id)::INT AS tenth FROM s WHERE damage_rate IS NOT NULL AND lang = 'ger'")
def _ntile(spark, sf_dir):
    rows = signals(spark, sf_dir).where("damage_rate is not null and lang = 'ger'").select("doc_id", "damage_rate")
    return V.tiled(rows, 10, "tenth", -F.col("damage_rate"), F.col("doc_id")).select("doc_id", "tenth")


@register("q_average_ranks", f"WITH {SIGNALS} SELECT doc_id, rank() OVER (PARTITION BY lccn ORDER BY damage_rate) + (count(*) OVER (PARTITION BY lccn, damage_rate) - 1) / 2 AS r FROM s WHERE damage_rate IS NOT NULL")
def _ranks(spark, sf_dir):
    s = signals(spark, sf_dir).where("damage_rate is not null")
    return s.select("doc_id", (F.rank().over(W.partitionBy("lccn").orderBy("damage_rate")) + (F.count("*").over(W.partitionBy("lccn", "damage_rate")) - 1) / F.lit(2.0)).alias("r"))


@register("q_shares", f"WITH {SIGNALS}, g AS (SELECT lang, decade, count(*) AS pages FROM s GROUP BY 1, 2) SELECT lang, decade, pages, round(pages / sum(pages) OVER (PARTITION BY lang), 6) AS share, round(pages / sum(pages) OVER (), 6) AS of_all FROM g")
def _shares(spark, sf_dir):
    g = signals(spark, sf_dir).groupBy("lang", "decade").agg(F.count("*").alias("pages"))
    return g.select("lang", "decade", "pages", F.round(V.share("pages", "lang"), 6).alias("share"), F.round(V.share("pages"), 6).alias("of_all"))


@register("q_top_per_group", f"WITH {SIGNALS}, r AS (SELECT lang, doc_id, damage_rate, row_number() OVER (PARTITION BY lang ORDER BY damage_rate DESC, doc_id) AS n FROM s WHERE damage_rate IS NOT NULL) SELECT lang, doc_id, n::INT AS n FROM r WHERE n <= 25")
def _top(spark, sf_dir):
    s = signals(spark, sf_dir).where("damage_rate is not null").withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("damage_rate"), "doc_id")))
    return s.where("n <= 25").select("lang", "doc_id", "n")


@register("q_hash_sample", f"WITH {SIGNALS}, r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('review' || doc_id), doc_id) AS k FROM s) SELECT lang, doc_id, k::INT AS k FROM r WHERE k <= 40")
def _sample(spark, sf_dir):
    s = signals(spark, sf_dir).withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(Q.seeded("review", "doc_id"), "doc_id")))
    return s.where("k <= 40").select("lang", "doc_id", "k")


@register("q_sha_review_order", f"WITH {SIGNALS} SELECT doc_id, sha256('seed' || doc_id) AS h FROM s ORDER BY h LIMIT 100")
def _sha(spark, sf_dir):
    return signals(spark, sf_dir).select("doc_id", F.sha2(F.concat(F.lit("seed"), F.col("doc_id").cast("string")), 256).alias("h")).orderBy("h").limit(100)
