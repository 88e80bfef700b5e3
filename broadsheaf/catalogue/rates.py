"""Coverage, baselines, relative rates and the skew model."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.time import Buckets
from ..operators import aggregate as A
from ..operators import skew as S
from ..registry import register
from ..sources.corpus import fact_pages
from ..sources.sql import FACTS

YEARS = Buckets("year", date(1995, 1, 1), date(2001, 12, 31))
MONTHS = Buckets("month", date(1995, 1, 1), date(2001, 12, 31))
P = "p AS (SELECT place_id, (year(date) - 1995)::INT AS bucket, count(*) AS pages FROM f GROUP BY 1, 2)"
Hh = "h AS (SELECT place_id, (year(date) - 1995)::INT AS bucket, count(*) AS hits FROM f WHERE price > 200000 GROUP BY 1, 2)"


def pages_and_hits(spark, sf_dir, buckets=YEARS):
    f = fact_pages(spark, sf_dir)
    return A.coverage(f, buckets), A.cube(f.where("price > 200000"), buckets)


@register("q_coverage", f"WITH {FACTS}, {P} SELECT * FROM p")
def _coverage(spark, sf_dir):
    return pages_and_hits(spark, sf_dir)[0]


@register("q_baseline_scope", f"WITH {FACTS} SELECT (year(date) - 1995)::INT AS bucket, count(*) AS pages FROM f WHERE list_has_any([language_set, 'x'], ['1-URGENT', '2-HIGH']) AND state IN (SELECT r_name FROM region WHERE r_regionkey < 3) GROUP BY 1")
def _scope(spark, sf_dir):
    f = fact_pages(spark, sf_dir)
    states = spark.read.parquet(f"{sf_dir}/region.parquet").where("r_regionkey < 3").select(F.col("r_name").alias("state"))
    f = f.where(F.arrays_overlap(F.array("language_set", F.lit("x")), F.array(F.lit("1-URGENT"), F.lit("2-HIGH")))).join(F.broadcast(states), "state", "left_semi")
    return f.groupBy(YEARS.index(F.col("date")).alias("bucket")).agg(F.count("*").alias("pages"))


@register("q_relative", f"WITH {FACTS}, {P}, {Hh} SELECT place_id, bucket, coalesce(hits, 0)::BIGINT AS hits, coalesce(pages, 0)::BIGINT AS pages, CASE WHEN coalesce(pages, 0) > 0 THEN coalesce(hits, 0) / pages WHEN hits > 0 THEN 'nan'::DOUBLE ELSE 0 END AS rate FROM p FULL JOIN h USING (place_id, bucket)")
def _relative(spark, sf_dir):
    pages, hits = pages_and_hits(spark, sf_dir)
    return A.relative(hits, pages)


@register("q_title_dates", f"WITH {FACTS} SELECT lccn, count(*) AS pages, min(date) AS first_date, max(date) AS last_date FROM f GROUP BY 1")
def _titles(spark, sf_dir):
    return A.title_dates(fact_pages(spark, sf_dir))


@register("q_language_sets", f"WITH {FACTS} SELECT language_set, place_id, count(*) AS pages, count(*) FILTER (price > 200000) AS hits FROM f GROUP BY 1, 2")
def _sets(spark, sf_dir):
    return fact_pages(spark, sf_dir).groupBy("language_set", "place_id").agg(F.count("*").alias("pages"), F.count_if(F.col("price") > 200000).alias("hits"))


REFERENCE = f"""WITH {FACTS}, {P}, {Hh}, n AS (SELECT bucket, sum(pages) AS np FROM p GROUP BY 1), m AS (SELECT bucket, sum(hits) AS nh FROM h GROUP BY 1),
c AS (SELECT place_id, bucket, coalesce(hits, 0) AS hits, pages, np, coalesce(nh, 0) AS nh FROM p LEFT JOIN h USING (place_id, bucket) JOIN n USING (bucket) LEFT JOIN m USING (bucket)),
r AS (SELECT *, CASE WHEN np = pages THEN NULL WHEN nh = hits AND hits > 0 THEN 0.5 / (np - pages) ELSE (nh - hits)::DOUBLE / (np - pages) END AS reference FROM c)"""


@register("q_reference_rate", REFERENCE + " SELECT place_id, bucket, hits::BIGINT AS hits, pages::BIGINT AS pages, round(reference, 10) AS reference FROM r")
def _reference(spark, sf_dir):
    pages, hits = pages_and_hits(spark, sf_dir)
    return S.reference_rates(hits, pages).select("place_id", "bucket", "hits", "pages", F.round("reference", 10).alias("reference"))


@register("q_place_counts", REFERENCE + " SELECT place_id, sum(hits)::BIGINT AS observed, round(sum(pages * reference), 6) AS expected FROM r WHERE reference IS NOT NULL GROUP BY 1")
def _counts(spark, sf_dir):
    pages, hits = pages_and_hits(spark, sf_dir)
    return S.place_counts(S.reference_rates(hits, pages), "place_id").withColumn("expected", F.round("expected", 6))


@register("q_skew_scores")
def _scores(spark, sf_dir):
    pages, hits = pages_and_hits(spark, sf_dir, MONTHS)
    return S.score(S.reference_rates(hits, pages), MONTHS)


@register("q_skew_states")
def _states(spark, sf_dir):
    pages, hits = pages_and_hits(spark, sf_dir, MONTHS)
    state = fact_pages(spark, sf_dir).select("place_id", "state").distinct()
    rates = S.reference_rates(hits, pages)
    return S.score_groups(rates, state, "state", MONTHS)
