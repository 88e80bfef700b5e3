"""Search predicates, aggregations and page lists over text pages."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.time import Buckets
from ..operators import aggregate as A
from ..operators import hits as H
from ..operators import postings as X
from ..plans.query import parse, spellings, to_column, words_of
from ..registry import register
from ..sources.corpus import fact_pages, text_pages
from ..sources.sql import FACTS, PAGES

FROM, TO = date(1850, 1, 1), date(1900, 1, 1)
MONTHS, YEARS = Buckets("month", FROM, TO), Buckets("year", FROM, TO)
HIT = "contains(words, ' this ') AND contains(words, ' from ')"

#: Query text and what it means for the oracle.
PREDICATES = {
    "term": ("than", "contains(words, ' than ')"),
    "and": ("than with", "contains(words, ' than ') AND contains(words, ' with ')"),
    "or_not": ("(than OR dans) -sur", "(contains(words, ' than ') OR contains(words, ' dans ')) AND NOT contains(words, ' sur ')"),
    "prefix": ("tionth*", "regexp_matches(words, ' tionth[^ ]* ')"),
    "wildcard": ("tions?an*", "regexp_matches(words, ' tions[^ ]an[^ ]* ')"),
    "phrase": ('"of the"', "contains(words, ' of the ')"),
    "near": ('"of was"~3', "list_bool_or(flatten(list_transform(list_filter(list_transform(tokens, lambda x, i: CASE WHEN x = 'of' THEN i END), lambda i: i IS NOT NULL), lambda i: list_transform(list_filter(list_transform(tokens, lambda x, j: CASE WHEN x = 'was' THEN j END), lambda j: j IS NOT NULL), lambda j: abs(j - i - 1) <= 3))))"),
    "ocr": ("then~ocr", "(" + " OR ".join(f"contains(words, ' {s} ')" for s in spellings("then")) + ")"),
    "fuzzy": ("thing~1", "len(list_filter(tokens, lambda x: levenshtein(x, 'thing') <= 1)) > 0"),
    "at_least": ("2 OF (than dans und this)", "(contains(words, ' than '))::INT + (contains(words, ' dans '))::INT + (contains(words, ' und '))::INT + (contains(words, ' this '))::INT >= 2"),
}

for _name, (_query, _sql) in PREDICATES.items():

    @register(f"q_match_{_name}", f"WITH {PAGES} SELECT doc_id, place_id, date FROM pg WHERE {_sql}")
    def _match(spark, sf_dir, query=_query):
        return text_pages(spark, sf_dir).where(to_column(query)).select("doc_id", "place_id", "date")


def found(spark, sf_dir):
    return text_pages(spark, sf_dir).where(to_column("this from"))


@register("q_filters", f"WITH {PAGES} SELECT doc_id, state, lccn, date, decade FROM pg WHERE {HIT} AND date BETWEEN DATE '1855-01-01' AND DATE '1889-12-31' AND decade IN (1850, 1860, 1870, 1880) AND state IN ('ASIA', 'EUROPE', 'REGION_1', 'REGION_2') OR front_page AND contains(words, ' than ') AND lccn IN ('src1', 'src9')")
def _filters(spark, sf_dir):
    p = text_pages(spark, sf_dir)
    a = to_column("this from") & F.col("date").between("1855-01-01", "1889-12-31") & F.col("decade").isin(1850, 1860, 1870, 1880) & F.col("state").isin("ASIA", "EUROPE", "REGION_1", "REGION_2")
    return p.where(a | F.col("front_page") & to_column("than") & F.col("lccn").isin("src1", "src9")).select("doc_id", "state", "lccn", "date", "decade")


@register("q_total", f"WITH {PAGES} SELECT count(*) AS hits, min(date) AS first_date, max(date) AS last_date, count(DISTINCT day) AS days FROM pg WHERE {HIT}")
def _total(spark, sf_dir):
    return A.total(found(spark, sf_dir))


@register("q_summary", f"""WITH {PAGES}, h AS (SELECT place_id, lccn, lang, year(date) - 1850 AS bucket, date FROM pg WHERE {HIT})
SELECT CASE WHEN grouping(place_id) = 0 THEN 'place' WHEN grouping(lccn) = 0 THEN 'title' WHEN grouping(lang) = 0 THEN 'language' WHEN grouping(bucket) = 0 THEN 'series' ELSE 'total' END AS kind,
  coalesce(place_id, lccn, lang, bucket::VARCHAR, '') AS key, count(*) AS hits, min(date) AS first_date, max(date) AS last_date
FROM h GROUP BY GROUPING SETS ((place_id), (lccn), (lang), (bucket), ())""")
def _summary(spark, sf_dir):
    return A.summary(found(spark, sf_dir), YEARS)


@register("q_cube_month", f"WITH {PAGES} SELECT place_id, (ym - 1850 * 12)::INT AS bucket, count(*) AS hits FROM pg WHERE {HIT} GROUP BY 1, 2")
def _cube(spark, sf_dir):
    return A.cube(found(spark, sf_dir), MONTHS)


@register("q_cube_week", f"WITH {PAGES} SELECT place_id, (date_diff('day', DATE '1850-01-03', date) // 7)::INT AS bucket, count(*) AS hits FROM pg WHERE {HIT} AND date >= DATE '1850-01-03' GROUP BY 1, 2")
def _week(spark, sf_dir):
    start = date(1850, 1, 3)
    return A.cube(found(spark, sf_dir).where(F.col("date") >= F.lit(start.isoformat()).cast("date")), Buckets("week", start, TO))


@register("q_cube_margins", f"""WITH {PAGES}, h AS (SELECT place_id, (year(date) - 1850)::INT AS bucket FROM pg WHERE {HIT})
SELECT CASE grouping(place_id, bucket) WHEN 0 THEN 'cell' WHEN 1 THEN 'place' WHEN 2 THEN 'bucket' ELSE 'total' END AS level, place_id, bucket, count(*) AS hits FROM h GROUP BY GROUPING SETS ((place_id, bucket), (place_id), (bucket), ())""")
def _margins(spark, sf_dir):
    return A.cube_with_totals(found(spark, sf_dir), YEARS)


@register("q_cube_fitted", f"WITH {PAGES} SELECT place_id, (year(date) - 1850)::INT AS bucket, count(*) AS hits FROM pg WHERE {HIT} GROUP BY 1, 2")
def _fitted(spark, sf_dir):
    return A.fitted_cube(found(spark, sf_dir), Buckets("day", FROM, TO), 25 * 60)[0]


@register("q_cube_merged", f"""WITH {PAGES}, c AS (SELECT place_id, (year(date) - 1850)::INT AS bucket, count(*) AS hits FROM pg WHERE {HIT} GROUP BY 1, 2)
SELECT place_id, list(bucket ORDER BY bucket) AS b, list(hits ORDER BY bucket) AS h FROM c GROUP BY 1""")
def _merged(spark, sf_dir):
    p = found(spark, sf_dir)
    return A.merge_cells(A.cube(p.where("batch in ('batch_0', 'batch_1')"), YEARS), A.cube(p.where("batch not in ('batch_0', 'batch_1')"), YEARS))


@register("q_series", f"""WITH {PAGES}, c AS (SELECT (ym - 1850 * 12)::INT AS bucket, count(*) AS hits FROM pg WHERE {HIT} GROUP BY 1)
SELECT s.bucket::INT AS bucket, make_date(1850 + s.bucket // 12, s.bucket % 12 + 1, 1) AS start, coalesce(hits, 0)::BIGINT AS hits FROM range(601) s(bucket) LEFT JOIN c ON c.bucket = s.bucket""")
def _series(spark, sf_dir):
    return A.series(found(spark, sf_dir), MONTHS)


@register("q_days", f"WITH {PAGES} SELECT place_id, day::INT AS day, count(*) AS hits FROM pg WHERE {HIT} AND place_id IN ('NATION_1', 'NATION_7') GROUP BY 1, 2")
def _days(spark, sf_dir):
    return A.days(found(spark, sf_dir), ["NATION_1", "NATION_7"])


@register("q_titles_ranked", f"WITH {PAGES} SELECT lccn, count(*) AS hits FROM pg WHERE {HIT} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _ranked(spark, sf_dir):
    return A.ranked(found(spark, sf_dir), "lccn", 10)


@register("q_languages", f"""WITH {PAGES}, l AS (SELECT unnest(CASE WHEN doc_id % 3 = 0 THEN list_distinct([lang, 'en']) ELSE [lang] END) AS language FROM pg WHERE {HIT}) SELECT language, count(*) AS hits FROM l GROUP BY 1""")
def _languages(spark, sf_dir):
    p = found(spark, sf_dir).withColumn("languages", F.when(F.col("doc_id") % 3 == 0, F.array("lang", F.lit("en"))).otherwise(F.array("lang")))
    return A.by_language(p, "languages")


@register("q_edges", f"""WITH {PAGES}, h AS (SELECT * FROM pg WHERE {HIT}), a AS (SELECT date, doc_id FROM h ORDER BY day, sort_key LIMIT 1), z AS (SELECT date, doc_id FROM h ORDER BY day DESC, sort_key DESC LIMIT 1)
SELECT a.date AS first_date, a.doc_id AS first_doc_id, z.date AS last_date, z.doc_id AS last_doc_id FROM a, z""")
def _edges(spark, sf_dir):
    return A.edges(found(spark, sf_dir))


@register("q_second_text_only", f"""WITH {PAGES} SELECT count(*) AS pages, count(*) FILTER (contains(replace(words, 'm', 'rn'), ' frorn ') AND NOT contains(words, ' frorn ')) AS only_second FROM pg""")
def _second(spark, sf_dir):
    p = text_pages(spark, sf_dir).withColumn("words2", F.replace("words", F.lit("m"), F.lit("rn")))
    both = to_column("frorn") | to_column("frorn", "words2")
    return p.agg(F.count("*").alias("pages"), F.count_if(both & ~to_column("frorn")).alias("only_second"))


@register("q_hits_oldest", f"WITH {PAGES} SELECT doc_id, day::INT AS day, sort_key FROM pg WHERE {HIT} ORDER BY day, sort_key, doc_id LIMIT 20")
def _oldest(spark, sf_dir):
    return H.ordered(found(spark, sf_dir), 20).select("doc_id", "day", "sort_key")


@register("q_hits_newest_offset", f"WITH {PAGES} SELECT doc_id, day::INT AS day FROM pg WHERE {HIT} ORDER BY day DESC, sort_key DESC, doc_id DESC LIMIT 10 OFFSET 15")
def _newest(spark, sf_dir):
    return H.ordered(found(spark, sf_dir), 10, True, 15).select("doc_id", "day")


@register("q_hits_keyset", f"WITH {PAGES} SELECT doc_id, day::INT AS day, sort_key FROM pg WHERE {HIT} AND (day > 60000 OR day = 60000 AND sort_key > 65536) ORDER BY day, sort_key, doc_id LIMIT 15")
def _keyset(spark, sf_dir):
    return H.ordered(found(spark, sf_dir).where(H.after(60000, 65536)), 15).select("doc_id", "day", "sort_key")


@register("q_hits_relevance", f"WITH {PAGES} SELECT doc_id, len(list_filter(tokens, lambda x: x = 'from'))::BIGINT AS score FROM pg WHERE {HIT} ORDER BY score DESC, day, sort_key, doc_id LIMIT 20")
def _relevance(spark, sf_dir):
    return H.by_relevance(found(spark, sf_dir), H.mentions(F.col("words"), "from"), 20).select("doc_id", "score")


@register("q_snippets")
def _snippets(spark, sf_dir):
    node = parse("this from")
    return H.ordered(found(spark, sf_dir), 20).select("doc_id", T.snippet_udf(words_of(node))("text").alias("snippets"))


@register("q_opening", f"WITH {PAGES}, o AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM pg) SELECT doc_id, CASE WHEN length(flat) <= 160 THEN flat ELSE CASE WHEN regexp_extract(substring(flat, 1, 161), '^(.*)\\s\\S*$', 1) = '' THEN substring(flat, 1, 160) ELSE regexp_extract(substring(flat, 1, 161), '^(.*)\\s\\S*$', 1) END || ' …' END AS opening FROM o")
def _opening(spark, sf_dir):
    return text_pages(spark, sf_dir, False).select("doc_id", T.opening(F.col("text")).alias("opening"))


@register("q_fact_cube", f"WITH {FACTS} SELECT place_id, (year(date) * 12 + month(date) - 1 - 1995 * 12)::INT AS bucket, count(*) AS hits FROM f WHERE price > 150000 GROUP BY 1, 2")
def _fact_cube(spark, sf_dir):
    return A.cube(fact_pages(spark, sf_dir).where("price > 150000"), Buckets("month", date(1995, 1, 1), date(2001, 12, 31)))


@register("q_index_terms", f"WITH {PAGES}, w AS (SELECT DISTINCT doc_id, date, unnest(list_filter(tokens, lambda x: length(x) <= 40)) AS word FROM pg) SELECT word, count(*) AS pages, min(date) AS first_date FROM w GROUP BY 1")
def _index_terms(spark, sf_dir):
    return X.postings(text_pages(spark, sf_dir)).groupBy("word").agg(F.count("*").alias("pages"), F.min("date").alias("first_date"))


@register("q_index_search", f"WITH {PAGES} SELECT doc_id, date, place_id FROM pg WHERE (contains(words, ' of the ') OR regexp_matches(words, ' tionth[^ ]* ')) AND contains(words, ' this ') AND NOT contains(words, ' sur ')")
def _index_search(spark, sf_dir):
    return X.found(X.postings(text_pages(spark, sf_dir)), parse('("of the" OR tionth*) this -sur')).select("doc_id", "date", "place_id")
