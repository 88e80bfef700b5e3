"""Several readings of a page, scripts, comparisons by year, write-once lists, picture boxes and views."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import readings as R
from ..functions import scripts as S
from ..operators import audits as A
from ..registry import register
from ..sources.corpus import create_views, dealt, signals, table, text_pages
from ..sources.sql import PAGES, SIGNALS, TOKENS

TOP = 50


def _three(spark, sf_dir):
    """Whole texts as three readers have them."""
    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", F.replace("text", F.lit("m"), F.lit("rn")).alias("b"), F.replace("text", F.lit("e"), F.lit("c")).alias("c"))


READERS = ("text", "b", "c")


# alignments of whole texts are beyond SQL: tests by brute force
@register("q_consensus")
def _consensus(spark, sf_dir):
    x = _three(spark, sf_dir).select("doc_id", R.consensus_of(*map(F.col, READERS)).alias("x"))
    per = x.select("doc_id", "x.words", F.posexplode(F.arrays_zip("x.own", "x.held")).alias("reader", "r"))
    return per.select("doc_id", "reader", F.col("r.own").alias("own"), F.col("r.held").alias("held"), "words", F.round(F.try_divide("r.held", "words"), 9).alias("completeness"), F.round(F.try_divide("r.held", "r.own"), 9).alias("precision"))


@register("q_confusions")
def _confusions(spark, sf_dir):
    n = R.confusions_of(_three(spark, sf_dir), *map(F.col, READERS))
    order = F.row_number().over(W.partitionBy("reader").orderBy(F.desc("n"), "kind", "was", "now"))
    return n.withColumn("rank", order).where(F.col("rank") <= TOP)


@register("q_text_agreement")
def _agreement(spark, sf_dir):
    d = dealt(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("text").alias("a"), F.replace("text", F.lit("m"), F.lit("rn")).alias("b"))
    return d.select("doc_id", R.agreement_of(F.col("a"), F.col("b")).alias("x")).select("doc_id", "x.*")


@register("q_latin_text", r"WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(replace(replace(text, ' of ', '日本 '), 'Ａ', 'A'), chr(10)), lambda l: array_to_string(list_transform(list_filter(regexp_extract_all(l, '[\x20-\x7E\x{00A0}-\x{024F}\x{2010}-\x{205E}]+'), lambda r: length(regexp_replace(r, '[^\p{L}]', '', 'g')) >= 2), lambda r: trim(r)), ' ')), lambda l: l <> '') AS t FROM documents) SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(array_to_string(t, chr(10)), '(\p{L})-[ \t]*\n\s*(\p{L})', '\1\2', 'g'), '[^\S\n]+', ' ', 'g'), ' ?\n\s*', chr(10), 'g')) AS text FROM l")
def _latin(spark, sf_dir):
    t = F.replace("text", F.lit(" of "), F.lit("日本 "))
    return table(spark, sf_dir, "documents").select("doc_id", S.latin_text(t).alias("text"))


@register("q_japanese_words", f"SELECT doc_id, list_filter({TOKENS}, lambda x: length(x) <= 40) AS words FROM (SELECT doc_id, replace(text, ' of ', ' 日 本 の ') AS text FROM documents)")
def _japanese(spark, sf_dir):
    t = F.replace("text", F.lit(" of "), F.lit(" 日本の"))
    return table(spark, sf_dir, "documents").select("doc_id", S.japanese_words(t).alias("words"))


TERMS = ["the", "from", "time", "more"]


@register("q_year_recall", f"WITH {PAGES}, b AS (SELECT year, coalesce(words, '') AS a, replace(coalesce(words, ''), 'm', 'rn') AS b FROM pg WHERE doc_id % 3 <> 0), t AS (SELECT unnest({TERMS}) AS term), c AS (SELECT year, term, contains(a, ' ' || term || ' ') AS a, contains(b, ' ' || term || ' ') AS b FROM b, t) SELECT year, term, count_if(a)::BIGINT AS ours, count_if(b)::BIGINT AS theirs, count_if(a OR b)::BIGINT AS either, count_if(b AND NOT a)::BIGINT AS only_theirs, round(CASE WHEN count_if(a) > 0 THEN count_if(b AND NOT a) / count_if(a) END, 9) AS gain FROM c GROUP BY 1, 2")
def _recall(spark, sf_dir):
    p = text_pages(spark, sf_dir).where(F.pmod("doc_id", F.lit(3)) != 0).withColumn("theirs", F.replace("words", F.lit("m"), F.lit("rn")))
    return A.year_recall(p, TERMS, "words", "theirs").withColumn("gain", F.round("gain", 9))


@register("q_year_summary", f"WITH {PAGES}, b AS (SELECT year, doc_id % 3 <> 0 AS shared, length(text) AS a, length(replace(text, 'm', 'rn')) AS b FROM pg) SELECT year, count(*) AS pages, count_if(shared)::BIGINT AS shared, round(count_if(shared) / count(*), 9) AS share, median(CASE WHEN shared THEN a END) AS chars_ours, median(CASE WHEN shared THEN b END) AS chars_theirs, round(sum(CASE WHEN shared THEN b END) / nullif(sum(CASE WHEN shared THEN a END), 0), 9) AS chars_ratio FROM b GROUP BY 1")
def _summary(spark, sf_dir):
    p = text_pages(spark, sf_dir, False)
    theirs = p.where(F.pmod("doc_id", F.lit(3)) != 0).select("doc_id", F.length(F.replace("text", F.lit("m"), F.lit("rn"))).alias("chars"))
    s = A.year_summary(p.select("doc_id", "year", F.length("text").alias("chars")), theirs, "doc_id", ["chars"])
    return s.withColumns({c: F.round(c, 9) for c in ("share", "chars_ratio")})


@register("q_write_once", "WITH o AS (SELECT event_id, user_id AS job, CASE WHEN event_type = 'error' THEN ts END AS r FROM events), n AS (SELECT event_id, CASE WHEN event_id % 10 = 1 THEN job + 1 ELSE job END AS job, CASE WHEN event_id % 10 IN (1, 2) THEN TIMESTAMP '2030-01-01' ELSE r END AS r FROM o WHERE event_id % 10 <> 0), j AS (SELECT o.event_id, CASE WHEN n.event_id IS NULL THEN 'deleted' WHEN o.r IS NOT NULL AND (o.r IS DISTINCT FROM n.r OR o.job IS DISTINCT FROM n.job) THEN 'already released' WHEN o.job IS DISTINCT FROM n.job THEN 'changed' END AS why FROM o LEFT JOIN n USING (event_id)) SELECT * FROM j WHERE why IS NOT NULL")
def _guard(spark, sf_dir):
    o = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("job"), F.when(F.col("event_type") == "error", F.col("ts")).alias("released_at"))
    k = F.pmod("event_id", F.lit(10))
    late = F.lit("2030-01-01").cast(o.schema["released_at"].dataType)
    n = o.where(k != 0).withColumns({"job": F.when(k == 1, F.col("job") + 1).otherwise(F.col("job")), "released_at": F.when(k.isin(1, 2), late).otherwise(F.col("released_at"))})
    return A.write_once(o, n, "event_id", "released_at")


TILE = "https://tile.loc.gov/image-services/iiif/service:ndnp:dlc:batch_dlc_ver0"


@register("q_crop_urls", f"SELECT doc_id, CASE WHEN doc_id % 11 > 0 AND doc_id % 6 > 0 THEN '{TILE}' || (doc_id % 7) || ':data:sn' || lpad((doc_id % 100000000)::VARCHAR, 8, '0') || ':' || CASE WHEN doc_id % 5 = 0 THEN 'no:' ELSE '' END || 'reel1:1901010201:' || lpad((doc_id % 9000)::VARCHAR, 4, '0') || '/pct:1.5,2,3,4/full/0/default.jpg' END AS url FROM documents")
def _crops(spark, sf_dir):
    mod = lambda n: F.pmod("doc_id", F.lit(n))
    whole = lambda c, n: F.lpad(c.cast("string"), n, "0")
    old = F.concat(
        F.lit("https://chroniclingamerica.loc.gov/iiif/2/dlc_ver0"), mod(7).cast("string"), F.lit("%2Fdata%2Fsn"), whole(mod(100000000), 8), F.lit("%2F"), F.when(mod(5) == 0, "no%2F").otherwise(""),
        F.lit("reel1%2F19010102"), F.when(mod(6) == 0, "00").otherwise("01"), F.lit("%2F"), whole(mod(9000), 4), F.lit(".jp2/pct:1.5,2,"), F.when(mod(11) == 0, "").otherwise("3"), F.lit(",4/full/0/default.jpg"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", A.rewritten_crop(old).alias("url"))


@register("q_picture_agreement", "WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity >= 5 AS has, l_tax <> 0.05 AS same, l_discount * 500 AS dx FROM lineitem), i AS (SELECT *, (80 - dx) * 60 / (9600 - (80 - dx) * 60) AS iou FROM b), c AS (SELECT *, max(CASE WHEN has AND same THEN iou END) OVER (PARTITION BY l_orderkey, l_linenumber) AS cover FROM i), m AS (SELECT count(*) AS n_gold, count_if(has)::BIGINT AS n_found, count_if(has AND same AND iou >= 0.5)::BIGINT AS n_matched, sum(coalesce(cover, 0)) AS best FROM c) SELECT n_gold, n_found, n_matched, n_gold - n_matched AS lost, n_found - n_matched AS surplus, round(best / n_gold, 6) AS mean_best, round(n_matched / n_found, 6) AS \"precision\", round(n_matched / n_gold, 6) AS recall FROM m")
def _pictures(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    box = lambda x: (x.cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(80.0).alias("w"), F.lit(60.0).alias("h"))
    place, own = F.col("l_linenumber") * 200, F.col("l_linenumber").cast("string")
    gold = F.collect_list(F.struct(own.alias("kind"), *box(place)))
    found = F.collect_list(F.when(F.col("l_quantity") >= 5, F.struct(F.when(F.col("l_tax") != 0.05, own).otherwise("other").alias("kind"), *box(place + F.col("l_discount") * 500), F.col("l_extendedprice").cast("double").alias("score"))))
    pages = li.groupBy("l_orderkey").agg(gold.alias("gold"), found.alias("found"))  # a page's boxes
    return A.picture_agreement(pages, "gold", "found").withColumns({c: F.round(c, 6) for c in ("mean_best", "precision", "recall")})


@register("q_views", f"WITH {SIGNALS} SELECT lang, count(*) AS pages, count(damage_rate) AS scored FROM s GROUP BY 1")
def _views(spark, sf_dir):
    create_views(spark, page_signals=signals(spark, sf_dir))
    return spark.sql("SELECT lang, count(*) AS pages, count(damage_rate) AS scored FROM page_signals GROUP BY lang")


@register("q_error_totals", "WITH p AS (SELECT p_brand, p_type, levenshtein(p_name, replace(replace(p_name, 'r', 'tt'), 'l', '')) AS e, length(p_name) AS n FROM part), r AS (SELECT *, CASE WHEN n > 0 THEN e / n WHEN e > 0 THEN 1.0 ELSE 0.0 END AS r FROM p) SELECT p_brand, p_type, count(e) AS n, round(CASE WHEN sum(n) > 0 THEN sum(e) / sum(n) END, 9) AS together, round(avg(r), 9) AS mean, round(median(r), 9) AS median FROM r GROUP BY 1, 2")
def _totals(spark, sf_dir):
    read = F.replace(F.replace("p_name", F.lit("r"), F.lit("tt")), F.lit("l"), F.lit(""))
    p = table(spark, sf_dir, "part").select("p_brand", "p_type", F.levenshtein(F.col("p_name"), read).alias("e"), F.length("p_name").alias("n"))
    return A.error_totals(p, ["p_brand", "p_type"], "e", "n").withColumns({c: F.round(c, 9) for c in ("together", "mean", "median")})
