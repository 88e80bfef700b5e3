"""Audits, retrieval and bootstrap measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import language as G
from ..operators import audits as A
from ..registry import register
from ..sources.corpus import signals, table
from ..sources.sql import SIGNALS, TOKENS
from .scalars import BM25, _both_readings, bm25_scores

S = f"WITH {SIGNALS}"
BANDS, NAMES = (0.5, 0.9, 0.99), ("mostly other", "half Latin", "some other", "Latin")


@register("q_holdings", "WITH t AS (SELECT p_brand || p_type AS lccn, p_size FROM part) SELECT bucket, count(*) AS titles FROM (SELECT lccn, CASE WHEN max(p_size) > 45 THEN 'ours' WHEN min(p_size) < 10 THEN 'theirs_only' ELSE 'unknown' END AS bucket FROM t GROUP BY 1) GROUP BY 1")
def _holdings(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat("p_brand", "p_type").alias("lccn"), "p_size")
    return A.holdings(p.select("lccn").distinct(), p.where("p_size < 10"), p.where("p_size > 45")).groupBy("bucket").agg(F.count("*").alias("titles"))


@register("q_missing_pages", "SELECT o_orderkey AS page_id, o_orderdate::DATE AS date FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber >= 5)")
def _missing(spark, sf_dir):
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.to_date("o_orderdate").alias("date"))
    return A.missing(images, table(spark, sf_dir, "lineitem").where("l_linenumber >= 5").select(F.col("l_orderkey").alias("page_id")), ["page_id"])


@register("q_script_bands", r"WITH t AS (SELECT lang, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS a, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS l FROM documents) SELECT lang, CASE WHEN l > 0 THEN CASE WHEN a / l < 0.5 THEN 'mostly other' WHEN a / l < 0.9 THEN 'half Latin' WHEN a / l < 0.99 THEN 'some other' ELSE 'Latin' END END AS band, count(*) AS pages FROM t GROUP BY 1, 2")
def _bands(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", A.banded(A.latin_share(F.col("text")), BANDS, NAMES).alias("band")).agg(F.count("*").alias("pages"))


DRAW = "SELECT doc_id, decade, lang AS band, row_number() OVER (PARTITION BY decade, lang ORDER BY sha256('p' || doc_id), doc_id) AS k FROM s"


@register("q_pilot_trim", f"{S}, d AS (SELECT * FROM ({DRAW}) WHERE k <= 40), t AS (SELECT * FROM d ORDER BY k, decade, band LIMIT 300), c AS (SELECT *, count(*) OVER (PARTITION BY decade, band) AS kept FROM t) SELECT doc_id, decade, band, k::INT AS k, kept, round((k - 0.5) / kept, 9) AS place FROM c")
def _trim(spark, sf_dir):
    from pyspark.sql import Window as W

    d = signals(spark, sf_dir).select("doc_id", "decade", F.col("lang").alias("band"))
    d = d.withColumn("k", F.row_number().over(W.partitionBy("decade", "band").orderBy(F.sha2(F.concat(F.lit("p"), F.col("doc_id").cast("string")), 256), "doc_id"))).where("k <= 40")
    return A.trimmed(d, ["decade", "band"], 300).withColumn("place", F.round("place", 9))


@register("q_retrieval", BM25 + """, t AS (SELECT item_id, doc_id, round(s, 9) AS s FROM s), rel AS (SELECT item_id, doc_id, (doc_id // 20) % 3 AS grade FROM benchmark JOIN documents ON doc_id % 20 = item_id % 20), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS rank FROM t),
  j AS (SELECT rel.item_id, grade, rank FROM rel LEFT JOIN r ON rel.item_id = r.item_id AND rel.doc_id = r.doc_id WHERE grade > 0), i AS (SELECT item_id, sum((2 ** grade - 1) / log2(k + 1)) AS idcg FROM (SELECT item_id, grade, row_number() OVER (PARTITION BY item_id ORDER BY grade DESC) AS k FROM rel WHERE grade > 0) WHERE k <= 10 GROUP BY 1)
SELECT item_id, round(count(*) FILTER (rank <= 10) / count(*), 6) AS recall, round(coalesce(1 / min(rank), 0), 6) AS reciprocal_rank, round(coalesce(sum((2 ** grade - 1) / log2(rank + 1)) FILTER (rank <= 10), 0) / any_value(idcg), 6) AS ndcg FROM j JOIN i USING (item_id) GROUP BY 1""")
def _retrieval(spark, sf_dir):
    scores = bm25_scores(spark, sf_dir).withColumn("s", F.round("s", 9))
    items, docs = table(spark, sf_dir, "benchmark").select("item_id"), table(spark, sf_dir, "documents").select("doc_id")
    relevance = items.join(docs, F.pmod("doc_id", F.lit(20)) == F.pmod("item_id", F.lit(20))).withColumn("grade", F.pmod(F.floor(F.col("doc_id") / 20), F.lit(3)))
    return A.retrieval(scores, relevance, 10).select("item_id", *(F.round(c, 6).alias(c) for c in ("recall", "reciprocal_rank", "ndcg")))


@register("q_cluster_bootstrap", f"""{S}, c AS (SELECT row_number() OVER (ORDER BY lccn) AS i, (sum(coalesce(est_cer, 0)) - sum(coalesce(local_cer, 0))) / sum(words) AS v FROM s GROUP BY lccn), z AS (SELECT count(*) AS n, avg(v) AS mean FROM c),
  l AS (SELECT draw, slot, n FROM range(200) d(draw), z, range(1, (SELECT n FROM z) + 1) x(slot)), p AS (SELECT draw, (('0x' || substring(sha256('b1|' || draw || '|' || slot), 1, 12))::BIGINT % n) + 1 AS i FROM l), m AS (SELECT draw, avg(v) AS m FROM p JOIN c USING (i) GROUP BY 1), o AS (SELECT list(m ORDER BY m) AS m FROM m)
SELECT n, round(mean, 9) AS mean, round(o.m[5], 9) AS low, round(o.m[195], 9) AS high FROM z, o""")
def _bootstrap(spark, sf_dir):
    zero = F.lit(0.0)
    c = signals(spark, sf_dir).groupBy("lccn").agg(((F.sum(F.coalesce("est_cer", zero)) - F.sum(F.coalesce("local_cer", zero))) / F.sum("words")).alias("v"))
    return A.bootstrap(c, "v", "lccn", 200, "b1").select("n", *(F.round(x, 9).alias(x) for x in ("mean", "low", "high")))


@register("q_rate_histogram", f"{S} SELECT lang, least(floor(damage_rate * 100), 99)::INT AS bin, count(*) AS n FROM s WHERE damage_rate IS NOT NULL GROUP BY 1, 2")
def _histogram(spark, sf_dir):
    return A.histogram(signals(spark, sf_dir), "damage_rate", ["lang"])


@register("q_title_moves", f"{S}, m AS (SELECT lccn, lang || '>' || decision AS move, count(*) AS n FROM s WHERE lang IS DISTINCT FROM decision GROUP BY 1, 2) SELECT lccn, string_agg(move || '=' || n, ',' ORDER BY move) AS moves FROM m GROUP BY 1")
def _moves(spark, sf_dir):
    m = A.moves(signals(spark, sf_dir), "lccn", "lang", "decision")
    return m.select("lccn", F.array_join(F.transform(F.map_entries("moves"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("moves"))


COMMON = list(dict.fromkeys(G.FUNCTION_WORDS["en"]))
_COMMON = ", ".join(f"'{w}'" for w in COMMON)


@register("q_findability", f"WITH p AS (SELECT doc_id, list_transform({TOKENS}, lambda x: CASE WHEN length(x) > 40 THEN '_' ELSE x END) AS a FROM documents), w AS (SELECT DISTINCT doc_id, unnest(a) AS w FROM p), h AS (SELECT DISTINCT doc_id, replace(w, 'm', 'rn') AS w FROM w), c AS (SELECT doc_id, w FROM w WHERE length(w) >= 3 AND w NOT IN ({_COMMON})), n AS (SELECT c.doc_id, count(*) AS wanted, count(h.w) AS found FROM c LEFT JOIN h ON c.doc_id = h.doc_id AND c.w = h.w GROUP BY 1) SELECT doc_id, coalesce(wanted, 0)::INT AS wanted, coalesce(found, 0)::INT AS found FROM p LEFT JOIN n USING (doc_id)")
def _findability(spark, sf_dir):
    t = _both_readings(spark, sf_dir)
    wanted, found = A.findability(F.col("a"), F.col("b"), COMMON)
    return t.select("doc_id", wanted.alias("wanted"), found.alias("found"))


# Codes of the languages that a list of 1999 and its three-letter standard name differently, and names
CODES = (("ger", "deu", "German"), ("fre", "fra", "French"), ("spa", "spa", "Spanish"), ("eng", "eng", "English"), ("cze", "ces", "Czech"), ("dut", "nld", "Dutch"), ("wel", "cym", "Welsh"), ("gre", "ell", "Greek"), ("rum", "ron", "Romanian"), ("slo", "slk", "Slovak"), ("ice", "isl", "Icelandic"), ("per", "fas", "Persian"), ("chi", "zho", "Chinese"), ("baq", "eus", "Basque"), ("alb", "sqi", "Albanian"), ("arm", "hye", "Armenian"))


@register("q_language_codes", f"{S}, c(lang, iso3, name) AS (VALUES {', '.join(map(str, CODES))}) SELECT lang, iso3, name, count(*) AS pages FROM s LEFT JOIN c USING (lang) GROUP BY ALL")
def _codes(spark, sf_dir):
    c = spark.createDataFrame(list(CODES), "lang string, iso3 string, name string")  # a fixed table
    return signals(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("pages")).join(F.broadcast(c), "lang", "left").select("lang", "iso3", "name", "pages")


TAG = "'reader-' || (doc_id % 3) || '/' || (doc_id % 5) || '.1' || CASE WHEN doc_id % 2 = 0 THEN ' profile=' || source ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN ' image=sha-' || doc_id ELSE '' END"


@register("q_engine_tags", rf"WITH t AS (SELECT doc_id, {TAG} AS t FROM documents) SELECT doc_id, nullif(regexp_extract(t, '^([^/\s]+)/\S+', 1), '') AS family, nullif(regexp_extract(t, '^[^/\s]+/(\S+)', 1), '') AS version, nullif(regexp_extract(t, '(?:^|\s)profile=(\S+)', 1), '') AS profile, nullif(regexp_extract(t, '(?:^|\s)image=(\S+)', 1), '') AS image FROM t")
def _tags(spark, sf_dir):
    i = F.col("doc_id")
    whole = lambda x: x.cast("string")
    t = F.concat(F.lit("reader-"), whole(F.pmod(i, F.lit(3))), F.lit("/"), whole(F.pmod(i, F.lit(5))), F.lit(".1"), F.when(F.pmod(i, F.lit(2)) == 0, F.concat(F.lit(" profile="), "source")).otherwise(""), F.when(F.pmod(i, F.lit(7)) == 0, F.concat(F.lit(" image=sha-"), whole(i))).otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", *(c.alias(n) for n, c in A.tag(F.col("t")).items()))


@register("q_catalog_checks", "SELECT 'repeated_title' AS \"check\", count(*) AS n FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'repeated_place', count(*) FROM (SELECT n_regionkey FROM nation GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'unknown_place', count(*) FROM customer WHERE c_nationkey % 7 NOT IN (SELECT n_regionkey FROM nation)")
def _checks(spark, sf_dir):
    titles = table(spark, sf_dir, "customer").select("c_custkey", F.pmod("c_nationkey", F.lit(7)).alias("n_regionkey"))
    return A.checks(titles, table(spark, sf_dir, "nation"), "c_custkey", "n_regionkey")


@register("q_holds", "SELECT coalesce((user_id % 40)::VARCHAR, '') AS doc, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS engine, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def _holds(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(40)).alias("doc"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("engine"), "event_id")
    return A.holds(e, ["doc", "engine"], "event_id")


@register("q_reader_report", f"{S}, p AS (SELECT DISTINCT doc_id FROM s WHERE seq <= 2), r AS (SELECT doc_id, batch, est_cer FROM s WHERE est_cer IS NOT NULL) SELECT batch, coalesce(pages, 0) AS pages, (SELECT count(*) FROM p) - coalesce(pages, 0) AS missing, mean, median FROM (SELECT DISTINCT batch FROM r) LEFT JOIN (SELECT batch, count(DISTINCT doc_id) AS pages, round(avg(est_cer), 6) AS mean, round(median(est_cer), 6) AS median FROM r WHERE doc_id IN (SELECT doc_id FROM p) GROUP BY 1) USING (batch)")
def _report(spark, sf_dir):
    s = signals(spark, sf_dir)
    return A.reader_report(s.where("seq <= 2"), s.where("est_cer is not null"), "doc_id", "batch", "est_cer").withColumns({c: F.round(c, 6) for c in ("mean", "median")})
