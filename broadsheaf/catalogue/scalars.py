"""Text, distance, date and retrieval functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import distance as X
from ..functions import language as G
from ..functions import text as T
from ..functions import time as D
from ..registry import register
from ..sources.corpus import dealt, fact_pages, table, text_pages
from ..sources.sql import FACTS, PAGES


@register("q_tokens", f"WITH {PAGES} SELECT doc_id, len(list_filter(tokens, lambda x: length(x) <= 40))::INT AS n, words FROM pg")
def _tokens(spark, sf_dir):
    return text_pages(spark, sf_dir).select("doc_id", F.size(T.tokens(F.col("text"))).alias("n"), "words")


@register("q_exact_words", f"WITH {PAGES} SELECT doc_id, words FROM pg")
def _exact(spark, sf_dir):
    return text_pages(spark, sf_dir, False).select("doc_id", T.exact_words(F.col("text")).alias("words"))


@register("q_text_status", r"WITH t AS (SELECT regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents) SELECT CASE WHEN t = '' THEN 'empty' WHEN length(t) < 20 THEN 'short' ELSE 'ok' END AS status, count(*) AS pages FROM t GROUP BY 1")
def _status(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(T.text_status(F.col("text")).alias("status"))
    return d.groupBy("status").agg(F.count("*").alias("pages"))


@register("q_rejoined", r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(text, 'tion', 'ti-' || chr(10) || 'on'), '(\p{L})-[ \t]*\n\s*(\p{L})', '\1\2', 'g'), '[^\S\n]+', ' ', 'g'), ' ?\n\s*', chr(10), 'g')) AS text FROM documents")
def _rejoined(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.rejoined(F.replace("text", F.lit("tion"), F.lit("ti-\non"))).alias("text"))


@register("q_normalised")
def _normalised(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalised(F.col("text")).alias("text"))


@register("q_common_grams", f"WITH {PAGES} SELECT doc_id, array_to_string(list_transform(list_zip(tokens, tokens[2:]), lambda p: coalesce(p[1] || '_' || p[2], '_')), ' ') AS pairs FROM pg WHERE len(tokens) > 1")
def _grams(spark, sf_dir):
    t = text_pages(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("t")).where(F.size("t") > 1)
    return t.select("doc_id", F.array_join(F.zip_with("t", F.slice("t", F.lit(2), F.size("t")), lambda a, b: F.coalesce(F.concat(a, F.lit("_"), b), F.lit("_"))), " ").alias("pairs"))


@register("q_days_months", f"WITH {FACTS} SELECT page_id, date_diff('day', DATE '1700-01-01', date)::INT AS day, (year(date) * 12 + month(date) - 1)::INT AS ym, make_date(year(date), month(date), 1) AS first, greatest((year(date) // 10) * 10, 1820)::INT AS decade FROM f")
def _dates(spark, sf_dir):
    f = fact_pages(spark, sf_dir).select("page_id", "date", D.ym_number(F.col("date")).cast("int").alias("ym"))
    return f.select("page_id", D.day_number(F.col("date")).alias("day"), "ym", D.date_of_ym(F.col("ym")).alias("first"), D.partition_decade(F.col("date")).alias("decade"))


@register("q_page_ids", f"WITH {PAGES}, k AS (SELECT lccn || '_' || date || '_ed-' || edition || '_seq-' || seq AS id FROM pg) SELECT id, split_part(id, '_', 1) AS lccn, split_part(id, '_', 2)::DATE AS date, regexp_extract(id, 'seq-(\\d+)', 1)::INT AS seq, 'https://pages.example/' || split_part(id, '_', 1) || '?date=' || split_part(id, '_', 2) AS url, sha256(id) AS digest FROM k")
def _ids(spark, sf_dir):
    k = text_pages(spark, sf_dir, False).select(F.concat_ws("_", "lccn", F.col("date").cast("string"), F.concat(F.lit("ed-"), F.col("edition").cast("string")), F.concat(F.lit("seq-"), F.col("seq").cast("string"))).alias("id"))
    parts = F.split("id", "_")
    return k.select("id", parts[0].alias("lccn"), parts[1].cast("date").alias("date"), F.regexp_extract("id", r"seq-(\d+)", 1).cast("int").alias("seq"), F.concat(F.lit("https://pages.example/"), parts[0], F.lit("?date="), F.url_encode(parts[1])).alias("url"), F.sha2("id", 256).alias("digest"))


@register("q_batch_versions", "SELECT regexp_extract(b, '^(.*)_ver(\\d+)$', 1) AS name, regexp_extract(b, '^(.*)_ver(\\d+)$', 2)::SMALLINT AS version FROM (SELECT source || '_acacia_ver' || lpad((doc_id % 7)::VARCHAR, 2, '0') AS b FROM documents)")
def _batches(spark, sf_dir):
    b = F.concat("source", F.lit("_acacia_ver"), F.lpad(F.pmod("doc_id", F.lit(7)).cast("string"), 2, "0"))
    return table(spark, sf_dir, "documents").select(b.alias("b")).select(F.regexp_extract("b", r"^(.*)_ver(\d+)$", 1).alias("name"), F.regexp_extract("b", r"^(.*)_ver(\d+)$", 2).cast("smallint").alias("version"))


# both compare whole texts, which the SQL engine is too slow for: tests by brute force
@register("q_pair_metrics")
def _pairs(spark, sf_dir):
    p = dealt(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("text").alias("a"), F.replace("text", F.lit("m"), F.lit("rn")).alias("b"))
    p = p.withColumn("e", X.whole_levenshtein(F.col("a"), F.col("b")))
    return p.select("doc_id", *(F.round(c, 9).alias(n) for n, c in X.pair_metrics(F.col("a"), F.col("b"), F.col("e")).items()))


@register("q_hat3")
def _hat(spark, sf_dir):
    p = dealt(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("text").alias("a"), F.replace("text", F.lit("m"), F.lit("rn")).alias("b"), F.replace("text", F.lit("e"), F.lit("c")).alias("c"))
    n = F.greatest(F.length("a"), F.lit(1))
    d = p.select("doc_id", *((X.whole_levenshtein(F.col(x), F.col(y)) / n).alias(x + y) for x, y in ("ab", "ac", "bc")))
    return d.select("doc_id", *(F.round(c, 9).alias(k) for k, c in X.hat3(F.col("ab"), F.col("ac"), F.col("bc")).items()))


SECOND = "list_transform(tokens, lambda x: replace(x, 'm', 'rn'))"


def _both_readings(spark, sf_dir):
    """All words of each page, and the same by a second reading."""
    t = text_pages(spark, sf_dir).select("doc_id", F.filter(F.split("words", " "), lambda x: x != "").alias("a"))
    return t.withColumn("b", F.transform("a", lambda x: F.replace(x, F.lit("m"), F.lit("rn"))))


@register("q_dice", f"WITH {PAGES}, t AS (SELECT doc_id, list_transform(tokens, lambda x: CASE WHEN length(x) > 40 THEN '_' ELSE x END) AS tokens FROM pg), u AS (SELECT doc_id, tokens AS a, {SECOND} AS b FROM t), w AS (SELECT doc_id, unnest(a) AS w, 1 AS x, 0 AS y FROM u UNION ALL SELECT doc_id, unnest(b), 0, 1 FROM u), c AS (SELECT doc_id, sum(c) AS c FROM (SELECT doc_id, least(sum(x), sum(y)) AS c FROM w GROUP BY doc_id, w) GROUP BY 1) SELECT u.doc_id, round(CASE WHEN len(a) + len(b) > 0 THEN 2 * coalesce(c, 0) / (len(a) + len(b)) ELSE 1 END, 9) AS dice FROM u LEFT JOIN c USING (doc_id)")
def _dice(spark, sf_dir):
    return _both_readings(spark, sf_dir).select("doc_id", F.round(X.whole_dice(F.col("a"), F.col("b")), 9).alias("dice"))


FW = ", ".join(f"('{c}', '{w}')" for c, ws in G.FUNCTION_WORDS.items() for w in dict.fromkeys(ws))


@register("q_page_language", f"""WITH {PAGES}, fw(language, word) AS (VALUES {FW}), sh AS (SELECT word, count(*) AS n FROM fw GROUP BY 1), w AS (SELECT doc_id, unnest(list_filter(tokens, lambda x: length(x) <= 40)) AS word FROM pg), c AS (SELECT doc_id, word, count(*) AS c FROM w GROUP BY 1, 2),
  h AS (SELECT doc_id, language, sum(c) AS c, count(*) AS d, sum(CASE WHEN n = 1 THEN c ELSE 0 END) AS own FROM c JOIN fw USING (word) JOIN sh USING (word) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER o AS k, lead(own) OVER o AS next FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY c DESC, language)), z AS (SELECT doc_id, len(list_filter(tokens, lambda x: length(x) <= 40)) AS words FROM pg)
SELECT doc_id, words::INT AS words, CASE WHEN words >= 20 AND c >= 0.1 * words AND d >= 10 AND own >= 2 * coalesce(next, 0) THEN language ELSE 'und' END AS language FROM z LEFT JOIN (FROM r WHERE k = 1) USING (doc_id)""")
def _language(spark, sf_dir):
    p = text_pages(spark, sf_dir).select("doc_id", F.filter(F.split("words", " "), lambda x: (x != "") & (x != "_")).alias("t"))
    return G.detect(p, "t")


_REAL = {w for ws in G.FUNCTION_WORDS.values() for w in ws}
_TOP = G.FUNCTION_WORDS["en"][:20]
_MODEL = ", ".join(f"('{w}', 1, 0)" for w in _TOP) + ", " + ", ".join(f"('{w}', 0, 1)" for w in G.near_misses(_TOP, _REAL))


@register("q_damage", f"""WITH {PAGES}, md(w, x, y) AS (VALUES {_MODEL}), e AS (SELECT doc_id, list_filter(tokens, lambda x: length(x) <= 40) AS t FROM pg WHERE lang = 'en'), c AS (SELECT doc_id, sum(x) AS head, sum(y) AS near FROM (SELECT doc_id, unnest(t) AS w FROM e) JOIN md USING (w) GROUP BY 1)
SELECT doc_id, coalesce(head, 0)::BIGINT AS head, coalesce(near, 0)::BIGINT AS near, round(near / (near + head), 9) AS damage FROM e LEFT JOIN c USING (doc_id)""")
def _damage(spark, sf_dir):
    p = text_pages(spark, sf_dir).where("lang = 'en'").select("doc_id", F.filter(F.split("words", " "), lambda x: (x != "") & (x != "_")).alias("t"))
    return G.damage(p, "t", "en").withColumn("damage", F.round("damage", 9))


BM25 = f"""WITH {PAGES}, q AS (SELECT item_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) > 3))) AS w FROM benchmark), d AS (SELECT doc_id, list_filter(tokens, lambda x: length(x) <= 40) AS t FROM pg), tf AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS w FROM d) WHERE w IN (SELECT w FROM q) GROUP BY 1, 2),
  df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1), z AS (SELECT count(*) AS n, avg(len(t)) AS m FROM d), s AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / m))) AS s FROM q JOIN tf USING (w) JOIN df USING (w) JOIN d USING (doc_id), z GROUP BY 1, 2)"""


def bm25_scores(spark, sf_dir):
    """Score of every page that has a word of the item, by item."""
    q = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x) > 3))).alias("w"))
    d = text_pages(spark, sf_dir).select("doc_id", F.filter(F.split("words", " "), lambda x: (x != "") & (x != "_")).alias("t"))
    some = q.select("w").distinct()
    tf = d.select("doc_id", F.size("t").alias("size"), F.explode("t").alias("w")).join(some, "w", "left_semi").groupBy("doc_id", "size", "w").agg(F.count("*").alias("tf"))
    df = tf.groupBy("w").agg(F.count("*").alias("df"))
    z = d.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("m"))
    return q.join(tf, "w").join(df, "w").crossJoin(F.broadcast(z)).groupBy("item_id", "doc_id").agg(F.sum(X.bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("size"), F.col("m"))).alias("s"))  # one row of totals


@register("q_bm25", BM25 + ", r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM s) SELECT item_id, rank::INT AS rank, doc_id, round(s, 6) AS score FROM r WHERE rank <= 5")
def _bm25(spark, sf_dir):
    r = bm25_scores(spark, sf_dir).withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc(F.round("s", 9)), "doc_id")))
    return r.where("rank <= 5").select("item_id", "rank", "doc_id", F.round("s", 6).alias("score"))


@register("q_haversine", "WITH p AS (SELECT n_nationkey AS k, n_nationkey * 3.5 - 40 AS lat, n_nationkey * 7.25 - 90 AS lon FROM nation) SELECT a.k AS a, b.k AS b, round(2 * 6371 * asin(sqrt(least(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2), 1))), 6) AS km FROM p a JOIN p b ON b.k = a.k + 1")
def _haversine(spark, sf_dir):
    from ..operators.extras import haversine

    p = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 3.5 - 40).alias("lat"), (F.col("n_nationkey") * 7.25 - 90).alias("lon"))
    a, b = p.alias("x"), p.alias("y")
    return a.join(b, F.col("y.k") == F.col("x.k") + 1).select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), F.round(haversine(F.col("x.lat"), F.col("x.lon"), F.col("y.lat"), F.col("y.lon")), 6).alias("km"))


@register("q_kept_lost_ngrams", f"WITH {PAGES}, t AS (SELECT doc_id, list_transform(tokens, lambda x: CASE WHEN length(x) > 40 THEN '_' ELSE x END) AS tokens FROM pg), u AS (SELECT doc_id, tokens AS a, {SECOND} AS b FROM t), g AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]))) AS v FROM u), h AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(b)), lambda i: b[i] || ' ' || b[i + 1]))) AS v FROM u), n AS (SELECT g.doc_id, count(h.v) AS kept, count(*) - count(h.v) AS lost FROM g LEFT JOIN h ON g.doc_id = h.doc_id AND g.v = h.v GROUP BY 1) SELECT doc_id, coalesce(kept, 0)::INT AS kept, coalesce(lost, 0)::INT AS lost FROM u LEFT JOIN n USING (doc_id)")
def _ngrams(spark, sf_dir):
    two = lambda c: F.array_distinct(F.filter(F.zip_with(c, F.slice(c, F.lit(2), F.size(c)), lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull()))
    g = _both_readings(spark, sf_dir).select("doc_id", two("a").alias("x"), two("b").alias("y"))
    return g.select("doc_id", F.size(F.array_intersect("x", "y")).alias("kept"), F.size(F.array_except("x", "y")).alias("lost"))
