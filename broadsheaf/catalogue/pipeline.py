"""Joins and corpus pipeline steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curate as C
from ..registry import register
from ..sources.corpus import fact_pages, table, text_pages
from ..sources.sql import FACTS, PAGES

PERIODS = "n_name AS place_id, (y * 3 + n_nationkey % 3 + 1994)::INT AS y0, n_name || '@' || y AS place"


def periods(spark, sf_dir):
    """Three-year periods per place with a gap at the end of each, so some pages take the default."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("place_id"), F.col("n_nationkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("y"))
    y0 = F.col("y") * 3 + F.pmod("k", F.lit(3)) + 1994
    return n.select("place_id", F.make_date(y0.cast("int"), F.lit(1), F.lit(1)).alias("since"), F.when(F.col("y") < 2, F.make_date((y0 + 2).cast("int"), F.lit(6), F.lit(30))).alias("until"), F.concat("place_id", F.lit("@"), F.col("y").cast("string")).alias("place"))


@register("q_dated_places", f"""WITH {FACTS}, q AS (SELECT n_name AS place_id, make_date((y * 3 + n_nationkey % 3 + 1994)::INT, 1, 1) AS since, CASE WHEN y < 2 THEN make_date((y * 3 + n_nationkey % 3 + 1996)::INT, 6, 30) ELSE DATE '9999-12-31' END AS until, n_name || '@' || y AS place FROM nation, range(3) r(y))
SELECT coalesce(q.place, f.place_id) AS place, count(*) AS pages FROM f LEFT JOIN q ON q.place_id = f.place_id AND f.date BETWEEN since AND until GROUP BY 1""")
def _dated(spark, sf_dir):
    p = C.placed_on_date(fact_pages(spark, sf_dir).select("place_id", "date"), periods(spark, sf_dir), "place_id")
    return p.groupBy(F.coalesce("dated_place", "place_id").alias("place")).agg(F.count("*").alias("pages"))


def copies(spark, sf_dir):
    p = text_pages(spark, sf_dir, False)
    return p.select("doc_id", "batch", "lccn", F.md5("text").alias("page"), (F.pmod("doc_id", F.lit(3)) > 0).alias("ok"), F.concat("batch", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("name"))


COPIES = f"{PAGES}, k AS (SELECT doc_id, batch, lccn, md5(text) AS page, doc_id % 3 > 0 AS ok, batch || '/' || lpad(doc_id::VARCHAR, 8, '0') AS name FROM pg), b AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY (NOT ok)::INT, name) = 1 AS kept FROM k)"


@register("q_best_copy", f"WITH {COPIES} SELECT doc_id, batch, kept FROM b")
def _best(spark, sf_dir):
    return C.best_copy(copies(spark, sf_dir), ["page"], F.col("ok"), "name").select("doc_id", "batch", "kept")


@register("q_copy_pairs", f"WITH {COPIES} SELECT x.batch AS kept_batch, y.batch AS other, count(*) AS pages FROM b y JOIN b x ON x.page = y.page AND x.kept AND NOT y.kept GROUP BY 1, 2")
def _pairs(spark, sf_dir):
    return C.pair_report(C.best_copy(copies(spark, sf_dir), ["page"], F.col("ok"), "name"), ["page"], "batch")


@register("q_shared_title_days", f"WITH {FACTS} SELECT lccn, date, list_sort(list(DISTINCT 'b' || (title_key % 4))) AS batches FROM f GROUP BY 1, 2 HAVING count(DISTINCT title_key % 4) > 1")
def _shared(spark, sf_dir):
    f = fact_pages(spark, sf_dir).withColumn("batch", F.concat(F.lit("b"), F.pmod("title_key", F.lit(4)).cast("string")))
    return C.shared_days(f, "lccn", "date", "batch")


@register("q_hidden_anti_join", f"WITH {COPIES} SELECT count(*) AS pages FROM pg WHERE (doc_id, batch) NOT IN (SELECT (doc_id, batch) FROM b WHERE NOT kept)")
def _hidden(spark, sf_dir):
    hidden = C.best_copy(copies(spark, sf_dir), ["page"], F.col("ok"), "name").where("not kept").select("doc_id", "batch")
    return text_pages(spark, sf_dir, False).join(hidden, ["doc_id", "batch"], "left_anti").agg(F.count("*").alias("pages"))


@register("q_enqueue", """WITH st AS (SELECT 'b' || p_partkey AS batch, (p_partkey % 3)::INT AS version, 'old' AS url FROM part WHERE p_partkey % 2 = 0), li AS (SELECT 'b' || p_partkey AS batch, max(p_size % 4)::INT AS v FROM part GROUP BY 1)
SELECT batch, CASE WHEN v > coalesce(version, -1) THEN v ELSE version END AS version, CASE WHEN v > coalesce(version, -1) THEN 'new' ELSE url END AS url, CASE WHEN version IS NULL THEN 'new' WHEN v > version THEN 'newer' ELSE 'known' END AS outcome FROM st FULL JOIN li USING (batch)""")
def _enqueue(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.concat(F.lit("b"), F.col("p_partkey").cast("string")).alias("batch")
    state = p.where("p_partkey % 2 = 0").select(name, F.pmod("p_partkey", F.lit(3)).cast("int").alias("version"), F.lit("old").alias("url"))
    return C.enqueue(state, p.select(name, F.pmod("p_size", F.lit(4)).cast("int").alias("version"), F.lit("new").alias("url")))


@register("q_superseded", "WITH u AS (SELECT l_orderkey AS unit, max(l_linenumber) AS attempt FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1) SELECT unit, attempt FROM u WHERE NOT EXISTS (FROM lineitem e WHERE e.l_returnflag = 'A' AND e.l_orderkey = unit AND e.l_linenumber > attempt)")
def _superseded(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("attempt"), "l_returnflag")
    return C.superseded(li.where("l_returnflag <> 'A'"), li.where("l_returnflag = 'A'"))


@register("q_ledger", """WITH q AS (SELECT user_id AS page, max_by({c: event_type, t: ts}, (ts, event_id)) AS r FROM events WHERE event_type IN ('view', 'click') GROUP BY 1), o AS (SELECT user_id AS page, max_by({c: event_type, t: ts}, (ts, event_id)) AS r FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 1)
SELECT q.r.c AS campaign, CASE WHEN o.r.t >= q.r.t THEN o.r.c ELSE 'pending' END AS state, count(*) AS pages FROM q LEFT JOIN o USING (page) GROUP BY 1, 2""")
def _ledger(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), "event_type", F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    ours = F.col("event_type").isin("view", "click")
    l = C.ledger(e.where(ours).withColumnRenamed("event_type", "campaign"), e.where(~ours).withColumnRenamed("event_type", "outcome"))
    return l.groupBy("campaign", "state").agg(F.count("*").alias("pages"))


@register("q_upsert", "WITH o AS (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier WHERE s_suppkey % 2 = 0), n AS (SELECT s_suppkey AS k, s_acctbal + 1 AS v FROM supplier WHERE s_suppkey % 3 = 0) SELECT k, CASE WHEN o.v IS NULL OR n.v > 5000 THEN n.v ELSE o.v END AS v FROM o FULL JOIN n USING (k)")
def _upsert(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return C.upsert(s.where("k % 2 = 0"), s.where("k % 3 = 0").withColumn("v", F.col("v") + 1), ["k"], F.col("new_v") > 5000)


@register("q_text_choice", f"""WITH {PAGES}, c AS (SELECT doc_id, CASE WHEN doc_id % 11 > 0 THEN lang END AS ol, CASE WHEN doc_id % 7 > 0 THEN (doc_id % 50) / 100 END AS od, CASE WHEN doc_id % 5 = 0 THEN 'en' ELSE lang END AS ll, CASE WHEN doc_id % 13 > 0 THEN (doc_id % 37) / 60 END AS ld, (doc_id % 90 + 10) AS ow, (doc_id % 80 + 20) AS lw FROM pg)
SELECT reason, count(*) AS pages FROM (SELECT CASE WHEN ol IS NULL THEN 'undecided' WHEN od IS NULL THEN 'unscored' WHEN ol <> ll THEN 'language differs' WHEN ld IS NOT NULL AND ld - od < 0.05 THEN 'margin' WHEN ow < 0.85 * lw THEN 'short' ELSE 'replaced' END AS reason FROM c) GROUP BY 1""")
def _choice(spark, sf_dir):
    i = F.col("doc_id")
    m = lambda n: F.pmod(i, F.lit(n))
    p = text_pages(spark, sf_dir, False).select("doc_id", F.when(m(11) > 0, F.col("lang")).alias("our_lang"), F.when(m(7) > 0, m(50) / 100).alias("our_damage"), F.when(m(5) == 0, "en").otherwise(F.col("lang")).alias("loc_lang"), F.when(m(13) > 0, m(37) / 60).alias("loc_damage"), (m(90) + 10).alias("our_words"), (m(80) + 20).alias("loc_words"))
    return C.choose_text(p).groupBy("reason").agg(F.count("*").alias("pages"))


@register("q_prune", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def _prune(spark, sf_dir):
    kept = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return C.kept_only(table(spark, sf_dir, "part"), kept, ["p_partkey"]).select("p_partkey")


@register("q_union_indexes", f"WITH {PAGES} SELECT batch, count(*) AS pages FROM pg GROUP BY 1")
def _union(spark, sf_dir):
    p = text_pages(spark, sf_dir, False)
    return C.union_indexes(p.where("batch = 'batch_0'"), p.where("batch = 'batch_1'").drop("state"), p.where("batch not in ('batch_0', 'batch_1')")).groupBy("batch").agg(F.count("*").alias("pages"))


@register("q_coverage_audit", "WITH a AS (SELECT c_nationkey AS k, count(*) AS ours FROM customer WHERE c_nationkey < 20 GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS theirs FROM supplier WHERE s_nationkey > 4 GROUP BY 1) SELECT k, coalesce(ours, 0)::BIGINT AS ours, coalesce(theirs, 0)::BIGINT AS theirs, (coalesce(ours, 0) - coalesce(theirs, 0))::BIGINT AS difference FROM a FULL JOIN b USING (k)")
def _audit(spark, sf_dir):
    a = table(spark, sf_dir, "customer").where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("ours"))
    b = table(spark, sf_dir, "supplier").where("s_nationkey > 4").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("theirs"))
    zero = F.lit(0).cast("long")
    return a.join(b, "k", "full_outer").select("k", F.coalesce("ours", zero).alias("ours"), F.coalesce("theirs", zero).alias("theirs")).withColumn("difference", F.col("ours") - F.col("theirs"))


@register("q_placement_ladder", """WITH p AS (SELECT event_id, user_id, ts::DATE AS d FROM events), c AS (SELECT DISTINCT user_id, ts::DATE AS d FROM events WHERE event_type = 'purchase'), u AS (SELECT DISTINCT user_id FROM c), dd AS (SELECT DISTINCT d FROM c WHERE d < DATE '2024-01-10')
SELECT CASE WHEN c.user_id IS NOT NULL THEN 'page' WHEN u.user_id IS NOT NULL THEN 'other day' WHEN dd.d IS NOT NULL THEN 'other title' ELSE 'unplaced' END AS class, count(*) AS n FROM p LEFT JOIN c USING (user_id, d) LEFT JOIN u ON u.user_id = p.user_id LEFT JOIN dd ON dd.d = p.d GROUP BY 1""")
def _ladder(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").alias("d"), "event_type")
    c = e.where("event_type = 'purchase'").select("user_id", "d").distinct()
    j = e.join(c.withColumn("a", F.lit(1)), ["user_id", "d"], "left").join(c.select("user_id").distinct().withColumn("b", F.lit(1)), "user_id", "left").join(c.where("d < date'2024-01-10'").select("d").distinct().withColumn("x", F.lit(1)), "d", "left")
    kind = F.when(F.col("a").isNotNull(), "page").when(F.col("b").isNotNull(), "other day").when(F.col("x").isNotNull(), "other title").otherwise("unplaced")
    return j.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))
