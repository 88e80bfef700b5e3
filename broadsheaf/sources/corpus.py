"""Page-shaped views over the driver's tables, the same arithmetic as the CTEs in ``sql``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import time as D


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Rows for work that costs far more than moving them: dealt over the cores.

    How many parts the scan has says nothing: of a file's splits only those that a row group begins in hold rows.
    """
    return df.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places (nations) with their state (region): 25 rows, a fixed dimension."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("place_id"), F.col("r_name").alias("state"))


def page_date(doc_id: Column) -> Column:
    return F.date_add(F.lit("1850-01-01").cast("date"), F.pmod(doc_id * 37, F.lit(18262)).cast("int"))


def text_pages(spark: SparkSession, sf_dir: str, with_words: bool = True) -> DataFrame:
    """Pages with text. ``words`` is what predicates match; Catalyst drops it and ``text`` where nothing reads them."""
    d = table(spark, sf_dir, "documents")
    id_ = F.col("doc_id")
    title = F.regexp_extract("source", r"(\d+)$", 1).cast("long")
    p = d.select(
        "doc_id", "text", F.col("lang"), F.col("source").alias("lccn"), page_date(id_).alias("date"), F.pmod(id_, F.lit(25)).cast("int").alias("ordinal"), F.lit(1).alias("edition"),
        (F.pmod(id_, F.lit(8)) + 1).cast("int").alias("seq"), F.concat(F.lit("batch_"), F.pmod(id_, F.lit(5)).cast("string")).alias("batch"), title.alias("title_ordinal"),
    )
    p = p.withColumns({
        "day": D.day_number(F.col("date")), "ym": D.ym_number(F.col("date")), "year": F.year("date"), "decade": D.partition_decade(F.col("date")), "front_page": F.col("seq") == 1,
        "sort_key": F.shiftleft("title_ordinal", 32).bitwiseOR(F.lit(1 << 16).cast("long")).bitwiseOR(F.col("seq").cast("long")),
    })
    if with_words:
        p = p.withColumn("words", T.words(F.col("text")))
    return p.join(F.broadcast(places(spark, sf_dir)), "ordinal")


def fact_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without text (orders): the denominator, and by predicate the hits of large aggregations."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_orderkey").alias("page_id"), F.to_date("o_orderdate").alias("date"), F.col("c_nationkey").alias("ordinal"), F.col("c_mktsegment").alias("lccn"), F.col("o_orderpriority").alias("language_set"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("title_key"),
    )
    return j.join(F.broadcast(places(spark, sf_dir)), "ordinal")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page-quality summary (one row per order line) that the report statements read."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    h = F.pmod(key * 31 + line * 17, F.lit(100))
    return j.select(
        ((key * 10 + line) * 1000000 + F.col("l_partkey")).alias("doc_id"), F.concat(F.lit("t"), F.pmod(F.col("l_suppkey"), F.lit(40)).cast("string")).alias("lccn"), F.to_date("o_orderdate").alias("date"),
        (F.floor(F.year("o_orderdate") / 2) * 2).cast("int").alias("decade"), F.concat(F.lit("b"), F.pmod(F.col("l_partkey"), F.lit(30)).cast("string")).alias("batch"), F.lit(1).alias("edition"), line.alias("seq"),
        F.when(F.col("l_returnflag") == "N", "eng").when(F.col("l_returnflag") == "R", "ger").otherwise("fre").alias("lang"),
        F.when(h < 5, "no_text").when(h < 12, "und").when(h < 20, "mixed").otherwise("detected").alias("decision"),
        F.when(h >= 12, F.round(F.col("l_discount") * 4 + F.col("l_tax") / 2, 6)).alias("damage_rate"), F.when(F.col("l_quantity") > 10, F.round(1 - F.col("l_tax") * 5, 6)).alias("wc_mean"),
        F.when(line <= 3, F.round(F.col("l_discount") + line / 100, 6)).alias("est_cer"), F.when(line == 2, F.lit(None).cast("double")).otherwise(F.round(F.col("l_tax") * 10, 6)).alias("matched"),
        F.when(F.pmod(line, F.lit(2)) == 0, F.round(F.col("l_discount") * 3, 6)).alias("local_cer"), F.when(F.pmod(key, F.lit(3)) > 0, F.round(1 - F.col("l_discount") * 5, 6)).alias("dice"),
        (F.col("l_quantity") * 40).cast("long").alias("words"), (F.col("l_quantity") * 3).cast("long").alias("den"), F.when(F.pmod(key, F.lit(7)) == 0, F.pmod(line, F.lit(3))).otherwise(0).cast("long").alias("ocr_runs"),
        (F.pmod(key + line, F.lit(4)) == 0).alias("has_image_features"), F.round(F.col("l_tax"), 6).alias("garbage_share"), F.round(F.col("l_discount"), 6).alias("function_share"),
    )


def create_views(spark: SparkSession, **frames: DataFrame) -> None:
    """Names for frames in SQL; a name is given anew where it exists. What is to be kept is written with ``curate.publish``."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
