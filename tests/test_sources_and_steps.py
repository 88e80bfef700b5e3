from __future__ import annotations

import io
import tarfile
from datetime import date, datetime

import pytest
import zstandard
from pyspark.sql import functions as F

from broadsheaf.engine import Engine
from broadsheaf.operators import campaigns as K
from broadsheaf.operators import curate as C
from broadsheaf.operators import extras as X
from broadsheaf.operators import logs as L
from broadsheaf.sources import corpus
from broadsheaf.sources import readers as R
from broadsheaf.streaming import logs as S

SF = "/root/testdata/sf0.001"


def archive(names, mode):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode=mode) as t:
        for n, text in names:
            info = tarfile.TarInfo(n)
            info.size = len(text)
            t.addfile(info, io.BytesIO(text))
    return raw.getvalue()


def test_archives(spark, tmp_path):
    names = [("sn1/1896/07/09/ed-1/seq-2/ocr.txt", b"gold"), ("sn1/1896-07-10/ed-2/seq-11/ocr.txt", b"silver"), ("sn1/1896/13/40/ed-1/seq-1/ocr.txt", b"no day"), ("sn1/readme.md", b"x")]
    (tmp_path / "a.tar.gz").write_bytes(archive(names, "w:gz"))
    (tmp_path / "b.tar.zst").write_bytes(zstandard.compress(archive(names[:1], "w")))
    got = {(r["text"], r["key"]["lccn"], r["key"]["date"], r["key"]["edition"], r["key"]["seq"]) for r in R.archives(spark, str(tmp_path)).collect()}
    assert got == {("gold", "sn1", date(1896, 7, 9), 1, 2), ("silver", "sn1", date(1896, 7, 10), 2, 11)}


def test_layouts(spark):
    blocks = [{"x": 1.0, "y": 2.0, "w": 3.0, "h": 4.0, "lines": [{"words": [{"text": "a<b", "x": 0.0, "y": 0.0, "w": 1.0, "h": 2.0, "conf": 0.25}, {"text": "c", "x": 2.0, "y": 0.0, "w": 1.0, "h": 4.0, "conf": 0.75}]}]}]
    xml = R.to_alto(blocks)
    assert R.alto(xml) == blocks and R.alto("<broken") == []
    df = R.layouts(spark.createDataFrame([(1, xml), (2, None)], "id int, xml string"), "xml")
    assert [r["text"] for r in R.layout_words(df, "id").orderBy("word").collect()] == ["a<b", "c"]
    s = R.layout_stats(df, "id").first()
    assert (s["words"], s["wc_mean"], s["wc_below"], s["height"]) == (2, 0.5, 0.5, 3.0)


def test_untrusted_rows(spark):
    digest = bytearray(bytes.fromhex("2c26b46b68ffc68ff99b453c1d30413413422d706483bfa0f98a5e886266e7ae"))
    rows = [("a", "ok", "foo", 3, digest), ("b", "ok", None, 0, None), ("c", "empty", "x", 1, None), ("d", "ok", "foo", 4, None), ("e", "ok", "bar", 3, digest), (None, "ok", "x", 1, None)]
    good, bad = R.checked_overlay(spark.createDataFrame(rows, "doc_id string, text_status string, text string, text_chars int, text_sha256 binary"))
    assert [r["doc_id"] for r in good.collect()] == ["a"] and bad.count() == 5


def test_boxes_and_places(spark):
    df = spark.createDataFrame([('[{"text":"a","x0":5,"y0":-2,"x1":1,"y1":3},{"text":"b","x0":99,"y0":0,"x1":120,"y1":1},{"text":"c","x0":200,"y0":0,"x1":220,"y1":1}]',)], "j string")
    got = df.select(R.boxes(F.col("j"), F.lit(100.0), F.lit(50.0)).alias("b")).first()["b"]
    assert [(x["text"], x["x"], x["y"], x["w"], x["h"]) for x in got] == [("a", 1.0, 0.0, 4.0, 3.0), ("b", 99.0, 0.0, 1.0, 1.0)]
    assert spark.range(1).select(R.place_name(F.lit("St. Émile"))).first()[0] == "saint emile"


def test_versions(spark, tmp_path):
    p = spark.createDataFrame([(1, 1890, 5), (2, 1900, 3)], "doc_id int, decade int, day int")
    C.publish(spark, p, str(tmp_path), 1)
    C.publish(spark, p.where("doc_id = 2"), str(tmp_path), 2)
    assert [r["doc_id"] for r in C.current(spark, str(tmp_path)).collect()] == [2]
    with pytest.raises(Exception, match="already exists"):
        C.publish(spark, p, str(tmp_path), 2)


def test_leases(spark):
    t = lambda m: datetime(2024, 1, 1, 0, m)
    rows = [("a", "send", t(0)), ("a", "receive", t(1)), ("a", "receive", t(5)), ("a", "receive", t(20)), ("a", "delete", t(21)), ("a", "receive", t(59)), ("b", "receive", t(1))]
    static = spark.createDataFrame(rows, "key string, action string, ts timestamp")
    import tempfile

    d = tempfile.mkdtemp()
    static.coalesce(1).write.mode("overwrite").parquet(d)
    got = S.drained(S.leases(spark.readStream.schema(static.schema).parquet(d)), "leases_test").orderBy("ts").collect()
    assert [(r["key"], r["ts"].minute, r["attempt"], r["state"]) for r in got] == [("a", 1, 1, "delivered"), ("a", 20, 2, "delivered")]


def test_plans_of_the_engine(spark):
    e = Engine(corpus.text_pages(spark, SF), date(1850, 1, 1), date(1900, 12, 31))
    out = e.aggregate("of the", "year")
    total = [r for r in out["summary"].collect() if r["kind"] == "total"][0]["hits"]
    assert total == sum(r["hits"] for r in out["cube"].collect()) == sum(r["hits"] for r in out["series"].collect()) == e.found("of the").count()
    assert all("<mark>" in s for r in e.hits("of the", 3).collect() for s in r["snippets"][:1])
    assert e.canonical("b a", state=["y", "x"]) == e.canonical("a b", state=["x", "y"])
    first = e.browse(k=5).collect()
    rest = e.browse(after=(first[-1]["day"], first[-1]["sort_key"]), k=5).collect()
    assert [(r["day"], r["sort_key"]) for r in first + rest] == sorted((r["day"], r["sort_key"]) for r in e.browse(k=10).collect())
    with pytest.raises(ValueError):
        e.scope(nonsense=[1])
    with pytest.raises(ValueError):
        e.scope(date(1990, 1, 1))
    plan = corpus.text_pages(spark, SF).groupBy("place_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1]


def test_equal_steps_take_the_cell(spark):
    sizes = spark.createDataFrame([("x", i, 1 + i % 5) for i in range(50)], "cell string, title int, pages long")
    takes = K.allocate(sizes, ["cell"], "title", 10, "s")
    assert takes.agg(F.sum("take")).first()[0] == 10


def test_wave_decisions():
    assert [K.decide_wave(*a) for a in ((900, 1, 0.1, 1), (0, 0.2, 0.1, 1), (0, 1, 0.1, 1), (0, 1, 0.001, 1), (0, 1, None, 1))] == ["idle", "enqueue", "next_wave", "stop", "stop"]


def test_union_of_missing_tables_and_neighbours(spark):
    assert L.union_existing(spark, "a int", None, spark.createDataFrame([(1,)], "a int")).count() == 1
    v = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (3, [0.0, 1.0], 2), (4, [-1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    got = {r["id"]: r["agreement"] for r in X.knn_agreement(v, 2).collect()}
    assert got[1] == 1.0 and got[3] == 0.0 and 4 not in got


def test_rows_are_dealt_however_many_parts_a_scan_has(spark, tmp_path):
    """Splits without the start of a row group are empty: many parts can hold their rows in one."""
    spark.range(4000).coalesce(1).write.parquet(f"{tmp_path}/one.parquet")
    cores, most = spark.sparkContext.defaultParallelism, "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(most)
    spark.conf.set(most, "1000")
    try:
        one = spark.read.parquet(f"{tmp_path}/one.parquet")
        assert one.rdd.getNumPartitions() >= cores
        rows = corpus.dealt(one).withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    finally:
        spark.conf.set(most, before)
    assert sum(r["count"] for r in rows) == 4000 and len(rows) >= cores and max(r["count"] for r in rows) < 4000 / cores
