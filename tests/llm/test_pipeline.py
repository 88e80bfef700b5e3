from __future__ import annotations

import duckdb

import __spark_entry__
import corpus_pipeline as C
from broadsheaf.llm import decontaminate, near_dup, pii, quality_gam
from broadsheaf.llm import queries as Q

from .helpers import SF


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "pack"]
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}

    good = C.materialise(C.quality(spark, docs, SF), "t1")
    assert good.columns == columns
    assert ids(good) == {r["doc_id"] for r in quality_gam.score(docs, labels).where("predicted = 1").collect()}
    clean = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert len(clean & ids(good)) >= 0.95 * len(clean & ids(docs))

    once = C.materialise(C.near_duplicates(spark, good, SF), "t2")
    assert once.columns == columns and ids(once) == {r["class_id"] for r in near_dup.near_duplicates(good).collect()}

    apart = C.materialise(C.decontamination(spark, once, SF), "t3")
    leaked = {r["doc_id"] for r in decontaminate.leaks(once, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert apart.columns == columns and ids(apart) == ids(once) - leaked

    masked = C.materialise(C.personal_data(spark, apart, SF), "t4")
    want = {r["doc_id"]: r["text"] for r in pii.pseudonymise(apart, pii.session_key(spark)).collect()}
    assert masked.columns == columns and {r["doc_id"]: r["text"] for r in masked.collect()} == want

    packed = C.pack(spark, masked, SF)
    assert ids(packed) == ids(masked)
    assert packed.count() == C.run(spark, SF).count()


def test_repeated_ids_are_decided_by_text(spark):
    rows = [(1, "a b c d e f g h", "en", "s", 3), (1, "a b c d e f g h", "en", "s", 3), (1, "one two three four five six", "en", "s", 3), (None, "a b c d e f g h", "en", "s", 3), (None, None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in C.near_duplicates(spark, d, SF).collect()) == [("1", "a b c d e f g h"), ("1", "one two three four five six"), ("None", "")]


def test_null_and_repeated_ids_lose_only_their_leaks(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").orderBy("item_id").first()["text"]
    rows = [(i, t, "en", "s", 3) for i in (None, 7) for t in (f"before {item} after", "a clean text of its own", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = C.decontamination(spark, d, SF)
    assert got.columns == d.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got.collect()) == [("7", ""), ("7", "a clean text of its own"), ("None", ""), ("None", "a clean text of its own")]


def test_registered_queries(spark):
    names = __spark_entry__.queries()
    assert {f"op{i}" for i in range(1, 11)} == {n.split("_")[0] for n in names if n.startswith("op")} and "pipeline" in names
    assert set(Q.oracle_sql()) <= set(Q.queries())


def test_sql_of_perspectives(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    got = Q.op2_perspective_rotation(spark, SF)
    want = c.sql(Q.oracle_sql()["op2_perspective_rotation"])
    assert sorted(map(str, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))
