"""The corpus pipeline: quality, near duplicates, decontamination, personal data, packing.

Every stage works on all its predecessor kept; all but the last return the columns of ``documents``. Rows are told
apart by id and text, so repeated ids with different texts are decided on their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheaf.llm import decontaminate, near_dup, packing, pii, quality_gam
from broadsheaf.llm.common import materialise, table


def _free(docs: DataFrame, *names: str) -> list[str]:
    """The names, made longer until ``docs`` has no such column."""
    out = []
    for n in names:
        while n.lower() in {c.lower() for c in docs.columns}:
            n += "_"
        out.append(n)
    return out


def _hash():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _kept(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id and text hash are in ``keys`` (doc_id, text_hash)."""
    own, id_, hash_ = _free(docs, "__own", "__id", "__hash")
    k = keys.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct()
    return docs.withColumn(own, _hash()).join(k, F.col(own).eqNullSafe(F.col(hash_)) & F.col("doc_id").cast("long").eqNullSafe(F.col(id_)), "left_semi").drop(own)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    scored = quality_gam.score(docs, table(spark, sf_dir, "labels"))
    return _kept(docs, scored.where("predicted = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the least id."""
    found = near_dup.near_duplicates(docs)
    once = _kept(docs, found.where("kept"))
    own = _free(docs, "__own")[0]
    return once.withColumn(own, _hash()).dropDuplicates(["doc_id", own]).drop(own)  # repeated rows


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    key, gone = _free(docs, "__key", "__leaked")
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    leaked = decontaminate.leaks(keyed, table(spark, sf_dir, "benchmark"), id_col=key).select(F.col("doc_id").alias(gone)).distinct()
    return keyed.join(leaked, F.col(key) == F.col(gone), "left_anti").drop(key)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data."""
    done = pii.pseudonymise(docs, pii.session_key(spark), found_col=None)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("pack", pack)]

#: Classifier, signatures, latent retrieval and tokenizer are beyond SQL: tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
