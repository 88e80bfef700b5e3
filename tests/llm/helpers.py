from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, h1 long, bands string, score double, n long"


def docs(spark: SparkSession, texts: list[str | None], ids: list[int | None] | None = None) -> DataFrame:
    """Documents with extra columns whose names operators use themselves."""
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", 1, "x", 0.5, None) for i, t in zip(ids, texts)], DOCS)


def prose(seed: int, n: int, words: int = 400) -> str:
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(words)]
    return " ".join(r.choice(vocab) + r.choice(["", "", "", ".", ","]) for _ in range(n))
