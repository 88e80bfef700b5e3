"""What the operators of this subpackage share: shared storage, tables, batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch carries at most; long texts make larger batches too large for a worker.
BATCH_ROWS = 2000
#: Bytes of text that a vectorised step takes at once.
SLICE_BYTES = 2 << 20

#: A key is hot if it has more than this part of all rows, and more rows than HOT_ROWS.
HOT_SHARE, HOT_ROWS = 1000, 256

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a local folder is set.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.conf.get("spark.broadsheaf.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="broadsheaf-")
        spark.conf.set("spark.broadsheaf.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Cuts lineage in a way that survives the loss of any executor; the files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/broadsheaf/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clear() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may have ended first
            return


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, so that a worker's memory does not follow the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` long and ``text`` string (null: empty) only; extra columns are left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of text; a longer text is a piece alone."""
    col = batch.column(column)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64)
    at, n = 0, batch.num_rows
    ends = np.cumsum(sizes)
    while at < n:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def spans(lengths: np.ndarray) -> np.ndarray:
    """Offsets (n + 1) of consecutive runs with these lengths."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated aranges: start, start + 1, ... for each pair."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    offs = spans(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - offs[:-1], lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, vectorised (overflow wraps)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def hot_rows(total: int) -> int:
    """Rows of one key, of ``total`` rows, above which the key is hot."""
    return max(total // HOT_SHARE, HOT_ROWS)


def join_dealt(rows: DataFrame, per: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """``rows`` joined with ``per``, which has one row per key; its column ``count`` tells how many of the ``total`` rows have the key.

    A hot key has more than ``total // HOT_SHARE`` rows, so there are fewer than HOT_SHARE of them: their rows of ``per`` are
    broadcast, and ``rows`` with a hot key stay where they are. All others are joined by a shuffle on the keys.
    """
    unit = hot_rows(total)
    hot, cold = per.where(F.col(count) > unit), per.where(F.col(count) <= unit)
    few = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return few.join(cold.hint("merge"), keys).unionByName(rows.join(F.broadcast(hot), keys))


def row_key(text: str = "text") -> list[Column]:
    """Two hashes of the whole text: with them equal texts are found without moving texts."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7919), F.col(text)).alias("h2")]
