"""Corpus pipeline: dated places, duplicate copies, text choice, work lists, ledgers and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_DELTAS = 8


def placed_on_date(pages: DataFrame, periods: DataFrame, key: str, date: str = "date") -> DataFrame:
    """Each page with the place in force on its date, else its title's default place.

    ``periods``: key, place, since, until (null: open), default_place. Periods of a title are joined on the title
    first, so the range condition only looks at that title's few periods.
    """
    p, q = pages.alias("p"), periods.alias("q")
    inside = (F.col(f"p.{date}") >= F.coalesce(F.col("q.since"), F.lit("0001-01-01").cast("date"))) & (F.col(f"p.{date}") <= F.coalesce(F.col("q.until"), F.lit("9999-12-31").cast("date")))
    return p.join(q, (F.col(f"p.{key}") == F.col(f"q.{key}")) & inside, "left").select("p.*", F.col("q.place").alias("dated_place"))


def best_copy(copies: DataFrame, key: list[str], ok: Column, name: str) -> DataFrame:
    """Copies with ``kept``: of each page the one with usable text and the first batch name."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy((~ok).cast("int"), name))
    return copies.withColumn("kept", rank == 1)


def shared_days(copies: DataFrame, title: str, day: str, batch: str) -> DataFrame:
    """Title-days that more than one batch holds."""
    return copies.groupBy(title, day).agg(F.array_sort(F.collect_set(batch)).alias("batches")).where(F.size("batches") > 1)


def pair_report(copies: DataFrame, key: list[str], batch: str) -> DataFrame:
    """How often a batch's copy was kept over another's."""
    kept = copies.where("kept").select(*key, F.col(batch).alias("kept_batch"))
    lost = copies.where(~F.col("kept")).select(*key, F.col(batch).alias("other"))
    return lost.join(kept, key).groupBy("kept_batch", "other").agg(F.count("*").alias("pages"))


def enqueue(state: DataFrame, listed: DataFrame) -> DataFrame:
    """The work list after an idempotent upsert: new batches and newer versions are added, the rest stays."""
    newest = listed.groupBy("batch").agg(F.max_by(F.struct("version", "url"), "version").alias("n")).select("batch", F.col("n.version").alias("n_version"), F.col("n.url").alias("n_url"))
    j = state.join(newest, "batch", "full_outer")
    newer = F.col("n_version") > F.coalesce("version", F.lit(-1))
    return j.select("batch", F.when(newer, F.col("n_version")).otherwise(F.col("version")).alias("version"), F.when(newer, F.col("n_url")).otherwise(F.col("url")).alias("url"), F.when(newer & F.col("version").isNull(), "new").when(newer, "newer").otherwise("known").alias("outcome"))


def superseded(pages: DataFrame, empties: DataFrame) -> DataFrame:
    """Newest finished attempt of each unit, without units whose later attempt was empty."""
    newest = pages.groupBy("unit").agg(F.max("attempt").alias("attempt"))
    e = empties.select(F.col("unit").alias("__u"), F.col("attempt").alias("__a"))
    return newest.join(e, (F.col("unit") == F.col("__u")) & (F.col("__a") > F.col("attempt")), "left_anti")


def ledger(queued: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per page the campaign of its newest queued row and the newest outcome that is not older; else pending."""
    def newest(df: DataFrame) -> DataFrame:
        return df.groupBy("page").agg(F.max_by(F.struct(*[c for c in df.columns if c != "page"]), F.struct("at", "seq")).alias("r")).select("page", "r.*")

    q = newest(queued).select("page", "campaign", F.col("at").alias("queued_at"))
    o = newest(outcomes).select("page", "outcome", F.col("at").alias("done_at"))
    done = F.col("done_at") >= F.col("queued_at")
    return q.join(o, "page", "left").select("page", "campaign", F.when(done, F.col("outcome")).otherwise("pending").alias("state"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], replace: Column | None = None) -> DataFrame:
    """Rows of ``old`` updated by ``new`` (where ``replace`` holds, over old_/new_ columns), and new rows."""
    values = [c for c in old.columns if c not in key]
    o = old.select(*key, *(F.col(c).alias(f"old_{c}") for c in values), F.lit(True).alias("__o"))
    n = new.select(*key, *(F.col(c).alias(f"new_{c}") for c in values), F.lit(True).alias("__n"))
    j = o.join(n, key, "full_outer")
    take = F.col("__n").isNotNull() & (F.col("__o").isNull() | (F.lit(True) if replace is None else F.coalesce(replace, F.lit(False))))
    return j.select(*key, *(F.when(take, F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")).alias(c) for c in values))


def choose_text(j: DataFrame) -> DataFrame:
    """Which text a page gets, and why: rules in order on scored columns of both texts (our_*, loc_*)."""
    reason = (
        F.when(F.col("our_lang").isNull(), "undecided").when(F.col("our_damage").isNull(), "unscored").when(F.col("our_lang") != F.coalesce("loc_lang", "our_lang"), "language differs")
        .when(F.col("loc_damage").isNotNull() & (F.col("loc_damage") - F.col("our_damage") < 0.05), "margin").when(F.col("our_words") < 0.85 * F.col("loc_words"), "short").otherwise("replaced")
    )
    return j.withColumn("reason", reason).withColumn("text_from", F.when(F.col("reason") == "replaced", "ours").otherwise("loc"))


def publish(spark: SparkSession, parts: DataFrame, root: str, version: int) -> str:
    """Write an immutable version partitioned by decade, then a pointer of its own for it, last.

    Rows are dealt by ranges of decade and day, so a large decade is written by many tasks. No pointer is overwritten: a reader
    takes the newest whole one, at any moment.
    """
    path = f"{root}/v{version}"
    dealt = parts.repartitionByRange("decade", "day").sortWithinPartitions("decade", "day")
    dealt.write.mode("errorifexists").partitionBy("decade").option("compression", "zstd").parquet(path)
    spark.createDataFrame([(version, path)], "version int, path string").coalesce(1).write.mode("errorifexists").json(f"{root}/pointers/{version}")
    return path


def current(spark: SparkSession, root: str) -> DataFrame:
    at = spark.read.schema("version int, path string").json(f"{root}/pointers/*").orderBy(F.desc("version")).first()
    return spark.read.parquet(at["path"])


def union_indexes(*parts: DataFrame) -> DataFrame:
    """A base and at most eight deltas searched as one."""
    if len(parts) > MAX_DELTAS + 1:
        raise ValueError("too many deltas: build a new base")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def kept_only(every: DataFrame, kept: DataFrame, key: list[str]) -> DataFrame:
    """What a prune removes: all that no kept version names."""
    return every.join(kept, key, "left_anti")
