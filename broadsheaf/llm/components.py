"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_rows, materialise


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) of every node that has an edge to another.

    Edges lead from a node to a lesser one. Each round has two steps. Large star: an edge to a node that has lesser neighbours
    itself leads to the least of them instead; hubs, to which many edges lead, are few and broadcast with their least neighbour.
    Small star: a node and its lesser neighbours lead to the least of them. Stops when a round changes nothing; raises where
    ``rounds`` do not reach that.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = materialise(now, "edges")
    state = (now.count(), None)
    for _ in range(rounds):
        if not state[0]:
            break
        least = now.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        hubs = now.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows(state[0])).select("v")
        hubs = hubs.join(least.hint("merge"), F.col("v") == F.col("w"), "left").select("v", F.coalesce("m", "v").alias("m"))
        few = now.join(F.broadcast(hubs.select("v")), "v", "left_anti").join(least.hint("merge"), F.col("v") == F.col("w"), "left")
        large = few.select("u", F.coalesce("m", "v").alias("v")).unionByName(now.join(F.broadcast(hubs), "v").select("u", F.col("m").alias("v")))
        large = large.repartition("u").dropDuplicates(["u", "v"])  # a node has few lesser neighbours
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")).hint("merge"), "u")
        small = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        now = materialise(small.where("u <> v").distinct(), "edges")
        new = tuple(now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
