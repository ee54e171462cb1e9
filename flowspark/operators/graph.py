"""Connected components by alternating large-star and small-star steps, all as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.plans.scale import HEAVY_ROWS, checkpoint, salted_join


def _state(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """`(node, component)`: every node of an edge list with the smallest node it is connected to.

    Each step needs only the smallest neighbour per node (a partial aggregate) and one join back;
    no node ever gathers its neighbours. Heavy nodes are salted in that join. Every round is
    checkpointed (large graphs twice); the rounds grow with the logarithm of the graph.
    """
    pairs = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct()
    nodes = edges.select(F.col(a).alias("node")).union(edges.select(F.col(b).alias("node"))).distinct()
    pairs = checkpoint(pairs.where("lo <> hi"))
    state = _state(pairs)
    for _ in range(max_rounds):
        rows = 2 * state[0]
        both = pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(
            pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = salted_join(both.where("v > u"), low, ["u"], rows=rows).select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        large = large.where("lo <> hi").distinct()
        large = checkpoint(large) if rows > HEAVY_ROWS else large
        least = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        hung = salted_join(large.select(F.col("hi").alias("u"), F.col("lo").alias("v")), least, ["u"], rows=rows)
        small = hung.select(F.col("m").alias("lo"), F.col("v").alias("hi")).union(least.select(F.col("m").alias("lo"), F.col("u").alias("hi")))
        pairs = checkpoint(small.where("lo <> hi").distinct())
        before, state = state, _state(pairs)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    lowest = pairs.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component"))
    return nodes.join(lowest, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
