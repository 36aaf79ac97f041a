"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.scratch import Scratch


def _state(edges: DataFrame) -> tuple:
    """Two numbers that differ between different edge sets, as far as 64 bits can tell."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str, b: str, scratch: Scratch, label: str = "cc") -> DataFrame:
    """(node, component) of every node that has an edge; a component is named by its smallest node.

    Nodes are longs.  Loops, repeated and reversed edges are harmless, edges with a null end and an
    empty table give no rows.  Each step moves edges towards smaller neighbours without changing
    what is connected, so the steps end at one star for each component.  A hub's edges are joined on
    the hub, which adaptive execution splits, and minima are combined before they are shuffled.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    pairs = edges.where(u.isNotNull() & v.isNotNull() & (u != v))
    now = scratch.write(f"{label}-0", pairs.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    state = _state(now)
    step = 0
    while state[0]:
        step += 1
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.write(f"{label}-{step}-large", large.where("u > v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = scratch.write(f"{label}-{step}", small.distinct())
        scratch.drop(f"{label}-{step - 1}", f"{label}-{step}-large")
        now, before, state = after, state, _state(after)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
