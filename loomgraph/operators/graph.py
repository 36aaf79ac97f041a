"""Bounded walks over the graph.  Each hop is a join on a frontier of at most ``max_nodes`` rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.visibility import Caller, memory_visible, visible_edges
from loomgraph.session import Steps

MOST_DEPTH, MOST_NODES = 4, 2048


def touching(edges: DataFrame, frontier: DataFrame, key: str = "memory_id") -> DataFrame:
    """Edges with an end in the frontier: two semi joins, so no join has an OR in its condition."""
    out = edges.join(frontier.select(F.col(key).alias("from_id")), "from_id", "left_semi").select(*edges.columns)
    into = edges.join(frontier.select(F.col(key).alias("to_id")), "to_id", "left_semi").select(*edges.columns)
    return out.unionByName(into).dropDuplicates(["rel_id"])


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    for side in ("from_id", "to_id"):
        edges = edges.join(nodes.select(F.col("memory_id").alias(side)), side, "left_semi").select(*edges.columns)
    return edges


def sharing(memories: DataFrame, seeds: DataFrame, column: str = "tags") -> DataFrame:
    """Memories that share an attribute with one of the seeds, without the seeds."""
    wanted = seeds.join(memories, "memory_id").select(F.explode(column).alias("attribute")).distinct()
    found = memories.select("memory_id", F.explode(column).alias("attribute")).join(wanted, "attribute", "left_semi")
    return found.select("memory_id").distinct().join(seeds, "memory_id", "left_anti")


def traverse(
    memories: DataFrame, edges: DataFrame, start: str, caller: Caller, direction: str = "both", kinds: list[str] | None = None, max_depth: int = 2, max_nodes: int = 128
) -> DataFrame:
    """(memory_id, depth): visible nodes that can be reached over visible nodes and edges.

    The start is not in the result, a depth of 0 is empty, and each hop keeps the smallest ids if the
    limit would be passed.  Give rows that are live at the time wanted.
    """
    spark, steps = memories.sparkSession, Steps(memories.sparkSession)
    schema = "memory_id string, depth int"
    depth, limit = min(max_depth, MOST_DEPTH), min(max_nodes, MOST_NODES)
    usable = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    nodes = memories.where(memory_visible(caller)).select("memory_id")
    seen = steps.keep(nodes.where(F.col("memory_id") == start).select("memory_id", F.lit(0).alias("depth")))
    frontier, found = seen, 0
    for hop in range(1, depth + 1):
        hops = []
        for side, other in [s for s in (("from_id", "to_id"), ("to_id", "from_id")) if direction in ("both", "out" if s[0] == "from_id" else "in")]:
            near = usable.join(frontier.select(F.col("memory_id").alias(side)), side, "left_semi")
            hops.append(visible_edges(near, memories, caller).select(F.col(other).alias("memory_id")))
        reached = hops[0] if len(hops) == 1 else hops[0].unionByName(hops[1])
        fresh = reached.distinct().join(nodes, "memory_id", "left_semi").join(seen, "memory_id", "left_anti")
        frontier = steps.keep(fresh.orderBy("memory_id").limit(limit - found).select("memory_id", F.lit(hop).alias("depth")))
        new = frontier.count()
        found += new
        if not new:
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0") if depth > 0 else spark.createDataFrame([], schema)


def find_related(memories: DataFrame, edges: DataFrame, anchor: str, caller: Caller, k: int = 2) -> DataFrame:
    return traverse(memories, edges, anchor, caller, "both", None, min(k, MOST_DEPTH), 128)


def chain(memories: DataFrame, edges: DataFrame, origin: str, max_depth: int = 4) -> DataFrame:
    """(memory_id, depth): the origin, then level by level the ends of the edges it was derived from."""
    steps = Steps(memories.sparkSession)
    seen = frontier = steps.keep(memories.where(F.col("memory_id") == origin).select("memory_id", F.lit(0).alias("depth")))
    for depth in range(1, min(max_depth, MOST_DEPTH) + 1):
        evidence = memories.where("provenance = 'Derived'").join(frontier.select("memory_id"), "memory_id", "left_semi").select(F.explode("evidence").alias("rel_id")).distinct()
        ends = edges.join(evidence, "rel_id", "left_semi").select(F.explode(F.array("from_id", "to_id")).alias("memory_id")).distinct()
        fresh = ends.join(memories.select("memory_id"), "memory_id", "left_semi").join(seen, "memory_id", "left_anti")
        frontier = steps.keep(fresh.select("memory_id", F.lit(depth).alias("depth")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def explain_edge(edges: DataFrame, target: str, budget: int = 64, max_depth: int = 5) -> DataFrame:
    """(rel_id, depth, rule): the derived edge and, backwards, the edges it rests on; smallest ids first.

    Gives nothing if the target is not a derived edge.
    """
    steps = Steps(edges.sparkSession)
    columns = ["rel_id", "rule", "evidence"]
    level = edges.where((F.col("rel_id") == target) & (F.col("provenance") == "Derived")).select(*columns, F.lit(0).alias("depth"))
    seen = frontier = steps.keep(level)
    for depth in range(1, max_depth + 1):
        room = budget - seen.count()
        wanted = frontier.select(F.explode("evidence").alias("rel_id")).distinct().join(seen, "rel_id", "left_anti")
        fresh = edges.join(wanted, "rel_id", "left_semi").select(*columns, F.lit(depth).alias("depth"))
        frontier = steps.keep(fresh.orderBy("rel_id").limit(max(0, room)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.select("rel_id", "depth", "rule")


def explanation(rows: list) -> str:
    """The rows of ``explain_edge`` as indented text."""
    return "\n".join("  " * r["depth"] + r["rel_id"] + (f" by {r['rule']}" if r["rule"] else "") for r in sorted(rows, key=lambda r: (r["depth"], r["rel_id"])))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): smallest node that can be reached, by spreading minima and following labels.

    Labels are followed to their label after each step, so long paths need few steps.
    """
    steps = Steps(edges.sparkSession)
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y")))
    both = steps.keep(both.where("x IS NOT NULL AND y IS NOT NULL").distinct())
    labels = steps.keep(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.min("x")).alias("component")))
    while True:
        named = both.join(labels.select(F.col("node").alias("y"), "component"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(named, "node").select("node", F.least("component", "near").alias("next"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("further"))
        moved = steps.keep(step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("further", "next")).alias("component"), "was"))
        changed = not moved.where("component <> was").isEmpty()
        labels = moved.select("node", "component")
        if not changed:
            return labels


def nodes_for(memories: DataFrame, wanted: DataFrame, caller: Caller) -> DataFrame:
    """(memory_id, outcome): found, denied or missing for each wanted id."""
    known = memories.select("memory_id", memory_visible(caller).alias("visible"))
    joined = wanted.join(known, "memory_id", "left")
    return joined.select("memory_id", F.when(F.col("visible").isNull(), "missing").when(F.col("visible"), "found").otherwise("denied").alias("outcome"))
