"""Deterministic rules over facts.  One evaluation is one composition step: derived facts do not feed it.

Facts are edges (from_id, to_id, kind), attributes (memory_id, attribute) and types (memory_id,
memory_type).  Attributes with too many members are dropped before they are joined with themselves,
which bounds the pairs and removes hot keys, unless the caller asks for all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scalars import derived_id

MOST_MEMBERS, MOST_DERIVED = 256, 10_000


def kind_of(edges: DataFrame, kind: str) -> DataFrame:
    return edges.where(F.col("kind") == kind).select("from_id", "to_id")


def typed(edges: DataFrame, kind: str, end: str, memory_type: str) -> DataFrame:
    """R1 to R3: the type that a memory has because an edge of a kind begins or ends at it."""
    return kind_of(edges, kind).select(F.col(end).alias("memory_id"), F.lit(memory_type).alias("inferred_type")).distinct()


def inferred_types(edges: DataFrame) -> DataFrame:
    return typed(edges, "Solves", "from_id", "Solution").unionByName(typed(edges, "Fixes", "from_id", "Fix")).unionByName(typed(edges, "Causes", "to_id", "Problem"))


def composed(edges: DataFrame, first: str, second: str) -> DataFrame:
    """Distinct (from_id, to_id) of two edges in a row; a two-cycle gives a loop."""
    a = kind_of(edges, first).withColumnRenamed("to_id", "middle")
    b = kind_of(edges, second).withColumnRenamed("from_id", "middle")
    return a.join(b, "middle").select("from_id", "to_id").distinct()


def shared_target(edges: DataFrame, kind: str) -> DataFrame:
    """Distinct pairs, both ways, of different sources of one target."""
    a = kind_of(edges, kind)
    return a.join(a.withColumnRenamed("from_id", "other"), "to_id").where("from_id <> other").select("from_id", F.col("other").alias("to_id")).distinct()


def frequent(facts: DataFrame, most: int = MOST_MEMBERS) -> DataFrame:
    """(attribute, members) of attributes with at most ``most`` members."""
    return facts.groupBy("attribute").agg(F.count("*").alias("members")).where(F.col("members") <= most)


def shared_attribute(facts: DataFrame, most: int | None = MOST_MEMBERS, block_rows: int = 1024) -> DataFrame:
    """(from_id, to_id, shared): for pairs, both ways, how many attributes they share.

    With ``most`` as None no attribute is dropped.  The members of a frequent one are then dealt into blocks and
    pairs of blocks are joined; a pair is sent by the first attribute it shares, so pairs are not shuffled again.
    """
    if most is None:
        rows = facts.where("attribute IS NOT NULL").groupBy("memory_id").agg(F.array_sort(F.collect_set("attribute")).alias("own"))
        rows = rows.select("memory_id", "own", F.explode("own").alias("attribute"))
        sizes = rows.groupBy("attribute").agg(F.expr(f"(count(*) + {block_rows - 1}) div {block_rows}").alias("blocks"), F.count("*").alias("n")).where("n > 1")
        placed = rows.join(sizes.drop("n"), "attribute").withColumn("at", F.pmod(F.xxhash64("memory_id"), F.col("blocks")))
        left = placed.select("attribute", F.col("memory_id").alias("x"), F.col("own").alias("x_own"), F.col("at").alias("i"), F.explode(F.sequence(F.col("at"), F.col("blocks") - 1)).alias("j"))
        right = placed.select("attribute", F.col("memory_id").alias("y"), F.col("own").alias("y_own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("at"))).alias("i"), F.col("at").alias("j"))
        common = F.array_intersect("x_own", "y_own")
        tasks = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that small blocks with many pairs stay apart
        met = left.repartition(tasks, "attribute", "i", "j").join(right, ["attribute", "i", "j"]).where("x < y OR i < j").where(F.col("attribute") == F.array_min(common))
        ways = F.explode(F.array(F.struct(F.col("x").alias("from_id"), F.col("y").alias("to_id")), F.struct(F.col("y").alias("from_id"), F.col("x").alias("to_id"))))
        return met.select(F.size(common).cast("long").alias("shared"), ways.alias("pair")).select("pair.from_id", "pair.to_id", "shared")
    kept = facts.distinct().join(frequent(facts.distinct(), most).select("attribute"), "attribute")
    pairs = kept.withColumnRenamed("memory_id", "from_id").join(kept.withColumnRenamed("memory_id", "to_id"), "attribute").where("from_id <> to_id")
    return pairs.groupBy("from_id", "to_id").agg(F.count("*").alias("shared"))


def reversed_solves(edges: DataFrame) -> DataFrame:
    """R6: what solves, seen from what is solved."""
    return kind_of(edges, "Solves").select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))


def implied_solves(edges: DataFrame, types: DataFrame) -> DataFrame:
    """D1: a fix that fixes also solves."""
    fixes = types.where("memory_type = 'Fix'").select(F.col("memory_id").alias("from_id"))
    return kind_of(edges, "Fixes").join(fixes, "from_id", "left_semi").select("from_id", "to_id").distinct()


def cohort(members: DataFrame) -> DataFrame:
    """D6: pairs a < b of one session, from (memory_id, session)."""
    other = members.select(F.col("memory_id").alias("to_id"), "session")
    return members.select(F.col("memory_id").alias("from_id"), "session").join(other, "session").where("from_id < to_id").select("from_id", "to_id").distinct()


# The kind, strength and confidence that each rule writes; None: by the shared count.
WRITTEN = {
    "R4": ("DependsOn", 0.5, 0.5),
    "R5": ("Requires", 0.5, 0.5),
    "R7": ("RelatedTo", 0.3, None),
    "R8": ("RelatedTo", 0.8, 0.8),
    "R9": ("RelatedTo", 0.3, None),
    "D1": ("Solves", 0.8, 0.8),
    "D2": ("BuildsOn", 0.5, 0.5),
    "D3": ("Blocks", 0.5, 0.5),
    "D4": ("Contradicts", 0.4, 0.5),
    "D5": ("RelatedTo", 0.5, 0.5),
    "D6": ("RelatedTo", 0.6, 0.5),
}


def written(rule: str, facts: DataFrame) -> DataFrame:
    """Facts of a rule as edges; the id holds the rule, so rules about one pair stay apart."""
    kind, strength, confidence = WRITTEN[rule]
    sure = F.lit(confidence).cast("double") if confidence is not None else F.least(F.col("shared") / 5.0, F.lit(1.0))
    return facts.select(
        derived_id("edge", F.col("from_id"), F.lit(kind), F.col("to_id"), F.lit(rule)).alias("rel_id"),
        "from_id",
        "to_id",
        F.lit(kind).alias("kind"),
        F.lit(rule).alias("rule"),
        F.lit(strength).alias("strength"),
        sure.alias("confidence"),
    )


def evaluate(edges: DataFrame, types: DataFrame, tags: DataFrame, entities: DataFrame, sessions: DataFrame) -> dict[str, DataFrame]:
    """The facts of every rule that writes edges."""
    return {
        "R4": composed(edges, "DependsOn", "DependsOn"),
        "R5": composed(edges, "Requires", "Requires"),
        "R7": shared_attribute(entities),
        "R8": shared_target(edges, "Solves"),
        "R9": shared_attribute(tags),
        "D1": implied_solves(edges, types),
        "D2": composed(edges, "BuildsOn", "BuildsOn"),
        "D3": composed(edges, "Blocks", "Requires"),
        "D4": composed(edges, "Contradicts", "Confirms"),
        "D5": shared_target(edges, "Modifies"),
        "D6": cohort(sessions),
    }


def write_back(facts: dict[str, DataFrame], memories: DataFrame, existing: DataFrame, most: int | None = MOST_DERIVED) -> DataFrame:
    """New derived edges: both ends known, visibility of the narrower end, not there yet; smallest ids first, all if ``most`` is None."""
    rows = None
    for rule, frame in facts.items():
        edges = written(rule, frame)
        rows = edges if rows is None else rows.unionByName(edges)
    for side in ("from", "to"):
        rows = rows.join(memories.select(F.col("memory_id").alias(f"{side}_id"), F.col("visibility").alias(f"{side}_visibility")), f"{side}_id")
    rows = rows.withColumn("visibility", F.least("from_visibility", "to_visibility")).drop("from_visibility", "to_visibility")
    rows = rows.join(existing.select("rel_id"), "rel_id", "left_anti")
    return rows if most is None else rows.orderBy("rel_id").limit(most)


def neighbourhood(edges: DataFrame, seeds: DataFrame, k: int, most_nodes: int = 512, most_edges: int = 4096) -> DataFrame:
    """Edges within ``k`` hops of the seeds, for a rule run on what changed."""
    from loomgraph.operators.graph import touching
    from loomgraph.session import Steps

    steps, near = Steps(edges.sparkSession), seeds.select("memory_id").distinct()
    for _ in range(k):
        ends = touching(edges, near).select(F.explode(F.array("from_id", "to_id")).alias("memory_id"))
        near = steps.keep(ends.unionByName(near).distinct().orderBy("memory_id").limit(most_nodes))
    return touching(edges, near).orderBy("rel_id").limit(most_edges)
