"""Ranked search with a scoring algebra, supersession, and plain listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scalars import age_days
from loomgraph.operators.visibility import Caller, memory_visible, visible_edges

#: Weights of the score: a hit, an asserted edge, a derived edge's confidence, importance, freshness.
HIT, EXPLICIT, INFERRED, IMPORTANCE, FRESH, FRESH_DAYS = 1.0, 0.30, 0.15, 0.50, 0.10, 7
DEMOTION = 0.1
MOST_RESULTS = 500
SUPERSEDING = ("Replaces", "Contradicts")


def edge_weights(edges: DataFrame) -> DataFrame:
    """(memory_id, explicit, inferred): each node's outgoing asserted edges, and confidences of derived ones."""
    derived = F.col("provenance") != "Asserted"
    return edges.groupBy(F.col("from_id").alias("memory_id")).agg(
        F.count_if(~derived).alias("explicit"), F.coalesce(F.sum(F.when(derived, F.col("confidence"))), F.lit(0.0)).alias("inferred")
    )


def matches(query: str) -> Column:
    """Whether the lower-case title and tags contain the query."""
    text = F.concat_ws(" ", F.lower("title"), F.array_join(F.transform("tags", F.lower), " "))
    return F.contains(text, F.lit(query.lower()))


def search(memories: DataFrame, edges: DataFrame, query: str, limit: int, caller: Caller, as_of: Column, count_hidden: bool = False) -> DataFrame:
    """(memory_id, score): the best visible rows whose title or tags hold the query, ties by id.

    An empty query or a limit of 0 gives nothing.  Matching is done before the edges are aggregated,
    and only edges of matching nodes are; ``count_hidden`` also counts edges the caller cannot see.
    """
    limit = max(0, min(limit, MOST_RESULTS))
    hits = memories.where(memory_visible(caller) & matches(query) if query.strip() else F.lit(False))
    hits = hits.select("memory_id", "importance", "recorded_at")
    own = edges.join(hits.select(F.col("memory_id").alias("from_id")), "from_id", "left_semi")
    counted = own if count_hidden else visible_edges(own, memories, caller)
    scored = hits.join(edge_weights(counted), "memory_id", "left")
    score = (
        F.lit(HIT)
        + EXPLICIT * F.coalesce("explicit", F.lit(0))
        + INFERRED * F.coalesce("inferred", F.lit(0.0))
        + IMPORTANCE * F.col("importance")
        + F.when(age_days(F.col("recorded_at"), as_of) <= FRESH_DAYS, FRESH).otherwise(0.0)
    )
    return scored.select("memory_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "memory_id").limit(limit)


def superseded_by(edges: DataFrame, kinds: tuple[str, ...] = SUPERSEDING) -> DataFrame:
    """(memory_id, successor): the smallest id from which a live superseding edge comes."""
    return edges.where(F.col("kind").isin(*kinds)).groupBy(F.col("to_id").alias("memory_id")).agg(F.min("from_id").alias("successor"))


def demoted(results: DataFrame, successors: DataFrame) -> DataFrame:
    """Search results with superseded rows' scores cut to a tenth, in the new order."""
    joined = results.join(successors, "memory_id", "left")
    score = F.when(F.col("successor").isNotNull(), F.col("score") * DEMOTION).otherwise(F.col("score"))
    return joined.select("memory_id", F.round(score, 6).alias("score"), "successor").orderBy(F.desc("score"), "memory_id")


def find_by_entity(memories: DataFrame, entity: str, caller: Caller, types: list[str] | None = None, project: str | None = None, valid: Column | None = None, limit: int = 100) -> DataFrame:
    """Visible rows that name the entity, newest first; filters are composed before the limit."""
    rows = memories.where(memory_visible(caller) & F.array_contains("entities", entity))
    if types:
        rows = rows.where(F.col("memory_type").isin(*types))
    if project:
        rows = rows.where(F.col("project") == project)
    if valid is not None:
        rows = rows.where(valid)
    return rows.orderBy(F.desc("recorded_at"), "memory_id").limit(min(limit, MOST_RESULTS))


def in_region(rows: DataFrame, org: str, project: str = "*", memory_type: str = "*") -> DataFrame:
    """Rows of a region; ``*`` is any project or type."""
    keep = F.col("org") == org
    for column, value in (("project", project), ("memory_type", memory_type)):
        keep &= F.lit(True) if value == "*" else F.col(column) == value
    return rows.where(keep)


def bounded(rows: DataFrame, limit: int) -> DataFrame:
    """``rows``, or an error if there are more than ``limit``: a region is never cut silently."""
    if rows.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows")
    return rows


def list_page(rows: DataFrame, caller: Caller, offset: int, limit: int, key: str = "memory_id") -> DataFrame:
    """A page of visible rows in the order of their key; 1 to 200 rows."""
    return rows.where(memory_visible(caller)).orderBy(key).offset(max(0, offset)).limit(max(1, min(limit, 200)))
