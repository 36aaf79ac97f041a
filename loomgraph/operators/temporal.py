"""Reads of versioned rows: by system time (lsn, recorded_at) and by world time (valid_from, valid_until).

Versions are append-only.  The version is chosen first and tested for being open afterwards, so a row
that was closed later is not found again in an older version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import Steps


def open_at(at: Column) -> Column:
    """Valid in the half-open interval [valid_from, valid_until)."""
    return (F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (F.col("valid_until") > at))


def live(at: Column) -> Column:
    """Rows of a snapshot: not invalidated, and not closed yet."""
    return F.col("invalidated_by").isNull() & (F.col("valid_until").isNull() | (F.col("valid_until") > at))


def latest(versions: DataFrame, key: str, lsn: str = "version_lsn") -> DataFrame:
    """The version of largest lsn for each key; combined before the shuffle, so no key is one task's.

    Give only the columns that are needed: they travel together.
    """
    rest = [c for c in versions.columns if c != key]
    best = versions.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(lsn)).alias("_v"))
    return best.select(*[F.col(key) if c == key else F.col("_v")[c].alias(c) for c in versions.columns])


def valid_at(versions: DataFrame, at: Column, key: str, lsn: str = "version_lsn") -> DataFrame:
    """Each key's version that was known and had begun at ``at``, if it was still open then."""
    known = versions.where((F.col("recorded_at") <= at) & (F.col("valid_from") <= at))
    return latest(known, key, lsn).where(open_at(at))


def as_of_join(points: DataFrame, versions: DataFrame, key: str, time: str, lsn: str = "version_lsn") -> DataFrame:
    """For each point (key, time) the version that was valid then; points without one are left out.

    The version is chosen per point by an aggregate that is combined before the shuffle.
    """
    numbered = points.withColumn("_point", F.monotonically_increasing_id())
    left = numbered.select("_point", key, F.col(time).alias("_at"))
    rest = [c for c in versions.columns if c != key]
    known = left.join(versions, key).where("recorded_at <= _at AND valid_from <= _at")
    best = known.groupBy("_point", "_at", key).agg(F.max_by(F.struct(*rest), F.col(lsn)).alias("_v"))
    return best.select(key, F.col("_at").alias(time), *[F.col("_v")[c].alias(c) for c in rest]).where(open_at(F.col(time)))


def state_counts(memories: DataFrame, edges: DataFrame, at: Column) -> DataFrame:
    """One row: how many nodes and edges were valid at ``at``."""
    nodes = valid_at(memories, at, "memory_id").agg(F.count("*").alias("n_memories"))
    return nodes.join(valid_at(edges, at, "rel_id").agg(F.count("*").alias("n_relationships")), how="inner", on=F.lit(True))


def history(versions: DataFrame, key: str, lsn: str = "version_lsn") -> DataFrame:
    """All versions with the lsn before and after, in the order of their lsn."""
    window = Window.partitionBy(key).orderBy(lsn)
    return versions.withColumn("previous_lsn", F.lag(lsn).over(window)).withColumn("next_lsn", F.lead(lsn).over(window))


def gaps(feed: DataFrame, key: str, lsn: str = "version_lsn") -> DataFrame:
    """(key, lsn, missing): places in a feed before which numbers are missing."""
    before = F.lag(lsn).over(Window.partitionBy(key).orderBy(lsn))
    return feed.select(key, lsn, (F.col(lsn) - before - 1).alias("missing")).where("missing > 0")


def believed_at(rows: DataFrame, cut: Column) -> DataFrame:
    """What was recorded by the cut and valid at it, without rows copied from outside systems."""
    return rows.where((F.col("recorded_at") <= cut) & open_at(cut) & (F.col("provenance") != "ExternalSnapshot"))


def believed_edges(edges: DataFrame, memories: DataFrame, cut: Column) -> DataFrame:
    """Believed edges whose two ends are believed."""
    nodes = believed_at(memories, cut).select("memory_id")
    kept = believed_at(edges, cut)
    for side in ("from_id", "to_id"):
        kept = kept.join(nodes.withColumnRenamed("memory_id", side), side, "left_semi")
    return kept.select(*edges.columns)


def running_total(rows: DataFrame, weight: Column, order: list[str], name: str, blocks: int = 64) -> DataFrame:
    """``rows`` with the running sum of ``weight`` over all rows in an order.

    Rows are dealt by range and summed by partition first; only one number for each partition is put
    in order by itself, so no task holds all rows.
    """
    dealt = rows.withColumn("_weight", weight).repartitionByRange(blocks, *order).sortWithinPartitions(*order)
    dealt = dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    dealt = Steps(rows.sparkSession).keep(dealt)  # written once: ranges may fall differently when they are dealt again
    sizes = dealt.groupBy("_part").agg(F.sum("_weight").alias("sum"))
    before = sizes.select("_part", F.coalesce(F.sum("sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum("_weight").over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    joined = dealt.join(F.broadcast(before), "_part")  # a row for each of the blocks
    return joined.withColumn(name, F.col("_before") + inside).drop("_weight", "_part", "_at", "_before")


def prefix_within(rows: DataFrame, weight: str, budget: float, order: list[str], partition: list[str]) -> DataFrame:
    """The rows of each partition, in order, whose running weight stays within the budget."""
    running = F.sum(weight).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running", running).where(F.col("running") <= budget)


def last_rows(rows: DataFrame, size: int, order: Column, partition: list[str]) -> DataFrame:
    """The ``size`` newest rows of each partition."""
    rank = F.row_number().over(Window.partitionBy(*partition).orderBy(order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= size).drop("_rank")


def rewinds(snapshots: DataFrame, source: str, lsn: str, digest: str, depth: int = 16) -> DataFrame:
    """Rows whose digest is among the ``depth`` before it, other than the one just before."""
    window = Window.partitionBy(source).orderBy(lsn)
    earlier = F.collect_list(digest).over(window.rowsBetween(-depth, -2))
    rows = snapshots.withColumn("_seen", F.array_contains(earlier, F.col(digest))).withColumn("_same", F.lag(digest).over(window) == F.col(digest))
    return rows.where(F.col("_seen") & ~F.coalesce("_same", F.lit(False))).drop("_seen", "_same")
