"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

A budget of tokens goes down a tree of groups (say domain, language, source).  At each node children
get shares by weight; a child that cannot use its share, because its documents over all allowed
epochs are fewer, passes the rest to its siblings, and only what a whole subtree cannot use goes to
the siblings of its parent.  A leaf repeats whole epochs and takes a prefix of the next one, in an
order that the seed, the epoch and the document's id decide.

Prefixes are found in buckets of the order: bucket totals are summed first, so no task needs to hold
a whole leaf even if one leaf has most of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.scratch import Scratch

#: Rows of a bucket in a small leaf; larger leaves have buckets of the square root of their rows.
BUCKET_ROWS = 256
KEY_BITS = 52
#: Stands for a missing id in the order of an epoch.
NO_ID = -(1 << 63)


def word_count(text: Column) -> Column:
    """Words of a text: runs other than space and 0x09-0x0D; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shares(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``nodes`` (parent columns, name, weight, capacity, given) with each node's ``share`` of ``given``.

    Nodes are filled in the order of capacity over weight: those that cannot use their part of what
    is left get their capacity, the others the same level times their weight, rounded down.
    """
    order = [(F.col("capacity") / F.col("weight")).asc(), F.col(name).asc()]
    window = Window.partitionBy(*parent, "given").orderBy(*order)
    before = F.coalesce(F.sum("capacity").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum("weight").over(window.rowsBetween(0, Window.unboundedFollowing))
    rows = nodes.withColumn("level", (F.col("given") - before) / weights)
    rows = rows.withColumn("full", F.col("capacity") / F.col("weight") <= F.col("level"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy(*parent, "given"))
    share = F.when(F.col("full"), F.col("capacity")).otherwise(F.greatest(F.lit(0), F.floor(level * F.col("weight"))).cast("long"))
    return rows.withColumn("share", share).drop("level", "full")


def leaf_budgets(leaves: DataFrame, path: list[str], weights: list[str], budget: tuple[int, int], epochs: int) -> DataFrame:
    """``leaves`` (path, tokens, rows) with the ``budget`` of each, budget[0] / budget[1] of all tokens."""
    named = leaves.withColumn("capacity", F.col("tokens") * epochs)
    given = named.agg(F.floor(F.sum("tokens") * budget[0] / budget[1]).cast("long").alias("given"))
    current = given.withColumn("_all", F.lit(0))
    parent = ["_all"]
    for depth, name in enumerate(path):
        keys = path[: depth + 1]
        nodes = named.groupBy(*keys).agg(F.sum("capacity").alias("capacity")).withColumn("_all", F.lit(0)).withColumn("weight", F.expr(weights[depth]).cast("long"))
        current = shares(nodes.join(current.select(*parent, "given"), parent), parent, name).select("_all", *keys, F.col("share").alias("given"))
        parent = ["_all", *keys]
    return leaves.join(current.select(*path, F.col("given").alias("budget")), path)


def _key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """A document's place in the order of an epoch: 52 bits of a digest."""
    name = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, KEY_BITS // 4), 16, 10).cast("long")


@dataclass(frozen=True)
class Mixture:
    """``rows`` (doc_id, path, n_tokens), and for each leaf whole epochs and the last key of the next."""

    rows: DataFrame
    planned: DataFrame
    levels: list[str]
    seed: int


def plan_mixture(
    documents: DataFrame, path: dict[str, Column], weights: list[str], budget: tuple[int, int] = (3, 5), epochs: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text"
) -> Mixture:
    """Budgets of all leaves and where each leaf's prefix ends.

    ``planned`` has a row for each leaf: whole (epochs that are taken whole), last_key and last_id
    (the end of the prefix of the epoch after them, null if it is empty).
    """
    scratch = Scratch(documents.sparkSession, "mix")
    levels = list(path)
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), *_nodes(path), word_count(F.col(text_col)).alias("n_tokens"))
    rows = scratch.write("rows", rows)
    leaves = rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    planned = leaf_budgets(scratch.write("leaves", leaves), levels, weights, budget, epochs).where("tokens > 0")
    planned = planned.select(*levels, "rows", F.expr("budget div tokens").alias("whole"), F.expr("budget % tokens").alias("part"))
    planned = planned.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("rows") / F.greatest(F.lit(BUCKET_ROWS), F.floor(F.sqrt("rows"))))).cast("long"))
    planned = scratch.write("planned", planned)

    placed = rows.join(planned.where("part > 0"), levels).withColumn("key", _key(seed, F.col("whole"), F.col("doc_id")))
    placed = placed.withColumn("bucket", F.floor(F.col("key") / F.lit(float(1 << KEY_BITS)) * F.col("buckets")).cast("long"))
    placed = placed.select("doc_id", *levels, "n_tokens", "part", "key", "bucket")
    totals = placed.groupBy(*levels, "bucket").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.partitionBy(*levels).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*levels, "bucket", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    totals = scratch.write("totals", totals)
    running = F.sum("n_tokens").over(Window.partitionBy(*levels, "bucket").orderBy("key", F.coalesce("doc_id", F.lit(NO_ID))))  # with ties
    reached = placed.join(totals, [*levels, "bucket"]).where("before <= part").withColumn("reached", F.col("before") + running)
    last = reached.where("reached <= part").groupBy(*levels).agg(F.max(F.struct("key", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"))).alias("last"))
    ends = planned.select(*levels, "whole").join(last, levels, "left")
    return Mixture(rows, scratch.write("ends", ends.select(*levels, "whole", F.col("last.key").alias("last_key"), F.col("last.id").alias("last_id"))), levels, seed)


def _nodes(path: dict[str, Column]) -> list[Column]:
    return [F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in path.items()]


def taken(rows: DataFrame, mixture: Mixture, id_col: str = "doc_id") -> DataFrame:
    """``rows`` (with the path's columns) as often as the mixture takes them, with their epoch.

    Decided row by row against the ends of the leaves' prefixes, so rows are neither sorted nor joined
    with lists of ids.
    """
    placed = rows.join(mixture.planned, mixture.levels)
    key = _key(mixture.seed, F.col("whole"), F.col(id_col).cast("long"))
    place = F.struct(key.alias("key"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"))
    more = F.coalesce(place <= F.struct(F.col("last_key").alias("key"), F.col("last_id").alias("id")), F.lit(False)) & F.col("last_key").isNotNull()
    count = F.col("whole") + F.when(more, 1).otherwise(0)
    return placed.withColumn("_taken", count).where("_taken > 0").withColumn("epoch", F.explode(F.expr("sequence(0L, _taken - 1)"))).drop("whole", "last_key", "last_id", "_taken")


def mix_sources(documents: DataFrame, path: dict[str, Column], weights: list[str], budget: tuple[int, int] = (3, 5), epochs: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the path's columns, epoch, n_tokens): one row for each time a document is taken.

    ``path`` names the levels of the tree, top first, and how a document's node is found; ``weights``
    gives for each level a positive whole number as SQL over the path's columns.  No leaf gets more
    tokens than its budget, nor more than ``epochs`` epochs.

    Cases: a null in a path is the group ''.  A null text has no tokens; a leaf without tokens has no
    budget and none of its rows is taken.  Rows with the same id, or without one, are taken together.
    An empty table gives an empty result; other columns are ignored.
    """
    mixture = plan_mixture(documents, path, weights, budget, epochs, seed, id_col, text_col)
    return taken(mixture.rows, mixture).select("doc_id", *mixture.levels, "epoch", "n_tokens")


def mix_documents(documents: DataFrame, path: dict[str, Column], weights: list[str], budget: tuple[int, int] = (3, 5), seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` that the mixture takes in one epoch, with the columns they have."""
    mixture = plan_mixture(documents, path, weights, budget, 1, seed, id_col, text_col)
    inner = {f"_level_{i}": n for i, n in enumerate(mixture.levels)}
    ends = Mixture(mixture.rows, mixture.planned.select(*[F.col(n).alias(k) for k, n in inner.items()], "whole", "last_key", "last_id"), list(inner), seed)
    nodes = [F.coalesce(path[n].cast("string"), F.lit("")).alias(k) for k, n in inner.items()]
    named = documents.select(F.struct(*documents.columns).alias("_row"), F.col(id_col).cast("long").alias("_id"), *nodes)
    return taken(named, ends, "_id").select("_row.*")
