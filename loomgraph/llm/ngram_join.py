"""N-gram Jaccard join by vertical partitioning.

All n-grams have one global order: rarer ones before more frequent ones, then by number.  The order is cut
into fragments at some frequencies, each document's set is cut with it, overlaps of two documents are
counted in each fragment on its own, and the counts are summed for each pair.

What keeps the join exact and far from all pairs:

* Equal sets become one class, and only classes are compared.  A class is a row of its own even where
  rows repeat an id; such ids tie their classes together when components are formed.
* A document can only link if the n-grams it shares with others reach the threshold.  That is first
  tested on the n-grams with the smallest numbers, a little more of a set than two linked documents may
  differ in, which drops most documents; documents left are tested on their whole sets.
* Candidates share an n-gram at places in the order, and with sizes, that still allow a link.
* In a list of candidates for one n-gram, all are first compared with the list's hub, the document whose
  n-gram comes first.  Whoever links to it is in the hub's component; only documents of other components
  are then compared with the rest of the list, so a group of copies costs its size and not its square.
* Lists of frequent n-grams are cut by salts: hubs are found among the salts' hubs, and rows that meet
  many others are repeated for the salts those are in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.components import connected_components
from loomgraph.llm.prefilter import with_ids
from loomgraph.llm.scratch import Scratch
from loomgraph.llm.shingles import digest, shingle_sets

#: The global order is cut after n-grams that are in so many sets.
FRAGMENT_ENDS = (2, 3, 7, 31)
#: Parts of a list when its hub is sought, and rows that one repeated row meets.
SALTS, SPREAD = 32, 256


def first_bound(percent: int) -> int:
    """Numbers below this are tested first: 5/4 of the share in which linked sets may differ, and 1/64 more."""
    return min((1 << 64) - 1, (1 << 64) * 5 * (100 - percent) // 400 + (1 << 58))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _sets(words: int, percent: int) -> Callable:
    """id, n, digest, n_low and grams: the n_low numbers below the bound, or all if a link needs none of those."""
    bound = np.uint64(first_bound(percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), words))
            low = [int(np.searchsorted(s, bound)) for s in sets]
            grams = [s if k <= len(s) - (len(s) * percent + 99) // 100 else s[:k] for s, k in zip(sets, low, strict=True)]
            digests = [digest(s, batch.column(1)[i].as_py() if len(s) == 1 else "", words) if len(s) else None for i, s in enumerate(sets)]
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(low, pa.int64()), _lists(grams)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "digest", "n_low", "grams"])

    return run


def _whole(words: int) -> Callable:
    """(key, n, grams): whole sets of the classes that a row is wanted for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, s in enumerate(shingle_sets(batch.column(0), words)):
                own = digest(s, batch.column(0)[i].as_py() if len(s) == 1 else "", words) if len(s) else None
                found += [(w["key"], s) for w in batch.column(1)[i].as_py() if w["digest"] == own]
            sizes = pa.array([len(s) for _, s in found], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), sizes, _lists([s for _, s in found])], ["key", "n", "grams"])

    return run


def _needed(percent: int, n: str = "n") -> str:
    """The smallest overlap with which a document of ``n`` shingles can reach the threshold."""
    return f"(({n} * {percent} + 99) div 100)"


def _shared(sets: DataFrame) -> DataFrame:
    """(key, df, g): the n-grams that are in two or more of the sets (key, grams)."""
    rows = sets.select("key", F.explode("grams").alias("g"))
    return rows.join(rows.groupBy("g").agg(F.count("*").alias("df")).where("df >= 2"), "g")


def _hopeful(sets: DataFrame, percent: int) -> DataFrame:
    """(key) of the sets (key, n, n_low, grams) that may have a partner.

    A partner misses at most n - needed of a set's n-grams, and thus of those below the bound.  Sets with
    fewer of them are whole here: a partner that shares none of those has as few, and is whole too.
    """
    bound = first_bound(percent)
    low = f"g >= 0 AND g < {bound}" if bound < 1 << 63 else f"g >= 0 OR g < {bound - (1 << 64)}"
    counts = _shared(sets).groupBy("key").agg(F.count_if(F.expr(low)).alias("k_low"))
    return counts.join(sets.select("key", "n", "n_low"), "key").where(f"n_low - k_low <= n - {_needed(percent)}").select("key")


def _ordered(sets: DataFrame, percent: int) -> DataFrame:
    """(key, n, k, grams): the k n-grams that other sets (key, n, grams) have too, as structs (df, g) in the global order."""
    shared = _shared(sets).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("grams"))
    shared = shared.join(sets.select("key", "n"), "key").withColumn("k", F.size("grams").cast("long"))
    return shared.where(f"k >= {_needed(percent)}").select("key", "n", "k", "grams")


def _candidates(ordered: DataFrame, percent: int) -> DataFrame:
    """(g, key, n, most, members, hub, hub_n, hub_most): entries of lists in which a link is possible.

    ``most`` is the largest size of a partner that an entry can reach from its place in the order.
    """
    entries = ordered.select("key", "n", F.expr("n - k").alias("unshared"), F.posexplode(F.expr(f"slice(grams, 1, CAST(k - {_needed(percent)} + 1 AS INT))")).alias("at", "x"))
    entries = entries.select(F.col("x.g").alias("g"), "key", "n", (F.col("unshared") + F.col("at")).alias("place"))
    entries = entries.withColumn("most", F.expr(f"((100 + {percent}) * (n - place)) div {percent} - n")).where(f"most >= {_needed(percent)}")
    entries = entries.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    parts = entries.groupBy("g", "salt").agg(
        F.count("*").alias("members"), F.min("n").alias("least_n"), F.max("most").alias("top"), F.min(F.struct("place", "key", "n", "most")).alias("hub")
    )
    lists = parts.groupBy("g").agg(F.sum("members").alias("members"), F.min("least_n").alias("least_n"), F.max("top").alias("top"), F.min("hub").alias("hub"))
    lists = parts.select("g", "salt").join(lists.where("members > 1"), "g")
    return entries.join(lists, ["g", "salt"]).where("most >= least_n AND n <= top").select(
        "g", "key", "n", "most", "members", F.col("hub.key").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.most").alias("hub_most")
    )


def _fragments(ordered: DataFrame) -> DataFrame:
    """(key, n, fragment, grams): each set cut with the global order."""
    low, parts = 1, []
    for i, high in enumerate((*FRAGMENT_ENDS, (1 << 63) - 1)):
        parts.append(f"struct({i} AS fragment, transform(filter(grams, x -> x.df > {low} AND x.df <= {high}), x -> x.g) AS grams)")
        low = high
    return ordered.select("key", "n", F.expr(f"inline(filter(array({', '.join(parts)}), p -> size(p.grams) > 0))"))


def _links(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs (a, b, spread) whose overlaps, summed over fragments, reach the threshold.

    A row may meet many others as ``a``: its segments are repeated for as many salts as its pairs name.
    """
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.col("spread")).alias("salt"))
    left = segments.select(F.col("key").alias("a"), F.col("n").alias("a_n"), "fragment", F.col("grams").alias("a_grams"))
    left = left.join(pairs.groupBy("a").agg(F.max("spread").alias("spread")), "a")
    left = left.select("a", "a_n", "fragment", "a_grams", F.explode(F.sequence(F.lit(0).cast("long"), F.col("spread") - 1)).alias("salt"))
    right = segments.select(F.col("key").alias("b"), F.col("n").alias("b_n"), "fragment", F.col("grams").alias("b_grams"))
    partial = salted.join(left, ["a", "salt"]).join(right, ["b", "fragment"]).select("a", "b", "a_n", "b_n", F.size(F.array_intersect("a_grams", "b_grams")).alias("overlap"))
    total = partial.groupBy("a", "b", "a_n", "b_n").agg(F.sum("overlap").alias("overlap"))
    return total.where(f"100 * overlap >= {percent} * (a_n + b_n - overlap)").select("a", "b")


def ngram_jaccard_components(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: which documents are linked, directly or not.

    Words are runs of characters other than space and 0x09-0x0D, A-Z in lower case.  A document's set
    holds its distinct shingles of ``words`` words; a shorter text's set is its whole sequence.  Two
    documents link if 100 * intersection >= ``percent`` * union; ``component_id`` is the smallest id
    that can be reached.  No pair is left out, and whole texts count.  Shingles are compared by 64-bit
    numbers and equal sets by 128-bit ones.

    Cases: a null or wordless text has no shingles and stands alone.  A null id stays in the result
    with a null component and links with nothing.  Repeated rows give equal rows.  Rows that repeat an
    id with different texts are one document of several texts: all that is linked to one of them is in
    its component.  Other columns are ignored.  An empty table gives an empty result.
    """
    if not 0 < percent <= 100 or words < 1:
        raise ValueError("percent must be 1 to 100 and words at least 1")
    scratch = Scratch(documents.sparkSession, "ngram")
    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    sets = texts.mapInArrow(_sets(words, percent), "id long, n long, digest binary, n_low long, grams array<long>")
    sets = scratch.write("sets", sets.withColumn("key", F.monotonically_increasing_id()))
    known = sets.where("n > 0 AND id IS NOT NULL")
    # a class of equal sets: its smallest id names it, its first row's key stands for it
    classes = scratch.write("classes", known.groupBy("digest").agg(F.min("id").alias("rep"), F.min("key").alias("key"), F.count("*").alias("members")))
    copies = known.select("key", "digest").join(classes.where("members > 1").select("digest", F.col("key").alias("first")), "digest").where("key <> first")
    single = known.join(copies.select("key"), "key", "left_anti")

    # the texts of documents that may have a partner; one row of each class has its key
    hopeful = scratch.write("hopeful", _hopeful(single.select("key", "n", "n_low", "grams"), percent))
    ids = known.join(hopeful, "key", "left_semi").groupBy("id").agg(F.collect_set(F.struct("digest", "key")).alias("wanted"))
    texts_of = with_ids(texts, scratch.write("ids", ids), "id").select("text", "wanted")
    whole = scratch.write("whole", texts_of.mapInArrow(_whole(words), "key long, n long, grams array<long>"))
    if whole.count() != hopeful.count():  # rows that repeat both id and text
        whole = scratch.write("whole-once", whole.dropDuplicates(["key"]))

    ordered = scratch.write("ordered", _ordered(whole, percent))
    scratch.drop("whole", "whole-once")
    lists = scratch.write("lists", _candidates(ordered, percent))
    segments = scratch.write("segments", _fragments(ordered.join(lists.select("key").distinct(), "key", "left_semi")))
    scratch.drop("ordered")

    spread = F.expr(f"(members + {SPREAD - 1}) div {SPREAD}")
    star = lists.where("key <> hub AND n <= hub_most AND hub_n <= most").groupBy(F.col("hub").alias("a"), F.col("key").alias("b")).agg(F.max(spread).alias("spread"))
    links = scratch.write("links-star", _links(scratch.write("star", star), segments, percent))
    parts = scratch.write("parts", connected_components(links, "a", "b", scratch, "cc-star"))

    # what other components the lists still hold, against the rest of their lists
    named = lists.join(parts.select(F.col("node").alias("key"), F.col("component").alias("key_part")), "key", "left")
    named = named.join(parts.select(F.col("node").alias("hub"), F.col("component").alias("hub_part")), "hub", "left")
    named = named.select("g", "key", "n", "most", spread.alias("spread"), F.coalesce("key_part", "key").alias("part"), F.coalesce("hub_part", "hub").alias("main"))
    named = scratch.write("named", named)
    outer = named.where("part <> main")
    remaining = named.join(outer.select("g").distinct(), "g", "left_semi").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("spread"))).alias("y")
    outer = outer.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("spread") - 1))).alias("x")
    differ = "x.g = y.g AND x.salt = y.salt AND x.part <> y.part AND (y.part = y.main OR x.key < y.key) AND x.n <= y.most AND y.n <= x.most"
    cross = outer.join(remaining, F.expr(differ)).groupBy(F.col("x.key").alias("a"), F.col("y.key").alias("b")).agg(F.max("x.spread").alias("spread"))
    more = scratch.write("links-rest", _links(scratch.write("cross", cross), segments, percent))

    # the classes that an id ties together, and components that are tied or linked by the rest of lists
    of_ids = known.select("id", "digest").join(classes.select("digest", "key"), "digest").groupBy("id").agg(F.min("key").alias("a"), F.max("key").alias("b"))
    several = known.select("id", "digest").join(of_ids.where("a <> b").select("id", "a"), "id").join(classes.select("digest", F.col("key").alias("b")), "digest")
    part = parts.toDF("key", "part")
    extra = more.unionByName(several.select("a", "b")).join(part.toDF("a", "u"), "a", "left").join(part.toDF("b", "v"), "b", "left")
    extra = scratch.write("extra", extra.select(F.coalesce("u", "a").alias("u"), F.coalesce("v", "b").alias("v")).where("u <> v").distinct())
    final = scratch.write("final", connected_components(extra, "u", "v", scratch, "cc-all"))

    of_classes = classes.select("digest", "key", "rep").join(part, "key", "left").withColumn("part", F.coalesce("part", "key"))
    of_classes = of_classes.join(final.toDF("part", "whole"), "part", "left").withColumn("whole", F.coalesce("whole", "part"))
    smallest = of_classes.groupBy("whole").agg(F.min("rep").alias("component_id"))
    of_classes = scratch.write("of-classes", of_classes.join(smallest, "whole").select("digest", "component_id"))
    scratch.keep("sets", "of-classes")
    found = known.select("id", "n", "digest").join(of_classes, "digest").select("id", "n", "component_id")
    alone = sets.where("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component_id"))
    return found.unionByName(alone).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
