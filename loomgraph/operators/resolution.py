"""Probabilistic entity resolution: blocking, comparison, weights from labelled pairs, decisions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from loomgraph.functions.scalars import blocking_keys, token_jaccard, without_legal_forms
from loomgraph.session import Steps

BAND = 0.85
OUTCOMES = ("Exact", "Similar", "Different", "Missing")


def folded(text: str) -> str:
    """Lower case, each character by itself."""
    return "".join(map(str.lower, text))


def jaro_similarity(a: str, b: str) -> float:
    """Share of characters, whatever their case, that match within half the longer length, less the transpositions.

    Transpositions are whole pairs, as in Winkler's program and DuckDB: an odd character out of place, as of
    three that change places in a circle, is not counted as half a pair.
    """
    a, b = folded(a), folded(b)
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    hits = []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if not used[j] and b[j] == c), None)
        if j is not None:
            used[j] = True
            hits.append(c)
    if not hits:
        return 0.0
    swapped = sum(x != y for x, y in zip(hits, (c for c, u in zip(b, used, strict=True) if u), strict=True)) // 2
    m = len(hits)
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def winkler(a: str, b: str) -> float:
    """Jaro raised for a common prefix of up to four characters, only above 0.7."""
    base = jaro_similarity(a, b)
    if base <= 0.7:
        return base
    a, b = folded(a), folded(b)
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return base + 0.1 * same * (1 - base)


def _compared(measure: Callable[[str, str], float], a: pd.Series, b: pd.Series) -> pd.Series:
    """A measure of two columns; each pair of values of a batch is compared once."""
    pairs = list(zip(a, b, strict=True))
    known = {(x, y): None if x is None or y is None else measure(x, y) for x, y in set(pairs)}
    return pd.Series([known[p] for p in pairs], dtype=float)


@pandas_udf(DoubleType())
def jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    return _compared(jaro_similarity, a, b)


@pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return _compared(winkler, a, b)


def band(a: Column, b: Column, least: float = BAND) -> Column:
    """Exact, Missing, Similar or Different; a null counts as missing."""
    x, y = F.lower(F.trim(F.coalesce(a, F.lit("")))), F.lower(F.trim(F.coalesce(b, F.lit(""))))
    absent = a.isNull() | b.isNull() | (((x == "") | (y == "")) & (x != y))
    return F.when(absent, "Missing").when(x == y, "Exact").when(jaro_winkler(x, y) >= least, "Similar").otherwise("Different")


def token_band(a: Column, b: Column, least: float = BAND) -> Column:
    return F.when(without_legal_forms(a) == without_legal_forms(b), "Exact").when(token_jaccard(a, b) >= least, "Similar").otherwise("Different")


def _keyed(corpus: DataFrame) -> DataFrame:
    """(id, keys): rows that repeat an id are one record with all keys."""
    return corpus.select("id", blocking_keys(F.col("name"), F.col("attributes")).alias("keys")).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"))


def candidates(corpus: DataFrame, block_rows: int = 1024) -> DataFrame:
    """Pairs a < b of records (id, name, attributes) that share a blocking key, each once.

    No key is left out.  The records of a frequent key are dealt into blocks and pairs of blocks are
    joined, so a hot key is many tasks; a pair is sent by the first key that its records share, which
    needs no comparison of all pairs afterwards.  Rows that repeat an id are one record with all keys.
    """
    rows = _keyed(corpus).select("id", "keys", F.explode("keys").alias("key"))
    sizes = rows.groupBy("key").agg(F.expr(f"(count(*) + {block_rows - 1}) div {block_rows}").alias("blocks"), F.count("*").alias("n")).where("n > 1")
    placed = rows.join(sizes.drop("n"), "key").withColumn("at", F.pmod(F.xxhash64("id"), F.col("blocks")))
    left = placed.select("key", F.col("id").alias("x"), F.col("keys").alias("x_keys"), F.col("at").alias("i"), F.explode(F.sequence(F.col("at"), F.col("blocks") - 1)).alias("j"))
    right = placed.select("key", F.col("id").alias("y"), F.col("keys").alias("y_keys"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("at"))).alias("i"), F.col("at").alias("j"))
    pairs = left.join(right, ["key", "i", "j"]).where("x < y OR i < j").where(F.col("key") == F.array_min(F.array_intersect("x_keys", "y_keys")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


#: Records with more keys that others share too are compared pair by pair when partners are counted.
MOST_KEYS = 8
#: Ids are counted in parts of at most 2 ** this many.
PART_BITS = 11


def partners(corpus: DataFrame, most_keys: int = MOST_KEYS) -> DataFrame:
    """(a, partners, first, last): of each record with ``candidates`` a < b how many there are, and the least and the last b.

    The pairs are not formed.  The later records that share some key with a are counted by inclusion and
    exclusion over the sets of a's keys: those that hold a whole set come from the order of the set's holders.
    The ids are numbered in order first, so the holders of a hot key are counted by parts.  A record has at most
    2 ** ``most_keys`` - 1 such sets; pairs with a record of more keys are joined and counted.
    """
    steps = Steps(corpus.sparkSession)
    rows = _keyed(corpus).select("id", F.explode("keys").alias("key"))
    shared = rows.join(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "key")
    dealt = shared.groupBy("id").agg(F.array_sort(F.collect_list("key")).alias("keys")).repartitionByRange("id").sortWithinPartitions("id")
    place = F.monotonically_increasing_id()  # in the order of ids; written once, as ranges may fall differently when they are dealt again
    dealt = steps.keep(dealt.withColumn("part", F.shiftright(place, PART_BITS)))
    wide = F.size("keys") > most_keys

    sets = F.expr("transform(sequence(1, shiftleft(1, size(keys)) - 1), m -> filter(keys, (k, i) -> (shiftright(m, i) & 1) = 1))")
    held = dealt.where(~wide).select("id", "part", F.explode(sets).alias("held"))
    downwards = Window.partitionBy("held").orderBy(F.desc("part"))
    before, whole = downwards.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("held")
    parts = held.groupBy("held", "part").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    parts = parts.select("held", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("above"), F.lag("low").over(downwards).alias("beyond"), F.max("high").over(whole).alias("highest"))
    within = Window.partitionBy("held", "part").orderBy(F.desc("id"))
    placed = held.withColumn("place", F.row_number().over(within) - 1).withColumn("next", F.lag("id").over(within)).join(parts, ["held", "part"])
    later, single = F.col("place") + F.col("above"), F.size("held") == 1
    sign = F.when(F.size("held") % 2 == 1, 1).otherwise(-1)
    last = F.when(single & (later > 0), F.col("highest"))
    few = placed.groupBy("id").agg(F.sum(sign * later).alias("n"), F.min(F.when(single, F.coalesce("next", "beyond"))).alias("first"), F.max(last).alias("last"))

    exploded = dealt.select("id", "keys", wide.alias("wide"), F.explode("keys").alias("key"))
    x = exploded.where("wide").select("key", F.col("id").alias("x"), F.col("keys").alias("x_keys"))
    y = exploded.select("key", F.col("id").alias("y"), F.col("keys").alias("y_keys"), F.col("wide").alias("y_wide"))
    pairs = x.join(y, "key").where("x < y OR (NOT y_wide AND x <> y)").where(F.col("key") == F.array_min(F.array_intersect("x_keys", "y_keys")))
    pairs = pairs.select(F.least("x", "y").alias("id"), F.greatest("x", "y").alias("b"))
    many = pairs.groupBy("id").agg(F.count("*").alias("n"), F.min("b").alias("first"), F.max("b").alias("last"))
    both = few.unionByName(many).groupBy(F.col("id").alias("a")).agg(F.sum("n").alias("partners"), F.min("first").alias("first"), F.max("last").alias("last"))
    return both.where("partners > 0")


def compared(pairs: DataFrame, corpus: DataFrame, attributes: list[str]) -> DataFrame:
    """``pairs`` with slots, a map from feature to outcome."""
    x = corpus.select(F.col("id").alias("a"), F.col("name").alias("na"), F.col("attributes").alias("aa"))
    y = corpus.select(F.col("id").alias("b"), F.col("name").alias("nb"), F.col("attributes").alias("ab"))
    joined = pairs.join(x, "a").join(y, "b")
    slots = [F.lit("name"), band(without_legal_forms(F.col("na")), without_legal_forms(F.col("nb"))), F.lit("name_tokens"), token_band(F.col("na"), F.col("nb"))]
    for key in attributes:
        either = F.map_contains_key("aa", key) | F.map_contains_key("ab", key)
        slots += [F.lit(f"attr:{key}"), F.when(either, band(F.element_at("aa", key), F.element_at("ab", key)))]
    return joined.select(*pairs.columns, F.map_filter(F.create_map(*slots), lambda _, v: v.isNotNull()).alias("slots"))


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios by (slot, outcome), and the two thresholds."""

    weights: dict[tuple[str, str], float]
    accept: float
    review: float


def probabilities(labelled: DataFrame) -> DataFrame:
    """(slot, outcome, m, u): smoothed shares of outcomes among matches and non-matches."""
    rows = labelled.select("label", F.explode("slots").alias("slot", "outcome"))
    counts = rows.groupBy("slot", "outcome").agg(F.count_if(F.col("label") == "match").alias("cm"), F.count_if(F.col("label") != "match").alias("cu"))
    totals = counts.groupBy("slot").agg(F.sum("cm").alias("tm"), F.sum("cu").alias("tu"))
    every = totals.select("slot", "tm", "tu", F.explode(F.array(*[F.lit(o) for o in OUTCOMES])).alias("outcome")).join(counts, ["slot", "outcome"], "left")
    share = lambda c, t: (F.coalesce(c, F.lit(0)) + 1) / (F.col(t) + 4)
    return every.select("slot", "outcome", "tm", "tu", share(F.col("cm"), "tm").alias("m"), share(F.col("cu"), "tu").alias("u"))


def scored(pairs: DataFrame, shares: DataFrame) -> DataFrame:
    """``pairs`` with the sum of ln(m / u) over their slots; unknown slots add nothing."""
    keys = [c for c in pairs.columns if c != "slots"]
    rows = pairs.select(*keys, F.explode("slots").alias("slot", "outcome")).join(F.broadcast(shares.select("slot", "outcome", "m", "u")), ["slot", "outcome"], "left")
    return rows.groupBy(*keys).agg(F.round(F.coalesce(F.sum(F.log(F.col("m") / F.col("u"))), F.lit(0.0)), 6).alias("score"))


def thresholds(labelled_scores: DataFrame) -> DataFrame:
    """One row (accept, review): three quarters of the way from the middle to each label's mean."""
    means = labelled_scores.agg(F.avg(F.when(F.col("label") == "match", F.col("score"))).alias("mm"), F.avg(F.when(F.col("label") != "match", F.col("score"))).alias("mu"))
    middle = (F.col("mm") + F.col("mu")) / 2
    return means.select((middle + 0.75 * (F.col("mm") - middle)).alias("accept"), (middle - 0.75 * (middle - F.col("mu"))).alias("review"))


def estimate(labelled: DataFrame) -> Model:
    """A model from labelled comparisons; needs both labels, and non-matches for every slot."""
    shares = probabilities(labelled)
    rows = shares.collect()  # four rows for each slot
    if any(r["tu"] == 0 for r in rows):
        raise ValueError("a feature is seen only in matches")
    limits = thresholds(scored(labelled.select("a", "b", "label", "slots"), shares)).first()
    if limits is None or limits["accept"] is None:
        raise ValueError("both matches and non-matches are needed")
    import math

    return Model({(r["slot"], r["outcome"]): math.log(r["m"] / r["u"]) for r in rows}, limits["accept"], limits["review"])


def decision(score: Column, accept: Column, review: Column) -> Column:
    return F.when(score >= accept, "match").when(score >= review, "review").otherwise("non_match")


def evaluated(decided: DataFrame) -> DataFrame:
    """One row with the confusion table, precision, recall and F1 from (label, decision)."""
    hit, said = F.col("label") == "match", F.col("decision") == "match"
    row = decided.agg(F.count_if(hit & said).alias("tp"), F.count_if(~hit & said).alias("fp"), F.count_if(hit & ~said).alias("fn"), F.count_if(~hit & ~said).alias("tn"))
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    row = row.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    both = F.col("precision") + F.col("recall")
    return row.withColumn("f1", F.round(ratio(2 * F.col("precision") * F.col("recall"), both), 6)).withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))
