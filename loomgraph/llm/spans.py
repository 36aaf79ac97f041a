"""Digest columns of span lists, shared by the queries of span-finding operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def listed(spans: Column, kinds: tuple[str, ...]) -> Column:
    """'kind:start:stop' joined by commas, by start, then kind in the order of ``kinds``, then stop."""
    order = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("k"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    words = F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))
    return F.array_join(words, ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def base_of(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["base"])
