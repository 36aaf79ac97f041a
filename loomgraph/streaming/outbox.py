"""Effects that follow a commit, delivered at least once: claimed, renewed, acknowledged, cleaned up.

Every change is a new version of an effect's row in a versioned store, committed against the version that
was read, so of two workers that claim at the same time one is refused.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from loomgraph.operators.temporal import latest
from loomgraph.sources.commit import Store

EFFECT = "effect_id string, payload string, seq long, generation long, token string, until timestamp, acknowledged boolean, cleaned boolean"


class Outbox:
    """The effects in one table of a store."""

    def __init__(self, store: Store, table: str = "effects"):
        self.store, self.table = store, table

    def rows(self) -> DataFrame:
        """The newest version of each effect."""
        found = self.store.read(self.table)
        return self.store.spark.createDataFrame([], EFFECT) if found is None else latest(found, "effect_id", "seq")

    def add(self, effects: DataFrame) -> int:
        """New effects (effect_id, payload); those that are known, or repeated, change nothing."""
        version = self.store.version()
        new = effects.dropDuplicates(["effect_id"]).join(self.rows().select("effect_id"), "effect_id", "left_anti")
        new = new.select("effect_id", "payload", F.lit(0).cast("long").alias("seq"), *[F.lit(None).cast(t).alias(n) for n, t in (("generation", "long"), ("token", "string"), ("until", "timestamp"))], F.lit(False).alias("acknowledged"), F.lit(False).alias("cleaned"))
        return self.store.commit({}, version, {self.table: new})

    def pending(self, limit: int) -> DataFrame:
        """Effects that are not acknowledged, by id; at most ``limit``."""
        return self.rows().where("NOT acknowledged").orderBy("effect_id").limit(limit)

    def claim(self, token: str, at: datetime, seconds: float) -> Row | None:
        """The first effect that is free, held for some time; None while another one is held.

        A claim that ran out is free again.  Each claim has a generation of its own, so a worker that
        comes back late can be told from the one that has the effect now.
        """
        version, rows = self.store.version(), self.rows()
        held = (F.col("until") > F.lit(at)) & ~F.col("acknowledged")
        if not rows.where(held).isEmpty():
            return None
        first = rows.where("NOT acknowledged").orderBy("effect_id").first()
        if first is None:
            return None
        generation = self.store.manifest(version)["lsns"].get(f"{self.table}-generation", 0) + 1
        return self._change(first, version, {f"{self.table}-generation": generation}, generation=generation, token=token, until=at + timedelta(seconds=seconds))

    def _change(self, row: Row, version: int, lsns: dict[str, int] | None = None, **values) -> Row:
        new = {**row.asDict(), **values, "seq": row["seq"] + 1}
        names = [f.split(" ")[0] for f in EFFECT.split(", ")]
        frame = self.store.spark.createDataFrame([tuple(new[n] for n in names)], EFFECT).coalesce(1)
        self.store.commit({}, version, {self.table: frame}, lsns)
        return Row(**new)

    def _one(self, test: Column) -> tuple[int, Row | None]:
        version = self.store.version()
        return version, self.rows().where(test).first()

    def _held(self, effect_id: str, token: str, at: datetime) -> Column:
        return (F.col("effect_id") == effect_id) & (F.col("token") == token) & (F.col("until") > F.lit(at)) & ~F.col("acknowledged")

    def renew(self, effect_id: str, token: str, at: datetime, seconds: float) -> bool:
        """Hold a claimed effect longer; False if this worker does not hold it any more."""
        version, row = self._one(self._held(effect_id, token, at))
        return row is not None and bool(self._change(row, version, until=at + timedelta(seconds=seconds)))

    def acknowledge(self, effect_id: str, token: str, at: datetime) -> bool:
        """The effect is delivered; False if this worker does not hold it any more."""
        version, row = self._one(self._held(effect_id, token, at))
        return row is not None and bool(self._change(row, version, acknowledged=True, token=None, until=None))

    def cleanups(self, limit: int) -> DataFrame:
        """Delivered effects whose traces are still to be removed, by id; at most ``limit``."""
        return self.rows().where("acknowledged AND NOT cleaned AND generation IS NOT NULL").orderBy("effect_id").limit(limit)

    def clean(self, effect_id: str, generation: int) -> bool:
        """The traces of one delivery are gone; False for another generation."""
        version, row = self._one((F.col("effect_id") == effect_id) & (F.col("generation") == generation) & F.col("acknowledged") & ~F.col("cleaned"))
        return row is not None and bool(self._change(row, version, cleaned=True))
