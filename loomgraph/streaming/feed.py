"""Ordered change feeds: replay, applying to a snapshot, gates, and write counters.

Order is by lsn, and lateness is an lsn below the next one expected; event time plays no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType

from loomgraph.sources.commit import Store

#: The operations of the change feed.
OPERATIONS = ["MemoryUpserted", "MemoryDeleted", "RelationshipUpserted", "RelationshipDeleted", "VisibilityChanged", "DiscoveryStored", "DiscoveryAccepted", "AuditAppended", "GraphReseed"]


def applied(snapshot: DataFrame, events: DataFrame, key: str = "key", lsn: str = "lsn") -> DataFrame:
    """The snapshot after events: the newest lsn of a key wins, a deletion removes it.

    A reseed drops every row and event that is older.  Both sides have the same columns besides op.  An lsn
    names one change of a key; of two with the same one either may win.
    """
    columns = snapshot.columns
    seed = events.where("op = 'GraphReseed'").agg(F.max(lsn).alias("_seed"))
    rows = snapshot.withColumn("op", F.lit("MemoryUpserted")).unionByName(events.where("op <> 'GraphReseed'").select(*columns, "op"))
    rows = rows.join(F.broadcast(seed), F.lit(True)).where(F.col("_seed").isNull() | (F.col(lsn) >= F.col("_seed"))).drop("_seed")
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(lsn)).alias("_v"))
    return best.where(~F.col("_v.op").endswith("Deleted")).select(*[F.col(c) if c == key else F.col(f"_v.{c}").alias(c) for c in columns])


def replay(retained: DataFrame, since: int, lsn: str = "lsn") -> tuple[str, DataFrame]:
    """('Fresh', events after ``since``), or 'TooOld' if some of them are no longer retained."""
    low = retained.agg(F.min(lsn)).first()[0]
    if low is not None and since + 1 < low:
        return "TooOld", retained.limit(0)
    return "Fresh", retained.where(F.col(lsn) > since).orderBy(lsn)


def synchronised(snapshot: DataFrame, since: int, retained: DataFrame, source: Callable[[], tuple[DataFrame, int]], key: str = "key", lsn: str = "lsn") -> tuple[DataFrame, int, str]:
    """A client's rows brought up to date: (rows, the lsn they are of, how).

    ``hydrated`` without a snapshot yet (``since`` below 0), ``tailed`` by the events after ``since``, and
    ``reseeded`` from the source, which gives its rows and their lsn, if some of the events are no longer retained.
    """
    if since < 0:
        return *source(), "hydrated"
    status, events = replay(retained, since, lsn)
    if status == "TooOld":
        return *source(), "reseeded"
    newest = events.agg(F.max(lsn)).first()[0]
    return applied(snapshot, events, key, lsn), since if newest is None else newest, "tailed"


def frontier(events: DataFrame, key: str, lsn: str = "lsn") -> DataFrame:
    """(key, floor, frontier, n): what is retained of each feed."""
    return events.groupBy(key).agg(F.min(lsn).alias("floor"), F.max(lsn).alias("frontier"), F.count("*").alias("n"))


def visible_events(events: DataFrame, visible: DataFrame, key: str = "memory_id") -> DataFrame:
    """Events about rows that a subscriber may see, and all deletions, which carry no content."""
    return events.where("op LIKE '%Deleted'").unionByName(events.where("op NOT LIKE '%Deleted'").join(visible.select(key), key, "left_semi").select(*events.columns))


GATE_STATE = "next_lsn long, held array<long>"


def gate(events: DataFrame, key: str = "org", lsn: str = "lsn", first: int = 0, wait_ms: int | None = 5000) -> DataFrame:
    """A stream of (org, lsn, status): lsns in order, held back until the ones before have come.

    ``released`` is the next in order, ``stale`` was there before, and ``gap`` says that the missing
    ones did not come in time: subscribe again from there.  A feed's state holds the lsns that wait, which
    are as many as come before a missing one: give ``wait_ms`` where that can last.  Without ``wait_ms`` there is no such time;
    a query with one keeps running batches, so it needs a trigger that is stopped from outside.
    """

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        upcoming, held = state.get if state.exists else (first, [])
        upcoming, waiting, out = int(upcoming), {int(x) for x in held}, []
        if state.hasTimedOut:
            state.update((upcoming, sorted(waiting)))
            yield pd.DataFrame([(keys[0], upcoming, "gap")], columns=["org", "lsn", "status"])
            return
        for batch in batches:
            for n in batch[lsn].tolist():
                if n < upcoming or n in waiting:
                    out.append((keys[0], n, "stale"))
                else:
                    waiting.add(n)
        while upcoming in waiting:
            waiting.remove(upcoming)
            out.append((keys[0], upcoming, "released"))
            upcoming += 1
        state.update((upcoming, sorted(waiting)))
        if waiting and wait_ms is not None:
            state.setTimeoutDuration(wait_ms)
        yield pd.DataFrame(out, columns=["org", "lsn", "status"])

    return events.select(F.col(key).cast("string").alias("org"), F.col(lsn).cast("long").alias(lsn)).groupBy("org").applyInPandasWithState(step, "org string, lsn long, status string", GATE_STATE, "append", GroupStateTimeout.NoTimeout if wait_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


#: Fixed value: messages that are published together.
MOST_PUBLISHED = 256


def published(events: DataFrame, most: int = MOST_PUBLISHED) -> DataFrame:
    """``events`` with the publish that each is sent in: in their order, at most ``most`` at a time.

    A task sends one publish after the other, so the triggers of a stream do not have to be as small as a
    publish.  Its name is of the trigger, the task's partition and a number: a trigger that is repeated gives the same.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, number, held = f"{task.getLocalProperty('streaming.sql.batchId') or 0}-{task.partitionId()}", 0, None

        def one(rows: pa.Table) -> pa.RecordBatch:
            return rows.append_column("publish", pa.array([f"{name}-{number}"] * rows.num_rows)).combine_chunks().to_batches()[0]

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            while held.num_rows >= most:
                yield one(held.slice(0, most))
                held, number = held.slice(most), number + 1
        if held is not None and held.num_rows:
            yield one(held)

    return events.mapInArrow(send, StructType([*events.schema.fields, StructField("publish", StringType())]))


def apply_stream(events: DataFrame, store: Store, table: str, checkpoint: str):
    """A running query that adds each micro-batch of events to the store's table, each batch once.

    What a batch costs does not depend on the rows before it: the events are kept, and
    ``stored_snapshot`` applies them when the table is read.
    """

    def batch(frame: DataFrame, number: int) -> None:
        name = f"{table}-batches"
        done = store.read(name)
        if done is not None and not done.where(F.col("batch") == number).isEmpty():
            return
        entry = frame.sparkSession.createDataFrame([(number,)], "batch long").coalesce(1)
        store.commit({}, added={table: frame, name: entry})

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_snapshot(store: Store, table: str, key: str = "key", version: int | None = None) -> DataFrame | None:
    """The rows that the events of ``apply_stream`` leave, or None before the first batch."""
    events = store.read(table, version)
    return None if events is None else applied(events.limit(0).drop("op"), events, key)


def compact(store: Store, table: str, key: str = "key") -> int:
    """Replace the table's events by one for each row that is left; deletions are no longer needed then."""
    rows = stored_snapshot(store, table, key)
    return store.version() if rows is None else store.commit({table: rows.withColumn("op", F.lit("MemoryUpserted"))}, expected=store.version())


def counted(effects: DataFrame) -> DataFrame:
    """Writes of each region from effects (effect_id, org, project, memory_type, memories, edges), each once."""
    once = effects.dropDuplicates(["effect_id"])
    return once.groupBy("org", "project", "memory_type").agg(F.sum("memories").alias("memory_writes"), F.sum("edges").alias("edge_writes"), F.max("at").alias("last_write"))


def stream_of(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A stream over the files of a folder, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
