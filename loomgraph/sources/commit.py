"""Versioned Parquet tables: a commit writes its new rows and then a manifest of the folders of all tables.

Readers see a version as a whole or not at all.  Folders are never written again, so versions share them
and a commit costs what is new.  A ledger of batch keys makes repeats harmless, audit rows are part of the
same commit, and a commit that expected another version is refused.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.temporal import believed_at, believed_edges, running_total
from loomgraph.session import remove


#: After so long a claimed version without a manifest has no writer any more.
CLAIM_SECONDS = 600


class Store:
    """Tables under one folder, all of one version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.sc().hadoopConfiguration()), target

    def versions(self) -> list[int]:
        """The numbers of the versions that are kept, in order."""
        fs, folder = self._fs(f"{self.path}/_versions")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(folder)) if fs.exists(folder) else []

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{"tables": {name: folders}, "lsns": {name: largest}} of a version."""
        at = self.version() if version is None else version
        fs, path = self._fs(f"{self.path}/_versions/{at}")
        if not at or not fs.exists(path):
            return {"tables": {}, "lsns": {}}
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """A table of a version; columns that only some of its folders have are null elsewhere."""
        folders = self.manifest(version)["tables"].get(table)
        return self.spark.read.option("mergeSchema", len(folders) > 1).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else None

    def commit(self, tables: dict[str, DataFrame], expected: int | None = None, added: dict[str, DataFrame] | None = None, lsns: dict[str, int] | None = None) -> int:
        """Write the next version; refused if ``expected`` is not the current one.

        ``tables`` are replaced by whole ones, to others the rows ``added`` are added, and the rest is
        carried over by name.  The manifest is created only if its number is not there, so of two
        writers of one version only one succeeds; the other's folders are removed.
        """
        now = self.version()
        if expected is not None and expected != now:
            raise RuntimeError(f"version {now} is newer than {expected}")
        manifest = self.manifest(now)
        mark, written = uuid.uuid4().hex, []
        for name, frame in [*tables.items(), *(added or {}).items()]:
            written.append(f"data/{name}/{now + 1}-{mark}")
            frame.write.parquet(f"{self.path}/{written[-1]}")
            before = manifest["tables"].get(name, []) if name not in tables else []
            manifest["tables"][name] = [*before, written[-1]]
        manifest["lsns"] |= lsns or {}
        fs, path = self._fs(f"{self.path}/_versions/{now + 1}")
        fs.mkdirs(path.getParent())
        _, whole = self._fs(f"{self.path}/_open/{mark}")
        stream = fs.create(whole, False)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        if not self._claimed(fs, whole, path, now + 1):
            for folder in written:
                remove(self.spark, f"{self.path}/{folder}")
            raise RuntimeError(f"version {now + 1} was committed by another writer")
        return now + 1

    def _claimed(self, fs, whole, path, number: int) -> bool:
        """Move a whole manifest to its number, if nobody else has claimed that.

        A claim whose writer was lost before the move is given up after ``CLAIM_SECONDS``.
        """
        _, claim = self._fs(f"{self.path}/_claims/{number}")
        try:
            if fs.exists(claim) and not fs.exists(path) and time.time() - fs.getFileStatus(claim).getModificationTime() / 1000 > CLAIM_SECONDS:
                fs.delete(claim, False)
            return bool(fs.createNewFile(claim)) and bool(fs.rename(whole, path))
        except Py4JJavaError:
            return False

    def append(self, table: str, rows: DataFrame, order: list[str], key: tuple[str, str] | None = None, audit: DataFrame | None = None, expected: int | None = None) -> int:
        """Append versions with the next lsns, in the order of some columns.

        With a ``key`` (producer, batch) a repeated batch changes nothing.
        """
        ledger = self.read("ledger") if key else None
        if ledger is not None and not ledger.where((F.col("producer") == key[0]) & (F.col("batch") == key[1])).isEmpty():
            return self.version()
        base = self.manifest()["lsns"].get(table, 0)
        numbered = with_lsns(rows, base, order)
        added = {table: numbered}
        if key:
            added["ledger"] = self.spark.createDataFrame([key], "producer string, batch string").coalesce(1)
        if audit is not None:
            added["audit"] = audit
        return self.commit({}, expected, added, {table: base + numbered.count()})

    def forget(self, version: int) -> None:
        """Remove a version that is no longer read, with the folders that no other version has."""
        kept = {f for v in self.versions() if v != version for folders in self.manifest(v)["tables"].values() for f in folders}
        for folders in self.manifest(version)["tables"].values():
            for folder in set(folders) - kept:
                remove(self.spark, f"{self.path}/{folder}")
        remove(self.spark, f"{self.path}/_versions/{version}")


def with_lsns(rows: DataFrame, base: int, order: list[str]) -> DataFrame:
    """``rows`` with version_lsn after ``base``, without gaps, in the order of some columns."""
    numbered = running_total(rows.drop("version_lsn"), F.lit(1), order, "version_lsn")
    return numbered.withColumn("version_lsn", (F.lit(base) + F.col("version_lsn")).cast("long"))


def closing(current: DataFrame, wanted: DataFrame, key: str, at: Column) -> DataFrame:
    """Closing versions of the wanted rows: the same row with valid_until set."""
    return current.join(wanted, key, "left_semi").withColumn("valid_until", at).select(*current.columns)


def settled(drafts: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Drafts of batches that are not in the ledger yet."""
    return drafts.join(ledger.select(*keys), keys, "left_anti")


def content_batch_id(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row (batch_id): digest of rows that does not depend on their order."""
    digest = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.sha2(F.concat_ws(":", F.sum(digest).cast("string"), F.count("*").cast("string")), 256).alias("batch_id"))


def corpus(memories: DataFrame, edges: DataFrame, cut: Column) -> dict[str, DataFrame]:
    """What a corpus export holds at a cut: memories, edges between them, lineage, and a manifest."""
    nodes = believed_at(memories, cut)
    links = believed_edges(edges, memories, cut)
    lineage = links.where("provenance = 'Derived'").select("rel_id", "rule", F.explode_outer("evidence").alias("evidence"))
    counts = nodes.agg(F.count("*").alias("memories")).join(links.agg(F.count("*").alias("edges"), F.array_sort(F.collect_set(F.when(F.col("kind").isin("SimilarTo", "Summarizes"), F.col("kind")))).alias("computed_kinds")), F.lit(True))
    return {"memories": nodes, "edges": links, "lineage": lineage, "manifest": counts}


def export(parts: dict[str, DataFrame], path: str) -> None:
    for name, frame in parts.items():
        frame.write.mode("overwrite").json(f"{path}/{name}")


def restored(spark: SparkSession, path: str, schemas: dict[str, str], fingerprint: str, expected: str) -> dict[str, DataFrame]:
    """An exported corpus, if it has the expected vocabulary and no edge without its ends."""
    if fingerprint != expected:
        raise ValueError("the export was made with another vocabulary")
    parts = {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items()}
    ends = parts["edges"].select(F.explode(F.array("from_id", "to_id")).alias("memory_id"))
    if not ends.join(parts["memories"], "memory_id", "left_anti").isEmpty():
        raise ValueError("an edge's end is missing")
    return parts
