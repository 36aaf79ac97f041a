"""Table sources: Parquet folders, Delta and Iceberg tables, JSON lines; all projected to drafts.

A mapping declares which columns make the title, the content, the key, the tags and the parent.
Columns are never inferred, only mapped ones are read, and cells are rendered as text.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.scalars import derived_id, schema_hash, title_of

KEY_SEPARATOR = "\x1f"


@dataclass(frozen=True)
class Mapping:
    """How rows of a table become drafts; ``parents`` are (column, kind)."""

    memory_type: str
    title: str
    content: tuple[str, ...]
    pk: tuple[str, ...]
    tags: str | None = None
    parents: tuple[tuple[str, str], ...] = ()
    version: int = 1

    def columns(self) -> list[str]:
        named = [self.title, *self.content, *self.pk, *([self.tags] if self.tags else []), *[c for c, _ in self.parents]]
        return list(dict.fromkeys(named))

    def check(self, available: list[str]) -> None:
        """An error names what is missing or empty."""
        if not self.pk or not self.content:
            raise ValueError("a mapping needs key and content columns")
        missing = [c for c in self.columns() if c not in available]
        if missing:
            raise ValueError(f"unknown columns: {', '.join(missing)}")


def declared(frame: DataFrame) -> list[tuple[str, str]]:
    """(name, type) of every column, as the schema hash reads them."""
    return [(f.name, f.dataType.simpleString()) for f in frame.schema]


def declared_hash(frame: DataFrame) -> DataFrame:
    """One row with the schema's digest, which does not depend on the order of columns."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type")) for n, t in declared(frame)])
    return frame.sparkSession.range(1).select(schema_hash(pairs).alias("schema_hash"))


def drafts(frame: DataFrame, mapping: Mapping, source: str) -> DataFrame:
    """(pk, memory_id, memory_type, title, content, tags, parents) of rows with a whole key."""
    mapping.check(frame.columns)
    cells = frame.select(*[F.col(c).cast("string").alias(c) for c in mapping.columns()])
    keyed = cells.where(~without_key(mapping))
    pk = F.concat_ws(KEY_SEPARATOR, *mapping.pk)
    content = F.array_join(F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c))) for c in mapping.content]), lambda x: x.isNotNull()), "\n")
    tags = F.split(F.col(mapping.tags), ",") if mapping.tags else F.array().cast("array<string>")
    parents = F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("pk"), F.lit(k).alias("kind"))) for c, k in mapping.parents] or [F.lit(None).cast("struct<pk:string,kind:string>")]), lambda p: p.isNotNull())
    title = title_of(F.coalesce(F.when(F.trim(mapping.title) != "", F.col(mapping.title)), pk))
    rows = keyed.select(pk.alias("pk"), F.lit(mapping.memory_type).alias("memory_type"), title.alias("title"), content.alias("content"), tags.alias("tags"), parents.alias("parents"))
    return rows.withColumn("memory_id", derived_id("external", F.lit(source), F.col("pk")))


def without_key(mapping: Mapping) -> Column:
    """Rows whose key has a null or empty part; they are skipped and counted."""
    bad = F.lit(False)
    for c in mapping.pk:
        bad |= F.col(c).isNull() | (F.col(c).cast("string") == "")
    return bad


def skipped(frame: DataFrame, mapping: Mapping) -> DataFrame:
    return frame.agg(F.count_if(without_key(mapping)).alias("skipped"), F.count_if(~without_key(mapping)).alias("kept"))


def parent_edges(rows: DataFrame) -> DataFrame:
    """Drafts' links to parents in the same window: (from_id, to_id, kind), to_id null if it is missing."""
    links = rows.select(F.col("memory_id").alias("from_id"), F.explode("parents").alias("p")).select("from_id", F.col("p.pk").alias("parent_pk"), F.col("p.kind").alias("kind"))
    ends = rows.select(F.col("pk").alias("parent_pk"), F.col("memory_id").alias("to_id"))
    return links.join(ends, "parent_pk", "left").select("from_id", "to_id", "kind", "parent_pk")


# --- files ------------------------------------------------------------------------------------


def parquet_folder(spark: SparkSession, path: str) -> DataFrame:
    """All Parquet files of a folder; an error if their schemas differ."""
    files = sorted(f.getPath().toString() for f in _listed(spark, path) if f.getPath().getName().endswith(".parquet"))
    if not files:
        raise ValueError(f"no Parquet files in {path}")
    schemas = {tuple(declared(spark.read.parquet(f))) for f in files}
    if len(schemas) > 1:
        raise ValueError(f"files of {path} have different schemas")
    return spark.read.parquet(*files)


def folder_digest(spark: SparkSession, path: str) -> DataFrame:
    """One row (snapshot_id, files): digest of the files' names and contents, in the order of names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("digest"))
    lines = F.array_sort(F.collect_list(F.concat_ws(":", "name", "digest")))
    return named.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("snapshot_id"), F.count("*").alias("files"))


def _listed(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.sc().hadoopConfiguration()).listStatus(target)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema; a line that does not fit is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def resolution_corpus(spark: SparkSession, corpus: str, labelled: str) -> tuple[DataFrame, DataFrame]:
    """Records and labelled pairs; an error if a pair names a record that is not there."""
    records = json_lines(spark, corpus, "id string, name string, attributes map<string,string>")
    pairs = json_lines(spark, labelled, "a string, b string, label string")
    named = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if not named.join(records, "id", "left_anti").isEmpty():
        raise ValueError("a labelled pair names a missing record")
    return records, pairs


# --- Delta ------------------------------------------------------------------------------------

DELTA_ACTIONS = (
    "add struct<path:string,partitionValues:map<string,string>,size:bigint,deletionVector:struct<storageType:string>>, remove struct<path:string>, "
    "metaData struct<schemaString:string,partitionColumns:array<string>,configuration:map<string,string>>, protocol struct<minReaderVersion:int,readerFeatures:array<string>>"
)


@dataclass(frozen=True)
class TableState:
    """The files that make up a table's current version."""

    files: DataFrame
    schema: list[tuple[str, str]]
    version: str
    partitions: list[str] = field(default_factory=list)


def delta_checkpoint(names: list[str]) -> tuple[int, list[str]]:
    """The version and files of the newest complete checkpoint among a log's names; -1 and none if there is none.

    A checkpoint is one file, or parts whose names tell how many there are; one that misses parts is passed over.
    """
    found: dict[int, list[str]] = {}
    parts: dict[tuple[int, int], dict[int, str]] = {}
    for name in names:
        if m := re.fullmatch(r"([0-9]+)\.checkpoint\.parquet", name):
            found[int(m[1])] = [name]
        elif m := re.fullmatch(r"([0-9]+)\.checkpoint\.([0-9]+)\.([0-9]+)\.parquet", name):
            parts.setdefault((int(m[1]), int(m[3])), {})[int(m[2])] = name
    for (version, total), files in parts.items():
        if len(files) == total:
            found.setdefault(version, [files[i] for i in sorted(files)])
    base = max(found, default=-1)
    return base, found.get(base, [])


def delta_state(spark: SparkSession, path: str) -> TableState:
    """The live files of a Delta table: commits after the last checkpoint, the latest action of a path."""
    log = f"{path}/_delta_log"
    names = [f.getPath().getName() for f in _listed(spark, log)]
    base, checkpoint = delta_checkpoint(names)
    commits = sorted(n for n in names if n.endswith(".json") and n[:20].isdigit() and int(n[:20]) > base)
    if not commits and base < 0:
        raise ValueError(f"no commits in {log}")
    wanted = [base + 1 + i for i in range(len(commits))]
    if [int(n[:20]) for n in commits] != wanted:
        raise ValueError("a commit is missing")
    frames = []
    if commits:
        actions = spark.read.schema(DELTA_ACTIONS).json([f"{log}/{n}" for n in commits])
        frames.append(actions.withColumn("version", F.regexp_extract(F.input_file_name(), r"(\d{20})\.json", 1).cast("long")))
    if base >= 0:
        kept = spark.read.parquet(*[f"{log}/{n}" for n in checkpoint])
        present = [c for c in ("add", "remove", "metaData", "protocol") if c in kept.columns]
        names_json = kept.select(F.to_json(F.struct(*present)).alias("j")).select(F.from_json("j", DELTA_ACTIONS).alias("a")).select("a.*")
        frames.append(names_json.withColumn("version", F.lit(base).cast("long")))
    actions = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    if not actions.where("protocol.minReaderVersion > 2").isEmpty():
        raise ValueError("this table needs a newer reader")
    if not actions.where("add.deletionVector IS NOT NULL").isEmpty():
        raise ValueError("deletion vectors are not read")
    meta = actions.where("metaData IS NOT NULL").orderBy(F.desc("version")).select("metaData.*").first()
    if meta is None:
        raise ValueError("a table without metadata")
    if (meta["configuration"] or {}).get("delta.columnMapping.mode", "none") != "none":
        raise ValueError("column mapping is not read")
    changes = actions.select(F.coalesce("add.path", "remove.path").alias("path"), F.col("add").isNotNull().alias("live"), "add.partitionValues", "version").where("path IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("version"), F.desc("live")))
    live = changes.withColumn("rank", rank).where("rank = 1 AND live").select(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))).alias("path"), "partitionValues")
    fields = [(f["name"], f["type"] if isinstance(f["type"], str) else json.dumps(f["type"])) for f in json.loads(meta["schemaString"])["fields"]]
    version = str(int(commits[-1][:20]) if commits else base)
    return TableState(live, fields, version, list(meta["partitionColumns"] or []))


def read_files(spark: SparkSession, path: str, state: TableState) -> DataFrame:
    """Rows of the live files as text, partition columns from the table's log."""
    rows = state.files.collect()  # the list of files, as any scan plans it
    names = [n for n, _ in state.schema]
    schema = ", ".join(f"`{n}` string" for n in names)
    if not rows:
        return spark.createDataFrame([], schema)
    inside = [n for n in names if n not in state.partitions]
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = target.getFileSystem(spark._jsc.sc().hadoopConfiguration()).makeQualified(target).toString()
    data = spark.read.parquet(*[r["path"] if "://" in r["path"] or r["path"].startswith("/") else f"{path}/{r['path']}" for r in rows])
    read = F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))
    cells = data.select(*[(F.col(n) if n in data.columns else F.lit(None)).cast("string").alias(n) for n in inside], _rooted(read).alias("_file"))
    place = F.when(F.col("path").contains("://") | F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit(whole + "/"), "path"))
    joined = cells.join(state.files.select(_rooted(place).alias("_file"), "partitionValues"), "_file", "left")
    return joined.select(*[F.element_at("partitionValues", n).alias(n) if n in state.partitions else F.col(n) for n in names])


def _rooted(path: Column) -> Column:
    """A whole path without its scheme, which is written in several ways: files of one name in two folders differ."""
    return F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:/*|^/+", "/")


def delta_table(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path, delta_state(spark, path))


# --- Iceberg ----------------------------------------------------------------------------------


def avro_records(data: bytes) -> list[dict]:
    """The records of an Avro object container file with null or deflate blocks."""
    if data[:4] != b"Obj\x01":
        raise ValueError("not an Avro file")
    at = 4

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return (value >> 1) ^ -(value & 1)

    def take(size: int) -> bytes:
        nonlocal at
        at += size
        return data[at - size : at]

    def blocks(item):
        while count := number():
            if count < 0:
                number()
            for _ in range(abs(count)):
                yield item()

    named: dict = {}

    def read(kind):
        if isinstance(kind, list):
            return read(kind[number()])
        if isinstance(kind, dict):
            name = kind.get("name")
            if name:
                named[name] = kind
            t = kind["type"]
            if t == "record":
                return {f["name"]: read(f["type"]) for f in kind["fields"]}
            if t == "array":
                return list(blocks(lambda: read(kind["items"])))
            if t == "map":
                return dict(blocks(lambda: (take(number()).decode(), read(kind["values"]))))
            if t == "fixed":
                return take(kind["size"])
            if t == "enum":
                return kind["symbols"][number()]
            return read(t)
        if kind in ("int", "long"):
            return number()
        if kind == "string":
            return take(number()).decode()
        if kind == "bytes":
            return take(number())
        if kind == "boolean":
            return take(1) == b"\x01"
        if kind in ("float", "double"):
            return struct.unpack("<f" if kind == "float" else "<d", take(4 if kind == "float" else 8))[0]
        return None if kind == "null" else read(named[kind])

    meta = dict(blocks(lambda: (take(number()).decode(), take(number()))))
    schema, codec, mark, out = json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null"), take(16), []
    if codec not in (b"null", b"deflate"):
        raise ValueError(f"Avro codec {codec.decode()} is not read")
    while at < len(data):
        count, body = number(), take(number())
        if take(16) != mark:
            raise ValueError("a block ends wrongly")
        outer, place = data, at
        data, at = zlib.decompress(body, -15) if codec == b"deflate" else body, 0
        out += [read(schema) for _ in range(count)]
        data, at = outer, place
    return out


def _bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def iceberg_state(spark: SparkSession, path: str) -> TableState:
    """The live Parquet files of an Iceberg table's current snapshot; delete files are refused."""
    names = [f.getPath().getName() for f in _listed(spark, f"{path}/metadata") if f.getPath().getName().endswith(".metadata.json")]
    if not names:
        raise ValueError(f"no metadata in {path}")
    order = lambda n: int("".join(c for c in n.split("-")[0].split(".")[0] if c.isdigit()) or 0)
    meta = json.loads(_bytes(spark, f"{path}/metadata/{max(names, key=order)}"))
    schemas = meta.get("schemas") or [meta["schema"]]
    schema = next((s for s in schemas if s.get("schema-id") == meta.get("current-schema-id")), schemas[-1])
    fields = [(f["name"], f["type"] if isinstance(f["type"], str) else json.dumps(f["type"])) for f in schema["fields"]]
    current = meta.get("current-snapshot-id")
    snapshot = next((s for s in meta.get("snapshots", []) if s["snapshot-id"] == current), None)
    live = []
    place = lambda p: p.replace(meta["location"], path, 1) if p.startswith(meta["location"]) else p
    for manifest in avro_records(_bytes(spark, place(snapshot["manifest-list"]))) if snapshot else []:
        if manifest.get("content", 0) != 0:
            raise ValueError("delete files are not read")
        for entry in avro_records(_bytes(spark, place(manifest["manifest_path"]))):
            file = entry["data_file"]
            if entry["status"] == 2:
                continue
            if file.get("content", 0) != 0 or file["file_format"].upper() != "PARQUET":
                raise ValueError("only Parquet data files are read")
            live.append((place(file["file_path"]), {k: None if v is None else str(v) for k, v in (file.get("partition") or {}).items()}))
    specs = meta.get("partition-specs") or [{"fields": meta.get("partition-spec", [])}]
    by_id = {f.get("id"): f["name"] for f in schema["fields"]}
    identity = [f["name"] for f in specs[-1]["fields"] if f["transform"] == "identity" and by_id.get(f["source-id"]) == f["name"]]
    files = spark.createDataFrame(live, "path string, partitionValues map<string,string>")
    return TableState(files, fields, str(current), identity)


def iceberg_table(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path, iceberg_state(spark, path))


def check_iceberg_mapping(mapping: Mapping, state: TableState, transformed: list[str]) -> None:
    """Columns that exist only as a transformed partition value may not be mapped."""
    bad = [c for c in mapping.columns() if c in transformed and c not in state.partitions]
    if bad:
        raise ValueError(f"columns behind a transform cannot be mapped: {', '.join(bad)}")
