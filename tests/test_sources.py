"""Sources, the versioned store and feeds on small fixtures."""

import json
import os
import struct
import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import ingest
from loomgraph.sources import commit, documents, tables
from loomgraph.sources.leases import Leases
from loomgraph.streaming import feed
from loomgraph.streaming.outbox import Outbox

MAPPING = tables.Mapping("Problem", "title", ("detail", "severity"), ("id",), tags="tags", parents=(("parent_id", "Causes"),))
ROWS = [(1, "First", "d1", "high", "a,b", None), (2, None, "d2", None, None, "1"), (None, "no key", "d", "low", None, "1"), (3, "x" * 300, None, None, None, "9")]
SCHEMA = "id long, title string, detail string, severity string, tags string, parent_id string"


def test_rows_become_drafts(spark, tmp_path):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    rows = {r.pk: r for r in tables.drafts(frame, MAPPING, "s").collect()}
    assert set(rows) == {"1", "2", "3"} and rows["2"].title == "2" and len(rows["3"].title) == 200
    assert rows["1"].content == "detail: d1\nseverity: high" and rows["1"].tags == ["a", "b"]
    assert tuple(tables.skipped(frame, MAPPING).first()) == (1, 3)
    links = {(r.parent_pk, r.to_id) for r in tables.parent_edges(tables.drafts(frame, MAPPING, "s")).collect()}
    assert links == {("1", rows["1"].memory_id), ("9", None)}
    with pytest.raises(ValueError):
        tables.drafts(frame.drop("detail"), MAPPING, "s")
    for i in range(2):
        frame.where(F.col("id") == i + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    assert tables.parquet_folder(spark, str(tmp_path / "p")).count() == 2
    first = tables.folder_digest(spark, str(tmp_path / "p")).first()
    assert first.files == 2 and tables.folder_digest(spark, str(tmp_path / "p")).first() == first
    spark.range(1).write.mode("append").parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError):
        tables.parquet_folder(spark, str(tmp_path / "p"))


def delta(tmp_path, spark, commits):
    spark.createDataFrame([(1, "a")], "id long, name string").coalesce(1).write.parquet(str(tmp_path / "data"))
    name = next(p.name for p in (tmp_path / "data").iterdir() if p.name.startswith("part-"))
    (tmp_path / "data" / name).rename(tmp_path / "f.parquet")
    (tmp_path / "_delta_log").mkdir()
    for i, actions in enumerate(commits):
        (tmp_path / "_delta_log" / f"{i:020d}.json").write_text("\n".join(map(json.dumps, actions)))
    return str(tmp_path)


META = {"metaData": {"schemaString": json.dumps({"fields": [{"name": "id", "type": "long"}, {"name": "name", "type": "string"}, {"name": "day", "type": "string"}]}), "partitionColumns": ["day"], "configuration": {}}}
ADD = {"add": {"path": "f.parquet", "partitionValues": {"day": "mon"}, "size": 1}}


def test_delta_log_is_replayed(spark, tmp_path):
    path = delta(tmp_path, spark, [[{"protocol": {"minReaderVersion": 1}}, META, ADD, {"add": {"path": "gone.parquet", "partitionValues": {}, "size": 1}}], [{"remove": {"path": "gone.parquet"}}]])
    assert [tuple(r) for r in tables.delta_table(spark, path).collect()] == [("1", "a", "mon")]
    assert tables.delta_state(spark, path).version == "1"


def test_delta_checkpoints_of_parts_and_files_of_one_name(spark, tmp_path):
    path = delta(tmp_path, spark, [])
    for day in ("mon", "tue é+1"):
        (tmp_path / f"day={day}").mkdir()
        spark.createDataFrame([(day,)], "who string").coalesce(1).write.parquet(str(tmp_path / "tmp" / day))
        os.rename(next((tmp_path / "tmp" / day).glob("*.parquet")), tmp_path / f"day={day}" / "part-0.parquet")
    schema = json.dumps({"type": "struct", "fields": [{"name": n, "type": "string"} for n in ("who", "day")]})
    added = lambda day, name: {"path": f"day={name}/part-0.parquet", "partitionValues": {"day": day}, "size": 1}
    types = "add struct<path:string,partitionValues:map<string,string>,size:bigint>, metaData struct<schemaString:string,partitionColumns:array<string>,configuration:map<string,string>>"
    parts = [[(added("mon", "mon"), None)], [(added("tue é+1", "tue%20%C3%A9+1"), None), (None, (schema, ["day"], {}))]]
    for i, rows in enumerate(parts, 1):
        spark.createDataFrame(rows, types).coalesce(1).write.parquet(str(tmp_path / "tmp" / f"c{i}"))
        os.rename(next((tmp_path / "tmp" / f"c{i}").glob("*.parquet")), tmp_path / "_delta_log" / f"{3:020d}.checkpoint.{i:010d}.{2:010d}.parquet")
    (tmp_path / "_delta_log" / f"{9:020d}.checkpoint.{1:010d}.{2:010d}.parquet").touch()  # its other part was never written
    got = sorted(tuple(r) for r in tables.delta_table(spark, path).collect())
    assert got == [("mon", "mon"), ("tue é+1", "tue é+1")] and tables.delta_state(spark, path).version == "3"
    assert tables.delta_checkpoint(["1.checkpoint.parquet", "2.checkpoint.0.2.parquet", "2.checkpoint.1.2.parquet", "x.json"]) == (2, ["2.checkpoint.0.2.parquet", "2.checkpoint.1.2.parquet"])
    assert tables.delta_checkpoint([]) == (-1, [])


@pytest.mark.parametrize("bad", [{"protocol": {"minReaderVersion": 3}}, {"add": {**ADD["add"], "deletionVector": {"storageType": "u"}}}, {"metaData": {**META["metaData"], "configuration": {"delta.columnMapping.mode": "name"}}}])
def test_delta_features_that_are_not_read(spark, tmp_path, bad):
    path = delta(tmp_path, spark, [[META, ADD], [bad]])
    with pytest.raises(ValueError):
        tables.delta_state(spark, path)


def zigzag(n):
    n, out = (n << 1) ^ (n >> 63), b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def text(s):
    s = s if isinstance(s, bytes) else s.encode()
    return zigzag(len(s)) + s


def avro(schema, rows, codec):
    body = b"".join(rows)
    if codec == "deflate":
        c = zlib.compressobj(wbits=-15)
        body = c.compress(body) + c.flush()
    head = b"Obj\x01" + zigzag(2) + text("avro.schema") + text(json.dumps(schema)) + text("avro.codec") + text(codec) + zigzag(0)
    return head + b"M" * 16 + zigzag(len(rows)) + zigzag(len(body)) + body + b"M" * 16


def test_avro_types():
    schema = {"type": "record", "name": "r", "fields": [{"name": "s", "type": "string"}, {"name": "n", "type": ["null", "long"]}, {"name": "d", "type": "double"}, {"name": "a", "type": {"type": "array", "items": "int"}}, {"name": "m", "type": {"type": "map", "values": "boolean"}}, {"name": "f", "type": {"type": "fixed", "name": "x", "size": 2}}, {"name": "e", "type": {"type": "enum", "name": "y", "symbols": ["p", "q"]}}]}
    row = text("é") + zigzag(1) + zigzag(-70) + struct.pack("<d", 1.5) + zigzag(2) + zigzag(1) + zigzag(2) + zigzag(0) + zigzag(1) + text("k") + b"\x01" + zigzag(0) + b"zz" + zigzag(1)
    for codec in ("null", "deflate"):
        assert tables.avro_records(avro(schema, [row, row], codec)) == [{"s": "é", "n": -70, "d": 1.5, "a": [1, 2], "m": {"k": True}, "f": b"zz", "e": "q"}] * 2


@pytest.mark.parametrize("deleted", [False, True])
def test_iceberg_snapshot_is_read(spark, tmp_path, deleted):
    path = delta(tmp_path, spark, [])
    entry = {"type": "record", "name": "entry", "fields": [{"name": "status", "type": "int"}, {"name": "data_file", "type": {"type": "record", "name": "file", "fields": [{"name": "file_path", "type": "string"}, {"name": "file_format", "type": "string"}, {"name": "partition", "type": {"type": "record", "name": "part", "fields": [{"name": "day", "type": "string"}]}}]}}]}
    row = lambda status, p: zigzag(status) + text(p) + text("PARQUET") + text("tue")
    (tmp_path / "metadata").mkdir()
    (tmp_path / "metadata" / "m.avro").write_bytes(avro(entry, [row(1, "s3://t/f.parquet"), row(2, "s3://t/old.parquet")], "null"))
    listed = {"type": "record", "name": "m", "fields": [{"name": "manifest_path", "type": "string"}, {"name": "content", "type": "int"}]}
    (tmp_path / "metadata" / "l.avro").write_bytes(avro(listed, [text("s3://t/metadata/m.avro") + zigzag(int(deleted))], "deflate"))
    fields = [{"id": i, "name": n, "type": t} for i, (n, t) in enumerate((("id", "long"), ("name", "string"), ("day", "string")), 1)]
    for i, current in ((1, None), (2, 7)):
        meta = {"location": "s3://t", "schemas": [{"schema-id": 0, "fields": fields}], "current-schema-id": 0, "current-snapshot-id": current, "snapshots": [{"snapshot-id": 7, "manifest-list": "s3://t/metadata/l.avro"}], "partition-specs": [{"fields": [{"name": "day", "transform": "identity", "source-id": 3}]}]}
        (tmp_path / "metadata" / f"v{i}.metadata.json").write_text(json.dumps(meta))
    if deleted:
        with pytest.raises(ValueError):
            tables.iceberg_state(spark, path)
    else:
        assert [tuple(r) for r in tables.iceberg_table(spark, path).collect()] == [("1", "a", "tue")]


def test_changes_are_mapped(spark):
    lines = [
        {"action": "I", "table": "t", "columns": [{"name": "id", "value": "1"}, {"name": "v", "value": "x"}], "identity": []},
        {"action": "U", "table": "t", "columns": [{"name": "v", "value": "y"}], "identity": [{"name": "id", "value": "1"}]},
        {"action": "D", "table": "t", "identity": [{"name": "id", "value": "1"}]},
        {"action": "I", "table": "t", "columns": [{"name": "id", "value": None}]},
        {"action": "T", "table": "t"},
        {"action": "I", "table": "other", "columns": []},
        {"action": "Z", "table": "t"},
    ]
    events = documents.changes(spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(lines)], "n int, value string"))
    got = {r.n: (r.verdict, r.pk) for r in documents.mapped_changes(events, "t", ["id"]).collect()}
    assert got == {0: ("row", "1"), 1: ("row", "1"), 2: ("delete", "1"), 3: ("null_key", None), 4: ("skip", None), 5: ("skip", None), 6: ("unknown", None)}


def test_history_and_trackers(spark):
    line = lambda *f: "\x1f".join(f)
    log = spark.createDataFrame([(line("s1", "a", "a@b", "2024-01-01T00:00:00Z", "fix: it", "body", "\n src/a.py\nb.md\n"),), (line("s2", "a", "a@b", "2024-01-02T00:00:00Z", "add", "body", "\nb.md\n"),), ("broken",), (" ",)], "value string")
    commits = documents.git_log(log)
    assert commits.where("NOT good").count() == 1
    made, edges = documents.git_drafts(commits, "r")
    assert sorted(r.memory_type for r in made.collect()) == ["Command", "FileContext", "FileContext", "Fix"] and edges.count() == 3
    assert {r.title for r in made.collect()} == {"fix: it", "add", "src/a.py", "b.md"}
    issues = spark.createDataFrame([(1, "i", "b", ["a BUG"], "open", "2024-01-01T00:00:00Z", None), (2, "j", "b", [], "open", "2024-01-01T00:00:00Z", None)], documents.ISSUE)
    pulls = spark.createDataFrame([(10, "p", "b", True, [1, 2], "2024-01-01T00:00:00Z", None), (11, "q", "b", False, [2], "2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z"), (12, "r", "b", True, [], "2024-01-01T00:00:00Z", None)], documents.PULL)
    made, edges = documents.tracker_drafts(issues, pulls, "r")
    assert {r.title: (r.memory_type, r.valid_until) for r in made.collect()} == {"i": ("Problem", None), "j": ("Task", None), "p": ("Fix", None), "q": ("Solution", datetime(2024, 2, 1)), "r": ("Command", None)}
    assert sorted(r.kind for r in edges.collect()) == ["Fixes", "RelatedTo", "Solves"]


def test_budgets_and_windows(spark):
    log = spark.createDataFrame([(f"s{i}\x1fa\x1fe\x1f2024-01-{i + 1:02d}T00:00:00Z\x1fs\x1fb\x1f\nf{i}\n",) for i in range(9)], "value string")
    made, _ = documents.git_drafts(documents.git_log(log), "r", rows=7)
    assert made.where("memory_type = 'Command'").count() == 3  # two rows each, a commit and its file
    rows = spark.range(25).selectExpr("CAST(id AS STRING) AS n", "id AS updatedAt").repartition(5)
    sizes = {r.window: r["count"] for r in documents.windows(rows, 10).groupBy("window").count().collect()}
    assert sizes == {0: 10, 1: 10, 2: 5}
    assert documents.cursor(rows, truncated=True).first().cursor == 23


def test_store_versions(spark, tmp_path):
    store = commit.Store(spark, str(tmp_path))
    frame = spark.range(300).selectExpr("id", "id % 7 AS v")
    assert store.version() == 0 and store.read("t") is None
    store.append("t", frame, ["id"], key=("p", "1"))
    store.append("t", frame, ["id"], key=("p", "1"))
    assert store.version() == 1 and store.read("t").count() == 300
    store.append("t", frame, ["id"], key=("p", "2"))
    assert sorted(r.version_lsn for r in store.read("t").collect()) == list(range(1, 601))
    assert store.read("t", 1).count() == 300
    with pytest.raises(RuntimeError):
        store.commit({"t": frame}, expected=1)
    # a commit writes its own rows only: versions share folders
    one, two = (store.manifest(v)["tables"]["t"] for v in (1, 2))
    assert two[:1] == one and len(two) == 2
    store.commit({"u": frame}, added={"t": frame.selectExpr("id", "'x' AS more")})
    assert store.manifest()["tables"]["t"][:2] == two and store.read("t").where("more = 'x'").count() == 300 and store.read("u").count() == 300
    # a writer that loses the race leaves nothing behind
    before = sorted(str(p) for p in (tmp_path / "data").rglob("*.parquet"))
    (tmp_path / "_claims" / "4").touch()
    with pytest.raises(RuntimeError):
        store.commit({"u": frame.limit(1)})
    assert store.version() == 3 and sorted(str(p) for p in (tmp_path / "data").rglob("*.parquet")) == before
    os.utime(tmp_path / "_claims" / "4", (0, 0))  # its writer never came back
    assert store.commit({"u": frame.limit(1)}) == 4 and store.read("u").count() == 1
    store.forget(3)
    assert store.versions() == [1, 2, 4] and store.read("t", 4).count() == 900 and store.read("t", 1).count() == 300
    assert not (tmp_path / store_folder(before, "u")).exists()


def store_folder(files, table):
    return os.path.dirname(next(f for f in files if f"/{table}/" in f))


def test_events_are_stored_by_batch_and_compacted(spark, tmp_path):
    schema = "key long, lsn long, state string, op string"
    for i in range(3):
        rows = [(k, 10 * i + k, f"s{i}", "MemoryDeleted" if k == i else "MemoryUpserted") for k in range(i, 4)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = commit.Store(spark, str(tmp_path / "store"))
    for _ in range(2):  # the second run finds nothing new
        feed.apply_stream(feed.stream_of(spark, str(tmp_path / "in"), schema, 1), store, "users", str(tmp_path / "checkpoint")).awaitTermination()
    assert store.version() == 3 and len(store.manifest()["tables"]["users"]) == 3
    want = {(3, 23, "s2")}
    assert {tuple(r) for r in feed.stored_snapshot(store, "users").collect()} == want
    assert feed.compact(store, "users") == 4 and len(store.manifest()["tables"]["users"]) == 1
    assert {tuple(r) for r in feed.stored_snapshot(store, "users").collect()} == want and feed.stored_snapshot(store, "none") is None


def test_export_and_restore(spark, tmp_path):
    nodes = spark.createDataFrame([("a",), ("b",)], "memory_id string")
    edges = spark.createDataFrame([("r", "a", "b")], "rel_id string, from_id string, to_id string")
    commit.export({"memories": nodes, "edges": edges}, str(tmp_path))
    schemas = {"memories": "memory_id string", "edges": "rel_id string, from_id string, to_id string"}
    assert commit.restored(spark, str(tmp_path), schemas, "f", "f")["edges"].count() == 1
    with pytest.raises(ValueError):
        commit.restored(spark, str(tmp_path), schemas, "f", "g")
    commit.export({"memories": nodes.where("memory_id = 'a'"), "edges": edges}, str(tmp_path))
    with pytest.raises(ValueError):
        commit.restored(spark, str(tmp_path), schemas, "f", "f")


def test_feed_is_applied_in_order(spark):
    snapshot = spark.createDataFrame([("a", 1, "old"), ("b", 2, "old")], "key string, lsn long, state string")
    events = spark.createDataFrame([("a", 5, "new", "MemoryUpserted"), ("a", 4, "late", "MemoryUpserted"), ("b", 6, None, "MemoryDeleted"), ("c", 7, "c", "MemoryUpserted")], "key string, lsn long, state string, op string")
    assert {tuple(r) for r in feed.applied(snapshot, events).collect()} == {("a", 5, "new"), ("c", 7, "c")}
    seed = spark.createDataFrame([(None, 6, None, "GraphReseed")], events.schema)
    assert {tuple(r) for r in feed.applied(snapshot, events.unionByName(seed)).collect()} == {("c", 7, "c")}
    assert feed.replay(events, 2)[0] == "TooOld" and [r.lsn for r in feed.replay(events, 5)[1].collect()] == [6, 7]
    assert feed.replay(events.limit(0), 0)[0] == "Fresh"


def test_effects_are_claimed_renewed_and_cleaned(spark, tmp_path):
    start = datetime(2024, 1, 1)
    at = lambda seconds: start + timedelta(seconds=seconds)
    box = Outbox(commit.Store(spark, str(tmp_path)))
    assert box.claim("a", start, 10) is None and box.pending(5).count() == 0
    effects = spark.createDataFrame([("e2", "y"), ("e1", "x"), ("e1", "x")], "effect_id string, payload string")
    box.add(effects)
    box.add(effects)
    assert [r.effect_id for r in box.pending(5).collect()] == ["e1", "e2"]
    first = box.claim("a", start, 10)
    assert (first["effect_id"], first["generation"]) == ("e1", 1) and box.claim("b", at(9), 10) is None
    assert box.renew("e1", "a", at(9), 10) and not box.renew("e1", "b", at(9), 10) and not box.renew("e9", "a", at(9), 10)
    assert box.claim("b", at(15), 10) is None  # held longer
    again = box.claim("b", at(20), 10)
    assert (again["effect_id"], again["generation"]) == ("e1", 2) and not box.acknowledge("e1", "a", at(21)) and not box.renew("e1", "a", at(21), 10)
    assert not box.clean("e1", 2) and box.acknowledge("e1", "b", at(21)) and not box.acknowledge("e1", "b", at(21))
    assert [r.effect_id for r in box.cleanups(5).collect()] == ["e1"] and not box.clean("e1", 1) and box.clean("e1", 2) and not box.clean("e1", 2)
    assert box.cleanups(5).count() == 0 and [r.effect_id for r in box.pending(5).collect()] == ["e2"] and box.claim("b", at(22), 1)["generation"] == 3


def test_uneven_log_entries_give_nothing(spark):
    schema = "entry long, session string, memories array<struct<memory_type:string,title:string,content:string>>, memory_ids array<string>, tags array<array<string>>, links array<struct<from:int,to:int,to_id:string,kind:string>>"
    draft = ("Fix", "t", "c")
    rows = [(1, "s", [draft, draft], ["a", "b"], [[" X ", "x"]], [(0, 1, None, "Uses"), (0, 7, None, "Uses"), (-1, 0, None, "Uses"), (1, None, "k", "Fixes")]), (2, "s", [draft], ["c", "d"], None, []), (3, "", None, ["e"], None, None), (4, None, [draft], ["f"], None, None)]
    nodes, links, dropped = ingest.materialized(spark.createDataFrame(rows, schema), spark.createDataFrame([("k",)], "memory_id string"))
    found = {r.memory_id: r for r in nodes.collect()}
    assert {"a", "b", "f"} < set(found) and len(found) == 4 and found["a"].tags == ["x"] and found["b"].tags == [] and found["f"].importance == 0.5
    assert sorted((r.from_id, r.kind) for r in links.collect()) == [("a", "InSession"), ("a", "Uses"), ("b", "Fixes"), ("b", "InSession")]
    assert sorted((r.entry, r.reason) for r in dropped.collect()) == [(1, "no end"), (1, "no end"), (2, "uneven"), (3, "uneven")]


def test_leases_have_one_owner(spark, tmp_path):
    start = datetime(2024, 1, 1)
    at = lambda seconds: start + timedelta(seconds=seconds)
    store = commit.Store(spark, str(tmp_path))
    held = Leases(store)
    one, other = held.acquire("k", "a", at(0), 10), held.acquire("j", "b", at(0), 10)
    assert (one.epoch, other.epoch) == (1, 1) and held.acquire("k", "b", at(5), 10) is None
    one = held.renew(one, at(8))
    assert one.until == at(18) and held.acquire("k", "b", at(12), 10) is None
    two = held.acquire("k", "b", at(18), 10)
    assert two.epoch == 2 and held.renew(one, at(19)) is None and not held.holds(one, at(19)) and held.holds(two, at(19))
    held.release(one, at(19))  # lost already: changes nothing
    assert held.holds(two, at(19))
    held.commit(two, at(19), {"t": spark.range(3)})
    with pytest.raises(RuntimeError):
        held.commit(one, at(19), {"t": spark.range(3)})
    held.release(two, at(20))
    assert held.acquire("k", "c", at(20), 10).epoch == 3 and store.read("t").count() == 3
