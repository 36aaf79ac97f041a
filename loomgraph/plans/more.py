"""Queries of governance, remaining sources and sinks, and operators that others are made of."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from loomgraph.functions import scalars
from loomgraph.operators import consolidation, governance, graph, ingest, rules, search, temporal, vectors, visibility
from loomgraph.plans.fixture import AS_OF, CALLER, as_of, edges, memories, records, table, versions
from loomgraph.plans.graphs import COSINE, affinity_sql, composed_sql, facts, shared_sql
from loomgraph.plans.ingestion import change_feed, delta_folder, folder
from loomgraph.plans.reads import KINDS_SQL, LIVE, RECENT_SQL, RECORDS_SQL, TRIPLES_SQL, VERDICT_SQL, batch_and_recent
from loomgraph.plans.registry import query
from loomgraph.schema import kinds_table, triples_table
from loomgraph.session import filesystem
from loomgraph.sources import commit, documents, leases, tables
from loomgraph.streaming import feed
from loomgraph.streaming.outbox import Outbox

# --- sources ----------------------------------------------------------------------------------


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer", plain=True)
def src_02(spark, d):
    """Only mapped columns, as text."""
    return table(spark, d, "customer").select(*[F.col(c).cast("string").alias(c) for c in ("c_custkey", "c_name")])


@query("SELECT ['a', 'b', 'd'][CAST(s_suppkey % 3 + 1 AS INT)] AS part, count(*) AS n FROM supplier GROUP BY 1", plain=True)
def src_05(spark, d):
    """Values of a partition column that the files do not hold."""
    return tables.delta_table(spark, delta_folder(spark, d)).groupBy("part").agg(F.count("*").alias("n"))


def _avro_long(n: int) -> bytes:
    n, out = (n << 1) ^ (n >> 63), b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def _avro_text(value: str | bytes) -> bytes:
    data = value if isinstance(value, bytes) else value.encode()
    return _avro_long(len(data)) + data


def _avro_file(spark, path: str, schema: dict, rows: list[bytes]) -> None:
    """An Avro file with one plain block of encoded records."""
    mark, body = bytes(range(16)), b"".join(rows)
    head = b"Obj\x01" + _avro_long(1) + _avro_text("avro.schema") + _avro_text(json.dumps(schema)) + _avro_long(0)
    _write(spark, path, head + mark + _avro_long(len(rows)) + _avro_long(len(body)) + body + mark)


def _write(spark, path: str, data: bytes) -> None:
    fs, target = filesystem(spark, path)
    stream = fs.create(target, True)
    stream.write(data)
    stream.close()


def iceberg_folder(spark, d) -> str:
    """An Iceberg table of suppliers by part, of which the manifest names one file as deleted."""
    path = folder()
    rows, entries = table(spark, d, "supplier").select("s_suppkey", "s_name"), []
    for part, keep, status in (("a", "s_suppkey % 3 = 0", 1), ("b", "s_suppkey % 3 = 1", 0), ("b", "s_suppkey % 3 = 1 AND s_suppkey < 5", 2), ("c", "s_suppkey % 3 = 2", 1)):
        place = f"{path}/data/{len(entries)}"
        rows.where(keep).coalesce(1).write.parquet(place)
        names = [f.getPath().getName() for f in tables._listed(spark, place)]
        name = next(n for n in names if n.startswith("part-"))
        entries.append(_avro_long(status) + _avro_text(f"s3://t/data/{len(entries)}/{name}") + _avro_text("PARQUET") + _avro_text(part))
    field = lambda name, kind: {"name": name, "type": kind}
    record = lambda name, *fields: {"type": "record", "name": name, "fields": list(fields)}
    file = record("file", field("file_path", "string"), field("file_format", "string"), field("partition", record("values", field("part", "string"))))
    _avro_file(spark, f"{path}/metadata/manifest.avro", record("entry", field("status", "int"), field("data_file", file)), entries)
    _avro_file(spark, f"{path}/metadata/list.avro", record("listed", field("manifest_path", "string"), field("content", "int")), [_avro_text("s3://t/metadata/manifest.avro") + _avro_long(0)])
    fields = [{"id": n, "name": name, "type": kind} for n, (name, kind) in enumerate((("s_suppkey", "long"), ("s_name", "string"), ("part", "string")), 1)]
    meta = {"location": "s3://t", "schemas": [{"schema-id": 0, "fields": fields}], "current-schema-id": 0, "current-snapshot-id": 7, "snapshots": [{"snapshot-id": 7, "manifest-list": "s3://t/metadata/list.avro"}], "partition-specs": [{"fields": [{"name": "part", "transform": "identity", "source-id": 3}, {"name": "bucket", "transform": "bucket[4]", "source-id": 1}]}]}
    _write(spark, f"{path}/metadata/v1.metadata.json", json.dumps(meta).encode())
    return path


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, ['a', 'b', 'c'][CAST(s_suppkey % 3 + 1 AS INT)] AS part FROM supplier", plain=True)
def src_06(spark, d):
    """The live files of an Iceberg table's current snapshot, with their partition values."""
    return tables.iceberg_table(spark, iceberg_folder(spark, d))


@query("SELECT 'part' AS name, TRUE AS mapped UNION ALL SELECT 'bucket', FALSE UNION ALL SELECT 's_name', TRUE", plain=True)
def src_07(spark, d):
    """Which columns a mapping may use: not those that exist only behind a transform."""
    state, out = tables.iceberg_state(spark, iceberg_folder(spark, d)), []
    for name in ("part", "bucket", "s_name"):
        try:
            tables.check_iceberg_mapping(tables.Mapping("Fix", name, (name,), ("s_suppkey",)), state, ["bucket", "part"])
            out.append((name, True))
        except ValueError:
            out.append((name, False))
    return spark.createDataFrame(out, "name string, mapped boolean")


@query("SELECT event_type AS action, count(*) AS n FROM events GROUP BY 1", plain=True)
def src_08(spark, d):
    """Change lines from a stream of files."""
    path, out = folder(), folder()
    line = F.to_json(F.struct(F.lit("I").alias("action"), F.lit("t").alias("table"), F.array(F.struct(F.lit("kind").alias("name"), F.col("event_type").alias("value"))).alias("columns")))
    table(spark, d, "events").select(line.alias("value")).write.mode("overwrite").parquet(path)
    parsed = documents.changes(feed.stream_of(spark, path, "value string", 2))
    parsed.select(F.element_at("columns", "kind").alias("action")).writeStream.format("parquet").option("path", out).option("checkpointLocation", folder()).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("action string").parquet(out).groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN event_type = 'view' THEN 'skip' WHEN event_type = 'error' THEN 'delete' ELSE 'row' END AS verdict FROM events) GROUP BY 1", plain=True)
def src_10(spark, d):
    cells = F.array(F.struct(F.lit("id").alias("name"), F.col("user_id").cast("string").alias("value")))
    action = F.when(F.col("event_type") == "view", "M").when(F.col("event_type") == "error", "D").otherwise("U")
    line = F.to_json(F.struct(action.alias("action"), F.lit("t").alias("table"), cells.alias("identity")))
    events = documents.changes(table(spark, d, "events").select(line.alias("value")))
    return documents.mapped_changes(events, "t", ["id"]).groupBy("verdict").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN doc_id % 9 = 0 THEN 'cut off' ELSE 'sha' || doc_id END AS sha, doc_id % 9 <> 0 AS good, CASE WHEN doc_id % 9 <> 0 THEN [source] ELSE [] END AS files FROM documents", plain=True)
def src_11(spark, d):
    whole = F.concat_ws("\x1f", F.concat(F.lit("sha"), "doc_id"), F.lit("a"), F.lit("e"), F.lit("2024-01-01T00:00:00Z"), F.lit("s"), F.lit("b"), F.concat(F.lit("\n"), "source"))
    log = documents.git_log(table(spark, d, "documents").select(F.when(F.col("doc_id") % 9 == 0, "cut off").otherwise(whole).alias("value")))
    return log.select("sha", "good", "files")


@query("SELECT 's' || s_suppkey AS a, 's' || (s_suppkey - 1) AS b, 'match' AS label, s_name AS name FROM supplier WHERE s_suppkey > 0", plain=True)
def src_16(spark, d):
    path = folder()
    rows = records(spark, d).where("id LIKE 's%'")
    rows.write.mode("overwrite").json(f"{path}/c")
    number = F.substring("id", 2, 9).cast("long")
    rows.where(number > 0).select("id", F.concat(F.lit("s"), number - 1).alias("b")).select(F.col("id").alias("a"), "b", F.lit("match").alias("label")).write.mode("overwrite").json(f"{path}/p")
    corpus, pairs = tables.resolution_corpus(spark, f"{path}/c", f"{path}/p")
    return pairs.join(corpus.select(F.col("id").alias("a"), "name"), "a").select("a", "b", "label", "name")


@query("SELECT user_id AS key, event_id AS lsn, event_type AS state FROM events", plain=True)
def src_18(spark, d):
    """A subscription to the change feed, read to its end."""
    path, out = folder(), folder()
    change_feed(spark, d).write.mode("overwrite").parquet(path)
    feed.stream_of(spark, path, "key long, lsn long, state string, op string", 4).writeStream.format("parquet").option("path", out).option("checkpointLocation", folder()).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("key long, lsn long, state string").parquet(out)


EXPORTED = {"memories": "memory_id string, memory_type string", "edges": "rel_id string, from_id string, to_id string"}


@query("SELECT rel_id, from_id, to_id, memory_type FROM edge JOIN mem ON memory_id = from_id WHERE to_id IN (SELECT memory_id FROM mem)")
def src_19(spark, d):
    """A backup written and read again, with its edges' ends checked."""
    path = folder()
    nodes = memories(spark, d)
    commit.export({"memories": nodes.select("memory_id", "memory_type"), "edges": graph.within(edges(spark, d), nodes).select("rel_id", "from_id", "to_id")}, path)
    parts = commit.restored(spark, path, EXPORTED, "v", "v")
    return parts["edges"].join(parts["memories"].withColumnRenamed("memory_id", "from_id"), "from_id").select("rel_id", "from_id", "to_id", "memory_type")


# --- sinks ------------------------------------------------------------------------------------


@query("SELECT 1 AS version, n_nationkey, n_name FROM nation", plain=True)
def snk_02(spark, d):
    store = commit.Store(spark, folder())
    store.commit({"nation": table(spark, d, "nation")}, expected=0)
    return store.read("nation").select(F.lit(store.version()).alias("version"), "n_nationkey", "n_name")


@query("SELECT TRUE AS refused, count(*) AS n FROM region", plain=True)
def snk_07(spark, d):
    """A commit against an old version is refused and leaves the table as it was."""
    store = commit.Store(spark, folder())
    store.commit({"region": table(spark, d, "region")})
    try:
        store.commit({"region": table(spark, d, "region").limit(0)}, expected=0)
        refused = False
    except RuntimeError:
        refused = True
    return store.read("region").agg(F.count("*").alias("n")).select(F.lit(refused).alias("refused"), "n")


def discoveries(spark, d):
    found = consolidation.transitive_discoveries(edges(spark, d), 40)
    return found.select(F.concat_ws(">", "from_id", "to_id").alias("discovery_id"), "from_id", "to_id", "quality", F.lit("open").alias("state"))


OPEN_PATHS = "(SELECT DISTINCT a.from_id, b.to_id FROM edge a JOIN edge b ON a.to_id = b.from_id WHERE a.provenance <> 'Derived' AND b.provenance <> 'Derived' AND a.from_id <> b.to_id AND NOT EXISTS (SELECT 1 FROM edge x WHERE x.from_id = a.from_id AND x.to_id = b.to_id) ORDER BY 1, 2 LIMIT 40)"


@query(f"SELECT from_id || '>' || to_id AS discovery_id, CASE WHEN from_id LIKE '%1' THEN 'accepted' ELSE 'open' END AS state FROM {OPEN_PATHS}")
def snk_09(spark, d):
    rows = discoveries(spark, d)
    return governance.accepted(rows, rows.where("from_id LIKE '%1'").select("discovery_id"))[1].select("discovery_id", "state")


@query("SELECT memory_id, title FROM mem")
def snk_11(spark, d):
    path = folder()
    commit.export({"memories": memories(spark, d).select("memory_id", "title")}, path)
    return spark.read.schema("memory_id string, title string").json(f"{path}/memories")


@query("SELECT 'first' AS step, CAST(1 AS BIGINT) AS epoch, TRUE AS held UNION ALL SELECT 'second while held', NULL, FALSE UNION ALL SELECT 'second', 2, TRUE UNION ALL SELECT 'late commit', 1, FALSE UNION ALL SELECT 'rows', (SELECT count(*) FROM region), TRUE", plain=True)
def snk_08(spark, d):
    """A lease is taken over when it ran out, and its former owner can no longer commit."""
    store, start = commit.Store(spark, folder()), datetime(2024, 1, 1)
    held, late = leases.Leases(store), start + timedelta(minutes=2)
    first = held.acquire("org", "a", start, 60)
    refused = held.acquire("org", "b", start, 60)
    second = held.acquire("org", "b", late, 60)
    try:
        held.commit(first, late, {"t": table(spark, d, "region")})
        lost = False
    except RuntimeError:
        lost = True
    held.commit(second, late, {"t": table(spark, d, "region")})
    steps = [("first", first.epoch, True), ("second while held", None, refused is not None), ("second", second.epoch, True), ("late commit", first.epoch, not lost), ("rows", store.read("t").count(), True)]
    return spark.createDataFrame(steps, "step string, epoch long, held boolean")


SIGNING_KEY = bytes(range(32))
INNER, OUTER = ("".join(f"\\x{b ^ pad:02X}" for b in SIGNING_KEY.ljust(64, b"\0")) for pad in (0x36, 0x5C))


@query(f"SELECT c_custkey, sha256('{OUTER}'::BLOB || unhex(sha256('{INNER}'::BLOB || encode(c_name)))) AS signature, c_custkey % 7 <> 0 AS good FROM customer", plain=True)
def scl_19(spark, d):
    """Signed names, of which every seventh was changed afterwards."""
    signature = scalars.hmac_sha256(SIGNING_KEY, F.col("c_name"))
    seen = F.when(F.col("c_custkey") % 7 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", signature.alias("signature"), scalars.verified(SIGNING_KEY, seen, signature).alias("good"))


@query()
def scl_23(spark, d):
    """The tag hash of each source."""
    return table(spark, d, "documents").select("source").distinct().select("source", scalars.fnv1a(F.col("source")).alias("hash"))


@query(r"SELECT memory_id, CASE WHEN regexp_matches(t, '\S') THEN 'length' END AS model, CASE WHEN regexp_matches(t, '\S') THEN CAST(length(t) AS DOUBLE) END AS size FROM (SELECT memory_id, coalesce(title, '') || chr(10) || coalesce(content, '') AS t FROM mem)")
def udf_04(spark, d):
    """Another embedder than the built-in one: any function from texts to vectors."""
    done = governance.stamped(memories(spark, d), lambda text: F.array(F.char_length(text).cast("double")), "length", "1")
    return done.select("memory_id", F.col("embedding.model.name").alias("model"), F.get("embedding.vector", F.lit(0)).alias("size"))


@query("SELECT project || ':' || team AS session, count(*) AS members FROM mem WHERE team <> 't1' GROUP BY 1")
def udf_05(spark, d):
    """Another rule of groups than sessions."""
    rule = F.when(F.col("team") != "t1", F.concat_ws(":", "project", "team"))
    return ingest.grouping(memories(spark, d), rule)[0].select("session", "members")


@query("SELECT memory_id, list_sort(list_intersect(e, ['e3', 'f5', 'x'])) AS common, list_sort(list_distinct(list_concat(e, ['e3', 'f5', 'x']))) AS either FROM (SELECT memory_id, entities AS e FROM mem)")
def set_05(spark, d):
    """What two token sets share and have together."""
    other = F.array(*[F.lit(x) for x in ("e3", "f5", "x")])
    return memories(spark, d).select("memory_id", F.array_sort(F.array_intersect("entities", other)).alias("common"), F.array_sort(F.array_union("entities", other)).alias("either"))


@query("SELECT event_id AS lsn, event_type AS state FROM events", plain=True)
def str_02(spark, d):
    """A feed of one file a trigger, published at most 256 messages at a time."""
    path, out, most = folder(), folder(), 256
    change_feed(spark, d).repartitionByRange(8, "lsn").sortWithinPartitions("lsn").write.parquet(path)
    batches = feed.stream_of(spark, path, "key long, lsn long, state string, op string", 1)
    feed.published(batches.select("lsn", "state"), most).writeStream.format("parquet").option("path", out).option("checkpointLocation", folder()).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("lsn long, state string").parquet(out)


@query("SELECT 'r' || r_regionkey AS effect_id, CASE WHEN r_regionkey = 0 THEN 'cleaned' WHEN r_regionkey = 1 THEN 'acknowledged 3' ELSE 'pending' END AS state FROM region", plain=True)
def snk_10(spark, d):
    """Effects of a commit: one is delivered and cleaned up, one is delivered by the worker that claimed it again."""
    box, start = Outbox(commit.Store(spark, folder())), datetime(2024, 1, 1)
    late = start + timedelta(minutes=2)
    box.add(table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("effect_id"), F.col("r_name").alias("payload")))
    first = box.claim("a", start, 60)
    box.acknowledge(first["effect_id"], "a", start)
    second = box.claim("a", start, 60)
    box.claim("b", start, 60)  # refused while the other is held
    again = box.claim("b", late, 60)
    box.acknowledge(second["effect_id"], "a", late)  # refused: it ran out
    box.acknowledge(again["effect_id"], "b", late)
    box.clean(first["effect_id"], first["generation"])
    state = F.when(F.col("cleaned"), "cleaned").when(F.col("acknowledged"), F.concat(F.lit("acknowledged "), F.col("generation").cast("string"))).otherwise("pending")
    return box.rows().select("effect_id", state.alias("state"))


@query(f"SELECT memory_id, memory_type FROM mem WHERE recorded_at <= {AS_OF} AND valid_from <= {AS_OF} AND (valid_until IS NULL OR valid_until > {AS_OF}) AND provenance <> 'ExternalSnapshot'")
def snk_12(spark, d):
    """A backup at a cut, written and read again."""
    path = folder()
    commit.export({"memories": commit.corpus(memories(spark, d), edges(spark, d), as_of())["memories"]}, path)
    return spark.read.schema("memory_id string, memory_type string").json(f"{path}/memories")


FEED_SQL = "SELECT user_id AS key, event_id AS lsn, event_type AS state FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'"


@query(f"SELECT how, key, lsn, state FROM ({FEED_SQL}) CROSS JOIN (SELECT unnest(['hydrated', 'tailed', 'reseeded']) AS how)", plain=True)
def str_12(spark, d):
    """A client without rows, one that can follow the retained events, and one that has been away too long."""
    every = change_feed(spark, d)
    none = every.limit(0).drop("op")
    source = lambda: (feed.applied(none, every), every.agg(F.max("lsn")).first()[0])
    retained, out = every.where("lsn >= 300"), None
    for since in (-1, 500, 100):
        rows, _, how = feed.synchronised(feed.applied(none, every.where(F.col("lsn") <= since)), since, retained, source)
        rows = rows.select(F.lit(how).alias("how"), "key", "lsn", "state")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""SELECT a AS from_id, b AS to_id, kind FROM (SELECT 'doc:' || min(doc_id) AS a, 'doc:' || (min(doc_id) + 1) AS b, 'RelatedTo' AS kind FROM documents GROUP BY doc_id // 10 HAVING count(*) > 1
UNION ALL SELECT 'doc:' || min(doc_id), 'known', 'Uses' FROM documents GROUP BY doc_id // 10)""", plain=True)
def ing_14(spark, d):
    """Offline log entries of ten documents each, as rows: their links, of which those without an end are dropped."""
    rows = table(spark, d, "documents").select("doc_id", F.expr("doc_id div 10").alias("entry"), F.struct("doc_id", F.struct(F.lit("Fix").alias("memory_type"), F.col("source").alias("title"), F.lit("").alias("content")).alias("m"), F.array("lang").alias("t")).alias("d"))
    link = lambda to, name, kind: f"named_struct('from', 0, 'to', CAST({to} AS INT), 'to_id', {name}, 'kind', '{kind}')"
    entries = rows.groupBy("entry").agg(F.array_sort(F.collect_list("d")).alias("d")).select(
        "entry", F.concat(F.lit("s"), "entry").alias("session"), F.expr("d.m").alias("memories"), F.expr("transform(d, x -> concat('doc:', x.doc_id))").alias("memory_ids"), F.expr("d.t").alias("tags"),
        F.expr(f"array({link('1', 'CAST(NULL AS STRING)', 'RelatedTo')}, {link('NULL', chr(39) + 'known' + chr(39), 'Uses')}, {link('NULL', chr(39) + 'unknown' + chr(39), 'Uses')})").alias("links"),
    )
    links = ingest.materialized(entries, spark.createDataFrame([("known",)], "memory_id string"))[1]
    return links.where("kind <> 'InSession'").select("from_id", "to_id", "kind")


@query("SELECT state, count(*) AS n FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 'synced' WHEN event_id % 5 = 0 THEN 'failed' ELSE 'pending' END AS state FROM events) GROUP BY state", plain=True)
def snk_13(spark, d):
    log = table(spark, d, "events").select(F.col("event_id").alias("entry"))
    return governance.staged(log, log.where("entry % 3 = 0"), log.where("entry % 5 = 0")).groupBy("state").agg(F.count("*").alias("n"))


# --- filters, joins, aggregates, limits -------------------------------------------------------


@query("SELECT count(*) FILTER (WHERE a.memory_id IS NOT NULL) AS shown, count(*) AS n FROM (SELECT memory_id FROM mem WHERE memory_type = 'Fix') m LEFT JOIN vis a USING (memory_id)")
def flt_20(spark, d):
    """Hints about prior rows are shown only for rows the draft's scope may see."""
    rows = memories(spark, d).where("memory_type = 'Fix'")
    return rows.agg(F.count_if(visibility.memory_visible(CALLER)).alias("shown"), F.count("*").alias("n"))


@query(composed_sql("Blocks", "Blocks"))
def jon_04(spark, d):
    return rules.composed(edges(spark, d), "Blocks", "Blocks")


@query(shared_sql("Requires"))
def jon_05(spark, d):
    return rules.shared_target(edges(spark, d), "Requires")


@query()
def agg_09(spark, d):
    return vectors.rate_reduction(vectors.coding_rates(table(spark, d, "embeddings"))).select("consolidate")


@query("SELECT memory_type, visibility, count(*) AS groups, CAST(sum(n) AS BIGINT) AS members FROM (SELECT memory_type, visibility, CASE visibility WHEN 0 THEN user_id WHEN 1 THEN project WHEN 2 THEN team ELSE org END AS s, count(*) AS n FROM mem GROUP BY 1, 2, 3 HAVING count(*) >= 3) GROUP BY 1, 2")
def agg_11(spark, d):
    return consolidation.abstraction_groups(memories(spark, d)).groupBy("memory_type", "visibility").agg(F.count("*").alias("groups"), F.sum("members").alias("members"))


@query(f"SELECT (SELECT count(*) FROM mem WHERE recorded_at <= {AS_OF} AND valid_from <= {AS_OF} AND (valid_until IS NULL OR valid_until > {AS_OF}) AND provenance <> 'ExternalSnapshot') AS memories")
def agg_18(spark, d):
    return commit.corpus(memories(spark, d), edges(spark, d), as_of())["manifest"].select("memories")


@query("SELECT provenance, count(*) AS scanned, count(*) FILTER (WHERE invalidated_by IS NOT NULL) AS superseded FROM mem GROUP BY provenance")
def agg_19(spark, d):
    return memories(spark, d).groupBy("provenance").agg(F.count("*").alias("scanned"), F.count_if(F.col("invalidated_by").isNotNull()).alias("superseded"))


@query("SELECT count(*) AS n FROM (SELECT list_contains(list(title) OVER (PARTITION BY memory_id ORDER BY version_lsn ROWS BETWEEN 16 PRECEDING AND 2 PRECEDING), title) AND lag(title) OVER (PARTITION BY memory_id ORDER BY version_lsn) <> title AS back FROM ver) WHERE back")
def win_07(spark, d):
    return temporal.rewinds(versions(spark, d), "memory_id", "version_lsn", "title").agg(F.count("*").alias("n"))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, {COSINE('a.embedding', 'b.embedding')} AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id ORDER BY score DESC, a, b LIMIT 32", plain=True)
def top_05(spark, d):
    pairs = vectors.similar_pairs(table(spark, d, "embeddings"), -1.1, most=32).select("a", "b", "score")
    return pairs.orderBy(F.desc("score"), "a", "b").limit(32)


@query(f"SELECT from_id, to_id FROM {OPEN_PATHS} ORDER BY 1, 2 LIMIT 16")
def top_06(spark, d):
    return consolidation.transitive_discoveries(edges(spark, d)).select("from_id", "to_id")


@query("SELECT memory_id FROM mem WHERE org = 'org' AND project = 'src4' AND memory_type = 'Task'")
def top_07(spark, d):
    return search.bounded(search.in_region(memories(spark, d), "org", "src4", "Task"), 100_000).select("memory_id")


@query("SELECT rel_id FROM edge WHERE from_id IN ('doc:9', 'doc:12') OR to_id IN ('doc:9', 'doc:12') ORDER BY rel_id LIMIT 4096")
def top_08(spark, d):
    seeds = spark.createDataFrame([("doc:9",), ("doc:12",)], "memory_id string")
    return rules.neighbourhood(edges(spark, d), seeds, 0).select("rel_id")


@query(f"SELECT from_id || '>' || to_id AS discovery_id FROM {OPEN_PATHS} WHERE from_id IN (SELECT memory_id FROM vis) AND to_id IN (SELECT memory_id FROM vis) ORDER BY discovery_id LIMIT 100")
def top_12(spark, d):
    nodes = memories(spark, d).where(visibility.memory_visible(CALLER)).select("memory_id")
    return graph.within(discoveries(spark, d), nodes).orderBy("discovery_id").limit(100).select("discovery_id")


@query("SELECT count(*) AS n FROM (SELECT DISTINCT from_id, to_id, kind FROM edge)")
def set_02(spark, d):
    return edges(spark, d).dropDuplicates(["from_id", "to_id", "kind"]).agg(F.count("*").alias("n"))


@query("SELECT from_id, to_id FROM edge WHERE kind = 'Solves' EXCEPT SELECT from_id, to_id FROM edge WHERE provenance = 'Derived'")
def set_03(spark, d):
    rows = edges(spark, d)
    return rows.where("kind = 'Solves'").select("from_id", "to_id").distinct().join(rows.where("provenance = 'Derived'").select("from_id", "to_id"), ["from_id", "to_id"], "left_anti")


@query("SELECT c_custkey, CAST(1 AS DOUBLE) / 3 AS score FROM customer", plain=True)
def scl_03(spark, d):
    other = F.concat(F.lit("zeta "), F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", scalars.token_jaccard(F.concat(F.col("c_name"), F.lit(" (alpha)")), other).alias("score"))


@query("SELECT p_partkey, lower(p_name) AS name FROM part", plain=True)
def scl_04(spark, d):
    noisy = F.concat(F.lit("Ltd. "), F.col("p_name"), F.lit(" GmbH"))
    return table(spark, d, "part").select("p_partkey", scalars.without_legal_forms(noisy).alias("name"))


@query(f"SELECT id, list_aggregate(list_sort(list_concat(['p:' || substr(lower(name), 1, 3), 't:' || lower(name)], attrs)), 'string_agg', ',') AS keys FROM ({RECORDS_SQL})", plain=True)
def scl_05(spark, d):
    return records(spark, d).select("id", F.array_join(scalars.blocking_keys(F.col("name"), F.col("attributes")), ",").alias("keys"))


@query(f"SELECT memory_id, CAST(greatest(1.0 - 0.01 * (date_diff('second', recorded_at, {AS_OF}) // 86400), 0.5) AS DOUBLE) AS decay FROM mem")
def scl_10(spark, d):
    return memories(spark, d).select("memory_id", F.round(scalars.decay_factor(scalars.age_days(F.col("recorded_at"), as_of())), 2).alias("decay"))


@query("SELECT doc_id, lower(hex(encode(substr(text, 1, 12)))) AS h FROM documents", plain=True)
def scl_21(spark, d):
    return table(spark, d, "documents").select("doc_id", F.lower(F.hex(F.substring("text", 1, 12))).alias("h"))


@query("SELECT doc_id, 64 AS width, TRUE AS unit FROM documents", plain=True)
def scl_24(spark, d):
    rows = table(spark, d, "documents").select("doc_id", governance.embed("text").alias("v"))
    return rows.select("doc_id", F.size("v").alias("width"), (F.abs(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) - 1) < 1e-9).alias("unit"))


@query("SELECT kind, CAST(q AS DOUBLE) AS quality FROM (VALUES ('CrossDomain', 0.9), ('TemporalEcho', 0.7), ('Orphan', 0.4), ('Transitive', 0.6)) t(kind, q)", plain=True)
def scl_28(spark, d):
    kinds = spark.createDataFrame([(k,) for k in scalars.DISCOVERY_QUALITY], "kind string")
    return kinds.select("kind", scalars.discovery_quality(F.col("kind")).alias("quality"))


@query("SELECT count(DISTINCT memory_type || visibility || s) AS groups FROM (SELECT memory_type, visibility, CASE visibility WHEN 0 THEN user_id WHEN 1 THEN project WHEN 2 THEN team ELSE org END AS s, count(*) AS n FROM mem GROUP BY 1, 2, 3 HAVING count(*) >= 3)")
def scl_29(spark, d):
    return consolidation.abstraction_groups(memories(spark, d)).agg(F.countDistinct("abstraction_id").alias("groups"))


@query("SELECT event_id, ts AS at FROM events", plain=True)
def scl_31(spark, d):
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return table(spark, d, "events").select("event_id", F.to_timestamp(text).alias("at"))


@query("SELECT event_id, CAST(props->>'$.k' AS VARCHAR) AS k FROM events", plain=True)
def scl_33(spark, d):
    return table(spark, d, "events").select("event_id", scalars.cell_text(F.get_json_object("props", "$.k")).alias("k"))


# --- graph ------------------------------------------------------------------------------------


@query(f"SELECT count(*) AS n FROM {OPEN_PATHS}")
def grf_26(spark, d):
    return consolidation.transitive_discoveries(edges(spark, d), 40).agg(F.count("*").alias("n"))


@query(f"SELECT from_id, to_id, shared FROM ({affinity_sql('entities')}) JOIN mem a ON a.memory_id = from_id JOIN mem b ON b.memory_id = to_id WHERE shared >= 2 AND a.project <> b.project AND from_id < to_id")
def grf_27(spark, d):
    pairs = rules.shared_attribute(facts(memories(spark, d), "entities")).where("shared >= 2 AND from_id < to_id")
    for side in ("from", "to"):
        pairs = pairs.join(memories(spark, d).select(F.col("memory_id").alias(f"{side}_id"), F.col("project").alias(f"{side}_project")), f"{side}_id")
    return pairs.where("from_project <> to_project").select("from_id", "to_id", "shared")


@query("SELECT CAST(least(confidence, 0.1) AS DOUBLE) AS confidence, (SELECT count(*) FROM edge WHERE kind = 'Contradicts' AND valid_until IS NULL AND from_id IN ('doc:1', 'doc:2') AND to_id IN ('doc:1', 'doc:2')) AS closed FROM mem WHERE memory_id = 'doc:2'")
def grf_31(spark, d):
    lost, closed = governance.contradiction_resolved(memories(spark, d), edges(spark, d), "doc:1", "doc:2", as_of())
    return lost.select("confidence").join(closed.agg(F.count("*").alias("closed")), F.lit(True))


@query("SELECT memory_id, 3 AS visibility FROM mem WHERE memory_type = 'Task' AND visibility < 3")
def grf_32(spark, d):
    rows = memories(spark, d)
    wanted = rows.where("memory_type = 'Task'").select("memory_id", F.lit(3).alias("visibility"))
    return governance.promoted(rows, wanted, as_of()).select("memory_id", "visibility")


# --- ingestion --------------------------------------------------------------------------------


@query("SELECT source, CASE WHEN source = 'src9' THEN 'bad ceiling' WHEN flavor = 'delta' THEN 'projection required' END AS problem FROM (SELECT DISTINCT source, CASE WHEN source IN ('src1', 'src2') THEN 'delta' ELSE 'git' END AS flavor FROM documents)", plain=True)
def ing_03(spark, d):
    name = F.col("source")
    rows = table(spark, d, "documents").select("source").distinct().select("source", name.alias("source_id"), F.when(name.isin("src1", "src2"), "delta").otherwise("git").alias("flavor"), F.when(name == "src9", 7).otherwise(3).alias("ceiling"), F.lit(None).cast("string").alias("projection"))
    return governance.registered(rows).select("source", "problem")


@query("SELECT o_orderkey, substr(sha256('external|4:tpch|' || strlen(CAST(o_orderkey AS VARCHAR)) || ':' || o_orderkey), 1, 32) AS memory_id, CAST(o_orderkey AS VARCHAR) AS title FROM orders", plain=True)
def ing_04(spark, d):
    mapping = tables.Mapping("Task", "o_orderkey", ("o_orderstatus",), ("o_orderkey",))
    rows = tables.drafts(table(spark, d, "orders"), mapping, "tpch")
    return rows.select(F.col("pk").cast("long").alias("o_orderkey"), "memory_id", "title")


@query(f"SELECT reject_code, count(*) AS n FROM (SELECT {VERDICT_SQL} AS reject_code FROM mem) GROUP BY 1")
def ing_07(spark, d):
    """A dry run: the same verdicts, counted and not committed."""
    verdicts = ingest.memory_verdicts(memories(spark, d), ["Problem", "Solution", "Fix", "Task", "FileContext"], F.lit(3))
    return verdicts.groupBy("reject_code").agg(F.count("*").alias("n"))


@query("SELECT memory_id, 'bag-of-words' AS model FROM mem WHERE memory_type = 'Fix'")
def ing_08(spark, d):
    done = governance.stamped(memories(spark, d).where("memory_type = 'Fix'"))
    return done.select("memory_id", F.col("embedding.model.name").alias("model"))


HINT_SQL = f"WITH {RECENT_SQL} SELECT new, arg_min(prior, rank) AS prior, max(score) AS score FROM (SELECT a.vec_id AS new, b.vec_id AS prior, {COSINE('a.embedding', 'b.embedding')} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COSINE('a.embedding', 'b.embedding')} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id IN (SELECT vec_id FROM newest) AND b.vec_id IN (SELECT vec_id FROM recent) AND {{w}}) WHERE rank = 1 GROUP BY new"


@query(HINT_SQL.format(w=COSINE("a.embedding", "b.embedding") + " >= 0.2"), plain=True)
def ing_10(spark, d):
    rows = table(spark, d, "embeddings")
    return vectors.best_prior(*batch_and_recent(rows), 0.2)


@query(HINT_SQL.format(w=f"{COSINE('a.embedding', 'b.embedding')} >= 0.1 AND {COSINE('a.embedding', 'b.embedding')} < 0.25"), plain=True)
def ing_11(spark, d):
    rows = table(spark, d, "embeddings")
    return vectors.best_prior(*batch_and_recent(rows), 0.1, 0.25)


@query(f"SELECT (SELECT count(*) FROM {KINDS_SQL}) AS kinds, (SELECT count(*) FROM {TRIPLES_SQL}) AS triples", plain=True)
def ing_13(spark, d):
    book = json.loads(governance.rulebook(kinds_table(spark), triples_table(spark)).first()[0])
    return spark.range(1).select(F.lit(len(book["kinds"])).alias("kinds"), F.lit(len(book["triples"])).alias("triples"))


@query("SELECT CAST(user_id % 5 AS VARCHAR) AS source, max(event_id) AS cursor FROM events e WHERE event_id < (SELECT min(event_id) FROM events x WHERE x.user_id % 5 = e.user_id % 5 AND x.event_id > 500 AND x.event_type = 'error') GROUP BY 1", plain=True)
def ing_16(spark, d):
    batches = table(spark, d, "events").select((F.col("user_id") % 5).cast("string").alias("source"), F.col("event_id").alias("snapshot"), (~((F.col("event_id") > 500) & (F.col("event_type") == "error"))).alias("settled"))
    return governance.settled_cursor(batches)


@query("SELECT 'Finding on ' || title AS title, CAST(least(visibility, 2) AS INT) AS visibility, 'Derived' AS provenance FROM (SELECT substr(title, 1, 20) AS title, visibility FROM mem WHERE memory_type = 'Error')")
def udf_02(spark, d):
    """A pack's action: a finding and an edge for each input row, with a ceiling."""
    rows = memories(spark, d).where("memory_type = 'Error'").select("memory_id", F.substring("title", 1, 20).alias("title"), "visibility")
    made, _ = governance.action_rows(rows, "Problem", F.concat(F.lit("Finding on "), "title"), "Causes", F.col("memory_id"), 2)
    return made.select("title", "visibility", "provenance")


@query("SELECT r_name, n FROM (SELECT r_name, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey >= 5 GROUP BY 1)", plain=True)
def udf_06(spark, d):
    """A registered template with bound parameters."""
    return spark.sql(
        "SELECT r_name, count(*) AS n FROM {nation} JOIN {region} ON r_regionkey = n_regionkey WHERE n_nationkey >= :least GROUP BY r_name",
        args={"least": 5}, nation=table(spark, d, "nation"), region=table(spark, d, "region"),
    )


# --- time and feeds ---------------------------------------------------------------------------


@query(f"SELECT count(*) AS n_memories FROM mem WHERE {LIVE}")
def tmp_02(spark, d):
    return memories(spark, d).where(temporal.live(as_of())).agg(F.count("*").alias("n_memories"))


@query("SELECT version_lsn, lag(version_lsn) OVER (ORDER BY version_lsn) AS previous_lsn FROM ver WHERE memory_id = 'user:3'")
def tmp_03(spark, d):
    return temporal.history(versions(spark, d).where("memory_id = 'user:3'"), "memory_id").select("version_lsn", "previous_lsn")


@query("SELECT user_id AS key, event_id AS lsn, event_type AS state FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_id > 500) WHERE rn = 1 AND event_type <> 'error'", plain=True)
def str_06(spark, d):
    """A reseed in the feed: everything older is dropped."""
    rows = change_feed(spark, d)
    seed = spark.createDataFrame([(None, 501, None, "GraphReseed")], rows.schema)
    return feed.applied(rows.limit(0).drop("op"), rows.unionByName(seed))


