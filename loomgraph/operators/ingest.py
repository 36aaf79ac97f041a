"""Ingestion: verdicts on drafts, entities, inverse and grouping edges, hints, replay and effects.

A verdict is a column, so a dry run and a commit share one builder.  Checks are made in stages; the
first failing check names a row's code, and a batch with a failing row is rejected as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.scalars import derived_id, normalized_tags

TITLE, SUMMARY, CONTENT, TAGS, TAG, ALL_TAGS, METADATA = 200, 500, 65_536, 32, 128, 2_048, 8_192
BATCH_MEMORIES, BATCH_EDGES = 256, 64


def first_code(checks: list[tuple[str, Column]]) -> Column:
    """The code of the first check that holds, null if none does."""
    return F.coalesce(*[F.when(condition, code) for code, condition in checks])


def memory_verdicts(drafts: DataFrame, types: list[str], ceiling: Column) -> DataFrame:
    """``drafts`` with reject_code: type, bounds, visibility wider than the source's, and times."""
    title, tags = F.char_length(F.trim("title")), F.coalesce("tags", F.array().cast("array<string>"))
    checks = [
        ("UNKNOWN_MEMORY_TYPE", ~F.coalesce(F.col("memory_type").isin(*types), F.lit(False))),
        ("UNKNOWN", F.col("title").isNull() | (title == 0) | (F.char_length("title") > TITLE)),
        ("UNKNOWN", F.coalesce(F.trim("content"), F.lit("")) == ""),
        ("RESOURCE_LIMIT_EXCEEDED", F.octet_length("content") > CONTENT),
        ("RESOURCE_LIMIT_EXCEEDED", (F.size(tags) > TAGS) | F.exists(tags, lambda t: F.octet_length(t) > TAG) | (F.octet_length(F.array_join(tags, "")) > ALL_TAGS)),
        ("VISIBILITY_WIDENING", F.col("visibility") > ceiling),
        ("UNKNOWN", F.col("valid_until") < F.col("valid_from")),
    ]
    return drafts.withColumn("reject_code", first_code(checks))


def legal(edges: DataFrame, triples: DataFrame) -> DataFrame:
    """``edges`` (kind, from_type, to_type) that a triple allows; an open side allows any type."""
    t = F.broadcast(triples.alias("t"))
    condition = (F.col("e.kind") == F.col("t.kind")) & (F.col("t.from_type").isNull() | (F.col("t.from_type") == F.col("e.from_type"))) & (F.col("t.to_type").isNull() | (F.col("t.to_type") == F.col("e.to_type")))
    return edges.alias("e").join(t, condition, "left_semi")


def edge_verdicts(edges: DataFrame, kinds: DataFrame, triples: DataFrame) -> DataFrame:
    """``edges`` with reject_code: kind, computed-only kinds, endpoints, legal types, number ranges."""
    known = edges.join(F.broadcast(kinds.select("kind", "computed_only")), "kind", "left")
    allowed = legal(edges.select("kind", "from_type", "to_type").distinct(), triples).withColumn("allowed", F.lit(True))
    joined = known.join(allowed, ["kind", "from_type", "to_type"], "left")
    sane = lambda c: ~F.isnan(c) & F.col(c).between(0, 1)
    checks = [
        ("UNKNOWN_KIND", F.col("computed_only").isNull()),
        ("COMPUTED_KIND_REJECTED", F.col("computed_only")),
        ("MISSING_EXTERNAL_KEY", F.col("from_type").isNull() | F.col("to_type").isNull()),
        ("INVALID_TYPE_TRIPLE", F.col("allowed").isNull()),
        ("UNKNOWN", ~(sane("strength") & sane("confidence"))),
    ]
    return joined.select(*edges.columns, first_code(checks).alias("reject_code"))


def with_defaults(edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """A strength of 0 becomes the kind's default and a confidence of 0 becomes 0.8."""
    joined = edges.join(F.broadcast(kinds.select("kind", "default_strength")), "kind", "left")
    strength = F.when(F.col("strength") == 0, F.coalesce("default_strength", F.lit(0.5))).otherwise(F.col("strength"))
    confidence = F.when(F.col("confidence") == 0, F.lit(0.8)).otherwise(F.col("confidence"))
    return joined.withColumn("strength", strength).withColumn("confidence", confidence).select(*edges.columns)


def batch_verdicts(rows: DataFrame, stages: list[str], batch: str = "batch_id") -> DataFrame:
    """(batch, accepted, stage, rejected): all or nothing, by the first stage with a failing row.

    ``rows`` has batch, stage and reject_code; combined before the shuffle, so a batch's size is no limit.
    """
    order = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("stage")).cast("int")
    bad = rows.groupBy(batch, order.alias("at")).agg(F.count_if(F.col("reject_code").isNotNull()).alias("rejected"))
    first = bad.groupBy(batch).agg(F.min(F.when(F.col("rejected") > 0, F.struct("at", "rejected"))).alias("f"))
    name = F.element_at(F.array(*[F.lit(s) for s in stages]), F.col("f.at"))
    return first.select(batch, F.col("f").isNull().alias("accepted"), F.when(F.col("f").isNotNull(), name).alias("stage"), F.coalesce("f.rejected", F.lit(0)).cast("long").alias("rejected"))


def admission(batches: DataFrame, sources: DataFrame, fingerprint: str, checksum: Column) -> DataFrame:
    """``batches`` with reject_code of the checks that come before any row is read."""
    joined = batches.join(sources.select("source_id", F.col("org").alias("source_org"), "producer"), "source_id", "left")
    checks = [
        ("UNKNOWN_SOURCE", F.col("producer").isNull()),
        ("RESOURCE_LIMIT_EXCEEDED", (F.col("n_memories") > BATCH_MEMORIES) | (F.col("n_edges") > BATCH_EDGES)),
        ("BAD_CHECKSUM", F.col("checksum") != checksum),
        ("INCOMPATIBLE_ONTOLOGY", F.col("fingerprint") != fingerprint),
        ("UNAUTHORIZED", F.col("org") != F.col("source_org")),
    ]
    return joined.select(*batches.columns, first_code(checks).alias("reject_code"))


def replayed(batches: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """``batches`` with the stored verdict of those that were settled before, and DUPLICATE_BATCH."""
    stored = ledger.select(*keys, F.col("verdict").alias("stored"))
    joined = batches.join(stored, keys, "left")
    return joined.withColumn("reject_code", F.when(F.col("stored").isNotNull(), "DUPLICATE_BATCH"))


def checksum(rows: DataFrame, batch: str, columns: list[str]) -> DataFrame:
    """(batch, checksum): digest of a batch's rows that does not depend on their order.

    Row digests are added as numbers, so nothing of a batch is gathered.
    """
    digest = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(batch).agg(F.sum(digest).cast("string").alias("sum"), F.count("*").alias("n")).select(batch, F.sha2(F.concat_ws(":", "sum", F.col("n").cast("string")), 256).alias("checksum"))


# Patterns of entity types, with the group that holds the name.
ENTITY_PATTERNS = [
    ("File", r"\b[\w\-/\.]+\.(?:rs|toml|py|ts|js|go|java|c|cpp|h|md)\b", 0),
    ("Function", r"\b[a-z_][a-z0-9_]*\(\s*\)", 0),
    ("Function", r"\bfn\s+([a-z_][a-z0-9_]*)", 1),
    ("Class", r"\b(?:struct|enum|trait|class)\s+([A-Z][A-Za-z0-9_]*)", 1),
    ("Error", r"\b[A-Z][A-Za-z0-9]*Error\b", 0),
    ("Error", r"\bpanic![^\]]*\]", 0),
    ("Technology", r"\b(?:rust|tokio|axum|serde|falkordb|redis|postgres|sqlite|python|typescript|kubernetes|docker)\b", 0),
    ("Concept", r"\b[A-Z][a-z]+(?:[ -][A-Z][a-z]+)+\b", 0),
    ("Person", r"@[a-z][a-z0-9_]{2,}", 0),
    ("Project", r"\b[a-z0-9]+-[a-z0-9]+(?:-[a-z0-9]+)*-service\b", 0),
    ("Command", r"\b(?:cargo|npm|pnpm|git|docker|kubectl|make|brew)\s+[a-z\-]+", 0),
    ("Package", r"\b[a-z0-9_\-]+@[0-9]+\.[0-9]+(?:\.[0-9]+)?\b", 0),
    ("Url", r"https?://[^\s]+", 0),
    ("Variable", r"\b[A-Z_][A-Z0-9_]{3,}\b", 0),
]


#: Words, spaces and their boundaries are those of Unicode, in every version of Java.
UNICODE = "(?U)"


def canonical(entity_type: str, name: Column) -> Column:
    if entity_type == "Function":
        return F.regexp_replace(name, r"(\(\))+$", "")
    if entity_type in ("Technology", "Concept", "Project"):
        return F.lower(name)
    return F.regexp_replace(name, r"[.,]+$", "") if entity_type == "Url" else name


def _named(names: Column, entity_type: str) -> Column:
    return F.transform(names, lambda n: F.struct(F.lit(entity_type).alias("entity_type"), canonical(entity_type, n).alias("name")))


def entities(rows: DataFrame, text: Column, key: str, types: list[str] | None = None) -> DataFrame:
    """(key, entity_type, name, confidence): distinct names; two or more of a type are ambiguous."""
    found = []
    for entity_type, pattern, group in ENTITY_PATTERNS:
        if types is None or entity_type in types:
            found.append(_named(F.regexp_extract_all(text, F.lit(UNICODE + pattern), F.lit(group)), entity_type))
    every = rows.select(key, F.explode(F.array_distinct(F.concat(*found))).alias("e")).select(key, "e.entity_type", "e.name").where("name <> ''")
    several = every.groupBy(key, "entity_type").agg(F.count("*").alias("n"))
    return every.join(several, [key, "entity_type"]).select(key, "entity_type", "name", F.when(F.col("n") > 1, 0.6).otherwise(0.95).alias("confidence"))


def inverses(edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """``edges`` with a companion for each one whose kind has an inverse and that is not bidirectional."""
    pairs = F.broadcast(kinds.where("inverse IS NOT NULL").select("kind", "inverse"))
    swapped = edges.where("NOT bidirectional").join(pairs, "kind").select(
        *[
            {
                "kind": F.col("inverse").alias("kind"),
                "from_id": F.col("to_id").alias("from_id"),
                "to_id": F.col("from_id").alias("to_id"),
                "rel_id": derived_id("edge", F.col("to_id"), F.col("inverse"), F.col("from_id")).alias("rel_id"),
            }.get(c, F.col(c))
            for c in edges.columns
        ]
    )
    return edges.unionByName(swapped).dropDuplicates(["rel_id"])


def grouping(members: DataFrame, rule: Column | str = "session") -> tuple[DataFrame, DataFrame]:
    """Session nodes and InSession edges of members with a memory_id; the rule names each member's group, or none."""
    named = members.select("memory_id", (F.col(rule) if isinstance(rule, str) else rule).alias("session"))
    rows = named.where("session IS NOT NULL AND session <> ''")
    node = derived_id("session", F.col("session"))
    nodes = rows.groupBy("session").agg(F.count("*").alias("members")).select(node.alias("memory_id"), "session", F.lit("Conversation").alias("memory_type"), "members")
    edges = rows.select(derived_id("edge", F.col("memory_id"), F.lit("InSession"), node).alias("rel_id"), F.col("memory_id").alias("from_id"), node.alias("to_id"), F.lit("InSession").alias("kind"))
    return nodes, edges


def floored(memories: DataFrame, edges: DataFrame) -> DataFrame:
    """``memories`` whose confidence is cut to 0.1 if a superseding edge points at them."""
    hit = edges.where(F.col("kind").isin("Replaces", "Contradicts")).select(F.col("to_id").alias("memory_id")).distinct().withColumn("_hit", F.lit(True))
    joined = memories.join(hit, "memory_id", "left")
    return joined.withColumn("confidence", F.when(F.col("_hit"), F.least("confidence", F.lit(0.1))).otherwise(F.col("confidence"))).select(*memories.columns)


def region_deltas(memories: DataFrame, edges: DataFrame) -> DataFrame:
    """(org, project, memory_type, memory_writes, edge_writes): what a commit adds to each region."""
    keys = ["org", "project", "memory_type"]
    nodes = memories.groupBy(*keys).agg(F.count("*").alias("memory_writes"))
    sources = memories.select(F.col("memory_id").alias("from_id"), *keys)
    links = edges.join(sources, "from_id").groupBy(*keys).agg(F.count("*").alias("edge_writes"))
    joined = nodes.join(links, keys, "full")
    return joined.select(*keys, F.coalesce("memory_writes", F.lit(0)).alias("memory_writes"), F.coalesce("edge_writes", F.lit(0)).alias("edge_writes"))


def demand(rejected: DataFrame) -> DataFrame:
    """(demand, n): which kinds between which types producers asked for in vain."""
    key = F.concat(F.col("kind"), F.lit("/"), F.coalesce("from_type", F.lit("?")), F.lit("->"), F.coalesce("to_type", F.lit("?")))
    return rejected.where(F.col("reject_code").isin("UNKNOWN_KIND", "INVALID_TYPE_TRIPLE")).groupBy(key.alias("demand")).agg(F.count("*").alias("n"))


def reindexed(current: DataFrame, fresh: DataFrame, key: str = "memory_id") -> DataFrame:
    """One row (scanned, changed, unchanged, superseded) for new vectors made at a known version.

    A row whose version has moved on is superseded and not written.
    """
    joined = fresh.withColumnRenamed("digest", "new_digest").withColumnRenamed("version_lsn", "seen_lsn").join(current, key)
    same = F.col("seen_lsn") == F.col("version_lsn")
    return joined.agg(F.count("*").alias("scanned"), F.count_if(same & (F.col("digest") != F.col("new_digest"))).alias("changed"), F.count_if(same & (F.col("digest") == F.col("new_digest"))).alias("unchanged"), F.count_if(~same).alias("superseded"))


def split_units(drafts: DataFrame, links: DataFrame, rows: int = BATCH_MEMORIES) -> DataFrame:
    """(key, component, unit): drafts that are linked stay together, components are filled into units.

    Units are numbered by the running size of components in their order, within blocks of components.
    """
    from loomgraph.operators.graph import components

    joined = drafts.select("key").join(components(links, "a", "b").withColumnRenamed("node", "key"), "key", "left")
    named = joined.select("key", F.coalesce("component", "key").alias("component"))
    sizes = named.groupBy("component").agg(F.count("*").alias("size")).withColumn("block", F.pmod(F.xxhash64("component"), F.lit(64)))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("block").orderBy("component").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    units = sizes.select("component", F.concat_ws("-", "block", F.floor(before / rows)).alias("unit"))
    return named.join(units, "component").select("key", "component", "unit")


def federated(rows: DataFrame, known_types: list[str], known_kinds: list[str]) -> DataFrame:
    """``rows`` (kind or memory_type) with the reason why one cannot be shared, null if it can."""
    reason = F.when(F.col("memory_type").isNotNull() & ~F.col("memory_type").isin(*known_types), "unknown type")
    return rows.withColumn("dropped", reason.when(F.col("kind").isNotNull() & ~F.col("kind").isin(*known_kinds), "unknown kind"))


def egress(licence: Column, consent: Column) -> Column:
    """licensed with both, partial with one, none without."""
    both, one = licence.isNotNull() & consent.isNotNull(), licence.isNotNull() | consent.isNotNull()
    return F.when(both, "licensed").when(one, "partial").otherwise("none")


def cleaned_tags(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tags", normalized_tags(F.col("tags")))


def materialized(entries: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Memories, edges and what is dropped of offline log entries, as the commit of their batches would make them.

    ``entries`` has (entry, session, memories, memory_ids, tags, links): parallel arrays of drafts (memory_type,
    title, content), ids and tags, and links (from, to, to_id, kind) between places of the entry, or to an id
    if ``to`` is null, which must be in the entry or in ``known`` (memory_id).  An entry whose drafts and ids
    differ in number gives nothing but a line in what is dropped.  Sessions get their node and edges.
    """
    good = F.coalesce(F.size("memories") == F.size("memory_ids"), F.lit(False))
    uneven = entries.where(~good).select("entry", F.lit("uneven").alias("reason"))
    whole = entries.where(good)
    drafts = whole.select("entry", "session", "memory_ids", "tags", F.posexplode("memories").alias("at", "m"))
    tags = normalized_tags(F.coalesce(F.get("tags", F.col("at")), F.array().cast("array<string>")))
    rows = drafts.select("entry", F.get("memory_ids", F.col("at")).alias("memory_id"), "m.memory_type", "m.title", "m.content", tags.alias("tags"), "session", F.lit(0.5).alias("importance"), F.lit(0.8).alias("confidence"))
    links = whole.select("entry", "memory_ids", F.explode("links").alias("l"))
    place = lambda n: F.when(n >= 0, F.get("memory_ids", n))
    ends = links.select("entry", place(F.col("l.from")).alias("from_id"), F.when(F.col("l.to").isNull(), F.col("l.to_id")).otherwise(place(F.col("l.to"))).alias("to_id"), F.col("l.kind").alias("kind"))
    there = known.select(F.col("memory_id").alias("to_id")).unionByName(rows.select(F.col("memory_id").alias("to_id"))).distinct().withColumn("there", F.lit(True))
    judged = ends.join(there, "to_id", "left").withColumn("there", F.coalesce("there", F.lit(False)) & F.col("from_id").isNotNull())
    edges = judged.where("there").select(derived_id("edge", F.col("from_id"), F.col("kind"), F.col("to_id")).alias("rel_id"), "from_id", "to_id", "kind")
    sessions, within = grouping(rows.select("memory_id", "session"))
    nodes = rows.select("memory_id", "memory_type", "title", "content", "tags", "importance", "confidence")
    node = sessions.select("memory_id", "memory_type", F.col("session").alias("title"), F.lit("").alias("content"), F.array().cast("array<string>").alias("tags"), F.lit(0.5).alias("importance"), F.lit(0.8).alias("confidence"))
    dropped = uneven.unionByName(judged.where("NOT there").select("entry", F.lit("no end").alias("reason")))
    return nodes.unionByName(node), edges.unionByName(within.select("rel_id", "from_id", "to_id", "kind")), dropped
