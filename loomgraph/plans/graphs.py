"""Queries of walks, rules, vectors, consolidation and entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import scalars
from loomgraph.operators import consolidation, graph, resolution, rules, temporal, vectors
from loomgraph.plans.fixture import AS_OF, CALLER, as_of, edges, memories, records, table
from loomgraph.plans.reads import COSINE, KINDS_SQL, LIVE
from loomgraph.plans.registry import query
from loomgraph.session import new_folder
from loomgraph.sources.commit import Store
from loomgraph.schema import kinds_table


def walk_sql(start: str, depth: int, limit: int, kinds: str = "TRUE") -> str:
    """Breadth-first levels of visible nodes; hop by hop, so that the limit counts."""
    parts = [f"l0 AS (SELECT memory_id, 0 AS depth FROM vis WHERE memory_id = '{start}')"]
    for k in range(1, depth + 1):
        before = " UNION ALL ".join(f"SELECT memory_id FROM l{i}" for i in range(k))
        found = " UNION ALL ".join(f"SELECT memory_id FROM l{i}" for i in range(1, k)) or "SELECT NULL WHERE FALSE"
        parts.append(
            f"l{k} AS (SELECT memory_id, {k} AS depth FROM (SELECT DISTINCT memory_id FROM (SELECT to_id AS memory_id FROM vedge WHERE {kinds} AND from_id IN (SELECT memory_id FROM l{k - 1}) "
            f"UNION ALL SELECT from_id FROM vedge WHERE {kinds} AND to_id IN (SELECT memory_id FROM l{k - 1}))) WHERE memory_id IN (SELECT memory_id FROM vis) AND memory_id NOT IN ({before}) "
            f"ORDER BY memory_id LIMIT (SELECT {limit} - count(*) FROM ({found}) t))"
        )
    return ", " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(1, depth + 1))


@query(walk_sql("doc:8", 3, 200))
def grf_01(spark, d):
    return graph.traverse(memories(spark, d), edges(spark, d), "doc:8", CALLER, "both", None, 3, 200)


@query(walk_sql("doc:23", 2, 128))
def grf_02(spark, d):
    return graph.find_related(memories(spark, d), edges(spark, d), "doc:23", CALLER, 2)


@query(""", RECURSIVE_EDGES AS (SELECT rel_id, unnest([from_id, to_id]) AS memory_id FROM edge), steps AS (SELECT m.memory_id AS a, e.memory_id AS b FROM (SELECT memory_id, unnest(evidence) AS rel_id FROM mem WHERE provenance = 'Derived') m JOIN RECURSIVE_EDGES e USING (rel_id)),
walk(memory_id, depth) AS (SELECT memory_id, 0 FROM mem WHERE memory_id = 'doc:960' UNION SELECT s.b, w.depth + 1 FROM walk w JOIN steps s ON s.a = w.memory_id WHERE w.depth < 4)
SELECT memory_id, CAST(min(depth) AS INT) AS depth FROM walk WHERE memory_id IN (SELECT memory_id FROM mem) GROUP BY memory_id""")
def grf_03(spark, d):
    return graph.chain(memories(spark, d), edges(spark, d), "doc:960", 4)


@query(""", walk(rel_id, depth) AS (SELECT rel_id, 0 FROM edge WHERE rel_id = 'e:960' AND provenance = 'Derived' UNION SELECT v.r, w.depth + 1 FROM walk w JOIN edge e ON e.rel_id = w.rel_id, LATERAL (SELECT unnest(e.evidence) AS r) v WHERE w.depth < 5)
SELECT w.rel_id, CAST(min(w.depth) AS INT) AS depth, any_value(e.rule) AS rule FROM walk w JOIN edge e ON e.rel_id = w.rel_id GROUP BY w.rel_id""")
def grf_04(spark, d):
    return graph.explain_edge(edges(spark, d), "e:960")


def composed_sql(first: str, second: str) -> str:
    return f"SELECT DISTINCT a.from_id, b.to_id FROM edge a JOIN edge b ON a.to_id = b.from_id WHERE a.kind = '{first}' AND b.kind = '{second}'"


def shared_sql(kind: str) -> str:
    return f"SELECT DISTINCT a.from_id, b.from_id AS to_id FROM edge a JOIN edge b ON a.to_id = b.to_id WHERE a.kind = '{kind}' AND b.kind = '{kind}' AND a.from_id <> b.from_id"


@query("SELECT DISTINCT from_id AS memory_id, 'Solution' AS inferred_type FROM edge WHERE kind = 'Solves' UNION ALL SELECT DISTINCT from_id, 'Fix' FROM edge WHERE kind = 'Fixes' UNION ALL SELECT DISTINCT to_id, 'Problem' FROM edge WHERE kind = 'Causes'")
def grf_05(spark, d):
    return rules.inferred_types(edges(spark, d))


@query(f"SELECT 'R4' AS rule, * FROM ({composed_sql('DependsOn', 'DependsOn')}) UNION ALL SELECT 'R5', * FROM ({composed_sql('Requires', 'Requires')})")
def grf_06(spark, d):
    rows = edges(spark, d)
    both = [rules.composed(rows, k, k).withColumn("rule", F.lit(r)) for r, k in (("R4", "DependsOn"), ("R5", "Requires"))]
    return both[0].unionByName(both[1])


@query("SELECT to_id AS from_id, from_id AS to_id FROM edge WHERE kind = 'Solves'")
def grf_07(spark, d):
    return rules.reversed_solves(edges(spark, d))


def attribute_sql(column: str) -> str:
    return f"SELECT DISTINCT memory_id, unnest({column}) AS attribute FROM mem"


def affinity_sql(column: str) -> str:
    return f"SELECT x.memory_id AS from_id, y.memory_id AS to_id, count(*) AS shared, least(count(*) / CAST(5 AS DOUBLE), 1.0) AS confidence FROM ({attribute_sql(column)}) x JOIN ({attribute_sql(column)}) y USING (attribute) WHERE x.memory_id <> y.memory_id AND attribute IN (SELECT attribute FROM ({attribute_sql(column)}) GROUP BY attribute HAVING count(*) <= 256) GROUP BY 1, 2"


def facts(rows, column):
    return rows.select("memory_id", F.explode(column).alias("attribute"))


@query(affinity_sql("entities"))
def grf_08(spark, d):
    shared = rules.shared_attribute(facts(memories(spark, d), "entities"))
    return shared.withColumn("confidence", F.least(F.col("shared") / 5.0, F.lit(1.0)))


@query(affinity_sql("tags"))
def jon_06(spark, d):
    shared = rules.shared_attribute(facts(memories(spark, d), "tags"))
    return shared.withColumn("confidence", F.least(F.col("shared") / 5.0, F.lit(1.0)))


@query(shared_sql("Solves"))
def grf_09(spark, d):
    return rules.shared_target(edges(spark, d), "Solves")


@query("SELECT DISTINCT from_id, to_id FROM edge WHERE kind = 'Fixes' AND from_id IN (SELECT memory_id FROM mem WHERE memory_type = 'Fix')")
def grf_10(spark, d):
    return rules.implied_solves(edges(spark, d), memories(spark, d))


@query(composed_sql("BuildsOn", "BuildsOn"))
def grf_11(spark, d):
    return rules.composed(edges(spark, d), "BuildsOn", "BuildsOn")


@query(composed_sql("Blocks", "Requires"))
def grf_12(spark, d):
    return rules.composed(edges(spark, d), "Blocks", "Requires")


@query(composed_sql("Contradicts", "Confirms"))
def grf_13(spark, d):
    return rules.composed(edges(spark, d), "Contradicts", "Confirms")


@query(shared_sql("Modifies"))
def grf_14(spark, d):
    return rules.shared_target(edges(spark, d), "Modifies")


@query("SELECT a.memory_id AS from_id, b.memory_id AS to_id FROM mem a JOIN mem b ON a.session = b.session AND a.memory_id < b.memory_id")
def grf_15(spark, d):
    return rules.cohort(memories(spark, d).select("memory_id", "session"))


@query("SELECT DISTINCT c.o_custkey, n.n_regionkey FROM orders c JOIN customer k ON k.c_custkey = c.o_custkey JOIN nation n ON n.n_nationkey = k.c_nationkey WHERE c.o_orderstatus = 'F'", plain=True)
def grf_16(spark, d):
    """A pack's own composition rule over other kinds: order, customer, nation."""
    at = table(spark, d, "customer").select(F.col("c_custkey").alias("from_id"), F.col("c_nationkey").alias("to_id"), F.lit("PartOf").alias("kind"))
    up = table(spark, d, "nation").select(F.col("n_nationkey").alias("from_id"), F.col("n_regionkey").alias("to_id"), F.lit("Governs").alias("kind"))
    links = rules.composed(at.unionByName(up), "PartOf", "Governs")
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey").distinct()
    return orders.join(links, orders["o_custkey"] == links["from_id"]).select("o_custkey", F.col("to_id").alias("n_regionkey"))


def rule_frames(spark, d):
    rows, nodes = edges(spark, d), memories(spark, d)
    return rules.evaluate(rows, nodes, facts(nodes, "tags"), facts(nodes, "entities"), nodes.select("memory_id", "session"))


WRITTEN_SQL = " UNION ALL ".join(
    f"SELECT '{r}' AS rule, '{k}' AS kind, from_id, to_id FROM ({q})"
    for r, k, q in [
        ("R4", "DependsOn", composed_sql("DependsOn", "DependsOn")),
        ("R5", "Requires", composed_sql("Requires", "Requires")),
        ("R8", "RelatedTo", shared_sql("Solves")),
        ("D2", "BuildsOn", composed_sql("BuildsOn", "BuildsOn")),
        ("D3", "Blocks", composed_sql("Blocks", "Requires")),
        ("D4", "Contradicts", composed_sql("Contradicts", "Confirms")),
        ("D5", "RelatedTo", shared_sql("Modifies")),
    ]
)


@query(f"SELECT rule, w.kind, CAST(min(least(a.visibility, b.visibility)) AS INT) AS narrowest, count(*) AS n FROM ({WRITTEN_SQL}) w JOIN mem a ON a.memory_id = w.from_id JOIN mem b ON b.memory_id = w.to_id GROUP BY 1, 2")
def grf_17(spark, d):
    kept = {r: f for r, f in rule_frames(spark, d).items() if r in ("R4", "R5", "R8", "D2", "D3", "D4", "D5")}
    return written_counts(spark, d, kept)


def written_counts(spark, d, facts_of_rules):
    done = rules.write_back(facts_of_rules, memories(spark, d), edges(spark, d).limit(0), most=None)
    return done.groupBy("rule", "kind").agg(F.min("visibility").alias("narrowest"), F.count("*").alias("n"))


ALL_WRITTEN_SQL = WRITTEN_SQL + "".join(
    f" UNION ALL SELECT '{r}' AS rule, '{k}' AS kind, from_id, to_id FROM ({q})"
    for r, k, q in [
        ("R7", "RelatedTo", affinity_sql("entities")),
        ("R9", "RelatedTo", affinity_sql("tags")),
        ("D1", "Solves", "SELECT DISTINCT from_id, to_id FROM edge WHERE kind = 'Fixes' AND from_id IN (SELECT memory_id FROM mem WHERE memory_type = 'Fix')"),
        ("D6", "RelatedTo", "SELECT a.memory_id AS from_id, b.memory_id AS to_id FROM mem a JOIN mem b ON a.session = b.session AND a.memory_id < b.memory_id"),
    ]
)


@query(f"SELECT rule, w.kind, CAST(min(least(a.visibility, b.visibility)) AS INT) AS narrowest, count(*) AS n FROM ({ALL_WRITTEN_SQL}) w JOIN mem a ON a.memory_id = w.from_id JOIN mem b ON b.memory_id = w.to_id GROUP BY 1, 2")
def grf_17_all(spark, d):
    """All eleven rules written back; the SQL of grf_17 holds seven."""
    return written_counts(spark, d, rule_frames(spark, d))


@query("""SELECT rel_id FROM edge WHERE from_id IN (SELECT unnest([from_id, to_id]) FROM edge WHERE from_id IN ('doc:40', 'doc:41') OR to_id IN ('doc:40', 'doc:41')) OR to_id IN (SELECT unnest([from_id, to_id]) FROM edge WHERE from_id IN ('doc:40', 'doc:41') OR to_id IN ('doc:40', 'doc:41'))""")
def grf_18(spark, d):
    seeds = spark.createDataFrame([("doc:40",), ("doc:41",)], "memory_id string")
    return rules.neighbourhood(edges(spark, d), seeds, 1).select("rel_id")


@query("SELECT DISTINCT 'Solution' AS inferred_type FROM edge WHERE kind = 'Solves' AND from_id = 'doc:77' UNION SELECT 'Fix' FROM edge WHERE kind = 'Fixes' AND from_id = 'doc:77' UNION SELECT 'Problem' FROM edge WHERE kind = 'Causes' AND to_id = 'doc:77'")
def grf_19(spark, d):
    return rules.inferred_types(edges(spark, d)).where("memory_id = 'doc:77'").select("inferred_type")


def mapping(spark):
    pairs = consolidation.resolved_merges([(f"doc:{i * 3}", f"doc:{i * 3 + 1}", 0.99 - i / 1000) for i in range(20)])
    return spark.createDataFrame(sorted(pairs.items()), "loser string, survivor string")


MERGED_SQL = "CASE WHEN {c} IN (SELECT 'doc:' || (3 * i + 1) FROM range(20) r(i)) THEN 'doc:' || (CAST(substr({c}, 5) AS INT) - 1) ELSE {c} END"


@query(f""", o AS (SELECT * FROM edge WHERE valid_until IS NULL), hit AS (SELECT *, {MERGED_SQL.format(c='from_id')} AS nf, {MERGED_SQL.format(c='to_id')} AS nt FROM o)
SELECT (SELECT count(*) FROM hit WHERE nf <> from_id OR nt <> to_id) AS closed, (SELECT count(*) FROM (SELECT DISTINCT nf, nt, kind FROM hit WHERE (nf <> from_id OR nt <> to_id) AND nf <> nt)) AS rewired""")
def grf_20(spark, d):
    _, moved = consolidation.merged(memories(spark, d), edges(spark, d), mapping(spark), as_of())
    return moved.agg(F.count_if(F.col("valid_until").isNotNull()).alias("closed"), F.count_if(F.col("valid_until").isNull()).alias("rewired"))


AGE = f"greatest(date_diff('second', e.recorded_at, {AS_OF}) // 86400, 0)"
STRENGTH = f"round(greatest(least((strength + least(0.05 * sqrt(CAST(evidence_count AS DOUBLE)), 0.2)) * (0.5 + 0.5 * coalesce(success_rate, 1.0)) * greatest(1.0 - 0.01 * {AGE}, 0.5), 1.0), 0.0), 6)"


@query(f"SELECT rel_id, evidence_count + 1 AS evidence_count, {STRENGTH} AS strength FROM edge e WHERE from_id IN (SELECT memory_id FROM mem WHERE {LIVE}) AND to_id IN (SELECT memory_id FROM mem WHERE {LIVE})")
def grf_21(spark, d):
    return consolidation.strengthened(edges(spark, d), memories(spark, d), as_of())


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, {COSINE('a.embedding', 'b.embedding')} AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {COSINE('a.embedding', 'b.embedding')} >= 0.25", plain=True)
def grf_22(spark, d):
    return vectors.similar_pairs(table(spark, d, "embeddings"), 0.2499).where("score >= 0.25").select("a", "b", "score")


@query("SELECT memory_type, visibility, CASE visibility WHEN 0 THEN user_id WHEN 1 THEN project WHEN 2 THEN team ELSE org END AS subject, count(*) AS members, 'Abstraction of ' || count(*) || ' ' || memory_type AS title FROM mem GROUP BY 1, 2, 3 HAVING count(*) >= 3")
def grf_23(spark, d):
    return consolidation.abstraction_groups(memories(spark, d)).select("memory_type", "visibility", "subject", "members", "title")


@query(f"SELECT memory_id, 'Redundant' AS reason FROM mem WHERE invalidated_by IS NOT NULL AND valid_until <= {AS_OF}")
def grf_24(spark, d):
    return consolidation.pruned(memories(spark, d), as_of())


@query(", w AS (SELECT DISTINCT unnest(['doc:1', 'doc:2', 'doc:5', 'doc:6', 'none:1']) AS memory_id) SELECT w.memory_id, CASE WHEN m.memory_id IS NULL THEN 'missing' WHEN v.memory_id IS NULL THEN 'denied' ELSE 'found' END AS outcome FROM w LEFT JOIN mem m USING (memory_id) LEFT JOIN vis v USING (memory_id)")
def grf_33(spark, d):
    wanted = spark.createDataFrame([(x,) for x in ("doc:1", "doc:2", "doc:5", "doc:6", "none:1")], "memory_id string")
    return graph.nodes_for(memories(spark, d), wanted, CALLER)


@query(", c(node, label) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT e.b, c.label FROM c JOIN (SELECT s_suppkey AS a, s_suppkey // 2 * 2 + 20 AS b FROM supplier UNION ALL SELECT s_suppkey // 2 * 2 + 20, s_suppkey FROM supplier) e ON e.a = c.node) SELECT node, min(label) AS component FROM c GROUP BY node")
def agg_20(spark, d):
    links = table(spark, d, "supplier").selectExpr("s_suppkey AS a", "s_suppkey div 2 * 2 + 20 AS b")
    found = graph.components(links, "a", "b")
    return found.select(F.col("node").cast("long").alias("node"), F.col("component").cast("long").alias("component"))


# --- aggregates over the graph ----------------------------------------------------------------


@query(f"SELECT from_id, to_id, shared FROM ({affinity_sql('entities')}) WHERE shared >= 2")
def agg_02(spark, d):
    return rules.shared_attribute(facts(memories(spark, d), "entities")).where("shared >= 2")


@query(f"SELECT attribute, count(*) AS members FROM ({attribute_sql('tags')}) GROUP BY attribute HAVING count(*) <= 256")
def agg_03(spark, d):
    return rules.frequent(facts(memories(spark, d), "tags").distinct())


@query("SELECT from_id AS memory_id, count(*) FILTER (WHERE provenance = 'Asserted') AS explicit, round(coalesce(sum(confidence) FILTER (WHERE provenance <> 'Asserted'), 0), 6) AS inferred FROM edge GROUP BY from_id")
def agg_04(spark, d):
    from loomgraph.operators.search import edge_weights

    return edge_weights(edges(spark, d)).withColumn("inferred", F.round("inferred", 6))


@query(""", deg AS (SELECT m.memory_id, coalesce(n, 0) AS degree FROM mem m LEFT JOIN (SELECT from_id, count(*) AS n FROM edge WHERE kind <> 'SimilarTo' GROUP BY from_id) e ON e.from_id = m.memory_id)
SELECT count(*) AS n_nodes, (SELECT count(*) FROM edge) AS n_edges, round(avg(degree), 6) AS mean_degree, median(degree) AS median_degree, round(count(*) FILTER (WHERE degree > 32) / CAST(count(*) AS DOUBLE), 6) AS hairball_share,
round((SELECT sum(confidence) FROM edge) / CAST(count(*) * (count(*) - 1) AS DOUBLE), 9) AS density FROM deg""")
def agg_05(spark, d):
    return vectors.sparsity(memories(spark, d), edges(spark, d))


@query("SELECT round((SELECT sum(confidence) FROM edge) / CAST((SELECT count(*) * (count(*) - 1) FROM mem) AS DOUBLE), 9) AS density")
def agg_06(spark, d):
    return vectors.sparsity(memories(spark, d), edges(spark, d)).select("density")


@query()
def agg_07(spark, d):
    return vectors.coding_rates(table(spark, d, "embeddings"))


@query()
def agg_08(spark, d):
    return vectors.rate_reduction(vectors.coding_rates(table(spark, d, "embeddings")))


CENTROID_SQL = "SELECT label, i, round(s / sqrt(sum(s * s) OVER (PARTITION BY label)), 6) AS value FROM (SELECT label, CAST(i AS INT) AS i, sum(CAST(embedding[i + 1] AS DOUBLE)) AS s FROM embeddings, range(64) r(i) GROUP BY label, i)"


@query(CENTROID_SQL, plain=True)
def agg_10(spark, d):
    return vectors.centroids(table(spark, d, "embeddings"))


@query(f"SELECT a.label, round(avg({COSINE('a.embedding', 'b.embedding')}), 4) AS cohesion FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label", plain=True)
def agg_10_cohesion(spark, d):
    return vectors.cohesion(table(spark, d, "embeddings")).select("label", F.round("cohesion", 4).alias("cohesion"))


@query("SELECT CAST(min(visibility) AS INT) AS narrowest, project FROM mem GROUP BY project")
def agg_22(spark, d):
    return memories(spark, d).groupBy("project").agg(F.min("visibility").alias("narrowest"))


@query("SELECT max(version_lsn) AS frontier FROM ver")
def agg_21(spark, d):
    from loomgraph.plans.fixture import versions

    return versions(spark, d).agg(F.max("version_lsn").alias("frontier"))


@query("SELECT a.project, count(*) AS pairs FROM mem a JOIN mem b ON a.session = b.session AND a.memory_id < b.memory_id GROUP BY a.project")
def agg_17(spark, d):
    pairs = rules.cohort(memories(spark, d).select("memory_id", "session"))
    return pairs.join(memories(spark, d).select(F.col("memory_id").alias("from_id"), "project"), "from_id").groupBy("project").agg(F.count("*").alias("pairs"))


# --- entity resolution ------------------------------------------------------------------------


def suppliers(spark, d):
    return records(spark, d).where("id LIKE 's%'")


LABELS_SQL = "SELECT 's' || a.s_suppkey AS a, 's' || b.s_suppkey AS b, CASE WHEN a.s_nationkey = b.s_nationkey THEN 'match' ELSE 'non_match' END AS label, a.s_name AS na, b.s_name AS nb, a.s_nationkey AS x, b.s_nationkey AS y FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 OR b.s_suppkey = a.s_suppkey + 25"


def labelled(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    steps = s.select("s_suppkey", "s_nationkey", F.explode(F.array(F.col("s_suppkey") + 1, F.col("s_suppkey") + 25)).alias("other"))
    other = s.select(F.col("s_suppkey").alias("other"), F.col("s_nationkey").alias("other_nation"))
    label = F.when(F.col("s_nationkey") == F.col("other_nation"), "match").otherwise("non_match")
    pairs = steps.join(other, "other").select(F.concat(F.lit("s"), "s_suppkey").alias("a"), F.concat(F.lit("s"), "other").alias("b"), label.alias("label"))
    return resolution.compared(pairs, suppliers(spark, d), ["nation"])


@query("SELECT s_suppkey, round(jaro_similarity(lower(s_name), lower('SUPPLIER#000000042')), 6) AS jaro FROM supplier", plain=True)
def scl_01(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.round(resolution.jaro(F.col("s_name"), F.lit("SUPPLIER#000000042")), 6).alias("jaro"))


@query("SELECT s_suppkey, round(jaro_winkler_similarity(lower(s_name), lower('SUPPLIER#000000042')), 6) AS jw FROM supplier", plain=True)
def scl_02(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.round(resolution.jaro_winkler(F.col("s_name"), F.lit("SUPPLIER#000000042")), 6).alias("jw"))


BAND_SQL = "CASE WHEN lower({a}) = lower({b}) THEN 'Exact' WHEN jaro_winkler_similarity(lower({a}), lower({b})) >= 0.85 THEN 'Similar' ELSE 'Different' END"


@query(f"SELECT a, b, {BAND_SQL.format(a='na', b='nb')} AS name, {BAND_SQL.format(a='CAST(x AS VARCHAR)', b='CAST(y AS VARCHAR)')} AS nation FROM ({LABELS_SQL})", plain=True)
def scl_06(spark, d):
    return labelled(spark, d).select("a", "b", F.col("slots")["name"].alias("name"), F.col("slots")["attr:nation"].alias("nation"))


SHARES_SQL = f"""rows AS (SELECT label, 'name' AS slot, {BAND_SQL.format(a='na', b='nb')} AS outcome FROM ({LABELS_SQL}) UNION ALL SELECT label, 'name_tokens', CASE WHEN na = nb THEN 'Exact' ELSE 'Different' END FROM ({LABELS_SQL}) UNION ALL SELECT label, 'attr:nation', {BAND_SQL.format(a='CAST(x AS VARCHAR)', b='CAST(y AS VARCHAR)')} FROM ({LABELS_SQL})),
every AS (SELECT slot, o AS outcome FROM (SELECT DISTINCT slot FROM rows), unnest(['Exact', 'Similar', 'Different', 'Missing']) t(o)),
shares AS (SELECT e.slot, e.outcome, (count(*) FILTER (WHERE label = 'match' AND r.outcome = e.outcome) + 1) / CAST(count(*) FILTER (WHERE label = 'match') + 4 AS DOUBLE) AS m, (count(*) FILTER (WHERE label <> 'match' AND r.outcome = e.outcome) + 1) / CAST(count(*) FILTER (WHERE label <> 'match') + 4 AS DOUBLE) AS u FROM every e JOIN rows r ON r.slot = e.slot GROUP BY 1, 2)"""


@query(f"WITH {SHARES_SQL} SELECT slot, outcome, round(m, 9) AS m, round(u, 9) AS u FROM shares", plain=True)
def agg_14(spark, d):
    return resolution.probabilities(labelled(spark, d)).select("slot", "outcome", F.round("m", 9).alias("m"), F.round("u", 9).alias("u"))


SCORES_SQL = f"""{SHARES_SQL}, pairs AS (SELECT a, b, label, unnest(['name', 'name_tokens', 'attr:nation']) AS slot, unnest([{BAND_SQL.format(a='na', b='nb')}, CASE WHEN na = nb THEN 'Exact' ELSE 'Different' END, {BAND_SQL.format(a='CAST(x AS VARCHAR)', b='CAST(y AS VARCHAR)')}]) AS outcome FROM ({LABELS_SQL})),
scores AS (SELECT a, b, label, round(sum(ln(m / u)), 6) AS score FROM pairs JOIN shares USING (slot, outcome) GROUP BY 1, 2, 3)"""


@query(f"WITH {SCORES_SQL} SELECT a, b, score FROM scores", plain=True)
def scl_07(spark, d):
    rows = labelled(spark, d)
    return resolution.scored(rows, resolution.probabilities(rows)).select("a", "b", "score")


LIMITS_SQL = "limits AS (SELECT mid + 0.75 * (mm - mid) AS accept, mid - 0.75 * (mid - mu) AS review FROM (SELECT mm, mu, (mm + mu) / 2 AS mid FROM (SELECT avg(score) FILTER (WHERE label = 'match') AS mm, avg(score) FILTER (WHERE label <> 'match') AS mu FROM scores)))"


@query(f"WITH {SCORES_SQL}, {LIMITS_SQL} SELECT round(accept, 5) AS accept, round(review, 5) AS review FROM limits", plain=True)
def agg_15(spark, d):
    rows = labelled(spark, d)
    return resolution.thresholds(resolution.scored(rows, resolution.probabilities(rows))).select(F.round("accept", 5).alias("accept"), F.round("review", 5).alias("review"))


@query(f"""WITH {SCORES_SQL}, {LIMITS_SQL}, t AS (SELECT count(*) FILTER (WHERE label = 'match' AND score >= accept) AS tp, count(*) FILTER (WHERE label <> 'match' AND score >= accept) AS fp, count(*) FILTER (WHERE label = 'match' AND score < accept) AS fn, count(*) FILTER (WHERE label <> 'match' AND score < accept) AS tn FROM scores, limits)
SELECT tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM (SELECT *, CASE WHEN tp + fp = 0 THEN CAST(0 AS DOUBLE) ELSE tp / CAST(tp + fp AS DOUBLE) END AS p, CASE WHEN tp + fn = 0 THEN CAST(0 AS DOUBLE) ELSE tp / CAST(tp + fn AS DOUBLE) END AS r FROM t)""", plain=True)
def agg_16(spark, d):
    rows = labelled(spark, d)
    scores = resolution.scored(rows, resolution.probabilities(rows))
    decided = scores.join(F.broadcast(resolution.thresholds(scores)), F.lit(True))
    return resolution.evaluated(decided.withColumn("decision", resolution.decision(F.col("score"), F.col("accept"), F.col("review"))))


# --- scalar functions -------------------------------------------------------------------------


@query(f"SELECT vec_id, {COSINE('embedding', 'list_reverse(embedding)')} AS score FROM embeddings", plain=True)
def scl_08(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(scalars.cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("score"))


@query(f"SELECT rel_id, {STRENGTH.replace('CAST(evidence_count AS DOUBLE)', 'CAST(evidence_count - 1 AS DOUBLE)')} AS strength, CAST(round(greatest(1.0 - 0.01 * {AGE}, 0.5), 6) AS DOUBLE) AS decay FROM edge e")
def scl_09(spark, d):
    age = scalars.age_days(F.col("recorded_at"), as_of())
    return edges(spark, d).select("rel_id", F.round(scalars.effective_strength(F.col("strength"), F.col("evidence_count"), F.col("success_rate"), age), 6).alias("strength"), F.round(scalars.decay_factor(age), 6).alias("decay"))


@query("SELECT rel_id, round(least(strength + 0.05 * sqrt(CAST(evidence_count AS DOUBLE)), 1.0), 6) AS strength FROM edge")
def scl_11(spark, d):
    return edges(spark, d).select("rel_id", F.round(scalars.reinforced(F.col("strength"), F.col("evidence_count")), 6).alias("strength"))


@query("SELECT rel_id, round(CASE WHEN kind = 'Replaces' THEN 0.1 ELSE greatest(least(0.8 + 0.05 * evidence_count - 0.05 * (version_lsn % 15), 1.0), 0.1) END, 6)::DOUBLE AS confidence FROM edge")
def scl_12(spark, d):
    return edges(spark, d).select("rel_id", F.round(scalars.derived_confidence(F.col("kind") == "Replaces", F.col("evidence_count"), F.col("version_lsn") % 15), 6).alias("confidence"))


@query(f"SELECT rel_id, inverse, CAST(round(default_strength, 2) AS DOUBLE) AS default_strength FROM edge e JOIN {KINDS_SQL} ON kinds.kind = e.kind")
def scl_26(spark, d):
    return edges(spark, d).join(F.broadcast(kinds_table(spark)), "kind").select("rel_id", "inverse", F.round("default_strength", 2).alias("default_strength"))


@query(f"SELECT memory_id, date_diff('second', recorded_at, {AS_OF}) // 86400 AS age FROM mem")
def scl_30(spark, d):
    return memories(spark, d).select("memory_id", scalars.age_days(F.col("recorded_at"), as_of()).alias("age"))


@query("SELECT memory_id, CASE WHEN provenance IN ('Asserted', 'Extracted') THEN 'observed' WHEN provenance = 'Derived' THEN 'inferred' ELSE 'imported' END AS label FROM mem")
def scl_26_labels(spark, d):
    return memories(spark, d).select("memory_id", scalars.provenance_label(F.col("provenance")).alias("label"))


@query()
def grf_25(spark, d):
    """Two cycles over a store of documents with their vectors: one is kept, the other regresses and is undone."""
    vector = table(spark, d, "embeddings").select(F.concat(F.lit("doc:"), "vec_id").alias("memory_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    store = Store(spark, new_folder(spark, "cycle"))
    store.commit({"memories": memories(spark, d).join(vector, "memory_id", "left"), "edges": edges(spark, d)})
    for tolerance in (consolidation.TOLERANCE, -1e6):
        consolidation.cycle(store, as_of(), tolerance)
    changed = [(v, t, len(store.manifest(v)["tables"].get(t, []))) for v in store.versions() for t in ("memories", "edges", "similar", "abstractions")]
    folders = spark.createDataFrame(changed, "version int, name string, folders int")
    return folders.unionByName(store.read("audit").select(F.lit(0).alias("version"), F.concat(F.lit("rolled back "), F.col("rolled_back").cast("string")).alias("name"), F.col("anchors").cast("int").alias("folders")))
