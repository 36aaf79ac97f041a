"""The driver's tables seen as a graph, for queries: nodes, edges, versions, records and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.visibility import Caller

AS_OF = "TIMESTAMP '2024-03-01 00:00:00'"
CALLER = Caller(user="u1", org="org", projects=("src0", "src1", "src2", "src3"), teams=("t0", "t1"), ceiling=4)
NODE_TYPES = ["Problem", "Solution", "Fix", "Error", "Task", "FileContext"]
EDGE_KINDS = ["Solves", "Fixes", "Causes", "DependsOn", "Requires", "BuildsOn", "Blocks", "Contradicts", "Confirms", "Modifies", "Replaces", "RelatedTo"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.expr(AS_OF)


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node for each document."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    types = ", ".join(f"'{t}'" for t in NODE_TYPES)
    return documents.join(labels.select("doc_id", "quality"), "doc_id", "left").selectExpr(
        "concat('doc:', doc_id) AS memory_id",
        "doc_id AS version_lsn",
        f"element_at(array({types}), CAST(doc_id % 6 + 1 AS INT)) AS memory_type",
        "substring(text, 1, 200) AS title",
        "text AS content",
        "array(lang, source) AS tags",
        "array(concat('e', doc_id % 17), concat('f', doc_id % 23)) AS entities",
        "CAST(doc_id % 5 AS INT) AS visibility",
        "'org' AS org",
        "source AS project",
        "concat('t', doc_id % 3) AS team",
        "concat('u', doc_id % 7) AS user_id",
        "concat('s', doc_id div 10) AS session",
        "CAST(coalesce(quality, 0) AS DOUBLE) AS importance",
        "0.5D + (doc_id % 5) / 10D AS confidence",
        "CASE WHEN doc_id % 4 = 0 THEN 'Derived' WHEN doc_id % 19 = 0 THEN 'ExternalSnapshot' ELSE 'Asserted' END AS provenance",
        "CASE WHEN doc_id % 4 = 0 AND doc_id > 1 THEN array(concat('e:', doc_id div 2)) ELSE CAST(array() AS ARRAY<STRING>) END AS evidence",
        "CAST(TIMESTAMP '2024-01-01' + make_dt_interval(CAST(doc_id % 60 AS INT)) AS TIMESTAMP) AS valid_from",
        "CASE WHEN doc_id % 11 = 0 THEN CAST(TIMESTAMP '2024-01-01' + make_dt_interval(CAST(doc_id % 60 + 30 AS INT)) AS TIMESTAMP) END AS valid_until",
        "CAST(TIMESTAMP '2024-01-01' + make_dt_interval(CAST(doc_id % 60 AS INT)) AS TIMESTAMP) AS recorded_at",
        "CASE WHEN doc_id % 29 = 3 THEN concat('doc:', doc_id div 2) END AS invalidated_by",
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two families of edges between documents; ids begin with e: and f:."""
    documents = table(spark, sf_dir, "documents").where("doc_id >= 1").select("doc_id")
    kinds = ", ".join(f"'{k}'" for k in EDGE_KINDS)
    family = lambda name, to, shift: documents.selectExpr(
        f"concat('{name}:', doc_id) AS rel_id",
        "concat('doc:', doc_id) AS from_id",
        f"concat('doc:', {to}) AS to_id",
        f"element_at(array({kinds}), CAST((doc_id * 5 + doc_id div 7 + {shift}) % 12 + 1 AS INT)) AS kind",
        "doc_id AS version_lsn",
        "CAST(2 + doc_id % 3 AS INT) AS visibility",
        "CASE WHEN doc_id % 4 = 0 THEN 'Derived' ELSE 'Asserted' END AS provenance",
        "CASE WHEN doc_id % 4 = 0 THEN concat('R', doc_id % 9) END AS rule",
        f"CASE WHEN doc_id % 4 = 0 AND doc_id > 1 THEN array(concat('{name}:', doc_id div 2), concat('e:', doc_id div 3 + 1)) ELSE CAST(array() AS ARRAY<STRING>) END AS evidence",
        "0.3D + (doc_id % 7) / 10D AS strength",
        "(doc_id % 10) / 10D AS confidence",
        "CAST(1 + doc_id % 9 AS INT) AS evidence_count",
        "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE (doc_id % 10) / 10D END AS success_rate",
        "doc_id % 6 = 0 AS bidirectional",
        "CAST(TIMESTAMP '2024-01-01' + make_dt_interval(CAST(doc_id % 50 AS INT)) AS TIMESTAMP) AS valid_from",
        "CASE WHEN doc_id % 13 = 0 THEN CAST(TIMESTAMP '2024-01-01' + make_dt_interval(CAST(doc_id % 50 + 10 AS INT)) AS TIMESTAMP) END AS valid_until",
        "CAST(TIMESTAMP '2024-01-01' + make_dt_interval(CAST(doc_id % 50 AS INT)) AS TIMESTAMP) AS recorded_at",
        "CAST(NULL AS STRING) AS invalidated_by",
    )
    return family("e", "doc_id div 2", 0).unionByName(family("f", "doc_id div 3", 4))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of users: a purchase or an error closes a version after an hour."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('user:', user_id) AS memory_id",
        "event_id AS version_lsn",
        "event_type AS title",
        "value",
        "CAST(ts AS TIMESTAMP) AS recorded_at",
        "CAST(ts AS TIMESTAMP) AS valid_from",
        "CASE WHEN event_type IN ('purchase', 'error') THEN CAST(ts + INTERVAL 1 HOUR AS TIMESTAMP) END AS valid_until",
        "props",
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers as records to resolve."""
    customers = table(spark, sf_dir, "customer").selectExpr("concat('c', c_custkey) AS id", "c_name AS name", "map('nation', CAST(c_nationkey AS STRING), 'segment', c_mktsegment) AS attributes")
    suppliers = table(spark, sf_dir, "supplier").selectExpr("concat('s', s_suppkey) AS id", "s_name AS name", "map('nation', CAST(s_nationkey AS STRING)) AS attributes")
    return customers.unionByName(suppliers)


# --- the same rows as SQL for the oracle ------------------------------------------------------


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


MEMORIES_SQL = f"""SELECT 'doc:' || d.doc_id AS memory_id, d.doc_id AS version_lsn, {_list(NODE_TYPES)}[CAST(d.doc_id % 6 + 1 AS INT)] AS memory_type,
  substr(text, 1, 200) AS title, text AS content, [lang, source] AS tags, ['e' || (d.doc_id % 17), 'f' || (d.doc_id % 23)] AS entities,
  CAST(d.doc_id % 5 AS INT) AS visibility, 'org' AS org, source AS project, 't' || (d.doc_id % 3) AS team, 'u' || (d.doc_id % 7) AS user_id, 's' || (d.doc_id // 10) AS session,
  CAST(coalesce(quality, 0) AS DOUBLE) AS importance, CAST(0.5 AS DOUBLE) + (d.doc_id % 5) / CAST(10 AS DOUBLE) AS confidence,
  CASE WHEN d.doc_id % 4 = 0 THEN 'Derived' WHEN d.doc_id % 19 = 0 THEN 'ExternalSnapshot' ELSE 'Asserted' END AS provenance,
  CASE WHEN d.doc_id % 4 = 0 AND d.doc_id > 1 THEN ['e:' || (d.doc_id // 2)] ELSE CAST([] AS VARCHAR[]) END AS evidence,
  TIMESTAMP '2024-01-01' + to_days(CAST(d.doc_id % 60 AS INT)) AS valid_from,
  CASE WHEN d.doc_id % 11 = 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(d.doc_id % 60 + 30 AS INT)) END AS valid_until,
  TIMESTAMP '2024-01-01' + to_days(CAST(d.doc_id % 60 AS INT)) AS recorded_at,
  CASE WHEN d.doc_id % 29 = 3 THEN 'doc:' || (d.doc_id // 2) END AS invalidated_by
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def _edges_sql(name: str, to: str, shift: int) -> str:
    return f"""SELECT '{name}:' || doc_id AS rel_id, 'doc:' || doc_id AS from_id, 'doc:' || ({to}) AS to_id, {_list(EDGE_KINDS)}[CAST((doc_id * 5 + doc_id // 7 + {shift}) % 12 + 1 AS INT)] AS kind,
  doc_id AS version_lsn, CAST(2 + doc_id % 3 AS INT) AS visibility, CASE WHEN doc_id % 4 = 0 THEN 'Derived' ELSE 'Asserted' END AS provenance,
  CASE WHEN doc_id % 4 = 0 THEN 'R' || (doc_id % 9) END AS rule,
  CASE WHEN doc_id % 4 = 0 AND doc_id > 1 THEN ['{name}:' || (doc_id // 2), 'e:' || (doc_id // 3 + 1)] ELSE CAST([] AS VARCHAR[]) END AS evidence,
  CAST(0.3 AS DOUBLE) + (doc_id % 7) / CAST(10 AS DOUBLE) AS strength, (doc_id % 10) / CAST(10 AS DOUBLE) AS confidence, CAST(1 + doc_id % 9 AS INT) AS evidence_count,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE (doc_id % 10) / CAST(10 AS DOUBLE) END AS success_rate, doc_id % 6 = 0 AS bidirectional,
  TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 50 AS INT)) AS valid_from,
  CASE WHEN doc_id % 13 = 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 50 + 10 AS INT)) END AS valid_until,
  TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 50 AS INT)) AS recorded_at, CAST(NULL AS VARCHAR) AS invalidated_by
FROM documents WHERE doc_id >= 1"""


EDGES_SQL = _edges_sql("e", "doc_id // 2", 0) + "\nUNION ALL " + _edges_sql("f", "doc_id // 3", 4)

VERSIONS_SQL = """SELECT 'user:' || user_id AS memory_id, event_id AS version_lsn, event_type AS title, value, ts AS recorded_at, ts AS valid_from,
  CASE WHEN event_type IN ('purchase', 'error') THEN ts + INTERVAL 1 HOUR END AS valid_until, props FROM events"""


def _scope(level: str, p: str) -> str:
    projects = ", ".join(f"'{x}'" for x in CALLER.projects)
    teams = ", ".join(f"'{x}'" for x in CALLER.teams)
    return f"({p}org = '{CALLER.org}' AND CASE {level} WHEN 0 THEN {p}user_id = '{CALLER.user}' WHEN 1 THEN {p}project IN ({projects}) WHEN 2 THEN {p}team IN ({teams}) ELSE TRUE END)"


def seen(p: str = "") -> str:
    """The rule for nodes as SQL."""
    return _scope(f"least({p}visibility, 3)", p)


SEEN_EDGES_SQL = f"""SELECT e.* FROM edge e JOIN mem a ON a.memory_id = e.from_id JOIN mem b ON b.memory_id = e.to_id
WHERE {seen("a.")} AND {seen("b.")} AND ({_scope("least(e.visibility, 3)", "a.")} OR {_scope("least(e.visibility, 3)", "b.")})"""

#: Common tables of all oracles.
WITH = f"""WITH RECURSIVE mem AS ({MEMORIES_SQL}), edge AS ({EDGES_SQL}), vis AS (SELECT * FROM mem WHERE {seen()}), vedge AS ({SEEN_EDGES_SQL}), ver AS ({VERSIONS_SQL})"""
