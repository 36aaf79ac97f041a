"""Vocabulary of the graph: types, kinds, legal triples, reject codes.

Tables of the vocabulary are small and fixed, so they may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PRIVATE, PROJECT, TEAM, ORG, PUBLIC = range(5)

# Names of memory and entity types, in order of declaration.
MEMORY_TYPES = "Task CodePattern Problem Solution Project Technology Error Fix Command FileContext Workflow General Conversation".split()
ENTITY_TYPES = "File Function Class Error Technology Concept Person Project Command Package Url Variable".split()

# Kinds as name, bucket, inverse (Self: symmetric) and default strength.
KINDS = [
    tuple(line.split())
    for line in """
Solves Solution SolvedBy 0.85
Addresses Solution AddressedBy 0.70
AlternativeTo Solution Self 0.60
Improves Solution ImprovedBy 0.70
Replaces Solution ReplacedBy 0.90
Causes Causal CausedBy 0.85
Prevents Causal PreventedBy 0.80
Triggers Causal TriggeredBy 0.75
LeadsTo Causal FollowsFrom 0.70
Enables Causal EnabledBy 0.65
Blocks Causal BlockedBy 0.75
Fixes Causal FixedBy 0.90
Uses Context UsedBy 0.70
Requires Context RequiredBy 0.85
DependsOn Context DependedBy 0.75
Contains Context ContainedBy 0.70
PartOf Context HasPart 0.70
InSession Context HasMember 0.80
InProject Context ProjectHas 0.80
WrittenIn Context Powers 0.65
Modifies Context ModifiedBy 0.65
Teaches Learning LearnedFrom 0.70
Demonstrates Learning Self 0.65
Contradicts Learning Self 0.80
Confirms Learning ConfirmedBy 0.75
BuildsOn Learning BuiltOnBy 0.75
Specializes Learning Generalizes 0.70
SimilarTo Similarity Self 0.60
DifferentFrom Similarity Self 0.55
AnalogousTo Similarity Self 0.55
RelatedTo Similarity Self 0.30
Precedes Workflow Follows 0.70
ParallelTo Workflow Self 0.50
Executes Workflow ExecutedBy 0.75
Creates Workflow CreatedBy 0.75
Configures Workflow ConfiguredBy 0.65
Automates Workflow AutomatedBy 0.75
Validates Quality ValidatedBy 0.75
Tests Quality TestedBy 0.75
Measures Quality MeasuredBy 0.65
Documents Quality DocumentedBy 0.65
Verifies Quality VerifiedBy 0.75
IntegratesWith Integration Self 0.70
Consumes Integration ConsumedBy 0.70
Produces Integration ProducedBy 0.70
Exposes Integration ExposedBy 0.65
Wraps Integration WrappedBy 0.70
Bridges Integration BridgedBy 0.70
Summarizes Context Self 0.70
""".strip().splitlines()
]

# Kinds that only the engine itself may write.
COMPUTED_KINDS = ["SimilarTo", "Summarizes"]

# Legal endpoint types of the restricted kinds; _ is any type.  Other kinds are free.
TRIPLES = """
Solves: Solution Fix > Problem Error
Addresses: Solution Fix > Problem Error
AlternativeTo: Solution Fix > Solution Fix
Improves: Solution Fix CodePattern > Solution Fix CodePattern Task
Causes: _ > Error Problem
Prevents: Solution Fix CodePattern > Error Problem
Fixes: Fix > Error Problem
Uses: _ > Technology Command
Requires: _ > Technology
InSession: _ > Conversation
InProject: _ > Project
WrittenIn: CodePattern FileContext > Technology
Modifies: Task Command Fix > FileContext
Executes: Command > _
Creates: Task Command Fix > FileContext
Automates: Workflow Command > _
"""

# Reject codes by number, with what a producer does about each.
REJECT_CODES = [
    tuple(line.split())
    for line in """
0 UNKNOWN Permanent
1 INCOMPATIBLE_ONTOLOGY Fatal
2 UNKNOWN_SOURCE Fatal
3 UNKNOWN_MEMORY_TYPE Permanent
4 UNKNOWN_KIND Permanent
5 INVALID_TYPE_TRIPLE Permanent
6 VISIBILITY_WIDENING Permanent
7 MISSING_EXTERNAL_KEY Permanent
8 DUPLICATE_BATCH Success
9 BAD_CHECKSUM Fatal
10 UNAUTHORIZED Fatal
11 RATE_LIMITED Retry
12 COMPUTED_KIND_REJECTED Permanent
13 INVALID_EXTERNAL_KEY Permanent
14 RESOURCE_LIMIT_EXCEEDED Permanent
15 SOURCE_REWOUND Fatal
16 SCHEMA_DRIFT Fatal
17 PROJECTION_BOUND_EXCEEDED Fatal
""".strip().splitlines()
]


def triples() -> list[tuple[str | None, str, str | None]]:
    """(from type, kind, to type) of every legal combination; None is any type."""
    out: list[tuple[str | None, str, str | None]] = []
    restricted = set()
    for line in TRIPLES.strip().splitlines():
        kind, _, sides = line.partition(":")
        left, right = ([None if t == "_" else t for t in side.split()] for side in sides.split(">"))
        restricted.add(kind)
        out += [(a, kind, b) for a in left for b in right]
    return out + [(None, k, None) for k, *_ in KINDS if k not in restricted]


def kinds_table(spark: SparkSession) -> DataFrame:
    rows = [(k, bucket, None if inverse == "Self" else inverse, float(strength), k in COMPUTED_KINDS) for k, bucket, inverse, strength in KINDS]
    return spark.createDataFrame(rows, "kind string, bucket string, inverse string, default_strength double, computed_only boolean")


def triples_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(triples(), "from_type string, kind string, to_type string")


def reject_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(int(n), c, d) for n, c, d in REJECT_CODES], "code int, reject_code string, disposition string")
