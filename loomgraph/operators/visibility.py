"""Who may see which rows.  Every rule is a Column, so it is pushed towards the scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.schema import ORG, PRIVATE, PROJECT, TEAM


@dataclass(frozen=True)
class Caller:
    """The caller's scope; ``*`` among the projects grants all of them."""

    user: str
    org: str
    projects: tuple[str, ...] = ()
    teams: tuple[str, ...] = ()
    ceiling: int = 4


def project_granted(caller: Caller, project: Column) -> Column:
    """Whether the caller has the project, by name or by the wildcard; a null project is never granted."""
    if "*" in caller.projects:
        return project.isNotNull()
    return F.coalesce(project.isin(*caller.projects), F.lit(False)) if caller.projects else F.lit(False)


def in_scope(caller: Caller, level: Column, prefix: str = "") -> Column:
    """Whether a row's scope columns admit the caller at ``level``; a null scope never widens."""
    user, project, team = (F.col(prefix + c) for c in ("user_id", "project", "team"))
    member = team.isin(*caller.teams) if caller.teams else F.lit(False)
    rule = F.when(level == PRIVATE, user == caller.user).when(level == PROJECT, project_granted(caller, project)).when(level == TEAM, member).otherwise(F.lit(True))
    return F.coalesce((F.col(prefix + "org") == caller.org) & rule, F.lit(False))


def memory_visible(caller: Caller, prefix: str = "") -> Column:
    """The rule for nodes: same org, public counts as org, at most the ceiling, and in scope."""
    level = F.least(F.col(prefix + "visibility").cast("int"), F.lit(ORG))
    return F.coalesce((level <= min(caller.ceiling, ORG)) & in_scope(caller, level, prefix), F.lit(False))


#: Scope columns of a node that the rule for edges needs.
SCOPE = ["org", "project", "team", "user_id", "visibility"]


def with_endpoints(edges: DataFrame, nodes: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """``edges`` joined with both nodes; their columns get the prefixes from_ and to_."""
    for side in ("from_", "to_"):
        columns = [F.col("memory_id").alias(side + "id"), *[F.col(c).alias(side + c) for c in (*SCOPE, *extra)]]
        edges = edges.join(nodes.select(*columns), side + "id")
    return edges


def relationship_visible(caller: Caller) -> Column:
    """The rule for edges that have their endpoints: both visible, and one in scope at the edge's level."""
    level = F.least(F.col("visibility").cast("int"), F.lit(ORG))
    one_side = in_scope(caller, level, "from_") | in_scope(caller, level, "to_")
    both = memory_visible(caller, "from_") & memory_visible(caller, "to_")
    return F.coalesce((level <= min(caller.ceiling, ORG)) & both & one_side, F.lit(False))


def visible_edges(edges: DataFrame, nodes: DataFrame, caller: Caller) -> DataFrame:
    return with_endpoints(edges, nodes).where(relationship_visible(caller)).select(*edges.columns)


def narrowest(*levels: Column | str) -> Column:
    """The narrowest of some visibilities."""
    return F.least(*levels)
