"""Document sources: git history, issue trackers, and change events, as drafts and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scalars import bounded_text, cell_text, derived_id, title_of
from loomgraph.operators.temporal import running_total

BODY, NOTICE = 4000, "\n[cut]"
PROBLEM_WORDS = ("bug", "defect", "incident", "regression")

# --- change events ----------------------------------------------------------------------------

CELLS = "array<struct<name:string,value:string>>"
CHANGE = f"action string, table string, columns {CELLS}, identity {CELLS}"
ACTIONS = ("I", "U", "D", "T", "M")


def changes(lines: DataFrame, column: str = "value") -> DataFrame:
    """Change events from JSON text: action, table, and cells as maps; null JSON cells are null."""
    as_map = lambda c: F.map_from_entries(F.transform(F.coalesce(c, F.array().cast(CELLS)), lambda x: F.struct(x["name"], cell_text(x["value"]))))
    event = lines.select(*[c for c in lines.columns if c != column], F.from_json(column, CHANGE).alias("c"))
    rest = [c for c in lines.columns if c != column]
    return event.select(*rest, F.col("c.action").alias("action"), F.col("c.table").alias("table"), as_map(F.col("c.columns")).alias("columns"), as_map(F.col("c.identity")).alias("identity"))


def mapped_changes(events: DataFrame, table: str, pk: list[str]) -> DataFrame:
    """``events`` with verdict (row, delete, skip, null_key, unknown), pk and the new image.

    The image is the old identity with the new columns over it.
    """
    fresh = F.map_filter("identity", lambda k, _: ~F.map_contains_key("columns", k))
    image = F.map_concat(fresh, F.col("columns"))
    row = events.withColumn("image", image)
    parts = [F.element_at("image", c) for c in pk]
    key = F.concat_ws("\x1f", *parts)
    absent = F.lit(False)
    for p in parts:
        absent |= p.isNull() | (p == "")
    verdict = (
        F.when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "unknown")
        .when(F.col("action").isin("T", "M") | ~F.col("table").eqNullSafe(F.lit(table)), "skip")
        .when(absent, "null_key")
        .when(F.col("action") == "D", "delete")
        .otherwise("row")
    )
    return row.withColumn("verdict", verdict).withColumn("pk", F.when(~absent, key))


# --- git --------------------------------------------------------------------------------------


def git_log(records: DataFrame, column: str = "value") -> DataFrame:
    """Commits from log records: fields by 0x1f, then the lines of changed files; bad ones are marked."""
    parts = F.split(F.ltrim(F.col(column)), "\x1f")
    rows = records.where(F.trim(column) != "").select(parts.alias("p"))
    files = F.filter(F.split(F.coalesce(F.get("p", F.lit(6)), F.lit("")), "\n"), lambda f: F.trim(f) != "")
    good = (F.size("p") >= 6) & (F.get("p", F.lit(0)) != "")
    return rows.select(
        F.get("p", F.lit(0)).alias("sha"), F.get("p", F.lit(1)).alias("author"), F.get("p", F.lit(2)).alias("email"), F.to_timestamp(F.get("p", F.lit(3))).alias("at"),
        F.get("p", F.lit(4)).alias("subject"), F.get("p", F.lit(5)).alias("body"), F.transform(files, lambda f: F.trim(f)).alias("files"), good.alias("good"),
    )


def commit_type(subject: Column) -> Column:
    return F.when(F.startswith(subject, F.lit("fix:")) | F.startswith(subject, F.lit("fix(")), "Fix").otherwise("Command")


def git_drafts(commits: DataFrame, repo: str, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Drafts of commits and files, and Modifies edges; ``rows`` keeps the oldest commits within it."""
    good = commits.where("good")
    if rows is not None:
        good = running_total(good, 1 + F.size("files"), ["at", "sha"], "weight").where(F.col("weight") <= rows)
    node = lambda domain, c: derived_id(domain, F.lit(repo), c)
    made = good.select(node("commit", F.col("sha")).alias("memory_id"), commit_type(F.col("subject")).alias("memory_type"), title_of(F.col("subject")).alias("title"), bounded_text(F.col("body"), BODY, NOTICE).alias("content"), F.col("at").alias("valid_from"))
    touched = good.select("sha", F.explode("files").alias("file"))
    files = touched.select("file").distinct().select(node("file", F.col("file")).alias("memory_id"), F.lit("FileContext").alias("memory_type"), title_of(F.col("file")).alias("title"), F.col("file").alias("content"), F.lit(None).cast("timestamp").alias("valid_from"))
    edges = touched.distinct().select(node("commit", F.col("sha")).alias("from_id"), node("file", F.col("file")).alias("to_id"), F.lit("Modifies").alias("kind"))
    return made.unionByName(files), edges


# --- issue trackers ---------------------------------------------------------------------------

ISSUE = "number long, title string, body string, labels array<string>, state string, updatedAt string, closedAt string"
PULL = "number long, title string, body string, merged boolean, closes array<long>, updatedAt string, closedAt string"


def issue_type(labels: Column) -> Column:
    """Problem if a label holds one of the words for defects, Task otherwise."""
    hit = F.lit(False)
    for word in PROBLEM_WORDS:
        hit |= F.contains(F.lower(F.array_join(F.coalesce(labels, F.array().cast("array<string>")), "\n")), F.lit(word))
    return F.when(hit, "Problem").otherwise("Task")


def tracker_drafts(issues: DataFrame, pulls: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """Drafts of issues and pull requests, and an edge for each issue that a pull request closes.

    A pull request that closes a problem is a Fix, one that closes a task a Solution, others a
    Command; one that was closed without a merge is valid until then.
    """
    node = lambda kind, c: derived_id(kind, F.lit(repo), c.cast("string"))
    typed = issues.withColumn("memory_type", issue_type(F.col("labels")))
    links = pulls.select(F.col("number").alias("pull"), F.explode("closes").alias("issue")).distinct()
    ends = links.join(typed.select(F.col("number").alias("issue"), "memory_type"), "issue")
    best = ends.groupBy(F.col("pull").alias("number")).agg(F.max(F.col("memory_type") == "Problem").alias("fixes"))
    pull_type = F.when(F.col("fixes"), "Fix").when(F.col("fixes").isNotNull(), "Solution").otherwise("Command")
    until = F.when(~F.col("merged"), F.to_timestamp("closedAt"))
    text = bounded_text(F.coalesce("body", F.lit("")), BODY, NOTICE).alias("content")
    made = pulls.join(best, "number", "left").select(node("pull", F.col("number")).alias("memory_id"), pull_type.alias("memory_type"), title_of(F.col("title")).alias("title"), text, F.to_timestamp("updatedAt").alias("valid_from"), until.alias("valid_until"))
    asked = typed.select(node("issue", F.col("number")).alias("memory_id"), "memory_type", title_of(F.col("title")).alias("title"), text, F.to_timestamp("updatedAt").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_until"))
    fixing = ends.join(best.withColumnRenamed("number", "pull"), "pull")
    kind = F.when(F.col("memory_type") == "Problem", "Fixes").when(F.col("fixes"), "RelatedTo").otherwise("Solves")
    edges = fixing.select(node("pull", F.col("pull")).alias("from_id"), node("issue", F.col("issue")).alias("to_id"), kind.alias("kind"))
    return asked.unionByName(made), edges


def windows(rows: DataFrame, size: int, order: str = "updatedAt") -> DataFrame:
    """``rows`` with a window number of about ``size`` rows each, in the order of their time."""
    return running_total(rows, F.lit(1), [order], "window").withColumn("window", F.floor((F.col("window") - 1) / size))


def cursor(rows: DataFrame, column: str = "updatedAt", truncated: bool = False) -> DataFrame:
    """One row (cursor): the largest time seen; if a page was cut, the time before the last one."""
    if not truncated:
        return rows.agg(F.max(column).alias("cursor"))
    last = rows.agg(F.max(column).alias("last"))
    return rows.join(F.broadcast(last), F.col(column) < F.col("last")).agg(F.max(column).alias("cursor"))


LINEAR = "id string, title string, description string, labels array<string>, parent string, project string, blocks array<string>, related array<string>"


def linear_drafts(issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drafts of issues and projects; Blocks, RelatedTo, Contains and InProject edges inside the window."""
    node = lambda kind, c: derived_id(kind, c)
    made = issues.select(node("issue", F.col("id")).alias("memory_id"), issue_type(F.col("labels")).alias("memory_type"), title_of(F.col("title")).alias("title"))
    projects = issues.where("project IS NOT NULL").select("project").distinct()
    made = made.unionByName(projects.select(node("project", F.col("project")).alias("memory_id"), F.lit("Project").alias("memory_type"), title_of(F.col("project")).alias("title")))
    pair = lambda a, b, kind: issues.select(a.alias("a"), b.alias("b"), F.lit(kind).alias("kind"))
    related = issues.select("id", F.explode("related").alias("r"))
    links = pair(F.col("id"), F.explode("blocks"), "Blocks")
    links = links.unionByName(related.select(F.least("id", "r").alias("a"), F.greatest("id", "r").alias("b"), F.lit("RelatedTo").alias("kind")))
    links = links.unionByName(issues.where("parent IS NOT NULL").select(F.col("parent").alias("a"), F.col("id").alias("b"), F.lit("Contains").alias("kind")))
    for side in ("a", "b"):
        links = links.join(issues.select(F.col("id").alias(side)).distinct(), side, "left_semi").select("a", "b", "kind")
    edges = links.distinct().select(node("issue", F.col("a")).alias("from_id"), node("issue", F.col("b")).alias("to_id"), "kind")
    members = issues.where("project IS NOT NULL").select(node("issue", F.col("id")).alias("from_id"), node("project", F.col("project")).alias("to_id"), F.lit("InProject").alias("kind"))
    return made, edges.unionByName(members.distinct())
