"""Scores 0 to 100 and grades A to F of repositories, and their roll-ups."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions.refs import full_name
from shoal.operators.audit import options_of
from shoal.operators.scan import scan
from shoal.sources.config import Config
from shoal.sources.workflows import action_refs, parse_workflows, run_block_units

RUBRIC_VERSION, ENGINE_VERSION = "0.3.0", "0.1.0"


class ScoreRule(NamedTuple):
    id: str
    category: str
    severity: str
    points: int
    remediation: str


# Ids, categories, severities and points of the rubric.
SCORE_RULES = (
    ScoreRule("pin.branch", "pin", "high", 15, "Use the full commit SHA and keep the tag as a comment."),
    ScoreRule("pin.sliding", "pin", "medium", 5, "Use the full commit SHA and keep the tag as a comment."),
    ScoreRule("pin.full_tag", "pin", "low", 2, "Use the full commit SHA and keep the tag as a comment."),
    ScoreRule("source.unverified", "source", "low", 1, "Check the publisher, then add it to trusted-owners, or pin to a fork of your own."),
    ScoreRule("runtime.pipe_to_shell", "runtime", "high", 20, "Save the download, check its digest or signature, then run it."),
    ScoreRule("runtime.fetch.high", "runtime", "high", 15, "Fetch a fixed version and check its digest."),
    ScoreRule("runtime.fetch.medium", "runtime", "medium", 8, "Fix the version of what is fetched."),
    ScoreRule("runtime.fetch.low", "runtime", "low", 3, "Look at the fetch; a version in the URL is often enough."),
    ScoreRule("workflow.permissions_write_all", "workflow", "high", 10, "Give each job only the permissions it needs."),
    ScoreRule("workflow.pull_request_target", "workflow", "high", 5, "Check which ref is checked out; keep tokens away from code of pull requests."),
    ScoreRule("workflow.workflow_run", "workflow", "medium", 3, "Check where the triggering run comes from."),
)
GRADES = ((90, "A"), (80, "B"), (70, "C"), (60, "D"))
PIN_RULES = {"branch": "pin.branch", "sliding": "pin.sliding", "tag": "pin.full_tag"}
OCCURRENCES = "array<struct<workflow:string,line:int>>"


class Score(NamedTuple):
    findings: DataFrame
    report: DataFrame


def score_of(points: Column) -> Column:
    return F.greatest(F.lit(0), 100 - F.coalesce(points, F.lit(0))).cast("int")


def grade_of(score: Column) -> Column:
    out = F.lit("F")
    for least, grade in reversed(GRADES):
        out = F.when(score >= least, grade).otherwise(out)
    return out


def with_metadata(findings: DataFrame) -> DataFrame:
    """Category, severity, points and remediation of each finding's rule, from a literal map."""
    table = F.create_map(*[x for r in SCORE_RULES for x in (F.lit(r.id), F.struct(F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), F.lit(r.points).alias("points"), F.lit(r.remediation).alias("remediation")))])
    return findings.withColumn("m", F.element_at(table, F.col("id"))).select("*", "m.*").drop("m")


def ref_findings(refs: DataFrame, config: Config = Config()) -> DataFrame:
    """pin.* and source.* findings, each once per repository and action@ref, with all occurrences."""
    pin = F.create_map(*[F.lit(x) for pair in PIN_RULES.items() for x in pair])
    name = full_name(F.col("owner"), F.col("repo_name"), F.col("subpath"))
    unverified = F.when(~F.lower("owner").isin(config.owners()), "source.unverified")
    ids = F.filter(F.array(F.try_element_at(pin, F.col("ref_type")), unverified), lambda x: x.isNotNull())
    rows = refs.select("repo", F.concat(name, F.lit("@"), F.col("ref_string")).alias("action_ref"), "workflow", "line_number", F.explode(ids).alias("id"))
    occurrence = F.struct(F.col("workflow"), F.col("line_number").cast("int").alias("line"))
    return rows.groupBy("repo", "id", "action_ref").agg(F.array_sort(F.collect_list(occurrence)).alias("occurrences"))


def workflow_findings(parsed: DataFrame) -> DataFrame:
    """Top-level permissions and triggers of the files that parse, once per file."""
    ids = F.array(
        F.when(F.col("write_all"), "workflow.permissions_write_all"),
        F.when(F.array_contains("triggers", "pull_request_target"), "workflow.pull_request_target"),
        F.when(F.array_contains("triggers", "workflow_run"), "workflow.workflow_run"),
    )
    rows = parsed.where("valid").select("repo", "workflow", F.explode(F.filter(ids, lambda x: x.isNotNull())).alias("id")).distinct()
    return rows.select("repo", "id", F.lit(None).cast("string").alias("action_ref"), F.array(F.struct("workflow", F.lit(0).alias("line"))).cast(OCCURRENCES).alias("occurrences"))


def runtime_findings(parsed: DataFrame, config: Config = Config()) -> DataFrame:
    """One finding per match in the run blocks of the files that parse; severities count after the checksum step."""
    found = scan(run_block_units(parsed.where("valid")), options_of(config, verbose=False))
    rule = F.when(F.col("rule_kind") == "pipe", "runtime.pipe_to_shell").otherwise(F.concat(F.lit("runtime.fetch."), F.col("severity")))
    return found.select("repo", rule.alias("id"), F.lit(None).cast("string").alias("action_ref"), F.array(F.struct(F.col("source_file").alias("workflow"), F.col("line").cast("int").alias("line"))).cast(OCCURRENCES).alias("occurrences"))


def score(files: DataFrame, config: Config = Config(), parsed: DataFrame | None = None) -> Score:
    """Findings and one report row per repository. Settings for severity and for ignoring play no part.

    Files are parsed once and kept, in memory or on executors' disks, until the session's cache is
    cleared; give parsed to keep them otherwise.
    """
    parsed = parse_workflows(files).persist() if parsed is None else parsed
    refs = action_refs(parsed)
    findings = with_metadata(ref_findings(refs, config).unionByName(workflow_findings(parsed)).unionByName(runtime_findings(parsed, config)))
    repos = parsed.groupBy("repo").agg(F.count("*").alias("workflows_scanned"))
    unique = refs.groupBy("repo").agg(F.count_distinct(F.concat(full_name(F.col("owner"), F.col("repo_name"), F.col("subpath")), F.lit("@"), F.col("ref_string"))).alias("unique_actions"))
    return Score(findings, score_report(repos, findings, unique))


def score_report(repos: DataFrame, findings: DataFrame, unique: DataFrame) -> DataFrame:
    sums = findings.groupBy("repo").agg(F.sum("points").alias("points_deducted"), F.count("*").alias("findings"), F.sum(F.size("occurrences")).alias("occurrences"))
    out = repos.join(sums, "repo", "left").join(unique, "repo", "left").fillna(0, ["points_deducted", "findings", "occurrences", "unique_actions"])
    out = out.withColumn("score", score_of(F.col("points_deducted"))).withColumn("grade", grade_of(F.col("score")))
    return out.select("repo", F.lit(RUBRIC_VERSION).alias("rubric_version"), F.lit(ENGINE_VERSION).alias("engine_version"), "score", "grade", F.col("points_deducted").cast("int").alias("points_deducted"), "findings", "workflows_scanned", "unique_actions", "occurrences", F.when(F.col("findings") > 0, 1).otherwise(0).alias("status"))


def in_report_order(findings: DataFrame) -> DataFrame:
    """Most points first, then by rule and action."""
    return findings.orderBy("repo", F.desc("points"), "id", F.coalesce("action_ref", F.lit("")), "occurrences")


def workflow_scores(findings: DataFrame) -> DataFrame:
    """Score of each workflow alone: every rule and action once in it."""
    rows = findings.select("repo", "id", "action_ref", "points", F.posexplode("occurrences").alias("n", "o")).withColumn("workflow", F.col("o.workflow"))
    once = rows.where("action_ref is null").select("repo", "workflow", "points").unionByName(rows.where("action_ref is not null").select("repo", "workflow", "id", "action_ref", "points").distinct().select("repo", "workflow", "points"))
    out = once.groupBy("repo", "workflow").agg(F.sum("points").alias("points_deducted")).withColumn("score", score_of(F.col("points_deducted")))
    return out.withColumn("grade", grade_of(F.col("score")))


def org_scores(reports: DataFrame, uses: DataFrame, org: Column | None = None) -> DataFrame:
    """Mean of the repositories' scores weighted by their number of action uses; plain mean if there are none."""
    org = F.substring_index("repo", "/", 1) if org is None else org
    rows = reports.join(uses, "repo", "left").fillna(0, ["uses"]).withColumn("org", org)
    weighted = F.sum(F.col("score") * F.col("uses")) / F.nullif(F.sum("uses"), F.lit(0))
    return rows.groupBy("org").agg(F.round(F.coalesce(weighted, F.avg("score")), 2).alias("score"), F.count("*").alias("repos"))


def score_changes(history: DataFrame) -> DataFrame:
    """history (repo, scanned_at, score) with the score before and the difference."""
    before = F.lag("score").over(Window.partitionBy("repo").orderBy("scanned_at"))
    return history.withColumn("before", before).withColumn("change", F.col("score") - F.col("before"))
