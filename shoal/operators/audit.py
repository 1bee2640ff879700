"""Audit of a corpus: run blocks, and the sources of the actions it uses."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions.refs import full_name, short_ref
from shoal.operators.scan import ScanOptions, scan
from shoal.sources.config import Config, severity_rank
from shoal.sources.snapshots import first_layer
from shoal.sources.workflows import action_refs, composite_scripts, parse_workflows, run_block_units


class Audit(NamedTuple):
    findings: DataFrame
    allowed: DataFrame
    refs: DataFrame  # one row per repository and owner/repo@ref, with its status
    report: DataFrame  # one row per repository
    clean: DataFrame  # commits that a scan found nothing in, for the clean cache


def rank_of(severity: Column) -> Column:
    return F.when(severity == "high", 2).when(severity == "medium", 1).otherwise(0)


def options_of(config: Config, verbose: bool = True, strict_hosts: bool = False) -> ScanOptions:
    return ScanOptions(config.trusted_hosts, config.extra_data_formats, strict_hosts, verbose)


def first_refs(refs: DataFrame) -> DataFrame:
    """The first use of each owner/repo@ref in a repository, by file and line; subpaths don't count apart."""
    order = Window.partitionBy("repo", "owner", "repo_name", "ref_string").orderBy("workflow", "line_number")
    return refs.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def is_ignored(config: Config) -> Column:
    name = F.concat_ws("/", "owner", "repo_name")
    out = F.lit(False)
    for prefix in config.ignore_actions:
        out = out | name.startswith(prefix)
    return out


def ref_status(refs: DataFrame, audited: DataFrame, sources: DataFrame, config: Config) -> DataFrame:
    """first_refs with status: ignored, a layer of the catalog, or fresh, sliding, branch for what is
    scanned; failed where its source is not in the snapshot."""
    known = first_layer(audited).withColumnRenamed("sha", "ref_string")
    there = sources.select("owner", "repo_name", F.col("ref").alias("ref_string")).distinct().withColumn("there", F.lit(True))
    rows = first_refs(refs).join(known, ["owner", "repo_name", "ref_string"], "left").join(there, ["owner", "repo_name", "ref_string"], "left")
    scanned = F.when(F.col("there").isNull(), "failed").when(F.col("ref_type") == "sliding", "sliding").when(F.col("ref_type") == "branch", "branch").otherwise("fresh")
    return rows.withColumn("status", F.when(is_ignored(config), "ignored").when(F.col("layer").isNotNull(), F.col("layer")).otherwise(scanned)).drop("there", "layer")


def source_kind(path: Column, subpath: Column) -> Column:
    """action_yml, javascript, python or dockerfile; null for files that are not scanned."""
    base = F.coalesce(subpath, F.lit(""))
    below = F.when(base == "", path).otherwise(F.regexp_replace(F.substring(path, F.length(base) + 1, F.lit(1 << 20)), "^/+", ""))
    kind = (
        F.when(below.isin("action.yml", "action.yaml"), "action_yml")
        .when(path.endswith(".js") | path.endswith(".ts"), "javascript")
        .when(path.endswith(".py"), "python")
        .when((below == "Dockerfile") | path.endswith(".dockerfile"), "dockerfile")
    )
    return F.when(path.startswith(base), kind)


def source_units(refs: DataFrame, sources: DataFrame) -> DataFrame:
    """Scan units of the refs' sources: files below the subpath, metadata by its scripts."""
    wanted = refs.select("repo", "workflow", "line_number", "owner", "repo_name", "subpath", F.col("ref_string").alias("ref"))
    listed = sources.where("entry_type = 'blob'").select("owner", "repo_name", "ref", "path", "content")
    files = listed.join(wanted, ["owner", "repo_name", "ref"]).withColumn("kind", source_kind(F.col("path"), F.col("subpath"))).where("kind is not null")
    name = full_name(F.col("owner"), F.col("repo_name"), F.col("subpath"))
    labels = [F.concat(name, F.lit(" ("), F.col("path"), F.lit(")")).alias("source_file"), F.concat(name, F.lit("@"), short_ref(F.col("ref"))).alias("action")]
    place = [F.col("workflow").alias("workflow_file"), F.col("line_number").alias("workflow_line")]
    unit = F.concat_ws("#", "repo", "owner", "repo_name", "ref", "path")
    code = files.where("kind <> 'action_yml'").select("repo", unit.alias("unit_id"), F.col("kind").alias("lang"), *labels, F.lit(0).alias("ordinal"), F.lit(1).alias("base_line"), "content", *place)
    keys = files.where("kind = 'action_yml'").select("repo", "owner", "repo_name", "ref", "path", *labels, *place).distinct()
    scripts = composite_scripts(files.where("kind = 'action_yml'").select("owner", "repo_name", "ref", "path", "content").distinct())
    shell = scripts.join(keys, ["owner", "repo_name", "ref", "path"]).select("repo", F.concat_ws("#", unit, "ordinal").alias("unit_id"), F.lit("shell").alias("lang"), "source_file", "action", "ordinal", F.lit(0).alias("base_line"), "content", "workflow_file", "workflow_line")
    return code.unionByName(shell)


def audit(files: DataFrame, config: Config = Config(), audited: DataFrame | None = None, sources: DataFrame | None = None, cache: DataFrame | None = None, verbose: bool = True, parsed: DataFrame | None = None, strict_hosts: bool = False) -> Audit:
    """Findings and allowed matches of the run blocks and, given the snapshots, of the actions used.

    Without sources (no token) only run blocks are scanned. A file that isn't valid YAML fails the
    whole audit of its repository: the report's status is 2 and it has no findings. Files are parsed
    once and kept until the session's cache is cleared; give parsed to keep them otherwise.
    """
    parsed = parse_workflows(files).persist() if parsed is None else parsed
    broken = parsed.groupBy("repo").agg(F.max(~F.col("valid")).alias("broken"))
    options = options_of(config, True, strict_hosts)
    good = parsed.join(broken.where("not broken").select("repo"), "repo", "left_semi")
    found = scan(run_block_units(good), options).withColumn("origin", F.lit(0))
    spark = files.sparkSession
    refs = action_refs(good)
    if sources is not None:
        known = audited if audited is not None else spark.createDataFrame([], "owner string, repo_name string, sha string, tag string, layer string")
        refs = ref_status(refs, known, sources, config)
        remote = scan(source_units(refs.where("status in ('fresh', 'sliding', 'branch')"), sources), options).withColumn("origin", F.lit(1))
        hit = remote.where("reason is null").select("repo", F.col("workflow_file").alias("workflow"), F.col("workflow_line").alias("line_number")).distinct()
        clean = refs.where("status = 'fresh' and ref_type = 'sha'").join(hit, ["repo", "workflow", "line_number"], "left_anti").select("owner", "repo_name", F.col("ref_string").alias("sha"), F.coalesce("tag_comment", F.lit("")).alias("tag")).distinct()
        if cache is not None:
            clean = clean.join(cache, ["owner", "repo_name", "sha"], "left_anti")
        found = found.unionByName(remote)
    else:
        refs = refs.where(F.lit(False)).withColumn("status", F.lit(None).cast("string"))
        clean = refs.select("owner", "repo_name", F.col("ref_string").alias("sha"), F.col("tag_comment").alias("tag"))
    seq = F.struct("origin", "workflow_file", "workflow_line", "source_file", "ordinal", "place").alias("seq")
    kept = F.lit(True)
    for text in config.ignore_patterns:
        kept = kept & ~F.col("description").contains(text)
    findings = found.where("reason is null").where(kept).where(rank_of(F.col("severity")) >= severity_rank(config.severity))
    findings = findings.select("repo", "severity", "category", "action", "source_file", "line", "pattern_matched", "description", "workflow_file", "workflow_line", "rule_id", seq)
    allowed = found.where("reason is not null").select("repo", "severity", "category", "action", "source_file", "line", "pattern_matched", "reason", "rule_id", seq)
    report = audit_report(broken, findings, allowed, refs, sources is not None)
    return Audit(findings, allowed if verbose else allowed.where(F.lit(False)), refs, report, clean)


def in_report_order(findings: DataFrame) -> DataFrame:
    """High first, then medium, then the rest; in order of discovery within each."""
    return findings.orderBy("repo", F.desc(rank_of(F.col("severity"))), "seq")


COUNTERS = {"audited_bundled": "bundled", "audited_local_cache": "local cache", "audited_remote": "remote", "scanned_fresh": "fresh", "scanned_unpinned_sliding": "sliding", "scanned_unpinned_branch": "branch", "ignored": "ignored"}


def audit_report(repos: DataFrame, findings: DataFrame, allowed: DataFrame, refs: DataFrame, had_token: bool) -> DataFrame:
    """Counters of each repository, summary lines and exit status (0 clean, 1 findings, 2 error)."""
    by = refs.groupBy("repo").agg(F.count("status").alias("actions_scanned"), *[F.count_if(F.col("status") == s).alias(c) for c, s in COUNTERS.items()])
    severities = findings.groupBy("repo").agg(F.count("*").alias("n_findings"), *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("high", "medium", "low")])
    counts = allowed.groupBy("repo").agg(F.count("*").alias("n_allowed"))
    out = repos.join(by, "repo", "left").join(severities, "repo", "left").join(counts, "repo", "left")
    out = out.fillna(0, ["actions_scanned", *COUNTERS, "n_findings", "n_high", "n_medium", "n_low", "n_allowed"])
    status = F.when(F.col("broken"), 2).when(F.col("n_findings") > 0, 1).otherwise(0)
    return out.withColumn("had_token", F.lit(had_token)).withColumn("status", status).withColumn("summary", summary_lines()).drop("broken")


def _plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def summary_lines() -> Column:
    """Up to four lines, each only if its count isn't zero."""
    trusted = sum((F.col(c) for c in ("audited_local_cache", "audited_remote", "scanned_fresh")), F.col("audited_bundled"))
    names = {"audited_bundled": "bundled", "audited_local_cache": "local cache", "audited_remote": "remote", "scanned_fresh": "scanned fresh"}
    parts = F.array_join(F.filter(F.array(*[F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {n}"))) for c, n in names.items()]), lambda x: x.isNotNull()), ", ")
    every = F.array(
        F.when(trusted > 0, F.concat(F.lit("Audited "), _plural(trusted, "action"), F.lit(": "), parts, F.lit("."))),
        F.when(F.col("scanned_unpinned_sliding") > 0, F.concat(_plural(F.col("scanned_unpinned_sliding"), "sliding tag"), F.lit(" scanned; pin them to commits."))),
        F.when(F.col("scanned_unpinned_branch") > 0, F.concat(_plural(F.col("scanned_unpinned_branch"), "branch ref"), F.lit(" scanned; pin to a commit by hand."))),
        F.when(F.col("ignored") > 0, F.concat(_plural(F.col("ignored"), "action"), F.lit(" ignored by configuration."))),
    )
    return F.filter(every, lambda x: x.isNotNull())
