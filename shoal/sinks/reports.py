"""Renderings of findings and scores."""

from __future__ import annotations

import html
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The schema's version and address, the categories that are rules there.
SARIF_VERSION, SARIF_SCHEMA = "2.1.0", "https://json.schemastore.org/sarif-2.1.0.json"
TOOL, TOOL_URI = "shoal", "https://example.org/shoal"
SARIF_RULES = {
    "docker_unpinned": "Image or download in a Dockerfile without a fixed version",
    "javascript_fetch": "Download from JavaScript or TypeScript without a fixed version",
    "python_fetch": "Download from Python without a fixed version",
    "shell_fetch": "Download from a shell script without a fixed version",
}


def report_json(df: DataFrame) -> DataFrame:
    """One JSON document per row; nulls are left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def sarif_level(severity: Column) -> Column:
    return F.when(severity == "high", "error").when(severity == "medium", "warning").otherwise("note")


def sarif_results(findings: DataFrame) -> DataFrame:
    """One result per finding, at the workflow line that uses the action, else at the source's own line."""
    remote = F.col("workflow_file").isNotNull() & F.col("workflow_line").isNotNull()
    uri = F.when(remote, F.col("workflow_file")).otherwise(F.col("source_file"))
    line = F.greatest(F.lit(1), F.when(remote, F.col("workflow_line")).otherwise(F.coalesce("line", F.lit(1))))
    text = F.concat(F.col("description"), F.when(F.col("workflow_file").isNotNull(), F.concat(F.lit(" (in "), F.col("source_file"), F.lit(")"))).otherwise(""))
    location = F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), F.struct(line.alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.concat(F.lit(f"{TOOL}/"), F.col("category")).alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(text.alias("text")).alias("message"), F.array(location).alias("locations"))
    return findings.select("repo", "severity", "seq", result.alias("result"))


def sarif(findings: DataFrame) -> DataFrame:
    """(repo, sarif): one document per repository, results in report order."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    ordered = sarif_results(findings).select("repo", F.struct(rank.alias("rank"), "seq", "result").alias("r")).groupBy("repo").agg(F.array_sort(F.collect_list("r")).alias("r"))
    rules = F.array(*[F.struct(F.lit(f"{TOOL}/{c}").alias("id"), F.lit(c).alias("name"), F.struct(F.lit(t).alias("text")).alias("shortDescription"), F.struct(F.lit(t).alias("text")).alias("fullDescription"), F.lit(TOOL_URI).alias("helpUri"), F.struct(F.lit("warning").alias("level")).alias("defaultConfiguration")) for c, t in SARIF_RULES.items()])
    driver = F.struct(F.lit(TOOL).alias("name"), F.lit("0.1.0").alias("version"), F.lit(TOOL_URI).alias("informationUri"), rules.alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.transform("r", lambda x: x["result"]).alias("results"))
    document = F.struct(F.lit(SARIF_SCHEMA).alias("$schema"), F.lit(SARIF_VERSION).alias("version"), F.array(run).alias("runs"))
    return ordered.select("repo", F.to_json(document).alias("sarif"))


def score_html(report: Any, findings: list[Any]) -> str:
    """A self-contained page for one repository's score. Line numbers are shown where they are known."""
    e = lambda x: html.escape(str(x), quote=True)
    rows = []
    for f in findings:
        places = "".join(f"<li>{e(o['workflow'])}{':' + str(o['line']) if o['line'] else ''}</li>" for o in f["occurrences"])
        rows.append(f"<tr class='{e(f['severity'])}'><td>{e(f['points'])}</td><td>{e(f['id'])}</td><td>{e(f['action_ref'] or '')}</td><td><ul>{places}</ul></td><td>{e(f['remediation'])}</td></tr>")
    table = f"<table><tr><th>Points</th><th>Rule</th><th>Action</th><th>Where</th><th>What to do</th></tr>{''.join(rows)}</table>" if rows else "<p>Nothing found.</p>"
    style = "body{font:16px sans-serif;margin:2em}td,th{text-align:left;vertical-align:top;padding:.3em 1em .3em 0}.high td:first-child{color:#b00}"
    return f"<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>{e(report['repo'])}</title><style>{style}</style></head><body><h1>{e(report['repo'])}: {e(report['score'])} ({e(report['grade'])})</h1><p>{e(report['points_deducted'])} points off, rubric {e(report['rubric_version'])}</p>{table}</body></html>"


def findings_text(findings: list[Any]) -> str:
    """Findings grouped by file, and their number by severity."""
    out = []
    for name, rows in _by(findings, "source_file").items():
        out += [name, *(f"  {r['line'] or '-'}: {r['severity']}: {r['description']}: {r['pattern_matched']}" for r in rows)]
    n = {s: sum(f["severity"] == s for f in findings) for s in ("high", "medium", "low")}
    out.append("No findings." if not findings else f"{len(findings)} finding{'s' * (len(findings) != 1)}: " + ", ".join(f"{v} {k}" for k, v in n.items() if v))
    return "\n".join(out)


def pins_text(pinned: list[Any], skipped: list[Any], apply: bool = False) -> str:
    """Pinned lines grouped by file, then what was skipped and why, then the numbers."""
    out = []
    for name, rows in _by(pinned, "file").items():
        out += [name, *(f"  {r['line']}: {r['action']}@{r['old_ref']} -> {r['sha']} # {r['tag']}" for r in rows)]
    out += [f"skipped {r['action']} ({r['file']}:{r['line']}): {r['reason']}" for r in skipped]
    out.append("Nothing to pin." if not pinned else f"{_count(len(pinned), 'action')} {'pinned' if apply else 'to pin'} in {_count(len(_by(pinned, 'file')), 'file')}.")
    return "\n".join(out)


def updates_text(updates: list[Any], up_to_date: int, apply: bool = False) -> str:
    """Updates grouped by file with the release's address, then the numbers."""
    out = []
    for name, rows in _by(updates, "file").items():
        out += [name, *(f"  {r['line']}: {r['action']} {r['current_tag']} -> {r['latest_tag']}{' ' + r['release_url'] if r['release_url'] else ''}" for r in rows)]
    out.append(f"{_count(len(updates), 'update')} {'applied' if apply else 'available'}, {up_to_date} up to date." if updates else f"All {up_to_date} up to date.")
    return "\n".join(out)


def score_text(report: Any, findings: list[Any]) -> str:
    """The score, then each finding with points, rule, action, places and remedy."""
    out = [f"{report['repo']}: {report['score']}/100 ({report['grade']}), {_count(report['workflows_scanned'], 'workflow')}, {_count(report['unique_actions'], 'action')}"]
    for f in findings:
        places = ", ".join(o["workflow"] + (f":{o['line']}" if o["line"] else "") for o in f["occurrences"])
        out += [f"  -{f['points']} {f['severity']} {f['id']}{' ' + f['action_ref'] if f['action_ref'] else ''}: {places}", f"    {f['remediation']}"]
    if not findings:
        out.append("  Nothing found.")
    return "\n".join(out)


def _by(rows: list[Any], key: str) -> dict[str, list[Any]]:
    out: dict[str, list[Any]] = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


def _count(n: int, word: str) -> str:
    return f"{n} {word}{'' if n == 1 else 's'}"


# Headings of change types in their order, and the types left out.
SECTIONS = {"feat": "What's New", "fix": "Fixes", "perf": "Performance", "refactor": "Under the Hood", "docs": "Documentation"}
OTHER, LEFT_OUT_TYPES = "Other", ("build", "ci", "chore")
CHANGELOG = "**Full Changelog**:"


def release_notes(lines: DataFrame, left_out_scopes: tuple[str, ...] = ()) -> DataFrame:
    """(section, place, entries) from lines (n, line) of generated notes: starred items by the type before
    their colon, `type: text` or `type(scope): text`, without the author and address at their ends."""
    item = F.regexp_replace("line", r"^\s+|\s+$", "")
    text = F.regexp_replace(item, r"^\*\s+", "")
    typed = r"^[a-z]+(\([^)]*\))?:\s*\S"
    head = F.when(text.rlike(typed), F.substring_index(text, ":", 1))
    head = F.when(text.rlike(r"^[a-z]+\([^)]*\):"), F.concat(F.substring_index(text, "):", 1), F.lit(")"))).otherwise(head)
    kind, scope = F.coalesce(F.substring_index(head, "(", 1), F.lit("")), F.coalesce(F.regexp_replace(F.when(head.contains("("), F.substring(head, F.locate("(", head) + 1, F.length(head))), r"\)$", ""), F.lit(""))
    entry = F.regexp_replace(F.when(head.isNull(), text).otherwise(F.substring(text, F.length(head) + 2, F.length(text))), r"^\s+", "")
    entry = F.regexp_replace(F.regexp_replace(entry, r"(?<=\S)\s+in\s+https?://\S+$", ""), r"(?<=\S)\s+by\s+@[\w-]+$", "")
    names = F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair])
    order = F.create_map(*[F.lit(x) for i, s in enumerate([*SECTIONS.values(), OTHER]) for x in (s, i)])
    rows = lines.where(item.rlike(r"^\*\s+\S")).select("n", kind.alias("kind"), scope.alias("scope"), entry.alias("entry"))
    rows = rows.where(~F.col("kind").isin(*LEFT_OUT_TYPES) & ~F.col("scope").isin(*left_out_scopes))
    rows = rows.select("n", F.coalesce(F.try_element_at(names, F.col("kind")), F.lit(OTHER)).alias("section"), "entry")
    grouped = rows.groupBy("section").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "entry"))), lambda x: x["entry"]).alias("entries"))
    return grouped.select("section", F.element_at(order, F.col("section")).alias("place"), "entries")


def changelog_url(lines: DataFrame) -> DataFrame:
    """(url) of the last changelog line of generated notes, one row or none."""
    text = F.regexp_replace("line", r"^\s+|\s+$", "")
    url = F.regexp_extract(F.substring(text, len(CHANGELOG) + 1, 1 << 20), r"^\s*(https?://\S+)", 1)
    found = lines.where(text.startswith(CHANGELOG)).select("n", url.alias("url")).where("url <> ''")
    return found.agg(F.max_by("url", "n").alias("url")).where("url is not null")


def release_markdown(title: str, sections: list[Any], url: str | None = None) -> str:
    """Markdown of the collected sections, in their order, with the changelog's address at the end."""
    out = [f"## {title}", ""]
    for s in sorted(sections, key=lambda s: s["place"]):
        out += [f"### {s['section']}", *(f"- {e}" for e in s["entries"]), ""]
    return "\n".join([*out, *(["---", f"{CHANGELOG} {url}", ""] if url else [])])
