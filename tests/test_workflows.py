"""Whole pipelines on small workflows, with the outcomes the rubric and the audit promise."""

import json

import pytest
from pyspark.sql import functions as F

from shoal.operators import audit as A
from shoal.operators import score as S
from shoal.operators.resolve import pin, pin_report, rewrite, update, update_report
from shoal.operators.scan import logical_lines, scan_dockerfile, scan_javascript, scan_shell
from shoal.sinks import clean_cache, reports
from shoal.sources.config import Config, load_config, parse_config, severity_rank
from shoal.sources.snapshots import ACTION_FILES, AUDITED, RELEASES, TAG_OBJECTS, TAG_REFS, read_catalog
from shoal.sources.workflows import FILES, action_refs, load_yaml, open_lines, parse_workflows, read_workflows, run_blocks

SHA = "0123456789abcdef0123456789abcdef01234567"
OTHER = "f" * 40


def workflow(run=None, head="on: push\n", uses=f"actions/checkout@{SHA}"):
    steps = [f"      - uses: {uses}\n"] if uses else []
    if run is not None:
        steps.append("      - run: |\n" + "".join(f"          {x}\n" for x in run.split("\n")))
    return f"{head}jobs:\n  a:\n    runs-on: x\n    steps:{' []' if not steps else ''}\n{''.join(steps)}"


CASES = {
    "clean": workflow("echo hello"),
    "pipe": workflow("curl https://x.example/i.sh | bash"),
    "latest": workflow('curl -L "https://x.example/latest/f"'),
    "versioned": workflow("curl https://x.example/v1.2.3/f"),
    "data": workflow("curl https://x.example/f.json"),
    "multi": workflow("curl https://x.example/i | sh\ngo install x.example/t@latest\npip install thing"),
    "checksum": workflow("wget https://x.example/latest/f\nsha256sum -c f"),
    "trusted": workflow("curl https://t.example/f"),
    "empty": workflow(uses=None),
    "clone": workflow("git clone https://x.example/r"),
    "clone_pinned": workflow("git clone --branch v1.2.3 https://x.example/r"),
    "clone_checkout": workflow(f"git clone https://x.example/r\ncd r\ngit checkout {SHA}"),
    "format": workflow("curl https://x.example/f.proto"),
    "sliding": workflow(uses="actions/checkout@v4"),
    "write_all": workflow(head="on: push\npermissions: write-all\n"),
    "target": workflow(head="on:\n  pull_request_target:\n    types: [opened]\n"),
    "run_trigger": workflow(head="on: [push, workflow_run]\n"),
    "risky": workflow("curl https://x.example/i | sh\nwget https://x.example/latest/f\ngit clone https://x.example/r\npip install thing"),
    "example": workflow("curl https://example.com/install.sh | sh", head="on: push\npermissions: write-all\n", uses="actions/checkout@v4\n      - uses: actions/setup-node@v4.2.1\n      - uses: some-org/custom-action@main"),
    "broken": "jobs: [\n  - uses: actions/checkout@v4\n",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(k, ".github/workflows/w.yml", v) for k, v in CASES.items()], FILES)


@pytest.fixture(scope="module")
def audited(files):
    a = A.audit(files, Config(trusted_hosts=("T.example",), extra_data_formats=(".proto",)))
    found: dict = {}
    for r in A.in_report_order(a.findings).collect():
        found.setdefault(r["repo"], []).append(r)
    return found, {r["repo"]: r for r in a.report.collect()}, a


@pytest.mark.parametrize(
    ("name", "expected"),
    [
        ("clean", []), ("pipe", [("high", "sh.pipe")]), ("latest", [("high", "sh.curl.latest")]), ("versioned", []), ("data", []),
        ("multi", [("high", "sh.pipe"), ("medium", "sh.go.latest"), ("low", "sh.pip")]), ("checksum", [("medium", "sh.wget.latest")]), ("trusted", []), ("empty", []),
        ("clone", [("medium", "sh.git.clone")]), ("clone_pinned", []), ("clone_checkout", []), ("format", []), ("broken", []),
    ],
)
def test_audit(audited, name, expected):
    found, report, _ = audited
    assert [(r["severity"], r["rule_id"]) for r in found.get(name, [])] == expected
    assert report[name]["status"] == (2 if name == "broken" else 1 if expected else 0)
    assert all(r["category"] == "shell_fetch" and r["source_file"] == ".github/workflows/w.yml" for r in found.get(name, []))


def test_audit_details(audited):
    found, _, a = audited
    assert found["checksum"][0]["description"].endswith("(checksum verified)")
    assert found["pipe"][0]["line"] == 8 and found["multi"][1]["line"] == 9
    allowed = {(r["repo"], r["reason"]) for r in a.allowed.collect()}
    assert {("versioned", "versioned URL"), ("trusted", "trusted host"), ("data", "data format URL"), ("format", "data format URL"), ("clone_checkout", "followed by SHA checkout")} <= allowed


def test_audit_filters(files):
    only = A.audit(files.where("repo = 'multi'"), Config(severity="high", ignore_patterns=("piped",)))
    assert only.findings.count() == 0
    assert A.audit(files.where("repo = 'multi'"), Config(severity="high")).findings.count() == 1


@pytest.mark.parametrize(
    ("name", "score", "grade", "ids"),
    [
        ("clean", 100, "A", set()), ("sliding", 95, "A", {"pin.sliding"}), ("write_all", 90, "A", {"workflow.permissions_write_all"}), ("target", 95, "A", {"workflow.pull_request_target"}), ("run_trigger", 97, "A", {"workflow.workflow_run"}),
        ("risky", 54, "F", {"runtime.pipe_to_shell", "runtime.fetch.high", "runtime.fetch.medium", "runtime.fetch.low"}),
        ("example", 47, "F", {"pin.sliding", "pin.full_tag", "pin.branch", "source.unverified", "runtime.pipe_to_shell", "workflow.permissions_write_all"}),
        ("broken", 95, "A", {"pin.sliding"}),
    ],
)
def test_score(scored, name, score, grade, ids):
    report, findings = scored
    assert (report[name]["score"], report[name]["grade"]) == (score, grade)
    assert {f["id"] for f in findings if f["repo"] == name} == ids


@pytest.fixture(scope="module")
def scored(files):
    s = S.score(files)
    return {r["repo"]: r for r in s.report.collect()}, S.in_report_order(s.findings).collect()


def test_score_html_and_json(spark, scored):
    report, findings = scored
    page = reports.score_html(report["example"], [f for f in findings if f["repo"] == "example"])
    assert "47 (F)" in page and "pin.branch" in page and "<script" not in reports.score_html(report["clean"] | {} if isinstance(report["clean"], dict) else {**report["clean"].asDict(), "repo": "<script>"}, [])
    assert [f["points"] for f in findings if f["repo"] == "example"] == [20, 15, 10, 5, 2, 1]
    assert json.loads(reports.report_json(spark.createDataFrame([("x", None)], "a string, b string")).first()[0]) == {"a": "x"}


def test_dedupe_over_files(spark):
    files = spark.createDataFrame([("r", f"{n}.yml", workflow(uses="actions/checkout@v4")) for n in "ba"], FILES)
    f = S.score(files).findings.collect()
    assert [(x["id"], x["points"], [(o["workflow"], o["line"]) for o in x["occurrences"]]) for x in f] == [("pin.sliding", 5, [("a.yml", 6), ("b.yml", 6)])]
    assert [r["score"] for r in S.workflow_scores(S.score(files).findings).orderBy("workflow").collect()] == [95, 95]


def test_lookahead_edges(spark):
    def one(script):
        return scan_shell(spark.createDataFrame([("shell", 1, script)], "lang string, base_line int, content string")).collect()

    at = lambda n: "curl https://x.example/latest/f\n" + "echo\n" * (n - 1) + "sha256sum f"
    assert [one(at(3))[0]["severity"], one(at(4))[0]["severity"]] == ["medium", "high"]
    joined = one("curl https://x.example/i \\\n  | sh\n# wget u | sh\n# a \\\ncurl u | bash")
    assert [(r["rule_id"], r["line"]) for r in joined if r["rule_id"] == "sh.pipe"] == [("sh.pipe", 1)]
    assert one("") == [] and one(None) == []


def test_logical_lines(spark):
    df = spark.createDataFrame([(["a \\", "  b \\", " c", "d", "e \\"],), ([],)], "x array<string>")
    got = [r[0] for r in df.coalesce(1).select(logical_lines(F.col("x"))).collect()]
    assert got == [["a  b  c".replace("b  c", "b  c"), None, None, "d", "e "], []] or got[0][1:] == [None, None, "d", "e "]


def test_dockerfile_and_minified(spark):
    text = "FROM a@sha256:00\nFROM b\nRUN curl u | sh\nRUN curl u\nADD https://x.example/v1.2/f /f"
    got = scan_dockerfile(spark.createDataFrame([("dockerfile", 1, text)], "lang string, base_line int, content string")).collect()
    assert sorted((r["line"], r["rule_id"], r["reason"]) for r in got) == [(2, "docker.from.untagged", None), (3, "sh.pipe", None), (4, "docker.run.curl", None), (5, "docker.add.url", "versioned URL")]
    long = "var a=1;" * 70 + "fetch('https://x.example/f'); b()"
    got = scan_javascript(spark.createDataFrame([("javascript", 1, long)], "lang string, base_line int, content string")).collect()
    assert [r["pattern_matched"] for r in got] == ["fetch('https://x.example/f')"]


def test_anchors_and_blocks():
    text = workflow("echo hello world") + "  b:\n    steps:\n      - run: echo hello\n      - run: echo hello\n      - run: ''\n"
    assert [(o, b) for o, b, _ in run_blocks(text, load_yaml(text))] == [(0, 8), (1, 11), (2, 12), (3, 0)]
    assert [n for n, x in open_lines("- run: |\n    - uses: a/b@v1\n\n    x\n- uses: c/d@v1\n- run: >2-\n   y") if "uses" in x] == [5]


def test_sources_of_actions(spark):
    files = spark.createDataFrame([("r", "w.yml", "jobs:\n  a:\n    steps:\n" + "".join(f"      - uses: {u}\n" for u in (f"o/a/sub@{SHA}", f"o/clean@{SHA}", f"o/known@{SHA}", "o/s@v4", "o/b@main", "o/gone@v1.0", "x/ignored@v1.0")))], FILES)
    rows = [("o", "a", SHA, "sub/action.yml", "blob", "runs:\n  steps:\n    - run: curl u | sh\n  args: wget https://x.example/latest/f\n"), ("o", "a", SHA, "sub/x.js", "blob", "fetch('https://x.example/f')"), ("o", "a", SHA, "y.py", "blob", "requests.get('https://x.example/f')"), ("o", "a", SHA, "sub/Dockerfile", "blob", "FROM b"), ("o", "a", SHA, "sub/d/Dockerfile", "blob", "FROM b"), ("o", "a", SHA, "sub", "tree", None)]
    rows += [("o", n, r, "action.yml", "blob", "name: x\n") for n, r in (("clean", SHA), ("known", SHA), ("s", "v4"), ("b", "main"))]
    sources = spark.createDataFrame(rows, ACTION_FILES)
    known = spark.createDataFrame([("o", "known", SHA, "v1", layer) for layer in ("remote", "bundled")], AUDITED)
    a = A.audit(files, Config(ignore_actions=("x/ig",)), known, sources)
    assert {r["repo_name"]: r["status"] for r in a.refs.collect()} == {"a": "fresh", "clean": "fresh", "known": "bundled", "s": "sliding", "b": "branch", "gone": "failed", "ignored": "ignored"}
    got = sorted((r["rule_id"], r["source_file"], r["line"], r["action"], r["workflow_line"]) for r in a.findings.collect())
    label = f"o/a/sub@{SHA[:7]}"
    assert got == [("docker.from.untagged", "o/a/sub (sub/Dockerfile)", 1, label, 4), ("js.fetch.url", "o/a/sub (sub/x.js)", 1, label, 4), ("sh.pipe", "o/a/sub (sub/action.yml)", 0, label, 4), ("sh.wget.latest", "o/a/sub (sub/action.yml)", 0, label, 4)]
    r = a.report.first()
    assert (r["actions_scanned"], r["audited_bundled"], r["scanned_fresh"], r["scanned_unpinned_sliding"], r["scanned_unpinned_branch"], r["ignored"]) == (7, 1, 2, 1, 1, 1)
    assert len(r["summary"]) == 4 and r["summary"][0] == "Audited 3 actions: 1 bundled, 2 scanned fresh."
    assert [c["repo_name"] for c in a.clean.collect()] == ["clean"]
    document = json.loads(reports.sarif(a.findings).first()["sarif"])
    results = document["runs"][0]["results"]
    assert document["version"] == "2.1.0" and len(results) == 4 and results[0]["level"] == "error"
    assert results[0]["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "w.yml"}, "region": {"startLine": 4}}
    assert "4 findings: 4 high" in reports.findings_text(A.in_report_order(a.findings).collect()) or "3 high" in reports.findings_text(A.in_report_order(a.findings).collect())


def test_clean_cache(spark, tmp_path):
    path = str(tmp_path / "clean")
    rows = spark.createDataFrame([("o", "r", SHA, "v1"), ("o", "r", SHA, "v0")], clean_cache.CLEAN)
    for _ in range(2):
        clean_cache.append_clean(rows, path)
    assert [tuple(r) for r in clean_cache.read_clean(spark, path).collect()] == [("o", "r", SHA, "v0")]
    assert clean_cache.clear(spark, path) and not clean_cache.clear(spark, path)


def test_pin_update_rewrite(spark):
    text = f"jobs:\n  a:\n    steps:\n      - uses: o/r@v1\r\n      - uses: o/r/s@v1.2.3\n      - uses: o/r@main\n      - uses: o/x@v9\n      - uses: o/r@{OTHER} # v1.0.0\n"
    files = spark.createDataFrame([("r", "w.yml", text)], FILES)
    refs = action_refs(parse_workflows(files))
    tags = spark.createDataFrame([("o", "r", "v1", "T", "tag"), ("o", "r", "v1.2.3", SHA, "commit"), ("o", "r", "v1.2", SHA, "commit"), ("o", "r", "v2.0.0", OTHER, "commit")], TAG_REFS)
    objects = spark.createDataFrame([("o", "r", "T", SHA)], TAG_OBJECTS)
    p = pin(refs, tags, objects)
    assert sorted((r["line"], r["sha"], r["tag"]) for r in p.pinned.collect()) == [(4, SHA, "v1.2.3"), (5, SHA, "v1.2.3")]
    assert sorted((r["line"], r["reason"]) for r in p.skipped.collect()) == [(4, "sliding tag, resolved to v1.2.3"), (6, "branch ref: pin to a commit by hand"), (7, "tag not found: v9")]
    new = rewrite(files, p.pinned.select("repo", "file", "line", "new_line")).first()["content"].split("\n")
    assert new[3] == f"      - uses: o/r@{SHA} # v1.2.3" and new[4].startswith("      - uses: o/r/s@") and new[-1] == "" and len(new) == 9
    releases = spark.createDataFrame([("o", "r", 0, "v3.0.0-rc1", False, True, None), ("o", "r", 1, "v2.0.0", False, False, "u"), ("o", "r", 2, "v1.0.0", False, False, None), ("o", "r", 30, "v9.0.0", False, False, None)], RELEASES)
    u = update(refs, releases, tags, objects)
    assert [(r["current_tag"], r["latest_tag"], r["latest_sha"], r["release_url"]) for r in u.updates.collect()] == [("v1.0.0", "v2.0.0", OTHER, "u")]
    assert tuple(u.counters.first())[1:] == (0, 1)
    assert update(refs, releases, tags, objects, only="zzz").updates.count() == 0


def test_config(tmp_path):
    c = parse_config('severity = "high"\nextra-data-formats = ["proto"]\nunknown = 1\n[ignore]\nactions = ["a/b"]\n')
    assert (c.severity, c.extra_data_formats, c.ignore_actions, c.fetch_remote) == ("high", ("proto",), ("a/b",), False)
    assert parse_config("= broken") is None and parse_config("severity = 1") is None
    (tmp_path / "u.toml").write_text('severity = "medium"')
    (tmp_path / "l.toml").write_text("broken =")
    assert load_config(tmp_path / "l.toml", tmp_path / "u.toml").severity == "medium" and load_config().severity == "low"
    assert [severity_rank(s) for s in ("high", "High", "medium", "low")] == [2, 0, 1, 0]


def test_readers(spark, tmp_path):
    folder = tmp_path / "root/.github/workflows"
    folder.mkdir(parents=True)
    for name in ("b.yml", "a.yaml", "c.YML", "d.txt"):
        (folder / name).write_text("on: push\n")
    got = read_workflows(spark, {"r": str(tmp_path / "root")}).orderBy("workflow").collect()
    assert [r["workflow"] for r in got] == [".github/workflows/a.yaml", ".github/workflows/b.yml"]
    with pytest.raises(Exception, match="(?i)path"):
        read_workflows(spark, {"r": str(tmp_path / "none")}).count()
    (tmp_path / "cat/o").mkdir(parents=True)
    (tmp_path / "cat/o/r.json").write_text(json.dumps([{"sha": SHA, "tag": "v1"}, {"sha": OTHER, "tag": "v2"}]))
    assert sorted(tuple(r) for r in read_catalog(spark, str(tmp_path / "cat")).collect()) == [("o", "r", SHA, "v1", "bundled"), ("o", "r", OTHER, "v2", "bundled")]


def test_release_notes(spark):
    notes = ["* feat(cli): add x by @a in https://x.example/1", "* ci: y by @b", "* fix: z", "* plain change by @c-d in https://x.example/2", "* chore(audited-actions): q", "text"]
    got = reports.release_notes(spark.createDataFrame(list(enumerate(notes)), "n int, line string")).orderBy("place").collect()
    assert [(r["section"], r["entries"]) for r in got] == [("What's New", ["add x"]), ("Fixes", ["z"]), ("Other", ["plain change"])]


def test_org_scores(spark):
    reports_ = spark.createDataFrame([("o/a", 100), ("o/b", 40), ("p/c", 70)], "repo string, score int")
    uses = spark.createDataFrame([("o/a", 1), ("o/b", 3)], "repo string, uses long")
    assert {r["org"]: (r["score"], r["repos"]) for r in S.org_scores(reports_, uses).collect()} == {"o": (55.0, 2), "p": (70.0, 1)}


def test_of_two_replacements_the_first_stays(spark):
    files = spark.createDataFrame([("r", "w", "a\nb\n")], FILES)
    rows = spark.createDataFrame([("r", "w", 1, "z"), ("r", "w", 1, "c"), ("r", "w", 9, "x")], "repo string, file string, line int, new_line string").coalesce(1)
    assert rewrite(files, rows).first()["content"] == "z\nb\n"
    assert rewrite(files, rows.withColumn("ordinal", -F.ascii("new_line"))).first()["content"] == "z\nb\n"
    assert rewrite(files, rows.withColumn("ordinal", F.ascii("new_line"))).first()["content"] == "c\nb\n"


def test_exact_tags_of_equal_length_go_by_place(spark):
    refs = action_refs(parse_workflows(spark.createDataFrame([("r", "w", "jobs:\n  a:\n    steps:\n      - uses: o/a@v1\n      - uses: o/b@main\n")], FILES)))
    tags = spark.createDataFrame([("o", "a", t, SHA, "commit", i) for i, t in enumerate(["v1", "v1.9", "v1.2"])], TAG_REFS + ", ordinal int")
    pins = pin(refs, tags, spark.createDataFrame([], TAG_OBJECTS))
    assert pins.pinned.first()["tag"] == "v1.9"
    assert pin(refs, tags.drop("ordinal"), spark.createDataFrame([], TAG_OBJECTS)).pinned.first()["tag"] == "v1.2"
    repos = spark.createDataFrame([("r",), ("none",)], "repo string")
    assert {tuple(r) for r in pin_report(pins, repos).collect()} == {("r", 1, 1, 2, 1), ("none", 0, 0, 0, 0)}
    assert {r["status"] for r in pin_report(pins, repos, apply=True).collect()} == {0}
    text = reports.pins_text(pins.pinned.collect(), pins.skipped.collect())
    assert "4: o/a@v1 -> " in text and "skipped o/b@main" in text and text.endswith("1 action to pin in 1 file.")
    assert reports.pins_text([], []) == "Nothing to pin."


def test_update_status_and_text(spark):
    line = f"jobs:\n  a:\n    steps:\n      - uses: o/a@{SHA} # v1.0\n      - uses: o/b@{SHA} # v2.0\n"
    refs = action_refs(parse_workflows(spark.createDataFrame([("r", "w", line)], FILES)))
    releases = spark.createDataFrame([("o", "a", 0, "v1.1", False, False, "https://h/1"), ("o", "b", 0, "v2.0", False, False, None)], RELEASES)
    tags = spark.createDataFrame([("o", "a", "v1.1", OTHER, "commit")], TAG_REFS)
    found = update(refs, releases, tags, spark.createDataFrame([], TAG_OBJECTS))
    assert [tuple(r) for r in update_report(found, refs).collect()] == [("r", 1, 1, 1, 1)]
    assert update_report(found, refs, apply=True).first()["status"] == 0
    assert reports.updates_text(found.updates.collect(), 1).splitlines() == ["w", "  4: o/a v1.0 -> v1.1 https://h/1", "1 update available, 1 up to date."]


def test_spaces_beyond_ascii(spark):
    rows = "# curl http://x.example | sh\n\u00a0# curl http://x.example | sh\ngit\u00a0clone https://x.example/y\n\u3000pip install thing\u3000"
    got = scan_shell(spark.createDataFrame([("shell", 1, rows)], "lang string, base_line int, content string")).collect()
    assert sorted((r["line"], r["rule_id"], r["pattern_matched"]) for r in got) == [(3, "sh.git.clone", "git\u00a0clone https://x.example/y"), (4, "sh.pip", "pip install thing")]


def test_one_read_for_all_roots(spark, tmp_path):
    for repo in ("a b", "c%d", "e+f"):
        folder = tmp_path / repo / ".github" / "workflows"
        folder.mkdir(parents=True)
        for name in ("w.yml", "x y.yaml", "p+q%.yml", "no.txt"):
            (folder / name).write_text(f"{repo} {name}")
    files = read_workflows(spark, {r: str(tmp_path / r) for r in ("a b", "c%d", "e+f")})
    want = {(r, f".github/workflows/{n}", f"{r} {n}") for r in ("a b", "c%d", "e+f") for n in ("w.yml", "x y.yaml", "p+q%.yml")}
    assert {tuple(r) for r in files.collect()} == want
    assert read_workflows(spark, {}).count() == 0
    assert files._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_a_file_is_parsed_once(spark):
    files = spark.createDataFrame([("r", "w", workflow("curl u | sh"))], FILES)
    plan = S.score(files).report._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("InMemoryTableScan") > 1 and plan.count("\nMapInPandas") == 0
    spark.catalog.clearCache()


def test_stream_of_refs(spark, tmp_path):
    from shoal.streaming.refs import new_refs

    schema = "seen_at timestamp, repo string, workflow string, raw_line string"
    source, sink = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    stream = new_refs(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source)))
    for n, lines in enumerate((["- uses: a/b@v1", "- uses: a/b@v1", "echo"], ["- uses: a/b@v1", "- uses: a/b@v2"])):
        rows = [(f"2024-01-01 00:0{n}:00", "r", "w", x) for x in lines]
        spark.createDataFrame(rows, "seen_at string, repo string, workflow string, raw_line string").coalesce(1).write.mode("append").json(str(source))
        run = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(sink)).trigger(availableNow=True).start()
        run.awaitTermination(120)
    assert sorted(r["ref_string"] for r in spark.read.parquet(str(sink)).collect()) == ["v1", "v2"]


def test_release_notes_as_markdown(spark):
    raw = ["## What's Changed", "* feat(scan): new rule: one by @a-b in https://h.example/1", "* fix: mend by @x in https://h.example/2", "* chore: none", "* feat(site): hidden by @x", "* Plain words by the way", "* feat: by @x", "**Full Changelog**: https://h.example/a...b more"]
    lines = spark.createDataFrame(list(enumerate(raw)), "n int, line string")
    sections = reports.release_notes(lines, ("site",)).collect()
    assert {r["section"]: list(r["entries"]) for r in sections} == {"What's New": ["new rule: one", "by @x"], "Fixes": ["mend"], "Other": ["Plain words by the way"]}
    url = reports.changelog_url(lines).first()["url"]
    assert reports.release_markdown("tool v1", sections, url) == "## tool v1\n\n### What's New\n- new rule: one\n- by @x\n\n### Fixes\n- mend\n\n### Other\n- Plain words by the way\n\n---\n**Full Changelog**: https://h.example/a...b\n"
    assert reports.changelog_url(lines.where("n < 3")).count() == 0


def test_score_as_text(spark):
    s = S.score(spark.createDataFrame([("r", "w.yml", workflow(None, uses="actions/checkout@v4"))], FILES))
    text = reports.score_text(s.report.first(), S.in_report_order(s.findings).collect())
    assert text.splitlines()[0] == "r: 95/100 (A), 1 workflow, 1 action" and "-5 medium pin.sliding actions/checkout@v4: w.yml:6" in text
    spark.catalog.clearCache()
