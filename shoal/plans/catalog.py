"""The registered queries of the posture engine and their DuckDB SQL.

The tables at hand hold no workflows, so each query derives its corpus from their keys, in the same
way on both sides, over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoal.functions.refs import classify_ref, parse_uses, pinned_line
from shoal.functions.text import is_comment, split_lines
from shoal.functions.urls import disposition, first_url, has_version, is_data_format, is_trusted_host, url_extension, url_host
from shoal.functions.versions import is_newer, is_release_tag, version_key
from shoal.operators import rules
from shoal.operators.resolve import latest_releases, pin, pin_report, rewrite, update, update_report
from shoal.operators.scan import LINE_END, lines_of, scan, scan_dockerfile, scan_javascript, scan_python, scan_shell
from shoal.operators.score import SCORE_RULES, grade_of, score_of, with_metadata
from shoal.sources.snapshots import TAG_OBJECTS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ref_string(k: Column) -> Column:
    """A branch, sliding tag, tag or commit by the key's remainder."""
    return F.when(k % 4 == 0, "main").when(k % 4 == 1, F.concat(F.lit("v"), (k % 9).cast("string"))).when(k % 4 == 2, F.concat(F.lit("v"), (k % 9).cast("string"), F.lit("."), (k % 13).cast("string"), F.lit(".0"))).otherwise(F.sha1(k.cast("string").cast("binary")))


REF_SQL = "case when {k} % 4 = 0 then 'main' when {k} % 4 = 1 then concat('v', {k} % 9) when {k} % 4 = 2 then concat('v', {k} % 9, '.', {k} % 13, '.0') else sha1(cast({k} as varchar)) end"
TYPE_SQL = "case when regexp_matches(r, '^[0-9a-fA-F]{40}$') then 'sha' when regexp_matches(r, '^v?[0-9.]*[.][0-9.]*$') then 'tag' when regexp_matches(r, '^v?[0-9]+$') then 'sliding' else 'branch' end"


def uses_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A `uses:` line for each row of lineitem: its part is the action, its supplier the repository."""
    k = F.col("l_partkey")
    owner = F.when(k % 5 == 0, "actions").otherwise(F.concat(F.lit("org"), (k % 7).cast("string")))
    sub = F.when(k % 6 == 0, "/sub/dir").otherwise("")
    line = F.concat(F.lit("      - uses: "), owner, F.lit("/action"), (k % 50).cast("string"), sub, F.lit("@"), ref_string(k), F.when(k % 3 == 0, " # v1.0.0").otherwise(""))
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("repo"), (F.col("l_orderkey") % 40).alias("workflow"), F.col("l_linenumber").alias("line"), line.alias("raw_line"))


USES_SQL = f"""select l_suppkey as repo, l_orderkey % 40 as workflow, l_linenumber as line, case when l_partkey % 5 = 0 then 'actions' else concat('org', l_partkey % 7) end as owner,
  concat('action', l_partkey % 50) as repo_name, case when l_partkey % 6 = 0 then 'sub/dir' end as subpath, {REF_SQL.format(k="l_partkey")} as r, case when l_partkey % 3 = 0 then 'v1.0.0' end as tag_comment from lineitem"""


@query("ref_classify", f"with u as ({USES_SQL}) select owner, repo_name, subpath, r as ref_string, {TYPE_SQL} as ref_type, tag_comment, count(*) as n from u group by all")
def ref_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = uses_lines(spark, sf_dir).select(parse_uses(F.col("raw_line")).alias("u")).where("u is not null").select("u.*")
    return rows.groupBy("owner", "repo_name", "subpath", "ref_string", "ref_type", "tag_comment").agg(F.count("*").alias("n"))


@query("pin_lines", f"with u as ({USES_SQL}) select concat('      - uses: ', owner, '/', repo_name, coalesce('/' || subpath, ''), '@', sha1(r), ' # ', r) as new_line, count(*) as n from u group by all")
def pin_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = uses_lines(spark, sf_dir)
    ref = parse_uses(F.col("raw_line"))["ref_string"]
    return rows.select(pinned_line(F.col("raw_line"), F.sha1(ref.cast("binary")), ref).alias("new_line")).groupBy("new_line").agg(F.count("*").alias("n"))


@query("ref_dedupe", f"""with u as ({USES_SQL}) select repo, concat_ws('/', owner, repo_name, subpath) || '@' || r as action_ref, string_agg(concat(workflow, ':', line), ',' order by workflow, line) as occurrences, count(*) as n from u group by all""")
def ref_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = uses_lines(spark, sf_dir).withColumn("u", parse_uses(F.col("raw_line")))
    ref = F.concat(F.concat_ws("/", "u.owner", "u.repo_name", "u.subpath"), F.lit("@"), F.col("u.ref_string")).alias("action_ref")
    out = rows.select("repo", ref, F.struct("workflow", "line").alias("o")).groupBy("repo", "action_ref").agg(F.array_sort(F.collect_list("o")).alias("o"))
    return out.select("repo", "action_ref", F.array_join(F.transform("o", lambda x: F.concat(x["workflow"].cast("string"), F.lit(":"), x["line"].cast("string"))), ",").alias("occurrences"), F.size("o").cast("long").alias("n"))


def pin_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pin and source findings of derived repositories: a hundred per part, so that scores spread."""
    rows = uses_lines(spark, sf_dir).withColumn("repo", F.col("repo") * 40 + F.col("workflow")).withColumn("u", parse_uses(F.col("raw_line"))).select("repo", "u.*")
    ids = F.array(F.when(F.col("ref_type") == "branch", "pin.branch").when(F.col("ref_type") == "sliding", "pin.sliding").when(F.col("ref_type") == "tag", "pin.full_tag"), F.when(F.col("owner") != "actions", "source.unverified"))
    ref = F.concat(F.concat_ws("/", "owner", "repo_name", "subpath"), F.lit("@"), F.col("ref_string")).alias("action_ref")
    return with_metadata(rows.select("repo", ref, F.explode(F.filter(ids, lambda x: x.isNotNull())).alias("id")).distinct())


@query("repo_score", f"""with u as ({USES_SQL}), t as (select repo * 40 + workflow as repo, owner, concat_ws('/', owner, repo_name, subpath) || '@' || r as a, {TYPE_SQL} as ty from u),
f as (select distinct repo, a, case ty when 'branch' then 15 when 'sliding' then 5 else 2 end as p, ty as k from t where ty <> 'sha' union select distinct repo, a, 1, 'source' from t where owner <> 'actions'),
s as (select repo, sum(p) as points_deducted, count(*) as findings from f group by repo)
select repo, cast(points_deducted as bigint) as points_deducted, findings, cast(greatest(0, 100 - points_deducted) as integer) as score,
  case when 100 - points_deducted >= 90 then 'A' when 100 - points_deducted >= 80 then 'B' when 100 - points_deducted >= 70 then 'C' when 100 - points_deducted >= 60 then 'D' else 'F' end as grade from s""")
def repo_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = pin_findings(spark, sf_dir).groupBy("repo").agg(F.sum("points").alias("points_deducted"), F.count("*").alias("findings"))
    score = score_of(F.col("points_deducted"))
    return sums.select("repo", "points_deducted", "findings", score.alias("score"), grade_of(score).alias("grade"))


@query("rule_metadata", "select * from (values " + ", ".join(f"('{r.id}', '{r.category}', '{r.severity}', {r.points})" for r in SCORE_RULES) + ") t(id, category, severity, points)")
def rule_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_metadata(spark.createDataFrame([(r.id,) for r in SCORE_RULES], "id string")).select("id", "category", "severity", "points")


URLS_SQL = "select page_id, concat('x ', regexp_replace(url, '[?#].*$', ''), case page_id % 5 when 0 then '/v1.2.3/f' when 1 then '/latest/f' when 2 then '/d/data.JSON' when 3 then '?a=1#b' else '' end, ' y') as line from pages"


def url_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line around each page's url, with a version, `latest`, data file, query or nothing after it."""
    k = F.col("page_id") % 5
    tail = F.when(k == 0, "/v1.2.3/f").when(k == 1, "/latest/f").when(k == 2, "/d/data.JSON").when(k == 3, "?a=1#b").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("x "), F.regexp_replace("url", "[?#].*$", ""), tail, F.lit(" y")).alias("line"))


EXTRACT_SQL = "regexp_extract(line, 'https?://[^\\s\"''`)>]+')"
HOST_SQL = "regexp_extract(u, '^https?://(?:[^@]*@)?([^/:?#]*)', 1)"
LAST_SQL = "string_split(regexp_extract(u, '^[^?#]*'), '/')[-1]"
EXT_SQL = f"case when contains({LAST_SQL}, '.') then regexp_extract({LAST_SQL}, '[^.]*$') end"


@query("url_host_ext", f"with l as ({URLS_SQL}), x as (select page_id, {EXTRACT_SQL} as u from l) select page_id, u as url, {HOST_SQL} as host, {EXT_SQL} as extension, regexp_matches(u, '[/=]v?[0-9]+([.][0-9]+)+[/\\s\"]') as versioned from x")
def url_host_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = first_url(F.col("line"))
    return url_lines(spark, sf_dir).select("page_id", u.alias("url")).select("page_id", "url", url_host(F.col("url")).alias("host"), url_extension(F.col("url")).alias("extension"), has_version(F.col("url")).alias("versioned"))


HOSTS = ("spam-farm.example.org", "WWW.cheap-pills.example.com")


@query("url_disposition", f"""with l as ({URLS_SQL}), x as (select page_id, {EXTRACT_SQL} as u from l)
select page_id, case when regexp_matches(u, '[/=]v?[0-9]+([.][0-9]+)+[/\\s\"]') then 'versioned URL' when lower({HOST_SQL}) in ('spam-farm.example.org', 'www.cheap-pills.example.com') then 'trusted host'
  when lower({EXT_SQL}) in ('json','jsonl','ndjson','yaml','yml','toml','xml','csv','tsv','txt','md','rst','proto') then 'data format URL' end as reason from x""")
def url_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lines(spark, sf_dir).select("page_id", disposition(first_url(F.col("line")), HOSTS, (".proto",)).alias("reason"))


@query("trusted_host", f"with l as ({URLS_SQL}), x as (select {EXTRACT_SQL} as u from l) select {HOST_SQL} as host, lower({HOST_SQL}) in ('spam-farm.example.org', 'www.cheap-pills.example.com') as trusted, count(*) as n from x group by all")
def trusted_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = first_url(F.col("line"))
    return url_lines(spark, sf_dir).select(url_host(u).alias("host"), is_trusted_host(u, HOSTS).alias("trusted")).groupBy("host", "trusted").agg(F.count("*").alias("n"))


@query("data_formats", f"with l as ({URLS_SQL}), x as (select {EXTRACT_SQL} as u from l) select coalesce(lower({EXT_SQL}) in ('json','jsonl','ndjson','yaml','yml','toml','xml','csv','tsv','txt','md','rst'), false) as data, count(*) as n from x group by all")
def data_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lines(spark, sf_dir).select(is_data_format(first_url(F.col("line"))).alias("data")).groupBy("data").agg(F.count("*").alias("n"))


def shell_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script of six lines for each page: a fetch by key, a comment, a pipe over two lines, a checksum."""
    k = F.col("page_id")
    fetch = F.when(k % 3 == 0, F.concat(F.lit("curl -o f "), F.col("u"))).when(k % 3 == 1, F.concat(F.lit('wget "'), F.col("u"), F.lit('/latest/f"'))).otherwise(F.concat(F.lit("curl "), F.col("u"), F.lit("/v1.2.3/f")))
    check = F.when(k % 2 == 0, "sha256sum -c f").otherwise("echo ok")
    pipe = F.when(k % 4 == 0, F.concat(F.lit("curl "), F.col("u"), F.lit(" \\\n  | sh"))).otherwise("echo a \\\n  b")
    script = F.concat_ws("\n", F.lit("# curl http://a.example/x | sh"), fetch, check, pipe, F.when(k % 5 == 0, "pip install thing").otherwise("pip install thing==1.0"))
    url = F.regexp_replace("url", "[?#].*$", "")
    return table(spark, sf_dir, "pages").withColumn("u", url).select("page_id", F.col("page_id").cast("string").alias("unit_id"), F.lit("shell").alias("lang"), F.lit(10).alias("base_line"), F.lit("s").alias("source_file"), F.lit("").alias("action"), F.lit(0).alias("ordinal"), script.alias("content"))


@query("shell_scan", """with p as (select page_id as k, regexp_replace(url, '[?#].*$', '') as u from pages), d as (select *, case when k % 2 = 0 then ' (checksum verified)' else '' end as c from p)
select k as page_id, 11 as line, 'sh.curl.url' as rule_id, case when k % 2 = 0 then 'low' else 'medium' end as severity, concat('curl -o f ', u) as pattern_matched, cast(null as varchar) as reason from d where k % 3 = 0
union all select k, 11, 'sh.wget.latest', case when k % 2 = 0 then 'medium' else 'high' end, concat('wget "', u, '/latest/f"'), null from d where k % 3 = 1
union all select k, 11, 'sh.curl.url', 'medium', concat('curl ', u, '/v1.2.3/f'), 'versioned URL' from d where k % 3 = 2
union all select k, 13, 'sh.pipe', 'high', concat('curl ', u, '  | sh'), null from d where k % 4 = 0
union all select k, 15, 'sh.pip', 'low', 'pip install thing', null from d where k % 5 = 0""")
def shell_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_shell(shell_units(spark, sf_dir)).select("page_id", "line", "rule_id", "severity", "pattern_matched", "reason")


CODE = {
    "javascript": (scan_javascript, "const r = await fetch('{u}')", "js.fetch.url"),
    "python": (scan_python, "r = requests.get('{u}')", "py.requests.url"),
    "dockerfile": (scan_dockerfile, "ADD {u} /tmp/", "docker.add.url"),
}


@query("code_scan", " union all ".join(f"select page_id, '{lang}' as lang, '{rule}' as rule_id, 'medium' as severity, 1 as line, case when page_id % 2 = 0 then 'versioned URL' end as reason from pages" for lang, (_, _, rule) in CODE.items()))
def code_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.when(F.col("page_id") % 2 == 0, "/v1.2.3/f").otherwise("/en/f"))
    out = None
    for lang, (scanner, text, _) in CODE.items():
        before, after = text.split("{u}")
        units = table(spark, sf_dir, "pages").select("page_id", F.lit(lang).alias("lang"), F.lit(1).alias("base_line"), F.concat(F.lit(before), url, F.lit(after)).alias("content"))
        found = scanner(units).select("page_id", "lang", "rule_id", "severity", "line", "reason")
        out = found if out is None else out.unionByName(found)
    return out


PACKAGES = {0: ("sh.pip", "pip install {p}", "pip install {p}==1.0"), 1: ("sh.npm", "npm install {p}", "npm install {p}@1.0"), 2: ("sh.cargo", "cargo install {p}", "cargo install {p} --version 1"), 3: ("sh.gem", "gem install {p}", "gem install {p} -v 1"), 4: ("sh.npx", "npx {p}", "npx {p}@1")}


@query("guarded_rules", "select p_partkey, case " + " ".join(f"when p_partkey % 5 = {i} then '{r}'" for i, (r, _, _) in PACKAGES.items()) + " end as rule_id from part where p_partkey % 2 = 0")
def guarded_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("p_partkey"), F.concat(F.lit("pkg"), F.col("p_partkey").cast("string"))
    line = F.lit(None).cast("string")
    for i, (_, loose, fixed) in PACKAGES.items():
        put = lambda t: F.concat(F.lit(t.split("{p}")[0]), name, F.lit(t.split("{p}")[1]))
        line = F.when((k % 5 == i) & (k % 2 == 0), put(loose)).when(k % 5 == i, put(fixed)).otherwise(line)
    units = table(spark, sf_dir, "part").select("p_partkey", F.lit("shell").alias("lang"), F.lit(1).alias("base_line"), line.alias("content"))
    return scan_shell(units).select("p_partkey", "rule_id")


@query("lines_explode", "with l as (select doc_id, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) as line from documents where text <> '') select doc_id, count(*) as lines, cast(sum(length(line)) as bigint) as chars, count(*) filter (where regexp_matches(line, '^[ \t]*#')) as comments from l group by doc_id")
def lines_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(split_lines(F.col("text"))).alias("line"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"), F.count_if(is_comment(F.col("line"))).alias("comments"))


def event_scripts(spark: SparkSession, sf_dir: str, backslash: str = "") -> DataFrame:
    """A text for each user, a line for each event in order; backslash is put behind views."""
    line = F.concat("event_type", F.when(F.col("event_type") == "view", backslash).otherwise(""))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("o"))
    return rows.select("user_id", F.array_join(F.transform("o", lambda x: x["line"]), "\n").alias("content"))


@query("lookahead_lines", "select user_id, cast(row_number() over w - 1 as integer) as i, event_type as line, coalesce(bool_or(event_type = 'error') over (partition by user_id order by event_id rows between 1 following and 3 following), false) as ahead from events window w as (partition by user_id order by event_id)")
def lookahead_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines_of(event_scripts(spark, sf_dir))
    return rows.select("user_id", "i", F.col("text").alias("line"), F.array_contains(F.split("ahead", LINE_END), "error").alias("ahead"))


@query("logical_commands", """with e as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) - 1 as i, coalesce(lag(event_type = 'view') over (partition by user_id order by event_id), false) as c from events),
i as (select *, sum(case when c then 0 else 1 end) over (partition by user_id order by event_id) as island from e)
select user_id, cast(min(i) as integer) as first_line, string_agg(event_type, ' ' order by event_id) as joined from i group by user_id, island""")
def logical_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines_of(event_scripts(spark, sf_dir, "\\"), logical=True)
    return rows.where("logical is not null").select("user_id", F.col("i").alias("first_line"), F.col("logical").alias("joined"))


#: A line for each rule, around a name {p}.
RULE_LINES = {
    "shell": {
        "sh.pipe": "curl -s https://h.example/{p}.sh | sudo bash", "sh.procsub": "bash <(curl -s https://h.example/{p}.sh)", "sh.cmdsub": 'sh -c "$(curl -fsSL https://h.example/{p}.sh)"', "ps.iex": "iex (iwr https://h.example/{p}.ps1)",
        "sh.curl.latest": "curl -LO https://h.example/latest/{p}", "sh.wget.latest": "wget https://h.example/latest/{p}", "sh.go.latest": "go install example.org/{p}@latest", "ps.iwr.latest": "Invoke-WebRequest https://h.example/latest/{p}",
        "sh.brew.head": "brew install {p} --head", "sh.curl.url": "curl -O https://h.example/{p}.tgz", "sh.wget.url": "wget https://h.example/{p}.tgz", "ps.iwr.url": "irm https://h.example/{p}.tgz", "sh.gh.release": "gh release download -p {p}",
        "sh.git.clone": "git clone https://h.example/{p}", "sh.pip": "pip3 install {p}", "sh.npm": "npm install @scope/{p}", "sh.cargo": "cargo install {p}", "sh.gem": "gem install {p}", "sh.npx": "npx --yes {p}", "ps.module": "Install-Module {p}",
        "sh.pip.git": "pip install git+https://h.example/{p}",
    },
    "javascript": {
        "js.fetch.latest": "fetch('https://h.example/latest/{p}')", "js.axios.latest": "axios.get('https://h.example/latest/{p}')", "js.got.latest": "got('https://h.example/latest/{p}')", "js.http.latest": "https.get('https://h.example/latest/{p}')",
        "js.exec.curl": "execSync('curl {p}')", "js.child.curl": "require('child_process').run('curl {p}')", "js.fetch.url": "fetch('https://h.example/{p}.tgz')", "js.axios.url": "axios.get('https://h.example/{p}.tgz')",
    },
    "python": {
        "py.urllib.latest": "urllib.request.urlopen('https://h.example/latest/{p}')", "py.requests.latest": "requests.get('https://h.example/latest/{p}')", "py.subprocess.curl": "subprocess.run(['curl', '{p}'])",
        "py.subprocess.wget": "subprocess.run(['wget', '{p}'])", "py.urllib.url": "urllib.request.urlopen('https://h.example/{p}.tgz')", "py.requests.url": "requests.head('https://h.example/{p}.tgz')",
    },
    "dockerfile": {
        "docker.from.latest": "FROM {p}:latest", "docker.from.untagged": "FROM library/{p} AS b", "docker.run.curl": "RUN apt-get -y upgrade && curl {p}", "docker.run.wget": "RUN wget {p}", "docker.add.url": "ADD https://h.example/{p}.tgz /",
        "docker.git.clone": "RUN git clone https://h.example/{p}",
    },
}
ALL_LINES = [(lang, rule, text) for lang, lines in RULE_LINES.items() for rule, text in lines.items()]
#: In code a URL rule speaks beside a plain one.
BESIDE = {"js.fetch.latest": "js.fetch.url", "js.axios.latest": "js.axios.url", "py.urllib.latest": "py.urllib.url", "py.requests.latest": "py.requests.url"}
HIT_VALUES = ", ".join("({}, '{}', '{}', {}, {})".format(k, hit, rules.BY_ID[hit].severity, *("'" + x.replace("'", "''") + "'" for x in text.split("{p}"))) for k, (_, rule, text) in enumerate(ALL_LINES) for hit in (rule, BESIDE.get(rule)) if hit)


@query("rule_hits", f"with v(k, rule_id, severity, before, after) as (values {HIT_VALUES}) select p_partkey, v.rule_id, v.severity, concat(v.before, 'pkg', p_partkey, v.after) as pattern_matched from part join v on p_partkey % {len(ALL_LINES)} = v.k")
def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each part, by turns one for each of the rules."""
    k, name = F.col("p_partkey") % len(ALL_LINES), F.concat(F.lit("pkg"), F.col("p_partkey").cast("string"))
    texts = F.array(*[F.concat(F.lit(t.split("{p}")[0]), name, F.lit(t.split("{p}")[1])) for _, _, t in ALL_LINES])
    langs = F.array(*[F.lit(lang) for lang, _, _ in ALL_LINES])
    units = table(spark, sf_dir, "part").select("p_partkey", F.get(langs, k.cast("int")).alias("lang"), F.lit(1).alias("base_line"), F.get(texts, k.cast("int")).alias("content"))
    return scan(units).select("p_partkey", "rule_id", "severity", "pattern_matched")


def part_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each part the action that uses_lines() has for it, and its key."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.when(k % 5 == 0, "actions").otherwise(F.concat(F.lit("org"), (k % 7).cast("string"))).alias("owner"), F.concat(F.lit("action"), (k % 50).cast("string")).alias("repo_name"), k.alias("k"))


PARTS_SQL = "select case when p_partkey % 5 = 0 then 'actions' else concat('org', p_partkey % 7) end as owner, concat('action', p_partkey % 50) as repo_name, p_partkey as k from part"


def refs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References as workflows give them, a repository for each supplier."""
    rows = uses_lines(spark, sf_dir).withColumn("u", parse_uses(F.col("raw_line"))).where("u is not null")
    return rows.select(F.col("repo").cast("string").alias("repo"), F.col("workflow").cast("string").alias("workflow"), F.col("line").alias("line_number"), "u.*", "raw_line")


# Tags of every action by its parts' keys: all of one major version are one commit, tags with a 7 were deleted,
# those with an even key are annotated, and of these each third leads nowhere.
TAGS_SQL = f"""p as ({PARTS_SQL}), tg as (select owner, repo_name, {REF_SQL.format(k="k")} as tag, min(k) as k from p where k % 4 in (1, 2) and k % 9 <> 7 group by all),
tr as (select owner, repo_name, tag, k, case when k % 2 = 0 and k % 3 = 0 then null else sha1(concat(owner, '/', repo_name, substr(tag, 1, 2))) end as sha from tg)"""


def tag_snapshot(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("k")
    tags = part_actions(spark, sf_dir).where((k % 4).isin(1, 2) & (k % 9 != 7)).groupBy("owner", "repo_name", ref_string(k).alias("tag")).agg(F.min("k").alias("k"))
    commit, tag_object = F.sha1(F.concat("owner", F.lit("/"), "repo_name", F.substring("tag", 1, 2)).cast("binary")), F.sha1(F.concat("owner", F.lit("/"), "repo_name", "tag").cast("binary"))
    annotated = k % 2 == 0
    refs = tags.select("owner", "repo_name", "tag", F.when(annotated, tag_object).otherwise(commit).alias("object_sha"), F.when(annotated, "tag").otherwise("commit").alias("object_type"), k.alias("ordinal"))
    objects = tags.where(annotated & (k % 3 != 0)).select("owner", "repo_name", tag_object.alias("tag_sha"), commit.alias("commit_sha"))
    return refs, objects


@query("pin_plan", f"""with u as ({USES_SQL}), t as (select *, {TYPE_SQL} as ty from u), {TAGS_SQL},
x as (select a.owner, a.repo_name, a.tag, a.sha, coalesce((select arg_min(b.tag, {{'l': -length(b.tag), 'k': b.k}}) from tr b where b.owner = a.owner and b.repo_name = a.repo_name and b.sha = a.sha and starts_with(b.tag, a.tag) and length(b.tag) > length(a.tag)), a.tag) as e from tr a where a.sha is not null),
j as (select t.*, concat_ws('/', t.owner, t.repo_name, subpath) as name, x.sha, x.e from t left join x on t.owner = x.owner and t.repo_name = x.repo_name and t.r = x.tag and ty in ('tag', 'sliding') where ty <> 'sha')
select 'pinned' as kind, concat('      - uses: ', name, '@', sha, ' # ', e) as text, count(*) as n from j where sha is not null group by all
union all select 'skipped', concat(name, '@', r, ': ', case when ty = 'branch' then 'branch ref: pin to a commit by hand' when sha is null then concat('tag not found: ', r) else concat('sliding tag, resolved to ', e) end), count(*) from j where ty <> 'tag' or sha is null group by all""")
def pin_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of pinning, from lines and a snapshot of tags to new lines and what is skipped."""
    pins = pin(refs_of(spark, sf_dir), *tag_snapshot(spark, sf_dir))
    done = pins.pinned.select(F.lit("pinned").alias("kind"), F.col("new_line").alias("text"))
    left = pins.skipped.select(F.lit("skipped").alias("kind"), F.concat("action", F.lit(": "), "reason").alias("text"))
    return done.unionByName(left).groupBy("kind", "text").agg(F.count("*").alias("n"))


@query("pin_status", f"""with u as ({USES_SQL}), t as (select *, {TYPE_SQL} as ty from u), {TAGS_SQL}, f as (select distinct owner, repo_name, tag from tr where sha is not null),
j as (select t.repo, t.workflow, ty, f.tag is not null as found from t left join f on t.owner = f.owner and t.repo_name = f.repo_name and t.r = f.tag and ty in ('tag', 'sliding') where ty <> 'sha')
select cast(repo as varchar) as repo, count(*) filter (where found) as pinned, count(distinct workflow) filter (where found) as files_touched, count(*) filter (where ty <> 'tag' or not found) as skipped, cast(bool_or(found) as integer) as status from j group by repo""")
def pin_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = refs_of(spark, sf_dir)
    return pin_report(pin(refs, *tag_snapshot(spark, sf_dir)), refs.where("ref_type <> 'sha'"))


# Releases of every action by its parts' keys: a version, its place in the list, drafts and pre-releases.
LISTED_SQL = f"p as ({PARTS_SQL}), l as (select owner, repo_name, k, row_number() over (partition by owner, repo_name order by k) - 1 as place, concat('v', k % 3, '.', k % 5, '.', k % 2) as tag, [k % 3, k % 5, k % 2] as v, k % 8 = 0 as out from p)"


def release_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    place = F.row_number().over(Window.partitionBy("owner", "repo_name").orderBy("k")) - 1
    tag = F.concat(F.lit("v"), (k % 3).cast("string"), F.lit("."), (k % 5).cast("string"), F.lit("."), (k % 2).cast("string"))
    return part_actions(spark, sf_dir).select("owner", "repo_name", place.alias("ordinal"), tag.alias("tag_name"), (k % 16 == 0).alias("draft"), (k % 16 == 8).alias("prerelease"), F.concat(F.lit("https://h.example/"), tag).alias("html_url"))


@query("update_plan", f"""with u as ({USES_SQL}), t as (select *, {TYPE_SQL} as ty from u), {LISTED_SQL},
b as (select owner, repo_name, arg_max(tag, {{'v': v, 'o': -place}}) as tag, max(v) as v from l where place < 30 and not out group by all),
j as (select cast(t.repo as varchar) as repo, b.tag, [1, 0, 0] < b.v as newer, t.owner, t.repo_name, t.subpath from t join (select distinct owner, repo_name from l) using (owner, repo_name) left join b using (owner, repo_name) where ty = 'sha' and tag_comment is not null),
c as (select repo, count(*) filter (where not coalesce(newer, false)) as up_to_date, count(*) filter (where newer) as outdated from j group by repo),
n as (select repo, count(*) as updates, min(concat('      - uses: ', concat_ws('/', owner, repo_name, subpath), '@', sha1(concat(owner, repo_name, tag)), ' # ', tag)) as first_line from j where newer group by repo)
select c.repo, coalesce(updates, 0) as updates, first_line, up_to_date, outdated, cast(coalesce(updates, 0) > 0 as integer) as status from c left join n using (repo)""")
def update_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of updating, from lines and snapshots of releases and tags to new lines and counters."""
    refs, releases = refs_of(spark, sf_dir), release_list(spark, sf_dir)
    tags = releases.select("owner", "repo_name", F.col("tag_name").alias("tag"), F.sha1(F.concat("owner", "repo_name", "tag_name").cast("binary")).alias("object_sha"), F.lit("commit").alias("object_type")).distinct()
    found = update(refs, releases, tags, spark.createDataFrame([], TAG_OBJECTS))
    first = found.updates.groupBy("repo").agg(F.min("new_line").alias("first_line"))
    return update_report(found, found.counters).join(first, "repo", "left").select("repo", "updates", "first_line", "up_to_date", "outdated", "status")


@query("rewrite_files", """with f as (select p_partkey as k, unnest(range(1, 6)) as i from part), c as (select l_partkey as k, l_linenumber as i, arg_min(concat('new ', l_orderkey, '-', l_suppkey), {'o': l_orderkey, 's': l_suppkey, 'q': l_quantity}) as t from lineitem group by all)
select concat('w', f.k) as workflow, concat(string_agg(coalesce(c.t, concat('line ', f.i)), chr(10) order by f.i), case when f.k % 2 = 0 then chr(10) else '' end) as content from f left join c on f.k = c.k and f.i = c.i group by f.k""")
def rewrite_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of five lines, half with carriage returns, in which line items replace lines; the first of several wins."""
    k = F.col("p_partkey")
    end = F.when(k % 3 == 0, "\r\n").otherwise("\n")
    content = F.concat(*[x for i in range(1, 6) for x in (F.lit(f"line {i}"), end if i < 5 else F.when(k % 2 == 0, end).otherwise(""))])
    files = table(spark, sf_dir, "part").select(F.lit("r").alias("repo"), F.concat(F.lit("w"), k.cast("string")).alias("workflow"), content.alias("content"))
    text = F.concat(F.lit("new "), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"))
    changes = table(spark, sf_dir, "lineitem").select(F.lit("r").alias("repo"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("file"), F.col("l_linenumber").alias("line"), text.alias("new_line"), F.struct("l_orderkey", "l_suppkey", "l_quantity").alias("ordinal"))
    return rewrite(files, changes).select("workflow", "content")


def release_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, k = F.col("l_quantity").cast("int"), F.col("l_orderkey")
    tag = F.concat(F.lit("v"), (k % 7).cast("string"), F.lit("."), q.cast("string"), F.when(k % 3 == 0, F.concat(F.lit("."), (k % 4).cast("string"))).otherwise(""), F.when(k % 5 == 0, "-rc1").otherwise(""))
    return table(spark, sf_dir, "lineitem").select(F.lit("o").alias("owner"), F.col("l_partkey").cast("string").alias("repo_name"), F.lit(0).alias("ordinal"), tag.alias("tag_name"), (k % 11 == 0).alias("draft"), F.lit(False).alias("prerelease"), F.lit(None).cast("string").alias("html_url"))


RELEASES_SQL = """select l_partkey, concat('v', l_orderkey % 7, '.', cast(l_quantity as integer), case when l_orderkey % 3 = 0 then concat('.', l_orderkey % 4) else '' end, case when l_orderkey % 5 = 0 then '-rc1' else '' end) as t,
  case when l_orderkey % 3 = 0 then [l_orderkey % 7, cast(l_quantity as bigint), l_orderkey % 4] else [l_orderkey % 7, cast(l_quantity as bigint)] end as v, l_orderkey % 5 <> 0 as s from lineitem where l_orderkey % 11 <> 0"""


@query("version_max", f"with r as ({RELEASES_SQL}) select cast(l_partkey as varchar) as repo_name, arg_max(t, {{'v': v, 's': s}}) as latest_tag from r group by l_partkey")
def version_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_releases(release_rows(spark, sf_dir)).select("repo_name", "latest_tag")


@query("update_available", f"""with r as ({RELEASES_SQL}), m as (select l_partkey, arg_max(t, {{'v': v, 's': s}}) as t, max({{'v': v, 's': s}}) as b from r group by l_partkey)
select o_orderkey, concat('v', o_orderkey % 7, '.', o_custkey % 50) as current_tag, m.t as latest_tag from orders join m on o_custkey = m.l_partkey where {{'v': [o_orderkey % 7, o_custkey % 50], 's': true}} < m.b""")
def update_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = latest_releases(release_rows(spark, sf_dir))
    now = F.concat(F.lit("v"), (F.col("o_orderkey") % 7).cast("string"), F.lit("."), (F.col("o_custkey") % 50).cast("string"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("repo_name"), now.alias("current_tag"))
    return orders.join(latest, "repo_name").where(is_newer(F.col("current_tag"), F.col("latest_tag"))).select("o_orderkey", "current_tag", "latest_tag")


@query("audited_layers", """with c as (select p_partkey as k, case when p_partkey % 6 = 0 then 1 when p_partkey % 4 = 0 then 2 when p_partkey % 9 = 0 then 3 end as layer from part)
select coalesce(['bundled', 'local cache', 'remote'][layer], case l_partkey % 4 when 0 then 'branch' when 1 then 'sliding' else 'fresh' end) as status, count(*) as n from lineitem join c on l_partkey = k group by all""")
def audited_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    layers = F.array(F.when(k % 6 == 0, "bundled"), F.when(k % 4 == 0, "local cache"), F.when(k % 9 == 0, "remote"))
    known = table(spark, sf_dir, "part").select(k, F.explode(F.filter(layers, lambda x: x.isNotNull())).alias("layer"))
    from shoal.sources.snapshots import first_layer

    first = first_layer(known.select(F.lit("o").alias("owner"), F.lit("r").alias("repo_name"), k.cast("string").alias("sha"), "layer")).select("sha", "layer")
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("sha"), F.when(F.col("l_partkey") % 4 == 0, "branch").when(F.col("l_partkey") % 4 == 1, "sliding").otherwise("fresh").alias("other"))
    return refs.join(first, "sha", "left").groupBy(F.coalesce("layer", "other").alias("status")).agg(F.count("*").alias("n"))


@query("org_score", f"with s as ({SQL['repo_score']}), g as (select repo % 10 as org, score, findings from s) select org, round(sum(score * findings) / sum(findings), 2) as score, count(*) as repos from g group by org")
def org_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoal.operators.score import org_scores

    scores = repo_score(spark, sf_dir)
    return org_scores(scores.select("repo", "score"), scores.select("repo", F.col("findings").alias("uses")), F.col("repo") % 10)


@query("score_history", f"with s as ({SQL['repo_score']}), h as (select repo % 50 as r, repo as scanned, score from s) select r as repo, scanned as scanned_at, score, lag(score) over (partition by r order by scanned) as \"before\", score - lag(score) over (partition by r order by scanned) as change from h")
def score_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoal.operators.score import score_changes

    return score_changes(repo_score(spark, sf_dir).select((F.col("repo") % 50).alias("repo"), F.col("repo").alias("scanned_at"), "score"))


@query("severity_filter", "select least(l_linenumber % 4, 3) as k, case l_linenumber % 4 when 0 then 2 when 1 then 1 else 0 end as rank, count(*) as n from lineitem group by all")
def severity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoal.operators.audit import rank_of

    k = F.col("l_linenumber") % 4
    name = F.when(k == 0, "high").when(k == 1, "medium").when(k == 2, "low").otherwise("High")
    return table(spark, sf_dir, "lineitem").select(k.alias("k"), rank_of(name).alias("rank")).groupBy("k", "rank").agg(F.count("*").alias("n"))


def workflow_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workflow for each page: a reference by key, a run block that fetches the page, triggers by key."""
    k = F.col("page_id")
    url = F.regexp_replace("url", "[?#].*$", "")
    content = F.concat(
        F.when(k % 4 == 0, "on: [push, pull_request_target]\n").otherwise("on: push\n"), F.when(k % 5 == 0, "permissions: write-all\n").otherwise(""),
        F.lit("jobs:\n  a:\n    steps:\n      - uses: actions/checkout@"), ref_string(k), F.lit("\n      - run: |\n          curl "), url, F.when(k % 3 == 0, " | sh").otherwise(""), F.lit("\n"),
    )
    return table(spark, sf_dir, "pages").select((k % 50).cast("string").alias("repo"), F.concat(F.lit(".github/workflows/w"), k.cast("string"), F.lit(".yml")).alias("workflow"), content.alias("content"))


@query("corpus_score", f"""with w as (select page_id as k, page_id % 50 as repo, {REF_SQL.format(k="page_id")} as r from pages),
f as (select distinct repo, case k % 4 when 0 then 15 when 1 then 5 when 2 then 2 end as p, r as a, -1 as w from w where k % 4 <> 3
  union all select repo, 10, '', k from w where k % 5 = 0 union all select repo, 5, '', k from w where k % 4 = 0
  union all select repo, case when k % 3 = 0 then 20 else 8 end, '', k from w),
s as (select repo, sum(p) as p, count(*) as n from f group by repo), u as (select repo, count(*) as workflows, count(distinct r) as actions from w group by repo)
select cast(u.repo as varchar) as repo, cast(greatest(0, 100 - s.p) as integer) as score, case when s.p <= 10 then 'A' when s.p <= 20 then 'B' when s.p <= 30 then 'C' when s.p <= 40 then 'D' else 'F' end as grade,
  cast(s.p as integer) as points_deducted, s.n as findings, workflows as workflows_scanned, actions as unique_actions from u join s on u.repo = s.repo""")
def corpus_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of scoring, from file texts to reports."""
    from shoal.operators.score import score

    return score(workflow_files(spark, sf_dir)).report.select("repo", "score", "grade", "points_deducted", "findings", "workflows_scanned", "unique_actions")


@query("corpus_audit", """select cast(page_id % 50 as varchar) as repo, concat('.github/workflows/w', page_id, '.yml') as source_file, case when page_id % 3 = 0 then 'sh.pipe' else 'sh.curl.url' end as rule_id,
  case when page_id % 3 = 0 then 'high' else 'medium' end as severity, 'shell_fetch' as category, 7 + (case when page_id % 5 = 0 then 1 else 0 end) as line,
  concat('curl ', regexp_replace(url, '[?#].*$', ''), case when page_id % 3 = 0 then ' | sh' else '' end) as pattern_matched from pages""")
def corpus_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of auditing run blocks, from file texts to findings."""
    from shoal.operators.audit import audit

    return audit(workflow_files(spark, sf_dir)).findings.select("repo", "source_file", "rule_id", "severity", "category", "line", "pattern_matched")


# Of the references of workflow_files(): audited commits by layer, sources that are at hand, with a fetch in some.
STATUS_SQL = f"""w as (select page_id as k, page_id % 50 as repo, {REF_SQL.format(k="page_id")} as r from pages), d as (select repo, r, min(k) as k from w group by all),
a as (select r, min(case when k % 12 = 3 then 1 when k % 12 = 7 then 2 when k % 24 = 11 then 3 end) as layer from w where k % 4 = 3 group by r), h as (select r, bool_or(k % 5 <> 0) as there, bool_or(k % 5 = 1) as bad from w group by r),
s as (select d.repo, d.r, case when layer is not null then ['bundled', 'local cache', 'remote'][layer] when not there then 'failed' when regexp_matches(d.r, '^v[0-9]+$') then 'sliding' when d.r = 'main' then 'branch' else 'fresh' end as status, bad
  from d left join a on d.r = a.r join h on d.r = h.r)"""


def action_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(audited, sources) of the actions that workflow_files() uses."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("k")).withColumn("r", ref_string(F.col("k")))
    layer = F.when(F.col("k") % 12 == 3, "bundled").when(F.col("k") % 12 == 7, "local cache").when(F.col("k") % 24 == 11, "remote")
    own = [F.lit("actions").alias("owner"), F.lit("checkout").alias("repo_name")]
    audited = pages.where("k % 4 = 3").select(*own, F.col("r").alias("sha"), F.lit("v1").alias("tag"), layer.alias("layer")).where("layer is not null")
    there = pages.groupBy("r").agg(F.max(F.col("k") % 5 != 0).alias("there"), F.max(F.col("k") % 5 == 1).alias("bad")).where("there")
    code = F.when(F.col("bad"), "x()\nfetch('https://h.example/f')\n").otherwise("x()\n")
    metadata = F.when(F.col("bad"), "runs:\n  steps:\n    - run: pip install thing\n").otherwise("runs:\n  steps: []\n")
    file = lambda path, text: there.select(*own, F.col("r").alias("ref"), F.lit(path).alias("path"), F.lit("blob").alias("entry_type"), text.alias("content"))
    return audited, file("index.js", code).unionByName(file("action.yml", metadata)).unionByName(file("README.md", F.lit("curl x | sh")))


@query("action_status", f"with {STATUS_SQL} select cast(repo as varchar) as repo, count(*) as actions_scanned, " + ", ".join(f"count(*) filter (where status = '{x}') as {c}" for c, x in {"audited_bundled": "bundled", "audited_local_cache": "local cache", "audited_remote": "remote", "scanned_fresh": "fresh", "scanned_unpinned_sliding": "sliding", "scanned_unpinned_branch": "branch"}.items()) + " from s group by repo")
def action_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoal.operators.audit import audit

    audited, sources = action_snapshots(spark, sf_dir)
    return audit(workflow_files(spark, sf_dir), audited=audited, sources=sources).report.select("repo", "actions_scanned", "audited_bundled", "audited_local_cache", "audited_remote", "scanned_fresh", "scanned_unpinned_sliding", "scanned_unpinned_branch")


@query("action_findings", f"""with {STATUS_SQL}, f as (select repo, r from s where bad and status in ('fresh', 'sliding', 'branch'))
select cast(repo as varchar) as repo, concat('actions/checkout@', substr(r, 1, 7)) as action, 'actions/checkout (index.js)' as source_file, 2 as line, 'js.fetch.url' as rule_id, 'medium' as severity from f
union all select cast(repo as varchar), concat('actions/checkout@', substr(r, 1, 7)), 'actions/checkout (action.yml)', 0, 'sh.pip', 'low' from f""")
def action_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in the sources of the actions that are neither audited nor missing."""
    from shoal.operators.audit import audit

    audited, sources = action_snapshots(spark, sf_dir)
    return audit(workflow_files(spark, sf_dir), audited=audited, sources=sources).findings.where("workflow_file is not null").select("repo", "action", "source_file", "line", "rule_id", "severity")


@query("clean_commits", f"with {STATUS_SQL} select r as sha from s where status = 'fresh' and length(r) = 40 group by r having not bool_or(bad)")
def clean_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits whose sources a scan found nothing in, for the clean cache."""
    from shoal.operators.audit import audit

    audited, sources = action_snapshots(spark, sf_dir)
    return audit(workflow_files(spark, sf_dir), audited=audited, sources=sources).clean.select("sha").distinct()
