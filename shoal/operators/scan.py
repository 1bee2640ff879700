"""Scanners: units of code to findings and allowed matches.

A unit row has: unit_id, lang, base_line, content, source_file, action, and whatever else should come
along. Scans are narrow plans: a unit is split into lines, each with what it needs of its neighbours
(the joined command that starts there, the next three lines), so nothing is shuffled or windowed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.functions.text import is_comment, split_lines, trim
from shoal.functions.urls import disposition, first_url
from shoal.operators.rules import CHECKSUM, DIGEST_FROM, PREFILTER, RULES, SHA_CHECKOUT, hits, java

#: Bytes of a line beyond which a script counts as minified; lines looked ahead.
MINIFIED, AHEAD = 500, 3
LINE_END = "\x01"


@dataclass(frozen=True)
class ScanOptions:
    trusted_hosts: tuple[str, ...] = ()
    extra_data_formats: tuple[str, ...] = ()
    strict_hosts: bool = False
    verbose: bool = True


@dataclass(frozen=True)
class _Parts:
    plain: Column
    url: Column
    package: Column
    pipe: Column = field(default_factory=lambda: F.array().cast("array<int>"))


def _rule_table() -> Column:
    """The rules as an array literal, looked up by position."""
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in (("rule_id", r.rule_id), ("kind", r.kind), ("severity", r.severity), ("category", r.category), ("description", r.description))]) for r in RULES])


def logical_lines(lines: Column) -> Column:
    """Aligned with lines: the joined command that starts there, null where a line continues another.

    A line continues if it ends in a backslash, white space aside. Pieces after the first are trimmed
    and joined with a space.
    """
    continues = r"(?U)\\\s*\z"
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("n"))

    def step(acc: Column, line: Column) -> Column:
        more = line.rlike(continues)
        body = F.when(more, F.regexp_replace(line, continues, "")).otherwise(line)
        text = F.when(acc["text"].isNull(), body).otherwise(F.concat(acc["text"], F.lit(" "), trim(body)))
        done = F.concat(acc["out"], F.array(text), F.array_repeat(F.lit(None).cast("string"), acc["n"]))
        return F.struct(F.when(more, acc["out"]).otherwise(done).alias("out"), F.when(~more, F.lit(None).cast("string")).otherwise(text).alias("text"), F.when(more, acc["n"] + 1).otherwise(0).alias("n"))

    def finish(acc: Column) -> Column:
        return F.when(acc["text"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["text"]), F.array_repeat(F.lit(None).cast("string"), acc["n"] - 1)))

    return F.aggregate(lines, state, step, finish)


def lines_of(units: DataFrame, logical: bool = False) -> DataFrame:
    """One row per physical line: i (from 0), text, ahead (the next three lines), logical."""
    kept = [c for c in units.columns if c != "content"]
    lines = units.select(*kept, split_lines(F.col("content")).alias("lines"))
    size = F.greatest(F.size("lines"), F.lit(1))
    ahead = [F.slice("lines", k + 1, size) for k in range(1, AHEAD + 1)]
    zipped = F.arrays_zip(F.col("lines"), *[a.alias(f"a{k}") for k, a in enumerate(ahead)], (logical_lines(F.col("lines")) if logical else F.col("lines")).alias("logical"))
    zipped = zipped.cast("array<struct<text:string," + ",".join(f"a{k}:string" for k in range(AHEAD)) + ",logical:string>>")
    out = lines.select(*kept, F.posexplode(zipped).alias("i", "z"))
    return out.select(*kept, "i", F.col("z.text").alias("text"), F.concat_ws(LINE_END, *[F.col(f"z.a{k}") for k in range(AHEAD)]).alias("ahead"), F.col("z.logical").alias("logical"))


def _emit(lines: DataFrame, parts: _Parts, options: ScanOptions, line: Column, downgrade: Column | None = None, clone_allowed: Column | None = None) -> DataFrame:
    """Explodes the hits of each line and settles disposition, severity and description."""
    kept = [c for c in lines.columns if c not in ("logical", "ahead", "text")]
    tagged = F.concat(*[F.transform(c, lambda x, k=k: F.struct(F.lit(k).alias("pass"), x.alias("rule"))) for k, c in enumerate((parts.pipe, parts.plain, parts.url, parts.package))])
    nothing = F.lit(False)
    rows = lines.select(*kept, "text", "logical", F.coalesce(downgrade if downgrade is not None else nothing, nothing).alias("checked"), F.coalesce(clone_allowed if clone_allowed is not None else nothing, nothing).alias("clone_ok"), line.alias("line"), tagged.alias("hits"))
    rows = rows.where(F.size("hits") > 0).select("*", F.explode("hits").alias("hit")).drop("hits")
    rows = rows.withColumn("r", F.get(_rule_table(), F.col("hit.rule")))
    url = first_url(F.col("text"))
    rows = rows.withColumn("url", F.when(F.col("r.kind") == "url", url)).where((F.col("r.kind") != "url") | F.col("url").isNotNull())
    reason = F.when(F.col("r.kind") == "url", disposition(F.col("url"), options.trusted_hosts, options.extra_data_formats, options.strict_hosts)).when((F.col("r.rule_id") == "sh.git.clone") & F.col("clone_ok"), "followed by SHA checkout")
    rows = rows.withColumn("reason", reason)
    checked = F.col("checked") & (F.col("r.kind") != "pipe") & F.col("reason").isNull()
    lower = F.when(F.col("r.severity") == "high", "medium").otherwise("low")
    out = rows.select(
        *kept, "line", F.col("r.rule_id").alias("rule_id"), F.col("r.kind").alias("rule_kind"),
        F.when(checked, lower).otherwise(F.col("r.severity")).alias("severity"), F.col("r.category").alias("category"),
        trim(F.when(F.col("r.kind") == "pipe", F.col("logical")).otherwise(F.col("text"))).alias("pattern_matched"),
        F.when(F.col("reason").isNull(), F.concat(F.col("r.description"), F.when(checked, " (checksum verified)").otherwise(""))).alias("description"),
        "reason", F.struct(F.when(F.col("hit.pass") == 0, 0).otherwise(1).alias("second"), F.col("i"), F.col("hit.pass"), F.col("hit.rule")).alias("place"),
    )
    return out if options.verbose else out.where("reason is null")


def _none() -> Column:
    return F.array().cast("array<int>")


def scan_shell(units: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Pipes over joined commands first; then, on lines that aren't comments and don't start such a
    command, plain rules, URL rules where no plain rule matched, and package rules. Findings but pipes
    go down one step if a checksum command stands in the next three lines."""
    lines = lines_of(units, logical=True).where(F.col("text").rlike(java(PREFILTER)) | F.col("logical").rlike(java(PREFILTER)))
    pipe = F.when(is_comment(F.col("logical")) | F.col("logical").isNull(), _none()).otherwise(hits("shell", ("pipe",), F.col("logical")))
    lines = lines.withColumn("pipe", pipe)
    skip = is_comment(F.col("text")) | (F.size("pipe") > 0)
    lines = lines.withColumn("plain", F.when(skip, _none()).otherwise(hits("shell", ("plain",), F.col("text"))))
    lines = lines.withColumn("urls", F.when(skip | (F.size("plain") > 0), _none()).otherwise(hits("shell", ("url",), F.col("text"))))
    lines = lines.withColumn("packages", F.when(skip, _none()).otherwise(hits("shell", ("package",), F.col("text"))))
    parts = _Parts(F.col("plain"), F.col("urls"), F.col("packages"), F.col("pipe"))
    out = _emit(lines, parts, options, F.col("base_line") + F.col("i"), F.col("ahead").rlike(java(CHECKSUM)), F.col("ahead").rlike(java(SHA_CHECKOUT)))
    return out.drop("pipe", "plain", "urls", "packages")


def _scan_lines(units: DataFrame, lang: str, options: ScanOptions) -> DataFrame:
    lines = lines_of(units)
    if lang == "javascript":  # minified lines are looked at statement by statement
        pieces = F.filter(F.transform(F.split("text", ";"), trim), lambda x: x != "")
        lines = lines.withColumn("text", F.explode(F.when(F.octet_length("text") > MINIFIED, pieces).otherwise(F.array("text"))))
    lines = lines.where(F.col("text").rlike(java(PREFILTER)))
    parts = _Parts(hits(lang, ("plain",), F.col("text")), hits(lang, ("url",), F.col("text")), _none())
    return _emit(lines, parts, options, F.col("i") + 1)


def scan_javascript(units: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    return _scan_lines(units, "javascript", options)


def scan_python(units: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    return _scan_lines(units, "python", options)


def scan_dockerfile(units: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Pipes on every line; the other rules on lines without a pipe and without an image digest."""
    lines = lines_of(units).where(F.col("text").rlike(java(PREFILTER))).withColumn("pipe", hits("shell", ("pipe",), F.col("text")))
    skip = F.col("text").rlike(java(DIGEST_FROM)) | (F.size("pipe") > 0)
    one = lambda kind: F.when(skip, _none()).otherwise(hits("dockerfile", (kind,), F.col("text")))
    parts = _Parts(one("plain"), one("url"), one("package"), F.col("pipe"))
    return _emit(lines, parts, options, F.col("i") + 1).drop("pipe")


SCANNERS = {"shell": scan_shell, "javascript": scan_javascript, "python": scan_python, "dockerfile": scan_dockerfile}


def scan(units: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """All languages; units of others give nothing. Findings have no reason, allowed matches have one."""
    out = None
    for lang, scanner in SCANNERS.items():
        found = scanner(units.where(F.col("lang") == lang), options)
        out = found if out is None else out.unionByName(found)
    return out
