import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shoal.functions.refs import parse_uses, pinned_line
from shoal.functions.text import split_lines
from shoal.functions.urls import disposition, first_url, url_extension, url_host
from shoal.functions.versions import is_newer


def rows(spark, values, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(values, schema).coalesce(1).select(*columns).collect()]


def test_refs(spark):
    sha = "Ab" * 20
    cases = [("v4", "sliding"), ("4", "sliding"), ("v1.2", "tag"), ("1.2.3", "tag"), (sha, "sha"), (sha + "a", "branch"), (sha[:39], "branch"), ("v1.0.0-rc1", "branch"), ("main", "branch"), ("v", "branch"), ("vv1", "branch"), (".", "tag")]
    got = rows(spark, [(f"  - uses: o/r/s/t@{r} # c ",) for r, _ in cases], "x string", parse_uses(F.col("x"))["ref_type"])
    assert [g[0] for g in got] == [t for _, t in cases]


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("- uses: o/r@v1", ("o", "r", None, "v1", None)),
        ("uses: o/r/a/b@main  #  tag 1 ", ("o", "r", "a/b", "main", "tag 1")),
        ("  uses: ./local@x", None),
        ("  uses: single@x", None),
        ("  uses: o/r", None),
        ("# uses: o/r@v1", None),
        ('  uses: "o/r@v1"', ('"o', "r", None, 'v1"', None)),
    ],
)
def test_uses(spark, line, expected):
    got = rows(spark, [(line,)], "x string", parse_uses(F.col("x")).alias("u"))[0][0]
    assert (got and (got.owner, got.repo_name, got.subpath, got.ref_string, got.tag_comment)) == expected


def test_pinned_line(spark):
    assert rows(spark, [("    - uses: o/r@v1 # old",)], "x string", pinned_line(F.col("x"), F.lit("S"), F.lit("v1.2")))[0][0] == "    - uses: o/r@S # v1.2"


def test_urls(spark):
    cases = [
        ("curl 'https://u@h.example:80/a/b.json?x=1#y' z", "https://u@h.example:80/a/b.json?x=1#y", "h.example", "json"),
        ("x http://h.example/a)", "http://h.example/a", "h.example", None),
        ("https://h.example", "https://h.example", "h.example", "example"),
        ("nothing", None, None, None),
        ("https://other.example/@t.example/x", "https://other.example/@t.example/x", "t.example", None),
    ]
    u = first_url(F.col("x"))
    assert rows(spark, [(c[0],) for c in cases], "x string", u, url_host(u), url_extension(u)) == [c[1:] for c in cases]
    assert rows(spark, [(cases[-1][0],)], "x string", url_host(first_url(F.col("x")), strict=True))[0][0] == "other.example"


def test_disposition_order(spark):
    cases = [("https://h/v1.2/f.json", "versioned URL"), ("https://H/f.json", "trusted host"), ("https://k/f.JSON", "data format URL"), ("https://k/f.proto", "data format URL"), ("https://k/v1/f", None), ("https://k/t-1.2.tgz", None), ("https://k/1.2", None)]
    assert [r[0] for r in rows(spark, [(c[0],) for c in cases], "u string", disposition(F.col("u"), ("h",), (".PROTO",)))] == [c[1] for c in cases]


NEWER = [
    ("v1.0.0", "v1.0.1", True), ("v1.0.1", "v1.0.0", False), ("v1.0.0", "v1.0.0", False), ("v9", "v10", True), ("1.2", "1.2.1", True), ("1.2.1", "1.2", False), ("v1.0.0-rc1", "v1.0.0", True), ("v1.0.0", "v1.0.0-rc1", False),
    ("1.0-a", "1.0-b", False), ("1..3", "1.3", False), ("1.0.0+b-5", "1.0.0", True), ("x", "1", True), ("1", "x", False), ("vv2", "v3", True), ("v1.0+build", "v1.0", False), ("18446744073709551615", "18446744073709551616", False), ("", "0", True), ("1.a.2", "1.2", False),
]


def test_versions(spark):
    got = rows(spark, [(a, b) for a, b, _ in NEWER], "a string, b string", is_newer(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [x for *_, x in NEWER]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.from_regex(r"v{0,2}[0-9]{1,3}(\.[0-9a]{1,2}){0,3}(-[a-z])?", fullmatch=True), min_size=3, max_size=9))
def test_version_order_is_a_total_preorder(spark, tags):
    pairs = [(a, b) for a in tags for b in tags]
    newer = dict(zip(pairs, (r[0] for r in rows(spark, pairs, "a string, b string", is_newer(F.col("a"), F.col("b")))), strict=True))
    for a in tags:
        assert not newer[a, a]
        for b in tags:
            assert not (newer[a, b] and newer[b, a])
            for c in tags:
                if newer[a, b] and newer[b, c]:
                    assert newer[a, c]


def test_split_lines(spark):
    cases = [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb\n\n", ["a", "b", ""]), ("\n", [""]), ("a\rb", ["a\rb"])]
    assert [r[0] for r in rows(spark, [(c[0],) for c in cases], "x string", split_lines(F.col("x")))] == [c[1] for c in cases]
