import subprocess
import sys

import __spark_entry__ as e
import pytest

from shoal.plans import catalog


def test_entry(spark):
    assert e.entry(spark).limit(1).count() == 1


def test_names():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.SQL) == set(catalog.QUERIES)


@pytest.mark.parametrize("name", ["repo_score", "shell_scan", "version_max", "lookahead_lines", "logical_commands", "rule_hits", "pin_plan", "pin_status", "update_plan", "rewrite_files", "action_status", "action_findings", "clean_commits", "corpus_score", "ref_classify", "pin_lines"])
def test_against_sql(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    for t in ("lineitem", "pages", "part", "orders", "events"):
        duckdb.sql(f"create or replace view {t} as select * from '{d}/{t}.parquet'")
    want = duckdb.sql(catalog.SQL[name])
    got = catalog.QUERIES[name](spark, d).select(*want.columns).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want.fetchall()))


def test_nothing_but_the_entry_knows_the_corpus_operators():
    code = "import sys, shoal, shoal.plans.catalog, shoal.operators.score, shoal.sinks.reports; assert not any('llm' in m for m in sys.modules if m.startswith('shoal'))"
    assert subprocess.run([sys.executable, "-c", code], cwd=e.__file__.rsplit("/", 1)[0], capture_output=True).returncode == 0
