"""Each stage against a plain version, on documents of the smallest scale."""

import brute
import corpus_pipeline
import pytest

from shoal.llm import toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_stages(spark, docs):
    columns = docs.columns
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, SF)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit_from(spark, SF)).collect()}
    assert ids(clean) == sorted(i for i, _ in texts if scores[i] < 0.5) and clean.columns == columns
    kept = stages["near_duplicates"](spark, docs, SF)
    assert ids(kept) == sorted(i for i, _, c in brute.near_duplicates(texts, 5, 80) if i == c) and kept.columns == columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = stages["decontamination"](spark, docs, SF)
    assert ids(left) == sorted(i for i, _, hit, _ in brute.overlaps(texts, items, 10) if not hit) and left.columns == columns
    mixed = stages["mixing"](spark, docs, SF)
    assert set(ids(mixed)) == {i for i, _ in texts} and mixed.columns == columns
    shards = stages["sharding"](spark, docs, SF)
    assert ids(shards) == sorted(i for i, _ in texts) and shards.columns == [*columns, "shard", "slot"]
    assert max(r["count"] for r in shards.groupBy("shard").count().collect()) - min(r["count"] for r in shards.groupBy("shard").count().collect()) <= 1


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.columns[-2:] == ["shard", "slot"]


def odd_rows(spark, docs):
    """Documents with nulls, empty and long texts, repeated rows and columns whose names the stages use."""
    rows = [tuple(r) for r in docs.limit(40).collect()]
    long = " ".join(f"w{i}" for i in range(60_000))
    rows += [(None, None, None, None, None), (9001, "", "en", "s", 0), (9002, None, "en", None, None), (9003, long, "en", "s", 1), (9004, long + " end", "en", "s", 2), rows[0], rows[0], (9005, "a b", "en", "", 3)]
    names = ["score", "Score_", "row", "_row", "mix_slot", "mix__position", "_s", "_h", "_c0", "n_hit", "label", "a.b"]
    kinds = ", ".join(f"`{n}` int" for n in names)
    return spark.createDataFrame([(*r, *range(i, i + len(names))) for i, r in enumerate(rows)], docs.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", " + kinds)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    odd = odd_rows(spark, docs)
    out = stage(spark, odd, SF)
    assert out.columns[: len(odd.columns)] == odd.columns
    given = {r["_c0"]: tuple(r) for r in odd.collect()}
    got = [tuple(r)[: len(odd.columns)] for r in out.collect()]
    assert all(given[r[odd.columns.index("_c0")]] == r for r in got)  # whole rows, no column overwritten
    kept = {r[odd.columns.index("_c0")] for r in got}
    if name in ("mixing", "sharding"):
        assert kept == set(given)
    if name == "near_duplicates":
        texts = [(i, r[1]) for i, r in sorted(given.items())]
        assert len(got) == len({c for _, _, c in brute.near_duplicates(texts, 5, 80)})
    if name in ("toxicity", "decontamination"):
        wordless = {i for i, r in given.items() if not (r[1] or "").strip()}
        assert wordless <= kept
    nothing = stage(spark, odd.limit(0), SF)
    assert nothing.count() == 0 and nothing.columns == out.columns
