import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shoal.llm import decontaminate, jaccard_join, line_templates, repeats, shared
from shoal.llm.bytetext import ALNUM, NONSPACE, words


def corpus(seed=0):
    """Texts with copies, near copies, shared passages, repeats, odd characters, nulls and empty ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" if i % 3 else f"Wörd{i}é" for i in range(120)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = make(25)
    docs = [(0, None), (1, ""), (2, " \n\t "), (3, "One two"), (4, "one TWO"), (None, "lonely null id text here"), (5, "x" * 500), (6, "xy" * 300)]
    base = [make(rng.randint(8, 120)) for _ in range(12)]
    for i in range(60):
        t = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            t.insert(rng.randrange(len(t)), passage)
        docs.append((100 - i, rng.choice([" ", "  ", ", "]).join(t)))
    docs += [(docs[20][0], docs[20][1]), (docs[21][0], "another text under an id that is there"), (None, docs[22][1]), (200, make(4000)), (201, make(4000))]
    return docs


def frame(spark, docs):
    """With columns whose names the operators use inside."""
    rows = [(i, t, "k", 1.0, 2, b"x") for i, t in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, score double, n int, spans binary").repartition(3)


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize(("table", "pattern"), [(ALNUM, brute.ALNUM), (NONSPACE, brute.NONSPACE)])
@pytest.mark.parametrize("chunk", [1, 1000, 1 << 20])
def test_words(table, pattern, chunk):
    texts = [t for _, t in corpus()]
    found, names = [], {}
    for part in words(pa.array(texts), table, chunk):
        found += [part.hash[a:b].tolist() for a, b in zip(part.first[:-1], part.first[1:])]
    want = [brute.words(t, pattern) for t in texts]
    assert [len(x) for x in found] == [len(x) for x in want]
    for f, w in zip(found, want):
        for h, x in zip(f, w):
            assert names.setdefault(x, h) == h
    assert len(set(names.values())) == len(names)


@pytest.mark.parametrize(("width", "percent", "seed"), [(3, 90, 0), (5, 80, 1), (1, 100, 2), (2, 50, 3)])
def test_near_duplicates(spark, width, percent, seed):
    docs = corpus(seed)
    out = jaccard_join.near_duplicates(frame(spark, docs), width=width, percent=percent)
    assert got(out, "doc_id", "n_shingles", "component_id") == brute.near_duplicates(docs, width, percent)


def test_near_duplicates_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    docs = corpus(5)
    assert got(jaccard_join.near_duplicates(frame(spark, docs)), "doc_id", "n_shingles", "component_id") == brute.near_duplicates(docs, 3, 90)


def sets_asked(monkeypatch):
    """How many sets each call of sets_of() asks for."""
    sets_of, asked = jaccard_join.sets_of, []

    def counting(docs, nodes, width):
        asked.append(nodes.count())
        return sets_of(docs, nodes, width)

    monkeypatch.setattr(jaccard_join, "sets_of", counting)
    return asked


def test_sets_travel_in_rounds_and_staged_tables_go(spark, monkeypatch, tmp_path):
    for name, value in (("ROUND_BYTES", 40_000), ("ROUND_SHARE", 0), ("SHORT", 3), ("BLOCK", 3)):
        monkeypatch.setattr(jaccard_join, name, value, raising=False)
    monkeypatch.setattr(shared, "shared_dir", lambda spark: f"file://{tmp_path}")
    asked = sets_asked(monkeypatch)
    docs = [d for d in corpus(4) if d[0] is not None]
    assert got(jaccard_join.near_duplicates(frame(spark, docs), width=2, percent=70), "doc_id", "n_shingles", "component_id") == brute.near_duplicates(docs, 2, 70)
    assert len(asked) >= 3 and max(asked) <= sum(asked) / 2
    assert not {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()} & {"classes", "listed", "entries", "postings", "stars", "open", "sets"}


def test_sets_of_unlike_texts_do_not_travel(spark, monkeypatch):
    """Texts that share two of three passages, far from enough: sketches tell, hardly a whole set is asked for."""
    asked = sets_asked(monkeypatch)
    passage = lambda i: " ".join(f"p{i}x{j}" for j in range(60))
    docs = [(i, " ".join(passage(j) for j in (i, i + 1, i + 2))) for i in range(60)]
    assert got(jaccard_join.near_duplicates(frame(spark, docs), width=2, percent=90), "doc_id", "n_shingles", "component_id") == brute.near_duplicates(docs, 2, 90)
    assert sum(asked) <= len(docs) / 4


def test_sketches_lose_no_link():
    rng = np.random.default_rng(9)
    for n in [1, 2, 3, 4, 7, 8, 60, 500, 3000] * 20:
        every = np.unique(rng.integers(0, 1 << 64, 2 * n, np.uint64) >> np.uint64(rng.choice([0, 3])))
        s, t = (np.sort(rng.choice(every, min(len(every), m), replace=False)) for m in (n, n + n // 8))
        if rng.random() < 0.7:
            t = np.unique(np.append(s[len(s) // 10 :], t[: len(t) // 10]))
        a, b = (np.frombuffer(jaccard_join.sketch(x), np.uint8) for x in (s, t))
        same = len(np.intersect1d(s, t))
        for percent in (50, 80, 90, 100):
            assert jaccard_join.may_reach(a, b, percent) or 100 * same < percent * (len(s) + len(t) - same)
    assert jaccard_join.sketch(np.zeros(2000, np.uint64)) == b""


@pytest.mark.parametrize("short, block, width, percent", [(2, 2, 2, 70), (3, 500, 3, 90), (1000, 3, 1, 60)])
def test_near_duplicates_of_short_and_long_lists(spark, monkeypatch, short, block, width, percent):
    monkeypatch.setattr(jaccard_join, "SHORT", short)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    docs = [d for d in corpus(4) if d[0] is not None]
    assert got(jaccard_join.near_duplicates(frame(spark, docs), width=width, percent=percent), "doc_id", "n_shingles", "component_id") == brute.near_duplicates(docs, width, percent)


def test_chained_lists_send_no_blocks_of_sets(spark, monkeypatch, tmp_path):
    """Texts that only chance shingles chain together: their sets must not meet in every pair of blocks."""
    compare = jaccard_join.compare_blocks

    def counting(percent):
        run, path = compare(percent), str(tmp_path / "rows")

        def counted(key, t):
            with open(path, "a") as f:
                f.write(f"{t.num_rows}\n")
            return run(key, t)

        return counted

    monkeypatch.setattr(jaccard_join, "compare_blocks", counting)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    cut = lambda i, k: " ".join(f"p{i}x{k}x{j}" for j in range(10))
    docs = [(i, " ".join(cut(j, k) for j in (i, i + 1, i + 2) for k in range(2))) for i in range(160)]
    assert got(jaccard_join.near_duplicates(frame(spark, docs)), "doc_id", "n_shingles", "component_id") == brute.near_duplicates(docs, 3, 90)
    rows = sum(map(int, (tmp_path / "rows").read_text().split())) if (tmp_path / "rows").exists() else 0
    assert rows <= 4 * len(docs)


def test_keep_one(spark):
    docs = [(i, t) for i, t in corpus(4)]
    kept = jaccard_join.keep_one(frame(spark, docs), width=5, percent=80)
    assert kept.columns == ["doc_id", "text", "key", "score", "n", "spans"]
    numbered = list(enumerate(t for _, t in docs))
    want = len({c for _, _, c in brute.near_duplicates(numbered, 5, 80)})
    assert kept.count() == want


def test_overlaps():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 50, rng.integers(0, 40)).astype(np.uint64)) for _ in range(9)]
    assert jaccard_join.overlaps(sets[:4], sets[4:]).tolist() == [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]


def benchmark_of(docs):
    texts = [t for _, t in docs if t and len(t) > 300]
    return [(1, " ".join(texts[0].split()[2:20])), (2, texts[1].upper()), ("2", "again " + texts[1]), (3, None), (4, ""), (5, "w1"), (6, "one, two"), (None, texts[2]), (7, "never seen anywhere at all in these texts here " * 3)]


@pytest.mark.parametrize("block", [8 << 20, 200])
def test_overlaps_with_items(spark, block):
    docs = corpus(6)
    items = benchmark_of(docs)
    bench = spark.createDataFrame([(None if i is None else str(i), t) for i, t in items], "item_id string, text string")
    out = decontaminate.find_overlaps(frame(spark, docs), bench, block_bytes=block)
    assert got(out, "_c0", "n_words", "n_hit", "items") == brute.overlaps(docs, items, 10)
    for r in out.where("longest_words is not null").select("_c1", "longest_words", "longest_at", "longest_item").collect():
        run = brute.words(r[0], brute.ALNUM)[r[2] : r[2] + r[1]]
        texts = [" ".join(brute.words(t, brute.ALNUM)) for i, t in items if t and (str(i) if i is not None else None) == r[3]]
        assert any(" ".join(run) in t for t in texts)
    found = {r["_c1"]: (r["longest_words"], r["longest_at"]) for r in out.collect() if r["longest_words"] is not None}
    assert found == {t: m for _, t in docs if (m := brute.longest(t, items, 10))}


def test_items_that_share_a_window(spark):
    preamble = "answer the next question with one of the given letters"
    bench = spark.createDataFrame([(str(i), f"{preamble} q{i} r{i}") for i in range(2000)], "item_id string, text string")
    docs = [(1, f"{preamble} . " * 1000), (2, f"x {preamble} q7 r7 {preamble}"), (3, "none of it")]
    placed = decontaminate.search(*[(p.hash, p.first) for p in decontaminate.words(pa.array([t for _, t in docs]), decontaminate.ALNUM)][0], decontaminate.Suffixes([f"{preamble} q{i} r{i}" for i in range(2000)], [str(i) for i in range(2000)], 10))
    assert len(placed[0]) == 1000 + 4  # places and distinct windows, not items
    out = {r["_c0"]: r for r in decontaminate.find_overlaps(frame(spark, docs), bench).collect()}
    assert [len(out[i]["items"]) for i in (1, 2, 3)] == [2000, 2000, 0]
    assert (out[2]["longest_words"], out[2]["longest_at"], out[2]["longest_item"]) == (12, 1, "7")


def test_remove_contaminated(spark):
    docs = corpus(6)
    bench = spark.createDataFrame([("a", benchmark_of(docs)[1][1])], "item_id string, text string")
    left = decontaminate.remove_contaminated(frame(spark, docs), bench)
    clean = [i for i, _, hit, _ in brute.overlaps(docs, [("a", benchmark_of(docs)[1][1])], 10) if not hit]
    assert sorted(map(repr, clean)) == sorted(repr(r[0]) for r in left.select("doc_id").collect()) and left.columns[1] == "text"


@pytest.mark.parametrize(("seed", "copies", "often"), [(0, 100, 4096), (1, -1, 2), (2, 100, 3)])
def test_repeats(spark, monkeypatch, seed, copies, often):
    monkeypatch.setattr(repeats, "OFTEN", often)
    monkeypatch.setattr(repeats, "COPIES", copies)
    monkeypatch.setattr(repeats, "SLICE", 50)
    docs = corpus(seed)
    out = repeats.find_repeats(frame(spark, docs))
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeats(docs, 50)


def test_repeats_small_windows(spark):
    docs = corpus(3)
    out = repeats.find_repeats(frame(spark, docs), window=20, gram=8)
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeats(docs, 20)


def log_docs():
    rng = random.Random(1)
    out = [(0, None), (1, ""), (2, "\n\n")]
    for i in range(40):
        out.append((10 + i, "\n".join([f"user {rng.choice('abcdefgh')}x logged in from 10.0.0.{i}", f"own line of document number d{'abcdefghij'[i % 10] * (i + 1)}", "All rights reserved." if i % 2 else "  All\trights   reserved. ", f"the quick brown {rng.choice(['fox', 'dog', 'cat'])} jumps over {i}", ""])))
    return out


@pytest.mark.parametrize("docs", [log_docs(), corpus(0)[:-4]], ids=["log", "prose"])
def test_templates(spark, docs):
    docs = [d for d in docs if d[0] is not None]
    out = line_templates.drop_templates(frame(spark, docs), min_docs=5)
    assert got(out, "doc_id", "n_lines", "n_dropped", "kept_text") == brute.templates(docs, 5)


def test_templates_run_no_python(spark):
    plan = line_templates.drop_templates(frame(spark, log_docs()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_tables(spark):
    none = frame(spark, []).coalesce(1)
    bench = spark.createDataFrame([], "item_id string, text string")
    some = frame(spark, [(1, "a b c")])
    assert jaccard_join.near_duplicates(none).count() == 0
    assert repeats.find_repeats(none).count() == 0
    assert line_templates.drop_templates(none).count() == 0
    assert decontaminate.find_overlaps(none, bench).count() == 0
    assert got(decontaminate.find_overlaps(some, bench), "n_words", "n_hit") == [(3, 0)]
    assert jaccard_join.keep_one(none).count() == 0
