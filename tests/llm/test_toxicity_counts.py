"""What the toxicity model counts and scores: all words, all labelled texts, all kinds of bigrams."""

import random
import re

import brute
import pytest
from pyspark.sql import functions as F

from shoal.llm import toxicity
from shoal.llm.shared import staged

PLAIN = [f"word{i}" for i in range(80)]


def corpus(spark, n, toxic, seed=0):
    """n texts of plain words, toxic(i) the words added to text i if it is toxic, else none."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        t = [rng.choice(PLAIN) for _ in range(rng.randint(5, 40))]
        bad = toxic(i, rng)
        for w in bad:
            t.insert(rng.randrange(len(t)), w)
        docs.append((i, " ".join(t)))
        labels.append((i, int(bool(bad))))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), docs, labels


def scores(spark, model, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["score"] for r in toxicity.score(df, model).orderBy("doc_id").collect()]


def test_words_of_few_toxic_texts_speak(spark):
    df, labels, *_ = corpus(spark, 120, lambda i, rng: ["trash", "scum"] if i % 40 == 0 else [])
    model = toxicity.fit(df, labels)
    trash, mild, new = scores(spark, model, ["word1 word2 trash scum word3", "word1 word2 word4 word5 word3", "word1 word2 never seen word3"])
    assert trash > 1.5 * max(mild, new)


ODD = ["", "...", "trash", "trash", "scum trash never seen scum trash", "new " * 3000 + "trash", "word1", "never seen"]


def found_figures(spark, model, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").withColumn("h", F.xxhash64("text"))
    by = {r["h"]: r["x"] for r in toxicity.figures(df.select("h", "text"), model).collect()}
    return [by[r["h"]] for r in df.orderBy("i").collect()]


@pytest.mark.parametrize("most_local", [toxicity.MOST_LOCAL, 40, 0])
def test_figures_are_those_of_the_formulas(spark, monkeypatch, most_local):
    monkeypatch.setattr(toxicity, "TELLING", 0.05)
    monkeypatch.setattr(toxicity, "TOKENS", 500)
    df, labels, docs, known = corpus(spark, 120, lambda i, rng: ["trash", "scum"] if i % 6 == 0 else [])
    texts = [(c, t) for (_, t), (_, c) in zip(docs, known, strict=True)]
    plain = brute.KneserNey(texts, 0.05)
    for c in (0, 1):
        assert sum(plain.q(c, "word1").values()) == pytest.approx(1)
    found = staged(toxicity.counted(spark.createDataFrame(texts, "cls int, text string")), "counts")
    model = toxicity.estimate(found, plain.share, most_local)
    assert len(model.key) <= most_local and (model.rest is None) == (most_local > 40)
    asked = [t for _, t in docs] + ODD
    want, got = [plain.figure(t) for t in asked], found_figures(spark, model, asked)
    assert [g is None for g in got] == [w is None for w in want]
    assert [g for g in got if g is not None] == pytest.approx([w for w in want if w is not None], abs=1e-6)
    assert len({round(g, 9) for g in got if g is not None}) > 100  # no few scores for many texts


def test_counts_do_not_stop_at_max_docs(spark):
    df, labels, docs, known = corpus(spark, 600, lambda i, rng: [rng.choice(["vile", "rotten", "awful"]) for _ in range(3)] if rng.random() < 0.3 else [])
    model = toxicity.fit(df, labels.where("doc_id % 5 > 0"), max_docs=20)
    held = [i for i in range(600) if i % 5 == 0]
    said = scores(spark, model, [docs[i][1] for i in held])
    assert sum((s >= 0.5) == bool(known[i][1]) for s, i in zip(said, held, strict=True)) > 0.95 * len(held)


def test_kinds_of_bigrams_are_counted(spark):
    df, labels, docs, known = corpus(spark, 60, lambda i, rng: ["trash"] if i % 20 == 0 else [])
    found = toxicity.counted(df.join(labels, "doc_id").selectExpr("toxic as cls", "text"))
    kinds = {(c, p) for (_, t), (_, c) in zip(docs, known, strict=True) for w in [["", *re.findall(r"\w+", t), "."]] for p in zip(w, w[1:])}
    of = toxicity.of_class
    got = found.selectExpr(*[f"sum(if(v is null, {of('f', c)}, cast({of('n', c)} > 0 as double)))" for c in (0, 1)]).first()
    assert tuple(got) == tuple(sum(k[0] == c for k in kinds) for c in (0, 1))
