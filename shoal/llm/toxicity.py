"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary texts, share their back-off. Counts are counts of texts. A
text is START, its words, END; all but START are predicted, so that every word is a context once.

Words. The vocabulary is every word found in two or more texts; all others are the unknown word, which
keeps their kinds of bigrams. p(w), the share of all kinds of bigrams that end in w, is common to both
classes. A class's own share discounts its kinds by DISCOUNT and gives what that frees to p. How far w
keeps its class's own share is s(w), the probability (TELLING before any count) that its texts are
divided between the classes at a rate of their own rather than as all texts are. So a rare word speaks
little, one whose texts are many and all toxic speaks fully, and none is left out.

Bigrams. q(w|v) discounts the texts of both classes that hold vw and gives the rest to p(w); a class's
own model does the same with its texts and its word shares. s(vw) says again how far the class's own
model counts; a bigram of one text gives its whole count to the back-off. Both levels are normalised:
for every context the probabilities of all words, the unknown one and END add up to one.

A text's figure is the difference of its two log-likelihoods over the number of its predictions; a
logistic curve, fitted on labelled texts that the counts have not seen, turns it into a score.

Counts come from all labelled texts (of equal texts of a class one) but those kept for the curve: of
each class a fifth by a hash of the id, `max_docs` at most. A first pass finds which words and bigrams
are in two texts, four bytes each; of the others only the sums that words and contexts need are
shuffled. Scoring looks up the words and bigrams of the most texts, at most `most_local`, in a table that
every task has, so that frequent ones are shuffled neither there nor by the texts; the rest are dealt
out by their hash to slices of the table that stays distributed, packed with the texts they are in.
There are at least as many slices as tasks that read texts.

Bigrams and texts are told apart by 64-bit hashes, words by 48 bits, and what is looked up within a slice
by the KEY_BITS after its own. Texts without words (null, empty, only
punctuation) get the score of figure 0. Labels other than 0 and 1 and rows with a null id are not
learnt from; an id labelled twice counts as toxic if one label says so; rows with equal ids are texts
of their own. Where the labels hold one class only, or none, all texts get that class's or a low score.
Columns of any name pass through; one with the score's name is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm.bytetext import ALNUM, BASE, Words, mix, words
from shoal.llm.shared import free_shuffles, marked, of_planes, planes, repeated_bits, staged, tune

MAX_DOCS, DISCOUNT, TELLING = 10_000, 0.75, 1e-4
#: Hashes that stand for the ends of a text and for the unknown word.
WORD = np.uint64(0xFFFFFFFFFFFF0000)
START, END, UNKNOWN = (np.uint64(x) for x in (0x9A3F5C17E2B80000, 0x5D17B0C94E6F0000, 0xC6E8213B7F900000))
#: Entries that every task has (12 bytes each), rows that may be sent to all tasks (16 bytes each).
MOST_LOCAL, MOST_ROWS = 4_000_000, 1_000_000
#: Tokens that are packed at once, entries of one slice of the table, bits of a hash within its slice.
TOKENS, SLICE, KEY_BITS = 500_000, 200_000, 48
#: Bits of the table that tells which words and bigrams are not in the distributed one.
BITS = 25


class Model(NamedTuple):
    key: np.ndarray  # sorted hashes of the words and bigrams of the most texts and
    value: np.ndarray  # what each adds to a text's log-likelihood ratio
    rest: DataFrame | None  # (key, value) of all others, None if there are none
    maybe: np.ndarray | None  # bitmap over their low bits
    n_rest: int
    unknown: float  # what any prediction adds, known or not
    size: tuple[int, int]  # words and bigrams
    curve: tuple[float, float]  # slope and intercept


def find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each h stands in the sorted keys, and whether it does."""
    if not len(keys):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


def sequences(part: Words) -> tuple[np.ndarray, np.ndarray]:
    """START, words, END of each text that has words, one after another; and the text of each. Of a word's
    hash the first 48 bits count."""
    n = np.diff(part.first)
    size = np.where(n > 0, n + 2, 0)
    end = np.cumsum(size)
    begin = end - size
    out = np.empty(int(size.sum()), np.uint64)
    out[np.repeat(begin + 1 - part.first[:-1], n) + np.arange(len(part.hash))] = part.hash & WORD
    out[begin[n > 0]], out[end[n > 0] - 1] = START, END
    return out, np.repeat(np.arange(len(n)), size)


def bigrams(token: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each token and its successor within the text, and where these stand."""
    at = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, np.int64)
    return mix(token[at] * np.uint64(BASE) + token[at + 1]), at


def distinct(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each pair of key and document stands first, by key, and how often the pair occurs."""
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    return order[new], np.diff(np.append(np.flatnonzero(new), len(k)))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x of 1 and more, by Stirling's series from x + 8 on."""
    y = x + 8.0
    out = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3)
    for i in range(8):
        out = out - np.log(x + i)
    return out


def telling(n0: np.ndarray, n1: np.ndarray, share: np.ndarray | float) -> np.ndarray:
    """Probability that of n0 + n1 texts n1 are toxic at an unknown rate, not at the rate share."""
    even = n1 * np.log(share) + n0 * np.log1p(-share)
    apart = log_gamma(n1 + 1.0) + log_gamma(n0 + 1.0) - log_gamma(n0 + n1 + 2.0)
    return 1 / (1 + np.exp(-np.clip(apart - even + np.log(TELLING / (1 - TELLING)), -40, 40)))


class Totals(NamedTuple):
    kinds: tuple[float, float, float]  # of bigrams: in each class, in both together
    types: tuple[float, float]  # words of the vocabulary, the unknown one too, that end a bigram of the class
    share: float  # of the texts the toxic ones


def word_ratios(d: dict[str, np.ndarray], t: Totals) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """p and each class's share over p, not yet normalised. d: texts n0, n1 and kinds f0, f1, f of bigrams
    that end in the word; one that ends none has p = 0 and ratios of 1."""
    p = d["f"] / max(1.0, t.kinds[2])
    s = telling(d["n0"], d["n1"], t.share)
    r = []
    for c in (0, 1):
        own = np.maximum(d[f"f{c}"] - DISCOUNT, 0) / np.where(p > 0, p, 1.0)
        r.append(np.where((p > 0) & (t.kinds[c] > 0), (1 - s) + s * (own + DISCOUNT * t.types[c]) / max(1.0, t.kinds[c]), 1.0))
    return p, r[0], r[1]


def pair_values(d: dict[str, np.ndarray], share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a bigram adds beyond its last word, and its probability in each class, not yet normalised.
    d: texts n0, n1; the last word's p and normalised ratios r0, r1; of the context all texts t0, t1 and
    what its bigrams keep of them after the discount, o0, o1, and o of both together."""
    odds = share * d["r1"] / ((1 - share) * d["r0"])
    s = telling(d["n0"], d["n1"], np.clip(odds / (1 + odds), 1e-9, 1 - 1e-9))
    t = d["t0"] + d["t1"]
    back = (d["n0"] + d["n1"] - DISCOUNT + (t - d["o"]) * d["p"]) / t
    q = []
    for c in (0, 1):
        low, tc = d["p"] * d[f"r{c}"], d[f"t{c}"]
        own = np.where(tc > 0, (np.maximum(d[f"n{c}"] - DISCOUNT, 0) + (tc - d[f"o{c}"]) * low) / np.maximum(tc, 1), low)
        q.append((1 - s) * back * d[f"r{c}"] + s * own)
    return np.log(q[1] / q[0]) - np.log(d["r1"] / d["r0"]), q[0], q[1]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a little ridge."""
    if not len(y) or y.min() == y.max():
        return (1.0, -20.0 if not len(y) or y.max() == 0 else 20.0)
    scale = max(1e-9, x.std())
    design = np.stack([x / scale, np.ones(len(x))], 1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        g = design.T @ (weight * (p - y)) + 1e-2 * b
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2), g)
        b -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(b[0] / scale), float(b[1])


def columns(df: DataFrame) -> dict[str, np.ndarray]:
    """A bounded result as arrays; long columns that hold hashes come as they are."""
    return {c: x.to_numpy() for c, x in zip(df.columns, df.toArrow().combine_chunks().itercolumns(), strict=True)}


def arrays(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {n: x.to_numpy(zero_copy_only=False).astype(float) for n, x in zip(b.schema.names, b.columns, strict=True)}


def few(df: DataFrame, n: int, most: int = MOST_ROWS) -> DataFrame:
    """df, of n rows, sent to all tasks by a join if they are few."""
    return F.broadcast(df) if n <= most else df


#: Two counts of the two classes in one long, the toxic one's above; they add up as such.
BOTH = 1 << 32


def of_class(column: str, c: int) -> str:
    return f"cast({column} div {BOTH} as double)" if c else f"cast({column} % {BOTH} as double)"


def counted(texts: DataFrame) -> DataFrame:
    """(v, w, n, f, t) from (cls, text), each with the counts of both classes (BOTH). Rows with v: n texts that
    hold the bigram, of bigrams that may be in two. Rows without: n texts that hold the word, and over all
    other bigrams f kinds that end in it and t texts that have it as context; UNKNOWN sums up the words
    of one text."""

    def hashes(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in words(b.column("text"), ALNUM):
            token, doc = sequences(part)
            pair, at = bigrams(token, doc)
            for key, of in ((mix(token), doc), (pair, doc[at])):
                yield key[distinct(key, of)[0]]

    twice = texts.sparkSession.sparkContext.broadcast(repeated_bits(texts.select("text"), hashes))
    bits = max(5, math.ceil(math.log2(max(1, texts.rdd.getNumPartitions()))) + 2)

    def send(kind: int, have: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        rows = summed(2 - kind, [np.concatenate(x) for x in zip(*have, strict=True)])
        radix = (mix(rows[0] * np.uint64(BASE) + rows[1]) if kind == 0 else rows[0]) >> np.uint64(64 - bits)
        order = np.argsort(radix, kind="stable")
        rows, cut = [x[order] for x in rows], np.searchsorted(radix[order], np.arange((1 << bits) + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(cut))
        raw = [b"".join(planes(x[cut[r] : cut[r + 1]], in_order=not i) for i, x in enumerate(rows)) for r in some]
        blobs = [pa.compress(x, codec="zstd", asbytes=True) for x in raw]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), kind, np.int32)), pa.array(np.diff(cut)[some]), pa.array([len(x) for x in raw], pa.int64()), pa.array(blobs, pa.binary())], names=["radix", "kind", "rows", "size", "blob"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: tuple[list, list] = ([], [])  # bigrams (v, w, n), words (w, n, f, t)
        for b in batches:
            toxic = b.column("cls").to_numpy() == 1
            for part in words(b.column("text"), ALNUM):
                token, doc = sequences(part)
                if not len(token):
                    continue
                pair, at = bigrams(token, doc)
                cls = np.where(toxic[doc + part.low], BOTH, 1)
                one, _ = distinct(pair, doc[at])
                known = marked(twice.value, pair[one])
                again, single = at[one[known]], at[one[~known]]
                have[0].append((token[again], token[again + 1], cls[again]))
                name = np.where(marked(twice.value, mix(token)) | (token == START) | (token == END), token, UNKNOWN)
                once, _ = distinct(token, doc)
                nothing = [np.zeros(len(x), np.int64) for x in (once, single, single)]
                have[1].append((name[once], cls[once], nothing[0], nothing[0]))
                have[1].append((name[single + 1], nothing[1], cls[single], nothing[1]))
                have[1].append((name[single], nothing[1], nothing[1], cls[single]))
            for kind, x in enumerate(have):
                if sum(len(y[0]) for y in x) > TOKENS:
                    yield send(kind, x)
                    x.clear()
        for kind, x in enumerate(have):
            if x:
                yield send(kind, x)

    def settle(_: tuple, t: pa.Table) -> pa.Table:
        out = []
        for kind in (0, 1):
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for k, rows, size, blob in zip(*(t.column(c).to_pylist() for c in ("kind", "rows", "size")), t.column("blob"), strict=True):
                if k == kind:
                    raw = pa.decompress(blob.as_buffer(), size, codec="zstd")
                    for i in range(size // (8 * rows)):
                        cols[i].append(of_planes(raw, np.uint64 if i < 2 - kind else np.int64, rows, 8 * rows * i, in_order=not i))
            if not cols[0]:
                continue
            x = summed(2 - kind, [np.concatenate(c) for c in cols if c])
            x = [pa.array(y.view(np.int64)) for y in x]
            none = pa.nulls(len(x[0]), pa.int64())
            zero = pa.array(np.zeros(len(x[0]), np.int64))
            out.append(pa.table(dict(zip(("v", "w", "n", "f", "t"), (*x, zero, zero) if kind == 0 else (none, *x), strict=True))))
        return pa.concat_tables(out)

    found = texts.mapInArrow(count, "radix int, kind int, rows long, size long, blob binary")
    return found.groupBy("radix").applyInArrow(settle, "v long, w long, n long, f long, t long")


def summed(keys: int, columns: list[np.ndarray]) -> list[np.ndarray]:
    """The rows with equal first columns, `keys` of them, summed up in the others; in the order of these."""
    order = np.lexsort(columns[:keys][::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns[:keys]], axis=0)
    first = np.flatnonzero(new)
    return [c[first] for c in columns[:keys]] + [np.add.reduceat(c, first) if len(first) else c for c in columns[keys:]]


def estimate(found: DataFrame, share: float, most_local: int = MOST_LOCAL) -> Model:
    """found: counted(), staged; share: of the counted texts the toxic ones."""
    pairs = found.where("v is not null").select("v", "w", "n")
    one = [f"cast({of_class('n', c)} > 0 as long)" for c in (0, 1)]
    again = f"n % {BOTH} + n div {BOTH} > 1"
    # Of the bigrams that a word is the context of: texts t; of those in two texts or more texts a, kinds in each class ak and in both together.
    parts = [
        found.where("v is null").selectExpr("w", "n", "f", f"f % {BOTH} + f div {BOTH} as g", "t", "0L as a", "0L as ak", "0L as kinds"),
        pairs.selectExpr("w", "0L", f"{one[0]} + {one[1]} * {BOTH}", "1L", "0L", "0L", "0L", "0L"),
        pairs.selectExpr("v", "0L", "0L", "0L", "n", f"if({again}, n, 0L)", f"if({again}, {one[0]} + {one[1]} * {BOTH}, 0L)", f"cast({again} as long)"),
    ]
    every = parts[0].union(parts[1]).union(parts[2])
    per_word = every.groupBy("w").agg(*[F.sum(c).alias(c) for c in every.columns[1:]])
    split = [f"{of_class(x, c)} as {x}{c}" for x in ("n", "f", "t") for c in (0, 1)] + ["cast(g as double) as f"]
    kept = [f"{of_class('a', c)} - {DISCOUNT} * {of_class('ak', c)} as o{c}" for c in (0, 1)] + [f"{of_class('a', 0)} + {of_class('a', 1)} - {DISCOUNT} * kinds as o"]
    per_word = staged(per_word.selectExpr("w", *split, *kept), "toxic-words")
    known = per_word.where(f"w <> {int(UNKNOWN.view(np.int64))} and n0 + n1 > 1")
    kinds = [float(x or 0) for x in per_word.agg(F.sum("f0"), F.sum("f1"), F.sum("f")).first()]
    own = known.agg(F.sum("f0"), F.sum("f1"), F.sum("f"), F.count_if(F.col("f0") > 0), F.count_if(F.col("f1") > 0), F.count("*")).first()
    apart = max(0.5, kinds[2] - float(own[2] or 0))  # kinds that end in the unknown word
    totals = Totals((kinds[0], kinds[1], float(own[2] or 0) + apart), tuple(float(own[3 + c] + (kinds[c] > float(own[c] or 0))) for c in (0, 1)), share)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, r0, r1 = word_ratios(arrays(b.select(["n0", "n1", "f0", "f1", "f"])), totals)
            key = pa.array(mix(b.column("w").to_numpy().view(np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.select(["w", "n", "t0", "t1", "o0", "o1", "o"]).columns, key, *map(pa.array, (p, r0, r1))], names=["w", "n", "t0", "t1", "o0", "o1", "o", "key", "p", "r0", "r1"])

    rated = known.select("*", (F.col("n0") + F.col("n1")).cast("long").alias("n")).mapInArrow(rate, "w long, n long, t0 double, t1 double, o0 double, o1 double, o double, key long, p double, r0 double, r1 double")
    rated = staged(rated, "toxic-ratios")
    sums = rated.agg(F.sum(F.expr("p * r0")), F.sum(F.expr("p * r1"))).first()
    norm = [float(x or 0) + apart / totals.kinds[2] for x in sums]
    rated = rated.withColumn("r0", F.col("r0") / norm[0]).withColumn("r1", F.col("r1") / norm[1])
    joined = pairs.where(again).join(rated.select("w", "p", "r0", "r1"), "w").join(rated.select(F.col("w").alias("v"), "t0", "t1", "o0", "o1", "o"), "v")
    joined = joined.selectExpr("*", *[f"{of_class('n', c)} as n{c}" for c in (0, 1)])

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = arrays(b.drop_columns(["v", "w", "n"]))
            v, w = (b.column(c).to_numpy().view(np.uint64) for c in ("v", "w"))
            key = mix(v * np.uint64(BASE) + w).view(np.int64)
            x, *q = pair_values(d, share)
            parts = (x.astype(np.float32) for x in (*q, d["p"] * d["r0"], d["p"] * d["r1"]))
            yield pa.RecordBatch.from_arrays([b.column("v"), *map(pa.array, (key, (d["n0"] + d["n1"]).astype(np.int64), x, *parts))], names=["v", "key", "n", "value", "q0", "q1", "b0", "b1"])

    valued = staged(joined.mapInArrow(value, "v long, key long, n long, value double, q0 float, q1 float, b0 float, b1 float"), "toxic-pairs")
    # What a context's bigrams have, and what its back-off gives to all other words, add up to z.
    context = valued.groupBy("v").agg(*[F.sum(c).alias(c) for c in ("q0", "q1", "b0", "b1")])
    z = [F.col(f"q{c}") + (1 - F.try_divide("o", F.col("t0") + F.col("t1"))) * (1 - F.col(f"b{c}")) for c in (0, 1)]
    unknown = math.log(norm[0] / norm[1])
    ends = rated.join(context.withColumnRenamed("v", "w"), "w", "left")
    ends = ends.select("key", "n", (F.when(F.col("p") > 0, F.log(F.col("r1") / F.col("r0")) - F.lit(unknown)).otherwise(0.0) - F.coalesce(F.log(z[1] / z[0]), F.lit(0.0))).alias("value"))
    ends = staged(ends, "toxic-ends")
    free_shuffles(found.sparkSession)
    table = ends.unionByName(valued.select("key", "n", "value"))
    rank = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(((r["rank"], r["count"]) for r in table.groupBy(rank.alias("rank")).count().collect()), reverse=True)
    total, least, held = sum(n for _, n in sizes), 1 << 30, 0
    for r, n in sizes:
        if held + n > most_local:
            break
        held, least = held + n, r
    got = columns(table.where(rank >= least).select("key", "value"))
    key = got["key"].astype(np.int64).view(np.uint64)
    order = np.argsort(key)
    rest = maybe = None
    if total > held:
        rest = table.where(rank < least).select("key", "value")
        place = F.col("key").bitwiseAND(F.lit((1 << BITS) - 1))
        bits = columns(rest.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("bits")))
        maybe = np.zeros(1 << (BITS - 6), np.int64)
        maybe[bits["at"].astype(np.int64)] = bits["bits"]
        maybe = maybe.view(np.uint64)
    return Model(key[order], got["value"].astype(np.float32)[order], rest, maybe, total - held, unknown, (int(own[5]), total - int(own[5])), (1.0, 0.0))


def cut_key(key: np.ndarray, slices: int) -> np.ndarray:
    """The KEY_BITS bits behind those that say the slice."""
    return key << np.uint64(slices) >> np.uint64(64 - KEY_BITS)


def packed(token: list[np.ndarray], doc: list[np.ndarray], text: np.ndarray, slices: int) -> pa.RecordBatch:
    """(radix, size, blob) of keys and the texts they are in, for each slice that some fall into; keys are
    cut to the KEY_BITS that follow the slice's."""
    key, of = np.concatenate(token), np.concatenate(doc)
    one, often = distinct(key, of)
    key, of = key[one], of[one]
    radix = (key >> np.uint64(64 - slices)).astype(np.int64)
    cut = np.searchsorted(radix, np.arange((1 << slices) + 1))
    some = np.flatnonzero(np.diff(cut))
    size, blobs = [], []
    for r in some.tolist():
        part = slice(cut[r], cut[r + 1])
        first = np.flatnonzero(np.append(True, key[part][1:] != key[part][:-1]))
        names, at = np.unique(of[part], return_inverse=True)
        n = np.diff(np.append(first, cut[r + 1] - cut[r]))
        raw = b"".join((np.array([len(first), len(names), len(at)], np.int64).tobytes(), planes(cut_key(key[part][first], slices), in_order=True), text[names].tobytes(), *(planes(x.astype(np.uint32)) for x in (n, at, often[part]))))
        size.append(len(raw)), blobs.append(pa.compress(raw, codec="zstd", asbytes=True))
    nothing = [pa.nulls(len(some), k) for k in (pa.int64(), pa.float64(), pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(size, pa.int64()), pa.array(blobs, pa.binary()), *nothing], names=["radix", "size", "blob", "h", "x", "n"])


def unpacked(blob: pa.Scalar, size: int, key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a blob, and what the values of its keys add up to in each. key: sorted, cut likewise."""
    raw = pa.decompress(blob.as_buffer(), size, codec="zstd")
    n_keys, n_texts, n = np.frombuffer(raw, np.int64, 3).tolist()
    asked = of_planes(raw, np.uint64, n_keys, 24, in_order=True)
    text = np.frombuffer(raw, np.int64, n_texts, 24 + 8 * n_keys)
    begin, out = 24 + 8 * (n_keys + n_texts), []
    for m in (n_keys, n, n):
        out.append(of_planes(raw, np.uint32, m, begin))
        begin += 4 * m
    each, at, often = out
    spot, ok = find(key, asked)
    x = np.where(ok, value[spot], 0.0) if len(key) else np.zeros(n_keys)
    return text, np.bincount(at, np.repeat(x, each) * often, n_texts)


def figures(texts: DataFrame, m: Model) -> DataFrame:
    """(h, x) of each distinct hash of a text: difference of the log-likelihoods over the number of
    predictions, null without words. texts: h, text."""
    table = texts.sparkSession.sparkContext.broadcast((m.key, m.value, m.maybe))
    unknown = m.unknown
    slices = max(3, math.ceil(math.log2(max(1, m.n_rest / SLICE, texts.rdd.getNumPartitions()))))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, value, maybe = table.value
        names, token, doc = [], [], []
        for b in batches:
            h = b.column("h").to_numpy()
            for part in words(b.column("text"), ALNUM):
                t, of = sequences(part)
                pair, at = bigrams(t, of)
                asked, of = np.concatenate([mix(t), pair]), np.concatenate([of, of[at]])
                spot, ok = find(key, asked)
                n = np.diff(part.first)
                n = n + (n > 0)
                x = unknown * n
                if len(key):
                    x += np.bincount(of[ok], value[spot[ok]], len(n))
                here = h[part.low : part.high]
                nothing = [pa.nulls(len(n), k) for k in (pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array((here & ((1 << slices) - 1)).astype(np.int32)), *nothing, pa.array(here), pa.array(x), pa.array(n)], names=["radix", "size", "blob", "h", "x", "n"])
                if maybe is not None:
                    place = asked & np.uint64((1 << BITS) - 1)
                    some = ~ok & ((maybe[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1)
                    token.append(asked[some]), doc.append(of[some] + sum(map(len, names)))
                    names.append(here)
            if sum(map(len, token)) > TOKENS:
                yield packed(token, doc, np.concatenate(names), slices)
                names, token, doc = [], [], []
        if names:
            yield packed(token, doc, np.concatenate(names), slices)

    sent = texts.mapInArrow(emit, "radix int, size long, blob binary, h long, x double, n long")
    if m.rest is not None:
        rest = m.rest.withColumn("radix", F.shiftrightunsigned("key", 64 - slices).cast("int"))

        def answer(_: tuple, asked: pa.Table, rest: pa.Table) -> pa.Table:
            key = cut_key(rest.column("key").to_numpy().view(np.uint64), slices)
            order = np.argsort(key)
            key, value = key[order], rest.column("value").to_numpy()[order]
            own = asked.filter(pc.is_null(asked.column("blob"))).select(["h", "x", "n"])
            asked = asked.filter(pc.is_valid(asked.column("blob")))
            got = [own]
            for blob, size in zip(asked.column("blob"), asked.column("size").to_pylist(), strict=True):
                h, x = unpacked(blob, size, key, value)
                got.append(pa.table({"h": h, "x": x, "n": np.zeros(len(h), np.int64)}))
            return pa.concat_tables(g.cast(own.schema) for g in got)

        sent = sent.groupBy("radix").cogroup(rest.groupBy("radix")).applyInArrow(answer, "h long, x double, n long")
    # Equal texts are summed up together: the quotient is that of one.
    return sent.groupBy("h").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).select("h", F.try_divide("x", "n").alias("x"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = MAX_DOCS, most_local: int = MOST_LOCAL) -> Model:
    """The model from all labelled texts. Of each class a fifth, by hash, and max_docs at most, is kept for the curve alone."""
    spark = docs.sparkSession
    tune(spark)
    known = labels.where(f"`{id_col}` is not null and `{label_col}` in (0, 1)").groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("cls"))
    totals = {r["cls"]: r["count"] for r in known.groupBy("cls").count().collect()}
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    prints = rows.join(few(known, sum(totals.values())), "id").select("id", "cls", F.xxhash64("text").alias("h"))
    one = staged(prints.groupBy("cls", "h").agg(F.min("id").alias("id")).select("id", "cls").distinct(), "toxic-labelled")
    drawn = one.where(F.pmod(F.xxhash64(F.lit("curve"), "id"), F.lit(5)) == 0)
    order = [F.xxhash64(F.lit("sample"), "id"), F.col("id")]
    held = [(r["id"],) for c in sorted(totals) for r in drawn.where(F.col("cls") == c).orderBy(*order).limit(max_docs).collect()]
    curve = spark.createDataFrame(held, one.select("id").schema)
    counts = one.join(F.broadcast(curve), "id", "left_anti")
    size = {r["cls"]: r["count"] for r in counts.groupBy("cls").count().collect()}
    found = staged(counted(rows.join(few(counts, sum(size.values())), "id").select("cls", "text")), "toxic-counts")
    free_shuffles(spark)
    n0, n1 = size.get(0, 0), size.get(1, 0)
    model = estimate(found, (n1 + 0.5) / (n0 + n1 + 1), most_local)
    texts = rows.join(F.broadcast(one.join(F.broadcast(curve), "id")), "id").select(F.xxhash64("text").alias("h"), "cls", "text")
    seen = texts.select("h", "cls").distinct().join(figures(texts.select("h", "text"), model), "h")
    held = columns(seen.select("cls", F.coalesce("x", F.lit(0.0)).alias("x")))
    y, x = held["cls"].astype(float), held["x"].astype(float)
    free_shuffles(spark)
    weight = np.where(y > 0, totals.get(1, 0) / max(1, y.sum()), totals.get(0, 0) / max(1, (1 - y).sum()))
    return model._replace(curve=logistic(x, y, weight / max(1e-9, weight.mean()) if len(weight) else weight))


def score(df: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """df's columns and the score (double, 0 to 1); a column of that name is replaced."""
    tune(df.sparkSession)
    kept = [c for c in df.columns if c != name]
    own = [f"_c{i}" for i in range(len(kept))]
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    found = staged(figures(df.select(h.alias("h"), F.col(text_col).alias("text")), model), "toxic-figures")
    slope, intercept = model.curve
    x = F.coalesce("_x", F.lit(0.0))
    s = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), slope * x + intercept))))
    found = few(found.select(F.col("h").alias("_h"), F.col("x").alias("_x")), found.count())
    rows = df.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(kept, own, strict=True)], h.alias("_h"))
    return rows.join(found, "_h").select(*[F.col(o).alias(c) for c, o in zip(kept, own, strict=True)], s.alias(name))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit_from(spark: SparkSession, sf_dir: str) -> Model:
    """The model from sf_dir's labels; rows with crc32(doc_id) mod 5 = 0 are never learnt from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    return fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, fit_from(spark, sf_dir)).select("doc_id", "score")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
