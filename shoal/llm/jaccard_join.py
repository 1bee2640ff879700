"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A text's set holds its distinct shingles, as 64-bit hashes. Equal sets are one class and are handled
once. All shingles have one order, rare before frequent: those that occur once in all texts, which
no prefix needs to list, then by count, both from tables of fixed size, then by hash. A class with n shingles and the needed overlap a = ceil(t * n) has, for
level l, the prefix of its first n - a + l shingles: two sets that reach the threshold share at
least l shingles of their prefixes of level l. Each class picks its own level by estimated cost,
a longer prefix against fewer candidates; a pair must share as many prefix shingles as the lower of
its two levels says, counting only shingles that both prefixes of that level hold.

Candidates are not taken from all pairs of a posting list at once. First each list links its members
to one pivot; what verification confirms is merged into components, so most near copies cost one
verification each. Of the lists whose members are then still in different components, the short ones,
of SHORT members at most, list their pairs. The members of the long ones are joined to clusters, whose
members meet block by block where their sizes allow a link: only their shingles of long lists travel
there, and products of their columns, one for each level, say which pairs share as many as they must. A
pair that shares shingles of both kinds is counted by the short lists, with what the long ones may add.
Few pairs of two blocks are verified one by one; where they are many, the blocks' sets meet whole, and only
the edges of a tree leave the task: no link between different components is lost.

Before whole sets travel, sketches do: counts of a set's shingles by their top bits, half a byte to a quarter
for each shingle. The smaller counts of two sets sum up to no less than they share, so that a pair that stays
below the needed overlap there can't link; all others are verified by whole sets.

Lists, pairs, blocks and sets are worked through in rounds where they would take more disk at once than a fixed
share of the texts: rounds add readings of the texts, but leave nothing out.

Verification compares whole sets. Texts without words, empty ones and nulls have an empty set and
stay alone; a text with fewer words than a shingle has one shingle of all its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm.bytetext import NONSPACE, mix, ngrams, words
from shoal.llm.shared import components, discard, free_name, free_shuffles, in_rounds, marked, of_planes, planes, repeated_bits, staged, staged_parts, tune

#: Bits of the tables of repeated shingles (16 MB) and of their counts (1 MB), levels that a class may
#: pick, cost of a verification in list entries.
AGAIN_BITS, COUNT_BITS, LEVELS, VERIFY_COST = 27, 20, 4, 30.0
#: Members of a list whose pairs are listed; sets and shingles of one block.
SHORT, BLOCK, BLOCK_SHINGLES = 16, 256, 500_000
#: Ids or groups that may be sent to all tasks (8 or 16 bytes each).
MOST_GONE = 500_000
#: Bytes that one round may shuffle and write: for each shingle of all texts, and at least.
ROUND_SHARE, ROUND_BYTES = 4, 256 << 20
#: Bytes of a list's entry on its way through a join by shingles, of a pair on its way to its count.
ENTRY_BYTES, PAIR_BYTES = 64, 32


def text_sets(arr: pa.Array, width: int, table: np.ndarray = NONSPACE) -> Iterator[np.ndarray]:
    """Of each text its sorted distinct shingles."""
    for part in words(arr, table):
        g = ngrams(part.hash, width)
        first = part.first.tolist()
        for i in range(part.high - part.low):
            a, b = first[i], first[i + 1]
            if b - a >= width:
                s = np.sort(g[a : b - width + 1])
                keep = np.ones(len(s), bool)
                keep[1:] = s[1:] != s[:-1]
                yield s[keep]
            elif b > a:
                h = np.full(1, b - a, np.uint64)
                for x in part.hash[a:b]:
                    h = mix(h * np.uint64(31) + x)
                yield h
            else:
                yield np.zeros(0, np.uint64)


class Rarity(NamedTuple):
    again: np.ndarray  # bitmap over the hashes' top bits: shingles that occur once are not in it, up to strangers
    weight: np.ndarray  # of each stretch of hashes, four times the logarithm of its repeated shingles' count


def rarity(texts: DataFrame, width: int) -> Rarity:
    """Which shingles of all texts occur again, and how often. Hashes are dealt out by their top bits,
    the next 24 of them packed in order, and counted there; the driver gets tables of fixed size."""
    bits = min(18, max(8, math.ceil(math.log2(max(1, texts.rdd.getNumPartitions()))) + 4))
    map_bits, count_bits = AGAIN_BITS - bits, max(0, COUNT_BITS - bits)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(have: list[np.ndarray]) -> pa.RecordBatch:
            h = np.concatenate(have)
            h.sort()
            cut = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            low = ((h << np.uint64(bits)) >> np.uint64(40)).astype(np.uint32)
            some = np.flatnonzero(np.diff(cut))
            blobs = [pa.compress(planes(low[cut[i] : cut[i + 1]], in_order=True), codec="zstd", asbytes=True) for i in some]
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.diff(cut)[some]), pa.array(blobs, pa.binary())], names=["radix", "n", "low"])

        have, size = [], 0
        for b in batches:
            for s in text_sets(b.column(0), width):
                have.append(s)
                size += len(s)
            if size > 1_500_000:
                yield send(have)
                have, size = [], 0
        if size:
            yield send(have)

    def settle(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        low = np.concatenate([of_planes(pa.decompress(x.as_buffer(), 4 * n, codec="zstd"), np.uint32, n, in_order=True) for x, n in zip(t.column("low"), t.column("n").to_pylist(), strict=True)])
        low.sort()
        begin = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        n = np.diff(np.append(begin, len(low)))
        value, n = low[begin[n > 1]], n[n > 1]
        again = np.zeros(1 << map_bits, bool)
        again[value >> np.uint32(24 - map_bits)] = True
        total = np.bincount((value >> np.uint32(24 - count_bits)).astype(np.int64), n, 1 << count_bits)
        return pa.table({"radix": pa.array([key[0].as_py()], pa.int32()), "again": pa.array([np.packbits(again, bitorder="little").tobytes()], pa.binary()), "weight": pa.array([np.round(np.log2(total + 1) * 4).astype(np.uint8).tobytes()], pa.binary())})

    found = texts.mapInArrow(deal, "radix int, n long, low binary").groupBy("radix").applyInArrow(settle, "radix int, again binary, weight binary")
    out = Rarity(np.zeros((1 << bits, (1 << map_bits) // 8), np.uint8), np.zeros((1 << bits, 1 << count_bits), np.uint8))
    for r in found.toLocalIterator():
        out.again[r["radix"]], out.weight[r["radix"]] = np.frombuffer(r["again"], np.uint8), np.frombuffer(r["weight"], np.uint8)
    return Rarity(out.again.ravel(), out.weight.ravel())


def prefix(s: np.ndarray, known: Rarity, percent: int) -> tuple[np.ndarray, int, int, int]:
    """The prefix's shingles that may occur again, in order; how many stand before them, which don't;
    the prefix's length at level 1, and the level picked."""
    n = len(s)
    need = -(-percent * n // 100)
    spot = (s >> np.uint64(64 - AGAIN_BITS)).astype(np.int64)
    again = s[known.again[spot >> 3] >> (spot & 7).astype(np.uint8) & 1 > 0]
    alone = n - len(again)
    most = min(LEVELS, need)
    size = n - need + most - alone
    if size <= 0:
        return s[:0], alone, n - need + 1, most
    weight = known.weight[(again >> np.uint64(64 - (len(known.weight) - 1).bit_length())).astype(np.int64)]
    order = np.lexsort((again, weight))[:size]
    seen = np.concatenate([np.zeros(alone), np.cumsum(np.exp2(weight[order] / 4.0))])
    level = 1 + int(np.argmin([seen[n - need + k - 1] * (1 + VERIFY_COST / k**2) for k in range(1, most + 1)]))
    return again[order[: max(0, n - need + level - alone)]], alone, n - need + 1, level


def sketch(s: np.ndarray) -> bytes:
    """Counts of the sorted set's shingles by their top bits, two to four a count; empty if one is beyond a byte."""
    bits = max(0, len(s).bit_length() - 2)
    n = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) if bits else np.array([len(s)])
    return n.astype(np.uint8).tobytes() if n.max() < 256 else b""


def may_reach(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether sets of these sketches may reach the threshold: they share at most the sum of the smaller counts."""
    if not len(a) or not len(b):
        return True
    m = min(len(a), len(b))
    a, b = (x.reshape(m, -1).sum(1, dtype=np.int64) for x in (a, b))
    most = int(np.minimum(a, b).sum())
    return 100 * most >= percent * (int(a.sum()) + int(b.sum()) - most)


def class_rows(docs: DataFrame, known: Rarity, width: int, percent: int, carry: str) -> DataFrame:
    """Of each text: carry, n, cls (64 bits of the set's digest; null if empty), prefix, alone, base, level, sketch (null without a prefix)."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Rarity(*shared.value)
        for b in batches:
            rows = []
            for s in text_sets(b.column("text"), width):
                if len(s):
                    cls = int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
                    shingles, *rest = prefix(s, known, percent)
                    rows.append((len(s), cls, shingles.view(np.int64), *rest, sketch(s) if len(shingles) else None))
                else:
                    rows.append((0, None, None, 0, 0, 0, None))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(carry), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=[carry, "n", "cls", "prefix", "alone", "base", "level", "sketch"])

    kind = dict(docs.dtypes)[carry]
    out = staged(docs.select(carry, "text").mapInArrow(run, f"`{carry}` {kind}, n long, cls long, prefix array<long>, alone int, base int, level int, sketch binary"), "classes")
    shared.destroy()  # else the driver keeps a copy
    return out


def list_entries(classes: DataFrame) -> DataFrame:
    """(token, node, n, alone, level, at) of the prefixes' shingles that stand in several of them, and of a few
    strangers that a bitmap lets through; at: the lowest level whose prefix holds the shingle."""
    bitmap = repeated_bits(classes.select("prefix"), lambda b: [b.column(0).flatten().to_numpy().view(np.uint64)])
    shared = classes.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            token = b.column("prefix").flatten().to_numpy()
            size = np.diff(b.column("prefix").offsets.to_numpy())
            row = np.repeat(np.arange(len(size)), size)
            alone, base = (b.column(c).to_numpy() for c in ("alone", "base"))
            at = lowest_level(np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size), alone[row], base[row])
            keep = np.flatnonzero(marked(shared.value, token.view(np.uint64)))
            own = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([pa.array(token[keep]), *(b.column(c).take(own) for c in ("cls", "n", "alone", "level")), pa.array(at[keep].astype(np.int32))], names=["token", "node", "n", "alone", "level", "at"])

    out = staged(classes.mapInArrow(run, "token long, node long, n long, alone int, level int, at int"), "entries")
    shared.destroy()
    return out


def needed_bits(nodes: DataFrame, bits: int = 23) -> np.ndarray:
    """A bitmap of fixed size (1 MB) over the top bits of the nodes: only a filter, hits are joined later."""
    spot = F.shiftrightunsigned("node", 64 - bits)
    got = nodes.select(spot.alias("s")).groupBy(F.shiftright("s", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    if got.num_rows:
        out[got["word"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    return out


def sets_of(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, shingles as bytes) of the classes in nodes, from the texts."""
    bitmap = docs.sparkSession.sparkContext.broadcast(needed_bits(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of this task
        for b in batches:
            node, data = [], []
            for s in text_sets(b.column(0), width):
                if not len(s):
                    continue
                raw = s.tobytes()
                c = int.from_bytes(blake2b(raw, digest_size=8).digest(), "little", signed=True)
                at = (c % (1 << 64)) >> 41
                if int(bitmap.value[at >> 6]) >> (at & 63) & 1 and c not in seen:
                    seen.add(c)
                    node.append(c), data.append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(data, pa.binary())], names=["node", "s"])

    found = docs.select("text").mapInArrow(run, "node long, s binary")
    out = staged(found.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("s").alias("s")), "sets")
    bitmap.destroy()
    return out


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose sets reach the threshold."""
    left = pairs.join(sets.select(F.col("node").alias("y"), F.col("s").alias("t")), "y")
    both = left.join(sets.withColumnRenamed("node", "x"), "x").select("x", "y", "s", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for s, t in zip(b.column("s"), b.column("t"), strict=True):
                s, t = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
                m = np.concatenate([s, t])
                m.sort(kind="stable")
                same = int((m[1:] == m[:-1]).sum())
                keep.append(100 * same >= percent * (len(s) + len(t) - same))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("x").filter(mask), b.column("y").filter(mask)], names=["x", "y"])

    return both.mapInArrow(run, "x long, y long")


def possible(pairs: DataFrame, listed: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y, size) that their sketches leave possible."""
    of = lambda node, name: listed.select(F.col("cls").alias(node), F.col("sketch").alias(name))
    both = pairs.join(of("y", "t"), "y").join(of("x", "s"), "x").select("x", "y", "size", "s", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [may_reach(np.frombuffer(s.as_buffer(), np.uint8), np.frombuffer(t.as_buffer(), np.uint8), percent) for s, t in zip(b.column("s"), b.column("t"), strict=True)]
            yield b.select(["x", "y", "size"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "x long, y long, size long")


def linked(docs: DataFrame, pairs: DataFrame, listed: DataFrame, width: int, percent: int, room: int) -> DataFrame:
    """The staged pairs (x, y) of pairs (x, y, size), size being the sum of both sets', that reach the threshold."""
    total = lambda df: df.agg(F.sum("size")).first()[0] or 0
    likely = staged_parts((possible(part, listed, percent) for part in in_rounds(pairs, ["x", "y"], total(pairs), room)), "likely")
    free_shuffles(docs.sparkSession)
    size = total(likely)

    def found() -> Iterator[DataFrame]:
        # Of a set's 8 bytes a shingle there are four copies at most: as written, by y, by x and with its pair.
        for part in in_rounds(likely, ["x"], 16 * size, room):
            sets = sets_of(docs, part.select(F.explode(F.array("x", "y")).alias("node")).distinct(), width)
            free_shuffles(docs.sparkSession)
            yield verified(part, sets, percent)
            discard(sets)

    out = staged_parts(found() if size else [likely.select("x", "y")], "links")
    discard(likely)
    free_shuffles(docs.sparkSession)
    return out


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of shingle columns, a few thousand at a time; each product's
    counts are exact."""
    if not left or not right:
        return np.zeros((len(left), len(right)), np.int64)
    token = np.concatenate([*left, *right])
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    column = np.cumsum(np.append(False, token[1:] != token[:-1]))
    shared = np.bincount(column)[column] > 1
    column, row = np.unique(column[shared], return_inverse=True)[1], row[shared]
    out = np.zeros((len(left), len(right)), np.int64)
    cut = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + 1 + 4096, 4096))
    for k, (low, high) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        m = np.zeros((len(left) + len(right), 4096), np.float32)
        m[row[low:high], column[low:high] - 4096 * k] = 1
        out += (m[: len(left)] @ m[len(left) :].T).astype(np.int64)
    return out


def multi_matches(prefixes: list[np.ndarray], at: list[np.ndarray], level: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs share as many shingles of their prefixes of the lower of their levels as that level says."""
    lower = np.minimum(level[left][:, None], level[right][None, :])
    out = np.zeros(lower.shape, bool)
    for k in np.unique(lower).tolist():
        part = [p[a <= k] for p, a in zip(prefixes, at, strict=True)]
        out |= (lower == k) & (overlaps([part[i] for i in left], [part[j] for j in right]) >= k)
    return out


def lowest_level(pos: np.ndarray, alone: int, base: int) -> np.ndarray:
    """The lowest level whose prefix holds the shingle at each place of a listed prefix."""
    return np.maximum(1, alone + pos - base + 2)


def may_link(t: pa.Table, a: int, z: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the nodes of two blocks: rows of the first, rows of the second, and which of them may link."""
    label, block, level, size = (t.column(c).to_numpy() for c in ("label", "block", "level", "n"))
    prefixes, at = ([p.values.to_numpy() for p in t.column(c)] for c in ("tokens", "ats"))
    left, right = np.flatnonzero(block == a), np.flatnonzero(block == z)
    linked = (label[left][:, None] != label[right][None, :]) & (100 * np.minimum(size[left][:, None], size[right]) >= percent * np.maximum(size[left][:, None], size[right]))
    if linked.any():
        linked &= multi_matches(prefixes, at, level, left, right)
    return left, right, linked


def pair_blocks(percent: int):
    """Function for two blocks of a cluster: the pairs (x, y) that may link, or a row without them where sending
    their sets one by one would take more than sending those of the blocks."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        cluster, a, z = (k.as_py() for k in key)
        node = t.column("node").to_numpy()
        left, right, linked = may_link(t, a, z, percent)
        i, j = np.nonzero(np.triu(linked) if a == z else linked)
        size = t.column("n").to_numpy()
        if 2 * len(i) > len(node):
            x, y, both = (pa.nulls(1, pa.int64()) for _ in range(3))
        else:
            x, y, both = pa.array(node[left[i]]), pa.array(node[right[j]]), pa.array(size[left[i]] + size[right[j]])
        return pa.table({"x": x, "y": y, "size": both, **{k: pa.array(np.full(len(x), v)) for k, v in (("cluster", cluster), ("a", a), ("z", z))}})

    return run


def compare_blocks(percent: int):
    """Function for two blocks of a cluster: (x, y) edges that join what links between them, a tree at most."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        node, label, size = (t.column(c).to_numpy() for c in ("node", "label", "n"))
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in t.column("s")]
        left, right, linked = may_link(t, key[1].as_py(), key[2].as_py(), percent)
        left, right, linked = left[linked.any(1)], right[linked.any(0)], linked[linked.any(1)][:, linked.any(0)]
        same = overlaps([sets[i] for i in left], [sets[j] for j in right])
        linked &= 100 * same >= percent * (size[left][:, None] + size[right][None, :] - same)
        root: dict[int, int] = {}

        def find(i: int) -> int:
            while (j := root.get(i, i)) != i:
                root[i] = root.get(j, j)
                i = j
            return i

        edges = []
        for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
            p, q = left[i], right[j]
            u, v = find(int(label[p])), find(int(label[q]))
            if u != v:
                root[max(u, v)] = min(u, v)
                edges.append((int(node[p]), int(node[q])))
        return pa.table({"x": pa.array([e[0] for e in edges], pa.int64()), "y": pa.array([e[1] for e in edges], pa.int64())})

    return run


def short_pairs(open_lists: DataFrame, percent: int, room: int) -> Iterator[DataFrame]:
    """Pairs (x, y, size) of different labels that share a shingle of a short list and may share as many as they must."""
    far = open_lists.where(F.col("c") > SHORT).groupBy("node").agg(F.count("*").alias("far"))
    near = open_lists.where(F.col("c") <= SHORT)
    size = near.agg(F.count("*") * ENTRY_BYTES).first()[0]
    near = staged_parts((part.join(far, "node", "left").select("token", "node", "n", "level", "at", "label", F.coalesce("far", F.lit(0)).alias("far")) for part in in_rounds(near, ["node"], size, room)), "near")
    other = near.select("token", *[F.col(c).alias(f"{c}2") for c in near.columns if c != "token"])
    size = near.groupBy("token").count().agg(F.sum(F.expr("count * (count - 1) / 2")) * PAIR_BYTES).first()[0] or 0
    for part in in_rounds(near, ["node"], size, room):
        both = part.join(other, "token").where("node < node2 and label <> label2").where("least(n, n2) * 100L >= greatest(n, n2) * %d" % percent).where("greatest(at, at2) <= least(level, level2)")
        pairs = both.groupBy(F.col("node").alias("x"), F.col("node2").alias("y")).agg(F.count("*").alias("k"), F.first(F.least("level", "level2")).alias("l"), F.first(F.least("far", "far2")).alias("far"), F.first(F.col("n") + F.col("n2")).alias("size"))
        yield pairs.where("k + far >= l").select("x", "y", "size")
    discard(near)


def long_blocks(open_lists: DataFrame, percent: int) -> DataFrame:
    """The members of long lists, once for each pair of blocks of their cluster whose sizes allow a link. A
    block holds nodes of one band of sizes; what links stands in one band or in two that follow each other."""
    left = open_lists.where(F.col("c") > SHORT)
    clusters = components(left.where("label <> a").select(F.col("label").alias("x"), F.col("a").alias("y")).distinct(), "clusters")
    members = left.groupBy("node", "n", "level", "label").agg(F.collect_list(F.struct("token", "at")).alias("p"))
    band = F.floor(F.log("n") / (math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9))
    nodes = staged(members.join(clusters.select(F.col("node").alias("label"), F.col("label").alias("cluster")), "label").withColumn("band", band), "members")
    count = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES))
    blocks = staged(nodes.groupBy("cluster", "band").agg(count.alias("blocks")), "blocks")
    # Blocks have the band in the upper bits of their number.
    first = lambda b: F.shiftleft(b.cast("long"), 24)
    others = blocks.select("cluster", F.col("band").alias("other_band"), F.explode(F.sequence(first(F.col("band")), first(F.col("band")) + F.col("blocks") - 1)).alias("other"))
    placed = nodes.join(blocks, ["cluster", "band"]).withColumn("block", first(F.col("band")) + F.pmod(F.xxhash64("node"), F.col("blocks")))
    placed = placed.select("cluster", "node", "n", "level", "label", "block", F.col("p.token").alias("tokens"), F.col("p.at").alias("ats"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("other_band"))
    placed = placed.join(others, ["cluster", "other_band"])
    return placed.select("cluster", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("z"), "node", "n", "level", "label", "block", "tokens", "ats")


def across(docs: DataFrame, postings: DataFrame, labels: DataFrame, tested: DataFrame, listed: DataFrame, width: int, percent: int, room: int) -> DataFrame:
    """Links between nodes of different labels, of lists that hold several. tested: pairs (x, y), x < y, that
    need no second look. postings and tested are deleted."""
    spark = docs.sparkSession

    def open_lists(part: DataFrame) -> DataFrame:
        known = part.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        lists = known.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("token", "a")
        return known.join(lists, "token").select("token", "node", "n", "level", "at", "label", "c", "a")

    left = staged_parts(map(open_lists, in_rounds(postings, ["token"], 2 * ENTRY_BYTES * postings.count(), room)), "open")
    discard(postings)
    free_shuffles(spark)
    key = ["cluster", "a", "z"]
    pairs, dense = staged_parts(short_pairs(left, percent, room), "short-pairs"), None
    found = pairs
    if left.where(F.col("c") > SHORT).limit(1).count():
        free_shuffles(spark)
        blocks = long_blocks(left, percent)
        size = blocks.agg(F.sum(F.size("tokens") * 12 + ENTRY_BYTES)).first()[0] or 0
        kind = "x long, y long, size long, cluster long, a long, z long"
        met = staged_parts((part.groupBy(*key).applyInArrow(pair_blocks(percent), kind) for part in in_rounds(blocks, key, size, room)), "met")
        found = found.unionByName(met.where("x is not null").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "size"))
        many = met.where("x is null").select(*key)
        if many.limit(1).count():
            dense = blocks.join(many, key)
    size = PAIR_BYTES * 2 * (found.count() + tested.count())
    tested_parts = in_rounds(tested, ["x", "y"], size, room)
    every = staged_parts((part.groupBy("x", "y").agg(F.first("size").alias("size")).join(seen.select("x", "y"), ["x", "y"], "left_anti") for part, seen in zip(in_rounds(found, ["x", "y"], size, room), tested_parts, strict=True)), "pairs")
    discard(pairs, tested, left)
    free_shuffles(spark)
    links = linked(docs, every, listed, width, percent, room)
    discard(every)
    if dense is None:
        return links

    def compared() -> Iterator[DataFrame]:
        size = 32 * (dense.agg(F.sum("n")).first()[0] or 0)
        for part in in_rounds(dense, key, size, room):
            sets = sets_of(docs, part.select("node").distinct(), width)
            free_shuffles(spark)
            yield part.join(sets, "node").groupBy(*key).applyInArrow(compare_blocks(percent), "x long, y long")
            discard(sets)

    return links.unionByName(staged_parts(compared(), "dense-links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """One row per text: id, n_shingles, component_id (smallest id reachable over links, itself included).

    Two texts link when 100 * intersection >= percent * union of their sets. Rows with a null id link
    like others but are never the smallest; rows that repeat an id keep their own sets and rows. Other
    columns of docs are not read. Different sets share a class only if 64 bits of their digests agree.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = rarity(docs.select("text"), width)
    free_shuffles(spark)
    rows = class_rows(docs, known, width, percent, "id")
    del known
    ids = staged(rows.select("id", "n", "cls"), "ids")
    room = max(ROUND_BYTES, ROUND_SHARE * (ids.agg(F.sum("n")).first()[0] or 0))
    listed = staged(rows.where("size(prefix) > 0").groupBy("cls").agg(*[F.first(c).alias(c) for c in ("n", "prefix", "alone", "base", "level", "sketch")]), "listed")
    discard(rows)
    entries = list_entries(listed)
    free_shuffles(spark)

    def shared_lists(part: DataFrame) -> DataFrame:
        # The pivot is the member with the fewest shingles of its own: of near copies the one they were made from.
        lists = part.groupBy("token").agg(F.count("*").alias("c"), F.min(F.struct("alone", "node", F.col("n").alias("m"), F.col("level").alias("level2"), F.col("at").alias("at2"))).alias("p")).where("c > 1")
        lists = lists.select("token", "c", F.col("p.node").alias("pivot"), "p.m", "p.level2", "p.at2")
        return part.join(lists, "token").drop("alone")

    postings = staged_parts(map(shared_lists, in_rounds(entries, ["token"], 2 * ENTRY_BYTES * entries.count(), room)), "postings")
    discard(entries)
    free_shuffles(spark)

    stars = postings.where("node <> pivot").where("least(n, m) * 100L >= greatest(n, m) * %d" % percent).where("greatest(at, at2) <= least(level, level2)")
    stars = stars.select(F.least("pivot", "node").alias("x"), F.greatest("pivot", "node").alias("y"), F.least("level", "level2").alias("l"), (F.col("n") + F.col("m")).alias("size"))
    count = lambda part: part.groupBy("x", "y").agg(F.count("*").alias("k"), F.first("l").alias("l"), F.first("size").alias("size")).where("k >= l").select("x", "y", "size")
    stars = staged_parts(map(count, in_rounds(stars, ["x", "y"], PAIR_BYTES * postings.count(), room)), "stars")
    free_shuffles(spark)
    links = linked(docs, stars, listed, width, percent, room)
    more = staged(across(docs, postings, components(links), stars, listed, width, percent, room), "more-links")
    discard(listed)
    free_shuffles(spark)
    labels = components(links.unionByName(more)).withColumnRenamed("node", "cls")

    placed = ids.join(labels, "cls", "left").select("id", "n", F.coalesce("label", "cls").alias("label"))
    # Few groups are sent to all texts, so that those of a large one don't meet in one task.
    groups = placed.where("label is not null").groupBy("label").agg(F.min("id").alias("least"), F.count("*").alias("c")).where("c > 1").drop("c")
    groups = staged(groups, "groups")
    out = placed.join(F.broadcast(groups) if groups.count() <= MOST_GONE else groups, "label", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """docs without all but the document with the smallest id of each group of near-duplicates.

    Where ids repeat or are null, rows are numbered first (and so written once more), and the first of
    a group stays. Few ids that go are broadcast, at most MOST_GONE; many are joined.
    """
    ids = docs.groupBy(id_col).count().agg(F.max("count").alias("most"), F.max(F.col(id_col).isNull()).alias("null")).first()
    numbered = docs
    if ids["null"] or (ids["most"] or 0) > 1:
        row = free_name(docs.columns, "row")
        numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
        id_col = row
    found = near_duplicates(numbered, id_col, text_col, width, percent)
    gone = staged(found.where(F.col(id_col) != F.col("component_id")).select(id_col), "gone")
    few = gone.count() <= MOST_GONE
    return numbered.join(F.broadcast(gone) if few else gone, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: all documents, three-word shingles, Jaccard similarity of 0.9 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as t from documents),
sets as (select doc_id, case when len(t) = 0 then cast([] as varchar[]) when len(t) < 3 then [array_to_string(t, ' ')] else list_distinct(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' '))) end as s from w),
g as (select doc_id, len(s) as n, unnest(s) as x from sets),
o as (select a.doc_id as p, b.doc_id as q, a.n as n, b.n as m, count(*) as k from g a join g b on a.x = b.x and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) group by all),
l as (select p, q from o where 100 * k >= 90 * (n + m - k)),
e as (select p, q from l union all select q, p from l),
r as (select doc_id as d, doc_id as c from documents union select e.q, r.c from r join e on r.d = e.p)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, min(r.c) as component_id from sets s join r on s.doc_id = r.d group by s.doc_id, len(s.s)
"""
