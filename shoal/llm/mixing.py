"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in a hashed order, form blocks. With target weight w, block k of a source (from
0) is released at slot floor(k / w) and due by ceil((k + 1) / w). Earliest deadline first fills each
slot with one block, so that after any number of slots every source is less than one block away
from its weight. Weights are exact fractions; nothing is rounded to a period.

The schedule is worked out in frames of `frame` slots, or as many as the smallest weight needs for one
block, each in a task of its own. What a source has had
when a frame begins is one of the two whole numbers next to weight times slots. Which of them, every
frame finds without its predecessor: it begins one frame earlier with the sources of the earliest
deadlines ahead, a state from which earliest deadline first meets all deadlines to come, and runs to
the border. The state reached there can be continued, and it can be reached from the border
before it, so between two such borders all windows, cut off at the borders, can be met again.

Nothing is dropped: the mix runs until every source has been used up once, and sources that are
short for their weight start again (their rows return with `epoch` 1, 2 and so on).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoal.llm.shared import staged

#: Slots of a frame, rows of a block, rows of a rank bucket, sources at most, blocks that may be sent to
#: all tasks (24 bytes each), returns of a row that one task lists.
FRAME, BLOCK_ROWS, BUCKET_ROWS, MOST_SOURCES, MOST_SENT, RETURNS = 16_384, 8, 20_000, 10_000, 400_000, 1_000


def exact(weights: Mapping[str, float | int | Fraction]) -> dict[str, Fraction]:
    """Shares that add up to one, without rounding; sources of weight 0 have none."""
    given = {s: Fraction(w) for s, w in weights.items()}  # infinities and NaN are refused here
    if any(w < 0 for w in given.values()):
        raise ValueError("a weight is negative")
    total = sum(given.values())
    return {s: w / total for s, w in given.items() if w}


def release(k: int, w: Fraction) -> int:
    return k * w.denominator // w.numerator


def deadline(k: int, w: Fraction) -> int:
    return -(-(k + 1) * w.denominator // w.numerator)


def ahead(shares: list[Fraction], at: int) -> list[int]:
    """Blocks that each source has had by slot `at`, if of those between two whole numbers the ones with
    the earliest deadlines have the larger."""
    had = [w.numerator * at // w.denominator for w in shares]
    order = sorted((deadline(n, w), i) for i, (n, w) in enumerate(zip(had, shares, strict=True)) if n * w.denominator != w.numerator * at)
    for _, i in order[: at - sum(had)]:
        had[i] += 1
    return had


def run(shares: list[Fraction], had: list[int], begin: int, end: int, last: list[int] | None = None) -> list[list[int]]:
    """Of each source the slots of its blocks from slot begin on, up to end: earliest deadline first among
    released ones. had: blocks before begin; last: blocks by the end, which become due then."""
    slots: list[list[int]] = [[] for _ in shares]
    at = list(had)
    if last is None:
        due = [deadline(k, w) for k, w in zip(had, shares, strict=True)]
    else:
        due = [min(end, deadline(k, w)) for k, w in zip(had, shares, strict=True)]
    waiting = [(release(k, w), i) for i, (k, w) in enumerate(zip(had, shares, strict=True)) if last is None or k < last[i]]  # by release
    ready: list[tuple[int, int]] = []  # by deadline
    heapq.heapify(waiting)
    for slot in range(begin, end):
        while waiting and waiting[0][0] <= slot:
            i = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (due[i], i))
        d, i = heapq.heappop(ready)
        assert slot < d, "the windows of shares that add up to one can always be met"
        slots[i].append(slot)
        at[i] += 1
        if last is None or at[i] < last[i]:
            due[i] = deadline(at[i], shares[i]) if last is None else min(end, deadline(at[i], shares[i]))
            heapq.heappush(waiting, (release(at[i], shares[i]), i))
    return slots


def frame_length(shares: list[Fraction], frame: int) -> int:
    """At least one block of every source, so that no source can have had less at a later border."""
    return max(frame, *[deadline(0, w) for w in shares])


def border(shares: list[Fraction], m: int, frame: int) -> list[int]:
    """Blocks that each source has had when frame m begins."""
    if not m:
        return [0] * len(shares)
    before = ahead(shares, (m - 1) * frame)
    return [n + len(s) for n, s in zip(before, run(shares, before, (m - 1) * frame, m * frame), strict=True)]


def frame_slots(shares: list[Fraction], m: int, frame: int) -> tuple[list[int], list[list[int]]]:
    """Of each source the blocks before frame m and the slots of its blocks in it."""
    had, last = border(shares, m, frame), border(shares, m + 1, frame)
    return had, run(shares, had, m * frame, (m + 1) * frame, last)


def schedule(spark: SparkSession, shares: Mapping[str, Fraction], slots: int, frame: int = FRAME) -> DataFrame:
    """(s, k, slot) of all blocks of the first `slots` slots, rounded up to whole frames."""
    names, fractions = list(shares), list(shares.values())
    frame = frame_length(fractions, frame)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m in b.column("id").to_pylist():
                had, found = frame_slots(fractions, m, frame)
                n = np.array([len(x) for x in found])
                source = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(names)), n).astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())
                k = np.concatenate([np.arange(h, h + c) for h, c in zip(had, n, strict=True)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([source, pa.array(k), pa.array(np.concatenate([np.array(x, np.int64) for x in found]))], names=["s", "k", "slot"])

    frames = max(1, -(-slots // frame))
    return spark.range(0, frames, 1, min(frames, 10_000)).mapInArrow(work, "s string, k long, slot long")


def tempered(counts: Mapping[str, int], power: float) -> dict[str, float]:
    """Weights in proportion to counts ** power: between equal (0) and natural (1) shares."""
    return {s: n**power for s, n in counts.items()}


def mix_sources(df: DataFrame, weights: Mapping[str, float | int | Fraction] | None = None, source_col: str = "source", key_cols: tuple[str, ...] = ("doc_id",), power: float = 0.7, frame: int = FRAME, block_rows: int = BLOCK_ROWS, seed: int = 1, prefix: str = "mix_") -> DataFrame:
    """df's columns with mix_position (0 on, without gaps), mix_slot, mix_block and mix_epoch, or other
    names by prefix; columns of df with the added names are replaced.

    weights: source to weight, with the key "" for null sources too; None: tempered counts. A source
    without a weight, all weights 0, a negative weight or one that is no number, or a source beyond
    MOST_SOURCES is an error, not a loss. A source of weight 0 has no place in the mix, and weights of
    sources without rows are not read. Rows are ranked within their source by a hash of key_cols; rows
    that agree in those are ranked by all other columns, and rows equal in all are interchangeable.
    """
    spark = df.sparkSession
    added = [f"{prefix}{c}" for c in ("position", "slot", "block", "epoch")]
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in added])
    own = [f"_c{i}" for i in range(len(df.columns))]
    name = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    rows = df.toDF(*own).withColumn("_s", F.coalesce(F.col(name[source_col]).cast("string"), F.lit("")))
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), *[name[c] for c in key_cols]))
    counts = {r["_s"]: r["count"] for r in rows.groupBy("_s").count().limit(MOST_SOURCES + 1).collect()}
    if len(counts) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    nothing = df.select("*", *[F.lit(0).cast("long").alias(c) for c in added])
    if not counts:
        return nothing
    given = tempered(counts, power) if weights is None else weights
    if missing := sorted(counts.keys() - given.keys()):
        raise ValueError(f"no weight for {missing}")
    shares = exact({s: given[s] for s in sorted(counts)})
    if not shares:
        raise ValueError("all weights are 0")
    # A source's last block stands somewhere in its window; the schedule reaches beyond all of these.
    need = {s: -(-counts[s] // block_rows) for s in shares}
    blocks = staged(schedule(spark, shares, max(deadline(k - 1, shares[s]) for s, k in need.items()), frame), "schedule")
    lasts = spark.createDataFrame([(s, k - 1) for s, k in need.items()], "s string, k long")
    slots = blocks.join(F.broadcast(lasts), ["s", "k"]).agg(F.max("slot")).first()[0] + 1
    placed = {r["s"]: r["n"] for r in blocks.where(F.col("slot") < slots).groupBy("s").agg(F.count("*").alias("n")).collect()}
    info = spark.createDataFrame([(s, counts[s], placed[s] * block_rows, max(1, math.ceil(counts[s] / BUCKET_ROWS))) for s in shares], "_s string, _n long, _items long, _buckets long")

    # A source's rank is taken bucket by bucket, so that no task has to sort a whole source.
    bucket = F.pmod(F.shiftright("_h", 20), F.col("_buckets")).alias("_b")
    rows = rows.join(F.broadcast(info), "_s").withColumn("_b", bucket)
    before = rows.groupBy("_s", "_b").count().withColumn("_before", F.sum("count").over(Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).drop("count")
    # Maps have no order; their JSON stands for them.
    order = [F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in rows.select(*own).dtypes]
    window = Window.partitionBy("_s", "_b").orderBy("_h", *order)
    ranked = rows.withColumn("_r", F.row_number().over(window) - 1).join(before.withColumnsRenamed({"_s": "_s2", "_b": "_b2"}), (F.col("_s") == F.col("_s2")) & (F.col("_b") == F.col("_b2")))
    ranked = ranked.withColumn("_r", F.col("_r") + F.coalesce("_before", F.lit(0))).where("_r < _items")
    # Item i of a source is its row i modulo n: row r is item r, r + n, r + 2n ... below _items. A row that
    # returns very often is listed in steps that are dealt out.
    ranked = ranked.withColumn("_last", F.expr("(_items - 1 - _r) div _n"))
    if max(placed[s] * block_rows // counts[s] for s in shares) > RETURNS:
        ranked = ranked.withColumn("_from", F.explode(F.expr(f"sequence(0L, _last, {RETURNS}L)"))).repartition("_s", "_r", "_from")
    else:
        ranked = ranked.withColumn("_from", F.lit(0).cast("long"))
    items = ranked.withColumn("_epoch", F.explode(F.expr(f"sequence(_from, least(_last, _from + {RETURNS - 1}L))"))).withColumn("_item", F.expr("_r + _epoch * _n")).withColumn("_k", F.expr(f"_item div {block_rows}"))
    known = blocks.where(F.col("slot") < slots).select(F.col("s").alias("_s3"), F.col("k").alias("_k3"), "slot")
    found = items.join(F.broadcast(known) if slots <= MOST_SENT else known, (F.col("_s") == F.col("_s3")) & (F.col("_k") == F.col("_k3")))
    position = F.expr(f"slot * {block_rows} + _item % {block_rows}")
    return found.select(*[F.col(c).alias(n) for c, n in zip(own, df.columns, strict=True)], *[x.alias(c) for x, c in zip((position, F.col("slot"), F.col("_k"), F.col("_epoch")), added, strict=True)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all documents, mixed by source with weights in proportion to counts to the power 0.7."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"))
