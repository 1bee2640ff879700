"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows lie in partitions of known size. How many rows each partition sends to each cell (a bounded
slice of a shard) is drawn exactly: the cells' sizes are split down a binary tree over the
partitions by multivariate hypergeometric draws, each seeded by its node, so a task draws its own
row of the matrix in O(log partitions) steps and the whole matrix exists nowhere. Rows are permuted
in their partition, dealt out by that row of the matrix, exchanged, and permuted again in their
cell. Every arrangement of the rows is equally likely, and shard sizes differ by one at most.

The rows are staged first with their partition and place, so lost tasks redo the same draws.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoal.llm.shared import staged, tune

#: Rows of one cell at most, so of one group in the second permutation.
CELL_ROWS = 50_000


def split_evenly(total: int, parts: int) -> np.ndarray:
    """Sizes that differ by one at most."""
    return np.full(parts, total // parts, np.int64) + (np.arange(parts) < total % parts)


def cell_sizes(total: int, shards: int, cell_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each cell its shard, first slot and size."""
    shard, first, size = [], [], []
    for s, rows in enumerate(split_evenly(total, shards)):
        own = split_evenly(int(rows), max(1, -(-int(rows) // cell_rows)))
        shard.append(np.full(len(own), s))
        first.append(np.cumsum(own) - own)
        size.append(own)
    return np.concatenate(shard), np.concatenate(first), np.concatenate(size)


def draw(rng: np.random.Generator, sizes: np.ndarray, n: int) -> np.ndarray:
    """How many of n rows fall in each cell, if sizes are the cells' free places. Exact at any size."""
    if sizes.sum() < 10**9:
        return rng.multivariate_hypergeometric(sizes, n, method="marginals")
    out, left = np.zeros_like(sizes), int(sizes.sum())
    for i, s in enumerate(sizes):  # cell by cell, each given the ones before
        left -= int(s)
        out[i] = thin(rng, int(s), left, n)
        n -= int(out[i])
    return out


def thin(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Hypergeometric by inversion, walking out from the mode, for totals beyond the generator's 10**9."""
    total = good + bad
    if total < 10**9:
        return int(rng.hypergeometric(good, bad, n)) if total else 0
    log = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    low, high = max(0, n - bad), min(good, n)
    up = down = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    p_up = p_down = math.exp(log(good, up) + log(bad, n - up) - log(total, n))
    u = rng.random() - p_up
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
            up += 1
            if (u := u - p_up) <= 0:
                return up
        if down > low:
            p_down *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
            down -= 1
            if (u := u - p_down) <= 0:
                return down
    return up if p_up > p_down else down


def matrix_row(counts: np.ndarray, sizes: np.ndarray, part: int, seed: int) -> np.ndarray:
    """Row `part` of the communication matrix: sums to counts[part]; all rows sum to sizes."""
    low, high = 0, len(counts)
    while high - low > 1:
        mid = (low + high) // 2
        left = draw(np.random.default_rng([seed, low, high]), sizes, int(counts[low:mid].sum()))
        low, high, sizes = (low, mid, left) if part < mid else (mid, high, sizes - left)
    return sizes


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 1, cell_rows: int = CELL_ROWS) -> DataFrame:
    """df's columns with shard (0 to shards - 1) and slot (0 on in each shard, without gaps).

    Every row of df counts, whatever it holds: nulls, repeats and ties are rows like others. Columns
    of df called shard or slot are replaced. An empty df gives no rows. The driver holds one count
    per partition and one size per cell.
    """
    spark = df.sparkSession
    tune(spark)
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("shard", "slot")])
    own = [f"_c{i}" for i in range(len(df.columns))]
    rows = df.toDF(*own).withColumn("_id", F.monotonically_increasing_id())
    rows = staged(rows.select(*own, F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_at")), "shards")
    got = rows.groupBy("_part").count().collect()
    parts = np.array(sorted(r["_part"] for r in got), np.int64)
    counts = np.zeros(len(parts), np.int64)
    for r in got:
        counts[np.searchsorted(parts, r["_part"])] = r["count"]
    cell_shard, cell_first, sizes = cell_sizes(int(counts.sum()), shards, cell_rows)
    schema = T.StructType([*rows.schema.fields, T.StructField("_cell", T.LongType())])
    known = spark.sparkContext.broadcast((parts, counts, sizes))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, counts, sizes = known.value
        kept: dict[int, np.ndarray] = {}
        for b in batches:
            part, at = b.column("_part").to_numpy(), b.column("_at").to_numpy()
            cell = np.empty(len(part), np.int64)
            for p in np.unique(part):
                i = int(np.searchsorted(parts, p))
                if i not in kept:
                    kept.clear()
                    kept[i] = np.random.default_rng([seed, 1 << 40, i]).permutation(np.repeat(np.arange(len(sizes), dtype=np.int32), matrix_row(counts, sizes, i, seed)))
                cell[part == p] = kept[i][at[part == p]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*b.schema.names, "_cell"])

    dealt = rows.mapInArrow(deal, schema)
    by = "_cell"
    order = F.row_number().over(_window(by, seed)) - 1
    cells = spark.createDataFrame([(i, int(s), int(f)) for i, (s, f) in enumerate(zip(cell_shard, cell_first, strict=True))], "_cell long, shard int, _first long")
    out = dealt.withColumn("_rank", order).join(F.broadcast(cells) if len(sizes) <= 200_000 else cells, by)
    return out.select(*[F.col(c).alias(n) for c, n in zip(own, df.columns, strict=True)], "shard", (F.col("_first") + F.col("_rank")).alias("slot"))


def _window(cell: str, seed: int):
    from pyspark.sql import Window

    return Window.partitionBy(cell).orderBy(F.xxhash64(F.lit(seed), "_part", "_at"), "_part", "_at")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all documents in 24 shards under the law `rows`: counts differ by one at most."""
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffle_into_shards(docs, 24).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
