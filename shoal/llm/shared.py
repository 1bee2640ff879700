"""Staging in the cluster's shared folder, Arrow batch limits and connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import math
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch may hold on its way to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def tune(spark: SparkSession) -> None:
    """Bounds the Arrow batches, so that very long texts can't gather in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir. Without that setting a local one, where one machine does
    all the work, as in tests; on a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="shoal-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def free_name(columns: list[str], stem: str) -> str:
    """A name that begins with stem and that no column has, whatever the case."""
    taken, name = {c.lower() for c in columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def clean() -> None:
        try:
            delete(spark, path)
        except Exception:  # the session has gone first; the folder's owner clears it
            pass

    atexit.register(clean)
    return path


def free_shuffles(spark: SparkSession) -> None:
    """Lets the driver's collector find the plans that staged tables have replaced: Spark deletes the shuffle
    files of plans that nothing refers to, which else stay until the driver happens to need memory. Memory
    that the driver's Python and Arrow have freed goes back to the system, too."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
    spark.sparkContext._jvm.System.gc()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: later plans start from those files."""
    return staged_parts([df], name)


def staged_parts(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """Writes one frame after the other, the shuffles of each freed before the next begins, and reads all of them back."""
    at, path, schema, spark = [], "", None, None
    for df in parts:
        if at:
            free_shuffles(spark)
        else:
            schema, spark = df.schema, df.sparkSession
            path = new_path(spark, name)
        at.append(f"{path}/{len(at)}")
        df.write.option("compression", "zstd").parquet(at[-1])
    out = spark.read.schema(schema).parquet(*at)
    out.staged_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the files of staged frames that no plan reads again."""
    for df in frames:
        delete(df.sparkSession, df.staged_path)


def in_rounds(df: DataFrame, keys: list[str], size: float, room: float) -> Iterator[DataFrame]:
    """df's rows, dealt by the keys to as many frames as keep each one's share of size within room."""
    n = max(1, math.ceil(size / room))
    for i in range(n):
        yield df.where(F.pmod(F.xxhash64(F.lit("round"), *keys), F.lit(n)) == i) if n > 1 else df


def planes(x: np.ndarray, in_order: bool = False) -> bytes:
    """The numbers' first bytes, then their second ones and so on, which compress well where they are alike;
    in_order: of numbers in ascending order, the steps between them."""
    if in_order and len(x):
        x = np.append(x[:1], x[1:] - x[:-1])
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def of_planes(raw, kind: type, n: int, at: int = 0, in_order: bool = False) -> np.ndarray:
    """n numbers from planes()."""
    size = np.dtype(kind).itemsize
    x = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel()
    return np.cumsum(x, dtype=kind) if in_order else x


#: Bits of the table of hashes that occur again (16 MB), hashes that one task deals out at once.
AGAIN_BITS, DEALT = 27, 1_000_000


class Repeated(NamedTuple):
    bitmap: np.ndarray  # over the top bits of the hashes that occur twice or more; misses none, may hold strangers
    often: np.ndarray  # sorted first bits of the hashes that were sent `often` times or more
    first_bits: int

    def many(self, h: np.ndarray) -> np.ndarray:
        """Which of the hashes are among those that occur often."""
        if not len(self.often):
            return np.zeros(len(h), bool)
        x = h >> np.uint64(64 - self.first_bits)
        return self.often[np.minimum(np.searchsorted(self.often, x), len(self.often) - 1)] == x


def repeated_bits(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int = AGAIN_BITS) -> np.ndarray:
    return repeated(df, hashes, bits).bitmap


def repeated(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int = AGAIN_BITS, often: int = 1 << 62) -> Repeated:
    """Which of the 64-bit hashes occur twice or more, as a bitmap of fixed size that holds the more strangers
    the fuller it is, and which are sent `often` times or more: at most a list of one for each so many sent.

    Hashes are dealt out by their top bits, 32 bits each, packed in order; of those that a task has seen
    several times at once two are sent; the driver gets the parts of the bitmap. There are as many groups
    as the reading takes tasks, four times over, so that a group's size doesn't grow with the input.
    """
    radix_bits = min(bits - 3, max(6, math.ceil(math.log2(max(1, df.rdd.getNumPartitions()))) + 2))
    piece_bits = bits - radix_bits

    def send(have: list[np.ndarray]) -> pa.RecordBatch:
        h = np.concatenate(have)
        h.sort()
        h = h[np.append(np.ones(min(2, len(h)), bool), (h[2:] != h[1:-1]) | (h[2:] != h[:-2]))]
        cut = np.searchsorted(h >> np.uint64(64 - radix_bits), np.arange((1 << radix_bits) + 1, dtype=np.uint64))
        low = ((h << np.uint64(radix_bits)) >> np.uint64(32)).astype(np.uint32)
        some = np.flatnonzero(np.diff(cut))
        blobs = [pa.compress(planes(low[cut[i] : cut[i + 1]], in_order=True), codec="zstd", asbytes=True) for i in some]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.diff(cut)[some]), pa.array(blobs, pa.binary())], names=["radix", "n", "low"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, size = [], 0
        for b in batches:
            for h in hashes(b):
                have.append(h)
                size += len(h)
                if size > DEALT:
                    yield send(have)
                    have, size = [], 0
        if size:
            yield send(have)

    def settle(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        low = np.concatenate([of_planes(pa.decompress(x.as_buffer(), 4 * n, codec="zstd"), np.uint32, n, in_order=True) for x, n in zip(t.column("low"), t.column("n").to_pylist(), strict=True)])
        low.sort()
        found = np.zeros(1 << piece_bits, bool)
        found[low[1:][low[1:] == low[:-1]] >> np.uint32(32 - piece_bits)] = True
        begin = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        many = low[begin[np.diff(np.append(begin, len(low))) >= often]]
        return pa.table({"radix": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(found, bitorder="little").tobytes()], pa.binary()), "many": pa.array([many.tobytes()], pa.binary())})

    out = np.zeros((1 << radix_bits, (1 << piece_bits) // 8), np.uint8)
    many = [np.zeros(0, np.uint64)]
    for r in df.mapInArrow(deal, "radix int, n long, low binary").groupBy("radix").applyInArrow(settle, "radix int, bits binary, many binary").toLocalIterator():
        out[r["radix"]] = np.frombuffer(r["bits"], np.uint8)
        many.append(np.frombuffer(r["many"], np.uint32).astype(np.uint64) | np.uint64(r["radix"] << 32))
    return Repeated(out.ravel(), np.sort(np.concatenate(many)), radix_bits + 32)


def marked(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes fall on a bit of repeated_bits()."""
    spot = (h >> np.uint64(64 - (8 * len(bitmap) - 1).bit_length())).astype(np.int64)
    return bitmap[spot >> 3] >> (spot & 7).astype(np.uint8) & 1 > 0


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels of all nodes of the edges of one task."""
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if not parts:
        return
    ends = np.stack([np.concatenate(x) for x in zip(*parts, strict=True)])
    node, index = np.unique(ends, return_inverse=True)
    root = list(range(len(node)))
    for i, j in index.reshape(2, -1).T.tolist():
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        while root[j] != j:
            root[j] = root[root[j]]
            j = root[j]
        if i != j:  # the smaller node stays
            root[max(i, j)] = min(i, j)
    for i, r in enumerate(root):  # a root stands before what hangs on it
        root[i] = root[r]
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[root])], names=["node", "label"])


#: Edges that one task merges by itself, at 16 bytes each.
MOST_IN_ONE_TASK = 1_000_000


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components: few edges are merged by one task, many by alternating large and small stars.

    edges has two long columns, x and y; self loops and repeated edges are fine. Returns (node,
    label) for every node of an edge between different nodes, label being the smallest node of the
    component. Each round of stars is a group minimum and a join, and is written to the shared folder;
    the driver only reads the number of edges and a checksum.
    """
    pairs = edges.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
    pairs = staged(pairs, name)
    if pairs.count() <= MOST_IN_ONE_TASK:
        return staged(pairs.coalesce(1).mapInArrow(_merge, "node long, label long"), name)
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        pairs = staged(small.where("u <> v").distinct(), name)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
