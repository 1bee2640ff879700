"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

Unit vectors, padded to a power of two, are turned by three rounds of random signs and a fast
Hadamard transform. The coordinate of the largest size, with its sign, is a vector's hash: the nearest
corner of the cross-polytope. A table's bucket joins HASHES such hashes. Besides its own bucket
(home) a vector is entered in those of its PROBES next-best corners. Two vectors meet in a bucket if
one of them is at home there.

Pairs that meet are verified by their cosine in double precision, block by block, and only counts
and merged groups leave a task. A pair that meets in several buckets counts in the first of them.
Large buckets are cut into blocks of at most BLOCK vectors; each pair of blocks is a task of its
own, so a bucket of any size is compared in full without being gathered in one place.

Equal vectors are one class, known by a 64-bit hash of label and components, and are entered once. Vectors that are null, zero, or hold nulls, NaN or
infinities link with nothing, as do those without a label; only vectors of equal label and length
are compared. Rows that repeat a vec_id are rows of their own; null ids link but are never the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm.bytetext import BASE, mix
from shoal.llm.shared import components, staged, tune

TABLES, HASHES, PROBES, BLOCK, SEED = 10, 3, 3, 1024, 7


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two; norms are kept."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2)
        h *= 2
    return x.reshape(n, d) / np.sqrt(d)


def rotated(x: np.ndarray, table: int, k: int) -> np.ndarray:
    d = 1 << max(1, int(x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng([SEED, table, k, d])
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], d))
    return y


def buckets(x: np.ndarray) -> np.ndarray:
    """[vector, table, 1 + PROBES] bucket numbers; the first is home."""
    out = np.empty((len(x), TABLES, 1 + PROBES), np.int64)
    for t in range(TABLES):
        corner, size = [], []
        for k in range(HASHES):
            y = rotated(x, t, k)
            best = np.argsort(-abs(y), 1, kind="stable")[:, : 1 + PROBES]
            v = np.take_along_axis(y, best, 1)
            corner.append(2 * best + (v < 0))
            size.append(abs(v))
        home = np.zeros(len(x), np.int64)
        for k in range(HASHES):
            home = home * (1 << 20) + corner[k][:, 0]
        # A probe changes one of the hashes to its next-best corners; the least loss of length comes first.
        options, loss = [], []
        for k in range(HASHES):
            for j in range(1, min(1 + PROBES, corner[k].shape[1])):
                options.append(home + (corner[k][:, j] - corner[k][:, 0]) * (1 << 20 * (HASHES - 1 - k)))
                loss.append(size[k][:, 0] - size[k][:, j])
        pick = np.argsort(np.stack(loss, 1), 1, kind="stable")[:, :PROBES]
        chosen = np.take_along_axis(np.stack(options, 1), pick, 1)
        out[:, t, 0] = home
        out[:, t, 1:] = chosen if chosen.shape[1] == PROBES else np.pad(chosen, ((0, 0), (0, PROBES - chosen.shape[1])), mode="edge")
    return out


def unit(values: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which vectors are usable, and these as unit vectors in double precision."""
    ok, out = np.zeros(len(values), bool), []
    for i, v in enumerate(values):
        if not v.is_valid or v.values.null_count or not len(v.values):
            continue
        x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
        top = abs(x).max()
        if np.isfinite(top) and top > 0:
            x = x / top
            ok[i] = True
            out.append(x / np.sqrt(x @ x))
    return ok, out


def hashed(classes: DataFrame) -> DataFrame:
    """(node, lab, d, weight, codes, x): codes are the keys of the class's buckets, table by table, home first.

    A key mixes label, length, table and bucket. Probes that name a bucket twice are given keys of their own.
    """
    every = 1 + PROBES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, vectors = unit(b.column("v"))
            lab, node, weight = (b.column(c).to_numpy() for c in ("lab", "node", "weight"))
            length = np.array([len(x) for x in vectors])
            for d in np.unique(length):
                of = np.flatnonzero(length == d)
                for low in range(0, len(of), 512):
                    part = of[low : low + 512]
                    x = np.stack([vectors[i] for i in part])
                    raw = buckets(x)
                    again = ~first_of_each(raw)
                    key = mix(raw.astype(np.uint64) + np.arange(TABLES, dtype=np.uint64)[None, :, None] * np.uint64(BASE))
                    key = mix(key ^ mix(lab[part].astype(np.uint64) + np.uint64(d))[:, None, None])
                    own = mix(node[part].astype(np.uint64))[:, None, None] + np.arange(TABLES * every, dtype=np.uint64).reshape(TABLES, every)
                    key = np.where(again, mix(own), key).view(np.int64).reshape(len(part), -1)
                    codes = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * key.shape[1]), pa.array(key.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(node[part]), pa.array(lab[part]), pa.array(np.full(len(part), d, np.int32)), pa.array(weight[part]), codes, pa.array([v.tobytes() for v in x], pa.binary())], names=["node", "lab", "d", "weight", "codes", "x"])

    return classes.mapInArrow(run, "node long, lab long, d int, weight long, codes array<long>, x binary")


def first_of_each(codes: np.ndarray) -> np.ndarray:
    keep = np.ones(codes.shape, bool)
    for j in range(1, codes.shape[2]):
        keep[:, :, j] = (codes[:, :, :j] != codes[:, :, j : j + 1]).all(2)
    return keep


def compare(cosine: float):
    """Function for one pair of blocks of a bucket: (node, n, root) of the members that have links."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        a, z = key[1].as_py(), key[2].as_py()
        table = t.column("t")[0].as_py()
        node, block, home, weight, lab = (t.column(c).to_numpy() for c in ("node", "block", "home", "weight", "lab"))
        x = np.stack([np.frombuffer(v.as_buffer(), np.float64) for v in t.column("x")])
        codes = t.column("codes").combine_chunks().flatten().to_numpy().reshape(len(x), TABLES, 1 + PROBES)
        left, right = np.flatnonzero(block == a), np.flatnonzero(block == z)
        count = np.zeros(len(x), np.int64)
        root = np.arange(len(x))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        bucket = key[0].as_py()
        for low in range(0, len(left), 256):
            part = left[low : low + 256]
            i, j = np.nonzero(x[part] @ x[right].T >= cosine)
            i, j = part[i], right[j]
            keep = (i < j if a == z else i >= 0) & (home[i] | home[j]) & (lab[i] == lab[j])
            i, j = i[keep], j[keep]
            for start in range(0, len(i), 20_000):
                p, q = i[start : start + 20_000], j[start : start + 20_000]
                ok = first_meeting(codes, p, q, table, bucket)
                p, q = p[ok], q[ok]
                np.add.at(count, p, weight[q])
                np.add.at(count, q, weight[p])
                for u, v in zip(p.tolist(), q.tolist(), strict=True):
                    u, v = find(u), find(v)
                    if u != v:
                        root[max(u, v)] = min(u, v)
        some = np.flatnonzero(count)
        return pa.table({"node": pa.array(node[some]), "n": pa.array(count[some]), "root": pa.array(np.array([node[find(i)] for i in some], np.int64))})

    return run


def first_meeting(codes: np.ndarray, p: np.ndarray, q: np.ndarray, table: int, bucket: int) -> np.ndarray:
    """Whether this bucket of this table is the first where the pairs meet."""
    ok = np.ones(len(p), bool)
    for t in range(table + 1):
        a, b = codes[p, t], codes[q, t]
        same = a[:, :, None] == b[:, None, :]
        same[:, 1:, 1:] = False  # one of them is at home
        if t < table:
            ok &= ~same.any((1, 2))
        else:
            ok &= np.where(same, a[:, :, None], np.int64((1 << 63) - 1)).min((1, 2)) == bucket
    return ok


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93) -> DataFrame:
    """One row per vector: id, n_links (other rows linked directly), component_id, kept (id is the component's)."""
    spark = df.sparkSession
    tune(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = F.coalesce(F.col("label").isNotNull() & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0), F.lit(False))
    rows = staged(rows.withColumn("usable", usable).withColumn("cls", F.when(F.col("usable"), F.xxhash64("label", "v", F.size("v")))), "vectors")
    classes = rows.where("usable").groupBy(F.col("cls").alias("node")).agg(F.xxhash64(F.first("label")).alias("lab"), F.first("v").alias("v"), F.count("*").alias("weight"))
    classes = staged(hashed(classes), "vector-classes")
    entry = classes.select("node", "d", F.posexplode("codes").alias("pos", "key"))
    entry = entry.select("node", "d", "key", F.expr(f"pos div {1 + PROBES}").cast("int").alias("t"), (F.col("pos") % (1 + PROBES) == 0).alias("home"))
    # An entry alone in its bucket has no partner; a bucket without a home has no pairs. Only the rest meets its vectors.
    sizes = entry.groupBy("key", "d").agg(F.count("*").alias("c"), F.max("home").alias("some")).where("c > 1 and some").select("key", "d", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    placed = entry.join(sizes, ["key", "d"]).withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks").cast("long")).cast("int"))
    placed = placed.join(classes.drop("d"), "node")
    # Block b is compared with itself and every other one: (b, b), (b, c) for c > b and (a, b) for a < b.
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.withColumn("a", F.least("block", "other")).withColumn("z", F.greatest("block", "other"))
    found = staged(pairs.groupBy("key", "a", "z", "d").applyInArrow(compare(cosine), "node long, n long, root long"), "vector-links")
    labels = components(found.select(F.col("node").alias("x"), F.col("root").alias("y")))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    info = classes.select("node", "weight").join(counts, "node", "left").join(labels, "node", "left").select(F.col("node").alias("cls"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("label", "node").alias("group"))
    out = rows.select("id", "cls").join(info, "cls", "left")
    least = out.where("group is not null").groupBy("group").agg(F.min("id").alias("first"))
    out = out.join(least, "group", "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("first", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all embeddings, cosine of 0.93 or more within a label."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings where label is not null and embedding is not null),
u as (select vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from v),
l as (select a.vec_id as p, b.vec_id as q from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and a.n > 0 and b.n > 0 and len(a.e) = len(b.e)
      where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r as (select vec_id as d, vec_id as c from embeddings union select l.q, r.c from r join l on r.d = l.p),
k as (select d, min(c) as c from r group by d)
select e.vec_id, cast((select count(*) from l where l.p = e.vec_id) as bigint) as n_links, k.c as component_id, e.vec_id = k.c as kept from embeddings e join k on e.vec_id = k.d
"""
