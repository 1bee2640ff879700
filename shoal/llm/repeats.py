"""Suffix-array dedup of byte strings by a depth-limited radix sort.

Each byte covered by a `window`-byte string that also starts in a document with a smaller id is
found. Suffixes are ordered only through their first `window` bytes, most significant digits first;
groups that are equal then are exactly the repeated strings, and a group with one member is dropped
as soon as a digit sets it apart.

The first digit is the anchor: of the GRAM-byte strings inside a window the one with the least hash
(the leftmost of equal ones). Equal windows have the same anchor at the same distance, and some
seventeen windows in a row share one, so anchors stand for their windows when suffixes are dealt out:

1. Anchors' hashes are dealt out by their top bits, four bytes each; those that occur once are
   settled. The rest mark a bitmap of fixed size, which may hold strangers but misses none.
2. Marked anchors send their context, the bytes of all windows they stand for. Of equal contexts a
   task sends the one with the smallest id; the others are covered already.
   The windows of very frequent anchors are dealt out one by one, by their next digit too.
3. For each anchor, equal contexts are grouped, and the windows of differing ones are refined by
   digits of eight bytes to the full depth. The smallest id of a group stays.
4. The covered spans go back to their documents.

Whole copies of a document are found first, by digest, and covered in full; only if they are few
(COPIES) are they also left out of the rest, which changes costs, not results.

Nulls are empty. Texts shorter than the window are left alone. Null ids come after all others and
cover nothing; rows with equal ids don't cover each other. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm.bytetext import BASE, CHUNK, INVERSE, buffers, mix, powers, spans
from shoal.llm.shared import Repeated, marked, repeated, staged, tune

WINDOW, GRAM = 50, 16
#: Copies that may be sent to all tasks (12 bytes each); bytes a group may bring.
COPIES, GROUP_BYTES = 400_000, 8 << 20
#: How often an anchor is sent by tasks in pass 1, two a million anchors at most, to count as very frequent.
OFTEN = 4096
#: Windows that are compared at once.
SLICE = 200_000
LAST = (1 << 63) - 1


def least_ahead(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of h[i] to h[i + width - 1] at each i."""
    m, have = h, 1
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(h) - width + 1], m[width - have : len(h) - have + 1]) if width > have else m


def anchors(text: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of the texts that end at ends in one array: hash, first window, last window, place of each anchor,
    and the running sums that hashes of other parts are taken from."""
    n, reach = len(text), window - gram + 1
    running = np.zeros(n + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=running[1:])
    if n < window:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z, running
    h = mix((running[gram:] - running[:-gram]) * powers(INVERSE, n)[: n - gram + 1])
    m = least_ahead(h, reach)
    begins = np.concatenate([[0], ends[:-1]])
    long = ends - begins >= window
    # Windows count up to `window` bytes before the end of their text.
    change = np.zeros(len(m) + 1, np.int8)
    np.add.at(change, begins[long], 1)
    np.add.at(change, ends[long] - window + 1, -1)
    valid = np.cumsum(change[:-1]) > 0
    new = np.empty(len(m), bool)
    new[:1] = True
    new[1:] = (m[1:] != m[:-1]) | (h[: len(m) - 1] == m[:-1])
    new[begins[long]] = True
    new &= valid
    first = np.flatnonzero(new)
    if not len(first):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z, running
    doc = np.searchsorted(ends, first, "right")
    last = np.minimum(np.append(first[1:], n) - 1, ends[doc] - window)
    place = np.empty(len(first), np.int64)
    for low in range(0, len(first), 1 << 15):
        f = first[low : low + (1 << 15)]
        place[low : low + len(f)] = f + np.argmax(h[f[:, None] + np.arange(reach)] == m[f][:, None], 1)
    return mix(m[first]), first, last, place, running  # mixed again: least hashes are small ones


def batches_of(b: pa.RecordBatch, skip: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, rows) of chunks of the batch's texts, without the rows whose key is in skip."""
    data, offsets = buffers(b.column("text"))
    gone = np.isin(b.column("key").to_numpy(), skip) if skip is not None and len(skip) else np.zeros(len(b), bool)
    for low, high in spans(offsets, CHUNK):
        stay = np.flatnonzero(~gone[low:high]) + low
        if not len(stay):
            continue
        if len(stay) == high - low:
            text = data[offsets[low] : offsets[high]]
        else:
            text = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in stay])
        yield text, np.cumsum(offsets[stay + 1] - offsets[stay]), stay


def repeated_anchors(docs: DataFrame, skip, window: int, gram: int) -> Repeated:
    """Pass 1: the bitmap of anchors that occur twice or more, and the very frequent ones."""

    def hashes(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        for text, ends, _ in batches_of(b, skip.value):
            yield anchors(text, ends, window, gram)[0]

    return repeated(docs, hashes, often=OFTEN)


SENT = "radix int, n long, blob binary, id long, key long, spans binary"


def contexts(docs: DataFrame, skip, known, radix_bits: int, window: int, gram: int) -> DataFrame:
    """Pass 2: rows with n hold contexts to compare, rows without spans covered already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b.column("id").to_numpy(), b.column("key").to_numpy()
            parts = []
            for text, ends, rows in batches_of(b, skip.value):
                h, first, last, place, running = anchors(text, ends, window, gram)
                known_anchors = Repeated(*known.value)
                hit = np.flatnonzero(marked(known_anchors.bitmap, h))
                if not len(hit):
                    continue
                h, first, last, place = h[hit], first[hit], last[hit], place[hit]
                if (many := known_anchors.many(h)).any():
                    # Windows of one anchor can be equal only at the same distance from it and with the same next
                    # digit, so those of very frequent anchors are dealt out by these, each as its own context.
                    n = np.where(many, last - first + 1, 1)
                    at = np.repeat(np.arange(len(h)), n)
                    h, many, place, step = h[at], many[at], place[at], ranges(n)
                    first, last = first[at] + step, np.where(many, first[at] + step, last[at])
                    digit = mix((running[first + 8] - running[first]) * powers(INVERSE, len(text) + 1)[first] + (place - first).astype(np.uint64))
                    h = np.where(many, mix(h + digit), h)
                c = (running[last + window] - running[first]) * powers(INVERSE, len(text) + 1)[first]
                c = mix(c ^ (last - first).astype(np.uint64) << np.uint64(40) ^ (place - first).astype(np.uint64) << np.uint64(52))
                doc = np.searchsorted(ends, first, "right")
                begin = (np.concatenate([[0], ends[:-1]]))[doc]
                size = last - first + window
                at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
                parts.append((h, c, rows[doc], first - begin, last - first + 1, place - first, text[at]))
            if not parts:
                continue
            h, c, row, first, wins, left = (np.concatenate([p[i] for p in parts]) for i in range(6))
            data = np.concatenate([p[6] for p in parts])
            size = wins + window - 1
            where = np.cumsum(size) - size
            order = np.lexsort((ids[row], c, h))
            same = np.zeros(len(order), bool)
            same[1:] = (h[order[1:]] == h[order[:-1]]) & (c[order[1:]] == c[order[:-1]])
            group = np.flatnonzero(~same)
            smallest = ids[row[order]][group][np.cumsum(~same) - 1]
            covered = ids[row[order]] > smallest
            gone, go = order[covered], order[~covered]
            radix, ns, blobs, out_id, out_key, out_spans = [], [], [], [], [], []
            for i, s in per_row(row[gone], first[gone], first[gone] + size[gone]):
                radix.append(int(keys[i]) & ((1 << radix_bits) - 1)), ns.append(None), blobs.append(None), out_id.append(int(ids[i])), out_key.append(int(keys[i])), out_spans.append(s)
            digit = (h[go] >> np.uint64(64 - radix_bits)).astype(np.int64)
            go = go[np.lexsort((first[go], row[go], digit))]  # by document: its id and key then compress away
            digit.sort()
            cut = np.append(np.flatnonzero(np.append(len(digit) > 0, digit[1:] != digit[:-1])), len(digit))
            for low, high in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                d, g = int(digit[low]), go[low:high]
                at = np.repeat(where[g] - (np.cumsum(size[g]) - size[g]), size[g]) + np.arange(size[g].sum())
                raw = b"".join((ids[row[g]].tobytes(), keys[row[g]].tobytes(), first[g].tobytes(), wins[g].astype(np.uint8).tobytes(), left[g].astype(np.uint8).tobytes(), data[at].tobytes()))
                radix.append(d), ns.append(len(g)), out_id.append(None), out_key.append(len(raw)), out_spans.append(None)
                blobs.append(pa.compress(raw, codec="zstd", asbytes=True))
            yield pa.RecordBatch.from_arrays([pa.array(radix, pa.int32()), pa.array(ns, pa.int64()), pa.array(blobs, pa.binary()), pa.array(out_id, pa.int64()), pa.array(out_key, pa.int64()), pa.array(out_spans, pa.binary())], names=[x.split()[0] for x in SENT.split(", ")])

    return docs.mapInArrow(run, SENT)


def per_row(row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(row, merged spans as pairs of 64-bit numbers) for every row that has some."""
    if not len(row):
        return
    order = np.lexsort((begin, row))
    row, begin, end = row[order], begin[order], end[order]
    # Ends so far, kept apart by row, tell where a new span begins.
    step = np.int64(int(end.max()) + 2)
    reach = np.maximum.accumulate(end + row * step) - row * step
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (begin[1:] > reach[:-1])
    at = np.flatnonzero(new)
    pairs = np.stack([begin[at], reach[np.append(at[1:], len(row)) - 1]], 1)
    rows, cut = np.unique(row[at], return_index=True)
    for i, (a, z) in enumerate(zip(cut, np.append(cut[1:], len(at)), strict=True)):
        yield int(rows[i]), pairs[a:z].tobytes()


def covered_parts(ids: np.ndarray, wins: np.ndarray, left: np.ndarray, data: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pass 3, on the contexts of one radix: (context, from, up to) of the parts that a smaller id has too:
    whole contexts, and windows of others."""
    size = wins + window - 1
    where = np.cumsum(size) - size
    gram_at = where + left
    n_digits = -(-window // 8)
    eights = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(8, np.uint8)), 8)

    def digit(at: np.ndarray, bytes_left: int) -> np.ndarray:
        d = eights[at].view(">u8").ravel().astype(np.uint64)
        return d if bytes_left >= 8 else d >> np.uint64(8 * (8 - bytes_left))

    def refine(group: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order by group and digit, and the new groups in that order."""
        order = np.lexsort((d, group))
        g, x = group[order], d[order]
        new = np.ones(len(order), bool)
        new[1:] = (g[1:] != g[:-1]) | (x[1:] != x[:-1])
        return order, np.cumsum(new) - 1

    # Contexts by anchor: the gram's bytes are the first digits.
    member = np.arange(len(ids))
    group = np.zeros(len(ids), np.int64)
    for i in range(gram // 8):
        order, group = refine(group, digit(gram_at[member] + 8 * i, 8))
        member = member[order]
        several = np.bincount(group)[group] > 1
        member, group = member[several], group[several]
    # Equal contexts need one stand-in: the smallest id; the others are covered in full.
    anchor = group
    form = (wins[member] << 8) | left[member]
    order, group = refine(anchor, form.astype(np.uint64))
    member, anchor = member[order], anchor[order]
    longest = int(size[member].max()) if len(member) else 0
    for i in range(-(-longest // 8)):
        rest = size[member] - 8 * i
        d = digit(np.minimum(where[member] + 8 * i, len(data)), 8)
        short = np.clip(8 - rest, 0, 8).astype(np.uint64)
        d = np.where(short >= 8, np.uint64(0), d >> (np.minimum(short, np.uint64(7)) * np.uint64(8)))
        order, group = refine(group, d)
        member, anchor = member[order], anchor[order]
    order = np.lexsort((ids[member], group))
    member, anchor, group = member[order], anchor[order], group[order]
    head = np.ones(len(member), bool)
    head[1:] = group[1:] != group[:-1]
    smallest = ids[member][np.flatnonzero(head)][np.cumsum(head) - 1] if len(member) else ids[:0]
    full = member[ids[member] > smallest]
    stay, anchor = member[ids[member] == smallest], anchor[ids[member] == smallest]
    out_c, out_w = [full[:0]], [full[:0]]
    # Windows of differing contexts, refined digit by digit; anchors are taken some at a time.
    bounds = np.append(np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])), len(anchor)) if len(anchor) else np.zeros(1, np.int64)
    load = np.append(0, np.cumsum(wins[stay]))[bounds]
    low = 0
    while low < len(bounds) - 1:
        high = max(low + 1, int(np.searchsorted(load, load[low] + SLICE, "right")) - 1)
        part, of = stay[bounds[low] : bounds[high]], anchor[bounds[low] : bounds[high]]
        low = high
        # Windows of one anchor can only be equal if they have the same distance to it.
        c = np.repeat(part, wins[part])
        w = ranges(wins[part])
        group = np.repeat(of, wins[part]) * 64 + (left[c] - w)
        order = np.argsort(group, kind="stable")
        c, w, group = c[order], w[order], group[order]
        for i in range(n_digits):
            new = np.append(True, group[1:] != group[:-1])
            n = np.diff(np.append(np.flatnonzero(new), len(group)))
            several = np.repeat(n > 1, n)
            c, w, group = c[several], w[several], group[several]
            if not len(c):
                break
            order, group = refine(group, digit(where[c] + w + 8 * i, window - 8 * i))
            c, w = c[order], w[order]
        if len(c):
            least = np.full(int(group.max()) + 1, LAST)
            np.minimum.at(least, group, ids[c])
            more = ids[c] > least[group]
            out_c.append(c[more]), out_w.append(w[more])
    c, w = np.concatenate(out_c), np.concatenate(out_w)
    return np.concatenate([full, c]), np.concatenate([np.zeros(len(full), np.int64), w]), np.concatenate([size[full], w + window])


def ranges(n: np.ndarray) -> np.ndarray:
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def compared(sent: DataFrame, window: int, gram: int) -> DataFrame:
    """Pass 3: (id, key, spans) from the contexts of pass 2; spans known already pass through."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        known = t.filter(pc.is_null(t.column("n"))).select(["id", "key", "spans"])
        t = t.filter(pc.is_valid(t.column("n")))
        if not len(t):
            return known
        cols: list[list[np.ndarray]] = [[] for _ in range(6)]
        for n, raw_size, blob in zip(t.column("n").to_pylist(), t.column("key").to_pylist(), t.column("blob"), strict=True):
            raw = pa.decompress(blob.as_buffer(), raw_size, codec="zstd")
            at = 0
            for i, kind in enumerate((np.int64, np.int64, np.int64, np.uint8, np.uint8)):
                cols[i].append(np.frombuffer(raw, kind, n, at))
                at += n * np.dtype(kind).itemsize
            cols[5].append(np.frombuffer(raw, np.uint8, -1, at))
        ids, keys, first, wins, left, data = (np.concatenate(x) for x in cols)
        c, begin, end = covered_parts(ids, wins.astype(np.int64), left.astype(np.int64), data, window, gram)
        names, row = np.unique(keys, return_inverse=True)
        owner = np.zeros(len(names), np.int64)
        owner[row] = ids
        got = list(per_row(row[c], first[c] + begin, first[c] + end))
        found = pa.table({"id": pa.array([int(owner[i]) for i, _ in got], pa.int64()), "key": pa.array([int(names[i]) for i, _ in got], pa.int64()), "spans": pa.array([s for _, s in got], pa.binary())})
        return pa.concat_tables([known.cast(found.schema), found])

    return sent.groupBy("radix").applyInArrow(run, "id long, key long, spans binary")


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, keep: bool = True) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, spans (pairs of 64-bit byte numbers, from
    and up to, in order, apart), kept_sha256, kept (bytes; null unless asked for)."""
    spark = docs.sparkSession
    tune(spark)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), text.alias("text"))
    rows = rows.select("id", "text", F.xxhash64("id", "text").alias("key"))
    copies = staged(rows.select("id", "key", F.octet_length("text").alias("n"), F.md5("text").alias("digest")), "digests")
    groups = copies.where(f"n >= {window}").groupBy("digest", "n").agg(F.min("id").alias("least"), F.count("*").alias("c")).where("c > 1").drop("c")
    groups = staged(groups, "copy-groups")
    copied = staged(copies.join(F.broadcast(groups) if groups.count() <= COPIES else groups, ["digest", "n"]).where(f"id > least and n >= {window}").select("id", "key", "n").distinct(), "copies")
    total = copies.agg(F.sum("n")).first()[0] or 0
    few = copied.count() <= COPIES
    skip = spark.sparkContext.broadcast(np.sort(np.array([r["key"] for r in copied.select("key").collect()], np.int64)) if few else None)
    bits = max(6, math.ceil(math.log2(max(1, total) / GROUP_BYTES)))
    known = spark.sparkContext.broadcast(tuple(repeated_anchors(rows, skip, window, gram)))
    sent = contexts(rows, skip, known, bits, window, gram)
    whole = copied.select("id", "key", F.lit(None).cast("binary").alias("spans"))
    found = compared(sent, window, gram).unionByName(whole)
    cover = staged(found.groupBy("id", "key").agg(F.collect_list("spans").alias("lists"), F.max(F.col("spans").isNull()).alias("whole")), "cover")
    touched = spark.sparkContext.broadcast(key_bits(cover))

    def marked(b: pa.RecordBatch) -> np.ndarray:
        spot = (b.column("key").to_numpy().view(np.uint64) >> np.uint64(41)).astype(np.int64)
        return touched.value[spot >> 3] >> (spot & 7).astype(np.uint8) & 1 > 0

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield finished(b.take(pa.array(np.flatnonzero(~marked(b)))), None, keep)

    def pass_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.take(pa.array(np.flatnonzero(marked(b))))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield finished(b, (b.column("lists").to_pylist(), b.column("whole").to_pylist()), keep)

    joined = rows.mapInArrow(pass_on, rows.schema).join(cover, ["id", "key"], "left")
    out = rows.mapInArrow(untouched, DONE).unionByName(joined.mapInArrow(finish, DONE))
    return out.select(F.nullif("id", F.lit(LAST)).alias(id_col), "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept")


DONE = "id long, n_bytes long, n_removed long, n_spans long, spans binary, kept_sha256 string, kept binary"


def key_bits(keys: DataFrame, bits: int = 23) -> np.ndarray:
    """Bitmap of 1 MB over the keys' top bits: only those hit are looked up."""
    spot = F.shiftrightunsigned("key", 64 - bits)
    got = keys.select(spot.alias("s")).groupBy(F.shiftright("s", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    if got.num_rows:
        out[got["word"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    return out.view(np.uint8)


def finished(b: pa.RecordBatch, lists, keep: bool) -> pa.RecordBatch:
    """Results of the batch's documents, of which lists has the spans of each and whether it goes whole."""
    n_bytes, removed, n_spans, out, sha, kept = [], [], [], [], [], []
    for i, text in enumerate(b.column("text")):
        raw = memoryview(text.as_buffer())
        pairs = np.zeros((0, 2), np.int64)
        if lists is not None and lists[1][i]:
            pairs = np.array([[0, len(raw)]], np.int64)
        elif lists is not None and lists[0][i]:
            p = np.frombuffer(b"".join(lists[0][i]), np.int64).reshape(-1, 2)
            pairs = np.frombuffer(next(per_row(np.zeros(len(p), np.int64), p[:, 0], p[:, 1]))[1], np.int64).reshape(-1, 2)
        left = b"".join(raw[a:z] for a, z in zip([0, *pairs[:, 1].tolist()], [*pairs[:, 0].tolist(), len(raw)], strict=True))
        n_bytes.append(len(raw)), removed.append(int((pairs[:, 1] - pairs[:, 0]).sum())), n_spans.append(len(pairs)), out.append(pairs.tobytes())
        sha.append(hashlib.sha256(left).hexdigest()), kept.append(left if keep else None)
    return pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(x, pa.int64()) for x in (n_bytes, removed, n_spans)), pa.array(out, pa.binary()), pa.array(sha), pa.array(kept, pa.binary())], names=[x.split()[0] for x in DONE.split(", ")])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all documents, strings of 50 bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_repeats(docs, keep=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


SQL = """
with b as (select doc_id, coalesce(hex(encode(text)), '') as h from documents),
q as (select doc_id, o, substr(h, 2 * o + 1, 498) as h from (select doc_id, h, unnest(range(0, len(h) // 2 - 49, 200)) as o from b)),
g as (select doc_id, o + p as p, hash(substr(h, 2 * p + 1, 100)) as s from (select doc_id, o, h, unnest(range(0, len(h) // 2 - 49)) as p from q)),
m as (select s, min(doc_id) as least from g group by s having count(*) > 1),
hit as (select g.doc_id, g.p from g join m using (s) where g.doc_id > m.least),
i as (select *, sum(case when p <= before + 50 then 0 else 1 end) over (partition by doc_id order by p) as island from (select *, lag(p) over (partition by doc_id order by p) as before from hit)),
r as (select doc_id, island, min(p) as a, max(p) + 50 as z from i group by all),
t as (select doc_id, cast(sum(z - a) as bigint) as n_removed, count(*) as n_spans from r group by doc_id),
k as (select doc_id, coalesce(lag(z) over (partition by doc_id order by a), 0) as a, a as z from r union all select b.doc_id, coalesce(max(r.z), 0), len(any_value(b.h)) // 2 from b left join r using (doc_id) group by b.doc_id),
c as (select b.doc_id, string_agg(substr(b.h, cast(2 * k.a + 1 as bigint), cast(2 * (k.z - k.a) as bigint)), '' order by k.a) as h from b join k using (doc_id) group by b.doc_id)
select b.doc_id, cast(len(b.h) // 2 as bigint) as n_bytes, coalesce(t.n_removed, 0) as n_removed, coalesce(t.n_spans, 0) as n_spans, sha256(unhex(c.h)) as kept_sha256
from b join c using (doc_id) left join t using (doc_id)
"""
