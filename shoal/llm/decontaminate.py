"""Benchmark decontamination by suffix arrays over shards of the training texts.

Each shard, some megabytes of whole texts, gets an array of its suffixes in order of their first
`window` words. Every suffix of the benchmark items is binary-searched in it: the range found holds
all places where the item's next `window` words stand verbatim. Equal suffixes are searched once, and
a hit is a place and a distinct window, however many items share it. Hits that continue along the same
item are followed in the longest runs of hits alone, which gives the longest verbatim match and its
place. Shards are independent, so the texts are read once and nothing is shuffled.

Only suffixes that could match are sorted: those whose next words all occur in the benchmark. Words
are compared by their 64-bit hashes.

Benchmark items are the query side. They are cut into blocks of at most `block_bytes` bytes; each
block is broadcast and the texts pass through one block after another, carrying their hits along.

Nulls and texts without words have no windows and are clean. An item of fewer than `window` words is
one window; items without words, or with a null id, or repeated: without words they match nothing,
with a null id they contaminate but are not counted or listed, repeated ids count once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm.bytetext import ALNUM, words
from shoal.llm.shared import tune

WINDOW, BLOCK_BYTES = 10, 8 << 20
SHARD = 2 << 20


class Suffixes:
    """The windows of a block of items, as big-endian keys of word ranks, in order."""

    def __init__(self, texts: list[str | None], ids: list[str | None], window: int) -> None:
        hashes, first = [], [0]
        for part in words(pa.array(texts, pa.large_string()), ALNUM):
            hashes.append(part.hash)
            first += (part.first[1:] + first[-1] - part.first[0]).tolist()
        h = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        first = np.array(first)
        n = np.diff(first)
        self.window, self.ids = window, ids
        self.vocabulary, rank = np.unique(h, return_inverse=True)
        self.likely = np.zeros(1 << 20, bool)
        self.likely[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        #: Of each window its place in the items' words, its item and its length.
        item = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(h))
        left = first[1:][item] - at
        ok = (left >= window) | ((at == first[item]) & (left > 0))
        self.at, self.item, self.length = at[ok], item[ok], np.minimum(left[ok], window)
        self.shortest = int(self.length.min()) if ok.any() else 0
        self.keys = {}
        #: Distinct windows are numbered; window i stands at self.places[self.begin[i] : self.begin[i + 1]] of the items' words.
        places, begin = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        for m in np.unique(self.length).tolist():
            of = np.flatnonzero(self.length == m)
            unique, group = np.unique(packed(rank + 1, self.at[of], m), return_inverse=True)
            self.keys[m] = unique, sum(map(len, begin)) - 1
            order = np.argsort(group, kind="stable")
            places.append(self.at[of][order])
            begin.append(np.cumsum(np.bincount(group, minlength=len(unique))) + begin[-1][-1])
        self.places, self.begin = np.concatenate(places), np.concatenate(begin)
        self.item_at = item
        #: Windows that the same items have share a set; a single item's set has the item's number.
        self.items = [[x] if x is not None else [] for x in ids]
        of = np.unique(np.repeat(np.arange(len(self.begin) - 1), np.diff(self.begin)) * max(1, len(n)) + item[self.places])
        window_of, item_of = np.divmod(of, max(1, len(n)))
        first_of = np.searchsorted(window_of, np.arange(len(self.begin)))
        self.set_of = item_of[first_of[:-1]]
        sets: dict[bytes, int] = {}
        for i in np.flatnonzero(np.diff(first_of) > 1).tolist():
            mine = item_of[first_of[i] : first_of[i + 1]]
            if (key := mine.tobytes()) not in sets:
                sets[key] = len(self.items)
                self.items.append([ids[x] for x in mine.tolist() if ids[x] is not None])
            self.set_of[i] = sets[key]


def packed(rank: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The ranks at[i] to at[i] + width - 1 as one byte string each, ordered as the ranks are."""
    padded = np.append(rank, np.zeros(width, rank.dtype))
    out = np.empty((len(at), width), ">u4")
    for i in range(width):
        out[:, i] = padded[at + i]
    return out.view(f"S{4 * width}").ravel() if len(at) else np.zeros(0, f"S{4 * width}")


def search(h: np.ndarray, first: np.ndarray, s: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, distinct window, length) of every hit in a shard of words h, by place."""
    none = np.zeros(0, np.int64)
    spot = np.flatnonzero(s.likely[(h >> np.uint64(44)).astype(np.int64)]) if s.shortest else none
    if not len(spot):
        return none, none, none
    rank = np.zeros(len(h) + 1, np.int64)
    at = np.minimum(np.searchsorted(s.vocabulary, h[spot]), len(s.vocabulary) - 1)
    ok = s.vocabulary[at] == h[spot]
    rank[spot[ok]] = at[ok] + 1
    # How many known words follow from each place on, within its text.
    stop = np.zeros(len(h) + 1, bool)
    stop[rank == 0] = True
    last = np.flatnonzero(stop)
    run = last[np.searchsorted(last, np.arange(len(h)))] - np.arange(len(h))
    end = first[np.searchsorted(first, np.arange(len(h)), "right")]
    run = np.minimum(run, end - np.arange(len(h)))
    keep = np.flatnonzero(run >= s.shortest)
    if not len(keep):
        return none, none, none
    # The suffix array: kept places in order of their next words, words beyond the run as 0.
    width = max(s.keys)
    padded = np.append(rank, np.zeros(width, np.int64))
    table = np.zeros((len(keep), width), ">u4")
    for i in range(width):
        table[:, i] = np.where(run[keep] > i, padded[keep + i], 0)
    key = table.view(f"S{4 * width}").ravel()
    order = np.argsort(key, kind="stable")
    array, suffixes = keep[order], key[order]
    places, windows, lengths = [none], [none], [none]
    for m, (unique, number) in s.keys.items():
        low = np.searchsorted(suffixes, unique.astype(suffixes.dtype), "left")
        top = np.full((len(unique), width), 0xFFFFFFFF, ">u4")
        top[:, :m] = unique.view(">u4").reshape(len(unique), m) if unique.dtype.itemsize == 4 * m else 0
        high = np.searchsorted(suffixes, top.view(f"S{4 * width}").ravel(), "right")
        n = high - low
        hit = np.flatnonzero(n)
        if not len(hit):
            continue
        places.append(array[np.repeat(low[hit], n[hit]) + ranges(n[hit])])
        windows.append(np.repeat(hit, n[hit]) + number)
        lengths.append(np.full(int(n[hit].sum()), m))
    place, window, length = (np.concatenate(x) for x in (places, windows, lengths))
    order = np.lexsort((length, place))
    return place[order], window[order], length[order]


def ranges(n: np.ndarray) -> np.ndarray:
    """0 to n[0] - 1, then 0 to n[1] - 1, and so on."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def longest_match(place: np.ndarray, window: np.ndarray, length: np.ndarray, s: Suffixes) -> tuple[int, int, int] | None:
    """(words, place, item) of the longest verbatim match among the hits of one text, the first of the
    longest; runs of hits are followed from the one that could hold the longest on."""
    if not len(place):
        return None
    cut = np.append(np.flatnonzero(np.append(True, place[1:] > place[:-1] + 1)), len(place))
    reach = np.maximum.reduceat(place + length, cut[:-1]) - place[cut[:-1]]
    best = (0, 0, 0)  # words, minus the place, minus the place in the items' words
    for r in np.lexsort((place[cut[:-1]], -reach)).tolist():
        if reach[r] < best[0] or (reach[r] == best[0] and -place[cut[r]] < best[1]):
            break
        at, since, before = np.zeros(0, np.int64), np.zeros(0, np.int64), -2
        low = cut[r]
        while low < cut[r + 1]:
            high = int(np.searchsorted(place[: cut[r + 1]], place[low], "right"))
            here = np.concatenate([s.places[s.begin[w] : s.begin[w + 1]] for w in window[low:high].tolist()])
            words = np.repeat(length[low:high], [s.begin[w + 1] - s.begin[w] for w in window[low:high].tolist()])
            order = np.argsort(here, kind="stable")
            here, words = here[order], words[order]
            start = np.full(len(here), place[low])
            if len(at) and before == place[low] - 1:
                spot = np.minimum(np.searchsorted(at, here - 1), len(at) - 1)
                go_on = (at[spot] == here - 1) & (s.item_at[here] == s.item_at[here - 1])
                start[go_on] = since[spot[go_on]]
            size = place[low] - start + words
            top = np.lexsort((here, start, -size))[0]
            best = max(best, (int(size[top]), -int(start[top]), -int(here[top] - (place[low] - start[top]))))
            at, since, before = here, start, place[low]
            low = high
    return best[0], -best[1], int(s.item_at[-best[2]])


OUTPUT = "n_words long, n_hit long, items array<string>, hit_spans binary, longest_words long, longest_at long, longest_item string"


def find_overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs' columns, renamed to _c0, _c1 ..., and those of OUTPUT.

    n_hit: words of the text inside occurrences of windows; items: sorted ids of the items with one;
    longest_*: words, first word (from 0) and item of the longest verbatim match, the first of the
    longest, null without one; hit_spans: pairs of 64-bit word numbers, from and up to.
    """
    spark = docs.sparkSession
    tune(spark)
    own = [f"_c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    out = docs.toDF(*own)
    empty = {"n_words": "0L", "n_hit": "0L", "items": "cast(array() as array<string>)", "hit_spans": "cast('' as binary)", "longest_words": "cast(null as bigint)", "longest_at": "cast(null as bigint)", "longest_item": "cast(null as string)"}
    out = out.select(*own, *[F.expr(e).alias(c) for c, e in empty.items()])
    schema = out.schema
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text"), F.octet_length(F.coalesce(F.col(item_text), F.lit(""))).alias("n"))
    total = items.agg(F.sum("n")).first()[0] or 0
    n_blocks = max(1, -(-int(total) // (block_bytes // 2)))
    for k in range(n_blocks):  # one block at a time is held by the driver
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == k).select("id", "text").orderBy("id", "text").collect() if n_blocks > 1 else items.select("id", "text").orderBy("id", "text").collect()
        block = spark.sparkContext.broadcast(([r["text"] for r in rows], [r["id"] for r in rows]))
        out = out.mapInArrow(_pass(block, window, at, k == n_blocks - 1), schema)
    return out


def _pass(block, window: int, text_at: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Suffixes(*block.value, window)
        ids = np.array(s.ids, object)
        for b in batches:
            old = {c: b.column(c) for c in ("items", "hit_spans", "longest_words", "longest_at", "longest_item")}
            before = [x for x in old["hit_spans"].to_pylist()]
            again = any(before) or old["items"].flatten().__len__() > 0
            n_words, n_hit, items, spans = [], [], [], []
            best: list[tuple] = []
            for part in words(b.column(text_at), ALNUM, SHARD):
                place, win, length = search(part.hash, part.first, s)
                docs = part.high - part.low
                n = np.diff(part.first)
                n_words.append(n)
                cover = np.zeros(len(part.hash) + 1, np.int64)
                np.add.at(cover, place, 1)
                np.add.at(cover, place + length, -1)
                if again:
                    for d in range(docs):
                        was = np.frombuffer(before[part.low + d], np.int64).reshape(-1, 2) + part.first[d]
                        np.add.at(cover, was[:, 0], 1)
                        np.add.at(cover, was[:, 1], -1)
                hit = np.cumsum(cover[:-1]) > 0
                running = np.append(0, np.cumsum(hit))
                n_hit.append(running[part.first[1:]] - running[part.first[:-1]])
                # Spans are cut at the ends of texts.
                edge = hit.copy()
                inner = part.first[1:-1][(part.first[1:-1] > 0) & (part.first[1:-1] < len(hit))]
                begin = np.flatnonzero(hit & ~np.append(False, edge[:-1]))
                begin = np.union1d(begin, inner[hit[inner]]) if len(hit) else begin
                end = np.flatnonzero(hit & ~np.append(edge[1:], False)) + 1
                end = np.union1d(end, inner[hit[inner - 1]]) if len(hit) else end
                doc = np.searchsorted(part.first, begin, "right") - 1
                pairs = np.stack([begin - part.first[doc], end - part.first[doc]], 1).astype(np.int64)
                cut = np.searchsorted(doc, np.arange(docs + 1))
                spans += [pairs[cut[d] : cut[d + 1]].tobytes() for d in range(docs)]
                of = np.searchsorted(part.first, place, "right") - 1
                got: dict[int, set] = {}
                for d, x in set(zip(of.tolist(), s.set_of[win].tolist(), strict=True)):
                    got.setdefault(d, set()).update(s.items[x])
                cut = np.searchsorted(of, np.arange(docs + 1))
                longest = {}
                for d in np.unique(of).tolist():
                    m, p, i = longest_match(place[cut[d] : cut[d + 1]], win[cut[d] : cut[d + 1]], length[cut[d] : cut[d + 1]], s)
                    longest[d] = (m, p - int(part.first[d]), ids[i])
                for d in range(docs):
                    was = old["items"][part.low + d].as_py() if again else []
                    items.append(sorted(got.get(d, set()) | set(was)))
                    mine = longest.get(d)
                    if again and (w := old["longest_words"][part.low + d].as_py()) is not None and (mine is None or (-w, old["longest_at"][part.low + d].as_py()) <= (-mine[0], mine[1])):
                        mine = (w, old["longest_at"][part.low + d].as_py(), old["longest_item"][part.low + d].as_py())
                    best.append(mine or (None, None, None))
            cat = lambda x: np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)
            new = [pa.array(cat(n_words)), pa.array(cat(n_hit)), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.binary()), *(pa.array([x[j] for x in best], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.string())))]
            width = len(b.schema.names) - len(new)
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *new], names=b.schema.names)

    return run


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs without the texts that hold a window of a benchmark item."""
    found = find_overlaps(docs, benchmark, text_col, window=window).where("n_hit = 0")
    return found.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document against every benchmark item, in windows of ten words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        F.col("_c0").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
with w as (
  select 'd' as k, cast(doc_id as varchar) as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as t from documents
  union all
  select 'b', cast(item_id as varchar), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
lengths as (select distinct least(10, len(t)) as m from w where k = 'b' and len(t) > 0),
b as (select id, least(10, len(t)) as m, unnest(list_transform(range(1, len(t) - least(10, len(t)) + 2), lambda i: array_to_string(t[i:i + least(10, len(t)) - 1], ' '))) as g from w where k = 'b' and len(t) > 0),
d as (select id, m, unnest(range(1, len(t) - m + 2)) as p, unnest(list_transform(range(1, len(t) - m + 2), lambda i: array_to_string(t[i:i + m - 1], ' '))) as g from w, lengths where k = 'd' and len(t) >= m),
hits as (select d.id, d.p, d.m, b.id as item from d join b on d.m = b.m and d.g = b.g),
n_hit as (select id, count(*) as n from (select distinct id, unnest(range(p, p + m)) as x from hits) group by id),
items as (select id, count(*) as n, string_agg(item, ',' order by item) as l from (select distinct id, item from hits) group by id)
select cast(w.id as bigint) as doc_id, cast(len(t) as bigint) as n_words, cast(coalesce(n_hit.n, 0) as bigint) as n_hit, cast(coalesce(items.n, 0) as bigint) as n_items,
       sha256(coalesce(l, '')) as items_sha256, coalesce(n_hit.n, 0) > 0 as contaminated
from w left join n_hit using (id) left join items using (id) where k = 'd'
"""
