"""URL filter: list rules first, then logistic regression on hashed character n-grams.

The regression reads the n-grams (3 to 5 characters) of `^host|path$`, hashed to 2**16 weights, each
text scaled to unit length. It is fitted on the driver from a small labelled table of URLs, of which
at most `max_train` rows are used (the smallest by hash); the weights are 512 KB at any input size.
Give your own table where you have one; the query, for which none is there, takes default_table().

Nulls, urls without `://` and empty ones have an empty host and path: no rule fits, the regression
judges the empty text. Rows are judged one by one, so ties, repeats and empty tables need no rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm.bytetext import BASE, buffers, mix, spans
from shoal.llm.shared import tune

BITS, SIZES = 16, (3, 4, 5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


#: The query's rules.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)
#: Words of the default labelled table: what unwanted sites are about, and what others are about.
BAD = "casino poker roulette slots jackpot lottery betting wager bets viagra pills pharma steroids diet porn xxx adult nude escort dating loans payday cash debt cheap replica fake bonus free prize winner giveaway forex warez crack keygen torrent hack cheats spam scam phishing malware popunder clickbait followers".split()
GOOD = "news journal weather library archive museum school university science physics biology garden flowers recipes kitchen music concert theatre cinema travel railway airport hotel maps history church hospital clinic council parliament bank insurance forum blog wiki docs manual software hardware bicycle football tennis chess photo paint poetry novel bookshop bakery farmers mountain river harbour market studio workshop".split()
TLDS = ("com", "net", "org", "info", "co.uk", "eu", "io")
PATHS = ("", "/", "/index.html", "/about", "/2019/05/14/post", "/p/{n}", "/category/{n}/page-2.html", "/en/article/{n}", "/static/{n}.pdf")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no `://`."""
    pattern = r"^(?s)(?:(?!://).)*://([^/?#]*)([^?#]*)"
    part = [F.coalesce(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2)]
    return F.translate(part[0], UPPER, LOWER), part[1]


def ngram_ids(arr: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For row ranges: the rows and the hashed ids of their n-grams."""
    data, offsets = buffers(arr)
    for low, high in spans(offsets, 1 << 18):
        text = data[offsets[low] : offsets[high]].astype(np.uint64)
        row = np.repeat(np.arange(high - low), np.diff(offsets[low : high + 1]))
        left = (offsets[low + 1 : high + 1] - offsets[low])[row] - np.arange(len(text))
        ids, rows = [], []
        g = np.zeros(len(text), np.uint64)
        for n in range(1, SIZES[-1] + 1):
            g[: len(text) - n + 1] = g[: len(text) - n + 1] * np.uint64(BASE) + text[n - 1 :] + np.uint64(1)
            if n in SIZES:
                ok = left >= n
                ids.append((mix(g[ok] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64))
                rows.append(row[ok])
        yield low, high, np.concatenate(rows), np.concatenate(ids)


def scores(arr: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Probability of class 1 for each text; the last weight is the bias."""
    out = np.empty(len(arr))
    for low, high, rows, ids in ngram_ids(arr):
        n = np.bincount(rows, minlength=high - low)
        z = np.bincount(rows, weights[ids], minlength=high - low) / np.sqrt(np.maximum(n, 1)) + weights[-1]
        out[low:high] = 1 / (1 + np.exp(-z))
    return out


def train(texts: list[str], labels: list[int], l2: float = 0.1, steps: int = 100, rate: float = 0.5) -> np.ndarray:
    """Full-batch Adam; the same rows give the same weights."""
    y = np.array(labels, float)
    w = np.zeros((1 << BITS) + 1)
    parts = [(low + rows, ids) for low, _, rows, ids in ngram_ids(pa.array(texts, pa.large_string()))]
    if not len(y) or not parts:
        return w
    rows, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
    n = np.bincount(rows, minlength=len(y))
    scale = 1 / np.sqrt(np.maximum(n, 1))
    weight = np.full(len(y), 1 / len(y))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(np.bincount(rows, w[ids], minlength=len(y)) * scale + w[-1])))
        error = (p - y) * weight
        g = np.append(np.bincount(ids, (error * scale)[rows], minlength=1 << BITS), error.sum()) + l2 * w / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate / (1 + t / 100) * 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def name(n: int) -> str:
    """The n-th of a row of made-up names of two to four syllables."""
    x, out = n * 2654435761 + 12345, ""
    for _ in range(2 + n % 3):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out += "bcdfghjklmnprstvwz"[(x >> 33) % 18] + "aeiouy"[(x >> 45) % 6] + ("", "n", "r", "s")[(x >> 55) % 4]
    return out


def default_table() -> list[tuple[str, int]]:
    """Labelled urls by rule, 1 for unwanted; a stand-in where no labelled table is given.

    Unwanted: hosts of one or two words of theirs, or a made-up host with such a word in the path.
    Others: hosts of ordinary words, of made-up names, or of both, behind the usual prefixes.
    """
    rows = []
    pick = lambda of, n: of[n * 7 % len(of)]
    for label, own in ((1, BAD), (0, GOOD)):
        for i, word in enumerate(own):
            for k in range(6):
                n = i * 6 + k
                other, tld, path = own[(i * 5 + k * 11 + 3) % len(own)], pick(TLDS, n), pick(PATHS, n + k).format(n=n * 37 % 1000)
                host = (f"{word}-{other}", f"{word}{other}", f"{name(n)}{word}", f"{word}{n % 100}", f"{word}.{name(n)}", f"{name(n)}-{word}")[k]
                rows.append((f"http{'s' * (n % 2)}://{('', 'www.', 'm.')[n % 3]}{host}.{tld}{path}", label))
            rows.append((f"https://{name(i)}.{pick(TLDS, i)}/{word}/{own[(i + 9) % len(own)]}-{i}.html", label))
    for i in range(900):  # names say nothing, whatever their paths
        rows.append((f"http{'s' * (i % 2)}://{('', 'www.', 'blog.', 'm.', 'shop.')[i % 5]}{name(1000 + i)}.{pick(TLDS, i)}{pick(PATHS, i).format(n=i * 37 % 1000)}", 0))
    return rows


def features(host: Column, path: Column) -> Column:
    return F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$"))


def fit(labelled: DataFrame, max_train: int = 20_000) -> np.ndarray:
    """Weights from labelled (url string, label 0 or 1); rows with a null in either are left out."""
    host, path = host_path(F.col("url"))
    rows = labelled.where("url is not null and label in (0, 1)").select(features(host, path).alias("x"), "label", F.xxhash64("url").alias("h"))
    got = rows.orderBy("h", "x", "label").limit(max_train).collect()
    return train([r.x for r in got], [r.label for r in got])


def filter_urls(df: DataFrame, weights: np.ndarray, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict (allow or block), score (of being bad).

    The longest fitting rule decides, else the score: block from threshold on. A rule fits its host
    and all subdomains if the path starts with the rule's path. Other columns of df are not returned.
    """
    tune(df.sparkSession)
    host, path = host_path(F.col(url_col))
    seen = df.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):  # the longest is asked first
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, r.host + r.path).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    seen = seen.select("*", rule.alias("rule"), verdict.alias("listed"))
    schema = seen.select(id_col, "host", "path", "rule", F.col("listed").alias("verdict"), F.lit(0.5).alias("score")).schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            host, path, listed = (b.column(c) for c in ("host", "path", "listed"))
            text = pa.compute.binary_join_element_wise("^", host, "|", path, "$", "")
            score = scores(text, weights)
            own = pa.array(np.where(score >= threshold, "block", "allow"), pa.string())
            verdict = pa.compute.coalesce(listed.cast(pa.string()), own)
            yield pa.RecordBatch.from_arrays([b.column(id_col), host, path, b.column("rule"), verdict, pa.array(score)], names=[id_col, "host", "path", "rule", "verdict", "score"])

    return seen.mapInArrow(judge, schema)


def query(spark: SparkSession, sf_dir: str, labelled: DataFrame | None = None) -> DataFrame:
    """op1: every page's url by the rules above, the rest by the regression fitted on labelled (url, label) or
    the default table."""
    if labelled is None:
        labelled = spark.createDataFrame(default_table(), "url string, label int")
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), fit(labelled))
