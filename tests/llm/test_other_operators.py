import gzip
import hashlib
import random
import re
import struct
from collections import Counter
from fractions import Fraction

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from shoal.llm import embedding_links, mixing, shuffle_shards, toxicity, url_filter, warc
from shoal.llm import shared
from shoal.llm.shared import components, new_path

# URL filter


def url_by_hand(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
        host, slash, path = rest.partition("/")
        host, path = host.translate(brute.LOWER), slash + path
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best and best.verdict


URLS = [None, "", "no scheme", "://", "http://", "HTTP://A.Org/x?y#z", "https://example.org/es/1", "https://sub.Example.org/en/12/", "https://notexample.org/es/", "http://a.com/fr/", "http://com/de/x", "http://x.org", "http://x.org?a=/b", "ftp://u@h.org:80/p://q", "x://a://b.org/", "http://é.com/fr/é", "http://a.com/de"]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    weights = url_filter.train(*zip(*[(f"^{u}$", y) for u, y in url_filter.default_table()]))
    got = {r["page_id"]: r for r in url_filter.filter_urls(df, weights).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = url_by_hand(u)
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), u
        assert r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow"))
    assert url_filter.filter_urls(df.limit(0), weights).count() == 0


def said(spark, weights, urls):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return np.array([r["verdict"] == "block" for r in url_filter.filter_urls(df, weights, rules=()).orderBy("page_id").collect()])


def test_url_model_on_another_generator(spark):
    """Precision and recall on urls made by another rule: other ordinary words, other hosts and paths."""
    rng = random.Random(11)
    plain = "orchard tailor glacier pottery violin lantern meadow anchor cobbler harvest compass saddle quarry willow ferry".split()
    stem = lambda: "".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    bad = [f"http://{rng.choice(['best', 'top', 'my', 'get', ''])}{w}{rng.choice(['online', '24', 'hub', 'world', '-deals'])}.{rng.choice(['biz', 'top', 'com'])}/{stem()}.php" for w in url_filter.BAD for _ in range(4)]
    good = [f"https://{rng.choice(['the', 'old', 'my', ''])}{w}{rng.choice(['house', '24', 'hub', 'world', ''])}.{rng.choice(['biz', 'top', 'com'])}/{stem()}.php" for w in plain for _ in range(8)]
    good += [f"https://{stem()}{stem()}.{rng.choice(['de', 'fr', 'com'])}/{stem()}/{rng.randint(1, 999)}" for _ in range(120)]
    weights = url_filter.fit(spark.createDataFrame([*url_filter.default_table(), (None, 1), ("http://x", None)], "url string, label int"))
    hit, miss = said(spark, weights, bad), said(spark, weights, good)
    print(f"recall {hit.mean():.3f}, precision {hit.sum() / (hit.sum() + miss.sum()):.3f}, false {miss.sum()} of {len(good)}")
    assert hit.mean() > 0.75 and hit.sum() / (hit.sum() + miss.sum()) > 0.85


def test_url_model_from_a_given_table(spark):
    rows = [(f"http://{'qzx' if i % 3 else 'mlo'}{i}.com/a", int(i % 3 > 0)) for i in range(300)]
    weights = url_filter.fit(spark.createDataFrame(rows, "url string, label int"))
    assert said(spark, weights, ["http://qzx999.net/b", "http://mlo777.net/b"]).tolist() == [True, False]
    assert not url_filter.fit(spark.createDataFrame([], "url string, label int")).any()


def test_url_query_on_verdicts_by_hand(spark, tmp_path):
    urls = {1: ("http://casino-bets.net/x", "block"), 2: ("https://www.library.net/about", "allow"), 3: ("http://casino.org/", "allow"), 4: ("http://library.com/de/1", "block"), 5: ("http://cheap-pills.com/fr/1", "allow"), 6: ("http://cheap-pills.com/en/1", "block")}
    spark.createDataFrame([(i, u, "") for i, (u, _) in urls.items()], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert {r["page_id"]: r["verdict"] for r in url_filter.query(spark, str(tmp_path)).collect()} == {i: v for i, (_, v) in urls.items()}


# Sharding


def test_shards(spark):
    rows = [(i % 40, None if i % 7 == 0 else f"t{i % 5}", 9, 9) for i in range(1003)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, slot long").repartition(5)
    got = shuffle_shards.shuffle_into_shards(df, 7, cell_rows=20).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, t) for i, t, *_ in rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(map(len, by.values())) == [143] * 5 + [144] * 2
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert shuffle_shards.shuffle_into_shards(df.limit(0), 3).count() == 0


def test_matrix_rows_add_up():
    counts, sizes = np.array([5, 0, 17, 3, 11]), np.array([9, 12, 8, 7])
    rows = np.stack([shuffle_shards.matrix_row(counts, sizes, i, 3) for i in range(5)])
    assert (rows.sum(1) == counts).all() and (rows.sum(0) == sizes).all() and (rows >= 0).all()


def test_shuffle_is_uniform():
    counts, sizes = np.array([2, 2]), np.array([2, 2])
    n = Counter(int(shuffle_shards.matrix_row(counts, sizes, 0, s)[0]) for s in range(3000))
    assert abs(n[0] / 3000 - 1 / 6) < 0.03 and abs(n[1] / 3000 - 4 / 6) < 0.04


def test_large_hypergeometric():
    rng = np.random.default_rng(0)
    x = [shuffle_shards.thin(rng, 1000, 3 * 10**9, 6 * 10**8) for _ in range(300)]
    assert abs(np.mean(x) - 1000 * 6e8 / (3e9 + 1000)) < 3 and all(0 <= v <= 1000 for v in x)


# Mixing


THIRDS = {"a": Fraction(1, 3), "b": Fraction(1, 7), "c": Fraction(11, 21)}


@pytest.mark.parametrize("weights", [{"a": 5, "b": 3, "c": 2}, {"a": 1, "b": 1, "c": 1}, {"a": 97, "b": 2, "c": 1}, {"a": 1.0}, {"a": 1e-3, "b": 0.3, "c": 2**-9, "d": 0, "e": 7.77}, {str(i): 1.5**-i for i in range(20)}])
@pytest.mark.parametrize("frame", [5, 64])
def test_blocks_stay_in_their_windows(weights, frame):
    shares = mixing.exact(weights)
    assert sum(shares.values()) == 1 and "d" not in shares
    w = list(shares.values())
    frame, found = mixing.frame_length(w, frame), [[] for _ in w]
    for m in range(max(3, 400 // frame)):
        had, slots = mixing.frame_slots(w, m, frame)
        assert had == [len(f) for f in found]
        for f, x in zip(found, slots, strict=True):
            f += x
    assert sorted(x for f in found for x in f) == list(range(max(3, 400 // frame) * frame))
    for f, share in zip(found, w, strict=True):
        assert all(k // share <= x < -(-(k + 1) // share) for k, x in enumerate(f))


def test_a_million_slots_of_thirds(spark):
    shares = mixing.exact(THIRDS)
    rows = mixing.schedule(spark, shares, 10**6).orderBy("slot").toPandas()
    assert (rows["slot"] == np.arange(len(rows))).all() and len(rows) >= 10**6
    for s, w in shares.items():
        had, at = np.cumsum(rows["s"] == s), np.arange(1, len(rows) + 1)
        assert (abs(had.to_numpy() * w.denominator - at * w.numerator) < w.denominator).all()


def plain_mix(rows, shares, block_rows, seed=1):
    """(id, source, slot, block, epoch) by position of rows (id, source), given the slots of each block."""
    import xxhash

    def key(i):
        h = xxhash.xxh64(struct.pack("<i", seed), seed=42).intdigest()
        h = h if i is None else xxhash.xxh64(struct.pack("<q", i), seed=h).intdigest()
        return h - (1 << 64) if h >> 63 else h

    of = {}
    for i, s in sorted(rows, key=lambda r: key(r[0])):
        of.setdefault(s or "", []).append((i, s))
    w = list(shares.values())
    frame, m, found = mixing.frame_length(w, mixing.FRAME), 0, [[] for _ in w]
    while any(len(f) * block_rows < len(of[s]) for f, s in zip(found, shares, strict=True)):
        for f, x in zip(found, mixing.frame_slots(w, m, frame)[1], strict=True):
            f += x
        m += 1
    slots = 1 + max(f[-(-len(of[s]) // block_rows) - 1] for f, s in zip(found, shares, strict=True))
    out = []
    for s, f in zip(shares, found, strict=True):
        for k, slot in enumerate(f):
            for j in range(block_rows if slot < slots else 0):
                n = k * block_rows + j
                out.append((slot * block_rows + j, *of[s][n % len(of[s])], slot, k, n // len(of[s])))
    return sorted(out)


def test_mix(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(500)] + [(1000 + i, None) for i in range(5)] + [(None, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, mix_slot int").repartition(4)
    got = sorted(map(tuple, mixing.mix_sources(df, block_rows=4).select("mix_position", "doc_id", "source", "mix_slot", "mix_block", "mix_epoch").collect()))
    shares = mixing.exact(mixing.tempered(dict(sorted(Counter(s or "" for _, s in rows).items())), 0.7))
    assert got == plain_mix(rows, shares, 4)
    assert Counter(r[1:3] for r in got if r[5] == 0) == Counter(rows)
    assert mixing.mix_sources(df.limit(0)).count() == 0
    kept = mixing.mix_sources(df, prefix="x_")
    assert kept.columns == ["doc_id", "source", "mix_slot", "x_position", "x_slot", "x_block", "x_epoch"] and {r["mix_slot"] for r in kept.collect()} == {1}


def test_mix_of_odd_weights(spark):
    rows = [(i, "abc"[i % 3], {"k": i}, "z" * (1 << (i % 18))) for i in range(60)]
    df = spark.createDataFrame([*rows, rows[0], rows[0]], "doc_id long, source string, m map<string,int>, t string")
    got = mixing.mix_sources(df, {"a": 0, "b": Fraction(1, 3), "c": 2**-9, "unused": 5}, block_rows=2).collect()
    assert {r["source"] for r in got} == {"b", "c"} and {r["mix_epoch"] for r in got if r["source"] == "c"} == {0}
    assert sorted(r["mix_position"] for r in got) == list(range(len(got)))
    assert len(mixing.mix_sources(df.where("source <> 'a'"), {"b": 1, "c": 1}, block_rows=2).collect()) == 40
    one = spark.createDataFrame([(0, "a"), *((i, "b") for i in range(1, 3001))], "doc_id long, source string")
    got = mixing.mix_sources(one, {"a": 3, "b": 1}, block_rows=1).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("mix_epoch").alias("e")).collect()
    assert {r["source"]: (r["n"] // 3000, r["e"] // 3000) for r in got} in ({"a": (3, 3), "b": (1, 0)}, {"a": (2, 2), "b": (1, 0)})
    for bad in ({"a": 1.0}, {"a": 1, "b": -1, "c": 1}, {"a": float("nan"), "b": 1, "c": 1}, {"a": 0, "b": 0, "c": 0}):
        with pytest.raises(ValueError):
            mixing.mix_sources(df, bad)


def test_mix_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").collect()]
    got = sorted(map(tuple, mixing.query(spark, sf).select("mix_position", "doc_id", "source", "mix_slot", "mix_block", "mix_epoch").collect()))
    assert got == plain_mix(rows, mixing.exact(mixing.tempered(dict(sorted(Counter(s or "" for _, s in rows).items())), 0.7)), mixing.BLOCK_ROWS)


# WARC


def page_rows():
    big = "<p>é" + "x" * 1500
    rows = [(1, "http://a.example/1", big), (2, "http://a b.example/\n2", big), (3, None, "short"), (4, "u", "short"), (5, "", None), (6, "v", ""), (7, "w", "line\r\n\r\nWARC/1.0\n" + "y" * 2000), (8, "w", "line\r\n\r\nWARC/1.0\n" + "y" * 2000), (None, "n", big), (9, "z", "z" * 3000), (9, "z", "z" * 3000)]
    return rows


@pytest.mark.parametrize("most", [200_000, -1])
def test_warc(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "MOST_BROADCAST", most)
    df = spark.createDataFrame([(*r, "o") for r in page_rows()], "page_id long, url string, html string, origin string").repartition(3)
    a, w = new_path(spark, "arc"), new_path(spark, "warc")
    warc.write_arc(df, a)
    records = warc.read_arc(spark, a).collect()
    assert Counter((r["id"], bytes(r["payload"])) for r in records) == Counter((i, (t or "").encode()) for i, _, t in page_rows())
    warc.convert(spark, a, w)
    got = warc.read_warc(spark, w).collect()
    last = {}
    for i, _, t in page_rows():
        if t and len(t.encode()) >= 1000 and i is not None:
            last[t] = max(last.get(t, i), i)
    for r in got:
        assert r["warc_date"] == "2024-01-02T03:04:05Z"
        assert r["record_type"] == ("response" if r["refers_to"] is None else "revisit") and (r["payload"] is None) == (r["refers_to"] is not None)
    want = Counter((i, len((t or "").encode()), hashlib.sha1((t or "").encode()).hexdigest(), None if last.get(t, i) == i else last[t]) for i, _, t in page_rows())
    assert Counter((r["id"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in got) == want
    assert len({r["record_id"] for r in got}) == len(got)
    again = new_path(spark, "warc")
    warc.convert(spark, a, again)
    assert {r["record_id"] for r in warc.read_warc(spark, again).collect()} == {r["record_id"] for r in got}


def test_arc_by_hand(tmp_path, spark):
    doc = b"HTTP/1.0 200 OK\r\nX-Row-Id: 5\r\n\r\n\xff\x00body\n\n"
    told = b"1 0 maker\nURL IP-address Archive-date Content-type Archive-length\n"
    one = b"filedesc://x 0.0.0.0 20000101000000 text/plain %d\n%s\n" % (len(told), told) + b"http://h/ 1.2.3.4 19990203 text/html %d\n%s\n" % (len(doc), doc) + b"http://h/2 1.2.3.4 19990203040506 image/gif 3\nabc\n"
    got = list(warc.arc_records(memoryview(gzip.compress(one[:90]) + gzip.compress(one[90:])), "x"))
    assert [(r[0], r[4], r[6]) for r in got] == [(5, "text/html", b"\xff\x00body\n\n"), (None, "image/gif", b"abc")]
    assert warc.warc_date("19990203") == "1999-02-03T00:00:00Z" and warc.warc_date("x") == "1970-01-01T00:00:00Z"
    for broken in (one.replace(b"1 0 maker", b"3 0 maker"), one.replace(b" text/html", b""), one[:-6]):
        with pytest.raises(ValueError, match="x: "):
            list(warc.arc_records(memoryview(broken), "x"))
    assert list(warc.arc_records(memoryview(b""), "x")) == []


def test_warc_headers(spark, tmp_path):
    doc = b"HTTP/1.0 200 OK\r\nX-Row-Id: %d\r\n\r\n" + b"x" * 2000
    told = b"1 0 maker\nURL IP-address Archive-date Content-type Archive-length\n"
    lines = [b"filedesc://x 0.0.0.0 20000101000000 text/plain %d\n%s" % (len(told), told)]
    for i, date in ((1, b"19990203"), (2, b"never")):
        lines.append(b"http://h/%d 1.2.3.4 %s text/html %d\n%s" % (i, date, len(doc % i), doc % i))
    lines.append(b"dns:h - 19990203040506 text/dns 3\nabc\n")
    a, w = new_path(spark, "arc"), new_path(spark, "warc")
    (tmp_path / "a.arc").write_bytes(b"\n".join(lines))
    warc.convert(spark, f"file://{tmp_path}/a.arc", w)
    raw = b"".join(bytes(r["content"]) for r in spark.read.format("binaryFile").load(w).collect())
    text = gzip.decompress(raw).decode()
    records = {re.search("(?m)^WARC-Target-URI: (.*)\r$", r)[1]: dict(re.findall("(?m)^([\\w-]+): (.*)\r$", r)) for r in text.split("WARC/1.1\r\n")[2:]}
    assert records["http://h/1"]["WARC-Type"] == "revisit" and records["http://h/1"]["WARC-Refers-To"] == records["http://h/2"]["WARC-Record-ID"]
    assert records["http://h/1"]["WARC-Refers-To-Target-URI"] == "http://h/2" and records["http://h/1"]["WARC-Refers-To-Date"] == records["http://h/2"]["WARC-Date"]
    assert {records[f"http://h/{i}"]["WARC-IP-Address"] for i in (1, 2)} == {"1.2.3.4"} and records["http://h/1"]["WARC-Identified-Payload-Type"] == "text/html"
    assert records["http://h/2"]["X-Archive-Date"] == "never" and "X-Archive-Date" not in records["http://h/1"]
    assert records["dns:h"]["WARC-Type"] == "resource" and records["dns:h"]["Content-Type"] == "text/dns" and "WARC-IP-Address" not in records["dns:h"]
    got = {r["url"]: r for r in warc.read_warc(spark, w).collect()}
    assert bytes(got["dns:h"]["payload"]) == b"abc" and got["http://h/1"]["refers_to"] == 2 and got["http://h/1"]["payload_bytes"] == 2000


def test_warc_of_long_payloads(spark):
    df = spark.createDataFrame([(1, "u", "é" * 3_000_000), (2, "u", "é" * 3_000_000), (3, None, "z")], "page_id long, url string, html string")
    a, w = new_path(spark, "arc"), new_path(spark, "warc")
    warc.write_arc(df, a)
    warc.convert(spark, a, w)
    assert {(r["id"], r["payload_bytes"], r["refers_to"]) for r in warc.read_warc(spark, w, payload=False).collect()} == {(1, 6_000_000, 2), (2, 6_000_000, None), (3, 1, None)}


def test_warc_of_nothing(spark):
    w, a = new_path(spark, "warc"), new_path(spark, "arc")
    warc.write_arc(spark.createDataFrame([], "page_id long, url string, html string"), a)
    warc.convert(spark, a, w)
    assert warc.read_warc(spark, w).count() == 0


# Embeddings


def vectors():
    rng = np.random.default_rng(0)
    rows, n = [], 0
    for d in (16, 24):
        for label in (0, 1):
            for _ in range(8):
                center = rng.normal(size=d)
                for _ in range(rng.integers(1, 9)):
                    rows.append((n, [float(x) for x in np.float32(center + rng.normal(size=d) * 0.18)], label))
                    n += 1
    rows += [(n + i, rows[3][1], rows[3][2]) for i in range(3)] + [(n + 3, [2 * x for x in rows[3][1]], rows[3][2])]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None, *rows[0][1][1:]], [float("inf"), *rows[0][1][1:]]]
    rows += [(n + 10 + i, v, 0) for i, v in enumerate(odd)] + [(n + 30, rows[0][1], None), (None, rows[5][1], rows[5][2]), (n + 31, [1e-200] * 16, 1)]
    return rows


def links_by_hand(rows):
    def ok(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    units = [np.array(v) / max(abs(np.array(v))) if ok(v) else None for _, v, _ in rows]
    units = [u / np.sqrt(u @ u) if u is not None else None for u in units]
    link = lambda i, j: units[i] is not None and units[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.93
    g = brute.groups(len(rows), link)
    least = {}
    for (i, *_), r in zip(rows, g):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((rows[i][0], sum(link(i, j) for j in range(len(rows)) if i != j), least[g[i]]) for i in range(len(rows))), key=repr)


@pytest.mark.parametrize("block", [1024, 2])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_links, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "vec_id long, embedding array<float>, label int, node int, key string").repartition(3)
    df = df.withColumn("embedding", F.col("embedding").cast("array<double>"))
    got = embedding_links.near_vectors(df).collect()
    want = links_by_hand([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows])
    found, wanted = sum(r["n_links"] for r in got), sum(w[1] for w in want)
    assert 0.9 * wanted <= found <= wanted
    if found == wanted:
        assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)
    assert embedding_links.near_vectors(df.limit(0)).count() == 0


def test_hadamard():
    x = np.random.default_rng(0).normal(size=(5, 8))
    h = np.array([[1.0]])
    for _ in range(3):
        h = np.block([[h, h], [h, -h]])
    assert np.allclose(embedding_links.hadamard(x), x @ h / np.sqrt(8))


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(shared, "MOST_IN_ONE_TASK", most)
    rng = random.Random(0)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    nodes = sorted({n for e in edges if e[0] != e[1] for n in e})
    pairs = {frozenset((nodes.index(a), nodes.index(b))) for a, b in edges if a != b}
    g = brute.groups(len(nodes), lambda i, j: frozenset((i, j)) in pairs)
    least = {r: min(n for n, x in zip(nodes, g) if x == r) for r in set(g)}
    assert got == {n: least[r] for n, r in zip(nodes, g)}


# Toxicity


def labelled(n=600):
    rng = random.Random(0)
    plain, bad = [f"word{i}" for i in range(80)], ["vile", "rotten", "awful"]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        t = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        for _ in range(3 if toxic else 0):
            t.insert(rng.randrange(len(t)), rng.choice(bad))
        docs.append((i, " ".join(t).capitalize() + "."))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity(spark):
    docs, labels = labelled()
    extra = [(None, "vile rotten"), (5000, None), (5001, ""), (5002, "..."), (5003, "Vile! rotten, AWFUL word1"), (5003, "word1 word2")]
    df = spark.createDataFrame([(*d, 0.5, "c") for d in docs + extra], "doc_id long, text string, score double, cls string")
    lab = spark.createDataFrame([x for x in labels if x[0] % 5] + [(None, 1), (3, None), (1, 7)], "doc_id long, toxic int")
    model = toxicity.fit(df, lab)
    out = toxicity.score(df, model).collect()
    assert len(out) == len(docs) + len(extra) and all(0 <= r["score"] <= 1 for r in out)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r["score"])
    held = [(by[i][0] >= 0.5) == bool(y) for i, y in labels if i % 5 == 0]
    assert np.mean(held) > 0.95
    assert by[None][0] > 0.5 and max(by[5003]) > 0.5 and by[5000] == by[5001] == by[5002]
    alone = toxicity.fit(df, lab.where("toxic = 0"))
    assert max(r["score"] for r in toxicity.score(df, alone).collect()) < 0.01
    assert toxicity.score(df.limit(0), model).count() == 0
    assert toxicity.fit(df.limit(0), lab.limit(0)).size == (0, 0)
