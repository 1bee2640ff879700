"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NONSPACE = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, pattern):
    return pattern.findall((text or "").translate(LOWER))


def shingles(text, width):
    w = words(text, NONSPACE)
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def groups(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    return [find(i) for i in range(n)]


def near_duplicates(docs, width, percent):
    """(id, n_shingles, component_id) of each document, sorted."""
    sets = [shingles(t, width) for _, t in docs]
    g = groups(len(docs), lambda i, j: bool(sets[i]) and bool(sets[j]) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]))
    least = {}
    for (i, _), r in zip(docs, g):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, len(s), least.get(r)) for (i, _), s, r in zip(docs, sets, g)), key=repr)


def overlaps(docs, items, window):
    out = []
    for i, t in docs:
        w, hit, found = words(t, ALNUM), set(), set()
        for item, text in items:
            b = words(text, ALNUM)
            m = min(window, len(b))
            grams = {tuple(b[k : k + m]) for k in range(len(b) - m + 1)} if b else set()
            for p in range(len(w) - m + 1) if b else ():
                if tuple(w[p : p + m]) in grams:
                    hit |= set(range(p, p + m))
                    if item is not None:
                        found.add(str(item))
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def longest(text, items, window):
    """(words, first word) of the longest run that an item has too, the first of these; None below a window."""
    w, best = words(text, ALNUM), None
    for _, t in items:
        b = words(t, ALNUM)
        before = [0] * (len(b) + 1)
        for i, x in enumerate(w):
            now = [0] * (len(b) + 1)
            for j, y in enumerate(b):
                if x == y:
                    now[j + 1] = n = before[j] + 1
                    if n >= min(window, len(b)) and (best is None or (n, n - i) > (best[0], -best[1] + 1)):
                        best = (n, i + 1 - n)
            before = now
    return best


def repeats(docs, window):
    """(id, n_bytes, n_removed, n_spans, sha256): null ids come last and cover nothing."""
    starts = {}
    key = lambda i: (i is None, i or 0)
    raw = [(i, (t or "").encode()) for i, t in docs]
    for i, b in raw:
        for s in range(len(b) - window + 1):
            g = b[s : s + window]
            starts[g] = min(starts.get(g, key(i)), key(i))
    out = []
    for i, b in raw:
        gone = set()
        for s in range(len(b) - window + 1):
            if starts[b[s : s + window]] < key(i):
                gone |= set(range(s, s + window))
        spans = sum(x - 1 not in gone for x in gone)
        out.append((i, len(b), len(gone), spans, hashlib.sha256(bytes(b[x] for x in range(len(b)) if x not in gone)).hexdigest()))
    return sorted(out, key=repr)


def templates(docs, min_docs, lead=3, similar=0.6):
    """(id, n_lines, n_dropped, kept_text); docs' rows are different documents."""
    split = lambda x: [t if not re.search("[0-9]", t) else "<*>" for t in re.findall(r"[^ \t\x0B\f\r]+", x)]
    lines = {d: [split(x) for x in t.split("\n")] for d, (_, t) in enumerate(docs) if t is not None}
    leaf = lambda t: (len(t), tuple(t[:lead]))
    where = {}
    for d, rows in lines.items():
        for t in rows:
            if t:
                where.setdefault(leaf(t), {}).setdefault(tuple(t), set()).add(d)
    name = {}
    for kinds in where.values():
        for t in kinds:
            name[t] = t
        if len(kinds) > 1 and sum(map(len, kinds.values())) >= min_docs:
            n = Counter()
            for t, ds in kinds.items():
                for at, x in enumerate(t):
                    n[at, x] += len(ds)
            for t in kinds:
                g = tuple(x if n[at, x] >= min_docs else "<*>" for at, x in enumerate(t))
                if sum(n[at, x] >= min_docs and x != "<*>" for at, x in enumerate(t)) >= similar * len(t):
                    name[t] = g
    docs_of = {}
    for d, rows in lines.items():
        for t in rows:
            if t:
                docs_of.setdefault(name[tuple(t)], set()).add(d)
    out = []
    for d, (i, text) in enumerate(docs):
        if text is None:
            out.append((i, 0, 0, None))
            continue
        gone = [bool(t) and len(docs_of[name[tuple(t)]]) >= min_docs for t in lines[d]]
        out.append((i, sum(map(bool, lines[d])), sum(gone), "\n".join(x for x, g in zip(text.split("\n"), gone) if not g)))
    return sorted(out, key=repr)


class KneserNey:
    """Class-conditional bigram models by the formulas, from (cls, text); q(c, v) lists all probabilities after v."""

    D = 0.75

    def __init__(self, texts, telling):
        seqs = [(c, ["<s>", *words(t, ALNUM), "</s>"]) for c, t in texts if words(t, ALNUM)]
        self.share = (sum(c for c, _ in texts) + 0.5) / (len(texts) + 1)
        self.telling = telling
        self.n, self.pairs = Counter(), Counter()
        for c, s in seqs:
            self.n.update((w, c) for w in set(s))
            self.pairs.update((p, c) for p in set(zip(s, s[1:])))
        self.vocabulary = {w for w, _ in self.n if self.n[w, 0] + self.n[w, 1] > 1}
        self.kinds = {p for p, _ in self.pairs}
        self.f, self.fc, self.t = Counter(), Counter(), Counter()
        for v, w in self.kinds:
            self.f[self.known(w)] += 1
            for c in (0, 1):
                if n := self.pairs[(v, w), c]:
                    self.fc[self.known(w), c] += 1
                    self.t[v, c] += n
        self.f[None] = max(self.f[None], 0.5)
        self.words = [w for w in self.vocabulary | {None} if self.f[w]]
        total = [sum(self.fc[w, c] for w in self.words) for c in (0, 1)]
        types = [sum(self.fc[w, c] > 0 for w in self.words) for c in (0, 1)]
        self.p = {w: self.f[w] / sum(self.f.values()) for w in self.words}
        self.own = [{}, {}]
        for c in (0, 1):
            for w in self.words:
                s = 0 if w is None else self.tells(self.n[w, 0], self.n[w, 1], self.share)
                mine = (max(self.fc[w, c] - self.D, 0) + self.D * types[c] * self.p[w]) / total[c] if total[c] else self.p[w]
                self.own[c][w] = (1 - s) * self.p[w] + s * mine
            z = sum(self.own[c].values())
            self.own[c] = {w: x / z for w, x in self.own[c].items()}

    def known(self, w):
        return w if w in self.vocabulary else None

    def tells(self, n0, n1, share):
        apart = math.lgamma(n0 + 1) + math.lgamma(n1 + 1) - math.lgamma(n0 + n1 + 2)
        even = n1 * math.log(share) + n0 * math.log(1 - share)
        return 1 / (1 + math.exp(even - apart) * (1 - self.telling) / self.telling)

    def q(self, c, v):
        if v not in self.vocabulary:
            return self.own[c]
        after = {w: (self.pairs[(v, w), 0], self.pairs[(v, w), 1]) for w in self.words if w and self.pairs[(v, w), 0] + self.pairs[(v, w), 1] > 1}
        keep = lambda n: max(n - self.D, 0)
        t, tc = self.t[v, 0] + self.t[v, 1], self.t[v, c]
        o, oc = sum(keep(sum(n)) for n in after.values()), sum(keep(n[c]) for n in after.values())
        out = {}
        for w in self.words:
            n, low = after.get(w), self.own[c][w]
            if n is None:
                out[w] = (1 - o / t) * low
                continue
            odds = self.share / (1 - self.share) * self.own[1][w] / self.own[0][w]
            s = self.tells(*n, odds / (1 + odds))
            back = (keep(sum(n)) + (t - o) * self.p[w]) / t * low / self.p[w]
            out[w] = (1 - s) * back + s * ((keep(n[c]) + (tc - oc) * low) / tc if tc else low)
        z = sum(out.values())
        return {w: x / z for w, x in out.items()}

    def figure(self, text):
        s = words(text, ALNUM)
        if not s:
            return None
        s = ["<s>", *s, "</s>"]
        return sum(math.log(self.q(1, v)[self.known(w)] / self.q(0, v)[self.known(w)]) for v, w in zip(s, s[1:])) / (len(s) - 1)
