"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, k):
    w = words(text, True)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def ngram_classes(rows, k, per_cent):
    """rows: {doc_id: text} to {doc_id: (n, component)}."""
    sets = {i: shingles(t, k) for i, t in rows.items()}
    where, both = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for ids in where.values():
        for a in range(len(ids)):
            for b in range(a):
                both[ids[a], ids[b]] += 1
    u = Union(rows)
    for (a, b), n in both.items():
        if n * 100 >= per_cent * (len(sets[a]) + len(sets[b]) - n):
            u.join(a, b)
    return {i: (len(sets[i]), u.root(i)) for i in rows}


def repeats(rows, window=35):
    """[(id, text)] to [(id, words, removed, sha256 of what is kept)]."""
    lists = [words(t) for _, t in rows]
    seen = Counter(tuple(w[i:i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, lists):
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k:k + window])] > 1:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def near_words(x, y):
    """Word edit distance of at most one, by the whole table."""
    d = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        e = [i]
        for j, b in enumerate(y, 1):
            e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (a != b)))
        d = e
    return d[-1] <= 1


def line_dedup(rows, shortest=3, edit_from=8):
    """{doc_id: text} to {doc_id: kept text}."""
    first, places = {}, []
    for i in sorted(rows):
        for j, line in enumerate((rows[i] or "").split("\n")):
            w = tuple(words(line, True))
            if len(w) >= shortest:
                places.append((i, j, w))
                first.setdefault(w, (i, j))
    long = sorted((w for w in first if len(w) >= edit_from), key=first.get)
    late = {b for k, b in enumerate(long) for a in long[:k] if abs(len(a) - len(b)) < 2 and near_words(a, b)}
    gone = {(i, j) for i, j, w in places if first[w] != (i, j) or w in late}
    return {i: None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in gone) for i, t in rows.items()}


def edit_places(item, text):
    """Least edits of item against any stretch of text."""
    d = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        e = [i]
        for j, b in enumerate(text, 1):
            e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (a != b)))
        d = e
    return min(d)


def cosine_classes(vectors, least):
    """{id: list or None} to {id: (links, component)}."""
    import math

    def unit(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v]

    u, units, links = Union(vectors), {i: unit(v) for i, v in vectors.items()}, Counter()
    ids = sorted(vectors)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if units[a] and units[b] and len(units[a]) == len(units[b]) and sum(x * y for x, y in zip(units[a], units[b])) >= least:
                links[a] += 1
                links[b] += 1
                u.join(a, b)
    return {i: (links[i], u.root(i)) for i in vectors}
