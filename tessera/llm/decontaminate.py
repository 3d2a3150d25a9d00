"""Benchmark decontamination by the q-gram lemma: shared q-grams are counted in diagonal bands, then aligned."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grams

FILTER_BITS = 22


def normal(text: str | None) -> str:
    """Lower case, runs of white space as one blank."""
    return " ".join((text or "").lower().split())


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hash(codes: np.ndarray, q: int) -> np.ndarray:
    return grams(codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), q)


@dataclass
class Index:
    """q-grams of benchmark items: hash, item and place, sorted by hash; an item's edit budget and least shared q-grams."""

    q: int
    ids: list[int]
    texts: list[np.ndarray]
    budget: np.ndarray
    least: np.ndarray
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    short: dict[str, list[int]]


def index(items: list[tuple[int, str]], q: int, rate: float) -> Index:
    """An item of m characters may differ by floor(rate * m) edits, or as many as the lemma still bounds: with e edits
    at least m + 1 - q - q * e q-grams stay. Items under q characters match whole documents only."""
    texts = [(i, normal(t)) for i, t in items]
    short: dict[str, list[int]] = {}
    for i, t in texts:
        if 0 < len(t) < q:
            short.setdefault(t, []).append(i)
    long = [(i, points(t)) for i, t in texts if len(t) >= q]
    m = np.array([len(t) for _, t in long], np.int64)
    budget = np.minimum(np.floor(rate * m), (m - q) // q).astype(np.int64)
    hashes = [_hash(t, q) for _, t in long]
    n = np.array([len(h) for h in hashes], np.int64)
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    return Index(q, [i for i, _ in long], [t for _, t in long], budget, m + 1 - q - q * budget, flat[order], np.repeat(np.arange(len(n)), n)[order], (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))[order], short)


def align(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """(edits, start, end) of the item's best place in text whose path stays on diagonals low..high (start minus 0).

    Rows are item characters, columns diagonals. Cost and start are one number, so the least cost's leftmost start wins.
    """
    one, k = 1 << 32, high - low + 1
    at = np.arange(low, low + k + len(item))
    inside = (at >= 0) & (at < len(text))
    window = np.where(inside, text[np.clip(at, 0, max(0, len(text) - 1))] if len(text) else 0, 0xFFFFFFFF).astype(np.int64)
    steps = np.arange(k) * one
    starts = np.clip(np.arange(low, low + k), 0, len(text))
    row = starts + np.abs(np.arange(low, low + k) - starts) * one
    for j, c in enumerate(item.astype(np.int64)):
        new = row + (window[j:j + k] != c) * one
        new[:-1] = np.minimum(new[:-1], row[1:] + one)
        row = np.minimum.accumulate(new - steps) + steps
    end = np.arange(low, low + k) + len(item)
    row = np.where((end >= 0) & (end <= len(text)), row, np.iinfo(np.int64).max)
    best = int(row.argmin())
    return int(row[best] >> 32), int(row[best] & (one - 1)), int(end[best])


def search(texts: list[str], ix: Index):
    """(text index, item id, start, end, edits, regions) for normal texts; an item's best region in a text, one row."""
    out = []
    for t, s in enumerate(texts):
        for i in ix.short.get(s, ()):
            out.append((t, i, 0, len(s), 0, 1))
    if not len(ix.hashes):
        return out
    known = np.zeros(1 << FILTER_BITS, bool)
    known[(ix.hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    codes = points("\n".join(texts))  # no item holds a line break
    base = np.concatenate([[0], np.cumsum([len(s) + 1 for s in texts])])
    if len(codes) < ix.q:
        return out
    h = _hash(codes, ix.q)
    p = np.flatnonzero(known[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    a, b = np.searchsorted(ix.hashes, h[p], "left"), np.searchsorted(ix.hashes, h[p], "right")
    p, a, n = p[b > a], a[b > a], (b - a)[b > a]
    slot = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    p = np.repeat(p, n)
    item, t = ix.item[slot], np.searchsorted(base, p, "right") - 1
    width = ix.budget[item] + 1
    diagonal = p - base[t] - ix.place[slot] + len(codes)
    band = diagonal // width
    key = ((t * len(ix.ids) + item) << 32)
    bands, count = np.unique(np.concatenate([key + band, key + band - 1]), return_counts=True)  # a band and half the next
    item = (bands >> 32) % len(ix.ids)
    keep = count >= ix.least[item]
    best: dict[tuple[int, int], list] = {}
    for k, i in zip(bands[keep], item[keep]):
        t, e = int((k >> 32) // len(ix.ids)), int(ix.budget[i])
        low = int(k & ((1 << 32) - 1)) * (e + 1) - len(codes)
        edits, start, end = align(ix.texts[i], codes[base[t]:base[t + 1] - 1], low - e, low + 2 * (e + 1) - 1 + e)
        if edits <= e:
            got = best.setdefault((t, int(i)), [])
            if (edits, start, end) not in got:
                got.append((edits, start, end))
    for (t, i), got in best.items():
        edits, start, end = min(got)
        out.append((t, ix.ids[i], start, end, edits, len({g[1] for g in got})))
    return out


def _indexes(benchmark: DataFrame, q: int, rate: float, most_chars: int):
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // most_chars))
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part) if parts > 1 else items
        yield index([(r["item_id"], r["text"]) for r in own.orderBy("item_id", "text").collect()], q, rate)


def find(docs: DataFrame, benchmark: DataFrame, q: int = 10, rate: float = 0.08, most_chars: int = 4_000_000) -> DataFrame:
    """docs(doc_id, text) against benchmark(item_id, text): doc_id, item_id, start, end, edits, regions; a row for each
    document and item found in it within rate edits a character.

    start and end count characters of the document's normal form (lower case, single blanks). Candidates: document
    regions that share as many q-grams with an item, in a band of diagonals, as the lemma says an occurrence must;
    each is aligned within its band. Benchmark text is measured first and goes out in parts of about `most_chars`
    characters, each a pass over the documents, so what a task holds does not grow with the benchmark. Documents are
    never shuffled. Null and empty texts match nothing; a null item_id or text is left out; repeated rows match alike;
    other columns are not read.
    """
    out = None
    for ix in _indexes(benchmark, q, rate, most_chars):

        def run(batches, ix=ix):
            for b in batches:
                for i in range(0, b.num_rows, 256):
                    own = b.slice(i, 256)
                    rows = sorted(search([normal(t) for t in own.column("text").to_pylist()], ix))
                    ids = own.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
                    yield pa.record_batch([ids, *(pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 6))], ["doc_id", "item_id", "start", "end", "edits", "regions"])

        hits = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, start long, end long, edits long, regions long")
        out = hits if out is None else out.unionByName(hits)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, q: int = 10, rate: float = 0.08, most_chars: int = 4_000_000) -> DataFrame:
    """Rows of docs in which no benchmark item is found, all columns as they are: a narrow filter for each part."""
    for ix in _indexes(benchmark, q, rate, most_chars):

        def run(batches, ix=ix):
            for b in batches:
                for i in range(0, b.num_rows, 256):
                    own = b.slice(i, 256)
                    keep = np.ones(own.num_rows, bool)
                    keep[[r[0] for r in search([normal(t) for t in own.column("text").to_pylist()], ix)]] = False
                    yield own.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
