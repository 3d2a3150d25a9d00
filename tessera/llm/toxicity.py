"""Toxicity: cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import _BYTES, as_batch, give_back, labelled, mix, powers, text_batches

BITS = 20
PREFIXES = (4, 5, 6, 7, 8)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = _LETTER[128:] = True


@dataclass
class Model:
    """P(grade <= k) = sigmoid(thresholds[k] - weights . log2(1 + counts) - length * log(1 + words)), one set of weights for all k."""

    weights: np.ndarray
    thresholds: np.ndarray
    length: float

    def severity(self, x: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Expected grade: the sum over k of P(grade > k)."""
        s = x + self.length * np.log1p(words)
        return (1 / (1 + np.exp(np.clip(self.thresholds[None, :] - s[:, None], -60, 60)))).sum(1)


def features(buf: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, bucket) of every word and word beginning of lower-cased texts, and words a text."""
    n, texts = len(buf), len(cuts) - 1
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, np.zeros(texts, np.int64)
    letter = _LETTER[buf]
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(letter[:-1], out=first[1:])
    first[cuts[:-1][cuts[:-1] < n]] = True
    starts = np.flatnonzero(first & letter)
    if not len(starts):
        return none, none, np.zeros(texts, np.int64)
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = first[1:] | ~letter[1:]
    lens = np.flatnonzero(last & letter) + 1 - starts
    at = np.arange(n, dtype=np.int64)
    at[starts[0]:] -= np.repeat(starts, np.diff(starts, append=n))
    v = np.where(letter, _BYTES[buf] * powers(int(at.max()) + 1)[at], np.uint64(0))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v)])
    text = np.searchsorted(cuts, starts, "right") - 1
    who, what = [text], [mix(sums[starts + lens] - sums[starts])]
    for k in PREFIXES:
        long = lens > k
        s = starts[long]
        who.append(text[long])
        what.append(mix((sums[s + k] - sums[s]) ^ np.uint64(k)))
    return np.concatenate(who), (np.concatenate(what) >> np.uint64(64 - BITS)).astype(np.int64), np.bincount(text, minlength=texts)


def lowered(batches):
    for b in batches:
        i = b.schema.get_field_index("text")
        yield b.set_column(i, "text", pc.utf8_lower(b.column(i).fill_null("")))


def fit(sample: list[tuple[str, int]], grades: int = 3, least_z: float = 3.0, steps: int = 300, l2: float = 1e-2) -> Model:
    """Fit on (text, toxic). Where labels only tell toxic or not, toxic texts are graded 1 to `grades` by tertile of how
    many of the toxic-leaning features they hold, clean ones 0."""
    y = np.array([t for _, t in sample], np.int64)
    empty = Model(np.zeros(1 << BITS, np.float32), np.full(grades, 20.0), 0.0)
    if len(set(y.tolist())) < 2:
        return empty

    def counted():
        """(sample row, bucket, log2(1 + times)) of each feature of a text, and words; some texts at a time."""
        for base in range(0, len(sample), 256):
            done = 0
            for part, buf, cuts in text_batches(lowered([as_batch([t for t, _ in sample[base:base + 256]])]), most=1 << 19):
                who, what, n = features(buf, cuts)
                pairs, times = np.unique((who << BITS) | what, return_counts=True)
                yield (pairs >> BITS) + base + done, pairs & ((1 << BITS) - 1), np.log2(1.0 + times), n
                done += part.num_rows

    df, pos, words = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS), []
    for who, what, _, n in counted():
        df += np.bincount(what, minlength=1 << BITS)
        pos += np.bincount(what, weights=y[who], minlength=1 << BITS)
        words.append(n)
    words, p = np.concatenate(words), y.mean()
    z = (pos - df * p) / np.sqrt(np.maximum(df, 1) * p * (1 - p))
    used = np.flatnonzero((df >= 4) & (np.abs(z) >= least_z))
    if not len(used):
        return empty
    slot = np.full(1 << BITS, -1, np.int32)
    slot[used] = np.arange(len(used))
    kept = [(who[m], slot[what[m]], times[m]) for who, what, times, _ in counted() for m in (slot[what] >= 0,)]
    who, what, times = (np.concatenate(x) for x in zip(*kept))
    hits = np.bincount(who, weights=(z[used] > 0)[what], minlength=len(y))
    grade = np.where(y == 1, 1 + np.searchsorted(np.quantile(hits[y == 1], np.arange(1, grades) / grades), hits, "left"), 0)
    balance = np.where(y == 1, 0.5 / p, 0.5 / (1 - p))
    balance /= balance.sum()
    length = np.log1p(words)
    th = np.concatenate([np.zeros(1), np.full(grades - 1, -0.5)])  # first threshold, then logs of the gaps
    x = np.concatenate([np.zeros(len(used)), [0.0], th])
    m, v, k = np.zeros_like(x), np.zeros_like(x), len(used)
    for i in range(1, steps + 1):
        w, lw, t = x[:k], x[k], np.concatenate([x[k + 1:k + 2], x[k + 1] + np.cumsum(np.exp(x[k + 2:]))])
        s = np.bincount(who, weights=w[what] * times, minlength=len(y)) + lw * length
        c = 1 / (1 + np.exp(-np.clip(np.concatenate([np.full((len(y), 1), -40.0), t[None] - s[:, None], np.full((len(y), 1), 40.0)], 1), -40, 40)))
        hi, lo = c[np.arange(len(y)), grade + 1], c[np.arange(len(y)), grade]
        prob = np.maximum(hi - lo, 1e-9)
        up, down = balance * hi * (1 - hi) / prob, balance * lo * (1 - lo) / prob
        gs = up - down  # of -log prob by s
        gt = np.array([-up[grade == j].sum() + down[grade == j + 1].sum() for j in range(grades)])
        gaps = np.exp(x[k + 2:])
        g = np.concatenate([np.bincount(what, weights=gs[who] * times, minlength=k) + l2 * w, [gs @ length], [gt.sum()], np.array([gt[j + 1:].sum() for j in range(grades - 1)]) * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - 0.05 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-9)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = x[:k]
    return Model(weights, np.concatenate([x[k + 1:k + 2], x[k + 1] + np.cumsum(np.exp(x[k + 2:]))]), float(x[k]))


def train(docs: DataFrame, labels: DataFrame, most: int = 4000, **options) -> Model:
    """Fit on at most `most` labelled documents of each class, bounded in characters too (see labelled())."""
    model = fit(labelled(docs, labels, "toxic", most), **options)
    give_back()
    return model


def _scorer(model: Model):
    used = np.flatnonzero(model.weights).astype(np.int64)
    values, thresholds, length = model.weights[used], model.thresholds, model.length

    def run(batches):
        """(Arrow slice as it came, severities) of slices of batches with a column text."""
        weights = np.zeros(1 << BITS, np.float32)
        weights[used] = values
        m = Model(weights, thresholds, length)
        for b in batches:
            at = 0
            for part, buf, cuts in text_batches(lowered([b.select(["text"])]), most=1 << 19):
                who, what, words = features(buf, cuts)
                hit = weights[what] != 0
                pairs, times = np.unique((who[hit] << BITS) | what[hit], return_counts=True)
                x = np.bincount(pairs >> BITS, weights=weights[pairs & ((1 << BITS) - 1)] * np.log2(1.0 + times), minlength=len(cuts) - 1)
                yield b.slice(at, part.num_rows), np.where(words > 0, m.severity(x, words), 0.0)
                at += part.num_rows

    return run


def score(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """docs(doc_id, text) to doc_id, severity double (expected grade, 0 to the top grade), toxic boolean (severity >= least).

    One narrow Arrow pass over whole texts. Null texts and texts without a letter have severity 0 and are not toxic.
    Repeated rows are scored alike; other columns are not read.
    """
    run = _scorer(model)

    def work(batches):
        for own, s in run(batches):
            yield pa.record_batch([own.column("doc_id"), pa.array(s), pa.array(s >= least)], ["doc_id", "severity", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, severity double, toxic boolean")


def keep_clean(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Rows of docs under `least`, all columns as they are: a narrow filter."""
    run = _scorer(model)

    def work(batches):
        for own, s in run(batches):
            yield own.filter(pa.array(s < least))

    return docs.mapInArrow(work, docs.schema)
