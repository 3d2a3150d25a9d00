"""Quality classifier: supervised subword embeddings, averaged over a document, with a softmax output."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _BYTES, as_batch, give_back, grams, labelled, text_batches, word_hashes

NGRAMS = (3, 4, 5)
BITS = 17
#: White space is one symbol, so that n-grams see where words begin and end.
_SYMBOL = np.where(_BYTES == 0, np.uint64(0x51ED270B9F0C2A6D), _BYTES)
#: Buckets of a pair of neighbouring words: different, or one word twice. Pairs of any repeated word share a vector.
_AGAIN = np.array([0, 1], np.int64)


@dataclass
class Model:
    """Hashed vectors, one a bucket, and output weights (dim, 2)."""

    vectors: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def table(self) -> np.ndarray:
        """What a bucket adds to the log-odds of label 1; the mean over a document commutes with the output layer."""
        return (self.vectors @ (self.out[:, 1] - self.out[:, 0])).astype(np.float32)


def features(buf: np.ndarray, cuts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """[(buckets, first bucket of each text)] for words, repeats of a word and each n-gram length, none across two texts."""
    words, at = word_hashes(buf, cuts)
    out = [((words >> np.uint64(64 - BITS)).astype(np.int64), at)]
    if len(words):
        again = np.zeros(len(words), np.int64)
        again[1:] = words[1:] == words[:-1]
        again[at[:-1][at[:-1] < len(words)]] = 0
        out.append((_AGAIN[again], at))
    symbols = _SYMBOL[buf] if len(buf) else np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    for n in NGRAMS:
        if len(buf) < n:
            out.append((np.zeros(0, np.int64), np.zeros(len(cuts), np.int64)))
            continue
        same = text[:len(text) - n + 1] == text[n - 1:]
        out.append(((grams(symbols, n)[same] >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([[0], np.cumsum(np.bincount(text[:len(same)][same], minlength=len(cuts) - 1))])))
    return out


def fit(sample: list[tuple[str, int]], dim: int = 8, epochs: int = 12, rate: float = 2.0, seed: int = 7) -> Model:
    """Stochastic gradient descent, a document at a time, on the log loss; classes weigh the same."""
    rng = np.random.RandomState(seed)
    model = Model(rng.uniform(-1, 1, (1 << BITS, dim)) / dim, np.zeros((dim, 2)), np.zeros(2))
    y = np.array([t for _, t in sample], np.int64)
    if len(set(y.tolist())) < 2:
        return model
    bags = []
    for part, buf, cuts in text_batches([as_batch([t for t, _ in sample])]):
        kinds = features(buf, cuts)
        for i in range(part.num_rows):
            ids, n = np.unique(np.concatenate([b[at[i]:at[i + 1]] for b, at in kinds]), return_counts=True)
            bags.append((ids, n / max(1, n.sum())))
    weigh = 0.5 / np.bincount(y, minlength=2) * len(y)
    total, step = epochs * len(y), 0
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            ids, share = bags[i]
            lr = rate * (1 - step / total)
            step += 1
            h = share @ model.vectors[ids]
            z = h @ model.out + model.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= weigh[y[i]]
            back = model.out @ p
            model.out -= 0.1 * lr * np.outer(h, p)
            model.bias -= 0.01 * lr * p
            model.vectors[ids] -= 20 * lr * np.outer(share, back)
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = 1500, where=None, **options) -> Model:
    """Fit on at most `most` labelled documents of each class, bounded in characters too (see labelled())."""
    model = fit(labelled(docs, labels, "quality", most, where), **options)
    give_back()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) to doc_id, score (probability of label 1): a narrow Arrow pass over whole texts.

    Null and empty texts get the score of the bias alone. Repeated rows are scored alike; other columns are not read.
    """
    table, bias = model.table(), float(model.bias[1] - model.bias[0])

    def run(batches):
        for part, buf, cuts in text_batches(batches):
            total, n = np.zeros(len(cuts) - 1), np.zeros(len(cuts) - 1, np.int64)
            for buckets, at in features(buf, cuts):
                sums = np.concatenate([[0.0], np.cumsum(table[buckets], dtype=np.float64)])
                total += sums[at[1:]] - sums[at[:-1]]
                n += np.diff(at)
            z = bias + total / np.maximum(n, 1)
            yield pa.record_batch([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def held_out() -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
