"""Substring dedup by recompression: runs and pairs get names that depend on content alone, so equal passages share symbols."""

from __future__ import annotations



import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _P, Scratch, mix, powers, text_batches, word_hashes

_INVERSE = pow(_P, -1, 1 << 64)
_inverses = np.ones(1, np.uint64)
#: Low bits of a rank hold a symbol's place in its batch, so that equal ranks go to the leftmost; floor(log2) of counts.
_PLACE = (1 << 32) - 1
_DEPTH = np.array([0] + [n.bit_length() - 1 for n in range(1, 4096)])


def _inverse_powers(n: int) -> np.ndarray:
    global _inverses
    if len(_inverses) < n:
        p = np.full(max(n, 4096), _INVERSE, np.uint64)
        p[0] = 1
        _inverses = np.multiply.accumulate(p)
    return _inverses


class Hashes:
    """Hash of any stretch of words from prefix sums."""

    def __init__(self, h: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(len(h) + 1)[:len(h)])])
        self.back = _inverse_powers(len(h) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.of((self.sums[end] - self.sums[start]) * self.back[start], end - start)

    @staticmethod
    def of(value: np.ndarray, words: np.ndarray) -> np.ndarray:
        return mix(value + words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def levels(h: np.ndarray, cuts: np.ndarray, rounds: int, longest: int):
    """Symbols after each round: (name, low, high). low:high are the words that settle that the symbol is there.

    A round names maximal runs of a symbol, then pairs of a left and a right symbol; a symbol's side is a bit of its
    name. Names are hashes of what they stand for: the same in all tasks without a dictionary to exchange, so every
    round runs where the text is. A name covers at most `longest` words; a longer run keeps its single symbols, which
    nothing settles from there on. Where a text ends nothing beyond is known, so low or high goes past the end.
    """
    start = np.arange(len(h), dtype=np.int64)
    text = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    name, size, low, high, sure = h, np.ones(len(h), np.int64), start, start + 1, np.ones(len(h), bool)
    out = []
    for r in range(rounds):
        n = len(name)
        if n < 2:
            break
        same = (text[1:] == text[:-1])
        first = np.concatenate([[True], ~(same & (name[1:] == name[:-1]))])
        heads = np.flatnonzero(first)
        count = np.diff(heads, append=n)
        whole = count * size[heads]
        fits = (whole <= longest) | (count == 1)
        keep = first | np.repeat(~fits, count)
        run = np.repeat(np.where(fits, count, 1), count)[keep]
        ends = np.flatnonzero(np.concatenate([keep[1:], [True]]))
        at = np.flatnonzero(keep)
        same = text[at][1:] == text[at][:-1]
        lead, tail = np.concatenate([[True], ~same]), np.concatenate([~same, [True]])
        edge = start[at[lead]] - 1, (start[ends] + size[ends])[tail] + 1
        # that a run ends here is settled by the symbols next to it as they were, not by the runs that they are in
        before, after = low[at - 1], high[np.minimum(ends + 1, n - 1)]
        before[lead], after[tail] = edge
        known = np.where(lead, True, sure[at - 1]) & np.where(tail, True, sure[np.minimum(ends + 1, n - 1)])
        sure = (sure & np.repeat(fits, count))[keep] & known
        name, text = name[keep], text[keep]
        start, low, high, size = start[keep], np.minimum(low[at], before), np.maximum(high[ends], after), size[keep] * run
        name = np.where(run > 1, mix(name + run.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), name)
        n = len(name)
        right = (mix(name ^ np.uint64(0xA0761D6478BD642F * (r + 1) & (1 << 64) - 1)) >> np.uint64(63)).astype(bool)
        joins = same & ~right[:-1] & right[1:] & (size[:-1] + size[1:] <= longest)
        left = np.concatenate([joins, [False]])
        gone = np.concatenate([[False], joins])
        before, after = low.copy(), high.copy()
        before[1:], after[:-1] = low[:-1], high[1:]
        before[lead], after[tail] = edge
        after_name = np.concatenate([name[1:], name[:1]])
        new_low = np.where(left | ~right, low, np.minimum(low, before))
        new_high = np.where(left, np.concatenate([high[1:], high[:1]]), np.where(right, high, np.maximum(high, after)))
        # a right symbol by itself hangs on the one before it, a left one on the one after it
        known = np.where(right, np.concatenate([[True], sure[:-1] | ~same]), np.concatenate([sure[1:] | ~same, [True]]))
        sure = sure & known
        name = np.where(left, mix(name * np.uint64(0xE7037ED1A0B428DB) + after_name), name)
        size = np.where(left, size + np.concatenate([size[1:], [0]]), size)
        keep = ~gone
        name, text, start, size, sure, low, high = name[keep], text[keep], start[keep], size[keep], sure[keep], new_low[keep], new_high[keep]
        out.append((name[sure], low[sure], high[sure]))
    return out


def segments(h: np.ndarray, cuts: np.ndarray, window: int, rounds: int = 3, longest: int = 8):
    """Stretches of successive windows that hang on one symbol: (text, first window, windows, key, content).

    A window hangs on one of the symbols that it settles by itself, of the highest round with any: the one with the
    least hash, the leftmost of equals. Two windows of equal words hang on equal symbols at equal places, so only
    stretches of one key (the symbol and the words that settle it) can hold equal windows. content is the hash of all
    words of the stretch. A window that settles no symbol is a stretch by itself.
    """
    counts = np.maximum(np.diff(cuts) - window + 1, 0)
    text = np.repeat(np.arange(len(cuts) - 1), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(cuts[:-1], counts)
    hashed = Hashes(h)
    anchor, key = np.full(len(at), -1, np.int64), np.zeros(len(at), np.uint64)
    for level, (name, low, high) in reversed(list(enumerate(levels(h, cuts, rounds, longest)))):
        todo = np.flatnonzero(anchor < 0)
        fine = (low >= 0) & (high <= len(h)) & (high - low <= window)
        name, low, high = name[fine], low[fine], high[fine]
        if not len(todo) or not len(name):
            continue
        below = np.concatenate([[0], np.cumsum(np.bincount(low, minlength=len(h)))])  # symbols with low < i
        upto = np.cumsum(np.bincount(high, minlength=len(h) + 1))  # symbols with high <= i
        a, b = below[at[todo]], upto[at[todo] + window]
        some = b > a
        todo, a, b = todo[some], a[some], b[some]
        if not len(todo):
            continue
        rank = mix(name + np.uint64(level)) & ~np.uint64(_PLACE) | np.arange(len(name), dtype=np.uint64)
        tables, width = [rank], 1
        while 2 * width <= (b - a).max():
            t = tables[-1]
            tables.append(np.minimum(t[:-width], t[width:]) if len(t) > width else t)
            width *= 2
        depth = _DEPTH[b - a]
        least = np.empty(len(todo), np.uint64)
        for d in range(len(tables)):
            m = np.flatnonzero(depth == d)
            least[m] = np.minimum(tables[d][a[m]], tables[d][b[m] - (1 << d)])
        chosen = (least & np.uint64(_PLACE)).astype(np.int64)
        anchor[todo] = chosen + level * (1 << 40)
        key[todo] = mix(name[chosen] + np.uint64(level)) ^ hashed(low[chosen], high[chosen])
    lone = anchor < 0
    key[lone] = hashed(at[lone], at[lone] + window)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | lone[1:]]) if len(at) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    n = np.diff(heads, append=len(at))
    return text[heads], at[heads], n, key[heads], hashed(at[heads], at[heads] + n + window - 1)


def repeated(docs: DataFrame, scratch: Scratch, window: int = 35) -> DataFrame:
    """(row, ranges): for rows of docs(row, text) with repeats, the words covered by a window that also starts elsewhere.

    1. Stretches are counted by key. A key seen once is done: nothing repeats. Where all stretches of a key have equal
       content, all their windows repeat.
    2. Only where stretches of one key differ, one of each content has its windows hashed and counted, with the number
       of its copies, to tell which repeat (the passage's ends, mostly).
    Sums come before every shuffle and joins are on hashes that Spark can split, so a passage in a third of all rows is
    no hot spot.
    """
    def stretches(batches):
        for part, buf, cuts in text_batches(batches):
            h, at = word_hashes(buf, cuts)
            text, first, n, key, content = segments(h, at, window)
            yield pa.record_batch([part.column("row").take(pa.array(text)), pa.array(first - at[text], pa.int32()), pa.array(n, pa.int32()), pa.array(key.view(np.int64)), pa.array(content.view(np.int64))], ["row", "first", "n", "key", "content"])

    found = scratch.save(docs.select("row", "text").mapInArrow(stretches, "row long, first int, n int, key long, content long"))
    keys = found.groupBy("key").agg(F.count("*").alias("total"), F.min("content").alias("low"), F.max("content").alias("high"))
    keys = scratch.save(keys.where("total > 1").select("key", (F.col("low") < F.col("high")).alias("mixed")))
    scratch.release()
    places = scratch.save(found.join(keys, "key"))
    scratch.release()
    scratch.drop(found, keys)
    kinds = places.where("mixed").groupBy("key", "content").agg(F.count("*").alias("copies"), F.min(F.struct("row", "first", "n")).alias("one"))

    ask = kinds.select(F.col("one.row").alias("row"), F.struct(F.col("one.first").alias("first"), F.col("one.n").alias("n"), "key", "content", "copies").alias("s"))
    ask = docs.join(ask.groupBy("row").agg(F.collect_list("s").alias("s")), "row").dropDuplicates(["row"]).select("row", "text", "s")

    def windows(batches):
        for part, buf, cuts in text_batches(batches):
            h, at = word_hashes(buf, cuts)
            hashed = Hashes(h)
            s = part.column("s")
            which = np.repeat(np.arange(part.num_rows), s.value_lengths().to_numpy(zero_copy_only=False))
            flat = {k: v for k, v in zip(("first", "n", "key", "content", "copies"), s.flatten().flatten())}
            n = flat["n"].to_numpy().astype(np.int64)
            begin = np.repeat(flat["first"].to_numpy() + at[which], n)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            each = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.record_batch([pa.array(hashed(begin + offset, begin + offset + window).view(np.int64)), pa.array(offset, pa.int32()), *(flat[k].take(each) for k in ("key", "content", "copies"))], ["w", "offset", "key", "content", "copies"])

    each = scratch.save(ask.mapInArrow(windows, "w long, offset int, key long, content long, copies long"))
    # equal windows have one key, so key and window must both agree: 128 bits, as where stretches agree in key and content
    again = each.groupBy("key", "w").agg(F.sum("copies").alias("total")).where("total > 1")
    offsets = scratch.save(each.join(again, ["key", "w"], "left_semi").groupBy("key", "content").agg(F.collect_list("offset").alias("offsets")))
    span = lambda start, n: F.struct(start.cast("int").alias("start"), (start + n + (window - 1)).cast("int").alias("end"))
    whole = places.where("not mixed").select("row", span(F.col("first"), F.col("n")).alias("r"))
    some = places.where("mixed").join(offsets, ["key", "content"]).select("row", F.explode("offsets").alias("o"), "first").select("row", span(F.col("first") + F.col("o"), F.lit(1)).alias("r"))
    return scratch.save(whole.unionByName(some).groupBy("row").agg(F.collect_set("r").alias("ranges")))


def remove(docs: DataFrame, scratch: Scratch, window: int = 35) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_words, n_removed, kept: whole texts without words of repeated windows.

    Windows are judged on the input, so all copies of a passage go, also within a document. Null text: no words, kept
    "". Texts shorter than a window stay. Repeated rows are occurrences of their windows like any other. Rows are told
    apart by a hash of doc_id and text; doc_id may be null. Other columns are not read.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    ranges = repeated(rows, scratch, window)
    scratch.release()

    def cut(batches):
        for part, buf, cuts in text_batches(batches):
            ids, total, removed, kept = part.column("doc_id"), [], [], []
            spans = part.column("ranges").to_pylist()
            for i in range(part.num_rows):
                b = buf[cuts[i]:cuts[i + 1]]
                words = bytes(b).split()  # ASCII white space
                total.append(len(words))
                if spans[i]:
                    step = np.zeros(len(words) + 1, np.int64)
                    for s in spans[i]:
                        step[s["start"]] += 1
                        step[s["end"]] -= 1
                    gone = np.cumsum(step[:-1]) > 0
                    words = [w for w, g in zip(words, gone) if not g]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.record_batch([ids, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return rows.join(ranges, "row", "left").select("doc_id", "text", "ranges").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
