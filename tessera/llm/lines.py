"""Line dedup by a deletion-neighbourhood join on words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_batches, word_hashes
from .substrings import Hashes

#: Kinds of variants: the line less word i, among lines as long; a whole line; a line less a word, among whole lines.
SAME, WHOLE, LESS = 0, 1, 2


def split(buf: np.ndarray, cuts: np.ndarray):
    """(text of each line, number of each line in its text, line cuts) of concatenated texts; lines end at \\n."""
    breaks = np.flatnonzero(buf == 10)
    text = np.concatenate([np.arange(len(cuts) - 1), np.searchsorted(cuts, breaks, "right") - 1])
    start = np.concatenate([cuts[:-1], breaks + 1])
    order = np.lexsort((start, text))
    text, start = text[order], start[order]
    number = np.arange(len(text)) - np.searchsorted(text, text)
    return text, number, np.append(start, len(buf))


def variants(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, place of the word left out, hash of what stays) for each word of lines a:b of word hashes h."""
    hashed = Hashes(h)
    n = b - a
    line = np.repeat(np.arange(len(n)), n)
    i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    with np.errstate(over="ignore"):
        front, back = hashed.sums[a[line] + i] - hashed.sums[a[line]], hashed.sums[b[line]] - hashed.sums[a[line] + i + 1]
        return line, i, hashed.of(front * hashed.back[a[line]] + back * hashed.back[a[line] + 1], n[line] - 1)


def within_one(x: list, y: list) -> bool:
    """Do two word lists differ by at most one word changed, put in or left out?"""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    i = next((i for i, (s, t) in enumerate(zip(x, y)) if s != t), len(x))
    return x[i + (len(x) == len(y)):] == y[i + 1:]


def repeats(docs: DataFrame, scratch: Scratch, shortest: int = 3, edit_from: int = 8) -> DataFrame:
    """(row, gone array<int>): numbers of lines to drop, for rows of docs(doc_id, row, text) that have any.

    1. Occurrences are grouped by their words; a group's earliest occurrence stands for it.
    2. Two lines within one word of each other share their first or last floor(m / 2) words, m the shorter's length.
       Only lines that share such a half with another line of a fitting length make variants; nothing else can match.
    3. Variants (a line less each of its words) meet by hash. All lines of a bucket are compared with its earliest,
       not with each other: what matters is whether any earlier line is near. Lines that lack the same word of the same
       place are all within one word; of whole lines and longer lines less a word each meets the other kind's earliest.
    4. Pairs are checked on the words themselves.
    """
    def scan(batches):
        for part, buf, cuts in text_batches(batches):
            text, number, at = split(buf, cuts)
            h, word = word_hashes(buf, at, lower=True)
            n = np.diff(word)
            m = n >= shortest
            hashed = Hashes(h)
            yield pa.record_batch([part.column("doc_id").take(pa.array(text[m])), part.column("row").take(pa.array(text[m])), pa.array(number[m], pa.int32()), pa.array(hashed(word[:-1][m], word[1:][m]).view(np.int64)), pa.array(n[m], pa.int32())], ["doc_id", "row", "line", "h", "n"])

    def halves(batches):
        for part, buf, cuts in text_batches(batches):
            _, _, at = split(buf, cuts)
            h, word = word_hashes(buf, at, lower=True)
            n = np.diff(word)
            a, b, n = word[:-1][n >= edit_from], word[1:][n >= edit_from], n[n >= edit_from]
            hashed = Hashes(h)
            line, keys = hashed(a, b).view(np.int64), []
            for longer in (0, 1):
                m = n - longer
                m_ok = m >= edit_from
                q = m // 2
                for side, k in enumerate((hashed(a, a + q), hashed(b - q, b))):
                    k = k ^ (m.astype(np.uint64) * np.uint64(4) + np.uint64(side)) * np.uint64(0x9E3779B97F4A7C15)
                    keys.append((k[m_ok].view(np.int64), line[m_ok], np.full(m_ok.sum(), longer, np.int32)))
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*keys)], ["key", "h", "longer"])

    rows = docs.select("doc_id", "row", "text")
    lines = scratch.save(rows.mapInArrow(scan, "doc_id long, row long, line int, h long, n int"))
    classes = scratch.save(lines.groupBy("h").agg(F.min(F.struct("doc_id", "row", "line")).alias("first"), F.min("n").alias("n")))
    half = scratch.save(rows.select("text").mapInArrow(halves, "key long, h long, longer int"))
    equal = F.when(F.col("longer") == 0, F.col("h"))
    met = half.groupBy("key").agg(F.min(equal).alias("low"), F.max(equal).alias("high"), F.max("longer").alias("longer"))
    met = met.select("key", (F.col("low") < F.col("high")).alias("same"), (F.col("longer").eqNullSafe(1) & F.col("low").isNotNull()).alias("grown")).where("same or grown")
    met = scratch.save(met)
    near = half.join(met, "key").groupBy("h").agg(F.max((F.col("longer") == 0) & F.col("same")).alias("same"), F.max((F.col("longer") == 0) & F.col("grown")).alias("whole"), F.max((F.col("longer") == 1) & F.col("grown")).alias("less"))
    near = scratch.save(near.where("same or whole or less"))
    scratch.drop(half)
    scratch.release()

    ask = classes.join(near, "h").groupBy(F.col("first.row").alias("row")).agg(F.collect_list(F.struct("first.doc_id", "first.line", "same", "whole", "less")).alias("s"))
    ask = rows.select("row", "text").join(ask, "row").dropDuplicates(["row"])

    def pick(batches):
        for b in batches:
            for text, row, s in zip(b.column("text"), b.column("row"), b.column("s")):
                own = text.as_py().split("\n")
                s = s.as_py()
                yield pa.record_batch([pa.array([x["doc_id"] for x in s], pa.int64()), pa.array([row.as_py()] * len(s), pa.int64()), pa.array([x["line"] for x in s], pa.int32()), *(pa.array([x[k] for x in s], pa.bool_()) for k in ("same", "whole", "less")), pa.array([own[x["line"]] for x in s])], ["doc_id", "row", "line", "same", "whole", "less", "text"])

    some = scratch.save(ask.mapInArrow(pick, "doc_id long, row long, line int, same boolean, whole boolean, less boolean, text string"))
    scratch.release()

    def spread(batches):
        for part, buf, cuts in text_batches(batches, most=1 << 18):
            h, word = word_hashes(buf, cuts, lower=True)
            a, b = word[:-1], word[1:]
            hashed = Hashes(h)
            flag = {k: part.column(k).to_numpy(zero_copy_only=False).astype(bool) for k in ("same", "whole", "less")}
            line, i, left = variants(h, a, b)
            n = (b - a)[line]
            place = (i * 2 + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) ^ n.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            s, d, w = flag["same"][line], flag["less"][line], np.flatnonzero(flag["whole"])
            v = np.concatenate([(left ^ place)[s], left[d], hashed(a, b)[w]])
            kind = np.repeat(np.array([SAME, LESS, WHOLE], np.int32), [s.sum(), d.sum(), len(w)])
            who = pa.array(np.concatenate([line[s], line[d], w]))
            yield pa.record_batch([pa.array(v.view(np.int64)), pa.array(kind), *(part.column(c).take(who) for c in ("doc_id", "row", "line"))], ["v", "kind", "doc_id", "row", "line"])

    each = some.mapInArrow(spread, "v long, kind int, doc_id long, row long, line int").select("v", "kind", F.struct("doc_id", "row", "line").alias("at"))
    # within SAME buckets to the earliest; WHOLE and LESS share a bucket and meet the other's earliest
    bucket = F.when(F.col("kind") == SAME, 0).otherwise(1).alias("across")
    low = each.groupBy("v", bucket).agg(*[F.min(F.when(F.col("kind") == k, F.col("at"))).alias(f"low{k}") for k in (SAME, WHOLE, LESS)], F.count("*").alias("count")).where(f"count > 1 and (across = 0 or low{WHOLE} is not null and low{LESS} is not null)")
    other = F.when(F.col("kind") == SAME, F.col(f"low{SAME}")).when(F.col("kind") == WHOLE, F.col(f"low{LESS}")).otherwise(F.col(f"low{WHOLE}"))
    pairs = each.withColumn("across", bucket).join(low, ["v", "across"]).select("at", other.alias("to")).where("to < at").distinct()
    words = some.select(F.struct("doc_id", "row", "line").alias("p"), F.lower("text").alias("text"))
    pairs = pairs.withColumn("k", F.xxhash64("at")).withColumn("l", F.xxhash64("to"))
    words = words.withColumn("k", F.xxhash64("p")).drop("p")
    pairs = pairs.join(words.withColumnRenamed("text", "x"), "k").join(words.select(F.col("k").alias("l"), F.col("text").alias("y")), "l").select("at.row", "at.line", "x", "y")

    def check(batches):
        low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
        cut = lambda s: s.encode().translate(low).split()
        for b in batches:
            yield b.select(["row", "line"]).filter(pa.array([within_one(cut(x.as_py()), cut(y.as_py())) for x, y in zip(b.column("x"), b.column("y"))], pa.bool_()))

    dropped = scratch.save(pairs.mapInArrow(check, "row long, line int").distinct())
    scratch.release()
    gone = classes.join(dropped.select(F.struct("row", "line").alias("d"), F.lit(True).alias("near")), (F.col("first.row") == F.col("d.row")) & (F.col("first.line") == F.col("d.line")), "left").select("h", "first", F.coalesce("near", F.lit(False)).alias("near"))
    out = lines.join(gone, "h").where("near or struct(doc_id, row, line) <> first").groupBy("row").agg(F.collect_set("line").alias("gone"))
    return scratch.save(out)


def dedup(docs: DataFrame, scratch: Scratch, shortest: int = 3, edit_from: int = 8) -> DataFrame:
    """docs with repeated lines dropped from text; columns n_lines and n_removed are added (or replaced), all others stay.

    A line's words are runs of other than ASCII white space with A-Z lower-cased. Lines of `shortest` words or more are
    compared: equal words, or at most one word changed, put in or left out where both lines have `edit_from` words or
    more. Of all occurrences in the order of (doc_id, a hash of the row, line number), one goes if it is not the first
    of its words or if a near line's first is earlier, whether that line stays or not. Kept lines are joined by \\n.

    A null text stays null (0 lines); so do empty texts stay empty (1 line). A null doc_id sorts first. Rows that
    repeat in doc_id and text are one row here: each keeps what the other keeps. A text may become "".
    """
    out, kept = _kept(docs, scratch, shortest, edit_from)
    n = F.when(F.col("d.text").isNull(), 0).otherwise(F.size(F.split("d.text", "\n", -1))).cast("long")
    removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    own = [kept.alias(c) if c == "text" else F.col(f"d.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*own, n.alias("n_lines"), removed.alias("n_removed"))


def drop_repeats(docs: DataFrame, scratch: Scratch, shortest: int = 3, edit_from: int = 8, length: str = "n_chars", least_share: float = 0.1) -> DataFrame:
    """docs with text as in dedup() and exactly their columns. A row goes if its lines that stay hold less than
    `least_share` of its words (all its lines are repeats, or it is a copy but for a line or two); one that loses no line
    stays. Column `length`, if there is one, is brought up to date where lines went."""
    words = lambda c: F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+"))
    out, kept = _kept(docs, scratch, shortest, edit_from)
    out = out.select("d", "gone", kept.alias("kept")).where(F.when(F.col("gone").isNull(), True).otherwise((F.col("kept") != "") & (words(F.col("kept")) >= least_share * words(F.col("d.text")))))
    new = {"text": F.col("kept")} | ({length: F.when(F.col("gone").isNull(), F.col(f"d.`{length}`")).otherwise(F.length("kept")).cast(docs.schema[length].dataType)} if length in docs.columns else {})
    return out.select(*[new.get(c, F.col(f"d.`{c}`")).alias(c) for c in docs.columns])


def _kept(docs: DataFrame, scratch: Scratch, shortest: int, edit_from: int):
    """Rows as a struct d with gone (null: nothing goes), and the expression of what stays of the text."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.xxhash64("doc_id", "text").alias("row"))
    gone = repeats(rows.select("d.doc_id", "row", F.coalesce("d.text", F.lit("")).alias("text")), scratch, shortest, edit_from)
    kept = F.array_join(F.filter(F.split("d.text", "\n", -1), lambda x, i: ~F.array_contains("gone", i)), "\n")
    return rows.join(gone, "row", "left"), F.when(F.col("gone").isNull(), F.col("d.text")).otherwise(kept)
