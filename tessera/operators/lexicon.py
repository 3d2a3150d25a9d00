"""Glossary matching: terms in questions, longest first, with a coverage gate."""

from __future__ import annotations

import functools
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


_HEAD = 4


@functools.lru_cache(maxsize=1 << 16)
def _form(key: str) -> re.Pattern | None:
    """The pattern of a key that is a plain ASCII word, hyphens optional; None for other keys."""
    if not re.fullmatch(r"[a-zA-Z0-9_-]+", key):
        return None
    form = "-?".join(map(re.escape, key.split("-")))
    return re.compile(rf"(?<![a-zA-Z0-9]){form}(?![a-zA-Z0-9])")


def pick(text: str, keys: list[str]) -> tuple[list[tuple[str, int, int]], float]:
    """Matches (key, start, end) that don't overlap, longest key first, and the share of the text that they cover.

    keys: in dictionary order, lower case. ASCII keys match whole words (hyphens may be missing) everywhere, others at
    their first place.
    """
    low, found = text.lower(), []
    for key in keys:
        form = _form(key)
        if form:
            found += [(key, *m.span()) for m in form.finditer(low)]
        elif (at := low.find(key)) >= 0:
            found.append((key, at, at + len(key)))
    taken, out = [False] * len(low), []
    for key, a, b in sorted(found, key=lambda m: -len(m[0])):
        if not any(taken[a:b]):
            taken[a:b] = [True] * (b - a)
            out.append((key, a, b))
    return out, sum(taken) / len(low) if low else 0.0


class Index:
    """Finds the keys that can occur in a text by hashed pieces of it: work grows with the text and its hits, not with the
    number of keys that begin alike."""

    def __init__(self, keys: list[str]):
        self.bare = [k for k in keys if k and not k.strip("-")]
        self.words: dict[str, list[str]] = {}  # plain words by their form without hyphens
        others = set()
        for k in keys:
            if _form(k):
                self.words.setdefault(k.replace("-", ""), []).append(k)
            else:
                others.add(k)
        self.words.pop("", None)
        self.others = others - {""}
        self.word_heads, self.other_heads = self._heads(self.words), self._heads(self.others)
        self.longest = max(map(len, self.words), default=0)

    @staticmethod
    def _heads(forms) -> dict[int, dict[str, list[int]]]:
        """By width, up to _HEAD, and beginning of that width: the lengths of forms."""
        out: dict[int, dict[str, set[int]]] = {}
        for f in forms:
            w = min(len(f), _HEAD)
            out.setdefault(w, {}).setdefault(f[:w], set()).add(len(f))
        return {w: {h: sorted(n) for h, n in heads.items()} for w, heads in out.items()}

    def able(self, text: str) -> set[str]:
        low, out = text.lower(), set()
        for w, heads in self.other_heads.items():
            for i in range(len(low) - w + 1):
                for n in heads.get(low[i:i + w], ()):
                    if (piece := low[i:i + n]) in self.others:
                        out.add(piece)
        if self.words:
            for m in _START.finditer(low):
                run = _RUN.match(low, m.start(), m.start() + 2 * self.longest)[0].replace("-", "")
                for w, heads in self.word_heads.items():
                    for n in heads.get(run[:w], ()):
                        out.update(self.words.get(run[:n], ()))
        if self.bare and "-" in low:
            out.update(self.bare)
        return out


_START, _RUN = re.compile(r"(?<![a-z0-9])[a-z0-9_]"), re.compile(r"[a-z0-9_-]*")
_MATCH = pa.list_(pa.struct([("key", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_KEYS = pa.list_(pa.struct([("key", pa.string()), ("seq", pa.int64())]))


def _chosen(ids: pa.Array, at: pa.Array, texts: list, keys: list[list[str]]) -> pa.RecordBatch:
    """A row for each id, whose text is texts[at]."""
    rows = [pick(t or "", k) for t, k in zip(texts, keys)]
    m = pa.array([[{"key": k, "start": a, "end": e} for k, a, e in r[0]] for r in rows], _MATCH)
    return pa.record_batch([ids, m.take(at), pa.array([r[1] for r in rows], pa.float64()).take(at)], ["question_id", "matches", "coverage"])


def match(questions: DataFrame, keys: DataFrame, coverage: float = 0.5, most_keys: int = 500_000) -> DataFrame:
    """questions(question_id, text) against keys(key, seq): question_id, matches, coverage, hit (coverage reached).

    The dictionary goes out in blocks of `most_keys`; with one block a question is one pass over its text, with more the
    candidates of all blocks meet in one list a question before the choice. Equal texts of a batch are looked up once.
    Questions are short and may lie in a few file blocks, so they are dealt out by their id first.
    """
    few, found = keys.limit(most_keys + 1).collect(), None  # one pass over the dictionary where a block holds it
    parts = 1 if len(few) <= most_keys else -(-keys.count() // most_keys)
    chosen = "question_id long, matches array<struct<key: string, start: int, end: int>>, coverage double"
    for part in range(parts):
        rows = few if parts == 1 else keys.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part).collect()
        rows.sort(key=lambda r: (r["seq"] is not None, r["seq"], r["key"]))
        seq = {}
        for r in rows:
            seq.setdefault(r["key"], r["seq"])
        index = Index(list(seq))

        def run(batches, seq=seq, index=index, choose=parts == 1):
            for b in batches:
                for i in range(0, b.num_rows, 4096):
                    own = b.slice(i, 4096)
                    each = pc.fill_null(own.column("text"), "").dictionary_encode()
                    texts = each.dictionary.to_pylist()
                    able = [sorted(index.able(t), key=lambda k: (seq[k], k)) for t in texts]
                    if choose:
                        yield _chosen(own.column("question_id"), each.indices, texts, able)
                    else:
                        keys = pa.array([[{"key": k, "seq": seq[k]} for k in ks] for ks in able], _KEYS)
                        yield own.append_column("keys", keys.take(each.indices))

        q = questions.select(F.col("question_id").cast("long").alias("question_id"), "text").repartition("question_id")
        if parts == 1:
            found = q.mapInArrow(run, chosen)
            break
        got = q.mapInArrow(run, "question_id long, text string, keys array<struct<key: string, seq: long>>")
        found = got if found is None else found.unionByName(got)
    if parts > 1:
        def choose(batches):
            for b in batches:
                for i in range(0, b.num_rows, 4096):
                    own = b.slice(i, 4096)
                    keys = [[k["key"] for k in sorted(ks or [], key=lambda x: (x["seq"], x["key"]))] for ks in own.column("keys").to_pylist()]
                    yield _chosen(own.column("question_id"), pa.array(range(len(keys)), pa.int32()), own.column("text").to_pylist(), keys)

        found = found.groupBy("question_id", "text").agg(F.flatten(F.collect_list("keys")).alias("keys")).mapInArrow(choose, chosen)
    return found.withColumn("hit", (F.size("matches") > 0) & (F.col("coverage") >= coverage))


def entries(matched: DataFrame, dictionary: DataFrame, most_chars: int = 1 << 26) -> DataFrame:
    """question_id, pos, seq, term, definitions of questions that hit, in the order of choice.

    Spark guesses sizes from files and would send out the matches, which grow, and join them in the dictionary's one task. So
    the dictionary goes out, if it has at most `most_chars` characters (64 more for each entry); a larger one is merged.
    """
    m = matched.where("hit").select("question_id", F.posexplode("matches").alias("pos", "m"))
    chars = dictionary.agg(F.sum(F.length(F.concat_ws("", "key", "term", "definitions", F.col("seq").cast("string"))) + 64)).first()[0] or 0
    known = F.broadcast(dictionary) if chars <= most_chars else dictionary.hint("merge")
    return m.select("question_id", "pos", F.col("m.key").alias("key")).join(known, "key").drop("key")


def grouped(found: DataFrame) -> DataFrame:
    """question_id, term, pos (of its first entry), n, definitions: entries of a term together, in order."""
    items = F.sort_array(F.collect_list(F.struct("pos", "seq", "definitions")))
    return found.groupBy("question_id", "term").agg(F.min("pos").alias("pos"), F.count("*").alias("n"), items.alias("items"))


def render(found: DataFrame) -> DataFrame:
    """question_id, markdown: a title a term, numbered where it has several entries, definitions as lists.

    Entries move once: both groupings are of rows that lie together by question.
    """
    def bullets(defs):
        lines = lambda d: F.transform(F.split(X.clean_definition(d), "\n", -1), lambda x, i: F.concat(F.when(i == 0, F.lit("- ")).otherwise("  "), x))
        return F.flatten(F.transform(defs, lines))

    def entry(e, i, n):
        defs = e["definitions"]
        numbered = F.concat(F.array(F.concat(F.lit("#### "), (i + 1).cast("string"), F.lit(". "), F.coalesce(X.clean_definition(F.get(defs, 0)), F.lit("")))), bullets(F.slice(defs, F.lit(2), F.greatest(F.lit(0), F.size(defs) - 1))))
        return F.when(n > 1, numbered).otherwise(bullets(defs))

    g = grouped(found.repartition("question_id")).withColumn("lines", F.flatten(F.transform("items", lambda e, i: entry(e, i, F.col("n")))))
    part = F.array_join(F.concat(F.array(F.concat(F.lit("## **"), F.col("term"), F.lit("**"))), F.col("lines")), "\n")
    parts = F.sort_array(F.collect_list(F.struct("pos", "term", part.alias("t"))))
    return g.groupBy("question_id").agg(X.strip(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n")).alias("markdown"))
