"""Statistics of chunks, documents and usage."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def category_counts(chunks: DataFrame, flags: tuple[str, ...] = ("has_error_code", "has_sql", "has_api", "has_number", "is_too_short", "is_large_table")) -> DataFrame:
    """category, value, count, percent of all chunks, for topic, block types as stored and flags that are set."""
    items = F.array_compact(F.array(F.when(F.col("topic").isNotNull(), F.struct(F.lit("topic").alias("category"), F.col("topic").alias("value"))), F.struct(F.lit("block_types").alias("category"), F.array_join("block_types", "|").alias("value")), *[F.when(F.col(f), F.struct(F.lit("flag").alias("category"), F.lit(f).alias("value"))) for f in flags]))
    total = chunks.agg(F.count("*").alias("total"))
    counts = chunks.select(F.explode(items).alias("i")).groupBy("i.category", "i.value").agg(F.count("*").alias("count"))
    return counts.join(F.broadcast(total)).select("category", "value", "count", F.round(F.col("count") * 100.0 / F.col("total"), 2).alias("percent"))  # one row


def length_extremes(chunks: DataFrame, id: str = "chunk_id") -> DataFrame:
    """The shortest and the longest text, the first of equals by id."""
    n = F.length("text")
    return chunks.agg(F.min(F.struct(n.alias("n"), F.col(id).alias("id"))).alias("lo"), F.min(F.struct((-n).alias("n"), F.col(id).alias("id"))).alias("hi")).select(F.col("lo.n").alias("min_length"), F.col("lo.id").alias("min_id"), (-F.col("hi.n")).alias("max_length"), F.col("hi.id").alias("max_id"))


def length_stats(nodes: DataFrame) -> DataFrame:
    n = F.length("text")
    return nodes.agg(F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.count("*").alias("n"))


def knowledge_hash(files: DataFrame, parts: tuple[str, ...] = ("file_path", "file_size", "modified")) -> DataFrame:
    """md5 of a collection's lines path:size:time in order of path (by its parts), joined by line ends. Without files: "empty".

    Lines are sorted by Spark; one task then streams over them, since such a hash is sequential, and holds one batch.
    """
    line = F.concat_ws(":", *[F.col(p).cast("string") for p in parts])
    lines = files.select(F.split(F.col(parts[0]).cast("string"), "/").alias("path"), line.alias("l"))

    def run(batches):
        h, n = hashlib.md5(usedforsecurity=False), 0
        for b in batches:
            for x in b.column("l"):
                h.update(("\n" * (n > 0) + x.as_py()).encode())
                n += 1
        yield pa.record_batch([pa.array([h.hexdigest()] if n else [], pa.string())], ["h"])

    return lines.orderBy("path", "l").coalesce(1).select("l").mapInArrow(run, "h string").agg(F.coalesce(F.max("h"), F.lit("empty")).alias("knowledge_hash"))


def blocked_hash(files: DataFrame, parts: tuple[str, ...] = ("file_path", "file_size", "modified"), digits: int = 3) -> DataFrame:
    """A hash of the same lines that no task computes alone: of their sorted blocks, by 16**digits hashes of the path. It tells
    collections apart as knowledge_hash() does, with another value. Without files: "empty"."""
    line = F.concat_ws(":", *[F.col(p).cast("string") for p in parts])
    each = files.select(line.alias("l"), F.substring(F.md5(F.col(parts[0]).cast("string")), 1, digits).alias("b"))
    own = each.groupBy("b").agg(F.md5(F.array_join(F.sort_array(F.collect_list("l")), "\n")).alias("h"))
    whole = own.agg(F.sort_array(F.collect_list(F.struct("b", "h"))).alias("h"))
    return whole.select(F.when(F.size("h") == 0, "empty").otherwise(F.md5(F.array_join(F.transform("h", lambda x: x["h"]), "\n"))).alias("knowledge_hash"))


def usage_totals(usage: DataFrame) -> DataFrame:
    """usage(question_id, stage, prompt_tokens, completion_tokens): a row a question with rewrite, answer and total."""
    pick = lambda s, c: F.sum(F.when(F.col("stage") == s, F.col(c)).otherwise(0))
    cols = [pick(s, f"{k}_tokens").alias(f"{s}_{k}") for s in ("rewrite", "answer") for k in ("prompt", "completion")]
    return usage.groupBy("question_id").agg(*cols, F.sum("prompt_tokens").alias("total_prompt"), F.sum("completion_tokens").alias("total_completion"))


def stream_maxima(counters: DataFrame, keys: list[str]) -> DataFrame:
    return counters.groupBy("question_id").agg(*[F.max(k).alias(k) for k in keys])


def outcome_counts(results: DataFrame, ok: Column) -> DataFrame:
    return results.agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))
