"""Citations, hit ranges, debug rows and highlighting."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import structure as S


def merge_ranges(ranges: DataFrame, key: str = "file_path") -> DataFrame:
    """(key, start, end): ranges [start, end) merged where they overlap or touch; empty ones go."""
    w = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = ranges.where(F.col("end") > F.col("start")).withColumn("_new", F.when(F.col("start") <= before, 0).otherwise(1))
    return r.withColumn("_g", F.sum("_new").over(w)).groupBy(key, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")


def range_lines(merged: DataFrame, key: str = "file_path") -> DataFrame:
    return merged.select(key, F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("line_no"))


def hit_lines(lines: DataFrame, merged: DataFrame, key: str = "file_path") -> DataFrame:
    """Lines that lie in a range: ranges become lines first, so it is an equality join that Spark can spread."""
    return lines.join(range_lines(merged, key), [key, "line_no"], "left_semi")


def highlight(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """docs(file_path, text) with hits(file_path, start, end): file_path, marked. Documents without hits stay as they are."""
    ranges = merge_ranges(hits).groupBy("file_path").agg(F.collect_list(F.struct("start", "end")).alias("hits"))

    def run(frames):
        for f in frames:
            hit = [[(int(h["start"]), int(h["end"])) for h in x] if x is not None else [] for x in f["hits"]]
            yield pd.DataFrame({"file_path": f["file_path"], "marked": [S.highlight(t or "", h) for t, h in zip(f["text"], hit)]})

    return docs.select("file_path", "text").join(ranges, "file_path", "left").mapInPandas(run, "file_path string, marked string")


def reference_lines(nodes: DataFrame) -> DataFrame:
    """query_id, refs: a line a node in order of rank, with the line range where it has one."""
    line = F.concat(F.lit("- `"), F.col("file_name"), F.lit("`"), F.when((F.col("line_start") >= 0) & (F.col("line_end") > F.col("line_start")), F.format_string(" `%d->%d行`", "line_start", "line_end")).otherwise(""))
    items = F.sort_array(F.collect_list(F.struct("rank", line.alias("l"))))
    return nodes.groupBy("query_id").agg(F.array_join(F.transform(items, lambda x: x["l"]), "\n").alias("refs"))


def files(nodes: DataFrame) -> DataFrame:
    """query_id, file_name, file_path, first rank and hits: one row a cited file by its name; the path is that of the best
    ranked node of the name."""
    hits = F.transform(F.sort_array(F.collect_list(F.struct("rank", "line_start", "line_end"))), lambda x: F.struct(x["line_start"].alias("start"), x["line_end"].alias("end")))
    return nodes.groupBy("query_id", "file_name").agg(F.min_by("file_path", F.struct("rank", "file_path")).alias("file_path"), F.min("rank").alias("rank"), hits.alias("hits"))


def numbered_files(nodes: DataFrame) -> DataFrame:
    """Distinct files of a query, numbered in the order in which they are first seen."""
    f = nodes.groupBy("query_id", "file_path").agg(F.min("rank").alias("first"))
    return f.withColumn("number", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "file_path")))


def debug_rows(nodes: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("rank")
    return nodes.select("query_id", F.row_number().over(w).alias("row"), F.round("score", 4).alias("score"), "file_path", "line_start", "line_end", F.array_join("block_types", "|").alias("block_types"), F.length("text").alias("text_length"))


def with_pdf(files: DataFrame, pdfs: DataFrame) -> DataFrame:
    """Files with the path of the PDF that has their name's stem, null without one."""
    stem = lambda c: F.regexp_replace(F.col(c), r"\.[^./]*$", "")
    p = pdfs.select(stem("pdf_name").alias("_stem"), "pdf_path")
    return files.withColumn("_stem", stem("file_name")).join(p, "_stem", "left").drop("_stem")


def micro_batches(tokens: DataFrame, most: int = 23) -> DataFrame:
    """tokens(question_id, seq, token): question_id, batch, text; a batch ends with a token that has a line end or brings it
    over `most` characters. An answer is one group."""
    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        out, have = [], ""
        for t in f.sort_values("seq")["token"]:
            have += t
            if "\n" in t or len(have) > most:
                out.append(have)
                have = ""
        out += [have] if have else []
        return pd.DataFrame({"question_id": key[0], "batch": range(len(out)), "text": out})

    return tokens.groupBy("question_id").applyInPandas(run, "question_id long, batch int, text string")
