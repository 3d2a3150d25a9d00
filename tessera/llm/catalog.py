"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, lines, mixing, neighbours, ngram_join, pages, quality, secrets, sql, substrings, toxicity
from .common import Scratch, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), Scratch(spark, "mix")).select("doc_id", "size", "source_size", "target", "taken")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents"), Scratch(spark, "ngrams"), k=4, per_cent=85)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return pages.extract(table(spark, sf_dir, "pages"), Scratch(spark, "pages")).select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.link(table(spark, sf_dir, "embeddings"), Scratch(spark, "neighbours"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "lines"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), where=~quality.held_out())
    out = quality.score(docs, model)
    return out.select("doc_id", F.coalesce(quality.held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove(table(spark, sf_dir, "documents"), Scratch(spark, "substrings"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), count("novel").alias("n_novel"))


def queries():
    return {"op1_mixing": op1_mixing, "op2_ngram_join": op2_ngram_join, "op3_toxicity": op3_toxicity, "op4_pages": op4_pages, "op5_neighbours": op5_neighbours, "op6_lines": op6_lines, "op7_quality": op7_quality, "op8_decontamination": op8_decontamination, "op9_substrings": op9_substrings, "op10_secrets": op10_secrets}


def oracle_sql():
    return {"op1_mixing": sql.OP1, "op2_ngram_join": sql.OP2, "op5_neighbours": sql.OP5, "op6_lines": sql.OP6, "op9_substrings": sql.OP9}
