"""Answers a table of questions at once, up to the prompt context and its citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import routing, text as X
from ..operators import cite, lexicon, retrieval
from ..settings import Settings


def retrieve(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, settings: Settings = Settings(), embedder=retrieval.embed, scorer: Column | None = None) -> DataFrame:
    """questions(query_id, query) to ranked nodes with their texts: fused lists, one node a place, reranked, selected and,
    where that is weak, with exact supplements."""
    q = embedder(questions.select("query_id", "query").withColumnRenamed("query", "text")).withColumnRenamed("text", "query")
    fused = retrieval.hybrid(chunks, vectors, q.select("query_id", "query"), q.select("query_id", "embedding"), settings)
    columns = ("chunk_id", "file_path", "file_name", "header_path", "line_start", "line_end", "block_types", "text")
    nodes = retrieval.dedup(fused.join(chunks.select(*columns), "chunk_id")).join(questions.select("query_id", "query"), "query_id")
    best = retrieval.select_dynamic(retrieval.rerank(nodes, scorer, settings.rerank_max), settings.rerank_min, settings.rerank_ratio, settings.rerank_max)
    state = retrieval.weak(best)
    poor = state.where("weak").select("query_id", F.least(F.col("n"), F.lit(settings.rerank_min)).alias("n"))
    start = best.join(poor.select("query_id"), "query_id", "left_semi").where(F.col("rank") <= settings.rerank_min)
    extra = retrieval.supplement(chunks, poor.join(questions, "query_id"), start, settings.rerank_max)
    mixed = retrieval.splice(start, extra).join(chunks.select(*columns), "chunk_id")
    return retrieval.together(best.join(poor.select("query_id"), "query_id", "left_anti").select(*mixed.columns), mixed)


def ask(questions: DataFrame, dictionary: DataFrame, chunks: DataFrame, vectors: DataFrame, settings: Settings = Settings(), embedder=retrieval.embed, scorer: Column | None = None) -> DataFrame:
    """questions(query_id, query, mode): route, dictionary answer, context and references of each; no model is called."""
    clean = questions.withColumn("asked", X.sanitize_query(F.col("query")))
    matched = lexicon.match(clean.select(F.col("query_id").alias("question_id"), F.col("asked").alias("text")), dictionary.select("key", "seq"), settings.dictionary_coverage)
    answers = lexicon.render(lexicon.entries(matched, dictionary)).withColumnRenamed("question_id", "query_id")
    routed = clean.join(matched.select(F.col("question_id").alias("query_id"), "hit"), "query_id", "left")
    routed = routed.withColumn("route", routing.route(F.col("query"), F.col("mode"), F.coalesce("hit", F.lit(False))))
    nodes = retrieve(routed.where(F.col("route").isin("RAG", "QUOTED")).select("query_id", F.col("asked").alias("query")), chunks, vectors, settings, embedder, scorer)
    return routed.select("query_id", "query", "route").join(answers, "query_id", "left").join(retrieval.context(nodes), "query_id", "left").join(cite.reference_lines(nodes), "query_id", "left")
