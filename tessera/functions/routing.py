"""Question routing, cache keys and usage, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_quoted, is_refusal, rough_tokens, sanitize_query, strip, token_analysis

#: Greetings that need no retrieval (fixed values).
TRIVIAL = ("hi", "hello", "hey", "你好", "你好吗", "您好", "谢谢", "thanks", "thank you", "bye", "再见", "?", "？")
FIELDS = ("question_type", "retrieval_query", "presentation_intent", "user_intent")


def classify(question: Column) -> Column:
    q = F.lower(strip(question))
    return F.when(q == "", "INVALID").when(q.isin(*TRIVIAL), "CHAT").when(F.length(q) <= 2, "INVALID").otherwise("RAG")


def analyze(question: Column, analyzer=None) -> Column:
    """The four analysis fields. analyzer: a column function of a model that returns JSON text; where it fails, and without
    one, the verdict of classify() and the question without quotes, cut to 200 characters."""
    plain = F.struct(classify(question).alias("question_type"), F.substring(sanitize_query(question), 1, 200).alias("retrieval_query"), F.lit("").alias("presentation_intent"), F.lit("").alias("user_intent"))
    if analyzer is None:
        return plain
    got = json_fields(analyzer(question))
    return F.when(got["question_type"].isin("RAG", "CHAT", "INVALID"), got).otherwise(F.struct(F.lit("RAG").alias("question_type"), question.alias("retrieval_query"), F.lit("").alias("presentation_intent"), F.lit("").alias("user_intent")))


def json_fields(text: Column) -> Column:
    """The four analysis fields of strict JSON, else of whatever looks like them; null where absent."""
    parsed = F.from_json(text, ", ".join(f"{f} string" for f in FIELDS))
    strict = F.try_parse_json(text).isNotNull()

    def loose(field: str) -> Column:
        v = strip(F.regexp_extract(text, rf'"{field}"\s*:\s*"([^"]*)"', 1))
        inner = F.regexp_extract(v, r'^[a-zA-Z_]+\s*":\s*"(.+)$', 1)
        return F.nullif(F.regexp_replace(F.when(inner != "", strip(inner)).otherwise(v), '"+$', ""), F.lit(""))

    return F.struct(*[F.when(strict, parsed[f]).otherwise(loose(f)).alias(f) for f in FIELDS])


def route(question: Column, mode: Column, dictionary_hit: Column) -> Column:
    """DICT, QUOTED, RAG, CHAT or INVALID: quoted questions skip analysis, a confirmed one skips the dictionary."""
    mode = F.when((mode == "NORMAL") & is_quoted(question), "QUOTED").otherwise(mode)
    verdict = classify(question)
    return F.when((mode != "CONFIRM_RAG") & dictionary_hit, "DICT").when(mode == "QUOTED", "QUOTED").when(mode == "CONFIRM_RAG", "RAG").otherwise(verdict)


def with_defaults(question: Column, analysis: Column) -> Column:
    """Analysis with defaults, and whether its answer may be cached (an empty presentation resets the user intent)."""
    given = lambda f: F.nullif(analysis[f], F.lit(""))
    query, intent, shown = given("retrieval_query"), given("user_intent"), given("presentation_intent")
    tokens = token_analysis(F.coalesce(query, question))
    single = (tokens["english_count"] == 1) & (tokens["chinese_count"] == 0)
    return F.struct(
        F.coalesce(query, question).alias("retrieval_query"),
        F.when(shown.isNull(), "获取信息").otherwise(F.coalesce(intent, F.lit("获取信息"))).alias("user_intent"),
        F.coalesce(shown, F.lit("intro")).alias("presentation_intent"),
        ((query.isNotNull() & intent.isNotNull()) | single).alias("need_cache"),
    )


def cache_query(retrieval_query: Column, presentation: Column, user: Column) -> Column:
    return strip(F.concat(F.lit("检索问题:\n"), retrieval_query, F.lit("\n\n用户意图:\n"), user, F.lit("\n\n输出要求:\n"), presentation))


def cache_key(query: Column) -> Column:
    return F.md5(query.cast("binary"))


def admissible(answer: Column) -> Column:
    a = strip(F.coalesce(answer, F.lit("")))
    return (F.length(a) >= 20) & ~is_refusal(a)


def shows_sources(references: Column, answer: Column) -> Column:
    return (F.coalesce(references, F.lit("")) != "") & (F.coalesce(strip(answer), F.lit("")) != "") & ~is_refusal(answer)


def usage(prompt: Column, completion: Column, reported_prompt: Column, reported_completion: Column, model: Column) -> Column:
    """Reported token counts, or estimates where any is missing."""
    known = reported_prompt.isNotNull() & reported_completion.isNotNull()
    return F.struct(
        F.when(known, reported_prompt).otherwise(rough_tokens(prompt)).cast("long").alias("prompt_tokens"),
        F.when(known, reported_completion).otherwise(rough_tokens(completion)).cast("long").alias("completion_tokens"),
        F.when(known, "reported").otherwise("estimate").alias("source"),
        model_name(model).alias("model"),
    )


def model_name(*candidates: Column) -> Column:
    return F.replace(F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.lit("unknown")), F.lit(".gguf"), F.lit(""))


def tokens_per_second(tokens: Column, seconds: Column) -> Column:
    return F.try_divide(tokens, seconds)
