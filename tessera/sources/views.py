"""Views over the driver tables that structural operators run on, in Spark and as SQL of the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A Markdown text for every document: two headings, the text, a table and a fenced block.
_KB = r"""concat('# ', source, '\n\n## Doc ', cast(doc_id as {string}), '\n\n', text, '\n\n### Facts\n\n| key | value |\n|--|--|\n| lang | ', lang, ' |\n| chars | ', cast(n_chars as {string}), ' |\n\n### Code\n\n```json\n{{"doc": ', cast(doc_id as {string}), '}}\n```')"""


def kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_path, file_name, file_size (characters), text."""
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".md"))
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("kb/"), name).alias("file_path"), name.alias("file_name"), F.expr(_KB.format(string="string")).alias("text"))
    return d.select("file_path", "file_name", F.length("text").cast("long").alias("file_size"), "text")


def _escaped(expression: str) -> str:
    """The expression with its string literals as E'' where they hold \\n, which DuckDB reads only there."""
    return re.sub(r"'[^']*\\n[^']*'", lambda m: "E" + m[0], expression)


KB = "kb AS (SELECT 'kb/' || doc_id || '.md' AS file_path, doc_id || '.md' AS file_name, length(text) AS file_size, text FROM (SELECT doc_id, " + _escaped(_KB.format(string="varchar")) + " AS text FROM documents))"

LINES = "l AS (SELECT file_path, unnest(range(len(a)::BIGINT)) AS n, unnest(a) AS line FROM (SELECT file_path, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM (SELECT file_path, string_split(text, chr(10)) AS a FROM kb)))"

_W = "OVER (PARTITION BY file_path ORDER BY n ROWS UNBOUNDED PRECEDING)"
#: Heading sections by windows: a level's title stands if it came after all titles of levels above.
SECTIONS = (
    "h AS (SELECT *, length(regexp_extract(line, '^(#{1,6})\\s+(.*)$', 1)) AS lvl, trim(regexp_extract(line, '^(#{1,6})\\s+(.*)$', 2)) AS title FROM l), "
    f"w AS (SELECT *, sum(CASE WHEN lvl > 0 THEN 1 ELSE 0 END) {_W} AS sec, "
    + ", ".join(f"coalesce(max(CASE WHEN lvl = {k} THEN n END) {_W}, -1) AS p{k}, max(CASE WHEN lvl = {k} THEN lpad(n::varchar, 9, '0') || title END) {_W} AS t{k}" for k in range(1, 7))
    + " FROM h), p AS (SELECT *, '/' || "
    + " || ".join(f"CASE WHEN p{k} > {'greatest(' + ', '.join(f'p{j}' for j in range(1, k)) + ')' if k > 1 else '-1'} THEN substr(t{k}, 10) || '/' ELSE '' END" for k in range(1, 7))
    + " AS header_path FROM w), s AS (SELECT file_path, sec, min(header_path) AS header_path, min(n) AS line_start, max(n) + 1 AS line_end, string_agg(line, chr(10) ORDER BY n) AS text FROM p WHERE lvl = 0 GROUP BY file_path, sec HAVING string_agg(line, '') ~ '\\S')"
)
SECTIONS = SECTIONS.replace("HAVING string_agg(line, '') ~ '\\S'", "HAVING regexp_matches(string_agg(line, ''), '\\S')")


def sections_sql(rest: str) -> str:
    return f"WITH {KB}, {LINES}, {SECTIONS} {rest}"


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer cache: assistant turns as answers, the user turn before as question, vec_id = conv_id as its vector."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("conv_id"), "embedding")
    return c.join(e, "conv_id").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.substring("text", 1, 40).alias("retrieval_query"), F.when(F.col("conv_id") % 2 == 0, "intro").otherwise("steps").alias("presentation_intent"), F.lit("获取信息").alias("user_intent"), F.col("text").alias("answer"), "embedding", F.concat(F.lit("h"), (F.col("conv_id") % 3).cast("string")).alias("knowledge_hash"))


CACHE = "cache AS (SELECT c.conv_id * 100 + c.turn AS id, substr(c.text, 1, 40) AS retrieval_query, CASE WHEN c.conv_id % 2 = 0 THEN 'intro' ELSE 'steps' END AS presentation_intent, '获取信息' AS user_intent, c.text AS answer, e.embedding, 'h' || (c.conv_id % 3) AS knowledge_hash FROM conversations c JOIN embeddings e ON e.vec_id = c.conv_id WHERE c.role = 'assistant')"
