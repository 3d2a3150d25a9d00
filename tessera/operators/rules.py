"""Rule-driven metadata of chunks as columns."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of

#: The built-in rules (fixed values). A later rule that matches overwrites an earlier one's value.
RULES = {
    "header_rules": [
        {"name": "topic", "match": ["错误", "失败", "异常"], "value": "error"},
        {"name": "topic", "match": ["配置", "参数"], "value": "config"},
        {"name": "topic", "match": ["流程", "步骤"], "value": "procedure"},
    ],
    "text_rules": [
        {"name": "has_error_code", "type": "contains_any", "patterns": ["错误码", "error code"], "value": True},
        {"name": "has_sql", "type": "regex", "patterns": [r"(?i)select\s+", r"(?i)update\s+", r"(?i)delete\s+", r"(?i)insert\s+"], "value": True},
        {"name": "has_api", "type": "contains_any", "patterns": ["/api/", "http", "接口"], "value": True},
    ],
}
PREFERRED = ("chunk_id", "file_path", "file_name", "header_path", "line_start", "line_end", "block_types", "text_length")
INTERNAL = ("node_id", "hit_sources", "prev_id", "next_id")


def load(path: str) -> dict:
    """Rules of a YAML file, if a YAML library is there."""
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def contains_any(text: Column, patterns: list[str]) -> Column:
    return any_of(F.contains(F.lower(text), F.lit(p.lower())) for p in patterns)


def _values(rules: list[dict], test) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for name in dict.fromkeys(r["name"] for r in rules):
        own = [r for r in rules if r["name"] == name]
        out[name] = F.coalesce(*[F.when(test(r), F.lit(r["value"])) for r in reversed(own)])
    return out


def header_columns(header: Column, rules: list[dict] = RULES["header_rules"]) -> dict[str, Column]:
    return _values(rules, lambda r: contains_any(header, r["match"]))


def text_columns(text: Column, rules: list[dict] = RULES["text_rules"]) -> dict[str, Column]:
    """Flags; False where no pattern is found. Patterns see lower-cased text."""
    test = lambda r: any_of(F.lower(text).rlike(p) for p in r["patterns"]) if r["type"] == "regex" else contains_any(text, r["patterns"])
    return {k: F.coalesce(v, F.lit(False)) for k, v in _values(rules, test).items()}


def derived(text: Column) -> dict[str, Column]:
    n = F.length(text)
    return {"text_length": n, "is_too_short": n < 100, "is_large_table": F.regexp_count(text, F.lit(r"\|")) > 20, "has_number": text.rlike(r"(?U)[\d²³¹]")}


def enrich(chunks: DataFrame, rules: dict = RULES) -> DataFrame:
    """chunks(text, header_path, ...) with derived values, topic (null without a match) and flags."""
    return chunks.withColumns(derived(F.col("text")) | header_columns(F.col("header_path"), rules["header_rules"]) | text_columns(F.col("text"), rules["text_rules"]))


def flatten(chunks: DataFrame) -> DataFrame:
    """Lists as stored: headers by " + ", block types by |."""
    return chunks.withColumns({c: F.array_join(c, sep) for c, sep in (("merged_headers", " + "), ("block_types", "|")) if c in chunks.columns})


def without_internal(chunks: DataFrame) -> DataFrame:
    return chunks.drop(*INTERNAL)


def ordered(chunks: DataFrame) -> DataFrame:
    first = [c for c in PREFERRED if c in chunks.columns]
    return chunks.select(*first, *sorted(set(chunks.columns) - set(first)))


def title_filter(chunks: DataFrame) -> DataFrame:
    from ..functions.text import is_title_only

    return chunks.where(~is_title_only(F.col("text")))


