"""Markdown repair as a narrow map, and the line flags it uses as columns."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import structure as S
from ..functions.text import FENCE, LIST_ITEM


@F.pandas_udf(T.StringType())
def clean_text(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else S.clean(t))


@F.pandas_udf(T.BooleanType())
def code_like(line: pd.Series) -> pd.Series:
    return line.map(lambda x: None if x is None else S.code_like(x))


@F.pandas_udf(T.BooleanType())
def bare_cjk(line: pd.Series) -> pd.Series:
    return line.map(lambda x: None if x is None else S.bare_cjk(x))


@F.pandas_udf(T.StringType())
def wrap_code(text: pd.Series) -> pd.Series:
    def one(t):
        lines = t.split("\n")
        return "\n".join(S.wrap_code(lines, S.fence_flags(lines))[0])

    return text.map(lambda t: None if t is None else one(t))


def clean_file(text: str, name: str | None) -> str:
    """A file's text repaired, with the stem of its name as title where it has none."""
    return S.clean(text, None if name is None else name.rsplit(".", 1)[0])


def clean(docs: DataFrame, stem: str | None = "file_name") -> DataFrame:
    """docs with cleaned: the repaired text, with the file's stem as title where it has none."""
    def run(batches):
        for b in batches:
            names = b.column(stem).to_pylist() if stem else [None] * b.num_rows
            yield b.append_column("cleaned", pa.array([None if t is None else clean_file(t, n) for t, n in zip(b.column("text").to_pylist(), names)], pa.string()))

    return docs.mapInArrow(run, _with(docs, "cleaned string"))


def _with(df: DataFrame, column: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), column])


def fence_flags(lines: Column) -> Column:
    """array<boolean>: is each line inside a fenced block (the opening line isn't, the closing line is)? A fold on the row."""
    zero = F.struct(F.lit("").alias("fence"), F.expr("cast(array() as array<boolean>)").alias("out"))

    def step(s: Column, line: Column) -> Column:
        mark = F.regexp_extract(line, FENCE, 1)
        ends = (s["fence"] != "") & (mark != "") & (F.substring(mark, 1, 1) == F.substring(s["fence"], 1, 1)) & (F.length(mark) >= F.length(s["fence"]))
        fence = F.when(s["fence"] == "", mark).when(ends, "").otherwise(s["fence"])
        return F.struct(fence.alias("fence"), F.concat(s["out"], F.array(s["fence"] != "")).alias("out"))

    return F.aggregate(lines, zero, step, lambda s: s["out"])


def list_spacing(lines: Column) -> Column:
    """Lines of a text without code, with a blank one before the first item of each list."""
    before = F.concat(F.array(F.lit("")), lines)
    gap = lambda x, p: x.rlike(LIST_ITEM) & p.rlike(r"(?U)\S") & ~p.rlike(LIST_ITEM)
    return F.flatten(F.zip_with(lines, F.slice(before, F.lit(1), F.size(lines)), lambda x, p: F.when(gap(x, p), F.array(F.lit(""), x)).otherwise(F.array(x))))
