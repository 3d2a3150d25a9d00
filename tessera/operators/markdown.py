"""Heading sections, typed blocks and chunks. Every step is a narrow map on documents: nothing is shuffled."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import structure as S
from ..functions.text import HEADING
from ..settings import Settings
from ..sources.io import CHUNK_SCHEMA


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def split_lines(text: Column) -> Column:
    """Lines as other tools count them: a line end at the very end opens no further line."""
    lines = F.split(text, r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85  ]", -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)


def section_array(lines: Column) -> Column:
    """array<struct<start, end, parts>> of the sections of a document's lines, blank ones too.

    A heading closes those of its level and below; its own line is in no section. Before the first heading there are no
    parts. The stack is a fold over the document's headings only, on the row itself; patterns see only lines that begin
    with #.
    """
    marked = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), x.alias("x"))), lambda h: h["x"].startswith("#"))
    heads = F.filter(F.transform(marked, lambda h: F.struct(h["at"].alias("at"), F.length(F.regexp_extract(h["x"], HEADING, 1)).alias("level"), F.regexp_replace(F.regexp_extract(h["x"], HEADING, 2), r"(?U)^\s+|\s+$", "").alias("title"))), lambda h: h["level"] > 0)
    none = F.expr("cast(array() as array<struct<level: int, title: string>>)")
    start = F.struct(none.alias("stack"), F.expr("array(named_struct('start', 0, 'parts', cast(array() as array<string>)))").alias("out"))

    def push(s: Column, h: Column) -> Column:
        stack = F.concat(F.filter(s["stack"], lambda x: x["level"] < h["level"]), F.array(F.struct(h["level"].alias("level"), h["title"].alias("title"))))
        return F.struct(stack.alias("stack"), F.concat(s["out"], F.array(F.struct((h["at"] + 1).alias("start"), F.transform(stack, lambda x: x["title"]).alias("parts")))).alias("out"))

    def ends(s: Column) -> Column:
        following = F.concat(F.transform(F.slice(s["out"], F.lit(2), F.size(s["out"])), lambda x: x["start"] - 1), F.array(F.size(lines)))
        return F.zip_with(s["out"], following, lambda x, e: F.struct(x["start"].alias("start"), e.alias("end"), x["parts"].alias("parts")))

    return F.aggregate(heads, start, push, ends)


def header_path(parts: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(parts, "/"), F.when(F.size(parts) > 0, "/").otherwise(""))


def sections(docs: DataFrame) -> DataFrame:
    """All columns but text, and header_path, header_parts, line_start, line_end, text of each section that isn't blank.
    A document's lines are made once."""
    others = [c for c in docs.columns if c != "text"]
    d = docs.select(*others, split_lines(F.col("text")).alias("_lines"))
    body = lambda s: F.array_join(F.slice("_lines", s["start"] + 1, s["end"] - s["start"]), "\n")
    d = d.select(*others, "_lines", section_array(F.col("_lines")).alias("_s"))
    d = d.select(*others, F.explode(F.transform(F.filter("_s", lambda s: s["end"] > s["start"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["parts"].alias("parts"), body(s).alias("body")))).alias("_s"))
    d = d.select(*others, header_path(F.col("_s.parts")).alias("header_path"), F.col("_s.parts").alias("header_parts"), F.col("_s.start").alias("line_start"), F.col("_s.end").alias("line_end"), F.col("_s.body").alias("text"))
    return d.where(F.col("text").rlike(r"(?U)\S"))


#: Rows that a map works on at once, so that Python holds the objects of few rows whatever the size of Spark's batches.
_ROWS = 256


def _table(rows: list[dict], schema: str) -> pa.RecordBatch:
    fields = [c.split(" ", 1) for c in schema.split(", ")]
    return pa.record_batch([pa.array([r.get(n) for r in rows], _ARROW[t]) for n, t in fields], [n for n, _ in fields])


def _per_row(df: DataFrame, keep: list[str], schema: str, work) -> DataFrame:
    """A narrow Arrow map: work(row as dict) gives dicts; `keep` columns are repeated. Batches go in slices."""
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, _ROWS):
                yield _table([{**{k: r[k] for k in keep}, **x} for r in b.slice(i, _ROWS).to_pylist() for x in work(r)], schema)

    return df.mapInArrow(run, schema)


def blocks(sections: DataFrame) -> DataFrame:
    """file_path, header_path, type, text, line_start, line_end, code_language of the blocks of sections (P3)."""
    def work(r):
        for b in S.blocks(r["text"].split("\n")):
            yield {"type": b["type"], "text": b["text"], "line_start": r["line_start"] + b["start"], "line_end": r["line_start"] + b["end"], "code_language": b.get("code_language")}

    return _per_row(sections.select("file_path", "header_path", "line_start", "text"), ["file_path", "header_path"], "file_path string, header_path string, type string, text string, line_start int, line_end int, code_language string", work)


def text_nodes(sections: DataFrame, size: int = Settings.chunk_size) -> DataFrame:
    """Blocks with text packed to at most `size` characters of whole lines (P4)."""
    def work(r):
        for b in S.blocks(r["text"].split("\n")):
            for n in S.text_nodes(b, r["line_start"], size):
                yield {k: n.get(k) for k in ("type", "text", "line_start", "line_end", "code_language", "fence_char", "fence_len")}

    return _per_row(sections.select("file_path", "header_path", "line_start", "text"), ["file_path", "header_path"], "file_path string, header_path string, type string, text string, line_start int, line_end int, code_language string, fence_char string, fence_len int", work)


def split_nodes(nodes: DataFrame, settings: Settings = Settings(), handlers: dict | None = None) -> DataFrame:
    """Nodes split by the handler of their type (K1-K5); a type without one passes."""
    handlers = {**S.HANDLERS, **(handlers or {})}

    def work(r):
        return handlers.get(r["type"], lambda n, _: [n])(r, settings.chunk_size)

    return _per_row(nodes, ["file_path", "header_path", "type"], "file_path string, header_path string, type string, text string, line_start int, line_end int, table_row_start int, table_row_end int, code_chunk_index int, code_total_chunks int, is_code_split boolean", work)


def merge_nodes(nodes: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Nodes of a file in the order of their lines, small neighbours joined (K7). Nodes are dealt by file and sorted, and a
    map goes along the files, one at a time; chunks() does the same without moving anything."""
    schema = "file_path string, header_path string, line_start int, line_end int, merged_chunks int, block_types array<string>, text string"

    def run(batches):
        file, own, out = None, [], []
        for b in batches:
            for i in range(0, b.num_rows, _ROWS):
                for r in b.slice(i, _ROWS).to_pylist():
                    if own and r["file_path"] != file:
                        out += S.merge(own, settings.chunk_size)
                        own = []
                    file = r["file_path"]
                    own.append({**r, "block_types": [r["type"]]})
                if out:
                    yield _table(out, schema)
                    out = []
        if own:
            yield _table(S.merge(own, settings.chunk_size), schema)

    n = nodes.select("file_path", "header_path", "type", "text", "line_start", "line_end").repartition("file_path")
    return n.sortWithinPartitions("file_path", F.asc_nulls_last("line_start"), F.asc_nulls_last("line_end")).mapInArrow(run, schema)


def chunk_rows(sections: list[dict], settings: Settings, handlers: dict) -> list[dict]:
    """Chunks of one document from its sections, in order."""
    size, out = settings.chunk_size, []
    for s in sections:
        for b in S.blocks(s["text"].split("\n")):
            for n in S.text_nodes(b, s["line_start"], size):
                if not S.is_title_only(n["text"]):
                    pieces = handlers.get(n["type"], lambda x, _: [x])(n, size)
                    out += [S.candidate({**p, "header_path": s["header_path"], "block_types": [n["type"]]}) for p in pieces]
    return S.merge(out, size)


def chunks(docs: DataFrame, settings: Settings = Settings(), handlers: dict | None = None, before=None) -> DataFrame:
    """docs(file_path, file_name, file_size, text) to chunks: sections, blocks, splits and merges of a document in one
    narrow Arrow map, since none of them looks beyond the document. chunk_id: file_path#number. handlers: splitters by
    type; before: a function of (text, file_name) that is applied first, cleaning for example."""
    handlers = {**S.HANDLERS, **(handlers or {})}
    schema = pa.schema([(n, _ARROW[t]) for n, t in (c.split(" ", 1) for c in CHUNK_SCHEMA.split(", "))])

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                own, rows = b.slice(i, 256), []
                for path, name, size, text in zip(*(own.column(c).to_pylist() for c in ("file_path", "file_name", "file_size", "text"))):
                    text = before(text, name) if before and text is not None else text
                    for k, c in enumerate(chunk_rows(S.sections(text or ""), settings, handlers)):
                        rows.append({**c, "text": c["text"].strip(), "chunk_id": f"{path}#{k}", "file_path": path, "file_name": name, "file_size": size})
                yield pa.record_batch([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)

    return docs.select("file_path", "file_name", "file_size", "text").mapInArrow(run, CHUNK_SCHEMA)


def with_links(nodes: DataFrame) -> DataFrame:
    """Optional view: prev_id and next_id of chunks in the order of their file and place."""
    w = Window.partitionBy("file_path").orderBy("line_start", "line_end", "chunk_id")
    return nodes.withColumn("prev_id", F.lag("chunk_id").over(w)).withColumn("next_id", F.lead("chunk_id").over(w))
