"""Web pages to Markdown, and Markdown texts to files."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACES = re.compile(r"\s+")
_SKIP = {"script", "style", "head", "template", "noscript"}
_BLOCKS = {"p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "body", "html", "ul", "ol", "blockquote", "form", "figure", "table", "tr", "dl", "dt", "dd"}
_MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}


class _Writer(HTMLParser):
    """Builds Markdown blocks while a page is read; open marks of a block are closed where it ends."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.line: list[str] = []
        self.lead, self.skip, self.pre, self.depth = "", 0, False, 0
        self.lists: list[int | None] = []
        self.links: list[str] = []
        self.open: list[str] = []
        self.row: list[str] | None = None
        self.rows: list[list[str]] = []

    def end_block(self) -> None:
        text = "".join([*self.line, *reversed(self.open)])
        self.open = []
        text = text.strip("\n") if self.pre else "\n".join(_SPACES.sub(" ", x).strip() for x in text.split("\n")).strip("\n")
        if text.strip():
            self.out.append(self.lead + text)
        self.line, self.lead = [], ""

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += 1
        if self.skip:
            return
        if tag == "br":
            self.line.append("\n")
        elif tag == "img":
            a = dict(attrs)
            self.line.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.line.append("[")
        elif tag in _MARKS and not self.pre:
            self.line.append(_MARKS[tag])
            self.open.append(_MARKS[tag])
        elif re.fullmatch("h[1-6]", tag):
            self.end_block()
            self.lead = "#" * int(tag[1]) + " "
        elif tag == "pre":
            self.end_block()
            self.pre = True
        elif tag in ("ul", "ol"):
            self.end_block()
            self.lists.append(0 if tag == "ol" else None)
        elif tag == "li":
            self.end_block()
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1
            mark = "- " if not self.lists or self.lists[-1] is None else f"{self.lists[-1]}. "
            self.lead = "  " * (len(self.lists) - 1) + mark
        elif tag == "table":
            self.end_block()
            self.rows = []
        elif tag == "tr":
            self.row = []
        elif tag in ("td", "th"):
            self.line = []
        elif tag == "hr":
            self.end_block()
            self.out.append("---")
        elif tag in _BLOCKS:
            self.end_block()

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if tag == "a":
            self.line.append(f"]({self.links.pop() if self.links else ''})")
        elif tag in _MARKS:
            if self.open and self.open[-1] == _MARKS[tag]:
                self.line.append(self.open.pop())
        elif tag == "pre":
            text = "".join(self.line).strip("\n")
            self.line, self.pre = [], False
            self.out.append(f"```\n{text}\n```")
        elif tag in ("td", "th"):
            if self.row is not None:
                self.row.append(_SPACES.sub(" ", "".join([*self.line, *reversed(self.open)])).strip().replace("|", "\\|"))
            self.line, self.open = [], []
        elif tag == "tr":
            if self.row:
                self.rows.append(self.row)
            self.row = None
        elif tag == "table":
            if self.rows:
                width = max(map(len, self.rows))
                rows = [f"| {' | '.join(r + [''] * (width - len(r)))} |" for r in self.rows]
                self.out.append("\n".join([rows[0], "|" + "--|" * width, *rows[1:]]))
            self.rows = []
        elif tag in ("ul", "ol"):
            self.end_block()
            if self.lists:
                self.lists.pop()
        elif re.fullmatch("h[1-6]", tag) or tag == "li" or tag in _BLOCKS:
            self.end_block()

    def handle_data(self, data):
        if not self.skip:
            self.line.append(data if self.pre else _SPACES.sub(" ", data))


def to_markdown(html: str | None) -> str:
    """The page as Markdown: headings, paragraphs, lists, links, emphasis, code, tables and images, blocks apart by a blank
    line (items of a list by none). Null or empty: ""."""
    w = _Writer()
    w.feed(html or "")
    w.close()
    w.end_block()
    item = re.compile(r"\s*(?:-|\d+\.) ")
    text = ""
    for i, b in enumerate(w.out):
        text += ("" if not i else "\n" if item.match(b) and item.match(w.out[i - 1]) else "\n\n") + b
    return text + "\n" if text else ""


def markdown(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with markdown: a narrow Arrow map over whole pages."""
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):  # Python holds the texts of few pages
                own = b.slice(i, 256)
                yield own.append_column("markdown", pa.array([to_markdown(h) for h in own.column(html).to_pylist()], pa.string()))

    return pages.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields), "markdown string"]))


def write_files(texts: DataFrame, folder: str, name: str = "name", text: str = "text") -> None:
    """A file folder/<name> for each row, written by the executors; folder: a path or URI that all of them share. A file
    is written whole or replaced, so a task that runs again leaves the same files. Names may not leave the folder."""
    def write(rows):
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for r in rows:
            parts = [p for p in r[0].split("/") if p not in ("", ".")]
            if not parts or ".." in parts:
                raise ValueError(f"not a file name: {r[0]}")
            path = "/".join([root.rstrip("/"), *parts])
            where.create_dir(path.rpartition("/")[0], recursive=True)
            with where.open_output_stream(path) as out:
                out.write((r[1] or "").encode("utf-8", "replace"))

    texts.select(name, F.col(text)).foreachPartition(write)
