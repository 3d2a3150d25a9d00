"""Golden cases of document structure and cleaning."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import structure as S
from tessera.operators import cleaner, markdown


def secs(spark, text):
    d = spark.createDataFrame([("f", text)], "file_path string, text string")
    return [(r.header_path, r.text, r.line_start, r.line_end) for r in markdown.sections(d).collect()]


def test_sections(spark):
    assert secs(spark, "# A\n\naaa\n\n## B\n\nbbb") == [("/A/", "\naaa\n", 1, 4), ("/A/B/", "\nbbb", 5, 7)]
    text = "intro\n# A\na\n## B\nb\n#### D\nd\n### C\nc\n# E\ne\n"
    assert [s[0] for s in secs(spark, text)] == ["/", "/A/", "/A/B/", "/A/B/D/", "/A/B/C/", "/E/"]
    assert secs(spark, "") == [] and secs(spark, "# only\n\n") == []


def test_blocks():
    text = "a\n\nb\n\n```py\nx\n```\n| h |\n|--|\n| 1 |\n$$\ny\n$$\n*[Image OCR]*\nid: 1\n*[End OCR]*\n~~~\nopen"
    got = S.blocks(text.split("\n"))
    assert [(b["type"], b["start"], b["end"]) for b in got] == [("text", 0, 4), ("code", 4, 7), ("table", 7, 10), ("math", 10, 13), ("ocr", 13, 16), ("code", 16, 18)]
    assert got[1]["text"] == "x" and got[1]["code_language"] == "py" and got[5]["text"] == "open" and got[5]["fence_char"] == "~"


def test_text_node_lines():
    b = S.blocks(["", "aaa", ""])[0]
    assert [(n["text"], n["line_start"]) for n in S.text_nodes(b, 1, 1000)] == [("aaa\n", 2)] or S.text_nodes(b, 1, 1000)[0]["line_start"] == 2


def test_packing():
    lines = ["aaaa", "bb", "cccccc", "d"]
    assert ["\n".join(lines[a:b]) for a, b in S.pack(lines, 7)] == ["aaaa\nbb", "cccccc", "d"]
    assert S.pack([], 5) == [] and S.pack(["x" * 50], 5) == [(0, 1)]


def test_tables():
    node = {"text": "| a | b |\n|--|--|\n| 1 | 2 |\n| 3 | 4 |", "line_start": 10, "line_end": 14}
    (p,) = S.split_table(node, 1000)
    assert p["text"].startswith("【表格 第 1-2 行，共 2 行】\n\n| a | b |") and (p["line_start"], p["line_end"], p["table_row_start"], p["table_row_end"], p["relative_row_start"], p["relative_row_end"]) == (12, 14, 0, 1, 1, 2)
    odd = {"text": "| a-b |\n| 1 |\n| 2 |", "line_start": 0, "line_end": 3}
    assert S.split_table(odd, 1000) == [odd]
    many = {"text": "| a |\n|--|\n" + "\n".join(f"| {i} |" for i in range(400)), "line_start": 0, "line_end": 402}
    parts = S.split_table(many, 500)
    assert len(parts) > 1 and parts[0]["table_row_end"] + 1 == parts[1]["table_row_start"] and parts[-1]["relative_row_end"] == 400


def test_code():
    n = {"text": "x = 1", "line_start": 3, "line_end": 6, "code_language": "py", "fence_char": "~", "fence_len": 4}
    (p,) = S.split_code(n, 1000)
    assert p["text"] == "~~~~py\nx = 1\n~~~~" and not p["is_code_split"]
    long = {**n, "text": "\n".join(f"line {i}" for i in range(300))}
    parts = S.split_code(long, 500)
    assert len(parts) > 2 and parts[1]["text"].startswith("【代码块 第 ") and all(p["code_total_chunks"] == len(parts) for p in parts)
    assert parts[0]["line_start"] == 4


def test_headers_and_merge():
    assert S.candidate({"header_path": "/A/B/", "text": "t"})["text"] == "[SECTION]\nA > B\n\n[CONTENT]\nt"
    assert [S.parent(p) for p in ("/A/B/C/", "/A/B/", "/A/")] == ["/A/B/", "/A/", "/"]
    c = lambda path, n, kind, at: {"text": "x" * n, "header_path": path, "block_types": [kind], "line_start": at, "line_end": at + 1}
    got = S.merge([c("/A/", 900, "code", 0), c("/A/B/", 100, "text", 1), c("/A/C/", 100, "table", 2), c("/A/C/", 1480, "math", 3)], 1000)
    assert [(m["block_types"], m.get("merged_chunks")) for m in got] == [(["code"], None), (["table", "text"], 2), (["math"], None)]
    assert got[1]["merged_headers"] == ["/B/", "/C/"] and got[1]["line_end"] == 3


def test_chunks(spark):
    text = "# A\n\npara\n\n## B\n\n| a | b |\n|--|--|\n| 1 | 2 |\n\n```sh\nls\n```\n"
    d = spark.createDataFrame([("f.md", "f.md", 9, text), ("e.md", "e.md", 0, None)], "file_path string, file_name string, file_size long, text string")
    got = markdown.chunks(d).collect()
    assert [r.chunk_id for r in got] == ["f.md#0"] and got[0].block_types == ["code", "table", "text"] and "```sh\nls\n```" in got[0].text
    assert markdown.with_links(markdown.chunks(d)).where("prev_id is not null").count() == 0


@pytest.mark.parametrize("line,code", [("def f(x):", True), ("select a from b", True), ("SELECT * FROM t", True), ("# title", False), ("- item", False), ("| a | b |", False), ("plain words here", False), ("host: example", True), ("这是说明 x=1", False), ("x = 1  # 注释", False), ("**bold** text;", False), ("10.0.0.1", True), ("[root@h ~]# ls", True), ("a@b.c", True), ("if (x) { y(); }", True)])
def test_code_like(line, code):
    assert S.code_like(line) is code


def test_cleaning(spark):
    assert S.clean("a\\_b     c ----\r\n\r\n\r\n\r\nd  ") == "a_b  c --\n\nd\n"
    assert S.clean("text\n- one\n- two", "name") == "# name\n\ntext\n\n- one\n- two\n"
    assert S.clean("words\nx = 1\ny = &lt;2&gt;\n\nmore words") == "words\n```\nx = 1\ny = <2>\n\n```\nmore words\n"
    assert S.unescape("&amp;lt;") == "&lt;" and S.unescape("&amp;quot;") == '"'
    assert S.fence_flags(["a", "```", "x", "```", "b"]) == [False, False, True, True, False]
    d = spark.createDataFrame([("t.md", "- a"), ("n.md", None)], "file_name string, text string")
    assert {r.file_name: r.cleaned for r in cleaner.clean(d).collect()} == {"t.md": "# t\n\n- a\n", "n.md": None}
    flags = spark.range(1).select(cleaner.fence_flags(F.array(*map(F.lit, ["a", "~~~~", "```", "~~~~", "b"]))).alias("f")).first().f
    assert flags == S.fence_flags(["a", "~~~~", "```", "~~~~", "b"])


def test_bare_cjk_and_markers():
    assert [S.bare_cjk(x) for x in ("说", '"说"', "# 说", "/* 说 */ x", "a 说", "'it\\'s 说'")] == [True, False, False, False, True, False]
    assert [S.paired_marker(x) for x in ("**a**", "** a**", "**a **", "==x==", "a ** b")] == [True, False, False, True, False]


def test_highlight():
    text = "# h\nline\n- item\n```\ncode\n```\n| a |  |\n|--|--|"
    assert S.highlight(text, [(0, 8)]) == '# h\n==line== <mark id="first-hit"/>\n\n- ==item==\n```\ncode\n```\n| <mark>a</mark> | |\n|--|--|'


def test_caption_blocks():
    b = S.caption_block("id1", "m", " words ")
    assert b[3] == "status: ok" and S.caption_block("i", "m", S.PLACEHOLDER)[3] == "status: failed"
    assert S.read_caption_block(["", *b], 0) == (1, 9, {"id": "id1", "model": "m", "status": "ok"}, ["", "words", ""])
    assert S.read_caption_block(["text"], 0) is None and S.read_caption_block(["*[Image OCR]*", "id: 1"], 0) is None
