"""Chunks against the plain version; files in and out."""

import os
import random
import struct
import zipfile
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import prompts, structure as S
from tessera.operators import answer_cache, assets, convert, markdown, rules, stats
from tessera.plans import build
from tessera.settings import Settings
from tessera.sources import io
from tessera.sources.views import kb

from . import plain

FOLDER = "/root/testdata/sf0.001"


def random_text(r):
    words = lambda n: " ".join("x" * r.randrange(1, 9) for _ in range(n))
    out = []
    for _ in range(r.randrange(1, 12)):
        out += r.choice([
            lambda: ["#" * r.randrange(1, 8) + " " + words(2)], lambda: [words(r.randrange(1, 60)) for _ in range(r.randrange(1, 6))], lambda: [""] * r.randrange(1, 3),
            lambda: ["| a | b |", "|--|--|", *(f"| {words(3)} | {i} |" for i in range(r.randrange(0, 90)))], lambda: ["~~~~" + r.choice(["", "py"]), *(words(4) for _ in range(r.randrange(0, 90))), r.choice(["~~~~", "~~~~~", "text"])],
            lambda: ["```sh", words(3), "# note", "```"], lambda: ["$$", "x", "$$"], lambda: ["*[Image OCR]*", "id: 1", "*[End OCR]*"], lambda: ["| a-b |", "| 1 |"], lambda: ["# only"],
        ])()
    return "\n".join(out)


@pytest.mark.parametrize("size", [1000, 200])
def test_chunks_are_those_of_the_plain_version(spark, size):
    r = random.Random(size)
    texts = {f"f{i}.md": random_text(r) for i in range(300)}
    d = spark.createDataFrame([(n, n, len(t), t) for n, t in texts.items()], "file_path string, file_name string, file_size long, text string")
    got: dict = {n: [] for n in texts}
    for c in sorted(markdown.chunks(d, Settings(chunk_size=size)).collect(), key=lambda c: int(c.chunk_id.partition("#")[2])):
        got[c.file_path].append((c.header_path, c.line_start, c.line_end, "|".join(c.block_types), c.merged_chunks, c.text))
    for n, t in texts.items():
        assert got[n] == plain.chunks(t, size), t
    for n, t in texts.items():
        assert [(s["header_path"], s["line_start"], s["text"]) for s in S.sections(t)] == plain.sections(t)
    native = {(r.file_path, r.header_path, r.line_start, r.text) for r in markdown.sections(d).collect()}
    assert native == {(n, p, a, b) for n, t in texts.items() for p, a, b in plain.sections(t)}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")
def test_queries_of_chunks_and_merges(spark):
    from tessera import catalog

    docs = {r.file_path: r for r in kb(spark, FOLDER).collect()}
    want = sorted((p, i, *c[:4], c[4] or 1, c[5]) for p, d in docs.items() for i, c in enumerate(plain.chunks(d.text, 1000)))
    rows = lambda name: catalog.queries()[name](spark, FOLDER).collect()
    got = sorted((r.file_path, int(r.chunk_id.partition("#")[2]), r.header_path, r.line_start, r.line_end, r.block_types, r.merged_chunks, r.text) for r in rows("k10_chunks"))
    assert got == want
    nodes = {p: [(h, a, b, k, t) for h, first, body in plain.sections(d.text) for block in plain.blocks(body, first) for k, t, a, b in ([(block[0], *x) for x in plain.pieces(block, 1000)] if block[0] == "text" else [block[:4]])] for p, d in docs.items()}
    want = sorted((p, h, a, b, m or 1, k, t) for p, n in nodes.items() for h, a, b, k, m, t in plain.merge(list(n), 1000))
    assert sorted((r.file_path, r.header_path, r.line_start, r.line_end, r.merged_chunks, r.block_types, r.text.strip()) for r in rows("k7_merge")) == want
    built = rows("k10_build")
    clean = {p: S.clean(d.text, d.file_name.rsplit(".", 1)[0]) for p, d in docs.items()}
    want = sorted((p, i, c[0], c[5]) for p, t in clean.items() for i, c in enumerate(plain.chunks(t, 1000)))
    assert sorted((r.file_path, int(r.chunk_id.partition("#")[2]), r.header_path, r.text) for r in built) == want
    assert all(r.text_length >= len(r.text) and r.is_too_short == (r.text_length < 100) for r in built)


class Handed:
    """Stands in for a DataFrame: runs the map that it is given over one batch, up to its first rows."""

    schema = type("Schema", (), {"fields": []})()

    def __init__(self, batch):
        self.batch = batch

    def mapInArrow(self, run, schema):
        return next(iter(run(iter([self.batch]))))

    def select(self, *columns):
        return self


def test_maps_of_nodes_work_on_few_rows_at_once():
    seen = []

    def work(r):
        seen.append(r["n"])
        yield {"text": "x"}

    first = markdown._per_row(Handed(pa.record_batch({"n": list(range(10_000)), "file_path": ["p"] * 10_000})), ["file_path"], "file_path string, text string", work)
    assert len(seen) == first.num_rows <= 1000


def test_merges_take_a_map_and_no_group_a_file(spark):
    """Files in one partition and across batches, one without a path; a group a file costs milliseconds each."""
    r, rows = random.Random(8), []
    for f in [None, *(f"f{i}" for i in range(120))]:
        for i in range(r.randrange(1, 9)):
            rows.append((f, r.choice(["/a/", "/a/b/", "/c/"]), r.choice(["text", "code"]), "x" * r.randrange(1, 400), 10 * i, 10 * i + 5))
    shuffled = r.sample(rows, len(rows))
    d = spark.createDataFrame(shuffled, "file_path string, header_path string, type string, text string, line_start int, line_end int")
    m = markdown.merge_nodes(d)
    assert "FlatMapGroups" not in m._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted((str(x.file_path), x.line_start, x.line_end, x.header_path, x.merged_chunks, x.block_types, x.text) for x in m.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for f in {x[0] for x in rows}:
        own = [dict(zip(["header_path", "type", "text", "line_start", "line_end"], x[1:])) for x in rows if x[0] == f]
        want += [(str(f), x["line_start"], x["line_end"], x["header_path"], x.get("merged_chunks"), x["block_types"], x["text"]) for x in S.merge([{**x, "block_types": [x["type"]]} for x in own], 1000)]
    assert got == sorted(want)


def test_captions_go_in_slices(monkeypatch):
    from tessera.operators import assets as A

    docs = Handed(pa.record_batch({"file_path": ["p"] * 5000, "text": ["![a](i.png)"] * 5000, "images": [None] * 5000}))
    docs.join = lambda *a: docs
    images = type("Images", (), {"groupBy": lambda s, *a: s, "agg": lambda s, *a: s})()
    monkeypatch.setattr(A, "F", type("F", (), {"__getattr__": lambda s, n: lambda *a: s, "alias": lambda s, n: s})())
    first = A.apply_captions(docs, images)
    assert first.num_rows <= 1000 and set(first["missing"].to_pylist()) == {1}


def test_pages_go_in_slices():
    first = convert.markdown(Handed(pa.record_batch({"page_id": list(range(5000)), "html": ["<p>a"] * 5000})))
    assert first.num_rows <= 1000 and set(first["markdown"].to_pylist()) == {"a\n"}


def test_embeddings_go_in_slices():
    from tessera.operators import retrieval

    first = retrieval.embed(Handed(pa.record_batch({"n": list(range(5000)), "text": ["a b", None] * 2500})), dim=8)
    got = first["embedding"].to_pylist()
    assert first.num_rows <= 1000 and abs(sum(x * x for x in got[0]) - 1) < 1e-6 and got[1] == [0.0] * 8


def test_a_folder_becomes_tables(spark, tmp_path):
    """S1, S2, W2: files in, chunk, posting and vector tables out; a second build replaces them."""
    src, out = tmp_path / "docs" / "sub", str(tmp_path / "out")
    src.mkdir(parents=True)
    (tmp_path / "docs" / "a.md").write_text("# A\n\nalpha beta\n\n## B\n\n| k | v |\n|--|--|\n| 1 | 2 |\n")
    (src / "b.md").write_bytes("# É\n\ngamma\r\nx = 1\r\n".encode() + b"\xff\n")
    (src / "c.txt").write_text("no")
    docs = io.markdown(spark, str(tmp_path / "docs")).collect()
    assert sorted(d.file_name for d in docs) == ["a.md", "b.md"] and all(d.file_size > 0 and d.modified for d in docs)
    chunks = build.build(spark, str(tmp_path / "docs"), out)
    assert {c.header_path for c in chunks.collect()} >= {"/A/", "/É/"}
    terms = {(r.term, r.chunk_id.rpartition("/")[2]) for r in spark.read.parquet(f"{out}/postings").collect()}
    assert ("alpha", "a.md#0") in terms and any(t == "gamma" for t, _ in terms)
    assert spark.read.parquet(f"{out}/vectors").count() == chunks.count() == io.read_chunks(spark, f"{out}/chunks").count()
    (tmp_path / "docs" / "a.md").unlink()
    assert {c.file_name for c in build.build(spark, str(tmp_path / "docs"), out).collect()} == {"b.md"}
    empty = tmp_path / "none"
    empty.mkdir()
    assert io.markdown(spark, str(empty)).count() == 0
    assert stats.knowledge_hash(io.markdown(spark, str(empty))).first().knowledge_hash == "empty"


def test_office_files_and_images(spark, tmp_path):
    """S3, S10, V1."""
    good, bad = tmp_path / "a.docx", tmp_path / "b.XLSX"
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("[Content_Types].xml", "<x/>")
        z.writestr("word/document.xml", "<x/>")
    bad.write_bytes(b"PK no")
    (tmp_path / "n.md").write_text("x")
    assert {(r.path.rpartition("/")[2], r.suffix) for r in io.office_files(spark, str(tmp_path)).collect()} == {("a.docx", "docx"), ("b.XLSX", "xlsx")}
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    valid = {r.path.rpartition("/")[2]: r.ok for r in files.select("path", assets.valid_office(F.col("content")).alias("ok")).collect()}
    assert valid["a.docx"] and not valid["b.XLSX"]
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 300, 90, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"\0" * 301 * 90)) + part(b"IEND", b"")
    (tmp_path / "i.png").write_bytes(png)
    heads = {
        "i.png": png, "g": b"GIF89a" + struct.pack("<HH", 300, 90), "b": b"BM" + bytes(16) + struct.pack("<ii", 300, -90), "x": b"RIFF    WEBPVP8X" + bytes(8) + (299).to_bytes(3, "little") + (89).to_bytes(3, "little"),
        "l": b"RIFF    WEBPVP8L" + bytes(4) + b"\x2f" + (299 | 89 << 14).to_bytes(4, "little") + bytes(9), "v": b"RIFF    WEBPVP8 " + bytes(10) + struct.pack("<HH", 300, 90),
        "j": b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + bytes(2) + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 90, 300) + bytes(9), "n": b"text", "z": b"",
    }
    d = spark.createDataFrame([(k, bytearray(v)) for k, v in heads.items()] + [("null", None)], "name string, content binary")
    got = {r.name: r.d and (r.d.width, r.d.height) for r in d.select("name", assets.dimensions("content").alias("d")).collect()}
    assert {k for k, v in got.items() if v == (300, 90)} == {"i.png", "g", "b", "x", "l", "v", "j"} and all(got[k] in (None, (None, None)) for k in ("n", "z", "null"))
    assert io.images(spark, str(tmp_path)).count() == 1


def test_cache_rows_come_back(spark, tmp_path):
    """W3, W5."""
    spark.sql("CREATE DATABASE IF NOT EXISTS tessera_test LOCATION '" + str(tmp_path / "db") + "'")
    try:
        io.create_cache(spark, "tessera_test.cache")
        assert spark.table("tessera_test.cache").count() == 0
        row = (7, "k", "q", "p", "u", "a", [(0.5, "n", "f", "/A/", 1, 2)], [1.0, 0.0], "h1", None)
        new = spark.createDataFrame([row], spark.table("tessera_test.cache").schema)
        new.write.insertInto("tessera_test.cache")
        fresh, deleted = answer_cache.split_stale(spark.table("tessera_test.cache"), "h1")
        assert [tuple(r)[:2] for r in fresh.collect()] == [(7, "k")] and deleted.first().deleted == 0
        assert answer_cache.split_stale(spark.table("tessera_test.cache"), "h2")[1].first().deleted == 1
    finally:
        spark.sql("DROP DATABASE IF EXISTS tessera_test CASCADE")


def test_web_pages_as_markdown(spark, tmp_path):
    """V2, W6."""
    page = '<html><head><title>t</title><style>x</style></head><body><h1>One &amp; two</h1><p>a <b>bold</b> and <i>it</i><br>line <a href="/u">here</a></p><ul><li>x<li>y <ol><li>z</ol></ul><pre>  code\n  more</pre><table><tr><th>a</th><th>b</th></tr><tr><td>1|2</td></tr></table><img src="i.png" alt="p"><hr><p><b>open</p></body>'
    want = "# One & two\n\na **bold** and *it*\nline [here](/u)\n\n- x\n- y\n  1. z\n\n```\n  code\n  more\n```\n\n| a | b |\n|--|--|\n| 1\\|2 |  |\n\n![p](i.png)\n\n---\n\n**open**\n"
    assert convert.to_markdown(page) == want
    d = spark.createDataFrame([("d/a.md", page), ("b.md", None), ("c.md", "")], "name string, html string").withColumn("text", F.lit(1))
    got = convert.markdown(d)
    assert {r.name: r.markdown for r in got.collect()} == {"d/a.md": want, "b.md": "", "c.md": ""}
    convert.write_files(got, str(tmp_path / "out"), text="markdown")
    assert (tmp_path / "out" / "d" / "a.md").read_text() == want and (tmp_path / "out" / "b.md").read_text() == ""
    convert.write_files(got, f"file://{tmp_path}/out", text="markdown")
    assert sorted(os.listdir(tmp_path / "out")) == ["b.md", "c.md", "d"]
    assert [r.file_name for r in io.markdown(spark, str(tmp_path / "out")).collect()] == ["a.md"]  # Spark reads no empty files


def test_prompts(spark):
    d = spark.createDataFrame([("q", None)], "q string, c string")
    got = d.select(prompts.fill(prompts.ANSWER, question=F.col("q"), intent=F.lit("steps"), context=F.col("c")).alias("a"), prompts.fill(prompts.ANALYSIS, question=F.col("q")).alias("b")).first()
    assert "Question:\nq\n" in got.a and got.a.endswith("Passages:\n") and '{"question_type": ""' in got.b and "{{" not in got.b


def test_settings(spark):
    """S11."""
    spark.conf.set("tessera.chunk_size", "500")
    try:
        assert Settings.load(spark).chunk_size == 500 and Settings.load(spark).rrf_k == 60
        with pytest.raises(ValueError, match="bm25_top_k"):
            Settings.load(spark, ("chunk_size", "bm25_top_k"))
    finally:
        spark.conf.unset("tessera.chunk_size")


def test_rules_from_a_file(tmp_path):
    """S8: the rules of a file replace the built-in ones."""
    path = tmp_path / "r.yaml"
    path.write_text("header_rules:\n  - name: topic\n    match: [x]\n    value: y\ntext_rules:\n  - name: has_sql\n    type: regex\n    patterns: ['select']\n    value: true\n")
    try:
        import yaml  # noqa: F401
    except ImportError:
        pytest.skip("no YAML reader here")
    got = rules.load(str(path))
    assert got["header_rules"][0]["value"] == "y" and got["text_rules"][0]["patterns"] == ["select"]
