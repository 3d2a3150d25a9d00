"""Golden cases of retrieval, dictionary, routing, citations, sources and streaming."""

import struct
import zlib

from pyspark.sql import functions as F

from tessera.functions import routing, text as X
from tessera.operators import answer_cache, assets, cite, lexicon, retrieval, rules, stats
from tessera.plans import ask, build
from tessera.settings import Settings
from tessera.sources import io
from tessera.streaming import incremental


def one(spark, c, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(c.alias("x")).first().x


KEYS = ["imsi", "impi", "impu", "msisdn", "isdn", "win", "str-sn", "hlr", "呼叫等待", "等待"]


def test_dictionary_matching(spark):
    got, share = lexicon.pick("IMPI IMPU IMSI MSISDN", KEYS)
    assert [k for k, _, _ in got] == ["msisdn", "imsi", "impi", "impu"] and share == 18 / 21
    assert lexicon.pick("windows", KEYS)[0] == [] and lexicon.pick("STRSN", KEYS) == ([("str-sn", 0, 5)], 1.0)
    got, share = lexicon.pick("HLR中IMSI和MSISDN的关系", KEYS)
    assert [k for k, _, _ in got] == ["msisdn", "imsi", "hlr"] and share == 13 / 18
    assert len(lexicon.pick("IMSI_X imsi imsi", KEYS)[0]) == 3
    assert lexicon.pick("呼叫等待是什么", KEYS) == ([("呼叫等待", 0, 4)], 4 / 7) and lexicon.pick("", KEYS) == ([], 0.0)
    d = io.dictionary(spark.createDataFrame([(f"{k.upper()}\tdef \"\"{k}\"\"\t\tmore", i) for i, k in enumerate(KEYS)] + [("  \tx", 99)], "value string, seq long"))
    assert d.count() == len(KEYS) and d.where("key = 'imsi'").first().definitions == ['def ""imsi""', "more"]
    q = spark.createDataFrame([(1, "IMPI IMPU IMSI MSISDN"), (2, "what does the imsi field contain"), (3, None), (4, "STRSN")], "question_id long, text string")
    m = lexicon.match(q, d)
    assert {r.question_id: r.hit for r in m.collect()} == {1: True, 2: False, 3: False, 4: True}
    shown = {r.question_id: r.markdown for r in lexicon.render(lexicon.entries(m, d)).collect()}
    assert shown[4] == '## **STR-SN**\n- def "str-sn"\n- more' and shown[1].startswith("## **MSISDN**")
    blocks = {r.question_id: (r.hit, [x.key for x in r.matches]) for r in lexicon.match(q, d, most_keys=3).collect()}
    assert blocks == {r.question_id: (r.hit, [x.key for x in r.matches]) for r in m.collect()}


def test_matches_join_where_they_lie(spark):
    """Whatever sizes Spark guesses, the dictionary goes out and not the matches, and entries move once."""
    d = io.dictionary(spark.createDataFrame([(f"{k}\tdefinition of {k} " + "x" * 200, i) for i, k in enumerate(KEYS * 3)], "value string, seq long"))
    m = lexicon.match(spark.createDataFrame([(1, "imsi hlr"), (2, "imsi")], "question_id long, text string"), d.select("key", "seq"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = lexicon.entries(m, d)
    assert "BuildRight" in plan(found) and "BuildLeft" not in plan(found)
    shown = lexicon.render(found)
    assert plan(shown).partition("MapInArrow")[0].count("Exchange hashpartitioning(") == 1
    merged = lexicon.entries(m, d, most_chars=0)
    assert "SortMergeJoin" in plan(merged) and sorted(merged.collect()) == sorted(found.collect())
    assert sorted(lexicon.render(merged).collect()) == sorted(shown.collect()) and found.count() == 9


def test_questions_of_one_block_are_dealt_out(spark):
    texts = ["imsi hlr", None, "imsi hlr", "", "STRSN", None, "no key", "IMSI_X imsi imsi"] * 700
    q = spark.createDataFrame(list(enumerate(texts)), "question_id long, text string").coalesce(1)
    d = spark.createDataFrame([(k, i) for i, k in enumerate(KEYS)], "key string, seq long")
    m = lexicon.match(q, d)
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(question_id" in plan.partition("MapInArrow")[2]
    for got in (m.collect(), lexicon.match(q, d, most_keys=3).collect()):
        assert len(got) == len(texts)
        for r in got:
            assert ([tuple(x) for x in r.matches], r.coverage) == lexicon.pick(texts[r.question_id] or "", KEYS)


def test_lines_of_a_dictionary_are_cleaned_once(spark, tmp_path):
    """Parts repeat brands and types: equal lines meet before they are cleaned, and keep their least seq."""
    from tessera import catalog

    parts = [(i, [" Brand#1", "brand#1", None, "BRAND#2 "][i % 4], ["LARGE", "large", "  "][i % 3]) for i in range(120, 0, -1)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    _, d = catalog._lexicon(spark, str(tmp_path))
    assert "keys=[value#" in d.select("key", "seq")._jdf.queryExecution().executedPlan().toString()
    want = {("brand#1", "Brand#1", "maker"): 4, ("brand#1", "brand#1", "maker"): 1, ("brand#2", "BRAND#2", "maker"): 3, ("maker", "maker", None): 2, ("large", "LARGE", "kind"): 3, ("large", "large", "kind"): 1}
    assert {(r.key, r.term, *(r.definitions or [None])): r.seq for r in d.collect()} == want


def test_index_finds_keys_in_time_with_the_text():
    """All keys begin alike, as brands do: only those that occur are candidates, and choices are those of all keys."""
    import random

    keys = sorted({f"brand#{i} type {j}" for i in range(40) for j in range(40)} | {"brand#7", "str-sn", "-x", "a-b-c", "ab", "_u", "b", "等待", "呼叫等待", "é", "x y"})
    index = lexicon.Index(keys)
    assert len(index.able("is brand#7 type 12 good")) <= 4
    r = random.Random(5)
    bits = ["brand#7 type 12", "brand#", "strsn", "str-sn", "a-bc", "ab-c", "-", "x", " ", "ab", "_", "呼叫等待", "é", "u", "B", "y", "7", "-x"]
    for _ in range(400):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 12)))
        assert lexicon.pick(text, [k for k in keys if k in index.able(text)]) == lexicon.pick(text, keys), text


def test_scores_of_cited_nodes_round_as_in_sql(spark):
    """Scores have six digits, so one in a hundred lies between two of four."""
    import duckdb

    scores = [(i * 100 + 50) / 1e6 for i in range(1, 20_000, 7)]
    nodes = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "query_id long, score double").selectExpr("*", "1 as rank", "'f' as file_name", "'p' as file_path", "'/' as header_path", "0 as line_start", "1 as line_end")
    got = {r.query_id: r.source_nodes[0].score for r in answer_cache.source_nodes(nodes).collect()}
    want = duckdb.execute("SELECT list(round(x, 4) ORDER BY i) FROM (SELECT unnest(?::DOUBLE[]) AS x, generate_subscripts(?::DOUBLE[], 1) AS i)", [scores, scores]).fetchone()[0]
    assert [got[i] for i in range(len(scores))] == want
    assert one(spark, X.rounded(F.col("t"), 4), t=-1.00005) == -one(spark, X.rounded(F.col("t"), 4), t=1.00005)


def test_numbered_entries(spark):
    f = spark.createDataFrame([(1, 0, 0, "T", ["a", "b"]), (1, 0, 1, "T", ["c■d"])], "question_id long, pos int, seq long, term string, definitions array<string>")
    assert lexicon.render(f).first().markdown == "## **T**\n#### 1. a\n- b\n#### 2. c\n- d"


def ranked(spark, scores):
    return spark.createDataFrame([(1, i, s, i + 1) for i, s in enumerate(scores)], "query_id long, chunk_id long, score double, rank int")


def test_selection_and_gate(spark):
    assert retrieval.select_dynamic(ranked(spark, [5.0, 4.9, 4.8, 4.7, 4.6, 4.5, 4.2, 4.3])).count() == 6
    for scores, want in (([0.9, -0.1], True), ([1.2, -0.1], False), ([0.9, 0.1], False)):
        assert retrieval.weak(ranked(spark, scores)).first().weak is want


def test_supplement(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"f{i // 3}", i, f"[SECTION]\nx\n[CONTENT]\nCFU case {i} [SECTION] other") for i in range(12)], "chunk_id string, file_path string, line_start int, text string")
    q = spark.createDataFrame([(1, "what is CFU", 5)], "query_id long, query string, n int")
    have = spark.createDataFrame([(1, "c0")], "query_id long, chunk_id string")
    got = retrieval.supplement(chunks, q, have).orderBy("seq").collect()
    assert [r.chunk_id for r in got] == ["c1", "c2", "c3"] and "other" not in got[0].text
    nodes = ranked(spark, [0.5, -0.2]).withColumn("chunk_id", F.col("chunk_id").cast("string")).withColumn("hit_sources", F.array(F.lit("bm25")))
    mixed = retrieval.splice(nodes, retrieval.supplement(chunks, q, have)).orderBy("rank").collect()
    assert [r.chunk_id for r in mixed] == ["0", "c1", "c2", "c3", "1"] and mixed[1].hit_sources == ["exact"]


def test_supplement_moves_few_hits(spark):
    """Every chunk has every term: of a batch only the first of a file are moved, and they are the right ones."""
    chunks = spark.range(900).selectExpr("id as chunk_id", "concat('f', id % 3) as file_path", "cast(900 - id as int) as line_start", "'alpha beta gamma' as text").coalesce(1)
    q = spark.createDataFrame([(1, "beta x1", 4), (2, "none", 4), (3, "gamma alpha", 9)], "query_id long, query string, n int")
    assert 0 < retrieval._first_hits(chunks, q, 12, 2_000).count() <= 2 * 3 * 12
    have = spark.createDataFrame([(1, 899), (1, 896)], "query_id long, chunk_id long")
    got = [(r.query_id, r.chunk_id, r.seq) for r in retrieval.supplement(chunks, q, have).orderBy("query_id", "seq").collect()]
    assert got == [(1, 897, 1), (1, 894, 2), (1, 898, 3), (3, 897, 1)]
    assert got == [(r.query_id, r.chunk_id, r.seq) for r in retrieval.supplement(chunks, q, have, most_queries=1).orderBy("query_id", "seq").collect()]


def test_bm25_weighs_few_chunks_at_once(spark, monkeypatch):
    """A batch of many chunks takes the memory of a few, and its best are those of the whole."""
    import tracemalloc

    import pyarrow as pa

    words = [f"w{i}" for i in range(1000)]
    chunks = spark.createDataFrame([(0, " ".join(words))], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, " ".join(words)), (2, "w7 w8")], "query_id long, query string")
    maps, there = [], type(chunks).mapInArrow
    monkeypatch.setattr(type(chunks), "mapInArrow", lambda self, f, *a, **k: maps.append(f) or there(self, f, *a, **k))
    retrieval.bm25(chunks, asked, k=3)
    batch = pa.record_batch([pa.array(range(4096)), pa.array(["w7" if i % 1000 == 999 else f"w{i % 500} xx" for i in range(4096)])], ["chunk_id", "text"])
    tracemalloc.start()
    got = [r for b in maps[0](iter([batch])) for r in b.to_pylist()]
    assert tracemalloc.get_traced_memory()[1] < 12 << 20
    tracemalloc.stop()
    best = sorted((r for r in got if r["query_id"] == 2), key=lambda r: (-r["score"], r["chunk_id"]))[:3]
    assert [r["chunk_id"] for r in best] == [999, 1999, 2999]


def test_posting_blocks(spark):
    c = spark.createDataFrame([(f"c{i}", "the rare%d" % (i % 50)) for i in range(100)], "chunk_id string, text string")
    got = retrieval.inverted_index(c, block=30).collect()
    the = [r for r in got if r.term == "the"]
    assert len(the) > 1 and all(r.df == 100 for r in the) and sorted(x for r in the for x in r.postings) == sorted(f"c{i}" for i in range(100))
    assert all(r.df == 2 and r.block == 0 for r in got if r.term != "the")


def test_index_query_has_one_row_a_term(spark, tmp_path):
    from tessera import catalog

    spark.range(70_000).selectExpr("id as doc_id", "'the word' as text").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["r1_inverted_index"](spark, str(tmp_path)).collect()
    want = " ".join(map(str, range(70_000)))
    assert sorted((r.term, r.block, r.df, r.postings == want) for r in got) == [("the", 0, 70_000, True), ("word", 0, 70_000, True)]


def test_vector_search_handles_zero_and_null(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [1.0, 1.0])], "chunk_id string, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [(r.chunk_id, r.score) for r in retrieval.vector_top(v, q).orderBy("rank").collect()] == [("a", 1.0), ("d", 0.707107), ("b", 0.0)]
    assert retrieval.vector_top(v, q, most_queries=1).count() == 3


def test_vector_search_keeps_tiles_and_k_rows():
    """Against the sorted whole, with copies, ties and values that are not numbers; no tile keeps more than k a query."""
    import numpy as np

    r = np.random.default_rng(3)
    q, v = r.normal(size=(70, 4)).round(1), r.normal(size=(900, 4)).round(1)
    v[100:400] = v[7]
    s = q @ v.T
    s[3, 5] = np.nan
    for ids in (r.permutation(900), r.permutation(900).astype(str).astype(object)):
        best = retrieval._Best(70, 15)
        for at in (0, 64, 128, 500):
            for first in (0, 40):
                best.add(first, s[first:first + 40 if first == 0 else 70, at:{0: 64, 64: 128, 128: 500, 500: 900}[at]], ids[at:{0: 64, 64: 128, 128: 500, 500: 900}[at]])
        which, own, scores = best.rows()
        assert best.scores.shape == best.ids.shape == (70, 15)
        for i in range(70):
            want = sorted((-x, ids[j]) for j, x in enumerate(s[i].round(6)) if x == x)[:15]
            assert [(-x, y) for x, y in zip(scores[which == i], own[which == i])] == want


def test_text_columns(spark):
    assert one(spark, X.strip(F.col("t")), t="  x\n") == "x"
    assert one(spark, X.exact_terms(F.col("t")), t="HLR中IMSI和MSISDN x_y Abc") == ["x_y", "abc"]
    assert one(spark, X.hybrid_tokens(F.col("t"), X.cjk_bigrams(F.col("t"))), t="呼叫等 ab c") == ["呼叫", "叫等", "ab"]
    assert [one(spark, X.is_quoted(F.lit(q))) for q in ('"CFU"', "'MME x'", 'abc"def', "CFU", '""')] == [True, True, False, False, False]
    assert [one(spark, routing.classify(F.lit(q))) for q in ("", "hi", "CW", "?", "HSS")] == ["INVALID", "CHAT", "INVALID", "CHAT", "RAG"]
    assert [one(spark, X.duration(F.lit(m))) for m in (12, 1240, 135000, 3782000)] == ["12ms", "1.24s", "2m15s", "1h03m02s"]
    assert [one(spark, X.rough_tokens(F.lit(t))) for t in ("", "a", "abcde")] == [0, 1, 2]
    assert [one(spark, routing.admissible(F.lit(a))) for a in ("不知道。" + "x" * 30, "y" * 19, "z" * 20)] == [False, False, True]
    assert one(spark, rules.header_columns(F.lit("配置 流程"))["topic"]) == "procedure"
    assert one(spark, X.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert one(spark, X.rewrite_images(F.lit("![a](x\\y.png) http://h ![b](http://h/i.png)"), F.lit("d"))) == "![a](/static/ref_md/d/x/y.png) http://h ![b](http://h/i.png)"
    assert one(spark, routing.json_fields(F.lit('{"question_type": "RAG"}'))).question_type == "RAG"
    d = one(spark, routing.with_defaults(F.lit("q"), F.struct(F.lit("").alias("retrieval_query"), F.lit("find").alias("user_intent"), F.lit("").alias("presentation_intent"))))
    assert (d.retrieval_query, d.user_intent, d.presentation_intent) == ("q", "获取信息", "intro")


def test_ranges_and_batches(spark):
    r = spark.createDataFrame([("f", 5, 8), ("f", 1, 3), ("f", 3, 4), ("f", 9, 9)], "file_path string, start int, end int")
    assert sorted((x.start, x.end) for x in cite.merge_ranges(r).collect()) == [(1, 4), (5, 8)]
    t = spark.createDataFrame([(1, i, x) for i, x in enumerate(["ab", "c\n", "x" * 24, "tail"])], "question_id long, seq int, token string")
    assert [x.text for x in cite.micro_batches(t).orderBy("batch").collect()] == ["abc\n", "x" * 24, "tail"]


def png(w, h):
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + head + struct.pack(">I", zlib.crc32(b"IHDR" + head))


def test_assets(spark):
    i = spark.createDataFrame([("f", k, f"img/{n}.png") for k, n in enumerate(["chart", "图1", "a" * 21, "图1"])], "file_path string, seq int, path string")
    assert [r.new_path for r in assets.new_names(i).orderBy("seq").collect()] == ["img/chart.png", "img/img_000001.png", "img/img_000002.png", "img/img_000001.png"]
    d = spark.createDataFrame([(png(200, 100),), (b"nothing",), (None,)], "content binary").select(assets.dimensions("content").alias("d")).select("d.*").collect()
    assert [(r.width, r.height) for r in d] == [(200, 100), (None, None), (None, None)]
    assert not spark.createDataFrame([(b"x",)], "content binary").select(assets.valid_office("content").alias("v")).first().v
    docs = spark.createDataFrame([("f", "![a](i.png) tail\n\n*[Image OCR]*\nold words\n*[End OCR]*\nend\n![b](gone.png)")], "file_path string, text string")
    known = spark.createDataFrame([("f", "i.png", "n.png", "abc", 200, 100, "new words")], "file_path string, path string, new_path string, image_id string, width int, height int, caption string")
    r = assets.apply_captions(docs, known).first()
    assert r.kept == 1 and r.missing == 1 and "old words" in r.text and "id: abc" in r.text and "![a](n.png) tail" in r.text and r.text.endswith("end\n![b](gone.png)")


def test_files_to_answers(spark, tmp_path):
    (tmp_path / "kb/sub").mkdir(parents=True)
    (tmp_path / "kb/a.md").write_text("# Calls\n\nCFU forwards every call.\n\n## Timer\n\nCFNRy waits 20 seconds.\n")
    (tmp_path / "kb/sub/b.md").write_text("# Store\n\nThe HSS keeps subscriber data.\n")
    (tmp_path / "kb/c.txt").write_text("no markdown")
    out = str(tmp_path / "out")
    chunks = build.build(spark, str(tmp_path / "kb"), out)
    assert chunks.select("file_path").distinct().count() == 2 and spark.read.parquet(f"{out}/postings").where("term = 'cfu'").count() == 1
    d = io.dictionary(spark.createDataFrame([("MSC\tswitch", 0)], "value string, seq long"))
    q = spark.createDataFrame([(1, "how does CFU work", "NORMAL"), (2, "MSC", "NORMAL"), (3, "hi", "NORMAL"), (4, '"HSS"', "NORMAL")], "query_id long, query string, mode string")
    got = {r.query_id: r for r in ask.ask(q, d, chunks, spark.read.parquet(f"{out}/vectors")).collect()}
    assert [got[i].route for i in (1, 2, 3, 4)] == ["RAG", "DICT", "CHAT", "QUOTED"]
    assert "CFU forwards" in got[1].context and "a.md" in got[1].refs and got[2].markdown == "## **MSC**\n- switch" and got[3].context is None
    io.write_chunks(chunks.limit(0), f"{out}/none")
    assert io.read_chunks(spark, f"{out}/none").count() == 0
    assert io.office_files(spark, str(tmp_path / "kb")).count() == 0
    stream = incremental.follow(spark, str(tmp_path / "kb"), str(tmp_path / "live"), str(tmp_path / "cp"))
    stream.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "live/chunks")).count() == chunks.count()


def test_settings_and_stats(spark):
    spark.conf.set("tessera.chunk_size", "500")
    assert Settings.load(spark).chunk_size == 500
    spark.conf.unset("tessera.chunk_size")
    try:
        Settings.load(spark, ("rrf_k",))
        raise AssertionError
    except ValueError:
        pass
    empty = spark.createDataFrame([], "file_path string, file_size long, modified long")
    assert stats.knowledge_hash(empty).first().knowledge_hash == "empty"


def test_an_image_without_height_is_not_meaningful(spark):
    d = spark.createDataFrame([(200, 0), (200, 100), (None, 100), (2000, 100)], "w int, h int")
    assert [r.ok for r in d.select(assets.meaningful(F.col("w"), F.col("h")).alias("ok")).collect()] == [False, True, False, False]
