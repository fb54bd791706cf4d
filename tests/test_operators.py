"""Operators on hand-made frames: the cases that the tables don't hold."""

import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import text as t
from corpusmill.functions import vectors as v
from corpusmill.operators import clean, conversations, embedding, evaluation, fusion, intervals, lookup, sections, splitting, text_search, usage, vector_search
from corpusmill.plans import q_retrieval
from corpusmill.sources import jsonl, tables


def rows(df):
    return [tuple(r) for r in df.collect()]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_one_heading(spark):
    out = sections.nodes(docs(spark, "# Intro\n\nChunk body that is long enough."), splitting.split).collect()
    assert [(r.path, r.text, r.parent_id, r.part) for r in out] == [("Intro", "Chunk body that is long enough.", None, 0)]


def test_heading_spans_lines_and_text_before_is_lost(spark):
    out = rows(sections.headings(docs(spark, "lost\n#\n\nTitle \r\nbody\n####### no heading")).select("level", "title", "body"))
    assert out == [(1, "Title", "body\n####### no heading")]


def test_dropped_subtree_and_its_quirk(spark):
    text = "# A\n\nx\n# References\n\nx\n## Thanks to all\n\nx\n## Kept again\n\nx\n# Citations of work\n\nx\n## Gone\n\nx\n# B\n\nx\n## Referenceses\n\nx"
    kept = [r.title for r in sections.kept_sections(sections.headings(docs(spark, text))).orderBy("pos").collect()]
    assert kept == ["A", "Kept again", "B", "Referenceses"]


def test_hierarchy_equals_a_stack(spark):
    rng = random.Random(1)
    outlines = [[rng.randint(1, 6) for _ in range(rng.randint(1, 14))] for _ in range(60)]
    data = [(d, i, level, f"t{i}") for d, levels in enumerate(outlines) for i, level in enumerate(levels)]
    out = {(r.doc_id, r.pos): (r.parent_pos, r.path) for r in sections.with_hierarchy(spark.createDataFrame(data, "doc_id int, pos int, level int, title string")).collect()}
    for d, levels in enumerate(outlines):
        stack = []
        for i, level in enumerate(levels):
            while stack and stack[-1][0] >= level:
                stack.pop()
            assert out[d, i] == (stack[-1][1] if stack else None, "/".join(f"t{k}" for _, k in [*stack, (0, i)]))
            stack.append((level, i))


def test_carried_texts(spark):
    text = "# A\n\nshort\n# B\n\nalso\n# C\n\nlong enough to stand alone here\n# D\n\ntiny\n# References\n\nx"
    out = rows(sections.with_carried(sections.kept_sections(sections.headings(docs(spark, text)))).orderBy("pos").select("title", "text"))
    assert out == [("A", ""), ("B", ""), ("C", "short\nalso\nlong enough to stand alone here"), ("D", "")]  # what D carried is lost
    assert rows(sections.with_carried(sections.headings(docs(spark, "# A\n\nlast"))).select("text")) == [("last",)]


def test_parts_are_linked(spark):
    text = "# Intro\n\n" + "\n\n".join(f"Sentence number {i} of this text." for i in range(40))
    out = sections.nodes(docs(spark, text), lambda x: ["part one", "", "part two"], max_tokens=20, metadata={"title": "given", "k": "v"}).orderBy("part").collect()
    assert [(r.path, r.text) for r in out] == [("Intro", ""), ("Intro/part 1", "part one"), ("Intro/part 2", "part two")]
    assert out[2].prev_id == out[1].node_id and out[1].next_id == out[2].node_id and out[1].parent_id == out[0].node_id and out[2].next_id is None
    assert out[1].metadata["title"] == "part 1" and out[1].metadata["k"] == "v" and out[1].metadata["max_tokens"] == "20"


def test_without_headings(spark):
    assert rows(sections.without_headings(docs(spark, "plain", "# A\nx", "")).select("doc_id")) == [(0,), (2,)]


def test_math_is_kept_whole():
    text = "Before $a.\\ b$ after. $$x\n\ny$$ rest. \\begin{align}a\n\nb\\end{align} end $$open"
    assert [text[a:b] for a, b in splitting.block_math(text)] == ["$$x\n\ny$$", "\\begin{align}a\n\nb\\end{align}"]
    assert splitting.marks("a $b$ c").find(1) == 2


@pytest.mark.parametrize(
    ("text", "count"),
    [
        ("One ends.\n\nTwo ends.", 2),
        ("It follows:\n\nTwo ends.", 1),
        ("a hyphen-\n\nated word", 1),
        ("As in e.g.\n\nThis case.", 1),
        ("unfinished line\n\nand more", 1),
        ("unfinished line\n\nNew one", 2),
        ("unfinished line\n\n# Heading", 2),
        ("An end.\n\n$$x$$\n\nNext.", 1),
    ],
)
def test_paragraphs(text, count):
    assert len(splitting.Splitter(text).paragraphs()) == count


def test_sentences():
    text = 'One ends. Two "ends." Three e.g. This goes on. 4 digits go on. (Brackets too) end! \\cite{x} goes on? Last.'
    s = splitting.Splitter(text)
    assert [text[w.start : w.end].strip() for w in s.sentences(splitting.Window(0, len(text)))] == ['One ends.', 'Two "ends."', "Three e.g. This goes on. 4 digits go on. (Brackets too) end! \\cite{x} goes on?", "Last."]


def test_packing_with_overlap_repeats_trailing_windows():
    units = [splitting.Window(i, i + 1, 2) for i in range(4)]
    assert [(w.start, w.end) for w in splitting.pack(units, 4, 2)] == [(0, 2), (1, 3), (2, 4), (3, 4)]
    assert [(w.start, w.end) for w in splitting.pack([splitting.Window(0, 9, 99), *units], 4)] == [(0, 9), (0, 2), (2, 4)]


def test_small_windows_merge():
    merge = lambda *spans: [(w.start, w.end) for w in splitting.merge_small([splitting.Window(*s) for s in spans], 20)]
    assert merge((0, 5), (5, 40), (40, 45)) == [(0, 45)]
    assert merge((0, 5)) == [(0, 5)] and merge((0, 30), (30, 35)) == [(0, 35)] and merge((0, 5), (5, 9)) == [(0, 9)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["A sentence here. ", "another one\n\n", "$x. Y$ ", "More words! ", "\n\n", "e.g. "]), min_size=1, max_size=60).map("".join))
def test_windows_lie_inside_and_lose_nothing(text):
    parts = splitting.split(text, max_tokens=8)
    assert "".join("".join(parts).split()) == "".join(text.split()) and all(p in text for p in parts)


def test_intervals(spark):
    data = spark.createDataFrame([("a", 0, 5), ("a", 5, 7), ("a", 8, 9), ("b", 0, 1), ("a", 1, 2)], "k string, s long, e long")
    assert sorted(rows(intervals.merged(data, ["k"], "s", "e"))) == [("a", 0, 7, 3), ("a", 8, 9, 1), ("b", 0, 1, 1)]
    probe = spark.createDataFrame([("a", 0, 20)], "k string, s long, e long")
    assert intervals.intersecting(probe, data, ["k"], "s", "e").count() == 1  # end points only: (0, 5) holds the first


def test_authors(spark):
    names = [["Doe", " J. -  P. ", ""], ["", " ", ""], ["Roe", None, "Jr"]]
    df = spark.createDataFrame([(names,), ([["", "", ""]],), (None,)], "a array<array<string>>")
    assert rows(df.select(t.authors_line(F.col("a")), F.size(t.author_names(F.col("a"))))) == [("Doe J.-P., Roe Jr", 2), (None, 0), (None, None)]


def test_metadata_edges(spark):
    data = [json.dumps({"id": "x", "authors_parsed": "none", "versions": [{"created": "Mon, 2 Apr 2007 19:18:42 GMT"}]}), '{"root":{"id":"y"}}', "no json", '{"id":" "}', None]
    out = {r.id: r for r in clean.metadata(spark.createDataFrame([(x,) for x in data], "raw_json string")).collect()}
    assert set(out) == {"x", "y"} and out["x"].number_of_authors == 0 and out["x"].authors is None and str(out["x"].created) == "2007-04-02 19:18:42"


def test_identifiers(spark):
    df = spark.createDataFrame([("a/b/0704.0001v2.html",), ("astro-ph0001234",), ("odd",), ("hep-th0001234v3.html",)], "id string")
    assert [r[0] for r in rows(df.select(t.canonical_id(F.col("id"))))] == ["0704.0001v2", "astro-ph/0001234", "odd", "hep-th/0001234v3"]


def test_citation_and_snippet(spark):
    df = spark.createDataFrame([("A\nB", "J", "u", " x \n y "), (None, "", "u", "z" * 200)], "t string, j string, u string, x string")
    assert rows(df.select(t.citation(F.col("t"), F.col("j"), F.col("u")), F.length(t.snippet(F.col("x"))))) == [("[A B. J](u)", 3), ("[](u)", 160)]


def test_jsonl(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"source_id":"1","text":" a ","metadata":{"k":1}}\n\n{"text":"é"}\n')
    assert rows(jsonl.read_documents(spark, str(good), strict=True)[0]) == [("1", "a", '{"k":1}'), (None, "é", None)]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"text":"ok"}\n[1]\n\nnope\n{"text":"  "}\n')
    found, rejects = jsonl.read_documents(spark, str(bad))
    assert found.count() == 1 and sorted((r.line, r.error) for r in rejects.collect()) == [(2, "not an object"), (4, "invalid JSON"), (5, "empty text")]
    with pytest.raises(Exception, match="not an object in line 2 of .*bad.jsonl"):
        jsonl.read_documents(spark, str(bad), strict=True)[0].collect()
    queries = tmp_path / "q.jsonl"
    queries.write_text('{"text":"q","relevance":["a"],"metadata":{"relevance":["b"]}}\n{"text":"r","relevance":{"a":2},"metadata":[1]}\n')
    assert rows(jsonl.read_queries(spark, str(queries))[0]) == [("q", '{"relevance":["b"]}', '["b"]'), ("r", "{}", '{"a":2}')]
    jsonl.write(spark.createDataFrame([("é", None)], "text string, x string"), str(tmp_path / "out"))
    assert "é" in "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))


def test_jsonl_line_numbers_over_blocks(spark, tmp_path):
    text = "".join("nope\r\n" if i % 97 == 0 else "\n" if i % 5 == 0 else json.dumps({"text": f"t{i}"}) + "\n" for i in range(1, 3000))
    (tmp_path / "a.jsonl").write_text(text)
    (tmp_path / "b.jsonl").write_text("\n[1]")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        found, rejects = jsonl.read_documents(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 4
        assert sorted((r.file[-7:], r.line, r.value) for r in rejects.collect()) == [("a.jsonl", i, "nope") for i in range(97, 3000, 97)] + [("b.jsonl", 2, "[1]")]
        assert found.count() == sum(1 for i in range(1, 3000) if i % 97 and i % 5)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_load_once_and_partitions(spark, tmp_path):
    first, second = docs(spark, "a"), docs(spark, "b", "c")
    assert tables.load_once(spark, str(tmp_path), first, "d").count() == 1 and tables.load_once(spark, str(tmp_path), second, "d").count() == 1
    kind, path = "dataset string, k int, created int", str(tmp_path / "p")
    tables.replace_partitions(spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], kind), path, ["dataset"])
    tables.replace_partitions(spark.createDataFrame([("b", 2, 2)], kind), path, ["dataset"])
    assert sorted((r.dataset, r.k) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2)]


def test_query_syntax(spark):
    df = spark.createDataFrame([('Big "red or blue" -dog or Cat -"b c"',), ("-only",), ("",)], "q string")
    first, second, third = (r[0] for r in rows(df.select(text_search.parsed(F.col("q")))))
    assert [(a.must, a.phrases, a.must_not) for a in first] == [(["big", "red", "or", "blue"], [["red", "or", "blue"]], ["dog"]), (["cat"], [], ["b", "c"])]
    assert second == [] and third == []


def test_text_search(spark):
    chunks = spark.createDataFrame([(1, "the red fox and a dog"), (2, "fox red"), (3, "red cat fox"), (4, ""), (5, "dog only")], "chunk_id long, text string")
    posted = text_search.postings(chunks)
    ask = lambda q, k=10: [(r.chunk_id, r.rank) for r in text_search.text_top_k(spark.createDataFrame([(1, q)], "query_id int, query string"), posted, k).orderBy("text_rank").collect()]
    assert ask("red fox") == [(1, 1.0), (2, 1.0), (3, 1.0)] and ask('"red fox"') == [(1, 1.0)] and ask("red fox -dog") == [(2, 1.0), (3, 1.0)]
    assert [c for c, _ in ask("cat or dog")] == [1, 3, 5] and ask(" \n ") == [] and ask("red", 0) == []


def test_zero_vectors_have_no_distance(spark):
    c = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 1.0]), (4, None)], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, qvec array<float>")
    assert [(r.chunk_id, r.vector_rank) for r in vector_search.vector_top_k(q, c, 5).collect()] == [(2, 1), (3, 2)]
    assert vector_search.vector_top_k(q, c, 0).count() == 0
    assert rows(c.where("chunk_id = 1").select(v.unit(F.col("embedding")))) == [([0.0, 0.0],)]


def test_fusion_and_rerank(spark):
    text = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, chunk_id long, text_rank int")
    near = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id int, chunk_id long, vector_rank int")
    fused = fusion.fused(text, near, fusion.Params()).orderBy("fused_rank")
    assert [r.chunk_id for r in fused.collect()] == [11, 12, 10] and fusion.fused(text, near, fusion.Params(fused_k=-1)).count() == 0
    scores = spark.createDataFrame([(1, 12, 0.9, True), (1, 99, 1.0, True)], "query_id int, chunk_id long, relevance_score double, ok boolean")
    final = lambda s, k=3, on=True: [r.chunk_id for r in fusion.reranked(fused, s, k, on).orderBy("final_rank").collect()]
    assert final(scores) == [12, 11, 10] and final(scores, 1) == [12] and final(scores, 2, False) == [11, 12] and final(scores.limit(0)) == [11, 12, 10]
    bad = scores.withColumn("ok", F.lit(False))
    assert final(bad) == [11, 12, 10]
    odd = fused.withColumns({"query": F.lit("q"), "text": F.lit("q")})
    assert not fusion.scored(odd, F.when(F.col("chunk_id") == 12, F.lit(float("nan"))).otherwise(1.0)).first().ok


def test_metrics_edges(spark):
    lists = spark.createDataFrame([(1, ["a", "", "b", "a"]), (2, None)], "query_id int, relevance array<string>")
    assert sorted(rows(evaluation.judgements_from_lists(lists))) == [(1, "a", 3), (1, "b", 2)]
    maps = spark.createDataFrame([(1, {"a": 2})], "query_id int, relevance map<string,int>")
    assert rows(evaluation.judgements_from_maps(maps)) == [(1, "a", 2)]
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    qrels = evaluation.judgements_from_lists(lists).withColumnRenamed("doc_id", "d").withColumnRenamed("d", "doc_id")
    pairs = evaluation.pair_rows(spark.createDataFrame([(1, "x", 1, 0.1), (1, "a", 2, 0.2)], "query_id int, doc_id string, rank int, distance double"), qrels)
    out = {r.query_id: r for r in evaluation.query_metrics(queries, pairs, qrels).collect()}
    assert out[2][1:] == (0.0,) * 5 and out[1].mrr == 0.5 and out[1].recall_50 == 0.5 and 0 < out[1].ndcg < 1
    with pytest.raises(ValueError, match="no documents"):
        evaluation.clamped_cutoff(5, 0)
    with pytest.raises(ValueError, match="quantization"):
        evaluation.clamped_cutoff(5, 9, "int8")
    specs = {"a": True, "b": False, "c": True}
    assert evaluation.clamped_cutoff(5, 3) == 3 and evaluation.selected_models(specs) == ["a", "c"] and evaluation.selected_models(specs, ["c", "b"]) == ["c"]
    with pytest.raises(ValueError, match="unknown models: x"):
        evaluation.selected_models(specs, ["a", "x"])


def test_failed_batches_reject_their_rows_only(spark):
    def encode(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return np.ones((len(texts), 4))

    data = spark.createDataFrame([(i, "bad" if i == 3 else "x") for i in range(8)] + [(9, "")], "id long, text string").coalesce(1)
    good, rejects = embedding.embedded(data, encode, 4, batch=2)
    assert sorted(r.id for r in good.collect()) == [0, 1, 4, 5, 6, 7] and sorted(rows(rejects)) == [(2, "RuntimeError: no"), (3, "RuntimeError: no")]
    assert embedding.embedded(data, encode, 5)[0].count() == 0
    assert embedding.hashed_features(8)(["a b"]).shape == (1, 8)


def test_conversation_edges(spark):
    data = [(1, 1, 1, "user", "hello"), (1, 1, 2, "assistant", "hi"), (1, 1, 3, "user", " ")]
    m = spark.createDataFrame(data, "thread_id int, user_id int, sequence_num long, role string, content string")
    assert rows(conversations.effective_prompts(m)) == [(1, "hello")]
    explicit = spark.createDataFrame([(1, " "), (2, "mine")], "thread_id int, prompt string")
    assert sorted(rows(conversations.effective_prompts(m, explicit))) == [(1, "hello"), (2, "mine")]
    assert conversations.last_messages(m, 0).count() == 0
    assert rows(spark.createDataFrame([(" a\nb ",), (" ",), (None,)], "x string").select(conversations.title(F.col("x")))) == [("a b",), ("New chat",), ("New chat",)]


def test_usage_edges(spark):
    day = lambda s: f"2024-01-01 {s}"
    hits = spark.createDataFrame([("k", day("00:00:50"), 1), ("k", day("00:01:10"), 2), ("k", day("00:01:49"), 3), ("k", day("00:01:50"), 4)], "key string, t string, event_id long").withColumn("ts", F.to_timestamp("t"))
    out = usage.fixed_windows(hits, "key", 60, 2).orderBy("event_id").select("count", "allowed", "retry_after")
    assert rows(out) == [(1, True, None), (2, True, None), (3, False, 1), (1, True, None)]  # the window opens at the first hit, not at the minute
    one = spark.createDataFrame([(1, day("10:00:00"), i, i == 9) for i in range(2)], "user_id int, t string, event_id int, is_premium boolean").withColumn("ts", F.to_timestamp("t"))
    assert rows(usage.daily_usage(one, 3).select("used", "remaining")) == [(2, 1)]
    assert rows(one.limit(1).select(usage.seconds_to_reset(F.to_timestamp(F.lit("2024-01-01 23:59:59"))))) == [(1,)]


def test_sql_table_function(spark):
    text = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "query_id long, chunk_id long, text_rank int")
    near = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, chunk_id long, vector_rank int")
    fusion.register_table_function(spark, "hybrid", fusion.fused(text, near, fusion.Params()))
    assert [r.chunk_id for r in spark.sql("SELECT * FROM hybrid(1, 2) ORDER BY fused_rank").collect()] == [11, 12]


def test_retrieval_queries_keep_texts_without_vectors(spark, tmp_path):
    texts = [(0, "red fox"), (1, "red red fox"), (2, "blue whale"), (3, "")]
    spark.createDataFrame([(i, x, "en", "s") for i, x in texts], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "red big fox"), (1, "blue big whale"), (2, " ")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, [1.0, 0.0], 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {(r.query_id, r.chunk_id): (r.text_rank, r.vector_rank) for r in q_retrieval.r08_rank_fusion(spark, str(tmp_path)).collect()}
    # Document 1 and query 1 have no vector; both are found by their words.
    assert found == {(0, 0): (1, 1), (0, 1): (2, None), (1, 2): (1, None)}
    for f in (q_retrieval.r09_hybrid_retrieve, q_retrieval.x01_scored_passages, q_retrieval.x04_merged_reranking, q_retrieval.r16_retrieve):
        assert {(r.query_id, r.chunk_id) for r in f(spark, str(tmp_path)).collect()} == set(found)


def test_fixed_windows_of_a_hot_key(spark):
    n = 120_000  # a second apart, in batches: windows of ten hits
    hot = spark.range(n).select(F.lit("hot").alias("key"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("event_id"))
    rest = spark.createDataFrame([("a", 5, n), ("a", None, n + 1), (None, 7, n + 2), ("a", 14, n + 3), (None, 17, n + 4)], "key string, s long, event_id long").select("key", F.timestamp_seconds("s").alias("ts"), "event_id")
    out = usage.fixed_windows(hot.union(rest), "key", 10, 4)
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    same = (F.col("count") == F.col("event_id") % 10 + 1) & (F.col("allowed") == (F.col("event_id") % 10 < 4)) & F.col("retry_after").eqNullSafe(F.when(F.col("event_id") % 10 >= 4, 10 - F.col("event_id") % 10))
    assert out.where("key = 'hot'").where(same).count() == n
    assert sorted(r.event_id - n for r in out.where("event_id >= 120000 and count = 1").collect()) == [0, 1, 2, 4]
    assert [r.event_id - n for r in out.where("event_id >= 120000 and count = 2").collect()] == [3]


def test_metadata_containment(spark, tmp_path):
    props = ['{"k": 42}', '{"k": 42.0, "t": ["a", {"b": null}]}', '{"k": "42"}', '{"k": 4}', '{"t": ["b"], "o": {"x": true, "it\'s": 1}}', "[42]", "not json", None, '{"k": 42.5}', '{"k": 9007199254740993}']
    events = spark.createDataFrame([(i, p, "e") for i, p in enumerate(props)], "event_id long, props string, event_type string")
    ids = lambda wanted: sorted(r.event_id for r in lookup.containing(events, "props", wanted).collect())
    assert ids({"k": 42}) == [0, 1] and ids({"k": "42"}) == [2] and ids({"k": 42.5}) == [8] and ids({"k": None}) == []
    assert ids({"k": 9007199254740992}) == [] and ids({"k": 9007199254740993}) == [9]
    assert ids({"k": 42, "t": ["a"]}) == [1] and ids({"t": [{"b": None}]}) == [1] and ids({"o": {"x": True, "it's": 1}}) == [4] and ids({"o": {"x": False}}) == []
    assert ids({}) == [0, 1, 2, 3, 4, 8, 9]
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(rows(q_retrieval.r13_containment_lookup(spark, str(tmp_path)))) == [(0, "e"), (1, "e")]
