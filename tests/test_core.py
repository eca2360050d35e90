"""Core operators: queries against their SQL, and pure functions on small fixtures."""

import random

import pytest
from helpers import assert_same
from pyspark.sql import functions as F

from loomgraph.engine import Engine
from loomgraph.functions import chunking
from loomgraph.operators import guards
from loomgraph.operators.graph import merge_nodes, upsert_edges, upsert_nodes
from loomgraph.operators.ranking import rrf
from loomgraph.operators.skew import lookup_join, running
from loomgraph.plans import catalog
from loomgraph.sources import files
from loomgraph.streaming import feeds

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, con, name):
    assert_same(catalog.QUERIES[name](spark, SF_DIR), con, catalog.ORACLES[name])


def test_salted_lookup_keeps_every_row(spark):
    left = spark.createDataFrame([("hot", i) for i in range(400)] + [("cold", 1), ("none", 2), (None, 3)], "k string, x int")
    right = spark.createDataFrame([("hot", "a"), ("cold", "b"), (None, "c")], "k string, y string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = sorted(map(tuple, left.join(right, ["k"], how).collect()), key=repr)
        assert sorted(map(tuple, lookup_join(left, right, ["k"], how, hot_rows=50).collect()), key=repr) == plain


def test_running_sums_over_stretches(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 5}", rng.random(), i) for i in range(600)] + [(None, 1.0, 9_000), (None, 0.5, 9_001)]
    df = spark.createDataFrame(rows, "k string, t double, i int")
    got = {r.i: (r.n, r.s) for r in running(df, ["k"], ["t", "i"], {"n": F.lit(1).cast("long"), "s": F.col("i").cast("long")}, 6).collect()}
    want, state = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        n, s = state.get(k, (0, 0))
        state[k] = want[i] = (n + 1, s + i)
    assert got == want


def test_chunks():
    assert chunking.chunk_text("  \n ") == []
    assert [c[1] for c in chunking.chunk_text("one\n\ntwo")] == ["one\n\ntwo"]
    long_ = chunking.chunk_text("x" * 5_000, 1_000, 100)
    assert len(long_) == 5 and all(len(c[1]) <= 1_102 for c in long_) and long_[1][1].startswith("x" * 100)
    assert [c[0] for c in long_] == list(range(5)) and [(c[3], c[4]) for c in long_][:2] == [(0, 1_000), (1_000, 2_000)]
    head = chunking.chunk_text("# A\n\ntext a\n\n### B\r\n\r\ntext b", 10, 0)
    assert head[-1][2] == ["A", None, "B"] and head[0][2] == ["A"]


def rows_of_chunks(text, size, overlap):
    return [(t, p, a, b) for _, t, p, a, b in chunking.chunk_text(text, size, overlap)]


def test_chunks_of_the_fixture_cases():
    # A long run is sliced; what follows it is a chunk of its own.
    run = "x" * 1_500
    assert rows_of_chunks(f"{run}\n\nshort paragraph", 1_000, 0) == [("x" * 1_000, [], 0, 1_000), ("x" * 500, [], 1_000, 1_500), ("short paragraph", [], 1_502, 1_517)]
    digits = "".join(f"{i:04d}" for i in range(400))
    got = rows_of_chunks(digits, 1_000, 100)
    assert [x[0] for x in got] == [digits[:1_000], f"{digits[900:1_000]}\n\n{digits[1_000:]}"] and [x[2:] for x in got] == [(0, 1_000), (1_000, 1_600)]
    # Ten sections of 500 characters with headings: each heading begins a chunk.
    text = "\n\n".join(f"# S{i}\n\n{'w' * 500}" for i in range(10))
    got = rows_of_chunks(text, 800, 50)
    assert len(got) == 10 and [p for _, p, _, _ in got] == [[f"S{i}"] for i in range(10)] and got[0][0] == f"# S0\n\n{'w' * 500}" and got[1][0] == f"{'w' * 50}\n\n# S1\n\n{'w' * 500}"
    # The tail is the end of the chunk before, without the tail that this one carries.
    parts = [c * 390 for c in "abc"]
    got = rows_of_chunks("\n\n".join(parts), 400, 80)
    assert [x[0] for x in got] == [parts[0], f"{'a' * 80}\n\n{parts[1]}", f"{'b' * 80}\n\n{parts[2]}"]
    # Offsets, also with CRLF and headings of two levels; paragraphs are joined by exactly one blank line.
    assert rows_of_chunks("one two three\n\n\n\nfour five six seven\n\neight", 40, 0) == [("one two three\n\nfour five six seven", [], 0, 36), ("eight", [], 38, 43)]
    assert rows_of_chunks("aa\r\nbb\r\n\r\ncc\rdd", 20, 0) == [("aa\nbb\n\ncc\ndd", [], 0, 12)]
    assert rows_of_chunks("# A\ntext of a\n## B ##\ntext of b", 30, 0) == [("# A\n\ntext of a", ["A"], 0, 13), ("## B ##\n\ntext of b", ["A", "B"], 14, 31)]
    # Skipped levels, leading spaces, a text that begins with the tail, characters beyond the first plane, blank lines of spaces.
    assert rows_of_chunks("# A\n### C\nx", 12, 0) == [("# A", ["A"], 0, 3), ("### C\n\nx", ["A", None, "C"], 4, 11)]
    assert rows_of_chunks("aaaaaa\n\naaabbb", 6, 3) == [("aaaaaa", [], 0, 6), ("aaabbb", [], 8, 14)]
    assert rows_of_chunks("😀😀😀\n\né", 3, 0) == [("😀😀😀", [], 0, 3), ("é", [], 5, 6)]
    assert rows_of_chunks("   x \n \t \ny", 12, 3) == [("x\n\ny", [], 0, 11)]
    for size, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            chunking.chunk_text("x", size, overlap)


def test_offsets_titles_and_excerpts(spark):
    raw = "a\r\nb\r\n\rc"
    df = spark.range(10).select(F.col("id").alias("o"), F.lit(raw).alias("raw"))
    got = {r.o: r.n for r in df.select("o", chunking.rebased_offset(F.col("raw"), F.col("o")).alias("n")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2, 4: 3, 5: 4, 6: 4, 7: 5, 8: 6, 9: 6}
    rows = [("T", ["h", "i"], 0, "0123456789", 3, 5), ("T", None, 4, "0123456789", -1, 5), ("T", [], 0, "0123456789", 20, 25), ("T", [None], 0, "0123456789", None, None)]
    df = spark.createDataFrame(rows, "title string, heading array<string>, n int, text string, a long, b long")
    got = df.select(chunking.chunk_title(F.col("title"), F.col("heading"), F.col("n")), chunking.excerpt(F.col("text"), F.col("a"), F.col("b"), 2)).collect()
    assert [tuple(r) for r in got] == [("T — h › i", "123456"), ("T — part 5", "0123456789"), ("T — part 1", "0123456789"), ("T — ", "0123456789")]


def test_text_functions(spark):
    from loomgraph.functions import text as T

    df = spark.createDataFrame([("Acme-Works", ["AW Ltd.", None, " ", "ab", "acme-works "], "ACME-Works, acme-works; acme-works2 aw ltd. foo foo")], "name string, aliases array<string>, text string")
    r = df.select(T.surfaces(F.col("name"), F.col("aliases")).alias("s"), T.merged_aliases(F.col("aliases"), F.array(F.lit("ab"), F.lit("new")), 4).alias("m")).first()
    assert r.s == ["acme-works", "aw ltd."] and r.m == ["AW Ltd.", "ab", "acme-works", "new"]
    count = lambda s: df.select(T.times_mentioned(F.col("text"), F.lit(s))).first()[0]
    assert [count(s) for s in ("acme-works", "aw ltd.", "foo", "fo", "a.me")] == [2, 1, 2, 0, 0]
    one = df.select(T.vector_id(F.lit("entity"), F.lit("ent:a b")), T.file_id_of(F.lit("doc:f1")), T.file_id_of(F.lit("f1")), T.found_at(F.lit("A  big\nKILN here"), F.lit(" Big kiln ")), T.found_at(F.lit("x"), F.lit("y"))).first()
    assert tuple(one) == ("vec_entity_ent_a_b", "f1", "f1", 2, -1)


def test_phrases_bags_and_groups_in_full_text(spark):
    from loomgraph.operators.search import bm25, cut, documents_by_title, postings

    docs = spark.createDataFrame([(1, "a b", "x", "k", "u"), (2, "b a", "x", "k", "u"), (3, "a", "b c", "doc_summary", "u"), (4, None, "a b a b", "k", "w")], "id int, title string, text string, kind string, universe_id string")
    ask = lambda q, **kw: {r.id: r.score for r in bm25(docs, spark.createDataFrame([(0, q)], "qid int, query string"), 10, **kw).collect()}
    assert set(ask("a/b")) == {1, 4} and set(ask("@@ a/b/c")) == set() and set(ask("ab x/y")) == set()
    one, two = ask("a/b zz"), ask("a/b a/b zz")
    assert all(abs(two[i] - 2 * one[i]) < 2e-6 for i in one)
    index = cut(postings(docs, []))
    assert ask("a/b", index=index) == one and index.count() == 4 + 3 + 3 + 3 + 4
    assert [r.id for r in documents_by_title(docs, spark.createDataFrame([(0, "b/c b/a")], "qid int, query string")).collect()] == [3]
    assert bm25(docs.limit(0), spark.createDataFrame([(0, "a/b")], "qid int, query string"), 3).count() == 0


def test_pairs_of_hot_keys(spark):
    from loomgraph.operators.skew import paired

    left = spark.createDataFrame([("hot", i) for i in range(40)] + [("cold", 1), (None, 2)], "k string, x int")
    right = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 7), (None, 3), ("none", 1)], "k string, y int")
    assert sorted(map(tuple, paired(left, right, ["k"], 7).collect())) == sorted(map(tuple, left.join(right, ["k"]).collect()))


def test_parsers(tmp_path, spark):
    assert files.parse_html("<html><title> T </title><script>no()</script><p>a<br>b&amp;</p></html>", "n") == ("T", "a b&")
    assert files.parse_markdown("---\ntitle: 'X'\nk: v\n---\n# H\nbody", "n") == ("X", "# H\nbody", {"title": "X", "k": "v"})
    assert files.parse_markdown("text\n# H1\n", "n")[0] == "H1" and files.parse_markdown("text", "n")[0] == "n"
    assert files.is_supported("a/README") and files.is_supported("x.PY") and not files.is_supported("x.exe")
    (tmp_path / "a.md").write_text("# Title\n\nbody")
    (tmp_path / "b.exe").write_bytes(b"\x00")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.md"].title == "Title" and got["b.exe"].text is None and "unsupported" in got["b.exe"].error and len(got["a.md"].hash) == 64
    pages = spark.createDataFrame([("d", 2, "cd"), ("d", 1, "abc")], "id string, page int, text string")
    r = files.join_pages(pages, ["id"]).first()
    assert r.text == "abc\n\ncd" and [(p.page, p.p_start, p.p_end) for p in r.pages] == [(1, 0, 3), (2, 5, 7)]


def test_gate_parsers():
    assert guards.parse_loose_json('text ```json\n{"kept": [1]}\n```') == {"kept": [1]} and guards.parse_loose_json("none") is None and guards.parse_loose_json('so {"a": {"b": 1}} it } is') == {"a": {"b": 1}} and guards.parse_loose_json("{ open") is None
    shapes = {"results": [{"source_id": "a", "relevance": " HIGH"}, {"sourceId": "b", "why": 3}, 7, {"sourceId": 5}]}
    assert guards.coerced_verdict(shapes) == [("a", "high", ""), ("b", "medium", "")] and guards.coerced_verdict([1]) is None and guards.coerced_verdict({"kept": 1}) is None
    assert guards.stable_json({"b": 1, "a": [2, {"d": 1, "c": 2}]}) == guards.stable_json({"a": [2, {"c": 2, "d": 1}], "b": 1})


def test_guards_and_verdicts(spark):
    log = [(1, i, "search", "{}") for i in range(5)] + [(1, i, "search", f"{i}") for i in range(5, 9)]
    got = [r.verdict for r in guards.guarded_calls(spark.createDataFrame(log, "turn int, seq int, tool string, args string"), {}).orderBy("seq").collect()]
    assert got == ["ok"] * 3 + ["loop_detected"] * 2 + ["ok"] + ["per_tool_budget_exceeded"] * 3
    rated = spark.createDataFrame([(1, "a", 0), (1, "x", 1), (1, "b", 2), (1, "a", 3), (1, "c", 4)], "turn int, source_id string, pos int")
    items = spark.createDataFrame([(1, s) for s in "abcd"], "turn int, source_id string")
    assert {r.source_id: r.rank for r in guards.shape_verdict(rated, items, 2).collect()} == {"a": 1, "b": 2, "c": None, "d": None}


def test_upserts_and_merges(spark):
    e = "universe_id string, rel string, src string, dst string, count long, predicate string"
    old = spark.createDataFrame([("u", "R", "a", "b", 2, "p"), ("u", "R", "c", "b", 1, None), ("u", "R", "a", "c", 1, None)], e)
    new = spark.createDataFrame([("u", "R", "a", "b", None, "q")], e)
    assert {tuple(r) for r in upsert_edges(old, new).collect()} == {("u", "R", "a", "b", 3, "q"), ("u", "R", "c", "b", 1, None), ("u", "R", "a", "c", 1, None)}
    m = spark.createDataFrame([("u", "c", "a")], "universe_id string, loser string, winner string")
    once = merge_nodes(old, m)
    assert {tuple(r) for r in once.collect()} == {("u", "R", "a", "b", 2, "p")} == {tuple(r) for r in merge_nodes(once, m).collect()}
    n = "universe_id string, id string, type string, label string, aliases array<string>"
    a, b = spark.createDataFrame([("u", "1", "T", "old", ["x", "y"])], n), spark.createDataFrame([("u", "1", None, "", ["y", "z"]), ("u", "2", "T", "n", None)], n)
    assert {tuple(map(str, r)) for r in upsert_nodes(a, b).collect()} == {("u", "1", "T", "", "['x', 'y', 'z']"), ("u", "2", "T", "n", "[]")}


def test_rrf_ties_and_sums(spark):
    lists = [spark.createDataFrame([(0, x, i + 1) for i, x in enumerate(ids)], "q int, id string, rank int") for ids in (["a", "b"], ["c", "a"])]
    assert [(r.id, r.rank) for r in rrf(lists, ["q"], 5).orderBy("rank").collect()] == [("a", 1), ("c", 2), ("b", 3)]


def test_streams(spark, tmp_path):
    (tmp_path / "in" / ".git").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("x")
    (tmp_path / "in" / ".hidden").write_text("x")
    seen = []
    feeds.on_each_batch(feeds.watch_files(spark, str(tmp_path / "in")), lambda df, _: seen.extend(r.path.rsplit("/", 1)[1] for r in df.collect()), str(tmp_path / "ck")).awaitTermination()
    assert seen == ["a.txt"]
    (tmp_path / "in" / "sub").mkdir()
    (tmp_path / "in" / "sub" / "b.tmp").write_text("x")
    (tmp_path / "in" / "sub" / "c.md").write_text("x")
    seen.clear()
    feeds.on_each_batch(feeds.watch_files(spark, str(tmp_path / "in"), exclude=["*.tmp", "**/a.*"]), lambda df, _: seen.extend(r.path.rsplit("/", 1)[1] for r in df.collect()), str(tmp_path / "ck2")).awaitTermination()
    assert seen == ["c.md"]


def test_globs():
    import re

    hits = lambda g, p: bool(re.match(feeds.glob_pattern(g), p))
    assert hits("*.tmp", "/a/b/x.tmp") and hits("sub/**", "/a/sub/c/d") and hits("**/x?.md", "/x1.md") and hits("/a/*.md", "/a/x.md")
    assert not hits("*.tmp", "/a/x.tmp/y") and not hits("sub/*", "/a/sub/c/d") and not hits("x?.md", "/x12.md") and not hits("/a/*.md", "/b/a/x.md")


def test_windowed_calls(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", "view", 1.0), ("2024-01-01 00:09:00", "view", 2.0), ("2024-01-01 00:11:00", "click", 4.0), ("2024-01-01 02:00:00", "view", 8.0)]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    for i in range(2):  # the second file moves the watermark beyond the first windows
        (df if i == 0 else df.filter("value = 8")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = feeds.windowed_calls(stream).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(str(r.window.start), r.event_type, r.calls, r.value) for r in spark.table("windows").collect()} == {("2024-01-01 00:00:00", "view", 2, 3.0), ("2024-01-01 00:10:00", "click", 1, 4.0)}


def test_breaker(spark, tmp_path):
    rows = [("k", 0, False), ("k", 10, False), ("k", 20, True), ("k", 1_800_010, True), ("j", 5, False)]
    spark.createDataFrame(rows, "key string, at long, ok boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = feeds.breaker(spark.readStream.schema("key string, at long, ok boolean").parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("breaker").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("breaker").collect()} == {("k", 0, True), ("k", 10, True), ("k", 20, False), ("k", 1_800_010, True), ("j", 5, True)}


def test_tools(spark):
    e = Engine(spark, SF_DIR)
    top = e.list_entities(5).orderBy(F.desc("n")).first()
    assert e.vector_search("harbour survey", top_k=5).count() == 5 and e.vector_search("kiln", ["doc_summary"], 3, expand_via_graph=True).count() == 3
    assert e.entity_search("valley", 3).count() == 3 and e.find_entity_mentions(top.id).count() >= 1
    doc = e.find_entity_mentions(top.id).first().id
    assert e.graph_navigate(doc).filter(F.col("id") == top.id).first().direction == "out"
    path = e.find_path(top.universe_id, doc, top.id).first()
    assert path.path == [doc, top.id] and "--[MENTIONS]-->" in path.narrative and e.find_path(top.universe_id, doc, "nowhere").count() == 0
    assert e.navigate(doc, "harbour").count() >= 1 and e.find_related_docs(doc).count() >= 0
    assert e.list_domains().count() and e.list_topics(3).count() and e.topic_hierarchy().count()
    summary = e.sample_knowledge(n=2).first().id
    for strategy in ("recent", "random"):
        assert e.sample_knowledge(n=2, strategy=strategy).count() > 0
    source = summary.replace("vec_summary_", "doc:")
    assert e.get_document_summary(source).count() == 1 and e.inspect(source).first().kind == "doc_summary" and e.inspect("nothing").count() == 0
    chunk = spark.read.parquet(f"{SF_DIR}/chunks.parquet").first().id
    assert e.get_chunk(chunk).count() == 1
    assert e.quote(source, "why?", lambda q, t: f"{q} {len(t)}").first().quote == "why? 1"
    assert e.save_agent_note(top.universe_id, "n1", "harbour note", links=[top.id, "gone"]).first().links == [top.id]
    assert e.recall_agent_memory("harbour note").first().id == "n1"
    assert e.note_links().first().dst == top.id and e.get_node(top.id).count() == 1 and e.list_entities(5, "nothing").count() == 0
    e.remove_agent_note("n1")
    assert e.note_links().count() == 0 and Engine(spark, SF_DIR).note_links().count() == 0
    with pytest.raises(ValueError):
        e.list_topics(0)


def test_gated_tools_keep_what_the_judge_keeps(spark):
    asked = []

    def judge(goal, tool, items):
        asked.append((goal, tool, len(items), items[0].text is not None))
        return "\n".join(f"#{i + 1} {'high: fits' if i in (1, 3) else 'drop'}" for i in range(len(items)))

    e = Engine(spark, SF_DIR, judge=judge, goal="the harbour")
    hits = e.vector_search("harbour survey", top_k=5, depth=0)
    ids = [r.id for r in hits.orderBy("rank").collect()]
    rows = e.compact(hits, "vectorSearch").collect()
    assert [(r.source_id, r.relevance, r.why, r["rank"]) for r in rows] == [(ids[1], "high", "fits", 1), (ids[3], "high", "fits", 2)] and "text" not in rows[0] and rows[0].universe_name
    assert asked == [("the harbour", "vectorSearch", 5, True)] and e.inspect(ids[0]).first().from_cache and not Engine(spark, SF_DIR).inspect(ids[0]).first().from_cache
    plain = Engine(spark, SF_DIR)
    assert [r.source_id for r in plain.compact(plain.vector_search("harbour survey", top_k=5, depth=0), "vectorSearch", 2).collect()] == ids[:2]
    node = plain.list_entities(1).first().id
    assert plain.compact(plain.graph_navigate(node), "graphNavigate").count() >= 1 and plain.compact(plain.graph_navigate("nowhere"), "graphNavigate").count() == 0


@pytest.mark.parametrize("hot", [1_000, 3, 0])
def test_most_shared_targets_without_pairing_hot_ones(spark, hot):
    """With ``hot`` 0 no documents are paired at all."""
    from collections import Counter

    from loomgraph.operators import graph as G

    rng = random.Random(8)
    links = {("u" if d % 7 else "w", f"doc:{d:03d}", f"e{min(int(rng.expovariate(0.25)), 25)}") for d in range(60) for _ in range(rng.randrange(1, 6))}
    rows = [(u, "MENTIONS", s, t, 1, None) for u, s, t in sorted(links)] + [("u", "MENTIONS", "chunk:1", "e1", 1, None), ("u", "ABOUT", "doc:001", "e1", 1, None)]
    e = spark.createDataFrame(rows + rows[:5], "universe_id string, rel string, src string, dst string, count long, predicate string")
    want = {}
    for u, a in {(u, s) for u, s, _ in links}:
        shared = Counter(s for v, s, t in links if v == u and s != a and (u, a, t) in links)
        want[u, a] = [(s, n) for s, n in sorted(shared.items(), key=lambda x: (-x[1], x[0]))[:4]]
    got = {}
    for r in G.most_shared(e, "MENTIONS", 4, hot=hot).orderBy("rank").collect():
        got.setdefault((r.universe_id, r.doc), []).append((r.other, r.shared))
    assert got == {k: v for k, v in want.items() if v}
    asked = spark.createDataFrame([("u", "doc:001"), ("u", "doc:404")], "universe_id string, doc string")
    assert [(r.other, r.shared) for r in G.most_shared(e, "MENTIONS", 4, asked, hot).orderBy("rank").collect()] == want["u", "doc:001"]


def test_related_documents_sum_their_channels(spark):
    from loomgraph.operators import graph as G

    rows = [("MENTIONS", "doc:a", "x"), ("MENTIONS", "doc:b", "x"), ("ABOUT", "doc:a", "t"), ("ABOUT", "doc:b", "t"), ("REFERENCES_DOC", "doc:b", "doc:a"), ("REFERENCES_DOC", "doc:c", "doc:a"), ("REFERENCES_DOC", "doc:a", "doc:a")]
    e = spark.createDataFrame([("u", r, s, d, 1, None) for r, s, d in rows], "universe_id string, rel string, src string, dst string, count long, predicate string")
    asked = spark.createDataFrame([("u", "doc:a")], "universe_id string, doc string")
    got = [(r.other, r.score, r.reason) for r in G.related_documents(e, docs=asked).orderBy("rank").collect()]
    assert got == [("doc:b", 3.2, "shared entities; shared topics; cross-document reference"), ("doc:c", 1.5, "cross-document reference")]
    assert G.similar_documents(e, 1).count() == 0 and G.similar_documents(e.filter("rel <> 'REFERENCES_DOC'"), 1).count() == 1
    with pytest.raises(ValueError):
        G.related_documents(e, "friends")


def test_relevance_of_turns(spark):
    from loomgraph.operators import gate

    items = [(turn, s, i) for turn in ("lines", "loose", "none", "strict", "bad", "late") for i, s in enumerate("abcd")] + [("few", "a", 1), ("few", "b", 0), ("few", "a", 5)]
    answers = [
        ("lines", None, "#3 high: first\r\n 1) Mid\n3 low\n2. drop: no\n#4: odd", None), ("loose", "{}", "1 drop", 'x {"kept": [{"sourceId": "d"}], "dropped": []} y'), ("none", None, None, None),
        ("strict", '{"kept": [{"sourceId": "zz", "relevance": "low", "why": ""}, {"sourceId": "c", "relevance": "low", "why": "w"}], "droppedIds": ["a"]}', "1 high", None),
        ("bad", '{"kept": [{"sourceId": "c", "relevance": "good", "why": "w"}]}', "", "nothing"), ("late", '{"kept": []}', "1 high", None), ("few", None, "1 high", None), ("unknown", None, "1 high", None),
    ]
    i = spark.createDataFrame(items, "turn string, source_id string, pos int")
    a = spark.createDataFrame(answers, "turn string, structured string, lines string, prose string")
    got = gate.evaluate_relevance(i, a, 2)
    kept = {}
    for r in got.orderBy("turn", "rank").collect():
        kept.setdefault((r.turn, r.way), []).extend([(r.source_id, r.relevance, r.why)] if r.kept else [])
    few, none = "Too few candidates to judge.", "Kept without a verdict."
    assert kept == {
        ("lines", "lines"): [("c", "high", "first"), ("a", "medium", "Rated medium by its line.")], ("loose", "loose"): [("d", "medium", "")],
        ("none", "fallback"): [("a", "medium", none), ("b", "medium", none)], ("strict", "structured"): [("c", "low", "w")], ("bad", "fallback"): [("a", "medium", none), ("b", "medium", none)],
        ("late", "structured"): [], ("few", "trivial"): [("b", "medium", few), ("a", "medium", few)],
    }
    assert got.count() == 26 and gate.evaluate_relevance(i.limit(0), a).count() == 0
    seen = spark.createDataFrame([(1, "a", 2, "late"), (1, "a", 1, "first"), (2, "a", 3, "x")], "turn int, source_id string, seq int, text string")
    assert {(r.turn, r.text) for r in gate.evidence(seen).collect()} == {(1, "first"), (2, "x")}


def test_citations(spark):
    text = "As [^source:s1] and [^s2], [^source: no] [^].\n\n**Sources:**\n1. [^s9]"
    a = spark.createDataFrame([("m", text), ("n", None), ("o", "plain")], "id string, text string")
    s = spark.createDataFrame([("m", "s2", 4), ("m", "s2", 3), ("x", "s1", 1)], "id string, source_id string, n int")
    assert {tuple(r) for r in guards.cited_sources(a, s).collect()} == {("m", 0, "s1", "?"), ("m", 1, "s2", "3")}
    calls = spark.createDataFrame([(1, 0, 30_000), (2, 0, 30_001), (3, 0, None)], "c int, started long, ended long")
    assert [r.timeout for r in guards.timed_out(calls).orderBy("c").collect()] == [False, True, True]


def store(spark, nodes=(), edges=(), fts=()):
    from loomgraph.operators.sinks import Stored

    return Stored(
        spark.createDataFrame(list(nodes), "universe_id string, id string, type string, label string, aliases array<string>, text string"),
        spark.createDataFrame(list(edges), "universe_id string, rel string, src string, dst string, count long, predicate string"),
        spark.createDataFrame(list(fts), "universe_id string, source_id string, kind string, file_id string, graph_node_id string, title string, text string"),
    )


def analysis(spark, docs, chunks, ents, rels):
    return (
        spark.createDataFrame(docs, "universe_id string, id string, file_id string, title string, summary string, domain string, topics array<string>, keywords array<string>"),
        spark.createDataFrame(chunks, "universe_id string, document string, id string, position int, text string, heading array<string>"),
        spark.createDataFrame(ents, "universe_id string, document string, name string, type string, aliases array<string>, id string"),
        spark.createDataFrame(rels, "universe_id string, document string, kind string, src_name string, dst_name string, predicate string"),
    )


def test_analysis_is_written_and_replaced(spark):
    from loomgraph.operators import sinks

    doc = ("u", "doc:f", "f", "Title", "Sum", "Arts", ["kiln", "big kiln", " "], ["clay"])
    chunks = [("u", "doc:f", "chunk:f:0", 0, "OpenKiln met Ada; Open-Kiln!", ["H", None]), ("u", "doc:f", "chunk:f:1", 1, "nothing", None), ("u", "doc:f", "chunk:f:2", 2, "ada, Ada and adamant", [])]
    ents = [("u", "doc:f", "OpenKiln", "organization", ["Open-Kiln"], None), ("u", "doc:f", "Ada", "person", None, "ent:person:ada_l")]
    rels = [("u", "doc:f", "related", "ada", "OPENKILN ", "Works At!"), ("u", "doc:f", "related", "ada", "nobody", None), ("u", "doc:f", "part_of", "kiln", "Big Kiln", None), ("u", "doc:f", "related", "ada", "Ada", None)]
    once = sinks.write_analysis(store(spark), *analysis(spark, [doc], chunks, ents, rels))
    edges = {(r.rel, r.src, r.dst, r["count"], r.predicate) for r in once.edges.collect()}
    assert edges >= {
        ("MENTIONS", "doc:f", "ent:organization:openkiln", 1, None), ("MENTIONS", "chunk:f:0", "ent:organization:openkiln", 2, None), ("MENTIONS", "chunk:f:0", "ent:person:ada_l", 1, None),
        ("MENTIONS", "chunk:f:2", "ent:person:ada_l", 2, None), ("RELATED", "ent:person:ada_l", "ent:organization:openkiln", 1, "works_at"), ("IN_DOMAIN", "doc:f", "dom:arts", 1, None), ("TAGGED", "doc:f", "kw:clay", 1, None),
    }
    assert {(s, d) for rel, s, d, _, _ in edges if rel == "PART_OF"} == {("top:big_kiln", "top:kiln"), ("top:kiln", "top:big_kiln")}
    assert sum(rel == "MENTIONS" for rel, *_ in edges) == 5 and once.nodes.count() == 1 + 1 + 2 + 1 + 2 + 3
    titles = {r.source_id: r.title for r in once.fts.collect()}
    assert titles == {"doc:f": "Title", "chunk:f:0": "Title — H › ", "chunk:f:1": "Title — part 2", "chunk:f:2": "Title — part 3"}
    # Written again with one chunk: the old chunks go, entities stay with united aliases.
    again = sinks.write_analysis(once, *analysis(spark, [doc[:5] + (None, [], None)], chunks[1:2], [("u", "doc:f", "OpenKiln", "organization", ["OK", "Open-Kiln "], None)], []))
    assert {r.id for r in again.nodes.filter("type = 'Chunk'").collect()} == {"chunk:f:1"} and again.fts.count() == 2
    assert again.nodes.filter("label = 'OpenKiln'").first().aliases == ["Open-Kiln", "OK"] and again.nodes.filter("type = 'Topic'").count() == 2
    assert {(r.rel, r.src, r.dst) for r in again.edges.filter("src like 'doc:%' or src like 'chunk:%'").collect()} == {("MENTIONS", "doc:f", "ent:organization:openkiln"), ("CONTAINS", "doc:f", "chunk:f:1")}
    empty = sinks.write_analysis(once, *(x.limit(0) for x in analysis(spark, [doc], chunks, ents, rels)))
    assert empty.edges.count() == once.edges.count() and empty.nodes.count() == once.nodes.count()


def test_notes_are_saved_and_removed(spark):
    from loomgraph.operators import sinks

    old = store(spark, [("u", "doc:a", "Document", "A", None, None)], [("u", "CONTAINS", "doc:a", "chunk:a", 1, None)])
    notes = spark.createDataFrame([("u", "n1", "x" * 80, "fact", ["doc:a", "gone", "doc:a"]), ("u", "n2", "short", "note", None)], "universe_id string, id string, content string, kind string, links array<string>")
    new = sinks.save_notes(old, notes)
    assert {(r.rel, r.src, r.dst) for r in new.edges.collect()} == {("CONTAINS", "doc:a", "chunk:a"), ("DERIVED_FROM_DOC", "n1", "doc:a")}
    assert new.nodes.filter("id = 'n1'").first().label == "x" * 60 and new.fts.filter("kind = 'agent_note'").count() == 2
    back = sinks.remove_notes(new, notes)
    assert back.nodes.count() == 1 and back.edges.count() == 1 and back.fts.count() == 0


def test_upserts_deletes_and_patches(spark):
    from loomgraph.operators import sinks
    from loomgraph.operators.vectors import as_records, embed_texts

    v = "id string, text string"
    old, new = spark.createDataFrame([("a", "old"), ("a", "older"), ("b", "keep")], v), spark.createDataFrame([("a", "1"), ("a", "2"), ("c", "3")], v)
    assert sorted(tuple(r) for r in sinks.upsert_vectors(old, new).collect()) == [("a", "1"), ("a", "2"), ("b", "keep"), ("c", "3")]
    with pytest.raises(ValueError):
        sinks.upsert_vectors(old, new, cap=2)
    for bad in ("no space", None, "a'b"):
        with pytest.raises(Exception, match="malformed id"):
            sinks.upsert_vectors(old, spark.createDataFrame([(bad, "x")], v)).collect()
    assert sinks.replace_rows(old, new, ["id"], [F.col("text")]).filter("id = 'a'").first().text == "2"
    assert sinks.patched(old, spark.createDataFrame([("b", None), ("z", "x"), ("a", "n")], v), ["id"]).filter("id <> 'a'").first().text == "keep"
    j = spark.createDataFrame([('{"a": 1, "b": {"c": [2]}}',), ("no json",), (None,)], "p string")
    got = j.select(sinks.json_set(F.col("p"), "a", F.lit("x")).alias("s"), sinks.json_field(F.col("p"), "b").alias("f")).collect()
    assert [tuple(r) for r in got] == [('{"b":{"c":[2]},"a":"x"}', '{"c":[2]}'), ('{"a":"x"}', None), ('{"a":"x"}', None)]
    assert sinks.quote_literal("it's") == "'it''s'"
    for bad in (3, "a\0b", None):
        with pytest.raises(ValueError):
            sinks.quote_literal(bad)
    r = as_records(spark.createDataFrame([("i", [1.0, None], None, 9)], "id string, vector array<double>, keywords array<string>, extra int")).first()
    assert len(r) == 13 and r.vector == [1.0] and r.keywords == [] and r.title == "" and r.created_at == 0
    texts = spark.createDataFrame([(i, None if i == 2 else f"t{i}") for i in range(5)], "id int, text string")
    e = {r.id: r.v for r in embed_texts(texts, lambda b: [[len(b), len(t)] for t in b], "query", batch=3).collect()}
    assert e[2] is None and e[0][1] == len("query: t0") and embed_texts(texts.limit(0), lambda b: 1 / 0).count() == 0


def test_expansion_to_depth_two(spark):
    from loomgraph.operators.ranking import expand, hydrate

    e = spark.createDataFrame([("u", "MENTIONS", "doc:a", "e", 3, None), ("u", "MENTIONS", "doc:b", "e", 1, None), ("u", "TAGGED", "doc:a", "k", 1, None), ("u", "ABOUT", "doc:b", "t", 1, None)], "universe_id string, rel string, src string, dst string, count long, predicate string")
    fused = spark.createDataFrame([("u", "doc:a", 0.5)], "universe_id string, id string, score double")
    recs = spark.createDataFrame([("u", i, [1.0, 0.0]) for i in ("doc:a", "doc:b", "e", "t", "k")], "universe_id string, id string, v array<double>")
    q = spark.createDataFrame([("u", [1.0, 0.0])], "universe_id string, qv array<double>")
    n = spark.createDataFrame([("u", "e", 0.5)], "universe_id string, id string, centrality double")
    run = lambda depth: {r.id: r.score for r in expand(fused, e, recs, q, n, ["universe_id"], depth=depth).collect()}
    import math

    near = round(0.4 * 0.5 * 0.5 * min(2, 1 + 0.3 * math.log(4) + 0.3), 9)
    assert run(0) == {"doc:a": 0.5} and run(1) == {"doc:a": 0.5, "e": near}
    # At two steps the far edge counts for its source, the other document; its topic is three steps away.
    assert run(2) == {"doc:a": 0.5, "e": near, "doc:b": round(0.4 * 0.5 * 0.1 * min(2, 1 + 0.3 * math.log(2) + 0.3), 9)}
    hits = spark.createDataFrame([("u", "s1", "chunk", "T"), ("u", "s2", "chunk", "T")], "universe_id string, source_id string, kind string, title string")
    known = spark.createDataFrame([("u", "s1", "r2", "topic", "d", ["x"], None, 5), ("u", "s1", "r1", "entity", "d", ["x"], None, 5)], "universe_id string, source_id string, id string, kind string, domain string, topics array<string>, keywords array<string>, created_at long")
    assert {(r.source_id, r.kind, r.domain, r.created_at) for r in hydrate(hits, known).collect()} == {("s1", "entity", "d", 5), ("s2", "chunk", "", 0)}


def test_samples_against_brute_force(spark):
    import numpy as np

    from loomgraph.operators.vectors import sample_diverse, sample_random, sample_recent

    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 8))
    rows = [("u", f"r{i:02d}", int(i * 37 % 60), x[i].tolist()) for i in range(60)] + [("w", "only", 1, x[0].tolist())]
    df = spark.createDataFrame(rows, "k string, id string, created_at long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = [0]
    while len(want) < 6:  # of the first 30, each the one whose nearest chosen one is farthest
        want.append(min((i for i in range(30) if i not in want), key=lambda i: (max(u[i] @ u[j] for j in want), i)))
    got = sample_diverse(df, 6, ["k"]).orderBy("turn").collect()
    assert [int(r.id[1:]) for r in got if r.k == "u"] == want and [r.id for r in got if r.k == "w"] == ["only"]
    recent = [r.id for r in sample_recent(df.filter("k = 'u'"), 4, ["k"]).orderBy("rank").collect()]
    assert recent == sorted((f"r{i:02d}" for i in range(8)), key=lambda s: -(int(s[1:]) * 37 % 60))[:4]
    drawn = {r.id for r in sample_random(df, 4, ["k"], 1).filter("k = 'u'").collect()}
    assert len(drawn) == 4 and drawn <= {f"r{i:02d}" for i in range(8)} and drawn == {r.id for r in sample_random(df, 4, ["k"], 1).filter("k = 'u'").collect()}


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_nearest_by_matrix_and_by_join(spark, metric, monkeypatch):
    """Both ways agree, with keys, ties, zero vectors, nulls and other lengths."""
    from loomgraph.operators import vectors as V

    rows = [("u" if i % 3 else "w", f"r{i:02d}", [float(i % 5), 1.0 + i % 2]) for i in range(40)] + [("u", "zero", [0.0, 0.0]), ("u", "none", None), ("u", "hole", [None, 1.0]), (None, "x", [1.0, 1.0])]
    rec = spark.createDataFrame(rows, "g string, id string, v array<double>")
    asked = spark.createDataFrame([("u", 1, [1.0, 0.5]), ("w", 1, [0.0, 1.0]), ("w", 2, [2.0, 1.0]), ("z", 3, [1.0, 1.0])], "g string, qid int, qv array<double>")
    get = lambda k: sorted(map(tuple, V.knn(rec, asked, k, metric, ["g"]).select("g", "qid", "rank", "id", "score").collect()))
    plain = lambda k: sorted(map(tuple, V.knn(rec.drop("g"), asked.drop("g").filter("qid <> 1"), k, metric).select("qid", "rank", "id", "score").collect()))
    found = [get(7), get(60), plain(7)]
    monkeypatch.setattr(V, "MATRIX_QUERIES", 0)
    assert [get(7), get(60), plain(7)] == found and len(found[0]) == 21
    assert V.knn(rec.limit(0), asked, 3, metric, ["g"]).count() == 0 and V.knn(rec, asked.limit(0), 3, metric, ["g"]).count() == 0
