"""Queries of ingestion, upkeep, text functions, guards and chats."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.functions import chunking
from loomgraph.functions.text import node_slug, predicate_name, shorten, strip_space
from loomgraph.operators import consolidate as C
from loomgraph.operators import graph as G
from loomgraph.operators.guards import cited_sources, guarded_calls
from loomgraph.session import table
from loomgraph.sources.files import file_changes
from loomgraph.sources.knowledge import _S, GRAPH_SQL, edges, predicate_sql, slug_sql, squeeze_sql

QUERIES, ORACLES = {}, {}


def _query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_LATEST = """SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings"""
_DOT = "list_dot_product(a.v, b.v)"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))


@_query("single_link_clusters", f"""WITH RECURSIVE e AS MATERIALIZED ({_LATEST}), p AS MATERIALIZED (SELECT a.label, a.id AS x, b.id AS y FROM e a JOIN e b ON a.label = b.label AND a.id <> b.id WHERE {_DOT} >= 0.35),
  r AS (SELECT label, x AS root, x AS id FROM p UNION SELECT r.label, r.root, p.y FROM r JOIN p ON p.label = r.label AND p.x = r.id) SELECT label, id, min(root) AS cluster FROM r GROUP BY ALL""")
def single_link_clusters(spark, d):
    return C.single_link(C.similar_pairs(_vectors(spark, d), 0.35, ["label"]), ["label"])


@_query("merge_entities", f"""WITH RECURSIVE e AS MATERIALIZED ({_LATEST}), p AS MATERIALIZED (SELECT a.label, a.id AS x, b.id AS y FROM e a JOIN e b ON a.label = b.label AND a.id <> b.id WHERE {_DOT} >= 0.35),
  r AS (SELECT label, x AS root, x AS id FROM p UNION SELECT r.label, r.root, p.y FROM r JOIN p ON p.label = r.label AND p.x = r.id), c AS (SELECT label, id, min(root) AS cluster FROM r GROUP BY ALL),
  g AS (SELECT label, x AS id, count(*) AS degree FROM p GROUP BY ALL), w AS (SELECT label, cluster, c.id AS winner FROM c JOIN g USING (label, id) QUALIFY row_number() OVER (PARTITION BY label, cluster ORDER BY degree DESC, c.id) = 1)
  SELECT label, id AS loser, winner FROM c JOIN w USING (label, cluster) WHERE id <> winner""")
def merge_entities(spark, d):
    pairs = C.similar_pairs(_vectors(spark, d), 0.35, ["label"])
    degree = pairs.select("label", F.explode(F.array("a", "b")).alias("id")).groupBy("label", "id").agg(F.count(F.lit(1)).alias("degree"))
    return C.canonical(C.single_link(pairs, ["label"]), degree, ["label"])


@_query("cluster_topics_part_of", f"""WITH RECURSIVE {GRAPH_SQL}, t AS MATERIALIZED (SELECT universe_id, source_id AS id, max(vector)::DOUBLE[] AS v FROM vector_records WHERE kind = 'topic' AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY ALL),
  p AS MATERIALIZED (SELECT a.universe_id, a.id AS x, b.id AS y FROM t a JOIN t b ON a.universe_id = b.universe_id AND a.id <> b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.85),
  r AS (SELECT universe_id, x AS root, x AS id FROM p UNION SELECT r.universe_id, r.root, p.y FROM r JOIN p ON p.universe_id = r.universe_id AND p.x = r.id), c AS (SELECT universe_id, id, min(root) AS cluster FROM r GROUP BY ALL)
  SELECT universe_id, id AS src, cluster AS dst FROM c WHERE id <> cluster AND NOT EXISTS (FROM edges e WHERE e.rel = 'PART_OF' AND e.universe_id = c.universe_id AND e.src = c.id AND e.dst = c.cluster)""")
def cluster_topics_part_of(spark, d):
    v = F.col("vector")
    ok = (F.size(v) == 64) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    t = table(spark, d, "vector_records").filter((F.col("kind") == "topic") & ok)
    t = t.groupBy("universe_id", F.col("source_id").alias("id")).agg(F.max("vector").alias("v"))
    return C.part_of_links(C.single_link(C.similar_pairs(t, 0.85, ["universe_id"], "cosine"), ["universe_id"]), edges(spark, d, "PART_OF"), ["universe_id"])


@_query("resolve_entities", f"""WITH e AS MATERIALIZED ({_LATEST}), s AS (SELECT a.label, a.id, b.id AS kid, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM e a JOIN e b ON a.label = b.label AND a.id <> b.id),
  b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY label, id ORDER BY s DESC, kid DESC) = 1)
  SELECT e.label, e.id, CASE WHEN b.s >= 0.3 THEN kid ELSE e.id END AS resolved, coalesce(b.s >= 0.3, false) AS merged FROM e LEFT JOIN b USING (label, id)""")
def resolve_entities(spark, d):
    v = _vectors(spark, d)  # every record is resolved against all others of its label
    return C.resolve(v, v, 0.3, ["label"], others=True)


@_query("consolidation_due", "SELECT universe_id, count(*) AS documents FROM files WHERE ingested_at > 1735689600000 GROUP BY universe_id HAVING count(*) >= 10")
def consolidation_due(spark, d):
    docs = table(spark, d, "files").filter(F.col("ingested_at").isNotNull())
    runs = table(spark, d, "universes").select(F.col("id").alias("universe_id"), F.lit(1735689600000).alias("ran_at"))
    return C.consolidation_due(docs, runs)


@_query("slugify", f"SELECT relation_id, {slug_sql('src_name')} AS slug FROM relations")
def slugify(spark, d):
    return table(spark, d, "relations").select("relation_id", node_slug(F.trim("src_name")).alias("slug"))


@_query("normalize_predicate", f"SELECT relation_id, {predicate_sql('predicate')} AS predicate FROM relations")
def normalize_predicate(spark, d):
    return table(spark, d, "relations").select("relation_id", predicate_name(F.col("predicate")).alias("predicate"))


@_query("topic_is_part_of", f"""WITH w AS (SELECT DISTINCT universe_id, name, string_split(name, ' ') AS ws FROM (SELECT universe_id, {squeeze_sql("t")} AS name FROM (SELECT universe_id, title AS t FROM vector_records WHERE kind = 'topic'
    UNION ALL SELECT universe_id, unnest(topics) FROM vector_records WHERE kind = 'doc_summary' UNION ALL SELECT universe_id, unnest(keywords) FROM vector_records WHERE kind = 'doc_summary')) WHERE name <> '')
  SELECT DISTINCT a.universe_id, a.name AS longer, b.name AS shorter FROM w a JOIN w b ON a.universe_id = b.universe_id WHERE len(b.ws) < len(a.ws) AND len(a.ws) >= 2 AND list_has_all(a.ws, b.ws)""")
def topic_is_part_of(spark, d):
    """Names of topics and keywords whose words are all in a longer name. They meet through the shorter one's first word, not pair by pair."""
    from loomgraph.functions.text import squeeze

    v = table(spark, d, "vector_records")
    summaries = v.filter(F.col("kind") == "doc_summary")
    t = v.filter(F.col("kind") == "topic").select("universe_id", F.col("title").alias("t"))
    for c in ("topics", "keywords"):
        t = t.unionByName(summaries.select("universe_id", F.explode(c).alias("t")))
    t = t.select("universe_id", squeeze(F.col("t")).alias("name")).filter("name <> ''").distinct().withColumn("ws", F.split("name", " "))
    a = t.select("universe_id", F.col("name").alias("longer"), F.col("ws").alias("wa"), F.explode(F.array_distinct("ws")).alias("w")).filter(F.size("wa") >= 2)
    b = t.select("universe_id", F.col("name").alias("shorter"), F.col("ws").alias("wb"), F.element_at("ws", 1).alias("w"))
    inside = (F.size(F.array_except("wb", "wa")) == 0) & (F.size("wb") < F.size("wa"))
    return a.join(b, ["universe_id", "w"]).filter(inside).select("universe_id", "longer", "shorter").distinct()


@_query("chunk_documents")
def chunk_documents(spark, d):
    return chunking.chunk_documents(table(spark, d, "documents"), "doc_id").select("doc_id", "position", "text", "start_offset", "end_offset")


@_query("page_range_overlap", """SELECT DISTINCT file_id, start_offset, end_offset, start_offset // 2000 + 1 AS page_start, (end_offset - 1) // 2000 + 1 AS page_end FROM chunks WHERE end_offset > start_offset AND start_offset >= 0""")
def page_range_overlap(spark, d):
    c = table(spark, d, "chunks").filter("end_offset > start_offset AND start_offset >= 0").select("file_id", "start_offset", "end_offset").distinct()
    last = c.groupBy("file_id").agg(F.max("end_offset").alias("last"))
    pages = last.withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("last") - 1) / 2000)))).select("file_id", (F.col("n") + 1).alias("page"), (F.col("n") * 2000).alias("p_start"), ((F.col("n") + 1) * 2000).alias("p_end"))
    return chunking.page_ranges(c, pages, ["file_id"]).withColumn("page_start", F.col("page_start").cast("long")).withColumn("page_end", F.col("page_end").cast("long"))


@_query("excerpt_context", """SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, greatest(0, 500 - 400) + 1, least(length(text), length(text) // 2 + 500 + 400) - greatest(0, 500 - 400)) ELSE text END AS excerpt FROM documents""")
def excerpt_context(spark, d):
    """From character 500 on; shorter texts come out whole."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", chunking.excerpt(t, F.lit(500), F.floor(F.length(t) / 2) + 500).alias("excerpt"))


@_query("llm_slices", "SELECT doc_id, i AS slice, substr(text, i * 18000 + 1, 18000) AS part FROM (SELECT doc_id, text, unnest(range(0, ((length(text) - 1) // 18000) + 1)) AS i FROM documents WHERE length(text) > 24000) UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) <= 24000")
def llm_slices(spark, d):
    t = table(spark, d, "documents").filter(F.col("text").isNotNull())
    return t.select("doc_id", F.posexplode(chunking.slices(F.col("text"))).alias("slice", "part")).withColumn("slice", F.col("slice").cast("long"))


@_query("sha256_dedupe", "SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def sha256_dedupe(spark, d):
    t = table(spark, d, "documents").filter(F.col("text").isNotNull())
    return t.groupBy(F.sha2("text", 256).alias("hash")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first")).filter("copies > 1")


@_query("cdc_diff", """WITH s AS (SELECT universe_id, abs_path, max(hash) AS hash FROM files WHERE mtime >= 1735689600000 GROUP BY ALL), k AS (SELECT universe_id, abs_path, min(hash) AS hash, min(status) AS status FROM files WHERE status <> 'pending' GROUP BY ALL)
  SELECT coalesce(s.universe_id, k.universe_id) AS universe_id, coalesce(s.abs_path, k.abs_path) AS abs_path, CASE WHEN s.abs_path IS NULL THEN 'removed' WHEN k.abs_path IS NULL THEN 'new' WHEN coalesce(s.hash = k.hash AND status = 'indexed', false) THEN 'unchanged' ELSE 'changed' END AS action
  FROM s FULL JOIN k ON s.universe_id = k.universe_id AND s.abs_path = k.abs_path""")
def cdc_diff(spark, d):
    f = table(spark, d, "files")
    snapshot = f.filter("mtime >= 1735689600000").groupBy("universe_id", "abs_path").agg(F.max("hash").alias("hash"))
    known = f.filter("status <> 'pending'").groupBy("universe_id", "abs_path").agg(F.min("hash").alias("hash"), F.min("status").alias("status"))
    return file_changes(snapshot, known)


@_query("files_filter", "SELECT universe_id, id, rel_path FROM files WHERE status = 'indexed' AND rel_path ILIKE '%harbour%'")
def files_filter(spark, d):
    return table(spark, d, "files").filter((F.col("status") == "indexed") & F.col("rel_path").ilike("%harbour%")).select("universe_id", "id", "rel_path")


@_query("universe_stats", """SELECT u.id, count(DISTINCT f.id) AS files, max(f.ingested_at) AS last_sync FROM universes u LEFT JOIN files f ON f.universe_id = u.id GROUP BY u.id""")
def universe_stats(spark, d):
    f = table(spark, d, "files").select(F.col("universe_id").alias("u"), F.col("id").alias("f"), "ingested_at").groupBy("u").agg(F.count_distinct("f").alias("files"), F.max("ingested_at").alias("last_sync"))
    u = table(spark, d, "universes").select("id")
    return u.join(f, F.col("id") == F.col("u"), "left").select("id", F.coalesce("files", F.lit(0).cast("long")).alias("files"), "last_sync")


@_query("get_chunk", """SELECT DISTINCT c.id, c.file_id, c.position_no, s.title FROM chunks c LEFT JOIN (SELECT file_id, max(title) AS title FROM vector_records WHERE kind = 'doc_summary' GROUP BY file_id) s USING (file_id)""")
def get_chunk(spark, d):
    s = table(spark, d, "vector_records").filter("kind = 'doc_summary'").groupBy("file_id").agg(F.max("title").alias("title"))
    return table(spark, d, "chunks").select("id", "file_id", "position_no").join(s, "file_id", "left").select("id", "file_id", "position_no", "title").distinct()


@_query("guard_empty_documents", "SELECT doc_id, CASE WHEN length(trim(coalesce(text, ''))) < 20 THEN 'failed' ELSE 'indexed' END AS status FROM documents")
def guard_empty_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.when(F.length(F.trim(F.coalesce("text", F.lit("")))) < 20, "failed").otherwise("indexed").alias("status"))


@_query("agent_guard_budgets", """WITH c AS (SELECT user_id AS turn, event_id AS seq, event_type AS tool, props AS args, count(*) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS nt, count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS na FROM events),
  e AS (SELECT *, CASE WHEN nt > CASE tool WHEN 'view' THEN 8 ELSE 6 END THEN 'per_tool_budget_exceeded' WHEN na > 18 AND tool IN ('view', 'click') THEN 'soft_total_budget_exceeded' END AS early FROM c)
  SELECT turn, seq, tool, coalesce(early, CASE WHEN sum(CASE WHEN early IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY turn, tool, args ORDER BY seq) > 1 THEN 'loop_detected' END, 'ok') AS verdict FROM e""")
def agent_guard_budgets(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("turn"), F.col("event_id").alias("seq"), F.col("event_type").alias("tool"), F.col("props").alias("args"))
    return guarded_calls(log, {"view": 8}, heavy=["view", "click"], repeats=1)


@_query("loop_fingerprints", "SELECT user_id AS turn, event_type AS tool, props AS args, count(*) AS calls FROM events GROUP BY ALL HAVING count(*) > 1")
def loop_fingerprints(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("turn"), F.col("event_type").alias("tool"), F.col("props").alias("args")).agg(F.count(F.lit(1)).alias("calls")).filter("calls > 1")


_TRIMMED = f"regexp_replace(chat_id, '^{_S}+|{_S}+$', '', 'g')"


@_query("chat_list_counts", f"SELECT c.id, c.title, count(DISTINCT m.id) AS messages FROM chats c LEFT JOIN messages m ON {_TRIMMED} = c.id GROUP BY ALL")
def chat_list_counts(spark, d):
    n = table(spark, d, "messages").groupBy(strip_space(F.col("chat_id")).alias("chat_id")).agg(F.count_distinct("id").alias("messages"))
    c = table(spark, d, "chats").select("id", "title")
    return c.join(n, c["id"] == n["chat_id"], "left").select("id", "title", F.coalesce("messages", F.lit(0).cast("long")).alias("messages"))


@_query("chat_branch", f"""WITH m AS (SELECT id, {_TRIMMED} AS chat_id, role, created_at FROM messages WHERE chat_id IS NOT NULL AND created_at IS NOT NULL),
  b AS (SELECT chat_id, max(created_at) AS upto FROM m WHERE role = 'user' GROUP BY chat_id) SELECT DISTINCT m.id, m.chat_id FROM m JOIN b USING (chat_id) WHERE m.created_at <= b.upto""")
def chat_branch(spark, d):
    """Every chat branched at the user's last message: it and all that was before."""
    m = table(spark, d, "messages").select("id", strip_space(F.col("chat_id")).alias("chat_id"), "role", "created_at")
    chosen = m.filter("role = 'user'").groupBy("chat_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))
    return C.branched(m, chosen).select("id", "chat_id").distinct()


@_query("last_user_goal", "SELECT chat_id, arg_max(content, {'t': created_at, 'i': id, 'c': content}) AS goal FROM messages WHERE role = 'user' AND chat_id IS NOT NULL AND created_at IS NOT NULL AND content IS NOT NULL GROUP BY chat_id")
def last_user_goal(spark, d):
    m = table(spark, d, "messages").filter("role = 'user' AND chat_id IS NOT NULL AND created_at IS NOT NULL AND content IS NOT NULL")
    return m.groupBy("chat_id").agg(F.max_by("content", F.struct("created_at", "id", "content")).alias("goal"))


@_query("chat_title", r"SELECT DISTINCT id, substr(split_part(content, chr(10), 1), 1, 60) AS title FROM messages WHERE content IS NOT NULL")
def chat_title(spark, d):
    return table(spark, d, "messages").filter("content IS NOT NULL").select("id", F.substring(F.substring_index("content", "\n", 1), 1, 60).alias("title")).distinct()


_SAID = r"""content || ' See [^source:' || coalesce(json_extract_string(sources, '$[0].id'), 'none') || '], [^s' || length(content) % 7 || '] and [^source: no].' || chr(10) || chr(10) || '## Sources' || chr(10) || '- [^source:hidden]'"""


@_query("citation_extract", rf"""WITH m AS (SELECT DISTINCT id, content, sources FROM messages WHERE content IS NOT NULL AND id IS NOT NULL), n AS (SELECT id, content, sources FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(content) DESC, content DESC, sources DESC NULLS LAST) = 1),
  k AS (SELECT id, s.id AS cited, min(i) AS n FROM (SELECT id, unnest(x) AS s, unnest(range(1, len(x) + 1)) AS i FROM (SELECT id, from_json(sources, '[{{"id":"VARCHAR"}}]') AS x FROM n WHERE sources IS NOT NULL)) GROUP BY ALL),
  c AS (SELECT id, unnest(x) AS cited, unnest(range(0, len(x))) AS place FROM (SELECT id, regexp_extract_all(split_part({_SAID}, chr(10) || chr(10) || '## Sources', 1), '\[\^(?:source:)?([^\]\s]+)\]', 1) AS x FROM n))
  SELECT c.id, c.place::INT AS place, c.cited, coalesce(k.n::VARCHAR, '?') AS mark FROM c LEFT JOIN k USING (id, cited)""")
def citation_extract(spark, d):
    """Answers that cite their first source, another one and, in a list at the end that doesn't count, a third."""
    m = table(spark, d, "messages").filter("content IS NOT NULL AND id IS NOT NULL")
    one = m.groupBy("id").agg(F.max(F.struct(F.length("content").alias("n"), "content", "sources")).alias("m")).select("id", "m.content", "m.sources")
    listed = one.select("id", F.posexplode(F.from_json("sources", "array<struct<id:string>>")).alias("n", "s")).select("id", F.col("s.id").alias("source_id"), (F.col("n") + 1).alias("n"))
    first = F.coalesce(F.get_json_object("sources", "$[0].id"), F.lit("none"))
    said = F.concat("content", F.lit(" See [^source:"), first, F.lit("], [^s"), (F.length("content") % 7).cast("string"), F.lit("] and [^source: no].\n\n## Sources\n- [^source:hidden]"))
    return cited_sources(one.select("id", said.alias("text")), listed)


@_query("hint_truncate", "SELECT doc_id, CASE WHEN length(title) > 18 THEN substr(title, 1, 17) || '…' ELSE title END AS hint FROM documents WHERE title IS NOT NULL")
def hint_truncate(spark, d):
    return table(spark, d, "documents").filter("title IS NOT NULL").select("doc_id", shorten(F.col("title"), 18).alias("hint"))


@_query("session_turns", "SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS turn FROM events")
def session_turns(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy("event_id")).alias("turn"))


__all__ = ["QUERIES", "ORACLES", "G"]
