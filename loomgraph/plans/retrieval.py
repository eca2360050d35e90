"""Queries of retrieval: full text, vectors, fusion, expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.engine import hashed_embedding
from loomgraph.operators import graph as G
from loomgraph.operators.ranking import across_universes, best_sources, expand, hybrid_search, linked_references, rrf
from loomgraph.operators.search import bm25, match_expression
from loomgraph.operators.skew import sent_if_small
from loomgraph.operators.vectors import knn, running_mean, sample_diverse, sample_recent, usable
from loomgraph.session import table
from loomgraph.sources.knowledge import GRAPH_SQL, edges, latest_vectors, nodes

#: The queries asked, a stated small set.
ASKED = ["harbour survey of the northern warehouse", "indexing run: pottery (kiln)", "grading timber harvest", "relation between alloys and fatigue", "the archive structure of cards cards"]

QUERIES, ORACLES = {}, {}


def _query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _asked(spark):
    return spark.createDataFrame(list(enumerate(ASKED)), "qid int, query string")


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "title", "text", F.col("mime").alias("kind"), "universe_id")


_ASK = "asked AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(ASKED)) + ") v(qid, query))"
_TERMS = r"list_filter(string_split_regex(strip_accents(lower(coalesce({c}, ''))), '[^\p{{L}}\p{{N}}_.\-]+'), lambda t: t <> '')"
_BM25 = rf"""{_ASK}, words AS (SELECT qid, unnest(string_split_regex(regexp_replace(query, '["''*^:()\-]', ' ', 'g'), '\s+')) AS w FROM asked),
q AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({_TERMS.format(c="w")}) AS term FROM words WHERE length(w) > 1) GROUP BY ALL),
d AS MATERIALIZED (SELECT doc_id AS id, universe_id, mime AS kind, {_TERMS.format(c="title")} || {_TERMS.format(c="text")} AS ts FROM documents),
st AS (SELECT count(*) AS n, avg(len(ts)) AS av FROM d),
tf AS (SELECT id, kind, len, term, count(*) AS f FROM (SELECT id, kind, len(ts) AS len, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT id, kind, term, CASE WHEN n > 2 * df THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / av)) AS s FROM tf JOIN dfs USING (term), st),
fts AS (SELECT qid, id, kind, round(sum(s * times), 6) AS score FROM s JOIN q USING (term) GROUP BY ALL)"""


@_query("bm25_search", f"WITH {_BM25} SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM fts QUALIFY rank <= 10")
def bm25_search(spark, d):
    return bm25(_docs(spark, d), _asked(spark), 10)


@_query("bm25_kind_filter", f"WITH {_BM25} SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM fts WHERE kind IN ('text/markdown', 'application/pdf') QUALIFY rank <= 10")
def bm25_kind_filter(spark, d):
    return bm25(_docs(spark, d), _asked(spark), 10, kinds=["text/markdown", "application/pdf"])


@_query("fts_sanitize", r"""SELECT id, string_agg('"' || w || '"', ' OR ' ORDER BY i) AS expression FROM (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
  SELECT id, list_filter(string_split_regex(regexp_replace(title, '["''*^:()\-]', ' ', 'g'), '\s+'), lambda w: length(w) > 1) AS ws FROM chats)) GROUP BY id""")
def fts_sanitize(spark, d):
    return table(spark, d, "chats").select("id", match_expression(F.col("title")).alias("expression")).filter("expression <> ''")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))


def _asked_vectors(spark, d):
    """Every row whose id is divisible by 50 is asked against all rows."""
    return _vectors(spark, d).filter(F.col("id") % 50 == 0).select(F.col("id").cast("int").alias("qid"), F.col("v").alias("qv"))


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_KNN = f"vec AS (SELECT b.vec_id AS qid, a.vec_id AS id, a.label, round({_COS}, 9) AS score FROM embeddings a JOIN embeddings b ON b.vec_id % 50 = 0)"


@_query("knn_topk", f"WITH {_KNN} SELECT qid::INT AS qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM vec QUALIFY rank <= 10")
def knn_topk(spark, d):
    return knn(_vectors(spark, d), _asked_vectors(spark, d), 10)


@_query("knn_filtered", f"WITH {_KNN} SELECT qid::INT AS qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM vec WHERE label IN (1, 3) AND id NOT IN (0, 1, 2) QUALIFY rank <= 10")
def knn_filtered(spark, d):
    kept = _vectors(spark, d).filter(F.col("label").isin(1, 3) & ~F.col("id").isin(0, 1, 2))
    return knn(kept, _asked_vectors(spark, d), 10)


@_query("knn_l2_score", f"WITH v AS (SELECT b.vec_id AS qid, a.vec_id AS id, round(1 - list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)), 9) AS score FROM embeddings a JOIN embeddings b ON b.vec_id % 50 = 0) SELECT qid::INT AS qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM v QUALIFY rank <= 10")
def knn_l2_score(spark, d):
    return knn(_vectors(spark, d), _asked_vectors(spark, d), 10, "l2")


@_query("running_mean_update", """SELECT a.vec_id AS id, round(list_sum(list_transform(m, lambda x: x * x)), 6) AS length, round(m[1] / sqrt(list_sum(list_transform(m, lambda x: x * x))), 6) AS first FROM (
  SELECT a.vec_id, list_transform(list_zip(a.embedding, b.embedding), lambda p: 0.6::DOUBLE * p[1] + 0.4::DOUBLE * p[2]) AS m FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) a""")
def running_mean_update(spark, d):
    a = _vectors(spark, d)
    b = a.select((F.col("id") - 1).alias("id"), F.col("v").alias("v2"))
    both = a.join(b, "id")
    mixed = F.aggregate(F.zip_with("v", "v2", lambda x, y: x.cast("double") * 0.6 + y.cast("double") * 0.4), F.lit(0.0), lambda s, x: s + x * x)
    return both.select("id", F.round(mixed, 6).alias("length"), F.round(running_mean(F.col("v"), F.col("v2"))[0], 6).alias("first"))


def _summaries(spark, d):
    return table(spark, d, "vector_records").filter(F.col("kind") == "doc_summary").groupBy("universe_id", "id").agg(F.max("created_at").alias("created_at"), F.max("vector").alias("v"))


@_query("sample_recent", """WITH r AS (SELECT universe_id, id, max(created_at) AS created_at FROM vector_records WHERE kind = 'doc_summary' GROUP BY ALL),
  p AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY universe_id ORDER BY id) <= 12)
  SELECT universe_id, id, row_number() OVER (PARTITION BY universe_id ORDER BY created_at DESC, id) AS rank FROM p QUALIFY rank <= 6""")
def sample_recent_query(spark, d):
    return sample_recent(_summaries(spark, d), 6, ["universe_id"]).select("universe_id", "id", "rank")


@_query("sample_diverse")
def sample_diverse_query(spark, d):
    return sample_diverse(_summaries(spark, d).filter(F.size("v") == 64), 6, ["universe_id"])


_RANKED = """, l1 AS (SELECT a.qid::BIGINT AS qid, v.qid AS vid, id, rank FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM vec QUALIFY rank <= 20) v, asked a),
l2 AS (SELECT qid::BIGINT AS qid, vid, id, rank FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM fts QUALIFY rank <= 20), (SELECT DISTINCT qid AS vid FROM vec)),
u AS (SELECT *, 0 AS list FROM l1 UNION ALL SELECT *, 1 FROM l2),
f AS (SELECT qid, vid, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min({'l': list, 'r': rank}) AS first FROM u GROUP BY ALL)"""


@_query("rrf_hybrid", f"WITH {_BM25}, {_KNN}{_RANKED} SELECT qid::INT AS qid, vid::INT AS vid, id, score, row_number() OVER (PARTITION BY qid, vid ORDER BY score DESC, first, id) AS rank FROM f QUALIFY rank <= 10")
def rrf_hybrid(spark, d):
    """Every text query with every asked vector (``vid``)."""
    asked, vectors = _asked(spark), _asked_vectors(spark, d)
    vec = knn(_vectors(spark, d), vectors, 20).withColumnRenamed("qid", "vid").crossJoin(F.broadcast(asked.select("qid")))
    fts = bm25(_docs(spark, d), asked, 20).crossJoin(sent_if_small(vectors.select(F.col("qid").alias("vid"))))
    return rrf([vec, fts], ["qid", "vid"], 10).select("qid", "vid", "id", "score", "rank")


_OK = "len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0"
#: The newest summary of each document, and the words of the asked texts as a sparse hashed vector (dim, val).
_SUMMARIES = """latest AS (SELECT * FROM vector_records WHERE kind = 'doc_summary' QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC, source_id DESC, universe_id DESC, title DESC, text DESC, vector DESC) = 1),
summaries AS (SELECT universe_id, source_id AS id, title, text, vector, topics, domain, keywords FROM latest QUALIFY row_number() OVER (PARTITION BY universe_id, source_id ORDER BY created_at DESC, latest.id DESC) = 1)"""


def _hashed_sql(texts: str, space: str = r"\s") -> str:
    """(t, dim, val) of the column t of ``texts``: :func:`hashed_embedding` without its length."""
    return f"""SELECT t, ('0x' || h[1:2])::INT % 64 + 1 AS dim, sum(CASE WHEN ('0x' || h[3:4])::INT % 2 = 1 THEN 1.0 ELSE -1.0 END) AS val
  FROM (SELECT t, sha256(w) AS h FROM (SELECT t, unnest(string_split_regex(lower(trim(t)), '{space}+')) AS w FROM {texts}) WHERE w <> '') GROUP BY ALL"""


def _newest_summaries(spark, d):
    newest = F.max(F.struct("created_at", F.col("id").alias("record"), "title", "text", "vector")).alias("m")
    return latest_vectors(spark, d, "doc_summary").groupBy("universe_id", F.col("source_id").alias("id")).agg(newest).select("universe_id", "id", "m.title", "m.text", "m.vector")


_CROSS = rf"""WITH {_SUMMARIES}, {_ASK}, words AS (SELECT qid, unnest(string_split_regex(regexp_replace(query, '["''*^:()\-]', ' ', 'g'), '\s+')) AS w FROM asked),
q AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({_TERMS.format(c="w")}) AS term FROM words WHERE length(w) > 1) GROUP BY ALL),
d AS MATERIALIZED (SELECT universe_id, 'doc:' || file_id AS id, {_TERMS.format(c="title")} || {_TERMS.format(c="text")} AS ts FROM documents),
st AS (SELECT universe_id, count(*) AS n, avg(len(ts)) AS av FROM d GROUP BY ALL),
tf AS (SELECT universe_id, id, len, term, count(*) AS f FROM (SELECT universe_id, id, len(ts) AS len, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
dfs AS (SELECT universe_id, term, count(*) AS df FROM tf GROUP BY ALL),
fts AS (SELECT universe_id, qid, id, round(sum(s * times), 6) AS score FROM (SELECT universe_id, id, term, CASE WHEN n > 2 * df THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / av)) AS s FROM tf JOIN dfs USING (universe_id, term) JOIN st USING (universe_id)) JOIN q USING (term) GROUP BY ALL),
l2 AS (SELECT universe_id, qid, id, row_number() OVER (PARTITION BY universe_id, qid ORDER BY score DESC, id) AS rank FROM fts QUALIFY rank <= 10),
h AS MATERIALIZED ({_hashed_sql("(SELECT query AS t FROM asked)")}),
vec AS (SELECT universe_id, qid, id, round(sum(val * vector[dim]::DOUBLE) / sqrt(sum(val * val)) / any_value(len2), 9) AS score FROM asked JOIN h ON h.t = query, (SELECT *, sqrt(list_dot_product(vector::DOUBLE[], vector::DOUBLE[])) AS len2 FROM summaries WHERE {_OK}) GROUP BY ALL),
l1 AS (SELECT universe_id, qid, id, row_number() OVER (PARTITION BY universe_id, qid ORDER BY score DESC, id) AS rank FROM vec QUALIFY rank <= 10),
f AS (SELECT universe_id, qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min({{'l': list, 'r': rank}}) AS first FROM (SELECT *, 0 AS list FROM l1 UNION ALL SELECT *, 1 FROM l2) GROUP BY ALL),
per AS (SELECT *, row_number() OVER (PARTITION BY universe_id, qid ORDER BY score DESC, first, id) AS r FROM f QUALIFY r <= 5)
SELECT qid::INT AS qid, universe_id, id, round(1.0::DOUBLE / (60 + r), 12) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(1.0::DOUBLE / (60 + r), 12) DESC, r, universe_id, id) AS rank FROM per QUALIFY rank <= 10"""


@_query("rrf_cross_universe", _CROSS)
def rrf_cross_universe(spark, d):
    """Full text of documents and vectors of summaries, fused in every universe and then across them."""
    docs = table(spark, d, "documents").select("universe_id", F.concat(F.lit("doc:"), "file_id").alias("id"), "title", "text", F.col("mime").alias("kind"))
    records = _newest_summaries(spark, d).filter(usable(F.col("vector"))).select("universe_id", "id", F.col("vector").alias("v"))
    asked = spark.createDataFrame([(i, q, hashed_embedding(q)) for i, q in enumerate(ASKED)], "qid int, query string, qv array<double>")
    return across_universes(hybrid_search(docs, records, asked, 5), 10).select("qid", "universe_id", "id", "score", "rank")


@_query("link_references", rf"""WITH {_SUMMARIES}, refs AS (SELECT DISTINCT universe_id, id AS document, trim(title) AS ref FROM chats WHERE length(trim(title)) >= 4),
ru AS (SELECT DISTINCT universe_id, ref FROM refs WHERE universe_id IS NOT NULL),
q AS (SELECT ref, term, count(*) AS times FROM (SELECT ref, unnest({_TERMS.format(c="w")}) AS term FROM (SELECT ref, unnest(string_split_regex(regexp_replace(ref, '["''*^:()\-]', ' ', 'g'), '\s+')) AS w FROM (SELECT DISTINCT ref FROM refs)) WHERE length(w) > 1) GROUP BY ALL),
texts AS (SELECT universe_id, 'doc:' || file_id AS id, title, text FROM documents),
d AS MATERIALIZED (SELECT universe_id, id, {_TERMS.format(c="title")} || {_TERMS.format(c="text")} AS ts FROM (SELECT * FROM texts UNION ALL SELECT universe_id, id, title, text FROM summaries s WHERE NOT EXISTS (FROM texts t WHERE t.universe_id = s.universe_id AND t.id = s.id))),
st AS (SELECT universe_id, count(*) AS n, avg(len(ts)) AS av FROM d GROUP BY ALL),
tf AS (SELECT universe_id, id, len, term, count(*) AS f FROM (SELECT universe_id, id, len(ts) AS len, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
dfs AS (SELECT universe_id, term, count(*) AS df FROM tf GROUP BY ALL),
s AS (SELECT universe_id, id, term, CASE WHEN n > 2 * df THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / av)) AS s FROM tf JOIN dfs USING (universe_id, term) JOIN st USING (universe_id)),
fts AS (SELECT s.universe_id, ref, id, round(sum(s * times), 6) AS score FROM s JOIN q USING (term) JOIN ru USING (universe_id, ref) GROUP BY ALL),
l1 AS (SELECT universe_id, ref, id, row_number() OVER (PARTITION BY universe_id, ref ORDER BY score DESC, id) AS rank FROM fts QUALIFY rank <= 3),
h AS MATERIALIZED ({_hashed_sql("(SELECT DISTINCT ref AS t FROM refs)")}),
vec AS (SELECT universe_id, ru.ref, id, round(sum(val * vector[dim]::DOUBLE) / sqrt(sum(val * val)) / any_value(len2), 9) AS score FROM ru JOIN h ON h.t = ru.ref JOIN
  (SELECT *, sqrt(list_dot_product(vector::DOUBLE[], vector::DOUBLE[])) AS len2 FROM summaries WHERE {_OK}) USING (universe_id) GROUP BY ALL),
l2 AS (SELECT universe_id, ref, id, row_number() OVER (PARTITION BY universe_id, ref ORDER BY score DESC NULLS LAST, id) AS rank FROM vec QUALIFY rank <= 3),
f AS (SELECT universe_id, ref, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min({{'l': list, 'r': rank}}) AS first FROM (SELECT *, 0 AS list FROM l1 UNION ALL SELECT *, 1 FROM l2) GROUP BY ALL)
SELECT universe_id, document, ref, id, score FROM refs JOIN f USING (universe_id, ref) WHERE id <> document QUALIFY row_number() OVER (PARTITION BY universe_id, document, ref ORDER BY score DESC, first, id) = 1""")
def link_references(spark, d):
    """Chats stand for the documents that refer, their titles for the references; files have a text or a summary."""
    refs = table(spark, d, "chats").select("universe_id", F.col("id").alias("document"), F.trim("title").alias("ref")).filter(F.length("ref") >= 4).distinct()
    vectors = refs.select("ref").distinct().withColumn("qv", F.udf(hashed_embedding, "array<double>", useArrow=True)("ref"))
    summaries = _newest_summaries(spark, d)
    texts = table(spark, d, "documents").select("universe_id", F.concat(F.lit("doc:"), "file_id").alias("id"), "title", "text")
    bare = summaries.join(texts, ["universe_id", "id"], "left_anti").select("universe_id", "id", "title", "text")
    docs = texts.unionByName(bare).withColumn("kind", F.lit("doc_summary"))
    return linked_references(refs.join(vectors, "ref"), docs, summaries.filter(usable(F.col("vector"))).select("universe_id", "id", F.col("vector").alias("v")), 0.0)


@_query("record_sources_topn", """SELECT user_id, source_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, seq, source_id) AS rank FROM
  (SELECT user_id, event_type AS source_id, max(value) AS score, min(event_id) AS seq FROM events GROUP BY ALL) QUALIFY rank <= 3""")
def record_sources_topn(spark, d):
    hits = table(spark, d, "events").select("user_id", F.col("event_type").alias("source_id"), F.col("value").alias("score"), F.col("event_id").alias("seq"))
    return best_sources(hits, ["user_id"], 3).select("user_id", "source_id", "score", "rank")


_EXPAND = rf"""WITH {GRAPH_SQL}, recs AS MATERIALIZED (SELECT universe_id, graph_node_id AS id, kind, max(vector)::DOUBLE[] AS v FROM vector_records WHERE {_OK} GROUP BY ALL),
qs AS (SELECT universe_id, v AS qv FROM recs WHERE kind = 'agent_note' QUALIFY row_number() OVER (PARTITION BY universe_id ORDER BY id) = 1),
fused AS (SELECT r.universe_id, r.id, round(1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY r.universe_id ORDER BY round(list_cosine_similarity(v, qv), 9) DESC, r.id)), 12) AS score
  FROM recs r JOIN qs USING (universe_id) WHERE kind = 'doc_summary' QUALIFY row_number() OVER (PARTITION BY r.universe_id ORDER BY round(list_cosine_similarity(v, qv), 9) DESC, r.id) <= 16),
seed AS (SELECT universe_id, id FROM fused QUALIFY row_number() OVER (PARTITION BY universe_id ORDER BY score DESC, id) <= 6),
deg AS (SELECT universe_id, id, count(*) AS g FROM (SELECT universe_id, src AS id FROM edges UNION ALL SELECT universe_id, dst FROM edges WHERE src <> dst) GROUP BY ALL),
cen AS (SELECT universe_id, id, g / greatest(1, max(g) OVER (PARTITION BY universe_id)) AS c FROM deg),
steps AS MATERIALIZED (SELECT universe_id, src AS h, dst AS other, rel, src, count FROM (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY universe_id, src ORDER BY rel, src, dst) <= 200)
  UNION ALL SELECT universe_id, dst, src, rel, src, count FROM (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY universe_id, dst ORDER BY rel, src, dst) <= 200)),
met AS (SELECT universe_id, other AS id, max(w) AS w, max(least(2.0, 1 + 0.3 * ln(1 + n) + 0.3 * CASE WHEN rel = 'ABOUT' OR (rel = 'MENTIONS' AND src LIKE 'doc:%') THEN 1.0 WHEN rel = 'MENTIONS' THEN least(1.0, 0.3 + 0.1 * n) ELSE 0.0 END)) AS e FROM (
  SELECT x.universe_id, x.other, x.rel, x.src, CASE WHEN rel = 'MENTIONS' THEN x.count::DOUBLE ELSE 0.0::DOUBLE END AS n, CASE rel WHEN 'CONTAINS' THEN 0.3 WHEN 'ABOUT' THEN 0.6 WHEN 'MENTIONS' THEN 0.5 WHEN 'RELATED' THEN 0.7 WHEN 'PART_OF' THEN 0.5 WHEN 'IN_DOMAIN' THEN 0.2 WHEN 'REFERENCES_DOC' THEN 0.6 ELSE 0.3 END AS w
  FROM seed s JOIN steps x ON x.universe_id = s.universe_id AND x.h = s.id WHERE rel <> 'TAGGED' AND x.other <> s.id) m
  WHERE NOT EXISTS (FROM fused f WHERE f.universe_id = m.universe_id AND f.id = m.other) GROUP BY ALL)
SELECT universe_id, id, score FROM fused UNION ALL
SELECT m.universe_id, m.id, round(0.4 * w * greatest(0.1, coalesce(c, 0.1)) * greatest(0.1, (list_cosine_similarity(v, qv) + 1) / 2) * e, 9)
FROM met m JOIN (SELECT universe_id, id, max(v) AS v FROM recs GROUP BY ALL) r ON r.universe_id = m.universe_id AND r.id = m.id JOIN qs ON qs.universe_id = m.universe_id LEFT JOIN cen ON cen.universe_id = m.universe_id AND cen.id = m.id"""


@_query("graph_expand_rerank", _EXPAND)
def graph_expand_rerank(spark, d):
    v = F.col("vector")
    ok = (F.size(v) == 64) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    recs = table(spark, d, "vector_records").filter(ok).groupBy("universe_id", F.col("graph_node_id").alias("id"), "kind").agg(F.max("vector").alias("v"))
    qs = G.top_rows(recs.filter(F.col("kind") == "agent_note"), ["universe_id"], [F.col("id")], 1).select("universe_id", F.lit(0).alias("qid"), F.col("v").alias("qv"))
    near = knn(recs.filter(F.col("kind") == "doc_summary"), qs, 16, keys=["universe_id"])
    fused = rrf([near], ["universe_id"], 16)
    e = edges(spark, d)
    c = G.centrality(e.select("universe_id", F.explode(F.array("src", "dst")).alias("id")).distinct(), e)
    one = recs.groupBy("universe_id", "id").agg(F.max("v").alias("v"))
    return expand(fused, e, one, qs.select("universe_id", "qv"), c, ["universe_id"])


__all__ = ["QUERIES", "ORACLES", "nodes"]
