"""Queries of sinks, point reads, JSON columns, mentions and written analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import chunking
from loomgraph.functions.text import file_id_of, found_at, is_blank, merged_aliases, vector_id
from loomgraph.operators import graph as G
from loomgraph.operators import sinks as S
from loomgraph.operators.vectors import as_records, by_source_id, sample_random, vector_filter
from loomgraph.plans.graph import _MAP, _same_names
from loomgraph.plans.retrieval import _OK, _hashed_sql
from loomgraph.session import table
from loomgraph.sources.files import mime_of
from loomgraph.sources.knowledge import _S, GRAPH_SQL, edges, latest_vectors, nodes, predicate_sql, slug_sql

QUERIES, ORACLES = {}, {}


def _query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _graph(body: str) -> str:
    return f"WITH RECURSIVE {GRAPH_SQL}{body}"


_LATEST = "latest AS (SELECT * FROM vector_records QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC, kind DESC, source_id DESC, universe_id DESC, title DESC, text DESC) = 1)"


def _fts_rows(records):
    return records.select("universe_id", "source_id", "kind", "file_id", "graph_node_id", "title", "text")


@_query("upsert_fts_rows", f"""WITH {_LATEST}, old AS (SELECT universe_id, source_id, kind, title, text FROM latest WHERE kind IN ('doc_summary', 'topic')),
  new AS (SELECT universe_id, 'doc:' || file_id AS source_id, 'doc_summary' AS kind, title, text FROM documents QUALIFY row_number() OVER (PARTITION BY universe_id, file_id ORDER BY title DESC NULLS LAST, text DESC NULLS LAST) = 1)
  SELECT universe_id, source_id, kind, title, length(text) AS n FROM (SELECT * FROM old WHERE NOT EXISTS (FROM new WHERE new.universe_id = old.universe_id AND new.source_id = old.source_id) UNION ALL SELECT * FROM new)""")
def upsert_fts_rows(spark, d):
    """The parsed texts take the place of the summaries of their documents."""
    none = F.lit("")
    new = table(spark, d, "documents").select("universe_id", F.concat(F.lit("doc:"), "file_id").alias("source_id"), F.lit("doc_summary").alias("kind"), "file_id", none.alias("graph_node_id"), "title", "text")
    return S.upsert_fts(_fts_rows(latest_vectors(spark, d, "doc_summary", "topic")), new).select("universe_id", "source_id", "kind", "title", F.length("text").cast("long").alias("n"))


@_query("delete_fts_rows", f"""WITH {_LATEST} SELECT universe_id, source_id, kind FROM latest WHERE NOT EXISTS (FROM files f WHERE f.status = 'deleted' AND f.universe_id = latest.universe_id AND 'doc:' || f.id = latest.source_id)""")
def delete_fts_rows(spark, d):
    gone = table(spark, d, "files").filter("status = 'deleted'").select("universe_id", F.concat(F.lit("doc:"), "id").alias("source_id"))
    return S.delete_rows(_fts_rows(latest_vectors(spark, d)), gone).select("universe_id", "source_id", "kind")


@_query("upsert_vectors", """SELECT id, count(*) AS n, max(t) AS title FROM (SELECT id, title AS t FROM vector_records v WHERE NOT (coalesce(kind = 'entity' AND domain = 'person', false)) AND NOT EXISTS (FROM vector_records x WHERE x.id = v.id AND x.kind = 'entity' AND x.domain = 'person')
  UNION ALL SELECT id, 'new ' || title FROM vector_records WHERE kind = 'entity' AND domain = 'person') GROUP BY id""")
def upsert_vectors(spark, d):
    """A batch with all rows of the persons: rows of one id all stay."""
    v = table(spark, d, "vector_records")
    new = v.filter("kind = 'entity' AND domain = 'person'").withColumn("title", F.concat(F.lit("new "), "title"))
    return S.upsert_vectors(v, new, cap=None).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("title").alias("title"))


@_query("delete_vectors_by_file", "SELECT id, count(*) AS n FROM vector_records v WHERE NOT EXISTS (FROM files f WHERE f.id = v.file_id AND f.universe_id = v.universe_id AND f.status IN ('deleted', 'failed')) GROUP BY id")
def delete_vectors_by_file(spark, d):
    gone = table(spark, d, "files").filter(F.col("status").isin("deleted", "failed")).select("universe_id", F.col("id").alias("file_id"))
    return S.delete_rows(table(spark, d, "vector_records"), gone).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@_query("rewrite_source_id", _graph(_MAP + f""", {_LATEST} SELECT v.universe_id, v.id, coalesce(a.winner, source_id) AS source_id, coalesce(b.winner, graph_node_id) AS graph_node_id FROM latest v
  LEFT JOIN m a ON a.universe_id = v.universe_id AND a.loser = source_id LEFT JOIN m b ON b.universe_id = v.universe_id AND b.loser = graph_node_id"""))
def rewrite_source_id(spark, d):
    mapping = _same_names(nodes(spark, d, "Entity"))
    return S.rekey_sources(latest_vectors(spark, d), mapping).select("universe_id", "id", "source_id", "graph_node_id")


@_query("patch_chats", """WITH t AS (SELECT chat_id, arg_min(content, {'t': created_at, 'i': id, 'c': content}) AS title FROM messages WHERE role = 'user' AND content IS NOT NULL AND created_at IS NOT NULL AND chat_id IS NOT NULL GROUP BY chat_id)
  SELECT id, coalesce(substr(t.title, 1, 60), chats.title) AS title, updated_at FROM chats LEFT JOIN t ON t.chat_id = chats.id""")
def patch_chats(spark, d):
    """Chats renamed after the user's first message, where there is one."""
    m = table(spark, d, "messages").filter("role = 'user' AND content IS NOT NULL AND created_at IS NOT NULL AND chat_id IS NOT NULL")
    first = m.groupBy(F.col("chat_id").alias("id")).agg(F.substring(F.min_by("content", F.struct("created_at", "id", "content")), 1, 60).alias("title"))
    changes = first.withColumn("updated_at", F.lit(None).cast("long"))
    return S.patched(table(spark, d, "chats"), changes, ["id"]).select("id", "title", "updated_at")


@_query("json_fields", "SELECT event_id, (props->>'k')::INT AS k, (props->>'missing') AS missing FROM events")
def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", S.json_field(F.col("props"), "k").cast("int").alias("k"), S.json_field(F.col("props"), "missing").alias("missing"))


@_query("json_set_key", """SELECT event_id, json_object('k', (props->>'k')::INT, 'type', event_type)::VARCHAR AS props FROM events""")
def json_set_key(spark, d):
    return table(spark, d, "events").select("event_id", S.json_set(F.col("props"), "type", F.col("event_type")).alias("props"))


@_query("mount_validity", """SELECT f.universe_id, f.mount_id, bool_or(u.id IS NOT NULL) AS valid, count(DISTINCT f.id) AS files FROM files f LEFT JOIN universes u ON u.id = f.universe_id GROUP BY ALL""")
def mount_validity(spark, d):
    """A mount is valid while its universe exists."""
    u = table(spark, d, "universes").select(F.col("id").alias("universe_id"), F.lit(True).alias("there")).distinct()
    per = table(spark, d, "files").groupBy("universe_id", "mount_id").agg(F.count_distinct("id").alias("files"))
    return per.join(u, "universe_id", "left").select("universe_id", "mount_id", F.coalesce("there", F.lit(False)).alias("valid"), "files")


@_query("message_hydrate", r"""SELECT id, chat_id, content, coalesce(string_agg(s, '|' ORDER BY s), '') AS sources, count(s) AS n FROM (SELECT DISTINCT id, chat_id, content, unnest(CASE WHEN len(x) = 0 THEN [NULL] ELSE x END) AS s FROM (
  SELECT id, chat_id, content, coalesce(list_transform(from_json(sources, '[{"id":"VARCHAR"}]'), lambda e: e.id), []) AS x FROM messages)) GROUP BY id, chat_id, content""")
def message_hydrate(spark, d):
    """Messages with the ids of the sources that they were answered from."""
    ids = F.transform(F.from_json("sources", "array<struct<id:string>>"), lambda e: e["id"])
    m = table(spark, d, "messages").select("id", "chat_id", "content", F.coalesce(ids, F.array().cast("array<string>")).alias("x"))
    g = m.groupBy("id", "chat_id", "content").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("x")))).alias("x"))
    return g.select("id", "chat_id", "content", F.array_join("x", "|").alias("sources"), F.size("x").cast("long").alias("n"))


_MIME_SQL = "CASE regexp_extract(lower(rel_path), '\\.([a-z0-9]+)$', 1) WHEN 'pdf' THEN 'application/pdf' WHEN 'md' THEN 'text/markdown' WHEN 'html' THEN 'text/html' WHEN 'txt' THEN 'text/plain' WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'text/plain' END"


@_query("read_original", f"""SELECT DISTINCT f.id, {_MIME_SQL} AS mime, CASE WHEN {_MIME_SQL} = 'application/pdf' THEN to_base64(encode(text)) ELSE replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) END AS body
  FROM files f JOIN documents t ON t.file_id = f.id AND t.universe_id = f.universe_id WHERE regexp_matches(lower(rel_path), '\\.(pdf|md|html|txt|docx)$')""")
def read_original(spark, d):
    """Texts with LF line ends, and PDF content in base 64."""
    f = table(spark, d, "files").filter(F.lower("rel_path").rlike(r"\.(pdf|md|html|txt|docx)$")).select("universe_id", F.col("id").alias("file_id"), mime_of(F.col("rel_path")).alias("kind")).distinct()
    t = table(spark, d, "documents").select("universe_id", "file_id", "text").join(f, ["universe_id", "file_id"])
    body = F.when(F.col("kind") == "application/pdf", F.replace(F.base64(F.encode("text", "UTF-8")), F.lit("\r\n"), F.lit(""))).otherwise(F.regexp_replace("text", "\r\n?", "\n"))
    return t.select(F.col("file_id").alias("id"), F.col("kind").alias("mime"), body.alias("body")).distinct()


@_query("get_by_source_id", """SELECT universe_id, source_id, id, kind FROM vector_records v WHERE source_id IN (SELECT left_id FROM match_pairs m WHERE m.universe_id = v.universe_id) QUALIFY row_number() OVER (PARTITION BY universe_id, source_id ORDER BY id, created_at DESC) = 1""")
def get_by_source_id(spark, d):
    asked = table(spark, d, "match_pairs").select("universe_id", F.col("left_id").alias("source_id"))
    return by_source_id(table(spark, d, "vector_records"), asked).select("universe_id", "source_id", "id", "kind")


@_query("vector_filters", "SELECT DISTINCT id, source_id FROM vector_records WHERE kind IN ('entity', 'topic') AND domain = 'person' AND source_id NOT IN ('ent:person:none')")
def vector_filters(spark, d):
    return vector_filter(table(spark, d, "vector_records"), ["entity", "topic"], domain="person", entity_type="person", exclude_source_ids=["ent:person:none"]).select("id", "source_id").distinct()


@_query("record_coercion", "SELECT id, coalesce(title, '') AS title, len(coalesce(list_filter(vector, lambda x: x IS NOT NULL), [])) AS numbers, len(coalesce(list_filter(keywords, lambda x: x IS NOT NULL), [])) AS keywords, coalesce(created_at, 0) AS created_at FROM vector_records")
def record_coercion(spark, d):
    r = as_records(table(spark, d, "vector_records"))
    return r.select("id", "title", F.size("vector").cast("long").alias("numbers"), F.size("keywords").cast("long").alias("keywords"), "created_at")


@_query("sample_random")
def sample_random_query(spark, d):
    v = latest_vectors(spark, d, "doc_summary").select("universe_id", "id")
    return sample_random(v, 6, ["universe_id"])


@_query("list_entities_by_type", _graph(" SELECT universe_id, id, label FROM nodes WHERE type = 'Entity' AND subtype = 'organization'"))
def list_entities_by_type(spark, d):
    return nodes(spark, d, "Entity").filter("subtype = 'organization'").select("universe_id", "id", "label")


@_query("list_all_topics", _graph(" SELECT universe_id, id, label FROM nodes WHERE type = 'Topic'"))
def list_all_topics(spark, d):
    return nodes(spark, d, "Topic").select("universe_id", "id", "label")


_TRIPLES = """, t AS (SELECT universe_id, id, direction || ' ' || predicate || ' ' || other AS t, row_number() OVER (PARTITION BY universe_id, id ORDER BY direction DESC, other, predicate) AS r FROM (
  SELECT universe_id, src AS id, 'out' AS direction, predicate, dst AS other FROM edges WHERE rel = 'RELATED' UNION ALL SELECT universe_id, dst, 'in', predicate, src FROM edges WHERE rel = 'RELATED') QUALIFY r <= 8),
  l AS (SELECT universe_id, dst AS id, src AS doc, row_number() OVER (PARTITION BY universe_id, dst ORDER BY count DESC, src) AS r FROM edges WHERE rel = 'MENTIONS' AND src LIKE 'doc:%' QUALIFY r <= 5),
  a AS (SELECT universe_id, id, list_slice(list_distinct(list(x)), 1, 20) AS al FROM (SELECT universe_id, id, unnest(aliases) AS x FROM entities) WHERE trim(x) <> '' GROUP BY ALL)"""


@_query("entity_details", _graph(_TRIPLES + """ SELECT n.universe_id, n.id, n.label, n.subtype, (SELECT string_agg(t, '; ' ORDER BY r) FROM t WHERE t.universe_id = n.universe_id AND t.id = n.id) AS triples,
  (SELECT string_agg(doc, '; ' ORDER BY r) FROM l WHERE l.universe_id = n.universe_id AND l.id = n.id) AS documents FROM nodes n WHERE n.type = 'Entity'"""))
def entity_details(spark, d):
    return G.entity_details(nodes(spark, d, "Entity"), edges(spark, d, "RELATED", "MENTIONS")).select("universe_id", "id", "label", "subtype", "triples", "documents")


@_query("entity_aliases", rf"""WITH a AS (SELECT universe_id, id, regexp_replace(unnest(aliases), '^{_S}+|{_S}+$', '', 'g') AS x FROM entities)
  SELECT e.universe_id, e.id, least(count(DISTINCT x), 20) AS aliases FROM (SELECT DISTINCT universe_id, id FROM entities) e LEFT JOIN (FROM a WHERE x <> '') b ON b.universe_id IS NOT DISTINCT FROM e.universe_id AND b.id = e.id GROUP BY ALL""")
def entity_aliases(spark, d):
    """How many aliases an entity keeps from all its rows: each once, at most 20."""
    e = table(spark, d, "entities").groupBy("universe_id", "id").agg(F.flatten(F.collect_list("aliases")).alias("a"))
    return e.select("universe_id", "id", F.size(merged_aliases(F.col("a"), F.array().cast("array<string>"))).cast("long").alias("aliases"))


@_query("vector_ids", "SELECT DISTINCT id, 'vec_entity_' || regexp_replace(id, '[^A-Za-z0-9_-]', '_', 'g') AS vector_id, CASE WHEN document_id LIKE 'doc:%' THEN document_id[5:] ELSE document_id END AS file_id FROM entities")
def vector_ids(spark, d):
    return table(spark, d, "entities").select("id", vector_id(F.lit("entity"), F.col("id")).alias("vector_id"), file_id_of(F.col("document_id")).alias("file_id")).distinct()


@_query("rebased_offsets", r"""SELECT DISTINCT id, length(text) // 2 AS raw, length(text) // 2 - len(regexp_extract_all(substr(text, 1, length(text) // 2), '\r\n')) AS rebased FROM chunks WHERE text IS NOT NULL""")
def rebased_offsets(spark, d):
    c = table(spark, d, "chunks").filter("text IS NOT NULL").select("id", "text", F.floor(F.length("text") / 2).alias("raw"))
    return c.select("id", "raw", chunking.rebased_offset(F.col("text"), F.col("raw")).alias("rebased")).distinct()


@_query("chunk_titles", """WITH s AS (SELECT file_id, max(title) AS title FROM vector_records WHERE kind = 'doc_summary' GROUP BY file_id)
  SELECT DISTINCT c.id, CASE WHEN len(heading) > 0 THEN title || ' — ' || array_to_string(list_transform(heading, lambda h: coalesce(h, '')), ' › ') ELSE title || ' — part ' || (position_no + 1) END AS title FROM chunks c JOIN s USING (file_id)""")
def chunk_titles(spark, d):
    s = table(spark, d, "vector_records").filter("kind = 'doc_summary'").groupBy("file_id").agg(F.max("title").alias("title"))
    return table(spark, d, "chunks").join(s, "file_id").select("id", chunking.chunk_title(F.col("title"), F.col("heading"), F.col("position_no")).alias("title")).distinct()


@_query("highlight_positions", rf"""WITH t AS (SELECT DISTINCT doc_id, lower(regexp_replace(text, '{_S}+', ' ', 'g')) AS t, regexp_replace(lower(regexp_replace(substr(text, 40, 300), '{_S}+', ' ', 'g')), '^{_S}+|{_S}+$', '', 'g') AS n FROM documents WHERE length(text) > 400)
  SELECT doc_id, strpos(t, substr(n, 1, 160)) - 1 AS at FROM t""")
def highlight_positions(spark, d):
    t = table(spark, d, "documents").filter(F.length("text") > 400)
    return t.select("doc_id", found_at(F.col("text"), F.substring("text", 40, 300)).cast("long").alias("at")).distinct()


#: A piece of text with every separator doubled, so that two matches never share one: for SQL without lookarounds.
_DOUBLED = r"regexp_replace(lower({c}), '([^\p{{L}}\p{{N}}_])', '\1\1', 'g')"
_MENTIONS_SQL = rf"""n AS (SELECT DISTINCT scope, id, s FROM (SELECT document_id[5:] AS scope, id, unnest(list_concat([name], coalesce(aliases, []))) AS s0, lower(regexp_replace(s0, '^{_S}+|{_S}+$', '', 'g')) AS s FROM entities WHERE document_id IS NOT NULL
    UNION ALL SELECT id, id, unnest(list_concat([name], coalesce(aliases, []))) AS s0, lower(regexp_replace(s0, '^{_S}+|{_S}+$', '', 'g')) FROM entities) WHERE length(s) >= 3),
  c AS (SELECT DISTINCT doc_id::VARCHAR AS chunk, file_id AS scope, text FROM documents UNION SELECT DISTINCT id, file_id, text FROM chunks UNION SELECT DISTINCT id, source_id, text FROM vector_records WHERE kind = 'entity'),
  k AS (SELECT chunk, n.id, sum(len(regexp_extract_all(' ' || {_DOUBLED.format(c="text")} || ' ', '[^\p{{L}}\p{{N}}_]' || regexp_escape({_DOUBLED.format(c="s")}) || '[^\p{{L}}\p{{N}}_]')))::BIGINT AS count
    FROM c JOIN n USING (scope) WHERE contains(lower(text), s) GROUP BY ALL)"""


def _mentions(spark, d):
    """Texts and chunks by their file, and the texts of entity records by their entity, with the entities of each."""
    e = table(spark, d, "entities")
    named = e.filter("document_id IS NOT NULL").select(F.expr("substring(document_id, 5)").alias("scope"), "id", "name", "aliases").unionByName(e.select(F.col("id").alias("scope"), "id", "name", "aliases"))
    texts = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk"), F.col("file_id").alias("scope"), "text")
    texts = texts.unionByName(table(spark, d, "chunks").select(F.col("id").alias("chunk"), F.col("file_id").alias("scope"), "text"))
    texts = texts.unionByName(table(spark, d, "vector_records").filter("kind = 'entity'").select(F.col("id").alias("chunk"), F.col("source_id").alias("scope"), "text"))
    return S.chunk_mentions(texts.distinct(), named, ["scope"]).groupBy("chunk", "id").agg(F.sum("count").cast("long").alias("count"))


@_query("mention_counts", f"WITH {_MENTIONS_SQL} SELECT chunk, id, count FROM k WHERE count > 0")
def mention_counts(spark, d):
    """Whole-word mentions of entities, by name or alias, in the texts of their documents and in their own records."""
    return _mentions(spark, d)


@_query("chunks_for_entity", f"""WITH {_MENTIONS_SQL}, h AS (SELECT id AS chunk, min('doc:' || file_id) AS document FROM chunks GROUP BY id)
  SELECT k.id, k.chunk, h.document, k.count, row_number() OVER (PARTITION BY k.id ORDER BY k.count DESC, k.chunk) AS rank FROM k LEFT JOIN h USING (chunk) WHERE k.count > 0 QUALIFY rank <= 8""")
def chunks_for_entity(spark, d):
    none = F.lit(None)
    m = _mentions(spark, d).select(F.lit("").alias("universe_id"), F.lit("MENTIONS").alias("rel"), F.col("chunk").alias("src"), F.col("id").alias("dst"), "count")
    held = table(spark, d, "chunks").select(F.lit("").alias("universe_id"), F.lit("CONTAINS").alias("rel"), F.concat(F.lit("doc:"), "file_id").alias("src"), F.col("id").alias("dst"), none.cast("long").alias("count"))
    return G.chunks_for_entity(m.unionByName(held)).select("id", "chunk", "document", "count", "rank")


def _analysis(spark, d):
    """The analysed documents: summaries with topics, keywords and domain, and their chunks, entities and relations."""
    v = latest_vectors(spark, d, "doc_summary")
    docs = v.groupBy("universe_id", F.col("source_id").alias("id")).agg(F.max(F.struct("created_at", F.col("id").alias("record"), "file_id", "title", "text", "domain", "topics", "keywords")).alias("m"))
    docs = docs.select("universe_id", "id", "m.file_id", "m.title", F.col("m.text").alias("summary"), "m.domain", "m.topics", "m.keywords")
    chunks = table(spark, d, "chunks").select("universe_id", F.concat(F.lit("doc:"), "file_id").alias("document"), "id", F.col("position_no").alias("position"), "text", "heading").distinct()
    keys = docs.select("universe_id", F.col("id").alias("document"))
    ents = table(spark, d, "entities").select("universe_id", F.col("document_id").alias("document"), "name", "type", "aliases", "id").join(keys, ["universe_id", "document"], "left_semi")
    kind = F.lower(F.trim("kind"))
    rels = table(spark, d, "relations").select("universe_id", F.col("document_id").alias("document"), F.when(kind == "related", "related").when(F.regexp_replace(kind, "[^a-z]", "") == "partof", "part_of").alias("kind"), "src_name", "dst_name", "predicate")
    return docs, chunks.join(keys, ["universe_id", "document"], "left_semi"), ents, rels.join(keys, ["universe_id", "document"], "left_semi")


def _store(spark, d):
    """An earlier state of the graph: entities and chunks without any document's analysis."""
    none = F.lit(None)
    n = nodes(spark, d, "Entity", "Chunk").select("universe_id", "id", "type", "label", none.cast("array<string>").alias("aliases"), none.cast("string").alias("text"))
    return S.Stored(n, edges(spark, d, "CONTAINS", "MENTIONS"), _fts_rows(latest_vectors(spark, d, "chunk")))


_WRITTEN = rf""", latest AS (SELECT * FROM vector_records WHERE kind = 'doc_summary' QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC, source_id DESC, universe_id DESC, title DESC, text DESC) = 1),
  docs AS MATERIALIZED (SELECT universe_id, source_id AS id, file_id, title, text, domain, topics, keywords FROM latest QUALIFY row_number() OVER (PARTITION BY universe_id, source_id ORDER BY created_at DESC, latest.id DESC) = 1),
  away AS MATERIALIZED (SELECT universe_id, id FROM docs UNION SELECT e.universe_id, e.dst FROM edges e JOIN docs d ON d.universe_id = e.universe_id AND d.id = e.src WHERE rel = 'CONTAINS'),
  ents AS MATERIALIZED (SELECT e.universe_id, e.document_id AS document, e.name, e.id FROM entities e JOIN docs d ON d.universe_id = e.universe_id AND d.id = e.document_id),
  tops AS MATERIALIZED (SELECT universe_id, id AS document, name, 'top:' || {slug_sql("name")} AS id FROM (SELECT universe_id, id, unnest(topics) AS name FROM docs) WHERE trim(name) <> ''),
  known AS MATERIALIZED (SELECT universe_id, document, kind, k, min(id) AS id FROM (SELECT universe_id, document, 'related' AS kind, lower(trim(name)) AS k, id FROM ents UNION ALL SELECT universe_id, document, 'part_of', lower(trim(name)), id FROM tops) GROUP BY ALL),
  rels AS (SELECT universe_id, document_id AS document, CASE WHEN lower(trim(kind)) = 'related' THEN 'related' WHEN regexp_replace(lower(kind), '[^a-z]', '', 'g') = 'partof' THEN 'part_of' END AS kind, lower(trim(src_name)) AS ks, lower(trim(dst_name)) AS kd, {predicate_sql("predicate")} AS predicate FROM relations),
  named AS (SELECT r.universe_id, r.kind, a.id AS src, b.id AS dst, r.predicate FROM rels r JOIN known a ON a.universe_id = r.universe_id AND a.document = r.document AND a.kind = r.kind AND a.k = r.ks
    JOIN known b ON b.universe_id = r.universe_id AND b.document = r.document AND b.kind = r.kind AND b.k = r.kd WHERE a.id <> b.id),
  broad AS (SELECT universe_id, document, id, string_split_regex(lower(trim(name)), '\s+') AS w FROM tops),
  new AS (SELECT universe_id, 'IN_DOMAIN' AS rel, id AS src, 'dom:' || {slug_sql("domain")} AS dst, NULL::BIGINT AS count, NULL AS predicate FROM docs WHERE trim(domain) <> ''
    UNION ALL SELECT universe_id, 'ABOUT', document, id, NULL, NULL FROM tops
    UNION ALL SELECT universe_id, 'TAGGED', id, 'kw:' || {slug_sql("name")}, NULL, NULL FROM (SELECT universe_id, id, unnest(keywords) AS name FROM docs) WHERE trim(name) <> ''
    UNION ALL SELECT universe_id, 'MENTIONS', document, id, 1, NULL FROM ents
    UNION ALL SELECT c.universe_id, 'CONTAINS', 'doc:' || c.file_id, c.id, NULL, NULL FROM chunks c JOIN docs d ON d.universe_id = c.universe_id AND d.id = 'doc:' || c.file_id
    UNION ALL SELECT universe_id, CASE kind WHEN 'related' THEN 'RELATED' ELSE 'PART_OF' END, src, dst, NULL, CASE kind WHEN 'related' THEN predicate END FROM named
    UNION ALL SELECT a.universe_id, 'PART_OF', a.id, b.id, NULL, NULL FROM broad a JOIN broad b ON a.universe_id = b.universe_id AND a.document = b.document WHERE len(b.w) < len(a.w) AND len(a.w) >= 2 AND list_has_all(a.w, b.w) AND a.id <> b.id)"""


@_query("write_analysis", _graph(_WRITTEN + """ SELECT universe_id, rel, src, dst, max(predicate) AS predicate FROM (SELECT universe_id, rel, src, dst, predicate FROM edges e WHERE rel IN ('CONTAINS', 'MENTIONS')
  AND NOT EXISTS (FROM away a WHERE a.universe_id = e.universe_id AND a.id IN (e.src, e.dst)) UNION ALL SELECT universe_id, rel, src, dst, predicate FROM new) GROUP BY universe_id, rel, src, dst"""))
def write_analysis(spark, d):
    """The edges after the analysis of every summarised document was written."""
    return S.write_analysis(_store(spark, d), *_analysis(spark, d)).edges.select("universe_id", "rel", "src", "dst", "predicate")


@_query("write_analysis_fts", f"""WITH latest AS (SELECT * FROM vector_records QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC, kind DESC, source_id DESC, universe_id DESC, title DESC, text DESC) = 1),
  docs AS MATERIALIZED (SELECT universe_id, source_id AS id, file_id, title, text FROM latest WHERE kind = 'doc_summary' QUALIFY row_number() OVER (PARTITION BY universe_id, source_id ORDER BY created_at DESC, latest.id DESC) = 1),
  own AS (SELECT c.universe_id, c.id, d.title, c.text, c.position_no, c.heading FROM chunks c JOIN docs d ON d.universe_id = c.universe_id AND d.id = 'doc:' || c.file_id),
  new AS (SELECT universe_id, id AS source_id, 'doc_summary' AS kind FROM docs UNION SELECT universe_id, id, 'chunk' FROM own)
  SELECT universe_id, source_id, kind FROM new UNION ALL SELECT universe_id, source_id, kind FROM latest l WHERE kind = 'chunk' AND NOT EXISTS (FROM new WHERE new.universe_id = l.universe_id AND new.source_id = l.source_id)""")
def write_analysis_fts(spark, d):
    return S.write_analysis(_store(spark, d), *_analysis(spark, d)).fts.select("universe_id", "source_id", "kind")


def _notes(spark, d):
    """The notes of the vector table, each linked to the documents of its universe with the smallest and greatest id and to nothing that exists."""
    v = latest_vectors(spark, d, "agent_note")
    ends = nodes(spark, d, "Document").groupBy("universe_id").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    return v.join(ends, "universe_id").select("universe_id", F.col("source_id").alias("id"), F.col("text").alias("content"), F.col("title").alias("kind"), F.array("a", "b", F.lit("gone")).alias("links")).dropDuplicates(["universe_id", "id"])


_NOTES = """, ends AS (SELECT universe_id, min(id) AS a, max(id) AS b FROM nodes WHERE type = 'Document' GROUP BY universe_id), notes AS (SELECT DISTINCT universe_id, source_id AS id, a, b FROM vector_records JOIN ends USING (universe_id) WHERE kind = 'agent_note')"""


@_query("save_agent_notes", _graph(_NOTES + " SELECT DISTINCT universe_id, 'DERIVED_FROM_DOC' AS rel, id AS src, unnest([a, b]) AS dst FROM notes"))
def save_agent_notes(spark, d):
    old = S.Stored(nodes(spark, d, "Document").select("universe_id", "id", "type", "label", F.lit(None).cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("text")), edges(spark, d, "CONTAINS"), _fts_rows(latest_vectors(spark, d, "chunk")))
    return S.save_notes(old, _notes(spark, d)).edges.filter("rel = 'DERIVED_FROM_DOC'").select("universe_id", "rel", "src", "dst")


@_query("analyzer_context", f"""WITH asked AS (SELECT universe_id, doc_id::VARCHAR AS qid, coalesce(title, '') || chr(10) || chr(10) || substr(coalesce(text, ''), 1, 1500) AS t FROM documents WHERE doc_id % 50 = 0),
  known AS (SELECT * FROM vector_records WHERE kind IN ('entity', 'topic') QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC, kind DESC, source_id DESC, universe_id DESC, title DESC, text DESC) = 1),
  usable AS (SELECT universe_id, id, kind, title, vector, sqrt(list_dot_product(vector::DOUBLE[], vector::DOUBLE[])) AS size FROM known WHERE {_OK}),
  h AS MATERIALIZED ({_hashed_sql("(SELECT DISTINCT t FROM asked)", _S)}),
  s AS (SELECT universe_id, qid, kind, id, title, round(sum(val * vector[dim]::DOUBLE) / sqrt(sum(val * val)) / any_value(size), 9) AS score FROM asked JOIN h USING (t) JOIN usable USING (universe_id) GROUP BY ALL),
  n AS (SELECT *, row_number() OVER (PARTITION BY universe_id, qid, kind ORDER BY score DESC NULLS LAST, id) AS rank FROM s QUALIFY rank <= CASE kind WHEN 'entity' THEN 50 ELSE 30 END),
  o AS (SELECT * FROM n WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY universe_id, qid, kind, lower(title) ORDER BY rank) = 1)
  SELECT universe_id, qid, kind, id, title AS name, row_number() OVER (PARTITION BY universe_id, qid, kind ORDER BY rank)::INT AS place FROM o QUALIFY place <= CASE kind WHEN 'entity' THEN 25 ELSE 15 END""")
def analyzer_context(spark, d):
    """For every document whose doc_id is divisible by 50 the known entities and topics of its universe that are nearest to its beginning."""
    from loomgraph.engine import hashed_embedding
    from loomgraph.operators.ranking import analyzer_context as context
    from loomgraph.operators.vectors import usable

    docs = table(spark, d, "documents").filter(F.col("doc_id") % 50 == 0).select("universe_id", F.col("doc_id").cast("string").alias("qid"), "title", "text")
    previews = docs.select("universe_id", "qid", F.concat_ws("\n\n", F.coalesce("title", F.lit("")), F.substring(F.coalesce("text", F.lit("")), 1, 1500)).alias("preview"))
    asked = previews.filter(~is_blank(F.col("preview"))).select("universe_id", "qid", F.udf(hashed_embedding, "array<double>", useArrow=True)("preview").alias("qv"))
    known = latest_vectors(spark, d, "entity", "topic").filter(usable(F.col("vector"))).select("universe_id", "id", "kind", "title", F.col("vector").alias("v"))
    return context(known, asked)
