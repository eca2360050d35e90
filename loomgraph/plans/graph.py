"""Queries on the property graph; each works on all universes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import graph as G
from loomgraph.sources.knowledge import GRAPH_SQL, edges, nodes

QUERIES, ORACLES = {}, {}


def _query(name, sql):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


def _sql(body: str) -> str:
    return f"WITH RECURSIVE {GRAPH_SQL}{body}"


def _listing(name, type_, rel, limit):
    cap = f"QUALIFY row_number() OVER (PARTITION BY universe_id ORDER BY n DESC, id) <= {limit}" if limit else ""

    @_query(
        name,
        _sql(f""" SELECT universe_id, id, label, n FROM (SELECT x.universe_id, x.id, x.label, count(e.src) AS n FROM nodes x
          LEFT JOIN edges e ON e.universe_id = x.universe_id AND e.dst = x.id AND e.rel = '{rel}' WHERE x.type = '{type_}' GROUP BY ALL) {cap}"""),
    )
    def run(spark, d):
        return G.counted_nodes(nodes(spark, d, type_), edges(spark, d, rel), rel, limit).select("universe_id", "id", "label", "n")


_listing("list_domains", "Domain", "IN_DOMAIN", None)
_listing("list_topics", "Topic", "ABOUT", 50)
_listing("list_entities", "Entity", "MENTIONS", 50)


@_query("graph_stats", _sql(""" SELECT universe_id, count(*) FILTER (type = 'Document') AS documents, count(*) FILTER (type = 'Entity') AS entities,
  count(*) FILTER (type = 'Topic') AS topics, count(*) FILTER (type = 'Chunk') AS chunks FROM nodes GROUP BY universe_id"""))
def graph_stats(spark, d):
    return G.graph_stats(nodes(spark, d))


def _related(name, via, rels):
    @_query(
        name,
        _sql(f""", ch(rel, o, w, reason) AS (VALUES ('MENTIONS', 0, 1.0::DOUBLE, 'shared entities'), ('ABOUT', 1, 0.7::DOUBLE, 'shared topics'), ('REFERENCES_DOC', 2, 1.5::DOUBLE, 'cross-document reference')),
          c AS (SELECT a.universe_id, a.rel, a.src AS doc, b.src AS other, count(*) AS shared FROM edges a JOIN edges b ON a.universe_id = b.universe_id AND a.rel = b.rel AND a.dst = b.dst AND a.src <> b.src
            WHERE a.rel IN ('MENTIONS', 'ABOUT') AND a.src LIKE 'doc:%' AND b.src LIKE 'doc:%' GROUP BY a.universe_id, a.rel, a.src, b.src QUALIFY row_number() OVER (PARTITION BY a.universe_id, a.rel, a.src ORDER BY count(*) DESC, b.src) <= 16
            UNION ALL SELECT universe_id, rel, src, dst, 1 FROM edges WHERE rel = 'REFERENCES_DOC' UNION ALL SELECT universe_id, rel, dst, src, 1 FROM edges WHERE rel = 'REFERENCES_DOC'),
          s AS (SELECT universe_id, doc, other, round(sum(shared * w), 6) AS score, string_agg(reason, '; ' ORDER BY o) AS reason FROM c JOIN ch USING (rel) WHERE rel IN ({rels}) GROUP BY ALL)
          SELECT universe_id, doc, other, score, reason, row_number() OVER (PARTITION BY universe_id, doc ORDER BY score DESC, other) AS rank FROM s QUALIFY rank <= 8"""),
    )
    def run(spark, d):
        return G.related_documents(edges(spark, d, "MENTIONS", "ABOUT", "REFERENCES_DOC"), via)


_related("related_docs_entities", "entities", "'MENTIONS'")
_related("related_docs_topics", "topics", "'ABOUT'")
_related("related_docs_references", "references", "'REFERENCES_DOC'")
_related("related_docs_all", "all", "'MENTIONS', 'ABOUT', 'REFERENCES_DOC'")


@_query("similar_docs_pairs", _sql(""" SELECT a.universe_id, a.src AS a, b.src AS b, count(DISTINCT a.dst) AS shared FROM edges a JOIN edges b
  ON a.universe_id = b.universe_id AND a.dst = b.dst AND a.src < b.src WHERE a.rel = 'MENTIONS' AND b.rel = 'MENTIONS' AND a.src LIKE 'doc:%' AND b.src LIKE 'doc:%'
  AND NOT EXISTS (FROM edges r WHERE r.rel = 'REFERENCES_DOC' AND r.universe_id = a.universe_id AND ((r.src = a.src AND r.dst = b.src) OR (r.src = b.src AND r.dst = a.src))) GROUP BY ALL HAVING count(DISTINCT a.dst) >= 1"""))
def similar_docs_pairs(spark, d):
    return G.similar_documents(edges(spark, d, "MENTIONS", "REFERENCES_DOC"), 1)


@_query("degree_centrality", _sql(""" SELECT universe_id, id, degree, degree / greatest(1, max(degree) OVER (PARTITION BY universe_id)) AS centrality FROM (
  SELECT n.universe_id, n.id, count(e.id) AS degree FROM nodes n LEFT JOIN (SELECT universe_id, src AS id FROM edges UNION ALL SELECT universe_id, dst FROM edges WHERE src <> dst) e
  ON e.universe_id = n.universe_id AND e.id = n.id GROUP BY ALL)"""))
def degree_centrality(spark, d):
    return G.centrality(nodes(spark, d), edges(spark, d))


@_query("entity_triples", _sql(""" SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY universe_id, id ORDER BY direction DESC, other, predicate) AS rank FROM (
  SELECT universe_id, src AS id, 'out' AS direction, predicate, dst AS other FROM edges WHERE rel = 'RELATED'
  UNION ALL SELECT universe_id, dst, 'in', predicate, src FROM edges WHERE rel = 'RELATED')) WHERE rank <= 10"""))
def entity_triples(spark, d):
    return G.entity_triples(edges(spark, d, "RELATED"))


@_query("docs_for_entity", _sql(""" SELECT universe_id, dst AS id, src AS doc, count, row_number() OVER (PARTITION BY universe_id, dst ORDER BY count DESC, src) AS rank
  FROM edges WHERE rel = 'MENTIONS' AND src LIKE 'doc:%' QUALIFY rank <= 5"""))
def docs_for_entity(spark, d):
    return G.documents_for_entity(edges(spark, d, "MENTIONS"))


def _roots(df):
    """The best connected document of each universe."""
    n = df.filter(F.col("rel") == "MENTIONS").groupBy("universe_id", F.col("src").alias("root")).agg(F.count(F.lit(1)).alias("n"))
    return G.top_rows(n, ["universe_id"], [F.desc("n"), F.col("root")], 1).select("universe_id", "root")


_ROOTS = """, roots AS (SELECT universe_id, src AS root FROM edges WHERE rel = 'MENTIONS' GROUP BY universe_id, src QUALIFY row_number() OVER (PARTITION BY universe_id ORDER BY count(*) DESC, src) = 1)"""
_STEPS = """, steps AS MATERIALIZED (SELECT universe_id, src AS here, dst AS other, rel, src, dst FROM (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY universe_id, src ORDER BY rel, src, dst) <= 200)
  UNION ALL SELECT universe_id, dst, src, rel, src, dst FROM (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY universe_id, dst ORDER BY rel, src, dst) <= 200))"""


@_query("neighborhood_1hop", _sql(_ROOTS + _STEPS + " SELECT DISTINCT universe_id, root, rel, src, dst, 1 AS hop FROM roots JOIN steps USING (universe_id) WHERE here = root"))
def neighborhood_1hop(spark, d):
    e = edges(spark, d)
    return G.neighbourhood(e, _roots(e)).drop("count", "predicate")


@_query("neighborhood_filtered", _sql(_ROOTS + _STEPS + " SELECT DISTINCT universe_id, root, rel, src, dst, 1 AS hop FROM roots JOIN steps USING (universe_id) WHERE here = root AND rel NOT IN ('TAGGED', 'CONTAINS')"))
def neighborhood_filtered(spark, d):
    e = edges(spark, d)
    return G.neighbourhood(e, _roots(e), without=["TAGGED", "CONTAINS"]).drop("count", "predicate")


@_query("neighborhood_2hop", _sql(_ROOTS + _STEPS + """, h1 AS (SELECT universe_id, root, rel, src, dst, other FROM roots JOIN steps USING (universe_id) WHERE here = root AND rel <> 'TAGGED'),
  f AS (SELECT DISTINCT universe_id, root, other AS here FROM h1 WHERE other <> root)
  SELECT universe_id, root, rel, src, dst, min(hop) AS hop FROM (SELECT universe_id, root, rel, src, dst, 1 AS hop FROM h1
  UNION ALL SELECT f.universe_id, f.root, s.rel, s.src, s.dst, 2 FROM f JOIN steps s ON s.universe_id = f.universe_id AND s.here = f.here WHERE s.rel <> 'TAGGED') GROUP BY ALL"""))
def neighborhood_2hop(spark, d):
    e = edges(spark, d)
    return G.neighbourhood(e, _roots(e), depth=2, without=["TAGGED"]).drop("count", "predicate")


@_query("neighborhood_only", _sql(_ROOTS + _STEPS + " SELECT DISTINCT universe_id, root, rel, src, dst, 1 AS hop FROM roots JOIN steps USING (universe_id) WHERE here = root AND rel IN ('ABOUT', 'MENTIONS')"))
def neighborhood_only(spark, d):
    e = edges(spark, d)
    return G.neighbourhood(e, _roots(e), only=["ABOUT", "MENTIONS"]).drop("count", "predicate")


@_query("graph_navigate", _sql(""", roots AS (SELECT universe_id, src AS root FROM edges WHERE rel = 'RELATED' GROUP BY universe_id, src QUALIFY row_number() OVER (PARTITION BY universe_id ORDER BY count(*) DESC, src) = 1)""" + _STEPS + """,
  e AS (SELECT DISTINCT s.universe_id, root, s.rel, s.src, s.dst, s.other, g.predicate FROM roots r JOIN steps s ON s.universe_id = r.universe_id AND s.here = r.root JOIN edges g ON g.universe_id = s.universe_id AND g.rel = s.rel AND g.src = s.src AND g.dst = s.dst
    WHERE s.rel NOT IN ('CONTAINS', 'TAGGED') AND s.src <> s.dst)
  SELECT universe_id, root, other AS id, string_agg(DISTINCT rel, '|' ORDER BY rel) AS relations, coalesce(string_agg(DISTINCT predicate, '|' ORDER BY predicate), '') AS predicates,
    arg_max(CASE WHEN src = root THEN 'out' ELSE 'in' END, {'r': rel, 's': src, 'd': dst}) AS direction FROM e GROUP BY universe_id, root, other"""))
def graph_navigate(spark, d):
    e = edges(spark, d)
    n = e.filter(F.col("rel") == "RELATED").groupBy("universe_id", F.col("src").alias("root")).agg(F.count(F.lit(1)).alias("n"))
    roots = G.top_rows(n, ["universe_id"], [F.desc("n"), F.col("root")], 1).select("universe_id", "root")
    return G.per_neighbour(G.neighbourhood(e, roots, without=["CONTAINS", "TAGGED"]))


_PATHS = _ROOTS + """, ends AS (SELECT r.universe_id, r.root AS start, g.goal FROM roots r JOIN (SELECT universe_id, max(src) AS goal FROM edges WHERE rel = 'MENTIONS' GROUP BY ALL) g USING (universe_id)),
  both_ways AS MATERIALIZED (SELECT DISTINCT universe_id, src AS here, dst AS other FROM edges WHERE rel IN ('MENTIONS', 'ABOUT', 'RELATED') UNION SELECT universe_id, dst, src FROM edges WHERE rel IN ('MENTIONS', 'ABOUT', 'RELATED')),
  walk AS (SELECT universe_id, start, start AS here, 0 AS hop, [start] AS path FROM ends UNION ALL
    SELECT universe_id, start, here, hop, path FROM (SELECT w.universe_id, w.start, b.other AS here, w.hop + 1 AS hop, list_append(w.path, b.other) AS path FROM walk w JOIN both_ways b ON b.universe_id = w.universe_id AND b.here = w.here
    WHERE w.hop < 4 AND NOT list_contains(w.path, b.other))),
  paths AS (SELECT universe_id, start, goal, path FROM (SELECT e.*, w.path FROM ends e JOIN walk w ON w.universe_id = e.universe_id AND w.start = e.start AND w.here = e.goal
    QUALIFY row_number() OVER (PARTITION BY e.universe_id ORDER BY w.hop, w.path) = 1))"""


def _paths(spark, d):
    e = edges(spark, d, "MENTIONS", "ABOUT", "RELATED")
    goal = e.filter(F.col("rel") == "MENTIONS").groupBy("universe_id").agg(F.max("src").alias("goal"))
    return G.shortest_paths(e, _roots(e).join(goal, "universe_id").select("universe_id", F.col("root").alias("start"), "goal")), e


@_query("find_path_bfs", _sql(_PATHS + " SELECT universe_id, start, goal, len(path) - 1 AS hops, array_to_string(path, '|') AS path FROM paths"))
def find_path_bfs(spark, d):
    return _paths(spark, d)[0].select("universe_id", "start", "goal", (F.size("path") - 1).alias("hops"), F.array_join("path", "|").alias("path"))


@_query("find_path_narrative", _sql(_PATHS + """, hops AS (SELECT universe_id, start, goal, i AS hop, path[i] AS here, path[i + 1] AS there FROM (SELECT *, unnest(range(1, len(path))) AS i FROM paths)),
  named AS (SELECT universe_id, id, min(label) AS label FROM nodes GROUP BY ALL),
  said AS (SELECT h.*, e.rel, e.src, e.predicate, coalesce(a.label, here) AS la, coalesce(b.label, there) AS lb FROM hops h JOIN edges e ON e.universe_id = h.universe_id AND e.rel IN ('MENTIONS', 'ABOUT', 'RELATED') AND ((e.src = here AND e.dst = there) OR (e.src = there AND e.dst = here))
    LEFT JOIN named a ON a.universe_id = h.universe_id AND a.id = here LEFT JOIN named b ON b.universe_id = h.universe_id AND b.id = there
    QUALIFY row_number() OVER (PARTITION BY h.universe_id, start, goal, hop ORDER BY e.rel, e.src, e.dst) = 1)
  SELECT universe_id, start, goal, string_agg(CASE WHEN src = here THEN la || ' --[' || rel || coalesce(':' || predicate, '') || ']--> ' || lb ELSE la || ' <--[' || rel || coalesce(':' || predicate, '') || ']-- ' || lb END, ' | ' ORDER BY hop) AS narrative FROM said GROUP BY ALL"""))
def find_path_narrative(spark, d):
    paths, e = _paths(spark, d)
    return G.path_narrative(G.path_hops(paths, e), nodes(spark, d))


@_query("browser_filter", _sql(""", n AS (SELECT * FROM nodes WHERE type IN ('Document', 'Topic', 'Entity') AND contains(lower(label), 'r'))
  SELECT universe_id, rel, src, dst FROM edges e WHERE EXISTS (FROM n WHERE n.universe_id = e.universe_id AND n.id = e.src) AND EXISTS (FROM n WHERE n.universe_id = e.universe_id AND n.id = e.dst)"""))
def browser_filter(spark, d):
    return G.browser_view(nodes(spark, d), edges(spark, d), ["Document", "Topic", "Entity"], "R")[1].select("universe_id", "rel", "src", "dst")


@_query("node_dispatch", _sql(""" SELECT universe_id, id, CASE WHEN id LIKE 'doc:%' THEN 'document' WHEN id LIKE 'chunk:%' THEN 'chunk' END AS reader, type, label FROM nodes WHERE id LIKE 'doc:%' OR id LIKE 'chunk:%'"""))
def node_dispatch(spark, d):
    """Only ids of documents and chunks have a reader; others give no row."""
    reader = F.when(F.col("id").startswith("doc:"), "document").when(F.col("id").startswith("chunk:"), "chunk")
    return nodes(spark, d).withColumn("reader", reader).filter("reader IS NOT NULL").select("universe_id", "id", "reader", "type", "label")


@_query("get_node", _sql(""" SELECT universe_id, id, type, label, subtype FROM nodes WHERE id = (SELECT max(id) FROM entities)"""))
def get_node(spark, d):
    from loomgraph.session import table

    asked = table(spark, d, "entities").agg(F.max("id").alias("id"))
    return G.get_nodes(nodes(spark, d), asked)


@_query("topic_hierarchy", _sql(""" SELECT n.universe_id, n.id, coalesce((SELECT string_agg(dst, '|' ORDER BY dst) FROM edges e WHERE e.universe_id = n.universe_id AND e.rel = 'PART_OF' AND e.src = n.id), '') AS parents,
  coalesce((SELECT string_agg(src, '|' ORDER BY src) FROM edges e WHERE e.universe_id = n.universe_id AND e.rel = 'PART_OF' AND e.dst = n.id), '') AS children FROM nodes n WHERE n.type = 'Topic'"""))
def topic_hierarchy(spark, d):
    e = edges(spark, d, "PART_OF")
    up = e.groupBy("universe_id", F.col("src").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("dst")), "|").alias("parents"))
    down = e.groupBy("universe_id", F.col("dst").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("src")), "|").alias("children"))
    t = nodes(spark, d, "Topic").select("universe_id", "id").join(up, ["universe_id", "id"], "left").join(down, ["universe_id", "id"], "left")
    return t.select("universe_id", "id", F.coalesce("parents", F.lit("")).alias("parents"), F.coalesce("children", F.lit("")).alias("children"))


_TYPES = "CASE type WHEN 'Domain' THEN 0 WHEN 'Topic' THEN 1 WHEN 'Document' THEN 2 WHEN 'Entity' THEN 3 END"


@_query("graph_overview", _sql(f""", n AS (SELECT * FROM nodes WHERE {_TYPES} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY universe_id ORDER BY {_TYPES}, id) <= 480)
  SELECT universe_id, rel, src, dst FROM (SELECT * FROM edges WHERE rel NOT IN ('CONTAINS', 'TAGGED') QUALIFY row_number() OVER (PARTITION BY universe_id ORDER BY rel, src, dst) <= 3000) e
  WHERE EXISTS (FROM n WHERE n.universe_id = e.universe_id AND n.id = e.src) AND EXISTS (FROM n WHERE n.universe_id = e.universe_id AND n.id = e.dst)"""))
def graph_overview(spark, d):
    return G.overview(nodes(spark, d, "Domain", "Topic", "Document", "Entity"), edges(spark, d))[1].select("universe_id", "rel", "src", "dst")


@_query("describe_nodes", _sql(""" SELECT m.universe_id, m.pair_id AS pos, m.left_id AS id, coalesce(n.type, 'Document') AS type, coalesce(n.label, m.left_id) AS label
  FROM match_pairs m LEFT JOIN nodes n ON n.universe_id = m.universe_id AND n.id = m.left_id"""))
def describe_nodes(spark, d):
    from loomgraph.session import table

    ids = table(spark, d, "match_pairs").select("universe_id", F.col("pair_id").alias("pos"), F.col("left_id").alias("id"))
    return G.describe(nodes(spark, d), ids)


@_query("graph_search", _sql(""" SELECT universe_id, type, id, label FROM (SELECT * FROM nodes WHERE type IN ('Topic', 'Entity', 'Document') QUALIFY row_number() OVER (PARTITION BY universe_id, type ORDER BY id) <= 200) WHERE contains(lower(label), 'harbour')"""))
def graph_search(spark, d):
    n = G.top_rows(nodes(spark, d, "Topic", "Entity", "Document"), ["universe_id", "type"], [F.col("id")], 200)
    return n.filter(F.lower("label").contains("harbour")).select("universe_id", "type", "id", "label")


_MAP = """, m AS (SELECT universe_id, id AS loser, min(id) OVER (PARTITION BY universe_id, subtype, lower(trim(label))) AS winner FROM nodes WHERE type = 'Entity' QUALIFY loser <> winner)"""


def _same_names(n):
    key = [F.col("universe_id"), F.col("subtype"), F.lower(F.trim("label")).alias("k")]
    first = n.groupBy(*key).agg(F.min("id").alias("winner"))
    own = n.select("universe_id", "subtype", F.lower(F.trim("label")).alias("k"), F.col("id").alias("loser"))
    return own.join(first, ["universe_id", "subtype", "k"]).filter("loser <> winner").select("universe_id", "loser", "winner")


@_query("merge_node_rewrite", _sql(_MAP + """ SELECT universe_id, rel, ns AS src, nd AS dst, count FROM (SELECT e.universe_id, rel, coalesce(a.winner, src) AS ns, coalesce(b.winner, dst) AS nd, src, dst, count, (a.winner IS NOT NULL OR b.winner IS NOT NULL) AS moved
  FROM edges e LEFT JOIN m a ON a.universe_id = e.universe_id AND a.loser = e.src LEFT JOIN m b ON b.universe_id = e.universe_id AND b.loser = e.dst)
  WHERE ns <> nd QUALIFY row_number() OVER (PARTITION BY universe_id, rel, ns, nd ORDER BY moved, src, dst) = 1"""))
def merge_node_rewrite(spark, d):
    return G.merge_nodes(edges(spark, d), _same_names(nodes(spark, d, "Entity"))).select("universe_id", "rel", "src", "dst", "count")


@_query("remove_document_cascade", _sql(""", gone AS (SELECT universe_id, 'doc:' || id AS id FROM files WHERE status = 'deleted'), away AS (SELECT * FROM gone UNION SELECT e.universe_id, e.dst FROM edges e JOIN gone g ON g.universe_id = e.universe_id AND g.id = e.src WHERE rel = 'CONTAINS')
  SELECT universe_id, rel, src, dst, count FROM edges e WHERE NOT EXISTS (FROM away a WHERE a.universe_id = e.universe_id AND a.id IN (e.src, e.dst))"""))
def remove_document_cascade(spark, d):
    from loomgraph.session import table

    docs = table(spark, d, "files").filter(F.col("status") == "deleted").select("universe_id", F.concat(F.lit("doc:"), "id").alias("id"))
    return G.remove_documents(nodes(spark, d), edges(spark, d), docs)[1].select("universe_id", "rel", "src", "dst", "count")


@_query("orphan_chunks", _sql(""" SELECT n.universe_id, n.id FROM nodes n JOIN chunks c ON c.id = n.id AND c.universe_id = n.universe_id LEFT JOIN files f ON f.id = c.file_id AND f.status = 'indexed' WHERE n.type = 'Chunk' AND f.id IS NULL GROUP BY ALL"""))
def orphan_chunks(spark, d):
    from loomgraph.session import table

    live = table(spark, d, "files").filter(F.col("status") == "indexed").select(F.concat(F.lit("doc:"), "id").alias("src")).distinct()
    return G.orphan_chunks(nodes(spark, d, "Chunk"), edges(spark, d, "CONTAINS").join(live, "src", "left_semi")).select("universe_id", "id")


@_query("upsert_edges_count_merge", _sql(""" SELECT universe_id, rel, src, dst, sum(count)::BIGINT AS count FROM (SELECT universe_id, rel, src, dst, count FROM edges WHERE rel = 'MENTIONS' UNION ALL
  SELECT universe_id, 'MENTIONS', document_id, id, 1 FROM entities WHERE document_id IS NOT NULL AND type = 'person') GROUP BY ALL"""))
def upsert_edges_count_merge(spark, d):
    from loomgraph.session import table

    none = F.lit(None)
    new = table(spark, d, "entities").filter((F.col("type") == "person") & F.col("document_id").isNotNull())
    new = new.select("universe_id", F.lit("MENTIONS").alias("rel"), F.col("document_id").alias("src"), F.col("id").alias("dst"), none.cast("long").alias("count"), none.cast("string").alias("predicate"))
    return G.upsert_edges(edges(spark, d, "MENTIONS"), new).select("universe_id", "rel", "src", "dst", "count")
