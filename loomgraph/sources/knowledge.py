"""The property graph, full-text rows and vector rows, read from the tables of the domain.

Each edge type is a projection of its own table, so a query reads only the tables and columns
of the relations that it asks for.  All frames carry ``universe_id``, the tenant.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import node_slug, predicate_name, squeeze
from loomgraph.session import table


def latest_vectors(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """The newest row of each vector record id."""
    v = table(spark, sf_dir, "vector_records")
    if kinds:
        v = v.filter(F.col("kind").isin(*kinds))
    rest = [c for c in v.columns if c not in ("id", "created_at")]
    return v.groupBy("id").agg(F.max(F.struct("created_at", *rest)).alias("m")).select("id", "m.*")


def _summary_edges(spark, sf_dir, rel, prefix, column):
    v = table(spark, sf_dir, "vector_records").filter(F.col("kind") == "doc_summary")
    name = F.explode(column) if column in ("topics", "keywords") else F.col(column)
    named = v.select("universe_id", F.col("source_id").alias("src"), name.alias("name")).filter(F.trim("name") != "")
    return named.select("universe_id", F.lit(rel).alias("rel"), "src", F.concat(F.lit(prefix), node_slug(F.trim("name"))).alias("dst"))


def _contains(spark, sf_dir):
    return table(spark, sf_dir, "chunks").select("universe_id", F.lit("CONTAINS").alias("rel"), F.concat(F.lit("doc:"), "file_id").alias("src"), F.col("id").alias("dst"))


def _mentions(spark, sf_dir):
    e = table(spark, sf_dir, "entities").filter(F.col("document_id").isNotNull())
    return e.select("universe_id", F.lit("MENTIONS").alias("rel"), F.col("document_id").alias("src"), F.col("id").alias("dst"))


def _part_of(spark, sf_dir):
    r = table(spark, sf_dir, "relations").filter((F.regexp_replace(F.lower("kind"), "[^a-z]", "") == "partof") & (F.trim("src_name") != "") & (F.trim("dst_name") != ""))
    at = lambda c: F.concat(F.lit("top:"), node_slug(F.trim(c)))
    return r.select("universe_id", F.lit("PART_OF").alias("rel"), at("src_name").alias("src"), at("dst_name").alias("dst")).filter("src <> dst")


def _related(spark, sf_dir):
    r = table(spark, sf_dir, "relations").filter(F.lower("kind") == "related")
    names = table(spark, sf_dir, "entities").select("universe_id", squeeze(F.col("name")).alias("k"), "id").groupBy("universe_id", "k").agg(F.min("id").alias("id"))
    r = r.select("universe_id", squeeze(F.col("src_name")).alias("ks"), squeeze(F.col("dst_name")).alias("kd"), predicate_name(F.col("predicate")).alias("predicate"))
    r = r.join(names.select("universe_id", F.col("k").alias("ks"), F.col("id").alias("src")), ["universe_id", "ks"])
    r = r.join(names.select("universe_id", F.col("k").alias("kd"), F.col("id").alias("dst")), ["universe_id", "kd"])
    return r.filter("src <> dst").select("universe_id", F.lit("RELATED").alias("rel"), "src", "dst", "predicate")


def _references(spark, sf_dir):
    """A document refers to the one from which the entity was extracted that one of its relations leads to."""
    r = table(spark, sf_dir, "relations").filter((F.lower("kind") == "related") & F.col("document_id").isNotNull())
    e = table(spark, sf_dir, "entities")
    names = e.select("universe_id", squeeze(F.col("name")).alias("k"), "id").groupBy("universe_id", "k").agg(F.min("id").alias("id"))
    origin = e.groupBy("universe_id", "id").agg(F.min("document_id").alias("dst"))
    r = r.select("universe_id", F.col("document_id").alias("src"), squeeze(F.col("dst_name")).alias("k")).join(names, ["universe_id", "k"]).join(origin, ["universe_id", "id"])
    return r.filter("src <> dst").select("universe_id", F.lit("REFERENCES_DOC").alias("rel"), "src", "dst")


_EDGES = {
    "CONTAINS": _contains,
    "MENTIONS": _mentions,
    "ABOUT": lambda s, d: _summary_edges(s, d, "ABOUT", "top:", "topics"),
    "IN_DOMAIN": lambda s, d: _summary_edges(s, d, "IN_DOMAIN", "dom:", "domain"),
    "TAGGED": lambda s, d: _summary_edges(s, d, "TAGGED", "kw:", "keywords"),
    "RELATED": _related,
    "PART_OF": _part_of,
    "REFERENCES_DOC": _references,
}


def edges(spark: SparkSession, sf_dir: str, *rels: str) -> DataFrame:
    """(universe_id, rel, src, dst, count, predicate), one row for each (universe_id, rel, src, dst)."""
    parts = []
    for rel in rels or _EDGES:
        e = _EDGES[rel](spark, sf_dir)
        parts.append(e if "predicate" in e.columns else e.withColumn("predicate", F.lit(None).cast("string")))
    return reduce(DataFrame.unionByName, parts).groupBy("universe_id", "rel", "src", "dst").agg(F.count(F.lit(1)).alias("count"), F.min("predicate").alias("predicate"))


def nodes(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    """(universe_id, id, type, label, subtype), one row for each (universe_id, id)."""
    text = lambda c: c.cast("string")
    none = F.lit(None).cast("string")
    out = []
    if not types or "Document" in types:
        f = table(spark, sf_dir, "files")
        out.append(f.select("universe_id", F.concat(F.lit("doc:"), "id").alias("id"), F.lit("Document").alias("type"), F.col("rel_path").alias("label"), none.alias("subtype")))
    if not types or "Chunk" in types:
        out.append(table(spark, sf_dir, "chunks").select("universe_id", "id", F.lit("Chunk").alias("type"), F.col("id").alias("label"), none.alias("subtype")))
    if not types or "Entity" in types:
        out.append(table(spark, sf_dir, "entities").select("universe_id", "id", F.lit("Entity").alias("type"), text(F.col("name")).alias("label"), F.col("type").alias("subtype")))
    for kind, rel, prefix in (("Topic", ("ABOUT", "PART_OF"), "top:"), ("Domain", ("IN_DOMAIN",), "dom:"), ("Keyword", ("TAGGED",), "kw:")):
        if not types or kind in types:
            e = edges(spark, sf_dir, *rel)
            ends = e.select("universe_id", F.explode(F.array("src", "dst")).alias("id")).filter(F.col("id").startswith(prefix))
            out.append(ends.select("universe_id", "id", F.lit(kind).alias("type"), F.substring("id", len(prefix) + 1, 200).alias("label"), none.alias("subtype")))
    return reduce(DataFrame.unionByName, out).groupBy("universe_id", "id", "type").agg(F.min("label").alias("label"), F.min("subtype").alias("subtype"))


_S = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def slug_sql(c: str) -> str:
    kept = f"left(regexp_replace(regexp_replace(lower(trim({c})), '{_S}+', '_', 'g'), '[^a-z0-9_]', '', 'g'), 128)"
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN {kept} = '' THEN '_' ELSE {kept} END"


def squeeze_sql(c: str) -> str:
    return f"lower(regexp_replace(regexp_replace({c}, '^{_S}+|{_S}+$', '', 'g'), '{_S}+', ' ', 'g'))"


def predicate_sql(c: str) -> str:
    return f"coalesce(nullif(left(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 48), ''), 'related_to')"


#: The same graph in SQL: common table expressions ``edges`` and ``nodes``.
GRAPH_SQL = rf"""
names AS (SELECT universe_id, {squeeze_sql("name")} AS k, min(id) AS id FROM entities GROUP BY ALL),
raw_edges AS (
  SELECT universe_id, 'CONTAINS' AS rel, 'doc:' || file_id AS src, id AS dst, NULL AS predicate FROM chunks
  UNION ALL SELECT universe_id, 'MENTIONS', document_id, id, NULL FROM entities WHERE document_id IS NOT NULL
  UNION ALL SELECT universe_id, 'ABOUT', source_id, 'top:' || {slug_sql("name")}, NULL FROM (SELECT universe_id, source_id, unnest(topics) AS name FROM vector_records WHERE kind = 'doc_summary') WHERE trim(name) <> ''
  UNION ALL SELECT universe_id, 'IN_DOMAIN', source_id, 'dom:' || {slug_sql("domain")}, NULL FROM vector_records WHERE kind = 'doc_summary' AND trim(domain) <> ''
  UNION ALL SELECT universe_id, 'TAGGED', source_id, 'kw:' || {slug_sql("name")}, NULL FROM (SELECT universe_id, source_id, unnest(keywords) AS name FROM vector_records WHERE kind = 'doc_summary') WHERE trim(name) <> ''
  UNION ALL SELECT r.universe_id, 'RELATED', a.id, b.id, {predicate_sql("predicate")} FROM relations r
    JOIN names a ON a.universe_id = r.universe_id AND a.k = {squeeze_sql("src_name")} JOIN names b ON b.universe_id = r.universe_id AND b.k = {squeeze_sql("dst_name")}
    WHERE lower(kind) = 'related' AND a.id <> b.id
  UNION ALL SELECT r.universe_id, 'REFERENCES_DOC', r.document_id, o.dst, NULL FROM relations r JOIN names n ON n.universe_id = r.universe_id AND n.k = {squeeze_sql("dst_name")}
    JOIN (SELECT universe_id, id, min(document_id) AS dst FROM entities GROUP BY ALL) o ON o.universe_id = n.universe_id AND o.id = n.id WHERE lower(kind) = 'related' AND r.document_id <> o.dst
  UNION ALL SELECT * FROM (SELECT universe_id, 'PART_OF', 'top:' || {slug_sql("src_name")} AS s, 'top:' || {slug_sql("dst_name")} AS d, NULL FROM relations
    WHERE regexp_replace(lower(kind), '[^a-z]', '', 'g') = 'partof' AND trim(src_name) <> '' AND trim(dst_name) <> '') WHERE s <> d
), edges AS MATERIALIZED (SELECT universe_id, rel, src, dst, count(*) AS count, min(predicate) AS predicate FROM raw_edges GROUP BY ALL),
nodes AS MATERIALIZED (
  SELECT universe_id, id, type, min(label) AS label, min(subtype) AS subtype FROM (
    SELECT universe_id, 'doc:' || id AS id, 'Document' AS type, rel_path AS label, NULL AS subtype FROM files
    UNION ALL SELECT universe_id, id, 'Chunk', id, NULL FROM chunks
    UNION ALL SELECT universe_id, id, 'Entity', name, type FROM entities
    UNION ALL SELECT universe_id, dst, 'Topic', dst[5:], NULL FROM edges WHERE rel IN ('ABOUT', 'PART_OF')
    UNION ALL SELECT universe_id, src, 'Topic', src[5:], NULL FROM edges WHERE rel = 'PART_OF'
    UNION ALL SELECT universe_id, dst, 'Domain', dst[5:], NULL FROM edges WHERE rel = 'IN_DOMAIN'
    UNION ALL SELECT universe_id, dst, 'Keyword', dst[4:], NULL FROM edges WHERE rel = 'TAGGED'
  ) GROUP BY universe_id, id, type
)"""
