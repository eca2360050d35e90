"""Queries on topic hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.hierarchy import descendants, topic_hierarchy
from loomgraph.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = topic_hierarchy(table(spark, sf_dir, "relations"))
    return tree.select("universe_id", "node", F.when(F.col("is_cycle"), F.lit("cycle")).otherwise(F.array_join("path", ">")).alias("path"))


def p1_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topic_hierarchy(table(spark, sf_dir, "relations")).select("universe_id", "node", "depth", "root", "is_cycle")


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendants(topic_hierarchy(table(spark, sf_dir, "relations")))


_WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _slug(c: str) -> str:
    trimmed = rf"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"
    return rf"left(regexp_replace(regexp_replace(lower({trimmed}), '{_WS}+', '_', 'g'), '[^a-z0-9_]', '', 'g'), 128)"


_TREE = rf"""
WITH RECURSIVE named AS (
  SELECT universe_id, {_slug("src_name")} AS child, {_slug("dst_name")} AS parent, created_at, relation_id
  FROM relations
  WHERE regexp_replace(lower(kind), '[^a-z]', '', 'g') = 'partof'
    AND regexp_replace(src_name, '{_WS}', '', 'g') <> '' AND regexp_replace(dst_name, '{_WS}', '', 'g') <> ''
), links AS (SELECT * FROM named WHERE child <> parent),
nodes AS (SELECT universe_id, child AS node FROM links UNION SELECT universe_id, parent FROM links),
latest AS (
  SELECT universe_id, child, parent FROM links
  QUALIFY row_number() OVER (PARTITION BY universe_id, child ORDER BY created_at DESC NULLS LAST, relation_id DESC) = 1
), tree AS (
  SELECT n.universe_id, n.node, n.node AS path, 0 AS depth, n.node AS root, [n.node] AS steps
  FROM nodes n LEFT JOIN latest l ON l.universe_id IS NOT DISTINCT FROM n.universe_id AND l.child = n.node WHERE l.child IS NULL
  UNION ALL
  SELECT l.universe_id, l.child, t.path || '>' || l.child, t.depth + 1, t.root, list_append(t.steps, l.child)
  FROM tree t JOIN latest l ON l.universe_id IS NOT DISTINCT FROM t.universe_id AND l.parent = t.node
)
"""

QUERIES = {"p1_found": p1_found, "p1_hierarchy": p1_hierarchy, "p1_descendants": p1_descendants}

ORACLES = {
    "p1_found": _TREE
    + """SELECT n.universe_id, n.node, coalesce(t.path, 'cycle') AS path
FROM nodes n LEFT JOIN tree t ON t.universe_id IS NOT DISTINCT FROM n.universe_id AND t.node = n.node""",
    "p1_hierarchy": _TREE
    + """SELECT n.universe_id, n.node, t.depth AS depth, t.root AS root, t.node IS NULL AS is_cycle
FROM nodes n LEFT JOIN tree t ON t.universe_id IS NOT DISTINCT FROM n.universe_id AND t.node = n.node""",
    "p1_descendants": _TREE
    + """SELECT universe_id, a.step AS ancestor, node, depth - a.at AS distance
FROM (SELECT universe_id, node, depth, unnest(steps) AS step, generate_subscripts(steps, 1) - 1 AS at FROM tree) a WHERE a.at < depth""",
}
