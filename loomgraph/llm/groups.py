"""Consolidating pairwise matches into groups: connected components on a two-dimensional grid.

Vertices are hashed into B blocks, and an edge goes to the grid cell of its two blocks.  Each
cell runs a local union-find and names for each of its vertices the smallest vertex of the
local component.  A vertex occurs in the cells of one row and column, so it gets at most B + 1
such names; the smallest becomes its parent.  For the next round a vertex is linked to its
parent's parent, and its other names to its parent.  When all names of every vertex agree, they are the component's smallest id.

A hub with a third of all edges is spread over B cells.  No task sees more than one cell's
share, no vertex gathers more than B + 1 rows, and the driver sees only counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import squeeze
from loomgraph.operators.skew import lookup_join
from loomgraph.session import cut, drop_cut

#: Edges that a grid cell holds on average.
CELL_EDGES = 200_000


def local_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest vertex of the component of each of ``n`` vertices, from edges ``a[i]``-``b[i]``."""
    parent = np.arange(n)
    while a.size:
        pa_, pb_ = parent[a], parent[b]
        apart = pa_ != pb_
        if not apart.any():
            break
        a, b, pa_, pb_ = a[apart], b[apart], pa_[apart], pb_[apart]
        np.minimum.at(parent, np.maximum(pa_, pb_), np.minimum(pa_, pb_))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all edges of a task; (v, rep) for each vertex seen."""
    kept = [b for b in batches if b.num_rows]
    if not kept:
        return
    edges = pa.Table.from_batches(kept)
    both = pa.chunked_array([*edges["a"].chunks, *edges["b"].chunks]).combine_chunks()
    words = both.dictionary_encode()
    names = words.dictionary
    order = pc.array_sort_indices(names).to_numpy()  # by bytes, which for UTF-8 is by code point
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    codes = rank[words.indices.to_numpy()]
    m = edges.num_rows
    rep = local_components(codes[:m], codes[m:], len(order))
    sorted_names = names.take(pa.array(order))
    out = pa.Table.from_arrays([sorted_names, sorted_names.take(pa.array(rep))], names=["v", "rep"])
    yield from out.to_batches(max_chunksize=50_000)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", cell_edges: int = CELL_EDGES) -> DataFrame:
    """(``id``, ``group_id``) of every vertex with an edge to another one.

    ``group_id`` is the smallest id (by code point) of all that are linked directly or
    indirectly.  Ids are strings.  Defined cases: edges with a null end and edges of a vertex
    with itself are ignored; repeated and reversed edges change nothing; no edges give no
    rows; other columns are ignored.
    """
    todo = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    todo = cut(todo)
    named: DataFrame | None = None
    while True:
        n = todo.count()
        # At least 3 blocks, so that all cores of a small cluster have a cell.
        blocks = max(3, ceil(sqrt(2 * n / cell_edges)))
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
        low, high = F.least(block("a"), block("b")), F.greatest(block("a"), block("b"))
        cells = blocks * (blocks + 1) // 2
        reps = todo.repartition(cells, low, high).mapInArrow(_cells, "v string, rep string")
        # One row for each vertex: its parent, and the other names that its cells gave it.
        parents = cut(
            reps.groupBy("v").agg(F.min("rep").alias("p"), F.collect_set("rep").alias("names")).select("v", "p", F.array_remove("names", F.col("p")).alias("others"))
        )
        drop_cut(todo)
        drop_cut(named)
        named = parents
        sizes = parents.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("others") > 0).alias("open")).first()
        vertices = sizes["n"]
        if not sizes["open"]:
            return named.select(F.col("v").alias("id"), F.col("p").alias("group_id"))
        # A vertex follows its parent's parent, and parents whose cells disagree are linked. The
        # even steps from any vertex end at the root of its tree, so no link is lost.
        children = parents.filter(F.col("v") != F.col("p")).select("v", "p")
        above = parents.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        up = lookup_join(children, above, ["p"], rows=vertices).select(F.col("v").alias("a"), F.col("pp").alias("b"))
        across = parents.select(F.explode("others").alias("a"), F.col("p").alias("b"))
        todo = cut(up.union(across))


def entity_links(entities: DataFrame, match_pairs: DataFrame) -> DataFrame:
    """(a, b) links of entity ids: accepted pairs of known ids, and shared names or aliases.

    Records that share a name are linked to the smallest id with that name in the same
    universe and type, not to one another.  Names are compared trimmed, with white-space runs
    as one space and in lower case; null and blank ones, and those of a null universe or type,
    link nothing.
    """
    ids = entities.select("id").filter(F.col("id").isNotNull()).distinct()
    pairs = match_pairs.filter(F.col("is_match") & F.col("left_id").isNotNull() & F.col("right_id").isNotNull()).select(
        F.col("left_id").alias("a"), F.col("right_id").alias("b")
    )
    known = lookup_join(lookup_join(pairs, ids.withColumnRenamed("id", "a"), ["a"], "left_semi"), ids.withColumnRenamed("id", "b"), ["b"], "left_semi")
    surfaces = F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), squeeze))
    keyed = (
        entities.filter(F.col("id").isNotNull() & F.col("universe_id").isNotNull() & F.col("type").isNotNull())
        .select("id", "universe_id", "type", F.explode(surfaces).alias("surface"))
        .filter(F.col("surface") != "")
    )
    # The key is a digest of a JSON array, in which no two triples look alike.
    keyed = keyed.select("id", F.sha2(F.to_json(F.array("universe_id", "type", "surface")), 256).alias("key"))
    first = keyed.groupBy("key").agg(F.min("id").alias("first"))
    shared = lookup_join(keyed, first, ["key"]).filter(F.col("id") != F.col("first")).select(F.col("id").alias("a"), F.col("first").alias("b"))
    return known.select("a", "b").unionByName(shared)


def entity_groups(entities: DataFrame, match_pairs: DataFrame, cell_edges: int = CELL_EDGES) -> DataFrame:
    """(``group_id``, ``entity_id``) of every record of a group of at least two.

    Rows of one id are one record.  See :func:`entity_links` for what links two records and
    :func:`connected_components` for nulls, repeats and empty tables.
    """
    found = connected_components(entity_links(entities, match_pairs), cell_edges=cell_edges)
    return found.select("group_id", F.col("id").alias("entity_id"))


def p2_found(spark, sf_dir):
    from loomgraph.session import table

    return entity_groups(table(spark, sf_dir, "entities"), table(spark, sf_dir, "match_pairs"))


_WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

QUERIES = {"p2_found": p2_found}
ORACLES = {
    "p2_found": rf"""
WITH RECURSIVE ids AS (SELECT DISTINCT id FROM entities),
surfaces AS (
  SELECT id, universe_id, type, unnest(list_append(coalesce(aliases, []), name)) AS s FROM entities
), keyed AS (
  SELECT DISTINCT id, universe_id, type, lower(regexp_replace(regexp_replace(s, '^{_WS}+|{_WS}+$', '', 'g'), '{_WS}+', ' ', 'g')) AS k FROM surfaces
), edges AS (
  SELECT left_id AS a, right_id AS b FROM match_pairs WHERE is_match AND left_id IN (FROM ids) AND right_id IN (FROM ids)
  UNION SELECT id, first FROM (SELECT id, min(id) OVER (PARTITION BY universe_id, type, k) AS first FROM keyed WHERE k <> '')
), sym AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach AS (SELECT DISTINCT a AS root, a AS v FROM sym UNION SELECT r.root, s.b FROM reach r JOIN sym s ON s.a = r.v)
SELECT min(root) AS group_id, v AS entity_id FROM reach GROUP BY v"""
}
