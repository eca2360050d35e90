"""Fusing ranked lists, and re-ranking by the graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import neighbourhood, top_rows
from loomgraph.operators.search import bm25
from loomgraph.operators.skew import sent_if_small
from loomgraph.operators.vectors import by_source_id, cosine, knn

RRF_K = 60
#: Weight of a relation in expansion; others count 0.3.
REL_WEIGHTS = {"CONTAINS": 0.3, "ABOUT": 0.6, "MENTIONS": 0.5, "RELATED": 0.7, "PART_OF": 0.5, "REFERENCES_DOC": 0.6, "SIMILAR_TO": 0.5, "IN_DOMAIN": 0.2, "TAGGED": 0.2, "DERIVED_FROM_DOC": 0.3}


def rrf(lists: list[DataFrame], keys: list[str], k: int) -> DataFrame:
    """(keys, id, score, rank) of ranked lists (keys, id, rank from 1), by reciprocal ranks.

    Equal scores are ordered by the list and rank where an id was first seen.
    """
    both = reduce(DataFrame.unionByName, [x.select(*keys, "id", "rank").withColumn("list", F.lit(i)) for i, x in enumerate(lists)])
    scored = both.groupBy(*keys, "id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 12).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    return top_rows(scored, keys, [F.desc("score"), F.col("first"), F.col("id")], k).drop("first")


def edge_signal(rel: Column, src: Column, count: Column) -> Column:
    """What an edge's count and weight add, at most 2; mentions have both, topics a weight of 1, other edges neither."""
    n = F.when(rel == "MENTIONS", F.coalesce(count, F.lit(0))).otherwise(0).cast("double")
    weight = F.when(rel == "ABOUT", 1.0).when((rel == "MENTIONS") & src.startswith("doc:"), 1.0).when(rel == "MENTIONS", F.least(F.lit(1.0), 0.3 + 0.1 * n)).otherwise(0.0)
    return F.least(F.lit(2.0), 1.0 + 0.3 * F.log1p(n) + 0.3 * weight)


def expand(fused: DataFrame, edges: DataFrame, records: DataFrame, queries: DataFrame, nodes: DataFrame, keys: list[str], seeds: int = 6, weight: float = 0.4, depth: int = 1) -> DataFrame:
    """(keys, id, score): fused hits and the neighbours of the first few, scored by the graph.

    ``records`` (universe_id, id, v) hold vectors of nodes, ``queries`` (keys, qv), ``nodes``
    (universe_id, id, centrality); the keys contain universe_id.  A neighbour scores weight *
    relation * centrality * similarity * edge signal, over its best relation and its
    strongest edge; hits keep their fused score.  An edge farther than one step counts for its
    source.  ``depth`` is 0 to 2; 0 changes nothing.
    """
    if depth <= 0:
        return fused.select(*keys, "id", "score")
    seed = top_rows(fused, keys, [F.desc("score"), F.col("id")], seeds, "s").select(*keys, F.col("id").alias("root"))
    table = F.create_map(*[F.lit(x) for kv in REL_WEIGHTS.items() for x in kv])
    around = neighbourhood(edges, seed.select("universe_id", "root").distinct(), min(depth, 2), without=["TAGGED"])
    other = F.when(F.col("src") == F.col("root"), F.col("dst")).otherwise(F.col("src"))
    near = around.select("universe_id", "root", other.alias("id"), F.coalesce(F.try_element_at(table, F.col("rel")), F.lit(0.3)).alias("w"), edge_signal(F.col("rel"), F.col("src"), F.col("count")).alias("e"))
    met = seed.join(near.filter("id <> root"), ["universe_id", "root"]).join(fused.select(*keys, "id"), [*keys, "id"], "left_anti").groupBy(*keys, "id").agg(F.max("w").alias("w"), F.max("e").alias("e"))
    scored = met.join(records.select("universe_id", "id", "v"), ["universe_id", "id"]).join(queries, keys).join(nodes.select("universe_id", "id", "centrality"), ["universe_id", "id"], "left")
    boost = weight * F.col("w") * F.greatest(F.lit(0.1), F.coalesce("centrality", F.lit(0.1))) * F.greatest(F.lit(0.1), (F.coalesce(cosine(F.col("v"), F.col("qv")), F.lit(0.0)) + 1) / 2) * F.col("e")
    return fused.select(*keys, "id", "score").unionByName(scored.select(*keys, "id", F.round(boost, 9).alias("score")))


def hydrate(hits: DataFrame, records: DataFrame) -> DataFrame:
    """Full-text hits (universe_id, source_id, kind, ...) with kind, domain, topics, keywords and time of their vector record, where there is one."""
    none = F.array().cast("array<string>")
    r = by_source_id(records, hits).select(
        "universe_id", "source_id", F.col("kind").alias("_kind"), F.col("domain").alias("_domain"), F.col("topics").alias("_topics"), F.col("keywords").alias("_keywords"), F.col("created_at").alias("_at")
    )
    own = [c for c in hits.columns if c not in ("kind", "domain", "topics", "keywords", "created_at")]
    return hits.join(r, ["universe_id", "source_id"], "left").select(
        *own, F.coalesce("_kind", "kind").alias("kind"), F.coalesce("_domain", F.lit("")).alias("domain"), F.coalesce("_topics", none).alias("topics"),
        F.coalesce("_keywords", none).alias("keywords"), F.coalesce("_at", F.lit(0).cast("long")).alias("created_at"),
    )


def hybrid_search(docs: DataFrame, records: DataFrame, asked: DataFrame, k: int, kinds: list[str] | None = None, graph: tuple[DataFrame, DataFrame, DataFrame] | None = None, depth: int = 0, weight: float = 0.4) -> DataFrame:
    """(universe_id, qid, id, score, rank): the k best of each universe for each query.

    ``docs`` (universe_id, id, title, text, kind) are all full-text rows, of which ``kinds``
    can be hits; ``records`` (universe_id, id, v) those that can be vector hits; ``asked`` has
    qid, query and qv.  The 2 k best of both are fused by rank and, with ``graph`` (edges,
    records, nodes with centrality) and a ``depth``, expanded.
    """
    keys = ["universe_id", "qid"]
    queries = docs.select("universe_id").union(records.select("universe_id")).distinct().crossJoin(sent_if_small(asked.select("qid", "qv")))
    vec = knn(records, queries, 2 * k, keys=["universe_id"])
    fts = bm25(docs, asked.select("qid", "query"), 2 * k, group="universe_id", kinds=kinds)
    fused = rrf([vec, fts], keys, 2 * k)
    if graph and depth:
        edges, nodes_v, nodes = graph
        return top_rows(expand(fused, edges, nodes_v, queries, nodes, keys, weight=weight, depth=depth), keys, [F.desc("score"), F.col("id")], k)
    return fused.filter(F.col("rank") <= k)


def across_universes(per: DataFrame, k: int) -> DataFrame:
    """(qid, universe_id, id, score, rank): the k best over all universes by their ranks alone; ties by rank, universe and id."""
    scored = per.withColumn("score", F.round(1.0 / (RRF_K + F.col("rank")), 12)).withColumnRenamed("rank", "r")
    return top_rows(scored, ["qid"], [F.desc("score"), F.col("r"), F.col("universe_id"), F.col("id")], k).drop("r")


def best_sources(hits: DataFrame, keys: list[str], limit: int = 40) -> DataFrame:
    """One row for each source, its highest score, and of those the ``limit`` best of each key (earlier ones first)."""
    one = hits.groupBy(*keys, "source_id").agg(F.max("score").alias("score"), F.min("seq").alias("seq"))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "seq", "source_id"))).filter(F.col("rank") <= limit)


def linked_references(refs: DataFrame, docs: DataFrame, records: DataFrame, threshold: float, top: int = 3) -> DataFrame:
    """(universe_id, document, ref, id, score): the document of its universe that each reference most likely means.

    ``refs`` has universe_id, document, ref and its vector qv; ``docs`` universe_id, id, title,
    text and kind; ``records`` universe_id, id and v.  The ``top`` best by full text and by
    vectors are fused by rank, the document itself is dropped, and the best of the rest is
    kept if it scores at least ``threshold``.
    """
    asked = refs.groupBy("universe_id", F.col("ref").alias("qid")).agg(F.first("qv").alias("qv"))
    fts = bm25(docs, asked.select("universe_id", "qid", F.col("qid").alias("query")), top, group="universe_id")
    vec = knn(records, asked, top, keys=["universe_id"])
    found = rrf([fts, vec], ["universe_id", "qid"], 2 * top).withColumnRenamed("qid", "ref")
    met = refs.select("universe_id", "document", "ref").distinct().join(found, ["universe_id", "ref"]).filter("id <> document")
    best = top_rows(met, ["universe_id", "document", "ref"], [F.col("rank")], 1, "place")
    return best.filter(F.col("score") >= threshold).select("universe_id", "document", "ref", "id", "score")


def analyzer_context(known: DataFrame, asked: DataFrame, entities: int = 25, topics: int = 15) -> DataFrame:
    """(universe_id, qid, kind, id, name, place): known names that an analysis of a text should reuse.

    ``known`` has universe_id, id, kind (entity or topic), title and v, ``asked`` universe_id,
    qid and qv, the vector of a text's beginning.  Of the nearest 2 ``entities`` and 2
    ``topics`` each name (in any case) counts once; the first of them are kept.
    """
    out = None
    for kind, n in (("entity", entities), ("topic", topics)):
        own = known.filter(F.col("kind") == kind)
        near = knn(own, asked, 2 * n, keys=["universe_id"]).join(own.select("universe_id", "id", F.col("title").alias("name")), ["universe_id", "id"])
        named = near.filter(F.coalesce(F.col("name"), F.lit("")) != "").withColumn("low", F.lower("name"))
        once = top_rows(named, ["universe_id", "qid", "low"], [F.col("rank")], 1, "r")
        best = top_rows(once, ["universe_id", "qid"], [F.col("rank")], n, "place").select("universe_id", "qid", F.lit(kind).alias("kind"), "id", "name", "place")
        out = best if out is None else out.unionByName(best)
    return out
