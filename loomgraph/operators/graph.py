"""Operators on a property graph of nodes (universe_id, id, type, label, subtype) and edges
(universe_id, rel, src, dst, count, predicate).  All work on every universe at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.skew import lookup_join, paired
from loomgraph.session import cut

#: Edges of a node, in each direction, that a neighbourhood step looks at.
FAN_OUT = 200


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key. Spark keeps only k rows of a key per task before it shuffles."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)


def counted_nodes(nodes: DataFrame, edges: DataFrame, rel: str, limit: int | None = None) -> DataFrame:
    """Nodes with their number of inbound ``rel`` edges, the most first (ties by id), per universe."""
    n = edges.filter(F.col("rel") == rel).groupBy("universe_id", F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    out = nodes.join(n, ["universe_id", "id"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out if limit is None else top_rows(out, ["universe_id"], [F.desc("n"), F.col("id")], limit).drop("rank")


def graph_stats(nodes: DataFrame) -> DataFrame:
    of = lambda t: F.count_if(F.col("type") == t)
    return nodes.groupBy("universe_id").agg(of("Document").alias("documents"), of("Entity").alias("entities"), of("Topic").alias("topics"), of("Chunk").alias("chunks"))


#: A target of more edges of one relation than this is hot: its sources are not paired with each other.
HOT_TARGET = 1_000


def most_shared(edges: DataFrame, rel: str, k: int, docs: DataFrame | None = None, hot: int = HOT_TARGET) -> DataFrame:
    """(universe_id, doc, other, shared, rank): for each document the k others with most common ``rel`` targets.

    ``docs`` (universe_id, doc) are the documents asked for, all if null.  Ties rank by id.

    Exact without pairing the sources of a hot target: documents that share another target
    are paired there, and their common hot targets are counted from the sets of hot targets
    that both have.  Of documents that share nothing but hot targets only the k + 1 first of
    each set of hot targets can be among the k best, so sets are paired in place of documents.
    """
    e = edges.filter((F.col("rel") == rel) & F.col("src").startswith("doc:")).select("universe_id", "src", "dst").distinct()
    degree = e.groupBy("universe_id", "dst").agg(F.count(F.lit(1)).alias("n"))
    marked = lookup_join(e, degree.select("universe_id", "dst", (F.col("n") > hot).alias("hot")), ["universe_id", "dst"])
    key = ["universe_id", "src"]
    sets = marked.filter("hot").groupBy(*key).agg(F.sort_array(F.collect_set("dst")).alias("set"))  # at most edges / hot targets
    cold = marked.filter("NOT hot").select("universe_id", "dst", "src")
    asked = e.select(*key).distinct() if docs is None else docs.select("universe_id", F.col("doc").alias("src")).distinct()
    left = cold.select("universe_id", "dst", F.col("src").alias("doc"))
    left = left if docs is None else left.join(docs.select("universe_id", "doc").distinct(), ["universe_id", "doc"], "left_semi")
    met = left.join(cold.select("universe_id", "dst", F.col("src").alias("other")), ["universe_id", "dst"]).filter("doc <> other").groupBy("universe_id", "doc", "other").agg(F.count(F.lit(1)).alias("cold"))
    of = lambda c, name: sets.select("universe_id", F.col("src").alias(c), F.col("set").alias(name))
    both = met.join(of("doc", "s1"), ["universe_id", "doc"], "left").join(of("other", "s2"), ["universe_id", "other"], "left")
    near = both.select("universe_id", "doc", "other", (F.col("cold") + F.coalesce(F.when(F.col("s1").isNotNull() & F.col("s2").isNotNull(), F.size(F.array_intersect("s1", "s2"))), F.lit(0))).alias("shared"))
    # Sets of hot targets, each with its first documents.
    first = top_rows(sets, ["universe_id", "set"], [F.col("src")], k + 1, "r").select("universe_id", "set", F.col("src").alias("other"))
    mine = sets.join(asked, key, "left_semi")
    own = mine.select("universe_id", F.col("set").alias("s1")).distinct().select("universe_id", "s1", F.explode("s1").alias("t"))
    theirs = first.select("universe_id", F.col("set").alias("s2")).distinct().select("universe_id", "s2", F.explode("s2").alias("t"))
    common = own.join(theirs, ["universe_id", "t"]).groupBy("universe_id", "s1", "s2").agg(F.count(F.lit(1)).alias("shared"))
    best = top_rows(common.join(first.withColumnRenamed("set", "s2"), ["universe_id", "s2"]), ["universe_id", "s1"], [F.desc("shared"), F.col("other")], k + 1, "r")
    far = mine.select("universe_id", F.col("src").alias("doc"), F.col("set").alias("s1")).join(best.select("universe_id", "s1", "other", "shared"), ["universe_id", "s1"]).filter("doc <> other")
    every = near.unionByName(far.select("universe_id", "doc", "other", "shared")).groupBy("universe_id", "doc", "other").agg(F.max("shared").alias("shared"))
    return top_rows(every.withColumn("shared", F.col("shared").cast("long")), ["universe_id", "doc"], [F.desc("shared"), F.col("other")], k)


#: Channels of related documents, in order, with their weights and reasons.
RELATED_CHANNELS = {
    "entities": ("MENTIONS", 1.0, "shared entities"),
    "topics": ("ABOUT", 0.7, "shared topics"),
    "references": ("REFERENCES_DOC", 1.5, "cross-document reference"),
}


def related_documents(edges: DataFrame, via: str = "all", k: int = 8, docs: DataFrame | None = None, hot: int = HOT_TARGET) -> DataFrame:
    """(universe_id, doc, other, score, reason, rank): documents with common entities or topics, or a reference.

    Of entities and topics the 2 k best of a document count, as found by :func:`most_shared`;
    a reference counts in both directions.
    """
    parts = []
    for at, (name, (rel, weight, reason)) in enumerate(RELATED_CHANNELS.items()):
        if via not in (name, "all"):
            continue
        if name == "references":
            r = edges.filter((F.col("rel") == rel) & (F.col("src") != F.col("dst")))
            met = both_ways(r).select("universe_id", F.col("at").alias("doc"), "other", F.lit(1).cast("long").alias("shared"))
            met = met if docs is None else met.join(docs.select("universe_id", "doc").distinct(), ["universe_id", "doc"], "left_semi")
        else:
            met = most_shared(edges, rel, 2 * k, docs, hot).drop("rank")
        parts.append(met.select("universe_id", "doc", "other", (F.col("shared") * weight).alias("s"), F.struct(F.lit(at).alias("at"), F.lit(reason).alias("reason")).alias("why")))
    if not parts:
        raise ValueError(f"unknown channel: {via}")
    scored = reduce(DataFrame.unionByName, parts).groupBy("universe_id", "doc", "other").agg(
        F.round(F.sum("s"), 6).alias("score"), F.array_join(F.transform(F.sort_array(F.collect_list("why")), lambda w: w["reason"]), "; ").alias("reason")
    )
    return top_rows(scored, ["universe_id", "doc"], [F.desc("score"), F.col("other")], k)


def similar_documents(edges: DataFrame, least: int = 3, block: int = 1_000) -> DataFrame:
    """(universe_id, a, b, shared): pairs of documents with at least ``least`` common entities and no reference between them.

    The documents of a hot entity are paired by many tasks (:func:`paired`).
    """
    e = edges.filter((F.col("rel") == "MENTIONS") & F.col("src").startswith("doc:")).select("universe_id", "dst", "src").distinct()
    # A document with fewer targets than ``least`` is in no pair.
    enough = e.groupBy("universe_id", "src").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    e = e.join(enough.select("universe_id", "src"), ["universe_id", "src"], "left_semi")
    x, y = e.select("universe_id", "dst", F.col("src").alias("a")), e.select("universe_id", "dst", F.col("src").alias("b"))
    pairs = paired(x, y, ["universe_id", "dst"], block).filter("a < b").groupBy("universe_id", "a", "b").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least)
    refs = edges.filter(F.col("rel") == "REFERENCES_DOC").select("universe_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return pairs.join(refs, ["universe_id", "a", "b"], "left_anti")


def centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree of each node over the largest degree in its universe; a self-loop counts once."""
    ends = edges.select("universe_id", F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"))
    degree = nodes.join(ends.groupBy("universe_id", "id").agg(F.count(F.lit(1)).alias("degree")), ["universe_id", "id"], "left")
    degree = degree.withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
    most = degree.groupBy("universe_id").agg(F.greatest(F.max("degree"), F.lit(1)).alias("most"))
    return degree.join(most, "universe_id").select("universe_id", "id", "degree", (F.col("degree") / F.col("most")).alias("centrality"))


def entity_triples(edges: DataFrame, k: int = 10) -> DataFrame:
    """Up to k triples of each entity, those that start at it first."""
    e = edges.filter(F.col("rel") == "RELATED").withColumn("predicate", F.coalesce("predicate", F.lit("related_to")))
    out = e.select("universe_id", F.col("src").alias("id"), F.lit("out").alias("direction"), "predicate", F.col("dst").alias("other"))
    into = e.select("universe_id", F.col("dst").alias("id"), F.lit("in").alias("direction"), "predicate", F.col("src").alias("other"))
    return top_rows(out.unionByName(into), ["universe_id", "id"], [F.desc("direction"), F.col("other"), F.col("predicate")], k)


def entity_details(nodes: DataFrame, edges: DataFrame, triples: int = 8, documents: int = 5) -> DataFrame:
    """Entities with their first ``triples`` and the ``documents`` that mention them most, each list joined by ``; `` (null if empty)."""
    listed = lambda of, c, name: of.groupBy("universe_id", "id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", c.alias("x")))), lambda y: y["x"]), "; ").alias(name))
    t = listed(entity_triples(edges, triples), F.concat_ws(" ", "direction", "predicate", "other"), "triples")
    m = listed(documents_for_entity(edges, documents), F.col("doc"), "documents")
    return nodes.join(t, ["universe_id", "id"], "left").join(m, ["universe_id", "id"], "left")


def documents_for_entity(edges: DataFrame, k: int = 5) -> DataFrame:
    e = edges.filter((F.col("rel") == "MENTIONS") & F.col("src").startswith("doc:")).select("universe_id", F.col("dst").alias("id"), F.col("src").alias("doc"), "count")
    return top_rows(e, ["universe_id", "id"], [F.desc("count"), F.col("doc")], k)


def chunks_for_entity(edges: DataFrame, k: int = 8) -> DataFrame:
    """(universe_id, id, chunk, document, count, rank): the chunks that mention an entity most, with the document that holds them."""
    m = edges.filter((F.col("rel") == "MENTIONS") & ~F.col("src").startswith("doc:")).select("universe_id", F.col("dst").alias("id"), F.col("src").alias("chunk"), F.coalesce("count", F.lit(1).cast("long")).alias("count"))
    best = top_rows(m, ["universe_id", "id"], [F.desc("count"), F.col("chunk")], k)
    held = edges.filter(F.col("rel") == "CONTAINS").groupBy("universe_id", F.col("dst").alias("chunk")).agg(F.min("src").alias("document"))
    return best.join(held, ["universe_id", "chunk"], "left").select("universe_id", "id", "chunk", "document", "count", "rank")


def both_ways(edges: DataFrame, *more: str) -> DataFrame:
    """Every edge seen from both ends: (universe_id, at, other, rel, src, dst and the columns ``more``)."""
    out = edges.select("universe_id", F.col("src").alias("at"), F.col("dst").alias("other"), "rel", "src", "dst", *more)
    return out.unionByName(edges.select("universe_id", F.col("dst").alias("at"), F.col("src").alias("other"), "rel", "src", "dst", *more))


def steps_from(edges: DataFrame, at: DataFrame, only: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """The edges at the nodes ``at`` (universe_id, at): (universe_id, at, other, rel, src, dst, count, predicate).

    Of a node and direction the first FAN_OUT edges in the order (rel, src, dst) count, before
    the relations are filtered.  Only edges of the nodes asked for are ranked.
    """
    order = [F.col("rel"), F.col("src"), F.col("dst")]
    kept = edges.select("universe_id", "rel", "src", "dst", "count", "predicate")
    asked = at.select("universe_id", "at").distinct()
    out, into = (
        top_rows(kept.withColumn("at", F.col(here)).join(asked, ["universe_id", "at"], "left_semi"), ["universe_id", "at"], order, FAN_OUT, "r").drop("r").withColumn("other", F.col(there))
        for here, there in (("src", "dst"), ("dst", "src"))
    )
    steps = out.unionByName(into)
    if only is not None:
        steps = steps.filter(F.col("rel").isin(*only))
    if without:
        steps = steps.filter(~F.col("rel").isin(*without))
    return steps


def neighbourhood(edges: DataFrame, roots: DataFrame, depth: int = 1, only: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """(universe_id, root, rel, src, dst, count, predicate, hop): edges met in ``depth`` steps from each root.

    ``roots`` has (universe_id, root).  See :func:`steps_from` for the edges of a step.
    """
    frontier = roots.select("universe_id", "root", F.col("root").alias("at"))
    seen, found = frontier, None
    for hop in range(1, depth + 1):
        met = frontier.join(steps_from(edges, frontier, only, without), ["universe_id", "at"]).withColumn("hop", F.lit(hop))
        if hop < depth:
            met = cut(met)
        found = met if found is None else found.unionByName(met)
        frontier = met.select("universe_id", "root", F.col("other").alias("at")).distinct().join(seen, ["universe_id", "root", "at"], "left_anti")
        seen = seen.unionByName(frontier)
    return found.groupBy("universe_id", "root", "rel", "src", "dst", "count", "predicate").agg(F.min("hop").alias("hop"))


def per_neighbour(around: DataFrame) -> DataFrame:
    """(universe_id, root, id, relations, predicates, direction): the edges at the root by neighbour.

    Lists are joined by ``|``; the direction is that of the last edge in the order (rel, src, dst).
    """
    own = around.filter((F.col("src") == F.col("root")) != (F.col("dst") == F.col("root")))
    is_out = F.col("src") == F.col("root")
    return own.groupBy("universe_id", "root", F.when(is_out, F.col("dst")).otherwise(F.col("src")).alias("id")).agg(
        F.array_join(F.sort_array(F.collect_set("rel")), "|").alias("relations"),
        F.array_join(F.sort_array(F.collect_set("predicate")), "|").alias("predicates"),
        F.max_by(F.when(is_out, F.lit("out")).otherwise(F.lit("in")), F.struct("rel", "src", "dst")).alias("direction"),
    )


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = 4) -> DataFrame:
    """(universe_id, start, goal, path array<string>): a shortest undirected path of each pair.

    ``pairs`` has (universe_id, start, goal).  Of several the smallest path counts.  Pairs
    without a path of at most ``max_hops`` are left out.  Each start's front is one set of
    rows that grows by a join a hop, and a node is entered once for each start.
    """
    steps = both_ways(edges).select("universe_id", "at", "other").distinct()
    front = pairs.select("universe_id", "start", F.col("start").alias("at")).distinct().withColumn("path", F.array("at"))
    seen = front.select("universe_id", "start", "at")
    reached = front
    for _ in range(max_hops):
        met = front.join(steps, ["universe_id", "at"]).groupBy("universe_id", "start", "other").agg(F.min("path").alias("path"))
        met = met.select("universe_id", "start", F.col("other").alias("at"), F.concat("path", F.array("other")).alias("path"))
        front = cut(met.join(seen, ["universe_id", "start", "at"], "left_anti"))
        seen = seen.unionByName(front.select("universe_id", "start", "at"))
        reached = reached.unionByName(front)
    return pairs.join(reached.withColumnRenamed("at", "goal"), ["universe_id", "start", "goal"]).select("universe_id", "start", "goal", "path")


def path_hops(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(universe_id, start, goal, hop, here, there, rel, src, dst, predicate): an edge for each step of the paths, the first in the order (rel, src, dst)."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct((i - 1).alias("hop"), F.get("path", i - 1).alias("here"), F.get("path", i).alias("there")))
    steps = paths.filter(F.size("path") > 1).select("universe_id", "start", "goal", F.explode(pairs).alias("p")).select("universe_id", "start", "goal", "p.*")
    seen = both_ways(edges, "predicate").select("universe_id", F.col("at").alias("here"), F.col("other").alias("there"), F.struct("rel", "src", "dst", "predicate").alias("e"))
    return steps.join(seen, ["universe_id", "here", "there"]).groupBy("universe_id", "start", "goal", "hop", "here", "there").agg(F.min("e").alias("e")).select("universe_id", "start", "goal", "hop", "here", "there", "e.*")


def path_narrative(hops: DataFrame, nodes: DataFrame) -> DataFrame:
    """(universe_id, start, goal, narrative): the hops in words, ``A --[REL:predicate]--> B`` or ``B <--[REL]-- C``, separated by `` | ``."""
    names = nodes.groupBy("universe_id", "id").agg(F.min("label").alias("label"))
    near, far = (names.select("universe_id", F.col("id").alias(c), F.col("label").alias(f"l_{c}")) for c in ("here", "there"))
    h = hops.join(near, ["universe_id", "here"], "left").join(far, ["universe_id", "there"], "left")
    mark = F.when((F.col("rel") == "RELATED") & F.col("predicate").isNotNull(), F.concat_ws(":", "rel", "predicate")).otherwise(F.col("rel"))
    a, b = F.coalesce("l_here", "here"), F.coalesce("l_there", "there")
    said = F.when(F.col("src") == F.col("here"), F.concat(a, F.lit(" --["), mark, F.lit("]--> "), b)).otherwise(F.concat(a, F.lit(" <--["), mark, F.lit("]-- "), b))
    told = h.groupBy("universe_id", "start", "goal").agg(F.sort_array(F.collect_list(F.struct("hop", said.alias("said")))).alias("all"))
    return told.select("universe_id", "start", "goal", F.array_join(F.transform("all", lambda x: x["said"]), " | ").alias("narrative"))


def browser_view(nodes: DataFrame, edges: DataFrame, types: list[str], needle: str = "") -> tuple[DataFrame, DataFrame]:
    """Nodes of the visible types whose label contains ``needle`` (in any case), and the edges with both ends among them."""
    n = nodes.filter(F.col("type").isin(*types) & F.lower("label").contains(needle.lower()))
    ids = n.select("universe_id", "id")
    e = edges.join(ids.withColumnRenamed("id", "src"), ["universe_id", "src"], "left_semi").join(ids.withColumnRenamed("id", "dst"), ["universe_id", "dst"], "left_semi")
    return n, e


def expanded_view(nodes: tuple[DataFrame, DataFrame], edges: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """A view and what a further look added: nodes once by id, edges once by ends and relation."""
    return nodes[0].unionByName(nodes[1]).dropDuplicates(["universe_id", "id"]), edges[0].unionByName(edges[1]).dropDuplicates(["universe_id", "rel", "src", "dst"])


def get_nodes(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes with the asked ids (id, and universe_id if it is there); unknown ids give no rows."""
    keys = [c for c in ("universe_id", "id") if c in ids.columns]
    return nodes.join(ids.select(*keys).distinct(), keys, "left_semi")


def describe(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Type and label of the asked (universe_id, pos, id), in that order; unknown ids count as documents."""
    named = nodes.select("universe_id", "id", "type", "label")
    return ids.join(named, ["universe_id", "id"], "left").select(
        "universe_id", "pos", "id", F.coalesce("type", F.lit("Document")).alias("type"), F.coalesce("label", "id").alias("label")
    )


def merge_nodes(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges after every ``loser`` of ``mapping`` (universe_id, loser, winner) became its winner.

    Self-loops drop out, and of edges that fall together one row stays: an untouched one
    first, then the one from the smallest old ends.  Counts are not added.
    """
    m = mapping.select("universe_id", "loser", "winner")
    s = lookup_join(edges, m.select("universe_id", F.col("loser").alias("src"), F.col("winner").alias("s2")), ["universe_id", "src"], "left")
    d = lookup_join(s, m.select("universe_id", F.col("loser").alias("dst"), F.col("winner").alias("d2")), ["universe_id", "dst"], "left")
    moved = d.select("universe_id", "rel", F.coalesce("s2", "src").alias("ns"), F.coalesce("d2", "dst").alias("nd"), (F.col("s2").isNotNull() | F.col("d2").isNotNull()).alias("moved"), "src", "dst", "count", "predicate")
    kept = moved.filter("ns <> nd").groupBy("universe_id", "rel", "ns", "nd").agg(F.min(F.struct("moved", "src", "dst", "count", "predicate")).alias("m"))
    return kept.select("universe_id", "rel", F.col("ns").alias("src"), F.col("nd").alias("dst"), "m.count", "m.predicate")


def remove_documents(nodes: DataFrame, edges: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the documents (universe_id, id) and the chunks that they contain."""
    chunks = edges.filter(F.col("rel") == "CONTAINS").join(docs.select("universe_id", F.col("id").alias("src")), ["universe_id", "src"], "left_semi")
    gone = docs.select("universe_id", "id").unionByName(chunks.select("universe_id", F.col("dst").alias("id"))).distinct()
    left = nodes.join(gone, ["universe_id", "id"], "left_anti")
    e = edges.join(gone.withColumnRenamed("id", "src"), ["universe_id", "src"], "left_anti").join(gone.withColumnRenamed("id", "dst"), ["universe_id", "dst"], "left_anti")
    return left, e.select(edges.columns)


def orphan_chunks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    held = edges.filter(F.col("rel") == "CONTAINS").select("universe_id", F.col("dst").alias("id"))
    return nodes.filter(F.col("type") == "Chunk").join(held, ["universe_id", "id"], "left_anti")


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each (universe_id, rel, src, dst): counts add up (a missing new one is 1), new predicates win."""
    a = old.select("universe_id", "rel", "src", "dst", F.coalesce("count", F.lit(0)).alias("count"), F.lit(0).alias("v"), "predicate")
    b = new.select("universe_id", "rel", "src", "dst", F.coalesce("count", F.lit(1)).alias("count"), F.lit(1).alias("v"), "predicate")
    return a.unionByName(b).groupBy("universe_id", "rel", "src", "dst").agg(
        F.sum("count").cast("long").alias("count"), F.max(F.when(F.col("predicate").isNotNull(), F.struct("v", "predicate")))["predicate"].alias("predicate")
    )


def upsert_nodes(old: DataFrame, new: DataFrame, aliases: int = 20) -> DataFrame:
    """Merged nodes (universe_id, id, type, label, aliases): new values win, aliases unite, old ones first."""
    a = old.select("universe_id", "id", *[F.col(c).alias(f"o_{c}") for c in ("type", "label", "aliases")])
    b = new.select("universe_id", "id", *[F.col(c).alias(f"n_{c}") for c in ("type", "label", "aliases")])
    none = F.array().cast("array<string>")
    both = F.array_distinct(F.concat(F.coalesce("o_aliases", none), F.coalesce("n_aliases", none)))
    return a.join(b, ["universe_id", "id"], "full").select(
        "universe_id", "id", F.coalesce("n_type", "o_type").alias("type"), F.coalesce("n_label", "o_label").alias("label"), F.slice(both, 1, aliases).alias("aliases")
    )


def overview(nodes: DataFrame, edges: DataFrame, limit: int = 120, edge_limit: int = 3_000) -> tuple[DataFrame, DataFrame]:
    """The first nodes by type order and the edges among them, cut before their ends are checked."""
    rank = F.when(F.col("type") == "Domain", 0).when(F.col("type") == "Topic", 1).when(F.col("type") == "Document", 2).when(F.col("type") == "Entity", 3)
    n = top_rows(nodes.withColumn("t", rank).filter("t IS NOT NULL"), ["universe_id"], [F.col("t"), F.col("id")], 4 * limit).drop("t", "rank")
    e = edges.filter(~F.col("rel").isin("CONTAINS", "TAGGED"))
    e = top_rows(e, ["universe_id"], [F.col("rel"), F.col("src"), F.col("dst")], edge_limit).drop("rank")
    ids = n.select("universe_id", "id")
    e = e.join(ids.withColumnRenamed("id", "src"), ["universe_id", "src"], "left_semi").join(ids.withColumnRenamed("id", "dst"), ["universe_id", "dst"], "left_semi")
    return n, e
