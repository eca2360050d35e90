"""The catalogue of parameterised tools, one method each; every method returns a DataFrame.

Model calls (embedding, judging, answering) are functions that the caller passes in; the
embedder has a deterministic default, so everything else can be tested without a model.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import gate
from loomgraph.operators import graph as G
from loomgraph.operators.ranking import across_universes, hybrid_search
from loomgraph.operators.vectors import knn, sample_diverse, sample_random, sample_recent, usable, vector_filter
from loomgraph.session import cut, table
from loomgraph.sources.knowledge import edges, latest_vectors, nodes

#: Candidates of a gated tool that are kept at most, of a navigation, and most sources of a summary.
KEPT, KEPT_STEPS, MOST_SOURCES = 6, 3, 12


def hashed_embedding(text: str, dim: int = 64) -> list[float]:
    """A unit vector from the words of ``text``; equal texts have equal vectors."""
    v = [0.0] * dim
    for w in text.lower().split():
        h = hashlib.sha256(w.encode()).digest()
        v[h[0] % dim] += 1.0 if h[1] % 2 else -1.0
    n = sum(x * x for x in v) ** 0.5 or 1.0
    return [x / n for x in v]


class Engine:
    """Tools over the tables in ``sf_dir``. ``universes`` limits them to some tenants.

    ``judge`` gets (goal, tool, candidates) and returns its answer as a list of lines; see
    :mod:`loomgraph.operators.gate`.  Without one the first candidates are kept.
    """

    def __init__(
        self, spark: SparkSession, sf_dir: str, universes: list[str] | None = None, embed: Callable[[str], list[float]] = hashed_embedding,
        judge: Callable[[str, str, list[Row]], str] | None = None, goal: str = "",
    ):
        self.spark, self.dir, self.universes, self.embed, self.judge, self.goal = spark, sf_dir, universes, embed, judge, goal
        self.notes: DataFrame | None = None
        self.seen: DataFrame | None = None

    def _own(self, df: DataFrame) -> DataFrame:
        return df.filter(F.col("universe_id").isin(*self.universes)) if self.universes else df

    def _edges(self, *rels: str) -> DataFrame:
        return self._own(edges(self.spark, self.dir, *rels))

    def _nodes(self, *types: str) -> DataFrame:
        return self._own(nodes(self.spark, self.dir, *types))

    def _vectors(self, *kinds: str) -> DataFrame:
        return self._own(latest_vectors(self.spark, self.dir, *kinds)).filter(usable(F.col("vector")))

    def _range(self, name: str, value: int, low: int, high: int) -> int:
        if not low <= value <= high:
            raise ValueError(f"{name} must be in {low}..{high}")
        return value

    def compact(self, hits: DataFrame, tool: str, keep: int = KEPT, goal: str | None = None) -> DataFrame:
        """The hits (universe_id, id, rank) of a tool that a judge keeps, without their texts, and a note of all as evidence.

        (source_id, kind, title, relevance, why, universe_id, universe_name, rank).  A tool's
        hits are few: at most 30 of a search, or the edges that a neighbourhood looks at.
        """
        about = self._own(latest_vectors(self.spark, self.dir)).groupBy("universe_id", F.col("source_id").alias("id")).agg(F.max_by(F.struct("kind", "title", "text"), F.struct("created_at", "id")).alias("v"))
        named = self._nodes().groupBy("universe_id", "id").agg(F.min(F.struct("type", "label")).alias("n"))
        rows = hits.select("universe_id", "id", "rank").join(about, ["universe_id", "id"], "left").join(named, ["universe_id", "id"], "left")
        subjects = cut(rows.select(
            F.lit(0).alias("turn"), F.col("id").alias("source_id"), F.coalesce("v.kind", "n.type").alias("kind"), F.coalesce("v.title", "n.label", "id").alias("title"),
            F.coalesce("v.text", "n.label", "id").alias("text"), "universe_id", F.col("rank").alias("pos"), F.lit(tool).alias("tool"),
        ))
        self.seen = subjects if self.seen is None else self.seen.unionByName(subjects)
        answers: list[tuple] = []
        if self.judge:
            found = subjects.orderBy("pos", "source_id").collect()
            answers = [(0, None, self.judge(goal or self.goal, tool, found), None)] if found else []
        told = self.spark.createDataFrame(answers, "turn int, structured string, lines string, prose string")
        universes = table(self.spark, self.dir, "universes").select(F.col("id").alias("universe_id"), "name")
        return gate.compact_rows(gate.evaluate_relevance(subjects.select("turn", "source_id", "pos"), told, keep), subjects, universes).drop("turn").orderBy("rank")

    def vector_search(
        self, query: str, kinds: list[str] | None = None, top_k: int = 8, domain: str | None = None, expand_via_graph: bool = True, depth: int = 1, entity_type: str | None = None
    ) -> DataFrame:
        """Hybrid search in every universe, fused across universes by rank: (universe_id, id, score, rank).

        ``kinds`` filters hits, not the statistics of full text; ``domain`` filters vector
        hits only.  With ``depth`` 0 nothing is expanded.
        """
        self._range("top_k", top_k, 1, 30)
        self._range("depth", depth, 0, 2)
        every = self._own(latest_vectors(self.spark, self.dir))
        recs = every.filter(usable(F.col("vector")))
        newest = lambda df, name: df.groupBy("universe_id", F.col(name).alias("id")).agg(F.max_by("vector", F.struct("created_at", "id")).alias("v"))
        docs = every.select("universe_id", F.col("source_id").alias("id"), "title", "text", "kind")
        asked = self.spark.createDataFrame([(0, query, self.embed(query))], "qid int, query string, qv array<double>")
        graph = None
        if expand_via_graph and depth:
            e = self._edges()
            ends = e.select("universe_id", F.explode(F.array("src", "dst")).alias("id")).distinct()
            graph = (e, newest(recs, "graph_node_id"), G.centrality(ends, e))
        per = hybrid_search(docs, newest(vector_filter(recs, kinds, domain=domain, entity_type=entity_type), "source_id"), asked, top_k, kinds, graph, depth)
        return across_universes(per, top_k).select("universe_id", "id", "score", "rank")

    def entity_search(self, query: str, top_k: int = 8, type: str | None = None) -> DataFrame:
        """Entities with aliases, centrality, up to 8 triples and 5 documents."""
        hits = self.vector_search(query, ["entity"], top_k, expand_via_graph=False, entity_type=type)
        e = self._edges()
        ends = hits.select("universe_id", "id")
        central = G.centrality(e.select("universe_id", F.explode(F.array("src", "dst")).alias("id")).distinct(), e).select("universe_id", "id", "centrality")
        details = G.entity_details(self._nodes("Entity").join(ends, ["universe_id", "id"], "left_semi"), e.filter(F.col("rel").isin("RELATED", "MENTIONS")))
        return hits.join(details.select("universe_id", "id", "label", "subtype", "triples", "documents"), ["universe_id", "id"], "left").join(self._aliases(), ["universe_id", "id"], "left").join(central, ["universe_id", "id"], "left")

    def _aliases(self) -> DataFrame:
        from loomgraph.functions.text import merged_aliases

        e = self._own(table(self.spark, self.dir, "entities")).groupBy("universe_id", "id").agg(F.flatten(F.collect_list("aliases")).alias("a"))
        return e.select("universe_id", "id", merged_aliases(F.col("a"), F.array().cast("array<string>")).alias("aliases"))

    def find_entity_mentions(self, entity_id: str, top_k: int = 8) -> DataFrame:
        """Chunks, then documents, that mention an entity: (universe_id, id, document, position, count)."""
        m = self._edges("MENTIONS").filter(F.col("dst") == entity_id)
        self._range("top_k", top_k, 1, 20)
        chunks = self._own(table(self.spark, self.dir, "chunks")).select("universe_id", F.col("id").alias("src"), F.concat(F.lit("doc:"), "file_id").alias("document"), F.col("position_no").alias("position")).dropDuplicates(["universe_id", "src"])
        found = m.join(chunks, ["universe_id", "src"], "left").withColumn("document", F.coalesce("document", F.when(F.col("src").startswith("doc:"), F.col("src"))))
        return found.orderBy(F.desc("count"), "src").limit(top_k).select("universe_id", F.col("src").alias("id"), "document", "position", "count")

    def find_related_docs(self, document_id: str, via: str = "all", top_k: int = 8) -> DataFrame:
        e = self._edges("MENTIONS", "ABOUT", "REFERENCES_DOC")
        asked = e.filter((F.col("src") == document_id) | (F.col("dst") == document_id)).select("universe_id", F.lit(document_id).alias("doc")).distinct()
        return G.related_documents(e, via, self._range("top_k", top_k, 1, 30), asked)

    def find_path(self, universe: str, start: str, goal: str, max_hops: int = 4) -> DataFrame:
        """(universe_id, start, goal, path, narrative); no row if there is no path."""
        pair = self.spark.createDataFrame([(universe, start, goal)], "universe_id string, start string, goal string")
        e = self._edges().filter(F.col("universe_id") == universe)
        paths = G.shortest_paths(e, pair, self._range("max_hops", max_hops, 1, 6))
        return paths.join(G.path_narrative(G.path_hops(paths, e), self._nodes()), ["universe_id", "start", "goal"], "left")

    def topic_hierarchy(self, root: str | None = None) -> DataFrame:
        """All topics with path, depth and root, or those at and below ``root`` (a topic's slug)."""
        from loomgraph.operators.hierarchy import topic_hierarchy

        tree = topic_hierarchy(self._own(table(self.spark, self.dir, "relations")))
        return tree if root is None else tree.filter(F.array_contains("path", root) | (F.col("node") == root))

    def list_domains(self) -> DataFrame:
        return G.counted_nodes(self._nodes("Domain"), self._edges("IN_DOMAIN"), "IN_DOMAIN")

    def list_topics(self, limit: int = 50) -> DataFrame:
        return G.counted_nodes(self._nodes("Topic"), self._edges("ABOUT"), "ABOUT", self._range("limit", limit, 1, 200))

    def list_entities(self, limit: int = 50, type: str | None = None) -> DataFrame:
        n = self._nodes("Entity")
        n = n if type is None else n.filter(F.col("subtype") == type)
        return G.counted_nodes(n, self._edges("MENTIONS"), "MENTIONS", self._range("limit", limit, 1, 200)).join(self._aliases(), ["universe_id", "id"], "left")

    def graph_navigate(self, node_id: str, depth: int = 1, include_structural: bool = False, only: list[str] | None = None) -> DataFrame:
        """Neighbours incident to the node: (universe_id, id, relations, predicates, direction, rank)."""
        every = self._edges()
        roots = every.filter((F.col("src") == node_id) | (F.col("dst") == node_id)).select("universe_id", F.lit(node_id).alias("root")).distinct()
        skip = None if include_structural or only else ["CONTAINS", "TAGGED"]
        # Neighbours farther away are not reported, so one step is enough at any depth.
        self._range("depth", depth, 1, 3)
        near = G.per_neighbour(G.neighbourhood(every, roots, 1, only, skip)).drop("root")
        return G.top_rows(near.withColumn("all", F.lit(1)), ["all"], [F.col("universe_id"), F.col("id")], 2 * G.FAN_OUT).drop("all")

    def get_node(self, node_id: str) -> DataFrame:
        return G.get_nodes(self._nodes(), self.spark.createDataFrame([(node_id,)], "id string"))

    def get_document_summary(self, document_id: str) -> DataFrame:
        return self._own(latest_vectors(self.spark, self.dir, "doc_summary")).filter(F.col("source_id") == document_id).select("universe_id", "source_id", "title", "text", "domain", "topics", "keywords")

    def get_chunk(self, chunk_id: str) -> DataFrame:
        """A chunk with the document that holds it and its title, if they are known."""
        c = self._own(table(self.spark, self.dir, "chunks")).filter(F.col("id") == chunk_id).dropDuplicates(["id"])
        titles = self._own(latest_vectors(self.spark, self.dir, "doc_summary")).groupBy("universe_id", F.col("source_id").alias("document")).agg(F.max_by("title", F.struct("created_at", "id")).alias("document_title"))
        return c.withColumn("document", F.concat(F.lit("doc:"), "file_id")).join(titles, ["universe_id", "document"], "left")

    def sample_knowledge(self, kind: str = "doc_summary", n: int = 6, strategy: str = "diverse", seed: int = 42) -> DataFrame:
        v = self._vectors(kind).select("universe_id", "id", "created_at", F.col("vector").alias("v"))
        self._range("n", n, 1, 20)
        if strategy == "recent":
            return sample_recent(v, n, ["universe_id"]).select("universe_id", "id")
        if strategy == "random":
            return sample_random(v, n, ["universe_id"], seed).select("universe_id", "id")
        return sample_diverse(v, n, ["universe_id"]).select("universe_id", "id")

    def inspect(self, source_id: str) -> DataFrame:
        """The record behind an id, wherever it is: what was seen before, then vector records, chunks, and nodes.

        (universe_id, id, kind, title, text, from_cache); no row if it is nowhere.
        """
        v = self._own(latest_vectors(self.spark, self.dir)).filter(F.col("source_id") == source_id).select("universe_id", F.col("source_id").alias("id"), "kind", "title", "text", F.lit(1).alias("place"))
        c = self._own(table(self.spark, self.dir, "chunks")).filter(F.col("id") == source_id).select("universe_id", "id", F.lit("chunk").alias("kind"), F.lit(None).cast("string").alias("title"), "text", F.lit(2).alias("place"))
        n = self._nodes().filter(F.col("id") == source_id).select("universe_id", "id", F.col("type").alias("kind"), F.col("label").alias("title"), F.col("label").alias("text"), F.lit(3).alias("place"))
        found = v.unionByName(c).unionByName(n)
        if self.seen is not None:
            found = self.seen.filter(F.col("source_id") == source_id).select("universe_id", F.col("source_id").alias("id"), "kind", "title", "text", F.lit(0).alias("place")).unionByName(found)
        return found.orderBy("place", "universe_id").limit(1).withColumn("from_cache", F.col("place") == 0).drop("place")

    def summarize_subthread(self, source_ids: list[str], question: str, answer: Callable[[str, list[str]], str]) -> DataFrame:
        """``answer`` gets the question and the texts of up to 12 sources, a bounded set, in id order."""
        self._range("number of source_ids", len(source_ids), 1, MOST_SOURCES)
        v = latest_vectors(self.spark, self.dir).filter(F.col("source_id").isin(*source_ids)).select("source_id", "text").orderBy("source_id").limit(MOST_SOURCES).collect()
        return self.spark.createDataFrame([(answer(question, [r.text or "" for r in v]), [r.source_id for r in v])], "answer string, citations array<string>")

    def quote(self, source_id: str, question: str, answer: Callable[[str, list[str]], str]) -> DataFrame:
        return self.summarize_subthread([source_id], question, answer).select(F.col("answer").alias("quote"), "citations")

    def navigate(self, node_id: str, goal: str, depth: int = 1, keep: int = KEPT_STEPS) -> DataFrame:
        """The neighbours whose labels share most words with the goal."""
        near = self.graph_navigate(node_id, self._range("depth", depth, 1, 2)).drop("rank").join(self._nodes().select("universe_id", "id", "label"), ["universe_id", "id"])
        words = F.array(*[F.lit(w) for w in sorted(set(goal.lower().split()))] or [F.lit("")])
        fit = F.size(F.array_intersect(F.split(F.regexp_replace(F.lower("label"), "_", " "), " "), words))
        return G.top_rows(near.withColumn("fit", fit), ["universe_id"], [F.desc("fit"), F.col("id")], keep)

    def save_agent_note(self, universe: str, note_id: str, content: str, kind: str = "insight", links: list[str] | None = None) -> DataFrame:
        """Adds a note; links to nodes that don't exist are dropped."""
        if kind not in ("note", "insight", "preference", "fact"):
            raise ValueError(f"unknown kind of note: {kind}")
        self._range("length of content", len(content), 5, 2_000)
        self._range("number of links", len(links or []), 0, 20)
        note = self.spark.createDataFrame([(universe, note_id, content, kind, self.embed(content), links or [])], "universe_id string, id string, content string, kind string, v array<double>, links array<string>")
        real = note.select("universe_id", F.explode_outer("links").alias("l")).join(self._nodes().select("universe_id", F.col("id").alias("l")), ["universe_id", "l"], "left_semi").groupBy("universe_id").agg(F.sort_array(F.collect_set("l")).alias("links"))
        note = note.drop("links").join(real, "universe_id", "left")
        self.notes = note if self.notes is None else self.notes.filter(F.col("id") != note_id).unionByName(note)
        return note

    def note_links(self) -> DataFrame:
        """The DERIVED_FROM_DOC edges of the notes saved: (universe_id, rel, src, dst)."""
        if self.notes is None:
            return self.spark.createDataFrame([], "universe_id string, rel string, src string, dst string")
        return self.notes.select("universe_id", F.lit("DERIVED_FROM_DOC").alias("rel"), F.col("id").alias("src"), F.explode("links").alias("dst"))

    def remove_agent_note(self, note_id: str) -> None:
        if self.notes is not None:
            self.notes = self.notes.filter(F.col("id") != note_id)

    def recall_agent_memory(self, query: str, top_k: int = 5) -> DataFrame:
        stored = self._vectors("agent_note").select("universe_id", "id", F.col("vector").cast("array<double>").alias("v"), F.col("text").alias("content"), F.col("title").alias("kind"))
        if self.notes is not None:
            stored = stored.unionByName(self.notes.select("universe_id", "id", "v", "content", "kind"))
        q = self.spark.createDataFrame([(0, self.embed(query))], "qid int, qv array<double>")
        return knn(stored, q, self._range("top_k", top_k, 1, 20)).join(stored.select("id", "content", "kind"), "id").select("id", "content", "kind", "score", "rank").orderBy("rank")
