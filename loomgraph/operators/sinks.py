"""Sinks: tables after an upsert, a delete or a patch, and the graph after an analysis was written.

Parquet has no update in place, so each sink returns the whole new table as a plan of joins;
the caller writes it, by partition of universe where tables are partitioned so.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.chunking import chunk_title
from loomgraph.functions.text import merged_aliases, node_slug, predicate_name, surfaces, times_mentioned
from loomgraph.operators.graph import remove_documents, top_rows, upsert_edges
from loomgraph.operators.skew import lookup_join

#: Ids that vector records may have, and the most of one batch.
RECORD_ID = r"^[A-Za-z0-9_\-:.]+$"
BATCH_CAP = 5_000
#: Fixed value: characters of a chunk that its node keeps.
NODE_TEXT = 8_000


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """``old`` without the rows that have a key of ``new``, and ``new``, of which the last of a key in ``order`` counts (all if null)."""
    kept = lookup_join(old, new.select(*keys).distinct(), keys, "left_anti")
    last = new if order is None else top_rows(new, keys, [c.desc() for c in order], 1, "_last").drop("_last")
    return kept.select(*old.columns).unionByName(last.select(*old.columns))


def upsert_fts(fts: DataFrame, new: DataFrame) -> DataFrame:
    """Full-text rows, one for each (universe_id, source_id); of several new ones the greatest in (title, text) counts."""
    return replace_rows(fts, new, ["universe_id", "source_id"], [F.struct("title", "text")])


def delete_rows(table: DataFrame, gone: DataFrame) -> DataFrame:
    """``table`` without the rows that agree with a row of ``gone`` in all its columns (ids, files, sources)."""
    return lookup_join(table, gone.distinct(), gone.columns, "left_anti").select(*table.columns)


def asserted(c: Column, pattern: str = RECORD_ID) -> Column:
    """``c``, or an error in the job where it is null or doesn't match."""
    return F.when(F.coalesce(c.rlike(pattern), F.lit(False)), c).otherwise(F.raise_error(F.concat(F.lit("malformed id: "), F.coalesce(c, F.lit("null")))))


def upsert_vectors(old: DataFrame, new: DataFrame, cap: int | None = BATCH_CAP) -> DataFrame:
    """Vector records after the ids of ``new`` were deleted and its rows appended; two rows of one id in a batch both stay.

    ValueError if the batch has more than ``cap`` rows; malformed ids fail the job.
    """
    if cap is not None and new.limit(cap + 1).count() > cap:
        raise ValueError(f"a batch has at most {cap} records")
    return replace_rows(old, new.withColumn("id", asserted(F.col("id"))), ["id"])


def rekey_sources(records: DataFrame, mapping: DataFrame) -> DataFrame:
    """Records whose source and node ids follow ``mapping`` (universe_id, loser, winner)."""
    out = records
    for c in ("source_id", "graph_node_id"):
        m = mapping.select("universe_id", F.col("loser").alias(c), F.col("winner").alias("_to"))
        out = lookup_join(out, m, ["universe_id", c], "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    return out.select(*records.columns)


def patched(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with the columns of ``changes`` where they aren't null; rows that aren't there are not added."""
    cols = [c for c in changes.columns if c not in keys]
    new = changes.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in cols])
    met = lookup_join(table, new, keys, "left")
    return met.select(*[F.coalesce(f"_n_{c}", c).alias(c) if c in cols else F.col(c) for c in table.columns])


def json_field(c: Column, key: str) -> Column:
    """The value of a key of a JSON object as text; null if it isn't there or ``c`` is no object."""
    return F.get_json_object(c, f"$['{key}']")


def json_merged(c: Column, patch: Column) -> Column:
    """A JSON object after a shallow merge with ``patch``, whose keys win and come last; what is no object counts as empty."""
    none = F.from_json(F.lit("{}"), "map<string,variant>")
    old, new = F.coalesce(F.from_json(c, "map<string,variant>"), none), F.coalesce(F.from_json(patch, "map<string,variant>"), none)
    return F.to_json(F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new))


def json_set(c: Column, key: str, value: Column) -> Column:
    """A JSON object with one key set to ``value`` (a number, text or boolean)."""
    return json_merged(c, F.to_json(F.create_map(F.lit(key), value)))


def quote_literal(value: str) -> str:
    """``value`` as a SQL text literal; only for tools that can't bind values."""
    if not isinstance(value, str) or "\0" in value:
        raise ValueError("only text without NUL can be quoted")
    return "'" + value.replace("'", "''") + "'"


@dataclass
class Stored:
    """The three frames of a graph store.

    ``nodes``: universe_id, id, type, label, aliases, text.  ``edges``: universe_id, rel, src,
    dst, count, predicate.  ``fts``: universe_id, source_id, kind, file_id, graph_node_id,
    title, text.
    """

    nodes: DataFrame
    edges: DataFrame
    fts: DataFrame


_NODES = ["universe_id", "id", "type", "label", "aliases", "text"]
_EDGES = ["universe_id", "rel", "src", "dst", "count", "predicate"]
_FTS = ["universe_id", "source_id", "kind", "file_id", "graph_node_id", "title", "text"]


def chunk_mentions(texts: DataFrame, named: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chunk, id, count): how often the names of a thing are in a text, summed over its names, where they are.

    ``texts`` has the keys, chunk and text, ``named`` the keys, id, name and aliases.  Only
    texts and things with equal keys (a document) meet; its names, few, are copied to the
    tasks that share its texts.  Names of fewer than three characters are ignored.
    """
    wanted = named.select(*keys, "id", F.explode(surfaces(F.col("name"), F.col("aliases"))).alias("_s")).distinct()
    lists = wanted.groupBy(*keys).agg(F.collect_list(F.struct("id", "_s")).alias("_all"))
    met = lookup_join(texts.select(*keys, "chunk", "text"), lists, keys).select(*keys, "chunk", "text", F.explode("_all").alias("_one"))
    counted = met.select(*keys, "chunk", F.col("_one.id").alias("id"), times_mentioned(F.col("text"), F.col("_one._s")).alias("n")).filter("n > 0")
    return counted.groupBy(*keys, "chunk", "id").agg(F.sum("n").cast("long").alias("count"))


def write_analysis(old: Stored, documents: DataFrame, chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> Stored:
    """The store after documents with their analysis were written, each in place of what it held before.

    ``documents``: universe_id, id, file_id, title, summary, domain, topics, keywords (lists of
    names).  ``chunks``: universe_id, document, id, position, text, heading.  ``entities``:
    universe_id, document, name, type, aliases, and id (made of type and name if null).
    ``relations``: universe_id, document, kind (related, part_of), src_name, dst_name,
    predicate.  A relation counts if both names are known in its document (in any case) and
    differ.  Entities, topics and keywords of the documents before stay; the edges of the old
    documents and chunks go.
    """
    none = F.lit(None)
    u = "universe_id"
    text = lambda c: F.lit(c)
    gone = documents.select(u, "id").distinct()
    nodes, edges = remove_documents(old.nodes.select(*_NODES), old.edges.select(*_EDGES), gone)
    held = old.edges.filter(F.col("rel") == "CONTAINS").join(gone.withColumnRenamed("id", "src"), [u, "src"], "left_semi").select(u, F.col("dst").alias("source_id"))
    fts = delete_rows(old.fts.select(*_FTS), gone.withColumnRenamed("id", "source_id").unionByName(held))

    def node(df: DataFrame, id_: Column, kind: str, label: Column, aliases: Column | None = None, body: Column | None = None) -> DataFrame:
        return df.select(u, id_.alias("id"), text(kind).alias("type"), label.alias("label"), (none.cast("array<string>") if aliases is None else aliases).alias("aliases"), (none.cast("string") if body is None else body).alias("text"))

    def edge(df: DataFrame, rel: str, src: Column, dst: Column, count: Column | None = None, predicate: Column | None = None) -> DataFrame:
        return df.select(u, text(rel).alias("rel"), src.alias("src"), dst.alias("dst"), (none if count is None else count).cast("long").alias("count"), (none if predicate is None else predicate).cast("string").alias("predicate"))

    slugged = lambda prefix, c: F.concat(F.lit(prefix), node_slug(c))
    topics = documents.select(u, "id", F.explode("topics").alias("name")).filter(F.trim("name") != "").withColumn("topic", slugged("top:", F.trim("name")))
    words = documents.select(u, "id", F.explode("keywords").alias("name")).filter(F.trim("name") != "").withColumn("word", slugged("kw:", F.trim("name")))
    domains = documents.filter(F.trim("domain") != "").select(u, "id", F.col("domain").alias("name"), slugged("dom:", F.trim("domain")).alias("domain"))
    made = F.concat(F.lit("ent:"), node_slug(F.col("type")), F.lit(":"), node_slug(F.trim("name")))
    ents = entities.select(u, "document", "name", "type", "aliases", F.coalesce("id", made).alias("id"))
    counted = chunk_mentions(chunks.select(u, "document", F.col("id").alias("chunk"), "text"), ents, [u, "document"])
    # Names known in a document, for its relations.
    key = lambda c: F.lower(F.trim(c))
    known = ents.select(u, "document", key("name").alias("k"), F.lit("related").alias("kind"), "id").unionByName(topics.select(u, F.col("id").alias("document"), key("name").alias("k"), F.lit("part_of").alias("kind"), F.col("topic").alias("id")))
    known = known.groupBy(u, "document", "kind", "k").agg(F.min("id").alias("id"))
    rel = relations.select(u, "document", "kind", key("src_name").alias("ks"), key("dst_name").alias("kd"), predicate_name(F.col("predicate")).alias("predicate"))
    for end, c in (("src", "ks"), ("dst", "kd")):
        rel = rel.join(known.select(u, "document", "kind", F.col("k").alias(c), F.col("id").alias(end)), [u, "document", "kind", c])
    rel = rel.filter("src <> dst")
    # A topic all of whose words are in a longer one of the same document is the broader.
    broad = topics.select(u, "id", "topic", F.split(key("name"), r"\s+").alias("w"))
    pairs = broad.alias("a").join(broad.select(u, "id", F.col("topic").alias("t2"), F.col("w").alias("w2")), [u, "id"]).filter((F.size(F.array_except("w2", "w")) == 0) & (F.size("w2") < F.size("w")) & (F.size("w") >= 2) & (F.col("topic") != F.col("t2")))

    new_nodes = [
        node(documents, F.col("id"), "Document", F.col("title"), body=F.col("summary")), node(domains, F.col("domain"), "Domain", F.col("name")), node(topics, F.col("topic"), "Topic", F.col("name")),
        node(words, F.col("word"), "Keyword", F.col("name")), node(ents, F.col("id"), "Entity", F.col("name"), F.col("aliases")), node(chunks, F.col("id"), "Chunk", F.col("id"), body=F.substring("text", 1, NODE_TEXT)),
    ]
    new_edges = [
        edge(domains, "IN_DOMAIN", F.col("id"), F.col("domain")), edge(topics, "ABOUT", F.col("id"), F.col("topic")), edge(words, "TAGGED", F.col("id"), F.col("word")),
        edge(ents, "MENTIONS", F.col("document"), F.col("id"), F.lit(1)), edge(chunks, "CONTAINS", F.col("document"), F.col("id")), edge(counted, "MENTIONS", F.col("chunk"), F.col("id"), F.col("count")),
        edge(pairs, "PART_OF", F.col("topic"), F.col("t2")), edge(rel.filter("kind = 'related'"), "RELATED", F.col("src"), F.col("dst"), predicate=F.col("predicate")),
        edge(rel.filter("kind = 'part_of'"), "PART_OF", F.col("src"), F.col("dst")),
    ]
    titles = documents.select(u, F.col("id").alias("document"), "file_id", "title")
    own = lookup_join(chunks, titles, [u, "document"]).select(
        u, F.col("id").alias("source_id"), text("chunk").alias("kind"), "file_id", F.col("id").alias("graph_node_id"), chunk_title(F.col("title"), F.col("heading"), F.col("position")).alias("title"), "text"
    )
    summaries = documents.select(u, F.col("id").alias("source_id"), text("doc_summary").alias("kind"), "file_id", F.col("id").alias("graph_node_id"), "title", F.concat_ws("\n\n", "title", "summary").alias("text"))
    return Stored(_upserted_nodes(nodes, _all(new_nodes)), upsert_edges(edges, _all(new_edges)), upsert_fts(fts, own.unionByName(summaries)))


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _upserted_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each (universe_id, id): new values win, aliases unite, old ones first."""
    both = old.withColumn("v", F.lit(0)).unionByName(new.withColumn("v", F.lit(1)))
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("v", F.col(c).alias("x"))))["x"].alias(c)
    lists = F.transform(F.sort_array(F.collect_list(F.when(F.size("aliases") > 0, F.struct("v", "aliases")))), lambda x: x["aliases"])
    merged = both.groupBy("universe_id", "id").agg(last("type"), last("label"), last("text"), F.flatten(lists).alias("aliases"))
    return merged.select("universe_id", "id", "type", "label", merged_aliases(F.col("aliases"), F.array().cast("array<string>")).alias("aliases"), "text")


def save_notes(old: Stored, notes: DataFrame) -> Stored:
    """The store with agent notes (universe_id, id, content, kind, links): a node, a full-text row, and DERIVED_FROM_DOC edges to those links that are nodes."""
    known = old.nodes.select("universe_id", F.col("id").alias("dst")).distinct()
    links = notes.select("universe_id", F.col("id").alias("src"), F.explode("links").alias("dst")).distinct().join(known, ["universe_id", "dst"], "left_semi")
    none = F.lit(None)
    n = notes.select("universe_id", "id", F.lit("AgentNote").alias("type"), F.substring("content", 1, 60).alias("label"), none.cast("array<string>").alias("aliases"), F.col("content").alias("text"))
    e = links.select("universe_id", F.lit("DERIVED_FROM_DOC").alias("rel"), "src", "dst", none.cast("long").alias("count"), none.cast("string").alias("predicate"))
    f = notes.select("universe_id", F.col("id").alias("source_id"), F.lit("agent_note").alias("kind"), F.lit("").alias("file_id"), F.col("id").alias("graph_node_id"), F.col("kind").alias("title"), F.col("content").alias("text"))
    return Stored(_upserted_nodes(old.nodes.select(*_NODES), n), upsert_edges(old.edges.select(*_EDGES), e), upsert_fts(old.fts.select(*_FTS), f))


def remove_notes(old: Stored, ids: DataFrame) -> Stored:
    """The store without the notes (universe_id, id), their edges and full-text rows."""
    gone = ids.select("universe_id", "id").distinct()
    edges = delete_rows(delete_rows(old.edges, gone.withColumnRenamed("id", "src")), gone.withColumnRenamed("id", "dst"))
    return Stored(delete_rows(old.nodes, gone), edges, delete_rows(old.fts, gone.withColumnRenamed("id", "source_id")))
