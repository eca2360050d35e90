"""Entity resolution and consolidation: linking, merging and clustering by similar vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import top_rows
from loomgraph.operators.skew import lookup_join, paired
from loomgraph.operators.vectors import similarity
from loomgraph.session import cut


def similar_pairs(records: DataFrame, least: float, keys: list[str], metric: str = "dot") -> DataFrame:
    """(keys, a, b) of records (keys, id, v) of one key with a similarity of at least ``least``, a < b.

    Exact.  The work grows as the square of a key's records, as consolidation is defined; the
    records of a hot key are dealt to blocks, which many tasks pair.
    """
    x, y = records.select(*keys, F.col("id").alias("a"), F.col("v").alias("va")), records.select(*keys, F.col("id").alias("b"), F.col("v").alias("vb"))
    near = similarity(F.col("va"), F.col("vb"), metric) >= least
    return paired(x, y, keys).filter((F.col("a") < F.col("b")) & near).select(*keys, "a", "b")


def single_link(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, cluster): members of clusters of at least two; the cluster is its smallest id.

    Labels spread along the links and jump to the label of their label, so rounds grow with
    the logarithm of a cluster's diameter.
    """
    e = cut(pairs.select(*keys, F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(*keys, F.col("b").alias("x"), F.col("a").alias("y"))))
    labels = cut(e.groupBy(*keys, F.col("x").alias("id")).agg(F.least(F.min("y"), F.col("x")).alias("cluster")))
    while True:
        around = lookup_join(e.withColumnRenamed("y", "id"), labels, [*keys, "id"]).groupBy(*keys, F.col("x").alias("id")).agg(F.min("cluster").alias("near"))
        up = labels.select(*keys, F.col("id").alias("cluster"), F.col("cluster").alias("above"))
        jumped = lookup_join(labels, up, [*keys, "cluster"], "left")
        new = cut(jumped.join(around, [*keys, "id"]).select(*keys, "id", F.least("cluster", F.coalesce("above", "cluster"), "near").alias("new"), "cluster"))
        changed = new.filter("new <> cluster").limit(1).count()
        labels = new.select(*keys, "id", F.col("new").alias("cluster"))
        if not changed:
            return labels


def canonical(clusters: DataFrame, degrees: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, loser, winner): of a cluster the node of highest degree wins, ties the smallest id."""
    d = clusters.join(degrees.select(*keys, "id", "degree"), [*keys, "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    best = top_rows(d, [*keys, "cluster"], [F.desc("degree"), F.col("id")], 1).select(*keys, "cluster", F.col("id").alias("winner"))
    return clusters.join(best, [*keys, "cluster"]).filter("id <> winner").select(*keys, F.col("id").alias("loser"), "winner")


def part_of_links(clusters: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """PART_OF edges (keys, src, dst) from the members of a cluster to its smallest id, where missing."""
    new = clusters.filter("id <> cluster").select(*keys, F.col("id").alias("src"), F.col("cluster").alias("dst"))
    return new.join(existing.filter(F.col("rel") == "PART_OF").select(*keys, "src", "dst"), [*keys, "src", "dst"], "left_anti")


def resolve(new: DataFrame, known: DataFrame, least: float, keys: list[str], metric: str = "cosine", others: bool = False) -> DataFrame:
    """(keys, id, resolved, merged): each new record is the nearest known one of its key if that is near enough.

    Records of one batch don't see each other, unless they are among the known.  A best match
    that is the record itself counts as not merged; with ``others`` it is no candidate, so the
    nearest other record is taken.
    """
    n, k = new.select(*keys, "id", F.col("v").alias("nv")), known.select(*keys, F.col("id").alias("kid"), F.col("v").alias("kv"))
    s = F.round(similarity(F.col("nv"), F.col("kv"), metric), 9)
    pairs = paired(n, k, keys)
    pairs = pairs.filter(F.col("kid") != F.col("id")) if others else pairs
    best = pairs.groupBy(*keys, "id").agg(F.max_by("kid", F.struct(s.alias("s"), F.col("kid"))).alias("kid"), F.max(s).alias("s"))
    hit = F.coalesce((F.col("s") >= least) & (F.col("kid") != F.col("id")), F.lit(False))
    return n.select(*keys, "id").join(best, [*keys, "id"], "left").select(*keys, "id", F.when(hit, F.col("kid")).otherwise(F.col("id")).alias("resolved"), hit.alias("merged"))


def consolidation_due(documents: DataFrame, last_run: DataFrame, every: int = 10) -> DataFrame:
    """Universes with at least ``every`` documents (universe_id, ingested_at) since their last run (universe_id, ran_at)."""
    d = documents.join(last_run, "universe_id", "left").filter(F.col("ran_at").isNull() | (F.col("ingested_at") > F.col("ran_at")))
    return d.groupBy("universe_id").agg(F.count(F.lit(1)).alias("documents")).filter(F.col("documents") >= every)


def branched(messages: DataFrame, chosen: DataFrame) -> DataFrame:
    """The messages of each chat up to the chosen one's time (chosen: chat_id, id), that one included."""
    at = messages.join(chosen, ["chat_id", "id"], "left_semi").groupBy("chat_id").agg(F.max("created_at").alias("_upto"))
    return lookup_join(messages, at, ["chat_id"]).filter(F.col("created_at") <= F.col("_upto")).drop("_upto")
