"""Parent-child links to full hierarchies, by pointer doubling.

Every node holds a pointer to an ancestor and the names between.  A round joins the pointers
with the nodes they point to, which doubles the distance, so trees of depth d take about
log2(d) rounds.  Resolved nodes (pointing at no one) leave the join's probe side.  In a round
k every acyclic node at a depth of up to 2^k is resolved, and if deeper ones exist, some lie
between 2^k and 2^(k+1): so a round that resolves nobody proves that all nodes still open
follow a cycle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import is_blank, name_slug
from loomgraph.operators.skew import HOT_ROWS, lookup_join
from loomgraph.session import cut, drop_cut


def latest_parent(links: DataFrame, group: str, child: str, parent: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(``g``, ``node``, ``parent``) of the latest link of each child, and all nodes (``g``, ``node``).

    ``order`` ranks a child's links, nulls lowest; equal ranks fall to the smallest parent.
    Links of a node with itself and links with a null end are ignored.  The choice is an
    aggregate combined on the map side, so a child with a third of all links costs one row
    per input task.
    """
    kept = links.select(F.col(group).alias("g"), F.col(child).alias("node"), F.col(parent).alias("parent"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    kept = kept.filter(F.col("node").isNotNull() & F.col("parent").isNotNull() & (F.col("node") != F.col("parent")))
    rank = [f"_o{i}" for i in range(len(order))]
    # max() of a struct ranks nulls lowest; among equal ranks min() of the parent decides.
    best = cut(kept.groupBy("g", "node", "parent").agg(F.max(F.struct(*(rank or [F.lit(0).alias("_o")]))).alias("_r")))
    top = best.groupBy("g", "node").agg(F.max("_r").alias("_m"))
    same = best.withColumnRenamed("g", "_g").withColumnRenamed("node", "_n")
    chosen = (
        same.join(top, F.col("_g").eqNullSafe(F.col("g")) & (F.col("_n") == F.col("node")) & F.col("_r").eqNullSafe(F.col("_m")))
        .groupBy("g", "node")
        .agg(F.min("parent").alias("parent"))
    )
    nodes = best.select("g", F.explode(F.array("node", "parent")).alias("node")).distinct()
    return chosen, nodes


def build_hierarchy(
    links: DataFrame,
    group: str = "universe_id",
    child: str = "child",
    parent: str = "parent",
    order: list[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Full paths of all nodes of parent-child links.

    Returns one row for each node: ``group``, ``node`` string, ``path`` array<string> (root
    first, the node last), ``depth`` int (0 for a root), ``root`` string, ``is_cycle`` boolean.
    For nodes whose parents never end ``path``, ``depth`` and ``root`` are null.

    Defined cases: a null group is a group of its own; links with a null end or between equal
    nodes are ignored; of several links of a child the one with the highest ``order`` counts
    (nulls lowest, then the smallest parent), so repeated rows change nothing; the parents of
    links that don't count are still nodes; no links give no rows; further columns of
    ``links`` are ignored, whatever their names.
    """
    chosen, nodes = latest_parent(links, group, child, parent, order or [])
    # A null group becomes "0" and any other "1<group>", so that plain equality joins hold.
    key = F.when(F.col("g").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("g").cast("string")))
    chosen, nodes = chosen.withColumn("g", key), nodes.withColumn("g", key)
    state = cut(
        nodes.join(chosen, ["g", "node"], "left").select("g", "node", F.col("parent").alias("anc"), F.array("node").alias("seg"))
    )
    done = [state.filter(F.col("anc").isNull()).select("g", "node", "seg")]
    active = state.filter(F.col("anc").isNotNull())
    rows = active.count()
    while rows:
        open_ = active.select("g", "node", "anc", "seg")
        known = reduce(DataFrame.unionByName, [d.withColumn("anc", F.lit(None).cast("string")) for d in done], open_)
        right = known.select("g", F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("seg").alias("seg2"))
        jumped = lookup_join(open_, right, ["g", "anc"], hot_rows=hot_rows, rows=rows).select(
            "g", "node", F.col("anc2").alias("anc"), F.concat("seg2", "seg").alias("seg")
        )
        jumped = cut(jumped)
        count = jumped.agg(F.count_if(F.col("anc").isNull()).alias("new"), F.count_if(F.col("anc").isNotNull()).alias("open")).first()
        if not count["new"]:
            drop_cut(jumped)
            break
        done.append(jumped.filter(F.col("anc").isNull()).select("g", "node", "seg"))
        active, rows = jumped.filter(F.col("anc").isNotNull()), count["open"]
    paths = reduce(DataFrame.unionByName, done).select(
        "g", "node", F.col("seg").alias("path"), (F.size("seg") - 1).alias("depth"), F.element_at("seg", 1).alias("root"), F.lit(False).alias("is_cycle")
    )
    if rows:
        none = F.lit(None)
        cyclic = active.select(
            "g", "node", none.cast("array<string>").alias("path"), none.cast("int").alias("depth"), none.cast("string").alias("root"), F.lit(True).alias("is_cycle")
        )
        paths = paths.unionByName(cyclic)
    named = F.when(F.col("g") != "0", F.substring("g", 2, 1 << 30)).alias(group)
    return paths.select(named, "node", "path", "depth", "root", "is_cycle")


def descendants(hierarchy: DataFrame, group: str = "universe_id") -> DataFrame:
    """All (``ancestor``, ``node``, ``distance``) pairs with a distance of at least 1.

    Read off the paths, without another join.  Nodes on or below a cycle have none.
    """
    steps = hierarchy.filter(~F.col("is_cycle")).select(group, "node", "depth", F.posexplode("path").alias("at", "ancestor"))
    return steps.filter(F.col("at") < F.col("depth")).select(group, "ancestor", "node", (F.col("depth") - F.col("at")).alias("distance"))


def topic_links(relations: DataFrame) -> DataFrame:
    """The part-of links of ``relations`` as (universe_id, child, parent, created_at, relation_id).

    Kinds are compared in lower case and by their letters only; null and blank names drop out.
    """
    kind = F.regexp_replace(F.lower("kind"), "[^a-z]", "")
    ok = (kind == "partof") & ~is_blank(F.col("src_name")) & ~is_blank(F.col("dst_name"))
    return relations.filter(ok).select(
        "universe_id", name_slug(F.col("src_name")).alias("child"), name_slug(F.col("dst_name")).alias("parent"), "created_at", "relation_id"
    )


def topic_hierarchy(relations: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """:func:`build_hierarchy` of the part-of links; see there for columns and defined cases."""
    return build_hierarchy(topic_links(relations), order=["created_at", "relation_id"], hot_rows=hot_rows)
