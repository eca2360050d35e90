"""The hierarchy operator on small fixtures: shapes, cycles, dirt, hot keys."""

from pyspark.sql import functions as F

from loomgraph.operators.hierarchy import build_hierarchy, descendants, topic_hierarchy

SCHEMA = "universe_id string, child string, parent string, seq long"


def paths(df):
    return {(r[0], r[1]): (">".join(r[2]) if r[2] else "cycle", r[3], r[4]) for r in df.select("universe_id", "node", "path", "depth", "root").collect()}


def test_empty_table(spark):
    assert build_hierarchy(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tree_cycle_ties_and_repeats(spark):
    rows = [
        ("u", "b", "a", 1), ("u", "c", "b", 1), ("u", "b", "a", 1),  # a chain, one row repeated
        ("u", "d", "x", 1), ("u", "d", "c", 2),  # the later link counts, x stays a node
        ("u", "e", "q", 3), ("u", "e", "p", 3),  # a tie: the smaller parent
        ("u", "m", "n", 1), ("u", "n", "m", 1), ("u", "o", "n", 1),  # a cycle and a node below it
        ("u", "s", "s", 9), ("u", None, "a", 1), ("u", "a", None, 1),  # ignored
        (None, "b", "z", None),  # a null group is a group of its own
    ]
    got = paths(build_hierarchy(spark.createDataFrame(rows, SCHEMA), order=["seq"]))
    assert got == {
        ("u", "a"): ("a", 0, "a"), ("u", "b"): ("a>b", 1, "a"), ("u", "c"): ("a>b>c", 2, "a"), ("u", "d"): ("a>b>c>d", 3, "a"),
        ("u", "x"): ("x", 0, "x"), ("u", "p"): ("p", 0, "p"), ("u", "q"): ("q", 0, "q"), ("u", "e"): ("p>e", 1, "p"),
        ("u", "m"): ("cycle", None, None), ("u", "n"): ("cycle", None, None), ("u", "o"): ("cycle", None, None),
        (None, "z"): ("z", 0, "z"), (None, "b"): ("z>b", 1, "z"),
    }


def test_deep_chain_and_hot_parent(spark):
    """A chain of 300, and a hub below a root with most of all rows, salted over several tasks."""
    rows = [("u", f"n{i:03d}", f"n{i - 1:03d}", 1) for i in range(1, 301)] + [("u", "hub", "top", 1)] + [("u", f"leaf{i}", "hub", 1) for i in range(500)]
    tree = build_hierarchy(spark.createDataFrame(rows, SCHEMA), order=["seq"], hot_rows=50).cache()
    got = paths(tree)
    assert got["u", "n300"] == (">".join(f"n{i:03d}" for i in range(301)), 300, "n000")
    assert all(got["u", f"leaf{i}"] == (f"top>hub>leaf{i}", 2, "top") for i in range(500))
    below = descendants(tree).groupBy("ancestor").agg(F.count("*").alias("n"), F.max("distance").alias("d"))
    by = {r.ancestor: (r.n, r.d) for r in below.collect()}
    assert by["n000"] == (300, 300) and by["hub"] == (500, 1) and by["top"] == (501, 2) and "n300" not in by


def test_part_of_kinds_names_and_clashing_columns(spark):
    rows = [
        ("u", "  Rural  Valley ", "Harbour Works!", "Part-Of", 1, "x", "y"),
        ("u", "rural valley", "Harbour Works", "related", 2, "x", "y"),
        ("u", "  ", "Harbour Works", "part_of", 3, "x", "y"),
        ("u", None, "Harbour Works", "part_of", 3, "x", "y"),
        ("u", "Rural valley", "RURAL   VALLEY", None, 4, "x", "y"),
        ("u", "w" * 5000, "Harbour Works", "PARTOF", 5, None, None),
    ]
    df = spark.createDataFrame(rows, "universe_id string, src_name string, dst_name string, kind string, relation_id long, node string, path string").withColumn(
        "created_at", F.lit(None).cast("timestamp")
    )
    assert paths(topic_hierarchy(df)) == {
        ("u", "rural_valley"): ("harbour_works>rural_valley", 1, "harbour_works"),
        ("u", "harbour_works"): ("harbour_works", 0, "harbour_works"),
        ("u", "w" * 128): ("harbour_works>" + "w" * 128, 1, "harbour_works"),
    }
