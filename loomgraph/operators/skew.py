"""Joins and numbering that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import cut

#: Rows of one key that one task may hold; a key with more is spread over several tasks.
HOT_ROWS = 500_000
#: At most so many keys are salted, which bounds the table that is broadcast. A key that is not
#: among them has less than a 10,000th of all rows.
MAX_HOT_KEYS = 10_000


#: Most rows that are sent to all tasks after a check.
SENT_ROWS = 100_000


def sent_if_small(df: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is, so that the join is shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS, limit: int = MAX_HOT_KEYS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows, and in ``_parts`` over how many tasks to spread each.

    The counts are combined on the map side, so a hot key costs one row per input task.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    parts = F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int")
    return counts.orderBy(F.desc("_n")).limit(limit).select(*keys, parts.alias("_parts"))


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot_rows: int = HOT_ROWS, rows: int | None = None) -> DataFrame:
    """Join ``left`` (any number of rows of a key) with ``right`` (few rows of a key) on ``keys``.

    Rows of a hot key of ``left`` are dealt over several tasks by a hash of the whole row, and
    the matching rows of ``right`` are copied to each.  Every row is kept.  Null keys match
    nothing.  ``how`` is "inner", "left", "left_semi" or "left_anti".  Both sides share no
    column names but the keys.  ``rows`` is the size of ``left`` where the caller knows it: no
    key can be hot if the whole table is below the limit, and the counting is saved.
    """
    if rows is not None and rows <= hot_rows:
        return left.join(right, keys, how)
    hot = F.broadcast(hot_keys(left, keys, hot_rows))
    part = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.coalesce(F.col("_parts"), F.lit(1)))
    a = left.join(hot, keys, "left").withColumn("_salt", part.cast("int")).drop("_parts")
    b = (
        right.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)))
        .drop("_parts")
    )
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


def paired(left: DataFrame, right: DataFrame, keys: list[str], block: int = 1_000) -> DataFrame:
    """Join all rows of ``left`` and ``right`` with equal keys, many on both sides.

    A key's rows on the right are dealt to blocks of ``block`` rows and its rows on the left
    copied to each block, so that the pairs of a hot key come from many tasks.  Counts are
    combined on the map side.  Null keys match nothing; only the keys share names.
    """
    parts = right.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    dealt = lookup_join(right, parts, keys)
    rest = [F.col(c) for c in right.columns if c not in keys]
    dealt = dealt.withColumn("_block", F.pmod(F.xxhash64(*(rest or [F.lit(0)])), F.col("_blocks")).cast("int")).drop("_blocks")
    copies = lookup_join(left, parts, keys).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    return copies.join(dealt, [*keys, "_block"]).drop("_block")


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """Add running sums (inclusive) of the columns ``sums`` within ``keys`` in ``order``.

    A window over ``keys`` would put a hot key into one task.  Here rows are ranged over all
    tasks by (keys, order); each task sums its own stretch of a key, and the totals of earlier
    stretches (one row for each task and key that meet) are added.  ``order`` has to be total
    for a result that does not depend on the tasks; nulls come first.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumns({f"_v_{k}": v for k, v in sums.items()}).repartitionByRange(n, *keys, *order)
    # The stretch number has to be the same in both reads below, so it is written down.
    ranged = cut(ranged.withColumn("_stretch", F.spark_partition_id()))
    totals = ranged.groupBy(*keys, "_stretch").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_stretch").alias("_s2"),
        *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums],
    )
    own = Window.partitionBy(*keys, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = ranged.withColumns({f"_o_{k}": F.sum(f"_v_{k}").over(own) for k in sums})
    same = F.col("_stretch") == F.col("_s2")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = inner.join(base, same, "left")
    return joined.select(*df.columns, *[(F.col(f"_o_{k}") + F.col(f"_b_{k}")).alias(k) for k in sums])
