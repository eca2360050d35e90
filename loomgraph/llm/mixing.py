"""Mixing sources to target weights, with capped repeats.

The natural share of a source is its part of all tokens.  Weights run from natural shares
(exponent 0) to the targets (exponent 1) as natural * (target / natural) ^ exponent,
normalised.  The exponent is bisected to the largest one at which no source is repeated
beyond its cap for the total asked for; without a total, that is the most tokens that the
targets themselves allow, so the exponent is 1 and the targets are met exactly.  Without
targets weights are natural ^ exponent: bisected to an entropy, or to the smallest exponent
(the flattest weights) at which no source is repeated beyond its cap for the total.

A source's budget is realised as full passes over its documents and one part pass: documents
are hashed to blocks, blocks are taken in a seeded permutation up to the budget, and the
block that straddles it is taken up to the document that comes nearest.
"""

from __future__ import annotations

from math import ceil, exp, floor, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import strip_space
from loomgraph.llm.tokens import VOCABULARY, count_tokens
from loomgraph.session import cut

#: Tokens of a block, and the most blocks of a source (then blocks are larger).
BLOCK_TOKENS, MAX_BLOCKS = 65_536, 100_000


def source_name(c: Column) -> Column:
    """Trimmed, lower case, with ``-`` and space as ``_``."""
    return F.regexp_replace(F.lower(strip_space(c)), r"[- \x{A0}]", "_")


def tempered(sizes: dict[str, float], targets: dict[str, float], exponent: float) -> dict[str, float]:
    """Weights between the natural shares (0) and the targets (1), which sum to 1."""
    total = sum(sizes.values())
    raw = {s: n / total * (targets[s] / (n / total)) ** exponent for s, n in sizes.items()}
    norm = sum(raw.values())
    return {s: w / norm for s, w in raw.items()}


def largest_total(sizes: dict[str, float], weights: dict[str, float], caps: dict[str, int]) -> float:
    """The most tokens at these weights with no source repeated beyond its cap."""
    return min(caps[s] * sizes[s] / weights[s] for s in sizes if weights[s] > 0)


def exponent_for_total(sizes: dict[str, float], targets: dict[str, float], caps: dict[str, int], total: float) -> float:
    """The largest exponent in [0, 1] at which ``total`` tokens keep every cap."""
    if largest_total(sizes, tempered(sizes, targets, 1.0), caps) >= total:
        return 1.0
    if largest_total(sizes, tempered(sizes, targets, 0.0), caps) < total:
        raise ValueError("no weights between the natural shares and the targets give that total within the caps")
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if largest_total(sizes, tempered(sizes, targets, mid), caps) >= total else (low, mid)
    return low


def exponent_for_entropy(sizes: dict[str, float], entropy: float) -> float:
    """The exponent e at which weights in proportion to share^e have ``entropy`` (nats); 0 gives log(n)."""
    total = sum(sizes.values())

    def of(e: float) -> float:
        raw = [exp(e * log(n / total)) for n in sizes.values()]
        return -sum(w / sum(raw) * log(w / sum(raw)) for w in raw if w)

    low, high = 0.0, 64.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if of(mid) > entropy else (low, mid)
    return (low + high) / 2


def powered(sizes: dict[str, float], exponent: float) -> dict[str, float]:
    """Weights in proportion to share ^ exponent, which sum to 1."""
    whole = sum(sizes.values())
    raw = {s: (n / whole) ** exponent for s, n in sizes.items()}
    return {s: w / sum(raw.values()) for s, w in raw.items()}


def exponent_for_repeats(sizes: dict[str, float], caps: dict[str, int], total: float) -> float:
    """The smallest exponent in [0, 1] at which ``total`` tokens in proportion to share ^ exponent keep every cap."""
    if largest_total(sizes, powered(sizes, 1.0), caps) < total * (1 - 1e-12):
        raise ValueError("the caps don't allow that total")
    low, high = -1e-9, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if largest_total(sizes, powered(sizes, max(mid, 0.0)), caps) >= total else (mid, high)
    return max(high, 0.0)


def budgets(sizes: dict[str, float], shares: dict[str, float], caps: dict[str, int], total: float | None, entropy: float | None = None, flatten: bool = False) -> tuple[dict[str, float], float]:
    """The weights of the sources and the tokens of the whole mix."""
    if flatten or entropy is not None:
        if flatten:
            e = exponent_for_repeats(sizes, caps, sum(sizes.values()) if total is None else total)
        else:
            e = exponent_for_entropy(sizes, entropy * log(len(sizes))) if len(sizes) > 1 else 1.0
        weights = powered(sizes, e)
        most = largest_total(sizes, weights, caps)
        if total is not None and total > most * (1 + 1e-9):
            raise ValueError("the caps don't allow that total")
        return weights, (most if entropy is not None else sum(sizes.values())) if total is None else total
    wanted = largest_total(sizes, shares, caps) if total is None else total
    return tempered(sizes, shares, exponent_for_total(sizes, shares, caps, wanted)), wanted


def mix_sources(
    documents: DataFrame,
    targets: DataFrame,
    total: float | None = None,
    passes: float | None = None,
    entropy: float | None = None,
    flatten: bool = False,
    seed: int = 42,
    path: str = VOCABULARY,
) -> DataFrame:
    """The chosen copies: ``doc_id``, ``source``, ``copy_no`` int (from 1), ``n_tokens`` long.

    ``targets`` has ``source``, ``target_share`` and ``max_repeats``, a bounded table of
    sources.  Shares of listed sources without tokens are spread over the others in
    proportion.  A source's tokens differ from its budget by less than one document.
    ``total`` is the number of tokens wanted, ``passes`` the same as a multiple of the
    tokens of the listed sources; ``entropy``, as a share of the highest (equal weights),
    or ``flatten`` (as equal as the caps allow for the total) takes the place of the target
    shares.  ValueError if the caps don't allow the total.

    Defined cases: documents of unlisted and null sources, and those without tokens (null,
    empty), are left out; a repeated row is a document of its own; targets that are null or
    not positive count as unlisted; a null or missing max_repeats is 1; empty tables give no
    rows; other columns are ignored.
    """
    spark = documents.sparkSession
    asked = (
        targets.filter((F.col("target_share") > 0) & F.col("source").isNotNull())
        .groupBy(source_name(F.col("source")).alias("source"))
        .agg(F.sum("target_share").alias("share"), F.greatest(F.max(F.coalesce("max_repeats", F.lit(1))), F.lit(1)).alias("cap"))
    )
    named = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text")
    counted = cut(count_tokens(named.join(F.broadcast(asked.select("source")), "source", "left_semi"), path=path).filter(F.col("n_tokens") > 0))
    sizes = {r.source: float(r.n) for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    goal = {r.source: r for r in asked.collect() if r.source in sizes}
    if not goal:
        return counted.select("doc_id", "source", F.lit(1).alias("copy_no"), "n_tokens").limit(0)
    norm = sum(r.share for r in goal.values())
    shares, caps = {s: r.share / norm for s, r in goal.items()}, {s: r.cap for s, r in goal.items()}
    weights, budget_all = budgets(sizes, shares, caps, passes * sum(sizes.values()) if passes is not None else total, entropy, flatten)
    plan = []
    for s, n in sizes.items():
        budget = weights[s] * budget_all
        passes = min(caps[s], floor(budget / n + 1e-9))
        rest = max(0.0, budget - passes * n) if passes < caps[s] else 0.0
        blocks = min(MAX_BLOCKS, max(1, ceil(n / BLOCK_TOKENS)))
        plan.append((s, passes, rest, blocks))
    plans = F.broadcast(spark.createDataFrame(plan, "source string, passes int, rest double, blocks int"))
    placed = counted.join(plans, "source").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")))
    # Sums of blocks are a small table: at most MAX_BLOCKS rows a source.
    sums = placed.groupBy("source", "block", "rest").agg(F.sum("n_tokens").alias("size"))
    order = Window.partitionBy("source").orderBy(F.xxhash64("block", "source", F.lit(seed)), "block")
    spans = sums.withColumn("upto", F.sum("size").over(order)).select("source", "block", (F.col("upto") - F.col("size")).alias("begin"), "upto")
    spread = placed.join(spans, ["source", "block"])
    whole = spread.filter(F.col("upto") <= F.col("rest")).select("doc_id", "source", (F.col("passes") + 1).alias("copy_no"), "n_tokens")
    # One block of a source straddles the budget; only its documents are put in order.
    within = Window.partitionBy("source").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = spread.filter((F.col("begin") < F.col("rest")) & (F.col("upto") > F.col("rest"))).withColumn("so_far", F.col("begin") + F.sum("n_tokens").over(within))
    partly = edge.filter(F.col("so_far") - F.col("n_tokens") / 2 <= F.col("rest")).select("doc_id", "source", (F.col("passes") + 1).alias("copy_no"), "n_tokens")
    full = (
        counted.join(plans, "source").filter(F.col("passes") > 0)
        .select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("passes"))).alias("copy_no"), "n_tokens")
    )
    return full.unionByName(whole).unionByName(partly)


def share_report(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """``source``, ``target_share``, ``actual_share``, ``n_tokens``, ``copies``, ``most_repeats`` of every listed source."""
    asked = targets.filter(F.col("source").isNotNull()).groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"))
    by = mix.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("copies"), F.max("copy_no").alias("most_repeats"))
    whole = by.agg(F.sum("n_tokens").alias("all_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return asked.join(by, "source", "left").join(F.broadcast(whole)).select(
        "source", "target_share", (zero("n_tokens") / F.greatest(zero("all_tokens"), F.lit(1))).alias("actual_share"),
        zero("n_tokens").alias("n_tokens"), zero("copies").alias("copies"), zero("most_repeats").alias("most_repeats"),
    )


def p9_mix(spark, sf_dir):
    from loomgraph.session import table

    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark, sf_dir):
    from loomgraph.session import table

    return share_report(p9_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_flat(spark, sf_dir):
    """Half as many tokens as the listed sources have, with shares as equal as the caps allow: the exponent is bisected to the caps."""
    from loomgraph.session import table

    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), passes=0.5, flatten=True)


def p9_flat_shares(spark, sf_dir):
    from loomgraph.session import table

    return share_report(p9_flat(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_entropy_shares(spark, sf_dir):
    """Natural shares, flattened to nine tenths of the highest entropy within the caps."""
    from loomgraph.session import table

    targets = table(spark, sf_dir, "mix_targets")
    return share_report(mix_sources(table(spark, sf_dir, "documents"), targets, entropy=0.9), targets)


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares, "p9_flat": p9_flat, "p9_flat_shares": p9_flat_shares, "p9_entropy_shares": p9_entropy_shares}
ORACLES: dict[str, str] = {}
