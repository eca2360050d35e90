"""Budgets of tool calls, and the parsers of a relevance gate's answers."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stable_json(value) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def guarded_calls(log: DataFrame, budgets: dict[str, int], default: int = 6, soft_total: int = 18, heavy: list[str] | None = None, repeats: int = 3) -> DataFrame:
    """The verdict on each call of a log (turn, seq, tool, args): ok or the first guard that rejects it.

    In order: calls of the tool in the turn beyond its budget; calls of the turn beyond
    ``soft_total`` for heavy tools; the same tool and arguments more than ``repeats`` times
    among the calls that passed the guards before.
    """
    by = F.create_map(*[F.lit(x) for kv in budgets.items() for x in kv]) if budgets else None
    limit = F.coalesce(F.try_element_at(by, F.col("tool")), F.lit(default)) if budgets else F.lit(default)
    order = [F.col("seq")]
    n_tool = F.count(F.lit(1)).over(Window.partitionBy("turn", "tool").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    n_all = F.count(F.lit(1)).over(Window.partitionBy("turn").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    first = log.withColumn("n_tool", n_tool).withColumn("n_all", n_all)
    is_heavy = F.col("tool").isin(*heavy) if heavy else F.lit(False)
    early = F.when(F.col("n_tool") > limit, "per_tool_budget_exceeded").when((F.col("n_all") > soft_total) & is_heavy, "soft_total_budget_exceeded")
    second = first.withColumn("early", early)
    same = Window.partitionBy("turn", "tool", "args").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.sum(F.col("early").isNull().cast("int")).over(same)
    verdict = F.coalesce("early", F.when(seen > repeats, "loop_detected"), F.lit("ok"))
    return second.select("turn", "seq", "tool", verdict.alias("verdict"))


def parse_loose_json(text: str):
    """The JSON value of ``text`` or of its first fenced block, else the first balanced object in it; None if there is none."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S | re.I)
    text = (fenced.group(1) if fenced else text).strip()
    try:
        return json.loads(text)
    except ValueError:
        at = text.find("{")
    try:
        return json.JSONDecoder().raw_decode(text[at:])[0] if at >= 0 else None
    except ValueError:
        return None


def coerced_verdict(value) -> list[tuple[str, str, str]] | None:
    """(source, relevance, reason) of the kept entries of a verdict in any of its known shapes; None if it is no verdict."""
    if not isinstance(value, dict):
        return None
    kept = next((value[k] for k in ("kept", "results") if isinstance(value.get(k), list)), None)
    if kept is None:
        return None
    out = []
    for e in kept:
        source = next((e[k] for k in ("sourceId", "source_id") if isinstance(e.get(k), str)), None) if isinstance(e, dict) else None
        if source is not None:
            rating = e["relevance"].lower().strip() if isinstance(e.get("relevance"), str) else ""
            out.append((source, rating if rating in ("high", "medium", "low") else "medium", e["why"] if isinstance(e.get("why"), str) else ""))
    return out


def shape_verdict(rated: DataFrame, items: DataFrame, keep: int) -> DataFrame:
    """(turn, source_id, rank, kept): rated items that exist, each once, the first ``keep`` of a turn; the rest is dropped."""
    w = Window.partitionBy("turn").orderBy("pos", "source_id")
    valid = rated.join(items.select("turn", "source_id").distinct(), ["turn", "source_id"], "left_semi").groupBy("turn", "source_id").agg(F.min("pos").alias("pos"))
    ranked = valid.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep).drop("pos")
    return items.select("turn", "source_id").distinct().join(ranked, ["turn", "source_id"], "left").withColumn("kept", F.col("rank").isNotNull())


#: The pattern of a citation, and of the list of sources at the end of an answer.
CITATION = r"\[\^(?:source:)?([^\]\s]+)\]"
SOURCES_AT_END = r"(?is)\n+\s*(?:#+\s*|\*\*)?sources:?(?:\*\*)?\s*\n.*$"


def citations(text: Column) -> Column:
    """Ids of the citations ``[^source:id]`` and ``[^id]`` of a text, in order, without a list of sources at its end."""
    return F.regexp_extract_all(F.regexp_replace(text, SOURCES_AT_END, ""), F.lit(CITATION), 1)


def cited_sources(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, place, cited, mark): each citation of ``answers`` (id, text) with its number in ``sources`` (id, source_id, n), or ``?``."""
    said = answers.select("id", F.posexplode(citations(F.col("text"))).alias("place", "cited"))
    known = sources.groupBy("id", F.col("source_id").alias("cited")).agg(F.min("n").alias("n"))
    return said.join(known, ["id", "cited"], "left").select("id", "place", "cited", F.coalesce(F.col("n").cast("string"), F.lit("?")).alias("mark"))


def timed_out(calls: DataFrame, limit_ms: int = 30_000) -> DataFrame:
    """Calls (with started and ended, milliseconds) with ``timeout``: whether they took longer than the limit or never ended."""
    return calls.withColumn("timeout", F.col("ended").isNull() | (F.col("ended") - F.col("started") > limit_ms))
