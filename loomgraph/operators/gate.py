"""The relevance gate: which of a turn's candidates are worth returning, from a judge's answers.

A judge (a model, outside this library) may answer for a turn in three ways, tried in this
order: a structured verdict (JSON that meets the schema), a list of lines (``#2 high: why``),
and loose JSON somewhere in a text.  Turns with few candidates aren't judged, and where no
answer can be used the first candidates are kept.  All turns are decided in one plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.guards import coerced_verdict, parse_loose_json

#: Candidates up to which a turn isn't judged, candidates kept by default, longest reason, ratings.
TRIVIAL, KEEP, REASON = 2, 6, 240
RATINGS = ["high", "medium", "low"]
#: The pattern of a line, words that drop a candidate, and other spellings of ratings.
LINE = r"^\s*#?\s*(\d+)[\s.)\-:]+([A-Za-z]+)(?:\s*[:\-]\s*(.*))?$"
DROPPED = ["drop", "skip", "no"]
ALIASES = {"mid": "medium"}

_KEPT = "array<struct<sourceId:string,relevance:string,why:string>>"
_VERDICT = f"struct<kept:{_KEPT},droppedIds:array<string>>"


def structured_verdict(c: Column) -> Column:
    """The kept entries of a structured answer, null unless all of it meets the schema."""
    v = F.from_json(c, f"kept {_KEPT}, droppedIds array<string>")
    whole = v["kept"].isNotNull() & F.forall(v["kept"], lambda k: k["sourceId"].isNotNull() & k["why"].isNotNull() & F.coalesce(k["relevance"].isin(*RATINGS), F.lit(False)))
    return F.when(F.coalesce(whole, F.lit(False)), v["kept"])


def line_verdicts(answers: DataFrame, items: DataFrame) -> DataFrame:
    """(turn, pos, source_id, relevance, why) of the lines of ``answers`` (turn, lines); ``items`` has turn, n (from 1) and source_id.

    Of a candidate the first line counts, also if its rating is a dropping or an unknown word.
    """
    lines = answers.select("turn", F.posexplode(F.split("lines", r"\r?\n")).alias("pos", "line")).withColumn("line", F.trim("line")).filter(F.col("line").rlike(LINE))
    part = lambda i: F.regexp_extract("line", LINE, i)
    read = lines.select("turn", "pos", part(1).cast("int").alias("n"), F.lower(part(2)).alias("word"), F.trim(part(3)).alias("reason"))
    named = read.join(items.select("turn", "n", "source_id"), ["turn", "n"])
    first = named.withColumn("r", F.row_number().over(Window.partitionBy("turn", "source_id").orderBy("pos"))).filter("r = 1")
    table = F.create_map(*[F.lit(x) for kv in ({r: r for r in RATINGS} | ALIASES).items() for x in kv])
    rated = first.withColumn("relevance", F.try_element_at(table, F.col("word"))).filter(F.col("relevance").isNotNull())
    said = F.when(F.col("reason") != "", F.substring("reason", 1, REASON)).otherwise(F.concat(F.lit("Rated "), F.col("relevance"), F.lit(" by its line.")))
    return rated.select("turn", "pos", "source_id", "relevance", said.alias("why"))


def loose_verdicts(answers: DataFrame) -> DataFrame:
    """(turn, kept array<struct<sourceId, relevance, why>>) of the first JSON object in ``answers`` (turn, prose), put into shape."""
    kind = answers.schema["turn"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for turn, prose in zip(b["turn"], b["prose"]):
                kept = coerced_verdict(parse_loose_json(prose or ""))
                if kept is not None:
                    rows.append((turn, [{"sourceId": s, "relevance": r, "why": w} for s, r, w in kept]))
            yield pd.DataFrame(rows, columns=["turn", "kept"])

    return answers.filter(F.col("prose").isNotNull()).select("turn", "prose").mapInPandas(run, f"turn {kind}, kept {_KEPT}")


def evaluate_relevance(items: DataFrame, answers: DataFrame, keep: int = KEEP) -> DataFrame:
    """(turn, source_id, relevance, why, rank, kept, way) of all candidates.

    ``items`` has turn, source_id and pos, the order in which they were found; repeated ones
    count once.  ``answers`` has at most one row for each turn: structured, lines and prose,
    each null if that way gave none.  ``way`` says how the turn was decided: trivial,
    structured, lines, loose or fallback.  Unknown ids in an answer are ignored; the first
    ``keep`` of an answer are kept; dropped candidates have a null rank.
    """
    keep = max(1, keep)
    own = items.groupBy("turn", "source_id").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("turn")
    own = own.withColumn("n", F.row_number().over(w.orderBy("pos", "source_id"))).withColumn("size", F.count(F.lit(1)).over(w))
    asked = own.filter(F.col("size") > TRIVIAL)
    told = answers.join(asked.select("turn").distinct(), "turn", "left_semi")
    entries = lambda df, way, place: df.select("turn", F.posexplode("kept").alias("at", "k")).select("turn", "at", F.col("k.sourceId").alias("source_id"), F.col("k.relevance").alias("relevance"), F.col("k.why").alias("why"), F.lit(way).alias("way"), F.lit(place).alias("place"))
    first = told.withColumn("kept", structured_verdict(F.col("structured")))
    lines = line_verdicts(told.select("turn", "lines"), asked).select("turn", F.col("pos").alias("at"), "source_id", "relevance", "why", F.lit("lines").alias("way"), F.lit(1).alias("place"))
    loose = loose_verdicts(told)
    # A structured or loose verdict decides its turn even if it keeps nobody; a list has to rate somebody.
    ways = (
        first.filter(F.col("kept").isNotNull()).select("turn", F.lit(0).alias("place"))
        .unionByName(lines.select("turn", "place")).unionByName(loose.select("turn", F.lit(2).alias("place")))
        .groupBy("turn").agg(F.min("place").alias("place"))
    )
    names = F.element_at(F.array(*[F.lit(x) for x in ("structured", "lines", "loose", "fallback")]), F.coalesce("place", F.lit(3)) + 1)
    chosen = entries(first, "structured", 0).unionByName(lines).unionByName(entries(loose, "loose", 2)).drop("way").join(ways, ["turn", "place"])
    valid = chosen.join(asked.select("turn", "source_id"), ["turn", "source_id"], "left_semi")
    once = valid.withColumn("r", F.row_number().over(Window.partitionBy("turn", "source_id").orderBy("at"))).filter("r = 1").drop("r")
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("turn").orderBy("at"))).filter(F.col("rank") <= keep)
    judged = asked.join(ways, "turn", "left").withColumn("way", names).join(ranked.select("turn", "source_id", "relevance", F.substring(F.trim("why"), 1, REASON).alias("why"), "rank"), ["turn", "source_id"], "left")
    fallen = F.col("place").isNull() & (F.col("n") <= keep)
    judged = judged.select(
        "turn", "source_id", F.when(fallen, "medium").otherwise(F.col("relevance")).alias("relevance"), F.when(fallen, "Kept without a verdict.").otherwise(F.col("why")).alias("why"),
        F.when(fallen, F.col("n")).otherwise(F.col("rank")).alias("rank"), "way",
    )
    few = own.filter(F.col("size") <= TRIVIAL).select("turn", "source_id", F.lit("medium").alias("relevance"), F.lit("Too few candidates to judge.").alias("why"), F.col("n").alias("rank"), F.lit("trivial").alias("way"))
    return judged.unionByName(few).select("turn", "source_id", "relevance", "why", "rank", F.col("rank").isNotNull().alias("kept"), "way")


def compact_rows(verdicts: DataFrame, subjects: DataFrame, universes: DataFrame) -> DataFrame:
    """(turn, source_id, kind, title, relevance, why, universe_id, universe_name, rank) of the kept candidates.

    ``subjects`` has turn, source_id, kind, title, universe_id and pos; of repeated ones the
    first counts.  ``universes`` has universe_id and name.
    """
    one = subjects.groupBy("turn", "source_id").agg(F.min(F.struct("pos", "kind", "title", "universe_id")).alias("s"))
    names = universes.select("universe_id", F.col("name").alias("universe_name"))
    met = verdicts.filter("kept").join(one, ["turn", "source_id"]).select("turn", "source_id", "s.kind", "s.title", "relevance", "why", F.col("s.universe_id").alias("universe_id"), "rank")
    return met.join(names, "universe_id", "left").select("turn", "source_id", "kind", "title", "relevance", "why", "universe_id", "universe_name", "rank")


def evidence(seen: DataFrame) -> DataFrame:
    """What a turn has seen of a source: the first record (in seq) of each (turn, source_id)."""
    rest = [c for c in seen.columns if c not in ("turn", "source_id", "seq")]
    return seen.groupBy("turn", "source_id").agg(F.min(F.struct("seq", *rest)).alias("m")).select("turn", "source_id", "m.*")
