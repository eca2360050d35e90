"""Queries of the relevance gate and of evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import gate as R
from loomgraph.session import table

QUERIES, ORACLES = {}, {}


def _query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _items(spark, d):
    """The kinds of event that a user met, in the order of their first event, as the candidates of a turn."""
    e = table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("turn"), F.col("event_type").alias("source_id")).agg(F.min("event_id").alias("pos"))


#: What the planted judge answers, by the number of the turn modulo 4, in the order of the ways.
_STRUCTURED = '{"kept": [{"sourceId": "click", "relevance": "high", "why": " fits "}, {"sourceId": "nobody", "relevance": "low", "why": ""}, {"sourceId": "click", "relevance": "low", "why": "again"}, {"sourceId": "view", "relevance": "low", "why": "far"}], "droppedIds": []}'
_LINES = "My ratings:\n#1 high: answers it\n2) MID - some\n#1 low: later\n3. skip\n4: maybe\n#9 high: nobody\n5 - low"
_LOOSE = 'Sure!\n```json\n{"results": [{"source_id": "error", "relevance": "HIGH ", "why": "w"}, {"sourceId": "signup", "relevance": "odd"}, {"x": 1}]}\n``` done'


def _answers(spark, items):
    none = F.lit(None).cast("string")
    way = F.col("turn") % 4
    return items.select("turn").distinct().select(
        "turn",
        F.when(way == 0, F.lit(_STRUCTURED)).when(way == 1, F.lit('{"kept": [{"sourceId": "click", "relevance": "HIGH", "why": ""}]}')).otherwise(none).alias("structured"),
        F.when(way == 1, F.lit(_LINES)).when(way == 2, F.lit("1 perhaps\n2 drop")).otherwise(none).alias("lines"),
        F.when(way == 2, F.lit(_LOOSE)).when(way == 3, F.lit("no idea {")).otherwise(none).alias("prose"),
    )


_ITEMS = """items AS (SELECT user_id AS turn, event_type AS source_id, min(event_id) AS pos FROM events GROUP BY ALL),
own AS (SELECT *, row_number() OVER (PARTITION BY turn ORDER BY pos, source_id) AS n, count(*) OVER (PARTITION BY turn) AS size FROM items)"""
_RELEVANCE = f"""WITH {_ITEMS}, said AS (
  SELECT turn, source_id, v.relevance, v.why, v.o, 'structured' AS way FROM own JOIN (VALUES ('click', 'high', 'fits', 1), ('view', 'low', 'far', 2)) v(s, relevance, why, o) ON v.s = source_id WHERE turn % 4 = 0 AND size > 2
  UNION ALL SELECT turn, source_id, v.relevance, v.why, v.o, 'lines' FROM own JOIN (VALUES (1, 'high', 'answers it', 1), (2, 'medium', 'some', 2), (5, 'low', 'Rated low by its line.', 3)) v(m, relevance, why, o) ON v.m = n WHERE turn % 4 = 1 AND size > 2
  UNION ALL SELECT turn, source_id, v.relevance, v.why, v.o, 'loose' FROM own JOIN (VALUES ('error', 'high', 'w', 1), ('signup', 'medium', '', 2)) v(s, relevance, why, o) ON v.s = source_id WHERE turn % 4 = 2 AND size > 2
  UNION ALL SELECT turn, source_id, 'medium', 'Kept without a verdict.', n, 'fallback' FROM own WHERE turn % 4 = 3 AND size > 2
  UNION ALL SELECT turn, source_id, 'medium', 'Too few candidates to judge.', n, 'trivial' FROM own WHERE size <= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY turn ORDER BY o) AS rank FROM said QUALIFY rank <= 2)
SELECT turn, source_id, r.relevance, r.why, r.rank::INT AS rank, r.rank IS NOT NULL AS kept, CASE WHEN size <= 2 THEN 'trivial' ELSE ['structured', 'lines', 'loose', 'fallback'][turn % 4 + 1] END AS way FROM own LEFT JOIN r USING (turn, source_id)"""


@_query("evaluate_relevance", _RELEVANCE)
def evaluate_relevance(spark, d):
    """Every user is a turn, the first two candidates are kept; the planted answers show every way to a verdict."""
    items = _items(spark, d)
    return R.evaluate_relevance(items, _answers(spark, items), keep=2)


@_query("gate_compact", _RELEVANCE.replace("SELECT turn, source_id, r.relevance", ", v AS (SELECT turn, source_id, r.relevance") + """)
  SELECT turn, source_id, 'event' AS kind, source_id || ' of ' || turn AS title, relevance, why, u.id AS universe_id, u.name AS universe_name, rank FROM v, (SELECT * FROM universes QUALIFY row_number() OVER (ORDER BY id) = 1) u WHERE kept""")
def gate_compact(spark, d):
    items = _items(spark, d)
    u = table(spark, d, "universes").select(F.col("id").alias("universe_id"), "name")
    first = u.agg(F.min("universe_id").alias("universe_id"))
    subjects = items.crossJoin(F.broadcast(first)).select("turn", "source_id", F.lit("event").alias("kind"), F.concat_ws(" of ", "source_id", F.col("turn").cast("string")).alias("title"), "universe_id", "pos")
    return R.compact_rows(R.evaluate_relevance(items, _answers(spark, items), keep=2), subjects, u)


@_query("evidence_first", "SELECT user_id AS turn, event_type AS source_id, arg_min(value, event_id) AS value, min(event_id) AS seq FROM events GROUP BY ALL")
def evidence_first(spark, d):
    """The first record of a source in a turn stays."""
    e = table(spark, d, "events").select(F.col("user_id").alias("turn"), F.col("event_type").alias("source_id"), F.col("event_id").alias("seq"), "value")
    return R.evidence(e).select("turn", "source_id", "value", "seq")


@_query("line_list_parse", f"""WITH {_ITEMS} SELECT turn, source_id, v.pos::INT AS pos, v.relevance, v.why FROM own JOIN (VALUES (1, 1, 'high', 'answers it'), (2, 2, 'medium', 'some'), (5, 7, 'low', 'Rated low by its line.')) v(m, pos, relevance, why) ON v.m = n""")
def line_list_parse(spark, d):
    items = _items(spark, d)
    from pyspark.sql import Window

    own = items.withColumn("n", F.row_number().over(Window.partitionBy("turn").orderBy("pos", "source_id")))
    return R.line_verdicts(items.select("turn").distinct().withColumn("lines", F.lit(_LINES)), own).select("turn", "source_id", "pos", "relevance", "why")
