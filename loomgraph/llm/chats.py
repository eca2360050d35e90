"""Rebuilding conversations from message rows.

Messages are cleaned and put in order, and broken chats are dropped; that alone decides which
rows there are.  Within the rest each message chooses its likeliest parent among the messages
before it, by time, mentions, lexical overlap and speaker roles.  The reply links form trees
(pointer doubling), which give each message its depth or its thread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import strip_space
from loomgraph.operators.hierarchy import build_hierarchy
from loomgraph.operators.skew import HOT_ROWS, lookup_join, running
from loomgraph.session import cut

#: Spellings of the speaker roles.
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "system": "system", "tool": "tool", "function": "tool"}
#: The order of roles at equal times.
RANK = {"system": 0, "user": 1, "tool": 2, "assistant": 3}
#: Messages before a message that may be its parent. A score has at most 5 points and loses 0.25 a
#: step, and the nearest message scores above 0, so nobody farther back can be the best.
CANDIDATES = 20
#: A message whose best link scores less begins a thread of its own: a link that fits in roles and nothing else scores about 1.
THREAD_SCORE = 1.0
#: Times below this are seconds, others milliseconds.
SECONDS_BELOW = 100_000_000_000

_UNSEEN = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200D}\x{2028}\x{2029}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}]"


def speaker(c: Column) -> Column:
    """The role's name, null for unknown ones."""
    table = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.try_element_at(table, F.lower(strip_space(c)))


def clean_messages(messages: DataFrame) -> DataFrame:
    """One row for each message: chat_id, id, role, content, at (milliseconds), odd.

    Rows without chat are ignored.  Of the rows of an id that with the longest content counts,
    at equal length the greatest in (content, chat, role, time).  ``odd`` marks messages that
    break their chat: unknown role, no time, no id.
    """
    kept = messages.filter(F.col("chat_id").isNotNull()).select(
        "id", strip_space(F.col("chat_id")).alias("chat_id"), "role", "content", F.col("created_at").cast("long").alias("created_at")
    )
    best = kept.groupBy("id", F.when(F.col("id").isNull(), F.col("chat_id")).alias("_c")).agg(
        F.max(F.struct(F.coalesce(F.length("content"), F.lit(-1)).alias("n"), "content", "chat_id", "role", "created_at")).alias("m")
    )
    t = F.col("m.created_at")
    return best.select(
        F.col("m.chat_id").alias("chat_id"), "id", speaker(F.col("m.role")).alias("role"), F.col("m.content").alias("content"),
        F.when(t < SECONDS_BELOW, t * 1000).otherwise(t).alias("at"),
    ).withColumn("odd", F.col("role").isNull() | F.col("at").isNull() | F.col("id").isNull())


def ordered_chats(messages: DataFrame, chats: DataFrame) -> DataFrame:
    """The messages of whole conversations, with ``turn`` (from 1).

    Whole: the chat is known, no message is odd, and the user and assistant messages alone
    alternate strictly from a user's to an assistant's, none of them null or blank.
    """
    clean = clean_messages(messages)
    speaks = F.col("role").isin("user", "assistant")
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), F.col("role")), F.lit(9))
    numbered = running(
        clean.withColumn("rank", rank), ["chat_id"], ["at", "rank", "id"], {"turn": F.lit(1).cast("long"), "spoken": speaks.cast("long")}
    )
    due = F.when(F.col("spoken") % 2 == 1, F.lit("user")).otherwise(F.lit("assistant"))
    blank = F.coalesce(F.regexp_replace("content", _UNSEEN, ""), F.lit("")) == ""
    numbered = cut(numbered.withColumn("wrong", F.col("odd") | (speaks & ((F.col("role") != due) | blank))))
    whole = (
        numbered.groupBy("chat_id").agg(F.max("wrong").alias("wrong"), F.max("spoken").alias("spoken"))
        .filter(~F.col("wrong") & (F.col("spoken") > 0) & (F.col("spoken") % 2 == 0))
        .join(chats.select(strip_space(F.col("id")).alias("chat_id")).distinct(), "chat_id", "left_semi")
        .select("chat_id")
    )
    return lookup_join(numbered.select("chat_id", "id", "role", "content", "at", "turn"), whole, ["chat_id"], "left_semi")


def reply_links(ordered: DataFrame, candidates: int = CANDIDATES, new_thread_below: float | None = None) -> DataFrame:
    """(``chat_id``, ``id``, ``turn``, ``parent``, ``score``) of every message.

    The score adds: nearness in time (1 at no gap, one half at a minute), the share of the
    message's words that the candidate has, a mention of the candidate's id, the fit of roles
    (answers follow questions or tool results, questions follow answers), and less for each
    message between.  The nearest wins a tie.  Links scored below ``new_thread_below`` (none
    if null) are cut, which separates interleaved threads of one channel.
    """
    words = F.array_distinct(F.transform(F.filter(F.split(F.lower(F.coalesce("content", F.lit(""))), r"(?U)[^\p{L}\p{N}_@]+"), lambda w: w != ""), lambda w: F.xxhash64(w)))
    slim = ordered.select("chat_id", "id", "turn", "role", "at", words.alias("words"), F.coalesce("content", F.lit("")).alias("content"))
    # Joining on (chat, block of turns) deals even one huge chat evenly over the tasks. A candidate is in a message's block or the one before.
    child = slim.withColumn("block", F.floor(F.col("turn") / candidates))
    blocks = F.explode(F.array("block", F.col("block") + 1)).alias("block")
    other = child.select("chat_id", blocks, F.col("turn").alias("p_turn"), F.col("id").alias("parent"), F.col("role").alias("p_role"), F.col("at").alias("p_at"), F.col("words").alias("p_words"))
    pairs = child.join(other, ["chat_id", "block"]).withColumn("back", F.col("turn") - F.col("p_turn")).filter(F.col("back").between(1, candidates))
    gap = F.greatest(F.col("at") - F.col("p_at"), F.lit(0)) / 60_000.0
    shared = F.size(F.array_intersect("words", "p_words")) / F.greatest(F.size("words"), F.lit(1))
    fits = (
        F.when((F.col("role") == "assistant") & F.col("p_role").isin("user", "tool"), 1.0)
        .when((F.col("role") == "tool") & F.col("p_role").isin("user", "assistant"), 1.0)
        .when((F.col("role") == "user") & F.col("p_role").isin("assistant", "system"), 1.0)
        .otherwise(0.0)
    )
    mention = F.when(F.expr("parent <> '' AND contains(content, parent)"), 2.0).otherwise(0.0)
    score = 1.0 / (1.0 + gap) + shared + fits + mention - 0.25 * (F.col("back") - 1)
    best = pairs.groupBy("chat_id", "id", "turn").agg(F.max(F.struct(score.alias("score"), (-F.col("back")).alias("near"), "parent")).alias("b"))
    if new_thread_below is not None:
        best = best.filter(F.col("b.score") >= new_thread_below)
    linked = best.select(F.col("chat_id").alias("c"), F.col("turn").alias("t"), F.col("b.parent").alias("parent"), F.col("b.score").alias("score"))
    return slim.select("chat_id", "id", "turn").join(linked, (F.col("chat_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left").drop("c", "t")


def conversations(messages: DataFrame, chats: DataFrame, candidates: int = CANDIDATES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``chat_id``, ``message_id``, ``turn`` long, ``role``, ``parent_id``, ``depth`` int of whole conversations.

    The rows are those of :func:`ordered_chats`.  Uncut links always go to some message before,
    so a chat is one tree below its first message and the links can drop nothing.

    Defined cases: rows without chat are ignored; rows of one id are one message, the longest;
    an unknown role, a null time, a null id, a chat not in ``chats`` or a null or blank text of
    a speaker drops the chat; equal times are ordered by role, then id; very long texts are
    compared whole; empty tables give no rows; other columns are ignored.
    """
    ordered = cut(ordered_chats(messages, chats))
    links = cut(reply_links(ordered, candidates))
    trees = build_hierarchy(links.filter(F.col("parent").isNotNull()), "chat_id", "id", "parent", hot_rows=hot_rows)
    below = trees.select(F.col("chat_id").alias("c"), F.col("node").alias("n"), "depth")
    placed = links.join(below, (F.col("chat_id") == F.col("c")) & (F.col("id") == F.col("n")), "left").drop("c", "n")
    roles = ordered.select(F.col("chat_id").alias("c"), F.col("turn").alias("t"), "role")
    return placed.join(roles, (F.col("chat_id") == F.col("c")) & (F.col("turn") == F.col("t"))).select(
        "chat_id", F.col("id").alias("message_id"), "turn", "role", F.col("parent").alias("parent_id"), F.coalesce("depth", F.lit(0)).alias("depth")
    )


def threads(ordered: DataFrame, new_thread_below: float = THREAD_SCORE, candidates: int = CANDIDATES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``chat_id``, ``message_id``, ``turn``, ``thread`` (the id of its first message), ``depth``: the messages of chats by interleaved thread.

    A message whose best link scores below ``new_thread_below`` begins a thread.  ``ordered``
    has chat_id, id, role, content, at and turn; see :func:`conversations` for the defined cases.
    """
    links = cut(reply_links(ordered, candidates, new_thread_below))
    trees = build_hierarchy(links.filter(F.col("parent").isNotNull()), "chat_id", "id", "parent", hot_rows=hot_rows)
    below = trees.select(F.col("chat_id").alias("c"), F.col("node").alias("n"), "root", "depth")
    placed = links.join(below, (F.col("chat_id") == F.col("c")) & (F.col("id") == F.col("n")), "left")
    return placed.select("chat_id", F.col("id").alias("message_id"), "turn", F.coalesce("root", "id").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"))


def p6_found(spark, sf_dir):
    """The rows of whole conversations: order and roles decide them, so no links are made."""
    from loomgraph.session import table

    return ordered_chats(table(spark, sf_dir, "messages"), table(spark, sf_dir, "chats")).select("chat_id", F.col("id").alias("message_id"), "turn")


def p6_replies(spark, sf_dir):
    from loomgraph.session import table

    return conversations(table(spark, sf_dir, "messages"), table(spark, sf_dir, "chats"))


def p6_threads(spark, sf_dir):
    """The interleaved threads of whole conversations."""
    from loomgraph.session import table

    return threads(cut(ordered_chats(table(spark, sf_dir, "messages"), table(spark, sf_dir, "chats"))))


_WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
QUERIES = {"p6_found": p6_found, "p6_replies": p6_replies, "p6_threads": p6_threads}
ORACLES = {
    "p6_found": rf"""
WITH m0 AS (
  SELECT id, regexp_replace(chat_id, '^{_WS}+|{_WS}+$', '', 'g') AS chat_id, lower(regexp_replace(role, '^{_WS}+|{_WS}+$', '', 'g')) AS r, content, created_at,
    row_number() OVER (PARTITION BY id ORDER BY coalesce(length(content), -1) DESC, content DESC, chat_id DESC, role DESC, created_at DESC) AS k
  FROM messages WHERE chat_id IS NOT NULL
), m AS (
  SELECT id, chat_id, content,
    CASE WHEN r IN ('user', 'human') THEN 'user' WHEN r IN ('assistant', 'ai', 'bot') THEN 'assistant' WHEN r = 'system' THEN r WHEN r IN ('tool', 'function') THEN 'tool' END AS role,
    CASE WHEN created_at < 100000000000 THEN created_at * 1000 ELSE created_at END AS ms
  FROM m0 WHERE k = 1
), n AS (
  SELECT *, row_number() OVER w AS turn, sum(CASE WHEN role IN ('user', 'assistant') THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS spoken
  FROM m WINDOW w AS (PARTITION BY chat_id ORDER BY ms NULLS FIRST, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 WHEN 'tool' THEN 2 WHEN 'assistant' THEN 3 ELSE 9 END, id)
), good AS (
  SELECT chat_id FROM n GROUP BY chat_id
  HAVING bool_and(role IS NOT NULL AND ms IS NOT NULL)
    AND bool_and(role NOT IN ('user', 'assistant') OR (role = CASE WHEN spoken % 2 = 1 THEN 'user' ELSE 'assistant' END
      AND coalesce(regexp_replace(content, '{_UNSEEN}', '', 'g'), '') <> ''))
    AND max(spoken) > 0 AND max(spoken) % 2 = 0
)
SELECT chat_id, id AS message_id, turn FROM n WHERE chat_id IN (FROM good) AND chat_id IN (SELECT id FROM chats)"""
}
