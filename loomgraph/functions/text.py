"""Column expressions on text, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of all scripts, no-break spaces included, as a character class that Java's and
#: RE2's regular expressions both read.
SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip_space(c: Column) -> Column:
    """``c`` without white space (of any kind) at its ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Column) -> Column:
    """True for null and for text of white space only."""
    return c.isNull() | (strip_space(c) == "")


def squeeze(c: Column) -> Column:
    """Trimmed, white-space runs as one space, lower case."""
    return F.lower(F.regexp_replace(strip_space(c), f"{SPACE}+", " "))


def name_slug(c: Column, limit: int = 128) -> Column:
    """Trimmed, lower case, white-space runs as ``_``, all but ``a-z0-9_`` dropped, at most ``limit``."""
    spaced = F.regexp_replace(F.lower(strip_space(c)), f"{SPACE}+", "_")
    return F.substring(F.regexp_replace(spaced, "[^a-z0-9_]", ""), 1, limit)


def node_slug(c: Column, limit: int = 128) -> Column:
    """The slug used in node ids: as :func:`name_slug` but untrimmed, and ``_`` where nothing is left."""
    spaced = F.regexp_replace(F.lower(c), f"{SPACE}+", "_")
    kept = F.substring(F.regexp_replace(spaced, "[^a-z0-9_]", ""), 1, limit)
    return F.when(kept == "", F.lit("_")).otherwise(kept)


def predicate_name(c: Column, limit: int = 48, default: str = "related_to") -> Column:
    """Lower snake case of a relation's predicate; ``default`` for null and for what has no letter or digit."""
    snake = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    cut = F.substring(snake, 1, limit)
    return F.when(c.isNull() | (cut == ""), F.lit(default)).otherwise(cut)


def shorten(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last an ellipsis where something was cut."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 1), F.lit("…"))).otherwise(c)


def vector_id(kind: Column, node_id: Column) -> Column:
    """The id of a node's vector record: all but letters, digits, ``_`` and ``-`` become ``_``."""
    return F.concat(F.lit("vec_"), kind, F.lit("_"), F.regexp_replace(node_id, "[^A-Za-z0-9_-]", "_"))


def file_id_of(document_id: Column) -> Column:
    """A document's id without its prefix."""
    return F.when(document_id.startswith("doc:"), F.substring(document_id, 5, 1 << 30)).otherwise(document_id)


def merged_aliases(old: Column, new: Column, cap: int = 20) -> Column:
    """Trimmed aliases, blank and null ones dropped, each once, old ones first, at most ``cap``."""
    none = F.array().cast("array<string>")
    both = F.transform(F.concat(F.coalesce(old, none), F.coalesce(new, none)), strip_space)
    return F.slice(F.array_distinct(F.filter(both, lambda a: a.isNotNull() & (a != ""))), 1, cap)


def surfaces(name: Column, aliases: Column, least: int = 3) -> Column:
    """The trimmed, lower-case names under which a thing is looked for, each once, of at least ``least`` characters."""
    every = F.transform(F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>"))), lambda a: F.lower(strip_space(a)))
    return F.array_distinct(F.filter(every, lambda a: F.coalesce(F.length(a) >= least, F.lit(False))))


def times_mentioned(text: Column, surface: Column) -> Column:
    """How often ``surface`` (a column of plain text) is in ``text`` as whole words, in any case."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(surface, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.regexp_count(text, F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])"), quoted, F.lit(r"(?![\p{L}\p{N}_])")))


def for_match(c: Column) -> Column:
    """Lower case with white-space runs as one space, as texts are compared for highlighting."""
    return F.lower(F.regexp_replace(c, f"{SPACE}+", " "))


def found_at(text: Column, needle: Column, limit: int = 160) -> Column:
    """Position (from 0, -1 if absent) in :func:`for_match` of ``text`` of the first ``limit`` characters of ``needle``."""
    return F.position(F.substring(strip_space(for_match(needle)), 1, limit), for_match(text)) - 1
