"""Heading-aware chunks of a document, and page ranges of chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern of a heading line.
_HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*#*$")
SCHEMA = "position int, text string, heading array<string>, start_offset int, end_offset int"


def blocks_of(text: str) -> Iterator[tuple[int, int, str, int, str]]:
    """(start, end, text, level, name) of headings (level 1 to 6, name) and paragraphs (level 0).

    A paragraph is a run of lines that are neither blank nor headings; its text is trimmed,
    its offsets cover the lines.  A heading's text is its line.
    """
    run: list[tuple[int, int]] = []
    at = 0
    for line in [*text.split("\n"), ""]:  # a last blank line closes the last paragraph
        m = _HEADING.match(line)
        if run and (m or not line.strip()):
            start, end = run[0][0], run[-1][1]
            yield start, end, text[start:end].strip(), 0, ""
            run = []
        if m:
            yield at, at + len(line), line, len(m.group(1)), m.group(2).strip()
        elif line.strip():
            run.append((at, at + len(line)))
        at += len(line) + 1


def chunk_text(text: str, max_chars: int = 3_500, overlap: int = 300) -> list[tuple[int, str, list, int, int]]:
    """(position, text, heading path, start, end) of the chunks of a text.

    Offsets are in the text with LF line ends.  Paragraphs, joined by one blank line, are
    packed up to ``max_chars``; a heading begins a chunk, which the paragraphs below it fill
    up.  A longer paragraph is cut at the limit, each slice a chunk of its own.  A chunk after
    the first begins with the last ``overlap`` characters of the one before, unless it begins
    with them anyway; its offsets don't cover them.  Skipped heading levels are None in the
    path.  Blank text gives no chunks.
    """
    if max_chars <= 0 or not 0 <= overlap < max_chars:
        raise ValueError("overlap must be at least 0 and less than max_chars")
    path: list = []
    packs: list[list] = []  # [text, path, start, end, whether it is a slice]
    is_open = False
    for start, end, body, level, name in blocks_of(text.replace("\r\n", "\n").replace("\r", "\n")):
        if level:
            path = [*path[: level - 1], *[None] * (level - 1 - len(path)), name]
            packs.append([body, path, start, end, False])
            is_open = True
        elif len(body) > max_chars:
            packs += [[body[i : i + max_chars], path, start + i, start + min(len(body), i + max_chars), True] for i in range(0, len(body), max_chars)]
            is_open = False
        elif is_open and len(packs[-1][0]) + 2 + len(body) <= max_chars:
            packs[-1][0], packs[-1][3] = f"{packs[-1][0]}\n\n{body}", end
        else:
            packs.append([body, path, start, end, False])
            is_open = True
    # Slices keep their white space, packed chunks don't.
    own = [x[0] if x[4] else x[0].strip() for x in packs]
    tails = ["", *[x[-overlap:] if overlap else "" for x in own[:-1]]]
    whole = [x if not tail or x.startswith(tail) else f"{tail}\n\n{x}" for x, tail in zip(own, tails)]
    return [(i, t, p, a, b) for i, (t, (_, p, a, b, _)) in enumerate(zip(whole, packs))]


def chunk_documents(df: DataFrame, key: str, text: str = "text", max_chars: int = 3_500, overlap: int = 300) -> DataFrame:
    """(key, position, text, heading, start_offset, end_offset) of every document."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *c) for k, t in zip(b["k"], b["t"]) for c in chunk_text(t, max_chars, overlap)]
            yield pd.DataFrame(rows, columns=["k", "position", "text", "heading", "start_offset", "end_offset"])

    slim = df.filter(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return slim.mapInPandas(run, f"k {kind}, {SCHEMA}").withColumnRenamed("k", key)


def page_ranges(chunks: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Adds page_start and page_end: the first and last page (keys, page, p_start, p_end) that a chunk overlaps.

    The join is on the keys (one document), with the overlap as a residual, and is aggregated at once.
    """
    hit = chunks.join(pages, keys).filter((F.col("p_start") < F.col("end_offset")) & (F.col("p_end") > F.col("start_offset")))
    return hit.groupBy(*keys, "start_offset", "end_offset").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"))


def slices(c, limit: int = 24_000, size: int = 18_000):
    """Texts above ``limit`` characters as an array of slices of ``size``, others as one."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length(c) - 1) / size)), lambda i: F.substring(c, (i * size + 1).cast("int"), F.lit(size)))
    return F.when(F.length(c) > limit, cut).otherwise(F.array(c))


def rebased_offset(raw: Column, offset: Column) -> Column:
    """The offset in the text with LF line ends of an offset in ``raw``, at most the length of either."""
    at = F.greatest(F.least(offset, F.length(raw)), F.lit(0))
    return (at - F.regexp_count(F.substring(raw, F.lit(1), at.cast("int")), F.lit("\r\n"))).cast("long")


def chunk_title(title: Column, heading: Column, position: Column) -> Column:
    """The title under which a chunk is found: the document's with the headings, or with the number of the part."""
    path = F.array_join(heading, " › ", "")
    return F.when(F.coalesce(F.size(heading), F.lit(0)) > 0, F.concat(title, F.lit(" — "), path)).otherwise(F.concat(title, F.lit(" — part "), (position + 1).cast("string")))


def excerpt(text: Column, start: Column, end: Column, pad: int = 400) -> Column:
    """The characters [start, end) of a text and ``pad`` more on each side; the whole text if the offsets are missing or wrong."""
    ok = F.coalesce((start >= 0) & (end > start) & (start < F.length(text)), F.lit(False))
    a = F.greatest(start - pad, F.lit(0))
    return F.when(ok, F.substring(text, (a + 1).cast("int"), (F.least(end + pad, F.length(text)) - a).cast("int"))).otherwise(text)
