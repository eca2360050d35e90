"""Splitting oversized texts at natural boundaries, by ranges.

A text, or a file, is handled in ranges with halos.  From a range and its halo a worker makes
a boundary table, in positions relative to the range: runs of starts with the end of the
piece that begins there, and for every start at which a piece may enter the range, where the
chain of pieces enters the next range and after how many pieces.  Both are runs of equal
values, so a table is far smaller than its text, and from here on no text is moved.

The tables of consecutive ranges are composed in blocks of BLOCK_RANGES, the blocks of one
text are stitched in order (each a look-up, with prefix sums of lengths and piece counts),
and the blocks then emit their pieces by offset, each on its own.  A text of one range takes
the same way.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.skew import lookup_join
from loomgraph.session import cut

MAX_CHARS = 3_500
OVERLAP = 300
#: Characters of a range of a text, bytes of a range of a file, ranges that are composed to a block.
RANGE_CHARS, RANGE_BYTES, BLOCK_RANGES = 8_192, 1 << 20, 64

_TABLE = "d string, blk long, no long, size long, stop long, r_at array<int>, r_end array<long>, h_at array<int>, h_next array<long>, h_count array<long>"


def unify_newlines(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def last_boundaries(text: str, before: str) -> list[np.ndarray]:
    """For positions 0 .. len(text) the last boundary at or before them, or -1, for each rank.

    The ranks are: right after two LF, one LF, a sentence end, a space.  ``before`` holds the
    two characters ahead of ``text`` (fewer at the start of the whole); 0 is no boundary.
    """
    k = len(before)
    codes = np.frombuffer((before + text).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lf, space = codes == 10, codes == 32
    double, ending = np.zeros_like(lf), np.zeros_like(lf)
    double[1:] = lf[1:] & lf[:-1]
    stop = (codes == ord(".")) | (codes == ord("!")) | (codes == ord("?"))
    ending[1:] = space[1:] & stop[:-1]
    ending |= codes == ord("。")
    out = []
    for marks in (double, lf, ending, space):
        at = np.full(len(text) + 1, -1, dtype=np.int64)
        hit = np.flatnonzero(marks[k:]) + 1
        at[hit] = hit
        out.append(np.maximum.accumulate(at))
    return out


def _runs(*values: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    change = np.zeros(len(values[0]), dtype=bool)
    change[:1] = True
    for v in values:
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def range_table(text: str, before: str, size: int, ends_here: bool, max_chars: int, overlap: int) -> tuple:
    """The boundary table of a range: (stop, r_at, r_end, h_at, h_next, h_count).

    ``text`` is the range, ``size`` characters, and a halo of ``max_chars`` (less only where
    the whole ends, which ``ends_here`` says).  ``stop`` is the end of the whole, or -1 if it
    lies behind the halo.  An end of -1 stands for a cut at the limit, a next entry of -1 for
    no more pieces.  Only the first ``max_chars`` starts of a range can be entries.
    """
    starts = np.arange(size, dtype=np.int64)
    ends, reach = np.full(size, -1, dtype=np.int64), np.minimum(starts + max_chars, len(text))
    for at in last_boundaries(text, before):
        last = at[reach]
        ends = np.where((ends < 0) & (last > starts + max_chars // 2), last, ends)
    stop = len(text) if ends_here else -1
    if ends_here:
        ends[starts + max_chars >= stop] = stop
    done = ends == stop if ends_here else np.zeros(size, dtype=bool)
    step = np.where(ends < 0, starts + max_chars, ends) - overlap
    step[done] = -1
    count = np.ones(size, dtype=np.int64)
    while True:  # pointer doubling within the range
        inside = (step >= 0) & (step < size)
        if not inside.any():
            break
        at = step[inside]
        count[inside] += count[at]
        step[inside] = step[at]
    head = min(size, max_chars)
    enter = np.where(step[:head] < 0, -1, step[:head] - size)
    r, h = _runs(ends), _runs(enter, count[:head])
    return stop, r.astype(np.int32), ends[r], h.astype(np.int32), enter[h], count[h]


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[list]:
    """Rows with equal keys, which lie together, as lists; also across batches."""
    held, of = [], None
    for b in batches:
        at = [b.columns.get_loc(k) for k in keys]
        for row in b.itertuples(index=False):
            key = tuple(row[i] for i in at)
            if held and key != of:
                yield held
                held = []
            of = key
            held.append(row)
    if held:
        yield held


def _framed(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows as frames of up to 1,000."""
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= 1_000:
            yield pd.DataFrame(held, columns=columns)
            held = []
    yield pd.DataFrame(held, columns=columns)


def composed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each block: its length and, for each run of entries, where they enter the next block and after how many pieces."""

    def rows_of() -> Iterator[tuple]:
        for rows in _groups(batches, ["d", "blk"]):
            at, enter, count = rows[0].h_at, rows[0].h_next.copy(), rows[0].h_count.copy()
            for r in rows[1:]:
                on = np.flatnonzero(enter >= 0)
                i = np.searchsorted(r.h_at, enter[on], side="right") - 1
                count[on] += r.h_count[i]
                enter[on] = r.h_next[i]
            yield rows[0].d, rows[0].blk, sum(r.size_ for r in rows), at, enter, count

    return _framed(rows_of(), ["d", "blk", "size", "h_at", "h_next", "h_count"])


def stitched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each block that a piece starts in: its offset, the entry and the number of the first piece."""

    def rows_of() -> Iterator[tuple]:
        for rows in _groups(batches, ["d"]):
            entry, first, base = 0, 0, 0
            for r in rows:
                yield r.d, r.blk, base, entry, first
                i = bisect_right(r.h_at, entry) - 1
                first, entry, base = first + int(r.h_count[i]), int(r.h_next[i]), base + r.size_
                if entry < 0:
                    break

    return _framed(rows_of(), ["d", "blk", "base", "entry", "first"])


def _emitter(max_chars: int, overlap: int):
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for rows in _groups(batches, ["d", "blk"]):
            base, p, n = int(rows[0].base), int(rows[0].entry), int(rows[0].first)
            for r in rows:
                if p < 0:
                    break
                while 0 <= p < r.size_:
                    e = int(r.r_end[bisect_right(r.r_at, p) - 1])
                    e = p + max_chars if e < 0 else e
                    out.append((r.d, n, base + p, base + e))
                    n, p = n + 1, -1 if e == r.stop else e - overlap
                base, p = base + r.size_, p - r.size_ if p >= 0 else p
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["d", "piece_no", "s", "e"])
                out = []
        yield pd.DataFrame(out, columns=["d", "piece_no", "s", "e"])

    return emit


def pieces_of(tables: DataFrame, max_chars: int, overlap: int) -> DataFrame:
    """(``d``, ``piece_no``, ``s``, ``e``) from boundary tables (see _TABLE, ``size`` as ``size_``).

    A block holds at most BLOCK_RANGES tables, and the stitching of a text one small row for
    each block: 16 for a file of 1 GB in ranges of 1 MB.
    """
    heads = tables.select("d", "blk", "no", "size_", "h_at", "h_next", "h_count").repartition("d", "blk").sortWithinPartitions("d", "blk", "no")
    blocks = heads.mapInPandas(composed, "d string, blk long, size long, h_at array<int>, h_next array<long>, h_count array<long>")
    entries = (
        blocks.withColumnRenamed("size", "size_").repartition("d").sortWithinPartitions("d", "blk")
        .mapInPandas(stitched, "d string, blk long, base long, entry long, first long")
    )
    known = tables.select("d", "blk", "no", "size_", "stop", "r_at", "r_end").join(entries, ["d", "blk"])
    return known.repartition("d", "blk").sortWithinPartitions("d", "blk", "no").mapInPandas(_emitter(max_chars, overlap), "d string, piece_no long, s long, e long")


def split_texts(
    df: DataFrame,
    key: str = "id",
    text: str = "text",
    offset: str | None = "start_offset",
    heading: str | None = "heading",
    max_chars: int = MAX_CHARS,
    overlap: int = OVERLAP,
    range_chars: int = RANGE_CHARS,
) -> DataFrame:
    """Pieces of the texts with more than ``max_chars`` characters (code points).

    Returns distinct rows ``key`` string, ``piece_no`` long, ``piece_start`` and ``piece_end``
    long (exclusive, plus the row's ``offset``, 0 if null), ``heading`` array<string>.  CRLF
    and CR count as LF.  A piece ends right after the last blank line, line end, sentence end
    or space (in this order of rank) in its second half, else at the limit; the next begins
    ``overlap`` characters before.

    The tables of a text are made where it is read (a value of a column has at most 2 GB);
    only tables are shuffled, those of equal texts once.

    Defined cases: null and short texts give no rows; repeated rows give one set of pieces;
    rows of one key with other texts or offsets give a set each; a null key stays null; an
    empty table gives no rows; only the columns named are read.
    """
    if not 0 <= overlap < max_chars // 2:
        raise ValueError("overlap must be less than half of max_chars")
    range_chars = max(range_chars, max_chars)
    long_ = df.filter(F.length(text) > max_chars).select(
        F.col(key).cast("string").alias("k"),
        F.replace(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")).alias("t"),
        (F.coalesce(F.col(offset), F.lit(0)) if offset else F.lit(0)).cast("long").alias("o"),
        (F.col(heading) if heading else F.lit(None).cast("array<string>")).alias("h"),
    )
    long_ = long_.filter(F.length("t") > max_chars).withColumn("d", F.sha2("t", 256))

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, t in zip(b["d"], b["t"]):
                for no, at in enumerate(range(0, len(t), range_chars)):
                    size = min(range_chars, len(t) - at)
                    table = range_table(t[at : at + size + max_chars], t[max(0, at - 2) : at], size, at + size + max_chars >= len(t), max_chars, overlap)
                    rows.append((d, no // BLOCK_RANGES, no, size, *table))
                    if len(rows) >= 1_000:
                        yield pd.DataFrame(rows, columns=_COLUMNS)
                        rows = []
            yield pd.DataFrame(rows, columns=_COLUMNS)

    # Copies of a text have equal tables: one is kept, after a first choice in each task.
    made = cut(long_.select("d", "t").mapInPandas(tables, _TABLE).withColumnRenamed("size", "size_").dropDuplicates(["d", "no"]))
    pieces = pieces_of(made, max_chars, overlap)
    rows = cut(long_.select("k", "o", "h", "d").distinct())
    joined = lookup_join(rows, pieces, ["d"])
    return joined.select(F.col("k").alias(key), "piece_no", (F.col("o") + F.col("s")).alias("piece_start"), (F.col("o") + F.col("e")).alias("piece_end"), F.col("h").alias("heading")).distinct()


_COLUMNS = ["d", "blk", "no", "size", "stop", "r_at", "r_end", "h_at", "h_next", "h_count"]


def read_range(f, at: int, upto: int, length: int, extra: int) -> tuple[str, str, str, bool]:
    """(before, body, halo, whether the file ends with the halo) of the byte range [at, upto) of an open file.

    A character belongs to the range of its first byte, a CRLF to that of its LF.  Broken
    UTF-8 is read as replacement characters.  The halo has ``extra`` characters, or fewer at
    the end; ``before`` the two characters ahead.
    """

    def aligned(x: int) -> int:
        if x <= 0 or x >= length:
            return max(0, min(x, length))
        f.seek(x - 1)
        b = f.read(5)
        if b[:2] == b"\r\n":
            return x + 1
        i = 1
        while i < len(b) and b[i] & 0xC0 == 0x80 and i < 4:
            i += 1
        return x - 1 + i

    def text(a: int, z: int) -> str:
        f.seek(a)
        return unify_newlines(f.read(z - a).decode("utf-8", "replace"))

    a, z = aligned(at), aligned(upto)
    y = aligned(min(z + 8 * extra, length))
    halo = text(z, y)
    return text(max(0, a - 16), a)[-2:], text(a, z), halo[:extra], y >= length and len(halo) <= extra


def split_files(spark: SparkSession, paths: str | list[str], max_chars: int = MAX_CHARS, overlap: int = OVERLAP, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(``path``, ``piece_no``, ``piece_start``, ``piece_end``) of UTF-8 files, none of which is loaded whole.

    ``paths`` are files or folders on any file system that Spark and Arrow read.  A file is
    cut into byte ranges, which are spread over the tasks; each is read once, with its halo.
    Offsets are in characters of the text with LF line ends; their prefix sums follow from the
    lengths in the tables.  Empty files give no rows; a file within the limit is one piece.
    """
    range_bytes = max(range_bytes, 8 * max_chars)
    listed = spark.read.format("binaryFile").load(paths).select("path", "length").filter(F.col("length") > 0)
    last = F.floor((F.col("length") - 1) / range_bytes)
    plan = listed.select(F.col("path").alias("d"), "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("no"))

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for b in batches:
            for r in b.itertuples(index=False):
                system, path = fs.FileSystem.from_uri(r.d)
                with system.open_input_file(path) as f:
                    before, body, halo, ends = read_range(f, r.no * range_bytes, (r.no + 1) * range_bytes, r.length, max_chars)
                if body:
                    table = range_table(body + halo, before, len(body), ends, max_chars, overlap)
                    yield pd.DataFrame([(r.d, r.no // BLOCK_RANGES, r.no, len(body), *table)], columns=_COLUMNS)

    # The rows are few and small but each stands for a range to read, so the number of tasks is stated.
    tasks = max(1, min(plan.count(), 4 * spark.sparkContext.defaultParallelism))
    made = cut(plan.repartition(tasks).mapInPandas(tables, _TABLE).withColumnRenamed("size", "size_"))
    return pieces_of(made, max_chars, overlap).select(F.col("d").alias("path"), "piece_no", F.col("s").alias("piece_start"), F.col("e").alias("piece_end"))


def p3_found(spark, sf_dir):
    from loomgraph.session import table

    return split_texts(table(spark, sf_dir, "chunks")).select(F.col("id").alias("chunk_id"), "piece_no", "piece_start", "piece_end").distinct()


def p3_files(spark, sf_dir):
    """The texts of ``documents``, written one behind the other into a file for each task, split by byte ranges."""
    from uuid import uuid4

    from loomgraph.session import shared_dir, table

    at = f"{shared_dir(spark)}/{uuid4().hex}"
    table(spark, sf_dir, "documents").filter(F.col("text").isNotNull()).select("text").write.text(at)
    pieces = split_files(spark, f"{at}/part-*")
    return pieces.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("file"), "piece_no", "piece_start", "piece_end")


QUERIES = {"p3_found": p3_found, "p3_files": p3_files}
ORACLES = {
    "p3_found": r"""
WITH RECURSIVE t AS (
  SELECT DISTINCT id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t, coalesce(start_offset, 0) AS o FROM chunks
), big AS (SELECT * FROM t WHERE length(t) > 3500),
pieces AS (
  SELECT id, t, o, 0::BIGINT AS no, 0::BIGINT AS p, NULL::BIGINT AS prev, false AS fin FROM big
  UNION ALL
  SELECT id, t, o, no + 1, e - 300, e, e >= length(t) FROM (
    SELECT *, CASE WHEN length(t) - p <= 3500 THEN length(t)
      WHEN strpos(w, chr(10) || chr(10)) > 0 THEN p + 3500 - strpos(w, chr(10) || chr(10)) + 1
      WHEN strpos(w[:1750], chr(10)) > 0 THEN p + 3500 - strpos(w[:1750], chr(10)) + 1
      WHEN regexp_matches(w, '^(?s:.*?)(?: [.!?]|。.)') AND s > 0 THEN p + 3500 - s + 1
      WHEN strpos(w[:1750], ' ') > 0 THEN p + 3500 - strpos(w[:1750], ' ') + 1
      ELSE p + 3500 END AS e
    FROM (SELECT *, coalesce(nullif(least(
            CASE WHEN strpos(w, ' .') BETWEEN 1 AND 1750 THEN strpos(w, ' .') ELSE 9999 END, CASE WHEN strpos(w, ' !') BETWEEN 1 AND 1750 THEN strpos(w, ' !') ELSE 9999 END,
            CASE WHEN strpos(w, ' ?') BETWEEN 1 AND 1750 THEN strpos(w, ' ?') ELSE 9999 END, CASE WHEN strpos(w[:1750], '。') > 0 THEN strpos(w[:1750], '。') ELSE 9999 END), 9999), 0) AS s
      FROM (SELECT *, reverse(t[p + 1750 : p + 3500]) AS w FROM pieces WHERE NOT fin))
  )
)
SELECT DISTINCT id AS chunk_id, no - 1 AS piece_no, lag_p + o AS piece_start, prev + o AS piece_end
FROM (SELECT *, lag(p) OVER (PARTITION BY id, t, o ORDER BY no) AS lag_p FROM pieces) WHERE no > 0"""
}
