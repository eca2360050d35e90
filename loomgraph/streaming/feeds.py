"""Streams: a feed of new files, budgets of a running tool log, and a breaker."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.files import IGNORED


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression for whole paths: ``**/`` any folders, ``**`` anything, ``*`` and ``?`` within a name."""
    out = ""
    for token in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", glob):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(token) or re.escape(token)
    return f"^(?:.*/)?{out}$" if not glob.startswith("/") else f"^{out}$"


def watch_files(spark: SparkSession, path: str, per_trigger: int = 1_000, exclude: list[str] | None = None, settled: str | None = None) -> DataFrame:
    """A stream of (path, modificationTime, length, hash) of new files below ``path``, without hidden and ignored ones.

    ``exclude`` are globs of paths to pass over; with ``settled`` (as ``600 milliseconds``)
    files changed since then wait for a later start.
    """
    source = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger)
    if settled:
        source = source.option("modifiedBefore", spark.sql(f"SELECT date_format(current_timestamp() - INTERVAL {settled}, \"yyyy-MM-dd'T'HH:mm:ss\")").first()[0])
    raw = source.schema("path string, modificationTime timestamp, length long, content binary").load(path)
    parts = F.split("path", "/")
    hidden = F.exists(F.slice(parts, -1, 1), lambda p: p.startswith(".")) | F.exists(parts, lambda p: p.isin(*IGNORED))
    for g in exclude or []:
        hidden = hidden | F.col("path").rlike(glob_pattern(g))
    return raw.filter(~hidden).select("path", "modificationTime", "length", F.sha2("content", 256).alias("hash"))


def on_each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Start ``stream`` with ``apply`` on each micro-batch; what is there is processed, then it stops."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_calls(stream: DataFrame, time: str = "ts", width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Calls by window and tool, final once ``late`` has passed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count(F.lit(1)).alias("calls"), F.sum("value").alias("value"))


def breaker(stream: DataFrame, failures: int = 2, off_ms: int = 30 * 60 * 1000) -> DataFrame:
    """(key, at, allowed) of a stream (key, at long, ok boolean): after ``failures`` in a row a key is off for ``off_ms``.

    A call while a key is off isn't allowed and its outcome doesn't count; a success resets the count.
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        count, until = state.get if state.exists else (0, 0)
        rows = []
        for at, ok in pd.concat(list(batches))[["at", "ok"]].sort_values("at").itertuples(index=False):
            allowed = at >= until
            rows.append((key[0], int(at), bool(allowed)))
            if allowed:
                count = 0 if ok else count + 1
                if count >= failures:
                    count, until = 0, int(at) + off_ms
        state.update((count, until))
        yield pd.DataFrame(rows, columns=["key", "at", "allowed"])

    return stream.groupBy("key").applyInPandasWithState(step, "key string, at long, allowed boolean", "count int, until long", "append", "NoTimeout")
