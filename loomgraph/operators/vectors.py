"""Exact vector search for a batch of query vectors, and small vector tools."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import top_rows
from loomgraph.operators.skew import sent_if_small


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision, over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    both = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is all zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """``cosine``, ``dot``, or ``l2``: one less the squared distance."""
    if metric == "l2":
        return 1.0 - F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return cosine(a, b) if metric == "cosine" else dot(a, b)


#: Query vectors that are sent to the tasks as a matrix; more are joined.
MATRIX_QUERIES = 20_000
#: Scores of one batch that are held at once.
BLOCK_SCORES = 4_000_000


def knn(records: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", keys: list[str] | None = None, digits: int = 9) -> DataFrame:
    """(keys, qid, id, score, rank): the k nearest records of each query, equal scores by id.

    ``queries`` (qid, qv, keys) is a stated set.  Up to MATRIX_QUERIES, as checked, are sent to
    all tasks as matrices, which batches of records are multiplied with; the records are
    scanned once and only k rows for each query and batch are shuffled.  More queries are
    joined.  A similarity that can't be told (a null, or the cosine of a zero vector) is null
    and ranks last.
    """
    keys = keys or []
    asked = queries.select(*keys, "qid", "qv").limit(MATRIX_QUERIES + 1).toArrow()
    order = [F.desc("score"), F.col("id")]
    if asked.num_rows <= MATRIX_QUERIES:
        types = [(c, queries.schema[c].dataType.simpleString()) for c in [*keys, "qid"]] + [("id", records.schema["id"].dataType.simpleString()), ("score", "double")]
        near = records.select(*keys, "id", "v").mapInArrow(_nearest_in_batches(asked, k, metric, keys, digits), ", ".join(f"`{c}` {t}" for c, t in types))
        return top_rows(near, [*keys, "qid"], order, k)
    score = F.round(similarity(F.col("v"), F.col("qv"), metric), digits).alias("score")
    q = sent_if_small(queries)
    pairs = records.join(q, keys) if keys else records.crossJoin(q)
    return top_rows(pairs.select(*keys, "qid", "id", score), [*keys, "qid"], order, k)


def _nearest_in_batches(asked, k: int, metric: str, keys: list[str], digits: int):
    import numpy as np
    import pyarrow as pa

    def matrix(column, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows of ``width`` numbers, NaN where one is null; which rows have that length)."""
        size = np.asarray(column.value_lengths().fill_null(-1))
        width = int(size.max(initial=0)) if width is None else width
        fits = size == width
        flat = column.filter(pa.array(fits)).flatten().cast(pa.float64())
        return np.asarray(flat.fill_null(np.nan)).reshape(int(fits.sum()), width), fits

    def scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            if metric == "l2":
                return 1.0 - np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0)
            s = x @ y.T
            if metric == "cosine":
                s = s / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :])
            return np.where(np.isfinite(s), s, np.nan)

    def run(batches):
        of: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(*(asked[c].to_pylist() for c in keys)) if keys else [()] * asked.num_rows):
            of.setdefault(key, []).append(i)
        qv, whole = matrix(asked["qv"].combine_chunks())
        if not whole.all():
            raise ValueError("all query vectors need the same length")
        names = [*keys, "qid", "id", "score"]
        for b in batches:
            ids = b.column("id").to_pylist()
            rank = np.empty(len(ids), dtype=np.int64)
            rank[sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i]))] = np.arange(len(ids))
            x, fits = matrix(b.column("v"), qv.shape[1])
            at = np.full(len(ids), -1)
            at[fits] = np.arange(len(x))
            rows_of: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(b.column(c).to_pylist() for c in keys)) if keys else [()] * len(ids)):
                if key in of:
                    rows_of.setdefault(key, []).append(i)
            for key, rows in rows_of.items():
                rows = np.array(rows)
                q = np.array(of[key])
                step = max(1, BLOCK_SCORES // len(rows))
                for lo in range(0, len(q), step):
                    some = q[lo : lo + step]
                    s = np.full((len(some), len(rows)), np.nan)
                    known = at[rows] >= 0
                    s[:, known] = np.round(scores(qv[some], x[at[rows[known]]]), digits)
                    low = np.where(np.isnan(s), -np.inf, s)
                    least = -np.partition(-low, min(k, len(rows)) - 1, axis=1)[:, [min(k, len(rows)) - 1]]
                    r, c = np.nonzero(low >= least)
                    order = np.lexsort((rank[rows[c]], -low[r, c], r))
                    r, c = r[order], c[order]
                    count = np.bincount(r, minlength=len(some))
                    keep = np.arange(len(r)) - (np.cumsum(count) - count)[r] < k
                    r, c = r[keep], c[keep]
                    v = s[r, c]
                    take = pa.array(rows[c])
                    cols = [b.column(n).take(take) for n in keys] + [asked["qid"].combine_chunks().take(pa.array(some[r])), b.column("id").take(take), pa.array(v, pa.float64(), mask=np.isnan(v))]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def running_mean(old: Column, new: Column, keep: float = 0.6) -> Column:
    """The unit vector of keep * old + (1 - keep) * new; a zero vector stays zero."""
    mixed = F.zip_with(old, new, lambda x, y: x.cast("double") * keep + y.cast("double") * (1 - keep))
    n = norm(mixed)
    return F.transform(mixed, lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def sample_recent(records: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """The n newest of the first 2 n records (in id order) of each key."""
    pool = top_rows(records, keys, [F.col("id")], 2 * n, "p")
    return top_rows(pool, keys, [F.desc("created_at"), F.col("id")], n).drop("p")


def sample_random(records: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """n of the first 2 n records (in id order) of each key, in a seeded order."""
    pool = top_rows(records, keys, [F.col("id")], 2 * n, "p")
    return top_rows(pool, keys, [F.xxhash64("id", F.lit(seed)), F.col("id")], n).drop("p")


def usable(v: Column, dim: int = 64) -> Column:
    """Whether a vector has ``dim`` numbers, none null, NaN or infinite, and not all zero."""
    whole = (F.size(v) == dim) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    return F.coalesce(v.isNotNull() & whole, F.lit(False))


def vector_filter(records: DataFrame, kinds: list[str] | None = None, file_id: str | None = None, domain: str | None = None, entity_type: str | None = None, source_ids: list[str] | None = None, exclude_source_ids: list[str] | None = None) -> DataFrame:
    """Records that meet all conditions given; an entity's type is its domain, so with both ``domain`` and ``entity_type`` both must hold."""
    conditions = [
        F.col("kind").isin(*kinds) if kinds else None,
        F.col("file_id") == file_id if file_id is not None else None,
        F.col("domain") == domain if domain is not None else None,
        F.col("domain") == entity_type if entity_type is not None else None,
        F.col("source_id").isin(*source_ids) if source_ids else None,
        ~F.col("source_id").isin(*exclude_source_ids) if exclude_source_ids else None,
    ]
    for c in conditions:
        records = records if c is None else records.filter(c)
    return records


def by_source_id(records: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked (universe_id, source_id) its record with the smallest id; unknown ones give no row."""
    met = records.join(asked.select("universe_id", "source_id").distinct(), ["universe_id", "source_id"], "left_semi")
    return top_rows(met, ["universe_id", "source_id"], [F.col("id"), F.desc("created_at")], 1).drop("rank")


def as_records(rows: DataFrame) -> DataFrame:
    """Rows of any origin as vector records: the thirteen columns with their types, missing ones and nulls as empty values."""
    texts = ["id", "kind", "source_id", "universe_id", "title", "text", "domain", "graph_node_id", "file_id"]
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    lists = lambda c: F.filter(F.coalesce(have(c).cast("array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull())
    numbers = F.filter(F.coalesce(have("vector").cast("array<float>"), F.array().cast("array<float>")), lambda x: x.isNotNull())
    cols = {c: F.coalesce(have(c).cast("string"), F.lit("")) for c in texts}
    cols |= {"vector": numbers, "keywords": lists("keywords"), "topics": lists("topics"), "created_at": F.coalesce(have("created_at").cast("long"), F.lit(0).cast("long"))}
    order = ["id", "kind", "source_id", "universe_id", "title", "text", "vector", "keywords", "domain", "topics", "graph_node_id", "file_id", "created_at"]
    return rows.select(*[cols[c].alias(c) for c in order])


def embed_texts(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], task: str = "passage", column: str = "text", batch: int = 16) -> DataFrame:
    """``texts`` with their vectors in ``v``: a model is called with batches of ``batch`` texts, each with the task as its prefix.

    ``embed`` runs on the workers.  Null texts have null vectors.
    """
    import pandas as pd
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    def run(batches):
        for b in batches:
            known = b[column].notna().to_numpy().nonzero()[0]
            vectors: list = [None] * len(b)
            for lo in range(0, len(known), batch):
                at = known[lo : lo + batch]
                for i, v in zip(at, embed([f"{task}: {b[column].iloc[j]}" for j in at])):
                    vectors[i] = [float(x) for x in v]
            yield b.assign(v=pd.Series(vectors, index=b.index, dtype=object))

    return texts.mapInPandas(run, StructType([*texts.schema.fields, StructField("v", ArrayType(DoubleType()))]))


def sample_diverse(records: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Up to n records of each key, each farthest from those chosen; the first is the smallest id.

    The pool is the first max(5 n, 20) records of a key in id order, so a group is bounded.
    """
    import numpy as np
    import pandas as pd

    pool = top_rows(records.select(*keys, "id", "v"), keys, [F.col("id")], max(5 * n, 20), "p")

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        if len(g) <= n:
            return g.assign(turn=range(len(g)))[[*keys, "id", "turn"]]
        x = np.stack(g["v"]).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        chosen, near = [0], x @ x[0]
        while len(chosen) < n:
            near[chosen] = np.inf
            chosen.append(int(near.argmin()))
            near = np.maximum(near, x @ x[chosen[-1]])
        return g.iloc[chosen].assign(turn=range(n))[[*keys, "id", "turn"]]

    schema = ", ".join(f"{k} {records.schema[k].dataType.simpleString()}" for k in [*keys, "id"]) + ", turn int"
    return pool.groupBy(*keys).applyInPandas(pick, schema)
