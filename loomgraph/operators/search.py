"""Full-text search with BM25, for a batch of queries at once."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import top_rows
from loomgraph.session import cut

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: Terms of all queries that are sent as a list; more are joined.
LISTED_TERMS = 2_000


def _accents() -> tuple[str, str]:
    """Latin letters with marks and the letters without, by Unicode decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x250)]
    plain = [(a, b[0].lower()) for a, b in pairs if len(b) > 1 and all(unicodedata.category(x) == "Mn" for x in b[1:])]
    return "".join(a for a, _ in plain), "".join(b for _, b in plain)


def fold(c: Column) -> Column:
    """Lower case without diacritics, in the JVM."""
    return F.regexp_replace(F.translate(F.lower(c), *_accents()), r"\p{Mn}", "")


def terms(c: Column) -> Column:
    """Maximal runs of letters, digits, ``_``, ``-`` and ``.`` of the folded text."""
    return F.filter(F.split(fold(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}\p{Co}_.\-]+"), lambda t: t != "")


def sanitize_query(c: Column) -> Column:
    """Query words (a bag) in the order given: operators become spaces, words of one character drop out."""
    words = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), "[\"'*^:()\\-]", " "), r"\s+")
    return F.filter(words, lambda w: F.length(w) > 1)


def match_expression(c: Column) -> Column:
    """The sanitized query as an OR of quoted words."""
    return F.array_join(F.transform(sanitize_query(c), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ")


def query_units(queries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, qid, unit, tokens, times): the words of each query with their tokens.

    A word of several tokens, as ``a/b``, is a phrase; one without tokens matches nothing; a
    repeated word counts as often as it is asked.
    """
    words = queries.select(*keys, "qid", F.explode(sanitize_query(F.col("query"))).alias("w")).select(*keys, "qid", terms(F.col("w")).alias("tokens")).filter(F.size("tokens") > 0)
    return words.groupBy(*keys, "qid", F.array_join("tokens", " ").alias("unit"), "tokens").agg(F.count(F.lit(1)).alias("times"))


def postings(docs: DataFrame, keys: list[str], wanted: DataFrame | list[str] | None = None) -> DataFrame:
    """(keys, id, kind, len, term, pos): one row for each token, and one with a null term for each document.

    With ``wanted`` (a frame with term, or a short list) only those terms are kept; those of a
    list leave the texts before anything is exploded.  Written once, it serves statistics and
    hits of any number of searches; the texts are tokenised once.  A position between title
    and text is left out, so no phrase crosses it.
    """
    own = docs.select(*keys, "id", "kind", terms(F.col("title")).alias("t1"), terms(F.col("text")).alias("t2"))

    def placed(c: str, after: Column) -> Column:
        row = lambda t, i: F.struct(t.alias("term"), (i + after).alias("pos"))
        if isinstance(wanted, list):
            return F.array_compact(F.transform(c, lambda t, i: F.when(t.isin(*wanted), row(t, i))))
        return F.transform(c, row)

    marker = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(-1).alias("pos")))
    tokens = F.concat(marker, placed("t1", F.lit(0)), placed("t2", F.size("t1") + 1))
    rows = own.select(*keys, "id", "kind", (F.size("t1") + F.size("t2")).alias("len"), F.explode(tokens).alias("p")).select(*keys, "id", "kind", "len", "p.term", "p.pos")
    if wanted is None or isinstance(wanted, list):
        return rows
    return rows.join(wanted.withColumn("_w", F.lit(True)), "term", "left").filter(F.col("_w") | F.col("term").isNull()).drop("_w")


def bm25(docs: DataFrame, queries: DataFrame, k: int, group: str | None = None, kinds: list[str] | None = None, index: DataFrame | None = None) -> DataFrame:
    """(``group``, qid, id, score, rank): the k best documents of each query.

    ``docs`` has id, title, text, kind (and ``group``: statistics are per group), ``queries``
    qid and query, and ``group`` if a query is asked in one group only.  Statistics cover all documents; ``kinds`` filters the hits only.  Only
    the terms of the queries leave the scan: the corpus isn't shuffled.  ``index`` is a written
    :func:`postings` in place of ``docs``.
    """
    keys = [group] if group else []
    own = [c for c in keys if c in queries.columns]
    q = query_units(queries, own)
    post = index
    if index is None:
        wanted = q.select(F.explode("tokens").alias("term")).distinct()
        few = [r.term for r in wanted.limit(LISTED_TERMS + 1).collect()]
        post = cut(postings(docs, keys, few if len(few) <= LISTED_TERMS else wanted))
    stats = post.filter(F.col("term").isNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"))
    units = q.select("unit", "tokens").distinct()
    hits = post.filter(F.col("term").isNotNull())
    one = hits.join(units.filter(F.size("tokens") == 1).select(F.col("unit").alias("term")), "term", "left_semi").groupBy(*keys, "id", "kind", "len", F.col("term").alias("unit")).agg(F.count(F.lit(1)).alias("f"))
    # A phrase begins where all its tokens are found in their places.
    steps = units.filter(F.size("tokens") > 1).select("unit", F.size("tokens").alias("size"), F.posexplode("tokens").alias("step", "term"))
    begun = hits.join(steps, "term").groupBy(*keys, "id", "kind", "len", "unit", "size", (F.col("pos") - F.col("step")).alias("begin")).agg(F.count(F.lit(1)).alias("met"))
    several = begun.filter(F.col("met") == F.col("size")).groupBy(*keys, "id", "kind", "len", "unit").agg(F.count(F.lit(1)).alias("f"))
    tf = one.unionByName(several)
    df = tf.groupBy(*keys, "unit").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.when(idf > 0, idf).otherwise(F.lit(IDF_FLOOR)) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    rare = df.join(stats, keys) if keys else df.crossJoin(F.broadcast(stats))  # one row of statistics
    joined = tf.join(rare, [*keys, "unit"])
    if kinds:
        joined = joined.filter(F.col("kind").isin(*kinds))
    scored = joined.withColumn("s", weight).join(q.select(*own, "qid", "unit", "times"), [*own, "unit"]).groupBy(*keys, "qid", "id").agg(F.round(F.sum(F.col("s") * F.col("times")), 6).alias("score"))
    return top_rows(scored, [*keys, "qid"], [F.desc("score"), F.col("id")], k)


def documents_by_title(docs: DataFrame, queries: DataFrame, k: int = 5, group: str | None = None) -> DataFrame:
    """The k best document summaries of each query; see :func:`bm25`."""
    return bm25(docs, queries, k, group, kinds=["doc_summary"])
