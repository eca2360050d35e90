"""Near-duplicate texts by deletion-variant signatures.

A text's set of three-word shingles becomes a signature of SEGMENTS * WIDTH min-hashes.  The
signature is cut into segments, and every segment is indexed by its variants with one place
left out (a wildcard), so two texts meet if some segment differs in at most one place.  A
plain bit signature cannot be used at a similarity of 0.70: its bits differ in 15 of 100
places, and no segment short enough to differ in one bit would tell texts apart; so the
places hold min-hashes, of which a segment holds few but selective ones.  With 9 segments of
6, texts at similarity 0.70 meet with 99.3 %, at 0.75 with 99.9 %.

Texts with equal word sequences are one class and indexed once.  Variants travel as packed
blobs, one for each (task, bucket), and a bucket sorts its keys.  Candidates must then agree
in a one-bit sketch, in their whole signatures, and last in an exact Jaccard of the shingles.
A key that is frequent among the documents of a task goes past its bucket, so it fills none;
a bucket, which sees all other entries of its keys, passes on every key with more than BLOCK
documents.  Both are counted together and dealt evenly to blocks of BLOCK documents, and
pairs of blocks are compared, so no key is gathered in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import strip_space
from loomgraph.operators.skew import lookup_join
from loomgraph.session import cut, drop_cut

SEGMENTS, WIDTH = 9, 6
PLACES = SEGMENTS * WIDTH
SHINGLE, MIN_WORDS, THRESHOLD = 3, 20, 0.70
#: Bytes of index entries that a bucket holds on average.
BUCKET_BYTES = 8 << 20
#: Documents of one key that are compared in place; a key with more is dealt in blocks of this size.
BLOCK = 4_096
#: Entries of one key among SPREAD documents of a task beyond which they go past the key's bucket.
FREQUENT, SPREAD = 128, 20_000
#: Members of a class in a block when the pairs of a class are listed.
LISTED = 1_000

_WORD = re.compile(r"[^\W_]+")
_RNG = np.random.default_rng(7)
_MUL = _RNG.integers(1, 1 << 63, PLACES, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, PLACES, dtype=np.uint64)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_ENTRY = np.dtype([("key", "<u8"), ("doc", "<i8"), ("bits", "<u8")])


def words_of(text: str) -> list[str]:
    """Maximal runs of letters or digits, lower-cased."""
    return _WORD.findall(text.lower())


def shingle_set(words: list[str], k: int = SHINGLE) -> frozenset[tuple[str, ...]]:
    return frozenset(zip(*[words[i:] for i in range(k)]))


def jaccard(a: frozenset, b: frozenset) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 0.0


class _WordHashes(dict):
    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[w] = h = xxhash.xxh64_intdigest(w)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX[1]
    return h ^ (h >> np.uint64(32))


def signatures(word_lists: list[list[str]], hashes: dict[str, int]) -> np.ndarray:
    """One row of PLACES 32-bit min-hashes for each list of at least SHINGLE words."""
    sizes = np.array([len(w) for w in word_lists])
    flat = np.fromiter((hashes[w] for ws in word_lists for w in ws), dtype=np.uint64, count=int(sizes.sum()))
    h = _mix(flat[:-2] * _MIX[0] + _mix(flat[1:-1] * _MIX[1] + flat[2:] * _MIX[2]))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    inside = np.ones(len(h), dtype=bool)  # shingles across a border of texts don't count
    for back in (1, 2):
        at = starts[1:] - back
        inside[at[at < len(h)]] = False
    h = h[inside]
    first = np.concatenate([[0], np.cumsum(sizes - SHINGLE + 1)[:-1]])
    out = np.empty((len(word_lists), PLACES), dtype=np.uint32)
    for i in range(PLACES):
        out[:, i] = np.minimum.reduceat((h * _MUL[i] + _ADD[i]) >> np.uint64(32), first)
    return out


def variant_entries(docs: np.ndarray, sigs: np.ndarray) -> np.ndarray:
    """Entries of all one-wildcard variants: a key of (segment, open place, other places)."""
    bits = np.zeros(len(docs), dtype=np.uint64)
    for i in range(PLACES):
        bits |= (sigs[:, i].astype(np.uint64) & np.uint64(1)) << np.uint64(i)
    out = np.empty((SEGMENTS * WIDTH, len(docs)), dtype=_ENTRY)
    for s in range(SEGMENTS):
        part = sigs[:, s * WIDTH : (s + 1) * WIDTH].astype(np.uint64)
        terms = [_mix((part[:, i] + np.uint64((s * WIDTH + i + 1) << 33)) * _MIX[0]) for i in range(WIDTH)]
        whole = np.sum(terms, axis=0, dtype=np.uint64)
        for i in range(WIDTH):
            row = out[s * WIDTH + i]
            row["key"] = _mix(whole - terms[i] + np.uint64(s * WIDTH + i))
            row["doc"], row["bits"] = docs, bits
    return out.reshape(-1)


def close_bits(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether two sketches may belong to texts at ``threshold``: 4.5 deviations of leeway."""
    p = (1 - threshold) / 2
    return np.bitwise_count(a ^ b) <= PLACES * p + 4.5 * (PLACES * p * (1 - p)) ** 0.5


def close_signatures(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    equal = (a == b).mean(axis=-1)
    return equal >= threshold - 4.5 * (threshold * (1 - threshold) / PLACES) ** 0.5


def pairs_in_runs(keys: np.ndarray, docs: np.ndarray, bits: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (smaller, larger) of documents with equal keys whose sketches are close; keys are sorted."""
    a_all, b_all, back = [], [], 1
    alive = np.arange(len(keys))
    while alive.size:  # each entry against the one ``back`` before it, as long as the key is the same
        alive = alive[alive >= back]
        alive = alive[keys[alive] == keys[alive - back]]
        ok = alive[close_bits(bits[alive], bits[alive - back], threshold) & (docs[alive] != docs[alive - back])]
        a_all.append(docs[ok - back])
        b_all.append(docs[ok])
        back += 1
    a, b = np.concatenate([*a_all, np.empty(0, np.int64)]), np.concatenate([*b_all, np.empty(0, np.int64)])
    a, b = np.minimum(a, b), np.maximum(a, b)
    if len(a):
        u = np.unique(np.stack([a, b], axis=1), axis=0)
        a, b = u[:, 0], u[:, 1]
    return a, b


def _signed(df: DataFrame, key: str, text: str) -> DataFrame:
    """doc long, id string, h long, seq binary, sig binary of texts of at least MIN_WORDS words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hashes, at = _WordHashes(), TaskContext.get().partitionId() << 40
        for b in batches:
            for lo in range(0, b.num_rows, 1_000):
                part = b.slice(lo, 1_000)
                words = [words_of(t) for t in part.column(2).to_pylist()]
                keep = [i for i, w in enumerate(words) if len(w) >= MIN_WORDS]
                if not keep:
                    continue
                kept = [words[i] for i in keep]
                sigs = signatures(kept, hashes)
                take = pa.array(keep)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(at, at + len(keep)), pa.int64()), part.column(0).take(take), part.column(1).take(take),
                        pa.array([xxhash.xxh3_128_digest(" ".join(w)) for w in kept], pa.binary()), pa.array([s.tobytes() for s in sigs], pa.binary()),
                    ],
                    names=["doc", "id", "h", "seq", "sig"],
                )
                at += len(keep)

    slim = df.filter(F.col(key).isNotNull() & (F.length(text) >= 2 * MIN_WORDS - 1)).select(F.col(key).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    return slim.mapInArrow(run, "doc long, id string, h long, seq binary, sig binary")


def candidate_pairs(reps: DataFrame, buckets: int, threshold: float = THRESHOLD, block: int = BLOCK) -> tuple[DataFrame, list[DataFrame]]:
    """Distinct (a, b), a < b, of documents (doc long, sig binary) that share a one-wildcard variant.

    Also returns the written frames behind it, to be dropped when the pairs have been read.
    """
    frequent = min(FREQUENT, block)
    none = lambda n, kind: pa.nulls(n, kind)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = b.column(0).to_numpy()
            sigs = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint32).reshape(-1, PLACES)
            for lo in range(0, len(docs), SPREAD):
                e = variant_entries(docs[lo : lo + SPREAD], sigs[lo : lo + SPREAD])
                where = (e["key"] % np.uint64(buckets)).astype(np.int64)
                e = e[np.lexsort((e["key"], where))]
                rows = []
                change = np.flatnonzero(e["key"][1:] != e["key"][:-1]) + 1
                starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(e)]])
                hot = ends - starts > frequent
                light = np.ones(len(e), dtype=bool)
                for s, t in zip(starts[hot], ends[hot]):
                    # The bucket gets a mark in place of the documents, so that it passes on what others have of the key;
                    # they themselves travel with any bucket.
                    rows += [(int(e["doc"][x] % buckets), int(e["key"][s].view(np.int64)), min(block, t - x), e[x : min(x + block, t)].tobytes()) for x in range(s, t, block)]
                    light[s:t] = False
                    light[s], e["doc"][s] = True, -1
                e = e[light]
                edges = np.searchsorted((e["key"] % np.uint64(buckets)).astype(np.int64), np.arange(buckets + 1))
                rows += [(i, None, None, e[edges[i] : edges[i + 1]].tobytes()) for i in range(buckets) if edges[i] < edges[i + 1]]
                cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(cols, names=["bucket", "hot", "n", "blob"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        at = None
        for b in batches:  # the buckets of a task lie one behind the other
            past = b.filter(pa.array(b.column(1).is_valid()))
            if past.num_rows:
                unknown = none(past.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([unknown, unknown, *past.columns[1:]], names=["a", "b", "hot", "n", "blob"])
            b = b.filter(b.column(1).is_null())
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                if held and bucket != at:
                    yield from meet_bucket(held)
                    held = []
                at = bucket
                held.append(blob)
        if held:
            yield from meet_bucket(held)

    def meet_bucket(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        e = np.frombuffer(b"".join(blobs), dtype=_ENTRY)
        e = e[np.argsort(e["key"], kind="stable")]
        change = np.flatnonzero(e["key"][1:] != e["key"][:-1]) + 1
        starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(e)]])
        passed = (ends - starts > block) | (np.add.reduceat((e["doc"] < 0).astype(np.int64), starts) > 0)
        here = np.repeat(~passed, ends - starts)
        a, b = pairs_in_runs(e["key"][here], e["doc"][here], e["bits"][here], threshold)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(none(len(a), t) for t in (pa.int64(), pa.int64(), pa.binary()))], names=["a", "b", "hot", "n", "blob"])
        for s, t in zip(starts[passed], ends[passed]):
            own = e[s:t][e["doc"][s:t] >= 0]
            x = [own[i : i + block] for i in range(0, len(own), block)]
            key, n = pa.array([int(e["key"][s].view(np.int64))] * len(x), pa.int64()), pa.array([len(y) for y in x], pa.int64())
            yield pa.RecordBatch.from_arrays([none(len(x), pa.int64()), none(len(x), pa.int64()), key, n, pa.array([y.tobytes() for y in x], pa.binary())], names=["a", "b", "hot", "n", "blob"])

    def regroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block_of(key: tuple, blobs: list[bytes]) -> pa.RecordBatch:
            cols = [pa.array([v], t) for v, t in zip((*key, b"".join(blobs)), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))]
            return pa.RecordBatch.from_arrays(cols, names=["hot", "part", "parts", "blob"])

        held: list[bytes] = []
        at = None
        for b in batches:
            for *key, blob in zip(*(b.column(i).to_pylist() for i in range(4))):
                if held and tuple(key) != at:
                    yield block_of(at, held)
                    held = []
                at = tuple(key)
                held.append(blob)
        if held:
            yield block_of(at, held)

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p, q = np.frombuffer(x, dtype=_ENTRY), np.frombuffer(y, dtype=_ENTRY)
                for lo in range(0, len(p), 256):
                    i, j = np.nonzero(close_bits(p["bits"][lo : lo + 256, None], q["bits"][None, :], threshold))
                    a, b = p["doc"][lo + i], q["doc"][j]
                    a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = reps.select("doc", "sig").mapInArrow(spread, "bucket int, hot long, n long, blob binary")
    met = cut(dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "a long, b long, hot long, n long, blob binary"))
    hot = met.filter(F.col("hot").isNotNull()).select("hot", "n", "blob")
    # All documents of a key, counted in one row for each task, are dealt to as many blocks as they fill.
    parts = hot.groupBy("hot").agg(F.ceil(F.sum("n") / block).cast("int").alias("parts"))
    placed = lookup_join(hot.select("hot", "blob"), parts, ["hot"]).select("hot", F.pmod(F.xxhash64("blob"), F.col("parts")).cast("int").alias("part"), "parts", "blob")
    blocks = cut(placed.repartition("hot", "part").sortWithinPartitions("hot", "part").mapInArrow(regroup, "hot long, part int, parts int, blob binary"))
    left = blocks.select("hot", F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("part"), "blob")
    far = left.join(blocks.select("hot", "part", F.col("blob").alias("blob2")), ["hot", "part"]).select("blob", "blob2").mapInArrow(cross, "a long, b long")
    return met.filter(F.col("hot").isNull()).select("a", "b").unionByName(far).distinct(), [met, blocks]


def near_duplicates(df: DataFrame, key: str = "id", text: str = "text", threshold: float = THRESHOLD, buckets: int | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Classes of texts and links between them.

    Returns (members, links): members has (``class`` long, ``id``), a class for each distinct
    word sequence; links has (``a``, ``b``, ``similarity`` double), a < b, of classes whose
    sets of three-word shingles have a Jaccard similarity of at least ``threshold``.

    Defined cases: texts of fewer than 20 words, null texts and null ids take no part;
    repeated rows count once; an id with several texts is in several classes; very long texts
    are compared whole; an empty table gives no rows; other columns are ignored.
    """
    signed = cut(_signed(df, key, text))
    reps = cut(signed.groupBy("seq").agg(F.min(F.struct("doc", "id", "h", "sig")).alias("m")).select("seq", "m.*"))
    # Buckets grow with the texts, so that none outgrows a task.
    n = buckets or reps.count() * PLACES * _ENTRY.itemsize // BUCKET_BYTES + 1
    members = lookup_join(signed.select("seq", "id").distinct(), reps.select("seq", F.col("doc").alias("class")), ["seq"], rows=signed.count()).select("class", "id")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), dtype=np.uint32).reshape(-1, PLACES) for i in (2, 3))
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(close_signatures(x, y, threshold)))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, frozenset] = {}
        size = 0
        for b in batches:
            a_, b_ = b.column(0).to_pylist(), b.column(1).to_pylist()
            out = []
            for i, j, x, y in zip(a_, b_, b.column(2), b.column(3)):
                for d, t in ((i, x), (j, y)):
                    if d not in sets:
                        if size > 200_000:  # shingles kept
                            sets.clear()
                            size = 0
                        sets[d] = shingle_set(words_of(t.as_py()))
                        size += len(sets[d])
                out.append(jaccard(sets[i], sets[j]) if i in sets and j in sets else jaccard(shingle_set(words_of(x.as_py())), shingle_set(words_of(y.as_py()))))
            sims = np.array(out, dtype=np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(sims)], names=["a", "b", "similarity"]).filter(pa.array(sims >= threshold))

    pairs, written = candidate_pairs(reps, n, threshold, block)
    sig_a, sig_b = (reps.select(F.col("doc").alias(x), F.col("sig").alias(f"s{x}")) for x in "ab")
    pairs = cut(pairs.join(sig_a, "a").join(sig_b, "b").select("a", "b", "sa", "sb").mapInArrow(agree, "a long, b long"))
    for frame in written:
        drop_cut(frame)
    # Texts only of those still in question, found again by id and hash.
    asked = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct().join(reps.select("doc", "id", "h"), "doc")
    source = df.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    texts = cut(source.join(asked, ["id", "h"]).dropDuplicates(["doc"]).select("doc", "t"))
    text_a, text_b = (texts.select(F.col("doc").alias(x), F.col("t").alias(f"t{x}")) for x in "ab")
    links = cut(pairs.join(text_a, "a").join(text_b, "b").select("a", "b", "ta", "tb").mapInArrow(exact, "a long, b long, similarity double"))
    for frame in (pairs, texts):
        drop_cut(frame)
    return members, links


def all_pairs(members: DataFrame, links: DataFrame, listed: int = LISTED) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of all members of linked classes and of each class.

    Members are dealt to blocks of ``listed``, and blocks are joined, so that a large class is
    listed by many tasks.
    """
    size = members.groupBy("class").agg(F.count(F.lit(1)).alias("n")).select("class", "n", F.ceil(F.col("n") / listed).cast("int").alias("parts"))
    placed = lookup_join(members, size, ["class"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    several = placed.filter(F.col("n") > 1)
    x = several.select("class", F.col("id").alias("x"), "part", every("parts").alias("with"))
    y = several.select("class", F.col("id").alias("y"), F.col("part").alias("with"), every("parts").alias("part"))
    inside = x.join(y, ["class", "part", "with"]).filter(F.col("x") < F.col("y")).select("x", "y")
    sized = [size.select(F.col("class").alias(c), F.col("parts").alias(f"n{c}")) for c in "ab"]
    ends = links.select("a", "b").join(sized[0], "a").join(sized[1], "b").select("a", "b", every("na").alias("pa"), "nb").select("a", "b", "pa", every("nb").alias("pb"))
    xs, ys = (placed.select(F.col("class").alias(c), F.col("part").alias(f"p{c}"), F.col("id").alias(i)) for c, i in (("a", "x"), ("b", "y")))
    between = ends.join(xs, ["a", "pa"]).join(ys, ["b", "pb"]).select("x", "y")
    both = between.unionByName(inside)
    return both.filter(F.col("x") != F.col("y")).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def file_classes(files: DataFrame) -> DataFrame:
    """(``class`` string, ``id``) of files with a hash; case, spaces and a leading ``sha256:`` don't count."""
    bare = F.regexp_replace(F.lower(strip_space(F.col("hash"))), "^sha256:", "")
    return files.filter(F.col("id").isNotNull() & F.col("hash").isNotNull()).select(strip_space(bare).alias("class"), "id").filter(F.col("class") != "").distinct()


def p7_found(spark, sf_dir):
    from loomgraph.session import table

    members, links = near_duplicates(table(spark, sf_dir, "chunks"))
    same = file_classes(table(spark, sf_dir, "files"))
    none = spark.createDataFrame([], "a string, b string")
    return all_pairs(members, links).unionByName(all_pairs(same, none))


def p7_groups(spark, sf_dir):
    """One row for each chunk of a near-duplicate group: its group, class size and links of its class."""
    from loomgraph.llm.groups import connected_components
    from loomgraph.session import table

    members, links = near_duplicates(table(spark, sf_dir, "chunks"))
    size = members.groupBy("class").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    degree = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    named = size.select("class", "least")
    ends = links.join(named.select(F.col("class").alias("a"), F.col("least").alias("x")), "a").join(named.select(F.col("class").alias("b"), F.col("least").alias("y")), "b")
    groups = connected_components(ends, "x", "y").select(F.col("id").alias("least"), "group_id")
    zero = F.coalesce("links", F.lit(0).cast("long")).alias("links")
    kept = size.join(degree, "class", "left").join(groups, "least", "left").filter((F.col("copies") > 1) | F.col("links").isNotNull())
    return lookup_join(members, kept, ["class"]).select("id", F.coalesce("group_id", "least").alias("group_id"), "copies", zero)


QUERIES = {"p7_found": p7_found, "p7_groups": p7_groups}
ORACLES: dict[str, str] = {
    "p7_found": r"""
WITH c AS (SELECT DISTINCT id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM chunks WHERE id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT DISTINCT id, w[i : i + 2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM c WHERE len(w) >= 20)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
f AS (SELECT DISTINCT id, trim(regexp_replace(lower(trim(hash)), '^sha256:', '')) AS h FROM files WHERE hash IS NOT NULL)
SELECT id_a, id_b FROM p JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE k >= 0.7 * (x.n + y.n - k)
UNION SELECT a.id, b.id FROM f a JOIN f b ON a.h = b.h AND a.id < b.id"""
}
