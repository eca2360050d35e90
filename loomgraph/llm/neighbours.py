"""Most similar vectors for every vector, with a robust-pruned directed graph in each shard.

Vectors of one group (here universe and kind) form a shard.  A larger group is dealt to cells
around centroids fitted on a bounded sample, and a vector is looked for in as many of the
nearest cells as a bounded sample of queries, compared with the whole group, needs to meet
its true neighbours.  A cell that is still too large is dealt to several shards, all of which
are searched.  So no shard exceeds a size, and every vector is indexed.

In a shard equal vectors are folded, and the graph grows over the distinct ones in batches:
a greedy search from a few entries proposes neighbours for each new node, the relaxed pruning
keeps diverse ones (a candidate is dropped if a kept one is nearer to it by the factor ALPHA),
and every edge is also entered backwards and pruned there.  Then beam searches of the whole
graph answer the queries; what they find is ranked by exact similarities.  Every group with
more vectors than a beam takes this way, whatever its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import cut

#: Edges of a node, width of the beam when building and when asking, nodes opened at once, factor of the pruning.
DEGREE, BUILD_BEAM, BEAM, OPEN, ALPHA = 24, 32, 48, 8, 1.2
#: Nodes at which a search starts; most nodes that enter the graph together.
ENTRIES, BATCH = 32, 1_024
#: Most vectors of a shard; queries of one shard that one task answers.
SHARD, VISITORS = 32_768, 131_072
#: Most cells of a group, and of all groups together (their centroids are broadcast: 32 MB at 64 numbers).
MAX_CELLS, MAX_CENTROIDS = 8_192, 131_072
#: Vectors for each cell in the sample on which centroids are fitted.
SAMPLE_PER_CELL = 8
#: Queries in the sample that measures how many cells to look in, and the share of their true neighbours that those must hold.
ASKED, MET = 512, 0.97


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def top_columns(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the k highest of each row, highest first."""
    k = min(k, sims.shape[1])
    at = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < sims.shape[1] else np.tile(np.arange(k), (len(sims), 1))
    val = np.take_along_axis(sims, at, 1)
    order = np.argsort(-val, axis=1, kind="stable")
    return np.take_along_axis(at, order, 1), np.take_along_axis(val, order, 1)


def places(rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted row numbers below ``n``: how many of each, and the place of each within its row."""
    count = np.bincount(rows, minlength=n)
    return count, np.arange(len(rows)) - (np.cumsum(count) - count)[rows]


class Graph:
    """A directed graph over the rows of ``x`` (unit vectors, single precision)."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA):
        n = len(x)
        self.x, self.degree, self.alpha2 = x, degree, alpha * alpha
        self.edges = np.full((n, degree), -1, dtype=np.int32)
        self.entries = np.empty(0, dtype=np.int64)
        lo = 0
        while lo < n:
            hi = min(n, lo + min(max(lo, beam), BATCH))
            if lo:
                ids, sims = self.search(x[lo:hi], beam)
            else:  # the first few nodes are candidates of each other
                own = x[:hi] @ x[:hi].T
                np.fill_diagonal(own, -np.inf)
                ids, sims = top_columns(own, beam)
                ids[~np.isfinite(sims)] = -1
            self.link(lo, hi, ids, sims)
            centre = int((x[:hi] @ x[:hi].mean(axis=0)).argmax())
            self.entries = np.unique(np.append(np.linspace(0, hi - 1, min(hi, ENTRIES)).astype(np.int64), centre))
            lo = hi

    def prune(self, nodes: np.ndarray, cand: np.ndarray, sims: np.ndarray) -> None:
        """Set the edges of ``nodes`` from candidates (-1 for none), nearest first."""
        for lo in range(0, len(nodes), 512):
            c, s = cand[lo : lo + 512], sims[lo : lo + 512]
            rows, v = np.arange(len(c)), self.x[np.maximum(c, 0)]
            far = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))  # squared distances among candidates
            limit, alive = 2 - 2 * np.where(c >= 0, s, 0), c >= 0
            out = np.full((len(c), self.degree), -1, dtype=np.int32)
            for r in range(self.degree):
                first = alive.argmax(axis=1)
                has = alive[rows, first]
                if not has.any():
                    break
                out[has, r] = c[rows, first][has]
                alive &= ~((self.alpha2 * far[rows, first] <= limit) & has[:, None])
                alive[rows, first] = False
            self.edges[nodes[lo : lo + 512]] = out

    def link(self, lo: int, hi: int, ids: np.ndarray, sims: np.ndarray) -> None:
        """Give nodes [lo, hi) pruned edges to the candidates, and enter the backward edges."""
        self.prune(np.arange(lo, hi), ids, sims)
        row, col = np.nonzero(self.edges[lo:hi] >= 0)
        back_to, back_from = self.edges[lo:hi][row, col].astype(np.int64), row + lo
        # Of each target: the edges that it has and the new ones, each once, nearest first.
        targets = np.unique(back_to)
        row, col = np.nonzero(self.edges[targets] >= 0)
        to = np.concatenate([back_to, targets[row]])
        frm = np.concatenate([back_from, self.edges[targets][row, col]])
        _, first = np.unique(to * len(self.x) + frm, return_index=True)
        to, frm = to[first], frm[first]
        sim = np.einsum("ij,ij->i", self.x[to], self.x[frm])
        order = np.lexsort((-sim, to))
        row, frm, sim = np.searchsorted(targets, to[order]), frm[order], sim[order]
        count, place = places(row, len(targets))
        width = min(int(count.max(initial=0)), 2 * self.degree)  # of a hub's backward edges the nearest are considered
        near = place < width
        cand, cs = np.full((len(targets), width), -1, dtype=np.int64), np.zeros((len(targets), width), dtype=np.float32)
        cand[row[near], place[near]], cs[row[near], place[near]] = frm[near], sim[near]
        full = count > self.degree
        w = min(width, self.degree)
        self.edges[targets[~full], :w] = cand[~full, :w]
        self.prune(targets[full], cand[full], cs[full])

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest nodes found from each row of ``q``, nearest first; -1 and -inf fill up."""
        step = int(np.clip((1 << 23) // max(1, len(self.x)), 16, 512))  # a mark for each query and node
        parts = [self._search(q[lo : lo + step], beam) for lo in range(0, len(q), step)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, act = len(self.x), np.arange(len(q))
        seen = np.full(len(q) * n, -1, dtype=np.int32)  # the turn at which a query met a node
        seen[(act[:, None] * n + self.entries).ravel()] = 0
        out_ids, out_sims = np.full((len(q), beam), -1, dtype=np.int32), np.full((len(q), beam), -np.inf, dtype=np.float32)
        ids, sims = out_ids.copy(), out_sims.copy()
        at, val = top_columns(q @ self.x[self.entries].T, beam)
        ids[:, : at.shape[1]], sims[:, : at.shape[1]] = self.entries[at], val
        fresh = ids >= 0
        while True:
            # The nearest nodes of each beam that are not opened yet; beams without any are done.
            pick = fresh & (np.cumsum(fresh, axis=1, dtype=np.int16) <= OPEN)
            live = fresh.any(axis=1)
            if not live.all():
                out_ids[act[~live]], out_sims[act[~live]] = ids[~live], sims[~live]
                if not live.any():
                    return out_ids, out_sims
                act, ids, sims, fresh, pick = act[live], ids[live], sims[live], fresh[live], pick[live]
            fresh &= ~pick
            row, col = np.nonzero(pick)
            near = self.edges[ids[row, col]]
            key = ((act[row] * n)[:, None] + near).ravel()
            new = np.flatnonzero((seen[key] < 0) & (near.ravel() >= 0))
            key, turn = key[new], np.arange(len(new), dtype=np.int32)
            seen[key] = turn
            once = seen[key] == turn  # a node met on several ways counts once
            new = new[once]
            if not len(new):
                continue
            row, node = row[new // self.degree], near.ravel()[new]
            count, place = places(row, len(act))
            new_ids, new_sims = np.full((len(act), count.max()), -1, dtype=np.int32), np.full((len(act), count.max()), -np.inf, dtype=np.float32)
            new_ids[row, place], new_sims[row, place] = node, np.einsum("ij,ij->i", q[act[row]], self.x[node])
            best, sims = top_columns(np.concatenate([sims, new_sims], 1), beam)
            ids = np.take_along_axis(np.concatenate([ids, new_ids], 1), best, 1)
            fresh = np.take_along_axis(np.concatenate([fresh, new_ids >= 0], 1), best, 1)


def folded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each distinct row, and for each row the number of its distinct one."""
    x = np.ascontiguousarray(x)
    _, first, which = np.unique(x.view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_index=True, return_inverse=True)
    return first, which.ravel()


class Shard:
    """The vectors ``x`` of ``ids``, equal ones folded, with a graph over the distinct ones."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, edges: np.ndarray | None = None, entries: np.ndarray | None = None):
        order = np.argsort(ids)
        self.ids, self.raw = ids[order], x[order]
        first, which = folded(self.raw)
        mix = np.random.default_rng(len(first)).permutation(len(first))
        place = np.empty_like(mix)
        place[mix] = np.arange(len(mix))
        self.which = which = place[which]
        self.exact = unit(self.raw[first[mix]])
        self.members = np.argsort(which, kind="stable")  # by distinct vector, then id
        self.count = np.bincount(which, minlength=len(first))
        self.begin = np.cumsum(self.count) - self.count
        x32 = self.exact.astype(np.float32)
        if edges is None:
            self.graph = Graph(x32)
        else:
            self.graph = Graph(x32[:0])
            self.graph.x, self.graph.edges, self.graph.entries = x32, edges.reshape(-1, DEGREE), entries

    def nearest(self, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, member, similarity): the k nearest members of each member, itself excluded, equal ones by id.

        What a search finds counts both ways, so a node that no edge leads to is found by those near it.
        """
        n = len(self.exact)
        row, node, sim = self._candidates(self.exact, least, BEAM // 2)
        row, node, sim = np.concatenate([row, node]), np.concatenate([node, row]), np.concatenate([sim, sim])
        _, once = np.unique(row * n + node, return_index=True)
        row, node, sim = row[once], node[once], sim[once]
        order = np.lexsort((-sim, row))
        row, node, sim = row[order], node[order], sim[order]
        keep = places(row, n)[1] < 2 * k + 2
        return self._rows(self.ids, self.which, n, *self._expanded(row[keep], node[keep], sim[keep], n, k), k)

    def visited(self, ids: np.ndarray, x: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for the vectors ``x`` of ``ids``, which may be members."""
        first, which = folded(x)
        return self._rows(ids, which, len(first), *self._expanded(*self._candidates(unit(x[first]), least, 2 * k + 2), len(first), k), k)

    def _candidates(self, q: np.ndarray, least: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node, exact similarity) of the ``most`` nearest nodes that a search finds, nearest first."""
        out = []
        for lo in range(0, len(q), 1_024):
            x = q[lo : lo + 1_024]
            found, _ = self.graph.search(x.astype(np.float32), max(BEAM, most))
            sims = np.einsum("ij,ikj->ik", x, self.exact[np.maximum(found, 0)])
            sims[found < 0] = -np.inf
            at, sims = top_columns(sims, most)
            row, col = np.nonzero(np.isfinite(sims) & (sims >= least))
            out.append((row + lo, np.take_along_axis(found, at, 1)[row, col].astype(np.int64), sims[row, col]))
        return tuple(np.concatenate([o[i] for o in out]) for i in range(3))

    def _expanded(self, row: np.ndarray, node: np.ndarray, sim: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes as their members: of each query the first k + 1 by similarity, then id."""
        several = np.minimum(self.count[node], k + 1)
        step = np.arange(several.sum()) - np.repeat(np.cumsum(several) - several, several)
        row, sim, member = np.repeat(row, several), np.repeat(sim, several), self.members[np.repeat(self.begin[node], several) + step]
        order = np.lexsort((member, -sim, row))
        row, sim, member = row[order], sim[order], member[order]
        keep = places(row, n)[1] <= k
        return row[keep], member[keep], sim[keep]

    def _rows(self, ids: np.ndarray, which: np.ndarray, n: int, asked: np.ndarray, member: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The list of each distinct query for every row that asks it, without the row itself."""
        size = np.bincount(asked, minlength=n)
        begin, times = np.cumsum(size) - size, size[which]
        row = np.repeat(np.arange(len(ids)), times)
        at = np.repeat(begin[which], times) + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        other = self.ids[member[at]] != ids[row]
        row, at = row[other], at[other]
        keep = places(row, len(ids))[1] < k
        return row[keep], member[at[keep]], sim[at[keep]]


def _columns(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array(t["id"].to_pylist(), dtype=object)
    return ids, np.asarray(t["v"].combine_chunks().flatten(), dtype=np.float32).reshape(len(ids), -1)


_FOUND = "id string, other_id string, similarity double"


def _answers(shard: Shard, ids: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Table:
    a, b, s = found
    return pa.table({"id": pa.array(ids[a], pa.string()), "other_id": pa.array(shard.ids[b], pa.string()), "similarity": pa.array(s, pa.float64())})


def usable_vectors(records: DataFrame, dim: int) -> DataFrame:
    """(universe_id, kind, id, v) of the latest version of each id, where its vector is usable."""
    latest = (
        records.filter(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max(F.struct("created_at", "universe_id", "kind", F.col("vector").cast("array<float>").alias("v"))).alias("m"))
    )
    v = F.col("m.v")
    whole = v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    return latest.filter(F.coalesce(whole, F.lit(False))).select("m.universe_id", "m.kind", "id", "m.v")


def _centroids(key, t):
    """Spherical k-means on the sample of a group, five rounds."""
    x = unit(np.stack(t["v"].to_pylist())).astype(np.float32)
    c = x[: int(t["cells"][0].as_py())].copy()
    for _ in range(5):
        at = np.concatenate([(x[lo : lo + 4_096] @ c.T).argmax(axis=1) for lo in range(0, len(x), 4_096)])
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        some = np.abs(total).sum(axis=1) > 0
        c[some] = unit(total[some]).astype(np.float32)
    return pa.table({"g": [key[0].as_py()] * len(c), "c": pa.array(list(c), pa.list_(pa.float32()))})


def _by_group(batches, table: dict):
    """(batch, row numbers, unit vectors, entry of the group in ``table``) for each group in each batch."""
    for b in batches:
        groups = np.array(b.column("g").to_pylist(), dtype=object)
        x = np.asarray(b.column("v").flatten(), dtype=np.float32).reshape(b.num_rows, -1)
        for g in np.unique(groups):
            rows = np.flatnonzero(groups == g)
            if g in table:
                yield b, rows, unit(x[rows]).astype(np.float32), table[g]


def probed_share(joined: DataFrame, table: dict, k: int) -> float:
    """The share of a group's cells in which MET of the true k nearest of the sampled queries lie.

    ASKED queries of all large groups together (each row with the same chance) are compared
    with their whole groups; each task passes on k rows a query and batch.
    """
    spark = joined.sparkSession
    n = joined.count()
    chance = F.pmod(F.xxhash64("id", F.lit("asked")), F.lit(1 << 40)) / float(1 << 40)
    asked: dict = {}
    for r in joined.filter(chance < 4 * ASKED / n).orderBy(F.xxhash64("id", F.lit("asked"))).limit(ASKED).select("g", "id", "v").collect():
        asked.setdefault(r.g, []).append((r.id, np.array(r.v, dtype=np.float32)))
    order = {}
    for g, qs in asked.items():
        q = unit(np.stack([v for _, v in qs])).astype(np.float32)
        order[g] = (np.array([i for i, _ in qs], dtype=object), q, np.argsort(np.argsort(-(q @ table[g].T), axis=1), axis=1), table[g])
    sent = spark.sparkContext.broadcast(order)

    def compare(batches):
        for b, rows, x, (ids, q, rank, c) in _by_group(batches, sent.value):
            cell = (x @ c.T).argmax(axis=1)
            own = np.array(b.column("id").take(pa.array(rows)).to_pylist(), dtype=object)
            s = np.where(own[None, :] == ids[:, None], -np.inf, q @ x.T)
            at, val = top_columns(s, k)
            who = np.repeat(np.arange(len(ids)), at.shape[1])
            ok = np.isfinite(val.ravel())
            share = ((rank[who, cell[at.ravel()]] + 1) / len(c))[ok]
            yield pa.RecordBatch.from_arrays([pa.array(ids[who[ok]], pa.string()), pa.array(val.ravel()[ok].astype(np.float64)), pa.array(share)], names=["id", "s", "share"])

    near = joined.select("g", "id", "v").mapInArrow(compare, "id string, s double, share double")
    w = Window.partitionBy("id").orderBy(F.desc("s"), "share")
    got = near.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select(F.sort_array(F.collect_list("share")).alias("x")).first() if asked else None
    return float(got.x[min(len(got.x) - 1, int(MET * len(got.x)))]) if got and got.x else 1.0


def _large_groups(joined: DataFrame, shard: int, probes: int | None, k: int, least: float) -> DataFrame:
    """Neighbours in groups of several shards; ``joined`` has g, id, v, n and cells."""
    chance = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    fitted = joined.filter(chance < SAMPLE_PER_CELL * F.col("cells") / F.col("n")).select("g", "v", "cells").groupBy("g").applyInArrow(_centroids, "g string, c array<float>")
    # At most MAX_CENTROIDS rows.
    table: dict = {}
    for r in fitted.toLocalIterator():
        table.setdefault(r.g, []).append(r.c)
    table = {g: np.array(c, dtype=np.float32) for g, c in table.items()}
    share = None if probes else probed_share(joined, table, k)
    sent = joined.sparkSession.sparkContext.broadcast(table)

    def deal(batches):
        for b, rows, x, c in _by_group(batches, sent.value):
            m = min(len(c), probes or max(1, int(np.ceil(share * len(c)))))
            for lo in range(0, len(rows), 1_024):
                at, _ = top_columns(x[lo : lo + 1_024] @ c.T, m)
                take = pa.array(np.repeat(rows[lo : lo + 1_024], m))
                home = np.tile(np.arange(m) == 0, len(at))
                yield pa.RecordBatch.from_arrays([b.column("g").take(take), pa.array(at.ravel().astype(np.int64)), b.column("id").take(take), b.column("v").take(take), pa.array(home)], names=["g", "cell", "id", "v", "home"])

    dealt = cut(joined.select("g", "id", "v").mapInArrow(deal, "g string, cell long, id string, v array<float>, home boolean"))
    sizes = dealt.groupBy("g", "cell").agg(F.ceil(F.count_if("home") / shard).cast("int").alias("parts"), F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("blocks")).filter("parts > 0")
    sizes = cut(sizes)
    placed = dealt.join(sizes, ["g", "cell"])
    name = F.concat_ws("\u0001", "g", "cell", "part").alias("shard")
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
    homes = placed.filter("home").select("g", "cell", "id", "v", own).select(name, "id", "v")

    def build(key, t):
        ids, x = _columns(t)
        s = Shard(ids, x)
        blob = lambda y: pa.array([np.ascontiguousarray(y).tobytes()], pa.binary())
        return pa.table({"shard": [key[0].as_py()], "ids": pa.array([list(s.ids)], pa.list_(pa.string())), "x": blob(s.raw), "edges": blob(s.graph.edges), "entries": blob(s.graph.entries)})

    graphs = cut(homes.groupBy("shard").applyInArrow(build, "shard string, ids array<string>, x binary, edges binary, entries binary"))
    # Every shard is asked in blocks of VISITORS, so its visitors are spread over tasks, each with a copy of the graph.
    block = F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")).cast("int").alias("block")
    visits = placed.select("g", "cell", "id", "v", block, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(name, "block", "id", "v")
    copies = graphs.join(sizes.select("g", "cell", "blocks", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(name, "blocks"), "shard")
    copies = copies.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def visit(key, t, g):
        if not t.num_rows or not g.num_rows:
            return pa.table({"id": pa.array([], pa.string()), "other_id": pa.array([], pa.string()), "similarity": pa.array([], pa.float64())})
        nodes = np.array(g["ids"][0].as_py(), dtype=object)
        x, edges, entries = (np.frombuffer(g[c][0].as_py(), dtype=d) for c, d in (("x", np.float32), ("edges", np.int32), ("entries", np.int64)))
        s = Shard(nodes, x.reshape(len(nodes), -1), edges, entries)
        ids, own = _columns(t)
        return _answers(s, ids, s.visited(ids, own, k, least))

    return visits.groupBy("shard", "block").cogroup(copies.groupBy("shard", "block")).applyInArrow(visit, _FOUND)


def nearest_records(records: DataFrame, k: int = 5, least: float = -1.0, dim: int = 64, shard: int = SHARD, probes: int | None = None) -> DataFrame:
    """(``id``, ``other_id``, ``rank`` int, ``similarity`` double): the k nearest of every usable vector.

    Only records of the same universe_id and kind are compared, by cosine.  ``least`` is the
    lowest similarity of interest.  Equal similarities rank by id.  Without ``probes`` the cells
    looked in follow from the measured share (:func:`probed_share`).

    Defined cases: rows without id are ignored; of the rows of an id the latest counts (equal
    times: the greatest in (universe, kind, vector)), and if its vector is null, of another
    length, all zero or has a null, NaN or infinite number, the id takes no part; null
    universes and kinds form groups of their own; a group of one has no neighbours; an empty
    table gives no rows; other columns are ignored.
    """
    group = F.to_json(F.array(F.coalesce("universe_id", F.lit("")), F.col("universe_id").isNull().cast("string"), F.coalesce("kind", F.lit("")), F.col("kind").isNull().cast("string")))
    keyed = cut(usable_vectors(records, dim).select(group.alias("g"), "id", "v"))
    sizes = keyed.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    # Groups above a size are at most as many as the vectors divided by it.
    big = cut(sizes.filter(F.col("n") > shard).withColumn("cells", F.least(F.lit(MAX_CELLS), F.ceil(2 * F.col("n") / shard))))
    total = big.agg(F.sum("cells")).first()[0] or 0

    def whole(t: pa.Table) -> pa.Table:
        s = Shard(*_columns(t))
        return _answers(s, s.ids, s.nearest(k, least))

    if not total:
        found = keyed.groupBy("g").applyInArrow(whole, _FOUND)
    else:
        big = big.withColumn("cells", F.greatest(F.lit(2), F.ceil(F.col("cells") * min(1.0, MAX_CENTROIDS / total))).cast("int"))
        small = keyed.join(big.select("g"), "g", "left_anti").groupBy("g").applyInArrow(whole, _FOUND)
        found = small.unionByName(_large_groups(cut(keyed.join(big, "g")), shard, probes, k, least))
    # At most k rows for each shard in which a vector was looked for.
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("id", "other_id", "rank", "similarity")


def p4_found(spark, sf_dir):
    from loomgraph.session import table

    near = nearest_records(table(spark, sf_dir, "vector_records"), least=0.80)
    return near.select(F.least("id", "other_id").alias("id_a"), F.greatest("id", "other_id").alias("id_b")).distinct()


QUERIES = {"p4_found": p4_found}
ORACLES = {
    "p4_found": """
WITH latest AS (
  SELECT id, universe_id, kind, vector FROM vector_records WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, universe_id DESC, kind DESC, vector DESC) = 1
), v AS (
  SELECT id, universe_id, kind, vector::DOUBLE[] AS v FROM latest
  WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0
), s AS (
  SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS s
  FROM v a JOIN v b ON a.universe_id = b.universe_id AND a.kind = b.kind AND a.id <> b.id
), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM s WHERE s >= 0.80)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE r <= 5"""
}
