"""Approximate search by proximity graphs, one graph per shard of vectors.

Shards are hash groups of bounded size: each is built and searched by one task,
and the shards' answers merge like partial top-k lists. All work on a shard is done for
many points at once: neighbours come from products of matrices, points are pruned and
queries walk in step.

A search may be guided by a product quantizer: the walk looks distances up by the vectors'
codes and only the nodes that it expands are measured exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectide.functions import vectors as V
from vectide.operators import quantize
from vectide.types import GraphParams, Metric, chunk_offsets, ram_budget

SCHEMA = "shard int, vid long, eid string, embedding array<float>, nbrs array<long>"
SHARD_ROWS = 20_000
#: points pruned at once, queries walked at once, queries and deleted ids that may travel with the tasks
PRUNED, WALKED, MOST_QUERIES, MOST_DELETED = 128, 256, 100_000, 10_000_000


@dataclass
class Counters:
    """What a search took: distances measured, distances looked up, nodes expanded."""

    measured: int = 0
    looked_up: int = 0
    expanded: int = 0


@dataclass
class Lookup:
    """Product-quantizer codes of a shard's vectors and the centres of each chunk."""

    codes: np.ndarray
    pivots: list[np.ndarray]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """queries x chunks x centres: squared distances."""
        at = chunk_offsets(q.shape[1], len(self.pivots))
        most = max(map(len, self.pivots))
        out = np.full((len(q), len(self.pivots), most), np.inf, np.float32)
        for c, p in enumerate(self.pivots):
            out[:, c, : len(p)] = V.distances(q[:, at[c] : at[c + 1]], p, Metric.L2)
        return out


class Graph:
    """Neighbours (a row for each vector, filled up with -1), searched from the medoid."""

    def __init__(self, x: np.ndarray, metric: Metric, params: GraphParams, nbrs: np.ndarray | None = None):
        self.x = np.ascontiguousarray(V.unit(x) if metric is Metric.COSINE else x, np.float32)
        self.metric, self.params = metric, params
        self.slots = int(params.slack * params.degree)
        self.nbrs = np.full((len(x), self.slots), -1, np.int32) if nbrs is None else nbrs
        self.entry = int(V.distances(self.x, self.x.mean(0, keepdims=True), Metric.L2)[:, 0].argmin()) if len(x) else 0
        self.norm = np.einsum("ij,ij->i", self.x, self.x)

    # -- distances

    def to_rows(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Distance of each query to its own list of rows."""
        y = self.x[rows]
        if self.metric is Metric.L2:
            d = y - q[:, None]
            return np.einsum("brd,brd->br", d, d)
        if self.metric is Metric.COSINE:
            return 1 - np.einsum("brd,bd->br", y, q)
        if self.metric is Metric.L1:
            return np.abs(y - q[:, None]).sum(2)
        return np.bitwise_count(y.view(np.uint32) ^ np.ascontiguousarray(q, np.float32).view(np.uint32)[:, None]).sum(2).astype(np.float32)

    def within(self, rows: np.ndarray) -> np.ndarray:
        """Distances between all rows of each list."""
        if self.metric in (Metric.L2, Metric.COSINE):
            y = self.x[rows]
            dots = y @ y.transpose(0, 2, 1)
            if self.metric is Metric.COSINE:
                return 1 - dots
            n = self.norm[rows]
            return np.maximum(n[:, :, None] + n[:, None] - 2 * dots, 0)
        return np.stack([V.distances(self.x[r], self.x[r], self.metric) for r in rows]).astype(np.float32)

    # -- building

    def prune(self, points: np.ndarray, pool: np.ndarray) -> np.ndarray:
        """Up to ``degree`` neighbours of each point from its pool (-1 for none).

        The nearest candidates are taken first; one is left out while a neighbour chosen before is
        nearer to it by alpha than the point is. Alpha grows from 1 until there are enough.
        """
        degree = self.params.degree
        pool = np.sort(pool, axis=1)
        none = (pool < 0) | (pool == points[:, None])
        none[:, 1:] |= pool[:, 1:] == pool[:, :-1]
        rows = np.where(none, 0, pool)
        dist = np.where(none, np.inf, self.to_rows(self.x[points], rows))
        order = np.argsort(dist, axis=1, kind="stable")[:, : self.params.pool]
        rows, dist = np.take_along_axis(rows, order, 1), np.take_along_axis(dist, order, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where((between := self.within(rows)) > 0, dist[:, None] / between, np.inf)  # by how much j is nearer to i than to the point
        occluded = np.where(np.isinf(dist), np.inf, 0)
        out = np.full((len(points), degree), -1, np.int32)
        count = np.zeros(len(points), np.int64)
        alpha = 1.0
        while alpha <= self.params.alpha + 1e-9:
            for i in range(rows.shape[1]):
                took = np.flatnonzero((occluded[:, i] <= alpha) & (count < degree))
                if len(took):
                    out[took, count[took]] = rows[took, i]
                    count[took] += 1
                    occluded[took, i] = np.inf
                    occluded[took, i + 1 :] = np.maximum(occluded[took, i + 1 :], ratio[took, i, i + 1 :])
            alpha *= 1.2
        return out

    def _nearest(self, rows: np.ndarray, k: int) -> np.ndarray:
        if self.metric is Metric.L2:
            far = self.norm[None] - 2 * (self.x[rows] @ self.x.T)
        elif self.metric is Metric.COSINE:
            far = -(self.x[rows] @ self.x.T)
        else:
            far = V.distances(self.x[rows], self.x, self.metric)
        return np.argpartition(far, k - 1, axis=1)[:, :k] if k < len(self.x) else np.tile(np.arange(len(self.x)), (len(rows), 1))

    def build(self, seed: int = 3) -> Graph:
        """Each point's pool is its ``queue`` nearest and, for long edges, points drawn at random up to ``pool``.

        What pruning keeps is linked both ways; points with too many neighbours are pruned again.
        """
        n = len(self.x)
        if n < 2:
            return self
        rng = np.random.default_rng(seed)
        for at in range(0, n, PRUNED):
            rows = np.arange(at, min(n, at + PRUNED))
            drawn = rng.integers(0, n, (len(rows), max(1, self.params.pool - self.params.queue)))
            self.nbrs[rows, : self.params.degree] = self.prune(rows, np.concatenate([self._nearest(rows, self.params.queue + 1), drawn], 1))
        p, slot = np.nonzero(self.nbrs >= 0)
        q = self.nbrs[p, slot].astype(np.int64)
        edges = np.unique(np.concatenate([p * n + q, q * n + p]))
        self._set(edges // n, edges % n)
        return self

    def _set(self, p: np.ndarray, q: np.ndarray) -> None:
        """The neighbours q of the points p, sorted by point; more than there are slots for are pruned."""
        n = np.bincount(p, minlength=len(self.x))
        place = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
        fits = n[p] <= self.slots
        self.nbrs[np.unique(p)] = -1
        self.nbrs[p[fits], place[fits]] = q[fits]
        full = np.flatnonzero(n > self.slots)
        full = full[np.argsort(n[full], kind="stable")]  # pools of like sizes together
        first = np.cumsum(n) - n
        at = 0
        while at < len(full):
            part = full[at : at + max(1, min(PRUNED, (1 << 20) // max(1, int(n[full[min(at + PRUNED, len(full)) - 1]]) * self.x.shape[1] // 16)))]
            pool = np.full((len(part), int(n[part].max())), -1, np.int64)
            for i, point in enumerate(part.tolist()):
                pool[i, : n[point]] = q[first[point] : first[point] + n[point]]
            self.nbrs[part] = -1
            self.nbrs[part, : self.params.degree] = self.prune(part, pool)
            at += len(part)

    # -- searching

    def search(self, q: np.ndarray, queue: int, k: int, hidden: np.ndarray | None = None, lookup: Lookup | None = None, beam: int = 4, counters: Counters | None = None, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(queries x k rows, distances), -1 where fewer are found: a best-first walk from the entry and from the rows of ``start``.

        Each query expands the ``beam`` nearest nodes of its queue at a time, until it has expanded all of
        them. Hidden rows are walked through but not returned. With a ``lookup`` it guides the walk, and
        what was expanded is measured.
        """
        found = [self._walk(q[at : at + WALKED], queue, k, hidden, lookup, beam, counters or Counters(), None if start is None else start[at : at + WALKED]) for at in range(0, len(q), WALKED)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def settled(self, q: np.ndarray, queue: int, k: int, hidden: np.ndarray | None = None, lookup: Lookup | None = None, beam: int = 4, counters: Counters | None = None) -> tuple[np.ndarray, np.ndarray]:
        """What ``search`` finds, walked again with twice the queue for the queries whose answer that changes, until none does.

        What a walk by codes has found is walked on from, by exact distances, first with a queue of 2 * k.
        """
        rows, dist = self.search(q, queue, k, hidden, lookup, beam, counters)
        open_, width = np.arange(len(q)), k if lookup else queue
        while len(open_) and width < len(self.x):
            width *= 2
            again, far = self.search(q[open_], width, k, hidden, None, beam, counters, rows[open_] if lookup else None)
            changed = (again != rows[open_]).any(1)
            rows[open_], dist[open_] = again, far
            open_ = open_[changed]
        return rows, dist

    def _walk(self, q: np.ndarray, queue: int, k: int, hidden: np.ndarray | None, lookup: Lookup | None, beam: int, counters: Counters, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        q = np.ascontiguousarray(q, np.float32)
        tables = lookup.tables(q) if lookup else None

        def far(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
            if tables is None:
                return self.to_rows(q[at], rows)
            codes = lookup.codes[rows]
            return tables[at[:, None, None], np.arange(codes.shape[2])[None, None], codes].sum(2)

        n = len(q)
        every = np.arange(n)
        rows, dist, done = np.full((n, queue), -1), np.full((n, queue), np.inf, np.float32), np.ones((n, queue), bool)
        seen = np.zeros((n, len(self.x)), bool)
        for i, first in enumerate([np.full(n, self.entry), *([] if start is None else start[:, : queue - 1].T)]):
            new = np.flatnonzero((first >= 0) & ~seen[every, first])
            rows[new, i], done[new, i], seen[new, first[new]] = first[new], False, True
            dist[new, i] = far(new, first[new, None])[:, 0]
        visited: list[tuple[np.ndarray, np.ndarray]] = []
        while not done.all():
            at = np.flatnonzero(~done.all(1))
            open_ = ~done[at]
            pick = open_ & (np.cumsum(open_, 1) <= beam)
            who, where = np.nonzero(pick)
            done[at[who], where] = True
            visited.append((at[who], rows[at[who], where]))
            counters.expanded += len(who)
            near = np.full((len(at), beam * self.nbrs.shape[1]), -1, np.int64)
            turn = np.cumsum(pick, 1)[who, where] - 1
            near.reshape(len(at), beam, -1)[who, turn] = self.nbrs[rows[at[who], where]]
            near = np.sort(near, axis=1)
            ok = near >= 0
            ok[:, 1:] &= near[:, 1:] != near[:, :-1]
            ok &= ~seen[at[:, None], np.maximum(near, 0)]
            width = int(ok.sum(1).max(initial=0))
            if not width:
                continue
            front = np.argsort(~ok, axis=1, kind="stable")[:, :width]
            near, ok = np.take_along_axis(near, front, 1), np.take_along_axis(ok, front, 1)
            seen[np.repeat(at, width)[ok.reshape(-1)], near[ok]] = True
            d = np.where(ok, far(at, np.maximum(near, 0)), np.inf)
            counters.looked_up += int(ok.sum()) * (lookup is not None)
            counters.measured += int(ok.sum()) * (lookup is None)
            both = np.concatenate([dist[at], d], 1)
            order = np.argsort(both, axis=1, kind="stable")[:, :queue]
            dist[at] = np.take_along_axis(both, order, 1)
            rows[at] = np.take_along_axis(np.concatenate([rows[at], np.where(ok, near, -1)], 1), order, 1)
            done[at] = np.take_along_axis(np.concatenate([done[at], ~ok], 1), order, 1)
        if lookup is not None:
            who, what = (np.concatenate(v) for v in zip(*visited, strict=True))
            order = np.argsort(who, kind="stable")
            count = np.bincount(who, minlength=n)
            place = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
            rows = np.full((n, int(count.max())), -1)
            rows[who[order], place] = what[order]
            dist = np.where(rows >= 0, self.to_rows(q, np.maximum(rows, 0)), np.inf)
            counters.measured += len(who)
        out = (rows < 0) | (hidden[np.maximum(rows, 0)] if hidden is not None else False)
        dist = np.where(out, np.inf, dist)
        order = np.lexsort((rows, dist), axis=1)[:, :k]
        rows, dist = np.take_along_axis(np.where(out, -1, rows), order, 1), np.take_along_axis(dist, order, 1)
        if rows.shape[1] < k:
            more = ((0, 0), (0, k - rows.shape[1]))
            rows, dist = np.pad(rows, more, constant_values=-1), np.pad(dist, more, constant_values=np.inf)
        return rows, dist

    # -- deletion

    def consolidate(self, deleted: np.ndarray) -> None:
        """Nodes with an edge to a deleted one drop it and take over its neighbours, pruned."""
        here = self.nbrs >= 0
        hit = np.flatnonzero((here & deleted[np.maximum(self.nbrs, 0)]).any(1) & ~deleted)
        sets = {}
        for p in hit.tolist():
            own = self.nbrs[p][here[p]]
            more = self.nbrs[own[deleted[own]]].reshape(-1)
            pool = np.unique(np.concatenate([own, more[more >= 0]]))
            sets[p] = pool[~deleted[pool] & (pool != p)]
        if sets:
            self.nbrs[hit] = -1
            self._set(np.repeat(hit, [len(sets[p]) for p in hit.tolist()]), np.concatenate([sets[p] for p in hit.tolist()]))
        self.nbrs[deleted] = -1
        alive = np.flatnonzero(~deleted)
        if len(alive) and deleted[self.entry]:
            self.entry = int(alive[V.distances(self.x[alive], self.x[alive].mean(0, keepdims=True), Metric.L2)[:, 0].argmin()])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(column), -1)


def _table(shard: int, eids: pa.ChunkedArray, x: np.ndarray, graph: Graph) -> pa.Table:
    n = len(eids)
    full = graph.nbrs >= 0
    offsets = np.append(0, np.cumsum(full.sum(1))).astype(np.int32)
    nbrs = pa.ListArray.from_arrays(pa.array(offsets), pa.array(graph.nbrs[full].astype(np.int64)))
    flat = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1), pa.float32()), x.shape[1]).cast(pa.list_(pa.float32())) if n else pa.array([], pa.list_(pa.float32()))
    return pa.table([pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(n)), eids.cast(pa.string()), flat, nbrs], names=["shard", "vid", "eid", "embedding", "nbrs"])


def build(vectors: DataFrame, metric: Metric = Metric.L2, params: GraphParams | None = None, shards: int | None = None) -> DataFrame:
    """Rows of SCHEMA from (eid, embedding). Rows without a vector are left out."""
    params = params or GraphParams()
    vectors = vectors.where("embedding IS NOT NULL")
    shards = shards or max(1, -(-vectors.count() // SHARD_ROWS))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("eid")
        x = _matrix(table["embedding"])
        return _table(key[0].as_py(), table["eid"], x, Graph(x, metric, params).build())

    eid = F.col("eid").cast("string")
    return vectors.select(F.pmod(F.xxhash64(eid), F.lit(shards)).cast("int").alias("shard"), eid.alias("eid"), "embedding").groupBy("shard").applyInArrow(run, SCHEMA)


def _load(table: pa.Table, metric: Metric, params: GraphParams) -> tuple[Graph, pa.ChunkedArray]:
    """The graph of a shard's rows, sorted by vid."""
    vids = table["vid"].to_numpy()
    column = table["nbrs"].combine_chunks()
    owner = np.repeat(np.arange(len(vids)), np.diff(column.offsets.to_numpy()))
    there = column.flatten().to_numpy()
    at = np.minimum(np.searchsorted(vids, there), max(0, len(vids) - 1))
    known = vids[at] == there if len(vids) else np.zeros(0, bool)
    owner, at = owner[known], at[known]
    n = np.bincount(owner, minlength=len(vids))
    nbrs = np.full((len(vids), max(int(params.slack * params.degree), int(n.max(initial=0)))), -1, np.int32)
    nbrs[owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)] = at
    return Graph(_matrix(table["embedding"]), metric, params, nbrs), table["eid"]


def _few(rows: DataFrame, most: int, what: str) -> list:
    """Rows that travel with the tasks; more than so many are an error."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} {what}: search them in parts")
    return found


def search(graph: DataFrame, queries: DataFrame, k: int, metric: Metric = Metric.L2, params: GraphParams | None = None, deleted: DataFrame | None = None, digits: int = 6, codebook: DataFrame | None = None, beam: int = 4) -> DataFrame:
    """qid, eid, distance, rank from every shard's graph; deleted ids are passed through but not returned.

    At most MOST_QUERIES queries, and at most MOST_DELETED deletions, those since the last
    consolidation, travel with the tasks. With a product quantizer's ``codebook`` (chunk, center,
    pivot) the walk is guided by codes (see ``Graph.search``).
    """
    params = params or GraphParams()
    spark = graph.sparkSession
    rows = _few(queries.where("embedding IS NOT NULL").orderBy("qid"), MOST_QUERIES, "queries")
    kind = dict(queries.dtypes)["qid"]
    q = np.array([r["embedding"] for r in rows], np.float32).reshape(len(rows), -1)
    gone = pa.array([r[0] for r in _few(deleted.select(F.col("eid").cast("string")).distinct(), MOST_DELETED, "deleted ids")] if deleted is not None else [], pa.string())
    pivots: dict[int, list] = {}
    for r in codebook.orderBy("chunk", "center").collect() if codebook is not None else ():
        pivots.setdefault(r["chunk"], []).append(r["pivot"])
    sent = spark.sparkContext.broadcast((np.array([r["qid"] for r in rows], object), V.unit(q).astype(np.float32) if metric is Metric.COSINE and len(q) else q, gone, [np.array(pivots[c], np.float32) for c in sorted(pivots)]))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        qids, q, gone, pivots = sent.value
        names = ["qid", "eid", "distance"]
        own = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
        table = table.sort_by("vid")
        if not len(q) or not table.num_rows:
            return pa.table([pa.array([], own), pa.array([], pa.string()), pa.array([], pa.float64())], names=names)
        g, eids = _load(table, metric, params)
        hidden = pc.is_in(eids, value_set=gone).to_numpy()
        lookup = None
        if pivots:
            at = chunk_offsets(g.x.shape[1], len(pivots))
            lookup = Lookup(np.stack([V.distances(g.x[:, at[c] : at[c + 1]], p, Metric.L2).argmin(1) for c, p in enumerate(pivots)], 1), pivots)
        found, dist = g.settled(q, max(params.queue, k), k, hidden, lookup, beam)
        who, place = np.nonzero(found >= 0)
        at = found[who, place]
        exact = V.exact(g.x[at], q[who], metric)
        return pa.table([pa.array(qids[who].tolist(), own), eids.take(pa.array(at)).cast(pa.string()), pa.array(np.round(exact, digits))], names=names)

    found = graph.groupBy("shard").applyInArrow(run, f"qid {kind}, eid string, distance double")
    order = Window.partitionBy("qid").orderBy("distance", "eid")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def consolidate(graph: DataFrame, deleted: DataFrame, metric: Metric = Metric.L2, params: GraphParams | None = None) -> DataFrame:
    """The graph without the deleted ids (eid), repaired."""
    params = params or GraphParams()
    marked = graph.join(deleted.select(F.col("eid").cast("string").alias("eid"), F.lit(True).alias("gone")).distinct(), "eid", "left")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("vid")
        g, eids = _load(table, metric, params)
        dead = np.array([bool(x) for x in table["gone"].to_pylist()])
        g.consolidate(dead)
        return _table(key[0].as_py(), eids, _matrix(table["embedding"]), g).filter(pa.array(~dead))

    return marked.select("shard", "vid", "eid", "embedding", "nbrs", "gone").groupBy("shard").applyInArrow(run, SCHEMA)


def write(graph: DataFrame, path: str) -> None:
    """A graph's rows on disk: a folder for each shard, sorted by vid in it, so that one shard's reading touches its files alone."""
    shards = graph.select("shard").distinct().count()
    graph.repartition(max(1, shards), "shard").sortWithinPartitions("shard", "vid").write.partitionBy("shard").parquet(path)


def read(graph_path: str, spark: SparkSession) -> DataFrame:
    """What ``write`` has written."""
    return spark.read.schema(SCHEMA).parquet(graph_path).select("shard", "vid", "eid", "embedding", "nbrs")


def code_chunks(n: int, dim: int, gigabytes: float) -> int:
    """Chunks of a quantizer whose codes, a byte each, keep n vectors within so much memory: at least one, 512 at most."""
    return int(max(1, min(ram_budget(gigabytes) // max(1, n), dim, 512)))


def build_on_disk(vectors: DataFrame, path: str, metric: Metric = Metric.L2, params: GraphParams | None = None, gigabytes: float = 1.0, shards: int | None = None) -> None:
    """An index under a folder: the graph by shards, and a product quantizer's codebook that guides its searches."""
    vectors = vectors.where("embedding IS NOT NULL").select("eid", "embedding")
    n, dim = vectors.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    write(build(vectors, metric, params, shards), f"{path}/graph")
    numbered = vectors.select(F.xxhash64("eid").alias("eid"), "embedding")
    quantize.train_product(numbered, dim, code_chunks(n, dim, gigabytes)).write.parquet(f"{path}/pivots")


def search_on_disk(spark: SparkSession, path: str, queries: DataFrame, k: int, metric: Metric = Metric.L2, params: GraphParams | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """What ``search`` finds in an index of ``build_on_disk``, guided by its codebook."""
    return search(read(f"{path}/graph", spark), queries, k, metric, params, deleted, codebook=spark.read.parquet(f"{path}/pivots"))


# ---- relational views of adjacency


def degree_stats(adjacency: DataFrame) -> DataFrame:
    """most, mean and least out-degree, and nodes with fewer than two, of (vid, nbrs)."""
    d = F.size("nbrs")
    return adjacency.agg(F.max(d).cast("long").alias("most"), F.avg(d).alias("mean"), F.min(d).cast("long").alias("least"), F.count_if(d < 2).alias("thin"))


def to_repair(adjacency: DataFrame, deleted: DataFrame) -> DataFrame:
    """Live nodes with an edge to a deleted one."""
    edges = adjacency.select("vid", F.explode("nbrs").alias("nbr"))
    hit = edges.join(deleted.select(F.col("vid").alias("nbr")), "nbr", "left_semi").select("vid").distinct()
    return hit.join(deleted, "vid", "left_anti")


def pruned_edges(adjacency: DataFrame, deleted: DataFrame) -> DataFrame:
    """(vid, nbr) of live nodes without deleted neighbours and themselves."""
    edges = adjacency.select("vid", F.explode("nbrs").alias("nbr")).where("vid <> nbr")
    return edges.join(deleted, "vid", "left_anti").join(deleted.select(F.col("vid").alias("nbr")), "nbr", "left_anti").select("vid", "nbr").distinct()


def hot_nodes(visits: DataFrame, n: int) -> DataFrame:
    """The n most visited nodes of (vid) rows."""
    return visits.groupBy("vid").agg(F.count(F.lit(1)).alias("visits")).orderBy(F.desc("visits"), "vid").limit(n)


def entry_point(vectors: DataFrame, digits: int = 6) -> DataFrame:
    """The vector nearest to the mean: eid, distance."""
    means = vectors.select(F.posexplode("embedding").alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = means.agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("mean"))
    d = F.round(V.l2(F.col("embedding"), F.col("mean")), digits)
    return vectors.crossJoin(F.broadcast(mean)).select("eid", d.alias("distance")).orderBy("distance", "eid").limit(1)

