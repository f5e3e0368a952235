"""Nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on at most `sample_rows` vectors (in the order of a hash; a documented bound): each
node splits in `branch` clusters until a leaf stands for few sample rows. Then every vector goes to its
leaf. A query walks the tree through a priority queue of branches, nearest centre first, and so lists
leaves in the order in which they should be visited. The number of visits is calibrated: for
`calibrate` queries, brute force over all vectors gives the truth, and visits widen until the recall
reaches `recall`; if no smaller number does, all leaves are visited. A query whose leaves
hold fewer than k rows besides itself goes on to further leaves until they hold k.

A leaf is searched in blocks of at most `block_rows` vectors, so a leaf that holds a third of all rows
(one frequent vector, say) is many tasks; each block gives each query at most k candidates, ordered by
(distance, id), so ties and repeated vectors are exact. Distances are sums of squared differences in
double precision on the original values.

Defined results: vectors that are null, zero or hold null or non-finite components take no part; neither
do rows of null id. Distances are between vectors of one length: each length that occurs is searched with a
tree of its own, so a query's candidates are the vectors as long as itself. A query has all candidates if
fewer than k. An empty table gives an empty result; ids are expected once, of repeated rows each is a
candidate but never the query's own id. Only the id and the vector column are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, written


@dataclass(frozen=True)
class Search:
    k: int = 10
    branch: int = 8
    leaf_rows: int = 64
    sample_rows: int = 20_000
    calibrate: int = 40
    recall: float = 0.98
    block_rows: int = 4096
    seed: int = 11


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centres by Lloyd's rounds from a k-means++ start."""
    centres = [x[rng.integers(len(x))]]
    d = ((x - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k and d.sum() > 0:
        centres.append(x[rng.choice(len(x), p=d / d.sum())])
        d = np.minimum(d, ((x - centres[-1]) ** 2).sum(axis=1))
    c = np.array(centres)
    for _ in range(rounds):
        own = nearest(x, c)
        new = np.array([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        if np.allclose(new, c):
            break
        c = new
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)


class Tree:
    """Nodes hold the centres of their children; a child below 0 is leaf number -1 - child."""

    def __init__(self, x: np.ndarray, p: Search):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        if len(x):
            self._grow(x, p, np.random.default_rng(p.seed))
        else:
            self.leaves = 1

    def _grow(self, x: np.ndarray, p: Search, rng: np.random.Generator) -> int:
        c = kmeans(x, p.branch, rng) if len(x) > p.leaf_rows else x[:1]
        if len(c) < 2:
            self.leaves += 1
            return -self.leaves
        at = len(self.centres)
        self.centres.append(c)
        self.children.append([])
        own = nearest(x, c)
        for i in range(len(c)):
            self.children[at].append(self._grow(x[own == i], p, rng))
        return at

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))] if self.centres else []
        while todo:
            node, rows = todo.pop()
            own = nearest(x[rows], self.centres[node])
            for i, child in enumerate(self.children[node]):
                part = rows[own == i]
                if len(part) and child < 0:
                    out[part] = -1 - child
                elif len(part):
                    todo.append((child, part))
        return out

    def best_bins(self, q: np.ndarray, most: int, held: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """Leaves in best-bin-first order: descend to the nearest child, queue its siblings.

        `most` leaves, and more until they hold `least` rows (`held`: rows of each leaf).
        """
        if not self.centres:
            return [0]
        queue, out, n, rows = [(0.0, 0, 0)], [], 1, 0
        while queue and (len(out) < most or rows < least):
            _, _, node = heapq.heappop(queue)
            while node >= 0:
                d = ((self.centres[node] - q) ** 2).sum(axis=1)
                near = int(d.argmin())
                for i, child in enumerate(self.children[node]):
                    if i != near:
                        heapq.heappush(queue, (float(d[i]), n, child))
                        n += 1
                node = self.children[node][near]
            out.append(-1 - node)
            rows += (held or {}).get(-1 - node, 0)
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(vec_id, v): finite, not zero."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))


def lengths(rows: DataFrame, is_query, most: int = 100) -> list[int]:
    """Lengths of the queries' vectors, ascending; a table whose queries have more than `most` different ones is refused."""
    found = [r[0] for r in rows.where(is_query).select(F.size("v")).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"queries of more than {most} different lengths")
    return sorted(found)


def _assign(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(tree.leaf_of(_matrix(batch.column("v"))), pa.int64())], names=["vec_id", "v", "leaf"])


def sampled(rows: DataFrame, n: int) -> np.ndarray:
    """The first `n` vectors in the order of their ids' hashes. Hash ranges are counted first, so that only the ranges that hold
    them are sorted, on an executor; the driver gets `n` rows, however many parts the table has."""
    rows = rows.select(F.xxhash64("vec_id").alias("h"), "vec_id", "v")
    part = F.shiftright("h", 48)
    counts = rows.groupBy(part.alias("part")).count().toArrow().sort_by("part")  # at most 2 ** 16
    if not counts.num_rows:
        return np.zeros((0, 1))
    last = min(int(np.searchsorted(np.cumsum(counts.column("count").to_numpy()), n)), counts.num_rows - 1)
    first = written(rows.where(part <= counts.column("part")[last].as_py()).orderBy("h", "vec_id").limit(n), "knn-sample")
    got = first.toArrow().sort_by([("h", "ascending"), ("vec_id", "ascending")])
    drop_written(first)
    return _matrix(got.column("v").combine_chunks())


def _visits(batches: Iterator[pa.RecordBatch], tree: Tree, most: int, held: dict[int, int], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bins = [tree.best_bins(q, most, held, least) for q in _matrix(batch.column("v"))]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(bins, pa.list_(pa.int64()))], names=["query_id", "q", "bins"])


def top_of_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k nearest of the block by (distance, id), without its own id."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(q)):
        d = np.sqrt(((x - q[i]) ** 2).sum(axis=1))
        ok = np.flatnonzero(ids != query_ids[i])
        if len(ok) > k:
            edge = np.partition(d[ok], k - 1)[k - 1]
            ok = ok[d[ok] <= edge]
        ok = ok[np.lexsort((ids[ok], d[ok]))][:k]
        out.append((np.full(len(ok), query_ids[i]), ids[ok], d[ok]))
    return tuple(np.concatenate(c) if c else np.zeros(0) for c in zip(*out, strict=True)) if out else (np.zeros(0), np.zeros(0), np.zeros(0))


_FOUND = "query_id long, vec_id long, score double"


def _search(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """A block's vectors (left) against the queries that visit it (right)."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    a, b, d = top_of_block(left.column("vec_id").to_numpy(), _matrix(left.column("v").combine_chunks()), right.column("query_id").to_numpy(), _matrix(right.column("q").combine_chunks()), k)
    return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(d, pa.float64())}, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _truth(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, d = top_of_block(batch.column("vec_id").to_numpy(), _matrix(batch.column("v")), ids, q, k)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.float64())], names=["query_id", "vec_id", "score"])


def _true_leaves(rows: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> list:
    """(query_id, leaf) of the true neighbours of a few queries: k rows a query are broadcast, never the table's leaves."""
    truth = _ranked(rows.select("vec_id", "v").mapInArrow(lambda it: _truth(it, ids, q, k), _FOUND), k)
    return rows.select("vec_id", "leaf").distinct().join(F.broadcast(truth), "vec_id").select("query_id", "leaf").collect()


def calibrated(rows: DataFrame, queries: DataFrame, tree: Tree, p: Search) -> tuple[int, float]:
    """Leaf visits that reach `recall` on sample queries against brute force, and the recall there."""
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(p.calibrate).collect()
    if not some:
        return 1, 1.0
    ids, q = np.array([r["vec_id"] for r in some]), np.array([r["v"] for r in some])
    truth = _true_leaves(rows, ids, q, p.k)
    place = {i: {leaf: n for n, leaf in enumerate(tree.best_bins(x, tree.leaves))} for i, x in zip(ids.tolist(), q, strict=True)}
    visits = sorted(place[r["query_id"]].get(r["leaf"], tree.leaves) + 1 for r in truth)
    need = visits[min(len(visits), max(1, int(np.ceil(p.recall * len(visits))))) - 1] if visits else 1
    return need, sum(v <= need for v in visits) / max(1, len(visits))


def nearest_neighbours(vectors: DataFrame, is_query, id_column: str = "vec_id", vector: str = "embedding", p: Search = Search()) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest; `is_query`: a condition on `vec_id`."""
    rows = usable(vectors, id_column, vector)
    found = [_neighbours(rows.where(F.size("v") == n), is_query, p) for n in lengths(rows, is_query)]
    return reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _neighbours(rows: DataFrame, is_query, p: Search) -> DataFrame:
    """Neighbours among vectors of one length."""
    tree = Tree(sampled(rows, p.sample_rows), p)
    placed = written(rows.mapInArrow(lambda it: _assign(it, tree), "vec_id long, v array<double>, leaf long"), "knn-leaves")
    queries = placed.where(is_query).select("vec_id", "v")
    most, _ = calibrated(placed, queries, tree, p)
    # leaves in blocks of bounded size: counts by leaf, then a hash deals a leaf's rows
    sizes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).select("leaf", "n", F.ceil(F.col("n") / F.lit(p.block_rows)).alias("blocks"))
    held = {r["leaf"]: r["n"] for r in sizes.select("leaf", "n").collect()}  # no more leaves than sample rows
    visits = queries.mapInArrow(lambda it: _visits(it, tree, most, held, p.k + 1), "query_id long, q array<double>, bins array<long>").select("query_id", "q", F.explode("bins").alias("leaf"))
    visits = written(visits, "knn-visits")
    # queries that visit a leaf are dealt likewise, so neither side of a group grows with the table
    sizes = sizes.drop("n").join(visits.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(p.block_rows)).alias("turns")), "leaf")
    # the side to broadcast is named: visits repeat a query's vector, so their files look far smaller than their rows are
    sizes = F.broadcast(sizes)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    blocks = placed.join(sizes, "leaf").select("leaf", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).alias("block"), each("turns").alias("turn"), "vec_id", "v")
    visits = visits.join(sizes, "leaf").select("leaf", each("blocks").alias("block"), F.pmod(F.xxhash64("query_id", F.lit(1)), F.col("turns")).alias("turn"), "query_id", "q")
    keys = ["leaf", "block", "turn"]
    found = blocks.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(lambda a, b: _search(a, b, p.k), _FOUND)
    return _ranked(found, p.k).withColumn("rank", F.col("rank").cast("int"))


@dataclass(frozen=True)
class Report:
    """How a search does on queries that didn't set its visits."""

    queries: int
    recall: float
    leaves: int
    visits: int
    rows_read: float


def recall_report(vectors: DataFrame, is_query, id_column: str = "vec_id", vector: str = "embedding", p: Search = Search(), most_queries: int = 40) -> Report:
    """Recall against brute force, and the share of all rows that a query reads, over up to `most_queries` queries beyond the calibrating ones."""
    rows = usable(vectors, id_column, vector)
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()  # the most frequent length
    rows = rows.where(F.size("v") == (width["n"] if width else 0))
    tree = Tree(sampled(rows, p.sample_rows), p)
    placed = written(rows.mapInArrow(lambda it: _assign(it, tree), "vec_id long, v array<double>, leaf long"), "knn-leaves")
    queries = placed.where(is_query).select("vec_id", "v")
    most, _ = calibrated(placed, queries, tree, p)
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(p.calibrate + most_queries).collect()[p.calibrate :]
    held = {r[0]: r[1] for r in placed.groupBy("leaf").count().collect()}
    total = sum(held.values())
    if not some:
        return Report(0, 1.0, tree.leaves, most, 0.0)
    ids, q = np.array([r["vec_id"] for r in some]), np.array([r["v"] for r in some])
    bins = {i: set(tree.best_bins(x, most, held, p.k + 1)) for i, x in zip(ids.tolist(), q, strict=True)}
    truth = _true_leaves(placed, ids, q, p.k)
    drop_written(placed)
    hit = sum(r["leaf"] in bins[r["query_id"]] for r in truth)
    return Report(len(some), hit / max(1, len(truth)), tree.leaves, most, float(np.mean([sum(held.get(b, 0) for b in x) for x in bins.values()])) / max(1, total))
