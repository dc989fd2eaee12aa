"""Nearest neighbours by largest inner product: a vantage-point tree for each shard.

Largest inner product becomes least distance: all vectors are divided by the length of the longest, each
gets one more component that brings it to length one, and queries are brought to length one with a zero
there, so the scale of vectors and queries plays no part. A shard's tree splits its points by the median
distance to a vantage point. The triangle inequality gives a least distance of a query to what is in a
branch; the branch is left out if that, times ``FACTOR``, is more than the distance of the last nearest so
far. With factor one only branches that can't hold a result are left out, so the search is exact; larger
factors leave out more. Queries go through a tree together, first to their own leaf, then from the top.
A tree holds equal vectors once. It keeps ``SPARE`` more than asked for, and what it keeps is ordered by
inner products of the original vectors, summed in the order of components in double precision.

Every vector is in the index of one shard, every query visits every shard, and a query's best of all
shards are merged. A shard holds ``SHARD`` vectors at most, which bounds a task, and fewer only as long as
there are fewer shards than shuffle partitions. Queries travel as packed blocks of one vector length; a
shard's queries are split into parts, so no task holds more than a shard and a batch of queries.

Defined cases: vectors that are null, zero or hold null or non-finite components and rows without vec_id
neither ask nor are found; vectors of another length than the query's aren't found; with fewer candidates
than k all are returned; ties go to the smaller vec_id; a row that stands twice is one vector; of several
vectors under one vec_id the least by its components counts, in index and queries; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shuffle_partitions, small_batches, table
from .vectors import squared, stacked, usable

K = 20
EVERY = 20
#: How much a branch's least distance is stretched before it is compared; 1 is exact.
FACTOR = 1.25
#: Vectors of a shard at most, and from how many on it is split while there are idle partitions.
SHARD, LEAST = 1 << 16, 1 << 13
LEAF = 128
#: Neighbours kept beyond those asked for, so that rounding within a tree can't displace one.
SPARE = 12
#: Queries that go through a tree together, and queries of a part.
BATCH, PART = 512, 1 << 16


class Tree:
    """A vantage-point tree over the distinct rows of ``points`` with ids; built from the top, nodes in lists."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, longest: float, seed: int = 5) -> None:
        order = np.argsort(ids, kind="stable")
        ids, points = ids[order], points[order]
        # Equal vectors are one point, in the order of their smallest ids.
        _, first, at = np.unique(np.ascontiguousarray(points).view(f"V{points.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
        rank = np.empty(len(first), dtype=np.int64)
        rank[np.argsort(first)] = np.arange(len(first))
        at = rank[at]
        self.points = points[np.sort(first)]
        by = np.argsort(at, kind="stable")
        self.ids, self.edges = ids[by], np.r_[np.flatnonzero(np.r_[True, at[by][1:] != at[by][:-1]]), len(ids)]
        self.unit = self.points / np.sqrt(longest)
        self.lifted = np.c_[self.unit, np.sqrt(np.maximum(1 - (self.unit**2).sum(axis=1), 0))]
        rng = np.random.default_rng(seed)
        self.nodes: list[tuple] = []  # (vantage, radius, inner, outer) or (members,)
        self.root = self._grow(np.arange(len(self.points)), rng)

    def answers(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best ``k`` of each query but itself, as (position of the query, id, score)."""
        # The query itself may take one of the places, rounding some.
        found = self.search(queries / np.sqrt((queries**2).sum(axis=1, keepdims=True)), k + 1 + SPARE, factor)
        q, j = np.nonzero(found >= 0)
        point = found[q, j]
        score = exact_scores(queries[q], self.points[point])
        n = np.minimum(np.diff(self.edges)[point], k + 1)  # of equal vectors the smallest ids
        q, score = np.repeat(q, n), np.repeat(score, n)
        vec = self.ids[np.repeat(self.edges[point], n) + np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)]
        other = vec != ids[q]
        q, vec, score = q[other], vec[other], score[other]
        order = np.lexsort((vec, -score, q))
        q, vec, score = q[order], vec[order], score[order]
        start = np.searchsorted(q, q)
        top = np.arange(len(q)) - start < k
        return q[top], vec[top], score[top]

    def _grow(self, members: np.ndarray, rng: np.random.Generator) -> int:
        if len(members) <= LEAF:
            self.nodes.append((members,))
            return len(self.nodes) - 1
        point = self.lifted[members[rng.integers(len(members))]]
        away = np.sqrt(((self.lifted[members] - point) ** 2).sum(axis=1))
        radius = float(np.median(away))
        inner = away <= radius
        if inner.all():  # equal points can't be parted
            self.nodes.append((members,))
            return len(self.nodes) - 1
        at = len(self.nodes)
        self.nodes.append(())
        self.nodes[at] = (point, radius, self._grow(members[inner], rng), self._grow(members[~inner], rng))
        return at

    def search(self, queries: np.ndarray, k: int, factor: float) -> np.ndarray:
        """Points (-1: none) nearest to each query of length one, nearest first."""
        self.q = queries
        self.lift = np.c_[queries, np.zeros(len(queries))]
        self.best = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), -1, dtype=np.int64)
        home = self._home(np.arange(len(queries)))
        for leaf in np.unique(home):
            self._visit(int(leaf), np.flatnonzero(home == leaf))
        stack = [(self.root, np.arange(len(queries)))]
        while stack:
            at, own = stack.pop()
            node = self.nodes[at]
            if len(node) == 1:
                self._visit(at, own[home[own] != at])
                continue
            away = self._away(own, node[0]) - node[1]
            reach = self._reach(own)
            # The branch that a query is in comes last onto the stack, so it is gone through first.
            stack.append((node[2], own[(away > 0) & (factor * away <= reach)]))
            stack.append((node[3], own[(away <= 0) & (factor * -away <= reach)]))
            stack.append((node[3], own[away > 0]))
            stack.append((node[2], own[away <= 0]))
            stack = [x for x in stack if len(x[1])]
        return self.found

    def _away(self, own: np.ndarray, point: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(((self.lift[own] - point) ** 2).sum(axis=1), 0))

    def _reach(self, own: np.ndarray) -> np.ndarray:
        """Distance of the k-th nearest so far, with room for rounding; endless while there are fewer."""
        d = 2 - 2 * self.best[own, -1]
        return np.where(np.isfinite(d), np.sqrt(np.maximum(d, 0)) + 1e-7, np.inf)  # all are of length one

    def _home(self, own: np.ndarray) -> np.ndarray:
        out, stack = np.zeros(len(own), dtype=np.int64), [(self.root, own)]
        while stack:
            at, some = stack.pop()
            node = self.nodes[at]
            if len(node) == 1:
                out[some] = at
                continue
            inner = self._away(some, node[0]) <= node[1]
            stack += [x for x in ((node[2], some[inner]), (node[3], some[~inner])) if len(x[1])]
        return out

    def _visit(self, leaf: int, own: np.ndarray) -> None:
        members = self.nodes[leaf][0]
        for k in range(0, len(members), 4 * LEAF):  # a leaf of equal points may be large
            if len(own):
                self._merge(members[k : k + 4 * LEAF], own)

    def _merge(self, members: np.ndarray, own: np.ndarray) -> None:
        score = self.q[own] @ self.unit[members].T
        k = self.best.shape[1]
        better = np.flatnonzero(score.max(axis=1) >= self.best[own, -1])
        own, score = own[better], score[better]
        if len(members) > k:
            # Members are in the order of their ids, so a stable sort keeps the smaller id of ties.
            pick = np.argsort(-score, axis=1, kind="stable")[:, :k]
            score, place = np.take_along_axis(score, pick, axis=1), members[pick]
        else:
            place = np.broadcast_to(members, score.shape)
        score = np.c_[self.best[own], score]
        place = np.c_[self.found[own], place]
        place = np.where(np.isneginf(score), -1, place)
        order = np.lexsort((place, -score), axis=1)[:, :k]  # places follow ids
        self.best[own] = np.take_along_axis(score, order, axis=1)
        self.found[own] = np.take_along_axis(place, order, axis=1)


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products summed in the order of the components, whatever the place of a vector."""
    out = np.zeros(len(q))
    for k in range(q.shape[1]):
        out += q[:, k] * x[:, k]
    return out


def one_each(df: DataFrame) -> DataFrame:
    """``id``, ``embedding``: the usable vectors, one for each id."""
    rows = usable(df.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")))
    return rows.groupBy("id").agg(F.min("embedding").alias("embedding"))


def _packed(asked: DataFrame) -> DataFrame:
    """Queries in blocks of one vector length: ``ids``, ``block`` (as bytes), ``dim``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, ids, q in by_length(b):
                for k in range(0, len(ids), BATCH):
                    cols = [pa.array([x], kind) for x, kind in ((ids[k : k + BATCH].astype(np.int64).tobytes(), pa.binary()), (q[k : k + BATCH].tobytes(), pa.binary()), (dim, pa.int32()))]
                    yield pa.RecordBatch.from_arrays(cols, names=["ids", "block", "dim"])

    return asked.mapInArrow(work, "ids binary, block binary, dim int")


def search(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, *, shard: int = SHARD, least: int = LEAST) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest of ``vectors`` to each of ``queries`` but itself."""
    spark = vectors.sparkSession
    small_batches(spark)
    index, asked = one_each(vectors), one_each(queries)
    size = index.agg(F.count("*").alias("n"), F.max(squared(F.col("embedding"))).alias("sq")).first()
    shards = max(1, -(-size["n"] // shard), min(shuffle_partitions(spark), -(-size["n"] // least)))
    parts = max(1, -(-asked.count() // PART))
    longest = float(size["sq"] or 0.0)
    kept = ["shard", "part", "side", "id", "embedding", "ids", "block", "dim"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda **c: [F.lit(None).cast(t).alias(n) for n, t in c.items()]
    points = index.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), every(parts).alias("part"), F.lit(0).alias("side"), "id", "embedding", *none(ids="binary", block="binary", dim="int"))
    visits = _packed(asked).withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int"))
    visits = visits.select(every(shards).alias("shard"), "part", F.lit(1).alias("side"), *none(id="long", embedding="array<double>"), "ids", "block", "dim")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, trees = None, [], None
        for b in batches:
            place = list(zip(*(b.column(n).to_pylist() for n in ("shard", "part", "side")), strict=True))
            cuts = [x for x in range(1, len(place)) if place[x] != place[x - 1]]
            for lo, hi in zip([0, *cuts], [*cuts, len(place)], strict=True):
                if lo == hi:
                    continue
                if place[lo][:2] != key:
                    key, held, trees = place[lo][:2], [], None
                part = b.slice(lo, hi - lo)
                if place[lo][2] == 0:
                    held.append(part.select(["id", "embedding"]))
                    continue
                if trees is None:
                    trees = {d: Tree(i, x, longest) for d, i, x in by_length(pa.Table.from_batches(held))} if held else {}
                    held = []
                for ids, block, dim in zip(*(part.column(n).to_pylist() for n in ("ids", "block", "dim")), strict=True):
                    if dim in trees:
                        ids, q = np.frombuffer(ids, dtype=np.int64), np.frombuffer(block).reshape(-1, dim)
                        at, vec, score = trees[dim].answers(ids, q, k, factor)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(vec), pa.array(score)], names=["query_id", "vec_id", "score"])

    met = points.unionByName(visits).repartition("shard", "part").sortWithinPartitions("shard", "part", "side")
    found = met.select(kept).mapInArrow(work, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def by_length(some: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Ids and vectors for each vector length."""
    column = some.column("embedding")
    dims = np.array([len(x) for x in column], dtype=np.int64)
    for dim in np.unique(dims):
        own = some.filter(pa.array(dims == dim))
        yield int(dim), own.column("id").to_numpy(), stacked(own.column("embedding"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0))
