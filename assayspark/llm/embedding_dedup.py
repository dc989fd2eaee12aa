"""Embedding near-dedup with randomised-rotation binary codes and stored correction factors.

A unit vector is rotated at random; its code is the signs of what comes out, its correction factor the
inner product of vector and code. For another vector, inner product with the code over the factor is an
unbiased estimate of the inner product of the two, and the factor bounds the estimate's error with
confidence ``BOUND``. Pairs whose upper bound reaches the threshold are recomputed exactly in double
precision, and only those that reach it are links.

Code, factor and the vector's buckets are computed once for each distinct vector and stored in the shared
folder; what is posted to a bucket is read from there.

Which pairs are estimated: sign bits of further rotations put each vector into one bucket in each of
several tables. Bits follow the number of vectors, so a bucket stays near ``BUCKET`` vectors, and tables
follow the bits, so a pair just at the threshold shares a bucket with probability ``RECALL``. Buckets of
more than ``BLOCK`` vectors are split into blocks, each of which meets the others; a vector goes to a bucket
that isn't split once. A pair is counted in the first table that it shares only.

No pairs leave a task: for each vector of a block its number of links and, over the block's links, the
smallest vector of its component do. Equal vectors are one vector with a multiplicity.

Defined cases: vectors that are null, zero or hold null or non-finite components, and rows without
vec_id, link with nothing (component is their own vec_id); vectors of other lengths aren't compared; a
row that stands twice is one vector; of several vectors under one vec_id the least by its components
counts, for all its rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, components, small_batches, table
from .vectors import stacked, usable

THRESHOLD = 0.9
#: Chance that a pair just at the threshold is looked at.
RECALL = 0.999
#: Standard errors of the estimate up to which a pair is recomputed.
BOUND = 4.0
#: Vectors of a bucket, about; vectors of a block of a large bucket; vectors that are compared with a block at once.
BUCKET, BLOCK, CHUNK = 512, 4096, 512
SEED = 99
#: How a bucket's number is stored beside a vector.
KEY = np.dtype("<u4")


@lru_cache(maxsize=64)
def rotation(dim: int, k: int) -> np.ndarray:
    """The k-th random rotation of a dimension, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, k]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def tables_for(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a bucket and number of tables for ``n`` vectors."""
    bits = max(1, ceil(log2(max(2, n / BUCKET))))
    share = (1 - acos(threshold) / pi) ** bits
    return bits, max(1, ceil(log(1 - recall) / log(1 - share)))


def buckets(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The bucket of each vector in each table, from sign bits of as many rotations as that takes."""
    dim = unit.shape[1]
    out = np.zeros((len(unit), tables), dtype=np.int64)
    need, k = tables * bits, 1
    signs = []
    while need > 0:
        signs.append(unit @ rotation(dim, k) > 0)
        need, k = need - dim, k + 1
    signs = np.concatenate(signs, axis=1)
    order = np.random.default_rng([SEED, dim, 0]).permutation(signs.shape[1])
    for t in range(tables):
        for b in range(bits):
            out[:, t] = out[:, t] << 1 | signs[:, order[t * bits + b]]
    return out


def encoded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (packed signs after the first rotation) and correction factors of unit vectors."""
    dim = unit.shape[1]
    rotated = unit @ rotation(dim, 0)
    return np.packbits(rotated > 0, axis=1), np.abs(rotated).sum(axis=1) / np.sqrt(dim)


class Codes:
    """Vectors of a block with their stored codes and factors."""

    def __init__(self, ids: np.ndarray, mult: np.ndarray, keys: np.ndarray, unit: np.ndarray, code: np.ndarray, factor: np.ndarray) -> None:
        self.ids, self.mult, self.keys, self.unit, self.code, self.factor = ids, mult, keys, unit, code, factor

    def part(self, a: int, z: int) -> Codes:
        return Codes(*(x[a:z] for x in (self.ids, self.mult, self.keys, self.unit, self.code, self.factor)))

    def estimates(self, other: Codes) -> tuple[np.ndarray, np.ndarray]:
        """Unbiased estimates of the inner products of own vectors with the other block's codes, and their errors."""
        dim = self.unit.shape[1]
        sign = np.unpackbits(other.code, axis=1, count=dim).astype(np.float32) * 2 - 1
        rotated = (self.unit @ rotation(dim, 0)).astype(np.float32)
        est = (rotated @ sign.T) / (np.sqrt(dim) * other.factor.astype(np.float32))
        error = np.sqrt(np.maximum(1 - other.factor**2, 0)) / other.factor / np.sqrt(max(1, dim - 1))
        return est, error


def links(one: Codes, other: Codes, table_no: int, once: np.ndarray | bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked pairs of two blocks, of those marked in ``once``."""
    est, error = one.estimates(other)
    i, j = np.nonzero(once & (est + BOUND * error[None, :].astype(np.float32) >= THRESHOLD))
    if table_no and len(i):
        new = ~(one.keys[i, :table_no] == other.keys[j, :table_no]).any(axis=1)
        i, j = i[new], j[new]
    exact = np.zeros(len(i))
    for k in range(0, len(i), 1 << 16):
        exact[k : k + (1 << 16)] = np.einsum("ij,ij->i", one.unit[i[k : k + (1 << 16)]], other.unit[j[k : k + (1 << 16)]])
    hit = exact >= THRESHOLD
    return i[hit], j[hit]


def roots(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id in each position's component of a small graph."""
    low = ids.copy()
    while len(i):
        before = low.copy()
        least = np.minimum(low[i], low[j])
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        if (low == before).all():
            break
    return low


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row of ``vectors``."""
    spark = vectors.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    own = usable(rows.where("vec_id IS NOT NULL")).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))
    equal = own.groupBy("embedding", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"))
    classes = ws.save(equal, "classes")
    n = classes.count()
    bits, tables = tables_for(n)
    kind = np.dtype({"float": "<f4", "double": "<f8"}[classes.schema["embedding"].dataType.elementType.simpleString()])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                x = stacked(part.column("embedding"))
                unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                signs, factor = encoded(unit)
                keys = buckets(unit, bits, tables)
                raw = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
                cols = [part.column("rep"), part.column("mult"), part.column("dim"), pa.array(keys.tolist(), pa.list_(pa.int64())), raw(keys.astype(KEY)), raw(signs), pa.array(factor), raw(x.astype(kind))]
                yield pa.RecordBatch.from_arrays(cols, names=["rep", "mult", "dim", "buckets", *kept])

    kept = ["keys", "code", "factor", "x"]
    coded = ws.save(classes.mapInArrow(code, "rep long, mult long, dim int, buckets array<long>, keys binary, code binary, factor double, x binary"), "codes")
    place = ["dim", "t", "bucket"]
    posted = coded.select("rep", "mult", "dim", F.posexplode("buckets").alias("t", "bucket"), *kept)
    sizes = ws.save(posted.groupBy(place).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "sizes")  # at most one for BLOCK rows
    posted = posted.join(sizes, place, "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / BLOCK)).cast("int"), F.lit(0)))
    cols = [*place, "block", "side", "rep", "mult", *kept]
    held = posted.withColumn("block", F.col("own")).withColumn("side", F.lit(0)).select(cols)
    met = posted.where("own > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("own") - 1))).withColumn("side", F.lit(1)).select(cols)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, one, waiting = None, [], None, []

        def codes(some: list[tuple]) -> Codes:
            rep, mult, keys, code, factor, x = zip(*some, strict=True)
            flat = lambda c, t: np.frombuffer(b"".join(c), dtype=t).reshape(len(rep), -1)
            x = flat(x, kind).astype(np.float64)
            return Codes(np.array(rep), np.array(mult), flat(keys, KEY), x / np.sqrt((x * x).sum(axis=1, keepdims=True)), flat(code, np.uint8), np.array(factor))

        def found(a: Codes, b: Codes, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(i):
                ids, at = np.unique(np.r_[a.ids[i], b.ids[j]], return_inverse=True)
                count = np.bincount(at, weights=np.r_[b.mult[j], a.mult[i]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(count), pa.array(roots(len(ids), at[: len(i)], at[len(i) :], ids))], names=["rep", "links", "root"])

        def block() -> Iterator[pa.RecordBatch]:
            """The block is whole: its own pairs."""
            nonlocal one, parts
            if parts:
                one, parts = codes(parts), []
                for k in range(0, len(one.ids), CHUNK):
                    other = one.part(k, k + CHUNK)
                    yield from found(one, other, *links(one, other, key[1], one.ids[:, None] < other.ids[None, :]))

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            if waiting and one:
                other = codes(waiting)
                yield from found(one, other, *links(one, other, key[1], True))
            waiting = []

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:4] != key:
                    yield from block()
                    yield from flush()
                    key, parts, one = row[:4], [], None
                if row[4] == 0:
                    parts.append(row[5:])
                else:
                    yield from block()
                    waiting.append(row[5:])
                    if len(waiting) >= CHUNK:
                        yield from flush()
        yield from block()
        yield from flush()

    dealt = held.unionByName(met).repartition(*place, "block").sortWithinPartitions(*place, "block", "side").select(cols)
    found = ws.save(dealt.mapInArrow(compare, "rep long, links long, root long"), "links")
    counts = found.groupBy(F.col("rep").alias("rep2")).agg(F.sum("links").alias("links"))
    comp = components(ws, found.where("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    of_class = (
        classes.join(counts, F.col("rep") == F.col("rep2"), "left").join(comp, F.col("rep") == F.col("node"), "left")
        .select("embedding", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    named = own.join(of_class, "embedding").select(F.col("vec_id").alias("id"), "links", "component")
    named = ws.save(named, "named")
    out = rows.join(named, F.col("vec_id") == F.col("id"), "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) >= 0.9 * a.l * b.l),
r AS (SELECT vec_id AS node, vec_id AS low FROM v UNION SELECT e.a, r.low FROM r JOIN e ON e.b = r.node),
c AS (SELECT node, min(low) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT node AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, node = component_id AS kept FROM c LEFT JOIN n ON n.a = c.node
"""
