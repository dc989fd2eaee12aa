"""MinHash near-dedup by a signature-coordinate inverted join.

A text's set is that of its distinct 5-word shingles. Equal sets form a class, one document stands for it.
Each class is posted under its ``COORDINATES`` pairs of signature coordinate and value. Linked documents
(Jaccard ``THRESHOLD`` or more) agree in ``MATCHES`` coordinates or more but for about one pair in 5 000
just at the threshold, and far fewer above it. Two documents that agree so often must share a pair among
the ``COORDINATES - MATCHES + 1`` that are rarest in the corpus (prefix), so only those are merged, and
pairs that nobody else has are skipped, as are documents with too few shared ones. Very common lines thus
stay out of the merge unless they make up most of a document.

Within a merged list no pairs are written out. First each document is compared with one pivot, the
document that most of its lists begin with. Then lists that still hold several components are gone
through in blocks, those with one main component together: documents outside of the main component
against all others, collisions counted over whole signatures. Documents with a pair above the match
threshold get their full sets and the blocks are gone through again; only confirmed links leave the task.
Links within one component can't change it and need no look. Blocks grow with their list, so the copies of
a list's members that are sent to blocks grow with its length to the power of a half more, up to a bound
on what a task holds.

Defined cases: null or empty text, or one without words: no shingles, linked with nothing; fewer than five
words: the whole sequence is the one shingle; null doc_id: linked with nothing, component null, kept;
repeated rows: one class; rows with one doc_id and different texts: documents of their own, each judged by its
text, with the smallest doc_id of what its text reaches as component; ties: the smallest doc_id is kept; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .anchors import mix64
from .common import Workspace, components, small_batches, table, words_of

SHINGLE = 5
#: Jaccard similarity in hundredths from which documents are linked.
THRESHOLD = 75
COORDINATES = 64
#: Coordinates in which a pair must agree to be compared on its full sets.
MATCHES = 35
#: Documents of a block outside of a list's main component, and of a run of the list that they meet: least and most,
#: the most with full sets; and how many of a block are compared at once.
LEAST, MOST, MOST_SETS, CHUNK = 512, 16384, 1024, 256
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240607)
_A = (_rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; A-Z count as a-z."""
    words = words_of(text)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w.lower()) for w in words), dtype=np.uint64, count=len(words))
    n = len(h) - SHINGLE + 1
    if not len(h):
        return h
    size, n = (SHINGLE, n) if n > 0 else (len(h), 1)
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out = out * MULTIPLIER + h[k : k + n]
    return np.unique(mix64(out))


def signature(s: np.ndarray) -> np.ndarray:
    """The least value of each coordinate's hash over a set."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(s), 2048):
        least = np.minimum(least, (s[k : k + 2048, None] * _A + _B).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _signed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n``, the set's digest ``set_id``, signature ``sig``; texts without words have neither."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t) for t in b.column("text").to_pylist()]
            n = pa.array([len(s) for s in sets], pa.int64())
            ids = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
            sig = pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), n, ids, sig], names=["doc_id", "n", "set_id", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n long, set_id binary, sig binary")


def _posts(classes: DataFrame) -> DataFrame:
    """``doc``, ``token``: a hash of coordinate and value, for all coordinates."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64) * MULTIPLIER)
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)
            doc = np.repeat(b.column("doc").to_numpy(zero_copy_only=False), COORDINATES)
            token = mix64(base + sig.astype(np.uint64)).view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(token)], names=["doc", "token"])

    return classes.select("doc", "sig").mapInArrow(work, "doc long, token long")


def merged_lists(ws: Workspace, classes: DataFrame) -> DataFrame:
    """``token``, ``doc``: the rarest shared pairs of each document that has enough of them."""
    posts = _posts(classes)
    often = posts.groupBy("token").agg(F.count("*").alias("often")).where("often > 1")
    shared = ws.save(posts.join(often, "token"), "shared")
    own = W.partitionBy("doc")
    ranked = shared.withColumn("all", F.count("*").over(own)).where(F.col("all") >= MATCHES)
    ranked = ranked.withColumn("rank", F.row_number().over(own.orderBy("often", "token")))
    prefix = ranked.where(F.col("rank") <= F.col("all") - MATCHES + 1).select("token", "doc")
    return ws.save(prefix, "prefix")


def _classes(ws: Workspace, signed: DataFrame) -> DataFrame:
    """``set_id``, ``doc``, ``least``, ``n``, ``sig`` of each distinct set: its number and its smallest doc_id, which is the number too if no other set has it."""
    usable = signed.where("doc_id IS NOT NULL AND set_id IS NOT NULL")
    classes = ws.save(usable.groupBy("set_id").agg(F.min("doc_id").alias("least"), F.min("n").alias("n"), F.min("sig").alias("sig")), "classes")
    if classes.groupBy("least").agg(F.count("*").alias("k")).where("k > 1").isEmpty():
        return classes.select("set_id", F.col("least").alias("doc"), "least", "n", "sig")
    # Numbers in the order of the ids, so that a smallest number stands for a smallest id.
    numbers = classes.select("least", "set_id").orderBy("least", "set_id").withColumn("doc", F.monotonically_increasing_id())
    return ws.save(classes.join(ws.save(numbers, "numbers").drop("least"), "set_id").select("set_id", "doc", "least", "n", "sig"), "numbered")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc``, ``n``, ``items``: the full sets of the classes in ``wanted`` (``doc``, ``least``, ``set_id``), one row for each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t) for t in b.column("text").to_pylist()]
            # A doc_id may stand on other texts as well.
            own = [k for k, (s, i) in enumerate(zip(sets, b.column("set_id").to_pylist(), strict=True)) if xxhash.xxh3_128_digest(s.tobytes()) == i]
            items = pa.array([sets[k].tobytes() for k in own], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(own, pa.int64())), pa.array([len(sets[k]) for k in own], pa.int64()), items], names=["doc", "n", "items"])

    texts = docs.select(F.col("doc_id").cast("long").alias("least"), "text").where("least IS NOT NULL")
    few = texts.join(wanted.hint("shuffle_hash"), "least").select("doc", "set_id", "text")
    return few.mapInArrow(work, "doc long, n long, items binary").dropDuplicates(["doc"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) whose full sets are similar enough.

    Each b's set goes to a's once; an a with many pairs is split, and its set is sent to each part.
    """
    many = pairs.groupBy("a").agg(F.count("*").alias("n_b")).withColumn("parts", F.ceil(F.col("n_b") / 512).cast("int"))
    heads = many.join(sets, many.a == sets.doc).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.col("a").alias("b"), "items")
    rest = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    members = rest.join(sets, rest.b == sets.doc).select("a", "part", F.lit(1).alias("side"), "b", "items")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, key = np.zeros(0, dtype=np.uint64), None
        for b in batches:
            left, right = [], []
            for a, part, side, other, items in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = np.frombuffer(items, dtype=np.uint64)
                if side == 0:
                    head, key = s, (a, part)
                elif key == (a, part):
                    at = np.searchsorted(head, s)
                    both = int((head[np.minimum(at, len(head) - 1)] == s).sum())
                    if 100 * both >= THRESHOLD * (len(head) + len(s) - both):
                        left.append(a)
                        right.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    met = heads.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", "side")
    return met.select("a", "part", "side", "b", "items").mapInArrow(work, "a long, b long")


def _pivots(prefix: DataFrame) -> DataFrame:
    """For each document the one that most of its lists begin with."""
    first = prefix.groupBy("token").agg(F.min("doc").alias("a"), F.count("*").alias("n")).where("n > 1")
    met = prefix.join(first, "token").where("doc > a").groupBy("doc", "a").agg(F.count("*").alias("n"))
    best = met.groupBy("doc").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a"))
    return best.select("a", F.col("doc").alias("b"))


def _members(prefix: DataFrame, comp: DataFrame) -> DataFrame:
    """``main``, ``doc``, ``comp``: documents of lists that hold several components, lists of one main component as one."""
    g = prefix.join(comp, prefix.doc == comp.node, "left").select("token", "doc", F.coalesce("component", "doc").alias("comp"))
    counts = g.groupBy("token", "comp").agg(F.count("*").alias("n"))
    lists = counts.groupBy("token").agg(F.sum("n").alias("all"), F.max("n").alias("main_n"), F.max_by("comp", F.struct("n", -F.col("comp"))).alias("main"))
    return g.join(lists.where(F.col("main_n") < F.col("all")).select("token", "main"), "token").select("main", "doc", "comp").distinct()


def _blocks(members: DataFrame, most: int) -> DataFrame:
    """Rows of members dealt out by ``main``, ``block`` and ``run``: side 0 those outside of the main component, side 1 all."""
    outside = F.col("comp") != F.col("main")
    sizes = members.groupBy("main").agg(F.count("*").alias("all"), F.count_if(outside).alias("out")).where("out > 0")
    pieces = lambda n: F.ceil(F.col(n) / F.least(F.lit(float(most)), F.greatest(F.lit(float(LEAST)), F.sqrt(n) * 8))).cast("int")
    sizes = sizes.select("main", pieces("out").alias("blocks"), pieces("all").alias("runs"))
    held = members.join(sizes, "main").withColumn("outside", outside)
    block, run = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64(F.lit(1), "doc"), F.col("runs")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ["main", "block", "run", "side", "outside", *members.columns[1:]]
    left = held.where("outside").withColumn("block", block).withColumn("run", every("runs")).withColumn("side", F.lit(0)).select(kept)
    right = held.withColumn("run", run).withColumn("block", every("blocks")).withColumn("side", F.lit(1)).select(kept)
    return left.unionByName(right).repartition("main", "block", "run").sortWithinPartitions("main", "block", "run", "side").select(kept)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list]]:
    """Blocks (side 0) with the parts of the runs (side 1) that they meet, as lists of columns."""
    key, held, block = None, [], None
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        keys = list(zip(*cols[:4], strict=True))
        cuts = [k for k in range(1, len(keys)) if keys[k] != keys[k - 1]]
        for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if lo == hi:
                continue
            part = [np.array(c[lo:hi]) for c in cols[4:8]]
            part.append(np.frombuffer(b"".join(cols[8][lo:hi]), dtype=np.int32).reshape(-1, COORDINATES))
            if len(cols) > 9:
                part.append([np.frombuffer(x, dtype=np.uint64) for x in cols[9][lo:hi]])
            if keys[lo][:3] != key:
                key, held, block = keys[lo][:3], [], None
            if keys[lo][3] == 0:
                held.append(part)
            elif held:
                block = block or [sum(x, []) if isinstance(x[0], list) else np.concatenate(x) for x in zip(*held, strict=True)]
                for k in range(0, hi - lo, CHUNK):
                    yield key[0], block, [x[k : k + CHUNK] for x in part]


def _close(one: list, other: list) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two blocks that agree in enough coordinates and aren't in one component yet."""
    (_, d1, c1, n1, s1), (out2, d2, c2, n2, s2) = one[:5], other[:5]
    small, large = np.minimum(n1[:, None], n2), np.maximum(n1[:, None], n2)
    # Of two documents outside of the main component only the smaller looks for the larger.
    i, j = np.nonzero((c1[:, None] != c2) & (100 * small >= THRESHOLD * large) & (~out2 | (d1[:, None] < d2)))
    hit = np.zeros(len(i), dtype=bool)
    for k in range(0, len(i), 1 << 15):
        hit[k : k + (1 << 15)] = (s1[i[k : k + (1 << 15)]] == s2[j[k : k + (1 << 15)]]).sum(axis=1) >= MATCHES
    return i[hit], j[hit]


def _needed(members: DataFrame) -> DataFrame:
    """``main``, ``doc``: members with some close pair; the pairs themselves don't leave the task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for main, one, other in _met(batches):
            i, j = _close(one, other)
            if len(i):
                docs = np.unique(np.r_[one[1][i], other[1][j]])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), main)), pa.array(docs)], names=["main", "doc"])

    return _blocks(members, MOST).mapInArrow(work, "main long, doc long").distinct()


def _linked(members: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) among close pairs, confirmed on full sets; one for a document and a component of a part suffices."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, one, other in _met(batches):
            i, j = _close(one, other)
            left, right = [], []
            for u in np.unique(i):
                own, some = one[5][u], j[i == u]
                sets = [other[5][k] for k in some]
                flat = np.concatenate(sets)
                at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                sizes = np.array([len(x) for x in sets])
                both = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
                link = some[100 * both >= THRESHOLD * (len(own) + sizes - both)]
                for k in link[np.unique(other[2][link], return_index=True)[1]] if len(link) else ():
                    left.append(int(one[1][u]))
                    right.append(int(other[1][k]))
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return _blocks(members, MOST_SETS).mapInArrow(work, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "minhash")
    signed = ws.save(_signed(docs), "signed")
    classes = _classes(ws, signed)
    prefix = merged_lists(ws, classes)
    pivots = ws.save(_pivots(prefix), "pivots")
    ws.drop("shared")
    ids = prefix.join(prefix.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "token", "left_semi").select("doc").distinct()
    sets = ws.save(_sets(docs, classes.select("doc", "least", "set_id").join(ids, "doc", "left_semi")), "sets")
    links = ws.save(confirmed(pivots, sets), "links-1")
    comp = ws.save(components(ws, links, "cc-a"), "components-1")
    signs = classes.select(F.col("doc").alias("d"), "n", "sig")
    members = ws.save(_members(prefix, comp), "members")
    signed_members = members.join(signs, F.col("doc") == F.col("d")).select("main", "doc", "comp", "n", "sig")
    needed = ws.save(_needed(signed_members), "needed")
    full = needed.join(members, ["main", "doc"]).join(signs, F.col("doc") == F.col("d")).drop("n")
    full = full.join(sets.withColumnRenamed("doc", "s"), F.col("doc") == F.col("s")).select("main", "doc", "comp", "n", "sig", "items")
    links = links.union(ws.save(_linked(full), "links-2"))
    ws.drop("sets", "pivots", "members", "needed")
    comp = components(ws, links, "cc-b")
    linked = comp.join(classes.select(F.col("doc").alias("head"), "least"), F.col("component") == F.col("head")).select("node", F.col("least").alias("component"))
    named = classes.join(linked, F.col("doc") == F.col("node"), "left").select("set_id", F.coalesce("component", "least").alias("component"))
    named = ws.save(named, "named")
    out = signed.alias("s").join(named.alias("c"), F.col("s.set_id") == F.col("c.set_id"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
u AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS hits FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * hits >= 75 * (na.n + nb.n - hits)),
r AS (SELECT doc_id AS node, doc_id AS low FROM n UNION SELECT e.a, r.low FROM r JOIN e ON e.b = r.node),
c AS (SELECT node, min(low) AS component_id FROM r GROUP BY node)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c ON c.node = n.doc_id
"""
