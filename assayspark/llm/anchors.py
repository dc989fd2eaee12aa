"""Repeated stretches by anchors: the passes that substring dedup and suffix-array dedup share.

Pass 1 takes anchors (hashes at chosen positions) of every document and brings equal ones together in
buckets; anchors that occur twice are hits. Pass 2 brings hits to their documents, which post what is to
be compared exactly around them, again in buckets; what turns out to be covered by an earlier occurrence
goes back to the documents. Pass 3 removes it.

Rows between passes are packed: one row holds many anchors of one task for one bucket, as byte planes
that compress well. A task first combines what it holds itself, so of a passage that a third of all
documents share a bucket gets one entry from each task, not one from each document. Documents and packed
rows meet in one shuffle by document bucket, so no join multiplies texts.

The number of buckets follows the bytes of text, a bucket stands for ``BUCKET_BYTES`` of it, so what a
task holds at once doesn't grow with the corpus. Each shuffle partition gets the same number of buckets and
goes through them one after the other. Anchors that stand at very many places are told apart as hot.

Documents are rows, not ids: rows that share an id but not their text are different documents. What goes
back to a document carries the hash of its text beside the id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, shuffle_partitions, small_batches

#: Kinds of packed rows.
POST, MARK, HOT = 0, 1, 3
#: Bytes of text that a bucket stands for, about.
BUCKET_BYTES = 32 << 20
#: Anchors that a task combines before it deals them out.
HELD = 1 << 20
#: Places of an anchor from which it is hot, and the most anchors that can be, as a share of all bytes.
HOT_PLACES, HOT_MOST = 20_000, 1 << 20
#: Bytes of an anchor's hash that are kept besides its bucket. Two different anchors of a bucket that agree
#: in them only cost a needless exact comparison; buckets grow in number with the data, not in size.
KEPT_BYTES = 5
_KEPT = np.uint64((1 << 8 * KEPT_BYTES) - 1)
PACKED = "kind int, key int, data binary"
NAMES = ["kind", "key", "data"]


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length as byte planes, with their length before them."""
    head = np.array([len(columns[0])], dtype="<i8").tobytes()
    return head + b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns)


def unpack_at(data: bytes, at: int, *kinds: str) -> tuple[list[np.ndarray], int]:
    """The columns of :func:`pack` by their types from a place on, and where they end."""
    n, at, out = int(np.frombuffer(data, dtype="<i8", count=1, offset=at)[0]), at + 8, []
    for kind in map(np.dtype, kinds):
        plane = np.frombuffer(data, dtype=np.uint8, count=n * kind.itemsize, offset=at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(plane.T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out, at


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    """The columns of :func:`pack` by their types."""
    return unpack_at(data, 0, *kinds)[0]


def rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kind, key, data = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key, pa.int32()), pa.array(data, pa.binary())], names=NAMES)


def dealt(kind: int, key: np.ndarray, *columns: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Packed rows of columns by key; marks in the order of their first column, which compresses."""
    if not len(key):
        return []
    order = np.lexsort((columns[0], key)) if kind == MARK else np.argsort(key, kind="stable")
    key, columns = key[order], [c[order] for c in columns]
    edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    return [(kind, int(key[a]), pack(*(c[a:b] for c in columns))) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def mix64(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Plan:
    """Buckets of one run: as many for each shuffle partition, each for a bounded number of bytes."""

    def __init__(self, docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> None:
        self.parts = shuffle_partitions(docs.sparkSession)
        self.bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.buckets = self.parts * max(1, -(-self.bytes // (bucket_bytes * self.parts)))
        # A place takes some bytes of text, so no more than about HOT_MOST anchors can have so many places.
        self.hot_places = max(HOT_PLACES, self.bytes // (8 * HOT_MOST))

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return (h % np.uint64(self.buckets)).astype(np.int64)

    def rest(self, h: np.ndarray) -> np.ndarray:
        """What of a hash is kept besides its bucket."""
        return h // np.uint64(self.buckets) & _KEPT

    def whole(self, bucket: np.ndarray | int, rest: np.ndarray) -> np.ndarray:
        """Bucket and rest as one number."""
        return rest * np.uint64(self.buckets) + np.asarray(bucket, dtype=np.uint64)

    def whole_of(self, h: np.ndarray) -> np.ndarray:
        """What :meth:`whole` gives for hashes."""
        return self.whole(self.bucket(h), self.rest(h))

    def of_doc(self, ids: np.ndarray) -> np.ndarray:
        """The bucket of documents by their ids, as :meth:`doc_key` has it."""
        return hash_long(ids).astype(np.int64) % self.buckets

    def doc_key(self) -> Column:
        """The bucket of a row; rows without id are spread by their text, as no mark is for them."""
        h = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("text"))
        return F.pmod(h, F.lit(self.buckets)).cast("int")

    def brought(self, rows_: DataFrame) -> DataFrame:
        """Rows by their key's partition; a partition has as many keys as the next."""
        return rows_.repartitionById(self.parts, F.pmod("key", F.lit(self.parts)))


def hash_long(x: np.ndarray) -> np.ndarray:
    """The built-in 64-bit xxhash of long values, for whole arrays."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, k: (v << np.uint64(k)) | (v >> np.uint64(64 - k))
    with np.errstate(over="ignore"):
        h = (np.uint64(42) + p5 + np.uint64(8)) ^ (turn(x.astype(np.int64).view(np.uint64) * p2, 31) * p1)
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def row_hash(text: bytes) -> int:
    """Tells rows of one id apart."""
    return xxhash.xxh3_64_intdigest(text)


def encoded(batch: pa.RecordBatch) -> tuple[np.ndarray, list[bytes]]:
    """Ids and UTF-8 of the documents that can match: without id or text there is nothing to match."""
    pairs = [(i, t) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if i is not None and t]
    return np.array([i for i, _ in pairs], dtype=np.int64), [t.encode("utf-8", "surrogatepass") for _, t in pairs]


def post(docs: DataFrame, plan: Plan, anchors: Callable[[bytes], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Pass 1, dealing: anchors (positions, hashes) of all documents, one for each value and task.

    Anchors that a task holds twice are hits already and go straight to their documents' buckets.
    """

    def combined(got: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        doc = np.repeat(np.array([i for i, _, _ in got], dtype=np.int64), [len(p) for _, p, _ in got])
        pos = np.concatenate([p for _, p, _ in got]).astype(np.int32)
        h = np.concatenate([x for _, _, x in got])
        order = np.argsort(h, kind="stable")
        starts = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]]) if len(h) else order
        n = np.diff(np.r_[starts, len(h)])
        twice = order[np.repeat(n > 1, n)]
        often = np.zeros(len(h), dtype=np.uint8)
        often[order[starts]] = np.ceil(np.log2(n)).astype(np.uint8) if len(n) else 0
        one = np.sort(order[starts])
        out = dealt(MARK, plan.of_doc(doc[twice]), doc[twice], pos[twice])
        out += [(k, key, squeeze(data)) for k, key, data in dealt(POST, plan.bucket(h[one]), plan.rest(h[one]), doc[one], pos[one], often[one])]
        return rows(out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, size = [], 0
        for b in batches:
            for i, t in zip(*encoded(b), strict=True):
                at, h = anchors(t)
                if len(at):
                    got.append((i, at, h))
                    size += len(at)
                if size >= HELD:
                    yield combined(got)
                    got, size = [], 0
        if got:
            yield combined(got)

    return docs.mapInArrow(work, PACKED)


def squeeze(data: bytes) -> bytes:
    """Drop the empty highest planes of the hashes."""
    n = int(np.frombuffer(data[:8], dtype="<i8")[0])
    return data[: 8 + KEPT_BYTES * n] + data[8 + 8 * n :]


def widen(data: bytes) -> bytes:
    """Undo :func:`squeeze`."""
    n = int(np.frombuffer(data[:8], dtype="<i8")[0])
    return data[: 8 + KEPT_BYTES * n] + bytes((8 - KEPT_BYTES) * n) + data[8 + KEPT_BYTES * n :]


def by_bucket(batches: Iterator[pa.RecordBatch], kind: int) -> Iterator[tuple[int, list[bytes]]]:
    """The packed rows of one kind by bucket, from rows sorted by kind and key; others as (-1, [row])."""
    key, held = None, []
    for b in batches:
        for k, x, data in zip(*(b.column(n).to_pylist() for n in NAMES), strict=True):
            if k != kind:
                yield -1, [(k, x, data)]
                continue
            if x != key and held:
                yield key, held
                held = []
            key = x
            held.append(data)
    if held:
        yield key, held


def gather(posted: DataFrame, plan: Plan, reduce: Callable[[int, list[bytes]], list[tuple[int, int, bytes]]]) -> DataFrame:
    """Bring packed rows of a bucket together and turn them into marks; marks pass through."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for key, held in by_bucket(batches, POST):
            new = held if key == -1 else reduce(key, held)
            out += new
            size += sum(len(x[2]) for x in new)
            if len(out) > 2000 or size > 8 << 20:
                yield rows(out)
                out, size = [], 0
        if out:
            yield rows(out)

    return plan.brought(posted).sortWithinPartitions("kind", "key").mapInArrow(work, PACKED)


def repeated(plan: Plan) -> Callable[[int, list[bytes]], list[tuple[int, int, bytes]]]:
    """Pass 1, meeting: anchors whose value came from two tasks are hits; those of very many places are named hot."""

    def reduce(key: int, held: list[bytes]) -> list[tuple[int, int, bytes]]:
        parts = [unpack(widen(x), "<u8", "<i8", "<i4", "u1") for x in held]
        h, doc, pos, often = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        starts = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
        n = np.diff(np.r_[starts, len(h)])
        keep = order[np.repeat(n > 1, n)]
        hot = h[order[starts]][np.add.reduceat(np.exp2(often[order].astype(np.float64)), starts) >= plan.hot_places]
        return dealt(MARK, plan.of_doc(doc[keep]), doc[keep], pos[keep]) + ([(HOT, 0, pack(plan.whole(key, hot)))] if len(hot) else [])

    return reduce


def hot_anchors(hits: DataFrame) -> np.ndarray:
    """Bucket and rest of the hot anchors of saved hits; their number is bounded (:class:`Plan`)."""
    got = [unpack(bytes(r["data"]), "<u8")[0] for r in hits.where(F.col("kind") == HOT).select("data").collect()]
    return np.unique(np.concatenate(got)) if got else np.zeros(0, dtype=np.uint64)


def meet(docs: DataFrame, marks: DataFrame, plan: Plan) -> DataFrame:
    """Documents and the marks of their bucket in one partition, marks first."""
    d = docs.select(F.lit(2).alias("kind"), plan.doc_key().alias("key"), F.lit(None).cast("binary").alias("data"), "doc_id", "text")
    m = marks.where(F.col("kind") == MARK).select("kind", "key", "data", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    return plan.brought(d.union(m)).sortWithinPartitions("key", "kind")


def marked(batches: Iterator[pa.RecordBatch], *kinds: str) -> Iterator[list[tuple[int | None, str | None, list[np.ndarray]]]]:
    """Batches of documents, each with the columns that its marks hold (the first mark column is the id)."""
    key, held, ids, cols = None, [], np.zeros(0, dtype=np.int64), []
    empty = [np.zeros(0, dtype=k) for k in kinds[1:]]
    for b in batches:
        out = []
        for kind, x, data, doc, text in zip(*(b.column(n).to_pylist() for n in (*NAMES, "doc_id", "text")), strict=True):
            if x != key:
                key, held, ids, cols = x, [], np.zeros(0, dtype=np.int64), []
            if kind != 2:
                held.append(data)
                continue
            if held:
                parts = [unpack(h, *kinds) for h in held]
                ids, *cols = (np.concatenate(c) for c in zip(*parts, strict=True))
                order = np.argsort(ids, kind="stable")
                ids, cols, held = ids[order], [c[order] for c in cols], []
            if doc is None or not len(ids):
                out.append((doc, text, empty))
                continue
            a, z = np.searchsorted(ids, [doc, doc + 1])
            out.append((doc, text, [c[a:z] for c in cols]))
        if out:
            yield out


def prepared(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def own_marks(text: bytes, who: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Of an id's marks those for the row with this text."""
    if not len(who):
        return list(columns)
    own = who == np.uint64(row_hash(text))
    return [c[own] for c in columns]


def saved(ws: Workspace, marks: DataFrame, name: str) -> DataFrame:
    """Write marks to the shared folder; what was shuffled to find them is dropped before texts move again."""
    out = ws.save(marks, name)
    del marks
    ws.release()
    return out
