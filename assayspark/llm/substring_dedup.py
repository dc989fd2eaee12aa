"""Substring dedup with difference-cover anchors.

Windows are ``WINDOW`` consecutive words. Hashes of shorter windows are taken only at word positions whose
remainder by ``PERIOD`` is in the difference cover ``COVER``. Every remainder is a difference of two members
of the cover, so of any two equal windows, wherever they start, some pair of aligned positions at most
``PERIOD - 1`` words in is in the cover on both sides: equal windows always share an anchor. Where anchors
repeat, all windows that hold them are extended to full length and compared as such.

Windows are compared by 128 bits of hash over 128-bit hashes of their words (at 1e13 windows two different
ones agree with a chance of 1e-12); anchors only say which windows to compare.

Defined cases: null text has no words; null doc_id takes no part and loses nothing; a row that stands
twice with one doc_id is one document (nothing is removed from it on account of its copy); rows of one
doc_id with different texts are different documents, none before the other, and each is judged by its own
text; texts shorter than a window keep all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from . import anchors as A
from .common import Workspace, table

WINDOW = 20
PERIOD = 13
#: Every remainder by 13 is a difference of two of these.
COVER = (0, 1, 3, 9)
#: So an aligned anchor starts within the first 13 words and is this long.
ANCHOR = WINDOW - (PERIOD - 1)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: bytes) -> np.ndarray:
    """Two 64-bit hashes of each word."""
    words = text.split()
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), dtype=np.uint64).reshape(-1, 2)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        h = h * MULTIPLIER + words[k : k + n]
    return A.mix64(h)


def cover_anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a text."""
    h = window_hashes(word_hashes(text)[:, 0], ANCHOR)
    at = np.flatnonzero(np.isin(np.arange(len(h)) % PERIOD, COVER)) if len(h) else np.zeros(0, dtype=np.int64)
    return at, h[at]


def _windows(plan: A.Plan):  # noqa: ANN202
    """Pass 2: windows around hits, the earliest of each value in a batch; later ones are covered already."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in A.marked(batches, "<i8", "<i4"):
            ids, whos, rows, starts, first, second = [], [], [], [], [], []
            for doc, text, (hits,) in docs:
                if not text or not len(hits):
                    continue
                raw = text.encode("utf-8", "surrogatepass")
                words = word_hashes(raw)
                h = window_hashes(words[:, 0], WINDOW)
                # Hits of an id may be of another row's text: they only say where to look.
                hit = np.zeros(len(h) + 1, dtype=np.int32)
                np.add.at(hit, np.clip(hits - (PERIOD - 1), 0, len(h)), 1)
                np.add.at(hit, np.minimum(hits + 1, len(h)), -1)
                at = np.flatnonzero(np.cumsum(hit)[: len(h)] > 0)
                if not len(at):
                    continue
                rows.append(np.full(len(at), len(ids)))
                ids.append(doc)
                whos.append(A.row_hash(raw))
                starts.append(at.astype(np.int32))
                first.append(h[at])
                second.append(window_hashes(words[:, 1], WINDOW)[at])
            if not rows:
                continue
            ids, whos = np.array(ids, dtype=np.int64), np.array(whos, dtype=np.uint64)
            row, pos, h, g = (np.concatenate(x) for x in (rows, starts, first, second))
            covered, rest = _later(h, g, ids[row], whos[row], pos)
            out = A.dealt(A.MARK, plan.of_doc(ids[row[covered]]), ids[row[covered]], whos[row[covered]], pos[covered])
            bucket = plan.bucket(h[rest])
            rest = rest[np.lexsort((pos[rest], row[rest], bucket))]
            bucket = plan.bucket(h[rest])
            edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(rest) else []
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                own = rest[a:z]
                doc, who = np.unique(row[own], return_inverse=True)
                out.append((A.POST, int(bucket[a]), A.pack(ids[doc], whos[doc]) + A.pack(h[own], g[own], who.astype(np.uint32), pos[own])))
            yield A.rows(out)

    return work


def _later(h: np.ndarray, g: np.ndarray, doc: np.ndarray, who: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that a smaller id or an earlier place of the same document has too, and those that nothing is before."""
    order = np.lexsort((pos, who, doc, g, h))
    h, g, doc, who = h[order], g[order], doc[order], who[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])] if len(h) else np.zeros(0, dtype=bool)
    least = doc[new][np.cumsum(new) - 1] if len(h) else doc
    own = new | np.r_[True, (doc[1:] != doc[:-1]) | (who[1:] != who[:-1])] if len(h) else new  # the first of its document
    free = own & (doc == least)
    return order[~free], order[free]


def _settle(plan: A.Plan):  # noqa: ANN202
    def reduce(_: int, held: list[bytes]) -> list[tuple[int, int, bytes]]:
        parts = []
        for x in held:
            (ids, whos), at = A.unpack_at(x, 0, "<i8", "<u8")
            (h, g, row, pos), _ = A.unpack_at(x, at, "<u8", "<u8", "<u4", "<i4")
            parts.append((h, g, ids[row], whos[row], pos))
        h, g, doc, who, pos = (np.concatenate(c) for c in zip(*parts, strict=True))
        covered = _later(h, g, doc, who, pos)[0]
        return A.dealt(A.MARK, plan.of_doc(doc[covered]), doc[covered], who[covered], pos[covered])

    return reduce


def covered_windows(docs: DataFrame, plan: A.Plan, ws: Workspace) -> DataFrame:
    """Packed marks: document and start of every window that also starts earlier."""
    hits = A.saved(ws, A.gather(A.post(docs, plan, cover_anchors), plan, A.repeated(plan)), "hits")
    windows = A.meet(docs, hits, plan).mapInArrow(_windows(plan), A.PACKED)
    marks = A.saved(ws, A.gather(windows, plan, _settle(plan)), "marks")
    ws.drop("hits")
    return marks


def dedup(docs: DataFrame, *, texts: bool = False, plan: A.Plan | None = None) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256``; with ``texts`` also the kept words as ``text``."""
    docs = A.prepared(docs)
    plan = plan or A.Plan(docs)
    marks = covered_windows(docs, plan, Workspace(docs.sparkSession, "substring"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in A.marked(batches, "<i8", "<u8", "<i4"):
            out = []
            for doc, text, found in group:
                raw = (text or "").encode("utf-8", "surrogatepass")
                words = raw.split()
                (starts,), kept = A.own_marks(raw, *found), words
                if len(starts):
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    starts = np.unique(starts)
                    edge[starts] += 1
                    edge[starts + WINDOW] -= 1
                    kept = [w for w, k in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not k]
                joined = b" ".join(kept)
                out.append((doc, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "surrogatepass") if texts else None))
            doc, n, gone, sha, text = zip(*out, strict=True)
            cols = [pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), *([pa.array(text, pa.string())] if texts else [])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept_sha256", *(["text"] if texts else [])])

    return A.meet(docs, marks, plan).mapInArrow(work, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * texts)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
