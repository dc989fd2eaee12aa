"""Suffix-array dedup: repeated byte strings by difference-cover suffix sorting.

Suffixes of the whole corpus at once would be many times the corpus on disk, so only stretches that may
be repeated are sorted. Pass 1 finds them without loss: of every 50-byte string the k-gram with the least
hash (all of them, if tied) is an anchor, equal strings have equal anchors, and a string whose anchor
occurs once occurs once. Around anchors that repeat, the stretch of strings that they stand for goes to
the anchor's bucket; equal strings always meet in one bucket. The strings of hot anchors (a common line
with many surroundings) are dealt out by more of what they hold: strings with the anchor at about the same
place go by the bytes that all of those have, so no bucket gets all surroundings of a line.

Every verdict comes from a suffix array. It is built over the distinct stretches of a bucket (each counts
for its smallest document) by the difference cover modulo 3: the suffixes at positions 1 and 2 modulo 3
are sorted by triples and named, the names are sorted by recursion until they are unique, the remaining
suffixes are sorted by one byte and a name and merged in, and neighbours in the array are compared on their
first 50 bytes. That gives the smallest document for every string, and each place of a stretch is judged
by it. A task that reads documents does so for the stretches that several of its own documents have, and
posts only what that leaves undecided. All steps are whole-array operations over portions of bounded size.

Defined cases: null text is the empty text; null doc_id takes no part and loses nothing; rows that share a
doc_id cover nothing of each other, whether their texts are equal or not, and each is judged by its own
text; texts under 50 bytes keep all; an empty table gives no rows; other columns are ignored.
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

#: Bytes of a string that must repeat.
LENGTH = 50
#: Bytes of an anchor; of ``LENGTH - GRAM + 1`` neighbouring ones the least is taken.
GRAM = 20
SPAN = LENGTH - GRAM + 1
#: Bytes of stretches that are sorted together, about.
SORTED = 1 << 18
#: Neighbouring strings of a hot anchor that are dealt out together.
PIECE = 6
_BYTE = A.mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWERS = [pow(0xD6E8FEB86659FD93, 2**k, 1 << 64) for k in range(6)]


def _slide(x: np.ndarray, size: int, best) -> np.ndarray:  # noqa: ANN001
    """``best`` of every ``size`` neighbours by doubling."""
    n, width = len(x) - size + 1, 1
    while 2 * width <= size:
        x = best(x[: len(x) - width], x[width:])
        width *= 2
    return best(x[:n], x[size - width : size - width + n])


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of every GRAM bytes, from hashes of 1, 2, 4, 8 and 16."""
    out, have = None, 0
    level, width = _BYTE[raw], 1
    n = len(raw) - GRAM + 1
    for k in range(GRAM.bit_length()):
        if GRAM >> k & 1:
            part = level[have : have + n]
            out = part if out is None else out * np.uint64(_POWERS[k]) + part
            have += width
        if 2 * width <= GRAM:
            level = level[: len(level) - width] * np.uint64(_POWERS[k]) + level[width:]
            width *= 2
    return A.mix64(out)


def least_grams(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams and, for every string of LENGTH bytes, the least hash in it."""
    h = gram_hashes(raw)
    return h, _slide(h, SPAN, np.minimum)


def least_anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of grams that are the least of some string."""
    if len(text) < LENGTH:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    h, least = least_grams(np.frombuffer(text, dtype=np.uint8))
    # A gram is the least of a string if the greatest of the leasts around it is its own hash.
    pad = np.zeros(SPAN - 1, dtype=np.uint64)
    at = np.flatnonzero(_slide(np.r_[pad, least, pad], SPAN, np.maximum) == h)
    return at, h[at]


def _names(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ranks (from 1, equal for equal triples) of the triples at positions."""
    a, b, c = s[at], s[at + 1], s[at + 2]
    base = int(s.max()) + 1
    if base**3 < 4 * len(at):  # few triples: those that occur are numbered without sorting
        key = (a * base + b) * base + c
        there = np.zeros(base**3, dtype=bool)
        there[key] = True
        return np.cumsum(there, dtype=np.int32)[key]
    if base**3 < 1 << 63:
        key = (a * base + b) * base + c
        order = np.argsort(key)
        new = key[order][1:] != key[order][:-1]
    else:
        pair, order = b * base + c, np.lexsort((b * base + c, a))
        new = (pair[order][1:] != pair[order][:-1]) | (a[order][1:] != a[order][:-1])
    out = np.empty(len(at), dtype=np.int64)
    out[order] = np.cumsum(np.r_[1, new])
    return out


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of ``t`` (values from 1) in order, by the difference cover modulo 3."""
    n = len(t)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), dtype=np.int64)
    s = np.zeros(n + 4, dtype=np.int64)
    if int(t.max()) < 1 << 16:  # values that don't occur are left out
        there = np.zeros(int(t.max()) + 1, dtype=bool)
        there[t] = True
        s[:n] = np.cumsum(there, dtype=np.int32)[t]
    else:
        s[:n] = t
    # The names of positions 1 modulo 3 end in a triple that has a zero, so none runs on into those of 2.
    sample = np.r_[np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)]
    names = _names(s, sample)
    if names.max() < len(sample):
        order = suffix_array(names)
        ranked = np.empty(len(sample), dtype=np.int64)
        ranked[order] = np.arange(1, len(sample) + 1)
    else:
        order, ranked = np.argsort(names), names
    rank = np.zeros(n + 4, dtype=np.int64)
    rank[sample] = ranked
    ordered = sample[order]
    one, two = ordered[ordered % 3 == 1], ordered[ordered % 3 == 2]
    r = len(sample) + 2
    # One before each position 1 modulo 3, in the order of what follows, so only their own values are left to be sorted by.
    rest = one - 1
    if int(s.max()) < 1 << 16:
        rest = rest[np.argsort(s[rest].astype(np.uint16), kind="stable")]
    else:
        rest = rest[np.argsort(s[rest] * r + rank[rest + 1])]
    by_one = s[rest] * r + rank[rest + 1]
    # Against position 1 a byte and a rank decide, against position 2 two bytes and a rank.
    before = np.searchsorted(s[one] * r + rank[one + 1], by_one)
    high = int(s.max()) + 1
    if high * high * r < 1 << 63:
        key = lambda x: (s[x] * high + s[x + 1]) * r + rank[x + 2]
        before += np.searchsorted(key(two), key(rest))
    else:
        both = np.r_[two, rest]
        o = np.lexsort((np.r_[np.ones(len(two)), np.zeros(len(rest))], rank[both + 2], s[both + 1], s[both]))
        place = np.empty(len(both), dtype=np.int64)
        place[o] = np.cumsum(o < len(two))
        before += place[len(two) :]
    out = np.empty(len(sample) + len(rest), dtype=np.int64)
    spot = before + np.arange(len(rest))
    held = np.zeros(len(out), dtype=bool)
    held[spot] = True
    out[spot], out[~held] = rest, ordered
    return out[out < n]


def smallest_documents(raw: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For stretches of ``raw`` (starts, sizes, documents): the smallest document of the string that starts at each position.

    Where no whole string starts it is less than any document.
    """
    owner = np.repeat(np.arange(len(start)), size)
    t = np.full(len(raw) + len(start), 1, dtype=np.int64)  # a 1 ends each stretch
    spot = np.arange(len(raw)) + owner
    t[spot] = raw.astype(np.int64) + 2
    array = suffix_array(t)
    left = np.zeros(len(t), dtype=np.int64)
    left[spot] = np.repeat(start + size, size) - np.arange(len(raw))
    array = array[left[array] >= LENGTH]
    at = array - np.repeat(np.arange(len(start)), size + 1)[array]  # back to positions in raw
    least = np.full(len(raw), NONE)
    if not len(at):
        return least
    wide = np.lib.stride_tricks.sliding_window_view(np.r_[raw, np.zeros(7, dtype=np.uint8)], 8)
    eight = np.ascontiguousarray(wide).view("<u8").ravel()
    same = np.ones(len(at) - 1, dtype=bool)
    for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        part = eight[at + k]
        same &= part[1:] == part[:-1]
    first = np.flatnonzero(np.r_[True, ~same])
    least[at] = np.repeat(np.minimum.reduceat(doc[owner[at]], first), np.diff(np.r_[first, len(at)]))
    return least


#: Less than any document.
NONE = np.iinfo(np.int64).min


class Stretches:
    """Distinct stretches and the places where they stand."""

    def __init__(self, gram: np.ndarray, text: list[bytes], which: np.ndarray, doc: np.ndarray) -> None:
        """``gram`` and ``text`` for each kind; ``which`` kind and ``doc`` for each place."""
        self.gram, self.text, self.which, self.doc = gram, text, which, doc
        self.size = np.array([len(t) for t in text], dtype=np.int64)
        self.least = np.full(len(text), np.iinfo(np.int64).max)
        np.minimum.at(self.least, which, doc)
        most = np.full(len(text), NONE)
        np.maximum.at(most, which, doc)
        self.several = most > self.least
        #: The second smallest document of a kind that several have; it stands for all but the smallest.
        self.second = np.full(len(text), np.iinfo(np.int64).max)
        later = doc > self.least[which]
        np.minimum.at(self.second, which[later], doc[later])

    def judged(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """By the suffix arrays of ``kinds``: ``bound``, above which a document's place is covered as a whole (by kind), and
        the runs that are covered in the place of a kind's smallest document (kind, start, size).

        A kind that several documents have stands in the array twice, for its smallest document and for the next one: that
        the second is covered by the first is what their suffixes' being neighbours tells, and nothing else does.
        """
        bound = np.full(len(self.text), np.iinfo(np.int64).max)
        own, starts, sizes = [], [], []
        kinds = kinds[np.argsort(self.gram[kinds], kind="stable")]
        for some in _portions(self.gram[kinds], self.size[kinds] * (1 + self.several[kinds])):
            some = kinds[some]
            twice = some[self.several[some]]
            both = np.r_[some, twice]
            size = self.size[both]
            start = np.cumsum(size) - size
            doc = np.r_[self.least[some], self.second[twice]]
            least = smallest_documents(np.frombuffer(b"".join([self.text[k] for k in both]), dtype=np.uint8), start, size, doc)
            whole = np.maximum.reduceat(least, start)
            bound[some] = whole[: len(some)]
            bound[twice] = np.where(whole[len(some) :] < self.second[twice], whole[len(some) :], np.iinfo(np.int64).max)
            start, size = start[: len(some)], size[: len(some)]
            least = least[: int(size.sum())]
            covered = (least < np.repeat(self.least[some], size)) & (least > NONE)
            # Neighbouring covered starts of a stretch are one run.
            head, tail = covered.copy(), covered.copy()
            head[1:] &= ~covered[:-1]
            tail[:-1] &= ~covered[1:]
            a, z = np.flatnonzero(head), np.flatnonzero(tail)
            k = np.searchsorted(start, a, side="right") - 1
            own.append(some[k])
            starts.append(a - start[k])
            sizes.append(z - a + LENGTH)
        join = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
        return bound, join(own), join(starts), join(sizes)


def _pieces(raw: bytes, h: np.ndarray, value: int, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
    """A hot stretch in pieces (key, start, end): neighbouring strings that have the anchor at about the same place.

    The key is a hash of the bytes around the anchor that all strings of such a piece have.
    """
    at = lo + np.flatnonzero(h[lo : hi - GRAM + 1] == np.uint64(value))
    string = np.arange(lo, hi - LENGTH + 1)
    gram = at[np.searchsorted(at, string)]  # the first in each string
    part = (gram - string) // PIECE
    cuts = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (part[1:] != part[:-1]), True])
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        g, q = int(gram[a]), int(part[a])
        common = raw[g - q * PIECE : g - q * PIECE - PIECE + 1 + LENGTH]
        yield xxhash.xxh3_64_intdigest(common, q), int(string[a]), int(string[z - 1]) + LENGTH


def _stretches(plan: A.Plan, hot: np.ndarray):  # noqa: ANN202
    """Pass 2: the stretches of hits. What several documents of a batch have is judged there; one place of each is posted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in A.marked(batches, "<i8", "<i4"):
            kinds: dict[tuple[int, bytes], int] = {}
            which, rows, places, ids, hashes = [], [], [], [], []
            for doc, text, (hits,) in docs:
                if not text or not len(hits):
                    continue
                raw = text.encode("utf-8", "surrogatepass")
                hits = hits[hits <= len(raw) - GRAM]  # an id's hits may be of another row's text
                if len(raw) < LENGTH or not len(hits):
                    continue
                h, least = least_grams(np.frombuffer(raw, dtype=np.uint8))
                # Neighbouring strings with one least gram are one stretch.
                cuts = np.flatnonzero(least[1:] != least[:-1]) + 1
                starts, value = [0, *cuts.tolist()], [int(least[0]), *least[cuts].tolist()]
                ends = [*(x - 1 + LENGTH for x in starts[1:]), len(raw)]
                known = set(h[hits].tolist())
                found = [(v, lo, hi) for v, lo, hi in zip(value, starts, ends, strict=True) if v in known]
                if len(hot):
                    split = np.isin(plan.whole_of(np.array([v for v, _, _ in found], dtype=np.uint64)), hot).tolist()
                    whole = [x for x, cut in zip(found, split, strict=True) if not cut]
                    found = whole + [piece for x, cut in zip(found, split, strict=True) if cut for piece in _pieces(raw, h, *x)]
                ids.append(doc)
                hashes.append(A.row_hash(raw))
                rows += [len(ids) - 1] * len(found)
                places += [lo for _, lo, _ in found]
                which += [kinds.setdefault((v, raw[lo:hi]), len(kinds)) for v, lo, hi in found]
            if not which:
                continue
            ids, hashes = np.array(ids, dtype=np.int64), np.array(hashes, dtype=np.uint64)
            which, row, lo = np.array(which), np.array(rows), np.array(places, dtype=np.int32)
            gram = np.fromiter((g for g, _ in kinds), dtype=np.uint64, count=len(kinds))
            s = Stretches(gram, [t for _, t in kinds], which, ids[row])
            bound = s.judged(np.flatnonzero(s.several))[0]
            late = ids[row] > bound[which]
            out = _marks(plan, ids[row[late]], hashes[row[late]], lo[late], s.size[which[late]])
            rest = np.flatnonzero(~late)
            rest = rest[np.argsort(plan.bucket(gram[which[rest]]), kind="stable")]
            bucket = plan.bucket(gram[which[rest]])
            edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(rest) else []
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                own = rest[a:z]
                kind, at = np.unique(which[own], return_inverse=True)
                doc, who = np.unique(row[own], return_inverse=True)
                head = [A.pack(ids[doc], hashes[doc]), A.pack(who.astype(np.uint32), at.astype(np.uint32), lo[own]), A.pack((gram[kind] >> np.uint64(32)).astype(np.uint32), s.size[kind].astype(np.int32))]
                out.append((A.POST, int(bucket[a]), b"".join([*head, *(s.text[k] for k in kind)])))
            if out:
                yield A.rows(out)

    return work


def _marks(plan: A.Plan, doc: np.ndarray, who: np.ndarray, lo: np.ndarray, size: np.ndarray) -> list[tuple[int, int, bytes]]:
    return A.dealt(A.MARK, plan.of_doc(doc), doc, who, lo.astype(np.int32), size.astype(np.int32))


def _settle(plan: A.Plan):  # noqa: ANN202
    """Pass 2, meeting: all places of a bucket's stretches judged by suffix arrays over its distinct stretches."""

    def reduce(_: int, held: list[bytes]) -> list[tuple[int, int, bytes]]:
        kinds, parts = {}, []
        for x in held:
            at = 0
            (ids, hashes), at = A.unpack_at(x, at, "<i8", "<u8")
            (row, kind, lo), at = A.unpack_at(x, at, "<u4", "<u4", "<i4")
            (gram, size), at = A.unpack_at(x, at, "<u4", "<i4")
            names = []
            for g, n in zip(gram.tolist(), size.tolist(), strict=True):
                names.append(kinds.setdefault((g, x[at : at + n]), len(kinds)))
                at += n
            parts.append((ids[row], hashes[row], lo, np.array(names)[kind]))
        doc, who, lo, which = (np.concatenate(c) for c in zip(*parts, strict=True))
        gram = np.fromiter((g for g, _ in kinds), dtype=np.int64, count=len(kinds))
        s = Stretches(gram, [t for _, t in kinds], which, doc)
        # A stretch that nobody else has, of a gram that no other stretch has, holds nothing that is repeated.
        _, at, often = np.unique(gram, return_inverse=True, return_counts=True)
        bound, kind, start, size = s.judged(np.flatnonzero(s.several | (often[at] > 1)))
        late = doc > bound[which]
        out = _marks(plan, doc[late], who[late], lo[late], s.size[which[late]])
        early = np.flatnonzero(~late & (doc == s.least[which]))
        early = early[np.argsort(which[early], kind="stable")]  # the places of each kind in its smallest document
        first, last = np.searchsorted(which[early], kind, side="left"), np.searchsorted(which[early], kind, side="right")
        own = early[np.concatenate([np.arange(x, y) for x, y in zip(first, last, strict=True)])] if len(kind) else early[:0]
        start, size = np.repeat(start, last - first), np.repeat(size, last - first)
        return out + _marks(plan, doc[own], who[own], lo[own] + start, size)

    return reduce


def _portions(gram: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Positions in portions of about SORTED bytes; ``gram`` is sorted, and equal grams stay in one portion."""
    if not len(gram):
        return []
    new = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    ends = np.cumsum(size)[np.r_[new[1:] - 1, len(gram) - 1]]
    portion = np.repeat(ends // SORTED, np.diff(np.r_[new, len(gram)]))
    return np.split(np.arange(len(gram)), np.flatnonzero(portion[1:] != portion[:-1]) + 1)


def covered_stretches(docs: DataFrame, plan: A.Plan, ws: Workspace) -> DataFrame:
    """Packed marks: document, start and size of what strings of smaller documents cover."""
    hits = A.saved(ws, A.gather(A.post(docs, plan, least_anchors), plan, A.repeated(plan)), "hits")
    stretches = A.meet(docs, hits, plan).mapInArrow(_stretches(plan, A.hot_anchors(hits)), A.PACKED)
    marks = A.saved(ws, A.gather(stretches, plan, _settle(plan)), "marks")
    ws.drop("hits")
    return marks


def dedup(docs: DataFrame, *, texts: bool = False, plan: A.Plan | None = None) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``; with ``texts`` also what is left as binary ``kept``."""
    docs = A.prepared(docs)
    plan = plan or A.Plan(docs)
    marks = covered_stretches(docs, plan, Workspace(docs.sparkSession, "suffix"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in A.marked(batches, "<i8", "<u8", "<i4", "<i4"):
            out = []
            for doc, text, found in group:
                raw = (text or "").encode("utf-8", "surrogatepass")
                starts, sizes = A.own_marks(raw, *found)
                kept, spans = raw, 0
                if len(starts):
                    edge = np.zeros(len(raw) + 1, dtype=np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + sizes, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
                out.append((doc, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            doc, n, gone, spans, sha, kept = zip(*out, strict=True)
            cols = [*(pa.array(c, pa.int64()) for c in (doc, n, gone, spans)), pa.array(sha, pa.string()), *([pa.array(kept, pa.binary())] if texts else [])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])])

    return A.meet(docs, marks, plan).mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
