"""Language identification by prediction by partial matching under frozen statistics.

For each language a tree of byte contexts up to ``ORDER`` bytes long holds how often each byte followed
each context. A byte is coded in its longest known context if it was seen there (count over total plus
number of kinds), else an escape (kinds over total plus kinds) is paid and the next shorter context
codes it, with the bytes that were seen in the longer one excluded from its counts; the last resort is
even odds over the bytes that no context excludes. The tree is frozen after learning, so a gram always
costs the same: its code length is looked up, not simulated, and a text's code length in a language is
the exact sum of its grams' costs. The language with the shortest code is predicted.

Counts cover all training documents, and every context counts, however many there are. What a worker
holds at once is bounded all the same: a model of many grams comes in parts by the last two context bytes,
as a gram's cost depends on its part and on the counts under the last byte only. The texts go past each
part, and a text's code length is the sum over the parts.

Defined cases: null text or a text without a letter is ``und`` with score 0; null lang, null doc_id and
empty texts teach nothing; a null doc_id is reported as held out; ties go to the language that is first
in code point order; repeated rows get equal results; nothing learned makes every text ``und``; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, crc_mod, small_batches, table

#: Bytes of context.
ORDER = 3
#: Costs (distinct grams times languages) in one part of the model; more grams make more parts.
PART_COSTS = 8 << 20
#: Bytes of text whose grams are counted or scored at once.
BLOCK = 4 << 20
#: Before a text stand line ends.
START = b"\n" * ORDER


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The (ORDER + 1)-byte gram that ends at each byte of the texts, as numbers, and the texts' lengths."""
    raw = np.frombuffer(b"".join(START + t for t in texts), dtype=np.uint8).astype(np.uint32)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    code = raw[ORDER:].copy() if len(raw) else raw
    for k in range(ORDER):
        code |= raw[k : len(raw) - ORDER + k] << np.uint32(8 * (ORDER - k))
    ends = np.cumsum(sizes + ORDER)
    # The grams that end in the padding of the next text are left out.
    use = np.ones(len(code), dtype=bool)
    for k in range(ORDER):
        at = ends[:-1] - ORDER + k
        use[at[at < len(use)]] = False
    return code[use], sizes


def _blocks(texts: list[bytes]) -> Iterator[list[int]]:
    """Runs of texts of about BLOCK bytes."""
    run, n = [], 0
    for k, t in enumerate(texts):
        run.append(k)
        n += len(t)
        if n >= BLOCK:
            yield run
            run, n = [], 0
    if run:
        yield run


class Tree:
    """One language's frozen context tree."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, below: tuple[int, np.ndarray, np.ndarray] | None = None) -> None:
        """``codes``: sorted distinct grams of full length, ``counts``: how often they occurred.

        Where these aren't all, ``below`` has an order and all grams of that order, sorted, with their counts.
        """
        self.levels = []  # for each order, longest first: grams, counts, contexts, totals, kinds, what the longer level excludes
        grams_, n = codes.astype(np.uint64), counts.astype(np.float64)
        for order in range(ORDER, -1, -1):
            contexts, at = np.unique(grams_ >> np.uint64(8), return_inverse=True)
            total = np.bincount(at, weights=n, minlength=len(contexts))
            kinds = np.bincount(at, minlength=len(contexts)).astype(np.float64)
            self.levels.append({"grams": grams_, "n": n, "contexts": contexts, "total": total, "kinds": kinds})
            if order:
                short, at = np.unique(grams_ & np.uint64((1 << 8 * order) - 1), return_inverse=True)
                grams_, n = short, np.bincount(at, weights=n, minlength=len(short))
            if below and order - 1 == below[0]:
                grams_, n = below[1].astype(np.uint64), below[2].astype(np.float64)
        for longer, shorter, order in zip(self.levels, self.levels[1:], range(ORDER, 0, -1), strict=False):
            self._exclude(longer, shorter, order)

    @staticmethod
    def _exclude(longer: dict, shorter: dict, order: int) -> None:
        """For each longer context the shorter level's counts of the bytes that were seen in it."""
        short = np.searchsorted(shorter["grams"], longer["grams"] & np.uint64((1 << 8 * order) - 1))
        at = np.searchsorted(longer["contexts"], longer["grams"] >> np.uint64(8))
        longer["out"] = np.bincount(at, weights=shorter["n"][short], minlength=len(longer["contexts"]))

    def cost(self, codes: np.ndarray) -> np.ndarray:
        """Bits for each gram of full length."""
        bits, open_ = np.zeros(len(codes)), np.ones(len(codes), dtype=bool)
        codes = codes.astype(np.uint64)
        gone_n, gone_k = np.zeros(len(codes)), np.zeros(len(codes))  # excluded counts and kinds
        for order, level in zip(range(ORDER, -1, -1), self.levels, strict=True):
            if not len(level["contexts"]):
                continue
            mine = codes & np.uint64((1 << 8 * (order + 1)) - 1)
            ctx, has_ctx = _find(level["contexts"], mine >> np.uint64(8))
            gram, has = _find(level["grams"], mine)
            total, kinds = level["total"][ctx] - gone_n, level["kinds"][ctx] - gone_k
            here = open_ & has_ctx & has
            bits[here] += np.log2((total + kinds)[here] / level["n"][gram][here])
            open_ &= ~here
            # Nothing is left to be escaped from where all kinds are excluded.
            esc = open_ & has_ctx & (kinds > 0)
            bits[esc] += np.log2((total + kinds)[esc] / kinds[esc])
            known = open_ & has_ctx
            gone_k[known] = level["kinds"][ctx][known]
            gone_n[known] = level["out"][ctx][known] if "out" in level else 0
        bits[open_] += np.log2(np.maximum(256 - gone_k[open_], 1))
        return bits


def _find(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(of), dtype=np.int64), np.zeros(len(of), dtype=bool)
    at = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
    return at, keys[at] == of


class Frozen:
    """Costs of all known grams in every language, in an open table that whole arrays are looked up in.

    A part of a model has the grams whose last two context bytes lie in ``ends`` (both included).
    """

    def __init__(self, trees: dict[str, Tree], ends: tuple[int, int] | None = None) -> None:
        self.ends = ends
        self.langs, self.trees = sorted(trees, key=lambda x: x.encode()), trees
        known = np.unique(np.concatenate([t.levels[0]["grams"] for t in trees.values()])) if trees else np.zeros(0, np.uint64)
        self.keys = known.astype(np.uint32)
        self.costs = np.stack([trees[x].cost(self.keys) for x in self.langs], axis=1).astype(np.float32) if trees else np.zeros((0, 0), np.float32)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(known)) * 4))))
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        todo, at = np.arange(len(known)), self._slot(self.keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]  # of several for one slot the last stays
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint32(2654435769)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def lookup(self, codes: np.ndarray) -> np.ndarray:
        """Costs (a row for each gram, a column for each language)."""
        at = self._slot(codes)
        got = self.slots[at]
        bad = np.flatnonzero((got >= 0) & (self.keys[got] != codes))
        while len(bad):
            at[bad] = (at[bad] + 1) & ((1 << self.bits) - 1)
            got[bad] = self.slots[at[bad]]
            bad = bad[(got[bad] >= 0) & (self.keys[got[bad]] != codes[bad])]
        out = self.costs[got]
        new = np.flatnonzero(got < 0)
        if len(new):
            distinct, at = np.unique(codes[new], return_inverse=True)
            out[new] = np.stack([self.trees[x].cost(distinct) for x in self.langs], axis=1).astype(np.float32)[at]
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language, in bits; of a part, what its grams cost."""
        out = np.zeros((len(texts), len(self.langs)))
        for run in _blocks(texts):
            codes, sizes = grams([texts[k] for k in run])
            where = np.repeat(np.arange(len(run)), sizes)
            if self.ends:
                end = (codes >> np.uint32(8)) & np.uint32(0xFFFF)
                own = (end >= self.ends[0]) & (end <= self.ends[1])
                codes, where = codes[own], where[own]
            costs = self.lookup(codes)
            for j in range(len(self.langs)):
                out[run, j] = np.bincount(where, weights=costs[:, j], minlength=len(run))
        return out


def count_grams(docs: DataFrame) -> DataFrame:
    """``lang``, ``code``, ``n``: grams of full length in all training documents, summed up in each task first."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column("lang").to_pylist()
            texts = [t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                for run in _blocks(own):
                    codes, n = np.unique(grams([own[k] for k in run])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])

    taught = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text")
    return taught.mapInArrow(work, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


class Parts:
    """A model whose grams are too many to be held at once: its parts are frozen one after the other."""

    def __init__(self, counts: DataFrame, langs: list[str], ends: list[tuple[int, int]], below: dict[str, tuple[int, np.ndarray, np.ndarray]]) -> None:
        self.counts, self.langs, self.ends, self.below = counts, langs, ends, below

    def __iter__(self) -> Iterator[Frozen]:
        for ends in self.ends:
            own = self.counts.where(_end().between(*ends)).toPandas()
            yield Frozen({x: Tree(*_column(own, x), self.below[x]) for x in self.langs}, ends)


def _end() -> Column:
    """The last two context bytes of a gram."""
    return F.shiftright("code", 8).bitwiseAND(0xFFFF)


def _column(rows: pd.DataFrame, lang: str) -> tuple[np.ndarray, np.ndarray]:
    """One language's grams in order, and their counts."""
    own = rows[rows.lang == lang].sort_values("code")
    return own.code.to_numpy(np.int64), own.n.to_numpy(np.int64)


def _shorter(counts: DataFrame, order: int) -> pd.DataFrame:
    """Counts of all grams with ``order`` bytes of context."""
    return counts.groupBy("lang", F.col("code").bitwiseAND((1 << 8 * (order + 1)) - 1).alias("code")).agg(F.sum("n").alias("n")).toPandas()


def learn(docs: DataFrame, max_grams: int | None = None, part_costs: int = PART_COSTS) -> Frozen | Parts:
    """Freeze the trees of all languages in ``docs``, in parts if they have more than ``part_costs`` costs.

    With ``max_grams``, which no query gives, a language knows its most frequent contexts of full length only,
    in whole count classes; the shorter contexts' counts are whole.
    """
    ws = Workspace(docs.sparkSession, "langid")
    counts = ws.save(count_grams(docs), "counts")
    langs = [r["lang"] for r in counts.select("lang").distinct().collect()]
    if max_grams is not None:
        return _cut(counts, langs, max_grams)
    # How many grams each of the 65536 ends has; the parts are runs of ends.
    sizes = counts.select("code").distinct().groupBy(_end().alias("end")).agg(F.count("*").alias("n")).orderBy("end").collect()
    first, held = [0], 0
    for r in sizes:
        if held and (held + r["n"]) * len(langs) > part_costs:
            first.append(r["end"])
            held = 0
        held += r["n"]
    if len(first) == 1:
        whole = counts.toPandas()
        ws.drop("counts")
        return Frozen({x: Tree(*_column(whole, x)) for x in langs})
    short = _shorter(counts, 1)
    return Parts(counts, langs, [(a, z - 1) for a, z in zip(first, [*first[1:], 1 << 16], strict=True)], {x: (1, *_column(short, x)) for x in langs})


def _cut(counts: DataFrame, langs: list[str], max_grams: int) -> Frozen:
    counts = counts.withColumn("context", F.shiftright("code", 8))
    per = counts.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    classes = per.groupBy("lang", F.floor(F.log2("total")).alias("class")).agg(F.sum("kinds").alias("grams")).collect()
    least = {}
    for lang in langs:
        n, least[lang] = 0, 0
        for k, g in sorted(((r["class"], r["grams"]) for r in classes if r["lang"] == lang), reverse=True):
            n += g
            if n > max_grams:
                least[lang] = 2 ** (k + 1)
                break
    if not least:
        return Frozen({})
    floor = F.create_map(*[x for lang, v in least.items() for x in (F.lit(lang), F.lit(v))])
    top = counts.join(per.where(F.col("total") >= floor[F.col("lang")]).select("lang", "context"), ["lang", "context"]).toPandas()
    short = _shorter(counts, ORDER - 1)
    return Frozen({x: Tree(*_column(top, x), (ORDER - 1, *_column(short, x))) for x in langs})


def _encoded(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _best(bits: np.ndarray, langs: list[str], letters: list[bool]) -> tuple[list[str], list[float]]:
    """Language and score by the code lengths (a row for each text)."""
    if not langs or not len(letters):
        return ["und"] * len(letters), [0.0] * len(letters)
    best = bits.argmin(axis=1)
    share = 1 / np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000)).sum(axis=1)
    return [langs[k] if ok else "und" for k, ok in zip(best, letters, strict=True)], [float(s) if ok else 0.0 for s, ok in zip(share, letters, strict=True)]


def identify(docs: DataFrame, model: Frozen | Parts) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score``: the best language's share of two to the minus code length."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if isinstance(model, Parts):
        return _identify_by_parts(rows, model, kind)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            letters = b.column("letters").to_pylist()
            bits = own.lengths(_encoded(b.column("text"))) if own.langs and letters else np.zeros((0, 0))
            lang, score = _best(bits, own.langs, letters)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(work, f"doc_id {kind}, lang_pred string, score double")


def _identify_by_parts(rows: DataFrame, model: Parts, kind: str) -> DataFrame:
    """The texts go past each part; code lengths are added up by id and digest of the text, so equal rows stay equal."""
    spark = rows.sparkSession
    ws = Workspace(spark, "langid-bits")
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))
    tables = []
    for k, part in enumerate(model):
        shared = spark.sparkContext.broadcast(part)

        def work(batches: Iterator[pa.RecordBatch], shared=shared, k=k) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bits = shared.value.lengths(_encoded(b.column("text")))
                cols = [b.column("doc_id"), b.column("digest"), b.column("letters"), pa.array([k] * len(bits), pa.int32()), pa.array(bits.tolist(), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "digest", "letters", "part", "bits"])

        tables.append(ws.save(rows.mapInArrow(work, f"doc_id {kind}, digest binary, letters boolean, part int, bits array<double>"), f"part-{k}"))
        shared.destroy()
    each = reduce(DataFrame.union, tables).groupBy("doc_id", "digest", "part").agg(F.first("bits").alias("bits"), F.first("letters").alias("letters"), F.count("*").cast("int").alias("n"))
    full = each.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_list(F.struct("part", "bits"))).alias("parts"), F.first("letters").alias("letters"), F.first("n").alias("n"))
    langs = sorted(model.langs, key=lambda x: x.encode())

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = np.array([np.sum(x, axis=0) for x in b.column("bits").to_pylist()])
            lang, score = _best(bits, langs, b.column("letters").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "n", "lang_pred", "score"])

    found = full.select("doc_id", "letters", "n", F.col("parts.bits").alias("bits")).mapInArrow(choose, f"doc_id {kind}, n int, lang_pred string, score double")
    return found.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("n")))).drop("copy", "n")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(True))
    model = learn(docs.where(~held).select("lang", "text"))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
