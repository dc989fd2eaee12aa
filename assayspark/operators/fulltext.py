"""A positional index and searches over it: phrases, prefixes, first words, nearness, and, or, not.

The index has a row for each word, key and column with the word's places. It is written in segments, each the texts of one task in runs
sorted by word, with no shuffle of words: a search reads from each segment only the row groups that can hold its words or prefixes, and a word that a
third of all texts have lies in as many segments as texts do. Places are written delta-packed. A search is one scan and one shuffle by
key: the rows of its words come together for each text, and phrases, nearness and the rest are evaluated on their lists of places.

Searches are built from :func:`phrase` and :func:`near` with ``&``, ``|`` and ``-`` (but not). Words are folded alike in texts
and searches: lower case, without diacritics, parted at all but letters and digits.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _folding() -> dict[int, str | None]:
    """What ``str.translate`` makes of lower-case text: letters of the Latin blocks without diacritics, no combining marks."""
    out: dict[int, str | None] = {}
    for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00)):
        for c in map(chr, block):
            base = unicodedata.normalize("NFD", c)[0]
            if base != c and base.isalpha():
                out[ord(c)] = base
    return out | {c: None for c in range(0x300, 0x20000) if unicodedata.category(chr(c)).startswith("M")}


#: Runs of letters and digits.
_WORD, _PLAIN_WORD = re.compile(r"[^\W_]+"), re.compile("[a-z0-9]+")


def words(text: str | None) -> list[str]:
    """The folded words of a text, or of what a user has typed, in order; null has none."""
    low = (text or "").lower()
    return _PLAIN_WORD.findall(low) if low.isascii() else _WORD.findall(low.translate(_folding()))


#: Rows of an index that a task makes at a time, that it sorts at a time, and of a file's row group.
HANDED, RUN, GROUP = 100_000, 1_000_000, 50_000


def positional_index(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``word``, key, ``column``, ``places`` (from 0, rising): a row for each word of each text. A null key has none.

    The words of a text come together in the task that reads it, so none is shuffled; rows are handed on in runs of about RUN rows, each sorted by word and key. Of rows with one key the words
    come in rows of their own, so keys should be unique.
    """
    kind = df.schema[key].dataType.simpleString()

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[str] = []
        owners, names, lists = [], [], []  # key and number of words; column and number of words; places of each word

        def handed(keys: pa.DataType) -> pa.RecordBatch:
            sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
            flat = np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(sizes.sum()))
            places = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat))
            own = pa.array([k for k, _ in owners], keys).take(pa.array(np.repeat(np.arange(len(owners)), [n for _, n in owners])))
            column = pa.array(columns, pa.string()).take(pa.array(np.repeat([k for k, _ in names], [n for _, n in names]).astype(np.int64)))
            out = pa.RecordBatch.from_arrays([pa.array(found, pa.string()), own, column, places], names=["word", key, "column", "places"])
            for part in (found, owners, names, lists):
                part.clear()
            return out

        made: list[pa.RecordBatch] = []

        def run() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(made).combine_chunks()
            made.clear()
            order = pc.sort_indices(whole, sort_keys=[("word", "ascending"), (key, "ascending")])
            for first in range(0, len(order), HANDED):
                yield from whole.take(order.slice(first, HANDED)).combine_chunks().to_batches()

        for b in batches:
            for row in range(b.num_rows):
                own = b.column(0)[row].as_py()
                for n, texts in enumerate(b.columns[1:]):
                    places: dict[str, list[int]] = {}
                    for k, word in enumerate(words(texts[row].as_py())):
                        if word in places:
                            places[word].append(k)
                        else:
                            places[word] = [k]
                    found.extend(places)
                    lists.extend(places.values())
                    owners.append((own, len(places)))
                    names.append((n, len(places)))
                if len(found) >= HANDED:
                    made.append(handed(b.schema.field(0).type))
                    if sum(m.num_rows for m in made) >= RUN:
                        yield from run()
            if found:
                made.append(handed(b.schema.field(0).type))
        if made:
            yield from run()

    texts = df.where(F.col(key).isNotNull()).select(key, *(F.col(c).alias(f"_{n}") for n, c in enumerate(columns)))
    return texts.mapInArrow(grouped, f"word string, {key} {kind}, column string, places array<int>")


def write_index(index: DataFrame, key: str, path: str) -> None:
    """Write an index, a segment for each task; more texts can be appended as more segments.

    An index comes in sorted runs, each of several row groups with a range of words, so nothing is sorted and spilled here.
    """
    out = index.write.mode("append").option("parquet.block.row.count.limit", str(GROUP))
    # Places as differences of a few bits each, words by dictionary.
    out = out.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary#places.list.element", "false")
    out.option("compression", "zstd").parquet(path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


class Search:
    """What a text must hold."""

    def __and__(self, other: Search) -> Search:
        return Both("and", self, other)

    def __or__(self, other: Search) -> Search:
        return Both("or", self, other)

    def __sub__(self, other: Search) -> Search:
        return Both("not", self, other)

    def terms(self) -> list[tuple[str, bool]]:
        """Words to be read, and whether they are prefixes."""
        raise NotImplementedError

    def holds(self, hits: Column, columns: Sequence[str]) -> Column:
        """Whether a text with these hits (word, column, places) has it."""
        raise NotImplementedError


@dataclass(frozen=True)
class Phrase(Search):
    """Words in a row; with ``prefix`` the last is the beginning of a word, with ``first`` they begin the column."""

    parts: tuple[str, ...]
    prefix: bool = False
    first: bool = False
    only: tuple[str, ...] | None = None

    def terms(self) -> list[tuple[str, bool]]:
        return [(w, self.prefix and k == len(self.parts) - 1) for k, w in enumerate(self.parts)]

    def starts(self, hits: Column, column: str) -> Column:
        """The places in a column at which the phrase begins."""

        def of(k: int, word: str, prefix: bool) -> Column:
            same = lambda x: (x["word"].startswith(word) if prefix else x["word"] == word) & (x["column"] == column)
            found = F.flatten(F.transform(F.filter(hits, same), lambda x: x["places"]))
            return F.transform(found, lambda p: p - k) if k else found

        begins = reduce(F.array_intersect, (of(k, w, p) for k, (w, p) in enumerate(self.terms())))
        return F.filter(begins, lambda p: p == 0) if self.first else begins

    def within(self, columns: Sequence[str]) -> list[str]:
        return [c for c in columns if self.only is None or c in self.only] if self.parts else []

    def holds(self, hits: Column, columns: Sequence[str]) -> Column:
        return reduce(lambda a, b: a | b, (F.size(self.starts(hits, c)) > 0 for c in self.within(columns)), F.lit(False))


@dataclass(frozen=True)
class Near(Search):
    """Phrases of one column with at most ``distance`` words between the end of the first and the start of the last."""

    phrases: tuple[Phrase, ...]
    distance: int = 10

    def terms(self) -> list[tuple[str, bool]]:
        return [t for p in self.phrases for t in p.terms()]

    def holds(self, hits: Column, columns: Sequence[str]) -> Column:
        if not all(p.parts for p in self.phrases):
            return F.lit(False)
        found = []
        for c in columns:
            if all(c in p.within(columns) for p in self.phrases):
                starts = [p.starts(hits, c) for p in self.phrases]
                for k, first in enumerate(self.phrases):  # every phrase may come first
                    reach = len(first.parts) + self.distance
                    # The places from which a phrase's start is in reach: linear in the places, not in pairs of them.
                    spread = lambda s, reach=reach: F.flatten(F.transform(s, lambda p: F.sequence(p - reach, p)))
                    rest = [spread(s) for n, s in enumerate(starts) if n != k]
                    found.append(F.size(reduce(F.array_intersect, rest, starts[k])) > 0)
        return reduce(lambda a, b: a | b, found, F.lit(False))


@dataclass(frozen=True)
class Both(Search):
    how: str
    left: Search
    right: Search

    def terms(self) -> list[tuple[str, bool]]:
        return self.left.terms() + self.right.terms()

    def holds(self, hits: Column, columns: Sequence[str]) -> Column:
        a, b = self.left.holds(hits, columns), self.right.holds(hits, columns)
        return a & b if self.how == "and" else a | b if self.how == "or" else a & ~b


def phrase(text: str, *, prefix: bool = False, first: bool = False, columns: Sequence[str] | None = None) -> Phrase:
    """The words of ``text`` in a row, in any or one of some columns. A text without a word is in no document."""
    return Phrase(tuple(words(text)), prefix, first, None if columns is None else tuple(columns))


def near(*phrases: Phrase | str, distance: int = 10) -> Near:
    return Near(tuple(phrase(p) if isinstance(p, str) else p for p in phrases), distance)


def all_words(text: str) -> Search:
    """Every word of ``text``, anywhere."""
    parts: list[Search] = [Phrase((w,)) for w in dict.fromkeys(words(text))]
    return reduce(lambda a, b: a & b, parts) if parts else Phrase(())


def matches(index: DataFrame, key: str, searches: dict[str, Search], columns: Sequence[str]) -> DataFrame:
    """``search`` and key of all texts that hold it, for several named searches in one scan and one shuffle."""
    terms = dict.fromkeys(t for s in searches.values() for t in s.terms())
    exact, prefixes = [w for w, p in terms if not p], [w for w, p in terms if p]
    wanted = reduce(lambda a, b: a | b, (F.col("word").startswith(p) for p in prefixes), F.col("word").isin(exact))
    hits = index.where(wanted).groupBy(key).agg(F.collect_list(F.struct("word", "column", "places")).alias("hits"))
    named = F.array(*(F.when(s.holds(F.col("hits"), columns), name) for name, s in searches.items()))
    return hits.select(F.explode(F.array_compact(named)).alias("search"), key)


def search(index: DataFrame, key: str, wanted: Search, columns: Sequence[str], k: int | None = None) -> DataFrame:
    """Keys of texts that hold what is wanted, the first ``k`` by key."""
    out = matches(index, key, {"": wanted}, columns).select(key)
    return out if k is None else out.orderBy(key).limit(k)
