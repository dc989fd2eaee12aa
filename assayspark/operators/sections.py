"""Text structure: lines, pages, sections, tables, density classes, line clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from assayspark.functions import text as T


def lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``line_no`` from 0, ``line``: a row for each line."""
    return docs.select(key, F.posexplode(T.lines_of(F.col("text"))).alias("line_no", "line"))


def carried(rows: DataFrame, value: Column, key: str = "doc_id", order: str = "line_no", name: str = "carried") -> DataFrame:
    """The last non-null value at or before each row: an as-of join without a join."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def page_of(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, T.PAGE_MARKER, 1), F.lit("")).try_cast("int")


def is_row(line: Column) -> Column:
    """A line that starts and ends with a bar."""
    s = T.strip(line)
    return s.startswith("|") & s.endswith("|")


def is_separator(line: Column) -> Column:
    """A separator row; alignment colons are accepted."""
    return T.strip(line).rlike(r"^\|[-:| ]+\|$")


def runs(rows: DataFrame, flag: Column, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """Rows for which the flag holds, numbered by run (``run`` from 1) within the key."""
    w = W.partitionBy(key).orderBy(order)
    marked = rows.withColumn("_on", F.coalesce(flag, F.lit(False)))
    start = F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False))
    return marked.withColumn("run", F.sum(start.cast("int")).over(w)).where("_on").drop("_on")


def tables(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``table_idx`` from 0, ``table_text``, ``page_num``: runs of rows with the page they stand on."""
    rows = carried(lines(docs, key), page_of(F.col("line")), key, name="page_num")
    found = runs(rows, is_row(F.col("line")), key)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    return found.groupBy(key, (F.col("run") - 1).alias("table_idx")).agg(F.array_join(parts, "\n").alias("table_text"), F.min_by("page_num", "line_no").alias("page_num"))


def table_rows(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of tables with ``row_idx`` from 1, the header counted and separators skipped, and ``cells``."""
    rows = found.select(key, "table_idx", F.posexplode(T.lines_of(F.col("table_text"))).alias("_at", "line")).where(~is_separator(F.col("line")))
    w = W.partitionBy(key, "table_idx").orderBy("_at")
    return rows.select(key, "table_idx", F.row_number().over(w).alias("row_idx"), T.cells(F.col("line")).alias("cells"))


def located(records: DataFrame, rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Records with the row of their label (or string) and the column of their value in their table.

    ``records``: key, ``rec_id``, ``table_idx``, ``row_label``, ``row_smiles``, ``value_original``.
    """
    head = F.try_element_at("cells", F.lit(1))
    keyed = rows.where(head.isNotNull()).select(key, "table_idx", "row_idx", "cells", F.explode(F.array(F.concat(F.lit("l"), F.lower(F.trim(head))), F.concat(F.lit("s"), head))).alias("_h"))
    # A row is met by what it begins with, so a table's rows never meet all of its records.
    by = F.array_compact(F.array(F.concat(F.lit("l"), F.lower(F.trim("row_label"))), F.concat(F.lit("s"), F.trim("row_smiles"))))
    wanted = records.where(F.col("row_label").isNotNull()).select(key, "rec_id", "table_idx", "value_original", F.explode(by).alias("_h"))
    marks = F.transform("cells", lambda c: T.number_matches(c, F.col("value_original").cast("double")))
    col = F.array_position(marks, True)
    best = F.min(F.struct("row_idx", F.when(col > 0, col - 1).cast("int").alias("col_idx")))
    at = wanted.join(keyed, [key, "table_idx", "_h"]).groupBy(key, "rec_id").agg(best.alias("_at"))
    return records.join(at, [key, "rec_id"], "left").select(*records.columns, F.col("_at.row_idx").alias("row_idx"), F.col("_at.col_idx").alias("col_idx"))


def density_class(n_ocr: Column, n_pages: Column) -> Column:
    """The class of a document by how many of its pages must be recognised."""
    return F.when(n_ocr == 0, "text_only").when(n_ocr == n_pages, "image_only").otherwise("mixed")


def density(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pages, characters and pages to be recognised of each document, and its class.

    ``pages`` has ``text`` and ``needs_ocr``; text that recognition brought counts as text.
    """
    out = pages.groupBy(key).agg(
        F.count("*").alias("n_pages"), F.sum(F.col("needs_ocr").cast("long")).alias("n_ocr"), F.sum(F.length("text")).cast("long").alias("n_text")
    )
    kind = density_class(F.col("n_ocr"), F.col("n_pages"))
    return out.select(key, "n_pages", "n_ocr", "n_text", (F.col("n_text") / F.col("n_pages")).alias("avg_text"), kind.alias("doc_kind"))


def page_needed(df: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Pages that a detector should see: not those full of native text without an image."""
    df = df.where(~((F.length("text") > 500) & ~F.col("has_images")))
    return df if max_pages is None else df.where(F.col("page_num") <= max_pages)


def page_markdown(page_num: Column, text: Column) -> Column:
    """A page's rough markdown: its marker, then its lines with headings promoted."""
    body = F.filter(F.transform(T.lines_of(text), T.rough_line), lambda x: x.isNotNull())
    return F.array_join(F.concat(F.array(F.format_string("<!-- PAGE %d -->", page_num)), body, F.array(F.lit(""))), "\n")


def rough_markdown(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """One markdown text for each document: page markers and promoted headings, pages in order."""
    parts = pages.select(key, "page_num", page_markdown(F.col("page_num"), F.col("text")).alias("md"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_num", "md"))), lambda x: x["md"])
    return parts.groupBy(key).agg(F.array_join(ordered, "\n").alias("markdown"))


def page_ranges(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines of each page: ``page_num``, ``start`` and ``end`` (the next marker, or the number of lines)."""
    w = W.partitionBy(key).orderBy("line_no")
    total = rows.groupBy(key).agg((F.max("line_no") + 1).alias("n"))
    marks = rows.withColumn("page_num", page_of(F.col("line"))).where("page_num IS NOT NULL")
    return marks.withColumn("next", F.lead("line_no").over(w)).join(total, key).select(key, "page_num", F.col("line_no").alias("start"), F.coalesce("next", "n").alias("end"))


def packed_chunks(segments: DataFrame, budget: int = 6000) -> DataFrame:
    """``chunk`` from 0 for each segment: greedily filled up to a budget of tokens; needs the order, so by document."""
    own = F.transform(F.array_sort(F.collect_list(F.struct("seg_no", "tokens"))), lambda x: F.struct(x["seg_no"].cast("int").alias("seg_no"), x["tokens"].cast("long").alias("tokens")))
    return packed(segments.groupBy("doc_id").agg(own.alias("s")).select("doc_id", F.col("s.seg_no").alias("seg_no"), F.col("s.tokens").alias("tokens")), budget)


def packed(docs: DataFrame, budget: int = 6000) -> DataFrame:
    """``doc_id``, ``seg_no``, ``tokens``, ``chunk``: as :func:`packed_chunks`, of documents whose segments are at hand, with no shuffle.

    ``docs``: doc_id, ``tokens`` (a list in order), and ``seg_no`` (as long), or places from 0 without it.
    """
    columns = ["doc_id", "tokens", *(["seg_no"] if "seg_no" in docs.columns else [])]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                b = whole.slice(first, 500)
                out, places = [], []
                for tokens in b.column("tokens").to_pylist():
                    chunk, used = 0, 0
                    for n in tokens or ():
                        if used and used + (n or 0) > budget:
                            chunk, used = chunk + 1, 0
                        used += n or 0
                        out.append(chunk)
                    places.extend(range(len(tokens or ())))
                doc = b.column("doc_id").take(pc.list_parent_indices(b.column("tokens")))
                number = pa.array(places, pa.int32()) if len(columns) == 2 else pc.list_flatten(b.column("seg_no"))
                yield pa.RecordBatch.from_arrays([doc, number, pc.list_flatten(b.column("tokens")), pa.array(out, pa.int32())], names=["doc_id", "seg_no", "tokens", "chunk"])

    return docs.select(*columns).mapInArrow(pack, "doc_id long, seg_no int, tokens long, chunk int")


def _cut(text: str, size: int, overlap: int) -> list[str]:
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            for mark in ("\n", "。", " "):
                at = text.rfind(mark, start, end)
                if at > start + size // 2:
                    end = at + 1
                    break
        out.append(text[start:end].strip())
        nxt = max(0, end - overlap)
        if nxt >= end or nxt <= start or nxt >= len(text):
            break
        start = nxt
    return [c for c in out if c]


@F.pandas_udf(ArrayType(StringType()))
def character_chunks(texts: pd.Series, size: pd.Series, overlap: pd.Series) -> pd.Series:
    """Chunks of a size with overlap that end after a line, a full stop or a blank in their second half.

    The cutting ends where the next chunk would not start before the end of the last (no overlap) or not further on
    than it (an overlap as long as a chunk).
    """
    return pd.Series([_cut(t or "", int(s), int(o)) for t, s, o in zip(texts, size, overlap, strict=True)])


#: Characters of chunks that a task hands on at a time.
HANDED = 1 << 20


def chunk_rows(docs: DataFrame, size: int, overlap: int, key: str = "doc_id") -> DataFrame:
    """Key, ``chunk_no``, ``chunk``: :func:`character_chunks` as rows. A task holds one text's chunks and HANDED characters, not those of a batch."""
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owners, numbers, chunks, held = [], [], [], 0
            for row in range(b.num_rows):
                found = _cut(b.column(1)[row].as_py() or "", size, overlap)
                owners.extend([row] * len(found))
                numbers.extend(range(len(found)))
                chunks.extend(found)
                held += sum(map(len, found))
                if chunks and (held >= HANDED or row == b.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owners)), pa.array(numbers, pa.int32()), pa.array(chunks, pa.string())], names=[key, "chunk_no", "chunk"])
                    owners, numbers, chunks, held = [], [], [], 0

    return docs.select(key, "text").mapInArrow(cut, f"{key} {kind}, chunk_no int, chunk string")


def line_clusters(items: DataFrame, gap: float = 6.0) -> DataFrame:
    """Text items of a page in lines: an item starts a line if it is more than ``gap`` from the line's first.

    The rule looks back to the first item of a line, so it needs the items of a page in order.
    """

    def group(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["y", "x", "item_no"], ascending=[False, True, True], kind="stable")
        line, first, out = 0, None, []
        for y in part.y:
            if first is None:
                first = y
            elif abs(y - first) > gap:
                line, first = line + 1, y
            out.append(line)
        return part.assign(line=out)[["page_id", "item_no", "line"]]

    return items.select("page_id", "item_no", "x", "y").groupBy("page_id").applyInPandas(group, "page_id long, item_no long, line int")


def content_stream(text_lines: DataFrame, molecules: DataFrame) -> DataFrame:
    """Text lines and molecules of a page together, from the top down; text first where both are equally high."""
    a = text_lines.select("page_id", F.lit("text").alias("kind"), "y", F.col("text").alias("content"))
    b = molecules.select("page_id", F.lit("molecule").alias("kind"), F.coalesce("y", F.lit(0.0)).alias("y"), F.col("smiles").alias("content"))
    w = W.partitionBy("page_id").orderBy(F.desc("y"), F.desc("kind"), "content")
    return a.unionByName(b).withColumn("position", F.row_number().over(w))


def ocr_chain(pages: DataFrame, backends: list[str]) -> Column:
    """The first non-blank of ordered recognition results."""
    return F.coalesce(*[F.when(T.strip(F.col(b)) != "", F.col(b)) for b in backends], F.lit(""))


def recognised(pages: DataFrame, backends: Sequence[Callable[[list], list[str]]], image: str = "image", size: int = 8) -> DataFrame:
    """Pages with ``text`` filled by recognition where it is blank: each backend in turn gets those still blank, at most ``size`` at once.

    A backend that raises leaves its batch blank for the next one. Only pages without text are sent; null images never are.
    """
    at_text, at_image = pages.columns.index("text"), pages.columns.index(image)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [t if isinstance(t, str) and t.strip(T.BLANK) else "" for t in f.iloc[:, at_text]]
            images = list(f.iloc[:, at_image])
            for backend in backends:
                blank = [k for k, t in enumerate(texts) if not t and images[k] is not None]
                for first in range(0, len(blank), size):
                    some = blank[first : first + size]
                    try:
                        got = backend([images[k] for k in some])
                    except Exception:  # noqa: BLE001  (a service that fails is no reason to lose the page)
                        continue
                    for k, t in zip(some, got, strict=True):
                        texts[k] = t if t and t.strip(T.BLANK) else ""
            yield f.assign(text=texts)

    return pages.mapInPandas(work, pages.schema)
