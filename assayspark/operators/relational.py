"""Filters, lookups, facets, pages, orders and set operations of the library and molecule views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import accumulate
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayspark.scratch import kept

#: Rows of a page: least, most, usual.
PAGE_SIZES = (1, 10_000, 50)
#: Rows that the client takes at once for its own filters and orders.
CLIENT_ROWS = 10_000


def where_equal(df: DataFrame, **values: Any) -> DataFrame:
    """Rows with these values; a value that is None or ``all`` doesn't filter."""
    for name, v in values.items():
        if v is not None and v != "all":
            df = df.where(F.col(name) == F.lit(v))
    return df


def where_range(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows within bounds; any bound leaves out nulls."""
    if low is not None:
        df = df.where(F.col(column) >= low)
    return df if high is None else df.where(F.col(column) <= high)


def where_contains(df: DataFrame, query: str, columns: Sequence[str]) -> DataFrame:
    """Rows with the query as a plain substring of any of the columns, in any case; no wildcards."""
    hit = [F.lower(F.col(c)).contains(query.lower()) for c in columns]
    return df.where(reduce(lambda a, b: a | b, hit))


def where_any_key(df: DataFrame, keys: Sequence[Any] | DataFrame, column: str) -> DataFrame:
    """Rows with one of the keys: a list goes into the filter, a table into a semi join."""
    if isinstance(keys, DataFrame):
        return df.join(keys.select(F.col(keys.columns[0]).alias("_key")), F.col(column) == F.col("_key"), "left_semi")
    return df.where(F.col(column).isin(list(keys)))


def lookup_either(df: DataFrame, value: Any, columns: Sequence[str], key: str) -> DataFrame:
    """The first row by key that has the value in one of the columns."""
    hit = reduce(lambda a, b: a | b, [F.col(c) == F.lit(value) for c in columns])
    return df.where(hit).orderBy(key).limit(1)


def facets(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts by value of each column and the total, in one pass over the data: ``facet``, ``value``, ``n``."""
    sets = df.groupingSets([[c] for c in columns] + [[]], *columns).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    bits = {(1 << len(columns)) - 1 - (1 << (len(columns) - 1 - k)): c for k, c in enumerate(columns)}
    facet = F.lit("total")
    value = F.lit(None).cast("string")
    for g, c in bits.items():
        facet = F.when(F.col("g") == g, F.lit(c)).otherwise(facet)
        value = F.when(F.col("g") == g, F.col(c).cast("string")).otherwise(value)
    return sets.select(facet.alias("facet"), value.alias("value"), "n")


def zero_filled(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Counts of all the keys, 0 for those that don't occur; other values are left out."""
    counts = df.where(F.col(column).isin(list(keys))).groupBy(column).agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(k,) for k in keys], f"{column} string")
    return every.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = PAGE_SIZES[2]) -> DataFrame:
    """One page in the given order (which ends with a key) with the number of all rows as ``total``."""
    size = min(max(size, PAGE_SIZES[0]), PAGE_SIZES[1])
    rows = df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)
    return rows.withColumn("total", df.agg(F.count("*")).scalar())


def ranked(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """All rows with their place from 1 in an order, which ends with a key.

    Ranges of the order are sorted each on its own; a place is that in its range after the rows of the ranges
    before, so no task holds all rows. Only the sizes of the ranges go to the driver.
    """
    # The id counts the rows of a range from its number times 2^33; the saved table keeps ranges as they are counted.
    rows = kept(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    sizes = rows.groupBy(F.shiftright("_at", 33).alias("_r")).agg(F.count("*").alias("_n")).collect()  # a row for each range
    before = dict(zip((r["_r"] for r in sorted(sizes)), accumulate((r["_n"] for r in sorted(sizes)), initial=0), strict=False))
    starts = df.sparkSession.createDataFrame(list(before.items()), "_r long, _start long")
    placed = rows.withColumn("_r", F.shiftright("_at", 33)).join(F.broadcast(starts), "_r")  # no larger than the number of partitions
    return placed.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_r", "_start")


def text_order(column: str, ascending: bool, key: str, collation: str = "UNICODE") -> list[Column]:
    """The order of a table's text column as a reader of a language expects it: letters before accents before case, null as in :func:`client_order`."""
    c = F.collate(F.col(column), collation)
    return [c.asc_nulls_last() if ascending else c.desc_nulls_first(), F.col(key).asc()]


def client_order(column: str, ascending: bool, key: str) -> list[Column]:
    """The client's order: null last ascending, first descending, then the key."""
    first = F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_first()
    return [first, F.col(key).asc()]


def status_rank(column: str, order: Sequence[str]) -> Column:
    """Place of a status in a fixed order, unknown ones last."""
    out = F.lit(len(order))
    for k, s in reversed(list(enumerate(order))):
        out = F.when(F.col(column) == s, k).otherwise(out)
    return out


def one_per_key(new: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """One row for each key: the last by ``order``, and among equals the greatest by all columns, whatever the partitions are."""
    rest = [c for c in new.columns if c not in keys]
    first = [order] if order else []
    if not rest:
        return new.distinct()
    best = F.max(F.struct(*first, *[c for c in rest if c not in first]))
    return new.groupBy(*keys).agg(best.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(new.columns)


def insert_or_ignore(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Base and those new rows, one for each key (:func:`one_per_key`), whose key it lacks."""
    return base.unionByName(one_per_key(new, keys).join(base.select(*keys), list(keys), "left_anti").select(base.columns))


def upsert_keep_first(base: DataFrame, new: DataFrame, key: str, keep: Sequence[str]) -> DataFrame:
    """All keys of both; columns in ``keep`` stay as they were where they were set, the others take the new value."""
    b, n = base.alias("b"), one_per_key(new, [key]).alias("n")
    cols = [F.coalesce(f"b.{key}", f"n.{key}").alias(key)]
    for c in base.columns:
        if c != key:
            cols.append(F.coalesce(f"b.{c}", f"n.{c}").alias(c) if c in keep or c not in new.columns else F.coalesce(f"n.{c}", f"b.{c}").alias(c))
    return b.join(n, F.col(f"b.{key}") == F.col(f"n.{key}"), "full_outer").select(cols)


def patch(base: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows with the non-null values of the changes; a patch can't set null.

    Of several changes of a key the last by ``order`` that sets a value counts for each column, without an order the greatest value.
    """
    last = lambda x: F.max_by(x, F.when(F.col(x).isNotNull(), F.struct(order, x))) if order else F.max(x)
    c = changes.groupBy(F.col(key).alias("_key")).agg(*[last(x).alias(f"_{x}") for x in changes.columns if x not in (key, order)])
    cols = [F.coalesce(f"_{x}", x).alias(x) if x not in (key, order) and x in changes.columns else F.col(x) for x in base.columns]
    return base.join(c, F.col(key) == F.col("_key"), "left").select(cols)


def replace(base: DataFrame, new: DataFrame, key: str, defaults: Mapping[str, Any], order: str | None = None) -> DataFrame:
    """Whole rows replaced by key: columns that the new rows don't name go back to their defaults; one row for each key (:func:`one_per_key`)."""
    types = dict(base.dtypes)
    new = one_per_key(new, [key], order)
    full = new.select(*[F.col(c) if c in new.columns else F.lit(defaults.get(c)).cast(types[c]).alias(c) for c in base.columns])
    return base.join(new.select(key), key, "left_anti").select(base.columns).unionByName(full)


def enqueue(files: DataFrame, queue: DataFrame) -> DataFrame:
    """Files that aren't queued yet, once each."""
    return one_per_key(files, ["file_path"]).join(queue.select("file_path"), "file_path", "left_anti")


def new_by_digest(incoming: DataFrame, stored: DataFrame, order: str) -> DataFrame:
    """Incoming rows whose digest isn't stored, the first by ``order`` of each digest."""
    fresh = incoming.join(stored.select("md5").distinct(), "md5", "left_anti")
    return fresh.groupBy("md5").agg(F.min_by(F.struct(*[c for c in incoming.columns if c != "md5"]), order).alias("r")).select("md5", "r.*")


def top_per_group(df: DataFrame, group: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group with their place and the size of the group.

    The size comes from a pre-aggregated count, so a group isn't sorted to be counted; Spark keeps only
    ``n`` rows of a group before the shuffle.
    """
    total = df.groupBy(group).agg(F.count("*").alias("total"))
    place = F.row_number().over(W.partitionBy(group).orderBy(*order))
    top = df.withColumn("place", place).where(F.col("place") <= n)
    return top.join(total, group)
