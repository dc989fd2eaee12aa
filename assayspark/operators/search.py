"""Keyword search over documents, an inverted index for molecule search, and the query cache."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayspark.functions import text as T

SNIPPET = 2000
#: Order of the sources of a search.
SOURCES = ("summaries", "sources", "concepts")


def keyword_search(docs: DataFrame, query: str, *, key: str = "doc_id", k: int | None = None, only: Sequence | None = None) -> DataFrame:
    """Documents by relevance: ``doc_id``, ``title``, ``hits``, ``score``, pages and a snippet.

    Unlike a filter on what a search returned, ``only`` goes to the scan. Ties are by key.
    """
    if only is not None:
        docs = docs.where(F.col(key).isin(list(only)))
    # A generator keeps the filter and the columns from counting again.
    out = docs.select("*", F.explode(F.array(T.term_frequency(F.col("text"), query))).alias("hits")).where("hits > 0")
    pages = T.page_range(F.col("text"))
    out = out.select(
        key, T.hash_heading(F.col("text")).alias("title"), "hits", T.relevance(F.col("hits"), query).alias("score"),
        pages["start"].alias("page_start"), pages["end"].alias("page_end"), F.substring("text", 1, SNIPPET).alias("snippet"),
    )
    return out if k is None else out.orderBy(F.desc("score"), F.asc(key)).limit(k)


def ordered_by_source(results: DataFrame, k: int) -> DataFrame:
    """The best ``k`` over several sources, ties in the order of the sources and then by id."""
    rank = F.lit(len(SOURCES))
    for n, s in enumerate(SOURCES):
        rank = F.when(F.col("kind") == s, n).otherwise(rank)
    return results.orderBy(F.desc("score"), rank, "id").limit(k)


def sources_together(results: dict[str, DataFrame]) -> DataFrame:
    """The results of all sources, each with its kind; nothing is dropped."""
    parts = [df.withColumn("kind", F.lit(kind)) for kind, df in results.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def tokens(text: Column) -> Column:
    """Lower-case words of a text or a query: runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def inverted_index(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``token``, key: lower-case words of the columns, once each."""
    return df.select(key, F.explode(F.array_distinct(tokens(F.concat_ws(" ", *columns)))).alias("token"))


def index_search(index: DataFrame, key: str, query: str, k: int | None = None) -> DataFrame:
    """Keys that hold all words of the query, the first ``k`` by key; a query without a word finds nothing."""
    words = F.array_distinct(tokens(F.lit(query)))
    found = index.where(F.array_contains(words, F.col("token"))).groupBy(key).agg(F.count("*").alias("n"))
    out = found.where((F.col("n") == F.size(words)) & (F.size(words) > 0)).select(key)
    return out if k is None else out.orderBy(key).limit(k)


def cache_lookup(cache: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries with what is cached for their text, number of results and filter; null where nothing is."""
    key = T.query_key(F.col("query"), F.coalesce(F.col("top_k").cast("string"), F.lit("")), F.coalesce("doc_filter", F.lit("")))
    return queries.withColumn("query_hash", key).join(cache, "query_hash", "left")


def cache_hit(cache: DataFrame, hits: DataFrame) -> DataFrame:
    """The cache with its hit counts raised by the lookups that found something."""
    n = hits.where("results IS NOT NULL").groupBy("query_hash").agg(F.count("*").alias("new"))
    return cache.join(n, "query_hash", "left").select(*[c for c in cache.columns if c != "hit_count"], (F.col("hit_count") + F.coalesce("new", F.lit(0))).alias("hit_count"))


def backlinks(notes: DataFrame, target: str, *, exact: bool = True) -> DataFrame:
    """Notes whose links hold the target, as a whole or as a part of their text."""
    hit = F.array_contains("links", target) if exact else F.to_json("links").contains(target)
    return notes.where(hit)


def cached_search(docs: DataFrame, queries: DataFrame, cache: DataFrame, *, k: int = 10, answers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Several searches through the cache: results (``query_id``, ``place``, ``doc_id``, ``score``, ``from_cache``) and the cache afterwards.

    ``queries``: query_id, query, doc_filter (null: none); ``cache``: query_hash, place, doc_id, score. What is cached for
    the same words, number of results and filter is taken as it is. The other queries, equal ones once, are all scored in one pass
    over the documents, a filter with them, and what they find is stored. ``answers`` (query_id) puts a row without document at the
    head of new results. The queries, a few users' typed texts, go to the driver; documents don't.
    """
    key = T.query_key(F.col("query"), F.lit(str(k)), F.coalesce(F.col("doc_filter").cast("string"), F.lit("")))
    asked = queries.withColumn("query_hash", key)
    columns = ["place", "doc_id", "score"]
    hit = asked.join(cache, "query_hash").select("query_id", *columns, F.lit(True).alias("from_cache"))
    missed = asked.join(cache.select("query_hash").distinct(), "query_hash", "left_anti")
    distinct = missed.groupBy("query_hash").agg(F.min(F.struct("query", "doc_filter")).alias("q")).orderBy("query_hash").collect()
    if not distinct:
        return hit, cache
    counts = T.term_frequencies(F.col("text"), [r["q"]["query"] for r in distinct])
    filters = {r["q"]["doc_filter"] for r in distinct}
    pool = docs if None in filters else docs.where(F.col("doc_id").isin(list(filters)))
    scored = pool.select("doc_id", F.explode(F.array(counts)).alias("hits"))
    wanted = []
    for n, r in enumerate(distinct):
        mine = F.col("hits")[n] > 0
        if r["q"]["doc_filter"] is not None:
            mine &= F.col("doc_id") == r["q"]["doc_filter"]
        score = T.relevance(F.col("hits")[n], r["q"]["query"])
        wanted.append(F.when(mine, F.struct(F.lit(r["query_hash"]).alias("query_hash"), score.alias("score"))))
    found = scored.select("doc_id", F.explode(F.array_compact(F.array(*wanted))).alias("x")).select("doc_id", "x.query_hash", "x.score")
    place = F.row_number().over(W.partitionBy("query_hash").orderBy(F.desc("score"), "doc_id"))
    top = found.withColumn("place", place).where(F.col("place") <= k)
    new = missed.select("query_id", "query_hash").join(top, "query_hash").select("query_id", "query_hash", *columns)
    if answers is not None:
        head = missed.join(answers.select("query_id"), "query_id").select("query_id", "query_hash", F.lit(0).alias("place"), F.lit(None).cast("long").alias("doc_id"), F.lit(1.0).alias("score"))
        new = new.unionByName(head)
    stored = cache.unionByName(new.select("query_hash", *columns).distinct())
    return hit.unionByName(new.select("query_id", *columns, F.lit(False).alias("from_cache"))), stored
