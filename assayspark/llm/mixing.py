"""Mixing sources to target weights by Efraimidis-Spirakis keys, DataFrame functions only.

Every source gets a word budget. Whole epochs of a source come first; what is left of its budget is a
weighted sample without replacement: documents sorted by exponential keys ``-ln(u) / quality`` (small
keys first, ``u`` a hash of the id and the seed) up to the budget, by prefix sums.

Prefix sums of a hot source are split: documents are range-partitioned by key, so ranges hold about equally
many whatever the weights are, ranges are summed, and a document's prefix is the sum of the ranges before
its own plus the words before it in its range. No task ever holds a source.

Defined cases: null text has size 0; null source is a source of its own, last in order; rows with null
doc_id are hashed by their text; repeated rows get equal keys and are separate rows, the smaller first where
sizes differ; missing or non-positive quality weights count as 1; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Workspace, shuffle_partitions, table

#: Source weights by position in code point order, repeating.
SOURCE_WEIGHTS = (3, 1, 2)
#: The mix has this share of all words.
SHARE = 1.5
#: No source and no document is used more often.
MAX_REPEATS = 2.0


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of the md5 of seed and id, or text where there is no id."""
    own = F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), own)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """Budget of each source: ``source``, ``source_size`` -> also ``target``.

    Budgets are proportional to the weights; those above ``cap`` times the source's size are held there
    and the excess goes to the others by weight, until none is above. In the order of size over weight
    the held sources come first, so one pass of running sums finds them. The table has a row for each
    source, not for each document.
    """
    order = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    t = sizes.withColumn("w", F.element_at(kinds, (order % len(weights) + 1).cast("int")))
    t = t.withColumn("limit", F.lit(cap) * F.col("source_size"))
    by = W.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = (
        t.withColumn("all", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("held", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(after))
        .withColumn("level", (F.col("all") - F.col("held")) / F.col("w_left"))
        .withColumn("fits", F.col("level") * F.col("w") <= F.col("limit"))
    )
    # The first source that fits sets the level of all after it; those before are held at their limit.
    level = F.min(F.when(F.col("fits"), F.struct(F.col("limit") / F.col("w"), F.col("source").isNull(), "source", "level"))).over(whole)
    return t.withColumn("first", level["level"]).select(
        "source", "source_size", F.least("limit", F.coalesce(F.col("first") * F.col("w"), F.col("limit"))).alias("target")
    )


def mix(
    docs: DataFrame,
    quality: DataFrame | None = None,
    *,
    share: float = SHARE,
    cap: float = MAX_REPEATS,
    weights: tuple[int, ...] = SOURCE_WEIGHTS,
    seed: str = "mix-1",
    ranges: int | None = None,
) -> DataFrame:
    """Decide how often the mix takes each document.

    ``quality``: optional ``doc_id``, ``weight`` with larger weights drawn earlier. Returns ``doc_id``,
    ``source``, ``size``, ``source_size``, ``target``, ``epochs`` (times the document is taken) and
    ``taken`` (words). A boundary document is taken whole if that brings its source nearer to the target.
    """
    ws = Workspace(docs.sparkSession, "mix")
    base = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), uniform(F.col("doc_id"), F.col("text"), seed).alias("u"))
    if quality is not None:
        best = quality.groupBy("doc_id").agg(F.max("weight").cast("double").alias("weight"))
        base = base.join(best, "doc_id", "left")
    else:
        base = base.withColumn("weight", F.lit(1.0))
    q = F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.lit(1.0))
    base = base.select("doc_id", "source", "size", (-F.log("u") / q).alias("key"))
    # The saved table keeps each document's range, whatever a rerun would deal out.
    base = base.repartitionByRange(ranges or shuffle_partitions(docs.sparkSession), "key", "doc_id", "size").withColumn("range", F.spark_partition_id())
    base = ws.save(base, "sizes")
    by_range = ws.save(base.groupBy("source", "range").agg(F.sum("size").alias("words")), "ranges")
    goal = targets(by_range.groupBy("source").agg(F.sum("words").alias("source_size")), share, cap, weights)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goal = goal.withColumn("full", full.cast("long"))
    goal = goal.withColumn("left", F.col("target") - F.col("full") * F.col("source_size"))
    ahead = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = by_range.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    starts = starts.alias("r").join(goal.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source"))).select(
        "r.source", "range", "words", "ahead", "source_size", "target", "full", "left"
    )
    same = F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.range") == F.col("s.range"))
    within = W.partitionBy("d.source", "d.range").orderBy("d.key", "d.doc_id", "d.size").rowsBetween(W.unboundedPreceding, -1)
    out = base.alias("d").join(starts.alias("s"), same)
    # A range wholly inside or outside of the budget needs no order within it.
    out = out.withColumn("inner", F.coalesce(F.sum("d.size").over(within), F.lit(0)))
    used = F.col("s.ahead") + F.col("inner") + F.col("d.size") / 2.0 <= F.col("s.left")
    out = out.withColumn("epochs", F.col("s.full") + F.when(used & (F.col("d.size") > 0), 1).otherwise(0))
    return out.select(
        F.col("d.doc_id").alias("doc_id"), F.col("d.source").alias("source"), F.col("d.size").alias("size"),
        F.col("s.source_size").alias("source_size"), F.col("s.target").alias("target"), F.col("epochs").cast("long").alias("epochs"),
        (F.col("epochs") * F.col("d.size")).cast("long").alias("taken"),
    )


def quality_weights(labels: DataFrame) -> DataFrame:
    """Document weights from review labels: good 1, poor a quarter; the caller's default holds for the rest."""
    return labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select(
        "doc_id", F.when(F.col("quality") == 1, 1.0).otherwise(0.25).alias("weight")
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), quality_weights(table(spark, sf_dir, "labels")))
    return out.select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
q AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END) AS weight FROM labels
      WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
k AS (
  SELECT d.*, -ln((('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null:' || md5(coalesce(d.text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5)
         / 4503599627370496.0::DOUBLE) / coalesce(q.weight, 1.0::DOUBLE) AS key
  FROM d LEFT JOIN q USING (doc_id)),
s AS (
  SELECT source, sum(size)::DOUBLE AS ss,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, (1.5::DOUBLE * sum(ss) OVER () - coalesce(sum(2 * ss) OVER (ORDER BY 2 * ss / w, source NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY 2 * ss / w, source NULLS LAST
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (
  SELECT source, ss, least(2 * ss, coalesce((SELECT arg_min(level, 2 * ss / w) FROM l WHERE level * w <= 2 * ss) * w, 2 * ss)) AS target
  FROM l),
f AS (SELECT *, CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END AS full_epochs FROM t),
p AS (
  SELECT k.doc_id, k.size, f.ss, f.target, f.full_epochs, f.target - f.full_epochs * f.ss AS rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM k JOIN f ON k.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, ss::BIGINT AS source_size, target,
       ((full_epochs + CASE WHEN size > 0 AND ahead + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM p
"""
