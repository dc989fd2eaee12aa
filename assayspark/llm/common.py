"""Shared helpers of the training-data operators: shared-folder tables, text rules, components."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word of the training-data contracts: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder which driver and executors share.

    The session's ``spark.checkpoint.dir`` is used wherever it is set. Only a local master, where
    driver and executors are one process on one machine, gets a folder of its own.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that the executors of {master} share")
    own = tempfile.mkdtemp(prefix="assayspark-")
    spark.conf.set(CHECKPOINT_KEY, f"file://{own}")
    import atexit

    atexit.register(shutil.rmtree, own, True)
    return f"file://{own}"


class Workspace:
    """Parquet tables of one operator run in the shared folder; they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/assayspark/{name}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as table ``name`` of this run and read it back with the same schema."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Let Spark's cleaner remove the shuffle files of plans that nothing refers to any more; it waits for a collection."""
        for _ in range(2):  # what the first one frees holds what the second one frees
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.3)

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which the operators' own buckets follow."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, records: int = 1000) -> None:
    """Bound the Arrow batches that Python workers get: texts may be long, so few rows and few bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def arrow_schema(schema: T.StructType) -> pa.Schema:
    """The Arrow form of a Spark schema, as Python workers return it."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _weight(value: object) -> int:
    """Characters or bytes of the texts in a value."""
    if isinstance(value, (str, bytes)):
        return len(value)
    if isinstance(value, dict):
        return sum(map(_weight, value.values()))
    return sum(map(_weight, value)) if isinstance(value, list) else 0


def arrow_batches(rows: Iterator[tuple], schema: pa.Schema, records: int = 1000, chars: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of at most ``records`` rows, and of no more rows once their texts and bytes reach ``chars``."""
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        size += sum(map(_weight, row))
        if len(held) == records or size >= chars:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


#: DuckDB has no CRC-32: its table by the bitwise rule, and its loop over the characters of an ASCII text.
CRC_SQL = """crc_steps AS (
  SELECT n, 0 AS k, n AS c FROM range(256) t(n)
  UNION ALL
  SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY n) AS crcs FROM crc_steps WHERE k = 8)"""


def crc_of(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text of ASCII characters, beside ``crc_table``."""
    step = "lambda a, b: xor(crcs[(xor(a, b) & 255) + 1], a >> 8)"
    return f"xor(4294967295, list_reduce(list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT), {step}, 4294967295::BIGINT))"


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the decimal text of ``doc_id`` modulo ``n``; null stays null."""
    return F.crc32(doc_id.cast("string")) % F.lit(n)


def components(ws: Workspace, edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components by alternating large-star and small-star steps on edge tables.

    ``edges`` has columns ``a`` and ``b`` (long, no nulls, a != b). Returns ``node``, ``component``
    (smallest node that can be reached) for every node of an edge. Each round is written to the
    shared folder, only a count and a checksum of its edges go to the driver.
    """

    def signature(e: DataFrame) -> tuple:
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return (r["n"], r["h"])

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m")).withColumn("m", F.least("k", "m"))
        joined = both.join(least, F.col("a") == F.col("k"))
        if large:
            out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
                least.select(F.col("k").alias("a"), F.col("m").alias("b"))
            )
        return out.where("a != b").distinct()

    now = ws.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{tag}-0")
    seen, turn = signature(now), 0
    while seen[0]:
        turn += 1
        nxt = ws.save(star(star(now, True), False), f"{tag}-{turn}")
        ws.drop(f"{tag}-{turn - 1}")
        now, before = nxt, seen
        seen = signature(now)
        if seen == before:
            break
    # A settled edge set has one edge from each node to its component's smallest node.
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, by the ASCII white space rule."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def remove_tree(path: str) -> None:
    if os.path.isdir(path):
        shutil.rmtree(path, ignore_errors=True)
