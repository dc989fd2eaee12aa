"""Ingest logs and diagnostics as streams: tail, latest state, ring, micro-batches, cache with a life time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RING, HISTORY, TTL = 500, 50, "30 seconds"


def tail(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """New log rows as they are appended to a folder; the offset is the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def since(logs: DataFrame, last: int) -> DataFrame:
    """The batch form of the tail: rows after an id, in order."""
    return logs.where(F.col("id") > last).orderBy("id")


def latest_per_task(logs: DataFrame) -> DataFrame:
    """State of each task by its last row; works on streams in update or complete mode."""
    return logs.groupBy("task").agg(F.max_by("level", "id").alias("level"), F.max_by("value", "id").alias("value"), F.max("id").alias("id"))


def diagnostics(rows: DataFrame, *, after: int = -1, level: str | None = None, category: str | None = None, code: str | None = None, limit: int = 200) -> DataFrame:
    """Diagnostics after a number, oldest first; the limit is held between 1 and 1000."""
    for name, v in (("level", level), ("category", category), ("error_code", code)):
        if v is not None:
            rows = rows.where(F.col(name) == v)
    return rows.where(F.col("seq") > after).orderBy("seq").limit(min(max(limit, 1), 1000))


def ring(rows: DataFrame, n: int = RING, order: str = "seq") -> DataFrame:
    """The last ``n`` rows by number: a top-k, no global sort."""
    return rows.orderBy(F.desc(order)).limit(n)


def last_per_key(rows: DataFrame, key: str, order: str, n: int = HISTORY) -> DataFrame:
    """The last ``n`` rows of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_n") <= n).drop("_n")


def merged_logs(rows: DataFrame, n: int) -> DataFrame:
    """Rows of each document without repeats of time and message, the last ``n`` in the order of time."""
    return last_per_key(rows.dropDuplicates(["doc_id", "ts_ms", "message"]).withColumn("_o", F.struct("ts_ms", "message")), "doc_id", "_o", n).drop("_o")


def merged_logs_of_last(rows: DataFrame, n: int, n_docs: int) -> DataFrame:
    """:func:`merged_logs` of the ``n_docs`` documents whose first row came last; those that came before are let go, first come, first gone.

    ``rows``: doc_id, ts_ms, message. Documents that came at one time go by id.
    """
    first = rows.groupBy("doc_id").agg(F.min("ts_ms").alias("came"))
    last = first.orderBy(F.desc("came"), F.desc("doc_id")).limit(n_docs).select("doc_id")
    return merged_logs(rows.join(last, "doc_id", "left_semi"), n)


def batch_no(place: Column, size: int = 3) -> Column:
    """The micro-batch of a row by its place from 1."""
    return F.floor((place - 1) / size).cast("int")


def fresh(cache: DataFrame, now: Column, ttl: str = TTL) -> DataFrame:
    """Cached rows that haven't outlived their time, the newest for each key."""
    alive = cache.where(F.col("cached_at") > now - F.expr(f"interval {ttl}"))
    return alive.groupBy("root", "doc_id", "page").agg(F.max_by("payload", "cached_at").alias("payload"), F.max("cached_at").alias("cached_at"))


def ring_sink(stream: DataFrame, path: str, checkpoint: str, n: int = RING, order: str = "seq") -> StreamingQuery:
    """Keep the last ``n`` rows of a stream as a table; each batch writes a version of its own, so repeats are harmless.

    The version before stays, as a repeated batch reads it; older ones are removed.
    """

    def merge(batch: DataFrame, no: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(batch.schema).parquet(f"{path}/v={no - 1}") if no else spark.createDataFrame([], batch.schema)
        ring(before.unionByName(batch).dropDuplicates([order]), n, order).write.mode("overwrite").parquet(f"{path}/v={no}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={no - 2}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def heartbeat(spark: SparkSession, seconds: int = 30) -> DataFrame:
    """A row at each interval."""
    return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("advanceMillisPerBatch", seconds * 1000).load()


#: Empty polls in a row that a tail of an ended task outlasts, and how long a failed service is left alone.
EMPTY_POLLS, COOL_DOWN = 5, "30 seconds"


def tail_ends(polls: DataFrame) -> DataFrame:
    """For each task the poll at which its tail ends: the first with more than EMPTY_POLLS empty ones up to it once the task isn't active.

    ``polls``: task, poll (from 1), n_rows, active.
    """
    w = W.partitionBy("task").orderBy("poll")
    last = F.coalesce(F.last(F.when(F.col("n_rows") > 0, F.col("poll")), ignorenulls=True).over(w), F.lit(0))
    empty = polls.withColumn("empty", F.col("poll") - last)
    return empty.where((F.col("empty") > EMPTY_POLLS) & ~F.col("active")).groupBy("task").agg(F.min("poll").alias("poll"))


def cooling(failures: DataFrame, now: Column, wait: str = COOL_DOWN) -> DataFrame:
    """Services whose last failure is less than the cool-down ago; a success since then clears it.

    ``failures``: name, ts, ok.
    """
    last = failures.groupBy("name").agg(F.max_by("ok", "ts").alias("ok"), F.max("ts").alias("ts"))
    return last.where(~F.col("ok") & (F.col("ts") > now - F.expr(f"interval {wait}"))).select("name", "ts")


#: What an agent's events are called for the reader, and how much of a tool's result is passed on.
EVENT_TYPES = {"on_chat_model_stream": "chunk", "on_tool_start": "tool_call", "on_tool_end": "tool_result", "error": "error"}
RESULT_CHARS = 500


def typed_events(events: DataFrame) -> DataFrame:
    """What a reader of an agent's run gets: text pieces that aren't empty, tool calls, results and errors; nothing for other events.

    ``events``: run, seq, event, name, content, recoverable. Of errors that can't be recovered from only a
    general word is passed on. Row by row, so streams may use it too.
    """
    kind = F.create_map(*[F.lit(x) for pair in EVENT_TYPES.items() for x in pair])[F.col("event")]
    content = F.coalesce("content", F.lit(""))
    shown = (
        F.when(F.col("type") == "tool_result", F.substring(content, 1, RESULT_CHARS))
        .when((F.col("type") == "error") & ~F.coalesce("recoverable", F.lit(False)), "Internal error")
        .otherwise(content)
    )
    rows = events.withColumn("type", kind).where(F.col("type").isNotNull() & ((F.col("type") != "chunk") | (content != "")))
    return rows.select("run", "seq", "type", F.when(F.col("type") == "tool_call", F.col("name")).alias("tool"), shown.alias("content"))


def with_done(events: DataFrame) -> DataFrame:
    """A run's typed events up to its first error, and the row that ends it; runs that show nothing end as well."""
    error = F.min(F.when(F.col("event") == "error", F.col("seq"))).over(W.partitionBy("run"))
    seen = events.withColumn("_error", error).where(F.col("_error").isNull() | (F.col("seq") <= F.col("_error"))).drop("_error")
    last = seen.groupBy("run").agg((F.max("seq") + 1).alias("seq"))
    none = F.lit(None).cast("string")
    return typed_events(seen).unionByName(last.select("run", "seq", F.lit("done").alias("type"), none.alias("tool"), none.alias("content")))
