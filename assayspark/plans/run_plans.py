"""Runs that write: the ingest of documents, commits over several tables, live state of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayspark.operators import ingest
from assayspark.scratch import own_path
from assayspark.sources.library import Library
from assayspark.streaming import state

from .registry import Tables, query


_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"
_PAGES = "string_split(replace(text, chr(10), chr(12)), chr(12))"


@query(f"""
WITH d AS (SELECT doc_id, text, doc_id % 13 = 5 AS lost, doc_id % 26 = 18 OR text IS NULL OR {_TRIM.format("text")} = '' AS bad FROM documents),
p AS (SELECT *, len({_PAGES}) AS n_pages, len(list_filter({_PAGES}, lambda x: length({_TRIM.format("x")}) <= 50)) AS n_ocr FROM d)
SELECT doc_id, CASE WHEN bad THEN 'failed' ELSE 'done' END AS status, CASE WHEN bad THEN 'extract' ELSE 'persist' END AS stage, CASE WHEN bad THEN 'PDF_PARSE_ERROR' END AS code,
       CASE WHEN lost OR bad THEN 2 ELSE 1 END AS attempt, CASE WHEN NOT bad THEN n_pages END AS n_pages,
       CASE WHEN bad THEN NULL WHEN n_ocr = 0 THEN 'text_only' WHEN n_ocr = n_pages THEN 'image_only' ELSE 'mixed' END AS doc_kind FROM p""")
def ingest_run(t: Tables) -> DataFrame:
    """All documents, a page for each line. Every 13th has lost its text; a second run finds half of these mended, and takes no other."""
    library = Library(t.spark, own_path(t.spark, "ingest"))
    docs = t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\f")).alias("text"))
    ingest.run(library, docs.withColumn("text", F.when(F.col("doc_id") % 13 != 5, F.col("text"))))
    ingest.run(library, docs.withColumn("text", F.when(F.col("doc_id") % 26 != 18, F.col("text"))))
    made = library.read("persist").select(F.col("doc_id").alias("_d"), "n_pages", "doc_kind")
    rows = library.read(ingest.STATE)
    return rows.join(made, rows.doc_id == made._d, "left").select("doc_id", "status", "stage", "code", "attempt", "n_pages", "doc_kind")


@query("""
SELECT 'texts' AS name, doc_id AS id, CASE WHEN n_chars % 5 = 0 THEN 'again' ELSE source END AS status FROM documents WHERE doc_id % 7 <> 0
UNION ALL SELECT 'sizes', n_chars, CASE WHEN n_chars % 5 = 0 THEN 'again' ELSE 'new' END FROM (SELECT DISTINCT n_chars FROM documents)""")
def library_commits(t: Tables) -> DataFrame:
    """Two tables through four transactions, one of which fails after its first table; then one table is compacted."""
    library = Library(t.spark, own_path(t.spark, "library"))
    texts = t.documents.select("n_chars", F.col("doc_id").alias("id"), F.col("source").alias("status"))
    sizes = t.documents.select(F.col("n_chars").alias("id")).distinct().withColumn("status", F.lit("new"))
    with library.transaction() as tx:
        tx.append("texts", texts)
        tx.append("sizes", sizes)
    with library.transaction() as tx:  # every fifth size comes again, with all its texts
        tx.replace("texts", texts.where("n_chars % 5 = 0").withColumn("status", F.lit("again")), ["n_chars"])
        tx.replace("sizes", sizes.where("id % 5 = 0").withColumn("status", F.lit("again")), ["id"])
    try:
        with library.transaction() as tx:
            tx.delete("sizes", sizes.select("id"))
            raise InterruptedError
    except InterruptedError:
        pass
    with library.transaction() as tx:
        tx.delete("texts", texts.where("id % 7 = 0").select("id"))
    library.compact("sizes")
    one = lambda name: library.read(name).select(F.lit(name).alias("name"), F.col("id").cast("long").alias("id"), "status")
    return one("texts").unionByName(one("sizes"))


@query("""
SELECT source, doc_id AS seq, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS n FROM documents) WHERE n <= 500""")
def live_rings(t: Tables) -> DataFrame:
    """The last 500 documents of each source as a stream keeps them, read back from the changes that it told."""
    own = state.with_state_store(t.spark)
    out = own_path(t.spark, "rings")
    source = f"{t.sf_dir}/documents.parque[t]"  # a pattern, as a stream takes a single file by that only
    rows = own.readStream.schema(t.documents.schema).parquet(source).select("source", F.col("doc_id").alias("seq"), "n_chars")
    write = lambda batch, no: batch.write.mode("overwrite").parquet(f"{out}/changes/v={no}")
    query = state.ring(rows, "source").writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return state.ring_content(t.spark.read.parquet(f"{out}/changes").drop("v"), "source")
