"""A training corpus from the documents table: five stages, each calling one operator on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the shared
folder and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayspark.llm import bpe, minhash_dedup, mixing, quality, secrets
from assayspark.llm.common import Workspace, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents which the quality classifier accepts; it learns from the labels of the training part only."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs.select(COLUMNS), model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id. Rows without id stay.

    Rows with one id and one text are one document, those with one id and several texts are several.
    """
    docs = docs.select(COLUMNS)
    ws = Workspace(spark, "pipeline-kept")
    named = docs.where("doc_id IS NOT NULL").withColumn("digest", F.coalesce(F.sha2("text", 256), F.lit("")))
    texts = named.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("z"))
    if texts.where("a != z").isEmpty():
        named = named.withColumn("key", F.col("doc_id")).drop("digest")
    else:  # numbers in the order of the ids stand for the documents
        keys = named.select("doc_id", "digest").distinct().orderBy("doc_id", "digest").withColumn("key", F.monotonically_increasing_id())
        named = named.join(ws.save(keys, "keys").hint("shuffle_hash"), ["doc_id", "digest"]).drop("digest")
    found = minhash_dedup.near_duplicates(named.select(F.col("key").alias("doc_id"), "text")).where("kept").groupBy(F.col("doc_id").alias("kept_key")).agg(F.count("*").alias("n"))
    found = ws.save(found, "kept")
    named = named.join(found.hint("shuffle_hash"), F.col("key") == F.col("kept_key"), "left_semi")
    if not found.where("n > 1").isEmpty():  # a row that stands twice is one document
        named = named.dropDuplicates(["key"])
    return named.select(COLUMNS).unionByName(docs.where("doc_id IS NULL"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with what the secret scan finds replaced in their texts."""
    ledger = secrets.ledger_path(spark, "pipeline-secrets")
    docs = docs.select(COLUMNS)
    secrets.scan(docs, ledger)
    found = secrets.findings(docs, ledger)
    clean = secrets.redact(F.col("text"), F.col("found"))
    size = F.when(F.size("found") > 0, F.length("clean").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("clean", clean).select("doc_id", F.col("clean").alias("text"), "lang", "source", size.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, none where it doesn't. Rows without id go by their content."""
    docs = docs.select(COLUMNS).withColumn("row_key", F.coalesce(F.col("doc_id"), F.xxhash64("text", "source")))
    mixed = mixing.mix(docs.select(F.col("row_key").alias("doc_id"), "source", "text"), mixing.quality_weights(table(spark, sf_dir, "labels")))
    times = mixed.groupBy(F.col("doc_id").alias("mixed_id")).agg(F.max("epochs").cast("int").alias("epochs")).where("epochs > 0")
    taken = docs.join(times.hint("shuffle_hash"), F.col("row_key") == F.col("mixed_id"))
    return taken.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("epochs")))).select(COLUMNS)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of what decoding gives back."""
    return bpe.encode_checked(docs, bpe.public_codec())


STAGES = [
    ("quality_classifier", keep_good),
    ("minhash_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode_bytes),
]

#: The classifier and the encoder can't be written in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), name)
        if k:
            ws.drop(STAGES[k - 1][0])
    return docs
