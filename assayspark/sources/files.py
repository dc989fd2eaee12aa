"""File sources and sinks: library folders, page texts, wiki files, notes, markdown, published tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayspark.scratch import kept
from assayspark.sources.library import Library, Transaction

# What a library scan takes and skips.
EXTENSIONS = ("pdf", "md", "txt", "sdf", "mol", "mol2", "pdb", "smi")
SKIPPED = (
    "node_modules", ".venv", "venv", "__pycache__", ".git", "target", "dist", "build", ".mypy_cache",
    ".pytest_cache", ".ruff_cache", ".codex", ".claude", "archived", "ref", "tools",
)
WIKI_BYTES = 50 << 20
UPLOAD_BYTES = 200 << 20
KINDS = ("summaries", "sources", "concepts")


def relative(path: Column, root: str) -> Column:
    """A file's path below a root, without its scheme."""
    bare = F.regexp_replace(path, r"^[a-z]+:/+", "/")
    return F.substring(bare, len("/" + root.split("://")[-1].strip("/")) + 2, 1 << 30)


def scan(spark: SparkSession, root: str, *, recursive: bool = True) -> DataFrame:
    """Files of a library folder: ``path`` below it, ``name``, ``ext``, ``size``, ``modified``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    path = relative(F.col("path"), root)
    out = files.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    parts = F.split("path", "/")
    out = out.withColumn("name", F.element_at(parts, -1)).withColumn("ext", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)))
    skip = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda x: x.isin(*SKIPPED))
    return out.where(F.col("ext").isin(*EXTENSIONS) & ~skip)


def tree(files: DataFrame) -> DataFrame:
    """Folders and files of a scan, folders first and then by name in any case; empty folders don't come up."""
    parts = F.split("path", "/")
    up = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("path"), (i < F.size(parts)).alias("is_dir")))).alias("n"))
    nodes = up.select("n.path", "n.is_dir").distinct()
    cut = F.split("path", "/")
    return nodes.select("path", "is_dir", F.element_at(cut, -1).alias("name"), F.array_join(F.slice(cut, 1, F.size(cut) - 1), "/").alias("parent")).orderBy("parent", F.desc("is_dir"), F.lower("name"))


def page_texts(spark: SparkSession, root: str, pages: list[int] | None = None) -> DataFrame:
    """``doc_id``, ``page_num``, ``text`` of page files ``<doc>/pages/page_NNNN.txt``."""
    raw = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    out = raw.select(F.regexp_extract("path", r"([^/]+)/pages/page_\d+\.txt$", 1).alias("doc_id"), F.regexp_extract("path", r"page_(\d+)\.txt$", 1).try_cast("int").alias("page_num"), "text").where("page_num IS NOT NULL")
    return out if pages is None else out.where(F.col("page_num").isin(pages))


def wiki(spark: SparkSession, root: str, most: int = WIKI_BYTES) -> DataFrame:
    """``id``, ``kind``, ``path``, ``size``, ``text`` of wiki files; larger ones are left out."""
    raw = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
    m = raw.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("text")).where(F.col("size") <= most)
    kind = F.regexp_extract("p", r"/(summaries|sources|concepts)/[^/]+\.(?:md|json)$", 1)
    return m.select(F.regexp_extract("p", r"/([^/]+)\.(?:md|json)$", 1).alias("id"), kind.alias("kind"), relative(F.col("p"), root).alias("path"), "size", "text").where("kind != ''")


def wiki_listing(files: DataFrame) -> DataFrame:
    """Sorted names of each kind."""
    return files.groupBy("kind").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def notes(spark: SparkSession, path: str) -> DataFrame:
    """The notes index; a corrupt one is empty."""
    schema = "id string, title string, links array<string>, updated string, _bad string"
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return raw.where("_bad IS NULL AND id IS NOT NULL").drop("_bad")


def note_saved(index: DataFrame, note: DataFrame) -> DataFrame:
    """The index with a note put in or replaced by its id."""
    return index.join(note.select("id"), "id", "left_anti").select(index.columns).unionByName(note, allowMissingColumns=True)


def note_deleted(index: DataFrame, note_id: str) -> DataFrame:
    return index.where(F.col("id") != note_id)


def document_tree(summaries: DataFrame, trees: DataFrame, docs: DataFrame) -> DataFrame:
    """A document's structure: one node from its summary if there is one, else what the map holds, else null."""
    node = F.when(F.col("summary").isNotNull(), F.to_json(F.array(F.struct(F.col("doc_id").alias("title"), F.col("summary").alias("summary")))))
    return docs.join(summaries, "doc_id", "left").join(trees, "doc_id", "left").select("doc_id", F.coalesce(node, F.col("tree")).alias("structure"))


def artifact_path(doc_id: Column, kind: str) -> Column:
    """Where a document's artifact is, below the library's root."""
    names = {"source": "source.pdf", "reorganized": "reorganized.md", "report": "report.json", "indexed": "indexed.md"}
    return F.concat(F.lit("storage/"), doc_id, F.lit("/" + names[kind]))


def crop_path(doc_id: Column, page: Column, index: Column) -> Column:
    """The name of a molecule's crop; pages and molecules as they are numbered by the detector."""
    return F.format_string("%s_page_%04d_mol_%04d.png", doc_id, page, index)


def rewritten_crop(path: Column, doc_id: Column, old: str) -> Column:
    """A crop's path moved from an old prefix into its document's storage; others as they are."""
    return F.when(path.startswith(old), F.concat(F.lit("storage/"), doc_id, F.lit("/crops/"), F.substring(path, len(old) + 1, 1 << 30))).otherwise(path)


def safe_id(doc_id: Column) -> Column:
    """An id that can stand in a path."""
    return F.coalesce(doc_id.rlike(r"^[A-Za-z0-9_][A-Za-z0-9_.\-]*$") & ~doc_id.contains(".."), F.lit(False))


def first_figures(figures: DataFrame) -> DataFrame:
    """The first rectangle of each image of a page."""
    return figures.select("doc_id", "page_num", F.posexplode("figures").alias("image_no", "rects")).where(F.size("rects") > 0).select("doc_id", "page_num", "image_no", F.element_at("rects", 1).alias("box"))


def publish(df: DataFrame, path: str, partition: str = "doc_id") -> None:
    """Replace the partitions of the documents in ``df``: a re-ingest can't double anything.

    What is computed is written aside first, so a failing plan changes nothing. The partitions are then replaced by a
    dynamic overwrite with one file for each; if that is broken off, running it again mends it.
    """
    spark = df.sparkSession
    stage = f"{path.rstrip('/')}__{uuid.uuid4().hex[:8]}"
    df.write.parquet(stage)
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(stage)
    try:
        done = spark.read.schema(df.schema).parquet(stage)
        done.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    finally:
        where.getFileSystem(conf).delete(where, True)


def write_texts(df: DataFrame, path: str, column: str, partition: str = "doc_id") -> None:
    """One text file for each document; files of other documents stay."""
    out = df.select(partition, column).repartition(partition).write.mode("overwrite")
    out.option("partitionOverwriteMode", "dynamic").partitionBy(partition).text(path)


def uploads(incoming: DataFrame, stored: DataFrame, most: int = UPLOAD_BYTES) -> DataFrame:
    """Incoming files (``name``, ``content``) with ``md5``, ``size`` and ``outcome``: too large, a duplicate of what is stored or of an
    earlier name in the same upload, or accepted."""
    files = incoming.withColumn("size", F.octet_length("content")).withColumn("md5", F.md5("content"))
    first = files.where(F.col("size") <= most).groupBy("md5").agg(F.min("name").alias("_first"))
    known = stored.select("md5").distinct().withColumn("_known", F.lit(True))
    marked = files.join(first, "md5", "left").join(known, "md5", "left")
    outcome = F.when(F.col("size") > most, "too_large").when(F.col("_known") | (F.col("name") != F.col("_first")), "duplicate").otherwise("accepted")
    return marked.select("name", "md5", "size", outcome.alias("outcome"))


def upload(library: Library, incoming: DataFrame, most: int = UPLOAD_BYTES) -> DataFrame:
    """Commit incoming files (``name``, ``content``): what is accepted goes with its contents to table ``files`` and as a queued row to ``documents``, both or none.

    Returns the outcomes of :func:`uploads`. Of two uploads of one content at once the second is run anew on the first's state, and finds a duplicate.
    """
    told: list[DataFrame] = []

    def change(tx: Transaction) -> None:
        known = tx.read("documents").select("md5") if tx.exists("documents") else incoming.sparkSession.createDataFrame([], "md5 string")
        outcome = kept(uploads(incoming, known, most), "upload")
        new = incoming.select("name", "content").join(outcome.where("outcome = 'accepted'"), "name")
        stored = tx.append("files", new.select("name", "md5", "size", "content"))
        tx.append("documents", stored.select("name", "md5", "size", F.lit("queued").alias("status")))
        told[:] = [outcome]

    library.run(change)
    return told[0]
