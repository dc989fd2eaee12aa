"""The document library: collections as a forest, deletes that cascade, migration."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayspark.operators.relational import one_per_key, ranked
from assayspark.scratch import kept


def documents_of(documents: DataFrame, members: DataFrame, collection: object) -> DataFrame:
    """Documents of a collection, newest first."""
    own = members.where(F.col("collection_id") == F.lit(collection)).select("doc_id")
    return documents.join(own, "doc_id").orderBy(F.desc("created_at"), "doc_id")


def with_counts(collections: DataFrame, members: DataFrame) -> DataFrame:
    """Collections with their numbers of documents, 0 where there are none."""
    n = members.groupBy("collection_id").agg(F.count("*").alias("doc_count"))
    return collections.join(n, "collection_id", "left").withColumn("doc_count", F.coalesce("doc_count", F.lit(0)))


def tree(collections: DataFrame) -> DataFrame:
    """All collections with ``depth`` and ``path``, whatever order they are listed in and however deep; a cycle is never reached.

    A level is a join of the collections with the level above, written to the shared folder.
    """
    rows = kept(collections.select("collection_id", "name", "parent_id"), "collections")
    level = kept(rows.where("parent_id IS NULL").select("*", F.lit(0).alias("depth"), F.col("name").alias("path")), "level")
    levels = [level]
    while not level.isEmpty():
        up = level.select(F.col("collection_id").alias("_up"), F.col("depth").alias("_depth"), F.col("path").alias("_path"))
        below = rows.join(up, F.col("parent_id") == F.col("_up"))
        level = kept(below.select(*rows.columns, (F.col("_depth") + 1).alias("depth"), F.concat_ws("/", "_path", "name").alias("path")), "level")
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def delete_collection(collections: DataFrame, members: DataFrame, gone: object) -> tuple[DataFrame, DataFrame]:
    """Both tables without a collection; its children move to its parent."""
    up = collections.where(F.col("collection_id") == F.lit(gone)).agg(F.max("parent_id").alias("_up"))
    moved = collections.where(F.col("collection_id") != F.lit(gone)).join(up, F.col("parent_id") == F.lit(gone), "left")
    parent = F.when(F.col("parent_id") == F.lit(gone), F.col("_up")).otherwise(F.col("parent_id")).alias("parent_id")
    kept = moved.select(*[parent if c == "parent_id" else F.col(c) for c in collections.columns])
    return kept, members.where(F.col("collection_id") != F.lit(gone))


def delete_documents(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables that hold documents without those to be deleted; molecules, which documents share, stay."""
    ids = gone.select("doc_id").distinct()
    return {name: t.join(ids, "doc_id", "left_anti").select(t.columns) if "doc_id" in t.columns else t for name, t in tables.items()}


def migrated(base: dict[str, DataFrame], legacy: dict[str, DataFrame], keys: dict[str, Sequence[str]]) -> dict[str, DataFrame]:
    """Whitelisted legacy tables (those with keys) merged into the base; what the base has wins."""
    out = dict(base)
    for name, key in keys.items():
        if name in legacy:
            one = one_per_key(legacy[name], list(key))
            out[name] = one if name not in base else base[name].unionByName(one.join(base[name].select(*key), list(key), "left_anti"), allowMissingColumns=True)
    return out


#: Steps of the schema by version: each adds what is missing and can be run again.
Step = Callable[[dict[str, DataFrame]], dict[str, DataFrame]]


def add_columns(table: str, **kinds: str) -> Step:
    """A step that adds missing columns as nulls."""

    def step(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        t = tables[table]
        for name, kind in kinds.items():
            if name not in t.columns:
                t = t.withColumn(name, F.lit(None).cast(kind))
        return tables | {table: t}

    return step


def backfilled_evidence(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Figure evidence for detections that have none yet; running it again adds nothing."""
    m = tables["molecules"].select(F.col("mol_id").alias("_m"), F.col("canonical_smiles").alias("_c"), F.col("esmiles").alias("_e"))
    d = tables["molecule_detections"].join(m, F.col("mol_id") == F.col("_m"), "left")
    new = d.select(F.coalesce(F.nullif("_c", F.lit("")), F.nullif("_e", F.lit("")), F.lit("")).alias("canonical_smiles"), "mol_id", "doc_id", "page", F.lit("figure").alias("kind")).where("canonical_smiles != ''")
    key = ["mol_id", "doc_id", "page", "kind"]
    have = tables["evidence"]
    return tables | {"evidence": have.unionByName(new.dropDuplicates(key).join(have.select(key), key, "left_anti"), allowMissingColumns=True)}


def upgrade(tables: dict[str, DataFrame], version: int, steps: dict[int, Step]) -> tuple[dict[str, DataFrame], int]:
    """Run the steps above a version in order."""
    for v in sorted(steps):
        if v > version:
            tables, version = steps[v](tables), v
    return tables, version


#: Tables that hold rows of one document, which a failed persist takes back; molecules are shared and stay.
OF_DOCUMENT = ("molecule_detections", "evidence", "text_molecule_links")


def compensated(tables: dict[str, DataFrame], doc_id: object) -> dict[str, DataFrame]:
    """All tables without what a document wrote to those that are its own."""
    return {name: t.where(~F.col("doc_id").eqNullSafe(F.lit(doc_id))) if name in OF_DOCUMENT else t for name, t in tables.items()}


def cleared(detections: DataFrame, doc_id: object | None = None) -> tuple[DataFrame, DataFrame]:
    """The detection cache without a document's rows (or without any), and a row with how many went as ``cleared``."""
    gone = F.lit(True) if doc_id is None else F.col("doc_id").eqNullSafe(F.lit(doc_id))
    return detections.where(~gone), detections.agg(F.count_if(gone).alias("cleared"))


def collection_list(collections: DataFrame, members: DataFrame) -> DataFrame:
    """Collections with their counts in the order of ``sort_order``, then name, then id."""
    return ranked(with_counts(collections, members), [F.asc("sort_order"), F.asc("name"), F.asc("collection_id")])


def migration_state(unified: bool, knowledge: bool, molecules: bool) -> str:
    """What there is to be done, by which stores exist."""
    if unified:
        return "already_migrated"
    return "needs_migration" if knowledge or molecules else "nothing_to_migrate"


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``name``, ``n``: what a migration would copy (a dry run), all tables in one job."""
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()])


def missing_rows(base: dict[str, DataFrame], legacy: dict[str, DataFrame], merged: dict[str, DataFrame], keys: dict[str, Sequence[str]]) -> DataFrame:
    """``name``, ``n``: keys of base or legacy that a merged table lacks; a migration is valid if every ``n`` is 0."""
    lost = {}
    for name, key in keys.items():
        if name in legacy:
            wanted = legacy[name].select(*key)
            wanted = wanted.unionByName(base[name].select(*key)) if name in base else wanted
            lost[name] = wanted.distinct().join(merged[name].select(*key), list(key), "left_anti")
    return row_counts(lost)
