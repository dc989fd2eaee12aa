"""Extracted candidates to stored molecules: normalised and merged, then committed with detections, evidence and activities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayspark.functions import chem
from assayspark.operators.evidence import EVIDENCE, MOLECULE, rejection, shaped
from assayspark.operators.matching import linked_activities
from assayspark.scratch import kept
from assayspark.sources.library import Transaction

#: Detections that are listed with a molecule; all are counted.
LISTED = 1000


def normalised(candidates: DataFrame, allowed: tuple[str, ...] = chem.ELEMENTS, listed: int = LISTED) -> DataFrame:
    """The molecules of each document: accepted ones first, then rejected ones with a reason, each in first-seen order (``position`` from 1).

    ``candidates``: doc_id, ord, esmiles, name, source, confidence, page, and what a toolkit says, ``valid`` and ``canonical``. Accepted ones are
    one by their canonical form, rejected ones by their own string. A molecule has the string and name that were seen first, its
    sources as they were seen, ``n_detections`` and the best ``listed`` ``detections`` by falling confidence.
    """
    reason = rejection(F.coalesce("esmiles", F.lit("")), F.col("valid"), F.col("canonical"), allowed)
    c = candidates.select("doc_id", "ord", F.coalesce("esmiles", F.lit("")).alias("esmiles"), "name", "source", "confidence", "page", "canonical", reason.alias("reason"))
    c = c.withColumn("rejected", F.col("reason").isNotNull()).withColumn("key", F.when(F.col("reason").isNull(), F.col("canonical")).otherwise(F.col("esmiles")))
    one = ["doc_id", "rejected", "key"]
    # Sources are few for each molecule: they are made distinct before they are listed, and so detections are ranked and cut.
    sourced = c.groupBy(*one, "source").agg(F.min("ord").alias("ord"), F.count("*").alias("n"), F.min_by(F.struct("esmiles", "name", "reason"), "ord").alias("first"))
    seen = F.transform(F.sort_array(F.collect_list(F.struct("ord", "source"))), lambda x: x["source"])
    heads = sourced.groupBy(*one).agg(F.min("ord").alias("ord"), F.sum("n").alias("n_detections"), F.min_by("first", "ord").alias("first"), seen.alias("sources"))
    place = F.row_number().over(W.partitionBy(*one).orderBy(F.desc("confidence"), "ord"))
    top = c.withColumn("place", place).where(F.col("place") <= listed)
    found = F.transform(F.sort_array(F.collect_list(F.struct("place", "confidence", "page", "source", "ord"))), lambda x: F.struct(x["confidence"], x["page"], x["source"], x["ord"]))
    lists = top.groupBy(*(F.col(k).alias(f"_{k}") for k in one)).agg(found.alias("detections"))
    both = heads.join(lists, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("rejected") == F.col("_rejected")) & F.col("key").eqNullSafe(F.col("_key")))
    position = F.row_number().over(W.partitionBy("doc_id").orderBy("rejected", "ord"))
    status = F.when(F.col("rejected"), "rejected").otherwise("pending")
    return both.select("doc_id", position.alias("position"), F.col("key").alias("canonical_smiles"), "first.esmiles", "first.name", "sources", "n_detections", "detections", status.alias("status"), "first.reason")


def persist(tx: Transaction, molecules: DataFrame, records: DataFrame | None = None) -> None:
    """Commit normalised molecules of some documents in the caller's transaction: molecules, first detections, figure evidence and activities.

    ``records``: doc_id, rec_id, table_idx, row_idx, col_idx, row_label, row_smiles, page_num, confidence, value, activity_type, unit, raw_text.
    A molecule takes the record of a table row that names it, else the most confident one of its first detection's page, once a page.
    What a stored molecule has stays but for its activity, which is that of the last document. Detections and evidence of the documents
    (but text evidence) replace their earlier ones.
    """
    good = molecules.where("status != 'rejected' AND canonical_smiles IS NOT NULL AND canonical_smiles != ''").withColumn("d", F.get("detections", F.lit(0)))
    stored = good.select("doc_id", "position", "canonical_smiles", "esmiles", "name", F.col("d.page").alias("page"), F.col("d.confidence").alias("confidence"))
    ids = molecules.select("doc_id").distinct()
    if tx.exists("molecule_detections"):
        tx.delete("molecule_detections", ids)
    if tx.exists("evidence"):
        tx.delete("evidence", ids.withColumn("kind", F.explode(F.array(*map(F.lit, ("figure", "table", "table_row"))))))
    head = F.col("mol_id").alias("canonical_smiles")
    found = tx.append("molecule_detections", stored.select(F.col("canonical_smiles").alias("mol_id"), "doc_id", F.col("position").cast("long"), F.col("page").cast("int"), "confidence", "esmiles", "name"))
    rows = shaped(found.select(head, "mol_id", "doc_id", "page", F.lit("detected").alias("role"), F.lit("figure").alias("kind"), "confidence", F.lit("image").alias("source_type")), EVIDENCE)
    new = found.groupBy("mol_id").agg(F.min_by(F.struct("esmiles", "name"), F.struct("doc_id", "position")).alias("m")).select(
        "mol_id", F.col("mol_id").alias("smiles"), "m.esmiles", F.coalesce("m.name", F.lit("")).alias("name"), F.lit("image").alias("source_type"), F.lit("pending").alias("status"), head
    )
    molecule_rows = shaped(new, MOLECULE)
    if tx.exists("molecules"):
        have = shaped(tx.read("molecules"), MOLECULE)
        touched = have.join(new.select("mol_id"), "mol_id", "left_semi").withColumn("canonical_smiles", F.coalesce("canonical_smiles", "mol_id"))
        molecule_rows = molecule_rows.join(have.select("mol_id"), "mol_id", "left_anti").select(*MOLECULE).unionByName(touched.select(*MOLECULE))
    if records is not None:
        c = found.select("doc_id", F.col("position").alias("cand_id"), "name", F.col("mol_id").alias("canonical"), "esmiles", "page")
        linked = linked_activities(c, records).withColumnRenamed("cand_id", "position").join(found.select("doc_id", "position", "mol_id"), ["doc_id", "position"])
        linked = kept(linked.join(records, ["doc_id", "rec_id"]), "linked")  # evidence and molecules both take from it
        at_row = lambda c: F.when(F.col("kind") == "table_row", F.col(c)).alias(c)
        activities = linked.select(
            head, "mol_id", "doc_id", F.col("page_num").alias("page"), F.lit("activity_data").alias("role"), "kind", "confidence", F.lit("llm_extraction").alias("source_type"),
            F.substring(F.coalesce("raw_text", F.lit("")), 1, 500).alias("context_text"), at_row("row_label"), at_row("table_idx"), at_row("row_idx"), at_row("col_idx"),
        )
        rows = rows.unionByName(shaped(activities, EVIDENCE))
        last = linked.groupBy(F.col("mol_id").alias("_m")).agg(F.max_by(F.struct("value", "activity_type", "unit"), F.struct("doc_id", "position")).alias("a"))
        value = lambda c, a: F.when(F.col("a").isNotNull(), F.col(f"a.{a}")).otherwise(F.col(c)).alias(c)
        changed = {"activity": "value", "activity_type": "activity_type", "units": "unit"}
        joined = molecule_rows.join(last, F.col("mol_id") == F.col("_m"), "left")
        molecule_rows = joined.select(*(value(c, changed[c]) if c in changed else F.col(c) for c in MOLECULE))
    tx.append("evidence", rows)
    tx.replace("molecules", shaped(molecule_rows, MOLECULE), ["mol_id"])
