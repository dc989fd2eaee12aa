"""The evidence chain: candidates to molecules, molecules to ranked evidence, text links, aliases."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayspark.functions import chem
from assayspark.operators.matching import needle_hits
from assayspark.operators.relational import top_per_group
from assayspark.scratch import kept
from assayspark.sources.library import Transaction

LIST_LIMIT, FULL_LIMIT = 50, 100_000
REASONS = ("low_quality_smiles", "invalid_smiles", "invalid_element", "canonicalization_failed")


def composite(detector: Column, reader: Column) -> Column:
    """Product of two confidences where the second is set, else the first."""
    return F.when(reader > 0, detector * reader).otherwise(F.coalesce(detector, F.lit(0.0)))


def rejection(smiles: Column, valid: Column, canonical: Column, allowed: tuple[str, ...] = chem.ELEMENTS) -> Column:
    """Why a candidate is rejected, null if it isn't. ``valid`` and ``canonical`` come from a toolkit."""
    return (
        F.when(chem.low_quality(smiles), F.lit(REASONS[0])).when(~F.coalesce(valid, F.lit(False)), F.lit(REASONS[1]))
        .when(F.size(chem.foreign_elements(smiles, allowed)) > 0, F.lit(REASONS[2])).when(canonical.isNull(), F.lit(REASONS[3]))
    )


def merged(candidates: DataFrame, key: str = "canonical", limit: int = FULL_LIMIT) -> DataFrame:
    """One row for each key: its first ``limit`` detections by falling confidence (then order), their number, sources and name as first seen.

    ``candidates`` has the key, ``ord``, ``confidence``, ``source``, ``name``. Detections are ranked and cut before they
    are listed, and sources are made distinct before they are, so a list is bounded by the limit or the number of sources.
    """
    first = candidates.groupBy(key, "source").agg(F.min("ord").alias("ord"), F.min_by("name", "ord").alias("name"), F.count("*").alias("n"))
    seen = F.transform(F.sort_array(F.collect_list(F.struct("ord", "source"))), lambda x: x["source"])
    heads = first.groupBy(key).agg(seen.alias("sources"), F.min_by("name", "ord").alias("name"), F.sum("n").alias("n_detections"))
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc("confidence"), "ord", "source"))
    top = candidates.withColumn("place", place).where(F.col("place") <= limit)
    found = F.transform(F.sort_array(F.collect_list(F.struct("place", "confidence", "ord", "source"))), lambda x: F.struct(x["confidence"], x["ord"], x["source"]))
    lists = top.groupBy(F.col(key).alias("_key")).agg(found.alias("detections"))
    return heads.join(lists, F.col(key).eqNullSafe(F.col("_key"))).select(key, "name", "sources", "n_detections", "detections")


def first_seen(df: DataFrame, value: str, order: str) -> DataFrame:
    """The first row of each value."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(value).orderBy(order))).where("_n = 1").drop("_n")


def with_evidence(molecules: DataFrame, evidence: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """Molecules with their first pieces of evidence as a list and the number of all.

    The evidence key is the canonical form, else the id. Evidence is ranked and cut before it is joined; addresses of crops go with it.
    """
    order = [F.asc("kind"), F.asc("doc_id"), F.asc("page"), F.asc("evidence_id")]
    top = top_per_group(evidence, "canonical", order, limit)
    item = F.struct("place", "evidence_id", "kind", "doc_id", "page", *(c for c in ("crop_url",) if c in evidence.columns))
    lists = top.groupBy(F.col("canonical").alias("_c")).agg(F.sort_array(F.collect_list(item)).alias("evidence"), F.max("total").alias("evidence_total"))
    m = molecules.withColumn("_key", F.coalesce("canonical", "mol_id"))
    out = m.join(lists, F.col("_key") == F.col("_c"), "left").drop("_key", "_c")
    return out.withColumn("evidence_total", F.coalesce("evidence_total", F.lit(0)))


def aliases(rows: DataFrame, key: str) -> DataFrame:
    """Distinct non-empty labels of each key in first-seen order; made distinct before they are listed."""
    kept = rows.where(F.coalesce("label", F.lit("")) != "")
    first = kept.groupBy(key, "label").agg(F.min(F.struct("doc_id", "page", "id")).alias("at"))
    return first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]).alias("aliases"))


def chain(predictions: DataFrame, smiles: object, label: object = None) -> DataFrame:
    """One row on a molecule's predictions, by its string or a label: ``aliases``, the names that they give it in first-seen order, and ``n_occurrences``."""
    hit = (F.col("mol_smiles") == F.lit(smiles)) | F.coalesce(F.col("label_text") == F.lit(label), F.lit(False))
    found = predictions.where(F.coalesce(hit, F.lit(False)))
    named = aliases(found.select(F.lit(0).alias("_m"), F.col("label_text").alias("label"), "doc_id", "page", "id"), "_m")
    total = found.agg(F.count("*").alias("n_occurrences")).withColumn("_t", F.lit(0))
    nothing = F.array().cast("array<string>")
    return total.join(named, F.col("_t") == F.col("_m"), "left").select(F.coalesce("aliases", nothing).alias("aliases"), "n_occurrences")


def prediction_group(bbox: Column, smiles: Column, pred_id: Column) -> Column:
    """The group of a prediction: its box, else its string, else itself."""
    return F.coalesce(F.concat(F.lit("bbox:"), bbox), F.concat(F.lit("smi:"), F.nullif(smiles, F.lit(""))), F.concat(F.lit("pred:"), pred_id.cast("string")))


def detection_tallies(rows: DataFrame, key: str) -> DataFrame:
    """Confirmed, pending and rejected detections and the sorted sources of each key."""
    tally = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    return rows.groupBy(key).agg(tally("confirmed"), tally("pending"), tally("rejected"), F.array_sort(F.collect_set("source")).alias("sources"))


def text_links(blocks: DataFrame, molecules: DataFrame) -> DataFrame:
    """For each molecule the first block of its document that holds its name, or the first 12 characters of its string."""
    of = lambda c: molecules.select("doc_id", F.col("mol_id").alias("needle_no"), c.alias("needle"))
    needles = of(F.col("name")).unionByName(of(F.substring("smiles", 1, 12)))
    texts = blocks.select("doc_id", F.col("block_idx").alias("text_no"), F.col("block").alias("text"))
    return needle_hits(texts, needles, "doc_id", first=True).select("doc_id", F.col("needle_no").alias("mol_id"), F.col("text_no").alias("block_idx"))


BLOCK = r"(?s)```molecode\n(.*?)\n```"
#: Blocks that a task hands on at a time.
BLOCKS_HELD = 2000


def code_blocks(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``block_idx`` from 0, ``block`` (its inside), ``char_start``, ``char_end`` (with its fences, from 0) of each structure block."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(BLOCK)
        held: list[tuple] = []

        def handed(ids: pa.DataType) -> pa.RecordBatch:
            kinds = (ids, pa.int32(), pa.string(), pa.int32(), pa.int32())
            arrays = [pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "block_idx", "block", "char_start", "char_end"])

        for b in batches:
            for row in range(b.num_rows):
                doc = b.column(0)[row].as_py()
                held.extend((doc, k, m.group(1), m.start(), m.end()) for k, m in enumerate(pattern.finditer(b.column(1)[row].as_py())))
                if len(held) >= BLOCKS_HELD:
                    yield handed(b.schema.field(0).type)
            if held:
                yield handed(b.schema.field(0).type)

    fenced = docs.where(F.col("text").contains("```molecode")).select("doc_id", "text")
    return fenced.mapInArrow(work, f"doc_id {kind}, block_idx int, block string, char_start int, char_end int")


def text_evidence(docs: DataFrame, molecules: DataFrame, around: int = 200) -> DataFrame:
    """Where the text of its document shows each molecule that isn't rejected: ``doc_id``, ``mol_id``, ``esmiles``, ``name``, ``text_excerpt``, ``role``, ``code_text``, ``char_start``, ``char_end``.

    ``docs``: doc_id, text; ``molecules``: doc_id, mol_id (the canonical string), esmiles, name, status. A molecule without a block has a note
    in place of an excerpt, and no place.
    """
    name = F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("Mol_"), F.substring("mol_id", 1, 8)))
    m = molecules.where(F.coalesce("status", F.lit("")) != "rejected").select("doc_id", "mol_id", "esmiles", name.alias("name"))
    blocks = kept(code_blocks(docs), "blocks")  # read twice
    links = text_links(blocks, m.select("doc_id", "mol_id", "name", F.col("mol_id").alias("smiles")).distinct())
    placed = links.join(blocks.select("doc_id", "block_idx", "char_start", "char_end"), ["doc_id", "block_idx"]).join(docs.select("doc_id", "text"), "doc_id")
    start = F.greatest(F.lit(0), F.col("char_start") - around)
    shown = F.replace(F.substring(F.col("text"), start + 1, F.col("char_end") + around - start), F.lit("\n"), F.lit(" "))
    code = F.substring(F.col("text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    at = placed.select(F.col("doc_id").alias("_d"), F.col("mol_id").alias("_m"), F.substring(shown, 1, 500).alias("text_excerpt"), F.substring(code, 1, 1000).alias("code_text"), "char_start", "char_end")
    out = m.join(at, (F.col("doc_id") == F.col("_d")) & (F.col("mol_id") == F.col("_m")), "left")
    return out.select(
        "doc_id", "mol_id", "esmiles", "name", F.coalesce("text_excerpt", F.lit("position unresolved")).alias("text_excerpt"), F.lit("mentioned").alias("role"),
        F.coalesce("code_text", F.lit("")).alias("code_text"), F.coalesce("char_start", F.lit(0)).alias("char_start"), F.coalesce("char_end", F.lit(0)).alias("char_end"),
    )


#: Columns of stored molecules and evidence, whoever writes them; a document's id keeps its own type.
MOLECULE = {c: "string" for c in ("mol_id", "smiles", "esmiles", "name", "source_type", "status", "canonical_smiles")} | {"activity": "double", "activity_type": "string", "units": "string"}
EVIDENCE = {
    "canonical_smiles": "string", "mol_id": "string", "doc_id": None, "page": "int", "role": "string", "kind": "string", "confidence": "double", "source_type": "string",
    "context_text": "string", "code_text": "string", "row_label": "string", "table_idx": "int", "row_idx": "int", "col_idx": "int",
}


def shaped(df: DataFrame, columns: dict[str, str | None]) -> DataFrame:
    """The named columns in their types, null where ``df`` lacks one."""
    return df.select(*((F.col(c) if k is None else F.col(c).cast(k) if c in df.columns else F.lit(None).cast(k)).alias(c) for c, k in columns.items()))


def register_text_evidence(tx: Transaction, docs: DataFrame, molecules: DataFrame) -> None:
    """Commit the links of a text, its molecules (what a known one has stays) and its evidence rows together, in the caller's transaction.

    Links and text evidence of the documents take the place of their earlier ones, so a repeated run doubles nothing.
    """
    found = text_evidence(docs, molecules)
    ids = docs.select("doc_id").distinct()
    links = found.select("doc_id", "mol_id", "text_excerpt", "role", "code_text", "char_start", "char_end")
    if tx.exists("text_molecule_links"):
        tx.delete("text_molecule_links", ids)
    links = tx.append("text_molecule_links", links)
    new = found.groupBy("mol_id").agg(F.min_by(F.struct("esmiles", "name"), "doc_id").alias("m")).select(
        "mol_id", F.col("mol_id").alias("smiles"), "m.esmiles", "m.name", F.lit("text").alias("source_type"), F.lit("pending").alias("status"), F.col("mol_id").alias("canonical_smiles")
    )
    if tx.exists("molecules"):
        known = shaped(tx.read("molecules"), MOLECULE)
        # Of a known molecule only a missing canonical form is set.
        bare = known.where("canonical_smiles IS NULL").join(new.select("mol_id"), "mol_id", "left_semi").withColumn("canonical_smiles", F.col("mol_id"))
        tx.replace("molecules", shaped(new.join(known.select("mol_id"), "mol_id", "left_anti"), MOLECULE).unionByName(bare), ["mol_id"])
    else:
        tx.append("molecules", shaped(new, MOLECULE))
    rows = links.select(F.col("mol_id").alias("canonical_smiles"), "mol_id", "doc_id", F.col("text_excerpt").alias("context_text"), "code_text", "role", F.lit("text").alias("kind"), F.lit("text").alias("source_type"))
    if tx.exists("evidence"):
        tx.delete("evidence", ids.withColumn("kind", F.lit("text")))
    tx.append("evidence", shaped(rows, EVIDENCE))


def excerpt(text: Column, at: Column, width: int = 200, most: int = 500) -> Column:
    """Text around a place (from 1); a note where there is none."""
    start = F.greatest(F.lit(1), at - width)
    return F.when(at > 0, F.substring(F.substring(text, start, at - start + width), 1, most)).otherwise(F.lit("position unresolved"))


def persisted(candidates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Molecules, first detections and figure evidence of accepted candidates; pages count from 1."""
    ok = candidates.where("reason IS NULL")
    best = ok.groupBy("doc_id", "canonical").agg(F.max_by(F.struct("page", "confidence", "bbox", "name", "esmiles"), F.struct("confidence", -F.col("ord"))).alias("d"))
    molecules = best.groupBy("canonical").agg(F.min_by("d.name", "doc_id").alias("name"), F.min_by("d.esmiles", "doc_id").alias("esmiles")).withColumn("mol_id", F.col("canonical"))
    detections = best.select(F.col("canonical").alias("mol_id"), "doc_id", "d.page", "d.confidence", "d.bbox")
    evidence = detections.select(F.col("mol_id").alias("canonical"), "mol_id", "doc_id", "page", F.lit("figure").alias("kind"), "confidence")
    return molecules, detections, evidence


def occurrences(predictions: DataFrame, value: object) -> DataFrame:
    """All predictions whose string or label is the value, in the order of document, page and id."""
    hit = (F.col("mol_smiles") == F.lit(value)) | (F.col("label_text") == F.lit(value))
    return predictions.where(hit).orderBy("doc_id", "page", "id")


def gated(detections: DataFrame, threshold: float, model: float = 0.5) -> DataFrame:
    """Detections that pass the model's gate and the caller's; a caller's gate below the model's changes nothing."""
    return detections.where(F.col("confidence") >= max(model, threshold))


def crop_url(doc_id: Column, path: Column, root: str) -> Column:
    """The address of a crop by the last part of its path; null without document or crop."""
    name = F.element_at(F.split(path, "/"), -1)
    url = F.concat(F.lit("/api/v1/library/documents/"), doc_id.cast("string"), F.lit("/crop?rel_path="), name, F.lit(f"&library_root={root}"))
    return F.when((F.coalesce(path, F.lit("")) != "") & (F.coalesce(doc_id.cast("string"), F.lit("")) != ""), url)


def numbered_names(molecules: DataFrame) -> DataFrame:
    """Molecules of a document with ``position`` by page and span (without span last on the page) and a name: their own, else by position."""
    order = [F.col("page").asc(), F.coalesce("span_idx", F.lit(9999)).asc(), F.col("ord").asc()]
    out = molecules.withColumn("position", F.row_number().over(W.partitionBy("doc_id").orderBy(*order)))
    return out.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.format_string("Mol_%03d", "position")))


def page_counters(pages: DataFrame, labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """How many labels and predictions were written for each asked page, 0 where none were."""
    key = ["doc_id", "page"]
    n = lambda df, name: df.groupBy(*key).agg(F.count("*").alias(name))
    out = pages.join(n(labels, "labels_written"), key, "left").join(n(predictions, "predictions_written"), key, "left")
    return out.na.fill(0, ["labels_written", "predictions_written"])


def page_view(pages: DataFrame, detections: DataFrame, labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """The structured view of each page: its text as a paragraph (none if blank), molecules, labels and predictions as lists.

    Lists are what stands on one page.
    """
    key = ["doc_id", "page"]

    def listed(df: DataFrame, name: str) -> DataFrame:
        row = F.struct(*[c for c in df.columns if c not in key])
        return df.groupBy(*key).agg(F.sort_array(F.collect_list(row)).alias(name))

    out = pages.select(*key, F.when(F.trim("text") != "", F.array(F.struct(F.lit("paragraph").alias("kind"), F.col("text").alias("content")))).alias("structured_text"))
    for df, name in ((detections, "molecules"), (labels, "labels"), (predictions, "predictions")):
        out = out.join(listed(df, name), key, "left")
    return out
