"""Candidates normalised against a plain loop, and their commit with detections, evidence and activities."""

import random

import pytest

from assayspark.functions import chem
from assayspark.operators import candidates as C
from assayspark.operators import evidence as E
from assayspark.sources.library import Library

SCHEMA = "doc_id long, ord int, esmiles string, name string, source string, confidence double, page int, valid boolean, canonical string"
RECORDS = (
    "doc_id long, rec_id long, table_idx int, row_idx int, col_idx int, row_label string, row_smiles string, page_num int, confidence double, value double, activity_type string, unit string, raw_text string"
)


def made(seed=1, n=120):
    rng = random.Random(seed)
    known = {"CCO": "CCO", "OCC": "CCO", "c1ccccc1": "c1ccccc1", "[Re]CC": "[Re]CC", "nonsense": None, "C": "C", "123456": None, "": None, None: None, "[Fe]CC": "[Fe]CC"}
    rows = []
    for k in range(n):
        s = rng.choice(list(known))
        rows.append((rng.choice([1, 2, 3]), k, s, rng.choice(["a", "b", None]), rng.choice(["image", "text"]), rng.choice([0.1, 0.5, 0.5, None]), rng.choice([1, 2, None]), known[s] is not None, known[s]))
    return rows


def plain(rows, allowed):
    out = {}
    for doc in {r[0] for r in rows}:
        good, bad = {}, {}
        for r in sorted((r for r in rows if r[0] == doc), key=lambda r: r[1]):
            s = r[2] or ""
            why = None
            if len(s) < 3 or s.isdigit():
                why = "low_quality_smiles"
            elif not r[7]:
                why = "invalid_smiles"
            elif any(x in s and x not in allowed for x in ("Re", "Fe")):
                why = "invalid_element"
            side, key = (bad, s) if why else (good, r[8])
            m = side.setdefault(key, {"esmiles": s, "name": r[3], "sources": [], "d": [], "reason": why})
            m["d"].append((r[5], r[6], r[4], r[1]))
            if r[4] not in m["sources"]:
                m["sources"].append(r[4])
        rows_ = [(k, m) for side in (good, bad) for k, m in side.items()]
        out[doc] = [(k, m["esmiles"], m["name"], m["sources"], sorted(m["d"], key=lambda d: (-(d[0] if d[0] is not None else -1), d[3])), m["reason"]) for k, m in rows_]
    return out


@pytest.mark.parametrize("more", [(), ("Fe",)])
def test_normalised_equals_a_plain_loop(spark, more):
    allowed = (*chem.ELEMENTS, *more)
    rows = made()
    df = C.normalised(spark.createDataFrame(rows, SCHEMA).repartition(3), allowed)
    got = {}
    for r in df.orderBy("doc_id", "position").collect():
        assert (r["status"] == "rejected") == (r["reason"] is not None) and r["n_detections"] == len(r["detections"])
        got.setdefault(r["doc_id"], []).append((r["canonical_smiles"], r["esmiles"], r["name"], r["sources"], [tuple(d) for d in r["detections"]], r["reason"]))
    assert got == plain(rows, allowed)


def test_merged_and_rejected_as_stated(spark):
    rows = [(1, 0, "CCO", "x", "text", 0.5, 1, True, "CCO"), (1, 1, "OCC", "y", "image", 0.9, 2, True, "CCO"), (1, 2, "C", "", "text", 0.1, 1, True, "C"), (1, 3, "12345", "", "text", 0.1, 1, False, None), (1, 4, "[Re]C", "", "text", 0.1, 1, True, "[Re]C")]
    got = C.normalised(spark.createDataFrame(rows, SCHEMA)).orderBy("position").collect()
    assert [(r["canonical_smiles"], r["status"], r["reason"]) for r in got] == [("CCO", "pending", None), ("C", "rejected", "low_quality_smiles"), ("12345", "rejected", "low_quality_smiles"), ("[Re]C", "rejected", "invalid_element")]
    assert [d["confidence"] for d in got[0]["detections"]] == [0.9, 0.5] and got[0]["sources"] == ["text", "image"]
    assert C.normalised(spark.createDataFrame([], SCHEMA)).collect() == []


def test_persisted_with_activities_and_again(spark, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/lib")
    rows = [(1, 0, "CCO", "1a", "image", 0.9, 1, True, "CCO"), (1, 1, "CCN", "1b", "image", 0.8, 2, True, "CCN"), (1, 2, "CCC", "1c", "image", 0.7, 2, True, "CCC"), (1, 3, "??!", "", "image", 0.7, 2, False, None), (2, 0, "OCC", "z", "image", 0.4, 5, True, "CCO")]
    records = [(1, 10, 0, 2, 1, " 1A ", None, 1, 0.5, 12.5, "IC50", "nM", "t" * 600), (1, 11, None, None, None, None, None, 2, 0.9, 7.0, "Ki", "nM", None), (1, 12, None, None, None, None, None, 2, 0.2, 8.0, "Ki", "nM", ""), (2, 13, None, None, None, None, None, 5, 0.1, 99.0, "EC50", "uM", "")]
    molecules, acts = C.normalised(spark.createDataFrame(rows, SCHEMA)), spark.createDataFrame(records, RECORDS)
    with lib.transaction() as tx:
        tx.append("evidence", E.shaped(spark.createDataFrame([("CCO", 1, "text")], "mol_id string, doc_id long, kind string"), E.EVIDENCE))
    for _ in range(2):
        lib.run(lambda tx: C.persist(tx, molecules, acts))
        known = {r["mol_id"]: (r["name"], r["activity"], r["activity_type"], r["units"]) for r in lib.read("molecules").collect()}
        # The last document's activity counts for a molecule of several; of a page the first molecule without a row takes the best record.
        assert known == {"CCO": ("1a", 99.0, "EC50", "uM"), "CCN": ("1b", 7.0, "Ki", "nM"), "CCC": ("1c", None, None, None)}
        got = sorted((r["doc_id"], r["mol_id"], r["kind"], r["page"], r["row_idx"], len(r["context_text"] or "")) for r in lib.read("evidence").collect() if r["kind"] != "text")
        assert [g[:3] for g in got] == [(1, "CCC", "figure"), (1, "CCN", "figure"), (1, "CCN", "table"), (1, "CCO", "figure"), (1, "CCO", "table_row"), (2, "CCO", "figure"), (2, "CCO", "table")]
        assert got[4][3:] == (1, 2, 500) and got[2][3:] == (2, None, 0)
        assert lib.read("evidence").where("kind = 'text'").count() == 1 and lib.read("molecule_detections").count() == 4
    lib.run(lambda tx: C.persist(tx, molecules.where("doc_id = 2"), None))
    assert lib.read("evidence").where("doc_id = 2").count() == 1 and lib.read("molecules").where("mol_id = 'CCO'").first()["activity"] == 99.0


def test_activities_are_linked_once(spark, tmp_path, monkeypatch):
    runs = spark.sparkContext.accumulator(0)
    plain = C.linked_activities

    def counted(c, r):
        def seen(batches):
            runs.add(1)
            yield from batches

        out = plain(c, r).coalesce(1)
        return out.mapInArrow(seen, out.schema)

    monkeypatch.setattr(C, "linked_activities", counted)
    c = spark.createDataFrame([(1, 1, "CCO", "m", "a", 0.5, 1, True, "CCO")], "doc_id long, ord int, esmiles string, name string, source string, confidence double, page int, valid boolean, canonical string")
    r = spark.createDataFrame([(1, 9, 0, 1, 1, "M", None, 1, 0.5, 2.0, "IC50", "nM", "m 2")], "doc_id long, rec_id long, table_idx int, row_idx int, col_idx int, row_label string, row_smiles string, page_num int, confidence double, value double, activity_type string, unit string, raw_text string")
    library = Library(spark, f"file://{tmp_path}/once")
    library.run(lambda tx: C.persist(tx, C.normalised(c), r))
    assert library.read("evidence").where("kind = 'table_row'").count() == 1 and library.read("molecules").first().activity == 2.0
    assert runs.value == 1
