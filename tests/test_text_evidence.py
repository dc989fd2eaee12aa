"""Needles by automaton, structure blocks with their places, and the registration of text evidence as one commit."""

import random
import re

import pytest

from assayspark.operators import evidence as E
from assayspark.operators import matching as M
from assayspark.sources.library import Library


def test_needle_hits_equal_every_pair(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    texts = [(g, k, word(rng.randrange(0, 30))) for g in range(6) for k in range(10)] + [(7, 0, "aa"), (None, 0, "a"), (0, 99, None)]
    needles = [(g, str(k % 7), word(rng.randrange(0, 4))) for g in range(7) for k in range(12)] + [(7, "x", "a"), (7, "y", "aa"), (7, "z", None), (None, "n", "a")]
    t, n = spark.createDataFrame(texts, "g long, text_no int, text string").repartition(3), spark.createDataFrame(needles, "g long, needle_no string, needle string")
    want = {(g, no, k) for g, no, needle in needles if g is not None and needle for h, k, text in texts if h == g and text is not None and needle in text}
    got = [tuple(r) for r in M.needle_hits(t, n, "g").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    first = {}
    for g, no, k in want:
        first[g, no] = min(k, first.get((g, no), 10**9))
    assert {(r[0], r[1]): r[2] for r in M.needle_hits(t, n, "g", first=True).collect()} == first
    plan = M.needle_hits(t, n, "g")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


TEXT = "# One\nintro é\n```molecode\nflow Aspirin\nCC(=O)Oc1ccccc1C(=O)O\n```\nmore\n```molecode\n\n```\n```molecode\nAspirin again, Benzene\n```\n"
MOLECULES = [
    (1, "CC(=O)Oc1ccccc1C(=O)O", "e1", "", "pending"),
    (1, "c1ccccc1", "e2", "Benzene", "pending"),
    (1, "CCO", "e3", "Aspirin", None),
    (1, "CCN", "e4", "nowhere", "pending"),
    (1, "CCCC", "e5", "Aspirin", "rejected"),
    (2, "CCO", "e6", "Aspirin", "pending"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, TEXT), (2, "no block, Aspirin"), (3, None), (4, "")], "doc_id long, text string")


@pytest.fixture(scope="module")
def molecules(spark):
    return spark.createDataFrame(MOLECULES, "doc_id long, mol_id string, esmiles string, name string, status string")


def test_blocks_with_their_places(docs):
    want = [(m.group(1), m.start(), m.end()) for m in re.finditer(r"```molecode\n(.*?)\n```", TEXT, re.DOTALL)]
    got = E.code_blocks(docs).orderBy("block_idx").collect()
    assert [(r["block"], r["char_start"], r["char_end"]) for r in got] == want and len(want) == 3


def test_text_evidence(docs, molecules):
    starts = [m.start() for m in re.finditer("```molecode", TEXT)]
    got = {(r["doc_id"], r["mol_id"]): r for r in E.text_evidence(docs, molecules).collect()}
    assert set(got) == {(d, m) for d, m, _, _, s in MOLECULES if s != "rejected"}
    at = {k: r["char_start"] for k, r in got.items() if r["char_end"]}
    # By the start of the string, by the string within a longer one, by name.
    assert at == {(1, "CC(=O)Oc1ccccc1C(=O)O"): starts[0], (1, "c1ccccc1"): starts[0], (1, "CCO"): starts[0]}
    assert got[1, "CCN"]["text_excerpt"] == "position unresolved" and got[1, "CCN"]["code_text"] == ""
    assert got[1, "CC(=O)Oc1ccccc1C(=O)O"]["name"] == "Mol_CC(=O)Oc"
    r = got[1, "CCO"]
    assert r["code_text"] == TEXT[r["char_start"] : r["char_end"]]
    assert r["text_excerpt"] == TEXT[max(0, r["char_start"] - 200) : r["char_end"] + 200].replace("\n", " ")[:500]
    assert got[2, "CCO"]["text_excerpt"] == "position unresolved"


def test_registration_is_one_commit_that_can_be_repeated(spark, docs, molecules, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/lib")
    with lib.transaction() as tx:
        tx.append("molecules", spark.createDataFrame([("CCO", "OCC", "kept", "ethanol", "image", "confirmed", None, 1.5, "IC50", "nM")], ", ".join(f"{c} {k}" for c, k in E.MOLECULE.items())))
    for _ in range(2):
        lib.run(lambda tx: E.register_text_evidence(tx, docs, molecules))
        known = {r["mol_id"]: r for r in lib.read("molecules").collect()}
        assert len(known) == lib.read("molecules").count() == 4
        assert (known["CCO"]["name"], known["CCO"]["status"], known["CCO"]["canonical_smiles"], known["CCO"]["activity"]) == ("ethanol", "confirmed", "CCO", 1.5)
        assert lib.read("text_molecule_links").count() == lib.read("evidence").where("kind = 'text'").count() == 5
    before = lib.version()
    with pytest.raises(RuntimeError), lib.transaction() as tx:
        E.register_text_evidence(tx, docs, molecules.limit(1))
        raise RuntimeError
    assert lib.version() == before and lib.read("evidence").count() == 5


def test_lines_of_spans_with_repeated_text(spark):
    spans = spark.createDataFrame([(1, 0, "Repeated text first."), (1, 1, "Repeated text second."), (2, 0, "Page two text."), (2, 1, ""), (3, 0, "nowhere")], "page_id long, span_idx int, text string")
    lines = spark.createDataFrame([(1, 1, "Repeated text first."), (1, 2, "Repeated text second."), (2, 4, "Page one text."), (2, 5, "Page two text."), (3, 7, "else")], "page_id long, line_no int, line string")
    got = {(r["page_id"], r["span_idx"]): r["line_no"] for r in M.span_lines(spans, lines).collect()}
    assert got == {(1, 0): 1, (1, 1): 2, (2, 0): 5}
