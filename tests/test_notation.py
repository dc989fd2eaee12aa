"""Atoms, the extended notation by the examples of its text, fragments, text order, cached search in one pass, bounded logs."""

import pytest
from pyspark.sql import functions as F

from assayspark.functions import chem
from assayspark.functions import text as T
from assayspark.operators import relational as R
from assayspark.operators import search as S
from assayspark.operators import sections as X
from assayspark.streaming import logs


def each(spark, f, values):
    df = spark.createDataFrame(list(enumerate(values)), "k int, s string")
    return [r[0] for r in df.orderBy("k").select(f(F.col("s")).alias("r")).collect()]


def test_atoms_in_brackets(spark):
    texts = ["c1cc[as]cc1", "c1cc[se]c1", "[nH]1cccc1", "[13C@H](Cl)Br", "[Re]C", "[Fe]C", "*C[*]", "[cH-]1cccc1", "", None]
    want = [["C", "C", "C", "As", "C", "C"], ["C", "C", "C", "Se", "C"], ["N", "C", "C", "C", "C"], ["C", "Cl", "Br"], ["Re", "C"], ["Fe", "C"], ["*", "C", "*"], ["C"] * 5, [], None]
    assert each(spark, chem.atoms, texts) == want
    assert each(spark, chem.foreign_elements, texts)[:6] == [[], [], [], [], ["Re"], ["Fe"]]


SPEC = [
    ("*c1ccccc1<sep><a>0:R[1]</a>", "*c1ccccc1", [("a", 0, "R[1]", "R1")], None),
    ("*CC(=O)O<sep><a>0:<dum></a>", "*CC(=O)O", [("a", 0, "<dum>", "<dum>")], None),
    ("c1ccccc1<sep><r>0:R[1]</r><r>0:R[2]</r>", "c1ccccc1", [("r", 0, "R[1]", "R1"), ("r", 0, "R[2]", "R2")], None),
    ("<sep><c>0:B</c>", "", [("c", 0, "B", "B")], None),
    ("**C1*C(*)=C(C(*)(*)C2=CC=NC=C2)N=1<sep><a>0:R[4]</a><a>1:X</a><r>1:R[5]?n</r><a>3:Z</a>", "**C1*C(*)=C(C(*)(*)C2=CC=NC=C2)N=1",
     [("a", 0, "R[4]", "R4"), ("a", 1, "X", "X"), ("r", 1, "R[5]?n", "R5?n"), ("a", 3, "Z", "Z")], None),
    ("********<sep><a>0:R[1]</a><c>0:B</c><a>13:R[7]</a>", "********", [("a", 0, "R[1]", "R1"), ("c", 0, "B", "B"), ("a", 13, "R[7]", "R7")], None),
    ("<c>1:R1</c>CC(=O)Oc1ccccc1C(=O)O", "CC(=O)Oc1ccccc1C(=O)O", [("c", 1, "R1", "R1")], "separator"),
    ("CCO", "CCO", [], None),
    ("CCO<sep>", "CCO", [], "empty"),
    ("*C<sep><a>0:Ph", "*C", [], "rest"),
    ("*C<sep><a>x:Ph</a>", "*C", [], "rest"),
    ("*C<sep><a>0:<a>1:Ph</a></a>", "*C", [("a", 0, "<a>1:Ph", "<a>1:Ph")], "rest"),
    ("*C<sep><a>0:Ph</r>", "*C", [], "rest"),
    ("*C<sep><a>0:Ph</a> and", "*C", [("a", 0, "Ph", "Ph")], "rest"),
]


def test_extended_notation(spark):
    got = each(spark, chem.layers, [s for s, *_ in SPEC] + [None])
    for (text, smiles, tags, error), r in zip(SPEC, got[:-1], strict=True):
        assert (r["smiles"], [tuple(t) for t in r["tags"]], r["error"]) == (smiles, tags, error), text
    assert got[-1] is None


def test_group_names(spark):
    names = ["R[1]", "R^1", "boc", "OCH3", "MeO", "CO2H", "Tos", "X", "free text", "R[2]?n", "Ring"]
    assert each(spark, chem.group_name, names) == ["R1", "R1", "Boc", "OMe", "OMe", "COOH", "Ts", "X", "free text", "R2?n", "Ring"]


def test_fragments(spark):
    texts = ["CC.O", "O.CC", "C.N", "C[X.Y]C.CC", "", None, "..", "[NH4+].[Cl-].CCO"]
    assert each(spark, chem.main_fragment, texts) == ["CC", "CC", "C", "C[X.Y]C", None, None, None, "CCO"]
    assert each(spark, chem.atom_count, ["CC(=O)O", "[NH4+]", "", "c1ccccc1Cl"]) == [4, 1, 0, 7]


def test_text_order_of_a_reader(spark):
    names = ["zebra", "Étude", "etude", "Zug", "étude", None, "Etude", "10", "9"]
    df = spark.createDataFrame(list(enumerate(names)), "k int, name string")
    up = [r["name"] for r in df.orderBy(*R.text_order("name", True, "k")).collect()]
    assert up == ["10", "9", "etude", "Etude", "étude", "Étude", "zebra", "Zug", None]
    assert [r["name"] for r in df.orderBy(*R.text_order("name", False, "k")).collect()] == up[::-1]


def test_several_searches_scan_the_documents_once(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows = [(k, "the red red fox" if k % 2 else "the dog") for k in range(20)] + [(20, None), (21, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    queries = spark.createDataFrame([(1, "red fox", None), (2, " RED fox ", None), (3, "dog", 4), (4, "the", None), (5, "nothing", None), (6, "", None)], "query_id long, query string, doc_filter long")
    cache = spark.createDataFrame([], "query_hash string, place int, doc_id long, score double")
    found, stored = S.cached_search(docs, queries, cache, k=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    got = {}
    for r in found.orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"], r["from_cache"]))
    assert got[1] == got[2] == [(k, 0.15, False) for k in (1, 3, 5)]
    assert got[3] == [(4, 0.1, False)] and [d for d, _, _ in got[4]] == [0, 1, 2] and 5 not in got and 6 not in got
    assert stored.count() == 3 + 1 + 3
    again, after = S.cached_search(docs, queries.where("query_id < 5"), stored, k=3)
    assert {r["from_cache"] for r in again.collect()} == {True} and after.count() == 7
    other, _ = S.cached_search(docs, queries.where("query_id = 1"), stored, k=2)  # another number of results is another query
    assert [r["from_cache"] for r in other.collect()] == [False, False]


def test_term_frequencies_of_several_queries(spark):
    df = spark.createDataFrame([("aa a Aé",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(T.term_frequencies(F.col("t"), ["a", "aa é", "", "a a"])).collect()]
    assert got == [[4, 2, 0, 4], [None, None, 0, None], [0, 0, 0, 0]]


def test_located_by_label_or_string(spark):
    rows = spark.createDataFrame([("d", 0, 1, ["name", "nM"]), ("d", 0, 2, ["1A ", "12.5 nM"]), ("d", 0, 3, ["1a", "9"]), ("d", 1, 1, ["CCO", "7"]), ("d", 1, 2, [])], "doc_id string, table_idx long, row_idx int, cells array<string>")
    records = spark.createDataFrame([("d", 1, 0, "1a", None, 12.5), ("d", 2, 1, "zz", "CCO", 8.0), ("d", 3, 0, "none", None, 1.0), ("d", 4, 0, None, "1a", 9.0), ("e", 5, 0, "1a", None, 9.0)], "doc_id string, rec_id long, table_idx long, row_label string, row_smiles string, value_original double")
    got = {r["rec_id"]: (r["row_idx"], r["col_idx"]) for r in X.located(records, rows).collect()}
    assert got == {1: (2, 1), 2: (1, None), 3: (None, None), 4: (None, None), 5: (None, None)}


@pytest.mark.parametrize("n_docs", [1, 2, 5])
def test_logs_of_the_last_documents(spark, n_docs):
    rows = [("a", 1, "x"), ("b", 2, "x"), ("a", 9, "y"), ("c", 3, "x"), ("c", 3, "x"), ("c", 4, "y"), ("c", 5, "z")]
    kept = []  # documents as they come; the first goes when there are too many
    for doc, _, _ in sorted(rows, key=lambda r: r[1]):
        if doc not in kept:
            kept.append(doc)
    kept = kept[-n_docs:]
    got = logs.merged_logs_of_last(spark.createDataFrame(rows, "doc_id string, ts_ms long, message string"), 2, n_docs).collect()
    want = {(d, t, m) for d, t, m in rows if d in kept and (d, t) not in {("c", 3)}}
    assert {tuple(r) for r in got} == want
