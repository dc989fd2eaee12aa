from pyspark.sql import functions as F

from assayspark.operators import evidence as E
from assayspark.operators import library as L
from assayspark.operators import relational as R


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_substring_search_takes_no_wildcards(spark):
    df = spark.createDataFrame([("100% solution",), ("1000 solutions",), (None,)], "t string")
    assert rows(R.where_contains(df, "100%", ["t"]), "t") == [("100% solution",)]


def test_page_bounds_and_total(spark):
    df = spark.range(7)
    got = R.page(df, [F.desc("id")], number=2, size=3)
    assert [(r.id, r.total) for r in got.collect()] == [(3, 7), (2, 7), (1, 7)]
    assert R.page(df, [F.asc("id")], number=9, size=3).count() == 0


def test_ranks_of_whole_tables_by_ranges(spark, sf_dir):
    from assayspark.operators import search as S

    orders, docs = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("orders", "documents"))
    found = S.keyword_search(docs, "the license of the that").select("doc_id", "hits")
    labelled = docs.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left").select("doc_id", "quality")
    status = {"P": 0, "O": 1, "F": 2}
    cases = [
        (orders, [R.status_rank("o_orderstatus", ["P", "O", "F"]), F.desc("o_orderdate"), F.asc("o_orderkey")],
         lambda r: (status.get(r.o_orderstatus, 3), -r.o_orderdate.toordinal(), r.o_orderkey)),
        (found, [F.desc("hits"), F.asc("doc_id")], lambda r: (-r.hits, r.doc_id)),
        (labelled, R.client_order("quality", True, "doc_id"), lambda r: (r.quality is None, r.quality or 0, r.doc_id)),
    ]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for df, order, key in cases:
            out = R.ranked(df, order).withColumn("task", F.spark_partition_id()).collect()
            assert [r.position for r in sorted(out, key=key)] == list(range(1, df.count() + 1))
            assert len({r.task for r in out}) > 1  # no task holds all rows
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert R.ranked(orders.limit(0), [F.asc("o_orderkey")]).count() == 0


def test_facets(spark):
    df = spark.createDataFrame([("a", None), ("a", "x"), ("b", "x")], "s string, t string")
    got = {(r.facet, r.value): r.n for r in R.facets(df, ["s", "t"]).collect()}
    assert got == {("s", "a"): 2, ("s", "b"): 1, ("t", None): 1, ("t", "x"): 2, ("total", None): 3}


def test_writes(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, None, 2)], "k int, name string, v int")
    new = spark.createDataFrame([(2, "n", 9), (3, "m", 3)], "k int, name string, v int")
    assert rows(R.upsert_keep_first(base, new, "k", ["name"]), "k", "name", "v") == [(1, "a", 1), (2, "n", 9), (3, "m", 3)]
    assert rows(R.insert_or_ignore(base, new.union(new), ["k"]), "k", "v") == [(1, 1), (2, 2), (3, 3)]
    assert rows(R.patch(base, spark.createDataFrame([(1, None, 7)], "k int, name string, v int"), "k"), "k", "name", "v")[0] == (1, "a", 7)
    assert rows(R.replace(base, new.where("k = 2").select("k", "v"), "k", {"name": "d"}), "k", "name", "v") == [(1, "a", 1), (2, "d", 9)]


def test_collection_tree_keeps_grandchildren(spark):
    c = spark.createDataFrame([(2, "m", 1), (3, "n", 2), (1, "Z", None)], "collection_id long, name string, parent_id long")
    assert rows(L.tree(c), "name", "depth", "path") == [("Z", 0, "Z"), ("m", 1, "Z/m"), ("n", 2, "Z/m/n")]
    kept, _ = L.delete_collection(c, c.limit(0), 2)
    assert rows(kept, "name", "parent_id") == [("Z", None), ("n", 1)]


def test_evidence_list_is_cut_and_counted(spark):
    m = spark.createDataFrame([("CCO", "CCO"), ("x", None)], "mol_id string, canonical string")
    e = spark.createDataFrame([("CCO", "figure", k, 1, k) for k in range(60)] + [("x", "text", 1, 1, 99)], "canonical string, kind string, doc_id int, page int, evidence_id int")
    got = {r.mol_id: (len(r.evidence), r.evidence_total, r.evidence[0].doc_id) for r in E.with_evidence(m, e).collect()}
    assert got == {"CCO": (50, 60, 0), "x": (1, 1, 1)}


def test_merged_candidates(spark):
    c = spark.createDataFrame([("CCO", 0, 0.5, "text", "a"), ("CCO", 1, 0.9, "image", "b"), ("CCN", 2, 0.1, "text", None)], "canonical string, ord int, confidence double, source string, name string")
    got = {r.canonical: ([d.confidence for d in r.detections], r.sources, r.name) for r in E.merged(c).collect()}
    assert got == {"CCO": ([0.9, 0.5], ["text", "image"], "a"), "CCN": ([0.1], ["text"], None)}


def test_rejections(spark):
    c = spark.createDataFrame([("CCO", True, "CCO"), ("C", True, "C"), ("12345", False, None), ("not_a", False, None), ("[Re]C", True, "[Re]C"), ("CCC", True, None)], "s string, valid boolean, canonical string")
    got = [r[0] for r in c.select(E.rejection(F.col("s"), F.col("valid"), F.col("canonical"))).collect()]
    assert got == [None, "low_quality_smiles", "low_quality_smiles", "invalid_smiles", "invalid_element", "canonicalization_failed"]


def test_backfill_can_run_twice(spark):
    t = {
        "molecules": spark.createDataFrame([("m", "", "CCO")], "mol_id string, canonical_smiles string, esmiles string"),
        "molecule_detections": spark.createDataFrame([("m", 1, 1), ("q", 1, 1)], "mol_id string, doc_id int, page int"),
        "evidence": spark.createDataFrame([], "canonical_smiles string, mol_id string, doc_id int, page int, kind string"),
    }
    once, version = L.upgrade(t, 3, {4: L.backfilled_evidence, 3: L.add_columns("molecules", note="string")})
    assert version == 4 and rows(L.backfilled_evidence(once)["evidence"], "canonical_smiles", "mol_id") == [("CCO", "m")]
