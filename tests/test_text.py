from pyspark.sql import functions as F

from assayspark.functions import text as T
from assayspark.operators import search as S
from assayspark.operators import sections as X


def values(spark, rows, col, name="text"):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k int, {name} string")
    return [r[0] for r in df.orderBy("k").select(col).collect()]


def test_title(spark):
    rows = ["x\nTitle: A good name\n", "(54) code\n12345\nReal first line", "INTRODUCTION\n", "ab\n\n", "", None, "INTRODUCTION\nThen a line"]
    assert values(spark, rows, T.title(F.col("text"))) == ["A good name", "Real first line", "INTRODUCTION", None, None, None, "Then a line"]


def test_headings_and_reorganising(spark):
    assert values(spark, ["Abstract", "1. Introduction", "RESULTS. More", "Nothing here"], T.is_heading(F.col("text"))) == [True, False, True, False]
    rows = ["<!-- PAGE 1 -->", "ABSTRACT", "# Claims of all", "MATERIALS USED HERE", "WIPO", "plain", "", "SINGLE"]
    got = values(spark, rows, T.reorganised_line(F.col("text")))
    assert got == [None, "## Abstract", "## Claims", "## Materials Used Here", "WIPO", "plain", "", "SINGLE"]


def test_degenerate_text(spark):
    df = spark.createDataFrame([("ab" * 200, "x"), ("```molecode\n```", "```molecode\n``` ```molecode"), ("short", "short")], "a string, b string")
    assert [r[0] for r in df.select(T.degenerate(F.col("a"), F.col("b"))).collect()] == [True, True, False]


def test_numbers_in_cells(spark):
    pairs = [("12.5", 12.5, True), ("12.5 nM", 12.5, True), ("> 1000", 1000.0, True), ("10.20", 10.2, True), ("112.5", 12.5, False), ("no number", 12.5, False), ("", 12.5, False), (None, 1.0, False)]
    df = spark.createDataFrame(pairs, "cell string, value double, want boolean")
    assert all(r[0] == r[1] for r in df.select(T.number_matches(F.col("cell"), F.col("value")), "want").collect())


def test_page_range_and_heading(spark):
    got = values(spark, ["see pages 5-10", "Page 3 only", "none"], T.page_range(F.col("text")))
    assert [tuple(r) for r in got] == [(5, 10), (3, 3), (None, None)]
    assert values(spark, ["# Hello\nx", "no", "## Two\n# One"], T.hash_heading(F.col("text"))) == ["Hello", "", "One"]


def test_keyword_search(spark):
    docs = spark.createDataFrame([(1, "Aspirin and aspirin"), (2, "nothing"), (3, "aspirin")], "doc_id long, text string")
    got = S.keyword_search(docs, "aspirin", k=5).select("doc_id", "hits", "score").collect()
    assert [tuple(r) for r in got] == [(1, 2, 0.2), (3, 1, 0.1)]
    assert [r.doc_id for r in S.keyword_search(docs, "ASPIRIN", only=[3]).collect()] == [3]
    assert S.keyword_search(docs, " ").count() == 0


def test_tables_rows_and_pages(spark):
    md = "<!-- PAGE 2 -->\ntext\n| name | IC50 |\n|:--|--:|\n| 1a | 12.5 |\n| 1b | 112.5 |\nend\n<!-- PAGE 3 -->\n| only |"
    found = X.tables(spark.createDataFrame([(1, md)], "doc_id long, text string"))
    assert [(r.table_idx, r.page_num) for r in found.orderBy("table_idx").collect()] == [(0, 2), (1, 3)]
    rows = X.table_rows(found)
    recs = spark.createDataFrame([(1, 1, 0, "1a", None, 12.5), (1, 2, 0, "zz", None, 1.0)], "doc_id long, rec_id int, table_idx long, row_label string, row_smiles string, value_original double")
    got = {r.rec_id: (r.row_idx, r.col_idx) for r in X.located(recs, rows.withColumn("table_idx", F.col("table_idx").cast("long"))).collect()}
    assert got == {1: (2, 1), 2: (None, None)}


def test_chunks_and_lines(spark):
    seg = spark.createDataFrame([(1, k, n) for k, n in enumerate([4, 4, 9, 1, 1])], "doc_id long, seg_no int, tokens long")
    assert [r.chunk for r in X.packed_chunks(seg, 8).orderBy("seg_no").collect()] == [0, 0, 1, 2, 2]
    items = spark.createDataFrame([(1, 0, 0.0, 100.0), (1, 1, 5.0, 97.0), (1, 2, 0.0, 90.0), (1, 3, 0.0, 85.0)], "page_id long, item_no int, x double, y double")
    assert [r.line for r in X.line_clusters(items).orderBy("item_no").collect()] == [0, 0, 1, 1]


def test_query_key_ignores_case_and_blanks(spark):
    a, b, c = values(spark, [" What? ", "what?", "other"], T.query_key(F.col("text")))
    assert a == b != c


def test_small_rules(spark):
    assert values(spark, ["a b" * 3, "x" * 300], T.truncated(F.col("text"), 5)) == ["a ba...", "xxxxx..."]
    assert values(spark, ["a/b:c", " x "], T.safe_filename(F.col("text"))) == ["a_b_c", "x"]
    assert values(spark, ["**OC(=O)", ""], T.safe_identifier(F.col("text"))) == ["__OC__O_", "Unnamed"]
    assert values(spark, ["| a | b |"], T.cells(F.col("text"))) == [["a", "b"]]
    assert [len(x) for x in values(spark, ["```json\n[{\"a\":1}]\n```", "bad", "{\"a\":1}"], T.json_array(F.col("text"), "array<struct<a:int>>"))] == [1, 0, 0]


def test_packed_documents_need_no_shuffle(spark, sf_dir):
    import random

    from assayspark.plans import registry, text_plans  # noqa: F401

    rng = random.Random(6)
    docs = [(d, [rng.choice([0, 0, 1, 5, 9]) for _ in range(rng.randrange(12))]) for d in range(1300)] + [(1300, None), (1301, [])]
    df = spark.createDataFrame(docs, "doc_id long, tokens array<long>").coalesce(1)
    want = []
    for d, tokens in docs:
        chunk, used = 0, 0
        for k, n in enumerate(tokens or []):
            if used and used + n > 8:
                chunk, used = chunk + 1, 0
            used += n
            want.append((d, k, n, chunk))
    got = sorted(map(tuple, X.packed(df, 8).collect()))
    rows = df.select("doc_id", F.posexplode("tokens").alias("seg_no", "tokens"))
    assert got == sorted(want) == sorted(map(tuple, X.packed_chunks(rows, 8).collect()))
    plan = registry.QUERIES["packed_token_chunks"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "InPandas" not in plan


def test_repetitive_is_what_the_ratio_says(spark):
    blanks = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    natural = " ".join(f"word{k * k % 997} stands{blanks[k % len(blanks)]}" for k in range(200))
    texts = [natural, natural * 9, "abcd " * 300, "中文é" * 200, natural[:600] + "ab" * 4000, "ab" * 4000 + natural, blanks * 40, "x" * 199, "x" * 200, "", None]
    texts += [natural[:n] + "y" * 1000 for n in range(150, 1150, 25)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select(T.repetitive(F.col("text"), F.lit(0.25)), F.coalesce(T.shingle_ratio(F.col("text")) < 0.25, F.lit(False))).collect()
    assert [r[0] for r in got] == [r[1] for r in got]
    assert {r[0] for r in got[-40:]} == {True, False}  # on both sides of the limit
