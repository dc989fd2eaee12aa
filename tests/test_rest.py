"""Rules that no query covers, each on a small case, and the defined results of clashing input."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from assayspark.functions import chem
from assayspark.functions import geometry as G
from assayspark.functions import text as T
from assayspark.operators import evidence as E
from assayspark.operators import library as L
from assayspark.operators import matching as M
from assayspark.operators import relational as R
from assayspark.operators import search as S
from assayspark.operators import sections as X
from assayspark.sources import files
from assayspark.streaming import logs


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def rows(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=str)


def test_texts_of_other_documents_stay(spark, tmp_path):
    out = str(tmp_path / "texts")
    write = lambda *pairs: files.write_texts(spark.createDataFrame(list(pairs), "doc_id string, md string"), out, "md")
    write(("a", "one"), ("b", "two"))
    write(("c", "three"), ("b", "new"))
    got = spark.read.text(out, wholetext=True)
    assert rows(got, "doc_id", "value") == [("a", "one\n"), ("b", "new\n"), ("c", "three\n")]


def test_search_splits_queries_as_the_index_does(spark):
    df = spark.createDataFrame([(1, "foo_bar x"), (2, "foo baz"), (3, "Größe bar foo")], "id int, t string")
    index = S.inverted_index(df, "id", ["t"])
    assert rows(S.index_search(index, "id", "foo_bar")) == [(1,), (3,)]
    assert rows(S.index_search(index, "id", "GRÖSSE größe")) == [] and rows(S.index_search(index, "id", "größe")) == [(3,)]
    assert rows(S.index_search(index, "id", " _ ")) == [] and rows(S.index_search(index, "id", "foo", 2)) == [(1,), (2,)]


@pytest.mark.parametrize(("size", "overlap"), [(100, 100), (100, 250), (100, 60), (10, 3), (5, 0)])
def test_chunks_end_for_any_overlap(spark, size, overlap):
    text = "word and another。 line\n" * 40
    got = one(spark, X.character_chunks(F.lit(text), F.lit(size), F.lit(overlap)))
    assert 1 <= len(got) <= len(text)
    if 0 < overlap < size // 2:
        assert got[-1] == text[-size:].strip()[-len(got[-1]) :]
    if not overlap:  # without overlap the next chunk starts where the first ends, and the rule stops there
        assert got == ["word"]


def test_two_changes_of_a_key_are_one_row(spark):
    base = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, s string, v double")
    twice = spark.createDataFrame([(1, "x", None, 2), (1, "y", 5.0, 1), (9, "z", 1.0, 1)], "k int, s string, v double, at int")
    assert rows(R.patch(base, twice, "k", "at")) == [(1, "x", 5.0), (2, "b", 2.0)]
    assert rows(R.patch(base, twice.drop("at"), "k")) == [(1, "y", 5.0), (2, "b", 2.0)]
    assert rows(R.replace(base, twice.drop("v"), "k", {"v": 0.0}, "at")) == [(1, "x", 0.0), (2, "b", 2.0), (9, "z", 0.0)]
    assert rows(R.insert_or_ignore(base, twice.drop("at"), ["k"])) == [(1, "a", 1.0), (2, "b", 2.0), (9, "z", 1.0)]
    old = {"t": spark.createDataFrame([(3, "p", 1.0), (3, "q", 0.0)], base.schema)}
    for n in (1, 5):
        assert rows(L.migrated({"t": base}, {"t": old["t"].repartition(n)}, {"t": ["k"]})["t"])[-1] == (3, "q", 0.0)


def test_capital_headings(spark):
    line = lambda s: one(spark, T.reorganised_line(F.lit(s)))
    assert line("CROSS-REFERENCE LIST") == "## Cross-Reference List"
    assert line("R&D OF A,B") == "## R&D Of A,B" and line("WIPO") == "WIPO" and line("ONE") == "ONE"


def test_ranked_needs_no_single_task(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("g")).repartition(6)
    out = R.ranked(df, [F.asc("g"), F.desc("id")])
    want = {r: k + 1 for k, r in enumerate(sorted(range(1000), key=lambda i: (i % 7, -i)))}
    assert {r.id: r.position for r in out.collect()} == want and R.ranked(df.limit(0), [F.asc("id")]).count() == 0


def test_deep_and_cyclic_trees(spark):
    chain = [(k, f"n{k}", k - 1 if k else None) for k in range(8)] + [(100, "x", 101), (101, "y", 100)]
    got = L.tree(spark.createDataFrame(chain, "collection_id int, name string, parent_id int"))
    assert [r.depth for r in got.orderBy("collection_id").collect()] == list(range(8))
    assert got.where("depth = 3").first().path == "n0/n1/n2/n3"


def test_merged_lists_are_bounded(spark):
    df = spark.createDataFrame([("c", k, k / 10, f"s{k % 2}", f"n{k}") for k in range(10)] + [(None, 99, 0.5, "s", None)], "canonical string, ord int, confidence double, source string, name string")
    got = {r.canonical: r for r in E.merged(df, limit=3).collect()}
    assert [d.ord for d in got["c"].detections] == [9, 8, 7] and got["c"].n_detections == 10 and got["c"].sources == ["s0", "s1"] and got["c"].name == "n0"
    assert got[None].n_detections == 1


def test_wiki_and_notes_shapes(spark):
    f = spark.createDataFrame([("b", "sources"), ("a", "sources"), ("z", "concepts")], "id string, kind string")
    assert rows(files.wiki_listing(f)) == [("concepts", ["z"]), ("sources", ["a", "b"])]
    index = spark.createDataFrame([("n1", "old", ["x"]), ("n2", "two", ["xy"])], "id string, title string, links array<string>")
    new = spark.createDataFrame([("n1", "new", ["q"])], index.schema)
    assert rows(files.note_saved(index, new), "id", "title") == [("n1", "new"), ("n2", "two")]
    assert rows(S.backlinks(index, "x"), "id") == [("n1",)] and rows(S.backlinks(index, "x", exact=False), "id") == [("n1",), ("n2",)]
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")
    tree = files.document_tree(spark.createDataFrame([("a", "S")], "doc_id string, summary string"), spark.createDataFrame([("a", "T"), ("b", "T")], "doc_id string, tree string"), docs)
    got = {r.doc_id: r.structure for r in tree.collect()}
    assert json.loads(got["a"]) == [{"title": "a", "summary": "S"}] and got["b"] == "T" and got["c"] is None


def test_pages_in_markdown(spark):
    pages = spark.createDataFrame([("d", 2, "Results\nplain\n\n"), ("d", 1, "Abstract. more\nx")], "doc_id string, page_num int, text string")
    md = X.rough_markdown(pages).first().markdown
    assert md == "<!-- PAGE 1 -->\n## Abstract. more\nx\n\n<!-- PAGE 2 -->\n## Results\nplain\n"
    got = X.page_ranges(X.lines(spark.createDataFrame([("d", md)], "doc_id string, text string")))
    assert rows(got, "page_num", "start", "end") == [(1, 0, 4), (2, 4, 8)]
    p = spark.createDataFrame([(1, "x" * 501, False), (2, "x" * 501, True), (3, "", False)], "page_num int, text string, has_images boolean")
    assert rows(X.page_needed(p), "page_num") == [(2,), (3,)] and rows(X.page_needed(p, 2), "page_num") == [(2,)]


def test_content_from_the_top(spark):
    lines = spark.createDataFrame([(1, 50.0, "low"), (1, 90.0, "top"), (1, 70.0, "same")], "page_id int, y double, text string")
    mols = spark.createDataFrame([(1, 70.0, "CCO"), (1, None, "N")], "page_id int, y double, smiles string")
    assert [r.content for r in X.content_stream(lines, mols).orderBy("position").collect()] == ["top", "same", "CCO", "low", "N"]


def test_items_go_to_blocks(spark):
    box = lambda y0, y1: (0.0, y0, 10.0, y1)
    blocks = spark.createDataFrame([(1, 7, box(0.0, 10.0)), (1, 8, box(9.0, 20.0))], f"page_id int, block_id int, box {G.BOX}")
    items = spark.createDataFrame([(1, 1, 4.0, 5.0, 2.0), (1, 2, 4.0, 11.0, 2.0), (1, 3, 4.0, 40.0, 2.0)], "page_id int, item_no int, x double, y double, w double")
    assert rows(M.items_in_blocks(items, blocks), "item_no", "block_id") == [(1, 7), (2, 8), (3, None)]


def test_ids_of_labels(spark):
    p = spark.createDataFrame([("d", 1, 0), ("d", 1, 5)], "doc_id string, page int, label_no int")
    l = spark.createDataFrame([("d", 1, 0, 77)], "doc_id string, page int, passing_id int, label_id int")
    assert rows(M.renumbered(p, l), "label_no", "label_id") == [(0, 77), (5, None)]
    zipped = spark.createDataFrame([(["a", "b"], ["c"])], "a array<string>, b array<string>")
    assert [tuple(x) for x in zipped.select(M.zipped(F.col("a"), F.col("b"), strict=False).alias("z")).first().z] == [("a", "c"), ("b", None)]
    with pytest.raises(Exception, match="different lengths"):
        zipped.select(M.zipped(F.col("a"), F.col("b"))).collect()


def test_text_evidence(spark):
    blocks = spark.createDataFrame([("d", 0, "nothing"), ("d", 1, "has CCOCCOCCOCCO here"), ("d", 2, "Aspirin")], "doc_id string, block_idx int, block string")
    mols = spark.createDataFrame([("d", "m1", "Aspirin", "XX"), ("d", "m2", "", "CCOCCOCCOCCOCC"), ("d", "m3", None, "")], "doc_id string, mol_id string, name string, smiles string")
    assert rows(E.text_links(blocks, mols), "mol_id", "block_idx") == [("m1", 2), ("m2", 1)]
    assert one(spark, E.excerpt(F.lit("abcdef"), F.lit(3), 2)) == "abcd" and one(spark, E.excerpt(F.lit("abc"), F.lit(0))) == "position unresolved"
    c = spark.createDataFrame([("d", "C", 1, 0.5, "b", "n", "e", None, 0), ("d", "C", 2, 0.9, "b", "n", "e", None, 1), ("d", "X", 1, 0.9, "b", "n", "e", "bad", 2)], "doc_id string, canonical string, page int, confidence double, bbox string, name string, esmiles string, reason string, ord int")
    molecules, detections, evidence = E.persisted(c)
    assert rows(molecules, "mol_id") == [("C",)] and rows(detections, "mol_id", "page") == [("C", 2)] and rows(evidence, "kind") == [("figure",)]


def test_query_cache(spark):
    q = spark.createDataFrame([(" A b ", 5, None), ("a b", 6, None)], "query string, top_k int, doc_filter string")
    key = one(spark, T.query_key(F.lit("a B"), F.lit("5"), F.lit("")))
    cache = spark.createDataFrame([(key, "[1]", 2)], "query_hash string, results string, hit_count int")
    found = S.cache_lookup(cache, q)
    assert rows(found, "top_k", "results") == [(5, "[1]"), (6, None)] and S.cache_hit(cache, found).first().hit_count == 3


def test_life_times(spark):
    t = datetime.datetime(2024, 1, 1, 12, 0, 0)
    cache = spark.createDataFrame([("r", "d", 1, "old", t - datetime.timedelta(seconds=31)), ("r", "d", 1, "mid", t - datetime.timedelta(seconds=20)), ("r", "d", 1, "new", t)], "root string, doc_id string, page int, payload string, cached_at timestamp")
    now = F.lit(t)
    assert rows(logs.fresh(cache, now), "payload") == [("new",)] and logs.fresh(cache.where("payload = 'old'"), now).count() == 0
    assert logs.heartbeat(spark).isStreaming
    fails = spark.createDataFrame([("a", t, False), ("b", t, False), ("b", t + datetime.timedelta(seconds=1), True), ("c", t - datetime.timedelta(seconds=40), False)], "name string, ts timestamp, ok boolean")
    assert rows(logs.cooling(fails, now), "name") == [("a",)]


def test_ring_keeps_two_versions(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(4):
        spark.createDataFrame([(k * 10 + i,) for i in range(10)], "seq long").coalesce(1).write.mode("append").parquet(src)
    logs.ring_sink(logs.tail(spark, src, "seq long"), out, str(tmp_path / "cp"), n=15).awaitTermination(120)
    assert sorted(x for x in os.listdir(out) if x.startswith("v=")) == ["v=2", "v=3"]
    assert rows(spark.read.parquet(f"{out}/v=3"))[0] == (25,)


def test_small_columns(spark):
    assert one(spark, T.highlighted(F.lit("aXbxc"), "x")) == ["a", "X", "b", "x", "c"]
    assert one(spark, T.collapsed(F.lit("abc"), F.lit("abcdefgh"))) and not one(spark, T.collapsed(F.lit("abcd"), F.lit("abcdefgh")))
    assert one(spark, chem.candidates(F.lit("the CC(=O)O word c1ccccc1 and CC(=O)O"))) == ["CC(=O)O", "c1ccccc1"]
    assert one(spark, chem.condensed(F.lit("(CH2)3COOEt"), ("COOEt",))) == '[[[["C",1],["H",2]],3],["COOEt",1]]'
    assert one(spark, chem.condensed(F.lit("C((OH"))) == '[["C",1],[[[[["O",1],["H",1]],1]],1]]' and one(spark, chem.condensed(F.lit(None).cast("string"))) is None
    text = "abcd" * 100 + "  x" + "efgh" * 10
    body = " ".join(text.split())
    want = [body[i : i + 8] for i in range(0, len(body) - 8, 4)]
    assert one(spark, T.shingle_ratio(F.lit(text))) == len(set(want)) / len(want) and one(spark, T.shingle_ratio(F.lit("x" * 199))) is None
    assert L.migration_state(True, True, False) == "already_migrated" and L.migration_state(False, False, True) == "needs_migration" and L.migration_state(False, False, False) == "nothing_to_migrate"


def test_agent_events(spark):
    e = [("r", 1, "on_chat_model_stream", None, "", None), ("r", 2, "on_tool_start", "find", "q", None), ("r", 3, "on_tool_end", None, "x" * 600, None), ("r", 4, "error", None, "why", False), ("r", 5, "on_chat_model_stream", None, "late", None), ("s", 1, "on_chain_end", None, "z", None), ("t", 1, "error", None, "why", True)]
    out = logs.with_done(spark.createDataFrame(e, "run string, seq long, event string, name string, content string, recoverable boolean"))
    want = [("r", 2, "tool_call", "find", "q"), ("r", 3, "tool_result", None, "x" * 500), ("r", 4, "error", None, "Internal error"), ("r", 5, "done", None, None), ("s", 2, "done", None, None), ("t", 1, "error", None, "why"), ("t", 2, "done", None, None)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_safe_ids(spark):
    ids = spark.createDataFrame([("doc_1.v2-a",), ("a..b",), ("../x",), ("a/b",), (".hid",), ("",), (None,)], "doc_id string")
    assert [r.ok for r in ids.select(files.safe_id(F.col("doc_id")).alias("ok")).collect()] == [True] + [False] * 6


def test_activities_of_a_table_for_each_brand(spark, sf_dir):
    from assayspark.plans import chain_plans, registry  # noqa: F401

    parts = spark.read.parquet(f"{sf_dir}/part.parquet").orderBy("p_partkey").collect()
    place, want = {}, []
    for r in parts:
        place[r.p_brand] = place.get(r.p_brand, 1) + 1  # the header is row 1
        want.append((r.p_brand, r.p_partkey, place[r.p_brand], 1))
    got = registry.QUERIES["activity_extraction"](spark, sf_dir).collect()
    assert sorted((r.doc_id, r.rec_id, r.row_idx, r.col_idx) for r in got) == sorted(want)


def test_chunks_of_a_batch_are_handed_on_in_parts(spark, sf_dir, monkeypatch):
    from assayspark.plans import registry, text_plans  # noqa: F401

    texts = [(k, None if k % 7 == 3 else " " * (k % 5) + "word and another。 line\n" * (k % 40)) for k in range(900)]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    want = sorted(map(tuple, df.select("doc_id", F.posexplode(X.character_chunks(F.col("text"), F.lit(100), F.lit(30))).alias("n", "c")).collect()))
    for held in (1, 500, 1 << 20):
        monkeypatch.setattr(X, "HANDED", held)
        assert sorted(map(tuple, X.chunk_rows(df, 100, 30).collect())) == want and len(want) > 3000
    plan = registry.QUERIES["character_chunks"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan  # which holds the chunks of a whole batch
