import json

from pyspark.sql import functions as F

from assayspark.sources import files as S
from assayspark.streaming import logs as L


def test_library_scan(spark, tmp_path):
    for p in ("a/x.pdf", "a/y.bin", "node_modules/z.md", "top.TXT"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x")
    found = S.scan(spark, str(tmp_path))
    assert sorted(r.path for r in found.collect()) == ["a/x.pdf", "top.TXT"]
    assert [(r.path, r.is_dir) for r in S.tree(found).collect()] == [("a", True), ("top.TXT", False), ("a/x.pdf", False)]


def test_pages_wiki_notes(spark, tmp_path):
    (tmp_path / "lib/d1/pages").mkdir(parents=True)
    (tmp_path / "lib/d1/pages/page_0002.txt").write_text("two\nlines")
    assert [tuple(r) for r in S.page_texts(spark, str(tmp_path / "lib"), [2]).collect()] == [("d1", 2, "two\nlines")]
    for kind in ("summaries", "concepts"):
        (tmp_path / "wiki" / kind).mkdir(parents=True)
        (tmp_path / "wiki" / kind / "n.md").write_text("# T\nx" * 10)
    (tmp_path / "wiki/concepts/big.md").write_text("x" * 500)
    assert sorted((r.kind, r.id) for r in S.wiki(spark, str(tmp_path / "wiki"), 100).collect()) == [("concepts", "n"), ("summaries", "n")]
    (tmp_path / "notes.json").write_text(json.dumps([{"id": "1", "title": "a", "links": ["2"]}]))
    (tmp_path / "bad.json").write_text("{broken")
    assert S.notes(spark, str(tmp_path / "notes.json")).count() == 1 and S.notes(spark, str(tmp_path / "bad.json")).count() == 0


def test_publish_replaces_documents(spark, tmp_path):
    path = str(tmp_path / "t")
    S.publish(spark.createDataFrame([(1, "a"), (2, "b")], "v int, doc_id string"), path)
    S.publish(spark.createDataFrame([(9, "b")], "v int, doc_id string"), path)
    assert sorted((r.doc_id, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 9)]


def test_stream_tail_and_ring_equal_batch(spark, tmp_path):
    src = str(tmp_path / "log")
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).select(F.col("id").alias("seq"), F.col("id").alias("id"), (F.col("id") % 3).alias("task"), F.lit("x").alias("level"), F.col("id").cast("double").alias("value")).coalesce(1).write.mode("append").parquet(src)
    schema = "seq long, id long, task long, level string, value double"
    L.ring_sink(L.tail(spark, src, schema), str(tmp_path / "ring"), str(tmp_path / "cp"), n=7).awaitTermination()
    versions = sorted(int(p.name[2:]) for p in (tmp_path / "ring").iterdir())
    got = sorted(r.seq for r in spark.read.parquet(str(tmp_path / f"ring/v={versions[-1]}")).collect())
    assert got == list(range(23, 30))
    q = L.latest_per_task(L.tail(spark, src, schema)).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = L.latest_per_task(spark.read.parquet(src))
    assert sorted(map(tuple, spark.table("latest").collect())) == sorted(map(tuple, batch.collect()))


def test_diagnostics_limits(spark):
    df = spark.range(2000).select(F.col("id").alias("seq"), F.lit("e").alias("level"))
    assert L.diagnostics(df, limit=5000).count() == 1000
    assert [r.seq for r in L.diagnostics(df, after=5, limit=2).collect()] == [6, 7]
