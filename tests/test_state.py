"""Keyed stream state: equal to the batch forms, going on after a restart, ending by itself."""

import time

import pytest
from pyspark.sql import functions as F

from assayspark.streaming import logs, state

ROWS = "k string, seq long, message string"


@pytest.fixture(scope="module")
def own(spark):
    return state.with_state_store(spark)


def put(session, rows, schema, path):
    session.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_ring_goes_on_after_a_restart_and_equals_batch(own, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    rows = [("ab"[k % 3 == 0], k * 7 % 1000, f"m{k * 7 % 1000}") for k in range(1000)]  # numbers come in no order
    rows += rows[:40] + [(None, 5, None), ("c", 1, None)]

    def run():
        stream = own.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(source)
        write = lambda b, no: b.write.mode("overwrite").parquet(f"{out}/v={no}")
        query = state.ring(stream, "k", 30).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query.lastProgress["numInputRows"] if query.lastProgress else 0

    for part in (rows[:300], rows[300:700]):
        put(own, part, ROWS, source)
    run()
    put(own, rows[700:], ROWS, source)
    run()  # a new query from the same checkpoint
    changes = own.read.parquet(out).drop("v")
    got = sorted(map(tuple, state.ring_content(changes, "k").collect()), key=repr)
    batch = own.createDataFrame(rows, ROWS).dropDuplicates(["k", "seq"])
    assert got == sorted(map(tuple, logs.last_per_key(batch, "k", "seq", 30).collect()), key=repr)
    assert changes.where("NOT kept").count() > 0
    assert changes.count() == changes.dropDuplicates().count()  # nothing was told twice


def test_cache_serves_what_it_holds_until_it_is_outlived(own, tmp_path):
    schema = "root string, doc_id string, page long, seq long, payload string"
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    served = {}

    def run(rows):
        put(own, rows, schema, source)
        stream = own.readStream.schema(schema).parquet(source)
        take = lambda b, no: served.update({r["seq"]: (r["payload"], r["from_cache"]) for r in b.collect()})
        # Streams with processing time never run out of batches, so this one is stopped.
        query = state.answered(stream, ttl_ms=6000, most=3).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(processingTime="200 milliseconds").start()
        try:
            for _ in range(150):
                if all(r[3] in served for r in rows):
                    break
                time.sleep(0.2)
        finally:
            query.stop()
        return served

    first = run([("r", "d", p, p, f"p{p}") for p in range(6)] + [("r", "d", 1, 10, "other"), ("r", "e", 1, 11, "own")])
    assert first[1] == ("p1", False) and first[10] == ("p1", True) and first[11] == ("own", False)
    start = time.time()
    second = run([("r", "d", 2, 20, "late")])
    if time.time() - start < 5:  # else it may have been outlived on a slow machine
        assert second[20] in (("p2", True), ("late", False))
    time.sleep(6.5)
    third = run([("r", "d", 2, 30, "new"), ("r", "d", 2, 31, "newer")])
    assert third[30] == ("new", False) and third[31] == ("new", True)


def test_tails_end_by_themselves_unless_the_task_goes_on(own, tmp_path):
    schema = "task string, id long, level string, message string, stage string"
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    put(own, [("a", 1, "start", "m", "s"), ("a", 2, "complete", "m", "s"), ("b", 3, "start", "m", "s"), ("a", 2, "complete", "m", "s")], schema, source)
    got = []
    stream = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = state.follow(state.tails(stream, polls=2, every_ms=300), {"a", "b"}, lambda b, no: got.extend(b.collect()), checkpoint, "300 milliseconds")
    try:
        for _ in range(200):
            if any(r["ended"] for r in got):
                break
            time.sleep(0.3)
        assert [(r["task"], r["id"]) for r in got if r["ended"]] == [("a", 2)]
        time.sleep(3)
        assert query.isActive and not any(r["task"] == "b" and r["ended"] for r in got)  # its last row says that it goes on
        put(own, [("b", 4, "error", "m", "s")], schema, source)
        query.awaitTermination(90)
        assert not query.isActive
    finally:
        query.stop()
    rows = [(r["task"], r["id"], r["level"]) for r in got if not r["ended"]]
    assert sorted(rows) == [("a", 1, "start"), ("a", 2, "complete"), ("b", 3, "start"), ("b", 4, "error")]
    assert rows.index(("a", 1, "start")) < rows.index(("a", 2, "complete"))
    assert [(r["task"], r["id"]) for r in got if r["ended"]] == [("a", 2), ("b", 4)]


def test_ring_content_of_nothing(own):
    empty = own.createDataFrame([], f"{ROWS}, kept boolean")
    assert state.ring_content(empty, "k").collect() == []
    assert state.ring_content(empty.select("*").where(F.lit(False)), "k").columns == ["k", "seq", "message"]
