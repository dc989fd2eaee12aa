"""The ingest run: stages, failures of single documents, reruns, changed documents, a run that is broken off."""

import pytest
from pyspark.sql import functions as F

from assayspark.operators import ingest
from assayspark.sources.library import Library

DOCS = "doc_id long, text string"
LONG = "Page of native text, long enough not to be taken for an image, "
SAMPLE = f"{LONG}one.\f{LONG}two."


@pytest.fixture
def lib(spark, tmp_path):
    return Library(spark, f"file://{tmp_path}/lib")


def states(lib):
    return {r["doc_id"]: (r["status"], r["stage"], r["code"], r["attempt"]) for r in lib.read(ingest.STATE).collect()}


def table(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def test_sample_document(spark, lib):
    report = ingest.run(lib, table(spark, [(1, SAMPLE)]))
    assert report == ingest.Report(1, 1, 0, 0, tuple(s.name for s in ingest.STAGES))
    doc = lib.read("persist").first()
    assert (doc["n_pages"], doc["doc_kind"], doc["n_tables"]) == (2, "text_only", 0)
    assert [p["page_num"] for p in lib.read("extract").first()["pages"]] == [1, 2]
    assert lib.read("markdown").first()["markdown"].startswith("<!-- PAGE 1 -->\n")
    log = lib.read(ingest.LOG).orderBy("place").collect()
    assert [(r["stage"], r["event"]) for r in log] == [(s.name, "success") for s in ingest.STAGES]


def test_failures_stop_their_documents_only_and_a_rerun_does_nothing(spark, lib):
    rows = [(1, SAMPLE), (2, None), (3, " \n"), (4, f"{LONG}\n| a | b |\n|---|---|\n| x | 1 |"), (5, "!?. " * 12 + "-" * 40), (None, SAMPLE), (6, SAMPLE), (6, SAMPLE)]
    docs = table(spark, rows).withColumn("stage", F.lit("extra")).repartition(3)
    report = ingest.run(lib, docs)
    assert (report.taken, report.finished, report.failed, report.warnings) == (6, 4, 2, 1)
    want = {k: ("done", "persist", None, 1) for k in (1, 4, 5, 6)} | {k: ("failed", "extract", "PDF_PARSE_ERROR", 1) for k in (2, 3)}
    assert states(lib) == want
    assert lib.read(ingest.LOG).where("event = 'warning'").select("doc_id", "code").collect() == [(5, "INDEX_FAILED")]
    assert lib.read("persist").where("doc_id = 4").first()["n_tables"] == 1
    version = lib.version()
    done = [r for r in rows if r[0] not in (2, 3)]
    assert ingest.run(lib, table(spark, done)) == ingest.Report(0, 0, 0, 0, ())
    assert lib.version() == version  # nothing was written


def test_only_changed_and_unfinished_documents_are_taken_again(spark, lib):
    ingest.run(lib, table(spark, [(1, SAMPLE), (2, None), (3, SAMPLE), (4, "")]))
    report = ingest.run(lib, table(spark, [(1, SAMPLE), (2, SAMPLE), (3, f"{SAMPLE}\f{LONG}three."), (4, ""), (5, SAMPLE)]))
    assert (report.taken, report.finished, report.failed) == (4, 3, 1)
    got = states(lib)
    assert got[1][3] == 1 and got[2] == ("done", "persist", None, 2) and got[3][3] == 2 and got[4][:2] == ("failed", "extract") and got[5][3] == 1
    pages = {r["doc_id"]: r["n_pages"] for r in lib.read("persist").collect()}
    assert pages == {1: 2, 2: 2, 3: 3, 5: 2}
    assert lib.read("extract").groupBy("doc_id").count().where("count > 1").count() == 0


def failing_stages(broken):
    """Stages of which the fourth fails for document 2 and the sixth as a whole, while ``broken`` says so."""

    def reorganize(have):
        rows = ingest.STAGES[3].make(have)
        bad = (F.col("doc_id") == 2) & F.lit("reorganize" in broken)
        return rows.withColumn("code", F.when(bad, "UNKNOWN_ERROR").otherwise(F.col("code")))

    def index(have):
        if "index" in broken:
            raise RuntimeError("the machine is gone")
        return ingest.STAGES[5].make(have)

    own = {3: ingest.Stage("reorganize", reorganize), 5: ingest.Stage("index", index)}
    return [own.get(k, s) for k, s in enumerate(ingest.STAGES)]


def test_a_run_that_is_broken_off_goes_on_where_each_document_stopped(spark, lib):
    broken = {"reorganize", "index"}
    stages = failing_stages(broken)
    docs = table(spark, [(1, SAMPLE), (2, SAMPLE), (3, None)])
    with pytest.raises(RuntimeError, match="the machine is gone"):
        ingest.run(lib, docs, stages)
    got = states(lib)
    assert got == {1: ("running", "activity", None, 1), 2: ("failed", "reorganize", "UNKNOWN_ERROR", 1), 3: ("failed", "extract", "PDF_PARSE_ERROR", 1)}
    broken.clear()
    before = lib.read(ingest.LOG).count()
    report = ingest.run(lib, docs, stages)
    assert (report.taken, report.finished, report.failed) == (3, 2, 1)
    new = sorted((r["doc_id"], r["place"]) for r in lib.read(ingest.LOG).collect())
    assert len(new) - before == 1 + 4 + 2
    assert [p for d, p in new if d == 1] == list(range(7))  # each stage once
    assert [p for d, p in new if d == 2] == [0, 1, 2, 3, 3, 4, 5, 6]
    assert states(lib)[1] == ("done", "persist", None, 2)
    assert {r["doc_id"]: r["n_pages"] for r in lib.read("persist").collect()} == {1: 2, 2: 2}


def test_empty_table(spark, lib):
    assert ingest.run(lib, table(spark, [])) == ingest.Report(0, 0, 0, 0, ())
    assert lib.version() == 0


def test_a_first_run_reads_no_text_to_choose_among_ids_that_stand_once(spark, lib, monkeypatch):
    def todo(*_):
        raise AssertionError("all documents are taken, so none has to be compared")

    monkeypatch.setattr(ingest, "todo", todo)
    assert ingest.run(lib, table(spark, [(1, SAMPLE), (2, None), (None, SAMPLE)])).taken == 2
    assert {r["doc_id"]: r["attempt"] for r in lib.read(ingest.STATE).collect()} == {1: 1, 2: 1}


def test_texts_do_not_move_to_meet_a_few_ids(spark, lib):
    plans = []

    def extract(have):
        plans.append(have("source")._jdf.queryExecution().executedPlan().toString())
        return ingest.STAGES[0].make(have)

    stages = [ingest.Stage("extract", extract), *ingest.STAGES[1:]]
    rows = [(k, SAMPLE) for k in range(20)]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the table of ids were too large to be sent unasked
    try:
        ingest.run(lib, table(spark, rows), stages)
        report = ingest.run(lib, table(spark, [(3, f"{SAMPLE}\f{LONG}three."), *(r for r in rows if r[0] != 3)]), stages)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert report.taken == 1 and len(plans) == 2
    assert "BroadcastHashJoin" in plans[1] and "hashpartitioning" not in plans[1]
    assert {r["doc_id"]: r["n_pages"] for r in lib.read("persist").collect()} == {k: 3 if k == 3 else 2 for k in range(20)}
