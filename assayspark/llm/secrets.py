"""Secret scans over an incremental blob ledger, DataFrame functions only.

Each version of a text is named by the sha256 of its content. A scan looks up which pairs of blob and
rule version the ledger already has, reads only one document for each unseen pair, appends the findings
to the ledger, and joins the ledger's findings back to every document (path) that holds the blob.

Positions come from built-in functions: what lies between the matches (``split``) and the matches
themselves (``regexp_extract_all``) give the offsets as running sums of lengths in code points.

The ledger may be kept from one run to the next: the setting ``LEDGER`` of the session names its folder, and
without it a run has a ledger of its own. Two scans at once, or a retried one, may append a blob twice; a
pair of blob and rule version is read as one all the same.

Defined cases: null text is the empty text; null doc_id is kept as a row; repeated rows and equal texts
share one blob and get the same spans; a doc_id with several texts (versions) is one row for each; a text
without a finding has an empty span list and is in the ledger as scanned; an empty table gives no rows;
columns of the table named ``blob`` or ``found`` give way to the operator's, others are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import Workspace, table

#: Names the patterns below; another set of patterns needs another version.
RULE_VERSION = "base-1"

#: Fixed values of the contract: kind, pattern, group that has a least length, that length.
RULES = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: A text that this does not match has no finding of a kind, so only one pass over it is needed.
PRESENT = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}""",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
}
#: Setting with the folder of a ledger that is kept between runs.
LEDGER = "spark.assayspark.secrets.ledger"
#: Matches whose places are summed up together, and code points of a text's pieces.
BLOCK, PIECE = 512, 1024
SPANS = "array<struct<start:int,ord:int,end:int>>"


def blob_id(text: Column) -> Column:
    """The content address of a text."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _before(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each of some numbers from 0 on what ``join`` (with 0 as its neutral element) makes of all before it.

    Results are gathered block by block, as an array that grows by one element is copied each time.
    """

    def gather(some: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(some, zero, lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def shift(blocks: Column) -> Column:
        ahead = gather(F.transform(blocks, lambda x: x["at"]))["out"]
        return F.flatten(F.zip_with(blocks, ahead, lambda x, start: F.transform(x["out"], lambda v: join(start, v))))

    last = F.greatest(F.floor((F.size(values) - 1) / BLOCK).cast("int"), F.lit(0))
    return _once(F.transform(F.sequence(F.lit(0), last), lambda k: gather(F.slice(values, k * BLOCK + 1, BLOCK))), shift)


def _spans(text: Column, order: int) -> Column:
    """Matches of one rule as structs of start, rule order and end, leftmost and non-overlapping."""
    kind, pattern, group, least = RULES[order]
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # Failing matches still use up their text, so they are dropped only after all were placed.
    kept = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.length(x) >= least)
    steps = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), F.transform(whole, lambda x: F.length(x)).alias("len"), kept.alias("ok"))

    def place(steps: Column) -> Column:
        ahead = _before(F.transform(steps, lambda x: x["gap"] + x["len"]), lambda a, b: a + b)
        starts = F.zip_with(steps, ahead, lambda x, at: F.struct((at + x["gap"]).alias("start"), F.lit(order).alias("ord"), (at + x["gap"] + x["len"]).alias("end"), x["ok"].alias("ok")))
        return F.transform(F.filter(starts, lambda x: x["ok"]), lambda x: F.struct(x["start"], x["ord"], x["end"]))

    found = _once(steps, place).cast(SPANS)
    return F.when(text.rlike(PRESENT[kind]), found).otherwise(F.array().cast(SPANS))


def find(text: Column) -> Column:
    """All spans of a text by start, then by the order of the rules."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*[_spans(text, k) for k in range(len(RULES))]))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's ``blob``, ``rule_version``, ``spans``, each pair once; empty where none was written yet."""
    try:
        return spark.read.parquet(path).dropDuplicates(["blob", "rule_version"])
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], f"blob string, rule_version string, spans {SPANS}")


def scan(docs: DataFrame, ledger: str) -> int:
    """Scan what the ledger at path ``ledger`` has not seen under RULE_VERSION and append it.

    Only hashes and ids are shuffled to find one document for each unseen blob; texts are scanned where
    they are read unless they have to be matched to those ids. Returns the number of blobs appended.
    """
    spark = docs.sparkSession
    seen = read_ledger(spark, ledger).where(F.col("rule_version") == RULE_VERSION).select("blob")
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias("id"), "text")
    first = ids.select("id", blob_id(F.col("text")).alias("blob")).groupBy("blob").agg(F.min("id").alias("id"))
    unseen = first.join(seen, "blob", "left_anti")
    # A doc_id may stand on rows with different texts: the blob is matched too, then made unique.
    texts = ids.withColumn("blob", blob_id(F.col("text"))).join(unseen, ["id", "blob"], "left_semi")
    found = texts.select("blob", find(F.col("text")).alias("spans")).groupBy("blob").agg(F.first("spans").alias("spans"))
    new = Observation()
    found.select("blob", F.lit(RULE_VERSION).alias("rule_version"), "spans").observe(new, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(ledger)
    return new.get["n"]


def ledger_path(spark: SparkSession, name: str) -> str:
    """The folder of the session's ledger, or of one for this run."""
    return spark.conf.get(LEDGER, None) or f"{Workspace(spark, name).root}/ledger"


def findings(docs: DataFrame, ledger: str) -> DataFrame:
    """Join the ledger's findings back: every row of ``docs`` with its ``blob`` and ``found`` spans."""
    hits = read_ledger(docs.sparkSession, ledger).where((F.col("rule_version") == RULE_VERSION) & (F.size("spans") > 0))
    named = docs.select(F.struct(*[c for c in docs.columns if c not in ("blob", "found")]).alias("row"), blob_id(F.col("text")).alias("blob"))
    joined = named.join(hits.select("blob", F.col("spans").alias("found")), "blob", "left")
    return joined.select("row.*", "blob", F.coalesce("found", F.array().cast(SPANS)).alias("found"))


def digest(found: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(r[0]) for r in RULES])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(kinds, x["ord"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with each found stretch (overlapping spans as one) replaced by ``mark``; null stays null."""

    def cut(pieces: Column, start: Column, end: Column) -> Column:
        # A string is walked through from its start, so only the pieces that hold the stretch are.
        first = F.floor(start / PIECE).cast("int")
        own = F.slice(pieces, first + 1, F.floor(end / PIECE).cast("int") - first + 1)
        return F.substring(F.array_join(own, ""), start - first * PIECE + 1, end - start)

    def joined(both: Column) -> Column:
        ends = F.transform(both["found"], lambda x: x["end"])
        placed = F.zip_with(both["found"], _before(ends, lambda a, b: F.greatest(a, b)), lambda x, at: F.struct(at.alias("at"), x["start"].alias("start")))
        new = F.filter(placed, lambda x: x["start"] >= x["at"])
        kept = F.transform(new, lambda x: F.concat(cut(both["pieces"], x["at"], x["start"]), F.lit(mark)))
        rest = cut(both["pieces"], F.array_max(ends), F.length(text))
        return F.concat(F.array_join(kept, ""), rest)

    done = _once(F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"), found.alias("found")), joined)
    return F.when(F.size(found) > 0, done).otherwise(text)


def _count(order: int) -> Column:
    """Number of spans of one rule."""
    return F.size(F.filter("found", lambda x: x["ord"] == order)).cast("long").alias(f"n_{RULES[order][0]}")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = ledger_path(spark, "secrets")
    scan(docs, ledger)
    out = findings(docs, ledger).withColumn("spans", digest(F.col("found")))
    return out.select("doc_id", *[_count(k) for k in range(len(RULES))], F.sha2("spans", 256).alias("base_sha256"), "spans")
