"""The ingest of documents as one run of stages over all documents that need it.

A stage is a function from the frames it reads to one row for each document: ``doc_id``, ``digest``, ``code`` (null:
success), ``message`` and what it makes. Its rows and the state of its documents are committed together, so a run
that is broken off goes on after the last stage that a document has finished. A failure is a row with its stage and code:
a recoverable one is a warning and the document goes on, another stops that document and no other one. A later run takes
documents that are new, changed (by digest) or unfinished, the last ones from the stage that they failed in.

Texts don't move between stages: a stage reads the rows that the one before has just written, without the few that failed, and
only documents that are taken up again are looked up in the library.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayspark.functions import text as T
from assayspark.operators import sections as X
from assayspark.operators.search import tokens
from assayspark.scratch import kept
from assayspark.sources.library import Library, Transaction

STATE, LOG = "ingest_state", "ingest_log"
#: What a stage's rows and a document's state begin with.
HEAD = ["doc_id", "digest", "attempt"]
#: Text under which a page is taken for an image.
NATIVE_CHARS = 50
#: Ids that are few enough to be sent to every task (16 bytes each with what a hash table adds).
FEW_IDS = 250_000


@dataclass(frozen=True)
class Stage:
    """``make`` gets a function that gives the rows of an earlier stage, or of ``source``, for the documents at hand."""

    name: str
    make: Callable[[Callable[[str], DataFrame]], DataFrame]
    recoverable: tuple[str, ...] = ()
    #: Paths of columns whose values hardly repeat, so that a dictionary of them is made in vain.
    plain: tuple[str, ...] = ()


def result(df: DataFrame, code: Column | None = None, message: Column | None = None, **made: Column) -> DataFrame:
    """A stage's rows: head, code, message and what is made."""
    text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    return df.select(*HEAD, text(code).alias("code"), text(message).alias("message"), *(c.alias(n) for n, c in made.items()))


# ---- the stages of text documents


def pages_of(text: Column) -> Column:
    """The pages of a text, parted by form feeds: ``page_num`` from 1, ``text``, ``needs_ocr``."""
    # At most so many characters are left of a page without outer white space if nothing but that follows them.
    short = lambda x: T.blank(F.substring(F.ltrim(x, F.lit(T.BLANK)), NATIVE_CHARS + 1, 1 << 30))
    page = lambda x, i: F.struct((i + 1).alias("page_num"), x.alias("text"), short(x).alias("needs_ocr"))
    return F.transform(F.split(text, "\f", -1), page)


def _extract(have: Callable[[str], DataFrame]) -> DataFrame:
    bad = F.coalesce(T.blank(F.col("text")), F.lit(True))
    return result(have("source"), F.when(bad, "PDF_PARSE_ERROR"), F.when(bad, "no text"), pages=F.when(~bad, pages_of(F.col("text"))))


def _density(have: Callable[[str], DataFrame]) -> DataFrame:
    n, ocr = F.size("pages"), F.size(F.filter("pages", lambda p: p["needs_ocr"]))
    chars = F.aggregate("pages", F.lit(0).cast("long"), lambda a, p: a + F.length(p["text"]))
    return result(have("extract"), n_pages=n, n_ocr=ocr, n_text=chars, doc_kind=X.density_class(ocr, n))


def _markdown(have: Callable[[str], DataFrame]) -> DataFrame:
    return result(have("extract"), markdown=F.array_join(F.transform("pages", lambda p: X.page_markdown(p["page_num"], p["text"])), "\n"))


def _reorganize(have: Callable[[str], DataFrame]) -> DataFrame:
    """The rules' text; where it has lost too much, the rough one and a warning."""
    # A generator keeps the text from being computed for every use.
    both = have("markdown").select(*HEAD, "markdown", F.explode(F.array(T.reorganised(F.col("markdown")))).alias("fine"))
    bad = F.coalesce(T.degenerate(F.col("fine"), F.col("markdown")) | T.collapsed(F.col("fine"), F.col("markdown")), F.lit(False))
    both = both.withColumn("bad", bad)
    return result(both, F.when(F.col("bad"), "LLM_REORGANIZE_FAILED"), F.when(F.col("bad"), "rough text kept"), text=F.when(F.col("bad"), F.col("markdown")).otherwise(F.col("fine")))


def _activity(have: Callable[[str], DataFrame]) -> DataFrame:
    """How many tables and rows a text has; only texts with a line that can be a table's row are parted into lines."""
    docs = have("reorganize")
    barred = docs.where(F.col("text").rlike(r"(?m)^\s*\|.*\|\s*$"))
    found = X.table_rows(X.tables(barred)).groupBy(F.col("doc_id").alias("_d")).agg(F.countDistinct("table_idx").alias("n_tables"), F.count("*").alias("n_rows"))
    out = docs.select(*HEAD).join(found, F.col("doc_id") == F.col("_d"), "left")
    return result(out, n_tables=F.coalesce("n_tables", F.lit(0)), n_rows=F.coalesce("n_rows", F.lit(0)))


def _index(have: Callable[[str], DataFrame]) -> DataFrame:
    docs = have("reorganize").select(*HEAD, "text", F.explode(F.array(F.array_distinct(tokens(F.col("text"))))).alias("words"))
    none = F.size("words") == 0
    return result(docs, F.when(none, "INDEX_FAILED"), F.when(none, "nothing to index"), tokens=F.col("words"), title=T.title(F.col("text")))


def _persist(have: Callable[[str], DataFrame]) -> DataFrame:
    parts = [have("density").select(*HEAD, "n_pages", "doc_kind"), have("activity").select("doc_id", "n_tables"), have("index").select("doc_id", "title", F.size("tokens").alias("n_tokens"))]
    docs = reduce(lambda a, b: a.join(b, "doc_id"), parts)
    return result(docs, **{c: F.col(c) for c in ("title", "n_pages", "doc_kind", "n_tables", "n_tokens")})


STAGES = (
    Stage("extract", _extract, plain=("pages.list.element.text",)),
    Stage("density", _density),
    Stage("markdown", _markdown, plain=("markdown",)),
    Stage("reorganize", _reorganize, ("LLM_REORGANIZE_FAILED",), ("text",)),
    Stage("activity", _activity, ("ACTIVITY_EXTRACTION_FAILED",)),
    Stage("index", _index, ("INDEX_FAILED",), ("tokens.list.element", "title")),
    Stage("persist", _persist),
)

# ---- a run


@dataclass(frozen=True)
class Report:
    """What a run did: documents taken, finished, failed and warned of; stages that had work."""

    taken: int
    finished: int
    failed: int
    warnings: int
    stages: tuple[str, ...]


def digest(text: Column) -> Column:
    """Sixteen bytes of a text's SHA-256; null has one of its own."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("\0")), 256), 1, 32))


def todo(library: Library, docs: DataFrame, n_stages: int) -> DataFrame:
    """Documents that need work: ``doc_id``, ``digest``, ``start`` (place of the first stage to run), ``attempt``, ``copies`` of the id."""
    now = docs.where("doc_id IS NOT NULL").select("doc_id", digest(F.col("text")).alias("digest"))
    now = now.groupBy("doc_id").agg(F.min("digest").alias("digest"), F.count("*").alias("copies"))  # an id that stands twice is one document
    manifest = library.manifest()
    if STATE not in manifest.tables:
        return now.withColumn("start", F.lit(0)).withColumn("attempt", F.lit(1))
    old = library.read(STATE, manifest).select(F.col("doc_id").alias("_d"), F.col("digest").alias("_old"), "status", "place", "attempt")
    both = now.join(old, F.col("doc_id") == F.col("_d"), "left")
    same = F.coalesce(F.col("digest") == F.col("_old"), F.lit(False))
    rest = both.where(~(same & (F.col("status") == "done") & (F.col("place") == n_stages - 1)))
    return rest.select("doc_id", "digest", "copies", F.when(same, F.col("place") + 1).otherwise(0).alias("start"), (F.coalesce("attempt", F.lit(0)) + 1).alias("attempt"))


def first_ids(docs: DataFrame) -> tuple[int, int]:
    """The number of ids, and of the rows of the one that stands most often; texts aren't read."""
    ids = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("copies"))
    return tuple(ids.agg(F.count("*"), F.coalesce(F.max("copies"), F.lit(0))).first())


def run(library: Library, docs: DataFrame, stages: Sequence[Stage] = STAGES) -> Report:
    """Bring every document of ``docs`` (``doc_id``, ``text``) through the stages; see the module's text.

    Of rows with one id the one with the least digest is taken; rows without id are left out.
    """
    spark, run_id = library.spark, uuid.uuid4().hex
    base = library.manifest()
    whole = STATE not in base.tables
    n, copies = first_ids(docs) if whole else (0, 0)
    starts, repeated, tasks = {0: n} if n else {}, copies > 1, None
    if repeated or not whole:  # else all documents are taken, each from its one row, and no digest tells more
        tasks = kept(todo(library, docs, len(stages)), "ingest-todo")
        groups = tasks.groupBy("start").agg(F.count("*").alias("n"), F.max("copies").alias("copies")).collect()
        starts, repeated = {r["start"]: r["n"] for r in groups}, any(r["copies"] > 1 for r in groups)
    if not starts:
        return Report(0, 0, 0, 0, ())
    places = {s.name: k for k, s in enumerate(stages)}
    written: dict[str, DataFrame] = {}
    failed: list[DataFrame] = []
    counts = {"success": 0, "warning": 0, "error": 0}
    ran = []

    def few(ids: DataFrame, n: int) -> DataFrame:
        return F.broadcast(ids) if n <= FEW_IDS else ids  # counted, so texts needn't move to meet a few ids

    def alive(df: DataFrame) -> DataFrame:
        return reduce(lambda a, f: a.join(f, "doc_id", "left_anti"), failed, df)

    def source() -> DataFrame:
        text = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
        if tasks is None:  # every row is wanted, and no text has to move
            return text.withColumn("digest", digest(F.col("text"))).withColumn("attempt", F.lit(1))
        wanted = few(tasks.where("start = 0").select("doc_id", F.col("digest").alias("_chosen"), "attempt"), starts.get(0, 0))
        text = text.join(wanted, "doc_id").withColumn("digest", digest(F.col("text"))).where("digest = _chosen").drop("_chosen")
        return text.dropDuplicates(HEAD) if repeated else text

    def reader(place: int) -> Callable[[str], DataFrame]:
        def have(name: str) -> DataFrame:
            if name == "source":
                return source()
            parts = [alive(written[name])] if name in written else []
            again = [k for k in starts if places[name] < k <= place]
            if again:
                ids = tasks.where(F.col("start").isin(again)).select("doc_id", "attempt")
                parts.append(alive(library.read(name, base).drop("attempt").join(few(ids, sum(starts[k] for k in again)), "doc_id")))
            return reduce(DataFrame.unionByName, parts)

        return have

    for place, stage in enumerate(stages):
        if not any(k <= place for k in starts):
            continue
        ran.append(stage.name)
        known = stage.recoverable
        told: list[DataFrame] = []

        def change(tx: Transaction, stage: Stage = stage, place: int = place, known: tuple = known, told: list = told) -> None:
            rows = tx.replace(stage.name, stage.make(reader(place)), ["doc_id"], stage.plain)
            event = F.when(F.col("code").isNull(), "success").when(F.col("code").isin(*known), "warning").otherwise("error") if known else F.when(F.col("code").isNull(), "success").otherwise("error")
            events = rows.select(*HEAD, "code", "message", event.alias("event"))
            end = F.when(F.col("event") == "error", "failed").when(F.lit(place == len(stages) - 1), "done").otherwise("running")
            reached = F.when(F.col("event") == "error", place - 1).otherwise(place)
            state = events.select(*HEAD, end.alias("status"), F.lit(stage.name).alias("stage"), reached.alias("place"), "code")
            tx.replace(STATE, state, ["doc_id"])
            tx.append(LOG, events.select(F.lit(run_id).alias("run"), "doc_id", F.lit(place).alias("place"), F.lit(stage.name).alias("stage"), "event", "code", "message"))
            told[:] = [rows, events]

        library.run(change)
        rows, events = told
        written[stage.name] = rows
        for r in events.groupBy("event").agg(F.count("*").alias("n")).collect():
            counts[r["event"]] += r["n"]
            if r["event"] == "error":
                ids = kept(events.where("event = 'error'").select("doc_id"), "ingest-failed")
                failed.append(few(ids, r["n"]))
    taken = sum(starts.values())
    return Report(taken, taken - counts["error"], counts["error"], counts["warning"], tuple(ran))
