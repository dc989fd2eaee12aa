"""Conversation structure repair: the cheapest edits that bring the roles of a conversation into ``(s?(ua)+)?``.

Rows get their places once, by ranges of (conv_id, turn, role, text), so a conversation of any length lies in as
many tasks as it fills. Stretches of up to 256 places of one conversation are dealt out by hash; each task puts
batches of whole stretches through one recursive DuckDB query, whose every recursion advances all stretches of the
batch by one turn and keeps the least (cost, audit) for each pair of entry and exit state of the grammar. Two
audits of one cost and as many rows are never prefixes of each other (an insert costs 5), so the least one of a
state stays part of the least whole. A fold over the few stretches of a conversation picks the path; its pieces
go back to the rows, which are edited in order.

Defined cases: a null role or text is one space, rows without conv_id are one conversation, rows of one turn (or
of none, which come first) go by role and text, repeated rows all count, and extra columns are left out. A
conversation without rows costs nothing. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import CRC_SQL, Workspace, arrow_batches, arrow_schema, crc_of, small_batches, table

#: Places in a stretch, as a power of two, and rows that one recursive query takes at a time.
STRETCH_BITS = 8
BATCH_ROWS = 8192

SPACE = " \t\n\x0b\x0c\r"
#: Faults in the order in which they count; 0 is none.
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: Costs of an edit, and what a truncated row that stays adds.
REROLE, DELETE, INSERT, STAYS_TRUNCATED = 1, 2, 5, 5

#: States: nothing yet (0), after system (S), user (U), assistant (A). A conversation may end in 0 or A.
STATES, FINAL = "0SUA", "0A"
NEXT = {("0", "s"): "S", ("0", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
ROLE_AFTER = {"0": "user", "S": "user", "A": "user", "U": "assistant"}


def _moves() -> list[tuple[str, str, str, str, int, str]]:
    """(state, edit, initial it needs or '', state after, cost, letters): an edit of a row with the inserts after it."""
    edits = [(s, "K", initial, to, 0) for (s, initial), to in NEXT.items()]
    edits += [(s, "R", "", NEXT[s, ROLE_AFTER[s][0]], REROLE) for s in STATES]
    edits += [(s, "D", "", s, DELETE) for s in STATES]
    out = []
    for state, edit, need, to, cost in edits:
        letters = edit
        for _ in range(3):  # no insert, one, two; a third would come back to where the first led
            out.append((state, edit, need, to, cost, letters))
            to, cost, letters = NEXT[to, ROLE_AFTER[to][0]], cost + INSERT, letters + "I"
    return out


_WALK = f"""
WITH RECURSIVE walk AS (
  SELECT g, 0 AS i, entry, entry AS state, 0::BIGINT AS cost, '' AS audit
  FROM (SELECT DISTINCT g FROM turns), (VALUES {", ".join(f"('{s}')" for s in STATES)}) s(entry)
  UNION ALL
  SELECT g, i, entry, state, best.cost, best.audit FROM (
    SELECT w.g, w.i + 1 AS i, w.entry, m.target AS state, min({{'cost': w.cost + m.cost
           + CASE WHEN t.fault = {TRUNCATED} AND m.edit <> 'D' THEN {STAYS_TRUNCATED} ELSE 0 END, 'audit': w.audit || m.letters}}) AS best
    FROM walk w JOIN turns t ON t.g = w.g AND t.i = w.i
    JOIN moves m ON m.state = w.state AND m.need IN ('', t.initial) AND (m.edit = 'D' OR t.fault NOT IN ({BLANK}, {DUPLICATE}))
    GROUP BY w.g, w.i, w.entry, m.target)),
ends AS (
  SELECT g, max(i) + 1 AS n, count(*) FILTER (fault = {BLANK}) AS blank, count(*) FILTER (fault = {DUPLICATE}) AS duplicate,
         count(*) FILTER (fault = {TRUNCATED}) AS truncated, min(turn) AS min_turn, max(turn) AS max_turn, count(DISTINCT turn) AS n_turns
  FROM turns GROUP BY g),
pairs AS (
  SELECT b.g, count(*) FILTER (a.initial || b.initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns a JOIN turns b ON b.g = a.g AND b.i = a.i + 1 GROUP BY b.g)
SELECT e.*, coalesce(p.illegal, 0) AS illegal, w.entries, w.exits, w.costs, w.audits, f.initial AS first_initial, l.initial AS last_initial
FROM ends e LEFT JOIN pairs p ON p.g = e.g
JOIN (SELECT w.g, list(entry) AS entries, list(state) AS exits, list(cost) AS costs, list(audit) AS audits
      FROM walk w JOIN ends e ON e.g = w.g AND e.n = w.i GROUP BY w.g) w ON w.g = e.g
JOIN turns f ON f.g = e.g AND f.i = 0 JOIN turns l ON l.g = e.g AND l.i = e.n - 1
ORDER BY e.g
"""
_SUMS = ("blank", "duplicate", "truncated", "illegal")
_WALKED = ["n", *_SUMS, "min_turn", "max_turn", "n_turns", "first_initial", "last_initial", "entries", "exits", "costs", "audits"]


def _conv_type(rows: DataFrame) -> T.DataType:
    return rows.schema["conv_id"].dataType


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the damage that the checksum of ``conv_id:turn`` names: one in four is hurt."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % 20
    rows = conversations.select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"), what.alias("what")).where("what != 0")
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("what") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("what") == 3, 2).otherwise(1)
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy"))
    return rows.drop("copy")


def placed(ws: Workspace, rows: DataFrame) -> DataFrame:
    """Rows in conversation order with ``place``, the ``stretch`` it lies in, the ``initial`` of the role and what is known of a fault."""
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    rows = rows.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    ends = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(ends == "", BLANK).when(~F.right(ends, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    initial = F.substring("role", 1, 1)
    return ws.save(
        rows.select(
            "*", F.shiftright("place", STRETCH_BITS).alias("stretch"),
            F.when(initial.isin("s", "u", "a"), initial).otherwise("-").alias("initial"), fault.alias("fault"),
            F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest"),
        ), "placed",
    )


def _walk(conv_type: pa.DataType):  # noqa: ANN202
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb
        import numpy as np

        con = duckdb.connect(config={"threads": 1})
        con.register("moves", pa.table(dict(zip(("state", "edit", "need", "target", "cost", "letters"), map(list, zip(*_moves(), strict=True)), strict=True))))

        def walked(turns: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
            g = np.zeros(len(turns), dtype=np.int64)
            g[starts] = 1
            g = np.cumsum(g) - 1
            i = np.arange(len(turns)) - starts[g]
            con.register("turns", pa.table({"g": g, "i": i, **{c: turns[c] for c in ("turn", "initial", "fault")}}))
            out = con.sql(_WALK).to_arrow_table()
            con.unregister("turns")
            heads = turns.take(pa.array(starts))
            out = pa.table([heads["conv_id"], heads["stretch"], *(out[c] for c in _WALKED)], names=["conv_id", "stretch", *_WALKED])
            return out.combine_chunks().to_batches()[0]

        waiting: list[pa.RecordBatch] = []

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            """Whole stretches of what is waiting; the last stretch waits on unless no more comes."""
            turns = pa.Table.from_batches(waiting).combine_chunks()
            stretch = turns["stretch"].to_numpy()
            conv = turns["conv_id"].combine_chunks()
            code = conv.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], (stretch[1:] != stretch[:-1]) | (code[1:] != code[:-1])]))
            end = len(turns) if last else int(starts[-1])
            if end:
                yield walked(turns.slice(0, end), starts[starts < end])
            waiting[:] = turns.slice(end).to_batches()

        for b in batches:
            waiting.append(b)
            if sum(w.num_rows for w in waiting) >= BATCH_ROWS:
                yield from cut(False)
        if sum(w.num_rows for w in waiting):
            yield from cut(True)

    return work


class _Fold:
    """The stretches of one conversation put together: for each state the least cost and audit, and how it was reached."""

    def __init__(self) -> None:
        self.best = {"0": (0, ""), "U": (INSERT, "I"), "A": (2 * INSERT, "II")}
        self.start, self.steps, self.stretches = self.best, [], []
        self.sums = dict.fromkeys(_SUMS, 0)
        self.least = self.most = self.last_initial = None
        self.n_turns = 0

    def add(self, row: dict) -> None:
        nxt, came = {}, {}
        for entry, state, cost, audit in zip(row["entries"], row["exits"], row["costs"], row["audits"], strict=True):
            if entry in self.best:
                before = self.best[entry]
                whole = (before[0] + cost, before[1] + audit)
                if state not in nxt or whole < nxt[state]:
                    nxt[state], came[state] = whole, (entry, audit)
        self.best = nxt
        self.steps.append(came)
        self.stretches.append(row["stretch"])
        for c in _SUMS:
            self.sums[c] += row[c]
        if self.last_initial is not None and self.last_initial + row["first_initial"] not in ("su", "ua", "au"):
            self.sums["illegal"] += 1
        self.last_initial = row["last_initial"]
        if row["min_turn"] is not None:
            self.n_turns += row["n_turns"] - (self.most == row["min_turn"])
            self.least = row["min_turn"] if self.least is None else self.least
            self.most = row["max_turn"]

    def rows(self, conv_id) -> Iterator[tuple]:  # noqa: ANN001
        """One row for the conversation, then one for each stretch with the state it is entered in and its edits."""
        (cost, audit), state = min((self.best[s], s) for s in FINAL if s in self.best)
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.n_turns
        pieces = []
        for came in reversed(self.steps):
            entry, piece = came[state]
            pieces.append((entry, piece))
            state = entry
        pieces[-1] = ("0", self.start[state][1] + pieces[-1][1])
        yield (conv_id, None, None, audit, cost, gaps, *(self.sums[c] for c in _SUMS))
        for stretch, (entry, piece) in zip(self.stretches, reversed(pieces), strict=True):
            yield (conv_id, stretch, entry, piece, None, None, *(None for _ in _SUMS))


_PATH = "stretch long, entry string, audit string, cost long, gaps long, " + ", ".join(f"{c} long" for c in _SUMS)


def paths(ws: Workspace, rows: DataFrame) -> DataFrame:
    """The cheapest audits of placed rows: a row for each conversation (``stretch`` null) and one for each of its stretches."""
    spark, conv = rows.sparkSession, _conv_type(rows)
    seen = Window.partitionBy("conv_id", "digest").orderBy("place")
    fault = F.when(F.col("fault") == BLANK, BLANK).when(F.row_number().over(seen) > 1, DUPLICATE).otherwise(F.col("fault"))
    marks = rows.select("conv_id", "stretch", "place", F.col("turn").cast("long").alias("turn"), "initial", fault.alias("fault"))
    marks = marks.repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "place")
    kind = conv.simpleString()
    lists = "entries array<string>, exits array<string>, costs array<long>, audits array<string>"
    counts = ", ".join(f"{c} long" for c in ("n", *_SUMS, "min_turn", "max_turn", "n_turns"))
    walked = marks.mapInArrow(_walk(pa.string()), f"conv_id {kind}, stretch long, {counts}, first_initial string, last_initial string, {lists}")
    out = spark.createDataFrame([], f"conv_id {kind}, {_PATH}").schema
    shape = arrow_schema(out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def folded() -> Iterator[tuple]:
            now, fold = None, None
            for b in batches:
                for row in b.to_pylist():
                    if fold is None or row["conv_id"] != now:
                        if fold is not None:
                            yield from fold.rows(now)
                        now, fold = row["conv_id"], _Fold()
                    fold.add(row)
            if fold is not None:
                yield from fold.rows(now)

        yield from arrow_batches(folded(), shape)

    return ws.save(walked.repartition("conv_id").sortWithinPartitions("conv_id", "stretch").mapInArrow(work, out), "paths")


_TURN = "step long, turn long, edit string, role string, text string"


def repaired(rows: DataFrame, path: DataFrame) -> DataFrame:
    """All rows and inserts in order: ``conv_id``, ``step``, ``turn``, the ``edit``'s initial, ``role`` and ``text``; D rows go."""
    pieces = path.where("stretch IS NOT NULL").select("conv_id", "stretch", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("long").alias("turn"), F.col("entry").alias("role"), F.col("audit").alias("text"))
    turns = rows.select("conv_id", "stretch", "place", F.col("turn").cast("long").alias("turn"), "role", "text")
    both = pieces.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "stretch", "place")
    out = rows.sparkSession.createDataFrame([], f"conv_id {_conv_type(rows).simpleString()}, {_TURN}").schema
    shape = arrow_schema(out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edited() -> Iterator[tuple]:
            now, step, state, piece, at = object(), 0, "0", "", 0
            for b in batches:
                for conv, _, place, turn, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if conv != now:
                        now, step = conv, 0
                    if place < 0:
                        state, piece, at = role, text, 0
                    else:
                        edit, at = piece[at], at + 1
                        if edit != "D":
                            role = role if edit == "K" else ROLE_AFTER[state]
                            state = NEXT[state, role[0]]
                        yield conv, step, turn, edit, role, text
                        step += 1
                    while at < len(piece) and piece[at] == "I":
                        role, at = ROLE_AFTER[state], at + 1
                        state = NEXT[state, role[0]]
                        yield conv, step, None, "I", role, ""
                        step += 1

        yield from arrow_batches(edited(), shape)

    return both.mapInArrow(work, out)


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id`` and the digest of its repaired rows; ``turns`` come as ``repaired`` returns them, with no shuffle between."""
    out = turns.sparkSession.createDataFrame([], f"conv_id {_conv_type(turns).simpleString()}, repaired_sha256 string").schema
    shape = arrow_schema(out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashed() -> Iterator[tuple]:
            now, digest, n = object(), None, 0
            for b in batches:
                for conv, edit, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "edit", "role", "text")), strict=True):
                    if digest is None or conv != now:
                        if digest is not None:
                            yield now, digest.hexdigest()
                        now, digest, n = conv, hashlib.sha256(), 0
                    if edit != "D":
                        digest.update(("\n" * (n > 0) + f"{role}:{text}").encode())
                        n += 1
            if digest is not None:
                yield now, digest.hexdigest()

        yield from arrow_batches(hashed(), shape)

    return turns.mapInArrow(work, out)


def report(ws: Workspace, conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``conversations`` on the repair of ``rows``, some of which may be gone."""
    small_batches(rows.sparkSession)
    at = placed(ws, rows)
    path = paths(ws, at)
    numbers = ["gaps", *_SUMS, "cost"]

    def part(df: DataFrame, *have: str) -> DataFrame:
        kinds = dict.fromkeys(numbers, "long") | {"audit": "string", "repaired_sha256": "string"}
        return df.select("conv_id", *(F.col(c) if c in have else F.lit(None).cast(k).alias(c) for c, k in kinds.items()))

    parts = part(conversations.select("conv_id")).union(part(path.where("stretch IS NULL"), *numbers, "audit")).union(part(digests(repaired(at, path)), "repaired_sha256"))
    least: dict[str, Column] = dict.fromkeys(numbers, F.lit(0)) | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return parts.groupBy("conv_id").agg(*(F.coalesce(F.max(c), d).alias(c) for c, d in least.items()))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair of every damaged conversation."""
    talks = table(spark, sf_dir, "conversations")
    return report(Workspace(spark, "op11"), talks, damaged(talks))


_SQL_MOVES = ", ".join(f"('{s}', '{e}', '{n}', '{t}', {c}, '{x}')" for s, e, n, t, c, x in _moves())

#: Walks whole conversations, one turn in each recursion, from the state before anything; the contract's rules in SQL.
ORACLE = rf"""
WITH RECURSIVE {CRC_SQL},
hurt AS (
  SELECT conv_id, turn, CASE what WHEN 4 THEN 'user' ELSE role END AS role,
         CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE what WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               {crc_of("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS what
        FROM conversations, crc_table) WHERE what <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
                    left(role, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ends FROM hurt),
marked AS (SELECT *, dense_rank() OVER (ORDER BY conv_id) AS g, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS was,
                  CASE WHEN ends = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
                       WHEN right(ends, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM numbered),
moves(state, edit, need, target, cost, letters) AS (VALUES {_SQL_MOVES}),
walk AS (
  SELECT g, 0 AS i, state, cost, audit FROM (SELECT DISTINCT g FROM marked),
         (VALUES ('0', 0, ''), ('U', 5, 'I'), ('A', 10, 'II')) s(state, cost, audit)
  UNION ALL
  SELECT g, i, state, best.cost, best.audit FROM (
    SELECT w.g, w.i + 1 AS i, m.target AS state, min({{'cost': w.cost + m.cost + CASE WHEN t.fault = 3 AND m.edit <> 'D' THEN 5 ELSE 0 END,
           'audit': w.audit || m.letters}}) AS best
    FROM walk w JOIN marked t ON t.g = w.g AND t.i = w.i + 1
    JOIN moves m ON m.state = w.state AND m.need IN ('', t.initial) AND (m.edit = 'D' OR t.fault NOT IN (1, 2))
    GROUP BY w.g, w.i, m.target)),
chosen AS (SELECT g, min({{'cost': cost, 'audit': audit}}) AS best FROM walk w JOIN (SELECT g, max(i) AS n FROM marked GROUP BY g) e USING (g) WHERE w.i = e.n AND state IN ('0', 'A') GROUP BY g),
letters AS (SELECT g, k, substr(best.audit, k, 1) AS edit, length(best.audit) - length(replace(best.audit, 'D', '')) AS gone, length(best.audit) AS n
            FROM (SELECT g, best, unnest(range(1, length(best.audit) + 1)) AS k FROM chosen)),
spots AS (SELECT *, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY k) AS i,
                 sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY k) AS j FROM letters),
lines AS (
  SELECT s.g, s.k, CASE s.edit WHEN 'K' THEN m.role ELSE CASE WHEN (s.n - s.gone - s.j) % 2 = 1 THEN 'user' ELSE 'assistant' END END
         || ':' || CASE s.edit WHEN 'I' THEN '' ELSE m.text END AS line
  FROM spots s LEFT JOIN marked m ON m.g = s.g AND m.i = s.i WHERE s.edit <> 'D'),
bodies AS (SELECT g, sha256(string_agg(line, chr(10) ORDER BY k)) AS repaired_sha256 FROM lines GROUP BY g),
told AS (
  SELECT g, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (i > 1 AND was || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY g)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN chosen USING (g) LEFT JOIN bodies USING (g)
"""
