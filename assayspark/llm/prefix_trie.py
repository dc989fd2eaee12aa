"""Conversation prefix trie: an LCP-aware external mergesort of turn sequences whose merged stream emits finished nodes.

A turn is a unit of 20 bytes: half of the SHA-256 of its role and text, and the text's length. A conversation is
the string of its units; texts are shuffled once, to put turns in order, and never again. Equal sequences are
counted before anything is sorted. Tasks sort bounded batches into runs, which carry with each sequence the length
of the prefix that it shares with the one before (LCP), and write them to the shared folder. Ranges of sequences
then meet their slices of all runs, and a loser tree merges them: a prefix shared with the last winner is never
compared again. The merged stream keeps the open path on a stack; a node is finished when the path leaves it.

Ranges cut through subtrees. The nodes on the first and last path of a range are therefore border nodes, which
are summed up over ranges by their prefix digest; sums over subtrees go along the paths. Ids of the conversations
that end at a node are sorted by ranges and packed before one task hashes a node's list.

Bounds: a task of the merge holds its range (``RANGE_BYTES`` of sequences on average), a row holds one
conversation's units (20 bytes a turn).

Defined cases: a null role or text is empty; rows without conv_id belong to no conversation; rows of one turn (or of
none, which come first) go by role and text; repeated rows count as turns; extra columns are left out. An empty
table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import CRC_SQL, Workspace, arrow_batches, arrow_schema, crc_of, shuffle_partitions, small_batches, table

UNIT = 20
#: Bytes and sequences of a sorted run, and mean bytes of a range of the merge.
RUN_BYTES, RUN_ROWS = 16 << 20, 1 << 16
RANGE_BYTES = 16 << 20
#: Ids in a packed block.
BLOCK_IDS = 4096
NOTHING = hashlib.sha256(b"").hexdigest()


def sequences(rows: DataFrame) -> DataFrame:
    """``conv_id`` and ``seq``, the units of its turns in order."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", role.alias("role"), text.alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    digest = F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32)
    unit = F.unhex(F.concat(digest, F.lpad(F.hex(F.length("text").cast("long")), 8, "0")))
    out = rows.sparkSession.createDataFrame([], "conv_id long, seq binary").schema
    shape = arrow_schema(out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined() -> Iterator[tuple]:
            now, units = None, []
            for b in batches:
                for conv, u in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if conv != now:
                        if units:
                            yield now, b"".join(units)
                        now, units = conv, []
                    units.append(u)
            if units:
                yield now, b"".join(units)

        yield from arrow_batches(joined(), shape)

    return rows.select("conv_id", unit.alias("unit")).mapInArrow(work, out)


def rebuilt(seqs: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Each sequence with its first h turns replaced by those of the conversation at the head of its ``every`` ids."""
    conv, h = F.col("conv_id"), F.crc32(F.col("conv_id").cast("string")) % most
    heads = seqs.where(conv % every == 0).select(conv.alias("base"), F.substring("seq", 1, UNIT * (most - 1)).alias("head"))
    part = lambda c, a, n: F.substring(F.col(c), a, n)
    cut = (h * UNIT).cast("int")
    seq = F.concat(F.coalesce(part("head", F.lit(1), cut), F.lit(bytearray())), part("seq", cut + 1, F.lit(2**31 - 1)))
    return seqs.join(heads, conv - conv % every == F.col("base"), "left").select("conv_id", seq.alias("seq"))


def common_units(a: bytes, b: bytes, at: int) -> int:
    """Number of leading units that ``a`` and ``b`` share, of which the first ``at`` are known to be equal."""
    end = min(len(a), len(b)) // UNIT
    while at < end and a[at * UNIT : at * UNIT + UNIT] == b[at * UNIT : at * UNIT + UNIT]:
        at += 1
    return at


def sorted_run(rows: list[tuple]) -> Iterator[tuple]:
    """Rows, whose first field is a sequence, in order, with the LCP to the one before at the front."""
    before = b""
    for row in sorted(rows, key=lambda r: r[0]):
        yield (common_units(before, row[0], 0), *row)
        before = row[0]


class LoserTree:
    """Merges sorted runs of (lcp, sequence, ...); every head carries its LCP with the last winner."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.compared = 0
        self.runs = runs
        self.at = [0] * len(runs)
        self.lcp = [0] * len(runs)
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.losers = [-1] * self.size
        self.winner = self._build(1)

    def _head(self, run: int) -> tuple | None:
        return self.runs[run][self.at[run]] if 0 <= run < len(self.runs) and self.at[run] < len(self.runs[run]) else None

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's LCP becomes that with the winner."""
        x, y = self._head(a), self._head(b)
        if y is None:
            return a, b
        if x is None:
            return b, a
        if self.lcp[a] != self.lcp[b]:  # the longer shared prefix is the smaller sequence; the other's LCP stands
            return (a, b) if self.lcp[a] > self.lcp[b] else (b, a)
        k = common_units(x[1], y[1], self.lcp[a])
        self.compared += k - self.lcp[a] + 1
        if x[1][k * UNIT : k * UNIT + UNIT] <= y[1][k * UNIT : k * UNIT + UNIT]:
            self.lcp[b] = k
            return a, b
        self.lcp[a] = k
        return b, a

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        won, self.losers[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return won

    def __iter__(self) -> Iterator[tuple]:
        """(lcp with the one before, sequence, ...) in order."""
        while (head := self._head(self.winner)) is not None:
            run = self.winner
            yield (self.lcp[run], *head[1:])
            self.at[run] += 1
            if (follower := self._head(run)) is not None:
                self.lcp[run] = follower[0]
            node = (run + self.size) // 2
            while node:
                run, self.losers[node] = self._play(run, self.losers[node])
                node //= 2
            self.winner = run


class _Open:
    """A node of the open path."""

    __slots__ = ("chars", "children", "digest", "end", "first", "least", "leaves", "n", "pending", "saved")

    def __init__(self, chars: int, first: bool) -> None:
        self.chars, self.first = chars, first
        self.n = self.children = self.leaves = self.saved = 0
        self.least = self.end = self.digest = None
        self.pending: list[tuple] = []  # finished children, which wait for this node's least id

    def counts(self, n: int, least: int) -> None:
        self.n += n
        self.least = least if self.least is None else min(self.least, least)


def nodes_of(merged: Iterator[tuple], path: int) -> Iterator[tuple]:
    """Rows of the nodes of one range; ``merged`` gives (lcp, sequence, n, least id) in order, ``path`` numbers its borders.

    A row is (path or null, conv_id, depth, parent's conv_id, digest, parent's digest, n, children, leaves, saved,
    chars, end). Border rows have a path; their children, leaves and saved count finished nodes below them only.
    """
    stack: list[_Open] = []
    sha: list = []  # running digests of the open path's first nodes
    last = b""

    def digest(seq: bytes, depth: int) -> str:
        while len(sha) <= depth:
            h = sha[-1].copy() if sha else hashlib.sha256()
            if sha:
                h.update(seq[(len(sha) - 1) * UNIT : len(sha) * UNIT])
            sha.append(h)
        return sha[depth].hexdigest()

    def border(f: _Open, depth: int, where: int, parent: str | None, real: bool = True) -> tuple:
        values = (f.n, f.children, f.leaves, f.saved) if real else (0, 0, 0, 0)
        return (where, f.least if real else None, depth, None, f.digest, parent, *values, f.chars, f.end if real else None)

    def close(depth: int) -> Iterator[tuple]:
        f, up = stack.pop(), stack[-1]
        up.counts(f.n, f.least)
        if f.first:
            yield from (row[:3] + (None, None, f.digest) + row[6:] for row in f.pending)
            yield border(f, depth, path, up.digest)
            return
        leaves = f.leaves if f.children else 1
        saved = f.saved + (f.n - 1) * f.chars
        yield from (row[:3] + (f.least,) + row[4:] for row in f.pending)
        up.children += 1
        up.leaves += leaves
        up.saved += saved
        up.pending.append((None, f.least, depth, None, None, None, f.n, f.children, leaves, saved, f.chars, f.end))

    started = False
    for lcp, seq, n, least in merged:
        if not started:
            stack.append(_Open(0, True))
            stack[0].digest = digest(seq, 0)
        while len(stack) - 1 > lcp:
            yield from close(len(stack) - 1)
        for depth in range(len(stack), len(seq) // UNIT + 1):
            stack.append(_Open(int.from_bytes(seq[depth * UNIT - 4 : depth * UNIT], "big"), not started))
            if not started:
                stack[-1].digest = digest(seq, depth)
        stack[-1].counts(n, least)
        stack[-1].end = hashlib.sha256(seq).hexdigest()
        started, last = True, seq
    del sha[1:]
    open_to = len(stack) - 1
    only_first = open_to < 0 or stack[-1].first
    for depth in range(open_to + 1):
        stack[depth].digest = digest(last, depth)
    for depth in range(open_to, -1, -1):
        f, parent = stack.pop(), stack[-1] if stack else None
        if parent is not None:
            parent.counts(f.n, f.least)
        up = parent.digest if parent is not None else None
        yield from (row[:3] + (None, None, f.digest) + row[6:] for row in f.pending)
        yield border(f, depth, path if f.first else path + 1, up)
        if f.first and not only_first:
            yield border(f, depth, path + 1, up, False)


_NODE = (
    "path long, conv_id long, depth long, parent_conv_id long, digest string, parent string, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, chars long, end string"
)


def merged_nodes(ws: Workspace, groups: DataFrame) -> DataFrame:
    """Node rows of all ranges from distinct sequences with ``n`` and ``least`` id."""
    spark = groups.sparkSession
    run_schema = spark.createDataFrame([], "run long, place long, lcp int, seq binary, n long, least long").schema
    run_shape = arrow_schema(run_schema)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def formed() -> Iterator[tuple]:
            first = (TaskContext.get().partitionId()) << 32
            held, size = [], 0
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    held.append(row)
                    size += len(row[0]) + 64
                    if size >= RUN_BYTES or len(held) >= RUN_ROWS:
                        yield from ((first, k, *r) for k, r in enumerate(sorted_run(held)))
                        held, size, first = [], 0, first + 1
            yield from ((first, k, *r) for k, r in enumerate(sorted_run(held)))

        yield from arrow_batches(formed(), run_shape)

    written = ws.save(groups.select("seq", "n", "least").mapInArrow(runs, run_schema), "runs")
    size = written.agg(F.coalesce(F.sum(F.length("seq") + 64), F.lit(0))).first()[0]
    ranges = max(shuffle_partitions(spark), -(-size // RANGE_BYTES))
    node_schema = spark.createDataFrame([], _NODE).schema
    node_shape = arrow_schema(node_schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: list[list[tuple]] = []
        now = None
        for b in batches:
            for run, lcp, seq, n, least in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if run != now:
                    slices.append([])
                    now = run
                slices[-1].append((lcp, seq, n, least))
        yield from arrow_batches(nodes_of(iter(LoserTree(slices)), 2 * TaskContext.get().partitionId()), node_shape)

    dealt = written.repartitionByRange(ranges, "seq").sortWithinPartitions("run", "place")
    return ws.save(dealt.select("run", "lcp", "seq", "n", "least").mapInArrow(merge, node_schema), "nodes")


def _summed_borders(border: DataFrame) -> DataFrame:
    """One row for each border node: counts over all ranges, sums over its subtree."""
    summed = border.groupBy("digest").agg(
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.min("conv_id").alias("conv_id"),
        *(F.max(c).alias(c) for c in ("depth", "chars", "parent", "end")), F.min("path").alias("owner"),
    )
    below = summed.groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("more"))
    summed = summed.join(below, F.col("digest") == F.col("of"), "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    own = summed.select(
        F.col("digest").alias("of"), "owner", (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("leaves"),
        (F.col("saved_tokens") + F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.col("chars")).otherwise(0)).alias("saved"),
    )
    mine = lambda c: F.when(F.col("path") == F.col("owner"), F.col(c)).otherwise(0)
    down = Window.partitionBy("path").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    along = border.select("path", "depth", "digest").join(own, F.col("digest") == F.col("of"))
    along = along.select("digest", F.sum(mine("leaves")).over(down).alias("leaves"), F.sum(mine("saved")).over(down).alias("saved"))
    totals = along.groupBy(F.col("digest").alias("of")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    return summed.drop("of").join(totals, F.col("digest") == F.col("of")).select(
        "digest", "parent", "conv_id", "depth", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "end"
    )


def ends(ws: Workspace, convs: DataFrame) -> DataFrame:
    """``end`` (digest of a sequence) and the digest of the ascending ids of its conversations, joined by commas."""
    spark = convs.sparkSession
    ids = convs.select(F.sha2("seq", 256).alias("end"), "conv_id").repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id")
    packed = spark.createDataFrame([], "end string, first long, ids string").schema
    packed_shape = arrow_schema(packed)
    done = spark.createDataFrame([], "end string, ends_sha256 string").schema
    done_shape = arrow_schema(done)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[tuple]:
            now, held = None, []
            for b in batches:
                for end, conv in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if held and (end != now or len(held) == BLOCK_IDS):
                        yield now, held[0], ",".join(map(str, held))
                        held = []
                    now = end
                    held.append(conv)
            if held:
                yield now, held[0], ",".join(map(str, held))

        yield from arrow_batches(blocks(), packed_shape)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashed() -> Iterator[tuple]:
            now, sha = None, None
            for b in batches:
                for end, _, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if end != now:
                        if sha is not None:
                            yield now, sha.hexdigest()
                        now, sha = end, hashlib.sha256(text.encode())
                    else:
                        sha.update(f",{text}".encode())
            if sha is not None:
                yield now, sha.hexdigest()

        yield from arrow_batches(hashed(), done_shape)

    blocks = ids.mapInArrow(pack, packed).repartition("end").sortWithinPartitions("end", "first")
    return ws.save(blocks.mapInArrow(digest, done), "ends")


def trie(ws: Workspace, seqs: DataFrame) -> DataFrame:
    """One row for each node of the trie of ``seqs`` (``conv_id``, ``seq``), which are read more than once."""
    nodes = merged_nodes(ws, seqs.groupBy("seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("least")))
    borders = ws.save(_summed_borders(nodes.where("path IS NOT NULL")), "borders")
    up = borders.select(F.col("digest").alias("up"), F.col("conv_id").alias("above"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end"]
    inner = nodes.where("path IS NULL AND parent IS NULL").select(columns)
    parented = lambda df: df.join(up, F.col("parent") == F.col("up"), "left").withColumn("parent_conv_id", F.col("above")).select(columns)
    every = inner.union(parented(nodes.where("path IS NULL AND parent IS NOT NULL"))).union(parented(borders))
    hashes = ends(ws, seqs).withColumnRenamed("end", "of")
    shown: list[Column | str] = [*columns[:-1]]
    ended = every.where("end IS NOT NULL").join(hashes, F.col("end") == F.col("of")).select(*shown, "ends_sha256")
    return ended.union(every.where("end IS NULL").select(*shown, F.lit(NOTHING).alias("ends_sha256")))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    small_batches(spark)
    ws = Workspace(spark, "op12")
    seqs = ws.save(sequences(table(spark, sf_dir, "conversations")), "sequences")
    return trie(ws, ws.save(rebuilt(seqs), "rebuilt"))


#: Prefixes as lists of turns, grouped; subtrees by joining leaves and nodes with all their prefixes.
ORACLE = f"""
WITH RECURSIVE {CRC_SQL},
talks AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
cuts AS (SELECT conv_id, turns, {crc_of("conv_id::VARCHAR")} % 6 AS h FROM talks, crc_table),
built AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM cuts c LEFT JOIN talks b ON b.conv_id = c.conv_id - c.conv_id % 100),
prefixes AS (SELECT conv_id, len(turns) AS n, d, turns[1:d] AS node FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM built)),
nodes AS (
  SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM prefixes GROUP BY node, d),
under AS (SELECT node[1:depth - 1] AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN under u ON u.depth = n.depth AND u.node = n.node),
above AS (
  SELECT node[1:d] AS node, d AS depth, count(*) FILTER (n_children = 0) AS n_leaves,
         sum(CASE WHEN k > 0 THEN (n_convs - 1) * coalesce(length(node[k].text), 0) ELSE 0 END) AS saved_tokens
  FROM (SELECT *, depth AS k, unnest(range(depth + 1)) AS d FROM full_nodes) GROUP BY 1, 2)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children,
       a.n_leaves::BIGINT AS n_leaves, a.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN above a ON a.depth = f.depth AND a.node = f.node
LEFT JOIN full_nodes p ON p.depth = f.depth - 1 AND p.node = f.node[1:f.depth - 1]
"""
