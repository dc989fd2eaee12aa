"""Live state of a session as keyed stream state: ring of the last rows, cache with a life time, tails that end by themselves.

Each is a stateful processor of a grouped stream. State lives in the session's state store (:func:`with_state_store`), its
versions in the query's checkpoint, so a query that is started again goes on where it stopped. What a trigger may bring
for a key is bounded by the source's options (files per trigger); a key's state is bounded as each processor says.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from assayspark.streaming.logs import EMPTY_POLLS, RING

#: Entries of a key above which outlived ones are removed, and how long an entry lives.
PURGE_ABOVE, TTL_MS = 256, 30_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> SparkSession:
    """A session of its own settings whose streams can hold lists, maps and timers."""
    own = spark.newSession()
    own.conf.set(PROVIDER, ROCKS)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own


class _Ring(StatefulProcessor):
    """The last rows of each key by number, and what came in and went out with a batch. State: at most ``n`` rows a key."""

    def __init__(self, n: int, key: str, order: str, schema: T.StructType) -> None:
        self.n, self.key, self.order, self.schema = n, key, order, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("ring", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        names = self.schema.names
        before = pd.DataFrame([tuple(r) for r in self.rows.get()], columns=names)
        now = before
        for part in rows:  # each part is cut at once, so a key's batch may be of any size
            now = pd.concat([now, part[names]] if len(now) else [part[names]]).drop_duplicates(self.order).sort_values(self.order).tail(self.n)
        self.rows.put([tuple(v.item() if hasattr(v, "item") else v for v in r) for r in now.itertuples(index=False)])
        entered = now[~now[self.order].isin(before[self.order])]
        left = before[~before[self.order].isin(now[self.order])]
        for part, kept in ((entered, True), (left, False)):
            if len(part):
                yield part.astype(object).assign(**{self.key: key[0], "kept": kept})[[self.key, *names, "kept"]]

    def close(self) -> None:
        pass


def ring(stream: DataFrame, key: str, n: int = RING, order: str = "seq") -> DataFrame:
    """Changes of the ring of each key: rows that came in (``kept``) and rows that were pushed out."""
    rest = T.StructType([f for f in stream.schema.fields if f.name != key])
    out = T.StructType([stream.schema[key], *rest.fields, T.StructField("kept", T.BooleanType())])
    return stream.groupBy(key).transformWithStateInPandas(_Ring(n, key, order, rest), out, "Update", "None")


def ring_content(changes: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """What a ring holds, by all changes that it has told. A row enters once and leaves at most once."""
    rest = [c for c in changes.columns if c not in (key, order, "kept")]
    both = changes.groupBy(key, order).agg(F.bool_and("kept").alias("kept"), *(F.first(c).alias(c) for c in rest))
    return both.where("kept").select(*[c for c in changes.columns if c != "kept"])


class _Cache(StatefulProcessor):
    """Answers by page of one document; an entry outlives ``ttl_ms`` never, and a map above ``most`` is purged."""

    def __init__(self, ttl_ms: int, most: int) -> None:
        self.ttl_ms, self.most = ttl_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("pages", "page long", "payload string, at long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        asked = pd.concat(list(rows)).sort_values("seq")
        out = []
        for seq, page, payload in asked[["seq", "page", "payload"]].itertuples(index=False):
            # The time is compared too: the store removes outlived entries at the end of a batch only.
            held = self.pages.getValue((int(page),)) if self.pages.containsKey((int(page),)) else None
            hit = held is not None and held[1] > now - self.ttl_ms
            if not hit:
                self.pages.updateValue((int(page),), (payload, int(now)))
            out.append((*key, page, seq, held[0] if hit else payload, hit))
        entries = list(self.pages.iterator())
        if len(entries) > self.most:
            for page, (_, at) in entries:
                if at <= now - self.ttl_ms:
                    self.pages.removeKey(tuple(page))
        yield pd.DataFrame(out, columns=["root", "doc_id", "page", "seq", "payload", "from_cache"])

    def close(self) -> None:
        pass


def answered(requests: DataFrame, ttl_ms: int = TTL_MS, most: int = PURGE_ABOVE) -> DataFrame:
    """Requests (``root``, ``doc_id``, ``page``, ``seq``, ``payload``) with the payload that they are served.

    The first request of a page is served its own payload, which is kept; those within its life time get the same one.
    """
    types = {f.name: f.dataType.simpleString() for f in requests.schema.fields}
    out = f"root {types['root']}, doc_id {types['doc_id']}, page {types['page']}, seq {types['seq']}, payload string, from_cache boolean"
    return requests.groupBy("root", "doc_id").transformWithStateInPandas(_Cache(ttl_ms, most), out, "Append", "ProcessingTime")


def _rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["task", "id", "level", "message", "ended"], dtype=object)


class _Tail(StatefulProcessor):
    """New rows of a task in order. A timer is a poll: after ``polls`` empty ones in a row the tail ends, unless the task is active.

    State of a task: the last number, the empty polls, and whether its last row says that it goes on.
    """

    def __init__(self, polls: int, every_ms: int, active: tuple[str, ...]) -> None:
        self.polls, self.every_ms, self.active = polls, every_ms, active

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("tail", "last long, empty int, active boolean")

    def _again(self, now: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(now + self.every_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        last, _, active = self.state.get() or (-1, 0, True)
        new = pd.concat(list(rows))
        new = new[new["id"] > last].drop_duplicates("id").sort_values("id")
        if len(new):
            last, active = int(new["id"].iloc[-1]), str(new["level"].iloc[-1]) in self.active
            self.state.update((last, 0, bool(active)))
            yield _rows([(key[0], int(i), level, message, False) for i, level, message in new[["id", "level", "message"]].astype(object).itertuples(index=False)])
        self._again(timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        last, empty, active = self.state.get() or (-1, 0, True)
        empty += 1
        if empty > self.polls and not active:
            self.state.clear()
            yield _rows([(key[0], last, None, None, True)])
            return
        self.state.update((last, empty, active))
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.every_ms)
        yield _rows([])

    def close(self) -> None:
        pass


#: Levels of a last row after which more is to be expected.
ACTIVE = ("start", "progress", "processing")


def tails(logs: DataFrame, polls: int = EMPTY_POLLS, every_ms: int = 1000, active: tuple[str, ...] = ACTIVE) -> DataFrame:
    """New rows of every task (``task``, ``id``, ``level``, ``message``), then a row that says that its tail has ``ended``."""
    key = logs.schema["task"].dataType.simpleString()
    out = f"task {key}, id long, level string, message string, ended boolean"
    rows = logs.select("task", F.col("id").cast("long"), "level", "message")
    return rows.groupBy("task").transformWithStateInPandas(_Tail(polls, every_ms, active), out, "Append", "ProcessingTime")


def follow(tail: DataFrame, tasks: set, take: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second") -> StreamingQuery:
    """Give each batch of a tail to ``take`` until the tails of all ``tasks`` (a reader's few) have ended; the query then stops itself.

    A batch may come twice after a failure, under the same number.
    """
    open_tasks = set(tasks)
    query: list[StreamingQuery] = []

    def step(batch: DataFrame, no: int) -> None:
        take(batch, no)
        wanted = batch.where(F.col("ended") & F.col("task").isin(list(tasks))).select("task").distinct()
        open_tasks.difference_update(r["task"] for r in wanted.collect())
        if not open_tasks and query:
            import threading

            threading.Thread(target=query[0].stop, daemon=True).start()  # after this batch has been committed

    query.append(tail.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=every).start())
    return query[0]
