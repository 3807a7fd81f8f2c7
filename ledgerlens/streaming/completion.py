"""Responses written while the stream runs, each once, when its request is over.

State per request is a few numbers, kept by ``transformWithState`` on processing time, in a list for each of ``GROUPS`` groups of requests: a trigger reads and
writes the lists of the groups that have lines or requests that are due.  A group's timer ends a request

* ``grace`` after the last line, once its end marker is in (lines that arrive out of order still count),
* after ``read_timeout`` of silence: what came is folded, and the fold reports the missing end,
* at its attempt limit, however many lines still come: a retryable failure without text (T4).

Then a marker that Spark drops after ``marker`` (a time to live) makes late lines known as such (T5).

Lines go to a store of ``buckets`` by a hash of the request.  A trigger writes its lines there, split by bucket; where requests of a bucket are over, it
reads that bucket alone, folds their lines and writes their responses.  A bucket whose lines are mostly of requests that are over, or that has
``FOLDERS`` folders, is rewritten without these lines.  So a bucket holds at most about twice the lines of its open requests, and what a trigger
reads and writes follows its own lines and the open requests in its buckets, not the history.

A trigger becomes current by its version file, which names the folders that count (at most ``buckets`` x ``FOLDERS`` entries); a trigger that runs again
starts from the version before it, and folders that no version names any more are deleted one trigger later.

Rows without a request id are dropped.  Repeated lines (same request and seq) count as they do in the batch fold.  An empty trigger
writes nothing.  Extra columns are ignored.
"""
from __future__ import annotations

import json
import threading
import time
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import classify as C
from ..functions import usage as U
from ..operators import chunks as CH
from ..sources import files
from .assemble import SPECS, _arrived, _combine

BUCKETS, FOLDERS, SHARE = 32, 8, 4
#: Groups of requests in the state, by a hash; fixed for the life of a checkpoint.
GROUPS = 2048
OPEN = "request_id string, started long, last long, first_arrived long, last_arrived long, ended boolean"
OVER = "request_id string, kind string, first_arrived long, last_arrived long"
HELD = "request_id string, seq long, line string, arrived long, first_arrived long, last_arrived long"
#: How a request ended; ``late`` lines belong to one that was over already.
ENDED, SILENT, LIMIT, LATE = "ended", "silent", "limit", "late"
#: A trigger's changes to the state are written, not all of it.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


class Requests(StatefulProcessor):
    """The lives of a group's requests.  Times are milliseconds; ``limit_ms`` may be None."""

    def __init__(self, read_timeout_ms: int, grace_ms: int, marker_ms: int, limit_ms: int | None):
        self.read_timeout_ms, self.grace_ms, self.marker_ms, self.limit_ms = read_timeout_ms, grace_ms, marker_ms, limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", OPEN)
        self.over = handle.getListState("over", "request_id string", ttlDurationMs=self.marker_ms)  # each entry has a life of its own
        self.next = handle.getValueState("next", "at long")

    def _due(self, request: tuple) -> int:
        _, started, last, _, _, ended = request
        due = last + (self.grace_ms if ended else self.read_timeout_ms)
        return due if ended or self.limit_ms is None else min(due, started + self.limit_ms)

    def _keep(self, requests: list[tuple], timer: int | None, now: int) -> None:
        """These are open; ``timer`` is the one that waits, if any.  It stays where it is due no later than they are."""
        if not requests:
            self.open.clear()
            self.next.clear()
            return
        self.open.put(requests)
        due = max(min(map(self._due, requests)), now + 1)
        if timer is None or due < timer:
            self.handle.registerTimer(due)
            self.next.update((due,))

    def handleInputRows(self, key, rows, timerValues):
        now, came = timerValues.getCurrentProcessingTimeInMs(), {}
        for row in rows:
            arrived, ends = came.get(row.request_id, (0, False))
            came[row.request_id] = max(arrived, row.arrived), ends or row.ends
        held = {x[0]: tuple(x) for x in self.open.get()}
        late = {x[0] for x in self.over.get()} & (came.keys() - held.keys()) if came.keys() - held.keys() else set()  # a request is never both
        for request_id, (arrived, ends) in came.items():
            if request_id in late:
                yield Row(request_id=request_id, kind=LATE, first_arrived=arrived, last_arrived=arrived)
            else:
                _, started, _, first, _, ended = held.get(request_id, (request_id, now, now, arrived, arrived, False))
                held[request_id] = (request_id, started, now, first, arrived, ended or ends)
        if len(late) < len(came):
            timer = self.next.get()
            self._keep(list(held.values()), timer and timer[0], now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, timer = timerValues.getCurrentProcessingTimeInMs(), self.next.get()
        if timer is None or timer[0] != expiredTimerInfo.getExpiryTimeInMs():
            return  # an earlier one has taken its place
        held = [tuple(x) for x in self.open.get()]
        over = [x for x in held if self._due(x) <= now]
        self._keep([x for x in held if self._due(x) > now], None, now)
        if over:
            self.over.appendList([(x[0],) for x in over])
        for request_id, started, _, first, arrived, ended in over:
            limit = not ended and self.limit_ms is not None and started + self.limit_ms <= now
            yield Row(request_id=request_id, kind=ENDED if ended else LIMIT if limit else SILENT, first_arrived=first, last_arrived=arrived)

    def close(self) -> None:
        pass


def assemble(lines: DataFrame, protocol: str, read_timeout_ms: int = 120_000, grace_ms: int = 5_000, marker_ms: int = 600_000, limit_ms: int | None = None) -> DataFrame:
    """All lines (kind null) as they come, and a row for each request that is over or has late lines."""
    own = lines.where("request_id IS NOT NULL").withColumn("request_id", F.col("request_id").cast("string"))
    ends = F.coalesce(SPECS[protocol]().end, F.lit(False)).alias("ends")
    # ts only fits the columns that are combined; nothing here runs on event time
    flags = CH.parse_sse(own).select("request_id", F.lit(None).cast("timestamp").alias("ts"), ends, _arrived())
    # once more by request, so that the state's worker sees one row a request, however many tasks the lines came from
    once = flags.mapInArrow(_combine, flags.schema).repartition("request_id").mapInArrow(_combine, flags.schema)
    # each call to the state is a round trip, some 0.2 ms: a group of requests has as many as a single one would
    marks = once.select(F.pmod(F.xxhash64("request_id"), F.lit(GROUPS)).alias("g"), "request_id", "ends", "arrived").groupBy("g").transformWithState(
        Requests(read_timeout_ms, grace_ms, marker_ms, limit_ms), OVER, "append", "processingTime")
    kept = own.select("request_id", "seq", "line", _arrived(), F.lit(None).cast("string").alias("kind"))
    return kept.unionByName(marks, allowMissingColumns=True)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("request_id"), F.lit(buckets)).cast("int")


def _within(lines: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """Lines of the marked requests that arrived while they ran (or the other lines, ``left_anti``)."""
    m = marks.select(F.col("request_id").alias("_id"), F.col("first_arrived").alias("_from"), F.col("last_arrived").alias("_to"))
    return lines.join(m, (F.col("request_id") == F.col("_id")) & F.col("arrived").between(F.col("_from"), F.col("_to")), how)


def limit_rows(marks: DataFrame, limit_ms: int | None) -> DataFrame:
    """T4: the failure row of attempts beyond their limit: no text, no usage."""
    zero = {c: F.lit(False) if c == "answer_tokens_estimated" else F.lit(0).cast("long") for c in U.USAGE_FIELDS}
    seconds = (limit_ms or 0) / 1000
    text = str(int(seconds)) if seconds == int(seconds) else str(seconds)
    return marks.where(F.col("kind") == LIMIT).select("request_id", F.lit("").alias("text"), F.lit(CH.DEFAULT_MODEL).alias("model"), F.lit(None).cast("string").alias("finish_reason"),
                                                      *[v.alias(c) for c, v in zero.items()], F.lit(f"{C.WALL_CLOCK_TIMEOUT}{text}s").alias("error"))


class Store:
    """The line store and the responses below ``path``."""

    def __init__(self, spark: SparkSession, path: str, protocol: str, buckets: int = BUCKETS, limit_ms: int | None = None):
        self.base, self.protocol, self.buckets, self.limit_ms = path.rstrip("/"), protocol, buckets, limit_ms
        #: of each bucket: folder -> [lines, lines of requests that are over], and the mark folders since its last rewrite
        self.version = self._last(spark) or {"batch": -1, "buckets": {}, "old": [], "read": 0, "written": 0, "responses": 0, "total": 0}
        self.at_work, self.closed, self.refused = threading.Lock(), False, False

    def _last(self, spark: SparkSession) -> dict | None:
        own = [n for n in files.names(spark, f"{self.base}/version") if n.endswith(".json")]
        return json.loads(files.read_text(spark, f"{self.base}/version/{own[-1]}")) if own else None

    def _lines(self, spark: SparkSession, held: dict, names: list[str]) -> DataFrame:
        paths = [f"{self.base}/lines/{folder}/b={b}" for b in names for folder in held[b]["lines"]]
        return spark.read.schema(HELD).parquet(*paths).withColumn("b", _bucket(self.buckets))

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Rows for a write by bucket.  Each file costs time of its own, so a task gets about ``SHARE`` shares of buckets and not a part of each bucket; the
        slices of a hot request are in several shares."""
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        shares = max(SHARE, -(-SHARE * tasks // self.buckets))
        return rows.repartition("b", F.pmod(F.xxhash64("request_id", F.floor(F.col("seq") / F.lit(CH.BUCKET))), F.lit(shares)))

    def _marks(self, spark: SparkSession, held: dict, names: list[str]) -> DataFrame:
        paths = sorted({f"{self.base}/marks/{folder}" for b in names for folder in held[b]["marks"]})
        return spark.read.schema(OVER).parquet(*paths)

    def close(self) -> None:
        """Take no further trigger.  One at work is finished; the next one fails before it has read anything, so that a later stream runs it again."""
        with self.at_work:
            self.closed = True

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """One trigger: its lines are stored, the requests that are over get their responses."""
        with self.at_work:
            if self.closed:
                self.refused = True
                raise RuntimeError("the store is closed: the stream was stopped")
            self._add(batch, batch_id)

    def _add(self, batch: DataFrame, batch_id: int) -> None:
        spark, before = batch.sparkSession, self.version
        if batch_id <= before["batch"]:
            return  # this trigger is in already
        tag = f"{batch_id:012d}-{uuid.uuid4().hex[:8]}"
        arrived = f"{self.base}/arrivals/{tag}"
        # slices of a hot request go to several tasks; the stateful part runs once, as all else reads these files
        dealt = self._dealt(batch.withColumn("b", _bucket(self.buckets)))
        dealt.withColumn("k", F.when(F.col("kind").isNull(), "lines").otherwise("marks")).write.partitionBy("k", "b").parquet(arrived)
        kinds = files.names(spark, arrived)
        held = {b: {"lines": dict(x["lines"]), "marks": list(x["marks"])} for b, x in before["buckets"].items()}
        old, read, written, n_responses = [arrived], 0, 0, 0
        if "k=lines" in kinds:
            files.move(spark, f"{arrived}/k=lines", f"{self.base}/lines/{tag}")
            for r in spark.read.schema("b int").parquet(f"{self.base}/lines/{tag}").groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect():  # a row a bucket
                held.setdefault(str(r["b"]), {"lines": {}, "marks": []})["lines"][tag] = [r["n"], 0]
                written += r["n"]
        if "k=marks" in kinds:
            marks = spark.read.schema(f"{OVER}, b int").parquet(f"{arrived}/k=marks")
            files.move(spark, f"{arrived}/k=marks", f"{self.base}/marks/{tag}")
            marks = spark.read.schema(f"{OVER}, b int").parquet(f"{self.base}/marks/{tag}")
            touched = {str(r["b"]): r["n"] for r in marks.groupBy("b").agg(F.count(F.when(F.col("kind") != LATE, 1)).alias("n")).collect()}  # a row a bucket
            over = [b for b, n in touched.items() if n]
            if over:
                n_responses = sum(touched.values())
                read += self._rows(held, over)
                lines = _within(self._lines(spark, held, over), marks.where(F.col("kind").isin(ENDED, SILENT)), "left_semi").select("request_id", "seq", "line")
                # dealt by the fold's slices: left as the join deals them, all lines of a hot request would stay in one task
                folded = CH.fold(lines.repartition("request_id", F.floor(F.col("seq") / F.lit(CH.BUCKET))), self.protocol)
                kind = marks.where(F.col("kind").isin(ENDED, SILENT)).select("request_id", "kind")
                rows = folded.join(kind, "request_id").unionByName(limit_rows(marks, self.limit_ms).withColumn("kind", F.lit(LIMIT)))
                rows.withColumn("retryable", ~C.non_retryable(F.lit(None).cast("int"), "error") & F.col("error").isNotNull()).write.parquet(f"{self.base}/responses/{tag}")
            for b in touched:
                held.setdefault(b, {"lines": {}, "marks": []})["marks"].append(f"{tag}/b={b}")
            gone = self._gone(spark, held, list(touched), marks)
            read += self._rows(held, touched)
            for b, n in gone.items():
                first = next(iter(held[b]["lines"].values()))
                first[1] += n  # which folder they are in doesn't matter: a bucket is rewritten whole
        full = [b for b, x in held.items() if x["lines"] and (len(x["lines"]) >= FOLDERS or len(x["marks"]) >= 4 * FOLDERS or 2 * sum(d for _, d in x["lines"].values()) >= self._rows(held, [b]))]
        if full:
            read += self._rows(held, full)
            kept = self._lines(spark, held, full)
            if any(held[b]["marks"] for b in full):
                kept = _within(kept, self._marks(spark, held, full), "left_anti")
            self._dealt(kept).write.partitionBy("b").parquet(f"{self.base}/lines/{tag}-kept")
            left = {str(r["b"]): r["n"] for r in spark.read.schema(f"{HELD}, b int").parquet(f"{self.base}/lines/{tag}-kept").groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()}
            for b in full:
                old += [f"{self.base}/lines/{folder}/b={b}" for folder in held[b]["lines"]] + [f"{self.base}/marks/{folder}" for folder in held[b]["marks"]]
                held[b] = {"lines": {f"{tag}-kept": [left[b], 0]} if b in left else {}, "marks": []}
                written += left.get(b, 0)
        old += [f"{self.base}/marks/{folder}" for x in held.values() if not x["lines"] for folder in x["marks"]]
        version = {"batch": batch_id, "buckets": {b: x for b, x in held.items() if x["lines"]}, "old": old, "read": read, "written": written,
                   "responses": n_responses, "total": before["total"] + n_responses}
        files.create(spark, f"{self.base}/version/{tag}.json", json.dumps(version))
        for path in before["old"]:  # what the version before the last one still named
            files.remove(spark, path)
        self.version = version

    @staticmethod
    def _rows(held: dict, names) -> int:
        return sum(n for b in names for n, _ in held[b]["lines"].values())

    def _gone(self, spark: SparkSession, held: dict, names: list[str], marks: DataFrame) -> dict[str, int]:
        """How many lines of each bucket this trigger's marks end."""
        own = [b for b in names if held[b]["lines"]]
        if not own:
            return {}
        lines = _within(self._lines(spark, held, own).select("request_id", "arrived", "b"), marks, "left_semi")
        return {str(r["b"]): r["n"] for r in lines.groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()}


def start(lines: DataFrame, path: str, checkpoint: str, protocol: str, interval: str = "1 second", buckets: int = BUCKETS, limit_ms: int | None = None,
          **times) -> tuple[StreamingQuery, Store]:
    """Run the stream: responses appear below ``path`` as requests get over.  The store's ``version`` says how far it is."""
    spark = lines.sparkSession
    store = Store(spark, path, protocol, buckets, limit_ms)
    was = {name: spark.conf.get(name, None) for name in STATE}
    for name, value in STATE.items():  # the query takes a copy of the settings when it starts
        spark.conf.set(name, value)
    try:
        return (assemble(lines, protocol, limit_ms=limit_ms, **times).writeStream.foreachBatch(store.add).option("checkpointLocation", checkpoint)
                .trigger(processingTime=interval).start()), store
    finally:
        for name, value in was.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)


def run_until(query: StreamingQuery, store: Store, total: int, seconds: float = 900) -> None:
    """Let the stream run until ``total`` responses are out, then stop it behind that trigger; or until ``seconds`` went by since a trigger that had
    lines or responses.

    Triggers may follow each other without a gap: the store is closed to the next one, and the stream stopped when the last one is committed."""
    end, last = time.monotonic() + seconds, store.version["batch"]
    while query.isActive and (now := store.version)["total"] < total:
        done, last = now["batch"] != last, now["batch"]
        if done and (now["written"] or now["responses"]):
            end = time.monotonic() + seconds
        elif time.monotonic() > end and (done or not query.status["isTriggerActive"]):  # never within a trigger
            break
        time.sleep(0.02)
    store.close()
    while query.isActive and query.status["isTriggerActive"] and (query.lastProgress is None or query.lastProgress.batchId < store.version["batch"]):
        time.sleep(0.01)
    failed = query.exception()
    query.stop()
    if failed and not store.refused:
        raise failed
    if store.version["total"] < total:
        raise TimeoutError(f"{store.version['total']} of {total} responses are out")


def responses(spark: SparkSession, path: str, key_type: str = "string") -> DataFrame:
    """The responses that are out, as published: request_id, those of the fold, kind and retryable."""
    base = path.rstrip("/")
    tags = {n.removesuffix(".json") for n in files.names(spark, f"{base}/version") if n.endswith(".json")}
    folders = [f"{base}/responses/{n}" for n in files.names(spark, f"{base}/responses") if n in tags]
    if not folders:
        raise FileNotFoundError(f"no responses below {base}")
    return spark.read.parquet(*folders).withColumn("request_id", F.col("request_id").cast(key_type))
