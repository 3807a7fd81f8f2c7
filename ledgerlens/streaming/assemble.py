"""Streaming response assembly (T1, T4 timer, T5 late-chunk policy), for any protocol and key type.

A request is over a while (``grace``) after its end marker, so that lines that arrive out
of order are in, or when it has been silent longer than the read timeout.  The stream's
output has two kinds of rows: every line, passed on as it comes and held nowhere, and one
mark for each request that is over, with the first and last arrival of its lines.  State
holds five numbers and flags a request and no line; before the shuffle the lines of each task are
reduced to one row per request, so a hot request costs its state's task a row a task.

``responses`` joins lines and marks and lets the batch fold (C1-C3) make the responses;
batch and stream agree on every request, and there is one response per request.  Lines that
arrive after the mark are ignored while the marker that stays in state lives (T5).  Timers
run on the lines' event time behind a watermark; ``lateness`` is how far lines may arrive
out of event-time order (a line beyond that moves no timer, but is part of the response if
it arrives between the request's other lines).  Arrivals are the start times of the
micro-batches, so the driver's clock must not run backwards from one to the next.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import chunks as CH

SPECS = {"chat": CH.chat_spec, "responses": CH.responses_spec, "messages": CH.messages_spec}
#: A line has ``arrived``; a mark has ``timed_out`` and the arrivals between which its lines came.
HELD = "request_id string, seq long, line string, timed_out boolean, arrived long, first_arrived long, last_arrived long"
MARKS = "request_id string, timed_out boolean, first_arrived long, last_arrived long"
STATE = "first_arrived long, last_arrived long, ended boolean, emitted boolean, last_ms long"


def marked(lines: DataFrame, protocol: str) -> DataFrame:
    """request_id (as text), ts, whether the line ends its request, and when it arrived."""
    ev = CH.parse_sse(lines)
    return ev.select(F.col("request_id").cast("string").alias("request_id"), "ts",
                     F.coalesce(SPECS[protocol]().end, F.lit(False)).alias("ends"), _arrived())


def _arrived():
    # in a stream, the same for all rows of a micro-batch, also when it runs again
    return F.unix_micros(F.current_timestamp()).alias("arrived")


#: Rows that ``_combine`` holds.
COMBINED = 1 << 18


def _combine(batches: Iterator[pa.RecordBatch], most: int = COMBINED) -> Iterator[pa.RecordBatch]:
    """One row per request and task (more where a task has over ``most`` / 2 requests); rows without a request id are one, too."""
    held, n = [], 0

    def reduced(parts):
        got = pa.Table.from_batches(parts).group_by("request_id").aggregate([("ts", "max"), ("ends", "max"), ("arrived", "max")])
        return got.select(["request_id", "ts_max", "ends_max", "arrived_max"]).rename_columns(parts[0].schema.names).combine_chunks().to_batches()

    for batch in batches:
        if batch.num_rows:
            own = reduced([batch])
            held, n = held + own, n + sum(x.num_rows for x in own)
            if n > most:
                held = reduced(held)
                n = sum(x.num_rows for x in held)
                if 2 * n > most:
                    yield from held
                    held, n = [], 0
    if held:
        yield from reduced(held)


def _over(read_timeout_ms: int, grace_ms: int, marker_ms: int):
    def step(key, batches, state):
        if key[0] is None:  # a heartbeat
            return
        first, last, ended, emitted, last_ms = state.get if state.exists else (None, None, False, False, 0)
        if state.hasTimedOut:
            if emitted:
                state.remove()
                return
            state.update((first, last, ended, True, last_ms))
            state.setTimeoutTimestamp(max(last_ms + marker_ms, state.getCurrentWatermarkMs() + 1))
            yield pd.DataFrame({"request_id": [key[0]], "timed_out": [not ended], "first_arrived": [first], "last_arrived": [last]})
            return
        if emitted:  # late: the mark is out
            return
        for pdf in batches:
            if len(pdf):
                arrived = int(pdf["arrived"].max())
                first, last = arrived if first is None else first, arrived
                ended = ended or bool(pdf["ends"].any())
                last_ms = max(last_ms, int(pdf["ts"].max().value // 1_000_000))
        state.update((first, last, ended, False, last_ms))
        state.setTimeoutTimestamp(max(last_ms + (grace_ms if ended else read_timeout_ms), state.getCurrentWatermarkMs() + 1))
    return step


def assemble(lines: DataFrame, protocol: str, read_timeout_ms: int = 120_000, grace_ms: int = 5_000,
             marker_ms: int = 600_000, lateness: str = "10 minutes") -> DataFrame:
    """All lines as they come, and a mark for each request that is over.

    Rows without a request id only move the event time on (a heartbeat of the source)."""
    flags = marked(lines, protocol)
    # heartbeats are dropped in the groups: a filter would go below the watermark and take them from it
    marks = flags.mapInArrow(_combine, flags.schema).withWatermark("ts", lateness).groupBy("request_id").applyInPandasWithState(
        _over(read_timeout_ms, grace_ms, marker_ms), MARKS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    kept = lines.where("request_id IS NOT NULL").select(F.col("request_id").cast("string").alias("request_id"), "seq", "line",
                                                        F.lit(None).cast("boolean").alias("timed_out"), _arrived())
    return kept.unionByName(marks, allowMissingColumns=True)


def finished(held: DataFrame) -> DataFrame:
    """The lines (request_id, seq, line) of the requests that are over, without those that came too late."""
    marks = held.where("timed_out IS NOT NULL").select(F.col("request_id").alias("_id"), F.col("first_arrived").alias("_from"), F.col("last_arrived").alias("_to"))
    lines = held.where("timed_out IS NULL").select("request_id", "seq", "line", "arrived")
    return lines.join(marks, (F.col("request_id") == F.col("_id")) & F.col("arrived").between(F.col("_from"), F.col("_to")), "left_semi").drop("arrived")


def responses(held: DataFrame, protocol: str, key_type: str = "string") -> DataFrame:
    """The responses of the requests that are over, by the batch fold."""
    lines = finished(held).withColumn("request_id", F.col("request_id").cast(key_type))
    # dealt by the fold's slices: left as the join deals them, all lines of a hot request would stay in one task
    return CH.fold(lines.repartition("request_id", F.floor(F.col("seq") / F.lit(CH.BUCKET))), protocol)
