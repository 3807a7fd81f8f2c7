"""Structured Streaming queries (T1-T3, T5) driven to completion with ``availableNow``.

Each query stages data Spark derives from the driver tables as files in two arrivals, runs
the stream to the end of what is there after each (so it also resumes from its checkpoint, and state carries
over), and returns the sink's contents as a batch DataFrame.
"""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import checkpoint_path
from ..streaming import completion as K
from ..streaming import ledger_stream as LS
from . import fixture_sql as Q
from . import sql_chunks as SC
from .fixtures import attempts, chunk_lines
from .q_sources import ALIKE_SQL, _summary, alike_runs
from .registry import query

#: Files of an arrival, and of a trigger.
FILES = 8

def _arrivals(df, late):
    """The rows in two arrivals: those that aren't late, then the late ones."""
    return [df.where(~late), df.where(late)]


def _drive(arrivals, src: str, start) -> None:
    """Write each arrival as files, in no order, and run the stream until it has read them."""
    for rows in arrivals:
        rows.write.mode("append").json(src)
        start().awaitTermination()


def _workdir(spark, name: str) -> str:
    return checkpoint_path(spark, f"streams/{name}-{uuid.uuid4().hex[:12]}")


def _complete(spark, sf_dir, protocol, arrivals, **options):
    """Run the lines of ``arrivals`` through the stream, one arrival a trigger, until each request has its response."""
    work = _workdir(spark, f"t1-{protocol}")
    lines = chunk_lines(spark, sf_dir, protocol)
    for rows in arrivals(lines):  # there before the stream starts, so that triggers follow each other
        rows.repartition(FILES).write.mode("append").json(f"{work}/src")
    src = spark.readStream.schema("request_id BIGINT, seq BIGINT, line STRING, ts TIMESTAMP").option("maxFilesPerTrigger", FILES).json(f"{work}/src")
    query, store = K.start(src, f"{work}/out", f"{work}/ckpt", protocol, **options)
    K.run_until(query, store, lines.select("request_id").distinct().count())
    return K.responses(spark, f"{work}/out", "bigint")


def _stream_fold(spark, sf_dir, protocol):
    """T1 + T5: lines arrive in an order that has nothing to do with theirs, half of each request in a
    second arrival; requests end by their marker or by silence."""
    rows = _complete(spark, sf_dir, protocol, lambda lines: _arrivals(lines, F.xxhash64("seq") % 2 == 0), read_timeout_ms=4_000, grace_ms=1_000)
    return rows.drop("kind", "retryable")


@query("t1_stream_fold", oracle=SC.responses_sql())
def t1_stream_fold(spark, sf_dir):
    """Every request of the responses protocol, ended or timed out, equals the batch fold."""
    return _stream_fold(spark, sf_dir, "responses")


@query("t1_stream_chat", oracle=SC.chat_sql())
def t1_stream_chat(spark, sf_dir):
    """T1 for the chat protocol."""
    return _stream_fold(spark, sf_dir, "chat")


@query("t1_stream_messages", oracle=SC.messages_sql())
def t1_stream_messages(spark, sf_dir):
    """T1 for the messages protocol, which has no end marker: requests are over when silent."""
    return _stream_fold(spark, sf_dir, "messages")


_T4_SQL = f"""WITH r AS ({SC.chat_sql()}),
d AS ({Q.with_ctes(SC.chunk_lines_sql("chat"))} SELECT request_id, bool_or(line = 'data: [DONE]') AS done FROM chunk_lines GROUP BY request_id)
SELECT request_id, CASE WHEN done THEN 'ended' ELSE 'limit' END AS kind, CASE WHEN done THEN text ELSE '' END AS text, CASE WHEN done THEN total_tokens ELSE 0 END AS total_tokens,
  CASE WHEN done THEN error ELSE 'wall_clock_timeout: attempt exceeded 5s' END AS error, coalesce(NOT done, false) AS timed_out FROM r JOIN d USING (request_id)"""


@query("t4_stream_deadline", oracle=_T4_SQL)
def t4_stream_deadline(spark, sf_dir):
    """T4 in the stream: requests without an end marker exceed their attempt limit, a retryable failure each, while others arrive and end.
    A request's lines are in one arrival, so that the outcome doesn't hang on the machine's speed."""
    rows = _complete(spark, sf_dir, "chat", lambda lines: _arrivals(lines, F.col("request_id") % 3 == 0), read_timeout_ms=600_000, grace_ms=1_000, limit_ms=5_000)
    return rows.select("request_id", "kind", "text", "total_tokens", "error", (F.col("retryable") & (F.col("kind") == K.LIMIT)).alias("timed_out"))


_A5_SQL = Q.with_ctes(Q.ATTEMPTS, Q.FIXED, Q.LATEST) + f"SELECT run_id, {Q.SUMMARY_SELECT} FROM latest GROUP BY run_id"


@query("t2_ingest", oracle=f"SELECT * REPLACE ({ALIKE_SQL}) FROM ({_A5_SQL})")
def t2_ingest(spark, sf_dir):
    """Attempt files ingested incrementally into the Parquet ledger, then summarised."""
    from ..sources import ledger_io as LIO
    work = _workdir(spark, "t2")
    rows = alike_runs(attempts(spark, sf_dir))
    by_stream, appended = rows.where("seq % 5 <> 0"), rows.where("seq % 5 = 0")
    _drive(_arrivals(by_stream, F.col("seq") % 2 == 0), f"{work}/src", lambda: LS.ingest(spark, f"{work}/src", f"{work}/ledger", f"{work}/ckpt"))
    LIO.append_rows(appended, f"{work}/ledger")  # a batch append after the stream's: both are read
    return _summary(LIO.read_rows(spark, f"{work}/ledger"))


@query("t3_live_summary", bench=True, oracle=_A5_SQL)
def t3_live_summary(spark, sf_dir):
    """Latest attempt per problem as streaming state, summaries republished per trigger."""
    work = _workdir(spark, "t3")
    _drive(_arrivals(attempts(spark, sf_dir), F.col("seq") % 2 == 0), f"{work}/src",
           lambda: LS.live_summary(spark, f"{work}/src", f"{work}/summary", f"{work}/ckpt"))
    return LS.read_summary(spark, f"{work}/summary").drop("batch_id")
