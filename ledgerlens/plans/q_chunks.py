"""Stream-fold queries over F5 (S9, C1-C3, W2, N10 on streams, P7-P10)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.classify import DEFAULT_ERROR
from ..operators import chunks as CH
from . import sql_chunks as SC
from .fixtures import chunk_lines
from .registry import query


@query("c1_fold", oracle=SC.chat_sql())
def c1_fold(spark, sf_dir):
    return CH.fold_chat(chunk_lines(spark, sf_dir, "chat"))


@query("c2_fold", bench=True, oracle=SC.responses_sql())
def c2_fold(spark, sf_dir):
    return CH.fold_responses(chunk_lines(spark, sf_dir, "responses"))


@query("c3_fold", oracle=SC.messages_sql())
def c3_fold(spark, sf_dir):
    return CH.fold_messages(chunk_lines(spark, sf_dir, "messages"))


@query("n10_stream_cache", oracle=SC.messages_cache_sql())
def n10_stream_cache(spark, sf_dir):
    lines = chunk_lines(spark, sf_dir, "messages")
    f = CH.ordered_fold(CH.parse_sse(lines), CH.messages_spec())
    return CH.cache_report(f)


@query("p7_failed_generations", oracle=f"""
SELECT request_id, coalesce(nullif(error, ''), {SC.q(DEFAULT_ERROR)}) AS error, finish_reason
FROM ({SC.responses_sql()}) WHERE error IS NOT NULL OR coalesce(finish_reason = 'error', false)""")
def p7_failed_generations(spark, sf_dir):
    from ..functions import classify as C
    r = CH.fold_responses(chunk_lines(spark, sf_dir, "responses"))
    return r.filter(C.generation_failed("error", "finish_reason")).select(
        "request_id", C.failure_message("error").alias("error"), "finish_reason")
