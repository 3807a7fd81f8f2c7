"""Response classification and retry policy as column expressions (P7-P13, T4 batch).

The reference decides these per call inside its client loop; here they are
columns over response and failure tables, so a whole run is classified in one
projection and retry planning is a query over recorded failures.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, non_empty

# ---------------------------------------------------------------- fixed values
DEFAULT_ERROR = "unknown_error: error response with empty message"
NO_OUTPUT = "empty_response_no_output_tokens: no visible text and zero output tokens"
REASONING_ONLY = "empty_response_reasoning_only: reasoning but no visible answer text"
NO_CONTENT = "empty_response_no_content: output tokens billed but no visible text"
STREAM_INCOMPLETE = "responses_stream_incomplete: stream ended without a terminal event"
STREAM_FAILED = "responses_stream_failed: "
STREAM_FAILED_DEFAULT = "provider reported failure"
RESPONSES_INCOMPLETE = "responses_incomplete: reason="
NON_RETRYABLE_STATUS = (400, 401, 403, 404, 422)
NON_RETRYABLE_KEYWORDS = ("invalid api key", "authentication failed", "invalid model",
                          "context length exceeded", "content policy violation", "invalid request")
PRESSURE_KEYWORDS = ("429", "rate limit", "too many requests", "peer closed", "incomplete message body",
                     "remoteprotocolerror", "readtimeout", "timeout")
JUDGE_BACKOFF = (5.0, 15.0, 45.0)
WALL_CLOCK_TIMEOUT = "wall_clock_timeout: attempt exceeded "
# ----------------------------------------------------------------------------


def generation_failed(error, finish_reason) -> Column:
    """A structural failure check (``error`` set at all, or finish reason ``error``)."""
    return col(error).isNotNull() | F.coalesce(col(finish_reason) == "error", F.lit(False))


def failure_message(error) -> Column:
    """The cached failure message is never empty."""
    return F.coalesce(F.nullif(col(error), F.lit("")), F.lit(DEFAULT_ERROR))


def classify_empty(text, output_tokens, reasoning_evidence, budget_exhausted, detail) -> Column:
    """The shared empty-response policy; null means scoreable."""
    d = F.concat(F.lit(" ("), col(detail), F.lit(")"))
    return (F.when(non_empty(text), F.lit(None).cast("string"))
            .when(col(output_tokens) <= 0, F.concat(F.lit(NO_OUTPUT), d))
            .when(F.coalesce(col(budget_exhausted), F.lit(False)), F.lit(None).cast("string"))
            .when(F.coalesce(col(reasoning_evidence), F.lit(False)), F.concat(F.lit(REASONING_ONLY), d))
            .otherwise(F.concat(F.lit(NO_CONTENT), d)))


def budget_exhausted(provider, finish_reason) -> Column:
    """The provider's own 'ran out of output budget' signal."""
    pv, fr = col(provider), col(finish_reason)
    return F.coalesce(
        F.when(pv == "chat_completion", fr == "length")
        .when(pv == "anthropic", fr == "max_tokens")
        .when(pv == "openai-responses", fr.startswith("incomplete"))
        .when(pv == "gemini", fr.contains("MAX_TOKENS")), F.lit(False))


def responses_status_error(status, incomplete_reason, failed_message, output_tokens,
                           text, reasoning_evidence) -> Column:
    """P10: terminal-status classifier of the responses stream (then P8)."""
    st = col(status)
    return (F.when(st.isNull(), F.lit(STREAM_INCOMPLETE))
            .when(st == "failed", F.concat(F.lit(STREAM_FAILED),
                                            F.coalesce(F.nullif(col(failed_message), F.lit("")),
                                                       F.lit(STREAM_FAILED_DEFAULT))))
            .when((st == "incomplete") & ~F.coalesce(col(incomplete_reason) == "max_output_tokens", F.lit(False)),
                  F.concat(F.lit(RESPONSES_INCOMPLETE), F.coalesce(F.nullif(col(incomplete_reason), F.lit("")),
                                                                   F.lit("unknown")),
                           F.lit(" (output_tokens="), col(output_tokens).cast("string"), F.lit(")")))
            .otherwise(classify_empty(text, output_tokens, reasoning_evidence, st == "incomplete",
                                      F.concat(F.lit("status="), st))))


def responses_finish_reason(status, incomplete_reason) -> Column:
    st = col(status)
    return F.when((st == "incomplete") & non_empty(incomplete_reason),
                  F.concat(F.lit("incomplete:"), col(incomplete_reason))).otherwise(st)


def _any_keyword(msg: Column, words) -> Column:
    low = F.lower(msg)
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return F.coalesce(out, F.lit(False))


def non_retryable(status_code, message) -> Column:
    """Client-side status codes or one of the fatal keywords."""
    return (F.coalesce(col(status_code).isin(*NON_RETRYABLE_STATUS), F.lit(False))
            | _any_keyword(col(message), NON_RETRYABLE_KEYWORDS))


def base_wait(message, attempt) -> Column:
    """P12 (deterministic part): throttling/broken streams back off 10·2^a up to 120 s,
    others 2^a up to 30 s (the uniform 0-1.5 s jitter is added separately)."""
    a = col(attempt).cast("double")
    pressure = _any_keyword(col(message), PRESSURE_KEYWORDS)
    return F.when(pressure, F.least(F.lit(10.0) * F.pow(F.lit(2.0), a), F.lit(120.0))) \
        .otherwise(F.least(F.pow(F.lit(2.0), a), F.lit(30.0)))


def jittered_wait(message, attempt, seed: int = 0) -> Column:
    """P12 with jitter: ``round(base + U(0, 1.5), 2)``."""
    return F.round(base_wait(message, attempt) + F.rand(seed) * F.lit(1.5), 2)


def retry_eligible(status_code, message, attempt, max_retries) -> Column:
    """Another attempt remains and the error is retryable."""
    return (col(attempt) < col(max_retries) - 1) & ~non_retryable(status_code, message)


def judge_backoff(attempt) -> Column:
    """P13 judge schedule: 5 / 15 / 45 s by attempt (last value repeats)."""
    idx = F.least(col(attempt) + 1, F.lit(len(JUDGE_BACKOFF)))
    return F.element_at(F.array(*[F.lit(x) for x in JUDGE_BACKOFF]), idx.cast("int"))


def deadline_error(latency, limit_s) -> Column:
    """T4 (batch): an attempt longer than the wall-clock limit is a retryable failure."""
    return F.when(col(limit_s).isNotNull() & (col(latency) > col(limit_s)),
                  F.concat(F.lit(WALL_CLOCK_TIMEOUT), col(limit_s).cast("string"), F.lit("s")))
