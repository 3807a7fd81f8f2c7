"""Response assembly from stream lines (S9, C1-C3, W2, P7-P10 applied).

Input: ``(request_id, seq, line)`` — server-sent-event lines in append order.
``parse_sse`` keeps ``data: `` payloads (``[DONE]`` flagged, undecodable JSON
ignored) as VARIANT.  :func:`ordered_fold` then reduces each request in two levels
so that no task ever buffers a whole hot request:

* level 1 groups ``(request_id, seq div BUCKET)`` slices (bounded size): the end
  position inside the slice comes from a window over the slice, the slice's text
  piece is an ordered ``listagg``, and every "last present value" is a
  ``max_by(value, seq)`` restricted to rows before the end;
* level 2 groups the slices of a request: the first slice holding an end marker
  bounds the request, pieces are concatenated in slice order and the per-slice
  "last present" values are reduced with ``max_by`` again.

Both levels shuffle on their grouping key only; nothing is collected per request
except the text, which *is* the result.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import usage as U
from ..functions.text import non_empty, strip_ws

# Width of the seq range folded by one level-1 group.
BUCKET = 1 << 12
# Model reported when the stream never names one (the run's configured model).
DEFAULT_MODEL = "m-default"


def parse_sse(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Every line kept (so empty requests still produce a response); ``ev`` is the
    parsed payload of a ``data: `` line, null for other lines and undecodable JSON."""
    ln = strip_ws(F.col(line_col))
    is_data = ln.startswith("data: ")
    payload = F.regexp_replace(ln, "^data: ", "")
    done = is_data & (payload == "[DONE]")
    ev = F.when(is_data & ~done, F.try_parse_json(payload))
    return lines.withColumns({"is_done": F.coalesce(done, F.lit(False)), "ev": ev}).drop(line_col)


def vget(path: str, typ: str = "string") -> Column:
    return F.try_variant_get(F.col("ev"), path, typ)


def vtype(path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(F.col("ev"), path, "variant"))


@dataclass
class FoldSpec:
    text: Column | None = None                       # delta text (null = none)
    end: Column = field(default_factory=lambda: F.lit(False))  # row ends the stream (kept)
    last: dict = field(default_factory=dict)         # name -> (value, present)
    sums: dict = field(default_factory=dict)         # name -> value
    at_end: dict = field(default_factory=dict)       # name -> value read from the end row


def ordered_fold(df: DataFrame, spec: FoldSpec, key: str = "request_id", order: str = "seq",
                 bucket: int = BUCKET) -> DataFrame:
    """Two-level ordered fold; see the module docstring."""
    # narrow, typed columns first: the parsed payload doesn't go through the shuffle
    cols = {"_b": F.floor(F.col(order) / F.lit(bucket)), "_end_row": F.coalesce(spec.end, F.lit(False)),
            "_text": spec.text if spec.text is not None else F.lit(None).cast("string")}
    for n, (v, present) in spec.last.items():
        cols |= {f"{n}__x": v, f"{n}__p": F.coalesce(present, F.lit(False))}
    cols |= {f"{n}__x": v for n, v in spec.sums.items()} | {f"{n}__e": v for n, v in spec.at_end.items()}
    base = df.select(key, order, *[v.alias(n) for n, v in cols.items()])
    w1 = Window.partitionBy(key, "_b")
    base = base.withColumn("_bend", F.min(F.when(F.col("_end_row"), F.col(order))).over(w1))
    keep = F.col("_bend").isNull() | (F.col(order) <= F.col("_bend"))
    kept = {"_t": F.when(keep, F.col("_text"))}
    kept |= {f"{n}__o": F.when(keep & F.col(f"{n}__p"), F.col(order)) for n in spec.last}
    kept |= {f"{n}__x": F.when(keep, F.col(f"{n}__x")) for n in spec.sums}
    kept |= {f"{n}__e": F.when(F.col(order) == F.col("_bend"), F.col(f"{n}__e")) for n in spec.at_end}
    base = base.withColumns(kept)

    lvl1 = [F.expr(f"listagg(_t, '') WITHIN GROUP (ORDER BY {order})").alias("_piece"),
            F.min("_bend").alias("_end")]
    for n in spec.last:
        lvl1 += [F.max(f"{n}__o").alias(f"{n}__s"), F.max_by(f"{n}__x", f"{n}__o").alias(f"{n}__v")]
    for n in spec.sums:
        lvl1.append(F.sum(f"{n}__x").alias(f"{n}__m"))
    for n in spec.at_end:
        lvl1.append(F.max(f"{n}__e").alias(f"{n}__e"))
    slices = base.groupBy(key, "_b").agg(*lvl1)

    w2 = Window.partitionBy(key)
    slices = slices.withColumn("_eb", F.min(F.when(F.col("_end").isNotNull(), F.col("_b"))).over(w2))
    keep2 = F.col("_eb").isNull() | (F.col("_b") <= F.col("_eb"))
    slices = slices.withColumn("_p", F.when(keep2, F.col("_piece")))
    lvl2 = [F.coalesce(F.expr("listagg(_p, '') WITHIN GROUP (ORDER BY _b)"), F.lit("")).alias("text"),
            F.min("_end").alias("end_seq")]
    for n in spec.last:
        lvl2.append(F.max_by(f"{n}__v", F.when(keep2, F.col(f"{n}__s"))).alias(n))
    for n in spec.sums:
        lvl2.append(F.coalesce(F.sum(F.when(keep2, F.col(f"{n}__m"))), F.lit(0)).alias(n))
    for n in spec.at_end:
        lvl2.append(F.max_by(f"{n}__e", F.when(F.col("_b") == F.col("_eb"), F.col("_b"))).alias(n))
    return slices.groupBy(key).agg(*lvl2)


# ---------------------------------------------------------------- C1: chat chunks
def chat_spec() -> FoldSpec:
    content = vget("$.choices[0].delta.content")
    model = vget("$.model")
    finish = vget("$.choices[0].finish_reason")
    has_usage = F.coalesce(vtype("$.usage").startswith("OBJECT"), F.lit(False))
    last = {"model": (model, non_empty(model)), "finish_reason": (finish, non_empty(finish))}
    for n, p in (("u_prompt", "$.usage.prompt_tokens"), ("u_completion", "$.usage.completion_tokens"),
                 ("u_total", "$.usage.total_tokens"),
                 ("u_reasoning", "$.usage.completion_tokens_details.reasoning_tokens")):
        last[n] = (vget(p, "bigint"), has_usage)
    last["has_usage"] = (has_usage, has_usage)
    return FoldSpec(text=F.when(non_empty(content), content), end=F.col("is_done"), last=last,
                    sums={"reasoning_chars": F.coalesce(F.length(vget("$.choices[0].delta.reasoning_content")),
                                                        F.lit(0))})


def fold_chat(lines: DataFrame) -> DataFrame:
    """Chat-completions chunks → one response per request (N4 usage, P8 policy)."""
    f = ordered_fold(parse_sse(lines), chat_spec())
    has = F.coalesce(F.col("has_usage"), F.lit(False))
    zero = F.lit(0).cast("bigint")
    f = U.split_usage_frame(f, F.when(has, F.col("u_prompt")).otherwise(zero),
                            F.when(has, F.col("u_completion")).otherwise(zero),
                            F.when(has, F.col("u_total")).otherwise(zero),
                            F.when(has, F.col("u_reasoning")).otherwise(zero), "text", out="tok")
    err = C.classify_empty("text", F.col("tok.output_tokens"),
                           (F.col("tok.reasoning_tokens") > 0) | (F.col("reasoning_chars") > 0),
                           F.col("finish_reason") == "length",
                           F.concat(F.lit("finish_reason="), F.coalesce(F.col("finish_reason"), F.lit("unknown"))))
    return _response(f, F.coalesce(F.col("model"), F.lit(DEFAULT_MODEL)), F.col("finish_reason"), err)


# ---------------------------------------------------------------- C2: responses events
TERMINAL_EVENTS = ("response.completed", "response.incomplete", "response.failed")


def responses_spec() -> FoldSpec:
    t = vget("$.type")
    terminal = F.coalesce(t.isin(*TERMINAL_EVENTS), F.lit(False))
    delta = vget("$.delta")
    err_obj = F.coalesce(vtype("$.response.error").startswith("OBJECT"), F.lit(False))
    err_msg = F.when(err_obj, vget("$.response.error.message")).otherwise(
        F.nullif(vget("$.response.error"), F.lit("")))
    at_end = {
        "t_type": t, "t_model": vget("$.response.model"), "t_status": vget("$.response.status"),
        "t_reason": vget("$.response.incomplete_details.reason"), "t_error": err_msg,
        "u_input": vget("$.response.usage.input_tokens", "bigint"),
        "u_output": vget("$.response.usage.output_tokens", "bigint"),
        "u_total": vget("$.response.usage.total_tokens", "bigint"),
        "u_reasoning": vget("$.response.usage.output_tokens_details.reasoning_tokens", "bigint"),
    }
    return FoldSpec(text=F.when(t == "response.output_text.delta", F.coalesce(delta, F.lit(""))),
                    end=F.col("is_done") | terminal, at_end=at_end,
                    sums={"reasoning_chars": F.when(t == "response.reasoning_text.delta",
                                                    F.coalesce(F.length(delta), F.lit(0))).otherwise(F.lit(0))})


def fold_responses(lines: DataFrame) -> DataFrame:
    """C2 + W2 + P10: events up to the first terminal event or ``[DONE]``."""
    f = ordered_fold(parse_sse(lines), responses_spec())
    status = F.when(F.col("t_type").isin(*TERMINAL_EVENTS),
                    F.coalesce(F.nullif(F.col("t_status"), F.lit("")),
                               F.regexp_replace(F.col("t_type"), r"^response\.", "")))
    f = f.withColumn("status", status)
    f = U.split_usage_frame(f, F.col("u_input"), F.col("u_output"), F.col("u_total"), F.col("u_reasoning"),
                            "text", out="tok")
    err = C.responses_status_error("status", "t_reason", "t_error", F.col("tok.output_tokens"), "text",
                                   (F.col("tok.reasoning_tokens") > 0) | (F.col("reasoning_chars") > 0))
    model = F.when(F.col("status").isNotNull(), F.coalesce(F.col("t_model"), F.lit(DEFAULT_MODEL))) \
        .otherwise(F.lit(DEFAULT_MODEL))
    return _response(f, model, C.responses_finish_reason("status", "t_reason"), err)


# ---------------------------------------------------------------- C3: messages events
def messages_spec() -> FoldSpec:
    t = vget("$.type")
    start = F.coalesce(t == "message_start", F.lit(False))
    mdelta = F.coalesce(t == "message_delta", F.lit(False))
    text = F.when((t == "content_block_delta") & (vget("$.delta.type") == "text_delta"),
                  F.coalesce(vget("$.delta.text"), F.lit("")))

    def z(p):
        return F.coalesce(vget(p, "bigint"), F.lit(0).cast("bigint"))

    cc_delta = vget("$.usage.cache_creation_input_tokens", "bigint")
    cr_delta = vget("$.usage.cache_read_input_tokens", "bigint")
    last = {
        "input_tokens": (z("$.message.usage.input_tokens"), start),
        "model": (F.coalesce(vget("$.message.model"), F.lit(DEFAULT_MODEL)), start),
        "cache_creation": (F.when(start, z("$.message.usage.cache_creation_input_tokens")).otherwise(cc_delta),
                           start | (mdelta & F.coalesce(cc_delta != 0, F.lit(False)))),
        "cache_read": (F.when(start, z("$.message.usage.cache_read_input_tokens")).otherwise(cr_delta),
                       start | (mdelta & F.coalesce(cr_delta != 0, F.lit(False)))),
        "cache_5m": (z("$.message.usage.cache_creation.ephemeral_5m_input_tokens"), start),
        "cache_1h": (z("$.message.usage.cache_creation.ephemeral_1h_input_tokens"), start),
        "output_tokens": (vget("$.usage.output_tokens", "bigint"),
                          mdelta & vget("$.usage.output_tokens", "bigint").isNotNull()),
        "thinking_tokens": (vget("$.usage.output_tokens_details.thinking_tokens", "bigint"),
                            mdelta & vget("$.usage.output_tokens_details.thinking_tokens", "bigint").isNotNull()),
        "stop_reason": (vget("$.delta.stop_reason"),
                        mdelta & F.try_variant_get(F.col("ev"), "$.delta.stop_reason", "variant").isNotNull()),
    }
    # ``[DONE]`` only interrupts the current read buffer in this protocol; later lines are
    # still processed, so it is not an end marker here.
    return FoldSpec(text=text, last=last)


def fold_messages(lines: DataFrame, counted=None) -> DataFrame:
    """C3 + N7 + P8: last present value per field, text deltas concatenated."""
    f = ordered_fold(parse_sse(lines), messages_spec())
    out = F.coalesce(F.col("output_tokens"), F.lit(0).cast("bigint"))
    f = f.withColumn("tok", U.fill_usage(U.messages_usage(
        F.coalesce(F.col("input_tokens"), F.lit(0).cast("bigint")), out, F.col("thinking_tokens"), "text", counted)))
    detail = F.concat(F.lit("stop_reason="), F.coalesce(F.col("stop_reason"), F.lit("None")),
                      F.lit(", output_tokens="), out.cast("string"))
    err = C.classify_empty("text", out, F.col("tok.reasoning_tokens") > 0,
                           F.col("stop_reason") == "max_tokens", detail)
    return _response(f, F.coalesce(F.col("model"), F.lit(DEFAULT_MODEL)), F.col("stop_reason"), err)


def cache_report(folded: DataFrame) -> DataFrame:
    """N10 on streams: requests whose prompt cache was written or read."""
    return folded.filter((F.col("cache_creation") > 0) | (F.col("cache_read") > 0)).select(
        "request_id", "cache_creation", "cache_read", "cache_5m", "cache_1h")


def _response(f: DataFrame, model: Column, finish: Column, error: Column) -> DataFrame:
    return f.select("request_id", "text", model.alias("model"), finish.alias("finish_reason"),
                    *[F.col(f"tok.{c}").alias(c) for c in U.USAGE_FIELDS], error.alias("error"))


def fold(lines: DataFrame, protocol: str) -> DataFrame:
    return {"chat": fold_chat, "responses": fold_responses, "messages": fold_messages}[protocol](lines)


def pick_text(text, parts, candidate_text) -> Column:
    """C4: ``text``, else non-empty candidate parts joined by a space, else the candidate's
    text, else empty."""
    joined = F.nullif(F.array_join(F.filter(parts, lambda p: non_empty(p)), " "), F.lit(""))
    return F.coalesce(F.nullif(F.col(text) if isinstance(text, str) else text, F.lit("")), joined,
                      F.nullif(F.col(candidate_text) if isinstance(candidate_text, str) else candidate_text,
                               F.lit("")), F.lit(""))
