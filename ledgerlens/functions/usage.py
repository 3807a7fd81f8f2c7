"""Token-usage normalisation as pure column algebra (N1-N10, P5, P15, U4 default).

Provider usage payloads arrive as one JSON string per row.  They are parsed once
with :data:`USAGE_SCHEMA` (the union of every provider's field names) and every
rule below is a ``when``/``least``/``greatest`` expression over that struct, so a
whole table is normalised in one codegen'd projection.  Each normaliser returns a
struct with the public token-usage fields.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Union of the usage field names of the four provider payload shapes.
USAGE_SCHEMA = (
    "prompt_tokens BIGINT, completion_tokens BIGINT, total_tokens BIGINT, "
    "completion_tokens_details STRUCT<reasoning_tokens: BIGINT>, "
    "input_tokens BIGINT, output_tokens BIGINT, "
    "output_tokens_details STRUCT<reasoning_tokens: BIGINT, thinking_tokens: BIGINT>, "
    "prompt_token_count BIGINT, candidates_token_count BIGINT, total_token_count BIGINT, "
    "thoughts_token_count BIGINT, "
    "cache_creation_input_tokens BIGINT, cache_read_input_tokens BIGINT, "
    "cache_creation STRUCT<ephemeral_5m_input_tokens: BIGINT, ephemeral_1h_input_tokens: BIGINT>"
)

# Provider names of the four built-in request/usage shapes.
CHAT, RESPONSES, MESSAGES, GENERATE = "chat_completion", "openai-responses", "anthropic", "gemini"

# Fixed value: multiplier of the character-based token estimate for unknown tokenizers.
TOKEN_ESTIMATE_MULTIPLIER = 1.7

USAGE_FIELDS = ("prompt_tokens", "answer_tokens", "reasoning_tokens", "output_tokens", "total_tokens",
                "answer_tokens_estimated", "unattributed_tokens")


def parse_usage(c) -> Column:
    return F.from_json(col(c), USAGE_SCHEMA)


def _z(c) -> Column:
    """``x or 0`` for an optional count."""
    return F.coalesce(c, F.lit(0).cast("bigint"))


def _nz(c) -> Column:
    """null when falsy (missing or zero), so ``coalesce`` walks a fallback chain."""
    return F.nullif(c, F.lit(0).cast("bigint"))


def estimate_tokens(text) -> Column:
    """P5 default estimator: ``int(len(text) // 4 * 1.7)`` (code points, truncated)."""
    n = F.coalesce(F.length(col(text)), F.lit(0))
    return (F.floor(n / F.lit(4)) * F.lit(TOKEN_ESTIMATE_MULTIPLIER)).cast("bigint")


def default_token_count(text) -> Column:
    """U4 default: ``(estimate, estimated=True)``; a tokenizer UDF can replace it."""
    return F.struct(estimate_tokens(text).alias("n"), F.lit(True).alias("estimated"))


def visible_tokens(text) -> Column:
    """0 for empty text, else ``max(1, ceil(len / 4))``."""
    n = F.coalesce(F.length(col(text)), F.lit(0))
    return F.when(n == 0, F.lit(0).cast("bigint")).otherwise(
        F.greatest(F.lit(1).cast("bigint"), F.ceil(n / F.lit(4.0)).cast("bigint")))


def fold_total_gap(prompt, output, reasoning, total) -> Column:
    """A positive ``total - prompt - output`` is hidden output (reasoning)."""
    gap = total - prompt - output
    pos = gap > 0
    return F.struct(
        F.when(pos, output + gap).otherwise(output).alias("output_tokens"),
        F.when(pos, reasoning + gap).otherwise(reasoning).alias("reasoning_tokens"),
        F.when(pos, gap).otherwise(F.lit(0).cast("bigint")).alias("unattributed_tokens"))


def repair_output_split(output, reasoning, text) -> Column:
    """Keep the provider split when reasoning fits, else estimate the answer share."""
    o = F.greatest(_z(output), F.lit(0).cast("bigint"))
    r = F.greatest(_z(reasoning), F.lit(0).cast("bigint"))
    fits = r <= o
    est_answer = F.least(visible_tokens(text), o)
    answer = F.when(fits, o - r).otherwise(est_answer)
    return F.struct(
        answer.alias("answer_tokens"),
        F.when(fits, r).otherwise(o - est_answer).alias("reasoning_tokens"),
        (~fits).alias("answer_tokens_estimated"))


def _usage(prompt, answer, reasoning, output, total, estimated, unattributed) -> Column:
    return F.struct(prompt.alias("prompt_tokens"), answer.alias("answer_tokens"),
                    reasoning.alias("reasoning_tokens"), output.alias("output_tokens"),
                    total.alias("total_tokens"), estimated.alias("answer_tokens_estimated"),
                    unattributed.alias("unattributed_tokens"))


def _split_usage(prompt, completion, total, reasoning, text) -> Column:
    folded = fold_total_gap(prompt, completion, reasoning, total)
    rep = repair_output_split(folded["output_tokens"], folded["reasoning_tokens"], text)
    return _usage(prompt, rep["answer_tokens"], rep["reasoning_tokens"], folded["output_tokens"], total,
                  rep["answer_tokens_estimated"], folded["unattributed_tokens"])


def chat_usage(u, text) -> Column:
    """Chat-completions usage (prompt/completion/total + completion details)."""
    u = col(u)
    return _split_usage(_z(u["prompt_tokens"]), _z(u["completion_tokens"]), _z(u["total_tokens"]),
                        _z(u["completion_tokens_details"]["reasoning_tokens"]), text)


def responses_usage(u, text) -> Column:
    """Responses-API usage (input/output/total + output details); null → zeros."""
    u = col(u)
    return _split_usage(_z(u["input_tokens"]), _z(u["output_tokens"]), _z(u["total_tokens"]),
                        _z(u["output_tokens_details"]["reasoning_tokens"]), text)


def generate_usage(u) -> Column:
    """Generate-content usage metadata with its fallback chains; no split repair."""
    u = col(u)
    zero = F.lit(0).cast("bigint")
    prompt = F.coalesce(_nz(u["prompt_token_count"]), _nz(u["prompt_tokens"]), _nz(u["input_tokens"]), zero)
    answer = F.coalesce(_nz(u["candidates_token_count"]), _nz(u["completion_tokens"]), _nz(u["output_tokens"]), zero)
    reasoning = _z(u["thoughts_token_count"])
    reported = F.coalesce(_nz(u["total_token_count"]), _nz(u["total_tokens"]), zero)
    total = F.when(reported == 0, prompt + answer + reasoning).otherwise(reported)
    folded = fold_total_gap(prompt, reasoning + answer, reasoning, total)
    return _usage(prompt, answer, folded["reasoning_tokens"], folded["output_tokens"], total,
                  F.lit(False), folded["unattributed_tokens"])


def messages_usage(prompt, output, thinking, text, counted=None) -> Column:
    """Messages-API usage.  An exact thinking count that fits is taken verbatim;
    otherwise the answer is the counted visible text (``counted`` = struct<n, estimated>,
    default U4) clamped to output; empty text counts 0.  Total = prompt + output."""
    p, o = _z(col(prompt)), _z(col(output))
    th = col(thinking)
    counted = default_token_count(text) if counted is None else counted
    exact = th.isNotNull() & (th >= 0) & (th <= o)
    has_text = F.coalesce(F.length(col(text)) > 0, F.lit(False))
    answer = (F.when(exact, o - th).when(has_text, F.least(counted["n"], o))
              .otherwise(F.lit(0).cast("bigint")))
    estimated = F.when(exact, F.lit(False)).when(has_text, counted["estimated"]).otherwise(F.lit(False))
    reasoning = F.greatest(o - answer, F.lit(0).cast("bigint"))
    return _usage(p, answer, reasoning, o, p + o, estimated, F.lit(0).cast("bigint"))


def fill_usage(u) -> Column:
    """N8 + P15: project the public fields; zero output/total are filled."""
    u = col(u)
    out = F.when(u["output_tokens"] == 0, u["reasoning_tokens"] + u["answer_tokens"]).otherwise(u["output_tokens"])
    total = F.when(u["total_tokens"] == 0, u["prompt_tokens"] + u["answer_tokens"] + u["reasoning_tokens"]) \
        .otherwise(u["total_tokens"])
    return _usage(u["prompt_tokens"], u["answer_tokens"], u["reasoning_tokens"], out, total,
                  u["answer_tokens_estimated"], u["unattributed_tokens"])


def normalize_usage(provider, usage, text, counted=None) -> Column:
    """One normaliser per provider in a single pass, then N8.

    ``usage`` is the parsed struct (see :func:`parse_usage`).  Messages-API rows
    read prompt/output/thinking from the same struct.
    """
    u = col(usage)
    pv = col(provider)
    msg = messages_usage(u["input_tokens"], u["output_tokens"], u["output_tokens_details"]["thinking_tokens"],
                         text, counted)
    raw = (F.when(pv == CHAT, chat_usage(u, text))
           .when(pv == RESPONSES, responses_usage(u, text))
           .when(pv == GENERATE, generate_usage(u))
           .when(pv == MESSAGES, msg))
    return fill_usage(raw)


def cache_metrics(u) -> Column:
    """Prompt-cache diagnostics of a messages-API payload (never part of totals)."""
    u = col(u)
    return F.struct(
        _z(u["cache_creation_input_tokens"]).alias("cache_creation_tokens"),
        _z(u["cache_read_input_tokens"]).alias("cache_read_tokens"),
        _z(u["cache_creation"]["ephemeral_5m_input_tokens"]).alias("cache_ephemeral_5m"),
        _z(u["cache_creation"]["ephemeral_1h_input_tokens"]).alias("cache_ephemeral_1h"))


def normalize_usage_frame(df, provider: str = "provider", usage: str = "u", text: str = "final_text",
                          counter=None, out: str = "tokens"):
    """N9 as staged projections: the same rules as :func:`normalize_usage`, but every
    intermediate is its own column, so Catalyst keeps each stage as one projection
    instead of inlining (and multiplying) the sub-expressions.  Adds struct ``out``.

    ``counter`` (U4) gets a text only where the messages rules need a count; for other rows
    it sees null.  Providers registered beside the built-in ones use their own normaliser."""
    from ..registry import providers
    u, pv = F.col(usage), F.col(provider)
    split, gen, msg = pv.isin(CHAT, RESPONSES), pv == GENERATE, pv == MESSAGES
    zero = F.lit(0).cast("bigint")
    thinking, visible = u["output_tokens_details"]["thinking_tokens"], _z(u["output_tokens"])
    exact = F.coalesce((thinking >= 0) & (thinking <= visible), F.lit(False))
    counted = (counter or default_token_count)(F.when(msg & ~exact & (F.length(text) > 0), F.col(text)))
    s = df.withColumns({
        "_p": (F.when(pv == CHAT, _z(u["prompt_tokens"]))
               .when(gen, F.coalesce(_nz(u["prompt_token_count"]), _nz(u["prompt_tokens"]), _nz(u["input_tokens"]), zero))
               .otherwise(_z(u["input_tokens"]))),
        "_c": (F.when(pv == CHAT, _z(u["completion_tokens"]))
               .when(gen, F.coalesce(_nz(u["candidates_token_count"]), _nz(u["completion_tokens"]),
                                     _nz(u["output_tokens"]), zero))
               .otherwise(_z(u["output_tokens"]))),
        "_t": (F.when(gen, F.coalesce(_nz(u["total_token_count"]), _nz(u["total_tokens"]), zero))
               .otherwise(_z(u["total_tokens"]))),
        "_r": (F.when(pv == CHAT, _z(u["completion_tokens_details"]["reasoning_tokens"]))
               .when(pv == RESPONSES, _z(u["output_tokens_details"]["reasoning_tokens"]))
               .when(gen, _z(u["thoughts_token_count"])).otherwise(zero)),
        "_th": u["output_tokens_details"]["thinking_tokens"],
        "_vis": visible_tokens(text),
        "_cnt": counted,
    })
    s = s.withColumns({
        "_t2": F.when(gen & (F.col("_t") == 0), F.col("_p") + F.col("_c") + F.col("_r"))
                .when(msg, F.col("_p") + F.col("_c")).otherwise(F.col("_t")),
        "_o0": F.when(gen, F.col("_r") + F.col("_c")).otherwise(F.col("_c")),
    })
    s = s.withColumn("_gap", F.when(msg, zero).otherwise(
        F.greatest(F.col("_t2") - F.col("_p") - F.col("_o0"), zero)))
    s = s.withColumns({"_o": F.col("_o0") + F.col("_gap"), "_r1": F.col("_r") + F.col("_gap")})
    s = s.withColumns({"_oo": F.greatest(F.col("_o"), zero), "_rr": F.greatest(F.col("_r1"), zero),
                       "_exact": F.col("_th").isNotNull() & (F.col("_th") >= 0) & (F.col("_th") <= F.col("_c")),
                       "_has_text": F.coalesce(F.length(text) > 0, F.lit(False))})
    s = s.withColumns({"_fits": F.col("_rr") <= F.col("_oo"), "_est_ans": F.least(F.col("_vis"), F.col("_oo"))})
    ans = (F.when(split, F.when(F.col("_fits"), F.col("_oo") - F.col("_rr")).otherwise(F.col("_est_ans")))
           .when(gen, F.col("_c"))
           .otherwise(F.when(F.col("_exact"), F.col("_c") - F.col("_th"))
                      .when(F.col("_has_text"), F.least(F.col("_cnt")["n"], F.col("_c"))).otherwise(zero)))
    est = (F.when(split, ~F.col("_fits")).when(gen, F.lit(False))
           .otherwise(F.when(F.col("_exact"), F.lit(False)).when(F.col("_has_text"), F.col("_cnt")["estimated"])
                      .otherwise(F.lit(False))))
    s = s.withColumns({"_ans": ans, "_est": est})
    rea = (F.when(split, F.when(F.col("_fits"), F.col("_rr")).otherwise(F.col("_oo") - F.col("_est_ans")))
           .when(gen, F.col("_r1")).otherwise(F.greatest(F.col("_c") - F.col("_ans"), zero)))
    s = s.withColumn("_rea", rea)
    output = F.when(F.col("_o") == 0, F.col("_rea") + F.col("_ans")).otherwise(F.col("_o"))
    total = F.when(F.col("_t2") == 0, F.col("_p") + F.col("_ans") + F.col("_rea")).otherwise(F.col("_t2"))
    s = s.withColumn(out, _usage(F.col("_p"), F.col("_ans"), F.col("_rea"), output, total, F.col("_est"),
                                 F.when(msg, zero).otherwise(F.col("_gap"))))
    for p in providers():
        if p.name not in (CHAT, RESPONSES, GENERATE, MESSAGES):
            s = s.withColumn(out, F.when(pv == p.name, fill_usage(p.normalize_usage(u, text))).otherwise(F.col(out)))
    return s.drop("_p", "_c", "_t", "_r", "_th", "_vis", "_cnt", "_t2", "_o0", "_gap", "_o", "_r1", "_oo", "_rr",
                  "_exact", "_has_text", "_fits", "_est_ans", "_ans", "_est", "_rea")


def split_usage_frame(df, prompt: Column, completion: Column, total: Column, reasoning: Column,
                      text: str, out: str = "tokens", filled: bool = True):
    """N2 + N3 (+ N8 fill) as staged projections for chat / responses payloads."""
    zero = F.lit(0).cast("bigint")
    s = df.withColumns({"_p": _z(prompt), "_c": _z(completion), "_t": _z(total), "_r": _z(reasoning),
                        "_vis": visible_tokens(text)})
    s = s.withColumn("_gap", F.greatest(F.col("_t") - F.col("_p") - F.col("_c"), zero))
    s = s.withColumns({"_o": F.col("_c") + F.col("_gap"), "_r1": F.col("_r") + F.col("_gap")})
    s = s.withColumns({"_oo": F.greatest(F.col("_o"), zero), "_rr": F.greatest(F.col("_r1"), zero)})
    s = s.withColumns({"_fits": F.col("_rr") <= F.col("_oo"), "_est_ans": F.least(F.col("_vis"), F.col("_oo"))})
    s = s.withColumns({
        "_ans": F.when(F.col("_fits"), F.col("_oo") - F.col("_rr")).otherwise(F.col("_est_ans")),
        "_rea": F.when(F.col("_fits"), F.col("_rr")).otherwise(F.col("_oo") - F.col("_est_ans"))})
    output, total_c = F.col("_o"), F.col("_t")
    if filled:
        output = F.when(F.col("_o") == 0, F.col("_rea") + F.col("_ans")).otherwise(F.col("_o"))
        total_c = F.when(F.col("_t") == 0, F.col("_p") + F.col("_ans") + F.col("_rea")).otherwise(F.col("_t"))
    s = s.withColumn(out, _usage(F.col("_p"), F.col("_ans"), F.col("_rea"), output, total_c,
                                 ~F.col("_fits"), F.col("_gap")))
    return s.drop("_p", "_c", "_t", "_r", "_vis", "_gap", "_o", "_r1", "_oo", "_rr", "_fits", "_est_ans",
                  "_ans", "_rea")
