"""DuckDB twins of the stream folds and the usage / classification rules they apply."""
from __future__ import annotations

from ..functions import classify as C
from ..operators.chunks import DEFAULT_MODEL, TERMINAL_EVENTS
from .fixture_sql import chunk_lines_sql, with_ctes
from .sql_extract import q, strip


def vis(text: str) -> str:
    return (f"(CASE WHEN coalesce(length({text}), 0) = 0 THEN 0 "
            f"ELSE greatest(1, CAST(ceil(length({text}) / 4.0) AS BIGINT)) END)")


def split_usage(p: str, c: str, t: str, r: str, text: str) -> dict[str, str]:
    gap = f"greatest({t} - {p} - {c}, 0)"
    o, r1 = f"({c} + {gap})", f"({r} + {gap})"
    oo, rr = f"greatest({o}, 0)", f"greatest({r1}, 0)"
    fits = f"({rr} <= {oo})"
    ans = f"(CASE WHEN {fits} THEN {oo} - {rr} ELSE least({vis(text)}, {oo}) END)"
    rea = f"(CASE WHEN {fits} THEN {rr} ELSE {oo} - least({vis(text)}, {oo}) END)"
    return fill({"prompt_tokens": p, "answer_tokens": ans, "reasoning_tokens": rea, "output_tokens": o,
                 "total_tokens": t, "answer_tokens_estimated": f"(NOT {fits})", "unattributed_tokens": gap})


def messages_usage(p: str, o: str, th: str, text: str) -> dict[str, str]:
    exact = f"({th} IS NOT NULL AND {th} >= 0 AND {th} <= {o})"
    has_text = f"coalesce(length({text}) > 0, false)"
    counted = f"CAST(floor(floor(coalesce(length({text}), 0) / 4) * 1.7::DOUBLE) AS BIGINT)"
    ans = f"(CASE WHEN {exact} THEN {o} - {th} WHEN {has_text} THEN least({counted}, {o}) ELSE 0 END)"
    est = f"(CASE WHEN {exact} THEN false WHEN {has_text} THEN true ELSE false END)"
    return fill({"prompt_tokens": p, "answer_tokens": ans, "reasoning_tokens": f"greatest({o} - {ans}, 0)",
                 "output_tokens": o, "total_tokens": f"({p} + {o})", "answer_tokens_estimated": est,
                 "unattributed_tokens": "0"})


def fill(u: dict[str, str]) -> dict[str, str]:
    out = dict(u)
    out["output_tokens"] = (f"(CASE WHEN {u['output_tokens']} = 0 THEN {u['reasoning_tokens']} + {u['answer_tokens']} "
                            f"ELSE {u['output_tokens']} END)")
    out["total_tokens"] = (f"(CASE WHEN {u['total_tokens']} = 0 THEN {u['prompt_tokens']} + {u['answer_tokens']} "
                           f"+ {u['reasoning_tokens']} ELSE {u['total_tokens']} END)")
    return out


def usage_select(u: dict[str, str]) -> str:
    return ", ".join(f"CAST({v} AS BIGINT) AS {k}" if k != "answer_tokens_estimated" else f"{v} AS {k}"
                     for k, v in u.items())


def classify_empty(text: str, out: str, evidence: str, budget: str, detail: str) -> str:
    d = f"' (' || {detail} || ')'"
    return (f"(CASE WHEN coalesce(length({text}), 0) > 0 THEN NULL "
            f"WHEN {out} <= 0 THEN {q(C.NO_OUTPUT)} || {d} "
            f"WHEN coalesce({budget}, false) THEN NULL "
            f"WHEN coalesce({evidence}, false) THEN {q(C.REASONING_ONLY)} || {d} "
            f"ELSE {q(C.NO_CONTENT)} || {d} END)")


EV = f"""ev AS (
  SELECT request_id, seq, coalesce(is_data AND p = '[DONE]', false) AS is_done,
         CASE WHEN is_data AND p <> '[DONE]' AND json_valid(p) THEN p END AS j
  FROM (SELECT request_id, seq, starts_with(l, 'data: ') AS is_data, substr(l, 7) AS p
        FROM (SELECT request_id, seq, {strip('line')} AS l FROM chunk_lines))
)"""


def _nz(x: str) -> str:
    return f"coalesce(length({x}), 0) > 0"


def chat_sql() -> str:
    u = split_usage("coalesce(up, 0)", "coalesce(uc, 0)", "coalesce(ut, 0)", "coalesce(ur, 0)", "text")
    zero = {k: ("false" if k == "answer_tokens_estimated" else "0") for k in u}
    tok = {k: f"(CASE WHEN has_usage THEN {v} ELSE {zero[k]} END)" for k, v in u.items()}
    fin = "finish_reason"
    err = classify_empty("text", tok["output_tokens"], f"({tok['reasoning_tokens']} > 0 OR reasoning_chars > 0)",
                         f"{fin} = 'length'", f"'finish_reason=' || coalesce({fin}, 'unknown')")
    return with_ctes(chunk_lines_sql("chat"), EV) + f"""
SELECT request_id, text, coalesce(model, {q(DEFAULT_MODEL)}) AS model, {fin}, {usage_select(tok)}, {err} AS error
FROM (
  SELECT request_id,
    coalesce(string_agg(content, '' ORDER BY seq) FILTER (WHERE {_nz('content')}), '') AS text,
    arg_max(model, seq) FILTER (WHERE {_nz('model')}) AS model,
    arg_max(finish, seq) FILTER (WHERE {_nz('finish')}) AS finish_reason,
    coalesce(sum(rchars), 0) AS reasoning_chars,
    coalesce(bool_or(has_usage), false) AS has_usage,
    arg_max_null(up, seq) FILTER (WHERE has_usage) AS up, arg_max_null(uc, seq) FILTER (WHERE has_usage) AS uc,
    arg_max_null(ut, seq) FILTER (WHERE has_usage) AS ut, arg_max_null(ur, seq) FILTER (WHERE has_usage) AS ur
  FROM (
    SELECT request_id, seq,
      json_extract_string(j, '$.choices[0].delta.content') AS content,
      json_extract_string(j, '$.model') AS model,
      json_extract_string(j, '$.choices[0].finish_reason') AS finish,
      coalesce(length(json_extract_string(j, '$.choices[0].delta.reasoning_content')), 0) AS rchars,
      coalesce(json_type(j, '$.usage') = 'OBJECT', false) AS has_usage,
      CAST(json_extract(j, '$.usage.prompt_tokens') AS BIGINT) AS up,
      CAST(json_extract(j, '$.usage.completion_tokens') AS BIGINT) AS uc,
      CAST(json_extract(j, '$.usage.total_tokens') AS BIGINT) AS ut,
      CAST(json_extract(j, '$.usage.completion_tokens_details.reasoning_tokens') AS BIGINT) AS ur
    FROM (SELECT *, min(CASE WHEN is_done THEN seq END) OVER (PARTITION BY request_id) AS end_seq FROM ev)
    WHERE end_seq IS NULL OR seq <= end_seq)
  GROUP BY request_id)"""


def responses_sql() -> str:
    term = ", ".join(q(t) for t in TERMINAL_EVENTS)
    raw_u = split_usage("coalesce(ui, 0)", "coalesce(uo, 0)", "coalesce(ut, 0)", "coalesce(ur, 0)", "text")
    status = (f"(CASE WHEN t_type IN ({term}) THEN coalesce(nullif(t_status, ''), "
              f"regexp_replace(t_type, '^response\\.', '')) END)")
    out = raw_u["output_tokens"]
    evidence = f"({raw_u['reasoning_tokens']} > 0 OR reasoning_chars > 0)"
    err = (f"CASE WHEN status IS NULL THEN {q(C.STREAM_INCOMPLETE)} "
           f"WHEN status = 'failed' THEN {q(C.STREAM_FAILED)} || coalesce(nullif(t_error, ''), {q(C.STREAM_FAILED_DEFAULT)}) "
           f"WHEN status = 'incomplete' AND NOT coalesce(t_reason = 'max_output_tokens', false) THEN "
           f"{q(C.RESPONSES_INCOMPLETE)} || coalesce(nullif(t_reason, ''), 'unknown') || ' (output_tokens=' "
           f"|| CAST({out} AS VARCHAR) || ')' "
           f"ELSE {classify_empty('text', out, evidence, "status = 'incomplete'", "'status=' || status")} END")
    finish = "CASE WHEN status = 'incomplete' AND coalesce(length(t_reason), 0) > 0 THEN 'incomplete:' || t_reason ELSE status END"
    model = f"CASE WHEN status IS NOT NULL THEN coalesce(t_model, {q(DEFAULT_MODEL)}) ELSE {q(DEFAULT_MODEL)} END"
    return with_ctes(chunk_lines_sql("responses"), EV) + f"""
SELECT request_id, text, {model} AS model, {finish} AS finish_reason, {usage_select(raw_u)}, {err} AS error
FROM (SELECT *, {status} AS status FROM (
  SELECT request_id,
    coalesce(string_agg(CASE WHEN t = 'response.output_text.delta' THEN coalesce(delta, '') END, '' ORDER BY seq), '') AS text,
    coalesce(sum(CASE WHEN t = 'response.reasoning_text.delta' THEN coalesce(length(delta), 0) ELSE 0 END), 0) AS reasoning_chars,
    max(t) FILTER (WHERE seq = end_seq) AS t_type,
    max(json_extract_string(j, '$.response.model')) FILTER (WHERE seq = end_seq) AS t_model,
    max(json_extract_string(j, '$.response.status')) FILTER (WHERE seq = end_seq) AS t_status,
    max(json_extract_string(j, '$.response.incomplete_details.reason')) FILTER (WHERE seq = end_seq) AS t_reason,
    max(CASE WHEN json_type(j, '$.response.error') = 'OBJECT' THEN json_extract_string(j, '$.response.error.message')
             ELSE nullif(json_extract_string(j, '$.response.error'), '') END) FILTER (WHERE seq = end_seq) AS t_error,
    max(CAST(json_extract(j, '$.response.usage.input_tokens') AS BIGINT)) FILTER (WHERE seq = end_seq) AS ui,
    max(CAST(json_extract(j, '$.response.usage.output_tokens') AS BIGINT)) FILTER (WHERE seq = end_seq) AS uo,
    max(CAST(json_extract(j, '$.response.usage.total_tokens') AS BIGINT)) FILTER (WHERE seq = end_seq) AS ut,
    max(CAST(json_extract(j, '$.response.usage.output_tokens_details.reasoning_tokens') AS BIGINT)) FILTER (WHERE seq = end_seq) AS ur
  FROM (
    SELECT *, json_extract_string(j, '$.delta') AS delta FROM (
      SELECT *, min(CASE WHEN is_done OR t IN ({term}) THEN seq END) OVER (PARTITION BY request_id) AS end_seq
      FROM (SELECT *, json_extract_string(j, '$.type') AS t FROM ev))
    WHERE end_seq IS NULL OR seq <= end_seq)
  GROUP BY request_id))"""


def messages_sql() -> str:
    u = messages_usage("coalesce(input_tokens, 0)", "coalesce(output_tokens, 0)", "thinking_tokens", "text")
    out = "coalesce(output_tokens, 0)"
    detail = f"'stop_reason=' || coalesce(stop_reason, 'None') || ', output_tokens=' || CAST({out} AS VARCHAR)"
    err = classify_empty("text", out, f"{u['reasoning_tokens']} > 0", "stop_reason = 'max_tokens'", detail)
    z = lambda p: f"coalesce(CAST(json_extract(j, '{p}') AS BIGINT), 0)"
    return with_ctes(chunk_lines_sql("messages"), EV) + f"""
SELECT request_id, text, coalesce(model, {q(DEFAULT_MODEL)}) AS model, stop_reason AS finish_reason,
       {usage_select(u)}, {err} AS error
FROM (
  SELECT request_id,
    coalesce(string_agg(CASE WHEN t = 'content_block_delta' AND json_extract_string(j, '$.delta.type') = 'text_delta'
                             THEN coalesce(json_extract_string(j, '$.delta.text'), '') END, '' ORDER BY seq), '') AS text,
    arg_max_null({z('$.message.usage.input_tokens')}, seq) FILTER (WHERE t = 'message_start') AS input_tokens,
    arg_max_null(coalesce(json_extract_string(j, '$.message.model'), {q(DEFAULT_MODEL)}), seq)
      FILTER (WHERE t = 'message_start') AS model,
    arg_max_null(CAST(json_extract(j, '$.usage.output_tokens') AS BIGINT), seq)
      FILTER (WHERE t = 'message_delta' AND json_extract(j, '$.usage.output_tokens') IS NOT NULL
              AND json_type(j, '$.usage.output_tokens') <> 'NULL') AS output_tokens,
    arg_max_null(CAST(json_extract(j, '$.usage.output_tokens_details.thinking_tokens') AS BIGINT), seq)
      FILTER (WHERE t = 'message_delta' AND json_type(j, '$.usage.output_tokens_details.thinking_tokens') IS NOT NULL
              AND json_type(j, '$.usage.output_tokens_details.thinking_tokens') <> 'NULL') AS thinking_tokens,
    arg_max_null(json_extract_string(j, '$.delta.stop_reason'), seq)
      FILTER (WHERE t = 'message_delta' AND json_type(j, '$.delta.stop_reason') IS NOT NULL) AS stop_reason
  FROM (SELECT *, json_extract_string(j, '$.type') AS t FROM ev)
  GROUP BY request_id)"""


def messages_cache_sql() -> str:
    z = lambda p: f"coalesce(CAST(json_extract(j, '{p}') AS BIGINT), 0)"
    return with_ctes(chunk_lines_sql("messages"), EV) + f"""
SELECT request_id, cache_creation, cache_read, cache_5m, cache_1h FROM (
  SELECT request_id,
    arg_max_null(CASE WHEN t = 'message_start' THEN {z('$.message.usage.cache_creation_input_tokens')}
                      ELSE CAST(json_extract(j, '$.usage.cache_creation_input_tokens') AS BIGINT) END, seq)
      FILTER (WHERE t = 'message_start' OR (t = 'message_delta'
              AND coalesce(CAST(json_extract(j, '$.usage.cache_creation_input_tokens') AS BIGINT), 0) <> 0)) AS cache_creation,
    arg_max_null(CASE WHEN t = 'message_start' THEN {z('$.message.usage.cache_read_input_tokens')}
                      ELSE CAST(json_extract(j, '$.usage.cache_read_input_tokens') AS BIGINT) END, seq)
      FILTER (WHERE t = 'message_start' OR (t = 'message_delta'
              AND coalesce(CAST(json_extract(j, '$.usage.cache_read_input_tokens') AS BIGINT), 0) <> 0)) AS cache_read,
    arg_max_null({z('$.message.usage.cache_creation.ephemeral_5m_input_tokens')}, seq)
      FILTER (WHERE t = 'message_start') AS cache_5m,
    arg_max_null({z('$.message.usage.cache_creation.ephemeral_1h_input_tokens')}, seq)
      FILTER (WHERE t = 'message_start') AS cache_1h
  FROM (SELECT *, json_extract_string(j, '$.type') AS t FROM ev)
  GROUP BY request_id)
WHERE cache_creation > 0 OR cache_read > 0"""
