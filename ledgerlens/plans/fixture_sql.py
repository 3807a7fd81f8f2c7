"""Derived views over the driver tables (oracle side, DuckDB SQL).

Each constant is one ``name AS (...)`` common table expression mirroring the rule
of the same name in :mod:`ledgerlens.plans.fixtures`.
"""
from __future__ import annotations

from .fixtures import LEGACY_JUDGE_ERROR

ATTEMPTS = f"""attempts AS (
  SELECT
    'run' || CAST(event_id % 4 AS VARCHAR) AS run_id,
    'p' || CAST(user_id AS VARCHAR) AS problem_key,
    event_id AS seq,
    'q' || CAST(user_id AS VARCHAR) AS question,
    CAST(user_id % 10 AS VARCHAR) AS ground_truth,
    CASE WHEN event_id % 11 = 0 THEN '' ELSE 'r' || CAST(event_id AS VARCHAR) END AS model_response,
    event_type = 'purchase' AS correct,
    CAST(10 + k AS BIGINT) AS prompt_tokens,
    CAST(event_id % 500 AS BIGINT) AS answer_tokens,
    CAST(k * 37 AS BIGINT) AS reasoning_tokens,
    CAST(CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 500 + k * 37 END AS BIGINT) AS output_tokens,
    CAST(CASE WHEN event_id % 7 = 0 THEN 0 ELSE 10 + k + event_id % 500 + k * 37 END AS BIGINT) AS total_tokens,
    value AS latency,
    CASE WHEN event_type = 'error' AND event_id % 3 <> 0 THEN 'HTTP 500'
         WHEN event_type = 'error' THEN '{LEGACY_JUDGE_ERROR}'
         WHEN event_id % 13 = 0 THEN ''
         ELSE NULL END AS error,
    CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'judge timeout' END AS evaluator_error,
    CASE WHEN event_type = 'error' AND event_id % 3 <> 0 THEN 'error' ELSE 'answer_block' END AS extraction_method,
    CASE WHEN event_type = 'error' AND event_id % 3 <> 0 THEN 'error' ELSE 'stop' END AS finish_reason
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
)"""

# P15 fill + P14 legacy migration over F1.
FIXED = """fixed AS (
  SELECT * REPLACE (
      CASE WHEN legacy THEN NULL ELSE error END AS error,
      CASE WHEN legacy THEN error ELSE evaluator_error END AS evaluator_error)
  FROM (
    SELECT * REPLACE (
        CASE WHEN output_tokens = 0 THEN reasoning_tokens + answer_tokens ELSE output_tokens END AS output_tokens,
        CASE WHEN total_tokens = 0 THEN prompt_tokens + answer_tokens + reasoning_tokens ELSE total_tokens END AS total_tokens),
      (coalesce(length(error), 0) > 0 AND coalesce(length(evaluator_error), 0) = 0
       AND coalesce(length(model_response), 0) > 0
       AND NOT coalesce(extraction_method IN ('error', 'exception'), false)) AS legacy
    FROM attempts)
)"""

# A1 (latest row per key, first-seen position) + P17 outcome.
LATEST = """latest AS (
  SELECT *,
    CASE WHEN coalesce(length(error), 0) = 0 AND coalesce(length(evaluator_error), 0) = 0 THEN 'completed'
         WHEN coalesce(length(evaluator_error), 0) > 0 AND coalesce(length(error), 0) = 0
              AND coalesce(length(model_response), 0) > 0 THEN 'rejudge'
         ELSE 'regenerate' END AS outcome
  FROM (
    SELECT * EXCLUDE (rn) FROM (
      SELECT *, row_number() OVER (PARTITION BY run_id, problem_key ORDER BY seq DESC) AS rn,
             min(seq) OVER (PARTITION BY run_id, problem_key) AS first_seq
      FROM fixed) WHERE rn = 1)
)"""

RUN_PROBLEMS = """run_problems AS (
  SELECT 'run' || CAST(c_custkey % 4 AS VARCHAR) AS run_id,
         'p' || CAST(c_custkey AS VARCHAR) AS problem_key,
         c_name AS problem, c_mktsegment AS answer
  FROM customer
)"""

SUMMARY_SELECT = """
    count(*)::BIGINT AS total_problems,
    count_if(coalesce(correct, false))::BIGINT AS correct_count,
    round(coalesce(count_if(coalesce(correct, false)) / count(*) * 100.0, 0.0), 6) AS accuracy,
    coalesce(sum(total_tokens), 0)::BIGINT AS total_tokens,
    coalesce(sum(prompt_tokens), 0)::BIGINT AS total_prompt_tokens,
    coalesce(sum(answer_tokens), 0)::BIGINT AS total_answer_tokens,
    coalesce(sum(reasoning_tokens), 0)::BIGINT AS total_reasoning_tokens,
    coalesce(sum(output_tokens), 0)::BIGINT AS total_output_tokens,
    round(coalesce(sum(total_tokens) / count(*), 0.0), 6) AS avg_tokens_per_problem,
    round(coalesce(sum(latency) / count(*), 0.0), 6) AS avg_latency,
    count_if(coalesce(length(error), 0) > 0 OR coalesce(length(evaluator_error), 0) > 0)::BIGINT AS error_count,
    round(coalesce(count_if(coalesce(correct, false)) / count(*) * 100.0, 0.0)
          - 10.0 * ln(coalesce(sum(total_tokens) / count(*), 0.0) / 10000.0 + 1.0), 9) AS efficiency_score"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"

USAGE_PAYLOADS = """usage_payloads AS (
  SELECT l_orderkey, l_linenumber,
    CASE l_linenumber % 4 WHEN 0 THEN 'chat_completion' WHEN 1 THEN 'openai-responses'
                          WHEN 2 THEN 'gemini' ELSE 'anthropic' END AS provider,
    CASE l_linenumber % 4
      WHEN 0 THEN '{"prompt_tokens": ' || p || ', "completion_tokens": ' || c || ', "total_tokens": ' || t
                  || CASE WHEN has_r THEN ', "completion_tokens_details": {"reasoning_tokens": ' || r || '}' ELSE '' END || '}'
      WHEN 1 THEN CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE
                  '{"input_tokens": ' || p || ', "output_tokens": ' || c || ', "total_tokens": ' || t
                  || CASE WHEN has_r THEN ', "output_tokens_details": {"reasoning_tokens": ' || r || '}' ELSE '' END || '}' END
      WHEN 2 THEN CASE l_orderkey % 3
          WHEN 0 THEN '{"prompt_token_count": ' || p || ', "candidates_token_count": ' || c || ', "total_token_count": ' || t
                      || CASE WHEN has_r THEN ', "thoughts_token_count": ' || r ELSE '' END || '}'
          WHEN 1 THEN '{"prompt_token_count": 0, "prompt_tokens": ' || p || ', "completion_tokens": ' || c
                      || ', "total_tokens": ' || t || '}'
          ELSE '{"input_tokens": ' || p || ', "output_tokens": ' || c
               || CASE WHEN has_r THEN ', "thoughts_token_count": ' || r ELSE '' END || '}' END
      ELSE '{"input_tokens": ' || p || ', "output_tokens": ' || c
           || CASE WHEN has_r THEN ', "output_tokens_details": {"thinking_tokens": ' || r || '}' ELSE '' END
           || CASE WHEN cache THEN ', "cache_creation_input_tokens": ' || cc || ', "cache_read_input_tokens": ' || (l_suppkey % 40)
                   || ', "cache_creation": {"ephemeral_5m_input_tokens": ' || c5 || ', "ephemeral_1h_input_tokens": ' || (cc - c5) || '}'
                   ELSE '' END || '}'
    END AS usage,
    CASE WHEN l_orderkey % 9 = 0 THEN '' ELSE repeat('x', CAST(l_linenumber * 5 AS INTEGER)) END AS final_text
  FROM (
    SELECT *, l_partkey % 97 AS p, CAST(l_quantity AS BIGINT) AS c, l_suppkey % 60 AS r,
      CASE l_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN l_partkey % 97 + CAST(l_quantity AS BIGINT)
           WHEN 2 THEN l_partkey % 97 + CAST(l_quantity AS BIGINT) + (l_orderkey % 7) * 11 + 1
           ELSE l_partkey % 97 END AS t,
      (l_orderkey + l_linenumber) % 3 <> 0 AS has_r,
      (l_orderkey * 7 + l_linenumber) % 10 = 0 AS cache,
      l_partkey % 50 AS cc, CAST(floor((l_partkey % 50) / 2) AS BIGINT) AS c5
    FROM lineitem)
)"""

# N1-N9 over F4 in SQL: parsed fields → per-provider rules → fill.
USAGE_NORM = """usage_fields AS (
  SELECT l_orderkey, l_linenumber, provider, usage, final_text,
    CAST(json_extract(usage, '$.prompt_tokens') AS BIGINT) AS j_prompt_tokens,
    CAST(json_extract(usage, '$.completion_tokens') AS BIGINT) AS j_completion_tokens,
    CAST(json_extract(usage, '$.total_tokens') AS BIGINT) AS j_total_tokens,
    CAST(json_extract(usage, '$.completion_tokens_details.reasoning_tokens') AS BIGINT) AS j_ctd_reasoning,
    CAST(json_extract(usage, '$.input_tokens') AS BIGINT) AS j_input_tokens,
    CAST(json_extract(usage, '$.output_tokens') AS BIGINT) AS j_output_tokens,
    CAST(json_extract(usage, '$.output_tokens_details.reasoning_tokens') AS BIGINT) AS j_otd_reasoning,
    CAST(json_extract(usage, '$.output_tokens_details.thinking_tokens') AS BIGINT) AS j_otd_thinking,
    CAST(json_extract(usage, '$.prompt_token_count') AS BIGINT) AS j_prompt_token_count,
    CAST(json_extract(usage, '$.candidates_token_count') AS BIGINT) AS j_candidates_token_count,
    CAST(json_extract(usage, '$.total_token_count') AS BIGINT) AS j_total_token_count,
    CAST(json_extract(usage, '$.thoughts_token_count') AS BIGINT) AS j_thoughts_token_count,
    CAST(json_extract(usage, '$.cache_creation_input_tokens') AS BIGINT) AS j_cache_creation,
    CAST(json_extract(usage, '$.cache_read_input_tokens') AS BIGINT) AS j_cache_read,
    CAST(json_extract(usage, '$.cache_creation.ephemeral_5m_input_tokens') AS BIGINT) AS j_c5m,
    CAST(json_extract(usage, '$.cache_creation.ephemeral_1h_input_tokens') AS BIGINT) AS j_c1h,
    CASE WHEN coalesce(length(final_text), 0) = 0 THEN 0
         ELSE greatest(1, CAST(ceil(length(final_text) / 4.0) AS BIGINT)) END AS vis,
    CAST(floor(floor(coalesce(length(final_text), 0) / 4) * 1.7::DOUBLE) AS BIGINT) AS counted
  FROM usage_payloads
),
split_in AS (
  SELECT *,
    CASE WHEN provider = 'chat_completion' THEN coalesce(j_prompt_tokens, 0) ELSE coalesce(j_input_tokens, 0) END AS sp,
    CASE WHEN provider = 'chat_completion' THEN coalesce(j_completion_tokens, 0) ELSE coalesce(j_output_tokens, 0) END AS sc,
    coalesce(j_total_tokens, 0) AS st,
    CASE WHEN provider = 'chat_completion' THEN coalesce(j_ctd_reasoning, 0) ELSE coalesce(j_otd_reasoning, 0) END AS sr
  FROM usage_fields
),
split_fold AS (
  SELECT *, sc + greatest(st - sp - sc, 0) AS so, sr + greatest(st - sp - sc, 0) AS sr1,
         greatest(st - sp - sc, 0) AS sun
  FROM split_in
),
split_norm AS (
  SELECT l_orderkey, l_linenumber, provider, sp AS prompt_tokens,
    CASE WHEN greatest(sr1, 0) <= greatest(so, 0) THEN greatest(so, 0) - greatest(sr1, 0)
         ELSE least(vis, greatest(so, 0)) END AS answer_tokens,
    CASE WHEN greatest(sr1, 0) <= greatest(so, 0) THEN greatest(sr1, 0)
         ELSE greatest(so, 0) - least(vis, greatest(so, 0)) END AS reasoning_tokens,
    so AS output_tokens, st AS total_tokens,
    NOT (greatest(sr1, 0) <= greatest(so, 0)) AS answer_tokens_estimated,
    sun AS unattributed_tokens
  FROM split_fold WHERE provider IN ('chat_completion', 'openai-responses')
),
gen_in AS (
  SELECT *,
    coalesce(nullif(j_prompt_token_count, 0), nullif(j_prompt_tokens, 0), nullif(j_input_tokens, 0), 0) AS gp,
    coalesce(nullif(j_candidates_token_count, 0), nullif(j_completion_tokens, 0), nullif(j_output_tokens, 0), 0) AS ga,
    coalesce(j_thoughts_token_count, 0) AS gr,
    coalesce(nullif(j_total_token_count, 0), nullif(j_total_tokens, 0), 0) AS grep
  FROM usage_fields WHERE provider = 'gemini'
),
gen_tot AS (
  SELECT *, CASE WHEN grep = 0 THEN gp + ga + gr ELSE grep END AS gt FROM gen_in
),
gen_norm AS (
  SELECT l_orderkey, l_linenumber, provider, gp AS prompt_tokens, ga AS answer_tokens,
    gr + greatest(gt - gp - (gr + ga), 0) AS reasoning_tokens,
    gr + ga + greatest(gt - gp - (gr + ga), 0) AS output_tokens,
    gt AS total_tokens, false AS answer_tokens_estimated,
    greatest(gt - gp - (gr + ga), 0) AS unattributed_tokens
  FROM gen_tot
),
msg_in AS (
  SELECT *, coalesce(j_input_tokens, 0) AS mp, coalesce(j_output_tokens, 0) AS mo, j_otd_thinking AS th,
    (j_otd_thinking IS NOT NULL AND j_otd_thinking >= 0 AND j_otd_thinking <= coalesce(j_output_tokens, 0)) AS exact,
    coalesce(length(final_text) > 0, false) AS has_text
  FROM usage_fields WHERE provider = 'anthropic'
),
msg_ans AS (
  SELECT *, CASE WHEN exact THEN mo - th WHEN has_text THEN least(counted, mo) ELSE 0 END AS ma,
    CASE WHEN exact THEN false WHEN has_text THEN true ELSE false END AS mest
  FROM msg_in
),
msg_norm AS (
  SELECT l_orderkey, l_linenumber, provider, mp AS prompt_tokens, ma AS answer_tokens,
    greatest(mo - ma, 0) AS reasoning_tokens, mo AS output_tokens, mp + mo AS total_tokens,
    mest AS answer_tokens_estimated, 0 AS unattributed_tokens
  FROM msg_ans
),
usage_raw AS (
  SELECT * FROM split_norm UNION ALL SELECT * FROM gen_norm UNION ALL SELECT * FROM msg_norm
),
usage_norm AS (
  SELECT l_orderkey, l_linenumber, provider,
    CAST(prompt_tokens AS BIGINT) AS prompt_tokens, CAST(answer_tokens AS BIGINT) AS answer_tokens,
    CAST(reasoning_tokens AS BIGINT) AS reasoning_tokens,
    CAST(CASE WHEN output_tokens = 0 THEN reasoning_tokens + answer_tokens ELSE output_tokens END AS BIGINT) AS output_tokens,
    CAST(CASE WHEN total_tokens = 0 THEN prompt_tokens + answer_tokens + reasoning_tokens ELSE total_tokens END AS BIGINT) AS total_tokens,
    answer_tokens_estimated, CAST(unattributed_tokens AS BIGINT) AS unattributed_tokens
  FROM usage_raw
)"""


def _responses_sql() -> str:
    from .fixtures import CODE_TAILS, MATH_TAILS, MCQ_TAILS
    from .templates import case_sql
    vals = {"L": "chr(CAST(65 + (doc_id * 7) % 4 AS INTEGER))", "N": "doc_id % 97", "ID": "doc_id"}
    body = "text"
    return f"""responses AS (
  SELECT doc_id,
    'Compute item ' || CAST(doc_id AS VARCHAR) || ' (' || lang || ')' AS question,
    chr(CAST(65 + doc_id % 4 AS INTEGER)) AS truth,
    CAST(doc_id % 97 AS VARCHAR) AS math_truth,
    CASE WHEN doc_id % 12 = 11 THEN '' ELSE {body} || {case_sql('doc_id % 12', MCQ_TAILS, vals)} END AS mcq_response,
    CASE WHEN doc_id % 23 = 0 THEN '' ELSE {body} || {case_sql('doc_id % 5', MATH_TAILS, vals)} END AS math_response,
    {body} || {case_sql('doc_id % 7', CODE_TAILS, vals)} AS code_response,
    list_transform(range(1, doc_id % 4 + 2), lambda i: 'assert f(' || CAST(i AS VARCHAR) || ') == ' || CAST(i + 1 AS VARCHAR)) AS tests
  FROM documents
)"""


RESPONSES = _responses_sql()


def chunk_lines_sql(protocol: str) -> str:
    from .fixtures import STREAM_LINES
    from .templates import case_sql
    vals = {"ID": "event_id", "M": "k % 3", "K": "k", "K2": "k * 2", "K3": "k * 3 + k % 5", "KR": "k % 7",
            "KT": "k % 9", "KX": "k * 3 + 1", "K4": "k % 50", "K5": "k % 40",
            "C5": "CAST(floor((k % 50) / 2) AS BIGINT)", "C1": "k % 50 - CAST(floor((k % 50) / 2) AS BIGINT)"}
    kind = ("CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'signup' THEN 2 "
            "WHEN 'purchase' THEN k % 4 + 3 ELSE event_id % 3 + 7 END")
    return f"""chunk_lines AS (
  SELECT user_id AS request_id, event_id AS seq, {case_sql(kind, STREAM_LINES[protocol], vals)} AS line
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
)"""


def _judge_outputs_sql() -> str:
    from .fixtures import JUDGE_OUTPUTS
    from .templates import case_sql
    return f"""judge_outputs AS (
  SELECT doc_id, CASE WHEN doc_id % 31 = 0 THEN '' ELSE {case_sql('doc_id % 10', JUDGE_OUTPUTS, {'N': 'doc_id % 97'})} END AS content
  FROM documents
)"""


JUDGE_OUTPUTS = _judge_outputs_sql()


PROBLEMS = """problems AS (
  SELECT item_id,
    CASE WHEN item_id % 5 = 0 THEN text || chr(10) || 'assert f(0) == 1' ELSE text END AS problem,
    chr(CAST(65 + item_id % 4 AS INTEGER)) AS answer,
    ['math', 'science', 'code', 'custom'][item_id % 4 + 1] AS evaluator_type,
    list_transform(range(1, item_id % 4 + 2), lambda i: 'assert f(' || CAST(i AS VARCHAR) || ') == ' || CAST(i + 1 AS VARCHAR)) AS test_list,
    CASE WHEN item_id % 3 = 0 THEN ['assert f(9) == 10'] ELSE []::VARCHAR[] END AS challenge_test_list,
    CASE WHEN item_id % 6 = 0 THEN list_transform(range(1, item_id % 4 + 2), lambda i: 'assert f(' || CAST(i AS VARCHAR) || ') == ' || CAST(i + 1 AS VARCHAR)) END AS test_cases,
    CASE WHEN item_id % 2 = 0 THEN CAST((item_id % 7 + 1) * 1000 AS BIGINT) END AS max_context_window,
    CASE WHEN item_id % 2 = 1 THEN CAST((item_id % 5 + 1) * 512 AS BIGINT) END AS max_output_tokens
  FROM benchmark
)"""

PAIRS = """pairs AS (
  SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS response
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'
)"""


def _runs_sql() -> str:
    from .fixtures import OVERRIDE_SET_RULES, OVERRIDE_UNSET_RULES, RUN_EVALUATORS, RUN_PROVIDERS
    from .templates import render_sql
    vals = {"T": "lower(p_type)", "K": "p_partkey", "S": "p_size"}
    entries = ", ".join(
        f"CASE WHEN p_partkey % {mod} = {rem} THEN {{'key': '{path}', 'value': {render_sql(tpl, vals)}}} END"
        for path, tpl, mod, rem in OVERRIDE_SET_RULES)
    unset = ", ".join(f"CASE WHEN p_partkey % {mod} = {rem} THEN '{path}' END" for path, mod, rem in OVERRIDE_UNSET_RULES)
    prov = ", ".join(f"'{x}'" for x in RUN_PROVIDERS)
    evs = ", ".join(f"'{x}'" for x in RUN_EVALUATORS)
    u0 = "regexp_replace(url, '#.*$', '')"
    u1 = f"CASE WHEN p_partkey % 3 = 0 THEN replace({u0}, '://', '://user:pw' || CAST(p_partkey AS VARCHAR) || '@') ELSE {u0} END"
    u2 = (f"CASE WHEN p_partkey % 4 = 0 THEN ({u1}) || CASE WHEN contains({u1}, '?') THEN '&' ELSE '?' END "
          f"|| 'api_key=SECRET' || CAST(p_partkey AS VARCHAR) || '&max_tokens=' || CAST(p_size AS VARCHAR) ELSE {u1} END")
    u2 = f"(({u2}) || regexp_extract(url, '(#.*)$', 1))"
    u2 = f"CASE p_partkey % 13 WHEN 5 THEN regexp_replace({u2}, '^[a-z]+://', '') WHEN 6 THEN regexp_replace({u2}, '^[a-z]+:', '') ELSE {u2} END"
    return f"""runs AS (
  SELECT 'run' || CAST(p_partkey AS VARCHAR) AS run_id,
    [{prov}][p_partkey % 4 + 1] AS provider,
    lower(replace(p_brand, '#', '-')) AS model,
    'data/' || lower(p_type) || '.jsonl' AS dataset_path,
    CASE WHEN p_partkey % 2 = 1 THEN lower(p_type) END AS dataset_name,
    CASE WHEN p_partkey % 3 = 0 THEN 'test' END AS dataset_split,
    [{evs}][p_size % 3 + 1] AS evaluator_type,
    (p_size % 25) / 10.0::DOUBLE AS temperature,
    CASE WHEN p_partkey % 2 = 1 THEN (p_partkey % 12) / 10.0::DOUBLE END AS top_p,
    CAST(CASE WHEN p_partkey % 5 NOT IN (1, 4) THEN p_size * 100 END AS BIGINT) AS max_output_tokens,
    CAST(CASE WHEN p_partkey % 5 = 0 THEN 32000 WHEN p_partkey % 5 = 4 THEN p_size * 1000 END AS BIGINT) AS max_context_window,
    CASE WHEN p_partkey % 6 <> 0 THEN 'sk-' || CAST(p_partkey AS VARCHAR) END AS api_key,
    {u2} AS base_url,
    CAST(CASE WHEN p_partkey % 7 = 0 THEN 300 END AS BIGINT) AS wall_clock_timeout,
    CAST(p_size % 3 + 5 AS BIGINT) AS execution_timeout,
    CAST(p_partkey % 20 + 5 AS BIGINT) AS concurrency,
    CAST(120 AS BIGINT) AS timeout,
    CAST(p_partkey % 3 + 1 AS BIGINT) AS max_retries,
    CASE WHEN p_partkey % 11 = 0 THEN 'high' END AS legacy_reasoning_effort,
    CASE WHEN p_partkey % 17 = 3 THEN 'true' END AS legacy_enable_thinking,
    CAST(CASE WHEN p_partkey % 19 = 7 THEN 0 END AS BIGINT) AS judge_max_tokens,
    CAST(CASE WHEN p_partkey % 23 = 5 THEN -1 END AS BIGINT) AS judge_timeout,
    list_filter([{entries}], lambda e: e IS NOT NULL) AS overrides_entries,
    list_filter([{unset}], lambda x: x IS NOT NULL) AS overrides_unset,
    CASE WHEN p_size % 3 = 0 AND p_partkey % 9 <> 4 THEN 'judge-' || CAST(p_partkey % 3 AS VARCHAR) END AS judge_model,
    CASE WHEN p_size % 3 = 0 AND p_partkey % 4 = 2 THEN 'https://judge:pw' || CAST(p_partkey AS VARCHAR) || '@judge.example.com/v1'
         WHEN p_size % 3 = 0 AND p_partkey % 4 <> 1 THEN 'https://judge.example.com/v1' END AS judge_base_url,
    CASE WHEN p_size % 3 = 0 AND p_partkey % 5 <> 2 THEN 'jk-' || CAST(p_partkey AS VARCHAR) END AS judge_api_key
  FROM part LEFT JOIN (SELECT page_id, url FROM pages) pg ON pg.page_id = part.p_partkey
)"""


RUNS = _runs_sql()

#: F7s, after RUNS.
SIBLING_RUNS = """sibling_runs AS (
  SELECT * REPLACE (
      CAST(CASE WHEN k % 7 = 3 THEN 900 ELSE wall_clock_timeout END AS BIGINT) AS wall_clock_timeout,
      CAST(CASE WHEN k % 11 = 4 THEN coalesce(max_output_tokens, 0) + 1 ELSE max_output_tokens END AS BIGINT) AS max_output_tokens)
  FROM (SELECT CAST(substr(o.run_id, 4) AS BIGINT) AS k, t.* REPLACE (o.run_id AS run_id, o.model AS model, o.api_key AS api_key,
            o.temperature AS temperature, o.concurrency AS concurrency, o.max_retries AS max_retries)
        FROM runs o JOIN runs t ON t.run_id = 'run' || CAST(CAST(substr(o.run_id, 4) AS BIGINT) % 5 + 1 AS VARCHAR))
)"""

DATASET_PROBLEMS = """dataset_problems AS (
  SELECT pr.*, 'data/' || lower(p_type) || '.jsonl' AS dataset_path
  FROM problems pr JOIN part ON part.p_partkey = pr.item_id
)"""


def _failures_sql() -> str:
    from .fixtures import FAILURE_MESSAGES, FAILURE_STATUS, FINISH_REASONS, RUN_PROVIDERS
    lst = lambda xs: "[" + ", ".join("'" + x + "'" for x in xs) + "]"
    return f"""failures AS (
  SELECT event_id, {lst(RUN_PROVIDERS)}[user_id % 4 + 1] AS provider,
    CAST([{', '.join(str(x) for x in FAILURE_STATUS)}][event_id % 7 + 1] AS BIGINT) AS status_code,
    {lst(FAILURE_MESSAGES)}[k % 8 + 1] AS message,
    {lst(FINISH_REASONS)}[k % 6 + 1] AS finish_reason,
    CAST(event_id % 4 AS BIGINT) AS attempt, CAST(3 AS BIGINT) AS max_retries, value AS latency
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) WHERE event_type = 'error'
)"""


FAILURES = _failures_sql()

GENERATE_RESPONSES = """generate_responses AS (
  SELECT doc_id,
    CASE WHEN doc_id % 4 = 0 THEN body ELSE '' END AS text,
    CASE WHEN doc_id % 4 = 1 THEN string_split(body, chr(10)) ELSE []::VARCHAR[] END AS parts,
    CASE WHEN doc_id % 4 = 2 THEN body END AS candidate_text,
    ['FinishReason.STOP', 'FinishReason.MAX_TOKENS', 'MAX_TOKENS'][doc_id % 3 + 1] AS finish_reason
  FROM (SELECT doc_id, text AS body FROM documents)
)"""
