"""Run-registry queries over F7."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.redact import MASK, is_secret_key, redact_url
from ..operators import runs as RU
from ..session import spread
from . import fixture_sql as Q
from . import sql_prompts as SP
from .fixtures import dataset_problems, runs
from .registry import query
from .sql_extract import q as sq

_RUNS = Q.with_ctes(Q.RUNS)
_PATHS = "list_concat(list_transform(overrides_entries, lambda e: e.key), overrides_unset)"


def _sql_secret(k: str) -> str:
    low = f"lower({k})"
    return (f"(contains({low}, 'key') OR contains({low}, 'secret') OR contains({low}, 'authorization') "
            f"OR contains({low}, 'password') OR (contains({low}, 'token') AND NOT contains({low}, 'tokens')))")


def _sql_violations() -> str:
    rules = [
        ("temperature_range", "temperature < 0 OR temperature > 2"),
        ("top_p_range", "top_p IS NOT NULL AND (top_p < 0 OR top_p > 1)"),
        ("max_output_tokens_positive", "max_output_tokens <= 0"),
        ("max_context_window_positive", "max_context_window <= 0"),
        ("settings_positive", "concurrency <= 0 OR timeout <= 0 OR max_retries <= 0 OR execution_timeout <= 0 "
                              "OR wall_clock_timeout <= 0"),
        ("budget_both", "max_output_tokens IS NOT NULL AND max_context_window IS NOT NULL"),
        ("budget_missing", "max_output_tokens IS NULL AND max_context_window IS NULL"),
        ("chat_requires_api_key", "provider = 'chat_completion' AND coalesce(length(api_key), 0) = 0"),
        ("chat_requires_base_url", "provider = 'chat_completion' AND coalesce(length(base_url), 0) = 0"),
        ("removed_field", "legacy_reasoning_effort IS NOT NULL OR legacy_enable_thinking IS NOT NULL"),
        ("judge_limits_positive", "judge_max_tokens <= 0 OR judge_timeout <= 0"),
        ("blank_override_path", f"len(list_filter({_PATHS}, lambda p: trim(p) = '')) > 0"),
    ]
    arms = ", ".join(f"CASE WHEN coalesce({cond}, false) THEN '{name}' END" for name, cond in rules)
    return f"list_filter([{arms}], lambda x: x IS NOT NULL)"


def _sql_protected() -> str:
    arms = " ".join(f"WHEN '{p}' THEN [{', '.join(sq(x) for x in paths)}]" for p, paths in RU.PROTECTED_PATHS.items())
    prot = f"(CASE provider {arms} ELSE []::VARCHAR[] END)"
    return f"list_filter({_PATHS}, lambda p: len(list_filter({prot}, lambda q: p = q OR starts_with(p, q || '.'))) > 0)"


@query("p20_rules", oracle=_RUNS + f"""
SELECT run_id, array_to_string({_sql_violations()}, ',') AS violations,
       len({_sql_violations()})::BIGINT AS n_violations, len({_sql_violations()}) = 0 AS valid FROM runs""")
def p20_rules(spark, sf_dir):
    r = runs(spark, sf_dir).withColumn("v", RU.violations())
    return r.select("run_id", F.array_join("v", ",").alias("violations"),
                    F.size("v").cast("bigint").alias("n_violations"), (F.size("v") == 0).alias("valid"))


@query("p21_protected", oracle=_RUNS + f"""
SELECT run_id, provider, array_to_string(list_sort({_sql_protected()}), ',') AS offending_paths,
       len({_sql_protected()})::BIGINT AS n_offending FROM runs""")
def p21_protected(spark, sf_dir):
    r = runs(spark, sf_dir).withColumn("o", RU.protected_violations(RU.override_paths(), "provider"))
    return r.select("run_id", "provider", F.array_join(F.array_sort("o"), ",").alias("offending_paths"),
                    F.size("o").cast("bigint").alias("n_offending"))


_JM = ("list_filter([CASE WHEN coalesce(length(judge_model), 0) = 0 THEN 'judge model' END, "
       "CASE WHEN coalesce(length(judge_base_url), 0) = 0 THEN 'judge endpoint/base_url' END, "
       "CASE WHEN coalesce(length(judge_api_key), 0) = 0 THEN 'judge api-key' END], lambda x: x IS NOT NULL)")


@query("p22_judge_missing", oracle=_RUNS + f"""
SELECT run_id, array_to_string({_JM}, ', ') AS missing, len({_JM}) = 0 AS judge_ready
FROM runs WHERE evaluator_type = 'math'""")
def p22_judge_missing(spark, sf_dir):
    r = runs(spark, sf_dir).filter(F.col("evaluator_type") == "math").withColumn("m", RU.judge_missing())
    return r.select("run_id", F.array_join("m", ", ").alias("missing"), (F.size("m") == 0).alias("judge_ready"))


@query("m1_secret_paths", oracle=_RUNS + f"""
SELECT run_id, e.key AS path, string_split(e.key, '.')[-1] AS leaf, {_sql_secret("string_split(e.key, '.')[-1]")} AS leaf_secret
FROM (SELECT run_id, unnest(overrides_entries) AS e FROM runs)""")
def m1_secret_paths(spark, sf_dir):
    return RU.secret_paths(runs(spark, sf_dir))


def _sql_redact_url(u: str) -> str:
    from ..functions.redact import URL_RE
    g = lambda i: f"regexp_extract({u}, {sq(URL_RE)}, {i})"
    netloc = f"substr({g(2)}, 3)"
    userinfo = f"regexp_extract({netloc}, '^(.*)@', 1)"
    hostport = f"regexp_extract({netloc}, '^(?:.*@)?(.*)$', 1)"
    host = f"lower(regexp_extract({hostport}, '^(\\[[^\\]]*\\]|[^:]*)', 1))"
    port = f"regexp_extract({hostport}, '^(?:\\[[^\\]]*\\]|[^:]*):([0-9]+)$', 1)"
    user_present = (f"(contains({netloc}, '@') AND (length(regexp_extract({userinfo}, '^([^:]*)', 1)) > 0 "
                    f"OR contains({userinfo}, ':')))")
    new_netloc = (f"CASE WHEN {user_present} THEN '//{MASK}@' || {host} || CASE WHEN {port} <> '' THEN ':' || {port} "
                  f"ELSE '' END ELSE {g(2)} END")
    query_ = g(4)
    key = "url_decode(replace(regexp_extract(p, '^([^=]*)', 1), '+', ' '))"
    is_sec = f"(length(p) > 0 AND {_sql_secret(key)})"
    pairs = f"string_split({query_}, '&')"
    q_changed = f"len(list_filter({pairs}, lambda p: {is_sec})) > 0"
    new_query = (f"CASE WHEN {q_changed} THEN array_to_string(list_transform({pairs}, lambda p: CASE WHEN {is_sec} "
                 f"THEN regexp_extract(p, '^([^=]*)', 1) || '={MASK}' ELSE p END), '&') ELSE {query_} END")
    rebuilt = (f"{g(1)} || ({new_netloc}) || {g(3)} || CASE WHEN length({query_}) > 0 THEN '?' || ({new_query}) ELSE '' END "
               f"|| CASE WHEN length({g(5)}) > 0 THEN '#' || {g(5)} ELSE '' END")
    eligible = f"(contains({u}, '@') OR contains({u}, '?'))"
    return (f"CASE WHEN {eligible} AND regexp_matches({u}, {sq(URL_RE)}) AND ({user_present} OR {q_changed}) "
            f"THEN {rebuilt} ELSE {u} END")


@query("m3_url", oracle=_RUNS + f"""
SELECT run_id, {_sql_redact_url('base_url')} AS base_url, {_sql_redact_url('judge_base_url')} AS judge_base_url FROM runs""")
def m3_url(spark, sf_dir):
    r = runs(spark, sf_dir)
    return r.select("run_id", redact_url("base_url").alias("base_url"),
                    redact_url("judge_base_url").alias("judge_base_url"))


_PARTS = "(SELECT r.*, p.p_type, p.p_size, p.p_partkey AS k FROM runs r JOIN part p ON r.run_id = 'run' || CAST(p.p_partkey AS VARCHAR))"


def _sql_template() -> tuple[str, str, str]:
    import hashlib

    from ..functions.prompts import PROMPT_FORMATTER_VERSION, TEMPLATES
    arms = " ".join(f"WHEN '{n}' THEN '{hashlib.sha256(t.encode()).hexdigest()}'" for n, t in TEMPLATES.items())
    return "evaluator_type", sq(PROMPT_FORMATTER_VERSION), f"CASE evaluator_type {arms} ELSE 'raw' END"


def _sql_canonical_set() -> str:
    """Sorted rows ``path=leaf`` of the masked override values, by the rules of F7."""
    t, k, s = "to_json(lower(p_type))::VARCHAR", "k", "p_size"
    mask = f'"{MASK}"'
    rules = [("true", [("'\"reasoning.effort\"'", t)]),
             ("k % 2 = 0", [("'\"extra_headers\"/\"Authorization\"'", f"'{mask}'"), ("'\"extra_headers\"/\"X-Trace\"'", f"'\"t' || {k} || '\"'")]),
             ("k % 3 = 1", [("'\"extra_body.api_token\"'", f"'{mask}'")]),
             ("k % 5 = 2", [("'\"extra_body.options\"/\"list\"/0/\"secret\"'", f"'{mask}'"), ("'\"extra_body.options\"/\"list\"/1'", "'2'"),
                            ("'\"extra_body.options\"/\"max_tokens\"'", f"{s}::VARCHAR"), ("'\"extra_body.options\"/\"nested\"/\"keep\"'", "'1'"),
                            ("'\"extra_body.options\"/\"nested\"/\"password\"'", f"'{mask}'")]),
             ("k % 4 = 1", [("'\"max_completion_tokens\"'", "'\"${max_output_tokens}\"'")]),
             ("k % 4 = 2", [("'\"metadata.note\"'", "'\"budget ${max_output_tokens} tokens\"'")]),
             ("k % 9 = 0", [("'\"model\"'", "'\"evil\"'")]), ("k % 8 = 3", [("'\"stream\"'", "'false'")]), ("k % 13 = 0", [("'\"   \"'", "'1'")])]
    parts = [f"CASE WHEN {cond} THEN [{', '.join(f'{path} || chr(61) || {leaf}' for path, leaf in rows)}] ELSE []::VARCHAR[] END" for cond, rows in rules]
    return f"list_sort(flatten([{', '.join(parts)}]))".replace("\\", "")


_MASKED_COUNT = ("(CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END "
                 "+ CASE WHEN k % 5 = 2 THEN 2 ELSE 0 END)")


@query("m5_redact_config", oracle=_RUNS + f"""
SELECT run_id, CASE WHEN coalesce(length(api_key), 0) > 0 THEN '{MASK}' ELSE api_key END AS api_key,
  {_sql_redact_url('base_url')} AS base_url,
  CASE WHEN coalesce(length(judge_api_key), 0) > 0 THEN '{MASK}' ELSE judge_api_key END AS judge_api_key,
  {_sql_redact_url('judge_base_url')} AS judge_base_url,
  CAST({_MASKED_COUNT} AS BIGINT) AS masked_values, false AS leaked, array_to_string({_sql_canonical_set()}, chr(10)) AS override_rows
FROM {_PARTS}""")
def m5_redact_config(spark, sf_dir):
    """M4 + M5: every credential masked (key, URL user-info and query, judge trio, override values
    at any depth); the masked override values row by row, their number, and that no secret text survives."""
    r = RU.redact_config(runs(spark, sf_dir)).withColumn("ov", F.to_json("overrides_set"))
    masked = (F.size(F.split("ov", F.lit(MASK.replace("*", r"\*")))) - 1).cast("bigint")
    leaked = F.col("ov").rlike(r'Bearer tok|tok-\d|pw\d|secret\\":\s*\\"s\\"')
    return r.select("run_id", "api_key", "base_url", "judge_api_key", "judge_base_url",
                    masked.alias("masked_values"), leaked.alias("leaked"), F.array_join(RU.override_rows("overrides_set"), "\n").alias("override_rows"))


def _sql_identity() -> dict[str, str]:
    """Component → its JSON, in the order of the keys."""
    def js(**parts):
        return f"to_json({{{', '.join(f"'{n}': {x}" for n, x in sorted(parts.items()))}}})::VARCHAR"

    limits = dict(max_context_window="max_context_window", max_output_tokens="max_output_tokens", temperature="temperature", top_p="top_p")
    et, version, template = _sql_template()
    empty = "{'set': []::VARCHAR[], 'unset': []::VARCHAR[]}"
    judge = js(base_url=_sql_redact_url("judge_base_url"), max_tokens=f"coalesce(judge_max_tokens, {RU.JUDGE_MAX_TOKENS})", model="judge_model", request_overrides=empty,
               runtime=sq(RU.JUDGE_RUNTIME), timeout=f"coalesce(judge_timeout, {RU.JUDGE_TIMEOUT})")
    return {
        "base_url": js(value=_sql_redact_url("base_url")), "dataset": js(name="dataset_name", path="dataset_path", split="dataset_split"),
        "evaluator_settings": js(execution_timeout="execution_timeout"), "evaluator_type": js(value="evaluator_type"),
        "generation": f"CASE WHEN wall_clock_timeout IS NULL THEN {js(**limits)} ELSE {js(**limits, wall_clock_timeout='wall_clock_timeout')} END",
        "judge": f"CASE WHEN judge_model IS NULL AND judge_base_url IS NULL AND judge_api_key IS NULL THEN 'null' ELSE {judge} END",
        "model": js(value="model"), "prompt_template": js(evaluator_type=et, formatter_version=version, template_hash=template), "provider": js(value="provider"),
        "request_overrides": f"to_json({{'set': {_sql_canonical_set()}, 'unset': overrides_unset}})::VARCHAR", "schema_version": js(value=sq(RU.SCHEMA_VERSION))}


_IDENTITY = _sql_identity()


@query("h5_identity_hash", oracle=_RUNS + f"""
SELECT run_id, sha256(to_json([{', '.join(f"{{'key': '{n}', 'value': {n}_}}" for n in _IDENTITY)}])::VARCHAR) AS identity_hash,
  to_json({{{', '.join(f"'{n}': {n}_" for n in _IDENTITY)}}})::VARCHAR AS identity
FROM (SELECT run_id, {', '.join(f'{x} AS {n}_' for n, x in _IDENTITY.items())} FROM {_PARTS})""")
def h5_identity_hash(spark, sf_dir):
    """H4 + H5: identity components, canonical at any depth, and their SHA-256."""
    r = RU.with_identity(runs(spark, sf_dir))
    return r.select("run_id", "identity_hash", F.to_json("identity").alias("identity"))


def _requested(spark, sf_dir):
    """The configuration a resumed run asks for: some runs changed temperature or model."""
    r = runs(spark, sf_dir)
    k = F.regexp_extract("run_id", r"(\d+)", 1).cast("bigint")
    return r.withColumns({
        "temperature": F.when(k % 5 == 3, F.col("temperature") + F.lit(0.1)).otherwise(F.col("temperature")),
        "model": F.when(k % 7 == 2, F.concat(F.col("model"), F.lit("-v2"))).otherwise(F.col("model")),
    })


@query("j5_identity_check", oracle=_RUNS + """
SELECT run_id, NOT (k % 5 = 3 OR k % 7 = 2) AS resumable,
       array_to_string(list_filter([CASE WHEN k % 5 = 3 THEN 'generation' END, CASE WHEN k % 7 = 2 THEN 'model' END],
                                   lambda x: x IS NOT NULL), ',') AS changed
FROM (SELECT run_id, CAST(substr(run_id, 4) AS BIGINT) AS k FROM runs)""")
def j5_identity_check(spark, sf_dir):
    """J5 + J7 + W6: stored header vs requested run (some runs changed temperature or model);
    the identity hash must differ exactly there, and the changed keys come out in key order."""
    stored = RU.with_identity(runs(spark, sf_dir))
    current = RU.with_identity(_requested(spark, sf_dir))
    return RU.identity_check(stored, current).drop("changes")


_VALID = f"len({_sql_violations()}) = 0 AND len({_sql_protected()}) = 0"
_FMT = SP.format_prompt("dp.problem", "r.evaluator_type", "dp.test_list")
_BUDGET = SP.budget(_FMT, "r.max_output_tokens", "r.max_context_window")


def _sql_request(prompt: str, budget: str, masked: bool) -> str:
    """The request's text, members sorted, after the overrides of F7 that valid runs may have (masked: as it is shown)."""
    text = lambda x: f"to_json({x})::VARCHAR"
    hide = lambda x: f"'\"{MASK}\"'" if masked else x
    is_ = lambda *names: f"provider IN ({', '.join(sq(n) for n in names)})"
    unset = "list_contains(overrides_unset, 'temperature')"
    body = ("'{' || array_to_string(list_filter([CASE WHEN k % 3 = 1 THEN '\"api_token\":' || " + hide("'\"tok-' || k || '\"'") + " END, CASE WHEN k % 5 = 2 THEN '\"options\":{\"list\":[{\"secret\":' || "
            + hide("'\"s\"'") + " || '},2],\"max_tokens\":' || p_size || ',\"nested\":{\"keep\":1,\"password\":' || " + hide("'\"pw' || k || '\"'")
            + " || '}}' END], lambda x: x IS NOT NULL), ',') || '}'")
    members = [
        ("config", is_("gemini"), f"'{{\"max_output_tokens\":' || {budget} || ',\"temperature\":' || temperature || coalesce(',\"top_p\":' || top_p, '') || '}}'"),
        ("contents", is_("gemini"), text(prompt)), ("extra_body", "k % 3 = 1 OR k % 5 = 2", body),
        ("extra_headers", "k % 2 = 0", "'{\"Authorization\":' || " + hide("'\"Bearer tok' || k || '\"'") + " || ',\"X-Trace\":\"t' || k || '\"}'"),
        ("input", is_("openai-responses"), text(prompt)), ("max_completion_tokens", "k % 4 = 1", f"{budget}::VARCHAR"), ("max_output_tokens", is_("openai-responses"), f"{budget}::VARCHAR"),
        ("max_tokens", is_("chat_completion", "anthropic"), f"{budget}::VARCHAR"), ("messages", is_("chat_completion", "anthropic"), f"'[{{\"content\":' || {text(prompt)} || ',\"role\":\"user\"}}]'"),
        ("metadata", "k % 4 = 2", f"'{{\"note\":\"budget ' || {budget} || ' tokens\"}}'"), ("model", "true", text("model")), ("reasoning", "true", "'{\"effort\":' || to_json(lower(p_type))::VARCHAR || '}'"),
        ("stream", f"NOT ({is_('gemini')}) OR k % 8 = 3", f"CASE WHEN {is_('gemini')} THEN 'false' ELSE 'true' END"), ("stream_options", is_("chat_completion"), "'{\"include_usage\":true}'"),
        ("temperature", f"({is_('chat_completion', 'openai-responses')}) AND NOT {unset}", "temperature::VARCHAR"), ("thinking", is_("anthropic"), "'{\"display\":\"summarized\",\"type\":\"adaptive\"}'"),
        ("top_p", f"({is_('chat_completion')}) AND top_p IS NOT NULL", "top_p::VARCHAR")]
    arms = ", ".join(f"CASE WHEN {cond} THEN '\"{name}\":' || {value} END" for name, cond, value in members)
    return f"'{{' || array_to_string(list_filter([{arms}], lambda x: x IS NOT NULL), ',') || '}}'".replace("\\", "")


_SAMPLE_TESTS = f"CASE WHEN evaluator_type = 'code' THEN [{', '.join(sq(t) for t in RU.SAMPLE_TESTS)}] END"


@query("q9_inspect", oracle=_RUNS + f"""
SELECT run_id, provider, model, {_sql_redact_url('base_url')} AS base_url, CASE WHEN coalesce(length(api_key), 0) > 0 THEN '{MASK}' END AS api_key, evaluator_type,
  budget AS max_output_tokens, {_sql_request('prompt', 'budget', True)} AS request
FROM (SELECT *, {SP.budget('prompt', 'max_output_tokens', 'max_context_window')} AS budget
      FROM (SELECT *, {SP.format_prompt(sq(RU.SAMPLE_PROBLEM), 'evaluator_type', _SAMPLE_TESTS)} AS prompt FROM {_PARTS} WHERE {_VALID}))""")
def q9_inspect(spark, sf_dir):
    """Q9: masked request per valid run for the fixed sample problem, the whole text."""
    return RU.inspect_requests(runs(spark, sf_dir))


@query("q5_override", bench=True, oracle=Q.with_ctes(Q.RUNS, Q.PROBLEMS, Q.DATASET_PROBLEMS) + f"""
SELECT run_id, item_id, budget, sha256(request) AS request_sha, length(request)::BIGINT AS request_chars
FROM (SELECT *, {_sql_request('prompt', 'budget', False)} AS request
      FROM (SELECT r.*, dp.item_id, {_FMT} AS prompt, {_BUDGET} AS budget FROM (SELECT * FROM {_PARTS} WHERE {_VALID}) r JOIN dataset_problems dp ON dp.dataset_path = r.dataset_path))""")
def q5_override(spark, sf_dir):
    """Q1-Q8 end to end: shaped request per run × problem of its dataset."""
    req = RU.build_requests(runs(spark, sf_dir), dataset_problems(spark, sf_dir))
    return req.select("run_id", "item_id", "budget", F.sha2("request", 256).alias("request_sha"),
                      F.length("request").cast("bigint").alias("request_chars"))


@query("q7_substitution", oracle=Q.with_ctes(Q.RUNS, Q.PROBLEMS, Q.DATASET_PROBLEMS) + f"""
SELECT r.run_id, dp.item_id, {_BUDGET} AS budget,
  CASE WHEN list_contains(list_transform(r.overrides_entries, lambda e: e.key), 'max_completion_tokens')
       THEN {_BUDGET} END AS max_completion_tokens,
  CASE WHEN list_contains(list_transform(r.overrides_entries, lambda e: e.key), 'metadata.note')
       THEN 'budget ' || CAST({_BUDGET} AS VARCHAR) || ' tokens' END AS note,
  CASE WHEN list_contains(r.overrides_unset, 'temperature') THEN false
       ELSE r.provider IN ('chat_completion', 'openai-responses') END AS has_temperature
FROM (SELECT * FROM runs WHERE {_VALID}) r JOIN dataset_problems dp ON dp.dataset_path = r.dataset_path""")
def q7_substitution(spark, sf_dir):
    """Q5-Q7 checked field by field: typed exact placeholder, textual embedded one, unset."""
    req = RU.build_requests(runs(spark, sf_dir), dataset_problems(spark, sf_dir))
    # One parse per request; string fields keep a value's JSON text, as ``get_json_object`` does.
    f = F.from_json("request", "max_completion_tokens STRING, metadata STRUCT<note: STRING>, temperature STRING")
    return req.select("run_id", "item_id", "budget",
                      f["max_completion_tokens"].cast("bigint").alias("max_completion_tokens"),
                      f["metadata"]["note"].alias("note"),
                      f["temperature"].isNotNull().alias("has_temperature"))


@query("q1_requests", oracle=Q.with_ctes(Q.RUNS, Q.PROBLEMS, Q.DATASET_PROBLEMS) + f"""
SELECT r.run_id, dp.item_id, r.provider,
  json_extract_string(req, '$.model') AS model, CAST(json_extract(req, '$.stream') AS BOOLEAN) AS stream,
  coalesce(json_extract_string(req, '$.messages[0].content'), json_extract_string(req, '$.input'),
           json_extract_string(req, '$.contents')) = {_FMT} AS prompt_placed,
  CAST(coalesce(json_extract(req, '$.max_tokens'), json_extract(req, '$.max_output_tokens'),
                json_extract(req, '$.config.max_output_tokens')) AS BIGINT) AS budget_field,
  CASE WHEN r.provider <> 'anthropic' THEN temperature END AS temperature,
  CASE WHEN r.provider IN ('chat_completion', 'gemini') THEN top_p END AS top_p,
  CASE WHEN r.provider = 'anthropic' THEN 'adaptive/summarized' END AS thinking,
  CASE WHEN r.provider = 'chat_completion' THEN true END AS include_usage,
  CASE WHEN r.provider IN ('chat_completion', 'anthropic') THEN 'user' END AS role
FROM (SELECT *, '{{"model":' || to_json(model) || ',"stream":' || CASE WHEN provider = 'gemini' THEN 'null' ELSE 'true' END
        || '}}' AS req_head FROM runs WHERE {_VALID}) r
JOIN dataset_problems dp ON dp.dataset_path = r.dataset_path,
LATERAL (SELECT CASE r.provider
    WHEN 'gemini' THEN '{{"model":' || to_json(r.model) || ',"contents":' || to_json({_FMT}) || ',"config":{{"max_output_tokens":' || CAST({_BUDGET} AS VARCHAR) || '}}}}'
    WHEN 'openai-responses' THEN '{{"model":' || to_json(r.model) || ',"input":' || to_json({_FMT}) || ',"max_output_tokens":' || CAST({_BUDGET} AS VARCHAR) || ',"stream":true}}'
    ELSE '{{"model":' || to_json(r.model) || ',"messages":[{{"role":"user","content":' || to_json({_FMT}) || '}}],"max_tokens":' || CAST({_BUDGET} AS VARCHAR) || ',"stream":true}}'
  END AS req) x""")
def q1_requests(spark, sf_dir):
    """Q1-Q4: base request per provider (before overrides), checked field by field."""
    r = RU.valid_runs(runs(spark, sf_dir))
    from ..functions import prompts as P
    rs = r.select("run_id", "dataset_path", "provider", "model", "evaluator_type", "temperature", "top_p",
                  "max_output_tokens", "max_context_window")
    dp = dataset_problems(spark, sf_dir).select("dataset_path", "item_id", "problem", "test_list")
    j = spread(dp).join(rs, "dataset_path")
    j = j.withColumn("prompt", P.format_prompt("problem", "evaluator_type", "test_list"))
    j = j.withColumn("budget", P.output_budget("prompt", "max_output_tokens", "max_context_window"))
    j = j.withColumn("req", RU.base_request("provider", "model", "prompt", "budget", "temperature", "top_p"))
    j = j.withColumn("_v", F.try_parse_json("req"))  # one parse, many lookups
    g = lambda p: F.try_variant_get("_v", p, "string")
    return j.select("run_id", "item_id", "provider", g("$.model").alias("model"),
                    g("$.stream").cast("boolean").alias("stream"),
                    (F.coalesce(g("$.messages[0].content"), g("$.input"), g("$.contents")) == F.col("prompt"))
                    .alias("prompt_placed"),
                    F.coalesce(g("$.max_tokens"), g("$.max_output_tokens"), g("$.config.max_output_tokens"))
                    .cast("bigint").alias("budget_field"),
                    F.coalesce(g("$.temperature"), g("$.config.temperature")).cast("double").alias("temperature"),
                    F.coalesce(g("$.top_p"), g("$.config.top_p")).cast("double").alias("top_p"),
                    F.concat(g("$.thinking.type"), F.lit("/"), g("$.thinking.display")).alias("thinking"),
                    g("$.stream_options.include_usage").cast("boolean").alias("include_usage"),
                    g("$.messages[0].role").alias("role"))


# The base override layer (preset) every run starts from.
BASE_SET = (("reasoning.effort", '"low"'), ("temperature", "0.5"))
BASE_UNSET = ("top_p",)


@query("q8_merge", oracle=_RUNS + f"""
SELECT run_id,
  array_to_string(list_sort(list_transform(list_concat(
      list_filter([{', '.join(f"{{'key': {sq(k)}, 'value': {sq(v)}}}" for k, v in BASE_SET)}],
                  lambda e: NOT list_contains(list_transform(overrides_entries, lambda c: c.key), e.key)),
      overrides_entries), lambda e: e.key || '=' || e.value)), '|') AS merged_set,
  array_to_string(list_filter(list_concat([{', '.join(sq(p) for p in BASE_UNSET)}],
      list_filter(overrides_unset, lambda p: NOT list_contains([{', '.join(sq(p) for p in BASE_UNSET)}], p))),
      lambda p: NOT (list_contains(list_transform(overrides_entries, lambda c: c.key), p)
                     AND NOT list_contains(overrides_unset, p))), '|') AS merged_unset
FROM runs""")
def q8_merge(spark, sf_dir):
    """Q8: preset layer overlaid by each run's own overrides."""
    r = runs(spark, sf_dir)
    base_set = F.create_map(*[x for k, v in BASE_SET for x in (F.lit(k), F.lit(v))])
    base_unset = F.array(*[F.lit(p) for p in BASE_UNSET])
    m = RU.merge_overrides(base_set, base_unset, "overrides_set", "overrides_unset")
    r = r.withColumn("m", m)
    merged = F.array_join(F.array_sort(F.transform(F.map_entries("m.set"),
                                                   lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")
    return r.select("run_id", merged.alias("merged_set"), F.array_join("m.unset", "|").alias("merged_unset"))
