"""Derived views over the driver tables (Spark side).

Each view is defined by a rule over a driver table so its size grows with the
data; the identical rule in SQL lives in :mod:`ledgerlens.plans.fixture_sql` and
feeds the DuckDB oracle.  All arithmetic is on non-negative integers.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from ..sources.tables import table


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# The legacy judge failure text stored in ``error`` by old ledgers.
LEGACY_JUDGE_ERROR = "judge: no JSON object in response"


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the attempt ledger, one attempt per event."""
    e = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k BIGINT")["k"])
    eid = F.col("event_id")
    et = F.col("event_type")
    k = F.col("k")
    http = (et == "error") & (eid % 3 != 0)
    error = (F.when(http, F.lit("HTTP 500"))
             .when(et == "error", F.lit(LEGACY_JUDGE_ERROR))
             .when(eid % 13 == 0, F.lit(""))
             .otherwise(F.lit(None).cast("string")))
    prompt = F.lit(10) + k
    answer = eid % 500
    reasoning = k * 37
    return e.select(
        F.concat(F.lit("run"), _s(eid % 4)).alias("run_id"),
        F.concat(F.lit("p"), _s("user_id")).alias("problem_key"),
        eid.alias("seq"),
        F.concat(F.lit("q"), _s("user_id")).alias("question"),
        _s(F.col("user_id") % 10).alias("ground_truth"),
        F.when(eid % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("r"), _s(eid))).alias("model_response"),
        (et == "purchase").alias("correct"),
        prompt.cast("bigint").alias("prompt_tokens"),
        answer.cast("bigint").alias("answer_tokens"),
        reasoning.cast("bigint").alias("reasoning_tokens"),
        F.when(eid % 5 == 0, F.lit(0)).otherwise(answer + reasoning).cast("bigint").alias("output_tokens"),
        F.when(eid % 7 == 0, F.lit(0)).otherwise(prompt + answer + reasoning).cast("bigint").alias("total_tokens"),
        F.col("value").alias("latency"),
        error.alias("error"),
        F.when((et == "signup") & (eid % 2 == 0), F.lit("judge timeout")).alias("evaluator_error"),
        F.when(http, F.lit("error")).otherwise(F.lit("answer_block")).alias("extraction_method"),
        F.when(http, F.lit("error")).otherwise(F.lit("stop")).alias("finish_reason"),
    )


def run_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem set per run for resume planning: every customer is one problem of one run."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.concat(F.lit("run"), _s(F.col("c_custkey") % 4)).alias("run_id"),
        F.concat(F.lit("p"), _s("c_custkey")).alias("problem_key"),
        F.col("c_name").alias("problem"),
        F.col("c_mktsegment").alias("answer"),
    )


def _json_int(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'"{name}": '), _s(value))


def usage_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one provider usage payload per line item (four JSON shapes, absent fields common)."""
    li = spread(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    ok, ln = F.col("l_orderkey"), F.col("l_linenumber")
    p = F.col("l_partkey") % 97
    c = F.col("l_quantity").cast("bigint")
    r = F.col("l_suppkey") % 60
    t = (F.when(ok % 4 == 0, F.lit(0).cast("bigint")).when(ok % 4 == 1, p + c)
         .when(ok % 4 == 2, p + c + (ok % 7) * 11 + 1).otherwise(p))
    has_r = (ok + ln) % 3 != 0
    cache = (ok * 7 + ln) % 10 == 0
    cc = F.col("l_partkey") % 50
    c5 = F.floor(cc / 2).cast("bigint")

    def opt(cond, piece):
        return F.when(cond, piece).otherwise(F.lit(""))

    chat = F.concat(F.lit("{"), _json_int("prompt_tokens", p), F.lit(", "), _json_int("completion_tokens", c),
                    F.lit(", "), _json_int("total_tokens", t),
                    opt(has_r, F.concat(F.lit(', "completion_tokens_details": {'),
                                        _json_int("reasoning_tokens", r), F.lit("}"))), F.lit("}"))
    resp = F.when(ok % 5 == 0, F.lit(None).cast("string")).otherwise(F.concat(
        F.lit("{"), _json_int("input_tokens", p), F.lit(", "), _json_int("output_tokens", c),
        F.lit(", "), _json_int("total_tokens", t),
        opt(has_r, F.concat(F.lit(', "output_tokens_details": {'), _json_int("reasoning_tokens", r), F.lit("}"))),
        F.lit("}")))
    gem = (F.when(ok % 3 == 0, F.concat(
        F.lit("{"), _json_int("prompt_token_count", p), F.lit(", "), _json_int("candidates_token_count", c),
        F.lit(", "), _json_int("total_token_count", t),
        opt(has_r, F.concat(F.lit(", "), _json_int("thoughts_token_count", r))), F.lit("}")))
        .when(ok % 3 == 1, F.concat(
            F.lit('{"prompt_token_count": 0, '), _json_int("prompt_tokens", p), F.lit(", "),
            _json_int("completion_tokens", c), F.lit(", "), _json_int("total_tokens", t), F.lit("}")))
        .otherwise(F.concat(
            F.lit("{"), _json_int("input_tokens", p), F.lit(", "), _json_int("output_tokens", c),
            opt(has_r, F.concat(F.lit(", "), _json_int("thoughts_token_count", r))), F.lit("}"))))
    msg = F.concat(
        F.lit("{"), _json_int("input_tokens", p), F.lit(", "), _json_int("output_tokens", c),
        opt(has_r, F.concat(F.lit(', "output_tokens_details": {'), _json_int("thinking_tokens", r), F.lit("}"))),
        opt(cache, F.concat(F.lit(", "), _json_int("cache_creation_input_tokens", cc), F.lit(", "),
                            _json_int("cache_read_input_tokens", F.col("l_suppkey") % 40),
                            F.lit(', "cache_creation": {'), _json_int("ephemeral_5m_input_tokens", c5),
                            F.lit(", "), _json_int("ephemeral_1h_input_tokens", cc - c5), F.lit("}"))),
        F.lit("}"))
    m = ln % 4
    provider = (F.when(m == 0, F.lit("chat_completion")).when(m == 1, F.lit("openai-responses"))
                .when(m == 2, F.lit("gemini")).otherwise(F.lit("anthropic")))
    usage = F.when(m == 0, chat).when(m == 1, resp).when(m == 2, gem).otherwise(msg)
    text = F.when(ok % 9 == 0, F.lit("")).otherwise(F.repeat(F.lit("x"), (ln * 5).cast("int")))
    return li.select(ok.alias("l_orderkey"), ln.alias("l_linenumber"), provider.alias("provider"),
                     usage.alias("usage"), text.alias("final_text"))


# Response tails appended to document text (F2 multiple choice, by doc_id % 12).
# Placeholder L is the letter the response commits to.
MCQ_TAILS = (
    "\n\n<answer>{L}</answer>",
    "\n\nThe answer is {L}.",
    "\n\nAnswer: ({L})",
    "\n\nFinal Answer: {L}",
    "\n\nI choose {L}",
    "\n\nOption {L}.",
    "\n\n\\boxed{{L}}",
    "\n\n{L}.",
    "\n\nThus {L} is right",
    "\n\nmy guess: {L} maybe",
    "\n\nno idea here",
    "",
)
# F2 math responses (by doc_id % 5); N is the committed value, ID the document id.
MATH_TAILS = (
    "\n<answer>{N}</answer>",
    "<answer>first</answer> then <answer>{N}</answer>",
    "<answer>{ID}</answer> and <answer>   </answer>",
    "<ANSWER>\n  {N}\n</ANSWER>",
    "",
)
# F2c code responses (by doc_id % 7).
CODE_TAILS = (
    "\n<solution>\ndef f(x):\n    return x + 1\n</solution>",
    "\n```python\ndef f(x):\n    return x + 1\n```\n",
    "\n```\nimport math\ndef f(x):\n    return x + 1\n```",
    "\n\ndef f(x):\n    y = x + 1\n    return y\n\nThat is all.",
    "\nclass F:\n    def f(self, x):\n        return x + 1\n",
    "",
    "\ndef\tf(x):\n    return x + 1\nDone.",
)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One multiple-choice, one math and one code response per document."""
    from .templates import case_spark
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    did = F.col("doc_id")
    body = F.col("text")
    letter = F.expr("chr(65 + (doc_id * 7) % 4)")
    vals = {"L": letter, "N": did % 97, "ID": did}
    mcq = F.when(did % 12 == 11, F.lit("")).otherwise(F.concat(body, case_spark(did % 12, MCQ_TAILS, vals)))
    math = F.when(did % 23 == 0, F.lit("")).otherwise(F.concat(body, case_spark(did % 5, MATH_TAILS, vals)))
    code = F.concat(body, case_spark(did % 7, CODE_TAILS, vals))
    tests = F.transform(F.sequence(F.lit(1).cast("bigint"), did % 4 + 1),
                        lambda i: F.concat(F.lit("assert f("), i.cast("string"), F.lit(") == "),
                                           (i + 1).cast("string")))
    return d.select(
        did.alias("doc_id"),
        F.concat(F.lit("Compute item "), did.cast("string"), F.lit(" ("), F.col("lang"), F.lit(")")).alias("question"),
        F.expr("chr(65 + doc_id % 4)").alias("truth"),
        (did % 97).cast("string").alias("math_truth"),
        mcq.alias("mcq_response"), math.alias("math_response"), code.alias("code_response"),
        tests.alias("tests"))


# Stream lines per protocol (F5), indexed by event kind:
# click 0, view 1, signup 2, purchase 3 + k % 4, error 7 + event_id % 3.
CHAT_LINES = (
    'data: {"id": "c{ID}", "model": "m-{M}", "choices": [{"index": 0, "delta": {"content": "t{ID} "}, "finish_reason": null}]}',
    'data: {"id": "c{ID}", "model": "", "choices": [{"index": 0, "delta": {"content": "v{ID} "}, "finish_reason": null}]}',
    'data: {"id": "c{ID}", "model": "m-{M}", "choices": [{"index": 0, "delta": {"reasoning_content": "think{ID}"}, "finish_reason": null}]}',
    'data: {"id": "c{ID}", "model": "m-{M}", "choices": [{"index": 0, "delta": {}, "finish_reason": "stop"}], "usage": {"prompt_tokens": {K}, "completion_tokens": {K2}, "total_tokens": {K3}}}',
    'data: {"id": "c{ID}", "model": "m-{M}", "choices": [{"index": 0, "delta": {}, "finish_reason": "length"}], "usage": {"prompt_tokens": {K}, "completion_tokens": {K2}, "total_tokens": {K3}, "completion_tokens_details": {"reasoning_tokens": {KR}}}}',
    'data: {"id": "c{ID}", "model": "m-{M}", "choices": [], "usage": {"prompt_tokens": {K}, "completion_tokens": {K2}, "total_tokens": {K3}, "completion_tokens_details": {"reasoning_tokens": {KR}}}}',
    'data: {"id": "c{ID}", "model": "m-{M}", "choices": [{"index": 0, "delta": {"content": ""}, "finish_reason": "length"}]}',
    "data: [DONE]",
    ": keep-alive",
    'data: {"id": "c{ID}", "choices": [ broken',
)
RESPONSES_LINES = (
    'data: {"type": "response.output_text.delta", "delta": "t{ID} "}',
    'data: {"type": "response.output_text.delta", "delta": "v{ID} "}',
    'data: {"type": "response.reasoning_text.delta", "delta": "think{ID}"}',
    'data: {"type": "response.completed", "response": {"model": "m-{M}", "status": "completed", "usage": {"input_tokens": {K}, "output_tokens": {K2}, "total_tokens": {K3}, "output_tokens_details": {"reasoning_tokens": {KR}}}}}',
    'data: {"type": "response.incomplete", "response": {"model": "m-{M}", "status": "incomplete", "incomplete_details": {"reason": "max_output_tokens"}, "usage": {"input_tokens": {K}, "output_tokens": {K2}, "total_tokens": {K3}}}}',
    'data: {"type": "response.incomplete", "response": {"incomplete_details": {"reason": "content_filter"}, "usage": {"input_tokens": {K}, "output_tokens": {K2}}}}',
    'data: {"type": "response.failed", "response": {"model": "m-{M}", "status": "failed", "error": {"message": "overloaded {ID}"}}}',
    "data: [DONE]",
    "event: response.in_progress",
    'data: {"type": "response.output_text.delta", "delta": broken',
)
MESSAGES_LINES = (
    'data: {"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": "t{ID} "}}',
    'data: {"type": "message_start", "message": {"model": "m-{M}", "usage": {"input_tokens": {K}, "cache_creation_input_tokens": {K4}, "cache_read_input_tokens": {K5}, "cache_creation": {"ephemeral_5m_input_tokens": {C5}, "ephemeral_1h_input_tokens": {C1}}}}}',
    'data: {"type": "content_block_delta", "index": 0, "delta": {"type": "thinking_delta", "thinking": "think{ID}"}}',
    'data: {"type": "message_delta", "delta": {"stop_reason": "end_turn"}, "usage": {"output_tokens": {K2}, "output_tokens_details": {"thinking_tokens": {KT}}}}',
    'data: {"type": "message_delta", "delta": {"stop_reason": "max_tokens"}, "usage": {"output_tokens": {K2}}}',
    'data: {"type": "message_start", "message": {"usage": {"input_tokens": {K}}}}',
    'data: {"type": "message_delta", "delta": {"stop_reason": null}, "usage": {"output_tokens": {K2}, "output_tokens_details": {"thinking_tokens": {KX}}}}',
    "data: [DONE]",
    "event: ping",
    'data: {"type": "message_delta", broken',
)
STREAM_LINES = {"chat": CHAT_LINES, "responses": RESPONSES_LINES, "messages": MESSAGES_LINES}


def chunk_values(k: Column, eid: Column) -> dict[str, Column]:
    return {"ID": eid, "M": k % 3, "K": k, "K2": k * 2, "K3": k * 3 + k % 5, "KR": k % 7, "KT": k % 9,
            "KX": k * 3 + 1, "K4": k % 50, "K5": k % 40, "C5": F.floor((k % 50) / 2).cast("bigint"),
            "C1": k % 50 - F.floor((k % 50) / 2).cast("bigint")}


def chunk_lines(spark: SparkSession, sf_dir: str, protocol: str) -> DataFrame:
    """one stream line per event; request = user, order = event id."""
    from .templates import case_spark
    e = spread(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props", "ts"))
    e = e.withColumn("k", F.from_json("props", "k BIGINT")["k"])
    et, eid, k = F.col("event_type"), F.col("event_id"), F.col("k")
    kind = (F.when(et == "click", 0).when(et == "view", 1).when(et == "signup", 2)
            .when(et == "purchase", k % 4 + 3).otherwise(eid % 3 + 7))
    line = case_spark(kind, STREAM_LINES[protocol], chunk_values(k, eid))
    return e.select(F.col("user_id").alias("request_id"), eid.alias("seq"), line.alias("line"), "ts")


# Judge outputs (F6, by doc_id % 10); N is the answer the judge extracted.
JUDGE_OUTPUTS = (
    '{"correct": true, "extracted_answer": "{N}", "reasoning": "matches the reference"}',
    '```json\n{"correct": false, "extracted_answer": "{N}", "reasoning": "off by one"}\n```',
    '```\n{"correct": "yes", "extracted_answer": "{N}", "reasoning": "same value"}\n```',
    'Here is my verdict: {"correct": true, "extracted_answer": "{N}", "reasoning": "fine"} hope it helps',
    '{"correct": false, "reasoning": "first look"} and then {"correct": true, "extracted_answer": "{N}", "reasoning": "second look"}',
    '{"correct": false, "extracted_answer": "x = m^{N}", "reasoning": "The student\'s answer does not ma',
    '{"correct": "False ", "extracted_answer": "{N}", "reasoning": "string boolean"}',
    '{"correct": 1, "extracted_answer": {N}, "reasoning": "numeric one"}',
    "I cannot grade this answer.",
    '[true, "{N}"]',
)


def judge_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one judge output per document (blank on every 31st)."""
    from .templates import case_spark
    d = spread(table(spark, sf_dir, "documents").select("doc_id"))
    did = F.col("doc_id")
    content = F.when(did % 31 == 0, F.lit("")).otherwise(case_spark(did % 10, JUDGE_OUTPUTS, {"N": did % 97}))
    return d.select(did.alias("doc_id"), content.alias("content"))


# Evaluator type of a benchmark problem (by item_id % 4).
EVALUATOR_TYPES = ("math", "science", "code", "custom")


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: problem set from ``benchmark`` (every 5th problem already carries an assert)."""
    b = table(spark, sf_dir, "benchmark")
    iid = F.col("item_id")
    text = F.when(iid % 5 == 0, F.concat(F.col("text"), F.lit("\nassert f(0) == 1"))).otherwise(F.col("text"))
    tests = F.transform(F.sequence(F.lit(1).cast("bigint"), iid % 4 + 1),
                        lambda i: F.concat(F.lit("assert f("), i.cast("string"), F.lit(") == "),
                                           (i + 1).cast("string")))
    et = F.element_at(F.array(*[F.lit(x) for x in EVALUATOR_TYPES]), (iid % 4 + 1).cast("int"))
    return b.select(iid.alias("item_id"), text.alias("problem"), F.expr("chr(65 + item_id % 4)").alias("answer"),
                    et.alias("evaluator_type"), tests.alias("test_list"),
                    F.when(iid % 3 == 0, F.array(F.lit("assert f(9) == 10"))).otherwise(
                        F.array().cast("array<string>")).alias("challenge_test_list"),
                    F.when(iid % 6 == 0, tests).alias("test_cases"),
                    F.when(iid % 2 == 0, (iid % 7 + 1) * 1000).cast("bigint").alias("max_context_window"),
                    F.when(iid % 2 == 1, (iid % 5 + 1) * 512).cast("bigint").alias("max_output_tokens"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a user turn and the assistant turn right after it (equi join on conv, turn + 1)."""
    c = table(spark, sf_dir, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return u.join(a, ["conv_id", "turn"], "inner")


# Provider of a run (by p_partkey % 4) and evaluator (by p_size % 3).
RUN_PROVIDERS = ("chat_completion", "openai-responses", "anthropic", "gemini")
RUN_EVALUATORS = ("math", "science", "code")
# Override entries (path, JSON value template, p_partkey modulus, remainder); T is lower(p_type),
# K the part key, S the part size.
OVERRIDE_SET_RULES = (
    ("reasoning.effort", '"{T}"', 1, 0),
    ("extra_headers", '{"Authorization": "Bearer tok{K}", "X-Trace": "t{K}"}', 2, 0),
    ("extra_body.api_token", '"tok-{K}"', 3, 1),
    ("extra_body.options", '{"max_tokens": {S}, "nested": {"password": "pw{K}", "keep": 1}, "list": [{"secret": "s"}, 2]}', 5, 2),
    ("max_completion_tokens", '"${max_output_tokens}"', 4, 1),
    ("metadata.note", '"budget ${max_output_tokens} tokens"', 4, 2),
    ("model", '"evil"', 9, 0),
    ("stream", "false", 8, 3),
    ("   ", "1", 13, 0),
)
OVERRIDE_UNSET_RULES = (("temperature", 3, 0), ("messages.0", 10, 0), ("stream_options", 7, 1))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the run registry — one run configuration per part (base URL from ``pages``)."""
    from .templates import render_spark
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    pg = table(spark, sf_dir, "pages").select(F.col("page_id").alias("p_partkey"), "url")
    # spread behind the join: its small rows would be coalesced to few tasks, and what is done per run is much more than its bytes tell
    j = spread(p.join(pg, "p_partkey", "left"))
    k, size = F.col("p_partkey"), F.col("p_size")
    vals = {"T": F.lower(F.col("p_type")), "K": k, "S": size}
    entries = F.filter(F.array(*[
        F.when(k % mod == rem, F.struct(F.lit(path).alias("key"), render_spark(tpl, vals).alias("value")))
        for path, tpl, mod, rem in OVERRIDE_SET_RULES]), lambda e: e.isNotNull())
    unset = F.filter(F.array(*[F.when(k % mod == rem, F.lit(path)) for path, mod, rem in OVERRIDE_UNSET_RULES]),
                     lambda x: x.isNotNull())
    u0 = F.regexp_replace(F.col("url"), "#.*$", "")
    u1 = F.when(k % 3 == 0, F.replace(u0, F.lit("://"), F.concat(F.lit("://user:pw"), k.cast("string"), F.lit("@")))).otherwise(u0)
    u2 = F.when(k % 4 == 0, F.concat(u1, F.when(u1.contains("?"), F.lit("&")).otherwise(F.lit("?")),
                                     F.lit("api_key=SECRET"), k.cast("string"), F.lit("&max_tokens="),
                                     size.cast("string"))).otherwise(u1)
    u2 = F.concat(u2, F.regexp_extract(F.col("url"), "(#.*)$", 1))  # the fragment, after what is planted
    u2 = F.when(k % 13 == 5, F.regexp_replace(u2, "^[a-z]+://", "")).when(k % 13 == 6, F.regexp_replace(u2, "^[a-z]+:", "")).otherwise(u2)
    et = F.element_at(F.array(*[F.lit(x) for x in RUN_EVALUATORS]), (size % 3 + 1).cast("int"))
    math = et == "math"
    return j.select(
        F.concat(F.lit("run"), k.cast("string")).alias("run_id"),
        F.element_at(F.array(*[F.lit(x) for x in RUN_PROVIDERS]), (k % 4 + 1).cast("int")).alias("provider"),
        F.lower(F.regexp_replace("p_brand", "#", "-")).alias("model"),
        F.concat(F.lit("data/"), F.lower("p_type"), F.lit(".jsonl")).alias("dataset_path"),
        F.when(k % 2 == 1, F.lower("p_type")).alias("dataset_name"),
        F.when(k % 3 == 0, F.lit("test")).alias("dataset_split"),
        et.alias("evaluator_type"),
        ((size % 25) / F.lit(10.0)).alias("temperature"),
        F.when(k % 2 == 1, (k % 12) / F.lit(10.0)).alias("top_p"),
        F.when(k % 5 != 1, F.when(k % 5 != 4, size * 100)).cast("bigint").alias("max_output_tokens"),
        F.when(k % 5 == 0, F.lit(32000)).when(k % 5 == 4, size * 1000).cast("bigint").alias("max_context_window"),
        F.when(k % 6 != 0, F.concat(F.lit("sk-"), k.cast("string"))).alias("api_key"),
        u2.alias("base_url"),
        F.when(k % 7 == 0, F.lit(300)).cast("bigint").alias("wall_clock_timeout"),
        (size % 3 + 5).cast("bigint").alias("execution_timeout"),
        (k % 20 + 5).cast("bigint").alias("concurrency"),
        F.lit(120).cast("bigint").alias("timeout"),
        (k % 3 + 1).cast("bigint").alias("max_retries"),
        F.when(k % 11 == 0, F.lit("high")).alias("legacy_reasoning_effort"),
        F.when(k % 17 == 3, F.lit("true")).alias("legacy_enable_thinking"),
        F.when(k % 19 == 7, F.lit(0)).cast("bigint").alias("judge_max_tokens"),
        F.when(k % 23 == 5, F.lit(-1)).cast("bigint").alias("judge_timeout"),
        F.map_from_entries(entries).alias("overrides_set"),
        unset.alias("overrides_unset"),
        F.when(math & (k % 9 != 4), F.concat(F.lit("judge-"), (k % 3).cast("string"))).alias("judge_model"),
        F.when(math & (k % 4 == 2), F.concat(F.lit("https://judge:pw"), k.cast("string"),
                                             F.lit("@judge.example.com/v1")))
        .when(math & (k % 4 != 1), F.lit("https://judge.example.com/v1")).alias("judge_base_url"),
        F.when(math & (k % 5 != 2), F.concat(F.lit("jk-"), k.cast("string"))).alias("judge_api_key"),
    )


# Columns in which sibling runs differ from the run they are made after.
SIBLING_OWN = ("run_id", "model", "api_key", "temperature", "concurrency", "max_retries")


def sibling_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7s: runs that are made after one of five runs and keep only some columns of their own; every seventh has another
    time limit and every eleventh another budget, so it must not be compared with its siblings."""
    own = runs(spark, sf_dir).withColumn("k", F.substring("run_id", 4, 20).cast("bigint"))
    rest = [c for c in own.columns if c not in (*SIBLING_OWN, "k")]
    made_after = own.where("k between 1 and 5").select(F.col("k").alias("_k"), *rest)
    s = own.select(*SIBLING_OWN, "k").join(made_after, F.col("_k") == F.col("k") % 5 + 1)
    return s.withColumns({"wall_clock_timeout": F.when(F.col("k") % 7 == 3, F.lit(900)).otherwise(F.col("wall_clock_timeout")).cast("bigint"),
                          "max_output_tokens": F.when(F.col("k") % 11 == 4, F.coalesce("max_output_tokens", F.lit(0)) + 1).otherwise(F.col("max_output_tokens")).cast("bigint")}).drop("_k", "k")


def dataset_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8 problems placed in the dataset of the part with the same key (joins runs on dataset)."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.concat(F.lit("data/"), F.lower("p_type"), F.lit(".jsonl")).alias("dataset_path"))
    return problems(spark, sf_dir).join(part, "item_id", "inner")


# Recorded provider failures (F9, from error events): status by event_id % 7,
# message by k % 8, finish reason vocabulary by k % 6.
FAILURE_STATUS = (400, 401, 403, 404, 422, 429, 500)
FAILURE_MESSAGES = ("Invalid API key provided", "rate limit exceeded", "peer closed connection",
                    "Internal server error", "ReadTimeout while streaming", "context length exceeded",
                    "upstream returned 429", "Bad gateway")
FINISH_REASONS = ("stop", "length", "max_tokens", "incomplete:max_output_tokens", "FinishReason.MAX_TOKENS",
                  "end_turn")


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one recorded failure per error event, plus the finish reason of its request."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == "error") \
        .withColumn("k", F.from_json("props", "k BIGINT")["k"])
    eid, k = F.col("event_id"), F.col("k")
    return e.select(
        eid.alias("event_id"),
        F.element_at(F.array(*[F.lit(x) for x in RUN_PROVIDERS]), (F.col("user_id") % 4 + 1).cast("int")).alias("provider"),
        F.element_at(F.array(*[F.lit(x) for x in FAILURE_STATUS]), (eid % 7 + 1).cast("int")).cast("bigint").alias("status_code"),
        F.element_at(F.array(*[F.lit(x) for x in FAILURE_MESSAGES]), (k % 8 + 1).cast("int")).alias("message"),
        F.element_at(F.array(*[F.lit(x) for x in FINISH_REASONS]), (k % 6 + 1).cast("int")).alias("finish_reason"),
        (eid % 4).cast("bigint").alias("attempt"),
        F.lit(3).cast("bigint").alias("max_retries"),
        F.col("value").alias("latency"))


def generate_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """non-streamed generate-content responses (text, candidate parts, candidate text)."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    did = F.col("doc_id")
    body = F.col("text")
    m = did % 4
    return d.select(
        did.alias("doc_id"),
        F.when(m == 0, body).otherwise(F.lit("")).alias("text"),
        F.when(m == 1, F.split(body, "\n", -1)).otherwise(F.array().cast("array<string>")).alias("parts"),
        F.when(m == 2, body).alias("candidate_text"),
        F.element_at(F.array(F.lit("FinishReason.STOP"), F.lit("FinishReason.MAX_TOKENS"), F.lit("MAX_TOKENS")),
                     (did % 3 + 1).cast("int")).alias("finish_reason"))
