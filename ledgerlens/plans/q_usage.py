"""Usage-normalisation queries over F4."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import usage as U
from ..functions.text import staged
from . import fixture_sql as Q
from .fixtures import usage_payloads
from .registry import query

_KEYS = ("l_orderkey", "l_linenumber")
_OUT = ("prompt_tokens", "answer_tokens", "reasoning_tokens", "output_tokens", "total_tokens",
        "answer_tokens_estimated", "unattributed_tokens")
_NORM = Q.with_ctes(Q.USAGE_PAYLOADS, Q.USAGE_NORM)
_OUT_SQL = "l_orderkey, l_linenumber, provider, " + ", ".join(_OUT)


def _parsed(spark, sf_dir):
    return usage_payloads(spark, sf_dir).withColumn("u", U.parse_usage("usage"))


def _project(df, struct_col):
    return df.select(*_KEYS, "provider", *[F.col(struct_col)[c].alias(c) for c in _OUT])


@query("n9_all_providers", bench=True, oracle=_NORM + f"SELECT {_OUT_SQL} FROM usage_norm")
def n9_all_providers(spark, sf_dir):
    df = _parsed(spark, sf_dir)
    return _project(U.normalize_usage_frame(df, "provider", "u", "final_text", out="n"), "n")


def _one(provider, fn):
    def run(spark, sf_dir):
        df = _parsed(spark, sf_dir).filter(F.col("provider") == provider)
        return _project(df.withColumn("n", U.fill_usage(fn(df))), "n")
    return run


query("n4_chat_usage", oracle=_NORM + f"SELECT {_OUT_SQL} FROM usage_norm WHERE provider = 'chat_completion'")(
    _one(U.CHAT, lambda df: U.chat_usage("u", "final_text")))
query("n5_responses_usage", oracle=_NORM + f"SELECT {_OUT_SQL} FROM usage_norm WHERE provider = 'openai-responses'")(
    _one(U.RESPONSES, lambda df: U.responses_usage("u", "final_text")))
query("n6_gemini_usage", oracle=_NORM + f"SELECT {_OUT_SQL} FROM usage_norm WHERE provider = 'gemini'")(
    _one(U.GENERATE, lambda df: U.generate_usage("u")))
query("n7_messages_usage", oracle=_NORM + f"SELECT {_OUT_SQL} FROM usage_norm WHERE provider = 'anthropic'")(
    _one(U.MESSAGES, lambda df: U.messages_usage(
        F.col("u.input_tokens"), F.col("u.output_tokens"), F.col("u.output_tokens_details.thinking_tokens"),
        "final_text")))


@query("n1_visible_est", oracle=Q.with_ctes(Q.USAGE_PAYLOADS) + """
SELECT l_orderkey, l_linenumber,
  CASE WHEN coalesce(length(final_text), 0) = 0 THEN 0
       ELSE greatest(1, CAST(ceil(length(final_text) / 4.0) AS BIGINT)) END::BIGINT AS visible_tokens,
  CAST(floor(floor(length(final_text) / 4) * 1.7::DOUBLE) AS BIGINT) AS estimated_tokens
FROM usage_payloads""")
def n1_visible_est(spark, sf_dir):
    df = usage_payloads(spark, sf_dir)
    return df.select(*_KEYS, U.visible_tokens("final_text").alias("visible_tokens"),
                     U.estimate_tokens("final_text").alias("estimated_tokens"))


_CHAT_IN = """
  SELECT l_orderkey, l_linenumber, final_text,
    coalesce(CAST(json_extract(usage, '$.prompt_tokens') AS BIGINT), 0) AS p,
    coalesce(CAST(json_extract(usage, '$.completion_tokens') AS BIGINT), 0) AS o,
    coalesce(CAST(json_extract(usage, '$.completion_tokens_details.reasoning_tokens') AS BIGINT), 0) AS r,
    coalesce(CAST(json_extract(usage, '$.total_tokens') AS BIGINT), 0) AS t
  FROM usage_payloads WHERE provider = 'chat_completion'"""


@query("n2_gap", oracle=Q.with_ctes(Q.USAGE_PAYLOADS) + f"""
SELECT l_orderkey, l_linenumber,
  CAST(o + greatest(t - p - o, 0) AS BIGINT) AS output_tokens,
  CAST(r + greatest(t - p - o, 0) AS BIGINT) AS reasoning_tokens,
  CAST(greatest(t - p - o, 0) AS BIGINT) AS unattributed_tokens
FROM ({_CHAT_IN})""")
def n2_gap(spark, sf_dir):
    df = _parsed(spark, sf_dir).filter(F.col("provider") == U.CHAT)
    z = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    g = U.fold_total_gap(z(F.col("u.prompt_tokens")), z(F.col("u.completion_tokens")),
                         z(F.col("u.completion_tokens_details.reasoning_tokens")), z(F.col("u.total_tokens")))
    return df.select(*_KEYS, g["output_tokens"].alias("output_tokens"),
                     g["reasoning_tokens"].alias("reasoning_tokens"),
                     g["unattributed_tokens"].alias("unattributed_tokens"))


@query("n3_repair", oracle=Q.with_ctes(Q.USAGE_PAYLOADS) + f"""
SELECT l_orderkey, l_linenumber,
  CAST(CASE WHEN greatest(r, 0) <= greatest(o, 0) THEN greatest(o, 0) - greatest(r, 0)
       ELSE least(CASE WHEN coalesce(length(final_text), 0) = 0 THEN 0
                       ELSE greatest(1, CAST(ceil(length(final_text) / 4.0) AS BIGINT)) END, greatest(o, 0)) END AS BIGINT)
    AS answer_tokens,
  CAST(CASE WHEN greatest(r, 0) <= greatest(o, 0) THEN greatest(r, 0)
       ELSE greatest(o, 0) - least(CASE WHEN coalesce(length(final_text), 0) = 0 THEN 0
                       ELSE greatest(1, CAST(ceil(length(final_text) / 4.0) AS BIGINT)) END, greatest(o, 0)) END AS BIGINT)
    AS reasoning_tokens,
  NOT (greatest(r, 0) <= greatest(o, 0)) AS answer_tokens_estimated
FROM ({_CHAT_IN})""")
def n3_repair(spark, sf_dir):
    df = _parsed(spark, sf_dir).filter(F.col("provider") == U.CHAT)
    rep = U.repair_output_split(F.col("u.completion_tokens"), F.col("u.completion_tokens_details.reasoning_tokens"),
                                "final_text")
    return df.select(*_KEYS, rep["answer_tokens"].alias("answer_tokens"),
                     rep["reasoning_tokens"].alias("reasoning_tokens"),
                     rep["answer_tokens_estimated"].alias("answer_tokens_estimated"))


@query("n8_token_usage", oracle=_NORM + """
SELECT provider, count(*)::BIGINT AS n, sum(prompt_tokens)::BIGINT AS prompt_tokens,
  sum(answer_tokens)::BIGINT AS answer_tokens, sum(reasoning_tokens)::BIGINT AS reasoning_tokens,
  sum(output_tokens)::BIGINT AS output_tokens, sum(total_tokens)::BIGINT AS total_tokens,
  count_if(answer_tokens_estimated)::BIGINT AS estimated_rows,
  sum(unattributed_tokens)::BIGINT AS unattributed_tokens,
  count_if(answer_tokens + reasoning_tokens <> output_tokens)::BIGINT AS split_mismatch_rows
FROM usage_norm GROUP BY provider""")
def n8_token_usage(spark, sf_dir):
    n = n9_all_providers(spark, sf_dir)
    return n.groupBy("provider").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(c) for c in ("prompt_tokens", "answer_tokens", "reasoning_tokens",
                                      "output_tokens", "total_tokens")],
        F.count_if("answer_tokens_estimated").alias("estimated_rows"),
        F.sum("unattributed_tokens").alias("unattributed_tokens"),
        F.count_if(F.col("answer_tokens") + F.col("reasoning_tokens") != F.col("output_tokens"))
        .alias("split_mismatch_rows"))


@query("n10_cache_rows", oracle=_NORM + """
SELECT l_orderkey, l_linenumber,
  coalesce(j_cache_creation, 0) AS cache_creation_tokens, coalesce(j_cache_read, 0) AS cache_read_tokens,
  coalesce(j_c5m, 0) AS cache_ephemeral_5m, coalesce(j_c1h, 0) AS cache_ephemeral_1h
FROM usage_fields
WHERE provider = 'anthropic' AND (coalesce(j_cache_creation, 0) > 0 OR coalesce(j_cache_read, 0) > 0)""")
def n10_cache_rows(spark, sf_dir):
    df = _parsed(spark, sf_dir).filter(F.col("provider") == U.MESSAGES)
    m = staged(df.select(*_KEYS, "u"), m=U.cache_metrics("u")).select(*_KEYS, "m.*")
    return m.filter((F.col("cache_creation_tokens") > 0) | (F.col("cache_read_tokens") > 0))


def _mirror_provider():
    """A provider of a user's own, registered once: its usage is one total, its body is flat."""
    from ..registry import Provider, available_providers, register_provider
    if "mirror" not in available_providers():
        z = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
        usage = lambda u, text: F.struct(
            F.lit(0).cast("bigint").alias("prompt_tokens"), z(u["total_tokens"]).alias("answer_tokens"), F.lit(0).cast("bigint").alias("reasoning_tokens"),
            z(u["total_tokens"]).alias("output_tokens"), z(u["total_tokens"]).alias("total_tokens"), F.lit(True).alias("answer_tokens_estimated"),
            F.lit(0).cast("bigint").alias("unattributed_tokens"))
        body = lambda model, prompt, budget, temperature, top_p: F.to_json(F.struct(
            F.col(model).alias("m"), prompt.alias("p") if hasattr(prompt, "alias") else F.col(prompt).alias("p"),
            budget.alias("n") if hasattr(budget, "alias") else F.col(budget).alias("n")))
        register_provider(Provider("mirror", ("m", "p"), usage, body))


@query("u2_custom_provider", oracle=Q.with_ctes(Q.RUNS) + """
SELECT run_id, max_output_tokens, array_to_string(list_filter(['m', 'p.x', 'note'], lambda p: p <> 'note'), ',') AS protected,
  'ask ' || run_id AS prompt_sent, model AS model_sent, coalesce(max_output_tokens, 0) AS total_tokens
FROM runs""")
def u2_custom_provider(spark, sf_dir):
    """A registered provider drives the request body, the protected paths and the usage of its rows."""
    from ..operators import runs as RU
    from .fixtures import runs
    _mirror_provider()
    r = runs(spark, sf_dir).withColumns({"provider": F.lit("mirror"), "prompt": F.concat(F.lit("ask "), "run_id"),
                                         "paths": F.array(F.lit("m"), F.lit("p.x"), F.lit("note")), "final_text": F.lit("x"),
                                         "u": U.parse_usage(F.to_json(F.struct(F.col("max_output_tokens").alias("total_tokens"))))})
    r = r.withColumn("request", RU.base_request("provider", "model", "prompt", "max_output_tokens", "temperature", "top_p"))
    n = U.normalize_usage_frame(r, "provider", "u", "final_text", out="n")
    return n.select("run_id", "max_output_tokens", F.array_join(RU.protected_violations(F.col("paths"), "provider"), ",").alias("protected"),
                    F.get_json_object("request", "$.p").alias("prompt_sent"), F.get_json_object("request", "$.m").alias("model_sent"),
                    F.col("n.total_tokens").alias("total_tokens"))


@query("u4_counter", oracle=_NORM + """
SELECT l_orderkey, l_linenumber, provider, least(len(regexp_extract_all(final_text, '[^ ]+')), mo)::BIGINT AS answer_tokens
FROM msg_in WHERE NOT exact AND has_text""")
def u4_counter(spark, sf_dir):
    """U4: a counter of the user's own (here: words) replaces the estimate where a text must be counted."""
    words = lambda text: F.struct(F.regexp_count(text, F.lit("[^ ]+")).cast("bigint").alias("n"), F.lit(True).alias("estimated"))
    n = U.normalize_usage_frame(_parsed(spark, sf_dir), "provider", "u", "final_text", counter=words, out="n")
    n = staged(n.select(*_KEYS, "provider", "n"), m=F.col("n"))  # the filter stays above the staged arithmetic
    return n.where((F.col("provider") == "anthropic") & F.col("m.answer_tokens_estimated")).select(
        *_KEYS, "provider", F.col("m.answer_tokens").alias("answer_tokens"))
