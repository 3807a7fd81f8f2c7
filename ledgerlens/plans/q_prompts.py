"""Prompt, budget and template queries over F8 / F3."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions.usage import estimate_tokens
from . import fixture_sql as Q
from . import sql_prompts as SP
from .fixtures import pairs, problems
from .registry import query
from .templates import sql_literal

_PR = Q.with_ctes(Q.PROBLEMS)
_FMT = SP.format_prompt("problem", "evaluator_type", "test_list")


@query("p1_prompt", oracle=_PR + f"""
SELECT item_id, evaluator_type, sha256({_FMT}) AS prompt_sha, length({_FMT})::BIGINT AS prompt_chars FROM problems""")
def p1_prompt(spark, sf_dir):
    p = problems(spark, sf_dir).withColumn("prompt", P.format_prompt("problem", "evaluator_type", "test_list"))
    return p.select("item_id", "evaluator_type", F.sha2("prompt", 256).alias("prompt_sha"),
                    F.length("prompt").cast("bigint").alias("prompt_chars"))


@query("p2_injection", oracle=_PR + f"""
SELECT item_id, {SP.inject('problem', 'test_list')} <> problem AS injected,
       length({SP.inject('problem', 'test_list')})::BIGINT AS chars FROM problems""")
def p2_injection(spark, sf_dir):
    p = problems(spark, sf_dir).withColumn("x", P.inject_tests("problem", "test_list"))
    return p.select("item_id", (F.col("x") != F.col("problem")).alias("injected"),
                    F.length("x").cast("bigint").alias("chars"))


@query("p3_hint", oracle=_PR + f"""
SELECT item_id, CASE WHEN len(test_list) > 0 THEN problem || {sql_literal(P.LOADER_HINT)}
    || array_to_string(list_transform(test_list[1:3], lambda x: '  ' || x || chr(10)), '') ELSE problem END AS hinted
FROM problems""")
def p3_hint(spark, sf_dir):
    p = problems(spark, sf_dir)
    return p.select("item_id", P.loader_hint("problem", "test_list").alias("hinted"))


@query("p4_merge", oracle=_PR + """
SELECT item_id, array_to_string(coalesce(test_cases, list_concat(coalesce(test_list, []), coalesce(challenge_test_list, []))), '|') AS tests
FROM problems""")
def p4_merge(spark, sf_dir):
    p = problems(spark, sf_dir)
    return p.select("item_id", F.array_join(P.merge_tests("test_cases", "test_list", "challenge_test_list"),
                                            "|").alias("tests"))


@query("p5_tokens", oracle=_PR + f"""
SELECT item_id, {SP.estimate('problem')} AS estimated_tokens, {SP.estimate(_FMT)} AS prompt_tokens_est FROM problems""")
def p5_tokens(spark, sf_dir):
    p = problems(spark, sf_dir).withColumn("prompt", P.format_prompt("problem", "evaluator_type", "test_list"))
    return p.select("item_id", estimate_tokens("problem").alias("estimated_tokens"),
                    estimate_tokens("prompt").alias("prompt_tokens_est"))


@query("p6_budget", oracle=_PR + f"""
SELECT item_id, {SP.budget(_FMT, 'max_output_tokens', 'max_context_window')} AS max_output_budget FROM problems""")
def p6_budget(spark, sf_dir):
    p = problems(spark, sf_dir).withColumn("prompt", P.format_prompt("problem", "evaluator_type", "test_list"))
    return p.select("item_id", P.output_budget("prompt", "max_output_tokens", "max_context_window")
                    .alias("max_output_budget"))


@query("h6_template_identity", oracle=_PR + """
SELECT evaluator_type, '1' AS formatter_version,
  CASE evaluator_type """ + " ".join(
    f"WHEN '{k}' THEN '{P.template_hash(k)}'" for k in P.TEMPLATES) + """ ELSE 'raw' END AS template_hash,
  count(*)::BIGINT AS problems
FROM problems GROUP BY evaluator_type""")
def h6_template_identity(spark, sf_dir):
    p = problems(spark, sf_dir).withColumn("t", P.template_identity("evaluator_type"))
    return p.groupBy("evaluator_type", F.col("t.formatter_version").alias("formatter_version"),
                     F.col("t.template_hash").alias("template_hash")).agg(F.count(F.lit(1)).alias("problems"))


@query("f3_pairs", oracle=Q.with_ctes(Q.PAIRS) + f"""
SELECT conv_id, turn, sha256({SP.render(P.MATH_PROMPT_TEMPLATE, 'prompt')}) AS prompt_sha,
       length(response)::BIGINT AS response_chars FROM pairs""")
def f3_pairs(spark, sf_dir):
    p = pairs(spark, sf_dir).withColumn("fp", P.format_prompt("prompt", F.lit("math")))
    return p.select("conv_id", "turn", F.sha2("fp", 256).alias("prompt_sha"),
                    F.length("response").cast("bigint").alias("response_chars"))
