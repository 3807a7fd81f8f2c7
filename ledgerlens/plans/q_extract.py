"""Extraction and grading queries over F2 / F2c."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions.text import last_match, staged
from ..operators.code_exec import grade_code
from ..operators.judge import judge_prompt
from . import fixture_sql as Q
from . import sql_extract as SX
from .fixtures import responses
from .registry import query

_R = Q.with_ctes(Q.RESPONSES)


def _mcq(spark, sf_dir):
    r = responses(spark, sf_dir)
    return r.withColumn("x", X.mcq_answer("mcq_response"))


_MCQ_A, _MCQ_M = SX.mcq("mcq_response")


@query("x2_cascade", bench=True, oracle=_R + f"""
SELECT doc_id, extracted_answer, extraction_method, {SX.mcq_correct('extracted_answer', 'truth')} AS correct
FROM (SELECT doc_id, truth, {_MCQ_A} AS extracted_answer, {_MCQ_M} AS extraction_method FROM responses)""")
def x2_cascade(spark, sf_dir):
    df = _mcq(spark, sf_dir)
    return df.select("doc_id", F.col("x.answer").alias("extracted_answer"),
                     F.col("x.method").alias("extraction_method"),
                     X.mcq_correct("x.answer", "truth").alias("correct"))


@query("x3_fallback", oracle=_R + f"""
SELECT doc_id, upper({SX.last_letter('right(mcq_response, 200)')}) AS tail_letter FROM responses""")
def x3_fallback(spark, sf_dir):
    r = responses(spark, sf_dir)
    tail = F.substring("mcq_response", -X.MCQ_TAIL_CHARS, X.MCQ_TAIL_CHARS)
    return r.select("doc_id", F.upper(last_match(tail, "(?U)" + X.MCQ_FALLBACK)).alias("tail_letter"))


@query("x4_grade", oracle=_R + f"""
SELECT extraction_method, count(*)::BIGINT AS n,
       count_if({SX.mcq_correct('extracted_answer', 'truth')})::BIGINT AS n_correct
FROM (SELECT doc_id, truth, {_MCQ_A} AS extracted_answer, {_MCQ_M} AS extraction_method FROM responses)
GROUP BY extraction_method""")
def x4_grade(spark, sf_dir):
    df = _mcq(spark, sf_dir).withColumn("correct", X.mcq_correct("x.answer", "truth"))
    return df.groupBy(F.col("x.method").alias("extraction_method")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("n_correct"))


_J4_A, _J4_M = SX.mcq("s.response")


@query("j4_graded", oracle=_R + f"""
SELECT p.doc_id, p.lang, {SX.mcq_correct(_J4_A, 'p.truth')} AS correct, {_J4_M} AS extraction_method
FROM (SELECT doc_id, lang, chr(CAST(65 + doc_id % 4 AS INTEGER)) AS truth FROM documents) p
JOIN (SELECT doc_id, mcq_response AS response FROM responses) s ON s.doc_id = p.doc_id""")
def j4_graded(spark, sf_dir):
    """Responses joined to their own problem's truth, then graded."""
    from ..sources.tables import table
    problems = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.expr("chr(65 + doc_id % 4)").alias("truth"))
    resp = responses(spark, sf_dir).select("doc_id", F.col("mcq_response").alias("response"))
    graded = resp.join(problems, "doc_id").withColumn("x", X.mcq_answer("response"))
    return graded.select("doc_id", "lang", X.mcq_correct("x.answer", "truth").alias("correct"),
                         F.col("x.method").alias("extraction_method"))


_X1_A, _X1_M = SX.answer_block("math_response")


@query("x1_block", oracle=_R + f"SELECT doc_id, {_X1_A} AS block, {_X1_M} AS method FROM responses")
def x1_block(spark, sf_dir):
    r = responses(spark, sf_dir).withColumn("b", X.answer_block("math_response"))
    return r.select("doc_id", F.col("b.answer").alias("block"), F.col("b.method").alias("method"))


@query("w5_last_match", oracle=_R + f"""
SELECT doc_id, {SX.last('math_response', '(?is)' + X.ANSWER_BLOCK)} AS last_block_raw FROM responses""")
def w5_last_match(spark, sf_dir):
    r = responses(spark, sf_dir)
    return r.select("doc_id", last_match("math_response", "(?is)" + X.ANSWER_BLOCK).alias("last_block_raw"))


@query("x11_candidates", oracle=_R + f"""
SELECT doc_id, sha256(CASE WHEN {_X1_M} <> 'empty_response' THEN coalesce({_X1_A}, math_response) END) AS candidate_sha,
       {_X1_M} <> 'empty_response' AS needs_judge, {_X1_M} AS method FROM responses""")
def x11_candidates(spark, sf_dir):
    r = responses(spark, sf_dir).withColumn("c", X.math_candidate("math_response"))
    return r.select("doc_id", F.sha2("c.candidate", 256).alias("candidate_sha"),
                    F.col("c.needs_judge").alias("needs_judge"), F.col("c.method").alias("method"))


def _judge_prompt_sql():
    from ..operators.judge import JUDGE_PROMPT_TEMPLATE
    from .templates import render_sql
    cand = f"coalesce({_X1_A}, math_response)"
    return render_sql(JUDGE_PROMPT_TEMPLATE, {"QUESTION": "question", "GROUND_TRUTH": "math_truth",
                                              "CANDIDATE": cand})


@query("x12_judge_prompt", oracle=_R + f"""
SELECT doc_id, sha256({_judge_prompt_sql()}) AS prompt_sha, length({_judge_prompt_sql()})::BIGINT AS prompt_chars
FROM responses WHERE {_X1_M} <> 'empty_response'""")
def x12_judge_prompt(spark, sf_dir):
    r = staged(responses(spark, sf_dir), c=X.math_candidate("math_response")).filter("c.needs_judge")
    p = judge_prompt("question", "math_truth", "c.candidate")
    return r.select("doc_id", F.sha2(p, 256).alias("prompt_sha"), F.length(p).cast("bigint").alias("prompt_chars"))


@query("x16_contains", oracle=_R + f"""
SELECT doc_id, coalesce(contains(math_response, math_truth), false) AS contains_truth,
       coalesce({SX.strip('math_response')} = {SX.strip('math_truth')}, false) AS exact_match FROM responses""")
def x16_contains(spark, sf_dir):
    r = responses(spark, sf_dir)
    return r.select("doc_id", X.contains_grade("math_response", "math_truth").alias("contains_truth"),
                    X.exact_grade("math_response", "math_truth").alias("exact_match"))


_X5_A, _X5_M = SX.code("code_response")


@query("x5_code", bench=True, oracle=_R + f"SELECT doc_id, {_X5_A} AS code, {_X5_M} AS method FROM responses")
def x5_code(spark, sf_dir):
    r = responses(spark, sf_dir).withColumn("c", X.code_answer("code_response"))
    return r.select("doc_id", F.col("c.answer").alias("code"), F.col("c.method").alias("method"))


@query("x6_clean", oracle=_R + f"SELECT doc_id, {SX.clean_code('code_response')} AS cleaned FROM responses")
def x6_clean(spark, sf_dir):
    r = responses(spark, sf_dir)
    return r.select("doc_id", X.clean_code("code_response").alias("cleaned"))


@query("x7_fallback", oracle=_R + f"SELECT doc_id, {SX.function_fallback('code_response')} AS fallback_code FROM responses")
def x7_fallback(spark, sf_dir):
    r = responses(spark, sf_dir)
    return r.select("doc_id", X.function_fallback("code_response").alias("fallback_code"))


@query("x8_script", oracle=_R + f"""
SELECT doc_id, sha256(script) AS script_sha, length(script)::BIGINT AS script_chars
FROM (SELECT doc_id, {SX.test_script('code', 'tests')} AS script
      FROM (SELECT doc_id, tests, {_X5_A} AS code FROM responses) WHERE code IS NOT NULL)""")
def x8_script(spark, sf_dir):
    r = staged(responses(spark, sf_dir), c=X.code_answer("code_response")).filter(F.col("c.answer").isNotNull())
    s = X.test_script("c.answer", "tests")
    return r.select("doc_id", F.sha2(s, 256).alias("script_sha"), F.length(s).cast("bigint").alias("script_chars"))


@query("x10_no_code", oracle=_R + f"""
SELECT doc_id, false AS all_passed, 0::BIGINT AS tests_passed, len(tests)::BIGINT AS tests_total,
       'Failed to extract code' AS execution_error
FROM (SELECT doc_id, tests, {_X5_A} AS code FROM responses) WHERE code IS NULL""")
def x10_no_code(spark, sf_dir):
    r = staged(responses(spark, sf_dir), c=X.code_answer("code_response")).filter(F.col("c.answer").isNull())
    g = X.code_grade("c.answer", "tests", F.lit(None))
    return r.select("doc_id", g["all_passed"].alias("all_passed"), g["tests_passed"].alias("tests_passed"),
                    g["tests_total"].alias("tests_total"), g["execution_error"].alias("execution_error"))


#: What the programs planted by CODE_TAILS do: all pass but the method without self (4) and the response without code (5).
X9_SQL = _R + """
SELECT doc_id, doc_id % 7 NOT IN (4, 5) AS all_passed, CASE WHEN doc_id % 7 IN (4, 5) THEN 0 ELSE len(tests) END::BIGINT AS tests_passed,
  len(tests)::BIGINT AS tests_total,
  CASE doc_id % 7 WHEN 5 THEN 'Failed to extract code' WHEN 4 THEN array_to_string(list_transform(range(1, len(tests) + 1),
    lambda i: 'ERROR Test ' || i || ': TypeError: f() missing 1 required positional argument: ' || chr(39) || 'x' || chr(39)), chr(10)) END AS execution_error
FROM responses"""


@query("x9_run_tests", oracle=X9_SQL)
def x9_run_tests(spark, sf_dir):
    """X9 + X10 over every code response; programs run in child processes."""
    r = responses(spark, sf_dir).withColumn("c", X.code_answer("code_response"))
    code = r.select("doc_id", F.col("c.answer").alias("code"), "tests")
    return grade_code(code, ["doc_id"], "code", "tests", timeout_s=5)


@query("u5_table_function", oracle=X9_SQL)
def u5_table_function(spark, sf_dir):
    """The same programs run from SQL by the table function, graded by the same columns."""
    from ..operators.code_exec import dealt, register_run_scripts
    r = responses(spark, sf_dir).withColumn("c", X.code_answer("code_response"))
    code, n = F.col("code"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = r.select("doc_id", F.col("c.answer").alias("code"), "tests").withColumn("script", F.when((F.length(code) > 0) & (F.size("tests") > 0), X.test_script("code", "tests")))
    register_run_scripts(spark)
    programs = dealt(r, ["doc_id"], n)  # scripts are small: left to AQE, one or a few tasks would run them all
    ran = spark.sql("SELECT * FROM run_scripts(TABLE({programs}) PARTITION BY bucket)", programs=programs)
    outcome = X.run_outcome("tests", "rc", "stdout", "stderr", F.coalesce(F.col("timed_out"), F.lit(False)), "5")
    g = ran.withColumn("g", X.code_grade("code", "tests", outcome))
    return g.select("doc_id", "g.all_passed", "g.tests_passed", "g.tests_total", "g.execution_error")


@query("w4_first_last", oracle=_R + """
SELECT doc_id, array_to_string(tests[1:3], '|') AS first_tests,
       array_to_string(tests[greatest(len(tests) - 2, 1):], '|') AS last_tests,
       right(mcq_response, 200) AS tail200, left(math_response, 120) AS head120 FROM responses""")
def w4_first_last(spark, sf_dir):
    r = responses(spark, sf_dir)
    return r.select("doc_id", F.array_join(X.first_n("tests", 3), "|").alias("first_tests"),
                    F.array_join(X.last_n("tests", 3), "|").alias("last_tests"),
                    F.substring("mcq_response", -200, 200).alias("tail200"),
                    F.substring("math_response", 1, 120).alias("head120"))


@query("u1_grader_dispatch", oracle=_R + f"""
SELECT doc_id, {_MCQ_A} AS extracted_answer, {_MCQ_M} AS extraction_method,
       {SX.mcq_correct(_MCQ_A, 'truth')} AS correct FROM responses""")
def u1_grader_dispatch(spark, sf_dir):
    """The multiple-choice responses graded through the grader registry by name."""
    from ..registry import grade
    r = responses(spark, sf_dir).select("doc_id", F.col("mcq_response").alias("response"), "truth")
    return grade(r, "science").select("doc_id", "extracted_answer", "extraction_method", "correct")
