"""Judge queries over F6 and F2."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import judge as J
from ..sources.tables import table
from . import fixture_sql as Q
from . import sql_extract as SX
from .fixtures import judge_outputs, responses
from .registry import query
from .sql_judge import parsed_cte

_PARSED = Q.with_ctes(Q.JUDGE_OUTPUTS, parsed_cte())


@query("x13_parse", oracle=_PARSED + """
SELECT doc_id, stage, correct, extracted_answer, reasoning, error FROM judge_parsed""")
def x13_parse(spark, sf_dir):
    j = J.parse_judgment_frame(judge_outputs(spark, sf_dir), "content", "v")
    return j.select("doc_id", "v.stage", "v.correct", "v.extracted_answer", "v.reasoning", "v.error")


@query("x14_coerce", oracle=_PARSED + """
SELECT stage, correct, count(*)::BIGINT AS n FROM judge_parsed GROUP BY stage, correct""")
def x14_coerce(spark, sf_dir):
    j = J.parse_judgment_frame(judge_outputs(spark, sf_dir), "content", "v")
    return j.groupBy("v.stage", "v.correct").agg(F.count(F.lit(1)).alias("n"))


_X1_A, _X1_M = SX.answer_block("math_response")


@query("j6_verdicts", oracle=Q.with_ctes(Q.RESPONSES, Q.JUDGE_OUTPUTS, parsed_cte(
    "(SELECT * FROM judge_outputs WHERE doc_id IN (SELECT doc_id FROM labels))")) + f"""
SELECT r.doc_id,
  CASE WHEN blank OR v.doc_id IS NULL THEN false ELSE v.correct END AS correct,
  CASE WHEN blank THEN NULL ELSE coalesce(v.extracted_answer, block) END AS extracted_answer,
  method AS extraction_method,
  CASE WHEN blank THEN {SX.q(J.EMPTY_RESPONSE_REASONING)}
       ELSE coalesce(nullif(v.reasoning, ''), CASE WHEN v.doc_id IS NULL THEN {SX.q(J.MISSING_VERDICT)} ELSE v.error END) END
    AS judge_reasoning,
  CASE WHEN blank THEN NULL WHEN v.doc_id IS NULL THEN {SX.q(J.MISSING_VERDICT)} ELSE v.error END AS evaluator_error
FROM (SELECT doc_id, {_X1_A} AS block, {_X1_M} AS method, {_X1_M} = 'empty_response' AS blank FROM responses) r
LEFT JOIN judge_parsed v ON v.doc_id = r.doc_id""")
def j6_verdicts(spark, sf_dir):
    cands = responses(spark, sf_dir).select("doc_id", F.col("math_response").alias("response"))
    labeled = table(spark, sf_dir, "labels").select("doc_id")
    verdicts = judge_outputs(spark, sf_dir).join(labeled, "doc_id", "left_semi")
    g = J.verdict_grade(cands, verdicts, ["doc_id"])
    return g.select("doc_id", "correct", "extracted_answer", "extraction_method", "judge_reasoning",
                    "evaluator_error")
