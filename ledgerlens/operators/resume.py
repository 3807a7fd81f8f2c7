"""Resume planning over the latest ledger rows.

The latest rows are keyed by ``(run_id, problem_key)``.  Problems and latest rows
are both large, so the joins are plain equi joins: Spark sort-merges them, or AQE
turns a side into a broadcast at run time once its real size is known.  The three
plans (skip, re-judge, regenerate) partition the problem set.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from .ledger import COMPLETED, KEY, REGENERATE, REJUDGE

TOKEN_COLUMNS = ("prompt_tokens", "answer_tokens", "reasoning_tokens", "output_tokens", "total_tokens")

# Columns of a latest row that resume planning and re-judging need.
PLAN_COLUMNS = ("question", "ground_truth", "model_response", "total_tokens", "latency",
                "finish_reason", "error", "evaluator_error", "extraction_method")


def resume_counts(latest: DataFrame) -> DataFrame:
    """Completed / re-judgable / regenerate counts per run."""
    return latest.groupBy("run_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


def not_completed(problems: DataFrame, latest: DataFrame) -> DataFrame:
    """Problems whose latest row is not completed."""
    done = latest.filter(F.col("outcome") == COMPLETED).select(*KEY)
    return problems.join(done, list(KEY), "left_anti")


def rejudge_pairs(problems: DataFrame, latest: DataFrame) -> DataFrame:
    """Remaining problems paired with their re-judgable cached row."""
    cached = latest.filter(F.col("outcome") == REJUDGE)
    return problems.join(cached, list(KEY), "inner")


def regenerate_set(problems: DataFrame, latest: DataFrame) -> DataFrame:
    """Problems with neither a completed nor a re-judgable latest row."""
    settled = latest.filter(F.col("outcome").isin(COMPLETED, REJUDGE)).select(*KEY)
    return problems.join(settled, list(KEY), "left_anti")


def rejudge_projection(pairs: DataFrame, grade=None) -> DataFrame:
    """A re-judged row keeps the cached response, tokens, latency and finish reason.

    ``grade(df) -> df`` adds ``correct`` and ``extraction_method``, and whatever else the grader
    knows - answer, reasoning, test counts, ``evaluator_error`` (default: the containment
    grader X16 on the cached response, which can't fail).  A grader's error stays, so the row
    is judged again next time.
    """
    if grade is None:
        def grade(df):
            return df.withColumns({
                "correct": F.coalesce(F.col("model_response").contains(F.col("ground_truth")), F.lit(False)),
                "extraction_method": F.lit("contains"),
            })
    base = pairs.select(
        "run_id", "problem_key", F.col("seq").alias("cached_seq"),
        F.coalesce(F.nullif(F.col("question"), F.lit("")), F.col("problem")).alias("question"),
        "ground_truth", "model_response", "total_tokens", "latency", "finish_reason")
    graded = grade(base).withColumn("error", F.lit(None).cast("string"))
    return graded if "evaluator_error" in graded.columns else graded.withColumn("evaluator_error", F.lit(None).cast("string"))


def work_list(problems: DataFrame, latest: DataFrame) -> DataFrame:
    """H1: the re-judge branch and the regenerate branch as one table, from one join."""
    known = latest.select(*KEY, "outcome")
    return (problems.select(*KEY).join(known, list(KEY), "left").where(~F.col("outcome").eqNullSafe(F.lit(COMPLETED)))
            .select(*KEY, F.when(F.col("outcome") == REJUDGE, F.lit(REJUDGE)).otherwise(F.lit(REGENERATE)).alias("branch")))


def result_rows(responses: DataFrame, grade) -> DataFrame:
    """Responses become ledger rows, by three branches.

    A generation that raised (column ``exception``, where there is one) has its text as error, no response and
    zero tokens; an error response keeps its tokens and carries its error; any other one is
    graded by ``grade(df) -> df``, whose own failure goes to ``evaluator_error``."""
    graded = grade(responses)
    raised = F.col("exception").isNotNull() if "exception" in graded.columns else F.lit(False)
    failed = C.generation_failed("error", "finish_reason")
    none = F.lit(None).cast("string")
    scorer = F.col("evaluator_error") if "evaluator_error" in graded.columns else none
    zeroed = {c: F.when(raised, F.lit(0).cast(t)).otherwise(F.col(c)) for c, t in graded.dtypes if c == "latency" or c in TOKEN_COLUMNS}
    text = F.col("exception") if "exception" in graded.columns else none
    return graded.withColumns({
        "correct": F.when(raised | failed, F.lit(False)).otherwise(F.col("correct")),
        "extraction_method": F.when(raised, F.lit("exception")).when(failed, F.lit("error")).otherwise(F.col("extraction_method")),
        "evaluator_error": F.when(~(raised | failed), scorer),
        "error": F.when(raised, text).when(failed, C.failure_message("error")),
        "text": F.when(raised, F.lit("")).otherwise(F.col("text")),
        "finish_reason": F.when(~raised, F.col("finish_reason")), **zeroed}).drop("exception")
