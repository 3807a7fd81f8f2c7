"""Ledger, resume and summary queries (A*, P14, P15, P17, W1, W3, J1-J3, H1, P18, P19)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators import resume as R
from ..operators import scoring as S
from . import fixture_sql as Q
from .fixtures import attempts, run_problems
from .registry import query

SUMMARY_COLUMNS = ("correct", *L.TOKEN_COLUMNS, "latency")


def run_summary(spark, sf_dir):
    latest = L.latest_flags(attempts(spark, sf_dir), columns=SUMMARY_COLUMNS)
    return S.round_summary(S.summarize(latest, by=("run_id",)))


@query("a5_run_summary", bench=True, oracle=Q.with_ctes(Q.ATTEMPTS, Q.FIXED, Q.LATEST)
       + f"SELECT run_id, {Q.SUMMARY_SELECT} FROM latest GROUP BY run_id")
def a5_run_summary(spark, sf_dir):
    return run_summary(spark, sf_dir)


@query("a3_summary_all", oracle=Q.with_ctes(Q.ATTEMPTS, Q.FIXED, Q.LATEST)
       + f"SELECT {Q.SUMMARY_SELECT} FROM latest")
def a3_summary_all(spark, sf_dir):
    latest = L.latest_flags(attempts(spark, sf_dir), columns=SUMMARY_COLUMNS)
    return S.round_summary(S.summarize(latest, by=()))


@query("a2_score", oracle=Q.with_ctes(Q.ATTEMPTS) + """
SELECT seq, round(10.0 * (seq % 10) - 10.0 * ln(total_tokens / 10000.0 + 1.0), 9) AS efficiency_score FROM attempts""")
def a2_score(spark, sf_dir):
    a = attempts(spark, sf_dir)
    return a.select("seq", F.round(S.score((F.col("seq") % 10) * F.lit(10.0), F.col("total_tokens")), 9).alias("efficiency_score"))


@query("a1_latest_attempt", oracle=Q.with_ctes(Q.ATTEMPTS, Q.FIXED, Q.LATEST) + """
SELECT run_id, problem_key, seq, first_seq, correct, error, evaluator_error, model_response, total_tokens FROM latest""")
def a1_latest_attempt(spark, sf_dir):
    fixed = L.migrate_legacy_errors(L.fill_token_usage(attempts(spark, sf_dir)))
    cols = ("correct", "error", "evaluator_error", "model_response", "total_tokens")
    return L.dedupe_latest(fixed, columns=cols).select(
        "run_id", "problem_key", "seq", "first_seq", *cols)


@query("w1_attempt_history", oracle=Q.with_ctes(Q.ATTEMPTS) + """
SELECT run_id, problem_key, seq,
       row_number() OVER (PARTITION BY run_id, problem_key ORDER BY seq)::BIGINT AS attempt_no,
       count(*) OVER (PARTITION BY run_id, problem_key)::BIGINT AS attempts,
       seq = max(seq) OVER (PARTITION BY run_id, problem_key) AS is_latest
FROM attempts""")
def w1_attempt_history(spark, sf_dir):
    h = L.attempt_history(attempts(spark, sf_dir).select("run_id", "problem_key", "seq"))
    return h.select("run_id", "problem_key", "seq", "attempt_no", "attempts", "is_latest")


@query("w3_first_seen", oracle=Q.with_ctes(Q.ATTEMPTS, Q.FIXED, Q.LATEST) + """
SELECT run_id, problem_key, first_seq, seq AS latest_seq FROM latest ORDER BY run_id, first_seq""")
def w3_first_seen(spark, sf_dir):
    latest = L.dedupe_latest(attempts(spark, sf_dir), columns=())
    return latest.select("run_id", "problem_key", "first_seq", F.col("seq").alias("latest_seq")) \
        .orderBy("run_id", "first_seq")


@query("p14_migrate", oracle=Q.with_ctes(Q.ATTEMPTS, Q.FIXED) + """
SELECT seq, error, evaluator_error, extraction_method FROM fixed""")
def p14_migrate(spark, sf_dir):
    return L.migrate_legacy_errors(attempts(spark, sf_dir)).select(
        "seq", "error", "evaluator_error", "extraction_method")


@query("p15_fill", oracle=Q.with_ctes(Q.ATTEMPTS, Q.FIXED) + """
SELECT seq, prompt_tokens, answer_tokens, reasoning_tokens, output_tokens, total_tokens FROM fixed""")
def p15_fill(spark, sf_dir):
    return L.fill_token_usage(attempts(spark, sf_dir)).select("seq", *L.TOKEN_COLUMNS)


@query("p17_outcome", oracle=Q.with_ctes(Q.ATTEMPTS, Q.FIXED, Q.LATEST) + """
SELECT run_id, problem_key, seq, outcome FROM latest""")
def p17_outcome(spark, sf_dir):
    latest = L.latest_flags(attempts(spark, sf_dir))
    return latest.select("run_id", "problem_key", "seq", "outcome")


@query("a6_resume_counts", oracle=Q.with_ctes(Q.ATTEMPTS, Q.FIXED, Q.LATEST) + """
SELECT run_id, outcome, count(*)::BIGINT AS n FROM latest GROUP BY run_id, outcome""")
def a6_resume_counts(spark, sf_dir):
    return R.resume_counts(L.latest_flags(attempts(spark, sf_dir)))


@query("a4_errors", oracle=Q.with_ctes(Q.ATTEMPTS, Q.FIXED) + """
SELECT run_id,
       count_if(coalesce(length(error), 0) > 0 OR coalesce(length(evaluator_error), 0) > 0)::BIGINT AS error_count,
       count_if(coalesce(length(error), 0) > 0)::BIGINT AS generation_errors,
       count_if(coalesce(length(evaluator_error), 0) > 0)::BIGINT AS evaluator_errors
FROM fixed GROUP BY run_id""")
def a4_errors(spark, sf_dir):
    fixed = L.migrate_legacy_errors(attempts(spark, sf_dir))
    return fixed.groupBy("run_id").agg(
        F.count_if(S.error_flag()).alias("error_count"),
        F.count_if(L.has_error("error")).alias("generation_errors"),
        F.count_if(L.has_error("evaluator_error")).alias("evaluator_errors"))


_PLAN_CTES = (Q.ATTEMPTS, Q.FIXED, Q.LATEST, Q.RUN_PROBLEMS)


@query("j1_done_skip", oracle=Q.with_ctes(*_PLAN_CTES) + """
SELECT p.run_id, p.problem_key FROM run_problems p
WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.run_id = p.run_id AND l.problem_key = p.problem_key
                  AND l.outcome = 'completed')""")
def j1_done_skip(spark, sf_dir):
    latest = L.latest_flags(attempts(spark, sf_dir))
    return R.not_completed(run_problems(spark, sf_dir), latest).select("run_id", "problem_key")


@query("j2_rejudge", oracle=Q.with_ctes(*_PLAN_CTES) + """
SELECT p.run_id, p.problem_key, p.problem, l.seq, l.model_response, l.evaluator_error
FROM run_problems p JOIN latest l ON l.run_id = p.run_id AND l.problem_key = p.problem_key
WHERE l.outcome = 'rejudge'""")
def j2_rejudge(spark, sf_dir):
    latest = L.latest_texts(attempts(spark, sf_dir), L.REJUDGE, R.PLAN_COLUMNS)
    return R.rejudge_pairs(run_problems(spark, sf_dir), latest).select(
        "run_id", "problem_key", "problem", "seq", "model_response", "evaluator_error")


@query("j3_regenerate", oracle=Q.with_ctes(*_PLAN_CTES) + """
SELECT p.run_id, p.problem_key, p.problem FROM run_problems p
WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.run_id = p.run_id AND l.problem_key = p.problem_key
                  AND l.outcome IN ('completed', 'rejudge'))""")
def j3_regenerate(spark, sf_dir):
    latest = L.latest_flags(attempts(spark, sf_dir))
    return R.regenerate_set(run_problems(spark, sf_dir), latest).select("run_id", "problem_key", "problem")


@query("p19_rejudge_rows", oracle=Q.with_ctes(*_PLAN_CTES) + """
SELECT l.run_id, l.problem_key, l.seq AS cached_seq,
       coalesce(nullif(l.question, ''), p.problem) AS question,
       l.ground_truth, l.model_response, l.total_tokens, l.latency, l.finish_reason,
       coalesce(contains(l.model_response, l.ground_truth), false) AS correct,
       'contains' AS extraction_method,
       CAST(NULL AS VARCHAR) AS error, CAST(NULL AS VARCHAR) AS evaluator_error
FROM run_problems p JOIN latest l ON l.run_id = p.run_id AND l.problem_key = p.problem_key
WHERE l.outcome = 'rejudge'""")
def p19_rejudge_rows(spark, sf_dir):
    latest = L.latest_texts(attempts(spark, sf_dir), L.REJUDGE, R.PLAN_COLUMNS)
    pairs = R.rejudge_pairs(run_problems(spark, sf_dir), latest)
    return R.rejudge_projection(pairs).select(
        "run_id", "problem_key", "cached_seq", "question", "ground_truth", "model_response",
        "total_tokens", "latency", "finish_reason", "correct", "extraction_method", "error", "evaluator_error")


@query("h1_union", oracle=Q.with_ctes(*_PLAN_CTES) + """
SELECT run_id, branch, count(*)::BIGINT AS n FROM (
  SELECT l.run_id, 'rejudge' AS branch FROM run_problems p
    JOIN latest l ON l.run_id = p.run_id AND l.problem_key = p.problem_key WHERE l.outcome = 'rejudge'
  UNION ALL
  SELECT p.run_id, 'regenerate' AS branch FROM run_problems p
  WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.run_id = p.run_id AND l.problem_key = p.problem_key
                    AND l.outcome IN ('completed', 'rejudge'))
) GROUP BY run_id, branch""")
def h1_union(spark, sf_dir):
    latest = L.latest_flags(attempts(spark, sf_dir))
    work = R.work_list(run_problems(spark, sf_dir), latest)
    return work.groupBy("run_id", "branch").agg(F.count(F.lit(1)).alias("n"))
