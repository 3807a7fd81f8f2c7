"""Run summaries: accuracy, token totals and the token-penalised score.

All aggregates are algebraic (count / sum), so Spark computes them with a partial
aggregation per map task and one small shuffle on the grouping key.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ledger import has_error

# Score constants (weight and token scale, natural log).
SCORE_TOKEN_WEIGHT = 10
SCORE_TOKEN_SCALE = 10000


def score(accuracy, avg_tokens) -> Column:
    """A2: ``accuracy - 10 * ln(avg_tokens / 10000 + 1)``."""
    acc = F.col(accuracy) if isinstance(accuracy, str) else accuracy
    avg = F.col(avg_tokens) if isinstance(avg_tokens, str) else avg_tokens
    return acc - F.lit(float(SCORE_TOKEN_WEIGHT)) * F.ln(avg / F.lit(float(SCORE_TOKEN_SCALE)) + F.lit(1.0))


def error_flag(df: DataFrame | None = None) -> Column:
    """A4: a non-empty error on either axis (precomputed flags are used when present)."""
    if df is not None and {"gen_error", "eval_error"} <= set(df.columns):
        return F.col("gen_error") | F.col("eval_error")
    return has_error("error") | has_error("evaluator_error")


def summary_aggs(df: DataFrame | None = None) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_problems"),
        F.count_if(F.coalesce(F.col("correct"), F.lit(False))).alias("correct_count"),
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("prompt_tokens").alias("total_prompt_tokens"),
        F.sum("answer_tokens").alias("total_answer_tokens"),
        F.sum("reasoning_tokens").alias("total_reasoning_tokens"),
        F.sum("output_tokens").alias("total_output_tokens"),
        F.sum("latency").alias("_latency_sum"),
        F.count_if(error_flag(df)).alias("error_count"),
    ]


def _finish(agg: DataFrame, keys: Sequence[str], duration: float | None) -> DataFrame:
    n = F.col("total_problems")
    zero = F.lit(0.0)
    accuracy = F.coalesce(F.try_divide(F.col("correct_count"), n) * F.lit(100.0), zero)
    avg_tokens = F.coalesce(F.try_divide(F.col("total_tokens"), n), zero)
    avg_latency = F.coalesce(F.try_divide(F.col("_latency_sum"), n), zero)
    cols = [F.col(k) for k in keys] + [
        "total_problems", "correct_count", accuracy.alias("accuracy"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in (
            "total_tokens", "total_prompt_tokens", "total_answer_tokens",
            "total_reasoning_tokens", "total_output_tokens")],
        avg_tokens.alias("avg_tokens_per_problem"), avg_latency.alias("avg_latency"),
        "error_count",
    ]
    out = agg.select(*cols).withColumn("efficiency_score", score("accuracy", "avg_tokens_per_problem"))
    if duration is not None:
        out = out.withColumn("total_duration", F.lit(float(duration)))
    return out


def summarize(df: DataFrame, by: Sequence[str] = ("run_id",), duration: float | None = None) -> DataFrame:
    """A3: one summary row per group (``by=()`` gives one row, zeros when empty)."""
    keys = list(by)
    aggs = summary_aggs(df)
    agg = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    return _finish(agg, keys, duration)


def summary_from_sums(agg: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """A3 from already merged sums named as in :func:`summary_aggs` (e.g. incremental deltas)."""
    return _finish(agg, list(by), None)


SUM_COLUMNS = ("total_problems", "correct_count", "total_tokens", "total_prompt_tokens", "total_answer_tokens",
               "total_reasoning_tokens", "total_output_tokens", "_latency_sum", "error_count")


def run_sums(df: DataFrame, key: str = "run_id") -> DataFrame:
    """One row of sums per run."""
    return df.groupBy(key).agg(*summary_aggs(df))


def summarize_rollup(sums: DataFrame, dims: Sequence[str], cube: bool = False) -> DataFrame:
    """Summaries at every level of ``rollup``/``cube`` over ``dims``, from one row of sums
    per run (:func:`run_sums`) that carries the dimensions: only those rows are multiplied."""
    grouped = sums.cube(*dims) if cube else sums.rollup(*dims)
    agg = grouped.agg(*[F.sum(c).alias(c) for c in SUM_COLUMNS], F.grouping_id(*dims).cast("bigint").alias("grouping_level"))
    return _finish(agg, list(dims) + ["grouping_level"], None)


def compare_runs(summaries: DataFrame, group: str = "comparable_id") -> DataFrame:
    """Runs side by side within groups that may be compared: ``rank`` by score (then accuracy, then run id), ``n_runs`` of the group, and how far
    accuracy and score are behind the group's best.

    Input is one row per run.  The group's best values come by an aggregation, combined before the shuffle, and a join; only the ranking sorts a group."""
    best = summaries.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("n_runs"), F.max("accuracy").alias("_a"), F.max("efficiency_score").alias("_s"))
    order = Window.partitionBy(group).orderBy(F.desc_nulls_last("efficiency_score"), F.desc_nulls_last("accuracy"), "run_id")
    return (summaries.join(best, F.col(group).eqNullSafe(F.col("_g"))).withColumn("rank", F.row_number().over(order).cast("bigint"))
            .withColumn("accuracy_behind", F.col("_a") - F.col("accuracy")).withColumn("score_behind", F.col("_s") - F.col("efficiency_score")).drop("_g", "_a", "_s"))


def fill_summary_aliases(df: DataFrame) -> DataFrame:
    """Stored summaries — ``total_completion_tokens`` stands in for a missing
    ``total_answer_tokens``; a missing or zero output total becomes answer + reasoning."""
    ans = F.coalesce(F.col("total_answer_tokens"), F.col("total_completion_tokens"), F.lit(0).cast("bigint"))
    out = F.when(F.coalesce(F.col("total_output_tokens"), F.lit(0)) == 0,
                 ans + F.coalesce(F.col("total_reasoning_tokens"), F.lit(0).cast("bigint"))) \
        .otherwise(F.col("total_output_tokens"))
    return df.withColumns({"total_answer_tokens": ans, "total_output_tokens": out}).drop("total_completion_tokens")


def round_summary(df: DataFrame) -> DataFrame:
    """Presentation rounding used by the oracle comparisons (6 / 9 places)."""
    return df.withColumns({
        "accuracy": F.round("accuracy", 6),
        "avg_tokens_per_problem": F.round("avg_tokens_per_problem", 6),
        "avg_latency": F.round("avg_latency", 6),
        "efficiency_score": F.round("efficiency_score", 9),
    })
