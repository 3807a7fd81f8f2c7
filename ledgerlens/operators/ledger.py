"""Attempt ledger: row fixes, latest-attempt de-duplication, outcome classes.

The ledger is an append-only table of attempts ``(run_id, problem_key, seq, ...)``
where ``seq`` orders appends inside a run.  Everything here is a narrow projection
except :func:`dedupe_latest`, which is one hash-partitioned aggregation on
``(run_id, problem_key)`` with a map-side partial step, so a hot run or a hot
problem is reduced to one row per map task before the shuffle.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import non_empty

KEY = ("run_id", "problem_key")

TOKEN_COLUMNS = ("prompt_tokens", "answer_tokens", "reasoning_tokens", "output_tokens", "total_tokens")

# Extraction methods that mark a generation-side failure row.
FAILURE_METHODS = ("error", "exception")

# Outcome classes of the latest row of a problem.
COMPLETED, REJUDGE, REGENERATE = "completed", "rejudge", "regenerate"


def has_error(c) -> Column:
    """An error exists only when it is a non-empty string."""
    return non_empty(c)


def fill_token_usage(df: DataFrame) -> DataFrame:
    """Zero means missing — output = reasoning + answer, total = prompt + answer + reasoning."""
    out = F.when(F.col("output_tokens") == 0, F.col("reasoning_tokens") + F.col("answer_tokens")) \
        .otherwise(F.col("output_tokens"))
    total = F.when(F.col("total_tokens") == 0,
                   F.col("prompt_tokens") + F.col("answer_tokens") + F.col("reasoning_tokens")) \
        .otherwise(F.col("total_tokens"))
    return df.withColumns({"output_tokens": out, "total_tokens": total})


def legacy_judge_error(df: DataFrame) -> Column:
    """P14 predicate: a judge failure stored in ``error`` by an old writer."""
    return (has_error("error") & ~has_error("evaluator_error") & non_empty("model_response")
            & ~F.coalesce(F.col("extraction_method").isin(*FAILURE_METHODS), F.lit(False)))


def migrate_legacy_errors(df: DataFrame) -> DataFrame:
    """Move a legacy judge failure from ``error`` to ``evaluator_error``."""
    legacy = legacy_judge_error(df)
    return df.withColumns({
        "evaluator_error": F.when(legacy, F.col("error")).otherwise(F.col("evaluator_error")),
        "error": F.when(legacy, F.lit(None).cast("string")).otherwise(F.col("error")),
    })


def outcome(df: DataFrame) -> Column:
    """Completed / rejudge (judge-only failure with a response) / regenerate."""
    gen_err, eval_err = has_error("error"), has_error("evaluator_error")
    return (F.when(~gen_err & ~eval_err, F.lit(COMPLETED))
            .when(eval_err & ~gen_err & non_empty("model_response"), F.lit(REJUDGE))
            .otherwise(F.lit(REGENERATE)))


def with_outcome(df: DataFrame) -> DataFrame:
    return df.withColumn("outcome", outcome(df))


_FIXED_WIDTH = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                T.FloatType, T.DoubleType, T.DateType, T.TimestampType)


def dedupe_latest(df: DataFrame, columns: Sequence[str] | None = None,
                  key: Sequence[str] = KEY, order: str = "seq") -> DataFrame:
    """A1: one row per key, the latest ``order`` wins; ``first_seq`` keeps first-seen order.

    ``columns`` limits the payload carried through the shuffle (e.g. only the narrow
    columns a summary needs, never response text).  ``max_by`` / ``min`` are
    aggregated partially on the map side, so the shuffle carries at most one row
    per key per map task regardless of key skew.  When every payload column is
    fixed-width, one ``max_by`` per column keeps the aggregation hash-based; a
    string payload travels as one struct (sort-based aggregation, spills safely).
    ``order`` must be unique per key so every column comes from the same row.
    """
    key = list(key)
    payload = [c for c in (columns if columns is not None else df.columns) if c not in key and c != order]
    types = {f.name: f.dataType for f in df.schema.fields}
    first = F.min(order).alias("first_seq")
    if all(isinstance(types[c], _FIXED_WIDTH) for c in payload):
        aggs = [F.max(order).alias(order)] + [F.max_by(c, order).alias(c) for c in payload]
        return df.groupBy(*key).agg(*aggs, first)
    latest = F.max_by(F.struct(F.col(order).alias(order), *[F.col(c) for c in payload]), F.col(order))
    agg = df.groupBy(*key).agg(latest.alias("_latest"), first)
    return agg.select(*key, "_latest.*", "first_seq")


# Width of an ``order`` range inside which attempts are numbered by one window task.
HISTORY_BUCKET = 1 << 16


def attempt_history(df: DataFrame, key: Sequence[str] = KEY, order: str = "seq",
                    bucket: int = HISTORY_BUCKET) -> DataFrame:
    """Every attempt with its number, attempt count and an ``is_latest`` flag.

    A plain ``row_number`` over ``partitionBy(key)`` sorts a hot key inside one task.
    Instead rows are numbered inside ``(key, order div bucket)`` slices (bounded by
    ``bucket`` rows when ``order`` is unique per key), and each slice is offset by
    the count of all earlier slices of its key, computed from a partially
    aggregated table with one row per slice.  ``order`` must be unique per key.
    """
    key = list(key)
    b = F.floor(F.col(order) / F.lit(bucket)).alias("_b")
    sliced = df.withColumn("_b", b)
    per_slice = sliced.groupBy(*key, "_b").agg(F.count(F.lit(1)).alias("_n"), F.max(order).alias("_mx"))
    wk = Window.partitionBy(*key)
    offsets = per_slice.select(
        *key, "_b",
        F.coalesce(F.sum("_n").over(wk.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_before"),
        F.sum("_n").over(wk).alias("attempts"),
        F.max("_mx").over(wk).alias("_last"))
    ranked = sliced.withColumn("_rn", F.row_number().over(Window.partitionBy(*key, "_b").orderBy(order)))
    return (ranked.join(offsets, key + ["_b"], "inner")
            .withColumn("attempt_no", (F.col("_before") + F.col("_rn")).cast("bigint"))
            .withColumn("attempts", F.col("attempts").cast("bigint"))
            .withColumn("is_latest", F.col(order) == F.col("_last"))
            .drop("_b", "_rn", "_before", "_last"))


def latest_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Ledger → fixed rows (P15, P14) → latest per problem (A1) → outcome."""
    fixed = migrate_legacy_errors(fill_token_usage(df))
    return with_outcome(dedupe_latest(fixed, columns))


def error_flags(df: DataFrame) -> DataFrame:
    """Row-level booleans that stand in for the error strings after de-duplication."""
    return df.withColumns({
        "gen_error": has_error("error"),
        "eval_error": has_error("evaluator_error"),
        "has_response": non_empty("model_response"),
    })


def outcome_from_flags() -> Column:
    return (F.when(~F.col("gen_error") & ~F.col("eval_error"), F.lit(COMPLETED))
            .when(F.col("eval_error") & ~F.col("gen_error") & F.col("has_response"), F.lit(REJUDGE))
            .otherwise(F.lit(REGENERATE)))


def latest_flags(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Like :func:`latest_rows` for fixed-width payloads: errors reduced to flags first,
    so the de-duplication stays a hash aggregation."""
    flagged = error_flags(migrate_legacy_errors(fill_token_usage(df)))
    latest = dedupe_latest(flagged, list(columns) + ["gen_error", "eval_error", "has_response"])
    return latest.withColumn("outcome", outcome_from_flags())


def latest_texts(df: DataFrame, wanted: str, columns: Sequence[str]) -> DataFrame:
    """The latest rows of outcome ``wanted`` with ``columns``.  De-duplication and outcome need flags only;
    texts are fetched by key and sequence for the rows that are left."""
    rows = latest_flags(df).where(F.col("outcome") == wanted).select(*KEY, "seq", "outcome", "first_seq")
    fixed = migrate_legacy_errors(fill_token_usage(df)).select(*KEY, "seq", *columns)
    return fixed.join(rows, [*KEY, "seq"])
