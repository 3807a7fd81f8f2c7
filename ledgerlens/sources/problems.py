"""Problem-set scans (S1-S3) with P3/P4 applied for code datasets.

JSON lines are read with Spark's JSON reader into one VARIANT column per line, so
``Any``-typed fields (id, answer, metadata) keep their JSON type: the problem key
is ``to_json(id)``, which keeps ``1`` and ``"1"`` apart.  A malformed line fails
the read (FAILFAST), as a bad dataset line aborts a run; blank lines are skipped.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prompts import loader_hint, merge_tests
from ..functions.text import is_blank
from .lines import numbered_lines


def _v(path: str, typ: str = "variant") -> Column:
    return F.try_variant_get(F.col("v"), path, typ)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("singleVariantColumn", "v").option("mode", "FAILFAST")
            .option("lineSep", "\n").json(path))


def _strings(path: str) -> Column:
    return F.coalesce(_v(path, "array<string>"), F.array().cast("array<string>"))


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    """``{problem, answer, id, metadata?}`` per line; problem, answer and id required."""
    raw = _read(spark, path)
    problem, answer, pid = _v("$.problem", "string"), _v("$.answer"), _v("$.id")
    missing = problem.isNull() | answer.isNull() | pid.isNull()
    checked = F.when(missing, F.raise_error(F.lit("problem line lacks one of: problem, answer, id")))
    return raw.select(
        F.coalesce(checked.cast("string"), F.to_json(pid)).alias("problem_key"),
        problem.alias("problem"), F.to_json(answer).alias("answer"),
        F.coalesce(F.to_json(_v("$.metadata")), F.lit("{}")).alias("metadata"),
        F.array().cast("array<string>").alias("test_cases"))


def read_code(spark: SparkSession, path: str) -> DataFrame:
    """Code datasets in three shapes — flat (problem/answer/metadata), nested ``doc``, and
    old top-level fields.  Tests merge as P4, the prompt gets the P3 hint.  A missing id
    falls back to the line's number in its file."""
    lines = numbered_lines(spark, path).where(~is_blank("value"))
    raw = lines.select(F.parse_json("value").alias("v"), F.col("line").alias("_rid"))
    flat = _v("$.problem").isNotNull() & _v("$.answer").isNotNull()
    nested = _v("$.doc").isNotNull()
    row_id = F.col("_rid").cast("string")

    meta_tests = _v("$.metadata.test_list", "array<string>")
    flat_tests = F.coalesce(meta_tests, F.array().cast("array<string>"))
    flat_cases = merge_tests(_v("$.metadata.test_cases", "array<string>"), flat_tests,
                             _strings("$.metadata.challenge_test_list"))
    flat_id = F.coalesce(F.to_json(_v("$.id")), row_id)

    doc_tests, doc_chal = _strings("$.doc.test_list"), _strings("$.doc.challenge_test_list")
    doc_id = F.coalesce(F.to_json(_v("$.doc.task_id")), F.to_json(_v("$.doc_id")), row_id)
    top_tests, top_chal = _strings("$.test_list"), _strings("$.challenge_test_list")
    top_id = F.coalesce(F.to_json(_v("$.task_id")), F.to_json(_v("$.id")), row_id)
    top_text = F.coalesce(_v("$.text", "string"), _v("$.problem", "string"), F.lit(""))

    text = F.when(flat, F.coalesce(_v("$.problem", "string"), F.lit(""))) \
        .when(nested, F.coalesce(_v("$.doc.text", "string"), F.lit(""))).otherwise(top_text)
    tests = F.when(flat, flat_tests).when(nested, doc_tests).otherwise(top_tests)
    cases = F.when(flat, flat_cases).when(nested, F.concat(doc_tests, doc_chal)) \
        .otherwise(F.concat(top_tests, top_chal))
    answer = F.when(flat, F.to_json(_v("$.answer"))).when(
        nested, F.to_json(F.coalesce(_v("$.doc.code"), F.parse_json(F.lit('""'))))).otherwise(
        F.to_json(F.coalesce(_v("$.code"), F.parse_json(F.lit('""')))))
    key = F.when(flat, flat_id).when(nested, doc_id).otherwise(top_id)
    return raw.select(key.alias("problem_key"), loader_hint(text, tests).alias("problem"), answer.alias("answer"),
                      tests.alias("test_list"), cases.alias("test_cases"))


def read_problems(spark: SparkSession, path: str, dialect: str = "auto") -> DataFrame:
    """S3: a path naming ``mbpp`` (any case) reads as a code dataset, anything else as plain."""
    if not path:
        raise ValueError("filepath is required")
    if dialect == "auto":
        dialect = "code" if "mbpp" in path.lower() else "plain"
    return read_code(spark, path) if dialect == "code" else read_plain(spark, path)
