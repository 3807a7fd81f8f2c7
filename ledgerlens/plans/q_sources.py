"""Source and sink round trips over derived data.

Each query first writes data Spark derives from the driver tables into the shared
checkpoint folder (JSON lines or Parquet), then reads it back through the source
under test, so the check covers the real reader.
"""
from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from ..functions.prompts import LOADER_HINT
from ..operators import ledger as L
from ..operators import scoring as S
from ..session import checkpoint_path, spread
from ..sources import ledger_io as LIO
from ..sources.problems import read_problems
from . import fixture_sql as Q
from .fixtures import attempts, problems
from .q_ledger import SUMMARY_COLUMNS
from .registry import query
from .templates import sql_literal


def _scratch(spark, sf_dir: str, name: str) -> str:
    tag = hashlib.sha1(sf_dir.encode()).hexdigest()[:10]
    return checkpoint_path(spark, f"derived/{name}-{tag}")


def _write_lines(df, path: str) -> None:
    df.select(F.col("value").cast("string")).write.mode("overwrite").text(path)


@query("s1_problems", oracle=Q.with_ctes(Q.PROBLEMS) + """
SELECT CAST(item_id AS VARCHAR) AS problem_key, problem, '"' || answer || '"' AS answer FROM problems""")
def s1_problems(spark, sf_dir):
    path = _scratch(spark, sf_dir, "problems_jsonl")
    p = problems(spark, sf_dir)
    _write_lines(p.select(F.to_json(F.struct("problem", "answer", F.col("item_id").alias("id"),
                                             F.struct("test_list").alias("metadata"))).alias("value")), path)
    return read_problems(spark, path).select("problem_key", "problem", "answer")


@query("s2_mbpp", oracle=Q.with_ctes(Q.PROBLEMS) + f"""
SELECT CAST(item_id AS VARCHAR) AS problem_key,
  CASE WHEN len(test_list) > 0 THEN problem || {sql_literal(LOADER_HINT)}
       || array_to_string(list_transform(test_list[1:3], lambda x: '  ' || x || chr(10)), '') ELSE problem END AS problem,
  '"' || answer || '"' AS answer,
  array_to_string(CASE WHEN item_id % 3 = 2 THEN test_list ELSE list_concat(test_list, challenge_test_list) END, '|') AS tests
FROM problems""")
def s2_mbpp(spark, sf_dir):
    path = _scratch(spark, sf_dir, "mbpp_jsonl")
    p = problems(spark, sf_dir)
    iid = F.col("item_id")
    flat = F.to_json(F.struct("problem", "answer", iid.alias("id"),
                              F.struct("test_list", "challenge_test_list").alias("metadata")))
    nested = F.to_json(F.struct(F.struct(iid.alias("task_id"), F.col("problem").alias("text"),
                                         F.col("answer").alias("code"), "test_list", "challenge_test_list")
                                .alias("doc")))
    top = F.to_json(F.struct(iid.alias("task_id"), F.col("problem").alias("text"), F.col("answer").alias("code"),
                             "test_list"))
    line = F.when(iid % 3 == 0, flat).when(iid % 3 == 1, nested).otherwise(top)
    _write_lines(p.select(line.alias("value")), path)
    r = read_problems(spark, path)
    return r.select("problem_key", "problem", "answer", F.array_join("test_cases", "|").alias("tests"))


_A5_SQL = Q.with_ctes(Q.ATTEMPTS, Q.FIXED, Q.LATEST) + f"SELECT run_id, {Q.SUMMARY_SELECT} FROM latest GROUP BY run_id"


def _summary(df):
    return S.round_summary(S.summarize(L.latest_flags(df, columns=SUMMARY_COLUMNS), by=("run_id",)))


@query("s4_ledger_scan", oracle=_A5_SQL)
def s4_ledger_scan(spark, sf_dir):
    """Ledgers as JSON lines, with a header line, two corrupt lines and lines without run and place, read back and
    summarised — the summary is a pure function of the ledger."""
    path = _scratch(spark, sf_dir, "ledger_jsonl")
    # problem keys are JSON values in the ledger (here: strings)
    a = attempts(spark, sf_dir).withColumn("problem_key", F.concat(F.lit('"'), "problem_key", F.lit('"')))
    named = F.col("run_id").isin("run0", "run1")
    extra = spark.createDataFrame(
        [('{"%s": true, "identity_hash": "h"}' % LIO.HEADER_KEY,), ('{"run_id": "run0", broken',), ("not json",)],
        "value string")
    # its lines are in no order; spread, as the events' scan has few tasks
    _write_lines(LIO.ledger_json_lines(spread(a.where(named))).unionByName(extra), f"{path}/mixed.jsonl")
    for run in ("run2", "run3"):  # one ledger each; its lines name neither run nor place, their order does
        own = a.where(F.col("run_id") == run).repartitionByRange("seq").sortWithinPartitions("seq")
        _write_lines(LIO.ledger_json_lines(own.drop("run_id", "seq")), f"{path}/{run}.jsonl")
    return _summary(LIO.read_ledger_json(spark, f"{path}/*.jsonl"))


#: Run ids that are different texts, though the same number.
ALIKE = (("run0", "01"), ("run1", "1"), ("run2", "1.0"))
ALIKE_SQL = "CASE run_id " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ALIKE) + " ELSE run_id END AS run_id"


def alike_runs(df):
    run = F.col("run_id")
    for a, b in ALIKE:
        run = F.when(F.col("run_id") == a, F.lit(b)).otherwise(run)
    return df.withColumn("run_id", run)


@query("s5_append", oracle=f"SELECT * REPLACE ({ALIKE_SQL}) FROM ({_A5_SQL})")
def s5_append(spark, sf_dir):
    """Two appends (in event-type order) to a run-partitioned Parquet ledger, read back; run ids are texts."""
    path = _scratch(spark, sf_dir, f"ledger_parquet-{uuid.uuid4().hex[:12]}")
    a = alike_runs(attempts(spark, sf_dir))
    first = F.col("extraction_method") == "error"
    LIO.append_rows(a.filter(first), path)
    LIO.append_rows(a.filter(~first), path)
    return _summary(LIO.read_rows(spark, path))


_REQUESTED = "CAST(substr(run_id, 4) AS BIGINT)"


@query("s6_open", oracle=Q.with_ctes(Q.RUNS) + f"""
SELECT run_id, CASE WHEN k % 2 = 0 THEN CASE WHEN k % 5 = 3 OR k % 7 = 2 THEN 'refused' ELSE 'resumed' END WHEN k % 10 = 1 THEN 'bare' ELSE 'created' END AS outcome,
  CASE WHEN k % 2 = 0 THEN array_to_string(list_filter([CASE WHEN k % 5 = 3 THEN 'generation' END, CASE WHEN k % 7 = 2 THEN 'model' END], lambda x: x IS NOT NULL), ',') END AS changed,
  k % 2 = 0 OR k % 10 <> 1 AND k % 3 = 0 AS has_header
FROM (SELECT run_id, {_REQUESTED} AS k FROM runs)""")
def s6_open(spark, sf_dir):
    """S6 + J5: a ledger is opened for every second run, rows of some others come without a header; what opening it for all runs as requested
    then means, and which runs have a header after a second opening."""
    from .fixtures import runs
    from .q_runs import _requested
    path = _scratch(spark, sf_dir, f"ledger_open-{uuid.uuid4().hex[:12]}")
    k = F.substring("run_id", 4, 20).cast("bigint")
    registry = runs(spark, sf_dir)
    LIO.open_ledger(spark, path, registry.where(k % 2 == 0))
    LIO.append_rows(registry.where((k % 10 == 1) | (k % 2 == 0)).select("run_id", "model"), path)
    report = LIO.open_report(spark, path, _requested(spark, sf_dir)).select("run_id", "outcome", "changed")
    LIO.open_ledger(spark, path, registry.where((k % 3 == 0) & ((k % 10 != 1) | (k % 2 == 0))))
    header = LIO.read_headers(spark, path).select("run_id", F.lit(True).alias("_has"))
    # the report is as of the first opening: its plan names the folders that counted then
    return report.join(header, "run_id", "left").withColumn("has_header", F.coalesce("_has", F.lit(False))).drop("_has")


@query("s7_results", oracle=f"SELECT * REPLACE ({ALIKE_SQL}) FROM (" + Q.with_ctes(Q.ATTEMPTS, Q.FIXED, Q.LATEST, Q.RUNS) + f"""
SELECT l.run_id, l.problem_key, l.correct, r.provider, r.model, s.accuracy
FROM latest l JOIN runs r ON r.run_id = l.run_id
JOIN (SELECT run_id, {Q.SUMMARY_SELECT} FROM latest GROUP BY run_id) s ON s.run_id = l.run_id)""")
def s7_results(spark, sf_dir):
    """S7 + S8: results, summaries and redacted configs written, read back and joined."""
    from .fixtures import runs
    path = _scratch(spark, sf_dir, f"results-{uuid.uuid4().hex[:12]}")
    latest = L.latest_rows(attempts(spark, sf_dir), columns=("correct", "total_tokens", "error", "evaluator_error",
                                                            "model_response"))
    summaries = _summary(attempts(spark, sf_dir))
    reg = runs(spark, sf_dir).join(summaries.select("run_id"), "run_id", "left_semi")
    for run in (F.col("run_id") < "run2", F.col("run_id") >= "run2"):  # saved one after the other
        LIO.write_results(*[alike_runs(x.where(run)) for x in (latest, summaries, reg)], path)
    return LIO.read_results(spark, path).select("run_id", "problem_key", "correct", "provider", "model", "accuracy")


@query("s8_result_documents", oracle=Q.with_ctes(Q.ATTEMPTS, Q.FIXED, Q.LATEST, Q.RUNS) + f"""
SELECT r.run_id || '.json' AS document, to_json(l.problem_key)::VARCHAR AS problem_key, l.correct, l.total_tokens, l.latency, r.provider, r.model, s.total_problems, s.accuracy
FROM latest l JOIN runs r ON r.run_id = l.run_id JOIN (SELECT run_id, {Q.SUMMARY_SELECT} FROM latest GROUP BY run_id) s ON s.run_id = l.run_id""")
def s8_result_documents(spark, sf_dir):
    """One JSON document a run, with config (two removed keys in it), summary and the list of results, made from the ledger and read back."""
    from .fixtures import runs
    path = _scratch(spark, sf_dir, f"documents-{uuid.uuid4().hex[:12]}")
    a = attempts(spark, sf_dir)
    latest = L.latest_rows(a, columns=("correct", "total_tokens", "latency", "error", "evaluator_error", "model_response"))
    tokens = F.struct(F.col("total_tokens")).alias("tokens")
    results = latest.groupBy("run_id").agg(F.collect_list(F.struct(F.col("problem_key").alias("problem_id"), "correct", tokens, "latency")).alias("results"))
    config = runs(spark, sf_dir).select("run_id", F.struct("dataset_path", "provider", "model", "evaluator_type", F.lit("high").alias("reasoning_effort"),
                                                           F.lit(True).alias("enable_thinking")).alias("config"))
    summary = _summary(a).select("run_id", F.struct("total_problems", "correct_count", "accuracy", "total_tokens", "error_count").alias("summary"))
    docs = results.join(config, "run_id").join(summary, "run_id").withColumn("dataset_name", F.lit("d")).withColumn("schema_version", F.lit("1"))
    (docs.select(F.concat("run_id", F.lit(".json")).alias("file"), F.to_json(F.struct("schema_version", "config", "results", "summary", "dataset_name")).alias("value"))
     .write.partitionBy("file").text(path))
    rows = LIO.read_result_documents(spark, f"{path}/*")
    return rows.select(F.regexp_extract("document", "file=([^/]+)", 1).alias("document"), F.to_json("problem_id").alias("problem_key"), "correct", F.col("tokens.total_tokens").alias("total_tokens"),
                       "latency", "provider", "model", F.col("summary.total_problems").alias("total_problems"), F.col("summary.accuracy").alias("accuracy"))
