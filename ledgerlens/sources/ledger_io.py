"""Ledger and result-document sources and sinks (S4-S8, H7, J5 on open).

Layout on shared storage (every path is a folder, written by Spark tasks):

* ``<ledger>/rows``  — attempt rows, Parquet, partitioned by ``run_bucket`` (a hash of the run) and ``arrival``, within a file by run, so folders don't
  grow with the runs; rows from before, partitioned by ``run_id`` and ``arrival``, are read with them;
* ``<ledger>/header`` — one identity row per run (hash + components), in folders that a log of numbered
  entries names; an entry is made only if its number is free, so headers are added one opener after the other;
* JSON-lines ledgers written by other tools are read with :func:`read_ledger_json`:
  a header line carries a truthy flag key and is split off; corrupt lines are dropped
  (PERMISSIVE + ``_corrupt_record``); lines split on ``\\n`` only.
"""
from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_blank, non_empty
from ..operators import runs as RU
from . import files
from .lines import numbered_lines

# Folders of an arrival's rows, at most.
RUN_BUCKETS = 64
# The run a file's lines belong to, in files and folders named <run>.jsonl.
RUN_OF_FILE = r"([^/]+?)(?:\.jsonl)?(?:/part-[^/]*)?$"
# Flag key of a JSON-lines ledger header (configurable per call).
HEADER_KEY = "__ledger_header__"

TOKENS = ("prompt_tokens", "answer_tokens", "reasoning_tokens", "output_tokens", "total_tokens")

LEDGER_JSON_SCHEMA = (
    "run_id STRING, seq BIGINT, problem_id VARIANT, question STRING, formatted_prompt STRING, "
    "ground_truth VARIANT, model_response STRING, extracted_answer VARIANT, correct BOOLEAN, "
    "tokens STRUCT<prompt_tokens: BIGINT, answer_tokens: BIGINT, reasoning_tokens: BIGINT, "
    "output_tokens: BIGINT, total_tokens: BIGINT, answer_tokens_estimated: BOOLEAN, completion_tokens: BIGINT, "
    "unattributed_tokens: BIGINT>, latency DOUBLE, error STRING, evaluator_error STRING, extraction_method STRING, "
    "finish_reason STRING, judge_reasoning STRING, tests_passed BIGINT, tests_total BIGINT, execution_error STRING"
)

# A result document of the reference; fields that aren't named here (the two removed config keys among them) are dropped.
RESULT_FIELDS = LEDGER_JSON_SCHEMA.removeprefix("run_id STRING, seq BIGINT, ")
RESULT_DOCUMENT_SCHEMA = (
    "schema_version STRING, config STRUCT<dataset_path: STRING, provider: STRING, model: STRING, evaluator_type: STRING, "
    "experiment_name: STRING, notes: STRING>, summary STRUCT<total_problems: BIGINT, correct_count: BIGINT, accuracy: DOUBLE, "
    "total_tokens: BIGINT, error_count: BIGINT, ock_score: DOUBLE>, timestamp STRING, dataset_name STRING, "
    f"results ARRAY<STRUCT<{RESULT_FIELDS}>>"
)


def read_ledger_json(spark: SparkSession, path: str, header_key: str = HEADER_KEY) -> DataFrame:
    """S4 + H7: ledger rows of JSON-lines files, header and corrupt lines removed, tokens
    flattened (the legacy ``completion_tokens`` alias fills a missing answer count).

    A line that names no run belongs to the run its file (or folder of part files) is named
    after, ``<run>.jsonl``; one without a sequence number has its place in that run's lines."""
    schema = f"`{header_key}` BOOLEAN, " + LEDGER_JSON_SCHEMA + ", _corrupt_record STRING"
    lines = numbered_lines(spark, path, F.regexp_extract("file", RUN_OF_FILE, 1)).where(~is_blank("value"))
    raw = lines.select("group", "line", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("j"))
    raw = raw.select("group", "line", "j.*")
    body = raw.filter(F.col("_corrupt_record").isNull() & ~F.coalesce(F.col(f"`{header_key}`"), F.lit(False)))
    body = body.withColumns({"run_id": F.coalesce("run_id", F.try_url_decode("group")), "seq": F.coalesce("seq", "line")})
    t = F.col("tokens")
    zero = F.lit(0).cast("bigint")
    return body.select(
        "run_id", "seq", F.to_json("problem_id").alias("problem_key"), "question", "formatted_prompt",
        F.to_json("ground_truth").alias("ground_truth"), "model_response",
        F.to_json("extracted_answer").alias("extracted_answer"), "correct",
        F.coalesce(t["prompt_tokens"], zero).alias("prompt_tokens"),
        F.coalesce(t["answer_tokens"], t["completion_tokens"], zero).alias("answer_tokens"),
        F.coalesce(t["reasoning_tokens"], zero).alias("reasoning_tokens"),
        F.coalesce(t["output_tokens"], zero).alias("output_tokens"),
        F.coalesce(t["total_tokens"], zero).alias("total_tokens"),
        "latency", "error", "evaluator_error", "extraction_method", "finish_reason", "judge_reasoning",
        "tests_passed", "tests_total", "execution_error")


def ledger_json_lines(ledger: DataFrame) -> DataFrame:
    """Ledger rows as JSON lines in the nested layout (``tokens`` object), for export."""
    tok = F.struct(*[F.col(c) for c in TOKENS])
    other = [c for c in ledger.columns if c not in TOKENS and c not in ("problem_key",)]
    return ledger.select(F.to_json(F.struct(F.parse_json("problem_key").alias("problem_id"),
                                            *[F.col(c) for c in other], tok.alias("tokens"))).alias("value"))


def append_rows(ledger: DataFrame, path: str, arrival: str | None = None) -> None:
    """Add attempt rows as an arrival of their own, partitioned by a hash of the run and sorted by run, so that a run's rows are read from few files.

    An arrival that is written again (a repeated micro-batch) replaces itself, so rows are
    added once; arrivals of batches and of streams lie side by side."""
    bucket = F.pmod(F.xxhash64(F.col("run_id").cast("string")), F.lit(RUN_BUCKETS)).cast("int")
    rows = ledger.withColumns({"run_id": F.col("run_id").cast("string"), "run_bucket": bucket, "arrival": F.lit(arrival or f"append-{uuid.uuid4().hex}")})
    (rows.sortWithinPartitions("run_bucket", "arrival", "run_id").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run_bucket", "arrival").parquet(f"{path.rstrip('/')}/rows"))


def read_by_run(spark: SparkSession, path: str, *partitions: str, form: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """A folder partitioned by text columns, which stay text: left to itself Spark types folder names, and ``01``, ``1`` and ``1.0`` become one run.

    Without ``schema``, the columns within the files are those of the files."""
    within = schema or spark.read.format(form).option("recursiveFileLookup", True).load(path).schema
    named = T.StructType([*[f for f in within.fields if f.name not in partitions], *[T.StructField(p, T.StringType()) for p in partitions]])
    return spark.read.schema(named).format(form).load(path)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    base = f"{path.rstrip('/')}/rows"
    folders = files.names(spark, base, folders=True)
    own = [f"{base}/{n}" for n in folders if n.startswith("run_bucket=")]
    older = [f"{base}/{n}" for n in folders if n.startswith("run_id=")]
    if not own:
        return read_by_run(spark, base, "run_id", "arrival").drop("arrival")
    rows = spark.read.option("basePath", base).parquet(*own).drop("run_bucket", "arrival")
    if older:
        within = spark.read.option("recursiveFileLookup", True).parquet(*older).schema
        named = T.StructType([*[f for f in within.fields if f.name not in ("run_id", "arrival")], T.StructField("run_id", T.StringType()), T.StructField("arrival", T.StringType())])
        rows = rows.unionByName(spark.read.schema(named).option("basePath", base).parquet(*older).drop("arrival"), allowMissingColumns=True)
    return rows


HEADER = "run_id string, identity_hash string, identity map<string,string>"


def _headers(spark: SparkSession, path: str) -> tuple[DataFrame | None, int, list[str]]:
    """The stored headers, the number of the last log entry and the folders that it names."""
    base = f"{path.rstrip('/')}/header"
    log = files.names(spark, f"{base}/log")
    log = [n for n in log if n.endswith(".json")]
    folders = json.loads(files.read_text(spark, f"{base}/log/{log[-1]}"))["folders"] if log else []
    paths = [f"{base}/{f}" for f in folders]
    paths += [f"{base}/{n}" for n in files.names(spark, base) if n.endswith(".parquet")]  # headers from before there was a log
    return (spark.read.schema(HEADER).parquet(*paths) if paths else None), int(log[-1].removesuffix(".json")) if log else 0, folders


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """H7: the headers of a ledger's runs."""
    stored = _headers(spark, path)[0]
    return stored if stored is not None else spark.createDataFrame([], HEADER)


def open_report(spark: SparkSession, path: str, runs: DataFrame) -> DataFrame:
    """S6 + J5: what opening the ledger means for each run: ``created`` (no header, no rows yet), ``resumed``, ``refused`` (another configuration: ``changes``
    names the components with both sides) or ``bare`` (rows without a header)."""
    return _report(spark, path, RU.with_identity(runs).select("run_id", "identity_hash", "identity"), read_headers(spark, path))


def _report(spark: SparkSession, path: str, current: DataFrame, stored: DataFrame) -> DataFrame:
    checked = RU.identity_check(stored, current)
    known = checked.select("run_id", F.when(F.col("resumable"), "resumed").otherwise("refused").alias("outcome"), "changed", "changes")
    new = current.select("run_id").join(stored.select("run_id"), "run_id", "left_anti").withColumn("outcome", F.lit("created"))
    if files.names(spark, f"{path.rstrip('/')}/rows", folders=True):
        bare = read_rows(spark, path).select(F.col("run_id").alias("_bare")).distinct()
        new = new.join(bare, F.col("run_id") == F.col("_bare"), "left").withColumn("outcome", F.when(F.col("_bare").isNull(), F.col("outcome")).otherwise("bare")).drop("_bare")
    return known.unionByName(new, allowMissingColumns=True)


def open_ledger(spark: SparkSession, path: str, runs: DataFrame) -> None:
    """S6 + J5: create headers for new runs; refuse runs whose stored identity differs, and runs that
    have rows but no header.  All runs are opened, or none.

    New headers are written to a folder of their own and count once a log entry names it.  Where another opener has made that entry in the meantime, the
    check is made again on what it stored, so of two openers with different configurations of a run one is refused.
    Only the report on the refused runs reaches the driver, to raise with all of them, the
    components that changed and both sides."""
    base = f"{path.rstrip('/')}/header"
    asked = f"{base}/asked-{uuid.uuid4().hex}"  # identities are worked out once
    try:
        RU.with_identity(runs).select("run_id", "identity_hash", "identity").write.parquet(asked)
        _open(spark, path, base, spark.read.schema(HEADER).parquet(asked))
    finally:
        files.remove(spark, asked)


def _open(spark: SparkSession, path: str, base: str, current: DataFrame) -> None:
    while True:
        stored, last, folders = _headers(spark, path)
        report = _report(spark, path, current, stored if stored is not None else spark.createDataFrame([], HEADER))
        said = []
        for r in report.where(F.col("outcome").isin("refused", "bare")).orderBy("run_id").collect():
            sides = "; ".join(f"{c.component}: stored {c.stored}, current {c.current}" for c in r.changes or [])
            said.append(f"ledger run '{r.run_id}' has rows but no header" if r.outcome == "bare" else f"ledger run '{r.run_id}' belongs to a different configuration ({sides})")
        if said:
            raise ValueError("\n".join(said))
        created = report.where("outcome = 'created'").select("run_id")
        if created.isEmpty():
            return
        folder = f"data-{uuid.uuid4().hex}"
        current.join(created, "run_id", "left_semi").write.parquet(f"{base}/{folder}")
        if files.create(spark, f"{base}/log/{last + 1:012d}.json", json.dumps({"folders": [*folders, folder]})):
            return
        files.remove(spark, f"{base}/{folder}")


def write_results(latest: DataFrame, summaries: DataFrame, runs: DataFrame, path: str) -> None:
    """Results, summaries and the redacted configuration as three tables, plus one JSON
    document per run (config + summary) next to its results as JSON lines.

    A run's results are never gathered into one row: the document's ``results`` list is
    the folder ``results/run_id=<id>/`` of JSON lines."""
    base = path.rstrip("/")

    def save(df: DataFrame, name: str, form: str) -> None:
        # only the folders of the runs being written are replaced; those saved before stay
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").format(form).save(f"{base}/{name}")

    cfg = RU.redact_config(runs).withColumn("overrides_set", F.to_json("overrides_set"))
    save(latest, "results", "parquet")
    save(summaries, "summaries", "parquet")
    save(cfg, "config", "parquet")
    doc = summaries.join(cfg, "run_id", "left").select(
        "run_id", F.to_json(F.struct(F.lit(RU.SCHEMA_VERSION).alias("schema_version"),
                                     F.struct(*[F.col(c) for c in cfg.columns if c != "run_id"]).alias("config"),
                                     F.struct(*[F.col(c) for c in summaries.columns if c != "run_id"]).alias("summary"),
                                     F.current_timestamp().cast("string").alias("timestamp"))).alias("document"))
    save(doc, "documents", "text")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results joined to their run's document fields; a document without a provider
    fails the read (identity fields are required)."""
    base = path.rstrip("/")
    results = read_by_run(spark, f"{base}/results", "run_id")
    docs = read_by_run(spark, f"{base}/documents", "run_id", form="text").select(
        "run_id", F.from_json("value", "config STRUCT<provider: STRING, model: STRING>, "
                                        "summary STRUCT<accuracy: DOUBLE, efficiency_score: DOUBLE>").alias("d"))
    docs = docs.select("run_id", F.assert_true(non_empty("d.config.provider"),
                                               F.lit("result document lacks provider")).alias("_ok"),
                       F.col("d.config.provider").alias("provider"), F.col("d.config.model").alias("model"),
                       F.col("d.summary.accuracy").alias("accuracy"), F.col("d.summary.efficiency_score").alias("efficiency_score"))
    return results.join(docs.filter(F.col("_ok").isNull()).drop("_ok"), "run_id", "left")


def read_result_documents(spark: SparkSession, path: str) -> DataFrame:
    """S8 on documents of the reference: each file one JSON document with config, summary and a
    ``results`` list; one row per result, with its place in the list and its document's fields.

    A document that isn't JSON, or lacks an identity field, its summary or its results, fails the
    read, also where its list is empty.  A document is read by one task, as its format demands."""
    docs = spark.read.schema(RESULT_DOCUMENT_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    needed = ("config.provider", "config.model", "config.dataset_path", "dataset_name", "summary", "results")
    results = F.col("results")
    for name in reversed(needed):  # part of the list itself, so that no plan can leave the test out
        results = F.when(F.col(name).isNotNull(), results).otherwise(F.raise_error(F.lit(f"result document lacks {name}")))
    rows = docs.select(F.input_file_name().alias("document"), "schema_version", "dataset_name", "timestamp", "config.dataset_path", "config.provider",
                       "config.model", "config.evaluator_type", "config.experiment_name", "summary", F.posexplode(results).alias("position", "_result"))
    return rows.select("*", "_result.*").drop("_result")
