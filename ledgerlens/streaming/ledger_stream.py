"""Incremental ledger ingest and live summaries.

* T2: new ledger files (JSON lines) are picked up by the file source and added to the
  run-partitioned Parquet ledger, each micro-batch as an arrival that a repeated batch
  replaces.  Logical duplicates (a problem attempted again) are resolved later by
  latest-row de-dup.
* T3: each micro-batch is reduced to the latest attempt per problem (JVM aggregation) and compared with
  what its problems had before; a run's sums change by the difference.
"""
from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators import scoring as S
from ..sources import files
from ..sources.ledger_io import append_rows

ATTEMPT_SCHEMA = (
    "run_id STRING, problem_key STRING, seq BIGINT, question STRING, ground_truth STRING, model_response STRING, "
    "correct BOOLEAN, prompt_tokens BIGINT, answer_tokens BIGINT, reasoning_tokens BIGINT, output_tokens BIGINT, "
    "total_tokens BIGINT, latency DOUBLE, error STRING, evaluator_error STRING, extraction_method STRING, "
    "finish_reason STRING"
)


def read_attempts_stream(spark: SparkSession, src: str, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(ATTEMPT_SCHEMA).option("lineSep", "\n")
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.json(src)


def ingest(spark: SparkSession, src: str, ledger_path: str, checkpoint: str, files_per_trigger: int | None = None):
    """Add new attempt files to ``<ledger>/rows``, one arrival per micro-batch; a batch that
    runs again after a failure replaces its own arrival."""
    stream = hashlib.sha1(checkpoint.encode()).hexdigest()[:12]

    def add(batch: DataFrame, batch_id: int) -> None:
        append_rows(batch, ledger_path, f"stream-{stream}-{batch_id}")

    return (read_attempts_stream(spark, src, files_per_trigger).writeStream.foreachBatch(add)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


# Sums of a run's latest attempts.
SUMS = ("n", "n_correct", "total_tokens", "prompt_tokens", "answer_tokens", "reasoning_tokens", "output_tokens", "latency", "n_error")
# Summary sums (as named by ``scoring.summary_aggs``) ← contribution columns.
SUM_OF = (("total_problems", "n"), ("correct_count", "n_correct"), ("total_tokens", "total_tokens"),
          ("total_prompt_tokens", "prompt_tokens"), ("total_answer_tokens", "answer_tokens"),
          ("total_reasoning_tokens", "reasoning_tokens"), ("total_output_tokens", "output_tokens"),
          ("_latency_sum", "latency"), ("error_count", "n_error"))
KEY = ("run_id", "problem_key")
# Latency in sums: exact, so that what is taken out again leaves nothing behind.
SECONDS = "decimal(28,9)"
LATEST = "run_id string, problem_key string, seq long, " + ", ".join(f"{c} {SECONDS if c == 'latency' else 'long'}" for c in SUMS)
DELTAS = "run_id string, " + ", ".join(f"{c} {'decimal(38,9)' if c == 'latency' else 'long'}" for c in SUMS)
#: Rows a bucket holds on average before there are twice as many buckets; folders before a bucket, or the sums of a level, are merged.
BUCKET_ROWS, FOLDERS = 200_000, 4


def contributions(rows: DataFrame) -> DataFrame:
    """Row fixes (P15, P14), error flags, then one attempt's counts and sums (JVM-side)."""
    f = L.error_flags(L.migrate_legacy_errors(L.fill_token_usage(rows)))
    zero = F.lit(0).cast("bigint")
    return f.select(
        "run_id", "problem_key", "seq", F.lit(1).cast("bigint").alias("n"),
        F.when(F.coalesce(F.col("correct"), F.lit(False)), 1).otherwise(0).cast("bigint").alias("n_correct"),
        *[F.coalesce(F.col(c), zero).alias(c) for c in ("total_tokens", "prompt_tokens", "answer_tokens",
                                                         "reasoning_tokens", "output_tokens")],
        F.coalesce(F.col("latency"), F.lit(0.0)).cast(SECONDS).alias("latency"),
        F.when(F.col("gen_error") | F.col("eval_error"), 1).otherwise(0).cast("bigint").alias("n_error"))


def latest_contributions(rows: DataFrame) -> DataFrame:
    """Per ``(run, problem)`` the contribution of its latest attempt: one aggregation, combined before the shuffle."""
    return rows.groupBy(*KEY).agg(F.max("seq").alias("seq"), *[F.max_by(c, "seq").alias(c) for c in SUMS])


def differences(new: DataFrame, old: DataFrame) -> DataFrame:
    """By how much each run's sums change when ``new`` (a row per problem) meets ``old`` (any number of earlier rows of the problems): the later
    row in, the earlier latest row out.  Rows of a problem that are older than what was known change nothing."""
    known = old.join(new.select(*[F.col(k).alias(f"_{k}") for k in KEY]), F.col("run_id").eqNullSafe(F.col("_run_id")) & F.col("problem_key").eqNullSafe(F.col("_problem_key")), "left_semi")
    both = new.withColumn("was", F.lit(False)).unionByName(known.withColumn("was", F.lit(True)))
    before = F.when(F.col("was"), F.col("seq"))
    own = both.groupBy(*KEY).agg(*[F.max_by(c, "seq").alias(c) for c in SUMS], *[F.max_by(c, before).alias(f"{c}_was") for c in SUMS])
    return own.groupBy("run_id").agg(*[F.sum(F.col(c) - F.coalesce(F.col(f"{c}_was"), F.lit(0))).alias(c) for c in SUMS])


class Latest:
    """The latest rows, dealt to buckets by a hash of their problem, and the runs' sums.

    A trigger writes its own latest rows by bucket, reads the buckets it touched and no others, and adds the differences of its runs as a folder.  A bucket of
    ``FOLDERS`` folders is merged into one with a row per problem, four folders of differences into one of the next level.  The
    number of buckets doubles when they hold ``bucket_rows`` rows on average (all rows are dealt anew then, each a logarithmic
    number of times in all), so a bucket stays of bounded size and a trigger of few problems reads few rows however long the history is.

    A trigger becomes current by its version file, which names the folders that count; a trigger that runs again starts from the version before it."""

    def __init__(self, spark: SparkSession, path: str, bucket_rows: int = BUCKET_ROWS):
        self.base, self.bucket_rows = path.rstrip("/"), bucket_rows
        self.version = latest_version(spark, self.base) or {"batch_id": -1, "n": 1, "buckets": {}, "sums": [], "old": [], "read": 0}

    def _write(self, rows: DataFrame, name: str, n: int) -> dict[str, int]:
        """Write latest rows by bucket; how many rows each got."""
        spark = rows.sparkSession
        rows.withColumn("b", F.pmod(F.xxhash64(*KEY), F.lit(n)).cast("int")).repartition("b").write.partitionBy("b").parquet(f"{self.base}/latest/{name}")
        if not files.names(spark, f"{self.base}/latest/{name}", folders=True):
            return {}
        return {str(r["b"]): r["n"] for r in spark.read.schema("b int").parquet(f"{self.base}/latest/{name}").groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a bucket

    def _read(self, spark: SparkSession, buckets: dict, names) -> DataFrame:
        paths = [f"{self.base}/latest/{folder}/b={b}" for b in names for folder in buckets.get(b, {})]
        return spark.read.schema(LATEST).parquet(*paths) if paths else spark.createDataFrame([], LATEST)

    def _merge_sums(self, spark: SparkSession, sums: list[str], tag: str, old: list[str]) -> list[str]:
        level = 0
        while len(full := [f for f in sums if f.startswith(f"{level}-")]) >= FOLDERS:
            rows = spark.read.schema(DELTAS).parquet(*[f"{self.base}/sums/{f}" for f in full])
            rows.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in SUMS]).select("run_id", *[F.col(c).cast(dict(x.split(" ") for x in DELTAS.split(", "))[c]) for c in SUMS]).write.parquet(f"{self.base}/sums/{level + 1}-{tag}")
            old += [f"{self.base}/sums/{f}" for f in full]
            sums = [*[f for f in sums if f not in full], f"{level + 1}-{tag}"]
            level += 1
        return sums

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """One trigger: its rows are in, once, when this is done."""
        spark, before = batch.sparkSession, self.version
        if batch_id <= before["batch_id"]:
            return  # this batch is in already
        tag, n = f"{batch_id:012d}-{uuid.uuid4().hex[:8]}", before["n"]
        buckets, old = {b: dict(x) for b, x in before["buckets"].items()}, []
        own = self._write(latest_contributions(contributions(batch)), tag, n)
        read, sums = sum(sum(buckets.get(b, {}).values()) for b in own), list(before["sums"])
        if own:
            new = spark.read.schema(LATEST).parquet(f"{self.base}/latest/{tag}").drop("b")
            change = differences(new, self._read(spark, buckets, own))
            change.select("run_id", *[F.col(c).cast("decimal(38,9)" if c == "latency" else "long").alias(c) for c in SUMS]).write.parquet(f"{self.base}/sums/0-{tag}")
            sums = self._merge_sums(spark, [*sums, f"0-{tag}"], tag, old)
        for b, rows in own.items():
            buckets.setdefault(b, {})[tag] = rows
        total, grown = sum(sum(x.values()) for x in buckets.values()), n
        while total > self.bucket_rows * grown:
            grown *= 2
        full = list(buckets) if grown > n else [b for b, x in buckets.items() if len(x) >= FOLDERS]
        if full:
            read += sum(sum(buckets[b].values()) for b in full)
            merged = self._write(latest_contributions(self._read(spark, buckets, full)), f"{tag}-merged", grown)
            old += [f"{self.base}/latest/{folder}/b={b}" for b in full for folder in buckets.pop(b)]
            for b, rows in merged.items():
                buckets[b] = {f"{tag}-merged": rows}
        version = {"batch_id": batch_id, "n": grown, "buckets": buckets, "sums": sums, "old": old, "read": read}
        files.create(spark, f"{self.base}/version/{tag}.json", json.dumps(version))
        for path in before["old"]:  # what only the version before the last one named
            files.remove(spark, path)
        self.version = version


def latest_version(spark: SparkSession, base: str) -> dict | None:
    own = [n for n in files.names(spark, f"{base}/version") if n.endswith(".json")]
    return json.loads(files.read_text(spark, f"{base}/version/{own[-1]}")) if own else None


def live_summary(spark: SparkSession, src: str, summary_path: str, checkpoint: str,
                 files_per_trigger: int | None = None, bucket_rows: int = BUCKET_ROWS):
    """Run summaries over the latest attempt per problem, kept current per trigger (see ``Latest``).

    Sums are integers and decimals, so nothing is left of a row that is taken out; a latency counts to the nanosecond."""
    latest = Latest(spark, summary_path, bucket_rows)
    return (read_attempts_stream(spark, src, files_per_trigger).writeStream
            .foreachBatch(latest.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_summary(spark: SparkSession, summary_path: str) -> DataFrame:
    """The summaries as of the last published version: its folders of differences, which are a row a run each, added up."""
    base = summary_path.rstrip("/")
    version = latest_version(spark, base)
    if version is None:
        raise FileNotFoundError(f"no summary below {base}")
    rows = spark.read.schema(DELTAS).parquet(*[f"{base}/sums/{f}" for f in version["sums"]]) if version["sums"] else spark.createDataFrame([], DELTAS)
    sums = rows.groupBy("run_id").agg(*[F.sum(c).cast("double" if c == "latency" else "long").alias(s) for s, c in SUM_OF])
    return S.round_summary(S.summary_from_sums(sums)).withColumn("batch_id", F.lit(version["batch_id"]).cast("long"))
