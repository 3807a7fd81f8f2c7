"""Retry policy, budget flags, text pick, summary fixes, comparisons and artifact names
(P9, P11-P13, T4, C4, P16, P18, A7, A8, A9, J8, S10)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import extract as X
from ..operators import chunks as CH
from ..operators import ledger as L
from ..operators import runs as RU
from ..operators import scoring as S
from . import fixture_sql as Q
from . import sql_chunks as SC
from .fixtures import chunk_lines, failures, generate_responses, runs, sibling_runs
from .fixtures import attempts as attempts_f
from .q_ledger import SUMMARY_COLUMNS
from .registry import query
from .q_extract import X9_SQL
from .sql_extract import q as sq

_F = Q.with_ctes(Q.FAILURES)
_KW = lambda words: "(" + " OR ".join(f"contains(lower(message), {sq(w)})" for w in words) + ")"
_NONRETRY = (f"(status_code IN ({', '.join(str(x) for x in C.NON_RETRYABLE_STATUS)}) OR "
             f"{_KW(C.NON_RETRYABLE_KEYWORDS)})")


@query("p11_final", oracle=_F + f"SELECT event_id, coalesce({_NONRETRY}, false) AS non_retryable FROM failures")
def p11_final(spark, sf_dir):
    f = failures(spark, sf_dir)
    return f.select("event_id", C.non_retryable("status_code", "message").alias("non_retryable"))


@query("p12_wait", oracle=_F + f"""
SELECT event_id, CASE WHEN {_KW(C.PRESSURE_KEYWORDS)} THEN least(10.0 * pow(2.0, attempt), 120.0)
                      ELSE least(pow(2.0, attempt), 30.0) END AS base_wait FROM failures""")
def p12_wait(spark, sf_dir):
    f = failures(spark, sf_dir)
    return f.select("event_id", C.base_wait("message", "attempt").alias("base_wait"))


@query("p13_eligible", oracle=_F + f"""
SELECT event_id, attempt < max_retries - 1 AND NOT coalesce({_NONRETRY}, false) AS eligible,
       [5.0::DOUBLE, 15.0::DOUBLE, 45.0::DOUBLE][least(attempt + 1, 3)] AS judge_wait FROM failures""")
def p13_eligible(spark, sf_dir):
    f = failures(spark, sf_dir)
    return f.select("event_id", C.retry_eligible("status_code", "message", "attempt", "max_retries").alias("eligible"),
                    C.judge_backoff("attempt").alias("judge_wait"))


@query("p9_budget", oracle=_F + """
SELECT event_id, provider, finish_reason, coalesce(CASE provider
    WHEN 'chat_completion' THEN finish_reason = 'length' WHEN 'anthropic' THEN finish_reason = 'max_tokens'
    WHEN 'openai-responses' THEN starts_with(finish_reason, 'incomplete')
    WHEN 'gemini' THEN contains(finish_reason, 'MAX_TOKENS') END, false) AS budget_exhausted FROM failures""")
def p9_budget(spark, sf_dir):
    f = failures(spark, sf_dir)
    return f.select("event_id", "provider", "finish_reason",
                    C.budget_exhausted("provider", "finish_reason").alias("budget_exhausted"))


@query("t4_deadline", oracle=_F + f"""
SELECT event_id, CASE WHEN provider = 'chat_completion' AND latency > 250 THEN
  {sq(C.WALL_CLOCK_TIMEOUT)} || '250s' END AS deadline_error FROM failures""")
def t4_deadline(spark, sf_dir):
    f = failures(spark, sf_dir).withColumn(
        "limit_s", F.when(F.col("provider") == "chat_completion", F.lit(250)).cast("bigint"))
    return f.select("event_id", C.deadline_error("latency", "limit_s").alias("deadline_error"))


_PICK = ("coalesce(nullif(text, ''), nullif(array_to_string(list_filter(parts, lambda p: length(p) > 0), ' '), ''), "
         "nullif(candidate_text, ''), '')")


@query("c4_pick", oracle=Q.with_ctes(Q.GENERATE_RESPONSES) + f"""
SELECT doc_id, sha256({_PICK}) AS text_sha, length({_PICK})::BIGINT AS text_chars,
       contains(finish_reason, 'MAX_TOKENS') AS budget_exhausted FROM generate_responses""")
def c4_pick(spark, sf_dir):
    g = generate_responses(spark, sf_dir).withColumn("t", CH.pick_text("text", "parts", "candidate_text"))
    return g.select("doc_id", F.sha2("t", 256).alias("text_sha"), F.length("t").cast("bigint").alias("text_chars"),
                    C.budget_exhausted(F.lit("gemini"), "finish_reason").alias("budget_exhausted"))


_A5 = Q.with_ctes(Q.ATTEMPTS, Q.FIXED, Q.LATEST)


@query("p16_summary_fill", oracle=_A5 + f"""
SELECT run_id, total_answer_tokens, total_output_tokens FROM (SELECT run_id, {Q.SUMMARY_SELECT} FROM latest GROUP BY run_id)""")
def p16_summary_fill(spark, sf_dir):
    from .q_ledger import run_summary
    s = run_summary(spark, sf_dir)
    legacy = F.col("run_id").isin("run1", "run3")
    stored = s.withColumns({
        "total_completion_tokens": F.when(legacy, F.col("total_answer_tokens")),
        "total_answer_tokens": F.when(~legacy, F.col("total_answer_tokens")),
        "total_output_tokens": F.when(legacy, F.lit(0).cast("bigint")).otherwise(F.col("total_output_tokens")),
    })
    return S.fill_summary_aliases(stored).select("run_id", "total_answer_tokens", "total_output_tokens")


@query("p18_ledger_rows", oracle=f"""
SELECT request_id,
  CASE WHEN raised OR failed THEN false ELSE coalesce(contains(text, 'v'), false) END AS correct,
  CASE WHEN raised THEN 'exception' WHEN failed THEN 'error' ELSE 'contains' END AS extraction_method,
  CASE WHEN raised THEN 'lost ' || CAST(request_id AS VARCHAR) WHEN failed THEN coalesce(nullif(error, ''), {sq(C.DEFAULT_ERROR)}) END AS error,
  CASE WHEN NOT (raised OR failed) AND request_id % 7 = 2 THEN 'no verdict' END AS evaluator_error,
  CASE WHEN raised THEN 0 ELSE total_tokens END AS total_tokens, CASE WHEN NOT raised THEN finish_reason END AS finish_reason
FROM (SELECT *, error IS NOT NULL OR coalesce(finish_reason = 'error', false) AS failed, request_id % 11 = 4 AS raised FROM ({SC.responses_sql()}))""")
def p18_ledger_rows(spark, sf_dir):
    """Responses become ledger rows; some generations raised, some scorers fail."""
    from ..operators.resume import result_rows

    def grade(df):
        return df.withColumns({"correct": X.contains_grade("text", F.lit("v")), "extraction_method": F.lit("contains"),
                               "evaluator_error": F.when(F.col("request_id") % 7 == 2, F.lit("no verdict"))})

    r = CH.fold_responses(chunk_lines(spark, sf_dir, "responses"))
    r = r.withColumn("exception", F.when(F.col("request_id") % 11 == 4, F.concat(F.lit("lost "), F.col("request_id").cast("string"))))
    return result_rows(r, grade).select("request_id", "correct", "extraction_method", "error", "evaluator_error", "total_tokens", "finish_reason")


def _sums_with_runs(spark, sf_dir):
    latest = L.latest_flags(attempts_f(spark, sf_dir), columns=SUMMARY_COLUMNS)
    reg = runs(spark, sf_dir).select("run_id", "provider", "evaluator_type", "model")
    return S.run_sums(latest).join(reg, "run_id", "inner")


_RUN_JOIN = ("(SELECT l.*, r.provider, r.evaluator_type, r.model FROM latest l "
             "JOIN (SELECT run_id, provider, evaluator_type, model FROM runs) r ON r.run_id = l.run_id)")


# Attempts of 60 runs, so that groups have several.
_A7_RUN = "'run' || CAST(seq % 60 + 1 AS VARCHAR)"


def _a7_comparable_sql() -> str:
    import hashlib

    from ..functions.prompts import TEMPLATES
    from .q_runs import _sql_redact_url
    template = "CASE evaluator_type " + " ".join(f"WHEN '{n}' THEN '{hashlib.sha256(t.encode()).hexdigest()}'" for n, t in TEMPLATES.items()) + " ELSE 'raw' END"
    paths = lambda x: f"list_sort(list_distinct(coalesce({x}, []::VARCHAR[])))"
    fields = {"dataset_name": "dataset_name", "dataset_path": "dataset_path", "dataset_split": "dataset_split", "evaluator_type": "evaluator_type", "execution_timeout": "execution_timeout",
              "judge_base_url": _sql_redact_url("judge_base_url"), "judge_model": "judge_model", "judge_set": "[]::VARCHAR[]", "judge_unset": "[]::VARCHAR[]",
              "max_context_window": "max_context_window", "max_output_tokens": "max_output_tokens", "provider": "provider",
              "set_paths": paths("list_transform(overrides_entries, lambda e: e.key)"), "template_hash": template, "unset_paths": paths("overrides_unset"), "wall_clock_timeout": "wall_clock_timeout"}
    return f"sha256(to_json({{{', '.join(f"'{n}': {x}" for n, x in sorted(fields.items()))}}})::VARCHAR)"


def _a7_sql(select: str) -> str:
    spread = f"attempts AS (SELECT * REPLACE ({_A7_RUN} AS run_id) FROM attempts_by_four)"
    return Q.with_ctes(Q.ATTEMPTS.replace("attempts AS", "attempts_by_four AS", 1), spread, Q.FIXED, Q.LATEST, Q.RUNS, Q.SIBLING_RUNS,
                       f"joined AS (SELECT l.*, r.model, r.comparable_id FROM latest l JOIN (SELECT run_id, model, {_a7_comparable_sql()} AS comparable_id FROM sibling_runs) r USING (run_id))") + select


def _a7_sums(spark, sf_dir):
    a = attempts_f(spark, sf_dir).withColumn("run_id", F.concat(F.lit("run"), (F.col("seq") % 60 + 1).cast("string")))
    reg = sibling_runs(spark, sf_dir)
    reg = reg.select("run_id", "model", RU.comparable_id(reg).alias("comparable_id"))
    return S.run_sums(L.latest_flags(a, columns=SUMMARY_COLUMNS)).join(reg, "run_id", "inner")


@query("a7_compare", oracle=_a7_sql(f"""
SELECT *, row_number() OVER (PARTITION BY comparable_id ORDER BY efficiency_score DESC, accuracy DESC, run_id)::BIGINT AS rank, count(*) OVER g AS n_runs,
  round(max(accuracy) OVER g - accuracy, 6) AS accuracy_behind, round(max(efficiency_score) OVER g - efficiency_score, 9) AS score_behind
FROM (SELECT comparable_id, run_id, model, {Q.SUMMARY_SELECT} FROM joined GROUP BY comparable_id, run_id, model) WINDOW g AS (PARTITION BY comparable_id)"""))
def a7_compare(spark, sf_dir):
    """Accuracy and score side by side, ranked among the runs that may be compared and no others."""
    rows = S.round_summary(S.summary_from_sums(_a7_sums(spark, sf_dir), ["comparable_id", "run_id", "model"]))
    return S.compare_runs(rows).withColumns({"accuracy_behind": F.round("accuracy_behind", 6), "score_behind": F.round("score_behind", 9)})


@query("a7_totals", oracle=_a7_sql(f"""
SELECT comparable_id, model, GROUPING(comparable_id, model)::BIGINT AS grouping_level, {Q.SUMMARY_SELECT}
FROM joined GROUP BY GROUPING SETS ((comparable_id, model), (comparable_id))"""))
def a7_totals(spark, sf_dir):
    """Sub-totals per model, and of each group of comparable runs; none beyond a group."""
    return S.round_summary(S.summarize_rollup(_a7_sums(spark, sf_dir), ["comparable_id", "model"])).where("grouping_level < 3")


@query("a8_cube", oracle=Q.with_ctes(Q.ATTEMPTS, Q.FIXED, Q.LATEST, Q.RUNS) + f"""
SELECT provider, evaluator_type, GROUPING(provider, evaluator_type)::BIGINT AS grouping_level, {Q.SUMMARY_SELECT}
FROM {_RUN_JOIN} GROUP BY CUBE (provider, evaluator_type)""")
def a8_cube(spark, sf_dir):
    """Totals for every combination of provider and task (one shuffle)."""
    return S.round_summary(S.summarize_rollup(_sums_with_runs(spark, sf_dir), ["provider", "evaluator_type"],
                                              cube=True))


# The batch grid's reasoning efforts, tasks and per-task output budgets.
GRID_EFFORTS = ("low", "medium", "high")
GRID_TASKS = (("math", 32768), ("science", 16384), ("code", 24576))


@query("j8_grid", oracle=Q.with_ctes(Q.RUNS) + f"""
SELECT m.model, e.effort, t.task, t.budget FROM (SELECT DISTINCT model FROM runs) m,
  (SELECT unnest([{', '.join(sq(x) for x in GRID_EFFORTS)}]) AS effort) e,
  (SELECT unnest([{', '.join(sq(t) for t, _ in GRID_TASKS)}]) AS task,
          unnest([{', '.join(str(b) for _, b in GRID_TASKS)}])::BIGINT AS budget) t""")
def j8_grid(spark, sf_dir):
    """Model × effort × task for batch runs, generated by exploding fixed lists per model
    (no join), with the per-task budget looked up from the same fixed list."""
    models = runs(spark, sf_dir).select("model").distinct()
    tasks = F.array(*[F.struct(F.lit(t).alias("task"), F.lit(b).cast("bigint").alias("budget")) for t, b in GRID_TASKS])
    g = models.withColumn("effort", F.explode(F.array(*[F.lit(x) for x in GRID_EFFORTS]))) \
        .withColumn("t", F.explode(tasks))
    return g.select("model", "effort", "t.task", "t.budget")


def artifact_name(dataset_name, dataset_path, model, ts, ext: str = "json"):
    """``{dataset}_{model}_{yyyyMMdd_HHmmss}.{ext}`` with ``/`` and ``\\`` replaced by ``_``;
    the dataset name defaults to the file stem of its path."""
    stem = F.regexp_extract(dataset_path, r"([^/]*?)(\.[^./]*)?$", 1)
    name = F.coalesce(F.col(dataset_name) if isinstance(dataset_name, str) else dataset_name, stem)
    return F.concat(F.translate(name, "/\\", "__"), F.lit("_"), F.translate(F.col(model), "/\\", "__"), F.lit("_"),
                    F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit("." + ext))


@query("s10_artifact_path", oracle=Q.with_ctes(Q.RUNS) + """
SELECT r.run_id, translate(coalesce(r.dataset_name, regexp_extract(r.dataset_path, '([^/]*?)(\\.[^./]*)?$', 1)), '/\\', '__')
       || '_' || translate(r.model, '/\\', '__') || '_' || strftime(e.last_ts, '%Y%m%d_%H%M%S') || '.json' AS artifact
FROM runs r JOIN (SELECT 'run' || CAST(event_id % 4 AS VARCHAR) AS run_id, max(ts) AS last_ts FROM events GROUP BY 1) e
  ON e.run_id = r.run_id""")
def s10_artifact_path(spark, sf_dir):
    from ..sources.tables import table
    e = table(spark, sf_dir, "events").groupBy(F.concat(F.lit("run"), (F.col("event_id") % 4).cast("string"))
                                               .alias("run_id")).agg(F.max("ts").alias("last_ts"))
    r = runs(spark, sf_dir).join(e, "run_id")
    return r.select("run_id", artifact_name("dataset_name", "dataset_path", "model", F.col("last_ts")).alias("artifact"))


@query("a9_tests", oracle=f"""
SELECT d.lang, sum(tests_passed)::BIGINT AS tests_passed, sum(tests_total)::BIGINT AS tests_total, count_if(all_passed)::BIGINT AS all_passed
FROM ({X9_SQL}) JOIN documents d USING (doc_id) GROUP BY d.lang""")
def a9_tests(spark, sf_dir):
    """Tests passed / total per document language over the code runs."""
    from ..sources.tables import table
    from .q_extract import x9_run_tests
    g = x9_run_tests(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return g.groupBy("lang").agg(F.sum("tests_passed").alias("tests_passed"), F.sum("tests_total").alias("tests_total"),
                                 F.count_if("all_passed").alias("all_passed"))
