"""Registries (U1, U2, U4) and streaming timers (T4, T5)."""
import pytest
from pyspark.sql import functions as F

from ledgerlens import registry as R


def test_grader_registry_rules(spark):
    with pytest.raises(ValueError, match="already registered"):
        R.register_grader("science")(lambda df, conf: df)
    with pytest.raises(ValueError, match="Registered evaluators: code, math, science"):
        R.get_grader("nope")

    @R.register_grader("contains_test")
    def contains(df, conf):
        return df.withColumn("correct", F.col("response").contains(F.col("truth")))

    df = spark.createDataFrame([("the answer is 42", "42"), ("no", "7")], "response string, truth string")
    assert [r.correct for r in R.grade(df, "contains_test").collect()] == [True, False]


def test_math_grader_needs_verdicts(spark):
    df = spark.createDataFrame([(1, "x")], "k int, response string")
    with pytest.raises(ValueError, match="judge verdicts"):
        R.grade(df, "math", {"keys": ["k"]})
    verdicts = spark.createDataFrame([(1, '{"correct": true, "extracted_answer": "x", "reasoning": "ok"}')],
                                     "k int, content string")
    r = R.grade(df, "math", {"keys": ["k"], "verdicts": verdicts}).collect()[0]
    assert r.correct is True and r.extraction_method == "no_answer_block" and r.evaluator_error is None


def test_provider_registry(spark):
    assert set(R.available_providers()) - {"mirror"} == {"anthropic", "chat_completion", "gemini", "openai-responses"}
    with pytest.raises(ValueError, match="unknown provider"):
        R.get_provider("x")
    p = R.get_provider("anthropic")
    assert p.protected_paths == ("model", "messages", "stream")


def test_token_counter_hook(spark):
    with pytest.raises(ValueError):
        R.register_token_counter("estimate", lambda t: t)
    R.register_token_counter("words_test", lambda t: F.struct(F.size(F.split(t, " ")).cast("bigint").alias("n"),
                                                               F.lit(False).alias("estimated")))
    from ledgerlens.functions import usage as U
    df = spark.createDataFrame([(5, 50, "one two three")], "p bigint, o bigint, t string")
    u = df.select(U.messages_usage("p", "o", F.lit(None).cast("bigint"), "t",
                                   R.token_counter("words_test")(F.col("t"))).alias("u")).collect()[0].u
    assert (u.answer_tokens, u.reasoning_tokens, u.answer_tokens_estimated) == (3, 47, False)


def test_code_grader_keeps_rows_and_bounds_output(spark):
    loud = "import sys\nprint('x' * 5_000_000)\nsys.stderr.write('e' * 100)\ndef f(x):\n    return x + 1"
    rows = [(1, "<solution>def f(x): return x + 1</solution>"), (1, "<solution>def f(x): return x</solution>"), (2, f"<solution>{loud}</solution>"), (3, "no code")]
    df = spark.createDataFrame([(k, r, ["assert f(1) == 2", "assert f(2) == 3"]) for k, r in rows], "k int, response string, tests array<string>")
    got = sorted((r.k, r.tests_passed, r.correct, r.execution_error) for r in R.grade(df, "code").collect())
    assert got == [(1, 0, False, "FAILED Test 1: assert f(1) == 2\nFAILED Test 2: assert f(2) == 3"), (1, 2, True, None), (2, 2, True, None), (3, 0, False, "Failed to extract code")]


def test_counter_sees_only_what_must_be_counted(spark):
    from ledgerlens.functions import usage as U
    seen = []
    rows = [("anthropic", '{"input_tokens":1,"output_tokens":9}', "a b"), ("anthropic", '{"input_tokens":1,"output_tokens":9,"output_tokens_details":{"thinking_tokens":4}}', "c d e"),
            ("gemini", "{}", "f g")]
    df = spark.createDataFrame(rows, "provider string, usage string, final_text string").withColumn("u", U.parse_usage("usage"))

    def counter(text):
        seen.append(text)
        return F.struct(F.size(F.split(text, " ")).cast("bigint").alias("n"), F.lit(False).alias("estimated"))

    n = U.normalize_usage_frame(df, counter=counter, out="n")
    assert sorted(r.n.answer_tokens for r in n.where("provider = 'anthropic'").collect()) == [2, 5]
    assert [r[0] for r in df.select(seen[0]).collect()] == ["a b", None, None]


def test_rejudging_keeps_the_graders_failure(spark):
    from ledgerlens.operators.resume import rejudge_projection
    pairs = spark.createDataFrame([("r", "p", 1, "q", "problem", "t", "resp", 5, 1.0, "stop")],
                                  "run_id string, problem_key string, seq long, question string, problem string, ground_truth string, model_response string, total_tokens long, latency double, finish_reason string")
    failing = lambda df: df.withColumns({"correct": F.lit(False), "extraction_method": F.lit("x"), "evaluator_error": F.lit("no verdict"), "judge_reasoning": F.lit("?")})
    r = rejudge_projection(pairs, failing).collect()[0]
    assert (r.evaluator_error, r.judge_reasoning, r.error) == ("no verdict", "?", None)


def test_only_counters_that_can_be_asked_for_are_offered():
    assert not hasattr(R, "tokenizer_counter")
    with pytest.raises(ValueError, match="Registered: .*estimate"):
        R.token_counter("tokenizer")
