"""Hot keys: sliced windows and two-level folds must not depend on the slice width.

One key is made to hold a third of all rows and the slice widths are shrunk so that
every key spans many slices; results are compared with the unsliced computation
(one window / one group per key), which is the brute-force definition.
"""
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators import chunks as CH
from ledgerlens.operators import ledger as L
from ledgerlens.plans import fixtures as FX

SF = "/root/testdata/sf0.01"


def _same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = a.select(*cols), b.select(*cols)
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0
    assert b.exceptAll(a).count() == 0


def _hot_attempts(spark):
    a = FX.attempts(spark, SF).select("run_id", "problem_key", "seq", "correct")
    hot = F.col("seq") % 3 == 0
    return a.withColumns({"run_id": F.when(hot, F.lit("run0")).otherwise(F.col("run_id")),
                          "problem_key": F.when(hot, F.lit("hot")).otherwise(F.col("problem_key"))})


@pytest.mark.parametrize("bucket", [2, 37])
def test_attempt_history_slices_match_plain_window(spark, bucket):
    a = _hot_attempts(spark)
    assert a.filter(F.col("problem_key") == "hot").count() * 3 >= a.count()
    got = L.attempt_history(a, bucket=bucket)
    w = Window.partitionBy("run_id", "problem_key")
    want = a.select("*",
                    F.row_number().over(w.orderBy("seq")).cast("bigint").alias("attempt_no"),
                    F.count(F.lit(1)).over(w).cast("bigint").alias("attempts"),
                    (F.col("seq") == F.max("seq").over(w)).alias("is_latest"))
    _same(got, want)


def test_dedupe_latest_hot_key(spark):
    a = _hot_attempts(spark)
    got = L.dedupe_latest(a, ["correct"])
    w = Window.partitionBy("run_id", "problem_key")
    want = (a.select("*", F.row_number().over(w.orderBy(F.col("seq").desc())).alias("_r"),
                     F.min("seq").over(w).alias("first_seq"))
            .filter("_r = 1").drop("_r"))
    _same(got, want)


@pytest.mark.parametrize("protocol, spec", [("chat", CH.chat_spec), ("responses", CH.responses_spec),
                                             ("messages", CH.messages_spec)])
def test_fold_slices_match_single_slice(spark, protocol, spec):
    lines = FX.chunk_lines(spark, SF, protocol)
    lines = lines.withColumn("request_id", F.when(F.col("seq") % 3 == 0, F.lit(-1))
                             .otherwise(F.col("request_id")))
    parsed = CH.parse_sse(lines)
    whole = CH.ordered_fold(parsed, spec(), bucket=1 << 40)
    for bucket in (2, 5):
        _same(CH.ordered_fold(parsed, spec(), bucket=bucket), whole)
