import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import compression_quality, lm_score, quality_rules, toxicity
from ledgerlens.llm.common import by_name

from .helpers import counted, empty, frame, key, odd_rows, words

MIDDLE = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def test_counts_odd_rows(spark):
    got = quality_rules.mark(frame(spark)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    want = []
    for d, t, *_ in odd_rows():
        c = counted(t)
        want.append((d, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def _plain_estimate(rows, rules):
    """The same model, row by row."""
    good, rates = quality_rules.START_GOOD, {r: dict(quality_rules.START) for r in rules}
    share = lambda r, c, v: {-1: rates[r][c][0], 1: rates[r][c][1], 0: 1 - sum(rates[r][c])}[v]
    for _ in range(quality_rules.STEPS):
        p = []
        for row in rows:
            a, b = good, 1 - good
            for r, v in zip(rules, row):
                a, b = a * share(r, "good", v), b * share(r, "bad", v)
            p.append(a / (a + b))
        n, held = len(rows), quality_rules.PRIOR * len(rows)
        new = {}
        for r, column in zip(rules, zip(*rows)):
            new[r] = {}
            for c, own, total in (("good", p, held * quality_rules.START_GOOD), ("bad", [1 - x for x in p], held * (1 - quality_rules.START_GOOD))):
                new[r][c] = tuple((sum(x for x, v in zip(own, column) if v == vote) + total * quality_rules.START[c][k]) / (sum(own) + total) for k, vote in enumerate((-1, 1)))
        was, good = good, (sum(p) + held * quality_rules.START_GOOD) / (n + held)
        moved = max(abs(good - was), *(abs(x - y) for r in rules for c in ("good", "bad") for x, y in zip(new[r][c], rates[r][c])))
        rates = new
        if moved < quality_rules.MOVED:
            break
    return good, rates


def test_estimation_equals_the_plain_one(spark):
    rules = list(quality_rules.votes())
    marked = quality_rules.mark(by_name(spark, SMALL, "documents"))
    rows = [tuple(r) for r in marked.select(*[f"vote_{r}" for r in rules]).collect()]
    good, rates = _plain_estimate(rows, rules)
    for r in marked.collect():
        a, b = good, 1 - good
        for rule in rules:
            v = r[f"vote_{rule}"]
            for c in ("good", "bad"):
                x = {-1: rates[rule][c][0], 1: rates[rule][c][1], 0: 1 - sum(rates[rule][c])}[v]
                a, b = (a * x, b) if c == "good" else (a, b * x)
        assert r["posterior"] == pytest.approx(a / (a + b), abs=1e-6)
        assert r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5)


def test_rules_agree_with_the_labels(spark):
    both = quality_rules.mark(by_name(spark, MIDDLE, "documents")).join(by_name(spark, MIDDLE, "labels"), "doc_id").where("not base_failed")
    n = {(r["quality"], r["kept"]): r["count"] for r in both.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.02 * n[1, True] and n.get((0, True), 0) <= 0.1 * n[0, False]


def test_no_python_on_the_rules_path(spark):
    plan = quality_rules.mark(by_name(spark, SMALL, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("module, label, least", [(compression_quality, "quality", 0.9), (toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, module, label, least):
    docs, labels = by_name(spark, MIDDLE, "documents"), by_name(spark, MIDDLE, "labels")
    rows = module.mark(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", label).collect()
    assert len(rows) > 40 and sum(a == b for a, b in rows) >= least * len(rows)


@pytest.mark.parametrize("module, label", [(compression_quality, "quality"), (toxicity, "toxic")])
def test_learning_looks_at_no_held_out_label(spark, module, label):
    docs, labels = by_name(spark, SMALL, "documents"), by_name(spark, SMALL, "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn(label, F.when(held, 1 - F.col(label)).otherwise(F.col(label)))
    scores = lambda l: sorted((r["doc_id"], r["score"]) for r in module.mark(docs, l).collect())
    assert scores(labels) == scores(turned)
    for r in module.mark(docs, labels).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1


@pytest.mark.parametrize("module", [compression_quality, toxicity])
def test_classifiers_on_odd_rows(spark, module):
    labels = by_name(spark, SMALL, "labels")
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 1), (1, None, None), (1, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int"))
    got = module.mark(by_name(spark, SMALL, "documents").select("doc_id", "text").unionByName(frame(spark, clashes=False).select("doc_id", "text")), odd).collect()
    assert len(got) == 200 + len(odd_rows()) and all(0 <= r["score"] <= 1 for r in got)
    got = module.mark(frame(spark), labels.where("false")).collect()
    assert len(got) == len(odd_rows()) and {r["score"] for r in got} == {0.5}
    one = module.mark(frame(spark), labels.where("quality = 1 and toxic = 0")).collect()
    assert {r["score"] for r in one} == {1.0 if module is compression_quality else 0.0}
    assert module.mark(empty(spark), labels).count() == 0


def test_quality_keep_returns_the_same_columns(spark):
    df = frame(spark)
    assert compression_quality.keep(df, by_name(spark, SMALL, "labels")).columns == df.columns


def _backoff(rows, order=2, alpha=0.4, least=2):
    grams = collections.Counter()
    for _, t in rows:
        w = words(t)
        grams.update(tuple(w[i:i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(len(words(t)) for _, t in rows)
    out = []
    for d, t in rows:
        w, sum_ = words(t), 0.0
        for i in range(len(w)):
            given = 1.0
            for n in range(min(order, i + 1), 0, -1):
                own = tuple(w[i - n + 1:i + 1])
                if n == 1:
                    sum_ += math.log(given * grams[own] / total)
                elif grams[own] >= least:
                    sum_ += math.log(given * grams[own] / grams[own[:-1]])
                    break
                else:
                    given *= alpha
        out.append((d, len(w), round(sum_, 5), round(sum_ / len(w), 7) if w else None))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_equals_the_plain_one(spark, order):
    rows = [(d, t) for d, t, *_ in odd_rows()]
    got = [(r["doc_id"], r["n_words"], round(r["log_score"], 5), r["mean_log_score"] if r["mean_log_score"] is None else round(r["mean_log_score"], 7)) for r in lm_score.score(frame(spark), order=order).collect()]
    want = _backoff(rows, order)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-6, abs=1e-4) and (a[3] is b[3] is None or a[3] == pytest.approx(b[3], rel=1e-6))


def test_backoff_of_nothing(spark):
    assert lm_score.score(empty(spark)).count() == 0


def test_triples_tell_scrambled_pairs_from_text(spark, duck_con):
    import __spark_entry__ as E
    from ledgerlens.plans.verify import _rows
    both = []
    for name in ("op9_lm_score", "op9_lm_score_pairs"):
        df = E.queries()[name](spark, SMALL)
        res = duck_con.execute(E.oracle_sql()[name])
        columns = [d[0] for d in res.description]
        both.append(_rows(df.columns, map(tuple, df.collect())))
        assert sorted(columns) == sorted(df.columns) and both[-1] == _rows(columns, res.fetchall())
    assert both[0] != both[1]
    # "a b e" is made of pairs that others have too, but its three words stand together nowhere else
    rows = [(1, "a b c"), (2, "a b c"), (3, "d b e"), (4, "d b e"), (5, "a b e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    two, three = ({r["doc_id"]: r["log_score"] for r in lm_score.score(docs, order=n).collect()} for n in (2, 3))
    assert three[5] == pytest.approx(two[5] + math.log(0.4)) and three[1] == pytest.approx(two[1] - math.log(2 / 5) + math.log(2 / 3))


def test_language_model_sends_few_bytes():
    """A batch's n-grams travel in fewer bytes than their hashes have, documents in about half of theirs, and both arrive whole."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 20_000, 500)) for _ in range(1000)] + ["", None]
    docs = pa.RecordBatch.from_pydict({"doc_id": [*range(1001), None], "text": [t or "" for t in texts], "batch": [i % 3 for i in range(1002)]})
    packed = pa.Table.from_batches(list(lm_score._pack(iter([docs]))))
    assert sorted(packed["batch"].to_pylist()) == [0, 1, 2]
    back = lm_score._docs(packed).to_pylist()
    assert sorted((d["doc_id"] if d["doc_id"] is not None else -1, d["text"]) for d in back) == sorted((i if i < 1001 else -1, t or "") for i, t in enumerate(texts))
    assert sum(map(len, packed["docs"].to_pylist())) < 0.6 * sum(len(t or "") for t in texts)
    one = packed.slice(0, 1)
    grams = [np.unique(g) for g in lm_score._ngrams(lm_score._docs(one), 3)[0]]
    sent = lm_score._entries(3, 5)(one)
    got = {n: [] for n in (1, 2, 3)}
    for r in sorted(sent.to_pylist(), key=lambda r: (r["n"], r["bucket"])):
        got[r["n"]].append(np.cumsum(lm_score._numbers(r["hashes"], np.uint64)))
    assert all((np.concatenate(got[n]) == grams[n - 1]).all() for n in got)
    assert sum(len(r["hashes"]) + len(r["counts"]) for r in sent.to_pylist()) < 7 * sum(map(len, grams))
