import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import mixing, packing
from ledgerlens.llm.common import by_name

from .helpers import empty, frame, odd_rows, words

SMALL = "/root/testdata/sf0.001"


def test_targets_fill_up_to_the_most(spark):
    per = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 1000), (None, 10), ("d", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(per).collect()}
    # order a b c d null, weights 3 1 2 3 1: a, d and null stop, b and c share the rest 1 to 2
    assert got["a"] == 200 and got["d"] == 0 and got[None] == 20
    assert got["c"] == pytest.approx(2 * got["b"]) and sum(got.values()) == pytest.approx(1.5 * 2110)


def test_mixing_odd_rows(spark):
    got = mixing.plan(frame(spark)).collect()
    assert len(got) == len(odd_rows())
    assert sorted(r["size"] for r in got) == sorted(len(words(t)) for _, t, *_ in odd_rows())
    for r in got:
        assert 0 <= r["copies"] <= 2
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan(frame(spark).repartition(3)).collect()))


def test_mix_repeats_rows_as_planned(spark):
    df = frame(spark)
    got = mixing.mix(df)
    assert got.columns == df.columns
    assert sum(len(words(r["text"])) for r in got.collect()) == sum(r["copies"] * r["size"] for r in mixing.plan(df).collect())


def test_taken_comes_near_the_target(spark):
    docs = by_name(spark, SMALL, "documents")
    taken, target, most = {}, {}, {}
    for r in mixing.plan(docs).collect():
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
        target[r["source"]] = r["target"]
        most[r["source"]] = max(most.get(r["source"], 0), r["size"])
    for s in taken:
        assert abs(taken[s] - target[s]) <= 2 * most[s] + 1


def test_empty(spark):
    assert mixing.plan(empty(spark)).count() == mixing.mix(empty(spark)).count() == packing.pack(empty(spark)).count() == 0


def _encoded(text):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.tokenizer_path())
    return t.encode(text or "", add_special_tokens=False).ids + [2]


def _check(rows, pieces):
    """Every id of every row lies in one piece; sequences are gapless, full or a power of two."""
    texts: dict = {}
    for d, t in rows:
        texts.setdefault(d, []).append(np.array(_encoded(t), "<u4").tobytes())
    found: dict = {}
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] > 0
        found.setdefault(p["doc_id"], []).append(p)
    assert set(found) == set(texts)
    for d, own in found.items():
        assert sum(p["length"] for p in own) == sum(len(x) // 4 for x in texts[d])
        for p in own:
            assert any(len(x) // 4 == p["doc_tokens"] and x[4 * p["start"]:4 * (p["start"] + p["length"])] == bytes(p["ids"]) for x in texts[d])
        if len(texts[d]) == 1:
            assert b"".join(bytes(p["ids"]) for p in sorted(own, key=lambda p: p["start"])) == texts[d][0]
    filled: dict = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == filled.get(p["sequence_id"], 0)
        filled[p["sequence_id"]] = p["offset"] + p["length"]
    assert all(0 < n <= 4096 and (n & (n - 1)) == 0 for n in filled.values())


def test_packing_odd_rows(spark):
    _check([(d, t) for d, t, *_ in odd_rows()], packing.pack(frame(spark)).collect())


def test_packing_in_small_lanes_keeps_the_shares(spark):
    docs = by_name(spark, SMALL, "documents")
    pieces = packing.pack(docs, lane=50_000).collect()
    _check([(r["doc_id"], r["text"]) for r in docs.collect()], pieces)


def test_words_are_tokens_of_their_own():
    rows = [t for _, t, *_ in odd_rows()] + ["it's <|endoftext|>x o'clock's don'T", "á é́ ́x", "Σ ΑΣ ΑΣ. 12ab34", "x,y;z!! ...a", "they're we'LL"]
    tokenizer = packing.WordTokenizer(packing.tokenizer_path(), most=3)
    for _ in range(2):
        ids, first = tokenizer(pa.array(rows))
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [_encoded(t)[:-1] for t in rows]
    ids, first = tokenizer(pa.array(rows).slice(3, 4))
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [_encoded(t)[:-1] for t in rows[3:7]]


@pytest.mark.parametrize("given", [True, False])
def test_serve_keeps_to_the_shares(given):
    lengths, share = {"a": 60_000, "b": 30_000, "c": 9_000, None: 1_000}, {"a": .6, "b": .3, "c": .09, None: .01}
    got, windows = dict.fromkeys(lengths, 0), list(packing.serve(lengths, {}, share if given else None))
    for k, window in enumerate(windows, 1):
        assert sum(n for _, n in window) == (4096 if k < len(windows) else 100_000 - 4096 * (len(windows) - 1))
        for s, n in window:
            got[s] += n
        if k < len(windows):
            for s in got:
                assert abs(got[s] - share[s] * 4096 * k) <= 2 * packing.BURST, (k, s)
    assert got == lengths


def test_serve_pays_what_is_carried_in_equal_parts():
    plain = list(packing.serve({"a": 50_000, "b": 50_000}, {}, {"a": .5, "b": .5}))
    owed = list(packing.serve({"a": 50_000, "b": 50_000}, {"a": 5000, "b": -5000}, {"a": .5, "b": .5}))
    sums = lambda windows, k: sum(n for w in windows[:k] for s, n in w if s == "a")
    for k in (6, 12, 18):
        assert sums(owed, k) - sums(plain, k) == pytest.approx(5000 * k / 25, abs=2 * packing.BURST)


def _away(pieces):
    """Of each full sequence, how far the shares of its sources are from those of all tokens (total variation)."""
    full = pieces.groupby("sequence_id").length.transform("sum") == 4096
    share = pieces[full].pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum", fill_value=0) / 4096
    whole = pieces.groupby("source").length.sum() / pieces.length.sum()
    return share.sub(whole, axis=1).abs().sum(axis=1) / 2


def test_windows_have_the_mixture_of_all(spark):
    away = _away(packing.pack(by_name(spark, "/root/testdata/sf0.01", "documents"), lane=100_000).drop("ids").toPandas())
    assert len(away) > 200 and away.mean() < 0.02 and away.max() < 0.08


def test_windows_have_the_mixture_with_a_long_document_and_a_hot_source(spark):
    docs = by_name(spark, SMALL, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")).alias("source"))
    long = spark.createDataFrame([(10**6, "one long text, " * 60_000, "a"), (10**6 + 1, None, None)], docs.select("doc_id", "text", "source").schema)
    docs = docs.union(long)
    pieces = packing.pack(docs, lane=40_960)
    _check([(r["doc_id"], r["text"]) for r in docs.collect()], pieces.collect())
    away = _away(pieces.fillna("none", subset=["source"]).drop("ids").toPandas())
    assert away.mean() < 0.05 and away.max() < 0.1


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0, "gone": 2.0}, {"a": 1.0, "b": 0.3, None: 0.1}])
def test_lanes_are_dealt_by_the_targets(weights):
    sizes = {"a": 9_001, "b": 40_000, "c": 17, None: 2_500}
    total = sum(sizes.values())
    course = packing.Course(total, weights and {s: (w, sizes.get(s, 0)) for s, w in weights.items()})
    queues = {s: course.queue(s, n) for s, n in sizes.items()}
    for x in range(0, total + 700, 700):
        given = {s: q.at(x) for s, q in queues.items()}
        assert abs(sum(n for n, _ in given.values()) - min(x, total)) <= 2 * len(sizes)
        assert all(-1 < owed <= 0 for _, owed in given.values())
        if weights is None:
            assert all(n + owed == pytest.approx(sizes[s] * min(x, total) / total) for s, (n, owed) in given.items())
        elif weights.get("gone") and 0 < x <= 12_000:
            assert given["a"][0] == pytest.approx(3 * given["b"][0], abs=4) and given["c"][0] == given[None][0] == 0
    for s, q in queues.items():
        lanes = [q.lane(place, 700) for place in range(sizes[s])]
        assert lanes == sorted(lanes) and all(q.at(n * 700)[0] <= p < q.at((n + 1) * 700)[0] for p, n in enumerate(lanes))


def test_weights_set_the_mixture(spark):
    docs = by_name(spark, SMALL, "documents").replace({"src0": "left"}, subset=["source"])
    pieces = packing.pack(docs, weights={"src1": 3.0, "src2": 1.0}).collect()
    first = {}
    for p in pieces:
        if p["sequence_id"] & 0xFFFF < 2 and p["source"] in ("src1", "src2"):
            first[p["source"]] = first.get(p["source"], 0) + p["length"]
    assert first["src1"] > 2 * first["src2"]
