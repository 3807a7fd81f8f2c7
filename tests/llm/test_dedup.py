import hashlib
import re

import numpy as np
import pytest

from ledgerlens.llm import components, exact_dedup, near_dedup, substring_dedup
from ledgerlens.llm.common import by_name

from .helpers import empty, frame, jaccard_set, key, near_classes, odd_rows, sentence, stripped

SMALL = "/root/testdata/sf0.001"


def test_perfect_hash_is_minimal_and_checks_bytes():
    digests = [hashlib.sha256(b"%d" % i).digest() for i in range(5000)]
    sizes, bits = exact_dedup.perfect_hash(digests)
    assert sorted(exact_dedup.slots(digests, sizes, bits).tolist()) == list(range(5000))
    others = [hashlib.sha256(b"x%d" % i).digest() for i in range(1000)]
    found = exact_dedup.slots(others, sizes, bits)
    held = [None] * 5000
    for d, s in zip(digests, exact_dedup.slots(digests, sizes, bits)):
        held[s] = d
    assert not any(s >= 0 and held[s] == o for o, s in zip(others, found))
    assert exact_dedup.perfect_hash([])[0] == []


def _exact(rows):
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((d, len(t or "")))
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))[0]
        out += [(d, best, len(members), d == best, hashlib.sha256(norm.encode()).hexdigest()) for d, _ in members]
    return sorted(out, key=key)


@pytest.mark.parametrize("history", [None, "true", "false"])
def test_exact_odd_rows(spark, history):
    from pyspark.sql import functions as F
    got = exact_dedup.mark(frame(spark), None if history is None else F.expr(history)).collect()
    assert sorted(map(tuple, got), key=key) == _exact(odd_rows())


def test_exact_keep_leaves_one_whole_row_of_each(spark):
    df = frame(spark)
    got = exact_dedup.keep(df)
    assert got.columns == df.columns
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in got.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in odd_rows()})


def test_empty_tables(spark):
    none = empty(spark)
    assert exact_dedup.mark(none).count() == exact_dedup.keep(none).count() == 0
    assert near_dedup.mark(none).count() == near_dedup.keep(none).count() == 0
    assert substring_dedup.strip(none).count() == 0


@pytest.mark.parametrize("width", [4, near_dedup.SHINGLE])
def test_near_odd_rows(spark, width):
    rows = [(2**63 - 1 - (d is None and i) if d is None else d, t) for i, (d, t, *_) in enumerate(odd_rows())]
    want = near_classes(dict(rows).items(), width)
    got = near_dedup.mark(frame(spark), width=width).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            n, top = want[r["doc_id"]]
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (n, top, r["doc_id"] == top), r
        else:
            assert r["component_id"] in (None, 1)


def test_near_without_null_ids_equals_brute_force(spark):
    """Chains, a star whose arms are linked only through its centre, copies, strays on shared passages."""
    base = sentence(3, 200).split()
    rows = [(0, " ".join(base))]
    for k in range(1, 40):  # arms: each changes three words of its own
        arm = base[:]
        for j in range(3):
            arm[(k * 5 + j * 67) % 200] = f"arm{k}x{j}"
        rows.append((k, " ".join(arm)))
    chain = sentence(4, 100).split()
    for k in range(8):
        chain = chain[:]
        chain[3 * k + 40] = f"link{k}"
        rows.append((100 + k, " ".join(chain)))
    passage = sentence(6, 60)
    rows += [(200 + k, passage + " " + sentence(300 + k, 25)) for k in range(40)]
    rows += [(300 + k, sentence(7, 80)) for k in range(10)] + [(400 + k, f"tiny {k % 3}") for k in range(9)]
    want = near_classes(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.mark(frame(spark, [(d, t, "", "", 0) for d, t in rows]), width=4).collect()}
    assert got == want
    assert len({x for _, x in want.values()}) < len(want)


def test_near_on_the_small_table(spark):
    docs = by_name(spark, SMALL, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.mark(docs).collect()}
    assert got == near_classes(rows, near_dedup.SHINGLE)


def test_shingles_are_distinct_windows():
    import pyarrow as pa
    texts = [t for _, t, *_ in odd_rows()]
    assert [len(x) for x in near_dedup._sets(pa.array(texts), 4)] == [len(jaccard_set(t)) for t in texts]


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (2, 1), (10, 11), (12, 11), (20, 20)] + [(1000 + i, 999) for i in range(50)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{k: 1 for k in range(1, 6)}, **{k: 10 for k in (10, 11, 12)}, **{k: 999 for k in (999, *range(1000, 1050))}}


def test_passages_odd_rows(spark):
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in substring_dedup.strip(frame(spark)).collect()), key=key)
    assert got == sorted(stripped([(d, t) for d, t, *_ in odd_rows()]), key=key)


def test_intervals_are_maximal_and_cut(spark):
    for r in substring_dedup.strip(frame(spark)).collect():
        spans = [(x["start"], x["length"]) for x in r["intervals"]]
        assert sum(n for _, n in spans) == r["n_removed"]
        assert all(a + n < b for (a, n), (b, _) in zip(spans, spans[1:]))


def test_gathered_batches_send_each_hash_once():
    rng = np.random.default_rng(0)
    hashes, ids = rng.integers(0, 300, 2000).astype(np.uint64) << np.uint64(50), np.sort(rng.integers(0, 50, 2000))
    batches = list(substring_dedup._flush(hashes, ids, 6))
    sent = sum(len(b) // 7 for x in batches for k, b in zip(x["bucket"].to_pylist(), x["hashes"].to_pylist()) if k >= 0)
    assert sent == len(np.unique(hashes))
