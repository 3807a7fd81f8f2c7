"""Segments and best-two-fit packing against whole texts given to the tokenizers."""
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import alignment, best_fit
from ledgerlens.llm.segments import ByteLevel, Cutter, gather

from .helpers import aligned, empty, frame, key, odd_rows

ODD = ["", "  ", " \n\n foo bar's  'tis !'s can't", "a b　 c  d", "x\r\n\r\ny\t z", "\x1c a\x1f b", " <|endoftext|> a<|endoftext|>b, c!", "naïve é ﬁ…” foo", "!!'s ~'s {'re",
       "100,000.5-abc_DEF(x)[y]{z}", "a\n b\n\nc \nd  \n", "'s 't ''s 'sS", "🙂 🙂🙂 x", "\n", "a   b  c", None, "qxzj Zqk", "x\u0085 y", "日本語　テキスト。 ok", "▁a ▁", "<0x0A> <s> </s> <unk>", "é ﬁ​"]


def odd_texts(n=3000):
    r = random.Random(7)
    letters = " \n\t\r'sretv!?.,-aZ9é 　日🙂<|\x00\x1c\u0085▁ "
    return ODD + ["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def level():
    return ByteLevel(best_fit.tokenizer_path())


def test_segments_have_the_tokens_of_whole_texts(level):
    texts = odd_texts()
    segments, first = Cutter(level.tokens)(pa.array(texts))
    kinds = segments.dictionary_encode()
    ids, at = gather(level.ids(kinds.dictionary.to_pylist()), level.kind, np.asarray(kinds.indices))
    at = at[first]
    for k, text in enumerate(texts):
        assert ids[at[k]:at[k + 1]].tolist() == level.tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_long_texts_come_in_parts(level):
    cutter = Cutter(level.tokens)
    text = " ".join(f"word{i % 977}, x" for i in range(40_000)) + "é" * 300_000 + " end"
    batch = pa.record_batch({"text": pa.array(["a b", text, None])})
    got = list(cutter.parts([batch], "text", 100_000))
    assert len(got) > 5 and [last for _, _, last in got].count(False) == len(got) - 3
    assert "".join(t or "" for _, texts, _ in got for t in texts.to_pylist()) == "a b" + text
    (_, ids, sizes), = [d for d in best_fit.documents([pa.record_batch({"doc_id": [1], "text": [text * 12]})], best_fit.tokenizer_path(), 0)]
    assert ids.tolist() == level.tokenizer.encode(text * 12, add_special_tokens=False).ids + [0] and sizes.tolist() == [len(ids)]


def plain_two_fit(lengths, room):
    """Best-two-fit on a sorted list: the sums of the sequences."""
    left, out = sorted(lengths), []
    while left:
        own, gap = [], room
        while fits := [x for x in left if x <= gap]:
            own.append(fits[-1])
            left.remove(fits[-1])
            gap -= fits[-1]
        if gap and len(own) > 1:
            pairs = [(left[i] + left[j], left[j], left[i]) for i in range(len(left)) for j in range(i + 1, len(left)) if own[-1] < left[i] + left[j] <= gap + own[-1]]
            if pairs:
                small = own.pop()
                for x in max(pairs)[1:]:
                    own.append(x)
                    left.remove(x)
                left = sorted([*left, small])
        out.append(own)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_two_fit_equals_a_plain_version(seed):
    r = random.Random(seed)
    lengths = [r.randint(1, r.choice((10, 40, 64))) for _ in range(r.randint(0, 120))]
    got = best_fit.best_two_fit(np.array(lengths, np.int64), 64)
    assert sorted(i for own in got for i in own) == list(range(len(lengths)))
    assert sorted(sorted(lengths[i] for i in own) for own in got) == sorted(sorted(own) for own in plain_two_fit(lengths, 64))


def test_a_pair_takes_the_place_of_the_smallest():
    assert sorted(len(x) for x in best_fit.best_two_fit(np.array([6, 3, 2, 2]), 10)) == [1, 3]  # 6 + 2 + 2, not 6 + 3


def check(rows, pieces, level, length):
    """Every id of every document lies in one piece; sequences are gapless and no longer than ``length``."""
    want = sorted((n, zlib.crc32(x.tobytes())) for n, x in ((len(x), x) for x in (np.array([*level.tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4") for r in rows)))
    assert all(p["length"] * 4 == len(p["ids"]) for p in pieces)
    sequences: dict = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own]).tolist()[:-1]] and sum(n for _, n in own) <= length
    docs: dict = {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"] is None, p["doc_id"] or 0, p["start"])):
        docs.setdefault(p["doc_id"], []).append(p)
    for own in docs.values():
        for a, b in zip(own, own[1:]):
            assert b["start"] == 0 or b["length"] == length or a["start"] == b["start"]  # repeated ids have their pieces twice
    alone = [(own[-1]["start"] + own[-1]["length"], zlib.crc32(b"".join(p["ids"] for p in own))) for own in docs.values() if [p["piece"] for p in own] == list(range(len(own)))]
    assert len(alone) > len(docs) // 2 and set(alone) <= set(want)
    assert sum(p["length"] for p in pieces) == sum(n for n, _ in want)
    return len(sequences)


def test_packing_of_odd_rows(spark, level):
    df = frame(spark)
    for lane in (best_fit.LANE, 5000):
        pieces = [r.asDict() for r in best_fit.pack(df, lane=lane).collect()]
        check(odd_rows(), pieces, level, best_fit.LENGTH)
    assert best_fit.pack(empty(spark)).count() == 0


def test_packing_of_documents(spark, level):
    from ..conftest import SMALL
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    pieces = [r.asDict() for r in best_fit.pack(docs).collect()]
    n = check([(r["doc_id"], r["text"]) for r in docs.collect()], pieces, level, best_fit.LENGTH)
    assert n <= -(-sum(p["length"] for p in pieces) // best_fit.LENGTH) + 1


@pytest.fixture(scope="module")
def paths():
    return [alignment.tokenizer_path(x) for x in (alignment.TOKENIZER_A, alignment.TOKENIZER_B)]


def test_alignment_of_odd_texts(spark, paths):
    rows = [(i, t, "en", "a", 1) for i, t in enumerate([*odd_texts(1500), "a" * 5000 + " " * 300 + "b", "日" * 400 + "🙂" * 100])] + odd_rows()
    want, groups = aligned([(r[0], r[1]) for r in rows], *paths)
    df = frame(spark, rows)
    for common in (alignment.COMMON, 40):  # all pairs broadcast, or few of them
        got = alignment.mark(df, common=common)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    spans = alignment.groups(df.where("doc_id < 1500 and doc_id not in (13, 14, 15, 16, 17, 18, 19) and doc_id > 12")).collect()
    for i in range(20, 1500):
        own = sorted((s for s in spans if s["doc_id"] == i), key=lambda s: s["group"])
        assert [(s["a"], s["b"]) for s in own] == groups[i]
        assert [s["start"] for s in own] == [0, *[s["end"] for s in own]][:len(own)]


def test_large_groups_are_counted_by_their_ids(paths):
    a = alignment.Aligner(*paths)
    ids_a, ids_b = np.array([5, 7, 5, 9]), np.array([1, 1, 2])
    whole = a._links(ids_a, ids_b, np.array([0, 0, 0, 1]), np.array([3, 1]), np.array([2, 1]))
    alignment.MANY, many = 1, alignment.MANY
    try:
        parts = a._links(ids_a, ids_b, np.array([0, 0, 0, 1]), np.array([3, 1]), np.array([2, 1]))
    finally:
        alignment.MANY = many
    for x, y in zip(whole, parts):
        assert all(np.array_equal(p, q) for p, q in zip(x, y))


def test_alignment_of_long_texts_and_of_none(spark, paths):
    text = " ".join(f"word{i % 977}, é☃x🙂\n" for i in range(500_000))  # several parts
    want, _ = aligned([(1, text), (2, "x word7, y")], *paths)
    assert sorted(map(tuple, alignment.mark(frame(spark, [(1, text, "en", "a", 1), (2, "x word7, y", "en", "a", 1)])).collect())) == want
    assert alignment.mark(empty(spark)).count() == 0 and alignment.groups(empty(spark)).count() == 0


def test_alignment_of_documents(spark, paths):
    from ..conftest import SMALL
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want, _ = aligned([(r["doc_id"], r["text"]) for r in docs.collect()], *paths)
    assert sorted(map(tuple, alignment.mark(docs).collect()), key=key) == sorted(want, key=key)
