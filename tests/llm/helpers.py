"""Small tables with the odd cases, and plain versions of what the operators compute."""
from __future__ import annotations

import collections
import hashlib
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that the operators use inside.
CLASHES = ("n", "size", "bucket", "digest", "v", "value", "key", "hub", "rank", "component", "score", "kept", "keep_id", "target", "copies", "rate", "part", "batch", "ids", "place", "y", "w", "h", "lines",
           "posterior", "answers", "hashes", "sequence_id", "offset", "start", "length", "id", "a", "b", "c", "df", "node", "at", "first", "skip")


def words(text):
    return WORD.findall(text or "")


def sentence(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append("w%d" % (x // 65536 % 5000))
    return " ".join(out)


def odd_rows():
    base = sentence(1, 120).split()
    near = base[:]
    near[60] = "changed"
    long = sentence(5, 30_000)
    passage = sentence(9, 40)
    return [
        (1, " ".join(base), "en", "a", 1), (2, "\n".join(base) + " ", "en", "a", 1), (3, " ".join(near), "en", None, 1),
        (4, None, "en", "b", None), (5, "", None, "b", 0), (6, " \t\n\r\x0b\x0c ", "de", "b", 3), (7, "one", "de", "c", 3), (8, "one", "de", "c", 3),
        (9, long, "fr", "a", 1), (10, long + " end", "fr", "b", 1), (11, sentence(20, 60) + " " + passage + " " + sentence(21, 60), "en", "a", 1),
        (12, passage + "\n" + passage + "\n" + sentence(23, 80), "en", "é", 1), (13, "Ä ß  x y İ ǅ naïve", "en", "", 1), (13, "Ä ß  x y İ ǅ naïve", "en", "", 1),
        (None, sentence(30, 70), None, None, None), (None, " ".join(base), "en", "a", 1), (14, "line\nline\nline\n\nother", "en", "a", 1), (15, "one two three", "en", "b", 1), (16, "ONE Two three", "en", "b", 1),
        (17, "*** ### $$$ a|b <c> & 100%", "en", "z", 1), (18, "a\x00b c\x1cd", "en", "z", 1), (19, " ".join(["same"] * 300), "en", "z", 1)]


def frame(spark, rows=None, clashes=True):
    df = spark.createDataFrame(odd_rows() if rows is None else rows, DOCS)
    return df.withColumns({c: F.lit("x") for c in CLASHES}) if clashes else df


def empty(spark):
    return frame(spark, [])


def jaccard_set(text, k=4):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def near_classes(rows, k=4):
    """doc_id -> (set size, smallest id reachable) of distinct ids."""
    sets = {d: jaccard_set(t, k) for d, t in rows}
    ids = sorted(sets)
    top = {d: d for d in ids}

    def find(d):
        while top[d] != d:
            d = top[d]
        return d
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def stripped(rows, k=13):
    """List of (doc_id, words, removed, sha256 of what is kept), ids sorted, null ids last."""
    least: dict = {}
    rank = lambda d: float("inf") if d is None else d
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - k + 1):
            x = tuple(w[i:i + k])
            least[x] = min(least.get(x, float("inf")), rank(d))
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - k + 1):
            if least[tuple(w[i:i + k])] < rank(d):
                gone.update(range(i, i + k))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def counted(text):
    t = text or ""
    w = words(t)
    three = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    times = collections.Counter(three)
    covered = {j for i, x in enumerate(three) if times[x] > 1 for j in (i, i + 1, i + 2)}
    seen, again = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), again, len(covered)


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def aligned(rows, path_a, path_b):
    """What ``alignment.mark`` gives for (doc_id, text), from whole texts: ends of tokens by their decoded bytes, all pairs of a group."""
    from ledgerlens.llm.alignment import Pieces
    from ledgerlens.llm.segments import ByteLevel
    a, b = ByteLevel(path_a, plain=True), Pieces(path_b)
    held, docs, groups_of = collections.Counter(), [], []
    for d, text in rows:
        ids_a = a.tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.model.encode(text) if text else []
        raw = (" " + text).encode() if text else b""
        if b"".join(a.tokens[i] for i in ids_a) != raw or b"".join(b.tokens[i] for i in ids_b) != raw:
            ids_a, ids_b = [], []
        ends = []
        for ids, tokens in ((ids_a, a.tokens), (ids_b, b.tokens)):
            at, own = 0, []
            for i in ids:
                at += len(tokens[i])
                own.append(at)
            ends.append(own)
        groups, x, y = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            first, second = [], []
            while x < len(ids_a) and ends[0][x] <= cut:
                first.append(ids_a[x])
                x += 1
            while y < len(ids_b) and ends[1][y] <= cut:
                second.append(ids_b[y])
                y += 1
            groups.append((first, second))
        links = collections.Counter((i, j) for first, second in groups for i in first for j in second)
        held.update(links.keys())
        groups_of.append(groups)
        docs.append((d, len(ids_a), len(ids_b), groups, links))
    top: dict = {}
    for (i, _), n in held.items():
        top[i] = max(top.get(i, 0), n)
    out = []
    for d, n_a, n_b, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((d, n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if held[p] == top[p[0]]), sum(n * held[p] for p, n in links.items()),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out, groups_of
