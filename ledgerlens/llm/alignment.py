"""Alignment of two tokenizers: which tokens of one cover the same bytes as which of the other, and how usual each such pair is.

A text, with a blank before it, is tokenised by a byte-level tokenizer (A) and by a sentencepiece model (B, which adds that blank itself).  The character
offsets that ``tokenizers`` reports and the spans of sentencepiece's ``proto`` output are coarse cuts; where several tokens share one
character - pieces of a multibyte character in A, byte-fallback tokens in B - their ends follow from the tokens' decoded bytes.  Places where
both end cut the text into groups; every A token of a group is linked with every B token of it.

Segments (see ``segments``) are cuts of both tokenizers, so groups never reach over them: each distinct segment is tokenised and aligned once
in a task, and a document's groups and links are those of its segments.  A pair of ids is one number, ``a * (size of B) + b``.

* One pass over the texts writes a narrow row per document with its distinct pairs and how often each is linked.
* Pairs are counted (documents that hold them) by one aggregation, combined before the shuffle; an A id's highest count by another.
* Counts go back by joins: the commonest pairs, at most ``COMMON`` by construction, are broadcast; the others - each in so few documents
  that it is no hot key - are joined by shuffle.  One row a document leaves each task.

Texts that are null, empty or not reproduced by the joined bytes of A or B have no tokens: zeros and an empty ``groups_sha256``.  Special tokens' strings are plain
text.  Repeated rows count each, also as documents.  A null doc_id is kept.  Extra columns are ignored.  An empty table gives no rows.
A text of many megabytes is aligned in parts cut between segments.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, stage, worker_cache
from .segments import ByteLevel, Cutter, Known, joined

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
CACHE, COMMON, MANY = 400_000, 500_000, 4096
ROWS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
                  ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
ROWS_DDL = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
GROUPS_DDL = "doc_id long, group long, start long, end long, a array<int>, b array<int>"


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Pieces:
    """A sentencepiece model with byte fallback, and its tokens' bytes."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        self.tokens = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.get_piece_size())]
        self.sizes = np.array([len(t) for t in self.tokens])
        if any(b"\n" in t and len(t) > 1 for t in self.tokens):
            raise ValueError("a piece joins a line feed with other characters")

    def spans(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """ids, and first and last byte of their spans.  A line feed, which stands apart in every piece, goes before
        each text and takes the blank that the model adds."""
        for found in self.model.encode(["\n" + t for t in texts], return_type="proto", num_threads=1):
            x = np.array([(p.id, p.begin, p.end) for p in found.pieces[2:]], np.int64).reshape(-1, 3)
            yield x[:, 0], x[:, 1] - 1, x[:, 2] - 1


def refined(coarse: np.ndarray, shared: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: the coarse ones, but for tokens that end inside a character (``shared``), which lie as many bytes behind the last certain end
    as their decoded bytes say."""
    if not shared.any():
        return coarse
    total = np.cumsum(sizes)
    last = np.maximum.accumulate(np.where(shared, -1, np.arange(len(coarse))))  # the last certain end up to here
    base = np.where(last >= 0, coarse[last] - total[last], 0)
    return np.where(shared, base + total, coarse)


class Aligner:
    """What is linked within segments."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a, plain=True), Pieces(path_b)
        self.cutter = Cutter(self.a.tokens, self.b.tokens)
        self.width = len(self.b.tokens)
        most = max(len(self.a.tokens), self.width)
        self._written = pa.array([f"{i}{mark}".encode() for i in range(most) for mark in ",|;"], pa.binary())

    def ends(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text: A's ids and byte ends, B's ids and byte ends."""
        for text, found, (ids_b, begin, end) in zip(texts, self.a.tokenizer.encode_batch(texts, add_special_tokens=False), self.b.spans(texts)):
            ids_a = np.array(found.ids, np.int64)
            chars = np.array(found.offsets, np.int64).reshape(-1, 2)
            coarse = chars[:, 1]
            if not text.isascii():
                raw = np.frombuffer(text.encode(), np.uint8)
                coarse = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))[coarse]
            shared = np.zeros(len(ids_a), bool)
            shared[:-1] = chars[1:, 0] < chars[:-1, 1]
            yield ids_a, refined(coarse, shared, self.a.sizes[ids_a]), ids_b, refined(end, begin == end, self.b.sizes[ids_b])

    def faithful(self, text: str, ids_a: np.ndarray, ids_b: np.ndarray) -> bool:
        raw = text.encode()
        return b"".join([self.a.tokens[i] for i in ids_a.tolist()]) == raw and b"".join([self.b.tokens[i] for i in ids_b.tolist()]) == raw

    def learn(self, segments: list[str]) -> list[tuple[bytes, bytes, bytes, bytes]]:
        """Of each segment: counts (unfaithful, A tokens, B tokens, groups, links), its distinct pairs, those of them that are
        linked more than once in a group with how much more, and its groups as text, each with ``;`` behind it."""
        if not segments:
            return []
        parts = joined(segments)
        who, edges, ids_a, ids_b, ends_a, ends_b, wrong, at = [], [], [], [], [], [], [], 0
        for (own, text, places), (a, end_a, b, end_b) in zip(parts, self.ends([p[1] for p in parts])):
            fine = self.faithful(text, a, b)
            if not fine and len(own) > 1:  # some of them: find out which
                raw, places_l = text.encode(), places.tolist()
                cut_a, cut_b = np.searchsorted(end_a, places, "right"), np.searchsorted(end_b, places, "right")
                for k in range(len(own)):
                    wrong.append(not self.faithful(raw[places_l[k]:places_l[k + 1]].decode(), a[cut_a[k]:cut_a[k + 1]], b[cut_b[k]:cut_b[k + 1]]))
            else:
                wrong += [not fine] * len(own)
            who += own
            edges.append(places[1:] + at)
            ids_a.append(a)
            ids_b.append(b)
            ends_a.append(end_a + at)
            ends_b.append(end_b + at)
            at += int(places[-1])
        edges, ids_a, ids_b, ends_a, ends_b = (np.concatenate(x) for x in (edges, ids_a, ids_b, ends_a, ends_b))
        common = np.union1d(np.intersect1d(ends_a, ends_b), edges)
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        n_a, n_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        segment = np.searchsorted(edges, common)
        pairs, more = self._links(ids_a, ids_b, group_a, n_a, n_b)
        counts = np.stack([np.array(wrong, np.int64), *(np.bincount(segment, weights=w, minlength=len(edges)).astype(np.int64) for w in (n_a, n_b, np.ones(len(common)), n_a * n_b))], axis=1)
        texts = self._groups(ids_a, ids_b, group_a, group_b, n_a, n_b)
        data = counts.astype("<i8").tobytes()
        blocks = [_blocks(x[1].astype("<i8"), segment[x[0]], len(edges)) for x in (pairs, more)]
        size = np.concatenate(([0], np.cumsum(np.bincount(segment, weights=texts[1], minlength=len(edges)).astype(np.int64)))).tolist()
        out: list = [None] * len(segments)
        for k, i in enumerate(who):
            out[i] = (data[40 * k:40 * k + 40], blocks[0][k], blocks[1][k], texts[0][size[k]:size[k + 1]])
        return out

    def _links(self, ids_a, ids_b, group_a, n_a, n_b):
        """(group, pair) of each distinct pair in a group; and (group, (pair, how many more)) of those that are there more than once."""
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        large = n_a * n_b > MANY
        each = np.where(large[group_a], 0, n_b[group_a])
        total = np.cumsum(each)
        b_at = np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - each, each) + np.repeat(first_b[group_a], each)
        groups, pairs = [np.repeat(group_a, each)], [np.repeat(ids_a, each) * self.width + ids_b[b_at]]
        times = [np.ones(len(pairs[0]), np.int64)]
        for g in np.flatnonzero(large).tolist():  # of a group of very many, the distinct ids' pairs
            a, times_a = np.unique(ids_a[first_a[g]:first_a[g] + n_a[g]], return_counts=True)
            b, times_b = np.unique(ids_b[first_b[g]:first_b[g] + n_b[g]], return_counts=True)
            pairs.append((a[:, None] * self.width + b[None, :]).reshape(-1))
            times.append((times_a[:, None] * times_b[None, :]).reshape(-1))
            groups.append(np.full(len(pairs[-1]), g))
        groups, pairs, times = np.concatenate(groups), np.concatenate(pairs), np.concatenate(times)
        order = np.lexsort((pairs, groups))
        groups, pairs, times = groups[order], pairs[order], times[order]
        new = np.ones(len(pairs), bool)
        new[1:] = (pairs[1:] != pairs[:-1]) | (groups[1:] != groups[:-1])
        start = np.flatnonzero(new)
        times = np.add.reduceat(times, start) if len(start) else times
        groups, pairs = groups[start], pairs[start]
        often = times > 1
        return (groups, pairs), (groups[often], np.stack([pairs[often], times[often] - 1], axis=1))

    def _groups(self, ids_a, ids_b, group_a, group_b, n_a, n_b) -> tuple[bytes, np.ndarray]:
        """All groups as text, and the length of each."""
        last_a, last_b = np.ones(len(ids_a), bool), np.ones(len(ids_b), bool)
        last_a[:-1], last_b[:-1] = group_a[1:] != group_a[:-1], group_b[1:] != group_b[:-1]
        which = np.empty(len(ids_a) + len(ids_b), np.int64)
        which[np.arange(len(ids_a)) + (np.cumsum(n_b) - n_b)[group_a]] = ids_a * 3 + last_a
        which[np.arange(len(ids_b)) + np.cumsum(n_a)[group_b]] = ids_b * 3 + 2 * last_b
        written = self._written.take(pa.array(which))
        flat, ends = _flat(written, np.uint8)
        return flat.tobytes(), np.diff(ends[np.concatenate(([0], np.cumsum(n_a + n_b)))])


def _blocks(values: np.ndarray, segment: np.ndarray, n: int) -> list[bytes]:
    """The bytes of the rows of each segment; segments rise."""
    data, wide = values.tobytes(), values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    at = (np.searchsorted(segment, np.arange(n + 1)) * wide).tolist()
    return [data[x:y] for x, y in zip(at, at[1:])]


def _flat(values: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The data of a binary array, and where each value starts in it, with the end, counted in ``kind``."""
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int32)[values.offset:values.offset + len(values) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None and len(values) else np.zeros(0, np.uint8)
    wide = np.dtype(kind).itemsize
    return raw.view(kind), (ends - ends[0]) // wide


def _aligner(path_a: str, path_b: str) -> tuple[Aligner, Known]:
    kept = worker_cache("alignment")
    if (path_a, path_b) not in kept:
        aligner = Aligner(path_a, path_b)
        kept[path_a, path_b] = (aligner, Known(aligner.learn, CACHE))
    return kept[path_a, path_b]


class _Sums:
    """A document's counts, links and digest, over the parts of its text."""

    def __init__(self):
        self.counts, self.pairs, self.digest, self.begun = np.zeros(5, np.int64), [], hashlib.sha256(), False

    def add(self, counts: np.ndarray, pairs: np.ndarray, times: np.ndarray, text: memoryview) -> None:
        if len(text):
            if self.begun:
                self.digest.update(b";")
            self.digest.update(text[:-1])
            self.begun = True
        self.counts += counts
        self.pairs.append((pairs, times))

    def row(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
        if self.counts[0] or not self.counts[1]:
            return np.zeros(5, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), ""
        pairs, times = (np.concatenate(x) for x in zip(*self.pairs))
        if len(self.pairs) > 1:
            pairs, where = np.unique(pairs, return_inverse=True)
            times = np.bincount(where, weights=times).astype(np.int64)
        return self.counts, pairs, times, self.digest.hexdigest()


def aligned_part(texts: pa.Array, aligner: Aligner, known: Known) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, memoryview]]:
    """Of each text (with its blank before it): counts, distinct pairs, their times, groups as text."""
    segments, first = aligner.cutter(texts)
    segments = segments.dictionary_encode()
    which = segments.indices
    own = known(segments.dictionary.to_pylist())
    entry = [pa.array(x, pa.binary()) for x in zip(*own)] if own else [pa.array([], pa.binary())] * 4
    each = np.frombuffer(b"".join(x[0] for x in own), "<i8").reshape(-1, 5)[np.asarray(which)]
    sums = np.concatenate((np.zeros((1, 5), np.int64), np.cumsum(each, axis=0)))[first]
    links, ends = _flat(entry[1].take(which), "<i8")
    more, more_ends = _flat(entry[2].take(which), "<i8")
    groups, group_ends = _flat(entry[3].take(which), np.uint8)
    ends, more_ends, group_ends, groups = ends[first], more_ends[first], group_ends[first].tolist(), memoryview(groups)
    number = np.repeat(np.arange(len(texts)) << 40, np.diff(ends))
    key = np.sort(links + number)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    start = np.flatnonzero(new)
    times, key = np.diff(np.append(start, len(key))), key[start]
    if len(more):
        more_key = more[0::2] + np.repeat(np.arange(len(texts)) << 40, np.diff(more_ends) // 2)
        np.add.at(times, np.searchsorted(key, more_key), more[1::2])
    at = np.searchsorted(key, np.arange(len(texts) + 1) << 40).tolist()
    pairs = key & ((1 << 40) - 1)
    return [(sums[k + 1] - sums[k], pairs[at[k]:at[k + 1]], times[at[k]:at[k + 1]], groups[group_ends[k]:group_ends[k + 1]]) for k in range(len(texts))]


def _spaced(texts: pa.Array, begin: bool) -> pa.Array:
    import pyarrow.compute as pc
    if not begin:
        return texts
    texts = pc.fill_null(texts, "")
    return pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))


def _rows(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, known = _aligner(path_a, path_b)
        row, open_text = TaskContext.get().partitionId() << 40, None
        for rows, texts, last in aligner.cutter.parts(batches, "text"):
            found = aligned_part(_spaced(texts, open_text is None), aligner, known)
            sums = [_Sums() for _ in found] if open_text is None else [open_text]
            for own, x in zip(sums, found):
                own.add(*x)
            if not last:
                open_text = sums[0]
                continue
            open_text = None
            done = [own.row() for own in sums]
            counts = np.array([x[0] for x in done]).reshape(-1, 5)
            ends = pa.array(np.concatenate(([0], np.cumsum([len(x[1]) for x in done]))), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[k] for x in done]), pa.int64())) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(done))), rows.column("doc_id"), *[pa.array(counts[:, k]) for k in range(1, 5)],
                                              pa.array([x[3] for x in done]), *lists], schema=ROWS)
            row += len(done)
    return run


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """A staged row per document: what it holds, its distinct pairs of ids and how often each is linked."""
    narrow = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = narrow.mapInArrow(_rows(path_a or tokenizer_path(TOKENIZER_A), path_b or tokenizer_path(TOKENIZER_B)), ROWS_DDL)
    return stage(rows, "aligned")


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """pair, n (documents that hold it) and best (whether n is its A id's highest), staged."""
    counts = stage(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pairs")
    a = F.floor(F.col("pair") / F.lit(width))
    top = counts.groupBy(a.alias("a")).agg(F.max("n").alias("top"))
    return stage(counts.withColumn("a", a).join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "pair-counts")


def _floor_of_common(counts: DataFrame, common: int) -> int:
    """The least power of two that fewer than ``common`` pairs' counts reach: 63 numbers at most come to the driver."""
    left = 0
    for r in sorted(counts.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count(F.lit(1)).alias("m")).collect(), key=lambda r: -r["k"]):
        left += r["m"]
        if left > common:
            return 1 << (r["k"] + 1)
    return 1


def _with_counts(rows: DataFrame, counts: DataFrame, common: int) -> DataFrame:
    """row, n_best and count_sum of the rows that have pairs."""
    least = _floor_of_common(counts, common)
    links = rows.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
    sums = (F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    usual = F.broadcast(counts.where(F.col("n") >= least))
    out = links.join(usual, "pair").groupBy("row").agg(*sums)
    if least > 1:
        rare = links.join(usual, "pair", "left_anti").join(counts.where(F.col("n") < least), "pair")
        out = out.union(rare.groupBy("row").agg(*sums))
    return out.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def mark(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, common: int = COMMON) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    n_best: links whose pair is among its A id's commonest.  count_sum: the pairs' counts summed over links."""
    rows = aligned(docs, path_a, path_b)
    counts = pair_counts(rows, len(Pieces(path_b or tokenizer_path(TOKENIZER_B)).tokens))
    zero = F.lit(0).cast("long")
    return (rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(_with_counts(rows, counts, common), "row", "left")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"))


def _spans(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, _ = _aligner(path_a, path_b)
        names = ("doc_id", "group", "start", "end", "a", "b")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        number, begin, fine = 0, 0, True
        for rows, texts, last in aligner.cutter.parts(batches, "text"):
            out: list[tuple] = []
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), texts.to_pylist()):
                text = (" " if not begin else "") + (text or "")
                if len(text) > (not begin):
                    (ids_a, end_a, ids_b, end_b), = aligner.ends([text])
                    common = np.intersect1d(end_a, end_b)
                    at_a, at_b = (np.searchsorted(x, common, "right").tolist() for x in (end_a, end_b))
                    a, b, ends = ids_a.tolist(), ids_b.tolist(), (common + begin).tolist()
                    if fine := fine and aligner.faithful(text, ids_a, ids_b):
                        for k, (x0, x1, y0, y1) in enumerate(zip([0, *at_a], at_a, [0, *at_b], at_b)):
                            out.append((doc_id, number + k, ends[k - 1] if k else begin, ends[k], a[x0:x1], b[y0:y1]))
                    number, begin = number + len(common), begin + len(text.encode())
                if last:  # the next text begins anew
                    number, begin, fine = 0, 0, True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds)], names)
    return run


def groups(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """A row per group: doc_id, its number, first byte and end in the text with its blank, and the ids of A and of B.

    Of a text so long that it comes in parts, the groups before the first part that isn't reproduced are given."""
    narrow = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_spans(path_a or tokenizer_path(TOKENIZER_A), path_b or tokenizer_path(TOKENIZER_B)), GROUPS_DDL)
