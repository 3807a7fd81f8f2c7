"""Stupid-backoff scores of all documents from the n-gram counts of all of them.

The score of a word is count(n-gram) / count(its first words) for the longest n-gram of up to ``ORDER`` words that ends at it and occurs
``LEAST`` times or more in the corpus, times ``ALPHA`` for each word of history given up; a single word's is its share of all
words.  A document's score is the sum of logarithms, and its mean.

Documents are dealt evenly to batches of about ``BATCH`` bytes and travel as compressed Arrow streams.  A batch hashes its n-grams (64 bits), counts its
own and sends each distinct one once, with its count, to the bucket of the hash's first bits: the count tables, partitioned by hash.  There
the counts of all batches are added, and each batch gets for each of its n-grams the corpus count, in the order in which it sent them
and in one byte where it is small.  Hashes travel sorted, as differences cut into planes of bytes, so what hashes of this number must have in common isn't sent.  Joined with the batch's documents, they give the scores.  An n-gram that is
everywhere arrives once per batch, and nothing is pruned but by ``LEAST``.

Null text and text without words: 0 words, score 0 and mean null.  Repeated rows count as often as they stand there.  A null doc_id is kept.
Extra columns are ignored.  An empty table gives an empty result.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, short_batches
from .words import words_of

ORDER, ALPHA, LEAST, BATCH, PER_BUCKET, LEAST_BITS = 3, 0.4, 2, 8 << 20, 2_000_000, 5
#: Bytes of documents that a task deals to batches at a time.
DEAL = 32 << 20
PACKED_DDL = "batch long, docs binary"
PACKED = pa.schema([("batch", pa.int64()), ("docs", pa.binary())])
DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
ENTRIES = pa.schema([("n", pa.int32()), ("bucket", pa.int32()), ("batch", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
ENTRIES_DDL = "n int, bucket int, batch long, hashes binary, counts binary"
ANSWERS = pa.schema([("batch", pa.int64()), ("n", pa.int32()), ("bucket", pa.int32()), ("totals", pa.binary()), ("large", pa.binary())])
ANSWERS_DDL = "batch long, n int, bucket int, totals binary, large binary"
SCORES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64()), ("mean_log_score", pa.float64())])
SCORES_DDL = "doc_id long, n_words long, log_score double, mean_log_score double"


def _ngrams(table: pa.Table, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each length 1..order, the hashes of all n-grams of the documents, and where each document's begin."""
    grams: list[list[np.ndarray]] = [[] for _ in range(order)]
    sizes: list[list[np.ndarray]] = [[] for _ in range(order)]
    for piece in cut(iter(table.to_batches()), "text"):
        words = words_of(piece.column("text"))
        for n in range(order):
            hashes, first = words.windows(n + 1)
            grams[n].append(hashes)
            sizes[n].append(np.diff(first))
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return [join(g, np.uint64) for g in grams], [np.concatenate(([0], np.cumsum(join(s, np.int64)))).astype(np.int64) for s in sizes]


def _planes(x: np.ndarray) -> bytes:
    """Numbers as compressed planes: the first byte of each, then the second of each, and so on."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _numbers(blob: bytes, kind) -> np.ndarray:
    n, width = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(blob[8:], n * width, codec="zstd"), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, batch -> a row a batch with its documents as a compressed Arrow stream, for each ``DEAL`` bytes of text or so."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))

    def dealt(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).sort_by("batch")
        batch = table["batch"].to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(batch)) + 1).tolist(), len(batch)]
        for first, end in zip(edges, edges[1:]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, DOCS, options=options) as out:
                out.write_table(table.slice(first, end - first).select(DOCS.names).cast(DOCS).combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([batch[first]], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=PACKED)

    held, size = [], 0
    for piece in cut(batches, "text"):
        held.append(piece)
        size += pc.sum(pc.binary_length(piece.column("text"))).as_py() or 0
        if size >= DEAL:
            yield from dealt(held)
            held, size = [], 0
    if held:
        yield from dealt(held)


def _docs(table: pa.Table) -> pa.Table:
    return pa.concat_tables([DOCS.empty_table(), *[pa.ipc.open_stream(x).read_all() for x in table["docs"].to_pylist()]])


def _entries(order: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        batch, rows = table["batch"][0].as_py(), []
        for n, hashes in enumerate(_ngrams(_docs(table), order)[0], 1):
            own, counts = np.unique(hashes, return_counts=True)
            bucket = own >> np.uint64(64 - bits)
            edges = np.searchsorted(bucket, np.arange((1 << bits) + 1))
            for k in np.flatnonzero(np.diff(edges)):
                a, b = edges[k], edges[k + 1]
                rows.append((n, int(k), batch, _planes(np.diff(own[a:b], prepend=np.uint64(0))), _planes(counts[a:b].astype(np.uint32))))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(ENTRIES)], schema=ENTRIES)
    return run


def _totals(least: int):
    def run(table: pa.Table) -> pa.Table:
        n, bucket = table["n"][0].as_py(), table["bucket"][0].as_py()
        blobs = [np.cumsum(_numbers(x, np.uint64)) for x in table["hashes"].to_pylist()]
        counts = [_numbers(x, np.uint32) for x in table["counts"].to_pylist()]
        flat = np.concatenate(blobs)
        order = np.argsort(flat)
        starts = np.flatnonzero(np.concatenate(([True], flat[order][1:] != flat[order][:-1])))
        total = np.add.reduceat(np.concatenate(counts).astype(np.int64)[order], starts)
        if n > 1:
            total[total < least] = 0
        each = np.empty(len(flat), np.int64)
        each[order] = np.repeat(total, np.diff(np.append(starts, len(flat))))
        ends = np.cumsum([len(x) for x in blobs])[:-1]
        parts = np.split(each, ends)
        rows = [[b, n, bucket, _planes(np.minimum(p, 255).astype(np.uint8)), _planes(p[p >= 255])] for b, p in zip(table["batch"].to_pylist(), parts)]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(ANSWERS)], schema=ANSWERS)
    return run


def _score(order: int, alpha: float, words_total: int):
    def run(packed: pa.Table, answers: pa.Table) -> pa.Table:
        docs = _docs(packed)
        grams, first = _ngrams(docs, order)
        found: list[list] = [[] for _ in range(order)]
        for n, bucket, totals, large in zip(*(answers[c].to_pylist() for c in ("n", "bucket", "totals", "large"))):
            found[n - 1].append((bucket, totals, large))
        counts = []  # of each n-gram in place
        for n in range(order):
            own, where = np.unique(grams[n], return_inverse=True)
            parts = []
            for _, totals, large in sorted(found[n]):
                part = _numbers(totals, np.uint8).astype(np.int64)
                part[part == 255] = _numbers(large, np.int64)
                parts.append(part)
            total = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            if len(total) != len(own):
                raise ValueError("the count tables don't answer every n-gram of the batch")
            counts.append(total[where] if len(own) else np.zeros(0, np.int64))
        n_docs, n_words = len(first[0]) - 1, np.diff(first[0])
        doc = np.repeat(np.arange(n_docs), n_words)
        place = np.arange(len(doc)) - first[0][doc]  # of each word in its document
        score = np.log(np.maximum(counts[0], 1) / max(words_total, 1))
        for n in range(2, order + 1):
            longer = place >= n - 1
            ends = np.flatnonzero(longer)
            at = first[n - 1][doc[ends]] + place[ends] - (n - 1)  # the n-gram that ends there
            before = first[n - 2][doc[ends]] + place[ends] - (n - 1)  # its first n - 1 words
            seen = counts[n - 1][at] > 0
            score[ends] = np.where(seen, np.log(np.maximum(counts[n - 1][at], 1) / np.maximum(counts[n - 2][before], 1)), score[ends] + math.log(alpha))
        total = np.bincount(doc, score, n_docs)
        mean = [t / n if n else None for t, n in zip(total.tolist(), n_words.tolist())]
        ids = docs["doc_id"].combine_chunks() if docs.num_rows else pa.array([], pa.int64())
        return pa.Table.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(total, pa.float64()), pa.array(mean, pa.float64())], schema=SCORES)
    return run


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score of every row."""
    got = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.regexp_count("text", F.lit(WORD))).alias("words")).first()
    size, words = got["bytes"] or 0, got["words"] or 0
    batches = max(1, math.ceil(size / BATCH))
    bits = min(24, max(LEAST_BITS, (words // PER_BUCKET).bit_length()))
    dealt = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("long"))
    dealt = dealt.mapInArrow(_pack, PACKED_DDL)
    entries = dealt.groupBy("batch").applyInArrow(_entries(order, bits), ENTRIES_DDL)
    answers = entries.groupBy("n", "bucket").applyInArrow(_totals(least), ANSWERS_DDL)
    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_score(order, alpha, words), SCORES_DDL)
