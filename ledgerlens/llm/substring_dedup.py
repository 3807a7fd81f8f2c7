"""Removal of repeated passages: windows of words that a document with a smaller id has too.

Each task hashes every window of ``WINDOW`` words of its documents (Rabin-Karp) and gathers about
``FLUSH`` windows.  Of a hash that several of the gathered documents have, only the smallest id's goes on; for
the others the task already knows that the window goes.  So a passage that a third of all documents share
reaches the counting side once per gathered batch.  What goes on is dealt by the first bits of the hash
to buckets, whose number follows the number of words; there all but the smallest id of a hash
get the answer that their window goes.  The answers return to the documents, one row for each, and their
windows merge into maximal intervals, which are cut.

The hash has 56 bits and those of the bucket's number: with W windows some W * W / 2**(57 + bits) pairs of different
windows are taken for equal (0.002 expected in 1.4e8).

Null text has no words.  Documents without WINDOW words keep all.  A null doc_id ranks behind all ids.  Rows that
repeat a doc_id remove nothing from each other; what goes from one goes from all that hold it.  Extra columns are
ignored.  An empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, short_batches, worker_cache
from .words import words_of

WINDOW, FLUSH, PER_BUCKET, LEAST_BITS = 13, 1_000_000, 2_000_000, 6
LAST_ID = 2**63 - 1
ROWS = "bucket int, docs binary, counts binary, hashes binary"
ANSWERS = "id long, hashes binary"


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.cast(pa.int64()).fill_null(LAST_ID))


def _per_doc(ids: np.ndarray, hashes: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """ids must be grouped: one value of 8-byte hashes for each id."""
    starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, np.int64)
    ends = np.append(starts, len(ids)).astype(np.int32) * np.int32(8)
    return pa.array(ids[starts], pa.int64()), pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(hashes).tobytes())])


def _flush(hashes: np.ndarray, ids: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    order = np.argsort(hashes)
    sorted_ids, sorted_hashes = ids[order], hashes[order]
    starts = np.flatnonzero(np.concatenate(([True], sorted_hashes[1:] != sorted_hashes[:-1])))
    del sorted_hashes
    group = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.append(starts, len(order))))
    above = sorted_ids > np.minimum.reduceat(sorted_ids, starts)[group]
    mine = np.flatnonzero(~above)
    one = np.empty(len(starts), np.int64)
    one[group[mine]] = order[mine]  # of a hash, one window of the smallest id
    once, later = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
    once[one] = True
    later[order] = above
    del order, sorted_ids, group, above, mine, one
    schema = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary())])
    keep = np.flatnonzero(once)
    bucket = (hashes[keep] >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.int64)
    turn = np.argsort(bucket, kind="stable")
    keep, bucket = keep[turn], bucket[turn]
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(keep) else np.zeros(1, np.int64)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    rows: list[tuple] = []
    for a, b in zip(edges[:-1], edges[1:]):
        if len(rows) == 512:
            yield batch(rows)
            rows = []
        own = ids[keep[a:b]]
        heads = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        counts = np.diff(np.append(heads, b - a)).astype(np.uint32)
        packed = counts.astype(np.uint8) if counts.max() < 256 else counts
        rows.append((int(bucket[a]), own[heads].tobytes(), packed.tobytes(), np.ascontiguousarray(hashes[keep[a:b]].view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()))
    where = np.flatnonzero(later)
    if len(where):
        where = where[np.argsort(ids[where], kind="stable")]
        known, answers = _per_doc(ids[where], hashes[where])
        for doc, answer in zip(known.to_pylist(), answers.to_pylist()):
            if len(rows) == 512:
                yield batch(rows)
                rows = []
            rows.append((-1 - int(doc % (1 << bits)), np.int64(doc).tobytes(), b"", answer))
    if rows:
        yield batch(rows)


def _spread(bits: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("substring_dedup")
        held, ids, n = [], [], 0
        for piece in cut(batches, "text"):
            hashes, first = words_of(piece.column("text")).windows(window)
            held.append(hashes)
            ids.append(np.repeat(_ids(piece.column("id")), np.diff(first)))
            n += len(hashes)
            if n >= FLUSH:
                both = np.concatenate(held), np.concatenate(ids)
                held, ids, n = [], [], 0
                yield from _flush(*both, bits)
                del both
        if n:
            both = np.concatenate(held), np.concatenate(ids)
            del held, ids
            yield from _flush(*both, bits)
            del both
        release()
    return run


def _answers(bits: int):
    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        docs, counts, blobs = (table[c].to_pylist() for c in ("docs", "counts", "hashes"))
        if bucket < 0:
            return pa.table({"id": pa.array([int(np.frombuffer(x, np.int64)[0]) for x in docs], pa.int64()), "hashes": pa.array(blobs, pa.binary())})
        ids, hashes = [], []
        for doc, count, blob in zip(docs, counts, blobs):
            own = np.frombuffer(doc, np.int64)
            each = np.frombuffer(count, np.uint8 if len(count) == len(own) else np.uint32)
            ids.append(np.repeat(own, each))
            wide = np.zeros((len(blob) // 7, 8), np.uint8)
            wide[:, :7] = np.frombuffer(blob, np.uint8).reshape(-1, 7)
            hashes.append(wide.reshape(-1).view(np.uint64))
        all_ids, all_hashes = np.concatenate(ids), np.concatenate(hashes)
        del ids, hashes, docs, counts, blobs
        order = np.argsort(all_hashes)
        all_ids, all_hashes = all_ids[order], all_hashes[order]
        del order
        starts = np.flatnonzero(np.concatenate(([True], all_hashes[1:] != all_hashes[:-1])))
        least = np.repeat(np.minimum.reduceat(all_ids, starts), np.diff(np.append(starts, len(all_ids))))
        goes = np.flatnonzero(all_ids > least)
        all_ids, all_hashes = all_ids[goes], all_hashes[goes]
        del starts, least, goes
        turn = np.argsort(all_ids, kind="stable")
        known, answers = _per_doc(all_ids[turn], all_hashes[turn])
        del all_ids, all_hashes, turn
        release()
        return pa.table({"id": known, "hashes": answers})
    return run


def _strip(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                        ("intervals", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), ("kept_text", pa.string())])
    low = np.uint64((1 << 56) - 1)  # the part that answers carry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("substring_dedup")
        for piece in cut(batches, "text"):
            texts, found = piece.column("text").to_pylist(), piece.column("answers").to_pylist()
            some = [i for i, x in enumerate(found) if x]
            if some:
                hashes, first = words_of(piece.column("text").take(pa.array(some))).windows(window)
            rows, turn = [], 0
            for i, (doc_id, text) in enumerate(zip(piece.column("doc_id").to_pylist(), texts)):
                words = (text or "").encode().split()
                spans: list[dict] = []
                kept = words
                if found[i]:
                    own = hashes[first[turn]:first[turn + 1]] & low
                    turn += 1
                    hit = np.isin(own, np.frombuffer(b"".join(found[i]), np.uint64) & low)
                    step = np.zeros(len(words) + 1, np.int64)
                    at = np.flatnonzero(hit)
                    np.add.at(step, at, 1)
                    np.add.at(step, at + window, -1)
                    gone = np.cumsum(step[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                    spans = [{"start": int(a), "length": int(b - a)} for a, b in zip(edge[::2], edge[1::2])]
                    kept = list(compress(words, ~gone))
                rows.append((doc_id, len(words), len(words) - len(kept), spans, b" ".join(kept).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
        release()
    return run


def strip(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, intervals (start and length in words) and kept_text of every row."""
    narrow = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), "text")
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(24, max(LEAST_BITS, (size // 7 // PER_BUCKET).bit_length()))
    entries = narrow.select("id", "text").mapInArrow(_spread(bits, window), ROWS)
    answers = (entries.groupBy("bucket").applyInArrow(_answers(bits), ANSWERS)
               .groupBy("id").agg(F.collect_list("hashes").alias("answers")))
    both = narrow.join(answers, "id", "left").select("doc_id", "text", "answers")
    return both.mapInArrow(_strip(window), "doc_id long, n_words long, n_removed long, intervals array<struct<start:long,length:long>>, kept_text string")
