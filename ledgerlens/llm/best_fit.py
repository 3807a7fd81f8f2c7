"""Packing whole documents into few sequences by best-two-fit.

A task tokenises the documents of its own partition, so nothing is shuffled, and packs them in lanes of about ``LANE`` tokens.  A document
longer than a sequence is cut into pieces of its full length, a shorter piece first; only that first piece is packed with others.
A sequence is filled greedily: the longest piece that still fits, until none does.  Then, where it holds more than one piece,
the shortest is taken out and two unpacked pieces come in its place, if a pair fits the larger gap with less left over; of all pairs
the one that leaves least.  Lengths are kept as a bit set, so that "the longest that fits" is one operation whatever the lane holds.

A lane is large (thousands of sequences), so what is left over at its end is far below a thousandth of the tokens: at most one sequence a lane that
short pieces could have filled.  Memory holds a lane's ids (two bytes a token for vocabularies below 65,536) and one row a piece.

Null text is an empty document: its one token is the end token.  A null doc_id is kept.  Repeated rows are packed each.  Pieces of equal length
are taken last come, first served.  Extra columns are ignored.  An empty table gives no pieces.  A text of many megabytes is tokenised in parts cut between segments.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, worker_cache
from .segments import ByteLevel, Cutter, Known, gather

LENGTH, END, LANE, CACHE = 2048, 0, 16_000_000, 500_000
TOKENIZER = "byte_bpe_50k.json"
EMIT = 1 << 20  # tokens in a batch of pieces
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
PIECES_DDL = "doc_id long, piece int, start long, length long, sequence_id long, offset long, ids binary"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def best_two_fit(lengths: np.ndarray, room: int = LENGTH) -> list[list[int]]:
    """Sequences as lists of the places of their pieces in ``lengths`` (each from 1 to room)."""
    order = np.argsort(lengths, kind="stable")
    first = np.searchsorted(lengths[order], np.arange(room + 2)).tolist()
    stacks = {s: order[first[s]:first[s + 1]].tolist() for s in range(1, room + 1) if first[s] < first[s + 1]}
    there = 0  # bit s: there are unpacked pieces of length s
    for s in stacks:
        there |= 1 << s
    upto = [(2 << s) - 1 for s in range(room + 1)]

    def take(s: int) -> int:
        nonlocal there
        own = stacks[s]
        if len(own) == 1:
            there ^= 1 << s
        return own.pop()

    def two(gap: int, beyond: int) -> tuple[int, int] | None:
        """The lengths of the pair with the largest sum above ``beyond`` that fits the gap."""
        found = None
        x = (there & upto[gap - 1]).bit_length() - 1
        while x > 0 and 2 * x > beyond:
            y = (there & upto[min(x, gap - x)]).bit_length() - 1
            if y == x and len(stacks[x]) < 2:
                y = (there & upto[x - 1]).bit_length() - 1
            if y > 0 and x + y > beyond:
                found, beyond = (x, y), x + y
                if beyond == gap:
                    break
            x = (there & upto[x - 1]).bit_length() - 1
        return found

    out = []
    while there:
        own, sizes, gap = [], [], room
        while gap and (s := (there & upto[gap]).bit_length() - 1) > 0:
            own.append(take(s))
            sizes.append(s)
            gap -= s
        if gap and len(own) > 1 and there:
            pair = two(gap + sizes[-1], sizes[-1])
            if pair:
                back = own.pop()
                own += [take(pair[0]), take(pair[1])]
                stacks[sizes[-1]].append(back)
                there |= 1 << sizes[-1]
        out.append(own)
    return out


def _tools(path: str) -> tuple[ByteLevel, Cutter, Known]:
    kept = worker_cache("best_fit")
    if path not in kept:
        tokenizer = ByteLevel(path)
        kept[path] = (tokenizer, Cutter(tokenizer.tokens), Known(tokenizer.ids, CACHE))
    return kept[path]


def documents(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """doc_ids, the ids of their documents one after the other with their end tokens, and the documents' lengths."""
    tokenizer, cutter, known = _tools(path)
    begun: list[np.ndarray] = []
    for rows, texts, last in cutter.parts(batches, "text"):
        segments, first = cutter(texts)
        segments = segments.dictionary_encode()
        ids, at = gather(known(segments.dictionary.to_pylist()), tokenizer.kind, np.asarray(segments.indices))
        at = at[first]
        if not last or begun:  # parts of one long text
            begun.append(ids)
            if not last:
                continue
            ids, begun = np.concatenate(begun), []
            at = np.array([0, len(ids)])
        yield rows.column("doc_id").to_pylist(), np.insert(ids, at[1:], np.array(end, tokenizer.kind)), np.diff(at) + 1


def _pieces(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents' lengths: each piece's document, number, start and length."""
    count = -(-sizes // length)
    doc = np.repeat(np.arange(len(sizes)), count)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    head = sizes - (count - 1) * length
    start = np.where(piece == 0, 0, head[doc] + (piece - 1) * length)
    return doc, piece, start, np.where(piece == 0, head[doc], length)


def _pack(path: str, length: int, end: int, lane: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, doc_ids, held, sizes, tokens = TaskContext.get().partitionId() << 40, [], [], [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            ids, size = np.concatenate(held), np.concatenate(sizes)
            doc, piece, start, long = _pieces(size, length)
            begin = (np.cumsum(size) - size)[doc] + start
            who = np.array([d if d is not None else 0 for d in doc_ids], np.int64)
            nobody = np.array([d is None for d in doc_ids], bool)
            short = np.flatnonzero(long < length)
            packed = [[i] for i in np.flatnonzero(long == length).tolist()] + [short[own].tolist() for own in best_two_fit(long[short], length)]
            per = max(1, EMIT // length)
            for k in range(0, len(packed), per):
                some = packed[k:k + per]
                order = np.array([i for own in some for i in own])
                number = np.repeat(np.arange(len(some)), [len(own) for own in some])
                n = long[order]
                before = np.cumsum(n) - n
                offset = before - before[np.searchsorted(number, number)]
                at = np.repeat(begin[order] - before, n) + np.arange(int(n.sum()))
                ends = pa.py_buffer(np.append(before, n.sum()).astype(np.int32) * np.int32(4))
                data = pa.Array.from_buffers(pa.binary(), len(order), [None, ends, pa.py_buffer(ids.take(at).astype("<u4"))])
                d = doc[order]
                yield pa.RecordBatch.from_arrays([pa.array(who[d], mask=nobody[d]), pa.array(piece[order], pa.int32()), pa.array(start[order]), pa.array(n),
                                                  pa.array(sequence + number), pa.array(offset), data], schema=PIECES)
                sequence += len(some)

        for own, ids, size in documents(batches, path, end):
            doc_ids += own
            held.append(ids)
            sizes.append(size)
            tokens += len(ids)
            if tokens >= lane:
                yield from emit()
                doc_ids, held, sizes, tokens = [], [], [], 0
        if doc_ids:
            yield from emit()
    return run


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, lane: int = LANE) -> DataFrame:
    """doc_id, piece, start, length, sequence_id, offset and ids (unsigned 32-bit, little-endian) of every piece.

    A sequence belongs to one partition of ``docs``; its number is the partition's number times 2**40 and a count."""
    narrow = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_pack(path or tokenizer_path(), length, end, lane), PIECES_DDL)
