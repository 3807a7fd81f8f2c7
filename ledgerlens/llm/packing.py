"""Packing tokens into sequences by deficit round-robin over source queues.

Each source has a target share of the tokens: its share of all tokens, or a given weight.  All documents of a source, cut anywhere, are one queue
over the whole table.  Documents are tokenised where they land, and a task notes what each source had before; with the token counts of
(partition, source), which are all that is exchanged first, each token knows its place in its source's queue.  The queues are dealt to lanes of
``LANE`` tokens, to each as much of every source as its target says, so that every lane has the mixture of all however long a document or
common a source is.  What a lane can't be given in whole tokens is the deficit that it starts with.

Within a lane a window of ``LENGTH`` tokens credits every source with its share of the window; sources are served in turn as far
as their credit goes, and what they couldn't use - or took in advance, when a window had room - stays as their deficit for the next one.
Credit below ``BURST`` tokens waits, so that small sources come in usable pieces.  With weights, a source that is used up leaves its share to the others,
and sources without weight follow when all others are used up, each by its size.

A lane's last tokens fill sequences of powers of two, which need no padding; all others are full.

Words are tokenised once per task and cached, as white space of ``[\\x20\\x09-\\x0D]`` always separates tokens here.

Null text is an empty document: its one token is the end token.  A null source is a source.  Repeated rows are packed each.
A null doc_id is kept.  Extra columns are ignored.  An empty table gives no pieces.
"""
from __future__ import annotations

import os
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, objects, short_batches, stage, worker_cache

LENGTH, END, LANE, BURST, CACHE = 4096, 2, 1_000_000, 32, 450_000
TOKENIZER = "word_bpe_49k.json"
CHUNKS = pa.schema([("part", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sources", pa.list_(pa.string())), ("lengths", pa.list_(pa.int64())),
                    ("before", pa.list_(pa.struct([("source", pa.string()), ("tokens", pa.int64())]))), ("width", pa.int32()), ("ids", pa.binary())])
CHUNKS_DDL = "part long, doc_ids array<long>, sources array<string>, lengths array<long>, before array<struct<source:string,tokens:long>>, width int, ids binary"
DEALT = pa.schema([("lane", pa.int64()), ("source", pa.string()), ("place", pa.int64()), ("owed", pa.float64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())),
                   ("lengths", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("width", pa.int32()), ("ids", pa.binary())])
DEALT_DDL = ("lane long, source string, place long, owed double, doc_ids array<long>, starts array<long>, lengths array<long>, doc_tokens array<long>, width int, ids binary")
PIECES = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
PIECES_DDL = "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class WordTokenizer:
    """Token ids of a text as little-endian bytes, two for each where the vocabulary allows it, else four.  A word - a run without
    white space - has the same tokens wherever it stands, and letters and the marks behind them are never in one token, so
    words and their letters are looked up in bounded caches.  New letters are tokenised together and cut behind the tokens that end a word."""

    def __init__(self, path: str, most: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self._tokenizer, self._most = Tokenizer.from_file(path), most
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self.kind = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._words: dict[str, bytes] = {}
        self._parts: dict[str, bytes] = {}
        self._split = re.compile(r"([^\W\d_]+)([.,;:!?*&%$#|]*)").fullmatch

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.kind).tobytes() for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, runs: list[str]) -> list[bytes]:
        """Of runs of letters, each of which the tokenizer takes for one word."""
        out: list[bytes] = []
        for i in range(0, len(runs), 512):
            own = runs[i:i + 512]
            ids = np.array(self._tokenizer.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, self.kind)
            ends = (np.flatnonzero(self._ends[ids]) + 1) * self.kind.itemsize
            if len(ends) == len(own):
                data, edges = ids.tobytes(), [0, *ends.tolist()]
                out += [data[x:y] for x, y in zip(edges, edges[1:])]
            else:  # a vocabulary that doesn't mark the ends
                out += self._alone(own)
        return out

    def _stems(self, stems: list[str]) -> list[bytes | None]:
        """None for letters that the tokenizer's own normal form turns into something else than letters."""
        known = self._parts
        out = list(map(known.get, stems))
        new = [i for i, x in enumerate(out) if x is None and (stems[i].isascii() or unicodedata.normalize("NFC", stems[i]).lower().isalpha())]
        for i, found in zip(new, self._letters([stems[i] for i in new])):
            out[i] = found
        if len(known) < self._most:
            known.update((stems[i], out[i]) for i in new)
        return out

    def _learn(self, words: pa.Array) -> list[bytes]:
        parts = pc.extract_regex(words, r"^(?P<stem>\p{L}+)(?P<marks>[.,;:!?*&%$#|]*)$")
        fits = np.flatnonzero(np.asarray(parts.is_valid()))
        out: list[bytes | None] = [None] * len(words)
        if len(fits):
            parts = parts.take(pa.array(fits))
            stems, marks = pc.ascii_lower(parts.field("stem")).dictionary_encode(), parts.field("marks").dictionary_encode()
            letters = pa.array(self._stems(objects(stems.dictionary)), pa.binary()).take(stems.indices)
            rest = pa.array(self._alone(objects(marks.dictionary)), pa.binary()).take(marks.indices)
            for i, x in zip(fits.tolist(), objects(pc.binary_join_element_wise(letters, rest, b""))):
                out[i] = x
        left = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(left, self._alone(objects(words.take(pa.array(left, pa.int64()))))):
            out[i] = x
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin, with the end."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        kinds, which, known = objects(words.dictionary), np.asarray(words.indices), self._words
        own = list(map(known.get, kinds))
        new = [i for i, x in enumerate(own) if x is None]
        for i, x in zip(new, self._learn(words.dictionary.take(pa.array(new, pa.int64())))):
            own[i] = x
        if len(known) < self._most:  # the first words to come are the commonest ones
            known.update((kinds[i], own[i]) for i in new)
        data = np.frombuffer(b"".join(own), self.kind)
        size = np.fromiter(map(len, own), np.int64, len(own)) // self.kind.itemsize
        start = np.cumsum(size) - size
        each = size[which]
        ends = np.concatenate(([0], np.cumsum(each)))
        kind = np.int32 if max(ends[-1], len(data)) < 2**31 else np.int64
        at = np.repeat((start[which] - ends[:-1]).astype(kind), each)
        at += np.arange(ends[-1], dtype=kind)
        return data.take(at), ends[np.asarray(split.offsets) - split.offsets[0].as_py()]


def _tokenizer(path: str) -> WordTokenizer:
    kept = worker_cache("packing")
    if path not in kept:
        kept[path] = WordTokenizer(path)
    return kept[path]


def _chunks(path: str, end: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        width, last = tokenizer.kind.itemsize, np.array([end], tokenizer.kind).tobytes()
        part, before = TaskContext.get().partitionId(), {}
        docs: list[tuple] = []
        size = 0

        def emit() -> pa.RecordBatch:
            row = [[part], [[d[0] for d in docs]], [[d[1] for d in docs]], [[len(d[2]) // width for d in docs]],
                   [[{"source": s, "tokens": n} for s, n in before.items()]], [width], [b"".join([d[2] for d in docs])]]
            for _, source, ids in docs:
                before[source] = before.get(source, 0) + len(ids) // width
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, CHUNKS)], schema=CHUNKS)

        for piece in cut(batches, "text", 4 << 20):
            ids, first = tokenizer(piece.column("text"))
            for doc_id, source, a, b in zip(piece.column("doc_id").to_pylist(), piece.column("source").to_pylist(), first.tolist(), first[1:].tolist()):
                docs.append((doc_id, source, ids[a:b].tobytes() + last))
                size += b - a + 1
                if size >= most:
                    yield emit()
                    docs, size = [], 0
        if docs:
            yield emit()
    return run


def chunks(docs: DataFrame, path: str, end: int = END, most: int = LANE) -> DataFrame:
    """Tokenised documents, about ``most`` tokens a row, with the tokens that each source had before in the partition."""
    narrow = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return narrow.repartition(F.xxhash64("doc_id", "text")).mapInArrow(_chunks(path, end, most), CHUNKS_DDL)


def _starts(staged: DataFrame) -> DataFrame:
    """part, and of each of its sources the tokens before the part (ahead) and of all parts (size)."""
    each = staged.select("part", F.explode(F.arrays_zip(F.col("sources"), F.col("lengths"))).alias("d")).groupBy("part", F.col("d.sources").alias("source")).agg(F.sum("d.lengths").alias("tokens"))
    up = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = each.groupBy(F.col("source").alias("s")).agg(F.sum("tokens").alias("size"))
    own = each.withColumn("ahead", F.coalesce(F.sum("tokens").over(up), F.lit(0))).join(whole, F.col("source").eqNullSafe(F.col("s")))
    return own.select("part", "source", "ahead", "tokens", "size")


class Course:
    """How far each source's queue has been dealt when x tokens of all sources have been.

    ``named`` has the weight and size of the sources with a weight: they are dealt by weight until they are used up, which the
    ``times`` tell (tokens per weight).  The others follow, each by its size; they are all where no weights are given."""

    def __init__(self, total: int, named: dict | None = None):
        self.total, self.named = total, {s: (Fraction(w), n) for s, (w, n) in (named or {}).items() if w > 0 and n}
        self.times = [Fraction(0), *sorted({n / w for w, n in self.named.values()})]
        self.dealt = [sum(min(n, int(w * t)) for w, n in self.named.values()) for t in self.times]

    def queue(self, source: str | None, size: int) -> "Queue":
        if source in self.named:
            w, n = self.named[source]
            return Queue(self.dealt, [min(n, int(w * t)) for t in self.times])
        return Queue([self.dealt[-1], self.total], [0, size])


class Queue:
    """A source's course: straight lines between knots (x tokens of all sources, own tokens)."""

    def __init__(self, xs: list[int], own: list[int]):
        self.xs, self.own = xs, own

    def at(self, x: int) -> tuple[int, float]:
        """The whole tokens that are dealt before x, and what is owed then (0 or less, above -1)."""
        k = bisect_right(self.xs, x) - 1
        if k < 0 or k == len(self.xs) - 1:
            return self.own[max(k, 0)], 0.0
        over, run = (x - self.xs[k]) * (self.own[k + 1] - self.own[k]), self.xs[k + 1] - self.xs[k]
        return self.own[k] - (-over // run), -(-over % run) / run

    def lane(self, place: int, size: int) -> int:
        """The lane of ``size`` tokens to which the own token at ``place`` goes."""
        k = bisect_right(self.own, place) - 1
        lane = (self.xs[k] + (place - self.own[k]) * (self.xs[k + 1] - self.xs[k]) // (self.own[k + 1] - self.own[k])) // size
        while self.at((lane + 1) * size)[0] <= place:
            lane += 1
        while self.at(lane * size)[0] > place:
            lane -= 1
        return lane


def _deal(course: Course, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                ids, width = memoryview(row["ids"]), row["width"]
                had = {x["source"]: x["tokens"] for x in row["before"]}
                queues = {x["source"]: (course.queue(x["source"], x["size"]), x["ahead"] + had.get(x["source"], 0)) for x in row["queues"]}
                places = {s: place for s, (_, place) in queues.items()}
                until: dict = {}
                now: dict = {}
                out: dict = {}
                first = 0
                for doc_id, s, n in zip(row["doc_ids"], row["sources"], row["lengths"]):
                    start = 0
                    while start < n:
                        place = places[s]
                        if place >= until.get(s, 0):
                            queue = queues[s][0]
                            lane = queue.lane(place, size)
                            until[s] = queue.at((lane + 1) * size)[0]
                            now[s] = out[lane, s] = (place, queue.at(lane * size)[1], [], [], [], [], [])
                        take = min(n - start, until[s] - place)
                        for values, x in zip(now[s][2:], (doc_id, start, take, n, ids[width * (first + start):width * (first + start + take)])):
                            values.append(x)
                        start += take
                        places[s] += take
                    first += n
                for (lane, s), (place, owed, doc_ids, starts, lengths, tokens, pieces) in out.items():
                    own = [[lane], [s], [place], [owed], [doc_ids], [starts], [lengths], [tokens], [width], [b"".join(pieces)]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(own, DEALT)], schema=DEALT)
    return run


def serve(lengths: dict, carried: dict, share: dict | None = None, length: int = LENGTH, burst: int = BURST) -> Iterator[list[tuple]]:
    """Windows as lists of (source, tokens): deficit round-robin over queues of ``lengths`` tokens.

    A window's credit is dealt by ``share``, or by what each queue still holds, so that all end together.  The deficits
    ``carried`` from what came before are paid in equal parts by all windows, not at once by the first ones."""
    left = {s: n for s, n in lengths.items() if n}
    windows = max(1, -(-sum(left.values()) // length))
    credit = dict.fromkeys(left, 0.0)
    turn = sorted(left, key=lambda s: (s is None, s or ""))
    while left:
        room, window = min(length, sum(left.values())), {}
        active = [s for s in turn if s in left]
        weight = {s: left[s] if share is None else share[s] for s in active}
        total = sum(weight.values())
        for s in active:
            credit[s] += room * (weight[s] / total if total else 1 / len(active)) + carried.get(s, 0) / windows
        for s in active:
            n = min(int(credit[s]), left[s], room)
            if n >= min(burst, left[s]) and n > 0:
                window[s] = n
                credit[s] -= n
                room -= n
                left[s] -= n
        while room:  # what waits in small credits, or a queue that ran out, leaves room: the largest credit takes it in advance
            s = max((s for s in active if left[s]), key=lambda s: credit[s])
            n = min(room, left[s], max(burst, int(credit[s])))
            window[s] = window.get(s, 0) + n
            credit[s] -= n
            room -= n
            left[s] -= n
        for s in active:
            if not left[s]:
                del left[s]
        yield list(window.items())


def _tail(n: int) -> list[int]:
    """n as falling powers of two."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def _pack(length: int, burst: int, weights: dict | None):
    def run(lane: pa.Table) -> pa.Table:
        rows = sorted(lane.to_pylist(), key=lambda r: (r["source"] is None, r["source"] or "", r["place"]))
        base = rows[0]["lane"] << 24
        queues: dict = {}  # of each source its pieces of documents: doc_id, start, length, doc_tokens, ids
        carried: dict = {}
        for row in rows:
            ids, a = memoryview(np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4").tobytes()), 0
            carried.setdefault(row["source"], row["owed"])
            own = queues.setdefault(row["source"], [])
            for doc_id, start, n, tokens in zip(row["doc_ids"], row["starts"], row["lengths"], row["doc_tokens"]):
                own.append((doc_id, start, n, tokens, ids[4 * a:4 * (a + n)]))
                a += n
        lengths = {s: sum(x[2] for x in own) for s, own in queues.items()}
        share = None if weights is None else {s: weights.get(s, 0.0) for s in queues}
        at = {s: [0, 0] for s in queues}  # the queue's piece and the tokens of it that are gone
        out: list[tuple] = []
        sequence = 0
        for window in serve(lengths, carried, share, length, burst):
            total = sum(n for _, n in window)
            sizes = [length] if total == length else _tail(total)
            room, filled = sizes.pop(0), 0
            for s, n in window:
                own, place = queues[s], at[s]
                while n:
                    doc_id, start, size, tokens, ids = own[place[0]]
                    gone = place[1]
                    take = min(n, size - gone, room - filled)
                    out.append((doc_id, s, start + gone, take, tokens, base + sequence, filled, bytes(ids[4 * gone:4 * (gone + take)])))
                    filled += take
                    n -= take
                    if gone + take == size:
                        place[0], place[1] = place[0] + 1, 0
                    else:
                        place[1] = gone + take
                    if filled == room:
                        sequence, filled = sequence + 1, 0
                        room = sizes.pop(0) if sizes else 0
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), PIECES)], schema=PIECES)
    return run


def pack(docs: DataFrame, path: str | None = None, weights: dict | None = None, length: int = LENGTH, burst: int = BURST, end: int = END, lane: int = LANE) -> DataFrame:
    """doc_id, source, start, length, doc_tokens, sequence_id, offset and ids (unsigned 32-bit, little-endian) of every piece.

    weights: target share of each source, any scale; sources that aren't named come when the others are used up.  The driver gets the sizes of the
    sources that are named, and of all together."""
    lane = max(1, lane // length) * length
    staged = stage(chunks(docs, path or tokenizer_path(), end, lane), "chunks")
    starts = stage(_starts(staged), "starts")
    total = starts.agg(F.sum("tokens")).first()[0] or 0
    named = None
    if weights is not None:
        known = F.lit(False)
        for s in weights:
            known = known | F.col("source").eqNullSafe(F.lit(s))
        sizes = {r["source"]: r["size"] for r in starts.where(known).groupBy("source").agg(F.max("size").alias("size")).collect()}
        named = {s: (w, sizes.get(s, 0)) for s, w in weights.items()}
    dealt = staged.join(starts.groupBy("part").agg(F.collect_list(F.struct("source", "ahead", "size")).alias("queues")), "part").mapInArrow(_deal(Course(total, named), lane), DEALT_DDL)
    return dealt.groupBy("lane").applyInArrow(_pack(length, burst, weights), PIECES_DDL)
