"""Exact de-duplication against a minimal perfect hash of the digests seen before.

Texts are equal when they are identical without the characters of ``[\\x20\\x09-\\x0D]``; their
SHA-256 is the digest.  The distinct digests of the *history* are dealt to buckets by their first
bytes.  Each bucket gets a minimal perfect hash: a cascade of bit vectors, in each of which a digest
that alone falls on a bit takes it, while the others try the next one; the number of set bits
before its own is a digest's slot.  A slot holds the whole digest and a locator of the winner, so a lookup
compares 32 bytes and never trusts the hash alone.  New digests found there join the stored group;
the others form groups of their own.

Digests are aggregated before each shuffle, so that a group of copies reaches a bucket as
one row however large it is; a bucket holds about ``BUCKET_ROWS`` digests.

Null text counts as empty.  A null doc_id is a document like any other and ranks behind all ids.
Rows that repeat a doc_id all count in the group's size; ``mark`` reports each of them, ``keep`` leaves
one.  An empty table gives an empty result.  Other columns pass through ``keep`` unchanged.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, stage, worker_cache

BUCKET_ROWS = 8192
GROUP = "digest binary, chars long, doc_id long, n long"
INDEX = "bucket long, level_bits array<long>, bits binary, digests binary, chars array<long>, doc_ids array<long>, counts array<long>"


# --- minimal perfect hash of one bucket ------------------------------------------------------

def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _places(words: np.ndarray, level: int, size: int) -> np.ndarray:
    return _mix(words[:, level % 4] + np.uint64(level * 0xA24BAED4963EE407 % 2**64)) % np.uint64(size)


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)


def perfect_hash(digests: list[bytes]) -> tuple[list[int], np.ndarray]:
    """Sizes of the levels, and their bits one after the other, for distinct 32-byte digests."""
    left, sizes, bits = _words(digests), [], []
    while len(left):
        size = 2 * len(left) + 1
        place = _places(left, len(sizes), size)
        alone = np.bincount(place.astype(np.int64), minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[place.astype(np.int64)]]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def slots(digests: list[bytes], sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each digest; -1 where no level has a bit for it (certainly not a member)."""
    words = _words(digests)
    rank = np.cumsum(bits) - 1
    out = np.full(len(words), -1, np.int64)
    todo, base = np.arange(len(words)), 0
    for level, size in enumerate(sizes):
        at = base + _places(words[todo], level, size).astype(np.int64)
        hit = bits[at]
        out[todo[hit]] = rank[at[hit]]
        todo, base = todo[~hit], base + size
    return out


def _build(table: pa.Table) -> pa.Table:
    worker_cache("digests")
    digests = table["digest"].to_pylist()
    sizes, bits = perfect_hash(digests)
    order = np.empty(len(digests), np.int64)
    order[slots(digests, sizes, bits)] = np.arange(len(digests))
    placed = table.take(pa.array(order))
    return pa.table({
        "bucket": pa.array(table["bucket"][:1].to_pylist(), pa.int64()),
        "level_bits": pa.array([sizes], pa.list_(pa.int64())),
        "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()),
        "digests": pa.array([b"".join(placed["digest"].to_pylist())], pa.binary()),
        "chars": pa.array([placed["chars"].to_pylist()], pa.list_(pa.int64())),
        "doc_ids": pa.array([placed["doc_id"].to_pylist()], pa.list_(pa.int64())),
        "counts": pa.array([placed["n"].to_pylist()], pa.list_(pa.int64())),
    })


def _better(a: tuple, b: tuple) -> tuple:
    """Of two (chars, doc_id): more characters, then the smaller id, null last."""
    rank = lambda x: (-x[0], x[1] is None, x[1] or 0)
    return min(a, b, key=rank)


def _probe(index: pa.Table, new: pa.Table) -> pa.Table:
    digests = new["digest"].to_pylist()
    held: list[list] = []
    if index.num_rows:
        row = index.to_pylist()[0]
        sizes = row["level_bits"]
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool)
        store = row["digests"]
        held = [[store[32 * i:32 * i + 32], *x] for i, x in enumerate(zip(row["chars"], row["doc_ids"], row["counts"]))]
        found = slots(digests, sizes, bits) if digests else np.zeros(0, np.int64)
    else:
        found = np.full(len(digests), -1, np.int64)
    own = []
    for digest, chars, doc_id, n, slot in zip(digests, new["chars"].to_pylist(), new["doc_id"].to_pylist(), new["n"].to_pylist(), found.tolist()):
        if slot >= 0 and held[slot][0] == digest:
            group = held[slot]
            group[1], group[2] = _better((group[1], group[2]), (chars, doc_id))
            group[3] += n
        else:
            own.append([digest, chars, doc_id, n])
    out = held + own
    return pa.table({k: pa.array([x[i] for x in out], kind) for i, (k, kind) in enumerate((("digest", pa.binary()), ("chars", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64())))})


# --- on tables -------------------------------------------------------------------------------

def fingerprints(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.char_length(text).cast("long").alias("chars"),
        F.unhex(F.sha2(F.regexp_replace(text, SPACE + "+", "").cast("binary"), 256)).alias("digest"))


def groups_of(prints: DataFrame) -> DataFrame:
    """One row per digest: its winner and its number of rows."""
    return (prints.groupBy("digest")
            .agg(F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("d"))).alias("w"), F.count(F.lit(1)).alias("n"))
            .select("digest", (-F.col("w.c")).alias("chars"), F.col("w.d").alias("doc_id"), "n"))


def _bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    return groups.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("long"))


def build_index(groups: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket: the minimal perfect hash of the digests and what their slots hold."""
    return _bucketed(groups, buckets).groupBy("bucket").applyInArrow(_build, INDEX)


def probe(index: DataFrame, groups: DataFrame, buckets: int) -> DataFrame:
    """All groups, those of the index brought up to date with ``groups``."""
    return index.groupBy("bucket").cogroup(_bucketed(groups, buckets).groupBy("bucket")).applyInArrow(_probe, GROUP)


def historical(doc_id: Column) -> Column:
    """The rows that count as seen before, where one table holds both: half of the ids by checksum."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def mark(docs: DataFrame, history: Column | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    prints = stage(fingerprints(docs), "prints")
    return _marked(prints, all_groups(prints, history))


def all_groups(prints: DataFrame, history: Column | None = None) -> DataFrame:
    history = historical(F.col("doc_id")) if history is None else history
    buckets = max(1, math.ceil(prints.count() / BUCKET_ROWS))
    index = stage(build_index(groups_of(prints.where(history)), buckets), "mph")
    return probe(index, groups_of(prints.where(~history)), buckets)


def _marked(prints: DataFrame, groups: DataFrame) -> DataFrame:
    best = groups.select("digest", F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"))
    return prints.join(best, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep(docs: DataFrame, history: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that win their group, one a group, with all columns."""
    marked = mark(docs, history).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), F.col("group_size").alias("__n")).distinct()
    sha = F.sha2(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACE + "+", "").cast("binary"), 256)
    rows = docs.withColumn("__text_sha", sha)
    once = Window.partitionBy("__id", "__sha").orderBy(F.char_length(F.coalesce("text", F.lit(""))).desc())
    return (rows.join(marked, rows["doc_id"].cast("long").eqNullSafe(marked["__id"]) & (rows["__text_sha"] == marked["__sha"]))
            .withColumn("__row", F.row_number().over(once)).where("__row = 1").select(*[F.col(f"`{c}`") for c in docs.columns]))
