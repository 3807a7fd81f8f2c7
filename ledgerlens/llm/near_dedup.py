"""Near duplicates by bottom-k sketches: documents whose word shingles have a Jaccard similarity of 0.8 or more.

One hash function; a document's sketch is the ``K`` smallest hashes of its shingles.  Documents with equal sets
form a class first, which one of them stands for.  Inverted lists hold, for each retained value, the classes
that have it.  Two similar sketches share many values, so a class is listed only under its rarest ones: as many
as at least one shared value must be among (``NEED`` of K shared values are asked for; at a similarity of
0.8 fewer have a chance of about 1e-6.  Sketches that hold the whole set miss nothing).

Pairs within a list are never all formed.  In each round a few hubs of a list, first those whose values are
commonest and later those outside the list's largest component, are compared with its members.  Pairs are
filtered by the estimate from the sketch of the union and verified by the exact similarity of the whole sets.
Hubs then leave the list, as all their pairs are done; a list whose members are in one component is done
too, as its other links can't change the result.  After the first round, what is left is listed anew, by the rarest shingles of the whole
sets: so many that similar sets of the sizes at hand must share one of them.  Members of a large group that differ too much from its
origin, and texts that share no more than a passage, then rarely meet.  Rounds go on until no list is left, with more hubs each
time, so no link that would join two components is dropped.

Null text and text without words: an empty set, linked with nothing.  Fewer words than a shingle: the whole
sequence is the one shingle.  A null doc_id is a document that comes behind all ids; those with equal texts share it, and
its component_id is null where all in it are.  Rows that repeat a doc_id are taken each with its own text.  Extra columns are ignored
by ``mark`` and kept by ``keep``.  An empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, short_batches, stage, worker_cache
from .components import components
from .words import mix64, words_of

SHINGLE, PERCENT, K, NEED, LEAST_ESTIMATE, HUBS, SALTS = 5, 80, 48, 24, 0.45, 4, 32
LAST_ID = 2**63 - 1


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    worker_cache("shingles")
    words = words_of(column, lower=True)
    hashes, first = words.windows(width)
    n = np.diff(words.first)
    for d in range(len(column)):
        if n[d] >= width:
            yield np.unique(hashes[first[d]:first[d + 1]].view(np.int64))
        elif n[d]:
            few = words.hashes[words.first[d]:words.first[d + 1]]
            whole = few[0]
            for x in few[1:]:
                whole = mix64(np.array([whole ^ np.uint64(0xA5A5A5A5A5A5A5A5)]) + x)[0]
            yield np.array([whole], np.uint64).view(np.int64)
        else:
            yield np.zeros(0, np.int64)


def _key(members: np.ndarray, doc: int) -> bytes:
    """128 bits of the whole set; an empty set has a key of its own."""
    return hashlib.blake2b(members.tobytes() if len(members) else b"%d" % doc, digest_size=16).digest()


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in values]))).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))


def _sketch(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in cut(batches, "text"):
            sets = list(_sets(piece.column("text"), width))
            yield pa.RecordBatch.from_pydict({
                "id": piece.column("id"), "n": pa.array([len(x) for x in sets], pa.int64()),
                "key": pa.array([_key(x, i) for x, i in zip(sets, piece.column("id").to_pylist())], pa.binary()),
                "sketch": _lists([x[:k] for x in sets])})
    return run


def _whole(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in cut(batches, "text"):
            yield pa.RecordBatch.from_pydict({"v": piece.column("id"), "members": _lists(list(_sets(piece.column("text"), width)))})
    return run


def sketches(docs: DataFrame, width: int = SHINGLE, k: int = K) -> DataFrame:
    """id (doc_id, the last long for null), n (size of the set), key (128 bits of the whole set), sketch."""
    return _narrow(docs).mapInArrow(_sketch(width, k), "id long, n long, key binary, sketch array<long>")


def _narrow(docs: DataFrame) -> DataFrame:
    return short_batches(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), "text")


def inverted_lists(reps: DataFrame, k: int = K, need: int = NEED, percent: int = PERCENT) -> DataFrame:
    """value, v, n, rank, cap: the classes under their rarest values that others have too.  rank is higher for classes
    with common values, as the origin of many copies has them; cap bounds the size of partners, here not."""
    values = reps.select("v", "n", F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    shared = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    held = values.join(shared, "value")
    own = Window.partitionBy("v")
    least = F.least(F.expr(f"({percent} * n + 99) div 100"), F.lit(need))
    return (held.withColumn("place", F.row_number().over(own.orderBy("df", "value")) + F.col("size") - F.count(F.lit(1)).over(own))
            .withColumn("rank", F.sum(F.log2("df")).over(own))
            .where(F.col("place") <= F.col("size") - least + 1).select("value", "v", "n", "rank", F.lit(LAST_ID).alias("cap")))


def _hubs(lists: DataFrame, count: int, order: list) -> DataFrame:
    """The first ``count`` members of each list; chosen within salted parts of a list first."""
    part = Window.partitionBy("value", F.pmod(F.xxhash64("v"), F.lit(SALTS))).orderBy(*order)
    best = Window.partitionBy("value").orderBy(*order)
    return (lists.withColumn("__r", F.row_number().over(part)).where(F.col("__r") <= count)
            .withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= count).drop("__r"))


def _estimate(k: int) -> Column:
    """Share of the union's bottom-k that both sketches hold."""
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, k)
    return F.size(F.array_intersect(union, F.array_intersect("sketch_a", "sketch_b"))) / F.size(union)


def similar(pairs: DataFrame, reps: DataFrame, sets: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar enough."""
    a = reps.select(F.col("v").alias("a"), F.col("sketch").alias("sketch_a"))
    b = reps.select(F.col("v").alias("b"), F.col("sketch").alias("sketch_b"))
    likely = pairs.join(b, "b").join(a, "a").where(_estimate(k) >= LEAST_ESTIMATE).select("a", "b")
    both = (likely.join(sets.select(F.col("v").alias("b"), F.col("members").alias("set_b")), "b")
            .join(sets.select(F.col("v").alias("a"), F.col("members").alias("set_a")), "a"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(100 * common >= percent * (F.size("set_a") + F.size("set_b") - common)).select("a", "b")


def mark(docs: DataFrame, width: int = SHINGLE, k: int = K, need: int = NEED, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    rows = stage(sketches(docs, width, k), "sketches")
    classes = stage(rows.where("n > 0").groupBy("key").agg(F.min("id").alias("v")), "classes")
    reps = stage(rows.join(classes, (rows["key"] == classes["key"]) & (rows["id"] == classes["v"])).select("v", "n", "sketch", rows["key"].alias("key")).dropDuplicates(["key"]).drop("key"), "reps")
    lists = stage(inverted_lists(reps, k, need, percent), "lists")
    active = lists.groupBy("value").agg(F.count(F.lit(1)).alias("c")).where("c > 1").join(lists, "value").select(F.col("v").alias("id")).distinct()
    sets = stage(_narrow(docs).join(active, "id", "left_semi").mapInArrow(_whole(width), "v long, members array<long>"), "sets")
    links, labels, hubs_each = None, None, HUBS
    while True:
        now = stage(_open(lists, labels), "open")
        if now.isEmpty():
            break
        hubs = stage(_hubs(now, hubs_each, [F.col("stray").desc(), F.col("rank").desc(), F.col("v")]), "hubs")
        found = similar(_pairs(now, hubs, percent), reps, sets, k, percent)
        links = stage(found if labels is None else links.union(found), "linked")
        lists = now.join(hubs.select("value", "v"), ["value", "v"], "left_anti").select("value", "v", "n", "rank", "cap")
        if labels is None:
            labels = stage(components(links), "labels")
            lists = stage(whole_lists(stage(_open(lists, labels), "open"), sets, percent), "lists")
        else:
            labels = stage(components(links), "labels")
        hubs_each *= 4
    label = F.col("v") if labels is None else F.coalesce("component", "v")
    found = (classes if labels is None else classes.join(labels, classes["v"] == labels["node"], "left")).select("key", label.alias("component"))
    done = rows.join(found, "key", "left").withColumn("component", F.coalesce("component", "id"))
    real = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return done.select(real("id").alias("doc_id"), F.col("n").alias("n_shingles"), real("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def _pairs(now: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """a, b, once each: hubs (first) with the members of their lists that are in other components and near enough in size."""
    hub = hubs.select("value", F.col("v").alias("a"), F.col("n").alias("hub_n"), F.col("c").alias("hub_c"), F.col("cap").alias("hub_cap"))
    near = ((F.col("hub_c") != F.col("c")) & (F.col("n") <= F.col("hub_cap")) & (F.col("hub_n") <= F.col("cap"))
            & (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")))
    both = now.join(hub, (now["value"] == hub["value"]) & near).select("a", F.col("v").alias("b"))
    return both.groupBy(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).agg(F.max("a").alias("a")).select("a", (F.col("x") + F.col("y") - F.col("a")).alias("b"))


def _open(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The lists with members of several components, with each member's component c; stray: it is outside the list's largest one."""
    if labels is None:
        several = lists.groupBy("value").agg((F.min("v") != F.max("v")).alias("more")).where("more").select("value")
        return lists.join(several, "value").withColumn("c", F.col("v")).withColumn("stray", F.lit(False))
    sizes = lists.groupBy("value").agg(F.min("n").alias("least"), F.max("cap").alias("most"))
    lists = lists.join(sizes, "value").where("least <= cap and n <= most").drop("least", "most")  # the others have no partner of a size they could be similar to
    own = lists.join(labels, lists["v"] == labels["node"], "left").select(lists["*"], F.coalesce("component", "v").alias("c"))
    parts = own.groupBy("value", "c").agg(F.count(F.lit(1)).alias("m"))
    whole = parts.groupBy("value").agg(F.max_by("c", "m").alias("top"), (F.min("c") != F.max("c")).alias("more")).where("more").select("value", "top")
    return own.join(whole, "value").withColumn("stray", F.col("c") != F.col("top")).drop("top")


def whole_lists(now: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """value, v, n, rank, cap: the members of the lists under the rarest shingles of their whole sets.

    Similar sets of n and m shingles share at least percent (n + m) / (100 + percent) of them, and m isn't below the smallest size in
    a member's lists.  Of two sets in one order, so many from the front that fewer than these are left can't all differ.  The larger the partner,
    the shorter this front: cap is the largest size for which a place counts."""
    least = now.groupBy("value").agg(F.min("n").alias("least"))
    members = (now.join(least, "value").groupBy("v").agg(F.max("n").alias("n"), F.max("rank").alias("rank"), F.min("least").alias("least"))
               .withColumn("m", F.greatest("least", F.expr(f"({percent} * n + 99) div 100")))
               .withColumn("front", F.expr(f"n - ({percent} * (n + m) + {99 + percent}) div {100 + percent} + 1")).select("v", "n", "rank", "front"))
    shingles = stage(sets.join(members, "v").select("v", "n", "rank", "front", F.explode("members").alias("value")), "shingles")
    common = shingles.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = Window.partitionBy("v")
    return (shingles.join(common, "value")
            .withColumn("place", F.row_number().over(own.orderBy("df", "value")) + F.col("n") - F.count(F.lit(1)).over(own))
            .where("place <= front").select("value", "v", "n", "rank", F.expr(f"({100 + percent} * (n - place + 1)) div {percent} - n").alias("cap")))


def keep(docs: DataFrame, **how) -> DataFrame:
    """One document of each group - the smallest id's - with all columns."""
    first = mark(docs, **how).where("kept").select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("__id")).distinct()
    return docs.withColumn("__of", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))).join(first, F.col("__of") == F.col("__id"), "left_semi").drop("__of")
