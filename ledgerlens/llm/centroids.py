"""k-means in integers over blocks of neighbouring vectors.

Vectors are put in the order of a Hilbert curve through all their dimensions (``BITS`` bits of each, range-partitioned by the curve's number, so that
the order is global) and cut into blocks of ``BLOCK`` vectors, each with the least and greatest value of every component.
In a round, a block's box bounds by how much each centroid is farther than the one nearest to the box's middle.  A centroid that is farther for every
vector the box could hold is left out; where one is left, the whole block is its own and its stored component sums are used, and
otherwise the vectors are compared exactly with those that are left.  All arithmetic is on 64-bit integers, so bounds, distances, ties and sums are exact.

The blocks are written once.  A round sends the centroids (k x dimensions numbers) out with the task and brings back sums per task, centroid
and component, which one aggregation adds up as decimals: k x (dimensions + 1) rows reach the driver, whatever the table's size.
Rounds end early when no centroid has changed, as all later ones would be equal.

Kept are vectors with exactly ``dimensions`` components, none null, NaN or infinite; other rows give no result.  A component x counts as floor(1024 * x).
A vector whose component is 2**27 or more then (distances would not fit a long) ends the job with an error that says so.
Repeated rows count each.  A null vec_id is kept, and hashed as an empty number.  Equal hashes of first centroids go by the vectors.  Equal distances go to the smaller
number.  With fewer kept vectors than ``k``, there are as many centroids; an empty table gives no rows.  Extra columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, stage

DIMENSIONS, K, ROUNDS, SCALE, SEED, BITS, BLOCK, WIDEST = 64, 8, 10, 1024, "3", 2, 256, 1 << 27
CURVE_DDL = "vec_id long, curve binary, v binary"
BLOCKS_DDL = "vec_ids array<long>, v binary, lo binary, hi binary, sums binary"
BLOCKS = pa.schema([("vec_ids", pa.list_(pa.int64())), ("v", pa.binary()), ("lo", pa.binary()), ("hi", pa.binary()), ("sums", pa.binary())])


# --- the curve -------------------------------------------------------------------------------

def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """The numbers of points (n x dimensions, values below 2**bits) along a Hilbert curve, as rows of bytes that compare like the numbers.

    The curve's number is found from the high bits down: wherever a coordinate has the current bit, the lower bits of the first coordinate are
    reflected, and elsewhere they are exchanged with the first one's; a Gray decoding over all bits ends it."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(n):
            has = (x[i] & q) != 0
            swap = np.where(has, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(has, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip = np.where(x[n - 1] & (1 << b), flip ^ ((1 << b) - 1), flip)
    x ^= flip
    planes = [(x >> b & 1).astype(np.uint8) for b in range(bits - 1, -1, -1)]  # all coordinates' highest bits first
    return np.packbits(np.concatenate(planes).T, axis=1)


# --- blocks ----------------------------------------------------------------------------------

def vectors(table: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of long) of the rows that are kept."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    own = table.where(x.isNotNull() & (F.size(x) == dimensions)).where(~bad).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: c.cast("double") * F.lit(float(scale))).alias("x"))
    fits = F.forall(F.col("x"), lambda c: (c >= -float(WIDEST)) & (c < float(WIDEST)))
    error = F.raise_error(F.concat(F.lit("vec_id "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")), F.lit(f" has a component of {WIDEST} or more after scaling")))
    return own.select("vec_id", F.when(fits, F.transform("x", lambda c: F.floor(c))).otherwise(error.cast("array<long>")).alias("v"))


def _curve(dimensions: int, bits: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = np.asarray(batch.column("v").flatten()).reshape(-1, dimensions)
                cells = np.clip(((v - low) << bits) // max(1, high - low + 1), 0, (1 << bits) - 1)
                code = hilbert(cells, bits)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() for r in code], pa.binary()),
                                                  pa.array([r.tobytes() for r in v.astype("<i4")], pa.binary())], ["vec_id", "curve", "v"])
    return run


def _blocks(dimensions: int, size: int):
    def emit(ids: list, rows: list[bytes]) -> pa.RecordBatch:
        data = b"".join(rows)
        v = np.frombuffer(data, "<i4").reshape(-1, dimensions).astype("<i8")
        cells = [[ids], [data], [v.min(0).tobytes()], [v.max(0).tobytes()], [v.sum(0).tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cells, BLOCKS)], schema=BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []
        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            rows += batch.column("v").to_pylist()
            while len(rows) >= size:
                yield emit(ids[:size], rows[:size])
                ids, rows = ids[size:], rows[size:]
        if rows:
            yield emit(ids, rows)
    return run


def blocks(own: DataFrame, dimensions: int = DIMENSIONS, bits: int = BITS, size: int = BLOCK) -> DataFrame:
    """Staged blocks of vectors that follow each other on the curve."""
    span = own.select(F.array_min("v").alias("low"), F.array_max("v").alias("high")).agg(F.min("low"), F.max("high")).first()
    low, high = (span[0], span[1]) if span[0] is not None else (0, 0)
    ordered = short_batches(own).mapInArrow(_curve(dimensions, bits, low, high), CURVE_DDL)
    # the checksum parts vectors of one curve number, so that very many equal ones are not one partition's
    ordered = ordered.repartitionByRange("curve", F.xxhash64("vec_id", "v")).sortWithinPartitions("curve", "vec_id")
    return stage(ordered.select("vec_id", "v").mapInArrow(_blocks(dimensions, size), BLOCKS_DDL), "blocks")


# --- rounds ----------------------------------------------------------------------------------

def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroids that may be nearest to a vector of the box, in their order.

    The squared distance to one centroid less that to another is linear in the vector, so its least value over the box is
    taken at a corner, component by component.  The other one is the centroid nearest to the box's middle."""
    middle = (low + high) // 2
    best = int(((middle - centroids) ** 2).sum(1).argmin())
    apart = centroids - centroids[best]
    corner = np.where(apart > 0, high, low)
    least = (centroids * centroids - centroids[best] * centroids[best] - 2 * corner * apart).sum(1)
    return np.flatnonzero((least < 0) | ((least == 0) & (np.arange(len(centroids)) <= best)))


def nearest(v: np.ndarray, centroids: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector: the nearest of the centroids ``which`` (the first of equal ones), and the squared distance."""
    distance = np.stack([((v - centroids[c]) ** 2).sum(1) for c in which.tolist()])
    first = distance.argmin(0)
    return which[first], distance[first, np.arange(len(v))]


def _block(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(row[k], "<i8") for k in ("lo", "hi", "sums"))


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i].as_py() for n in names}


def _sums(centroids: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, np.int64)
        k, dimensions = c.shape
        total = np.zeros((k, dimensions + 1), np.int64)
        for row in _rows(batches, ["v", "lo", "hi", "sums"]):
            low, high, sums = _block(row)
            which = candidates(low, high, c)
            if len(which) == 1:
                total[which[0], :dimensions] += sums
                total[which[0], dimensions] += len(row["v"]) // (4 * dimensions)
                continue
            v = np.frombuffer(row["v"], "<i4").reshape(-1, dimensions).astype(np.int64)
            own, _ = nearest(v, c, which)
            for j in which.tolist():
                mine = own == j
                total[j, :dimensions] += v[mine].sum(0)
                total[j, dimensions] += mine.sum()
        at, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(place, pa.int32()), pa.array(total[at, place])], ["cluster", "place", "total"])
    return run


def step(staged: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round."""
    found = staged.select("v", "lo", "hi", "sums").mapInArrow(_sums(centroids), "cluster int, place int, total long")
    rows = found.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # k x (dimensions + 1) at most
    total = {(r["cluster"], r["place"]): int(r["total"]) for r in rows}
    d = len(centroids[0])
    return [[total.get((j, i), 0) // total[j, d] for i in range(d)] if total.get((j, d)) else c for j, c in enumerate(centroids)]


def first_centroids(own: DataFrame, k: int = K, seed: str = SEED) -> list[list[int]]:
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [list(r["v"]) for r in own.select("v", key.alias("key")).orderBy("key", "v").limit(k).collect()]


def _assign(centroids: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, np.int64)
        for row in _rows(batches, ["vec_ids", "v", "lo", "hi", "sums"]):
            low, high, _ = _block(row)
            v = np.frombuffer(row["v"], "<i4").reshape(-1, c.shape[1]).astype(np.int64)
            own, distance = nearest(v, c, candidates(low, high, c))
            yield pa.RecordBatch.from_arrays([pa.array(row["vec_ids"], pa.int64()), pa.array(own, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])
    return run


def fit(table: DataFrame, dimensions: int = DIMENSIONS, k: int = K, rounds: int = ROUNDS, seed: str = SEED, scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """The staged blocks and the centroids after the rounds."""
    own = stage(vectors(table, dimensions, scale), "vectors")
    centroids = first_centroids(own, k, seed)
    staged = blocks(own, dimensions)
    for _ in range(rounds if centroids else 0):
        centroids, before = step(staged, centroids), centroids
        if centroids == before:
            break
    return staged, centroids


def assign(staged: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Staged vec_id, cluster and distance of every vector."""
    found = staged.mapInArrow(_assign(centroids), "vec_id long, cluster int, distance long") if centroids else staged.select(
        F.explode("vec_ids").alias("vec_id"), F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
    return stage(found, "assigned")


def mark(table: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    staged, centroids = fit(table, **options)
    own = assign(staged, centroids)
    spread = {r["cluster"]: int(r["s"]) for r in own.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    rows = [(j, spread[j], sum(spread.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids) if j in spread]
    each = table.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return own.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
