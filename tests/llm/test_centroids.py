"""k-means over blocks against a plain version in Python's integers."""
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm import centroids as C

from .helpers import CLASHES, key

TABLE = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], TABLE).withColumns({c: F.lit("x") for c in (*CLASHES, "cluster", "v", "curve", "lo", "hi", "sums", "x")})


def plain(rows, k=C.K, rounds=C.ROUNDS):
    kept = [(i, tuple(math.floor(1024 * float(np.float32(x))) for x in v)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centers = [v for _, v in first]

    def of(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        own = [of(v)[1] for _, v in kept]
        centers = [tuple(sum(x) // len(mine) for x in zip(*mine)) if (mine := [v for (_, v), o in zip(kept, own) if o == j]) else c for j, c in enumerate(centers)]
    last = [of(v) for _, v in kept]
    return [(i, j, d, sum(e for e, o in last if o == j), sum(e for e, _ in last), hashlib.sha256(",".join(map(str, centers[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last)]


def near(r, centers, spread):
    return [x + r.gauss(0, spread) for x in r.choice(centers)]


@pytest.mark.parametrize("case", ["odd", "few", "equal", "apart"])
def test_equals_a_plain_version(spark, case):
    r = random.Random(case)
    centers = [[r.gauss(0, 0.3) for _ in range(64)] for _ in range(9)]
    if case == "odd":
        rows = [(i, near(r, centers, 0.2)) for i in range(300)]
        rows += [(0, rows[0][1]), (0, rows[1][1]), (None, rows[2][1]), (None, near(r, centers, 1)), (400, None), (401, []), (402, [0.5] * 63), (403, [0.5] * 65), (404, [0.0] * 64),
                 (405, [float("nan"), *[0.0] * 63]), (406, [float("inf"), *[0.0] * 63]), (407, [None, *[0.0] * 63]), (408, [-0.0001] * 64), (-5, [1000.0, -1000.0] * 32)]
    elif case == "few":
        rows = [(i, near(r, centers, 0.2)) for i in range(3)]
    elif case == "equal":  # one vector, very often: empty clusters and ties
        rows = [(i, centers[0]) for i in range(600)] + [(1000 + i, c) for i, c in enumerate(centers[:3])]
    else:
        rows = [(i, near(r, centers, 0.001)) for i in range(900)]
    got = C.mark(table(spark, rows))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows), key=key)


def test_none_and_too_wide(spark):
    assert C.mark(table(spark, [])).count() == 0
    assert C.mark(table(spark, [(1, None), (2, [0.5])])).count() == 0
    with pytest.raises(Exception, match="vec_id 7 has a component"):
        C.mark(table(spark, [(7, [2e5] * 64)])).count()


@pytest.mark.parametrize("n,bits", [(2, 1), (2, 4), (3, 3), (4, 2)])
def test_the_curve_goes_by_single_steps(n, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), axis=-1).reshape(-1, n)
    codes = [bytes(c) for c in C.hilbert(points, bits)]
    assert len(set(codes)) == len(points)
    path = points[np.argsort(codes)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_boxes_leave_out_only_what_is_farther():
    r = np.random.default_rng(5)
    pruned = 0
    for k in range(300):
        c = r.integers(-50, 50, (6, 3)) if k % 2 else r.integers(-2, 3, (6, 3))
        v = r.integers(-60, 60, 3) + r.integers(-3, 4, (20, 3))
        which = C.candidates(v.min(0), v.max(0), c)
        all_of, distance = C.nearest(v, c, np.arange(6))
        assert set(all_of.tolist()) <= set(which.tolist())
        some, again = C.nearest(v, c, which)
        assert (some == all_of).all() and (again == distance).all()
        pruned += 6 - len(which)
    assert pruned > 600


def test_blocks_of_clusters_that_lie_apart_have_one_candidate(spark):
    r = random.Random(1)
    centers = [[r.choice((-1.0, 1.0)) for _ in range(64)] for _ in range(8)]
    rows = [(i, near(r, centers, 0.005)) for i in range(2000)]
    own = C.vectors(table(spark, rows))
    staged = C.blocks(own, size=32).collect()
    c = np.array([[int(1024 * x) for x in center] for center in centers])
    n = [len(C.candidates(np.frombuffer(b["lo"], "<i8"), np.frombuffer(b["hi"], "<i8"), c)) for b in staged]
    assert sum(len(b["vec_ids"]) for b in staged) == 2000 and np.mean(np.array(n) == 1) > 0.8  # all but those between two clusters
