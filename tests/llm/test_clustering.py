import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from schemaloom.llm import clustering


def plain(rows, k, rounds, width, scale=256, seed=2):
    """Lloyd's rounds over Python integers: sorted (id, cluster, distance), and the centroids."""
    kept = [(i, [math.floor(scale * float(x)) for x in v], v) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    hashed = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    centroids = [v for _, v, _ in sorted(kept, key=lambda r: (r[0] is None, hashed(r[0]), r[2]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v, _ in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v, _), o in zip(kept, own, strict=True) if o == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return sorted(((i, *nearest(v)[::-1]) for i, v, _ in kept), key=str), centroids


def made(seed, n, width, spread=3.0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, spread, (6, width))
    return [(i, [float(x) for x in middles[i % 6] + rng.normal(0, 0.4, width)]) for i in range(n)]


def found(spark, rows, **kw):
    out, centroids = clustering.exponion(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, id string, v string, cluster string").repartition(3), **kw)
    return sorted(((r.id, r.cluster, r.distance) for r in out.collect()), key=str), centroids.tolist()


def clash(rows):
    return [(i, v, "x", "y", "z") for i, v in rows]


@pytest.mark.parametrize("k, rounds", [(1, 2), (7, 5), (12, 3)])
def test_rows_are_those_of_plain_rounds(spark, k, rounds):
    rows = made(k, 300, 4)
    rows += [(1000 + i, rows[0][1]) for i in range(60)]  # a group of equal vectors
    rows += [(5, rows[7][1]), (None, rows[9][1]), (None, rows[9][1])]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 3), (2003, [1.0, 2.0, None, 3.0]), (2004, [1.0, 2.0, float("nan"), 3.0]), (2005, [1.0, float("inf"), 0.0, 0.0])]
    want, centroids = plain(rows, k, rounds, 4)
    assert found(spark, clash(rows), k=k, rounds=rounds, width=4) == (want, centroids)


def test_ties_go_to_the_smaller_number(spark):
    grid = [(i, [float(i % 4), float(i // 4 % 4), 0.0]) for i in range(64)]  # many points half-way between centroids
    want, centroids = plain(grid, 9, 4, 3, scale=1)
    assert found(spark, clash(grid), k=9, rounds=4, width=3, scale=1) == (want, centroids)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = made(1, 3, 4)
    want, centroids = plain(rows, 40, 5, 4)
    assert found(spark, clash(rows), width=4) == (want, centroids)
    assert found(spark, clash([(1, [1.0])]), width=4) == ([], [])


def test_large_components_are_exact_or_an_error(spark):
    rows = [(i, [float(x * 3_000_017) for x in v]) for i, v in made(2, 60, 4)]
    want, centroids = plain(rows, 5, 3, 4, scale=1)
    assert found(spark, clash(rows), k=5, rounds=3, width=4, scale=1) == (want, centroids)
    with pytest.raises(Exception, match="too large"):
        found(spark, clash([(1, [1e30] * 4)]), width=4)


def test_search_scans_a_part_only_and_bounds_hold():
    rng = np.random.default_rng(4)
    middles = rng.integers(-4000, 4000, (64, 3))
    x = middles[rng.integers(0, 64, 4000)] + rng.integers(-150, 150, (4000, 3))
    ball = clustering.Ball(middles)
    cluster, upper, lower = ball.first(x)
    new = middles + rng.integers(-60, 60, middles.shape)
    upper, lower = clustering.moved_bounds(cluster, upper, lower, middles, new)
    computed = clustering.Ball(new).search(x, cluster, upper, lower)
    d = clustering.squared(x, new)
    assert (cluster == d.argmin(1)).all() and computed < 4000 * 64 / 4
    own = d[np.arange(4000), cluster]
    d[np.arange(4000), cluster] = 1 << 60
    assert (upper**2 >= own).all() and (np.maximum(lower, 0) ** 2 <= d.min(1)).all()


def test_query_gives_sums_and_hashes(spark):
    rows = [(i, [float(x) for x in v]) for i, v in made(3, 120, 64)]
    got = clustering.op11_clustering(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    exact = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").select("vec_id", F.col("embedding").cast("array<double>")).collect()
    want, centroids = plain([(r[0], r[1]) for r in exact], 40, 5, 64)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == want
    for r in got:
        assert r.inertia == sum(w[2] for w in want) and r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()
