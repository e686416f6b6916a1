"""Centroid clustering: Lloyd's rounds over integer vectors, with Exponion search.

Each vector keeps an upper bound of the distance to its centroid and a lower bound of that to any
other one. Where these, moved by how far the centroids went, still tell that its centroid is the
nearest, no distance is computed. Else only the centroids inside a ball around its own one are
scanned: a radius of twice the upper bound, and the gap to the next centroid, holds the nearest and
the second one. The lists of centroids by their distance from each one are sorted once a round, and
a ball is a prefix of a list, taken up to the next power of two. Radius and bounds are inclusive
and rounded outwards, and distances are compared as exact integers, so ties go to the smaller number.

Vectors stay with their bounds in a table that each round reads and writes again; only the
centroids, and sums by centroid, pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_path, workspace, written

CENTROIDS, ROUNDS, WIDTH, SCALE = 40, 5, 64, 256
#: Relative and absolute slack of a bound: more than the rounding of a few double operations.
SLACK, LEAST = 1e-12, 1e-9


def _up(x):
    return x * (1 + SLACK) + LEAST


def _down(x):
    return x * (1 - SLACK) - LEAST


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to those of ``c`` (integers)."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 8 * x.shape[1] * most * most < 1 << 53:  # every product and sum is an integer that a double holds
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1) if len(c) else np.zeros((len(x), 0), np.int64)


class Ball:
    """Centroids, the gaps between them, and each one's others in the order of their gaps."""

    def __init__(self, centroids: np.ndarray):
        self.centroids, self.k = centroids, len(centroids)
        between = squared(centroids, centroids)
        self.order = np.argsort(between, axis=1, kind="stable")
        self.gaps = np.sqrt(np.take_along_axis(between, self.order, 1).astype(np.float64))
        alone = np.sqrt(between.astype(np.float64))
        np.fill_diagonal(alone, np.inf)
        self.nearest = alone.min(1)

    def own_distance(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        return ((x - self.centroids[cluster]) ** 2).sum(1)

    def _scan(self, x: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest of these centroids (ties: the smaller number), its upper bound, and a lower bound of the next."""
        d = squared(x, self.centroids[among])
        best = d.min(1)
        cluster = np.where(d == best[:, None], among, self.k).min(1)
        d[among == cluster[:, None]] = np.iinfo(np.int64).max
        second = np.sqrt(d.min(1).astype(np.float64)) if len(among) > 1 else np.full(len(x), np.inf)
        return cluster, _up(np.sqrt(best.astype(np.float64))), _down(second)

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self._scan(x, np.arange(self.k))

    def search(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Bring the three arrays up to date, in place; returns how many distances were computed."""
        half = _down(self.nearest / 2)
        open_ = np.flatnonzero(upper >= np.maximum(lower, half[cluster]))
        upper[open_] = _up(np.sqrt(self.own_distance(x[open_], cluster[open_]).astype(np.float64)))
        computed = len(open_)
        open_ = open_[upper[open_] >= np.maximum(lower[open_], half[cluster[open_]])]
        open_ = open_[np.argsort(cluster[open_], kind="stable")]
        for rows in np.split(open_, np.flatnonzero(np.diff(cluster[open_])) + 1):
            if not len(rows):
                continue
            own = int(cluster[rows[0]])
            inside = np.searchsorted(self.gaps[own], _up(2 * upper[rows] + self.nearest[own]), side="right")
            level = np.ceil(np.log2(np.maximum(inside, 1))).astype(np.int64)
            for n in np.unique(level):
                some = rows[level == n]
                among = self.order[own, : min(self.k, 1 << int(n))]
                cluster[some], upper[some], lower[some] = self._scan(x[some], among)
                computed += len(some) * len(among)
        return computed


def moved_bounds(cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bounds after the centroids went from ``old`` to ``new``."""
    went = _up(np.sqrt(((old - new) ** 2).sum(1).astype(np.float64)))
    farthest = np.argsort(-went, kind="stable")
    others = np.full(len(went), went[farthest[0]])
    others[farthest[0]] = went[farthest[1]] if len(went) > 1 else 0.0
    return _up(upper + went[cluster]), _down(lower - others[cluster])


def quantised(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as integers whose squared distances fit 64 bits; larger ones are an error."""
    whole = np.floor(scale * values)
    if 4 * values.shape[-1] * float(np.abs(whole).max(initial=0)) ** 2 >= 1 << 62:
        raise ValueError("components are too large for squared distances of 64 bits")
    return whole.astype(np.int64)


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _state(ids, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, names: list[str]):
    import pyarrow as pa

    lists = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([ids, lists, pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower)], names=names)


def start(vectors: DataFrame, vec_id: str, vector: str, k: int, width: int, scale: int, seed: int) -> np.ndarray:
    """The ``k`` kept vectors of the smallest sha256 of ``seed:id``; repeated ids by their vectors, null ids last."""
    values = F.col(vector).cast("array<double>")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(vec_id).cast("string")), 256)
    kept = vectors.where(F.size(vector) == width).where(finite).select(hashed.alias("h"), values.alias("v"))
    rows = kept.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()  # k rows
    return quantised(np.array([r.v for r in rows], np.float64).reshape(-1, width), scale)


def _sums(state: DataFrame, k: int, width: int) -> np.ndarray:
    """For each centroid its vectors' components summed, and their number, as Python integers."""

    def partial(batches) -> Iterator:
        import pyarrow as pa

        found = np.zeros((k, width + 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            cluster, x = batch.column(0).to_numpy(), _matrix(batch.column(1), width)
            order = np.argsort(cluster, kind="stable")
            first = np.flatnonzero(np.diff(cluster[order], prepend=-1))
            found[cluster[order][first], :width] += np.add.reduceat(x[order], first, axis=0)
            found[:, width] += np.bincount(cluster, minlength=k)
        held = np.flatnonzero(found[:, width])
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(list(found[held]), pa.list_(pa.int64()))], names=["cluster", "sums"])

    parts = state.select("cluster", "v").mapInArrow(partial, "cluster int, sums array<bigint>")
    each = parts.select("cluster", F.posexplode("sums").alias("at", "x"))
    rows = each.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("x")).collect()  # k * (width + 1) rows
    sums = np.zeros((k, width + 1), object)
    for r in rows:
        sums[r.cluster, r.at] = int(r.x)
    return sums


def next_centroids(old: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """floor(sum / number) of every component; centroids without vectors stay."""
    new = old.copy()
    for j, row in enumerate(sums):
        if row[-1]:
            new[j] = [x // row[-1] for x in row[:-1]]
    return new


def exponion(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = 2
) -> tuple[DataFrame, np.ndarray]:
    """Cluster the vectors of exactly ``width`` finite components: (id, cluster, distance) of each, and the centroids.

    Others (null, of other width, with a null or non-finite component) have no row. Components are
    floor(scale * x); where these are too large for squared distances of 64 bits the job fails.
    Centroids start as ``start`` says, fewer than ``k`` where fewer vectors are kept. Repeated rows
    and ids are vectors like others, and a null id stays null. Other columns are not read. An empty
    table gives no rows and no centroids.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[vec_id].dataType.simpleString()
    path, names = workspace(spark, "clusters"), ["id", "v", "cluster", "upper", "lower"]
    schema = f"id {id_type}, v array<bigint>, cluster int, upper double, lower double"
    centroids = start(vectors, vec_id, vector, k, width, scale, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"id {id_type}, cluster int, distance bigint"), centroids

    def begun(batches) -> Iterator:
        import pyarrow.compute as pc

        ball = Ball(centroids)
        for batch in batches:
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), width), False))
            values = _matrix(batch.column(1), width).astype(np.float64)  # nulls are NaN
            finite = np.isfinite(values).all(1)
            if finite.any():
                x = quantised(values[finite], scale)
                yield _state(batch.column(0).filter(finite), x, *ball.first(x), names)

    source = vectors.select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    state = written(source.mapInArrow(begun, schema), f"{path}/round-0")
    for n in range(1, rounds + 1):
        old, centroids = centroids, next_centroids(centroids, _sums(state, len(centroids), width))
        if (old == centroids).all():
            break  # no vector can change its centroid any more
        if n < rounds:
            state = written(state.mapInArrow(_again(old, centroids, width, names), schema), f"{path}/round-{n}")
            delete_path(spark, f"{path}/round-{n - 1}")

    def ended(batches, old=old, new=centroids) -> Iterator:
        import pyarrow as pa

        ball = Ball(new)
        for batch in batches:
            ids, x, cluster, upper, lower = _read(batch, width)
            if len(x):
                upper, lower = moved_bounds(cluster, upper, lower, old, new)
                ball.search(x, cluster, upper, lower)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(ball.own_distance(x, cluster))], names=["id", "cluster", "distance"])

    done = written(state.mapInArrow(ended, f"id {id_type}, cluster int, distance bigint"), f"{path}/done", small=True)
    return done, centroids


def _read(batch, width: int):
    cluster, upper, lower = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
    return batch.column(0), _matrix(batch.column(1), width), cluster.astype(np.int64), upper.copy(), lower.copy()


def _again(old: np.ndarray, new: np.ndarray, width: int, names: list[str]):
    def step(batches) -> Iterator:
        ball = Ball(new)
        for batch in batches:
            ids, x, cluster, upper, lower = _read(batch, width)
            if len(x):
                upper, lower = moved_bounds(cluster, upper, lower, old, new)
                ball.search(x, cluster, upper, lower)
                yield _state(ids, x, cluster, upper, lower, names)

    return step


def op11_clustering(vectors: DataFrame) -> DataFrame:
    """The contract's columns of ``exponion``."""
    placed, centroids = exponion(vectors)
    totals = {r.cluster: int(r.x) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("x")).collect()}  # a row for each centroid
    inertia = sum(totals.values())
    told = [(j, totals[j], inertia, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for j, row in enumerate(centroids.tolist()) if j in totals]
    named = placed.sparkSession.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return placed.join(F.broadcast(named), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH}
),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, e) - 1 AS cluster, v
  FROM (SELECT sha256('2:' || k.vec_id) AS h, k.v, k.v AS e FROM kept k) QUALIFY row_number() OVER (ORDER BY h NULLS LAST, e) <= {CENTROIDS}
)"""
    ]
    for n in range(ROUNDS + 1):
        parts.append(f"""a{n} AS MATERIALIZED (
  SELECT r, min({{'d': list_sum(list_transform(list_zip(kept.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'c': c.cluster}}) AS x
  FROM kept, c{n} c GROUP BY r
)""")
        if n < ROUNDS:
            parts.append(f"""c{n + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN (
    SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS v FROM (
      SELECT x.c AS cluster, pos, sum(e)::HUGEINT AS s, count(*)::HUGEINT AS n
      FROM (SELECT x, unnest(v) AS e, generate_subscripts(v, 1) AS pos FROM a{n} JOIN kept USING (r)) GROUP BY ALL
    ) GROUP BY cluster
  ) m USING (cluster)
)""")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, x.c::INTEGER AS cluster, x.d AS distance, sum(x.d) OVER (PARTITION BY x.c)::BIGINT AS cluster_inertia, sum(x.d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN kept USING (r) JOIN c{ROUNDS} c ON c.cluster = x.c
"""


OP11_SQL = _sql()
