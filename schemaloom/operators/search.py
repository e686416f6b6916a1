"""Top-k similarity join of source vectors with target vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from schemaloom.functions.embed import Embedder, embedded
from schemaloom.functions.scratch import workspace, written
from schemaloom.functions.vectors import cosine, l2_normalise

#: Bytes of target vectors that one broadcast may hold; more are met block by block.
MAX_BROADCAST = 256 * 1024 * 1024
#: Queries, and targets, that one product covers where targets stream.
BLOCK_ROWS, TILE_ROWS = 512, 8192
#: Targets that one product of matrices covers; 256 queries by so many are 32 MB.
TILE = 16_384


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.full_like(rows, np.nan), where=length > 0)


def _best(q: np.ndarray, t: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, threshold: float | None, skip_self: bool):
    """(query row, target id, similarity) of each query's k best targets; ties go to the smaller id."""
    if len(t) > TILE:  # a product of bounded size at a time, and the best so far
        parts = [_best(q, t[i : i + TILE], ids[i : i + TILE], own, k, threshold, skip_self) for i in range(0, len(t), TILE)]
        return _best_of(parts, k)
    scores = np.round(q @ t.T, 12)
    scores[np.isnan(scores)] = -np.inf
    if skip_self:
        scores[own[:, None] == ids[None, :]] = -np.inf
    if threshold is not None:
        scores[scores < threshold] = -np.inf
    if k < scores.shape[1]:
        # everything that ties with the k-th best is a candidate
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        rows, columns = np.nonzero((scores >= kth) & np.isfinite(scores))
    else:
        rows, columns = np.nonzero(np.isfinite(scores))
    values = scores[rows, columns]
    order = np.lexsort((ids[columns], -values, rows))
    rows, columns, values = rows[order], columns[order], values[order]
    keep = _rank(rows) < k
    return rows[keep], ids[columns[keep]], values[keep]


def _rank(rows: np.ndarray) -> np.ndarray:
    """The place of each element among its equals, which lie together."""
    first = np.r_[0, np.flatnonzero(np.diff(rows)) + 1] if len(rows) else np.zeros(0, np.int64)
    return np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))


def _best_of(parts: list[tuple], k: int) -> tuple:
    """The k best of each query's results against several sets of targets."""
    rows, ids, values = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((ids, -values, rows))
    rows, ids, values = rows[order], ids[order], values[order]
    keep = _rank(rows) < k
    return rows[keep], ids[keep], values[keep]


def _matrix(batch, column: int) -> np.ndarray:
    lists = batch.column(column)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


_FOUND = "source_id bigint, target_id bigint, similarity double"


def _arrow(own: np.ndarray, rows: np.ndarray, ids: np.ndarray, values: np.ndarray):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(own[rows]), pa.array(ids), pa.array(values)], names=["source_id", "target_id", "similarity"])


def _usable(rows: DataFrame, id_: str, vector: str) -> DataFrame:
    own = F.col(vector).cast("array<double>")
    return rows.select(F.col(id_).cast("bigint").alias("id"), own.alias("v")).where(F.col("id").isNotNull() & own.isNotNull() & (F.size(own) > 0))


def _by_matrix(queries: DataFrame, targets: DataFrame, k: int, threshold: float | None, skip_self: bool) -> DataFrame:
    """One broadcast matrix of all targets, whose size the caller has checked."""
    table = targets.toArrow().combine_chunks()
    ids = table.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    shared = queries.sparkSession.sparkContext.broadcast((ids[order], _unit(flat.reshape(len(ids), -1).astype(np.float64)[order]) if len(ids) else None))

    def search(batches) -> Iterator:
        ids, matrix = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                if matrix is not None:
                    own = some.column(0).to_numpy()
                    yield _arrow(own, *_best(_unit(_matrix(some, 1)), matrix, ids, own, k, threshold, skip_self))

    return queries.mapInArrow(search, _FOUND)


def _by_blocks(queries: DataFrame, targets: DataFrame, k: int, threshold: float | None, skip_self: bool) -> DataFrame:
    """Blocks of queries, each of at most MAX_BROADCAST bytes, against the targets as they stream through the tasks.

    A task holds one block of queries, a tile of targets and the k best so far of each query, so it
    gives k rows a query, whatever the number of targets.
    """
    found = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    n = max(1, -(-found.n * (found.width or 0) * 8 // MAX_BROADCAST))
    return reduce(DataFrame.unionByName, [_streamed(queries if n == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(n)) == i), targets, k, threshold, skip_self) for i in range(n)])


def _streamed(queries: DataFrame, targets: DataFrame, k: int, threshold: float | None, skip_self: bool) -> DataFrame:
    table = queries.toArrow().combine_chunks()
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    own = table.column("id").to_numpy()
    shared = queries.sparkSession.sparkContext.broadcast((own, _unit(flat.reshape(len(own), -1).astype(np.float64)) if len(own) else None))

    def search(batches) -> Iterator:
        own, q = shared.value
        if q is None:
            return
        best: list[tuple | None] = [None] * -(-len(own) // BLOCK_ROWS)
        for ids, t in _tiles(batches):
            for at in range(len(best)):
                rows = slice(at * BLOCK_ROWS, (at + 1) * BLOCK_ROWS)
                found = _best(q[rows], t, ids, own[rows], k, threshold, skip_self)
                best[at] = found if best[at] is None else _best_of([best[at], found], k)
        for at, found in enumerate(best):
            if found is not None:
                yield _arrow(own[at * BLOCK_ROWS : (at + 1) * BLOCK_ROWS], *found)

    return targets.mapInArrow(search, _FOUND)


def _tiles(batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids and unit vectors of a task's targets, up to TILE_ROWS at a time."""
    held, n = [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, TILE_ROWS):
            some = batch.slice(i, TILE_ROWS)
            held.append((some.column(0).to_numpy().astype(np.int64), _unit(_matrix(some, 1))))
            n += some.num_rows
            if n >= TILE_ROWS:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _by_hashing(queries: DataFrame, targets: DataFrame, threshold: float | None, skip_self: bool, tables: int, bucket: float) -> DataFrame:
    """Approximate: random projections of unit vectors meet in buckets; cosine is exact for the pairs that meet."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    width = targets.select(F.size("v").alias("n")).first()
    nothing = F.array_repeat(F.lit(0.0), width.n if width else 1)  # Spark may evaluate this before it drops null vectors
    unit = lambda d: d.select("id", array_to_vector(F.coalesce(l2_normalise(F.col("v")), nothing)).alias("unit"))
    t = unit(targets)
    model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=1).fit(t)
    furthest = float(np.sqrt(max(0.0, 2 - 2 * (threshold if threshold is not None else -1.0)))) + 1e-9
    met = model.approxSimilarityJoin(unit(queries), t, furthest, "distance")
    similarity = cosine(vector_to_array("datasetA.unit"), vector_to_array("datasetB.unit"))
    found = met.select(F.col("datasetA.id").alias("source_id"), F.col("datasetB.id").alias("target_id"), similarity.alias("similarity"))
    return found.where(F.col("source_id") != F.col("target_id")) if skip_self else found


def top_k(
    queries: DataFrame,
    targets: DataFrame,
    k: int = 10,
    threshold: float | None = None,
    id_: str = "id",
    vector: str = "vector",
    skip_self: bool = False,
    strategy: str = "auto",
    tables: int = 8,
    bucket: float = 0.5,
) -> DataFrame:
    """The ``k`` most similar targets of every query: source_id, target_id, similarity, rk.

    Similarity is the cosine in double precision; ``threshold`` is inclusive. Equal similarities
    rank by target id. Rows without id or vector, and zero vectors, match nothing. ``matrix`` and
    ``blocks`` are exact; ``auto`` takes the matrix while the targets fit one broadcast of a
    checked size; ``lsh`` is approximate and for thresholds near 1.
    """
    q, t = _usable(queries, id_, vector), _usable(targets, id_, vector)
    if strategy == "auto":
        found = t.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
        strategy = "matrix" if found.n * (found.width or 0) * 8 <= MAX_BROADCAST else "blocks"
    if strategy == "matrix":
        best = _by_matrix(q, t, k, threshold, skip_self)
    elif strategy == "blocks":
        best = _by_blocks(q, t, k, threshold, skip_self)
    elif strategy == "lsh":
        best = _by_hashing(q, t, threshold, skip_self, tables, bucket)
    else:
        raise ValueError(f"no strategy {strategy}")
    order = Window.partitionBy("source_id").orderBy(F.desc("similarity"), "target_id")
    return best.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)


def top_k_texts(
    queries: DataFrame,
    targets: DataFrame,
    embedder: Embedder,
    k: int = 10,
    threshold: float | None = None,
    id_: str = "id",
    text: str = "text",
    skip_self: bool = False,
    strategy: str = "auto",
) -> DataFrame:
    """``top_k`` of texts by an embedder's vectors, with each distinct text embedded and searched once.

    Copies of a text have one vector, so the best targets of a query are among the smallest ids of the
    best texts. The texts are ordered by their smallest id, which keeps the order of ties; the rows are
    those of ``top_k`` over all pairs, and the work grows with the pairs of distinct texts. A null text
    is the empty one. A query that is given twice has its rows twice.
    """
    q, t = (d.select(F.col(id_).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("id IS NOT NULL") for d in (queries, targets))
    most = k + 1 if skip_self else k
    asked = q.select("text").distinct().select("text", F.lit(None).cast("bigint").alias("first"), F.lit(True).alias("asked"))
    known = t.groupBy("text").agg(F.min("id").alias("first")).select("text", "first", F.lit(False).alias("asked"))
    each = asked.unionByName(known).groupBy("text").agg(F.min("first").alias("first"), F.max("asked").alias("asked"))
    path = workspace(q.sparkSession, "texts")
    numbered = written(each.orderBy("first", "text").select(F.monotonically_increasing_id().alias("kind"), "*"), f"{path}/texts")  # numbers in the order of the smallest ids
    n = max(int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")), q.sparkSession.sparkContext.defaultParallelism)
    kinds = written(numbered.repartition(n, "kind").withColumn("vector", embedded(F.col("text"), embedder)), f"{path}/vectors")
    best = top_k(kinds.where("asked"), kinds.where("first IS NOT NULL"), most, threshold, id_="kind", strategy=strategy)
    names = numbered.select("kind", "text")
    place = F.row_number().over(Window.partitionBy("text").orderBy("id"))
    members = t.withColumn("place", place).where(F.col("place") <= most).join(names, "text").select(F.col("kind").alias("target_id"), F.col("id").alias("member"))
    pairs = best.join(members, "target_id").select("source_id", "similarity", "member")
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("similarity"), "member"))
    pairs = pairs.withColumn("place", place).where(F.col("place") <= most)
    listed = pairs.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("place", "member", "similarity"))).alias("best"))
    listed = listed.join(names, listed["source_id"] == names["kind"]).select("text", "best")
    found = q.join(listed, "text").select(F.col("id").alias("source_id"), "best")
    left = F.filter("best", lambda x: x["member"] != F.col("source_id")) if skip_self else F.col("best")
    one = found.select("source_id", F.posexplode(F.slice(left, 1, k)).alias("at", "b"))
    return one.select("source_id", F.col("b.member").alias("target_id"), F.col("b.similarity").alias("similarity"), (F.col("at") + 1).alias("rk"))
