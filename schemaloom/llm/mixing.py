"""Mixing sources to target weights by balanced sampling: the cube method.

A source's target divided by its size is how often each of its documents is taken on average. Whole
takes are given to every document; the fraction left is an inclusion probability, equal for all
documents of the source. The flight moves probabilities, three documents at a time, along the
null space of two constraints, the number of documents and the sum of their sizes, until one of the
three is certain: so both totals of a source never change. A block of documents is left with at
most two that are undecided. Those of many blocks are flown again, and so on until a source is one
block; the landing decides its last two by the cheaper of the two designs that keep their probabilities.

Rows are dealt to blocks by hashes of their content, and the chances are hashes too, so the same
rows give the same mix however they are partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WS_CLASS, null_safe_join, workspace, written

#: Weights of the sources in their order, repeating, and the most that a source may be repeated.
WEIGHTS, MOST = (5, 2, 1), 3
#: Documents of one block on average, and how many blocks meet in one of the next level.
BLOCK, FAN_IN = 1 << 12, 1 << 10
#: Equal rows that are numbered at once.
CHUNK = 1 << 16
#: Sources (and bytes of their names) that may be broadcast; beyond that the join is shuffled.
MAX_BROADCAST, MAX_BROADCAST_BYTES = 100_000, 16 << 20


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, h (the text's hash) and size, the number of words; a null text has none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_count(text, F.lit(f"[^{WS_CLASS[1:]}+"))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("h"), words.cast("long").alias("size"))


def _ranked(rows: DataFrame, path: str) -> DataFrame:
    """source, source_size, documents and weight: the weights repeat over the sources by code point, null last."""
    order = F.col("source").asc_nulls_last()
    totals = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("documents"))
    ordered = totals.repartitionByRange(order).sortWithinPartitions(order)
    placed = written(ordered.withColumns({"part": F.spark_partition_id(), "inside": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), f"{path}/ordered")
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")  # a row for each partition of sources
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", before.alias("before"))
    rank = F.col("before") + F.col("inside")
    weights = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(rank, F.lit(len(WEIGHTS))) + 1).cast("int"))
    return placed.join(parts, "part").select("source", "source_size", "documents", weights.alias("weight"))


def targets(rows: DataFrame, path: str) -> DataFrame:
    """source, source_size, documents and target: shares of all sizes by weight, none above ``MOST`` times its source.

    ``rows`` has source, size and n, how many documents a row stands for. What a target exceeds its
    bound by is shared anew, by weight, among the others, until none is above.
    """
    ranked = written(_ranked(rows, path), f"{path}/ranked", small=True)
    most = F.lit(MOST) * F.col("source_size")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    share, capped = 0.0, -1
    while True:
        full = (F.lit(share) * F.col("weight") >= most) if capped >= 0 else F.lit(False)
        n, held, weight = ranked.agg(F.count_if(full), F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped or not weight:
            break
        share, capped = (total - (held or 0)) / weight, n
    return ranked.select("source", "source_size", "documents", F.least(most.cast("double"), F.lit(share) * F.col("weight")).alias("target"))


def _chances(at: np.ndarray, level: int) -> np.ndarray:
    """Two numbers of [0, 1) for each row, by its hash."""
    out = np.empty((len(at), 2))
    with np.errstate(over="ignore"):
        for n in range(2):
            x = at.astype(np.uint64) + np.uint64((2 * level + n + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out[:, n] = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
    return out


class Flight:
    """Units of one source, taken in one after another; between them at most two are undecided."""

    def __init__(self) -> None:
        self.open: list[list] = []  # [row, size, p]

    def _direction(self) -> tuple[int, ...] | None:
        """A direction that keeps the sum of p and that of p * size, if the open units have one."""
        z = [u[1] for u in self.open]
        if len(z) == 3:
            u = (z[1] - z[2], z[2] - z[0], z[0] - z[1])
            return u if any(u) else (1, -1, 0)
        return (1, -1) if len(z) == 2 and z[0] == z[1] else None

    def add(self, row, size: int, p: float, chances) -> Iterator[tuple]:
        """Yields (row, 0.0 or 1.0) of every unit that is decided by taking this one in."""
        if not 0.0 < p < 1.0:
            yield row, p
            return
        self.open.append([row, size, p])
        n = 0
        while (u := self._direction()) is not None:
            forth = [(1.0 - x[2]) / d if d > 0 else x[2] / -d if d else np.inf for x, d in zip(self.open, u, strict=True)]
            back = [x[2] / d if d > 0 else (1.0 - x[2]) / -d if d else np.inf for x, d in zip(self.open, u, strict=True)]
            a, b = min(forth), min(back)
            sign, room, step = (1, forth, a) if chances[min(n, 1)] * (a + b) < b else (-1, back, b)
            n += 1
            for x, d, r in zip(self.open, u, room, strict=True):
                if r == step:
                    x[2] = 1.0 if d * sign > 0 else 0.0
                elif d:
                    x[2] = min(1.0, max(0.0, x[2] + sign * step * d))
            yield from ((x[0], x[2]) for x in self.open if x[2] in (0.0, 1.0))
            self.open = [x for x in self.open if 0.0 < x[2] < 1.0]

    def rest(self) -> list[tuple]:
        """The undecided units with their probabilities, for another flight."""
        out, self.open = [(x[0], x[2]) for x in self.open], []
        return out

    def land(self, chance: float) -> list[tuple]:
        """Decides the undecided units with their probabilities: of two, together or apart, whichever is expected to miss the size by less."""
        units, self.open = self.open, []
        if len(units) < 2:
            return [(row, float(chance < p)) for row, _, p in units]
        (one, y, p), (other, z, q) = units

        def miss(both: float) -> float:
            cases = ((both, y + z), (p - both, y), (q - both, z), (1 - p - q + both, 0))
            return sum(w * (size - p * y - q * z) ** 2 for w, size in cases)

        both = min(max(0.0, p + q - 1), min(p, q), key=miss)
        return [(one, float(chance < p)), (other, float(chance < both or p <= chance < p + q - both))]


def _flown(level: int, columns: list[str]):
    """Flies the blocks of its partition, which is sorted by them, and lands sources of one block."""
    source, size, at, blocks, block, p = (columns.index(c) for c in ("source", "size", "at", "blocks", "block", "p"))

    def fly(batches) -> Iterator:
        import pyarrow as pa

        flight, now, whole, chance, schema = Flight(), None, False, 0.0, None

        def ended():
            return flight.land(chance) if whole else flight.rest()

        def batch_of(done):
            values = zip(*[(*row[:p], value, *row[p + 1 :]) for row, value in done], strict=True)
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for batch in batches:
            schema, done = batch.schema, []
            chances = _chances(batch.column(at).to_numpy(), level)
            for row, own in zip(zip(*[c.to_pylist() for c in batch.columns], strict=True), chances, strict=True):
                if now != (row[source], row[block]):
                    done += ended()
                    now, whole = (row[source], row[block]), row[blocks] == 1
                done += flight.add(row, row[size], row[p], own)
                chance = own[1]
            if done:
                yield batch_of(done)
        if last := ended():
            yield batch_of(last)

    return fly


def mix(docs: DataFrame) -> DataFrame:
    """How often the mix takes each row of ``docs``: doc_id, source, h, size, source_size, target and takes.

    A document's size is the number of its words (null text: none); a null source is one like others and comes
    last. A row is taken at most ``MOST`` times. Documents without words count as documents of their
    source. Rows that are equal in doc_id, source and text are documents like others, and told apart
    by a number; a null doc_id stays null. Other columns are not read. An empty table gives no rows,
    and where no document has a word nothing is aimed at and nothing taken.
    """
    spark = docs.sparkSession
    path = workspace(spark, "mix")
    keys = ["doc_id", "source", "h", "size"]
    sized = written(sizes(docs).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), f"{path}/sizes", small=True)  # the texts are read once
    aims = written(targets(sized, path), f"{path}/targets", small=True)
    few, longest, most = aims.agg(F.count(F.lit(1)), F.sum(F.octet_length("source")), F.max("documents")).first()
    known = F.broadcast(aims) if few <= MAX_BROADCAST and (longest or 0) <= MAX_BROADCAST_BYTES else aims
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK)))
    number = F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK) - 1))
    rows = null_safe_join(sized.withColumn("chunk", chunk).withColumn("number", number), known, ["source"], "inner")
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(float(MOST)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    blocks = F.ceil(F.col("documents") / BLOCK)
    at = F.xxhash64("doc_id", "source", "h", "number")
    rows = rows.select(*keys, "source_size", "target", F.floor(ratio).cast("int").alias("base"), (ratio - F.floor(ratio)).alias("p"), at.alias("at"), blocks.alias("blocks"))
    rows, parts, level, most = rows.withColumn("block", F.pmod("at", "blocks")), [], 0, -(-(most or 0) // BLOCK)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    while True:
        dealt = rows.repartition("source", "block").sortWithinPartitions("source", "block", "at", "doc_id", "h")
        flown = written(dealt.mapInArrow(_flown(level, rows.columns), schema), f"{path}/level-{level}", small=True)
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        parts.append(flown.where(~open_))
        if most <= 1:
            break
        level, most = level + 1, -(-most // FAN_IN)
        rows = flown.where(open_).withColumn("blocks", F.ceil(F.col("blocks") / FAN_IN)).withColumn("block", F.pmod("at", "blocks"))
    done = parts[0]
    for part in parts[1:]:
        done = done.unionByName(part)
    return done.select(*keys, "source_size", "target", (F.col("base") + F.col("p").cast("int")).alias("takes"))


def mixture(docs: DataFrame) -> DataFrame:
    """The mix itself: the documents with all their columns, each as often as ``mix`` takes it.

    Rows equal in doc_id, source and text that differ in other columns are taken in the number that
    ``mix`` gives them together, with the columns of any one of them.
    """
    keys = ["__sl_id", "__sl_source", "__sl_h"]
    takes = mix(docs).groupBy(F.col("doc_id").alias(keys[0]), F.col("source").alias(keys[1]), F.col("h").alias(keys[2]))
    takes = takes.agg(F.count(F.lit(1)).alias("__sl_n"), F.sum("takes").alias("__sl_takes")).where("__sl_takes > 0")
    takes = written(takes, workspace(docs.sparkSession, "takes"), small=True)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumns({keys[0]: F.col("doc_id"), keys[1]: F.col("source").cast("string"), keys[2]: F.xxhash64(text)})
    rows = null_safe_join(keyed, takes.where("__sl_n = 1"), keys, "inner")
    repeated = takes.where("__sl_n > 1")
    if not repeated.isEmpty():
        rows = rows.unionByName(null_safe_join(keyed, repeated, keys, "inner").dropDuplicates(keys))
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__sl_takes")))
    return rows.withColumn("__sl_again", again).select(*[F.col(f"`{c}`") for c in docs.columns])


def op12_mixing(docs: DataFrame) -> DataFrame:
    """The contract's columns of ``mix``."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("takes")).alias("taken"))
