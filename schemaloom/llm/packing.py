"""Best-fit packing of whole documents into token sequences.

Best-two-fit: a bin is filled greedily, the largest document that fits first; then its smallest
document is replaced by two unpacked ones that fit the gap, widened by it, more tightly, for as
long as there are such two.

Which lengths go together depends on the number of documents of each length only, and lengths are
at most the capacity. So the driver packs that histogram, of 4096 numbers at any size of the
corpus, into patterns with a multiplicity; a document's place follows from its rank among the
documents of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import workspace, written
from .tokens import encoded_rows

CAPACITY = 4096
END_ID = 1
ROWS_A_BLOCK = 100_000
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class Segment(NamedTuple):
    """Documents of one length at one place of a pattern: ranks from ``first``, ``times`` to a bin."""

    length: int
    first: int
    times: int
    sequence: int
    offset: int


def _two(lengths: np.ndarray, left: np.ndarray, gap: int, more_than: int) -> tuple[int, int] | None:
    """The two lengths (of those left) with the largest sum in (more_than, gap]."""
    small = lengths[(left > 0) & (lengths < gap)]
    if not len(small):
        return None
    at = np.searchsorted(small, gap - small, side="right") - 1
    own = np.arange(len(small))
    single = dict(zip(lengths.tolist(), left.tolist(), strict=True))
    lone = (at == own) & np.array([single[x] < 2 for x in small.tolist()])
    at = np.where(lone, at - 1, at)
    sums = np.where(at >= 0, small + small[np.maximum(at, 0)], -1)
    best = int(np.argmax(sums))
    return (int(small[best]), int(small[at[best]])) if sums[best] > more_than else None


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Segment], int]:
    """Pack ``counts`` documents of each length; returns the segments and the number of sequences."""
    lengths = np.array(sorted(k for k, n in counts.items() if n > 0), dtype=np.int64)
    if len(lengths) and (lengths[0] < 1 or lengths[-1] > capacity):
        raise ValueError("lengths must lie between 1 and the capacity")
    left = np.array([counts[int(k)] for k in lengths], dtype=np.int64)
    place = {int(k): i for i, k in enumerate(lengths)}
    live = [int(k) for k in lengths]
    used = dict.fromkeys(live, 0)
    segments: list[Segment] = []
    sequence = 0
    while live:
        taken: dict[int, int] = {}
        gap = capacity

        def take(length: int, n: int) -> None:
            left[place[length]] -= n
            taken[length] = taken.get(length, 0) + n

        i = len(live)
        while i:
            length = live[i - 1]
            n = min(gap // length, int(left[place[length]])) if taken else min(1, int(left[place[length]]))
            if n:
                take(length, n)
                gap -= n * length
            # the first document may have equals that fit as well
            i = min(i if n and gap >= length and left[place[length]] else i - 1, bisect_right(live, gap))
        while gap and sum(taken.values()) > 1:
            smallest = min(taken)
            two = _two(lengths, left, gap + smallest, smallest)
            if two is None:
                break
            take(smallest, -1)
            if not taken[smallest]:
                del taken[smallest]
            for length in two:
                take(length, 1)
            gap += smallest - sum(two)
        bins = 1 + min(int(left[place[k]]) // n for k, n in taken.items())
        offset = 0
        for length, n in sorted(taken.items(), reverse=True):
            segments.append(Segment(length, used[length], n, sequence, offset))
            used[length] += n * bins
            left[place[length]] -= n * (bins - 1)
            offset += n * length
        sequence += bins
        live = [k for k in live if left[place[k]]] if any(not left[place[k]] for k in taken) else live
    return segments, sequence


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool, special_strings: bool):
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches) -> Iterator:
        import pyarrow as pa

        rows: list[tuple] = []
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids

        def batch():
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for doc_id, ids in encoded_rows(batches, path, special_strings):
            ids += end
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                own = ids[at : at + 4 * capacity]
                rows.append((doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own), own)[: len(names)])
            if len(rows) >= 2000:
                yield batch()
                rows.clear()
        if rows:
            yield batch()

    return cut


def ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``rank``, from 0 within each length: within blocks by a window, blocks by their counts."""
    blocks = max(8, -(-pieces.count() // ROWS_A_BLOCK))
    blocked = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    counts = blocked.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("length", "block", (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32"))
    both = blocked.withColumn("inside", inside).join(before, ["length", "block"])
    return both.withColumn("rank", F.col("before") + F.col("inside") - 1).drop("block", "before", "inside")


def placed(pieces: DataFrame, segments: list[Segment]) -> DataFrame:
    """``pieces`` with sequence_id and offset by their rank; there are a few segments for each length at most."""
    spark = pieces.sparkSession
    table = np.array(sorted(segments), dtype=np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(table)
    rows = ranked(pieces)
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "rank"]

    def locate(batches) -> Iterator:
        import pyarrow as pa

        t = shared.value
        keys = (t[:, 0] << 44) + t[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(zero_copy_only=False)
            own = t[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            n, k = np.divmod(rank - own[:, 1], own[:, 2])
            kept = [batch.column(f.split(" ")[0]) for f in fields]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(own[:, 3] + n), pa.array(own[:, 4] + k * length)], names=[*(f.split(" ")[0] for f in fields), "sequence_id", "offset"]
            )

    return rows.mapInArrow(locate, ", ".join([*fields, "sequence_id bigint", "offset bigint"]))


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, special_strings: bool = False
) -> DataFrame:
    """Pack every document, whole, into as few sequences of at most ``capacity`` tokens as best-two-fit can.

    A document's ids are those of its text by the tokenizer file, without special tokens, and then
    ``end_id``; a null or empty text has that id only. Strings of special tokens are ordinary text,
    or those tokens with ``special_strings``. Only documents of more than ``capacity``
    ids are cut, into pieces of that many. Repeated rows and doc_ids are documents like others; a
    null doc_id stays null. Other columns are not read. An empty table gives no rows.

    Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset, and, with
    ``with_ids``, ids (little-endian unsigned 32-bit).
    """
    spark = docs.sparkSession
    schema = _PIECES + (", ids binary" if with_ids else "")
    cut = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(tokenizer, capacity, end_id, with_ids, special_strings), schema)
    pieces = written(cut, workspace(spark, "pieces"), small=not with_ids)  # the texts are encoded once
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    segments, _ = plan_bins(counts, capacity)
    return placed(pieces, segments)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids (little-endian unsigned 32-bit), from pieces packed ``with_ids``; a sequence is small."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit("").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def op1_packing(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The contract's columns of ``pack_documents``, with the ids of the library's plain call."""
    packed = pack_documents(docs, tokenizer, special_strings=True)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
