"""Sharding by minimax contiguous partition of ordered atomic groups.

The rows of equal texts are one group and stay together. Groups are ordered by a 64-bit key; the
smallest feasible capacity is found by binary search, each step checked greedily, and the order is
cut where the greedy check of that capacity cuts it.

Prefix sums of all groups never meet in one place. The driver holds the sums of 2^16 key ranges, and
fetches finer sums only for the ranges in which a best cut can fall, until the bounds of the best
capacity meet; that takes two or three levels at any size.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import workspace, written

#: Key ranges of the first level, and finer ranges that one range is divided into at a later level.
RESOLUTION_BITS, FINER_BITS = 16, 8
#: Ranges divided at once; further ones are divided in later rounds.
MOST_DIVIDED = 2048
#: A group larger than this part of a shard is placed by itself; there are at most shards * LARGE of them.
LARGE = 8
ROWS_A_BLOCK = 100_000


def _greedy(prefix: list[int], shards: int, capacity: int) -> list[int] | None:
    """Cuts (ends of shards, as indexes into prefix) that fill each shard up to capacity; None where they don't suffice."""
    cuts, at, last = [], 0, len(prefix) - 1
    for _ in range(shards):
        at = bisect_right(prefix, prefix[at] + capacity) - 1
        cuts.append(at)
        if at == last:
            return cuts
    return None


def minimax_cuts(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest capacity with which the ordered sizes fit into so many contiguous shards, and its cuts."""
    prefix = [0]
    for s in sizes:
        prefix.append(prefix[-1] + s)
    low, high = max([0, *sizes, -(-prefix[-1] // shards)]), prefix[-1]
    while low < high:
        middle = (low + high) // 2
        if _greedy(prefix, shards, middle):
            high = middle
        else:
            low = middle + 1
    return low, _greedy(prefix, shards, low) or [0]


def _key() -> Column:
    """The key of a row's group: its text's hash, and one key for all null texts."""
    return F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("text"))


def _sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), _key().alias("key"))


class _Range(NamedTuple):
    """Groups whose key has these leading bits."""

    start: int
    bits: int
    bytes: int
    groups: int

    @property
    def end(self) -> int:
        return self.start + (1 << (64 - self.bits)) - 1


def _summed(groups: DataFrame, bits: int) -> list[_Range]:
    bucket = F.shiftright("key", 64 - bits)
    found = groups.groupBy(bucket.alias("b")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("groups")).collect()
    return sorted(_Range(r.b << (64 - bits), bits, r.bytes, r.groups) for r in found)


def _divided(groups: DataFrame, coarse: list[_Range]) -> list[_Range]:
    """Ranges of one depth, each divided into finer ones."""
    bits = coarse[0].bits
    wanted = groups.sparkSession.createDataFrame([(r.start >> (64 - bits),) for r in coarse], "b bigint")
    inside = groups.withColumn("b", F.shiftright("key", 64 - bits)).join(F.broadcast(wanted), "b", "left_semi")
    return _summed(inside.select("key", "bytes"), min(64, bits + FINER_BITS))


def _furthest(prefix: list[int], ranges: list[_Range], start: int, capacity: int) -> int:
    """Bytes that a shard from ``start`` reaches at most, were the groups of a range as fine as bytes."""
    end = start + capacity
    if end >= prefix[-1]:
        return prefix[-1]
    i = bisect_right(prefix, end) - 1
    return prefix[i] if ranges[i].groups == 1 else end


def _smallest(low: int, high: int, enough: Callable[[int], bool]) -> int:
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if enough(middle) else (middle + 1, high)
    return low


def _bounds(ranges: list[_Range], shards: int) -> tuple[int, int, list[_Range]]:
    """Lower and upper bound of the best capacity, and the ranges of several groups in which a best cut may fall.

    Cuts on range borders are cuts between groups, so their best capacity is an upper bound, and
    their greedy reach a lower bound of the groups' greedy reach. Cuts anywhere in a range of
    several groups give the other bounds.
    """
    prefix = [0]
    for r in ranges:
        prefix.append(prefix[-1] + r.bytes)
    total = prefix[-1]

    def may_do(capacity: int) -> bool:
        at = 0
        for _ in range(shards):
            at = _furthest(prefix, ranges, at, capacity)
        return at == total

    high, _ = minimax_cuts([r.bytes for r in ranges], shards)
    low = _smallest(-(-total // shards), high, may_do)
    near: set[int] = set()
    least, most = 0, 0  # index of a border, bytes
    for _ in range(shards):
        least = max(least, bisect_right(prefix, prefix[least] + low) - 1)
        most = _furthest(prefix, ranges, most, high)
        near.update(range(least, min(len(ranges), bisect_right(prefix, most))))
    return low, high, [ranges[i] for i in sorted(near) if ranges[i].groups > 1 and ranges[i].bits < 64]


def cut_points(groups: DataFrame, shards: int) -> list[int]:
    """The last key of each shard, in order; fewer than ``shards`` where fewer are needed."""
    ranges = _summed(groups, RESOLUTION_BITS)
    while ranges:
        low, high, open_ = _bounds(ranges, shards)
        if low == high or not open_:
            break
        depth = min(r.bits for r in open_)
        chosen = sorted((r for r in open_ if r.bits == depth), key=lambda r: -r.bytes)[:MOST_DIVIDED]
        ranges = sorted({*ranges} - {*chosen} | {*_divided(groups, chosen)})
    _, cuts = minimax_cuts([r.bytes for r in ranges], shards)
    return [ranges[c - 1].end for c in cuts if c]


@dataclass(frozen=True)
class Assignment:
    """Which shard each key has: ``alone`` keys one each, the others by their place in the order and its cuts."""

    alone: dict[int, int]  # key to shard
    moved: dict[int, int]  # key to a place other than the key itself
    ends: list[int]  # the last place of each further shard

    def places(self, groups: DataFrame) -> DataFrame:
        """(key, bytes) of the groups that are not alone, by their places."""
        rows = groups
        if self.alone:
            rows = rows.where(~F.col("key").isin(list(self.alone)))
        if not self.moved:
            return rows
        table = rows.sparkSession.createDataFrame(list(self.moved.items()), "key bigint, moved bigint")
        return rows.join(F.broadcast(table), "key", "left").select(F.coalesce("moved", "key").alias("key"), "bytes")

    def apply(self, rows: DataFrame, key: str) -> DataFrame:
        """``rows`` with the column __sl_shard by the column ``key``."""
        named = [(k, None, i) for k, i in self.alone.items()] + [(k, p, None) for k, p in self.moved.items()]
        table = rows.sparkSession.createDataFrame(named, "__sl_key bigint, __sl_moved bigint, __sl_alone int")  # at most shards * LARGE rows
        placed = rows.join(F.broadcast(table), rows[key] == table["__sl_key"], "left")
        place, first = F.coalesce("__sl_moved", key), len(self.alone)
        if len(self.ends) < 2:
            shard = F.lit(first)
        else:
            cuts, bits = self.ends[:-1], min(32, len(self.ends).bit_length() + 2)
            prefix = F.shiftright(place, 64 - bits)
            placed = placed.join(F.broadcast(self._ranges(rows, cuts, bits)), prefix == F.col("__sl_prefix"))
            shard = F.col("__sl_before") + F.size(F.filter("__sl_cuts", lambda c: c < place)) + first
        return placed.withColumn("__sl_shard", F.coalesce("__sl_alone", shard).cast("int")).select(*[rows[c] for c in rows.columns], "__sl_shard")

    @staticmethod
    def _ranges(rows: DataFrame, cuts: list[int], bits: int) -> DataFrame:
        """The cuts by their leading bits, at most 16 ranges for each shard: how many are before the range, and those in it."""
        step, at, found = 1 << (64 - bits), 0, []
        for prefix in range(-(1 << (bits - 1)), 1 << (bits - 1)):
            upto = bisect_left(cuts, (prefix + 1) * step, at)
            found.append((prefix, at, cuts[at:upto]))
            at = upto
        return rows.sparkSession.createDataFrame(found, "__sl_prefix bigint, __sl_before int, __sl_cuts array<bigint>")


def assign(sized: DataFrame, shards: int) -> Assignment:
    """The assignment for rows of (key, size)."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    groups = sized.groupBy("key").agg(F.sum("size").alias("bytes"))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    top = groups.orderBy(F.desc("bytes"), "key").limit(shards * LARGE).collect()
    alone: dict[int, int] = {}
    rest, left = total, shards
    for g in top:
        if left > 1 and g.bytes * left > rest:
            alone[g.key] = len(alone)
            rest, left = rest - g.bytes, left - 1
    loads, put = [0.0] * left, []
    for g in top:  # largest first, each to the lightest place
        if g.key not in alone and g.bytes * left * LARGE > rest:
            k = loads.index(min(loads))
            loads[k] += g.bytes
            put.append((g.key, k))
    free = [max(0.0, rest / left - x) for x in loads]
    begins = [sum(free[:k]) / (sum(free) or 1) for k in range(left)]
    moved = {key: min((1 << 63) - 1, int(begins[k] * 2.0**64) - (1 << 63) + n) for n, (key, k) in enumerate(put)}
    if not rest:
        return Assignment(alone, moved, [])
    everywhere = Assignment(alone, moved, []).places(groups)
    return Assignment(alone, moved, cut_points(everywhere, left))


def shard_by_bytes(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Put every row into one of ``shards`` shards of nearly equal bytes; equal texts stay together.

    A row's size is the UTF-8 bytes of its text (null: none) plus 8. Groups larger than the equal
    share of what is left take a shard each; smaller ones that still weigh on a shard are spread
    over the key order; the rest lies at its text's hash. Null texts are one group, apart from
    empty ones. Two texts of one 64-bit hash would be one group. Repeated rows and doc_ids are
    rows like others. Other columns are not read. An empty table gives no rows.

    Returns doc_id, size, text_crc32, shard, slot: slots number a shard's rows from 0.
    """
    rows = written(_sized(docs), workspace(docs.sparkSession, "shard-sizes"), small=True)  # the texts are read once
    placed = assign(rows, shards).apply(rows, "key").withColumnRenamed("__sl_shard", "shard")
    return _with_slots(placed.select("doc_id", "size", "text_crc32", "shard"), rows)


def _with_slots(placed: DataFrame, rows: DataFrame) -> DataFrame:
    """Number each shard's rows from 0: within blocks by a window, and the blocks by their counts."""
    blocks = max(8, -(-rows.count() // ROWS_A_BLOCK))
    blocked = placed.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)))
    counts = blocked.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32"))
    numbered = blocked.withColumn("inside", inside).join(before, ["shard", "block"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("inside") - 1).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 24) -> None:
    """Write the documents with all their columns as Parquet folders shard=0, shard=1, ...; a column named shard is written as shard_."""
    rows = written(_sized(docs).select("key", "size"), workspace(docs.sparkSession, "shard-sizes"), small=True)
    free = "shard_"
    while free in docs.columns:
        free += "_"
    placed = assign(rows, shards).apply(docs.withColumnRenamed("shard", free).withColumn("__sl_own", _key()), "__sl_own")
    placed.drop("__sl_own").withColumnRenamed("__sl_shard", "shard").write.partitionBy("shard").parquet(path)


def op2_sharding(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The contract's digest of ``shard_by_bytes``: law ``bytes``."""
    put = shard_by_bytes(docs, shards)
    return put.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
