"""SimHash near-duplicates by anchor points of a covering code.

A pair of 64-bit fingerprints at 3 differing bits or fewer differs in 1 bit or none in one of its
two halves. 31 bits of each half are covered by the Hamming code [31, 26]: every word lies within
1 bit of a code word. These 2 * 2^26 code words are the anchors. A fingerprint is replicated to all
anchors within covering radius plus threshold, 1 + 1 bits: 1 or 16 of each half. So every pair
that must link meets at an anchor, and fingerprints are compared there in full.

Equal fingerprints are one row before that. At an anchor only a spanning forest of the links is
made, so that a dense group of n fingerprints gives n - 1 links and not their square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import null_safe_join, workspace, written

SHINGLE_WORDS = 3
MOST_BITS = 3
SEED = 42
#: Shingles counted at once; bounds the memory of a long text.
CHUNK = 1 << 16
#: Fingerprints at one anchor that are compared without a further division.
SMALL = 1024
_PARITY = [sum(1 << (p - 1) for p in range(1, 32) if p >> b & 1) for b in range(5)]
_PAIRS = [(i, j) for i in range(1, 32) for j in range(i + 1, 32)]
#: For each syndrome, the masks that lead to the code words at 2 bits.
_TWO = np.array([[0] * 15] + [[(1 << (i - 1)) | (1 << (j - 1)) for i, j in _PAIRS if i ^ j == s] for s in range(1, 32)], dtype=np.int64)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of the text's word shingles, repeats included; 0 for a text without words.

    Words lie between ASCII white space, A-Z in lower case. A text of fewer words is one shingle.
    """
    from xxhash import xxh64_digest

    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return 0
    k = min(words, len(own))
    counts, n = np.zeros(64, np.int64), len(own) - k + 1
    for at in range(0, n, CHUNK):
        part = own[at : at + CHUNK + k - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(k)), strict=False))
        bits = np.unpackbits(np.frombuffer(b"".join([xxh64_digest(s, SEED) for s in shingles]), np.uint8))
        lanes = bits.view(np.uint64).reshape(-1, 8)  # 8 counters of one byte in each number
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
        counts += sums.view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, h (the text's hash) and fp (the fingerprint as a signed number) of every row."""

    def compute(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                found = np.array([fingerprint(t, words) for t in some.column(1).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(found.view(np.int64))], names=["doc_id", "h", "fp"])

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text)).mapInArrow(compute, "doc_id bigint, h bigint, fp bigint")


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, index of fingerprint) of every replica: all code words within 2 bits of each half."""
    found, whose = [], []
    for half in (0, 1):
        word = (fps >> (32 * half)) & 0x7FFFFFFF
        syndrome = np.zeros(len(fps), np.int64)
        for b, mask in enumerate(_PARITY):
            syndrome |= (np.bitwise_count(word & mask).astype(np.int64) & 1) << b
        nearest = np.where(syndrome > 0, word ^ (1 << np.maximum(syndrome - 1, 0)), word)
        tag = np.int64(half) << 32
        found.append(nearest | tag)
        whose.append(np.arange(len(fps)))
        off = np.flatnonzero(syndrome)
        found.append(((word[off, None] ^ _TWO[syndrome[off]]) | tag).ravel())
        whose.append(np.repeat(off, 15))
    return np.concatenate(found), np.concatenate(whose)


def _spread(fps: np.ndarray, bits: int, links: list) -> None:
    """Links of a spanning forest of these distinct fingerprints, by breadth-first search."""
    left = fps
    while len(left) > 1:
        root, left, queue = left[0], left[1:], [left[0]]
        while queue and len(left):
            near = np.bitwise_count((left ^ queue.pop()).view(np.uint64)) <= bits
            if near.any():
                new = left[near]
                left = left[~near]
                links.append((np.full(len(new), root), new))
                queue.extend(new)


def _linked(fps: np.ndarray, anchor: int, bits: int, links: list) -> None:
    """Links at one anchor. Many fingerprints are first divided by two of five blocks of the other half.

    3 differing bits leave at least two of five blocks equal, so no link is lost.
    """
    fps = np.unique(fps)
    if len(fps) <= SMALL:
        _spread(fps, bits, links)
        return
    shift = 0 if anchor >> 32 else 32
    blocks = [((fps >> (shift + at)) & ((1 << size) - 1)) for at, size in ((0, 7), (7, 7), (14, 6), (20, 6), (26, 6))]
    for i in range(5):
        for j in range(i):
            key = blocks[i] << 8 | blocks[j]
            order = np.argsort(key, kind="stable")
            edges = np.flatnonzero(np.diff(key[order])) + 1
            for group in np.split(fps[order], edges):
                _spread(group, bits, links)


def links(distinct: DataFrame, bits: int = MOST_BITS) -> DataFrame:
    """(a, b), a < b: links that connect what pairs of at most ``bits`` differing bits connect."""

    def replicate(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            if len(fps):
                anchor, whose = anchors(fps)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps[whose])], names=["anchor", "fp"])

    def compare(batches) -> Iterator:
        import pyarrow as pa

        def batch_of(found: list):
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        held: list[np.ndarray] = []
        open_anchor = None
        found: list = []
        for batch in batches:
            at, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(at):
                continue
            edges = np.flatnonzero(np.diff(at)) + 1
            begins, ends = np.r_[0, edges], np.r_[edges, len(at)]
            many = np.flatnonzero(ends - begins > 1).tolist()
            last = len(begins) - 1
            if at[0] == open_anchor:
                held.append(fps[: ends[0]])
                if last == 0:
                    continue
                many = [i for i in many if i]
            if open_anchor is not None and sum(map(len, held)) > 1:
                _linked(np.concatenate(held), open_anchor, bits, found)
            for i in many:
                if i != last:
                    _linked(fps[begins[i] : ends[i]], int(at[begins[i]]), bits, found)
            open_anchor, held = int(at[-1]), [fps[begins[last] :]]
            if found:
                yield batch_of(found)
                found = []
        if open_anchor is not None and sum(map(len, held)) > 1:
            _linked(np.concatenate(held), open_anchor, bits, found)
        if found:
            yield batch_of(found)

    met = distinct.select("fp").mapInArrow(replicate, "anchor bigint, fp bigint").repartition("anchor").sortWithinPartitions("anchor")
    return met.mapInArrow(compare, "a bigint, b bigint").distinct()


def components(edges: DataFrame, path: str) -> DataFrame:
    """(fp, label) of every fingerprint that has a link, by randomised contraction; label is one of its component's.

    In each round nodes are ordered by a new hash, a node goes to the first of itself and its
    neighbours, and links are carried over to where their ends went; rounds end when no link is
    left. A round leaves three quarters of the nodes at most, on average and whatever the links
    are, so the rounds grow with the logarithm of the nodes. Each is written under ``path``, a
    shared folder.
    """
    edges = written(edges, f"{path}/links-0")
    labels, n = None, 0
    while not edges.isEmpty():
        n += 1
        placed = lambda c: F.struct(F.xxhash64(F.lit(n), c).alias("at"), F.col(c).alias("to"))  # noqa: B023, E731
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy(F.col("a").alias("node")).agg(F.min(placed("b")).alias("near"))
        goes = written(first.select("node", F.least(placed("node"), F.col("near"))["to"].alias("to")), f"{path}/to-{n}")
        a, b = goes.select(F.col("node").alias("a"), F.col("to").alias("ta")), goes.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        carried = edges.join(a, "a").join(b, "b").where(F.col("ta") != F.col("tb"))
        edges = written(carried.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), f"{path}/links-{n}")
        if labels is None:
            labels = goes.select(F.col("node").alias("fp"), F.col("to").alias("label"))
        else:
            onward = labels.join(goes.withColumnRenamed("node", "label"), "label", "left")
            labels = written(onward.select("fp", F.coalesce("to", "label").alias("label")), f"{path}/labels-{n}")
    return labels if labels is not None else edges.select(F.col("a").alias("fp"), F.col("b").alias("label"))


def near_duplicates(docs: DataFrame, bits: int = MOST_BITS, words: int = SHINGLE_WORDS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, h (the text's hash), fp (signed), label, component_id.

    Fingerprints link at ``bits`` (3 at most) or fewer differing bits; label is a fingerprint of
    the component, and component_id the smallest doc_id among all documents that links reach, which
    two components may share where doc_ids repeat or are null. Texts without words (null, empty)
    have fingerprint 0, which links like any other. Repeated rows are documents like others; a null
    doc_id never is the smallest unless there are null ones only. Other columns are not read. An
    empty table gives no rows.
    """
    if not 0 <= bits <= MOST_BITS:
        raise ValueError("the covering code is made for at most 3 bits")
    path = workspace(docs.sparkSession, "simhash")
    own = written(fingerprints(docs, words), f"{path}/fingerprints", small=True)
    first = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    labels = components(links(own.select("fp").distinct(), bits), path)
    labelled = first.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    component = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    ids = written(labelled.join(component, "label").select("fp", "label", "component_id"), f"{path}/components")
    return own.join(ids, "fp").select("doc_id", "h", "fp", "label", "component_id")


def keep_one_each(docs: DataFrame, bits: int = MOST_BITS, words: int = SHINGLE_WORDS) -> DataFrame:
    """The documents with all their columns, of each component one: that of the smallest doc_id.

    Where several rows of it have that doc_id, the one with the smallest fingerprint and text hash
    stays; of rows that are equal in these, any one. So it is for a component without any doc_id.
    Components are told apart by their fingerprints, so repeated or null doc_ids join none.
    """
    path = workspace(docs.sparkSession, "kept")
    firsts = near_duplicates(docs, bits, words).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    counted = firsts.groupBy("label", "doc_id", "fp", "h").agg(F.count(F.lit(1)).alias("n"))
    smallest = counted.groupBy("label").agg(F.min_by(F.struct("doc_id", "h", "n"), F.struct("fp", "h")).alias("x"))
    chosen = written(smallest.select(F.col("x.doc_id").alias("__sl_id"), F.col("x.h").alias("__sl_h"), F.col("x.n").alias("__sl_n")), path)
    keyed = docs.withColumns({"__sl_id": F.col("doc_id").cast("long"), "__sl_h": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})

    def rows_of(these: DataFrame) -> DataFrame:
        return null_safe_join(keyed, these.drop("__sl_n"), ["__sl_id", "__sl_h"], "left_semi")

    staying = rows_of(chosen.where("__sl_n = 1"))
    repeated = chosen.where("__sl_n > 1")
    if not repeated.isEmpty():
        staying = staying.unionByName(rows_of(repeated).dropDuplicates(["__sl_id", "__sl_h"]))
    return staying.drop("__sl_id", "__sl_h")


def op7_simhash(docs: DataFrame) -> DataFrame:
    """The contract's columns of ``near_duplicates``."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
