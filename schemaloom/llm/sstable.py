"""Token ids as sorted-string-table shards.

A shard file holds the documents of a range of identifiers, in ascending order:

    magic | block ... | sparse index | Bloom filter | footer

A block holds entries (shared, unshared, ids: varints; the key's unshared bytes; the ids), the first
one with a whole key, and ends with its CRC-32. The index has each block's first key, place, entries
and the number of ids before it. Keys are 9 bytes that sort as the identifiers do, null first. Ids
take 2 bytes each where the vocabulary allows it, else 4. All numbers are little-endian.

Files are written through the file system that the folder's address names, under a name of their
own for each attempt of a task; only files that a finished task reports are read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import workspace, written
from .tokens import encoded_rows

MAGIC = b"SLSST001"
BLOCK_BYTES = 64 * 1024
BLOOM_BITS, BLOOM_HASHES = 10, 7
END_ID = 0
_FOOTER = struct.Struct("<QQQQQQIIQ8s")  # places and sizes of index and filter, documents, ids, id width, filter hashes, crc of both, magic
_INDEX = struct.Struct("<9sQIIQ")  # first key, place, size, entries, ids before


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    import xxhash

    a, b = xxhash.xxh64_intdigest(key, 0), xxhash.xxh64_intdigest(key, 1) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Writes one shard to a binary stream; documents come in ascending order of their keys."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.at = out.write(MAGIC) and len(MAGIC)
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.block, self.first, self.last = bytearray(), b"", b""
        self.entries = self.ids = self.ids_before = self.documents = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if key < self.last:
            raise ValueError("keys must ascend")
        if not self.entries:
            self.first, shared = key, 0
        else:
            shared = next((i for i in range(9) if key[i] != self.last[i]), 9)
        body = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        self.block += _varint(shared) + _varint(9 - shared) + _varint(len(ids)) + key[shared:] + body
        if key != self.last or not self.documents:
            self.keys.append(key)
        self.last = key
        self.entries += 1
        self.documents += 1
        self.ids += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self.entries:
            self.block += struct.pack("<I", zlib.crc32(self.block))
            self.index.append(_INDEX.pack(self.first, self.at, len(self.block), self.entries, self.ids_before))
            self.out.write(bytes(self.block))
            self.at += len(self.block)
            self.ids_before, self.entries = self.ids, 0
            self.block.clear()

    def close(self) -> None:
        self._end_block()
        index = b"".join(self.index)
        bits = max(64, len(self.keys) * BLOOM_BITS)
        filter_ = np.zeros(bits, np.uint8)
        for key in self.keys:
            filter_[_bloom_places(key, bits)] = 1
        bloom = struct.pack("<Q", bits) + np.packbits(filter_).tobytes()
        self.out.write(index)
        self.out.write(bloom)
        crc = zlib.crc32(bloom, zlib.crc32(index))
        self.out.write(_FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.documents, self.ids, self.width, BLOOM_HASHES, crc, MAGIC))


class Block(NamedTuple):
    first: bytes
    place: int
    size: int
    entries: int
    ids_before: int


class Reader:
    """Reads one shard from a seekable binary stream, a block at a time."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, 2)
        if end < len(MAGIC) + _FOOTER.size:
            raise ValueError("not a shard: too short")
        file.seek(end - _FOOTER.size)
        index_at, index_size, bloom_at, bloom_size, self.documents, self.ids, self.width, _, crc, magic = _FOOTER.unpack(file.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard: no footer")
        file.seek(index_at)
        index, bloom = file.read(index_size), file.read(bloom_size)
        if zlib.crc32(bloom, zlib.crc32(index)) != crc:
            raise ValueError("damaged index or filter")
        self.blocks = [Block(*_INDEX.unpack_from(index, i)) for i in range(0, len(index), _INDEX.size)]
        self.firsts = [b.first for b in self.blocks]
        self.bits = struct.unpack_from("<Q", bloom)[0]
        self.bloom = bloom[8:]

    def entries(self, block: Block) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """(key, ids before it, ids) of a block's documents."""
        self.file.seek(block.place)
        data = self.file.read(block.size)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("damaged block")
        at, key, before, kind = 0, b"", block.ids_before, "<u2" if self.width == 2 else "<u4"
        for _ in range(block.entries):
            shared, at = _read_varint(data, at)
            unshared, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + unshared]
            at += unshared
            yield key, before, np.frombuffer(data, kind, n, at)
            at += n * self.width
            before += n

    def __iter__(self) -> Iterator[tuple[bytes, int, np.ndarray]]:
        for block in self.blocks:
            yield from self.entries(block)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] & (128 >> (p & 7)) for p in _bloom_places(key, self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document of that identifier: filter, binary search of the index, then the blocks."""
        key, found = key_of(doc_id), []
        if self.may_hold(key):
            i = max(0, bisect_right(self.firsts, key) - 1)
            while i > 0 and self.firsts[i] == key:
                i -= 1  # equal keys may begin in an earlier block
            while i < len(self.blocks) and self.firsts[i] <= key:
                found += [ids.copy() for k, _, ids in self.entries(self.blocks[i]) if k == key]
                i += 1
        return found


#: Hadoop's names of object stores, and those that pyarrow knows; others, such as file, hdfs, gs and abfs, are the same.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


def _file_system(path: str):
    from pyarrow import fs

    scheme, colon, rest = path.partition("://")
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}{colon}{rest}")


def open_shard(path: str) -> Reader:
    system, own = _file_system(path)
    return Reader(system.open_input_file(own))


_MANIFEST = "shard int, path string, documents bigint, ids bigint, first bigint, last bigint, nulls boolean"


def write_table(docs: DataFrame, tokenizer: str, path: str, shards: int | None = None, end_id: int = END_ID, special_strings: bool = False) -> DataFrame:
    """Encode every text, append ``end_id`` and write all documents in ascending doc_id as shards under ``path``.

    Documents of one doc_id lie next to each other, ordered by their text's hash. Null and empty
    texts have the end id only; a null doc_id comes first. Strings of special tokens are ordinary
    text, or those tokens with ``special_strings``. Returns the manifest, one row for each
    shard that has documents, which is also written as ``path``/manifest.
    """

    def write(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext
        from tokenizers import Tokenizer

        rows = encoded_rows(batches, tokenizer, special_strings)
        head = next(rows, None)
        if head is None:
            return
        system, folder = _file_system(path)
        system.create_dir(folder, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"shard-{part:06d}-{uuid.uuid4().hex}.sst"
        wide = max(end_id, Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) - 1) >= 1 << 16
        first = last = None
        nulls, end = False, np.array([end_id], "<u4")
        with system.open_output_stream(f"{folder}/{name}") as out:
            shard = Writer(out, 4 if wide else 2)
            row: tuple | None = head
            while row is not None:
                doc_id, ids = row
                shard.add(key_of(doc_id), np.concatenate([np.frombuffer(ids, "<u4"), end]))
                if doc_id is None:
                    nulls = True
                else:
                    first, last = (doc_id if first is None else first), doc_id
                row = next(rows, None)
            shard.close()
        values = [part, f"{path}/{name}", shard.documents, shard.ids, first, last, nulls]
        types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        names = [x.split(" ")[0] for x in _MANIFEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    dealt = rows.repartitionByRange(shards, *order) if shards else rows.repartitionByRange(*order)
    return written(dealt.sortWithinPartitions(*order).mapInArrow(write, _MANIFEST), f"{path}/manifest", small=True)


def read_table(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Every document from the shard files: doc_id, start, n_tokens, ids_crc32, and ids (binary) on demand.

    ``start`` counts the ids of all documents before it, in this shard and the earlier ones.
    """
    before = F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")  # a row for each file
    files = manifest.select("path", before.alias("before"))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def read(batches) -> Iterator:
        import pyarrow as pa

        types = [pa.int64()] * 4 + [pa.binary()] * with_ids
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = open_shard(path)
                for block in shard.blocks:
                    rows = []
                    for key, at, ids in shard.entries(block):
                        plain = ids.astype("<u4").tobytes()
                        rows.append((id_of(key), base + at, len(ids), zlib.crc32(plain), plain)[: len(names)])
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
                shard.file.close()

    spread = files.repartition(max(1, manifest.count()))  # dealt one by one, so that each task has a file
    return spread.mapInArrow(read, ", ".join(f"{n} {'binary' if n == 'ids' else 'bigint'}" for n in names))


def lookup(spark: SparkSession, manifest: DataFrame, doc_id: int | None) -> list[np.ndarray]:
    """The ids of every document of that identifier, from the shards whose range can hold it."""
    inside = F.col("nulls") if doc_id is None else (F.col("first") <= doc_id) & (F.col("last") >= doc_id)
    return [ids for r in manifest.where(inside).orderBy("shard").collect() for ids in open_shard(r.path).get(doc_id)]


def op10_token_output(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The contract's columns, read back from the files that ``write_table`` has written with the ids of the library's plain call."""
    return read_table(write_table(docs, tokenizer, workspace(docs.sparkSession, "sst"), special_strings=True))
