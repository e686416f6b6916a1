"""Archives as tables: members are listed from directories and headers, and read by tasks of their own.

A zip file's directory and a plain tar file's headers say where each member lies, so these are read
first, by one task for each archive that passes over the contents; then every member is an input of its own,
opened at its place. Compressed tar files and single compressed files have no such places, and
one task reads each of them from its beginning. No content comes to the driver.
"""

from __future__ import annotations

import bz2
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.functions.files import file_system
from schemaloom.functions.scratch import workspace, written

#: Bytes of one piece of a member, and stored bytes that a task reads on average.
PIECE, TASK = 32 << 20, 64 << 20
_BLOCK = 1 << 20
_MEMBERS = "archive string, member string, kind string, at bigint, stored bigint, crc bigint, error string"


def _fault(name: str) -> str | None:
    """Why a member's name may not be written to a folder."""
    parts = name.replace("\\", "/").split("/")
    if name.startswith(("/", "\\")) or ".." in parts or "\0" in name or (len(parts[0]) > 1 and parts[0][1] == ":"):
        return f"{name} would leave its folder"
    return None if posixpath.normpath(name) not in (".", "") else f"{name} names no file"


def _kind(path: str) -> str | None:
    low = path.lower()
    if low.endswith((".tar.gz", ".tgz")):
        return "tar-gz"
    if low.endswith((".tar.bz2", ".tbz2")):
        return "tar-bz2"
    return next((k for k in ("tar", "zip", "gz", "bz2") if low.endswith(f".{k}")), None)


class _Unpacked:
    """The bytes of a compressed file from its beginning, also where it is several streams, as a file to read."""

    def __init__(self, file, kind: str):
        self.file, self.new = file, (lambda: zlib.decompressobj(31)) if kind == "gz" else bz2.BZ2Decompressor
        self.stream, self.held, self.rest, self.started = self.new(), b"", b"", False

    def read(self, size: int = -1) -> bytes:
        while size < 0 or len(self.held) < size:
            data = self.rest or self.file.read(_BLOCK)
            self.rest = b""
            if not data:
                if self.started and not self.stream.eof:
                    raise EOFError("a compressed file ends too early")
                break
            if self.stream.eof:
                data = data.lstrip(b"\0")
                if not data:
                    continue
                self.stream = self.new()
            self.started = True
            self.held += self.stream.decompress(data)
            self.rest = self.stream.unused_data if self.stream.eof else b""
        out, self.held = (self.held, b"") if size < 0 else (self.held[:size], self.held[size:])
        return out


def _listed(path: str) -> Iterator[tuple]:
    """The rows of one archive's members."""
    import tarfile
    import zipfile

    kind = _kind(path)
    system, own = file_system(path)
    if kind in ("tar-gz", "tar-bz2"):
        yield path, None, kind, 0, system.get_file_info(own).size, None, None
    elif kind in ("gz", "bz2"):
        yield path, posixpath.basename(own)[: -len(kind) - 1], kind, 0, system.get_file_info(own).size, None, None
    elif kind:
        with system.open_input_file(own) as file:
            if kind == "tar":
                with tarfile.open(fileobj=file, mode="r:") as archive:
                    for m in archive:
                        if m.isfile():
                            yield path, m.name, kind, m.offset_data, m.size, None, _fault(m.name)
                return
            with zipfile.ZipFile(file) as archive:
                for m in archive.infolist():
                    if not m.is_dir():
                        how = {0: "stored", 8: "deflated"}.get(m.compress_type)
                        fault = _fault(m.filename) or ("encrypted" if m.flag_bits & 1 else None if how else f"compression {m.compress_type}")
                        yield path, m.filename, f"zip-{how}", m.header_offset, m.compress_size, m.CRC, fault


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """Members of all archives under ``path``: archive, member, kind, at, stored, crc, and error where one may not be read.

    Compressed tar files have one row without a member. Folders, links and devices in archives have
    no rows, and neither have files of other names.
    """
    names = [f.split(" ")[0] for f in _MEMBERS.split(", ")]

    def listed(batches) -> Iterator:
        import pyarrow as pa

        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for own in batch.column(0).to_pylist():
                rows = list(_listed(own))  # one archive's directory
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    spread = files.where(F.lower("path").rlike(r"\.(zip|tar|tgz|gz|tbz2|bz2)$"))
    return spread.repartition(F.col("path")).mapInArrow(listed, _MEMBERS)


def _member(path: str, kind: str, at: int, stored: int, crc: int | None) -> Iterator[bytes]:
    """The bytes of a member, in blocks."""
    system, own = file_system(path)
    with system.open_input_file(own) as file:
        if kind in ("gz", "bz2"):
            source = _Unpacked(file, kind)
            while block := source.read(_BLOCK):
                yield block
            return
        if kind != "tar":
            file.seek(at)
            head = file.read(30)
            name, extra = struct.unpack("<HH", head[26:30])
            at += 30 + name + extra
        file.seek(at)
        stream, seen = zlib.decompressobj(-15) if kind == "zip-deflated" else None, 0
        while stored or (stream and stream.unconsumed_tail):
            data = stream.unconsumed_tail if stream and stream.unconsumed_tail else file.read(min(stored, _BLOCK))
            if not (stream and stream.unconsumed_tail):
                if not data:
                    raise EOFError(f"{path} ends too early")
                stored -= len(data)
            block = stream.decompress(data, 4 * _BLOCK) if stream else data
            seen = zlib.crc32(block, seen)
            yield block
        if stream and (block := stream.flush()):
            seen = zlib.crc32(block, seen)
            yield block
        if crc is not None and seen != crc:
            raise ValueError(f"{path} is damaged")


def _opened(row: tuple) -> Iterator[tuple[str, Iterator[bytes]]]:
    """(member, its blocks) of a row of ``archive_members``: several for a compressed tar file."""
    import tarfile

    path, member, kind, at, stored, crc, error = row
    if error:
        raise ValueError(f"{path}: {error}")
    if member is not None:
        yield member, _member(path, kind, at, stored, crc)
        return
    system, own = file_system(path)
    with system.open_input_file(own) as file, tarfile.open(fileobj=_Unpacked(file, kind[4:]), mode="r|") as archive:
        for m in archive:
            if m.isfile():
                if fault := _fault(m.name):
                    raise ValueError(f"{path}: {fault}")
                source = archive.extractfile(m)
                yield m.name, iter(lambda: source.read(_BLOCK), b"")  # noqa: B023


def _rows(batch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _dealt(members: DataFrame) -> DataFrame:
    """Members over as many tasks as their bytes take."""
    known = written(members, workspace(members.sparkSession, "members"), small=True)
    n, size = known.agg(F.count(F.lit(1)), F.sum("stored")).first()
    bad = known.where("error IS NOT NULL").select("archive", "error").first()
    if bad:
        raise ValueError(f"{bad.archive}: {bad.error}")
    return known.repartition(max(1, min(n, (size or 0) // TASK + 1)))


def read_members(members: DataFrame, piece: int = PIECE) -> DataFrame:
    """archive, member, piece (from 0) and content of these members; a piece has ``piece`` bytes at most, and an empty member one empty piece.

    A member that may not be read is an error before any is.
    """

    def read(batches) -> Iterator:
        import pyarrow as pa

        def sent(rows):
            types = [pa.string(), pa.string(), pa.int32(), pa.large_binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays([*columns[:3], columns[3].cast(pa.binary())], names=["archive", "member", "piece", "content"])

        out, size = [], 0
        for row in (r for batch in batches for r in _rows(batch)):
            for member, blocks in _opened(row):
                held, n = bytearray(), 0
                for block in blocks:
                    held += block
                    while len(held) > piece:
                        yield sent([(row[0], member, n, bytes(held[:piece]))])
                        del held[:piece]
                        n += 1
                out.append((row[0], member, n, bytes(held)))
                size += len(held)
                if size > PIECE or len(out) >= 5000:
                    yield sent(out)
                    out, size = [], 0
        if out:
            yield sent(out)

    return _dealt(members).mapInArrow(read, "archive string, member string, piece int, content binary")


def read_archives(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """The contents of all archives under ``path``, as ``read_members`` gives them."""
    return read_members(archive_members(spark, path), piece)


def unpack(spark: SparkSession, path: str, target: str | None = None) -> DataFrame:
    """Write every member as a file, under ``target`` or next to its archive; returns archive, member, path and bytes.

    Tasks write to a name of their own and rename at the end, so no half file has a member's name,
    and a task that is run again gives the same files. Nothing is written if a member would leave its folder.
    """

    def write(batches) -> Iterator:
        import pyarrow as pa

        for row in (r for batch in batches for r in _rows(batch)):
            system, own = file_system(target or row[0].rsplit("/", 1)[0])
            done = []
            for member, blocks in _opened(row):
                name = f"{own}/{posixpath.normpath(member)}"
                fresh = f"{posixpath.dirname(name)}/.{uuid.uuid4().hex}"
                system.create_dir(posixpath.dirname(name), recursive=True)
                size = 0
                with system.open_output_stream(fresh) as out:
                    for block in blocks:
                        out.write(block)
                        size += len(block)
                system.move(fresh, name)
                done.append((row[0], member, f"{target or row[0].rsplit('/', 1)[0]}/{posixpath.normpath(member)}", size))
            if done:
                types = [pa.string(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=["archive", "member", "path", "bytes"])

    made = _dealt(archive_members(spark, path)).mapInArrow(write, "archive string, member string, path string, bytes bigint")
    return written(made, workspace(spark, "unpacked"), small=True)


def write_archives(rows: DataFrame, path: str, archive: str, member: str, content: str) -> DataFrame:
    """One zip file for each value of ``archive``, with a member for each of its rows; returns archive, path and members.

    ``content`` is text or binary. Rows of an archive go to one task, sorted by member; an archive that
    a lost task left half written has another name.
    """

    def write(batches) -> Iterator:
        import zipfile

        import pyarrow as pa

        system, own = file_system(path)
        system.create_dir(own, recursive=True)
        now = out = fresh = zipped = None
        n, done = 0, []

        def ended() -> None:
            if zipped is not None:
                zipped.close()
                out.close()
                system.move(fresh, f"{own}/{now}.zip")
                done.append((now, f"{path}/{now}.zip", n))

        for name, inner, data in (r for batch in batches for r in _rows(batch)):
            if name != now:
                ended()
                if fault := _fault(name) or ("/" in name and f"{name} is no file name") or None:
                    raise ValueError(fault)
                now, n, fresh = name, 0, f"{own}/.{uuid.uuid4().hex}"
                out = system.open_output_stream(fresh)
                zipped = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
            zipped.writestr(zipfile.ZipInfo(inner), data or b"", zipfile.ZIP_DEFLATED)
            n += 1
        ended()
        if done:
            types = [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=["archive", "path", "members"])

    own = rows.select(F.col(archive).cast("string").alias("a"), F.col(member).cast("string").alias("m"), F.col(content).cast("binary").alias("c"))
    dealt = own.repartition("a").sortWithinPartitions("a", "m")
    return written(dealt.mapInArrow(write, "archive string, path string, members bigint"), workspace(rows.sparkSession, "archives"), small=True)
