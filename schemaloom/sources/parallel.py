"""Files of records that may hold their own separator, read in parts by many tasks.

A file is read as pieces between separators, lines of a table or what lies between commas of a JSON
array, by Spark's own text reader, so that a large file has many parts. Whether a piece ends a record depends on
what comes before it: a quote or a bracket may be open. So a first pass sums up each part for every
state in which it may begin; the states are then carried over the parts of a file, a few rows for each
part; and a second pass, which knows its part's state, joins pieces to records. Only the records
that parts share are gathered in a shuffle.
"""

from __future__ import annotations

import csv
import io
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.functions.scratch import workspace, written

#: Parts whose states may be broadcast, about 200 bytes each; beyond that the pieces are sorted once more.
MAX_BROADCAST = 200_000

#: A piece and whether a quote is open before it (0 or 1), to that after it and how many levels deeper it ends.
Step = Callable[[str, int], tuple[int, int]]


@dataclass(frozen=True)
class Grammar:
    """How records are told: one ends after a piece that leaves no quote open, at the depth ``level``."""

    separator: str
    level: int
    step: Step
    blank: str  # characters of which a piece says nothing


def quoted_lines(field_separator: str, quote: str = '"') -> Grammar:
    """Lines of a table: a field that begins with a quote ends at the next one that is not doubled."""
    closing = re.compile(f"(?:[^{quote}]|{quote}{quote})*?{quote}(?!{quote})", re.S)

    def step(line: str, inside: int) -> tuple[int, int]:
        if quote not in line:
            return inside, 0
        at = 0
        while True:
            if inside or line.startswith(quote, at):
                m = closing.match(line, at if inside else at + 1)
                if not m:
                    return 1, 0
                inside, at = 0, m.end()
            at = line.find(field_separator, at)
            if at < 0:
                return 0, 0
            at += len(field_separator)

    return Grammar("\n", 0, step, "\ufeff\r")


_MARKS = re.compile(r'[\[\]{}"]|\\.?', re.S)


def array_elements() -> Grammar:
    """Pieces between commas: those at depth 1 and outside of strings end the elements of an array."""

    def step(piece: str, inside: int) -> tuple[int, int]:
        depth = 0
        for m in _MARKS.finditer(piece):
            c = m.group()
            if c == '"':
                inside = 1 - inside
            elif not inside:
                depth += (c in "[{") - (c in "]}")
        return inside, depth

    return Grammar(",", 1, step, "\ufeff \t\r\n")


def _pieces(spark: SparkSession, path: str, grammar: Grammar) -> DataFrame:
    meta = F.col("_metadata")
    rows = spark.read.option("lineSep", grammar.separator).option("recursiveFileLookup", "true").text(path)
    return rows.select(meta["file_path"].alias("path"), meta["file_block_start"].alias("part"), "value", F.monotonically_increasing_id().alias("at"))


_SUMMARY = "path string, part bigint, guess int, mode int, depth int, at_first bigint, opens boolean, rel int, n bigint"
_STATES = "path string, part bigint, mode int, depth int, before bigint, head bigint"


def _batch(rows: list[tuple], ddl: str):
    import pyarrow as pa

    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    names, types = zip(*(x.split(" ") for x in ddl.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


class _Part:
    """What a part does to each state in which it may begin."""

    def __init__(self, path: str, part: int):
        self.key, self.modes, self.depths = (path, part), [0, 1], [0, 0]
        self.ends: tuple[Counter, Counter] = (Counter(), Counter())  # by depth, pieces that end outside of quotes
        self.pieces, self.first, self.opens = 0, None, None

    def take(self, piece: str, grammar: Grammar) -> None:
        if self.first is None and (told := piece.strip(grammar.blank)):
            self.first, self.opens = self.pieces, told[0] == "["
        self.pieces += 1
        for guess in (0, 1):
            self.modes[guess], deeper = grammar.step(piece, self.modes[guess])
            self.depths[guess] += deeper
            if not self.modes[guess]:
                self.ends[guess][self.depths[guess]] += 1

    def rows(self) -> list[tuple]:
        told = [(guess, self.modes[guess], self.depths[guess], self.first, self.opens) for guess in (0, 1)]
        return [(*self.key, *told[guess], rel, n) for guess in (0, 1) for rel, n in (self.ends[guess] or {0: 0}).items()]


def _summaries(grammar: Grammar):
    def summed(batches) -> Iterator:
        own, out = None, []
        for batch in batches:
            for path, part, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own is None or own.key != (path, part):
                    out += own.rows() if own else []
                    own = _Part(path, part)
                own.take(piece, grammar)
            if out:
                yield _batch(out, _SUMMARY)
                out = []
        if own:
            yield _batch(own.rows(), _SUMMARY)

    return summed


#: A depth from which no piece comes back: a file that is no array is one record.
_NEVER = 1 << 20


def _carried(level: int):
    """The state at the beginning of each part, the records that end before it, and the file's first record that is not blank, from the part that holds it."""

    def carry(batches) -> Iterator:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        now = head = None
        mode = depth = before = 0
        for (path, part), held in groupby(rows, key=lambda r: r[:2]):
            told = list(held)  # a few rows for each depth
            _, _, _, _, _, first, opens, _, _ = told[0]
            if path != now:
                now, head, mode, depth, before = path, None, 0, (_NEVER if level and opens is False else 0), 0
            if head is None and first is not None:
                head = before + first
            yield _batch([(path, part, mode, depth, before, head)], _STATES)
            own = [r for r in told if r[2] == mode]
            before += sum(r[8] for r in own if depth + r[7] == level)
            mode, depth = own[0][3], depth + own[0][4]

    return carry


_FOUND = "path string, part bigint, record bigint, head boolean, whole boolean, closes boolean, value string"


def _joined(grammar: Grammar):
    """Records of a part, and its share of the records at its ends; ``closes`` tells the end of a file's outermost level."""

    def join(batches) -> Iterator:
        key, held, out, size = None, [], [], 0
        mode = depth = record = 0
        whole, head = True, None

        def ended(own: bool, closes: bool) -> tuple:
            return (*key, record, record == head, own, closes, grammar.separator.join(held))

        for batch in batches:
            for path, part, piece, m, d, b, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (path, part):
                    if held:
                        out.append(ended(False, not mode and depth < grammar.level))
                    key, held, mode, depth, record, head = (path, part), [], m, d, b, h
                    whole = part == 0 or (not mode and depth == grammar.level)
                held.append(piece)
                mode, deeper = grammar.step(piece, mode)
                depth += deeper
                if not mode and depth == grammar.level:
                    out.append(ended(whole, False))
                    size += len(out[-1][-1])
                    held, whole, record = [], True, record + 1
                if size > 1 << 24 or len(out) > 10_000:
                    yield _batch(out, _FOUND)
                    out, size = [], 0
        if held:
            out.append(ended(False, not mode and depth < grammar.level))
        if out:
            yield _batch(out, _FOUND)

    return join


def read_records(spark: SparkSession, path: str, grammar: Grammar) -> DataFrame:
    """path, record (its number in the file, from 0), head (it is the first that is not blank), closes and value of every record, also blank ones.

    A record that nothing ends, as after a quote that is never closed, goes to the file's end. A
    record lies in one row, so none may pass 2 GB.
    """
    pieces = _pieces(spark, path, grammar)
    found = pieces.select("path", "part", "value").mapInArrow(_summaries(grammar), _SUMMARY)
    by_file = found.repartition("path").sortWithinPartitions("path", "part", "guess", "rel")
    states = written(by_file.mapInArrow(_carried(grammar.level), _STATES), workspace(spark, "parts"), small=True)
    columns = ["path", "part", "value", "mode", "depth", "before", "head"]
    if states.count() <= MAX_BROADCAST:
        placed = pieces.join(F.broadcast(states), ["path", "part"]).select(*columns)  # each piece stays where it is read
    else:
        placed = pieces.join(states, ["path", "part"]).repartition("path", "part").sortWithinPartitions("path", "part", "at").select(*columns)
    joined = placed.mapInArrow(_joined(grammar), _FOUND)
    told = ["path", "record", "head", "closes", "value"]
    parts = F.array_sort(F.collect_list(F.struct("part", "value")))
    shared = joined.where("NOT whole").groupBy("path", "record").agg(F.max("head").alias("head"), F.max("closes").alias("closes"), parts.alias("x"))
    return joined.where("whole").select(*told).unionByName(shared.withColumn("value", F.array_join(F.col("x.value"), grammar.separator)).select(*told))


def table_records(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """path, record, head and value of the records of tables, without empty lines; a carriage return before a line feed counts to it."""
    rows = read_records(spark, path, quoted_lines(separator))
    text = F.regexp_replace(F.regexp_replace("value", "\r(?=\n|$)", ""), "^\ufeff", "")
    return rows.select("path", "record", "head", text.alias("value")).where(F.col("value") != "")


def _safe_names(names: list[str]) -> list[str]:
    """Names of columns as Spark's reader gives them: by their place where empty, and with it where repeated."""
    lower = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def read_quoted_table(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """Tables with a header, as text columns; quoted fields may hold separators, doubled quotes and line feeds.

    The first record of each file is its header; that of the first file by name gives the columns.
    Fields too many are left out, and missing ones are null, as are empty ones without quotes.
    """
    records = table_records(spark, path, separator)
    head = records.where("head").select("path", "value").orderBy("path").first()
    if head is None:
        return spark.createDataFrame([], "_c0 string")
    names = _safe_names(next(csv.reader(io.StringIO(head.value), delimiter=separator)))
    fields = ", ".join(f"`_{i}` string" for i in range(len(names)))
    options = {"sep": separator, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxColumns": str(max(20_480, len(names) + 1))}
    rows = records.where("NOT head").select(F.from_csv("value", fields, options).alias("x"))
    return rows.select(*[F.col("x")[f"_{i}"].alias(n) for i, n in enumerate(names)])


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """path, place (from 0) and json of the elements of files that hold a JSON array each; another file is one element.

    Elements are told apart by brackets and strings only, and not checked further.
    """
    rows = read_records(spark, path, array_elements())
    opened = F.when(F.col("record") == 0, F.regexp_replace("value", "^\ufeff?[ \t\r\n]*\\[?", "")).otherwise(F.col("value"))
    closed = F.when(F.col("closes"), F.regexp_replace("value", "\\][ \t\r\n]*$", "")).otherwise(F.col("value"))
    inner = rows.withColumn("value", opened).withColumn("value", closed)
    trimmed = F.regexp_replace("value", "^[ \t\r\n]+|[ \t\r\n]+$", "")
    return inner.select("path", F.col("record").alias("place"), trimmed.alias("json")).where(F.col("json") != "")
