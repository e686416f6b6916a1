"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.functions.scratch import delete_path, read_text, shared_dir, workspace, write_text, written

__all__ = ["ascii_lower", "delete_path", "document_key", "indexes", "let", "null_safe_join", "read_text", "running", "shared_dir", "table", "workspace", "write_text", "written"]

#: ASCII white space, as a Java character class and as the characters themselves.
WS_CLASS = r"[\x20\x09-\x0D]"
WS_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``, so that Catalyst cannot evaluate it for every use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def indexes(size: Column) -> Column:
    """0, 1, ... size - 1; empty for 0."""
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))


#: Elements of one chunk of ``running``.
CHUNK = 128


def running(items: Column, kind: str, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The states before each element, as ``step`` carries them from ``zero`` over the array; of the type ``kind``.

    An array cannot grow inside ``aggregate`` without being copied, so states are gathered in chunks:
    the work is that of the elements times a chunk's length, and a small share of their square.
    """
    none = F.array().cast(f"array<{kind}>")

    def gathered(some: Column, first: Column, after: Callable[[Column, Column], Column]) -> Column:
        start = F.struct(first.cast(kind).alias("s"), none.alias("seen"))
        return F.aggregate(
            some,
            start,
            lambda acc, x: F.struct(after(acc["s"], x).cast(kind).alias("s"), F.concat(acc["seen"], F.array(acc["s"])).alias("seen")),
            lambda acc: acc["seen"],
        )

    def over(xs: Column) -> Column:
        chunks = F.transform(indexes(F.ceil(F.size(xs) / CHUNK).cast("int")), lambda j: F.slice(xs, j * CHUNK + 1, F.lit(CHUNK)))
        whole = lambda s, chunk: F.aggregate(chunk, s, lambda a, x: step(a, x).cast(kind))
        return let(chunks, lambda cs: F.flatten(F.zip_with(cs, gathered(cs, zero, whole), lambda chunk, s: gathered(chunk, s, step))))

    return let(items, over)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys of the same name, where null equals null; the left side's keys stay."""
    renamed = right.select([F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = None
    for key in keys:
        same = left[key].eqNullSafe(renamed[f"__r_{key}"])
        condition = same if condition is None else condition & same
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def document_key(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and ``__h``, the text's hash.

    The pair (doc_id, __h) tells rows of one doc_id and different texts apart; rows that agree in
    both get the same decisions in every operator here.
    """
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("__h", F.xxhash64("text"))
