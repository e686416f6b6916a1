"""Profiles of raw tables: what kind of values a column has, and how they are distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemaloom.functions.scratch import workspace, written
from schemaloom.functions.text import py_strip, typed_number

# Cells that count as missing where a table is read from text.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def null_missing(rows: DataFrame) -> DataFrame:
    """Text cells that stand for missing values as nulls."""
    text = [c for c, kind in rows.dtypes if kind == "string"]
    return rows.withColumns({c: F.when(~F.col(f"`{c}`").isin(MISSING), F.col(f"`{c}`")) for c in text})


def split_values(cell: Column, delimiters: list[str]) -> Column:
    """The stripped parts of a multi-value cell, without blank ones and ``na``."""
    escaped = "|".join("\\" + d if not d.isalnum() and not d.isspace() else d for d in delimiters)
    parts = F.transform(F.split(cell, escaped, -1), py_strip)
    return F.filter(parts, lambda x: (x != "") & (F.lower(x) != "na"))


def value_counts(rows: DataFrame, keys: list[str], value: str, ordinal: str | None = None) -> DataFrame:
    """How often each value occurs, nulls left out, most frequent first; ties by first occurrence or value."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), (F.min(ordinal) if ordinal else F.lit(0)).alias("first"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "first", value)
    return counted.withColumn("rk", F.row_number().over(order)).drop("first")


def ranked_counts(rows: DataFrame, keys: list[str], value: str, ordinal: str | None = None) -> DataFrame:
    """The rows of ``value_counts`` for keys with any number of distinct values: no task holds all of one key.

    The counts are sorted over ranges and written to the shared folder; a row's rank is its place in
    its range plus the number of the key's rows in earlier ranges, of which there are few.
    """
    spark = rows.sparkSession
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), (F.min(ordinal) if ordinal else F.lit(0)).alias("first"))
    order = [F.desc("n"), "first", value]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    ranged = counted.repartitionByRange(parts, *keys, *order).withColumn("__part", F.spark_partition_id())
    ranged = written(ranged, workspace(spark, "ranks"))  # the ranges are of a sample, and must not be drawn anew
    sizes = ranged.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    place = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))
    return ranged.withColumn("__place", place).join(offsets, same).select(*keys, value, "n", (F.col("__before") + F.col("__place")).alias("rk"))


def histogram(rows: DataFrame, keys: list[str], value: str, bins: int = 5) -> DataFrame:
    """Counts in ``bins`` ranges of equal width between a key's smallest and largest value; the last one is closed.

    Where all values are equal the range reaches half a unit to both sides. One value alone is one
    bin of its own; keys without values have no rows. Returns keys, bin (from 1), low, high, n.
    """
    own = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).withColumn("__v", F.col(value).cast("double"))
    edges = own.groupBy(*keys).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count(F.lit(1)).alias("__n"))
    flat = F.col("__lo") == F.col("__hi")
    edges = edges.withColumns({"__a": F.when(flat & (F.col("__n") > 1), F.col("__lo") - 0.5).otherwise(F.col("__lo")), "__b": F.when(flat & (F.col("__n") > 1), F.col("__hi") + 0.5).otherwise(F.col("__hi"))})
    edges = edges.withColumn("__bins", F.when(F.col("__n") == 1, F.lit(1)).otherwise(F.lit(bins)))
    joined = own.join(edges, keys) if keys else own.join(F.broadcast(edges))  # without keys one row
    place = F.floor((F.col("__v") - F.col("__a")) / (F.col("__b") - F.col("__a")) * bins) + 1
    at = F.when(F.col("__n") == 1, F.lit(1)).otherwise(F.least(place, F.lit(bins))).cast("int")
    counted = joined.select(*keys, at.alias("bin")).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    every = edges.select(*keys, "__a", "__b", "__bins", F.explode(F.sequence(F.lit(1), F.col("__bins"))).alias("bin"))
    step = (F.col("__b") - F.col("__a")) / F.col("__bins")
    full = every.join(counted, [*keys, "bin"], "left")
    return full.select(*keys, "bin", (F.col("__a") + step * (F.col("bin") - 1)).alias("low"), (F.col("__a") + step * F.col("bin")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def bin_label(low: Column, high: Column) -> Column:
    return F.when(low == high, low.cast("string")).otherwise(F.format_string("%.2f-%.2f", low, high))


def column_kind(n_numbers: Column, n_strings: Column) -> Column:
    """number, string, mixed or unknown."""
    return (
        F.when((n_numbers > 0) & (n_strings > 0), F.lit("mixed"))
        .when(n_numbers > 0, F.lit("number"))
        .when(n_strings > 0, F.lit("string"))
        .otherwise(F.lit("unknown"))
    )


def cells(rows: DataFrame, columns: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """The table in long form: kept columns, column_ord, column_name, cell (as text)."""
    own = columns or [c for c in rows.columns if c not in (keep or [])]
    each = F.array(*[F.struct(F.lit(i).alias("column_ord"), F.lit(py_name(c)).alias("column_name"), F.col(f"`{c}`").cast("string").alias("cell")) for i, c in enumerate(own)])
    return rows.select(*(keep or []), F.explode(each).alias("c")).select(*(keep or []), "c.*")


def py_name(column: str) -> str:
    return column.strip().replace("\t", "")


def _values(long: DataFrame, keys: list[str], delimiters: tuple[str, ...]) -> DataFrame:
    """The parts of all cells as numbers or strings."""
    values = long.where(F.col("cell").isNotNull()).select(*keys, F.explode(split_values(F.col("cell"), list(delimiters))).alias("text"))
    return values.withColumn("number", typed_number(F.col("text"))).withColumn("string", F.when(F.col("number").isNull(), F.col("text")))


def profile_bins(rows: DataFrame, columns: list[str] | None = None, keep: list[str] | None = None, bins: int = 5, delimiters: tuple[str, ...] = (";", "|")) -> DataFrame:
    """The bins of ``column_profile`` as rows, for columns with any number of distinct strings.

    Returns kept columns, column_ord, column_name, kind (``number``, ``string`` or ``null``), place
    (from 1, by kind), label and n. No row or task holds all strings of a column.
    """
    keys = [*(keep or []), "column_ord", "column_name"]
    long = cells(rows, columns, keep)
    values = _values(long, keys, delimiters)
    bigint = lambda c: F.col(c).cast("bigint")
    numbers = histogram(values, keys, "number", bins).select(*keys, F.lit("number").alias("kind"), bigint("bin").alias("place"), bin_label(F.col("low"), F.col("high")).alias("label"), bigint("n").alias("n"))
    strings = ranked_counts(values, keys, "string").select(*keys, F.lit("string").alias("kind"), bigint("rk").alias("place"), F.col("string").alias("label"), "n")
    nulls = long.where(F.col("cell").isNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return numbers.unionByName(strings).unionByName(nulls.select(*keys, F.lit("null").alias("kind"), F.lit(1).cast("bigint").alias("place"), F.lit("NA").alias("label"), "n"))


def column_profile(rows: DataFrame, columns: list[str] | None = None, keep: list[str] | None = None, bins: int = 5, delimiters: tuple[str, ...] = (";", "|")) -> DataFrame:
    """For each column: kind, numbers of values, the distinct strings by frequency, and the histogram.

    Bins are those of the numbers, then the strings with their counts, then ``NA`` with the nulls
    where there are any. One pass makes the long form; each measure is a grouped aggregate of it.
    A column is one row with all its distinct strings, as a model has them; ``profile_bins`` has a row for each.
    """
    keys = [*(keep or []), "column_ord", "column_name"]
    long = cells(rows, columns, keep)
    nulls = long.groupBy(*keys).agg(F.count_if(F.col("cell").isNull()).alias("n_null"), F.count(F.lit(1)).alias("n_rows"))
    values = _values(long, keys, delimiters)
    kinds = values.groupBy(*keys).agg(F.count("number").alias("n_numbers"), F.count("string").alias("n_strings"))
    strings = value_counts(values, keys, "string").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rk", "string", "n"))).alias("strings"))
    numbers = histogram(values, keys, "number", bins).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", bin_label(F.col("low"), F.col("high")).alias("label"), "n"))).alias("numbers"))
    joined = nulls.join(kinds, keys, "left").join(strings, keys, "left").join(numbers, keys, "left")
    zero = F.lit(0).cast("bigint")
    n_numbers, n_strings = F.coalesce("n_numbers", zero), F.coalesce("n_strings", zero)
    labels = F.concat(
        F.coalesce(F.transform("numbers", lambda x: x["label"]), F.array().cast("array<string>")),
        F.coalesce(F.transform("strings", lambda x: x["string"]), F.array().cast("array<string>")),
        F.when(F.col("n_null") > 0, F.array(F.lit("NA"))).otherwise(F.array().cast("array<string>")),
    )
    counts = F.concat(
        F.coalesce(F.transform("numbers", lambda x: x["n"]), F.array().cast("array<bigint>")),
        F.coalesce(F.transform("strings", lambda x: x["n"]), F.array().cast("array<bigint>")),
        F.when(F.col("n_null") > 0, F.array("n_null")).otherwise(F.array().cast("array<bigint>")),
    )
    return joined.select(
        *keys,
        column_kind(n_numbers, n_strings).alias("type"),
        "n_rows",
        "n_null",
        n_numbers.alias("n_numbers"),
        n_strings.alias("n_strings"),
        F.transform("strings", lambda x: x["string"]).alias("values"),
        labels.alias("bins"),
        counts.alias("counts"),
    )


def profile_model(profile: DataFrame, key: str) -> DataFrame:
    """A profile as a simple model of one unnamed node: (key, json)."""
    prop = F.struct(
        F.col("column_name").alias("name"),
        F.col("column_name").alias("description"),
        "type",
        "values",
        F.struct("bins", "counts").alias("histogram"),
    )
    listed = profile.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("column_ord", prop.alias("p")))).alias("ps"))
    node = F.struct(F.lit("object").alias("type"), F.lit("").alias("name"), F.transform("ps", lambda x: x["p"]).alias("properties"))
    return listed.select(key, F.to_json(F.struct(F.array(node).alias("nodes"))).alias("json"))
