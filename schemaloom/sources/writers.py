"""Writers: JSON lines, tables as text, and mapping sets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.operators.approach import MAPPING_COLUMNS, mapping_rows


def with_metrics(cases: DataFrame, metrics: DataFrame, key: str = "test_id", column: str = "custom_metrics", line: str = "line") -> DataFrame:
    """Each case's JSON line with its metrics as a field; one of that name is replaced.

    The field is put before the closing brace of the object, so nothing else is rewritten. Only in a
    line that has the field already the others are written anew, with equal values.
    """
    packed = metrics.select(key, F.to_json(F.struct(*[c for c in metrics.columns if c != key])).alias("__m"))
    joined = cases.join(packed, key, "left")
    known = F.array_contains(F.map_keys(F.from_json(line, "map<string,string>")), column)
    others = F.to_json(F.map_filter(F.from_json(line, "map<string,variant>"), lambda k, _: k != column))
    body = F.regexp_replace(F.rtrim(F.when(known, others).otherwise(F.col(line))), r"\}\s*$", "")
    comma = F.when(F.regexp_like(body, F.lit(r"^\s*\{\s*$")), F.lit("")).otherwise(F.lit(", "))
    added = F.concat(body, comma, F.lit(f'"{column}": '), F.coalesce("__m", F.lit("null")), F.lit("}"))
    return joined.withColumn(line, added).drop("__m")


def write_json_lines(rows: DataFrame, path: str, line: str | None = None, mode: str = "errorifexists") -> None:
    """Rows as JSON lines, or a column that holds such lines already."""
    if line:
        rows.select(line).write.mode(mode).text(path)
    else:
        rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_by_key(rows: DataFrame, path: str, key: str, line: str, mode: str = "errorifexists") -> None:
    """One folder for each key, such as the target model's hash."""
    rows.select(key, line).write.mode(mode).partitionBy(key).text(path)


def one_file_each(rows: DataFrame, path: str, ordinal: str, line: str, most: int = 10_000, mode: str = "errorifexists") -> None:
    """A folder with one line for each row; for at most so many rows."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} files")
    rows.select(ordinal, line).write.mode(mode).partitionBy(ordinal).text(path)


def flat(rows: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = [f.name for f in rows.schema if f.dataType.typeName() in ("struct", "array", "map", "variant")]
    return rows.withColumns({c: F.to_json(f"`{c}`") for c in nested})


def json_lines_to_table(spark: SparkSession, path: str, out: str, separator: str = ",", mode: str = "errorifexists") -> list[str]:
    """JSON lines as quoted text; the first record's keys are the header, which is returned.

    Blank and broken lines are left out. A key that a later record lacks is an empty field there, and
    one that the first record lacks is an error, before anything is written. Strings are as they are,
    and all other values JSON.
    """
    lines = spark.read.text(path).select("value", F.from_json("value", "map<string,variant>").alias("m")).where("m IS NOT NULL")
    first = lines.select(F.map_keys("m").alias("k")).first()
    if first is None:
        raise ValueError("no records")
    names = list(dict.fromkeys(first.k))
    more = lines.select(F.explode(F.array_except(F.map_keys("m"), F.array(*[F.lit(n) for n in names]))).alias("k")).first()
    if more is not None:
        raise ValueError(f"a record has {more.k}, which the first one has not")

    def field(name: str) -> Column:
        own = F.try_element_at("m", F.lit(name))
        return F.when(F.schema_of_variant(own) == "STRING", F.try_variant_get(own, "$", "string")).when(~F.is_variant_null(own), F.to_json(own)).alias(name)

    write_table(lines.select(*[field(n) for n in names]), out, separator, mode=mode)
    return names


def write_table(rows: DataFrame, path: str, separator: str = ",", null: str = "", header: bool = True, mode: str = "errorifexists") -> None:
    """Rows as quoted text; nested columns as JSON."""
    flat(rows).write.mode(mode).csv(path, sep=separator, header=header, nullValue=null, quote='"', escape='"')


def mapping_text(rows: DataFrame, key: str, source: str, target: str, header: str, ordinal: str | None = None) -> DataFrame:
    """The lines of each key as one quoted, tab-separated text with a header."""
    order = F.col(ordinal) if ordinal else F.lit(0)
    line = F.concat(quoted(F.col(source)), F.lit("\t"), quoted(F.col(target)))
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))).alias("ls"))
    return listed.select(key, F.concat(F.lit(header + "\n"), F.array_join(F.transform("ls", lambda x: x["l"]), "\n"), F.lit("\n")).alias("mapping"))


def quoted(text: Column, separator: str = "\t") -> Column:
    """A field as a CSV writer puts it: quoted only where it must be."""
    needs = F.regexp_like(text, F.lit(f'["\r\n{re.escape(separator)}]'))
    return F.when(needs, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


# The head of a mapping set.
MAPPING_SET_HEAD = {
    "mapping_set_id": "https://w3id.org/sssom/mappings/schemaloom",
    "mapping_set_description": "Suggested mappings between two data models",
    "license": "https://creativecommons.org/licenses/by/4.0/",
}
CURIE_MAP = {
    "EX": "https://example.org/",
    "semapv": "https://w3id.org/semapv/vocab/",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "sssom": "https://w3id.org/sssom/",
}


def mapping_set_head(head: dict[str, str] | None = None, curies: dict[str, str] | None = None) -> list[str]:
    own = ["curie_map:", *(f"  {k}: {v}" for k, v in (curies or CURIE_MAP).items()), *(f"{k}: {v}" for k, v in (head or MAPPING_SET_HEAD).items())]
    return [f"# {x}" for x in own]


def write_mapping_set(spark: SparkSession, suggested: DataFrame, path: str, head: dict[str, str] | None = None, comments: bool = True, mode: str = "errorifexists") -> None:
    """A mapping set as tab-separated text: comment lines with the head, names, and rows in order.

    The rows are sorted and written in parts; the first part begins with the head, so the parts in
    the order of their names are one valid file.
    """
    rows = mapping_rows(suggested)
    names = rows.columns
    line = F.concat_ws("\t", *[quoted(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in names])
    first = [*(mapping_set_head(head) if comments else []), "\t".join(names)]
    top = spark.createDataFrame([(0, i, x, "") for i, x in enumerate(first)], "part int, at int, line string, tie string")
    body = rows.select(F.lit(1).alias("part"), F.lit(0).alias("at"), line.alias("line"), F.concat("subject_id", "object_id").alias("tie"))
    top.unionByName(body).orderBy("part", "at", "tie", "line").select("line").write.mode(mode).text(path)


def mapping_set_lines(suggested: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The rows of a mapping set as tab-separated lines: keys, subject_id, object_id, line."""
    own = suggested.withColumns({f"__k{i}": F.col(k) for i, k in enumerate(keys or [])})
    rows = mapping_rows(own, keep=[f"__k{i}" for i in range(len(keys or []))])
    fields = [quoted(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in rows.columns if not c.startswith("__k")]
    return rows.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys or [])], "subject_id", "object_id", F.concat_ws("\t", *fields).alias("line"))


def mapping_set_texts(suggested: DataFrame, key: str, comments: bool = False, head: dict[str, str] | None = None) -> DataFrame:
    """(key, mapping_set): the suggestions of each key as the text of a whole mapping set; a case's suggestions are few."""
    lines = mapping_set_lines(suggested, [key])
    listed = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("subject_id", "object_id", "line"))).alias("ls"))
    first = [*(mapping_set_head(head) if comments else []), "\t".join(MAPPING_COLUMNS)]
    return listed.select(key, F.concat(F.lit("\n".join(first) + "\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit("\n")).alias("mapping_set"))


def markdown_rows(rows: DataFrame, title: str, measures: list[str]) -> DataFrame:
    """A short report for each row."""
    body = F.concat_ws("\n", *[F.concat(F.lit(f"- {m}: "), F.coalesce(F.col(m).cast("string"), F.lit("not measured"))) for m in measures])
    return rows.withColumn("report", F.concat(F.lit("## "), F.col(title).cast("string"), F.lit("\n\n"), body))
