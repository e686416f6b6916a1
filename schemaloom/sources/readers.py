"""Readers: model files, test cases as JSON lines, mappings and tables as text."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schemaloom.functions.text import parse_line, py_strip
from schemaloom.operators.profile import null_missing
from schemaloom.sources.parallel import json_elements, read_quoted_table


def read_json_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files: path, json, and error where the text is no JSON (json is null then)."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    good = F.try_parse_json("raw").isNotNull() | F.from_json("raw", "map<string,string>").isNotNull()
    return files.select("path", F.when(good, F.col("raw")).alias("json"), F.when(~good, F.lit("not JSON")).alias("error"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are not empty, with their file and their number in it, from 1.

    Files are read in parts: a line's number is its place in its part, in the order of reading, after
    the lines of the file's earlier parts. Lines end at line feeds, with or without a carriage return.
    """
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(meta["file_path"].alias("path"), meta["file_block_start"].alias("part"), F.regexp_replace("value", "\r$", "").alias("line"), F.monotonically_increasing_id().alias("at"))
    parts = lines.groupBy("path", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("part")) - F.col("n")  # a row for each part
    inside = F.row_number().over(Window.partitionBy("path", "part").orderBy("at"))
    numbered = lines.withColumn("inside", inside).join(parts.select("path", "part", before.alias("before")), ["path", "part"])
    return numbered.where(F.col("line") != "").select("path", (F.col("before") + F.col("inside")).alias("line_no"), "line")


def json_object(line: Column) -> Column:
    """The fields of a text that is one JSON object and nothing else, as texts; null for any other text."""
    both = F.from_json(F.concat(F.lit("["), line, F.lit(",{}]")), "array<map<string,string>>", {"allowSingleQuotes": "false"})  # what follows an object would stand before the second one
    return F.when(F.size(both) == 2, both[0])


def _fields(line: Column, names: list[str]) -> list[Column]:
    return [F.get_json_object(line, f"$.{n}").alias(n) for n in names]


def read_json_lines(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Named top-level fields of JSON lines as text, whether they hold strings or objects; blank and broken lines are left out."""
    lines = spark.read.text(path).select(F.col("value").alias("line")).where(py_strip(F.col("line")) != "")
    return lines.where(json_object(F.col("line")).isNotNull()).select("line", *_fields(F.col("line"), fields))


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """How many lines ``read_json_lines`` leaves out: n_blank and n_broken."""
    lines = spark.read.text(path)
    blank = py_strip(F.col("value")) == ""
    return lines.agg(F.count_if(blank).alias("n_blank"), F.count_if(~blank & json_object(F.col("value")).isNull()).alias("n_broken"))


def benchmark_cases(lines: DataFrame) -> DataFrame:
    """Test cases of JSON lines: models given as objects or as JSON text, the mapping, and the target's key.

    ``lines`` has path, line_no and line, as ``read_lines`` gives.
    """
    named = ["input_source_model", "input_target_model", "harmonized_mapping"]
    cases = lines.where(json_object(F.col("line")).isNotNull()).select("path", "line_no", "line", *_fields(F.col("line"), named))
    return cases.select(
        F.concat_ws(":", "path", "line_no").alias("test_id"),
        "path",
        "line_no",
        "line",
        F.col("input_source_model").alias("source_model"),
        F.col("input_target_model").alias("target_model"),
        "harmonized_mapping",
        F.sha2("input_target_model", 256).alias("target_key"),
    )


def _mapping_records(text: str | None) -> list[list[str]]:
    """The records of a mapping after its header; a mapping without one, or with a record of other than two fields, is an error."""
    records = csv.reader(io.StringIO(text or ""), delimiter="\t")
    if next(records, None) is None:
        raise ValueError("an empty mapping")
    found = list(records)
    for n, record in enumerate(found):
        if len(record) != 2:
            raise ValueError(f"record {n + 1} has {len(record)} fields, not 2")
    return found


def mapping_results(cases: DataFrame, key: str = "test_id", mapping: str = "harmonized_mapping") -> DataFrame:
    """The known mappings of each case as ``expected_mappings`` gives them, and one row with ``error`` for a case that has none that can be read.

    A bad case keeps no other from being read: its row has no line_ord, and null lines.
    """

    def read(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out: list[tuple] = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    out += [(k, n, *record, None) for n, record in enumerate(_mapping_records(text))]
                except (ValueError, csv.Error) as fault:
                    out.append((k, None, None, None, str(fault)))
            types = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.string()]
            names = [key, "line_ord", "s", "t", "error"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    kind = cases.schema[key].dataType.simpleString()
    raw = cases.select(key, mapping).mapInArrow(read, f"{key} {kind}, line_ord int, s string, t string, error string")
    told = [F.when(F.col("error").isNull(), parse_line(F.col(side[0]))[f]).alias(f"{side}_{f}") for side in ("source", "target") for f in ("node", "property", "type", "description")]
    return raw.select(key, "line_ord", *told, "error")


def expected_mappings(cases: DataFrame, key: str = "test_id", mapping: str = "harmonized_mapping") -> DataFrame:
    """The known mappings of each case, both lines parsed; quoting is that of a CSV reader.

    The first record is a header whatever it says. Lines of another form are four empty strings and
    count. A record that has not two fields is an error and fails the job, as does an empty mapping;
    ``mapping_results`` gives such cases as rows.
    """
    found = mapping_results(cases, key, mapping)
    fault = F.raise_error(F.concat(F.lit("case "), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(": "), F.col("error")))
    return found.where(F.when(F.col("error").isNull(), F.lit(True)).otherwise(fault.cast("boolean"))).drop("error")  # a filter, as an unused column would be pruned


def read_table(spark: SparkSession, path: str, separator: str | None = None, multi_line: bool = True) -> DataFrame:
    """A table as text with a header; names are stripped and freed of tabs, and missing values are null.

    Quoted fields may hold line feeds; large files are read in parts all the same. Without
    ``multi_line`` no field holds a line feed, and one scan is enough.
    """
    own = separator or ("\t" if path.lower().rstrip("/").endswith(".tsv") else ",")
    if multi_line:
        rows = read_quoted_table(spark, path, own)
    else:
        rows = spark.read.csv(path, header=True, sep=own, escape='"', quote='"')
    return null_missing(rows.toDF(*[c.strip().replace("\t", "") for c in rows.columns]))


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """A row for each element of JSON array files, large ones read in parts, with the columns that their elements have."""
    elements = json_elements(spark, path).select("json")
    texts = getattr(elements._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(spark._jsparkSession.read().json(texts), spark)


def model_folders(spark: SparkSession, root: str, source: str = "source", target: str = "target", expected: str = "expected") -> DataFrame:
    """Folders that hold all three files of a test case: folder, source_model, target_model, harmonized_mapping.

    Files are told apart by their names' beginning.
    """
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    named = files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"), "value")
    pick = lambda p: F.max(F.when(F.startswith("name", F.lit(p)), F.col("value")))
    grouped = named.groupBy("folder").agg(pick(source).alias("source_model"), pick(target).alias("target_model"), pick(expected).alias("harmonized_mapping"))
    return grouped.na.drop("any")


def files_matching(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """A listing of files by name: those on a list, or those not on one; nothing is deleted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    if include is not None:
        files = files.where(name.isin(include))
    return files.where(~name.isin(exclude)) if exclude else files


def metric_files(files: DataFrame, mark: str = "custom_metrics") -> DataFrame:
    """The CSV files whose name says that they hold metrics."""
    return files.where(F.endswith(F.lower("path"), F.lit(".csv")) & F.contains("path", F.lit(mark)))


def catalogue_of(spark: SparkSession, paths: dict[str, str], aliases: dict[str, str] | None = None) -> DataFrame:
    """A small table of dictionaries: domain, path; aliases are domains with the path of another."""
    rows = [*paths.items(), *((a, paths[d]) for a, d in (aliases or {}).items())]
    return spark.createDataFrame(rows, "domain string, path string")


def common_elements(rows: DataFrame, url: str) -> DataFrame:
    """Data elements with the fields of their nested lists as lists, and the page that each is from."""
    has = set(rows.columns)
    pull = lambda c, f: (F.transform(c, lambda x: x[f]) if c in has else F.array().cast("array<string>"))
    plain = lambda c: (F.col(c) if c in has else F.lit(None)).cast("string").alias(c)
    return rows.select(
        plain("tinyId"),
        pull("designations", "designation").alias("names"),
        pull("definitions", "definition").alias("definitions"),
        pull("properties", "value").alias("properties"),
        pull("ids", "id").alias("ids"),
        plain("steward"),
        plain("elementType"),
        (F.col("nihEndorsed") if "nihEndorsed" in has else F.lit(None)).cast("boolean").alias("nihEndorsed"),
        F.concat(F.lit(url), plain("tinyId")).alias("source"),
    )


def element_documents(elements: DataFrame, metadata=None) -> DataFrame:
    """Elements as texts to embed: the names as content, all else as JSON metadata unless a function says what."""
    own = metadata or (lambda row: F.to_json(row))
    return elements.select(F.array_join("names", ", ").alias("text"), own(F.struct("*")).alias("metadata"))
