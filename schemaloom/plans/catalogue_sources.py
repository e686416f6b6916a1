"""Queries of the readers of large files, archives and the growing store, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.functions import text as tx
from schemaloom.functions.embed import LetterEmbedder, VectorRuns
from schemaloom.functions.scratch import workspace
from schemaloom.operators import joins
from schemaloom.plans.registry import register, table
from schemaloom.sources import archives, parallel, readers, writers


@register(
    """
SELECT p_partkey AS id, p_name || chr(10) || chr(10) || p_type AS text, 'say "' || p_brand || '", twice' AS said, CASE WHEN p_size > 9 THEN p_type END AS kind
FROM part
"""
)
def quoted_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table whose fields hold line feeds, quotes and separators, written and read in parts."""
    path = workspace(spark, "quoted")
    text = F.concat_ws("\n\n", "p_name", "p_type")
    said = F.concat(F.lit('say "'), F.col("p_brand"), F.lit('", twice'))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("text"), said.alias("said"), F.when(F.col("p_size") > 9, F.col("p_type")).alias("kind"))
    writers.write_table(rows, path)
    return readers.read_table(spark, path).withColumn("id", F.col("id").cast("bigint"))


def _arrays(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a JSON array file of the suppliers of each nation."""
    path = workspace(spark, "arrays")
    told = F.struct(F.col("s_suppkey").alias("id"), F.concat(F.col("s_name"), F.lit(', "[x]" {')).alias("name"), F.array("s_nationkey", F.lit(1)).alias("nested"))
    rows = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.to_json(F.sort_array(F.collect_list(told))).alias("json"))  # a nation's are few
    writers.write_by_key(rows, path, "s_nationkey", "json")
    return path


@register("SELECT s_suppkey AS id, s_name || ', \"[x]\" {' AS name, s_nationkey::BIGINT AS nation FROM supplier")
def json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of JSON array files as rows."""
    rows = readers.read_json_array(spark, _arrays(spark, sf_dir))
    return rows.select("id", "name", F.col("nested")[0].alias("nation"))


@register(
    """
SELECT s_nationkey::BIGINT AS nation, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::BIGINT AS place, s_suppkey::BIGINT AS id FROM supplier
"""
)
def json_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of elements in their files."""
    rows = parallel.json_elements(spark, _arrays(spark, sf_dir))
    return rows.select(F.get_json_object("json", "$.nested[0]").cast("bigint").alias("nation"), "place", F.get_json_object("json", "$.id").cast("bigint").alias("id"))


@register(
    """
SELECT 'nation-' || s_nationkey AS archive, 'suppliers/' || s_suppkey || '.txt' AS member, s_name || chr(10) || s_suppkey AS content, length(s_name || chr(10) || s_suppkey)::BIGINT AS bytes
FROM supplier
"""
)
def archive_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zip files written by tasks, one for each nation, and read again member by member."""
    path = workspace(spark, "zips")
    member, content = F.concat(F.lit("suppliers/"), F.col("s_suppkey"), F.lit(".txt")), F.concat_ws("\n", "s_name", F.col("s_suppkey").cast("string"))
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("nation-"), F.col("s_nationkey")).alias("a"), member.alias("m"), content.alias("c"))
    archives.write_archives(rows, path, "a", "m", "c")
    found = archives.read_archives(spark, path)
    return found.select(F.regexp_extract("archive", r"([^/]*)\.zip$", 1).alias("archive"), "member", F.decode("content", "UTF-8").alias("content"), F.octet_length("content").cast("bigint").alias("bytes"))


@register("SELECT n_nationkey::VARCHAR AS name, n_regionkey <> 0 AS good, CASE WHEN n_regionkey <> 0 THEN n_name END AS nation FROM nation")
def json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON file for each nation, some of them broken, read with what is wrong."""
    path = workspace(spark, "json-files")
    whole = F.to_json(F.struct(F.col("n_name").alias("name")))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_regionkey") == 0, F.substring(whole, 1, 5)).otherwise(whole).alias("json"))
    writers.write_by_key(rows, path, "n_nationkey", "json")
    files = readers.read_json_files(spark, f"{path}/*")
    return files.select(F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).alias("name"), F.col("error").isNull().alias("good"), F.get_json_object("json", "$.name").alias("nation"))


@register(
    """
SELECT 'kept' AS what, c_custkey::BIGINT AS id, c_name AS name FROM customer WHERE c_custkey % 5 NOT IN (1, 2)
UNION ALL SELECT 'blank', count(*), NULL FROM customer WHERE c_custkey % 5 = 1
UNION ALL SELECT 'broken', count(*), NULL FROM customer WHERE c_custkey % 5 = 2
"""
)
def tolerant_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with blank and broken ones between them: what is read, and how many are left out."""
    path = workspace(spark, "lines")
    line = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))
    kind = F.col("c_custkey") % 5
    lines = table(spark, sf_dir, "customer").select(F.when(kind == 1, F.lit(" \t")).when(kind == 2, F.concat(line, F.lit("]"))).otherwise(line).alias("line"))
    writers.write_json_lines(lines, path, "line")
    left = readers.rejected_lines(spark, path)
    out = left.select(F.inline(F.array(F.struct(F.lit("blank").alias("what"), F.col("n_blank").alias("id")), F.struct(F.lit("broken").alias("what"), F.col("n_broken").alias("id")))))
    kept = readers.read_json_lines(spark, path, ["id", "name"]).select(F.lit("kept").alias("what"), F.col("id").cast("bigint").alias("id"), "name")
    return kept.unionByName(out.withColumn("name", F.lit(None).cast("string")))


@register(
    """
WITH l AS (SELECT p_partkey, p_brand || '.' || p_type || ' (string): ' || CASE WHEN p_partkey % 50 = 0 THEN p_name ELSE p_brand END AS text FROM part),
a AS (SELECT 1 AS addition, text FROM l WHERE p_partkey % 3 = 0 UNION ALL SELECT 2, text FROM l WHERE p_partkey % 2 = 0 UNION ALL SELECT 3, text FROM l)
SELECT text, min(addition)::BIGINT AS addition, length(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'))::BIGINT AS letters FROM a GROUP BY text
"""
)
def growing_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store holds after three additions that overlap, and which of them embedded each text."""
    part = table(spark, sf_dir, "part")
    told = F.when(F.col("p_partkey") % 50 == 0, F.col("p_name")).otherwise(F.col("p_brand"))
    lines = part.select("p_partkey", tx.render_line(F.col("p_brand"), F.col("p_type"), F.lit("string"), told).alias("text"))
    path = workspace(spark, "store")
    for some in ("p_partkey % 3 = 0", "p_partkey % 2 = 0", "true"):
        VectorRuns(spark, path, LetterEmbedder(), fanout=3).add(lines.where(some))
    held = VectorRuns(spark, path, LetterEmbedder()).contents()
    return held.select("text", "addition", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).cast("bigint").alias("letters"))


@register(
    """
SELECT o.o_orderkey AS k, coalesce(l.q, -1.0) AS quantity, l.q IS NOT NULL AS known
FROM orders o LEFT JOIN (SELECT l_orderkey, arg_max(l_quantity, {'n': l_linenumber, 'q': l_quantity}) AS q FROM lineitem WHERE l_linenumber > 1 GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
"""
)
def last_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup in a table of repeated keys, of which the last row counts."""
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").cast("double").alias("quantity"), "l_linenumber")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    found = joins.lookup(rows, lines, "k", "quantity", F.lit(-1.0), ordinal="l_linenumber")
    return found.withColumn("known", F.col("quantity") >= 0)


@register(
    """
SELECT p_partkey AS test_id, CASE WHEN p_partkey % 7 NOT IN (1, 2) THEN 0 END::INTEGER AS line_ord, CASE WHEN p_partkey % 7 NOT IN (1, 2) THEN p_brand END AS source_node,
       CASE WHEN p_partkey % 7 NOT IN (1, 2) THEN p_name END AS target_description,
       CASE p_partkey % 7 WHEN 1 THEN 'an empty mapping' WHEN 2 THEN 'record 1 has 1 fields, not 2' END AS error
FROM part
"""
)
def mapping_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings of which some cannot be read: these are rows that say why, and the rest is read."""
    part, kind = table(spark, sf_dir, "part"), F.col("p_partkey") % 7
    source = tx.render_line(F.col("p_brand"), F.lit("name"), F.lit("string"), F.lit("of a part"))
    target = tx.render_line(F.lit("Part"), F.lit("label"), F.lit("string"), F.col("p_name"))
    text = F.concat(F.lit("source\ttarget\n"), writers.quoted(source), F.when(kind == 2, F.lit("")).otherwise(F.concat(F.lit("\t"), writers.quoted(target))))
    cases = part.select(F.col("p_partkey").alias("test_id"), F.when(kind == 1, F.lit("")).otherwise(text).alias("harmonized_mapping"))
    return readers.mapping_results(cases).select("test_id", "line_ord", "source_node", "target_description", "error")
