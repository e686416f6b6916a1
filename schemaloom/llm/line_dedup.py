"""Removal of lines that many documents share: levelled sorted runs of line hashes.

A run holds (line, n): a line's hash and the number of documents in which the run counts it, in
buckets by hash and sorted by hash within each. Every batch is merge-anti-joined with the lines
that the runs know as frequent already, and the rest of its lines is added as a run of level 0;
when a level holds ``fanout`` runs they are merged, two at a time, into one run of the next level.
Runs have the same buckets, so a merge is a full outer sort-merge join of two runs that shuffles
nothing.

The store's folder has a manifest of its levels, by which it is opened again. At the end every
document loses the lines that all runs together know as frequent.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_CHARS, ascii_lower, delete_path, document_key, indexes, let, null_safe_join, read_text, workspace, write_text, written

#: Documents whose lines make a bucket, so that buckets follow the corpus and a small one has few files.
DOCS_A_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 25_000, 4, 20_000


def line_key(line: Column) -> Column:
    """128-bit hash of the stripped line with A-Z in lower case; null for a line of white space only."""
    stripped = F.btrim(line, F.lit(WS_CHARS))
    return F.when(stripped != "", F.md5(ascii_lower(stripped)))


def _with_lines(docs: DataFrame) -> DataFrame:
    keyed = document_key(docs).withColumn("lines", F.split("text", "\n", -1))
    return keyed.withColumn("keys", F.transform("lines", line_key))


def _distinct_keys(keys: Column) -> Column:
    return F.array_compact(F.array_distinct(keys))


class LineRuns:
    """The levelled store of one corpus, in a shared folder.

    A folder that has a manifest is opened as it was left. What a lost driver has left half done is
    in folders that the manifest does not name. Runs are registered as tables of this session for
    their buckets' sake; ``close`` takes the names back.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 2, buckets: int | None = None):
        self.spark, self.path = spark, (path or workspace(spark, "line-runs")).rstrip("/")
        known = read_text(spark, f"{self.path}/manifest.json")
        state = json.loads(known) if known else {}
        self.fanout = state.get("fanout", max(2, fanout))
        self.buckets = state.get("buckets", buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.levels: list[list[str]] = state.get("levels", [])
        self._tables: dict[str, str] = {}

    def _save(self) -> None:
        write_text(self.spark, f"{self.path}/manifest.json", json.dumps({"fanout": self.fanout, "buckets": self.buckets, "levels": self.levels}))

    def _table(self, run: str, batches: bool = False) -> str:
        if run not in self._tables:
            name = f"schemaloom_{uuid.uuid4().hex}"
            columns = "line STRING, n BIGINT, batch INT" if batches else "line STRING, n BIGINT"
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (line) SORTED BY (line) INTO {self.buckets} BUCKETS LOCATION '{run}'")
            self._tables[run] = name
        return self._tables[run]

    def _forget(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop(run)}") if run in self._tables else None

    def close(self) -> None:
        for run in list(self._tables):
            self._forget(run)

    def _write(self, rows: DataFrame, level: int) -> str:
        run = f"{self.path}/level-{level}/run-{uuid.uuid4().hex}"
        rows.select("line", "n").write.insertInto(self._table(run))
        self.spark.catalog.refreshTable(self._table(run))
        return run

    def _put(self, level: int, run: str) -> None:
        """Name the run in the manifest; merge full levels, each with one more change of the manifest."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        self._save()
        if len(self.levels[level]) >= self.fanout:
            merging, self.levels[level] = self.levels[level], []
            merged, used = merging[0], list(merging)
            for more in merging[1:]:
                merged = self._write(self._merged(merged, more), level + 1)
                used.append(merged)
            self._put(level + 1, merged)
            for old in used[:-1]:
                self._forget(old)
                delete_path(self.spark, old)

    def _merged(self, one: str, other: str) -> DataFrame:
        a, b = (self.spark.table(self._table(run)).withColumnRenamed("n", n) for run, n in ((one, "a"), (other, "b")))
        zero = F.lit(0)
        return a.join(b.hint("merge"), "line", "full_outer").select("line", (F.coalesce("a", zero) + F.coalesce("b", zero)).alias("n"))

    def _runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def add(self, docs: DataFrame, min_docs: int | None = None, batch: Column | None = None, batches: int = 1) -> None:
        """Add documents as one batch, or, with ``batch`` (0 to batches - 1), as that many from one scan.

        With ``min_docs`` the lines that the runs know from so many documents are not counted on:
        their counts are lower bounds then.
        """
        number = F.lit(0) if batch is None else batch
        rows = _with_lines(docs).select(number.cast("int").alias("batch"), F.explode(_distinct_keys(F.col("keys"))).alias("line"))
        counted = rows.groupBy("line", "batch").agg(F.count(F.lit(1)).alias("n"))
        landing = f"{self.path}/landing-{uuid.uuid4().hex}"
        counted.repartition(self.buckets, "line").select("line", "n", "batch").write.insertInto(self._table(landing, batches=True))
        self.spark.catalog.refreshTable(self._table(landing))
        for k in range(batches if batch is not None else 1):
            fresh = self.spark.table(self._table(landing)).where(F.col("batch") == k)
            if min_docs is not None and self._runs():
                fresh = fresh.join(self.frequent(min_docs).hint("merge"), "line", "left_anti")
            self._put(0, self._write(fresh, 0))
        self._forget(landing)
        delete_path(self.spark, landing)

    def counts(self) -> DataFrame:
        """(line, n) over all runs; summed in the plan, or read as it is where one run is left."""
        runs = self._runs()
        if not runs:
            return self.spark.range(0).select(F.lit("").alias("line"), F.col("id").alias("n"))
        if len(runs) == 1:
            return self.spark.table(self._table(runs[0]))
        # without their buckets: Spark 4.1 takes a union of bucketed tables for bucketed, and sums wrongly
        return self.spark.read.schema("line string, n bigint").parquet(*runs).groupBy("line").agg(F.sum("n").alias("n"))

    def frequent(self, min_docs: int) -> DataFrame:
        return self.counts().where(F.col("n") >= min_docs).select("line")

    def judge_then_add(self, docs: DataFrame, min_docs: int) -> DataFrame:
        """Incremental use: the batch judged by the runs that lie there, written, and then added to them."""
        judged = written(apply_runs(docs, self, min_docs), workspace(self.spark, "line-batch"))
        self.add(docs, min_docs)
        return judged


def _applied(docs: DataFrame, runs: LineRuns, min_docs: int) -> DataFrame:
    """``docs`` with all columns and __sl_before and __sl_kept, the lines of the text and those that stay."""
    frequent = written(runs.frequent(min_docs), workspace(runs.spark, "frequent-lines"), small=True)  # without buckets, so that a line of many documents can be split
    runs.close()
    probes = _with_lines(docs).select(F.col("doc_id").alias("__sl_id"), F.col("__h").alias("__sl_h"), F.posexplode("keys").alias("at", "line")).where("line IS NOT NULL")
    going = probes.join(frequent.hint("merge"), "line", "left_semi").groupBy("__sl_id", "__sl_h").agg(F.collect_set("at").alias("__sl_gone"))
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumns({"__sl_id": F.col("doc_id"), "__sl_h": F.xxhash64(text)})
    both = null_safe_join(keyed, going, ["__sl_id", "__sl_h"], "left").withColumn("__sl_before", F.split(text, "\n", -1))
    staying = lambda lines: F.transform(F.array_except(indexes(F.size(lines)), F.col("__sl_gone")), lambda i: F.get(lines, i))
    left = let(F.split(text, "\n", -1), staying)  # by places, which a hash set tells apart: linear in the lines
    return both.withColumn("__sl_kept", F.when(F.col("__sl_gone").isNull(), F.col("__sl_before")).otherwise(left)).drop("__sl_id", "__sl_h", "__sl_gone")


def apply_runs(docs: DataFrame, runs: LineRuns, min_docs: int) -> DataFrame:
    """Each document without the lines whose key the runs hold ``min_docs`` times or more.

    Returns doc_id, kept_text, n_lines, n_dropped: one row for each row of ``docs``.
    """
    found = _applied(docs.select("doc_id", "text"), runs, min_docs)
    n_lines = F.size("__sl_before").cast("long")
    return found.select("doc_id", F.array_join("__sl_kept", "\n").alias("kept_text"), n_lines.alias("n_lines"), (n_lines - F.size("__sl_kept")).alias("n_dropped"))


def _runs_of(docs: DataFrame, min_docs: int, batches: int, fanout: int) -> LineRuns:
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-docs.count() // DOCS_A_BUCKET)))
    runs = LineRuns(docs.sparkSession, fanout=fanout, buckets=buckets)
    runs.add(docs, min_docs, F.pmod(F.xxhash64("doc_id", "__h"), F.lit(batches)), batches)
    return runs


def dedup_lines(docs: DataFrame, min_docs: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """Drop every line whose key occurs in ``min_docs`` or more documents.

    Lines are split at line feeds; a key is the line without ASCII white space at both ends and
    with A-Z in lower case. Lines with an empty key always stay. A null or empty text is one empty
    line. Rows are documents: repeated rows count once each, whatever their ``doc_id``; a null
    ``doc_id`` is a value like others. Other columns are not read. An empty table gives no rows.

    Returns doc_id, kept_text, n_lines (before), n_dropped.
    """
    return apply_runs(docs, _runs_of(docs, min_docs, batches, fanout), min_docs)


def without_common_lines(docs: DataFrame, min_docs: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """The documents with all their columns, without the lines that ``dedup_lines`` drops.

    Every document stays, if with an empty text. A null text stays null. n_chars, where there is
    such a column, is counted anew for the texts that have changed.
    """
    found = _applied(docs, _runs_of(docs, min_docs, batches, fanout), min_docs)
    changed = F.size("__sl_kept") < F.size("__sl_before")
    kept = F.array_join("__sl_kept", "\n")
    new = {"text": F.when(changed, kept).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.char_length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumns(new).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_line_dedup(docs: DataFrame) -> DataFrame:
    """The contract's digest of ``dedup_lines``."""
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM rows_
),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
),
frequent AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (k IN (FROM frequent))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (k NOT IN (FROM frequent)), '')) AS kept_sha256
FROM keyed GROUP BY r
"""
