"""Evaluation of test cases as they land: each case once, whatever is landed or started again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from schemaloom.functions.scratch import passing, written
from schemaloom.plans.evaluate import run_benchmark
from schemaloom.sources.readers import benchmark_cases
from schemaloom.streaming.landing import landing_lines


def landed_cases(lines: DataFrame, finished: DataFrame | None = None) -> DataFrame:
    """Test cases of a stream of lines, each line once: a case's test_id is the hash of its line.

    The state is one row for each case that was ever seen, spread by that hash, so a popular target is
    no hot key. It has no end, as a case may land again at any time. Cases of the targets in
    ``finished`` (target_key) are left out.
    """
    cases = benchmark_cases(lines.withColumn("line_no", F.lit(0).cast("bigint"))).drop("line_no")
    own = cases.withColumn("test_id", F.sha2("line", 256))
    if finished is not None:
        own = own.join(finished.select("target_key").where("target_key IS NOT NULL").distinct(), "target_key", "left_anti")
    return own.dropDuplicates(["test_id"])


def evaluate_landing(spark: SparkSession, path: str, out: str, checkpoint: str, finished: DataFrame | None = None, available_now: bool = True, files_each: int = 100, **options) -> StreamingQuery:
    """Evaluate what lands in a folder by ``run_benchmark``, whose options these are, into folders below ``out``.

    Each micro-batch has a folder of its number in ``cases``, ``suggestions``, ``metrics``, ``failures``
    and ``lines``. A batch that was broken off is run again on the same cases and replaces its own
    folders, so a restart repeats and loses nothing. Cases that fail are rows of ``failures``.
    """
    root = out.rstrip("/")

    def put(batch: DataFrame, number: int) -> None:
        cases = written(batch, f"{root}/cases/batch={number}")  # the stream's rows, and its state, are computed once
        if cases.isEmpty():
            return
        with passing(spark):
            done = run_benchmark(cases, on_error="rows", **options)
            for name in ("suggestions", "metrics", "failures"):
                getattr(done, name).write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
            done.lines.select("test_id", "target_key", "line").write.mode("overwrite").parquet(f"{root}/lines/batch={number}")

    cases = landed_cases(landing_lines(spark, path, files_each), finished)
    writer = cases.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
