"""Scores of suggested mappings against the known ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIR = ["source_node", "source_property", "target_node", "target_property"]


def _distinct_pairs(rows: DataFrame, case: str) -> DataFrame:
    return rows.select(case, *[F.coalesce(c, F.lit("")).alias(c) for c in PAIR]).distinct()


def correct_pairs(suggested: DataFrame, expected: DataFrame, case: str = "test_id") -> DataFrame:
    return _distinct_pairs(suggested, case).join(_distinct_pairs(expected, case), [case, *PAIR], "left_semi")


def missing_pairs(suggested: DataFrame, expected: DataFrame, case: str = "test_id") -> DataFrame:
    return _distinct_pairs(expected, case).join(_distinct_pairs(suggested, case), [case, *PAIR], "left_anti")


def case_metrics(suggested: DataFrame, expected: DataFrame, cases: DataFrame | None = None, case: str = "test_id") -> DataFrame:
    """Counts of distinct pairs, accuracy, precision, recall, F1 and the missing mappings of each case.

    A ratio over nothing is 0. Cases of ``cases`` without any pair have zeros.
    """
    s = _distinct_pairs(suggested, case).withColumn("s", F.lit(1))
    e = _distinct_pairs(expected, case).withColumn("e", F.lit(1))
    both = s.join(e, [case, *PAIR], "full_outer")
    text = F.concat("source_node", F.lit("."), "source_property", F.lit(" -> "), "target_node", F.lit("."), "target_property")
    counted = both.groupBy(case).agg(
        F.count("s").alias("n_suggested"),
        F.count("e").alias("n_expected"),
        F.count_if(F.col("s").isNotNull() & F.col("e").isNotNull()).alias("n_correct"),
        F.array_sort(F.collect_list(F.when(F.col("s").isNull(), text))).alias("missing_mappings"),
    )
    if cases is not None:
        counted = cases.select(case).distinct().join(counted, case, "left")
    n = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("n_suggested", "n_expected", "n_correct")}
    zero = F.lit(0.0)
    precision, recall = (F.coalesce(F.try_divide(n["n_correct"], n[c]), zero) for c in ("n_suggested", "n_expected"))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(zero)
    return counted.select(
        case,
        *[v.alias(k) for k, v in n.items()],
        recall.alias("overall_accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1_score"),
        F.coalesce("missing_mappings", F.array().cast("array<string>")).alias("missing_mappings"),
    )


def metrics_by(rows: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """Means for each key and, in the row with a null key and ``is_total``, over all rows by row."""
    means = [F.avg(c).alias(f"mean_{c}") for c in measures]
    return rows.rollup(key).agg(*means, F.count(F.lit(1)).alias("n"), F.grouping(key).cast("int").alias("is_total"))


def metrics_rows(rows: DataFrame, file: str, ordinal: str, measures: list[str]) -> DataFrame:
    """The measures of every row with its file and its number in it, from 1."""
    order = Window.partitionBy(file).orderBy(ordinal)
    return rows.select(file, F.row_number().over(order).alias("row"), *measures)


def with_overall_mean(rows: DataFrame, measure: str) -> DataFrame:
    """Every row with the mean of all rows, which is one number joined on by its single row."""
    mean = rows.agg(F.avg(measure)).first()[0]
    return rows.withColumn(f"mean_{measure}", F.lit(mean).cast("double"))


def best_per_source(suggested: DataFrame, keys: list[str], score: str, ties: list[str]) -> DataFrame:
    """The suggestion with the highest score of each source; ties go by the given order."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), *ties)
    return suggested.withColumn("__rk", F.row_number().over(order)).where("__rk = 1").drop("__rk")


def rows_by_label(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """The rows that a list of keys selects."""
    return rows.join(labels.select(key).distinct(), key, "left_semi")
