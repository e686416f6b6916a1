"""Approaches that suggest, for every property of a source model, properties of a target model."""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schemaloom.functions.embed import Embedder, LexicalEmbedder, VectorStore, embedded
from schemaloom.functions.scratch import workspace, written
from schemaloom.functions.text import curie, parse_line

from .models import Models, documents
from .search import top_k

SUGGESTION = [
    "test_id", "node_ord", "prop_ord", "source_node", "source_property", "source_type", "source_description",
    "target_node", "target_property", "target_type", "target_description", "similarity", "rk",
]


class NothingFound(Exception):
    """No property of the source has a match."""


class Approach(ABC):
    """``suggest`` takes two parsed models and returns a DataFrame with the columns of SUGGESTION."""

    @abstractmethod
    def suggest(self, source: Models, target: Models, **options) -> DataFrame: ...


class CaseApproach(ABC):
    """An approach of one's own that matches a case's source lines with its target's, both as pandas frames.

    ``schemaloom.plans.evaluate`` runs it inside one grouped plan, whatever the number of targets. A call
    sees all lines of one case, so it may weigh them against each other.
    """

    @abstractmethod
    def match(self, source: pd.DataFrame, target: pd.DataFrame) -> pd.DataFrame:
        """Rows (source, target, similarity): row numbers, from 0, in both frames, and a score; any number of rows, in any order.

        ``source``: node_name, property_name, property_type, property_description and npd, its line;
        ``target``: text, its line. Both are in the models' order. An exception fails this case alone.
        """

    def match_cases(self, source: pd.DataFrame, target: pd.DataFrame, cases: list[tuple[tuple[int, int], tuple[int, int]]]) -> tuple[pd.DataFrame, dict[int, Exception]]:
        """Many cases at once: the rows of ``match``, by row numbers in the frames of all cases, and the fault of each case (by its number) that failed.

        ``cases``: for each case its rows in ``source`` and those in ``target``, as first and the one after
        the last. This calls ``match`` for each; an approach that can do many small cases in a few
        array operations may do so here, with the same results.
        """
        found, faults = [], {}
        for c, ((a, b), (t, u)) in enumerate(cases):
            try:
                one = self.match(source.iloc[a:b].reset_index(drop=True), target.iloc[t:u].reset_index(drop=True))
                i, j = one["source"].to_numpy("int64"), one["target"].to_numpy("int64")
                if len(i) and not (0 <= i.min() and i.max() < b - a and 0 <= j.min() and j.max() < u - t):
                    raise ValueError("the approach gives rows that are not there")
                found.append((i + a, j + t, pd.to_numeric(one["similarity"]).to_numpy("float64")))
            except Exception as fault:  # whatever an approach of one's own may raise is told in the case's row
                faults[c] = fault
        columns = zip(*found, strict=True) if found else ([], [], [])
        return pd.DataFrame({n: np.concatenate([*x, np.zeros(0, kind)]) for n, x, kind in zip(("source", "target", "similarity"), columns, ("int64", "int64", "float64"), strict=True)}), faults


class ExampleApproach(Approach):
    """Two fixed suggestions, whatever the models: a test double."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def suggest(self, source: Models, target: Models, **options) -> DataFrame:
        # Fixed values of the example.
        rows = [
            (0, 0, 0, "Table1", "foo", "string", "Foo field", "TableA", "bar", "string", "Bar field", 0.88, 1),
            (0, 1, 0, "Table2", "baz", "string", "Baz field", "TableB", "buzz", "string", "Buzz field", 0.92, 1),
        ]
        kinds = ["bigint", "int", "int", *["string"] * 8, "double", "int"]
        return self.spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in zip(SUGGESTION, kinds, strict=True)))


class SimilarityApproach(Approach):
    """Nearest lines of the target by an embedder's vectors.

    A target may be several models, whose lines are searched together. Source texts are the rendered lines. The source's description is given raw; what is told of the
    target is parsed back from its line. Sources without a match have no rows. Equal lines
    of the source are embedded and searched once. With ``best=True`` only the best of the k targets of a property are given, all of them where they tie.
    """

    def __init__(self, embedder: Embedder | None = None, store: VectorStore | None = None, k: int = 4, threshold: float | None = None, strategy: str = "auto"):
        self.embedder, self.store, self.k, self.threshold, self.strategy = embedder or LexicalEmbedder(), store, k, threshold, strategy

    def _targets(self, target: Models, force: bool) -> DataFrame:
        """(id, text, vector) of all target models' lines, computed once."""
        texts = documents(target).select("target_ord", "text")
        if self.store is not None:
            return self.store.populate(texts, self.embedder, force)
        spark = texts.sparkSession
        own = texts.select(F.monotonically_increasing_id().alias("id"), "text", embedded(F.col("text"), self.embedder).alias("vector"))
        return written(own, workspace(spark, "targets"))

    def suggest(self, source: Models, target: Models, must_match: bool = False, force: bool = False, **options) -> DataFrame:
        targets = self._targets(target, force)
        spark = targets.sparkSession
        props = source.properties.withColumn("__text", F.coalesce("npd", F.lit("")))
        props = written(props, workspace(spark, "sources"))  # parsed once
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        lines = props.select("__text").distinct().repartition(n, "__text")
        lines = written(lines.select("__text", F.monotonically_increasing_id().alias("id"), embedded(F.col("__text"), self.embedder).alias("vector")), workspace(spark, "lines"))  # numbered and embedded once
        found = top_k(
            lines.select("id", "vector"),
            targets.select("id", "vector"),
            options.get("k", self.k),
            options.get("threshold", self.threshold),
            strategy=options.get("strategy", self.strategy),
        )
        if must_match and found.isEmpty():
            raise NothingFound("no property of the source has a match")
        if options.get("best"):
            found = found.withColumn("__best", F.max("similarity").over(Window.partitionBy("source_id"))).where("similarity = __best").drop("__best")
        t = parse_line(F.col("text"))
        told = targets.select(F.col("id").alias("target_id"), t.alias("t"))
        of_line = found.join(told, "target_id").join(lines.select(F.col("id").alias("source_id"), "__text"), "source_id")
        return of_line.join(props, "__text").select(
            F.col("model_id").alias("test_id"),
            "node_ord",
            "prop_ord",
            F.col("node_name").alias("source_node"),
            F.col("property_name").alias("source_property"),
            F.col("property_type").alias("source_type"),
            F.col("property_description").alias("source_description"),
            F.col("t.node").alias("target_node"),
            F.col("t.property").alias("target_property"),
            F.col("t.type").alias("target_type"),
            F.col("t.description").alias("target_description"),
            "similarity",
            "rk",
        )


def display_table(suggested: DataFrame) -> DataFrame:
    """The five columns that people look at."""
    return suggested.select(
        F.concat("source_node", F.lit("."), "source_property").alias("Original Node.Property"),
        F.concat("target_node", F.lit("."), "target_property").alias("Target Node.Property"),
        F.col("source_description").alias("Original Description"),
        F.col("target_description").alias("Target Description"),
        F.col("similarity").alias("Similarity"),
    )


# Fixed values of mapping sets.
PREDICATE, JUSTIFICATION = "skos:relatedMatch", "semapv:UnspecifiedMatching"


MAPPING_COLUMNS = ["subject_id", "subject_label", "predicate_id", "object_id", "object_label", "mapping_justification", "similarity_score"]


def mapping_rows(suggested: DataFrame, predicate: str = PREDICATE, justification: str = JUSTIFICATION, keep: list[str] | None = None) -> DataFrame:
    """Suggestions as rows of a mapping set, after the columns to keep."""
    subject, object_ = (F.concat(f"{s}_node", F.lit("."), f"{s}_property") for s in ("source", "target"))
    return suggested.select(
        *(keep or []),
        curie(subject).alias("subject_id"),
        subject.alias("subject_label"),
        F.lit(predicate).alias("predicate_id"),
        curie(object_).alias("object_id"),
        object_.alias("object_label"),
        F.lit(justification).alias("mapping_justification"),
        F.col("similarity").alias("similarity_score"),
    )
