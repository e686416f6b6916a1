"""Evaluation of an embedder over many test cases in one job, and the orchestration around it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.functions.embed import Embedder, LexicalEmbedder, embedded
from schemaloom.functions.scratch import workspace, written
from schemaloom.functions.text import parse_line
from schemaloom.operators import metrics as m
from schemaloom.operators.joins import finished_anti
from schemaloom.operators.approach import Approach, CaseApproach
from schemaloom.operators.models import Models, documents, parse
from schemaloom.operators.search import _best, _rank, _unit
from schemaloom.sources.named_files import write_mapping_sets
from schemaloom.sources.readers import mapping_results
from schemaloom.sources.writers import with_metrics

#: Source properties that one task compares with a target's; a popular target's are dealt to as many tasks as that takes.
PART_ROWS = 4096
#: Source properties, about, that one call of pandas gets: those of many small targets together.
BUCKET_ROWS = 20_000

SOURCE_COLUMNS = ["test_id", "node_ord", "prop_ord", "node_name", "property_name", "property_type", "property_description"]


@dataclass(frozen=True)
class Evaluation:
    suggestions: DataFrame
    metrics: DataFrame
    lines: DataFrame  # the test cases' JSON with their metrics
    failures: DataFrame  # test_id, stage and error of the cases that could not be evaluated


def suggest_all(cases: DataFrame, embedder: Embedder | None = None, k: int = 10, threshold: float | None = 0.0, source_format: str | Callable[[DataFrame], Models] = "unknown", target_format: str | Callable[[DataFrame], Models] = "unknown") -> DataFrame:
    """Suggestions for every case against its own target model; each distinct target is parsed and embedded once.

    A format is a dialect's name, or a function that makes models of (model_id, json) rows.

    ``cases``: test_id, source_model, target_model, target_key.
    """
    embedder = embedder or LexicalEmbedder()
    props, target = _sides(cases, source_format, target_format)
    lines = target.withColumn("tv", embedded(F.col("text"), embedder))
    parts = props.groupBy("target_key").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("parts"))
    dealt = props.join(parts, "target_key").withColumn("salt", F.pmod(F.xxhash64("test_id", "node_ord", "prop_ord"), F.col("parts")))
    queries = dealt.withColumn("qv", embedded(F.col("npd"), embedder))
    salted = lines.join(parts, "target_key").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")
    kept = SOURCE_COLUMNS
    kinds = {f.name: f.dataType.simpleString() for f in props.schema}

    def search(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("target_ord")
        if not len(q) or not len(t):
            return pd.DataFrame({**{c: pd.Series(dtype=object) for c in kept}, "text": pd.Series(dtype=object), "similarity": pd.Series(dtype=float), "rk": pd.Series(dtype=int)})
        ids = t["target_ord"].to_numpy(np.int64)
        rows, found, values = _best(_unit(np.stack(q["qv"])), _unit(np.stack(t["tv"])), ids, np.full(len(q), -1), k, threshold, False)
        out = q.iloc[rows][kept].reset_index(drop=True)
        out["text"] = t["text"].to_numpy()[np.searchsorted(ids, found)]
        out["similarity"] = values
        out["rk"] = pd.Series(rows).groupby(rows).cumcount().to_numpy() + 1
        return out

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in kept), "text string", "similarity double", "rk int"])
    found = queries.select("target_key", "salt", *kept, "qv").groupBy("target_key", "salt").cogroup(salted.groupBy("target_key", "salt")).applyInPandas(search, schema)
    return _told(found)


def _sides(cases: DataFrame, source_format: str | Callable[[DataFrame], Models], target_format: str | Callable[[DataFrame], Models]) -> tuple[DataFrame, DataFrame]:
    """The cases' source properties with their target_key, and the lines of each distinct target: target_key, target_ord, text."""
    source = _parsed(cases.select(F.col("test_id").alias("model_id"), F.col("source_model").alias("json")), source_format)
    targets = cases.groupBy("target_key").agg(F.first("target_model").alias("json"))
    target = documents(_parsed(targets.select(F.col("target_key").alias("model_id"), "json"), target_format))
    props = source.properties.withColumnRenamed("model_id", "test_id").join(cases.select("test_id", "target_key"), "test_id")
    return props, target.select(F.col("model_id").alias("target_key"), "target_ord", "text")


def _told(found: DataFrame, *more: str) -> DataFrame:
    """The columns of SUGGESTION of matches with a source's properties and a target's line."""
    t = parse_line(F.col("text"))
    return found.select(
        "test_id", "node_ord", "prop_ord",
        F.col("node_name").alias("source_node"), F.col("property_name").alias("source_property"),
        F.col("property_type").alias("source_type"), F.col("property_description").alias("source_description"),
        *[F.when(F.col("text").isNotNull(), t[f]).alias(f"target_{f}") for f in ("node", "property", "type", "description")],
        "similarity", "rk", *more,
    )


def suggest_by(cases: DataFrame, approach: Approach, source_format: str = "unknown", target_format: str = "unknown", most: int = 1000, **options) -> DataFrame:
    """Suggestions of an approach over DataFrames for every case, one distinct target model (of at most ``most``) after another.

    Any number of targets goes into one plan with a ``CaseApproach`` and ``suggest_cases``.
    """
    keys = [r.target_key for r in cases.select("target_key").distinct().limit(most + 1).collect()]
    if len(keys) > most:
        raise ValueError(f"more than {most} target models")
    found = []
    for key in sorted(keys, key=str):
        own = cases.where(F.col("target_key") == key)
        source = own.select(F.col("test_id").alias("model_id"), F.col("source_model").alias("json"))
        target = own.select(F.col("target_key").alias("model_id"), F.col("target_model").alias("json")).limit(1)
        found.append(approach.suggest(_parsed(source, source_format), _parsed(target, target_format), **options))
    return reduce(DataFrame.unionByName, found) if found else suggest_all(cases.limit(0))


def suggest_cases(cases: DataFrame, approach: CaseApproach, k: int = 10, threshold: float | None = None, source_format: str | Callable[[DataFrame], Models] = "unknown", target_format: str | Callable[[DataFrame], Models] = "unknown") -> DataFrame:
    """Suggestions of an approach of one's own for every case, any number of targets in one plan: the columns of SUGGESTION and error.

    Each distinct target is parsed once and sent to the tasks that its cases are dealt to; a case is
    never split. For each source property the k best targets of at least the threshold are kept,
    ties in the target's order; a score that is null or not finite is none. A case whose match fails
    is one row with its error and nulls else, and no suggestion; the others go on. Cases without
    source or target properties have no rows.

    ``cases``: test_id, source_model, target_model, target_key.
    """
    props, lines = _sides(cases, source_format, target_format)
    spark = cases.sparkSession
    # a number of partitions that is kept: the rows are small beside the work that an approach has with them
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    sized = written(props.groupBy("target_key").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("parts"), F.count(F.lit(1)).alias("rows")), workspace(spark, "sizes"))
    total = sized.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    buckets = max(n, -(-total // BUCKET_ROWS))  # a group holds many small targets, so that its cost is shared
    bucket = F.pmod(F.xxhash64("target_key", "salt"), F.lit(buckets)).cast("int").alias("bucket")
    dealt = props.join(sized.drop("rows"), "target_key").withColumn("salt", F.pmod(F.xxhash64("test_id"), F.col("parts")))
    salted = lines.join(sized.drop("rows"), "target_key").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    kinds = {f.name: f.dataType.simpleString() for f in props.schema}
    names = [*SOURCE_COLUMNS, "text", "similarity", "rk", "error"]

    def best(source: pd.DataFrame, target: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        i, j = found["source"].to_numpy(np.int64), found["target"].to_numpy(np.int64)
        score = pd.to_numeric(found["similarity"]).to_numpy(np.float64)
        order = np.lexsort((-score, j, i))  # of a repeated pair the best score
        order = order[np.isfinite(score[order])]
        order = order[np.r_[True, (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)][: len(order)]]
        order = order[score[order] >= (-np.inf if threshold is None else threshold)]
        order = order[np.lexsort((j[order], -score[order], i[order]))]
        rank = _rank(i[order]) + 1
        order, rank = order[rank <= k], rank[rank <= k]
        own = {c: source[c].to_numpy()[i[order]] for c in SOURCE_COLUMNS}
        return pd.DataFrame({**own, "text": target["text"].to_numpy()[j[order]], "similarity": score[order], "rk": rank, "error": None})

    def search(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        """The cases of a bucket, each against the lines of its target and part."""
        nothing = pd.DataFrame({n: pd.Series(dtype=object) for n in names})
        target = t.sort_values(["target_key", "salt", "target_ord"], ignore_index=True)
        source = q.sort_values(["test_id", "target_key", "node_ord", "prop_ord"], ignore_index=True)
        spans = _spans(target, ["target_key", "salt"])
        cases = {key: (rows, spans[key[1:]]) for key, rows in _spans(source, ["test_id", "target_key", "salt"]).items() if key[1:] in spans}
        if not cases:
            return nothing
        found, faults = approach.match_cases(source[["node_name", "property_name", "property_type", "property_description", "npd"]], target[["text"]], list(cases.values()))
        bad = [{"test_id": key[0], "error": f"{type(faults[c]).__name__}: {faults[c]}"[:500]} for c, key in enumerate(cases) if c in faults]
        out = [best(source, target, found)[names].astype(object), pd.DataFrame(bad, columns=names).astype(object)]
        together = pd.concat([o for o in out if len(o)] or [nothing], ignore_index=True)
        return together.where(together.notna(), None)

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in SOURCE_COLUMNS), "text string", "similarity double", "rk int", "error string"])
    left = dealt.select(bucket, "target_key", "salt", *SOURCE_COLUMNS, "npd").repartition(n, "bucket")
    right = salted.select(bucket, "target_key", "salt", "target_ord", "text").repartition(n, "bucket")
    found = left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInPandas(search, schema)
    return _told(found, "error")


def _spans(rows: pd.DataFrame, keys: list[str]) -> dict[tuple, tuple[int, int]]:
    """First row and the row after the last of each key, whose rows lie together."""
    if not len(rows):
        return {}
    changed = np.zeros(len(rows), bool)
    for key in keys:
        codes = pd.factorize(rows[key], use_na_sentinel=False)[0]
        changed[1:] |= codes[1:] != codes[:-1]
    changed[0] = True
    first = np.flatnonzero(changed)
    named = zip(*(rows[key].to_numpy()[first].tolist() for key in keys), strict=True)
    return dict(zip(named, zip(first.tolist(), [*first[1:].tolist(), len(rows)], strict=True), strict=True))


def _parsed(models: DataFrame, format: str | Callable[[DataFrame], Models]) -> Models:
    """Models by a named dialect, or by a function of one's own from (model_id, json)."""
    return format(models) if callable(format) else parse(models, format)


class CasesFailed(Exception):
    """Some cases could not be evaluated; ``evaluation`` has the results of the others."""

    def __init__(self, message: str, evaluation: Evaluation):
        super().__init__(message)
        self.evaluation = evaluation


def run_benchmark(
    cases: DataFrame, embedder: Embedder | None = None, column: str = "custom_metrics", approach: Approach | CaseApproach | None = None,
    on_error: str = "raise", mapping_sets: str | None = None, **options,
) -> Evaluation:
    """Suggest, score and append the metrics to every case's line, by vectors or by an approach of one's own.

    Suggestions are computed once and written to the shared folder; metrics, lines and mapping sets
    are read from there. A case fails if its known mapping cannot be read, if no dialect takes one of
    its models, or if a ``CaseApproach`` raises. With ``on_error="rows"`` such cases are the rows of
    ``failures`` (test_id, stage, error), have no metrics, and their lines have null for these; with
    ``"raise"`` an error tells of them after all other cases are done and carries their results.
    ``mapping_sets`` names a folder for a mapping set of each case that did not fail. It is written
    before an error is raised.
    """
    if on_error not in ("raise", "rows"):
        raise ValueError("on_error must be 'raise' or 'rows'")
    path = workspace(cases.sparkSession, "evaluation")
    if isinstance(approach, CaseApproach):
        found = suggest_cases(cases, approach, **options)
    else:
        found = (suggest_by(cases, approach, **options) if approach else suggest_all(cases, embedder, **options)).withColumn("error", F.lit(None).cast("string"))
    found = written(found, f"{path}/found")
    known = written(mapping_results(cases), f"{path}/known")
    formats = {side: options.get(f"{side}_format", "unknown") for side in ("source", "target")}
    faults = [
        known.where("error IS NOT NULL").select("test_id", F.lit("mapping").alias("stage"), "error"),
        found.where("error IS NOT NULL").select("test_id", F.lit("match").alias("stage"), "error"),
        *[_not_parsed(cases, side, format) for side, format in formats.items()],
    ]
    failures = written(reduce(DataFrame.unionByName, faults), f"{path}/failures")
    failed = failures.select("test_id").distinct()
    suggested = found.where("error IS NULL").drop("error").join(failed, "test_id", "left_anti")
    good = cases.join(failed, "test_id", "left_anti")
    scored = m.case_metrics(suggested, known.where("error IS NULL").drop("error").join(failed, "test_id", "left_anti"), good)
    done = Evaluation(suggested, scored, with_metrics(cases, scored, column=column), failures)
    if mapping_sets:
        write_mapping_sets(suggested, mapping_sets, cases=good)
    if on_error == "raise":
        some = failures.orderBy("test_id", "stage").limit(5).collect()
        if some:
            raise CasesFailed(f"{failed.count()} cases failed, such as " + "; ".join(f"{r.test_id} ({r.stage}): {r.error}" for r in some), done)
    return done


def _not_parsed(cases: DataFrame, side: str, format: str | Callable[[DataFrame], Models]) -> DataFrame:
    """A failure for each case whose model no dialect takes."""
    if side == "source":
        own = cases.select("test_id", F.col("test_id").alias("model_id"), F.col("source_model").alias("json"))
    else:
        own = cases.select("test_id", F.col("target_key").alias("model_id"), F.col("target_model").alias("json"))
    models = own.groupBy("model_id").agg(F.first("json").alias("json"))
    bad = _parsed(models, format).valid.where("NOT coalesce(valid, false)").select("model_id")
    return own.join(bad, "model_id", "left_semi").select("test_id", F.lit(f"{side} model").alias("stage"), F.lit("no dialect takes the model").alias("error"))


def still_to_do(cases: DataFrame, finished: DataFrame) -> DataFrame:
    """Cases of the targets that have no result yet, to resume an evaluation."""
    return finished_anti(cases, finished, "target_key")
