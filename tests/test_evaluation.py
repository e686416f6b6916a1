"""Approaches of one's own, failures as rows, and what a benchmark writes."""

import json
import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from schemaloom.functions.embed import LetterEmbedder
from schemaloom.operators.approach import CaseApproach
from schemaloom.plans import evaluate

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not have the tests' folder


def model(node, *names):
    return json.dumps({"nodes": [{"name": node, "properties": [{"name": n, "type": "string", "description": "x"} for n in names]}]})


class SameName(CaseApproach):
    """Properties of the same name; a source with the property ``fail`` raises, one with ``stray`` gives a row that is not there."""

    def match(self, source, target):
        if (source["property_name"] == "fail").any():
            raise RuntimeError("will not")
        names = target["text"].str.extract(r"\.(.*?) \(")[0]
        rows = [(i, j, 1.0) for i, s in enumerate(source["property_name"]) for j, t in enumerate(names) if s == t]
        if (source["property_name"] == "stray").any():
            rows.append((99, 0, 1.0))
        return pd.DataFrame(rows, columns=["source", "target", "similarity"])


def cases(spark, rows):
    own = spark.createDataFrame(rows, "test_id string, source_model string, target_model string, harmonized_mapping string")
    return own.withColumns({"target_key": F.sha2("target_model", 256), "line": F.lit('{"id": 1}')})


GOOD = "s\tt\na.zip (string): x\tu.zip (string): x\n"
SIMPLE = {"source_format": "simple", "target_format": "simple"}


def test_ten_thousand_targets_in_one_plan(spark):
    rows = spark.range(10_000).select(
        F.col("id").cast("string").alias("test_id"),
        F.lit(model("a", "zip", "age")).alias("source_model"),
        F.concat(F.lit('{"nodes": [{"name": "n'), "id", F.lit('", "properties": [{"name": "age", "type": "string", "description": "y"}]}]}')).alias("target_model"),
    ).withColumn("target_key", F.sha2("target_model", 256))
    found = evaluate.suggest_cases(rows, SameName(), **SIMPLE)
    told = found.groupBy("error", "source_property", "target_property").agg(F.count("*").alias("n"), F.count_if(F.concat(F.lit("n"), "test_id") == F.col("target_node")).alias("own")).collect()
    assert [(r.error, r.source_property, r.target_property, r.n, r.own) for r in told] == [(None, "age", "age", 10_000, 10_000)]


def test_bad_cases_are_rows_and_the_rest_goes_on(spark, tmp_path):
    target = model("u", "age", "zip")
    rows = cases(spark, [
        ("good", model("a", "zip"), target, GOOD), ("raises", model("a", "fail"), target, GOOD), ("strays", model("a", "stray"), target, GOOD), ("mapping", model("a", "zip"), target, "s\tt\nonly one\n"),
        ("source", "[]", target, GOOD), ("target", model("a", "zip"), "no json", GOOD), ("null", None, target, GOOD), ("none", model("a", "nil"), target, GOOD),
    ])
    done = evaluate.run_benchmark(rows, approach=SameName(), on_error="rows", mapping_sets=f"file://{tmp_path}/sets", **SIMPLE)
    assert {(r.test_id, r.stage) for r in done.failures.collect()} == {("raises", "match"), ("strays", "match"), ("mapping", "mapping"), ("source", "source model"), ("target", "target model"), ("null", "source model")}
    assert {r.test_id: r.recall for r in done.metrics.collect()} == {"good": 1.0, "none": 0.0}
    lines = {r.test_id: json.loads(r.line)["custom_metrics"] for r in done.lines.collect()}
    assert len(lines) == 8 and lines["good"]["recall"] == 1.0 and lines["raises"] is None
    assert sorted(p.name for p in (tmp_path / "sets").glob("*.tsv")) == ["good.sssom.tsv", "none.sssom.tsv"]
    with pytest.raises(evaluate.CasesFailed, match="6 cases failed") as told:
        evaluate.run_benchmark(rows, approach=SameName(), **SIMPLE)
    assert told.value.evaluation.metrics.count() == 2


def test_ranks_ties_and_thresholds(spark):
    class Scored(CaseApproach):
        def match(self, source, target):
            return pd.DataFrame({"source": [0] * 6, "target": [3, 2, 1, 0, 2, 3], "similarity": [0.5, 0.9, 0.5, None, 0.9, float("inf")]})

    rows = cases(spark, [("c", model("a", "p"), model("t", "w", "x", "y", "z"), GOOD)])
    found = evaluate.suggest_cases(rows, Scored(), k=2, threshold=0.5, **SIMPLE).orderBy("rk").collect()
    assert [(r.target_property, r.similarity, r.rk) for r in found] == [("y", 0.9, 1), ("x", 0.5, 2)]
    assert evaluate.suggest_cases(rows.limit(0), Scored(), **SIMPLE).count() == 0


def test_cases_of_one_target_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "PART_ROWS", 2)

    class Count(CaseApproach):
        def match(self, source, target):
            return pd.DataFrame({"source": range(len(source)), "target": 0, "similarity": float(len(source))})

    rows = cases(spark, [(f"c{i}", model("a", *[f"p{j}" for j in range(i + 1)]), model("t", "x"), GOOD) for i in range(6)])
    found = evaluate.suggest_cases(rows, Count(), **SIMPLE)
    assert {(r.test_id, r.n, r.s) for r in found.groupBy("test_id").agg(F.count("*").alias("n"), F.max("similarity").alias("s")).collect()} == {(f"c{i}", i + 1, i + 1.0) for i in range(6)}


def test_suggestions_are_computed_once(spark):
    calls = spark.sparkContext.accumulator(0)

    class Counted(LetterEmbedder):
        def embed_documents(self, texts):
            calls.add(len(texts))
            return super().embed_documents(texts)

    rows = cases(spark, [("c", model("a", "zip"), model("u", "zip"), GOOD)])
    done = evaluate.run_benchmark(rows, Counted(), **SIMPLE)
    before = calls.value
    done.metrics.collect(), done.lines.collect(), done.suggestions.collect()
    assert calls.value == before > 0


def test_many_small_cases_share_a_call_and_fail_alone(spark):
    import json

    from pyspark.sql import functions as F

    from schemaloom.operators.approach import CaseApproach
    from schemaloom.plans import evaluate

    calls = spark.sparkContext.accumulator(0)

    class Same(CaseApproach):
        def match(self, source, target):
            if "bad" in source["property_name"].tolist():
                raise KeyError("bad")
            return pd.DataFrame({"source": [0], "target": [len(target) - 1], "similarity": [0.5]})

        def match_cases(self, source, target, cases):
            calls.add(1)
            return super().match_cases(source, target, cases)

    import pandas as pd

    model = lambda *names: json.dumps({"nodes": [{"name": "n", "description": "d", "properties": [{"name": x, "description": "", "type": "t"} for x in names]}]})
    rows = [(i, model("bad" if i % 10 == 3 else f"p{i}"), model("x", f"t{i // 2}"), f"k{i // 2}") for i in range(200)]
    cases = spark.createDataFrame(rows, "test_id bigint, source_model string, target_model string, target_key string")
    got = {r.test_id: r for r in evaluate.suggest_cases(cases, Same(), source_format="simple", target_format="simple").collect()}
    assert sorted(got) == list(range(200)) and calls.value <= 16
    for i, r in got.items():
        assert (r.error, r.target_property) == (("KeyError: 'bad'", None) if i % 10 == 3 else (None, f"t{i // 2}"))
