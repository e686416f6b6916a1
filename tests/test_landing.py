import json
import sys

import pandas as pd
import pytest
from pyspark import cloudpickle

from schemaloom.operators.approach import CaseApproach
from schemaloom.streaming import evaluation as E

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class First(CaseApproach):
    def match(self, source, target):
        return pd.DataFrame({"source": range(len(source)), "target": 0, "similarity": 1.0})


def case(i, target="t"):
    model = lambda node, name: {"nodes": [{"name": node, "properties": [{"name": name, "type": "string", "description": "x"}]}]}
    return json.dumps({"id": i, "input_source_model": model("a", f"p{i}"), "input_target_model": model(target, "q"), "harmonized_mapping": f"s\tt\na.p{i} (string): x\t{target}.q (string): x\n" if i % 4 else ""})


def test_landed_cases_are_evaluated_once(spark, tmp_path, monkeypatch):
    landing, out = tmp_path / "in", f"file://{tmp_path}/out"
    landing.mkdir()
    options = {"approach": First(), "source_format": "simple", "target_format": "simple"}
    finished = spark.createDataFrame([(None,)], "target_key string")
    run = lambda: E.evaluate_landing(spark, f"file://{landing}", out, f"file://{tmp_path}/cp", finished, **options).awaitTermination()

    def ids():
        return sorted(json.loads(r.line)["id"] for r in spark.read.parquet(f"{out}/lines").collect())

    (landing / "1.jsonl").write_text("\n".join([case(1), case(2), case(2), "broken", case(4)]))
    run()
    assert ids() == [1, 2, 4]
    (landing / "2.jsonl").write_text("\n".join([case(2), case(3)]))
    whole = E.run_benchmark

    def broken(*args, **more):
        whole(*args, **more).suggestions.write.parquet(f"{out}/suggestions/batch=1")  # a part of the batch is there already
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(E, "run_benchmark", broken)
        with pytest.raises(Exception, match="lost"):
            run()
    run()
    run()  # nothing new
    assert ids() == [1, 2, 3, 4] and spark.read.parquet(f"{out}/suggestions").count() == 4 - 1
    assert sorted(r.recall for r in spark.read.parquet(f"{out}/metrics").collect()) == [1.0, 1.0, 1.0]
    assert [r.stage for r in spark.read.parquet(f"{out}/failures").collect()] == ["mapping"]


def test_finished_targets_are_skipped(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.jsonl").write_text("\n".join([case(1, "t"), case(2, "u"), case(3, "t")]))
    lines = spark.read.text(f"file://{tmp_path}/in").selectExpr("_metadata.file_path AS path", "value AS line")
    keys = {json.loads(r.line)["id"]: r.target_key for r in E.landed_cases(lines).collect()}
    left = E.landed_cases(lines, spark.createDataFrame([(keys[1],)], "target_key string")).collect()
    assert len(keys) == 3 and [json.loads(r.line)["id"] for r in left] == [2]
