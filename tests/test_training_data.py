import json

from pyspark.sql import functions as F

from schemaloom.operators.models import spread_properties
from schemaloom.plans import training_data as D


def test_lines_and_cases(spark):
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    var_map = frame([("m", "case", "Patient", "n"), ("m", "case.age", "years", "how old"), ("m", "case.sex", "gender", None)], "model string, key string, new_name string, new_description string")
    origins = frame([("m", "case", "age", "d1", "case", "age"), ("m", "case", "sex", "d1", "case", "sex"), ("m", "case", "sex", "d2", "subject", "sex")], "model string, node string, property string, domain string, original_node string, original_property string")
    catalog = frame([("d1", "case", "age", "age\tin years"), ("d1", "case", "sex", "s")], "domain string, node string, property string, description string")
    lines = D.mapped_lines(var_map, origins, catalog)
    got = sorted((r.domain, r.source_line, r.target_line) for r in lines.collect())
    assert got == [("d1", "Patient.gender: ", "case.sex: s"), ("d1", "Patient.years: how old", "case.age: age    in years"), ("d2", "Patient.gender: ", "subject.sex: ")]
    cases = D.training_cases(lines, ["model", "domain"]).collect()
    assert [(c.domain, c.n) for c in cases] == [("d1", 2)] and cases[0].harmonized_mapping.count("\n") == 3
    named = frame([(1, "s", "t"), (2, "s", "none")], "test_id int, source_name string, target_name string")
    assert [r.test_id for r in D.named_cases(named, frame([("s", "{}"), ("t", "{}")], "name string, model string")).collect()] == [1]


def test_tables_become_models_and_truth_becomes_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,p\n2,q\n")
    rows = {r.path: r for r in D.source_models(spark, [f"file://{tmp_path}/a.csv", f"file://{tmp_path}/none.csv"]).collect()}
    good, bad = rows[f"file://{tmp_path}/a.csv"], rows[f"file://{tmp_path}/none.csv"]
    assert [p["type"] for p in json.loads(good.json)["nodes"][0]["properties"]] == ["number", "string"] and bad.error and bad.json is None
    truth = spark.createDataFrame([("x", "age"), ("z", None), (None, "age")], "original_name string, target_name string")
    source = spark.createDataFrame([("x", ".x (number): x")], "key string, line string")
    target = spark.createDataFrame([("case.age", "case.age (int): a", 1), ("sample.age", "sample.age (int): b", 0)], "key string, line string, ord int")
    pairs = D.truth_mappings(truth, source, target)
    assert sorted(map(tuple, pairs.collect())) == [(".x (number): x", "sample.age (int): b"), ("z", "")]
    assert D.truth_text(pairs.withColumn("k", F.lit(1)), "k").first().mapping.startswith(D.TYPED_HEADER + "\n")
    cases = spark.createDataFrame([(1, "{}", "{}", "h")], "test_id int, source_model string, target_model string, harmonized_mapping string")
    D.case_files(cases, f"file://{tmp_path}/cases")
    assert len(list((tmp_path / "cases").glob("*/test_id=1/part-*"))) == 3


def test_spread(spark):
    model = {"nodes": [{"name": "n", "properties": [{"name": "p", "unit": "kg"}, {"name:": "q", "node": "x"}]}]}
    found = spread_properties(spark.createDataFrame([(1, json.dumps(model))], "model_id int, json string")).orderBy("prop_ord")
    assert found.columns == ["model_id", "node_ord", "prop_ord", "node", "name", "name:", "property_node", "unit"]
    assert [r.unit for r in found.collect()] == ["kg", None]
