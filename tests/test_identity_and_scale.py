"""Cases in which collections, models and lines share what tells them apart."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from schemaloom.functions.embed import LetterEmbedder, LexicalEmbedder, VectorStore
from schemaloom.functions.scratch import passing, workspace, written
from schemaloom.operators import search
from schemaloom.operators.approach import Approach, SimilarityApproach
from schemaloom.operators.models import parse, parse_simple
from schemaloom.plans import evaluate
from schemaloom.plans.training_data import source_models
from schemaloom.sources import readers, writers


def model(node, *names):
    return json.dumps({"nodes": [{"name": node, "description": node, "properties": [{"name": n, "description": f"the {n}", "type": "string"} for n in names]}]})


def models(spark, *rows):
    return parse_simple(spark.createDataFrame(list(rows), "model_id bigint, json string"))


def test_metrics_of_a_line_that_has_some_are_replaced(spark):
    lines = ['{"a":1,"custom_metrics":{"x":0}}', '{"custom_metrics": null, "b": {"custom_metrics": 2}, "c": [1.5, "1"]} ', '{"a": "no \\"custom_metrics\\" here"}', "{}"]
    cases = spark.createDataFrame(list(enumerate(lines)), "test_id bigint, line string")
    scored = spark.createDataFrame([(0, 0.5), (1, 0.25), (2, 1.0), (3, 0.0)], "test_id bigint, x double")
    once = writers.with_metrics(cases, scored)
    for found in (once, writers.with_metrics(once, scored)):
        for r in found.collect():
            before = json.loads(lines[r.test_id])
            assert r.line.count('"custom_metrics":') == (2 if r.test_id == 1 else 1)
            assert json.loads(r.line) == {**before, "custom_metrics": {"x": {0: 0.5, 1: 0.25, 2: 1.0, 3: 0.0}[r.test_id]}}


def test_collections_of_equal_pairs_are_told_apart(spark, tmp_path):
    store, e = VectorStore(spark, f"file://{tmp_path}/s"), LexicalEmbedder(16)
    frame = lambda *rows: spark.createDataFrame(list(rows), "target_ord bigint, text string")
    twice = [frame((0, "x"), (0, "x")), frame((1, "yy"), (1, "yy")), frame((0, None), (0, None)), frame((0, ""), (0, ""))]
    assert len({store.path(t, e) for t in twice}) == 4
    assert {r.text for r in store.populate(twice[0], e).collect()} == {"x"} and {r.text for r in store.populate(twice[1], e).collect()} == {"yy"}


@pytest.mark.parametrize("with_store", [False, True])
def test_two_target_models_of_the_same_ordinals(spark, tmp_path, with_store):
    store = VectorStore(spark, f"file://{tmp_path}/s") if with_store else None
    target = models(spark, (1, model("t", "age")), (2, model("u", "zebra")))
    found = SimilarityApproach(LetterEmbedder(), store, k=1, threshold=None).suggest(models(spark, (7, model("s", "age", "zebra"))), target).collect()
    assert sorted((r.source_property, r.target_node, r.target_property, r.rk) for r in found) == [("age", "t", "age", 1), ("zebra", "u", "zebra", 1)]


def test_tiles_and_running_best_give_what_one_product_gives(spark, monkeypatch):
    rng = np.random.default_rng(1)
    q, t = (search._unit(rng.integers(-2, 3, (n, 4)).astype(float)) for n in (30, 500))
    ids, own = np.arange(500), np.arange(30)
    whole = search._best(q, t, ids, own, 7, -0.5, True)
    monkeypatch.setattr(search, "TILE", 64)
    tiled = search._best(q, t, ids, own, 7, -0.5, True)
    assert all(np.array_equal(a, b) for a, b in zip(whole, tiled))
    monkeypatch.setattr(search, "BLOCK_ROWS", 16)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(300)], "id bigint, vector array<double>")
    one, two = (sorted(map(tuple, search.top_k(rows, rows, 5, skip_self=True, strategy=s).collect())) for s in ("matrix", "blocks"))
    assert [x[:2] for x in one] == [x[:2] for x in two] and np.allclose([x[2] for x in one], [x[2] for x in two])


def test_hashing_recalls_near_neighbours(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 16))
    points = [(i, (centres[i % 60] + 0.08 * rng.normal(size=16)).tolist()) for i in range(600)]
    rows = spark.createDataFrame(points, "id bigint, vector array<double>")
    exact, near = ({(r.source_id, r.target_id) for r in search.top_k(rows, rows, 5, 0.95, skip_self=True, strategy=s).collect()} for s in ("matrix", "lsh"))
    assert len(exact & near) >= 0.9 * len(exact) > 1000


def test_letters_are_counted(spark):
    v = LetterEmbedder().embed_documents(["abba 09Z é", None, ""])
    assert v[0][:2].tolist() == [2, 2] and v[0][25] == 1 and v[0][26] == v[0][35] == 1 and v[0].sum() == 7 and not v[1:].any()


CASES = [
    {"input_source_model": json.loads(model("a", "sample", "age")), "input_target_model": model("t", "sample", "age", "zip"), "harmonized_mapping": "s\tt\na.sample (string): x\tt.sample (string): y\n"},
    {"input_source_model": json.loads(model("b", "zip")), "input_target_model": model("u", "zip"), "harmonized_mapping": "s\tt\nb.zip (string): x\tu.zip (string): y\n"},
]


class First(Approach):
    def suggest(self, source, target, **options):
        return SimilarityApproach(LetterEmbedder(), k=1).suggest(source, target)


def test_any_approach_and_converters_and_mapping_sets(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, CASES)))
    cases = readers.benchmark_cases(readers.read_lines(spark, f"file://{tmp_path}/c.jsonl"))
    assert cases.select("test_id").distinct().count() == 2
    done = evaluate.run_benchmark(cases, approach=First(), source_format=lambda m: parse(m, "simple"), target_format="simple")
    by_vectors = evaluate.run_benchmark(cases, LetterEmbedder(), k=1, source_format=parse_simple, target_format="simple")
    for found in (done, by_vectors):
        recalls = [json.loads(r.line)["custom_metrics"]["recall"] for r in found.lines.collect()]
        assert recalls == [1.0, 1.0] and found.suggestions.count() == 3
    texts = [r.mapping_set for r in writers.mapping_set_texts(done.suggestions, "test_id").collect()]
    assert all(t.startswith("subject_id\tsubject_label") and t.endswith("\n") for t in texts) and sorted(t.count("\n") for t in texts) == [2, 3]
    with pytest.raises(ValueError, match="more than 1"):
        evaluate.suggest_by(cases, First(), most=1)


def test_a_popular_target_is_dealt_to_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(evaluate, "PART_ROWS", 2)
    names = [f"prop{c}" for c in "abcdefghij"]
    case = {"input_source_model": json.loads(model("a", *names)), "input_target_model": model("t", *names), "harmonized_mapping": "s\tt\n"}
    (tmp_path / "c.jsonl").write_text(json.dumps(case))
    cases = readers.benchmark_cases(readers.read_lines(spark, f"file://{tmp_path}/c.jsonl"))
    found = evaluate.suggest_all(cases, LetterEmbedder(), k=1, source_format="simple", target_format="simple").collect()
    assert sorted((r.source_property, r.target_property) for r in found) == [(n, n) for n in names]


def test_a_table_that_fails_while_it_is_read_does_not_stop_the_others(spark, tmp_path):
    (tmp_path / "good.csv").write_text("a,b\n1,x\n2,y\n")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in source_models(spark, [f"file://{tmp_path}/good.csv", f"file://{tmp_path}/missing.csv"]).collect()}
    assert json.loads(rows["good.csv"].json)["nodes"] and rows["good.csv"].error is None
    assert rows["missing.csv"].json is None and rows["missing.csv"].error


def test_scratch_folders_pass_with_their_work(spark):
    with passing(spark):
        inner = workspace(spark, "t")
        assert written(spark.range(3), inner).count() == 3
    import os

    assert not os.path.exists(inner.removeprefix("file://"))
