import json

import pytest

from schemaloom.operators import models as M


def frame(spark, *jsons):
    return spark.createDataFrame([(i, j if isinstance(j, (str, type(None))) else json.dumps(j)) for i, j in enumerate(jsons)], "model_id bigint, json string")


def properties(found):
    rows = found.properties.orderBy("model_id", "node_ord", "prop_ord").collect()
    return [(r.model_id, r.node_name, r.property_name, r.property_description, r.property_type) for r in rows]


def valid(found):
    return {r.model_id: r.valid for r in found.valid.collect()}


SIMPLE = {
    "nodes": [
        {"name": "a", "description": "A", "links": ["b"], "properties": [{"name": "p", "description": "d\te", "type": "string"}, {"name:": "q"}, {"name": "visit_id", "type": ["string", "null"]}]},
        {"name:": "empty", "properties": []},
    ]
}
DICTIONARY = {
    "_settings": {"x": 1},
    "root": {"description": "r", "properties": {}},
    "case": {
        "description": "a case",
        "links": [{"name": "studies"}, {"subgroup": []}],
        "properties": {
            "sex": {"enum": ["f", "m"], "description": "s"},
            "age": {"type": "integer", "term": {"description": "years", "termDef": {"id": 7}}},
            "studies": {"anyOf": [{"items": {"properties": {"id": {"type": "string"}, "code": {"enum": ["x"]}}}}, {"type": "array"}]},
            "case_id": {"type": "string"},
        },
    },
    "sample": {"description": "a sample", "links": {"subgroup": [{"name": "cases"}]}, "properties": {}},
}
LINKED = {"$defs": {"n": {"description": "N", "title": "T", "properties": {"p": {"type": "string", "description": "d", "unit": "kg"}}}}}


def test_simple(spark):
    found = M.parse_simple(frame(spark, SIMPLE))
    assert properties(found) == [(0, "a", "p", "d\te", "string"), (0, "a", "q", "", ""), (0, "a", "visit_id", "", "['string', 'null']")]
    nodes = found.nodes.orderBy("node_ord").collect()
    assert [(n.node_name, n.node_description, n.links) for n in nodes] == [("a", "A", ["b"]), ("empty", "", [])]
    assert found.properties.where("prop_ord = 0").first().npd == "a.p (string): d    e"
    assert [p[2] for p in properties(M.parse_simple(frame(spark, SIMPLE), ["id"]))] == ["p", "q"]


@pytest.mark.parametrize(
    "model",
    [{"nodes": [{"name": "a", "properties": [{"name": None}]}]}, {"nodes": [{"name": "a", "properties": [{"name": "p", "description": None}]}]}, {"nodes": [{"name": "a"}]}, {"x": []}, "no json", "[1]", None, ""],
)
def test_simple_rejects_the_model(spark, model):
    found = M.parse_simple(frame(spark, model, SIMPLE))
    assert valid(found) == {0: False, 1: True}
    assert {p[0] for p in properties(found)} == {1}


def test_repeated_keys_count_once_with_the_last_value(spark):
    found = M.parse_simple(frame(spark, '{"nodes":[{"name":"a","properties":[{"name":"x","name":"y","type":"t"}]}]}'))
    assert properties(found) == [(0, "a", "y", "", "t")]
    found = M.parse_prefixed(frame(spark, '{"n":{"properties":{"p":{"type":"1"},"q":{"type":"2"},"p":{"type":"3"}}}}'))
    assert [(p[2], p[4]) for p in properties(found)] == [("p", "3"), ("q", "2")]


def test_dictionary(spark):
    found = M.parse_dictionary(frame(spark, DICTIONARY))
    assert properties(found) == [(0, "case", "sex", "s", "enum"), (0, "case", "age", "years", "integer"), (0, "case", "studie.id", "", "string"), (0, "case", "studie.code", "", "enum"), (0, "case", "case_id", "", "string")]
    assert {n.node_name: n.links for n in found.nodes.collect()} == {"case": ["studies"], "sample": ["cases"]}
    assert json.loads(found.properties.where("property_name = 'age'").first().additional_metadata) == {"cde_info": {"id": 7}}
    assert [p[2] for p in properties(M.parse_dictionary(frame(spark, DICTIONARY), ["id"]))] == ["sex", "age", "studie.code"]
    assert valid(M.parse_dictionary(frame(spark, {"n": {"properties": {}}}, {"n": {"description": "d", "properties": {"p": 1}}}))) == {0: False, 1: False}


def test_prefixed(spark):
    found = M.parse_prefixed(frame(spark, {"_x": 1, "n": {"links": [{"name": "m"}, {}], "properties": {"p": {"enum": ["a"]}, "q": {"values": ["b"], "type": ["x"]}}}}))
    assert [(p.property_name, p.property_type, p.property_values, p.type_is_list) for p in found.properties.orderBy("prop_ord").collect()] == [("p", "", '["a"]', False), ("q", "['x']", '["b"]', True)]
    assert found.nodes.first().links == ["m"]
    assert valid(M.parse_prefixed(frame(spark, DICTIONARY))) == {0: False}  # links with a subgroup


def test_linked(spark):
    found = M.parse_linked(frame(spark, LINKED, {"$defs": {"n": {"properties": {}}}}))
    assert properties(found) == [(0, "n", "p", "d", "string")] and valid(found) == {0: True, 1: False}
    assert json.loads(found.properties.first().additional_metadata) == {"unit": "kg"}
    assert json.loads(found.nodes.first().node_metadata) == {"title": "T"}


def test_unknown_dialects(spark):
    plain = {"n": {"description": "d", "properties": {"p": {"enum": ["a"]}}}}
    df = frame(spark, SIMPLE, DICTIONARY, plain, "x")
    last = {r.model_id: r.chosen for r in M.parse_unknown(df).valid.collect()}
    first = {r.model_id: r.chosen for r in M.parse_unknown(df, detect="first").valid.collect()}
    assert last == {0: "simple", 1: "dictionary", 2: "prefixed", 3: None}
    assert first == {0: "simple", 1: "dictionary", 2: "dictionary", 3: None}
    with pytest.raises(ValueError):
        M.parse_unknown(df, detect="some")
    with pytest.raises(ValueError):
        M.parse(df, "xml")


def test_views_of_a_model(spark):
    found = M.parse(frame(spark, SIMPLE), "simple")
    assert [r.text for r in M.documents(found).orderBy("target_ord").collect()] == ["a.p (string): d    e", "a.q (): ", "a.visit_id (['string', 'null']): "]
    assert M.shape(found).first().properties == ["p", "q", "visit_id"]
    assert {r.key: r.line for r in M.line_lookup(found).collect()}["a.q"] == "a.q (): "
    assert "additional_metadata" in M.property_table(found).columns and M.property_lines(found).count() == 3
    keyed = M.as_keyed(frame(spark, {"nodes": [{"name": "a", "properties": [{"name": "p", "type": "1"}, {"name": "p", "type": "2"}]}]})).first()
    assert json.loads(keyed.properties["p"])["type"] == "2"


def test_empty_table(spark):
    for format in ("simple", "dictionary", "prefixed", "linked", "unknown"):
        found = M.parse(frame(spark, SIMPLE).limit(0), format)
        assert found.properties.count() == found.nodes.count() == found.valid.count() == 0


def test_models_of_one_partition_are_parsed_by_many_tasks_and_json_once(spark):
    from pyspark.sql import functions as F

    rows = spark.range(400).coalesce(1).selectExpr("id AS model_id", """concat('{"nodes":[{"name":"n","description":"d","properties":[{"name":"p', id, '","type":"t"}]}]}') AS json""")
    found = M.parse_simple(rows).properties
    told = found.withColumn("part", F.spark_partition_id()).collect()
    assert len(told) == 400 and len({r.part for r in told}) > 1 and {r.npd for r in told} == {f"n.p{i} (t): " for i in range(400)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 16  # each document, list and property, for the rows and for the bad ones; they were 27


def test_a_model_is_parsed_by_the_chosen_dialect_only(spark):
    rows = spark.createDataFrame([(1, '{"nodes":[{"name":"n","description":"d","properties":[{"name":"p","type":"t"}]}]}'), (2, '{"a":{"description":"d","properties":{"q":{"type":"t"}}}}'), (3, "no")], "model_id bigint, json string")
    found = M.parse_unknown(rows)
    assert {(r.model_id, r.chosen) for r in found.valid.collect()} == {(1, "simple"), (2, "prefixed"), (3, None)}
    assert {(r.model_id, r.property_name) for r in found.properties.collect()} == {(1, "p"), (2, "q")}
    assert "dialects" in "".join(found.properties.inputFiles())  # which dialect it is was written once


def test_a_models_rows_are_judged_in_the_pass_that_parses_them(spark):
    jsons = [json.dumps(SIMPLE), '{"nodes":[{"name":"n","properties":[{"name":"p"}]},{"name":"m","properties":[{"name":"q","type":null}]}]}', '{"nodes":[{"name":"n","properties":[{"name":"p"}]}]}']
    rows = spark.createDataFrame([(0, jsons[0]), (1, jsons[1]), (2, jsons[2]), (2, jsons[1]), (None, jsons[2])], "model_id bigint, json string")
    found = M.parse_simple(rows)
    assert {(r.model_id, r.property_name) for r in found.properties.collect()} == {(0, "p"), (0, "q"), (0, "visit_id"), (None, "p")}  # one bad node, or one bad text of an id, rejects all of it
    assert {r.model_id for r in found.nodes.collect()} == {0, None}


@pytest.mark.parametrize("view", [M.documents, M.shape, M.property_lines, M.line_lookup])
def test_a_view_parses_each_model_once_and_moves_it_once(spark, view):
    found = view(M.parse_simple(frame(spark, SIMPLE)))._jdf.queryExecution()
    plan, steps = found.optimizedPlan().toString(), found.executedPlan().toString()
    assert "Join" not in plan and plan.count("from_json") <= 8  # it was parsed again for the bad models, which were joined
    assert steps.count("Exchange") == 1 and "REPARTITION_BY_NUM" in steps  # the deal of the models
    if view is M.documents:
        assert steps.count("Sort [") == 1  # judged and numbered in one order
