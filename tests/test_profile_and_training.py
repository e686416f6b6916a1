import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from schemaloom.operators import profile as P
from schemaloom.operators import training as T


@pytest.mark.parametrize("values", [[1, 2, 3, 4, 10], [5, 5, 5], [0.5, -3, 7.25, 7.25, 2], list(range(100)), [1, 1000000]])
def test_histogram_equals_numpy(spark, values):
    df = spark.createDataFrame([("k", float(v)) for v in values] + [("k", None)], "k string, v double")
    got = P.histogram(df, ["k"], "v").orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=5)
    assert [r.n for r in got] == counts.tolist()
    assert np.allclose([r.low for r in got], edges[:-1]) and np.allclose([r.high for r in got], edges[1:])


def test_profile(spark):
    rows = [("1;2", "a|b", "x", None, "4"), ("3", " a ", "2", None, None), ("na", None, "x", None, "4"), ("5", "", "y; 7", None, "4")]
    df = spark.createDataFrame(rows, "num string, `tab\t ` string, both string, none string, one string")
    got = {r.column_name: r for r in P.column_profile(df).collect()}
    assert {k: v.type for k, v in got.items()} == {"num": "number", "tab": "string", "both": "mixed", "none": "unknown", "one": "number"}
    assert got["tab"]["values"] == ["a", "b"] and got["tab"].bins == ["a", "b", "NA"] and got["tab"].counts == [2, 1, 1]
    assert got["both"]["values"] == ["x", "y"] and got["both"].n_numbers == 2
    assert got["none"].bins == ["NA"] and got["none"].counts == [4]
    assert got["num"].counts == [1, 1, 1, 0, 1]
    model = json.loads(P.profile_model(P.column_profile(df.withColumn("f", F.lit("t.csv")), keep=["f"]), "f").first().json)
    assert [p["name"] for p in model["nodes"][0]["properties"]] == ["num", "tab", "both", "none", "one"] and model["nodes"][0]["name"] == ""


def test_missing_and_counts(spark):
    df = P.null_missing(spark.createDataFrame([("NA", 1), ("nan", 2), ("ok", 3)], "a string, b int"))
    assert [r.a for r in df.orderBy("b").collect()] == [None, None, "ok"]
    counts = P.value_counts(spark.createDataFrame([("b", 0), ("a", 1), ("c", 2), ("c", 3), (None, 4)], "v string, o int"), [], "v", "o")
    assert [(r.v, r.n) for r in counts.orderBy("rk").collect()] == [("c", 2), ("b", 1), ("a", 1)]


def test_lineage(spark):
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    found = T.original_properties(
        frame([("m", "case", "age"), ("m", "case", "case_id"), ("m", "case", "up"), ("m", "case", "")], "model string, node string, property string"),
        frame([("m", "case", "d1")], "model string, node string, original_model string"),
        frame([("d1", "case", "age"), ("d2", "subject", "subject_id"), ("d1", "parent", "up"), ("d1", "parent", "age")], "domain string, node string, property string"),
        frame([("case", "subject")], "node string, alternate string"),
        frame([("m", "case", "parent")], "model string, node string, parent string"),
    )
    got = sorted((r.property, r.domain, r.original_node, r.original_property) for r in found.collect())
    assert got == [("age", "d1", "case", "age"), ("case_id", "d2", "subject", "subject_id"), ("up", "d1", "parent", "up")]
    assert len(T.lineage_lists(found).collect()) == 3


def test_filters(spark):
    rows = [("n", "p", "t", "q"), ("n", "", "t", "q"), ("n", "p", "t", None), ("n", "id", "t", "q"), ("n", "p", "project", "q"), ("n", "p", "skip", "q"), ("n", "grid", "t", "q")]
    df = spark.createDataFrame(rows, "source_node string, source_property string, target_node string, target_property string").withColumn("target_model", F.lit("m"))
    assert T.keep_for_training(df).count() == 3
    assert T.keep_for_training(df, skip=spark.createDataFrame([("m", "skip")], "target_model string, node string")).count() == 2
    lines = spark.createDataFrame([("h",), ("x",), ("a\tharmonized_model_node_prop_desc",)], "l string")
    assert [r.l for r in T.not_header(lines, "l", "h").collect()] == ["x"]
    groups = spark.createDataFrame([("g", "t1", "x"), ("g", "t2", None), ("h", "t1", "y"), ("h", "t2", "z")], "g string, t string, v string")
    assert {r.g for r in T.complete_groups(groups, "g", "t", F.col("v").isNotNull()).collect()} == {"h"}
    assert T.at_least(groups, ["v"], 2).count() == 0 and T.at_least(groups, ["g"], 2).count() == 4
    assert T.restrict(groups, "g", ["g"]).count() == 2 and T.drop_nulls(groups).count() == 3
    keys = spark.createDataFrame([("a",), ("a.b",), ("a.b.c",)], "k string")
    assert T.exact_keys(keys, "k").count() == 1 and T.exact_keys(keys, "k", False).count() == 2


def test_pairs_and_triplets(spark):
    cases = spark.createDataFrame([(1, "h1\th2\nn.a: x\tt.b: y, z\n\nbad line")], "test_id int, m string")
    got = T.mapping_pairs(cases, "m", ["test_id"]).orderBy("line_ord").collect()
    assert [(r.source, r.target, r.error) for r in got] == [("n.a: x", "t.b: y, z", False), ("bad line", None, True)]
    pairs = spark.createDataFrame([(1, "n.a: x, w", "t", "b", "t.b: y, z"), (2, "s", "t", "b", "p")], "test_id int, anchor string, node string, property string, positive string")
    lines = spark.createDataFrame([(1, 0, 0, "t", "b", "t.b (s): y, z"), (1, 0, 1, "t", "c", "t.c (s): u,v")], "test_id int, node_ord int, prop_ord int, node string, property string, line string")
    rows = {r.test_id: r for r in T.triplets(pairs, lines).collect()}
    assert (rows[1].anchor, rows[1].positive, json.loads(rows[1].negatives)) == ("n.a: x; w", "t.b: y; z", ["t.c (s): u;v"])
    assert json.loads(rows[2].negatives) == []
    assert T.mapping_texts(spark.createDataFrame([("k", "b"), ("k", "a"), ("k", "a"), ("j", None)], "k string, l string"), "k", "l").collect()[0].mapping == "a\nb"


def test_splits(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("line"))
    exact = T.exact_split(df, "line", [40, 30, 30], seed=3)
    assert {r.split: r.n for r in T.split_tallies(exact).collect()} == {0: 400, 1: 300, 2: 300}
    again = T.exact_split(df.repartition(7), "line", [40, 30, 30], seed=3)
    assert exact.exceptAll(again).count() == 0 and exact.select("line").distinct().count() == 1000
    assert T.exact_split(df, "line", [40, 30, 30], seed=4).exceptAll(exact).count() > 0
    parts = {r.split: r.n for r in T.split_tallies(T.hash_split(df, "line", {"a": 0.8, "b": 0.2}, seed=1)).collect()}
    assert 750 < parts["a"] < 850 and sum(parts.values()) == 1000
    with pytest.raises(ValueError):
        T.exact_split(df, "line", [50, 40])
    with pytest.raises(ValueError):
        T.hash_split(df, "line", {"a": 0.5})
    assert T.first_rows(df, 3, ["line"]).count() == 3


def test_triplets_of_one_large_model_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(T, "TRIPLET_ROWS", 50)
    lines = spark.range(600).selectExpr("'t' AS test_id", "0 AS node_ord", "id AS prop_ord", "IF(id = 9, NULL, 'n') AS node", "cast(id % 300 AS string) AS property", "IF(id = 5, NULL, concat('l, \"', id)) AS line")
    pairs = spark.range(300).coalesce(1).selectExpr("'t' AS test_id", "concat('a', id) AS anchor", "'n' AS node", "cast(id AS string) AS property", "'p' AS positive")
    found = T.triplets(pairs, lines)
    rows = found.withColumn("p", F.spark_partition_id()).collect()
    assert len(rows) == 300 and len({r.p for r in rows}) > 1
    for r in rows:
        i = int(r.anchor[1:])
        assert json.loads(r.negatives) == [None if j == 5 else f'l; "{j}' for j in range(600) if j % 300 != i]


def test_what_triplets_send_does_not_grow_with_the_rows_of_a_model(spark, monkeypatch):
    monkeypatch.setattr(T, "TRIPLET_ROWS", 1)
    lines = spark.range(1000).selectExpr("'t' AS test_id", "0 AS node_ord", "id AS prop_ord", "'n' AS node", "cast(id AS string) AS property", "sha2(cast(id AS string), 256) AS line")
    pairs = lines.select("test_id", F.concat(F.lit("a"), "property").alias("anchor"), "node", "property", F.lit("p").alias("positive"))
    sent = lambda: sum(e.totalShuffleWrite() for e in [told.apply(i) for told in [spark.sparkContext._jsc.sc().statusStore().executorList(True)] for i in range(told.size())])
    before = sent()
    found = T.triplets(pairs, lines).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("negatives")).alias("chars")).first()
    assert (found.n, found.chars) == (1000, 1000 * (999 * 67 + 1))
    assert sent() - before < 10_000_000  # the model's text of 67,000 bytes for each of 16 tasks, not for each of 1000 rows


def test_triplets_cut_the_first_the_last_the_only_and_many_lines(spark):
    lines = spark.createDataFrame([(1, i, k, f"l{i}") for i, k in enumerate("abca")] + [(2, 0, "a", "é,"), (3, 0, "a", "x"), (3, 1, "a", "y")], "test_id int, prop_ord int, property string, line string")
    lines = lines.selectExpr("test_id", "0 AS node_ord", "prop_ord", "'n' AS node", "property", "line")
    pairs = spark.createDataFrame([(1, k) for k in "abcd"] + [(2, "a"), (2, "b"), (3, "a"), (4, "a")], "test_id int, property string").selectExpr("test_id", "property AS anchor", "'n' AS node", "property", "'p' AS positive")
    got = {(r.test_id, r.anchor): json.loads(r.negatives) for r in T.triplets(pairs, lines).collect()}
    assert got == {
        (1, "a"): ["l1", "l2"], (1, "b"): ["l0", "l2", "l3"], (1, "c"): ["l0", "l1", "l3"], (1, "d"): ["l0", "l1", "l2", "l3"],
        (2, "a"): [], (2, "b"): ["é;"], (3, "a"): [], (4, "a"): [],
    }
