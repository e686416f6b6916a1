from pyspark.sql import functions as F

from schemaloom.operators import joins as J
from schemaloom.operators import metrics as M
from schemaloom.operators import sets as S


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_null_safe_match(spark):
    a = spark.createDataFrame([("x", None), ("y", "t")], "name string, type string")
    b = spark.createDataFrame([("x", None, "g"), ("y", None, "h"), ("y", "t", None)], "name string, type string, target string")
    assert rows(J.null_safe_match(a, b, ["name", "type"], ["target"]), "name", "m_target") == [("x", "g")]


def test_lookups(spark):
    a = spark.createDataFrame([("k1",), ("k2",), (None,)], "key string")
    t = spark.createDataFrame([("k1", "v1"), (None, "never")], "key string, value string")
    assert sorted(map(str, rows(J.lookup(a, t, "key", "value").fillna("-"), "value"))) == ["('-',)", "('k2',)", "('v1',)"]
    keys = spark.createDataFrame([("a.p", 2), ("b.p", 1), ("c.d.q", 0), ("plain", 3)], "key string, ord int")
    names = spark.createDataFrame([("p",), ("d.q",), ("q",), ("z",)], "name string")
    assert rows(J.first_suffix_match(names, keys), "name", "match") == [("d.q", "c.d.q"), ("p", "b.p"), ("q", "c.d.q"), ("z", "z")]
    table = spark.createDataFrame([("d1", "n1", "l1", 0), ("d1", "n2", "l2", 1), (None, "n3", "l3", 2)], "description string, name string, line string, ord int")
    want = spark.createDataFrame([("d1", "x"), ("dx", "n3"), (None, "none")], "description string, name string")
    assert sorted(map(str, rows(J.description_match(want, table, "description", "name", "line", "ord"), "name", "line"))) == ["('n3', 'l3')", "('none', None)", "('x', 'l2')"]


def test_fallback_and_synonyms(spark):
    catalog = spark.createDataFrame([("child", "own", "1"), ("p1", "up", "2"), ("p2", "up", "3")], "node string, name string, value string")
    parents = spark.createDataFrame([("child", "p2", 0), ("child", "p1", 1)], "node string, parent string, parent_ord int")
    asked = spark.createDataFrame([("child", "own"), ("child", "up"), ("child", "no")], "node string, name string")
    assert sorted(map(str, rows(J.with_fallback(asked, parents, catalog, "node", "name", "value"), "name", "value"))) == ["('no', None)", "('own', '1')", "('up', '3')"]
    found = J.synonyms(spark.createDataFrame([("case", "case_id")], "node string, property string"), spark.createDataFrame([("case", "subject")], "node string, alternate string"), spark.createDataFrame([("d1", "subject"), ("d1", "subject"), ("d2", "x")], "domain string, node string"))
    assert rows(found, "domain", "renamed") == [("d1", "subject_id")]
    assert J.domains_of_nodes(spark.createDataFrame([("d", "n"), ("d", "n")], "domain string, node string")).count() == 1


def test_renamed_keys_and_unknown_keys(spark):
    var_map = spark.createDataFrame([("n", "N", "d"), ("n.p", "P", "e"), ("m.fk.q", "Q", "f")], "key string, new_name string, new_description string")
    assert sorted(map(str, rows(J.renamed_keys(var_map), "key", "tail", "new_node", "missing"))) == ["('m.fk.q', 'fk.q', None, True)", "('n.p', 'n.p', 'N', False)"]
    mapping = spark.createDataFrame([(1, "a.b", "c.d"), (1, "a.x", ""), (2, "a.b", None)], "test_id int, source_key string, target_key string")
    keys = lambda *k: spark.createDataFrame(list(k), "test_id int, key string")
    strict = J.unknown_keys(mapping, keys((1, "a.b")), keys((1, "c.d")))
    assert sorted(map(str, rows(strict, "test_id", "side", "key"))) == ["(1, 'source', 'a.x')", "(1, 'target', '')", "(2, 'source', 'a.b')", "(2, 'target', None)"]
    assert rows(J.unknown_keys(mapping, keys((1, "a.b")), keys((1, "c.d")), skip_blank=True), "test_id", "key") == [(1, "a.x"), (2, "a.b")]


def pairs(spark, *items):
    return spark.createDataFrame([(c, *p.split(".")) for c, p in items], "test_id int, source_node string, source_property string, target_node string, target_property string")


def test_case_metrics(spark):
    suggested = pairs(spark, (1, "a.b.c.d"), (1, "a.b.c.d"), (1, "a.b.c.e"), (2, "x.y.z.w"))
    expected = pairs(spark, (1, "a.b.c.d"), (1, "q.r.s.t"), (3, "m.n.o.p"))
    cases = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "test_id int")
    got = {r.test_id: r for r in M.case_metrics(suggested, expected, cases).collect()}
    r = got[1]
    assert (r.n_suggested, r.n_expected, r.n_correct, r.precision, r.recall, r.overall_accuracy, r.f1_score) == (2, 2, 1, 0.5, 0.5, 0.5, 0.5)
    assert r.missing_mappings == ["q.r -> s.t"]
    assert (got[2].precision, got[2].recall, got[2].f1_score, got[2].missing_mappings) == (0.0, 0.0, 0.0, [])
    assert got[3].missing_mappings == ["m.n -> o.p"] and (got[4].n_suggested, got[4].n_expected) == (0, 0)
    assert M.correct_pairs(suggested, expected).count() == 1 and M.missing_pairs(suggested, expected).count() == 2


def test_means_and_best(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 0.0)], "target string, recall double")
    got = {r.target: (r.mean_recall, r.n, r.is_total) for r in M.metrics_by(df, "target", ["recall"]).collect()}
    assert got == {"a": (1.0, 2, 0), "b": (0.0, 1, 0), None: (2 / 3, 3, 1)}
    assert {round(r.mean_recall, 6) for r in M.with_overall_mean(df, "recall").collect()} == {0.666667}
    s = spark.createDataFrame([("x", 0.5, 2), ("x", 0.5, 1), ("y", 0.1, 9)], "src string, score double, t int")
    assert rows(M.best_per_source(s, ["src"], "score", ["t"]), "src", "t") == [("x", 1), ("y", 9)]
    assert M.rows_by_label(s, spark.createDataFrame([("y",)], "src string"), "src").count() == 1
    numbered = M.metrics_rows(spark.createDataFrame([("f", 3, 0.1), ("f", 1, 0.2)], "file string, o int, m double"), "file", "o", ["m"])
    assert rows(numbered, "row", "m") == [(1, 0.2), (2, 0.1)]


def test_sets(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "x int"), spark.createDataFrame([(2, "z")], "x int, y string")
    assert S.union_all([a, b]).columns == ["x", "y"] and S.union_all([a, b]).count() == 4
    assert rows(S.intersection(a, b), "x") == [(2,)] and S.difference(a, b).count() == 2
    assert S.distinct_lines(a.select(F.col("x").cast("string").alias("l")), "l").count() == 2


def test_repeated_keys_give_the_last_value(spark):
    table = spark.createDataFrame([("a", "first", 1), ("a", "last", 2), ("a", "zz", 0), ("b", None, 3), ("b", "x", 1), (None, "n", 1)], "k string, v string, o int")
    rows = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string")
    got = {r.k: r.v for r in J.lookup(rows, table, "k", "v", F.lit("none"), ordinal="o").collect()}
    assert got == {"a": "last", "b": "none", "c": "none", None: "none"}
    assert {r.k: r.v for r in J.lookup(rows, table, "k", "v").collect()} == {"a": "zz", "b": "x", "c": "c", None: None}
    catalog = spark.createDataFrame([("n", "p", "first", 1), ("n", "p", "last", 2), ("up", "q", "old", 1), ("up", "q", "new", 5)], "node string, name string, value string, o int")
    parents = spark.createDataFrame([("n", "up", 0)], "node string, parent string, parent_ord int")
    wanted = spark.createDataFrame([("n", "p"), ("n", "q"), ("n", "r")], "node string, name string")
    found = J.with_fallback(wanted, parents, catalog, "node", "name", "value", ordinal="o").collect()
    assert {r["name"]: r.value for r in found} == {"p": "last", "q": "new", "r": None}
