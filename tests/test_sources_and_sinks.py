import bz2
import csv
import gzip
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from schemaloom.operators.approach import ExampleApproach, NothingFound, SimilarityApproach, display_table, mapping_rows
from schemaloom.operators.models import parse
from schemaloom.plans.evaluate import run_benchmark, still_to_do
from schemaloom.sources import readers, writers
from schemaloom.streaming.landing import each_batch, event_counts, landing_lines


def model(node, *names):
    return {"nodes": [{"name": node, "description": node, "properties": [{"name": n, "description": f"the {n} of it", "type": "string"} for n in names]}]}


CASES = [
    {"input_source_model": model("a", "sample_type", "age"), "input_target_model": json.dumps(model("t", "sample type", "age at visit", "zip")), "harmonized_mapping": "s\tt\na.sample_type (string): x\tt.sample type (string): y\n\"a.age (string): q\"\tt.age at visit: z\n"},
    {"input_source_model": model("b", "zipcode"), "input_target_model": json.dumps(model("t", "sample type", "age at visit", "zip")), "harmonized_mapping": "h\th\nnonsense\tt.zip: y\n", "extra": 1},
]


@pytest.fixture()
def jsonl(tmp_path):
    path = tmp_path / "cases.jsonl"
    path.write_text(json.dumps(CASES[0]) + "\n\n{broken\n" + json.dumps(CASES[1]) + "\n")
    return f"file://{path}"


def test_json_lines(spark, jsonl):
    assert readers.read_json_lines(spark, jsonl, ["input_target_model", "extra"]).count() == 2
    r = readers.rejected_lines(spark, jsonl).first()
    assert (r.n_blank, r.n_broken) == (1, 1)
    cases = readers.benchmark_cases(readers.read_lines(spark, jsonl)).orderBy("line_no").collect()
    assert [c.line_no for c in cases] == [1, 4] and json.loads(cases[0].source_model) == CASES[0]["input_source_model"]
    assert cases[0].target_key == cases[1].target_key


def test_benchmark_runner(spark, jsonl, tmp_path):
    cases = readers.benchmark_cases(readers.read_lines(spark, jsonl))
    done = run_benchmark(cases, k=1, source_format="simple", target_format="simple")
    rows = {json.loads(r.line)["harmonized_mapping"][:1]: json.loads(r.line) for r in done.lines.collect()}
    first, second = rows["s"], rows["h"]
    assert first["custom_metrics"]["recall"] == 1.0 and first["custom_metrics"]["n_suggested"] == 2
    assert second["custom_metrics"]["n_expected"] == 1 and second["custom_metrics"]["missing_mappings"] == [". -> t.zip"]
    assert {k: v for k, v in second.items() if k != "custom_metrics"} == CASES[1]
    assert still_to_do(cases, cases.limit(1)).count() == 0
    writers.write_json_lines(done.lines, f"file://{tmp_path}/out", "line")
    assert readers.read_json_lines(spark, f"file://{tmp_path}/out", ["custom_metrics"]).count() == 2


def test_mapping_text_is_read_as_csv(spark):
    text = 'h\th\n"n.p: a ""b""\tc"\tt.q: d\n"n.r: x\ny"\tt.s: e\n'
    df = spark.createDataFrame([(1, text)], "test_id int, harmonized_mapping string")
    got = readers.expected_mappings(df).orderBy("line_ord").collect()
    assert [(r.source_node, r.source_property, r.source_description) for r in got] == [("n", "p", 'a "b"\tc'), ("", "", "")]
    for bad in ("", "h\th\n\nx\ty\n", "h\nonly one\n"):
        with pytest.raises(Exception, match="mapping|fields"):
            readers.expected_mappings(spark.createDataFrame([(1, bad)], "test_id int, harmonized_mapping string")).collect()


def test_approaches(spark):
    source = parse(spark.createDataFrame([(7, json.dumps(model("a", "sample_type")))], "model_id bigint, json string"), "simple")
    target = parse(spark.createDataFrame([(8, json.dumps(model("t", "zip", "sample type")))], "model_id bigint, json string"), "simple")
    found = SimilarityApproach(k=1).suggest(source, target).first()
    assert (found.test_id, found.source_property, found.target_property, found.source_description, found.rk) == (7, "sample_type", "sample type", "the sample_type of it", 1)
    with pytest.raises(NothingFound):
        SimilarityApproach(threshold=0.9999).suggest(source, target, must_match=True)
    assert len(display_table(SimilarityApproach().suggest(source, target)).columns) == 5


def test_mapping_set(spark, tmp_path):
    example = ExampleApproach(spark).suggest(None, None)
    assert {(r.subject_id, r.object_id) for r in mapping_rows(example).collect()} == {("EX:Table1_foo", "EX:TableA_bar"), ("EX:Table2_baz", "EX:TableB_buzz")}
    writers.write_mapping_set(spark, example, f"file://{tmp_path}/set")
    lines = [x for p in sorted((tmp_path / "set").glob("part-*")) for x in p.read_text().splitlines()]
    body = [x for x in lines if not x.startswith("#")]
    assert lines[0] == "# curie_map:" and body[0].startswith("subject_id\t") and len(body) == 3
    assert "Table1.foo" in body[1] and "TableA.bar" in body[1] and "TableB.buzz" in body[2]
    writers.write_mapping_set(spark, example, f"file://{tmp_path}/clean", comments=False)
    assert not any(x.startswith("#") for p in (tmp_path / "clean").glob("part-*") for x in p.read_text().splitlines())


def test_tables(spark, tmp_path):
    (tmp_path / "a.tsv").write_text(' x \ty\n1\tNA\n"q\tr"\tz\n')
    df = readers.read_table(spark, f"file://{tmp_path}/a.tsv")
    assert df.columns == ["x", "y"] and [tuple(r) for r in df.collect()] == [("1", None), ("q\tr", "z")]
    nested = df.withColumn("n", F.struct("x"))
    writers.write_table(nested, f"file://{tmp_path}/b", "\t", "N/A")
    text = "".join(p.read_text() for p in sorted((tmp_path / "b").glob("part-*")))
    assert "N/A" in text and list(csv.reader(io.StringIO(text), delimiter="\t"))[0] == ["x", "y", "n"]
    lines = spark.createDataFrame([(1, 0, "a\tb", 'c"d')], "k int, o int, s string, t string")
    text = writers.mapping_text(lines, "k", "s", "t", "h1\th2", "o").first().mapping
    assert list(csv.reader(io.StringIO(text), delimiter="\t")) == [["h1", "h2"], ["a\tb", 'c"d']]
    assert "not measured" in writers.markdown_rows(lines.withColumn("m", F.lit(None).cast("double")), "k", ["m"]).first().report


def test_files_by_key_and_row(spark, tmp_path):
    df = spark.createDataFrame([("k1", 1, "a"), ("k2", 2, "b")], "key string, n int, line string")
    writers.write_by_key(df, f"file://{tmp_path}/k", "key", "line")
    assert {p.name for p in (tmp_path / "k").glob("key=*")} == {"key=k1", "key=k2"}
    writers.one_file_each(df, f"file://{tmp_path}/n", "n", "line")
    with pytest.raises(ValueError):
        writers.one_file_each(df, f"file://{tmp_path}/m", "n", "line", most=1)


def test_files_and_folders(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "good.json").write_text('{"a": 1}')
    (tmp_path / "x" / "bad.json").write_text("{")
    got = {r.path.rsplit("/", 1)[1]: r.error for r in readers.read_json_files(spark, f"file://{tmp_path}/x").collect()}
    assert got == {"good.json": None, "bad.json": "not JSON"}
    for f, names in (("f1", ["source.json", "target.json", "expected.tsv"]), ("f2", ["source.json"])):
        (tmp_path / "t" / f).mkdir(parents=True)
        for n in names:
            (tmp_path / "t" / f / n).write_text(n)
    assert [r.harmonized_mapping for r in readers.model_folders(spark, f"file://{tmp_path}/t").collect()] == ["expected.tsv"]
    files = readers.files_matching(spark, f"file://{tmp_path}/t", exclude=["source.json"])
    assert files.count() == 2 and readers.files_matching(spark, f"file://{tmp_path}/t", include=["source.json"]).count() == 2
    (tmp_path / "arr.json").write_text('[{"tinyId": "1", "designations": [{"designation": "A"}, {"designation": "B"}], "nihEndorsed": true}, {"tinyId": "2"}]')
    elements = readers.common_elements(readers.read_json_array(spark, f"file://{tmp_path}/arr.json"), "u/").orderBy("tinyId").collect()
    assert elements[0].names == ["A", "B"] and elements[0].source == "u/1" and elements[0].nihEndorsed
    assert readers.catalogue_of(spark, {"d": "p"}, {"e": "d"}).count() == 2


def test_streams(spark, jsonl, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "1.jsonl").write_text('{"a": 1}\n\nbroken\n{"a": 2}\n')
    work = lambda batch: batch.select(F.get_json_object("line", "$.a").alias("a"))
    for _ in range(2):  # the second run finds nothing new
        each_batch(landing_lines(spark, f"file://{landing}"), work, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    assert sorted(r.a for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == ["1", "2"]
    events = spark.createDataFrame([("2020-01-01 00:10:00", "a"), ("2020-01-01 00:50:00", "a"), ("2020-01-01 01:00:00", "a")], "ts string, event_type string")
    assert sorted(r.n for r in event_counts(events.withColumn("ts", F.to_timestamp("ts"))).collect()) == [1, 2]


def test_lines_are_numbered_over_the_parts_of_a_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i}\r\n" if i % 7 else "\n" for i in range(1, 2001)))
    (tmp_path / "b.txt").write_text("only\n\nlast")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = readers.read_lines(spark, f"file://{tmp_path}").collect()
        assert len({r.path for r in rows}) == 2
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    a = {r.line_no: r.line for r in rows if r.path.endswith("a.txt")}
    assert a == {i: f"line {i}" for i in range(1, 2001) if i % 7}
    assert {r.line_no: r.line for r in rows if r.path.endswith("b.txt")} == {1: "only", 3: "last"}


def test_json_lines_to_a_table_by_the_first_record(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('\n{"b": "x, y", "a": 1.5}\nbroken\n{"a": {"c": [1]}}\n{"b": null}\n')
    assert writers.json_lines_to_table(spark, f"file://{tmp_path}/a.jsonl", f"file://{tmp_path}/out") == ["b", "a"]
    rows = sorted((r.b or "", r.a or "") for r in spark.read.csv(f"file://{tmp_path}/out", header=True, escape='"').collect())
    assert rows == [("", ""), ("", '{"c":[1]}'), ("x, y", "1.5")]
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n{"a": 2, "more": 3}\n')
    with pytest.raises(ValueError, match="more"):
        writers.json_lines_to_table(spark, f"file://{tmp_path}/b.jsonl", f"file://{tmp_path}/out2")
    (tmp_path / "c.jsonl").write_text("\n")
    with pytest.raises(ValueError, match="no records"):
        writers.json_lines_to_table(spark, f"file://{tmp_path}/c.jsonl", f"file://{tmp_path}/out3")


def test_lines_that_are_more_than_one_object_are_broken(spark):
    good = ['{"a":1}', ' {"a":[1,{"b":"]},{"}]} ', "{}", '{"a":NaN}']
    bad = ['{"a":1}]', '{"a":1} x', '{"a":1', '{"a":1}{"b":2}', '{"a":1},{"b":2}', "[1]", '"x"', '{"a":1},', "{'a':1}", "7", "null", "", None]
    rows = spark.createDataFrame([(t,) for t in good + bad], "t string").select(readers.json_object(F.col("t")).isNotNull().alias("ok")).collect()
    assert [r.ok for r in rows] == [True] * len(good) + [False] * len(bad)
