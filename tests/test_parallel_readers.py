import json
import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from schemaloom.sources import parallel, readers


@contextmanager
def small_parts(spark, size):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    try:
        for k in keys:
            spark.conf.set(k, str(size))
        yield
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)


def field(rng):
    parts = ["plain", "", 'say ""no""', "a, b", "line\nfeed", "\n", "é ÿ", "x" * rng.randint(0, 90), "tab\t", "\n\n,", "{[", "17"]
    text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    return f'"{text}"' if any(c in text for c in '",\n') or rng.random() < 0.2 else text


def table_text(seed, rows, end="\n"):
    rng = random.Random(seed)
    lines = ['id,"a name",note,note,,last']
    for i in range(rows):
        lines.append(",".join([str(i), *(field(rng) for _ in range(rng.choice([5, 5, 5, 3, 6])))]))
        lines += [""] * (rng.random() < 0.05)
    return end.join(lines) + end * rng.randint(0, 2)


def whole(spark, path, separator=","):
    return spark.read.csv(path, header=True, sep=separator, multiLine=True, escape='"', quote='"')


def rows_of(df):
    return df.columns, sorted(map(str, df.collect()))


@pytest.mark.parametrize("seed, size", [(1, 300), (2, 900), (3, 1 << 20)])
def test_quoted_tables_are_read_as_by_the_whole_file_reader(spark, tmp_path, seed, size):
    path = tmp_path / "t.csv"
    path.write_text(table_text(seed, 150), newline="")
    with small_parts(spark, size):
        got = rows_of(parallel.read_quoted_table(spark, f"file://{path}"))
    assert got == rows_of(whole(spark, f"file://{path}"))


def test_carriage_returns_marks_and_several_files(spark, tmp_path):
    for n in range(4):
        (tmp_path / f"{n}.csv").write_text("\ufeff" * (n == 1) + "\n" * n + table_text(n, 60, "\r\n" if n % 2 else "\n"), newline="")
    with small_parts(spark, 700):
        got = rows_of(parallel.read_quoted_table(spark, f"file://{tmp_path}"))
    columns, want = None, []
    for n in range(4):
        plain = table_text(n, 60)
        (tmp_path / "one").mkdir(exist_ok=True)
        (tmp_path / "one" / f"{n}.csv").write_text(plain, newline="")
        columns, rows = rows_of(whole(spark, f"file://{tmp_path}/one/{n}.csv"))
        want += rows
    assert got == (columns, sorted(want))


def test_many_parts_are_told_apart_and_one_record_may_fill_them(spark, tmp_path, monkeypatch):
    text = 'a,b\n1,"' + 'long "" line,\n' * 100 + '"\n2,"x\n'  # the last quote is never closed
    (tmp_path / "t.csv").write_text(text)
    with small_parts(spark, 128):
        assert parallel._pieces(spark, f"file://{tmp_path}", parallel.quoted_lines(",")).select("part").distinct().count() > 9
        records = sorted(map(tuple, parallel.table_records(spark, f"file://{tmp_path}").select("record", "head", "value").collect()))
        assert records == [(0, True, "a,b"), (1, False, '1,"' + ('long "" line,\n' * 100) + '"'), (2, False, '2,"x')]
        monkeypatch.setattr(parallel, "MAX_BROADCAST", 1)
        assert sorted(map(tuple, parallel.table_records(spark, f"file://{tmp_path}").select("record", "head", "value").collect())) == records


def test_a_quote_inside_a_field_is_a_character(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n5" pipe,"x"\n"y" z,"1\n2"\n3,4\n')
    with small_parts(spark, 8):
        got = rows_of(parallel.read_quoted_table(spark, f"file://{tmp_path}"))
    assert got == rows_of(whole(spark, f"file://{tmp_path}"))


def test_tables_without_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n")
    assert rows_of(readers.read_table(spark, f"file://{tmp_path}/t.csv")) == (["a", "b"], [])
    (tmp_path / "e.csv").write_text("")
    assert readers.read_table(spark, f"file://{tmp_path}/e.csv").count() == 0


def value(rng, depth=0):
    kinds = [lambda: rng.randint(-9, 9), lambda: rng.choice(["", "a,b", 'q"]"', "[{", "}\\", "é\n", "\\\\"]), lambda: None, lambda: rng.random() < 0.5]
    if depth < 4:
        kinds += [lambda: [value(rng, depth + 1) for _ in range(rng.randint(0, 4))], lambda: {rng.choice("ab,]\"\\"): value(rng, depth + 1) for _ in range(rng.randint(0, 3))}]
    return rng.choice(kinds)()


@pytest.mark.parametrize("seed, size, indent", [(1, 250, None), (2, 900, 2), (3, 1 << 20, None)])
def test_elements_of_arrays_of_several_parts(spark, tmp_path, seed, size, indent):
    rng = random.Random(seed)
    files = {f"{n}.json": [value(rng) for _ in range(rng.choice([0, 1, 60]))] for n in range(4)}
    files["many.json"] = [{"id": i, "v": value(rng)} for i in range(60)]
    for name, items in files.items():
        (tmp_path / name).write_text(("\ufeff \n" if name == "0.json" else "") + json.dumps(items, indent=indent, ensure_ascii=False) + "\n" * rng.randint(0, 1))
    with small_parts(spark, size):
        rows = parallel.json_elements(spark, f"file://{tmp_path}").select(F.element_at(F.split("path", "/"), -1).alias("name"), "place", "json").collect()
    got = {name: [json.loads(r.json) for r in sorted(rows, key=lambda r: r.place) if r.name == name] for name in files}
    assert got == files


def test_files_that_are_no_arrays_are_one_element(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": [1, 2, {"b": "x, y"}], "c": 3}\n')
    (tmp_path / "b.json").write_text("")
    with small_parts(spark, 10):
        rows = parallel.json_elements(spark, f"file://{tmp_path}").collect()
    assert [json.loads(r.json) for r in rows] == [{"a": [1, 2, {"b": "x, y"}], "c": 3}]


def test_arrays_have_the_columns_of_the_whole_file_reader(spark, tmp_path):
    items = [{"id": i, "t": f"x{i}, [y]", "n": {"a": [i, 2]}} for i in range(100)] + [{"id": 100, "extra": True}]
    (tmp_path / "a.json").write_text(json.dumps(items, indent=1))
    with small_parts(spark, 700):
        got = readers.read_json_array(spark, f"file://{tmp_path}")
        assert got.schema == spark.read.json(f"file://{tmp_path}", multiLine=True).schema
        assert sorted(map(str, got.collect())) == sorted(map(str, spark.read.json(f"file://{tmp_path}", multiLine=True).collect()))
