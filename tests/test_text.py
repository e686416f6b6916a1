import pytest
from pyspark.sql import functions as F

from schemaloom.functions import text as tx


def one(spark, expression, **values):
    names = {k: F.lit(v) for k, v in values.items()}
    return spark.range(1).select(*[c.alias(k) for k, c in names.items()]).select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    "line, want",
    [
        ("n.weight (kg) (number): w", ("n", "weight (kg)", "number", "w")),
        ("n.a:b (string): d", ("n", "a", "", "b (string): d")),
        ("n.p (st)ring): d", ("n", "p (st)ring)", "", "d")),
        ("n.p (t): a\nb", ("", "", "", "")),
        ("no dot: desc. more: x", ("no dot: desc", "more", "", "x")),
        (".col (number): col", ("", "col", "number", "col")),
        ("n.p: d", ("n", "p", "", "d")),
        ("n.p (t): a\rb c", ("n", "p", "t", "a\rb c")),
        ("  n . p  ( t ):  d  ", ("n", "p", "t", "d")),
        ("nothing", ("", "", "", "")),
        ("", ("", "", "", "")),
        (None, ("", "", "", "")),
    ],
)
def test_parse_line(spark, line, want):
    df = spark.createDataFrame([(line,)], "line string")
    assert tuple(df.select(tx.parse_line(F.col("line")).alias("x")).first().x) == want


def test_render_and_parse_are_inverse(spark):
    df = spark.createDataFrame([("node", "prop", "string", "a\tb\nc"), ("n", "p", "", "")], "n string, p string, t string, d string")
    lines = df.select(tx.render_line(*map(F.col, "nptd")).alias("l"))
    assert [r.l for r in lines.collect()] == ["node.prop (string): a    b c", "n.p (): "]
    assert [tuple(r.x) for r in lines.select(tx.parse_line(F.col("l")).alias("x")).collect()] == [("node", "prop", "string", "a    b c"), ("n", "p", "", "")]


@pytest.mark.parametrize("key, want", [("Table1.foo", "EX:Table1_foo"), ("a b.c-d.e", "EX:a_b_c_d_e"), ("--x.y--", "EX:x_y"), ("plain", "EX:plain"), ("é.ü ", "EX:é_ü")])
def test_curie(spark, key, want):
    assert one(spark, tx.curie(F.col("k")), k=key) == want


def test_small_expressions(spark):
    assert one(spark, tx.py_strip(F.col("a")), a=" \t x  \n") == "x"
    assert one(spark, tx.render_untyped(F.lit("n"), F.lit("p"), F.lit(None).cast("string"))) == "n.p: "
    assert tuple(one(spark, tx.split_at_colon(F.col("a")), a="p : d: e")) == ("p", "d: e")
    assert tuple(one(spark, tx.split_at_colon(F.col("a")), a="p")) == ("p", "")
    assert one(spark, tx.key_node(F.col("a")), a="a.b.c") == "a"
    assert one(spark, tx.key_tail(F.col("a")), a="a.b.c") == "b.c"
    assert one(spark, tx.key_dots(F.col("a")), a="a.b.c") == 2
    assert one(spark, tx.rename_in(F.lit("case_id"), F.lit("case"), F.lit("subject"))) == "subject_id"
    assert one(spark, tx.semicolons(F.lit("a,b,c"))) == "a;b;c"
    assert one(spark, tx.python_list(F.array(F.lit("string"), F.lit("null")))) == "['string', 'null']"
    assert one(spark, tx.mapping_line(F.lit("a.b"), F.lit("c.d"))) == "a.b".ljust(50) + " -> c.d"
    assert one(spark, tx.mapping_line(F.lit("a" * 60), F.lit("c" * 40))) == "a" * 60 + " -> " + "c" * 40
    assert one(spark, tx.short_id(F.lit("/x/y/abcdefghijklmnopqrstuvwxyz.jsonl"))) == "abcdefghijklmnopqrst"
    assert one(spark, tx.display_name(F.lit("k"), {"k": "K"})) == "K" and one(spark, tx.display_name(F.lit("z"), {"k": "K"})) == "z"
    assert one(spark, tx.study_id(F.lit("/d/phs000123.v1.json"))) == "phs000123.v1"
    assert one(spark, tx.document_text(F.lit(1), F.lit("t"), F.lit(0.5))) == "1. [0.500] t"
    assert one(spark, tx.is_comment(F.lit("  # x"))) and not one(spark, tx.is_comment(F.lit("x # y")))
    assert one(spark, tx.ends_with_any(F.lit("steroid "), ["id"])) and not one(spark, tx.ends_with_any(F.lit("idx"), ["id"]))
    assert one(spark, tx.shorter_than(F.lit(" abc "), 4)) and not one(spark, tx.shorter_than(F.lit("abcd"), 4))
    with pytest.raises(ValueError):
        tx.shorter_than(F.lit("a"), 0)


@pytest.mark.parametrize("cell, want", [("1", 1.0), (" -2.5e3 ", -2500.0), (".5", 0.5), ("1d", None), ("NaN", None), ("1_000", None), ("", None), ("0x1", None)])
def test_typed_number(spark, cell, want):
    assert one(spark, tx.typed_number(F.col("a")), a=cell) == want
