import pytest
from pyspark.sql import functions as F

from schemaloom.operators import profile as P
from schemaloom.plans.lineage import LineageStore, VersionConflict
from schemaloom.plans.training_data import persist_lineage

SCHEMA = "model string, node string, n int"


def content(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_only_what_differs_is_written(spark, tmp_path):
    store = LineageStore(spark, f"file://{tmp_path}/l")
    assert store.contents() is None
    first = [("a", "x", 1), ("a", "x", 1), ("b", "y", None), (None, "z", 3)]
    assert store.add(spark.createDataFrame(first, SCHEMA)) == 3
    assert store.add(spark.createDataFrame(first[::-1], SCHEMA)) == 0 and store.versions() == [1]
    assert store.add(spark.createDataFrame([("a", "x", 1), ("c", "w", 1)], SCHEMA)) == 2  # a lost a row, c is new, b and null are not mentioned
    now = [("a", "x", 1), ("b", "y", None), ("c", "w", 1), (None, "z", 3)]
    assert content(store.contents()) == sorted(now, key=str) and content(store.contents(1)) == sorted(first, key=str)
    store.expire()
    assert store.versions() == [2] and content(store.contents()) == sorted(now, key=str)
    with pytest.raises(ValueError, match="no version 1"):
        store.contents(1)
    with pytest.raises(ValueError, match="holds"):
        store.add(spark.createDataFrame([(1,)], "model int"))


def test_a_run_that_is_broken_off_leaves_the_last_version(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/l"
    for known in ([], [("a", "x", 1)]):  # the first version too
        if known:
            LineageStore(spark, path).add(spark.createDataFrame(known, SCHEMA))
        with monkeypatch.context() as m:
            m.setattr(LineageStore, "_save", lambda *_: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError, match="lost"):
                LineageStore(spark, path).add(spark.createDataFrame([("a", "new", 1), ("b", "y", 1)], SCHEMA))
        held = LineageStore(spark, path).contents()
        assert (content(held) if held else []) == known
    assert LineageStore(spark, path).tidy() > 0
    assert content(persist_lineage(spark.createDataFrame([("b", "y", 1)], SCHEMA), path)) == [("a", "x", 1), ("b", "y", 1)]


def test_empty_runs_compaction_and_conflicts(spark, tmp_path):
    store = LineageStore(spark, f"file://{tmp_path}/l", most_runs=2)
    assert store.add(spark.createDataFrame([], SCHEMA)) == 0 and content(store.contents()) == []
    for i in range(4):
        store.add(spark.createDataFrame([(f"m{i}", "x", i), ("all", "y", i)], SCHEMA))
    assert content(store.contents()) == [("all", "y", 3), *[(f"m{i}", "x", i) for i in range(4)]] and len(store._state()["runs"]) <= 2
    with pytest.raises(VersionConflict):
        store._save(store._state())


def test_ranks_over_ranges_equal_those_of_a_window(spark):
    rows = spark.range(30_000).select((F.col("id") % 3).alias("k"), F.concat(F.lit("v"), (F.col("id") * F.col("id")) % 7001).alias("v"), "id").unionByName(spark.range(5).select(F.lit(None).cast("bigint").alias("k"), F.lit("x").alias("v"), "id"))
    for ordinal in (None, "id"):
        a, b = (sorted(map(str, f(rows, ["k"], "v", ordinal).select("k", "v", "n", F.col("rk").cast("bigint")).collect())) for f in (P.value_counts, P.ranked_counts))
        assert a == b and len(a) > 5000
    assert P.ranked_counts(rows.limit(0), ["k"], "v").count() == 0 and P.ranked_counts(rows, [], "v").where("rk = 1").count() == 1


def test_bins_as_rows_equal_those_of_the_profile(spark):
    rows = spark.range(500).select(F.when(F.col("id") % 5 > 0, F.concat_ws(";", F.col("id").cast("string"), F.lit("t"), (F.col("id") % 9).cast("string"), F.concat(F.lit("u"), F.col("id") % 40))).alias("a"), F.lit(None).cast("string").alias("b"), F.lit("one").alias("c"))
    want = {r.column_name: list(zip(r.bins, r.counts, strict=True)) for r in P.column_profile(rows).collect()}
    order = F.array_position(F.array(F.lit("number"), F.lit("string"), F.lit("null")), F.col("kind"))
    got = {}
    for r in P.profile_bins(rows).orderBy("column_ord", order, "place").collect():
        got.setdefault(r.column_name, []).append((r.label, r.n))
    assert got == want and set(want) == {"a", "b", "c"}


def test_a_million_distinct_strings(spark):
    rows = spark.range(1_000_000).select(F.concat(F.lit("s"), F.col("id")).alias("s"))
    found = P.profile_bins(rows)
    assert tuple(found.agg(F.count("*"), F.min("place"), F.max("place"), F.count_distinct("place")).first()) == (1_000_000, 1, 1_000_000, 1_000_000)
