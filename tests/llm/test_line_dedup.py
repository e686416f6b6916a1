import hashlib
import time
from collections import Counter

from pyspark.sql import functions as F

from schemaloom.llm import line_dedup
from schemaloom.llm.common import indexes, running

WS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WS))


def brute(rows, least):
    docs = [(d, (t or "").split("\n")) for d, t in rows]
    seen = Counter(k for _, lines in docs for k in {key(x) for x in lines} if k)
    out = []
    for d, lines in docs:
        kept = [x for x in lines if seen[key(x)] < least or not key(x)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def by_text(rows):
    return sorted(rows, key=str)


def test_query_equals_brute_force(docs, corpus):
    got = [tuple(r) for r in line_dedup.op4_line_dedup(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()]
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(corpus, 10)]
    assert by_text(got) == by_text(want)
    assert sum(k for _, _, k, _ in want) > 20


def test_compaction_levels_and_batches_give_the_same(spark, docs, corpus):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for part in docs.randomSplit([0.3, 0.3, 0.4], seed=3):
        runs.add(part)
    assert len(runs.levels) > 1  # a level was merged
    got = [tuple(r) for r in line_dedup.apply_runs(docs, runs, 10).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()]
    assert by_text(got) == by_text(brute(corpus, 10))


def test_a_store_is_opened_again_and_half_done_work_does_not_count(spark, docs, corpus):
    runs = line_dedup.LineRuns(spark, buckets=3)
    parts = docs.randomSplit([0.3, 0.2, 0.2, 0.3], seed=4)
    for part in parts[:3]:
        runs.add(part)
    runs._write(spark.createDataFrame([("lost", 99)], "line string, n bigint"), 0)  # the driver is lost before the manifest names it
    runs.close()
    again = line_dedup.LineRuns(spark, runs.path, fanout=7)
    assert (again.levels, again.fanout, again.buckets) == (runs.levels, 2, 3)
    again.add(parts[3], 10)
    got = [tuple(r) for r in line_dedup.apply_runs(docs, again, 10).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()]
    assert by_text(got) == by_text(brute(corpus, 10))


def test_runs_are_merged_without_a_shuffle(spark, docs):
    runs = line_dedup.LineRuns(spark, fanout=8)
    for part in docs.randomSplit([0.5, 0.5], seed=4):
        runs.add(part)
    merged = runs._merged(*runs.levels[0])
    assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
    want = {r.line: r.n for r in runs.counts().collect()}
    assert {r.line: r.n for r in merged.collect()} == want and max(want.values()) >= 14


def test_batches_as_they_arrive_are_judged_by_what_came_before(spark):
    runs = line_dedup.LineRuns(spark)
    make = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    first = runs.judge_then_add(make([(1, "a\nb"), (2, "a")]), 2).collect()
    assert {r.doc_id: r.kept_text for r in first} == {1: "a\nb", 2: "a"}
    second = runs.judge_then_add(make([(3, " A \nc")]), 2).collect()
    assert second[0].kept_text == "c"


def test_documents_keep_their_columns(docs, corpus):
    found = line_dedup.without_common_lines(docs)
    assert found.schema == docs.schema
    rows = found.collect()
    assert len(rows) == len(corpus)
    want = by_text([(d, None if t is None else kept) for (d, t), (_, _, _, kept) in zip(corpus, brute(corpus, 10))])
    assert by_text([(r.doc_id, r.text) for r in rows]) == want
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None and r.doc_id in range(400, 414))


def test_empty_table(no_docs):
    assert line_dedup.op4_line_dedup(no_docs).collect() == []
    assert line_dedup.without_common_lines(no_docs).collect() == []


def test_a_text_of_very_many_common_lines_takes_time_in_proportion(spark):
    n = 50_000
    text = "\n".join(f"common line {i}" for i in range(n)) + "\nown"
    docs = spark.createDataFrame([(i, text) for i in range(10)] + [(99, "common line 7\nonce\n once\ncommon line 8")], "doc_id bigint, text string").repartition(4)
    began = time.perf_counter()
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(docs, batches=1).collect()}
    assert time.perf_counter() - began < 60
    assert all(rows[i].kept_text == "" and rows[i].n_lines == rows[i].n_dropped == n + 1 for i in range(10))
    assert (rows[99].kept_text, rows[99].n_lines, rows[99].n_dropped) == ("once\n once", 4, 2)


def test_running_states_are_those_of_a_loop(spark):
    for n in (0, 1, 127, 128, 129, 1000):
        rows = spark.range(1).select(running(F.transform(indexes(F.lit(n)), lambda i: i * 3 % 7), "int", F.lit(5), lambda s, x: s * 2 % 1001 + x).alias("r"))
        want, s = [], 5
        for i in range(n):
            want.append(s)
            s = s * 2 % 1001 + i * 3 % 7
        assert rows.first().r == want
