import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from schemaloom.llm import decontaminate

SPLIT = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return SPLIT.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items):
    out = []
    for d, t in rows:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            b = words(text)
            k = min(10, len(b))
            grams = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if b else set()
            for i in range(len(w) - k + 1 if b else 0):
                if tuple(w[i : i + k]) in grams:
                    hit |= set(range(i, i + k))
                    ids.add(str(item))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(corpus):
    passage = corpus[0][1].split("\n")[-1]
    return [(1, passage), (2, passage.upper()), (10, "Two, words!"), (3, None), (4, ""), (5, "never there at all " * 5), (6, "one"), (7, "É àb")]


def table(spark, items):
    return spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, width string")


def test_query_equals_brute_force(spark, docs, corpus, items):
    got = decontaminate.op9_decontamination(docs, table(spark, items)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    want = brute(corpus, items)
    assert sorted(map(tuple, got), key=str) == want
    assert sum(r[-1] for r in want) > 20


def test_shuffled_join_gives_the_same(spark, docs, items):
    one = decontaminate.find_hits(docs, table(spark, items), max_broadcast=0).select("doc_id", "hits").collect()
    two = decontaminate.find_hits(docs, table(spark, items)).select("doc_id", "hits").collect()
    flat = lambda rows: sorted(str((r.doc_id, [(h.start, h.width, sorted(h.item_ids)) for h in r.hits])) for r in rows)
    assert flat(one) == flat(two)


def test_clean_documents_and_spans(spark, docs, corpus, items):
    bench = table(spark, items)
    kept = decontaminate.clean_documents(docs, bench)
    assert kept.schema == docs.schema
    clean = sorted(str((d, t)) for (d, t), in zip([c for c in corpus if not brute([c], items)[0][-1]]))
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == clean
    short = spark.createDataFrame([(1, "a b c two words d two words two words")], "doc_id bigint, text string")
    spans = decontaminate.hit_spans(short, bench).first().spans
    assert [tuple(s) for s in spans] == [(3, 4), (6, 9)]


def test_a_window_that_many_items_share_is_carried_by_name(spark, docs, corpus, items):
    many = [*items, *((100 + i, items[0][1] + f" own ending {i}") for i in range(300))]
    hits, sets = decontaminate._hits(docs, table(spark, many))
    assert "item_ids" not in hits.columns and sets.where(F.size("item_ids") > 300).count() == 1
    got = decontaminate.op9_decontamination(docs, table(spark, many)).collect()
    assert sorted(map(tuple, got), key=str) == brute(corpus, many)


def test_empty_tables(spark, docs, no_docs, items):
    nothing = table(spark, items).limit(0)
    assert decontaminate.op9_decontamination(no_docs, table(spark, items)).collect() == []
    assert {r.n_hit for r in decontaminate.op9_decontamination(docs, nothing).collect()} == {0}
    assert decontaminate.clean_documents(docs, nothing).count() == docs.count()


def test_a_null_item_is_one_item(spark):
    rows = [(1, "a b c d e f g h i j k l"), (2, "q r"), (3, "nothing")]
    items = [(None, "a b c d e f g h i j k l"), (None, "a b c d e f g h i j"), (4, "b c d e f g h i j k"), (None, "q r")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in decontaminate.op9_decontamination(docs, table(spark, items)).collect()}
    assert [(got[i].n_hit, got[i].n_items, got[i].contaminated) for i in (1, 2, 3)] == [(12, 2, True), (2, 1, True), (0, 0, False)]
    assert [got[i].items_sha256 for i in (1, 2, 3)] == [hashlib.sha256(x).hexdigest() for x in (b"4", b"", b"")]
    listed = {r.doc_id: r.item_ids for r in decontaminate.decontaminate(docs, table(spark, items)).collect()}
    assert listed == {1: ["4", None], 2: [None], 3: []}


def test_many_documents_that_hold_a_phrase_of_many_items(spark):
    phrase = "one two three four five six seven eight nine ten"
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit(f"before {phrase} after "), F.col("id")).alias("text"))
    items = spark.range(20_000).select(F.col("id").alias("item_id"), F.lit(phrase).alias("text"))
    began = time.perf_counter()
    rows = decontaminate.op9_decontamination(docs, items).select("n_hit", "n_items", "items_sha256").distinct().collect()
    assert time.perf_counter() - began < 60
    assert [tuple(r) for r in rows] == [(10, 20_000, hashlib.sha256(",".join(sorted(map(str, range(20_000)))).encode()).hexdigest())]


def test_spans_are_maximal_runs_of_hit_words(spark):
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice("abc") for _ in range(rng.choice([2, 3, 12])))) for i in range(6)]
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.choice([0, 5, 40, 400])))) for i in range(30)]
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in decontaminate.hit_spans(spark.createDataFrame(rows, "doc_id bigint, text string"), table(spark, items)).collect()}
    for i, text in rows:
        w, hit = words(text), set()
        for _, item in items:
            b = words(item)
            k = min(10, len(b))
            grams = {tuple(b[j : j + k]) for j in range(len(b) - k + 1)}
            hit |= {p for j in range(len(w) - k + 1) if tuple(w[j : j + k]) in grams for p in range(j, j + k)}
        assert got[i] == [(p, min(q for q in range(p, len(w) + 1) if q + 1 not in hit)) for p in sorted(hit) if p - 1 not in hit]
