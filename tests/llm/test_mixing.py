import random
import re

import numpy as np
from pyspark.sql import functions as F

from schemaloom.llm import mixing

SCHEMA = "doc_id bigint, source string, text string, size string, h string, takes string, n string, block string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA)


def words(text):
    return len(re.findall("[^ \t-\r]+", text or ""))


def plain_targets(totals):
    """By source: the shares, recomputed until no target is above its bound."""
    order = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, rest = set(), sum(totals.values())
    while True:
        share = rest / (sum(weight[s] for s in order if s not in full) or 1)
        above = {s for s in order if s not in full and share * weight[s] > 3 * totals[s]}
        if not above:
            return {s: 3.0 * totals[s] if s in full else share * weight[s] for s in order}
        full |= above
        rest = sum(totals.values()) - sum(3 * totals[s] for s in full)


def made(seed, sources, n, longest=200):
    rng = random.Random(seed)
    return [(i, rng.choice(sources), " ".join(["w"] * rng.randint(0, longest))) for i in range(n)]


def check(rows, got, slack=2.0):
    """Targets as computed plainly, sizes counted, and each source near its target in words and in documents."""
    totals = {}
    for _, source, text in rows:
        totals[source] = totals.get(source, 0) + words(text)
    aims = plain_targets(totals)
    assert len(got) == len(rows)
    want = sorted(((i, s, words(t)) for i, s, t in rows), key=str)
    assert sorted(((r.doc_id, r.source, r.size) for r in got), key=str) == want
    for source, aim in aims.items():
        own = [r for r in got if r.source == source]
        assert all(r.source_size == totals[source] and abs(r.target - aim) < 1e-6 * max(1.0, aim) for r in own)
        ratio = aim / totals[source] if totals[source] else 0.0
        assert all(int(ratio + 1e-9) <= r.takes <= min(3, int(ratio) + 1) for r in own)
        longest = max(r.size for r in own)
        assert abs(sum(r.size * r.takes for r in own) - aim) <= slack * longest + 1e-6
        assert abs(sum(r.takes for r in own) - ratio * len(own)) <= 2


def test_sources_come_near_their_targets(spark):
    rows = made(1, ["a", "b", "c", "B", "é", None, "zz", "big", "big", "big", "big", "big"], 3000)
    rows += [(10_000 + i, "a", None) for i in range(20)] + [(None, "c", "one two"), (None, None, "x y z")]
    rows += [(7, "b", "same text")] * 40 + [(8, "b", "q " * 30_000)]
    check(rows, mixing.mix(table(spark, rows)).collect())


def test_many_blocks_and_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rows = made(2, ["a", "b", "b", "b", "c"], 1500)
    check(rows, mixing.mix(table(spark, rows)).collect())


def test_reruns_agree_however_the_rows_lie(spark):
    rows = made(3, ["a", "b", "c", "d"], 600) + [(7, "b", "same text")] * 9 + [(None, None, None)] * 3
    one = sorted(mixing.op12_mixing(table(spark, rows).repartition(7)).collect(), key=str)
    random.Random(1).shuffle(rows)
    assert one == sorted(mixing.op12_mixing(table(spark, rows).coalesce(1)).collect(), key=str)


def test_empty_table_texts_without_words_and_one_source(spark):
    assert mixing.op12_mixing(table(spark, [(1, "a", "x")]).limit(0)).count() == 0
    silent = mixing.op12_mixing(table(spark, [(1, "a", None), (2, None, " \n")])).collect()
    assert [(r["size"], r.source_size, r.target, r.taken) for r in silent] == [(0, 0, 0.0, 0)] * 2
    alone = mixing.op12_mixing(table(spark, [(1, "a", "x y"), (2, "a", "z")])).collect()
    assert sorted((r.doc_id, r.target, r.taken) for r in alone) == [(1, 3.0, 2), (2, 3.0, 1)]


def test_many_sources_and_a_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_BROADCAST", 10)
    rows = made(4, [f"s{i}" for i in range(300)], 4000, 30)
    check(rows, mixing.mix(table(spark, rows)).collect())


def test_flight_keeps_both_totals_and_probabilities_hold():
    rng = np.random.default_rng(5)
    size = rng.integers(1, 50, 400)
    taken = np.zeros(400)
    for run in range(200):
        flight, out, chances = mixing.Flight(), {}, rng.random((400, 2))
        for i in range(400):
            out.update(flight.add(i, int(size[i]), 0.3, chances[i]))
            undecided = {x[0]: x[2] for x in flight.open}
            assert len(undecided) <= 2
            p = np.array([out.get(j, undecided.get(j, 0.3)) for j in range(400)])
            if i % 50 == 0:
                assert abs(p.sum() - 120) < 1e-7 and abs(p @ size - 0.3 * size.sum()) < 1e-5
        out.update(flight.land(rng.random()))
        taken += [out[i] for i in range(400)]
    assert abs(taken.mean() / 200 - 0.3) < 0.005 and 0.15 < taken.min() / 200 and taken.max() / 200 < 0.45


def test_landing_keeps_probabilities():
    for p, q in ((0.3, 0.6), (0.7, 0.8), (0.5, 0.5), (0.9, 0.05)):
        hits = np.zeros(2)
        for k in range(2000):
            flight = mixing.Flight()
            flight.open = [[0, 10, p], [1, 7, q]]
            hits += [v for _, v in flight.land((k + 0.5) / 2000)]
        assert np.allclose(hits / 2000, [p, q], atol=1e-3)


def test_mixture_repeats_documents(spark):
    rows = made(6, ["a", "b", "c", None], 300) + [(7, "b", "same text")] * 5
    docs = table(spark, rows)
    takes = mixing.mix(docs).groupBy("doc_id", "source", "h").agg(F.sum("takes").alias("t")).where("t > 0").collect()
    mixed = mixing.mixture(docs)
    assert mixed.columns == docs.columns
    found = mixed.groupBy("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).count().collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, takes), key=str)
