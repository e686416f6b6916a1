import random
import zlib

import pytest

from schemaloom.llm import sharding as S


def test_minimax_is_optimal():
    rng = random.Random(0)

    def best(sizes, shards):
        inf = float("inf")
        table = [0] + [inf] * len(sizes)
        for _ in range(shards):
            table = [min((max(table[j], sum(sizes[j:i])) for j in range(i + 1)), default=0) for i in range(len(sizes) + 1)]
        return table[-1]

    for _ in range(60):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        shards = rng.randint(1, 5)
        assert S.minimax_cuts(sizes, shards)[0] == best(sizes, shards)


@pytest.mark.parametrize("seed", range(4))
def test_distributed_cuts_equal_the_local_ones(spark, seed, monkeypatch):
    monkeypatch.setattr(S, "RESOLUTION_BITS", 3)
    monkeypatch.setattr(S, "FINER_BITS", 2)
    monkeypatch.setattr(S, "MOST_DIVIDED", 3)
    rng = random.Random(seed)
    groups = sorted({rng.getrandbits(64) - (1 << 63): rng.choice([8, 50, rng.randint(8, 4000)]) for _ in range(rng.choice([1, 6, 80]))}.items())
    shards = rng.choice([1, 3, 24])
    ends = S.cut_points(spark.createDataFrame(groups, "key bigint, bytes bigint"), shards)
    loads = [0] * len(ends)
    for key, size in groups:
        loads[next(i for i, e in enumerate(ends) if key <= e)] += size
    assert len(ends) <= shards and max(loads) == S.minimax_cuts([b for _, b in groups], shards)[0]


def check(rows, corpus, shards):
    sizes = [(d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in corpus]
    assert sorted(map(str, sizes)) == sorted(str((r.doc_id, r.size, r.text_crc32)) for r in rows)
    by_shard, by_text = {}, {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
        by_text.setdefault((r.text_crc32, r.size), set()).add(r.shard)
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert all(len(v) == 1 for (crc, _), v in by_text.items() if crc)  # null and empty texts are two groups


def test_query(docs, corpus):
    check(S.op2_sharding(docs).collect(), corpus, 24)


def test_hot_text_has_a_shard_and_the_rest_is_even(spark):
    rng = random.Random(1)
    rows = [(i, "hot " * 50) for i in range(600)] + [(1000 + i, "x" * rng.randint(50, 150) + str(i)) for i in range(2000)]
    got = S.op2_sharding(spark.createDataFrame(rows, "doc_id bigint, text string"), 8).collect()
    loads = {}
    for r in got:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
    hot = next(r.shard for r in got if r.doc_id == 0)
    assert {r.shard for r in got if r.doc_id < 600} == {hot} and all(r.doc_id < 600 for r in got if r.shard == hot)
    others = [v for k, v in loads.items() if k != hot]
    assert len(others) == 7 and max(others) - min(others) < 400


def test_empty_table_and_files(spark, no_docs, docs, tmp_path):
    assert S.op2_sharding(no_docs).collect() == []
    S.write_shards(docs.select("doc_id", "text", "lang"), f"file://{tmp_path}/out", 4)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == docs.count()


def test_thousands_of_shards(spark):
    rng = random.Random(9)
    ends = sorted({rng.getrandbits(64) - (1 << 63) for _ in range(2500)} | {5, 6, 7, -(1 << 63), (1 << 63) - 1})
    keys = [*ends, *(e + 1 for e in ends[:-1]), *(rng.getrandbits(64) - (1 << 63) for _ in range(500))]
    put = S.Assignment({keys[0]: 0, 11: 1}, {keys[1]: 6}, ends)
    rows = put.apply(spark.createDataFrame([(k, k) for k in [*keys, 11]], "own bigint, __x bigint"), "own").collect()
    for r in rows:
        place = 6 if r.own == keys[1] else r.own
        want = {keys[0]: 0, 11: 1}.get(r.own, 2 + sum(e < place for e in ends[:-1]))
        assert r["__sl_shard"] == want


def test_groups_alone_and_moved_are_near_the_best_capacity(spark):
    rng = random.Random(3)
    for shards in (3, 7):
        groups = {rng.getrandbits(64) - (1 << 63): n for n in [9000, 4000, *(rng.randint(100, 900) for _ in range(10)), *(rng.randint(8, 40) for _ in range(300))]}
        put = S.assign(spark.createDataFrame(list(groups.items()), "key bigint, size bigint"), shards)
        found = put.apply(spark.createDataFrame([(k,) for k in groups], "key bigint"), "key").collect()
        loads = [0] * shards
        for r in found:
            loads[r["__sl_shard"]] += groups[r.key]
        left, rest = shards, sum(groups.values())
        for n in sorted(groups.values(), reverse=True):  # the bound: large groups alone, the rest in equal parts
            if left > 1 and n * left > rest:
                left, rest = left - 1, rest - n
        assert sum(loads) == sum(groups.values()) and sorted(loads)[left - 1] <= rest / left * (1 + 1 / S.LARGE)  # an order cut anywhere between groups of at most a LARGE-th of a shard


def test_write_shards_keeps_columns(spark, docs, tmp_path):
    S.write_shards(docs, str(tmp_path / "s"), 5)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert set(back.columns) == {*docs.columns, "shard_"} and back.count() == docs.count()
    assert {r.shard_ for r in back.select("shard_").collect()} == {"x"} and {r.shard for r in back.select("shard").collect()} <= set(range(5))
