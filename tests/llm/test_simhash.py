import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from schemaloom.llm import simhash as S
from schemaloom.llm.common import workspace


def brute_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    label = list(range(len(fps)))
    for i, a in enumerate(fps):
        for j in range(i):
            if bin(a ^ fps[j]).count("1") <= 3 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label


def test_query_equals_brute_force(docs, corpus):
    rows = S.op7_simhash(docs).collect()
    fps = [brute_fingerprint(t) for _, t in corpus]
    label = brute_components(fps)
    first = {c: min((d for (d, _), x in zip(corpus, label) if x == c and d is not None), default=None) for c in set(label)}
    want = sorted(str((d, f"{f:016x}", first[c])) for (d, _), f, c in zip(corpus, fps, label))
    assert sorted(map(str, map(tuple, rows))) == want


def test_long_texts_are_counted_in_chunks(monkeypatch):
    text = " ".join(str(i % 97) for i in range(5000))
    whole = S.fingerprint(text)
    monkeypatch.setattr(S, "CHUNK", 100)
    assert S.fingerprint(text) == whole == brute_fingerprint(text)


def test_every_linked_pair_meets_at_an_anchor():
    rng = np.random.default_rng(0)
    for _ in range(1500):
        x = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(2))
        y = x
        for b in rng.choice(64, int(rng.integers(0, 4)), replace=False):
            y ^= 1 << int(b)
        anchor, whose = S.anchors(np.array([x, y], np.uint64).view(np.int64))
        assert set(anchor[whose == 0]) & set(anchor[whose == 1])
        assert len(anchor) <= 64


@pytest.mark.parametrize("small", [1024, 16])
def test_dense_group_keeps_its_components_with_few_links(spark, monkeypatch, small):
    monkeypatch.setattr(S, "SMALL", small)
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**63))
    fps = {base}
    for _ in range(600):
        x = base
        for b in rng.choice(63, int(rng.integers(1, 7)), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    links = S.links(spark.createDataFrame([(f,) for f in fps], "fp bigint"))
    assert links.count() < 20 * len(fps)
    found = {r.fp: r.label for r in S.components(links, workspace(spark, "dense")).collect()}
    label = brute_components(fps)
    groups = {}
    for f, c in zip(fps, label):
        groups.setdefault(c, []).append(f)
    for members in groups.values():
        assert len({found.get(f, f) for f in members}) == 1
    assert len({found.get(f, f) for f in fps}) == len(groups)


def test_one_of_each_group_stays(spark, docs, corpus):
    kept = S.keep_one_each(docs)
    assert kept.schema == docs.schema
    label = brute_components([brute_fingerprint(t) for _, t in corpus])
    rows = kept.collect()
    assert len(rows) == len(set(label))
    first = sorted(str(min((d for (d, _), x in zip(corpus, label) if x == c and d is not None), default=None)) for c in set(label))
    assert sorted(str(r.doc_id) for r in rows) == first


def test_chain_of_links_is_one_component(spark):
    fps = [(1 << (i // 3 * 3)) - 1 for i in range(0, 60, 3)]
    edges = S.links(spark.createDataFrame([(f,) for f in set(fps)], "fp bigint"))
    assert len({r.label for r in S.components(edges, workspace(spark, "chain")).collect()}) == 1


@pytest.mark.parametrize("n, most", [(50, 24), (2000, 50)])
def test_rounds_are_logarithmic_on_an_ascending_chain(spark, monkeypatch, n, most):
    rounds = []
    plain = S.written
    monkeypatch.setattr(S, "written", lambda df, path: rounds.append(path) or plain(df, path))
    chain = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    rows = S.components(chain, workspace(spark, "long-chain")).collect()
    assert len(rows) == n + 1 and len({r.label for r in rows}) == 1
    assert sum("/to-" in p for p in rounds) <= most


def test_components_that_share_a_doc_id_or_have_none_all_keep_one(spark):
    texts = ["alpha beta gamma delta one", "some wholly other words stand here", "third text of its own kind entirely"]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (5, texts[2]), (5, "and yet one more that shares the id five"), (6, texts[2])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted((str(r.doc_id), r.text) for r in S.keep_one_each(docs).collect())
    assert kept == sorted({(str(d), t) for d, t in rows if d != 6})


def test_empty_table(no_docs):
    assert S.op7_simhash(no_docs).collect() == []
    assert S.keep_one_each(no_docs).collect() == []
