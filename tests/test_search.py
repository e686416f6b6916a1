import numpy as np
import pytest

from schemaloom.functions.embed import CollectionExists, LexicalEmbedder, VectorStore, batches, embedded
from schemaloom.functions.vectors import cosine, l2_normalise, mean_pool
from schemaloom.operators.search import top_k
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(40)] + [(40, [1.0] * 6), (41, [2.0] * 6), (42, [3.0] * 6), (43, [0.0] * 6), (44, None), (None, [1.0] * 6)]
    return spark.createDataFrame(rows, "id bigint, vector array<double>")


def brute(rows, k, threshold):
    own = [(r.id, np.array(r.vector)) for r in rows if r.id is not None and r.vector]
    out = []
    for i, a in own:
        scored = [(-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9), j) for j, b in own if i != j and a.any() and b.any()]
        best = [(s, j) for s, j in sorted(scored) if threshold is None or -s >= threshold][:k]
        out += [(i, j, -s, n + 1) for n, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("strategy", ["matrix", "blocks", "auto"])
@pytest.mark.parametrize("k, threshold", [(3, None), (50, 0.2), (1, 0.9)])
def test_exact_strategies(vectors, strategy, k, threshold):
    got = top_k(vectors, vectors, k, threshold, skip_self=True, strategy=strategy).collect()
    assert sorted((r.source_id, r.target_id, round(r.similarity, 9), r.rk) for r in got) == brute(vectors.collect(), k, threshold)


def test_hashing_finds_near_vectors_only_among_true_ones(vectors):
    exact = {(r.source_id, r.target_id) for r in top_k(vectors, vectors, 50, 0.95, skip_self=True).collect()}
    near = {(r.source_id, r.target_id) for r in top_k(vectors.where("id <> 43"), vectors.where("id <> 43"), 50, 0.95, skip_self=True, strategy="lsh").collect()}
    assert near <= exact and len(near) >= 0.9 * len(exact) > 0


def test_empty_sides(vectors):
    none = vectors.limit(0)
    for strategy in ("matrix", "blocks"):
        assert top_k(none, vectors, 3, strategy=strategy).count() == top_k(vectors, none, 3, strategy=strategy).count() == 0
    with pytest.raises(ValueError):
        top_k(vectors, vectors, 3, strategy="guess")


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<double>")
    rows = df.select(cosine(F.col("a"), F.col("b")).alias("c"), l2_normalise(F.col("a")).alias("u")).collect()
    assert rows[0].c == pytest.approx(0.96) and rows[0].u == pytest.approx([0.6, 0.8])
    assert rows[1].c is None and rows[1].u == [0.0, 0.0]
    tokens = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [3.0, 4.0], 1), (1, [100.0, 100.0], 0), (2, [1.0, 1.0], 0)], "k int, v array<double>, m int")
    pooled = {r.k: r.v for r in mean_pool(tokens, ["k"], "v", F.col("m")).collect()}
    assert pooled == {1: [2.0, 3.0], 2: [0.0, 0.0]}


def test_embedder_is_deterministic_and_of_length_one(spark):
    e = LexicalEmbedder(64)
    a = e.embed_documents(["sample type", "Sample  Type", "zzz", ""])
    assert np.allclose(a[0], a[1]) and np.linalg.norm(a[2]) == pytest.approx(1) and not a[3].any()
    df = spark.createDataFrame([("sample type",), (None,)], "t string").select(embedded(F.col("t"), e).alias("v")).collect()
    assert np.allclose(df[0].v, a[0]) and not any(df[1].v)


def test_store_is_keyed_by_content(spark, tmp_path):
    store, e = VectorStore(spark, f"file://{tmp_path}/store"), LexicalEmbedder(16)
    one = spark.createDataFrame([(0, "a.b (c): d"), (1, "e.f (g): h")], "target_ord bigint, text string")
    assert store.populate(one, e).count() == 2 and store.populate(one, e).count() == 2
    with pytest.raises(CollectionExists):
        store.populate(one, e, must_be_new=True)
    assert store.populate(one, e, force=True).count() == 2
    assert store.path(one, e) != store.path(one.limit(1), e) != store.path(one, LexicalEmbedder(32))


def test_batches(spark):
    assert [r.batch for r in batches(spark.range(5), "id", 2).orderBy("id").collect()] == [0, 0, 1, 1, 2]


@pytest.mark.parametrize("strategy", ["auto", "blocks"])
def test_texts_are_searched_once_and_give_the_rows_of_all_pairs(spark, strategy):
    import random

    from schemaloom.functions.embed import LetterEmbedder, embedded
    from schemaloom.operators.search import top_k_texts

    told = random.Random(3)
    texts = [None, "", "..", *("".join(told.choice("abc") for _ in range(told.randrange(1, 4))) for _ in range(25))]
    rows = spark.createDataFrame([(i if i % 29 else None, told.choice(texts)) for i in range(400)], "id bigint, text string")
    seen = spark.sparkContext.accumulator(0)

    class Counted(LetterEmbedder):
        def embed_documents(self, texts):
            seen.add(len(texts))
            return LetterEmbedder().embed_documents(texts)

    vectors = rows.withColumn("vector", embedded(F.col("text"), LetterEmbedder()))
    for skip, k, threshold in ((True, 3, None), (False, 7, 0.5), (True, 50, 0.0)):
        want = top_k(vectors.where("id % 3 = 0"), vectors, k, threshold, skip_self=skip).collect()
        before = seen.value
        got = top_k_texts(rows.where("id % 3 = 0"), rows, Counted(), k, threshold, skip_self=skip, strategy=strategy)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want)
        assert seen.value - before == len({x or "" for x in texts} & {r.text or "" for r in rows.where("id IS NOT NULL").collect()})


def test_blocks_of_queries_and_tiles_of_targets(spark, monkeypatch):
    from schemaloom.operators import search

    rows = spark.range(300).selectExpr("id", "array(sin(id), cos(id * 3), sin(id * 7) + 0.1) AS vector").repartition(7)
    want = sorted(map(tuple, top_k(rows, rows, 4, skip_self=True, strategy="matrix").collect()))
    monkeypatch.setattr(search, "MAX_BROADCAST", 300 * 24 // 3)
    assert sorted(map(tuple, top_k(rows, rows, 4, skip_self=True, strategy="blocks").collect())) == want and len(want) == 1200


def test_equal_source_lines_are_embedded_once_and_only_the_best_are_given(spark):
    from schemaloom.functions.embed import LetterEmbedder
    from schemaloom.operators import approach, models

    seen = spark.sparkContext.accumulator(0)

    class Counted(LetterEmbedder):
        def embed_documents(self, texts):
            seen.add(len(texts))
            return LetterEmbedder().embed_documents(texts)

    json = '{"nodes":[{"name":"n","description":"d","properties":[{"name":"ab","type":"t"},{"name":"ba","type":"t"},{"name":"zz","type":"t"}]}]}'
    source = models.parse_simple(spark.range(50).selectExpr("id AS model_id", f"'{json}' AS json"))
    target = models.parse_simple(spark.range(1).selectExpr("id AS model_id", f"'{json}' AS json"))
    found = approach.SimilarityApproach(Counted(), k=3).suggest(source, target, best=True).collect()
    assert seen.value == 6 and len(found) == 50 * 5  # ab and ba are each other's best too
    assert {(r.source_property, r.target_property) for r in found} == {("ab", "ab"), ("ab", "ba"), ("ba", "ab"), ("ba", "ba"), ("zz", "zz")}
