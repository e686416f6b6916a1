import random
import zlib

import numpy as np
import pytest

from schemaloom.llm import toxicity as T


def test_features_are_the_ngrams_of_the_whole_text(monkeypatch):
    whole = T.features("Some TEXT with  white\nspace é\U0001f600 " * 40)
    monkeypatch.setattr(T, "CHUNK", 16)
    assert np.array_equal(T.features("Some TEXT with  white\nspace é\U0001f600 " * 40), whole)
    assert np.array_equal(T.features("some text"), T.features(" SOME \n text\t"))
    assert len(T.features(None)) == len(T.features("")) <= 3


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    rows, labels = [], []
    for i in range(900):
        toxic = int(i % 5 == 1)
        text = [rng.choice(words) for _ in range(rng.randint(20, 150))]
        if toxic:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["zorkface", "quubhead", "Vexling"]))
        rows.append((i, " ".join(text), "x"))
        if i % 3:
            labels.append((i, toxic))
    labels += [(1, 1), (None, 1), (2, None), (3, 7)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    rows = T.op6_toxicity(docs, labels).collect()
    assert len(rows) == 900
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 5 == 1) for r in held]) > 0.97
    toxic, clean = ([r.score for r in held if (r.doc_id % 5 == 1) == t] for t in (True, False))
    assert np.mean([a > b for a in toxic for b in clean]) > 0.99


def test_held_out_labels_do_not_matter(spark, labelled):
    docs, labels = labelled
    flipped = labels.rdd.map(lambda r: (r.doc_id, (1 - r.toxic) if r.doc_id is not None and r.toxic in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else r.toxic))
    other = spark.createDataFrame(flipped, labels.schema)
    assert np.array_equal(T.train(docs, labels).weights, T.train(docs, other).weights)


def test_stage_drops_what_scores_as_toxic(labelled):
    docs, labels = labelled
    kept = T.drop_toxic(docs, labels)
    assert kept.schema == docs.schema
    ids = {r.doc_id for r in kept.collect()}
    assert np.mean([(i in ids) == (i % 5 != 1) for i in range(900)]) > 0.97


def test_edge_rows_and_tables(spark, docs, corpus, no_docs, labelled):
    labels = labelled[1]
    rows = T.op6_toxicity(docs, labels).collect()
    assert len(rows) == len(corpus) and all(not r.held_out for r in rows if r.doc_id is None)
    assert T.op6_toxicity(no_docs, labels).collect() == []
    assert {r.score for r in T.op6_toxicity(docs, labels.limit(0)).collect()} == {0.5}
    only_clean = spark.createDataFrame([(i, 0) for i in range(50)], "doc_id bigint, toxic int")
    assert {r.predicted for r in T.op6_toxicity(docs, only_clean).collect()} == {0}


def test_model_equals_one_fitted_in_one_place(spark, labelled):
    docs, labels = labelled
    model = T.train(docs, labels)
    toxic = {}
    for r in labels.collect():
        if r.doc_id is not None and r.toxic in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5:
            toxic[r.doc_id] = max(toxic.get(r.doc_id, 0), r.toxic)
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(toxic)
    whole = T.fit([T.features(texts[i]) for i in ids], np.array([toxic[i] for i in ids]), min(0.5, max(0.01, np.mean(list(toxic.values())))))
    assert np.allclose(model.weights, whole.weights, atol=1e-6) and abs(model.bias - whole.bias) < 1e-9
    scores = {r.doc_id: r.score for r in T.scored(docs.select("doc_id", "text"), model).collect()}
    for i in list(texts)[:50]:
        assert scores[i] == pytest.approx(whole.score(texts[i]), abs=1e-6)


def test_a_document_repeated_many_times_is_one_row_of_the_sample(spark, labelled):
    docs, labels = labelled
    again = docs.unionByName(docs.where("doc_id in (1, 6, 7)").crossJoin(spark.range(30)).drop("id"))
    assert np.array_equal(T.train(docs, labels).weights, T.train(again, labels).weights)
