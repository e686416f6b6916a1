import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from schemaloom.functions.embed import LetterEmbedder, VectorRuns, VectorStore


def counting(path):
    """An embedder that notes the texts that it embeds in a file; made here, so that workers get it by value."""

    class Counting(LetterEmbedder):
        name = "counting"

        def embed_documents(self, texts):
            with open(path, "a") as f:
                f.write("".join(json.dumps(t) + "\n" for t in texts))
            return super().embed_documents(texts)

        def seen(self):
            with open(path) as f:
                return [json.loads(x) for x in f]

    return Counting()


def texts(spark, items):
    return spark.createDataFrame([(i, t) for i, t in enumerate(items)], "target_ord bigint, text string")


def test_additions_embed_only_what_is_new(spark, tmp_path):
    e = counting(f"{tmp_path}/log")
    path, first = f"file://{tmp_path}/s", [f"text {i}" for i in range(300)]
    assert VectorRuns(spark, path, e).add(texts(spark, first)) == 300
    assert VectorRuns(spark, path, e).add(texts(spark, first + ["x", "x", None, ""])) == 2
    assert VectorRuns(spark, path, e).add(texts(spark, first)) == 0
    assert sorted(e.seen()) == sorted([*first, "x", ""])
    held = VectorRuns(spark, path, e).contents().collect()
    assert len(held) == 302 and {r.addition for r in held} == {1, 2}
    want = dict(zip([r.text for r in held], LetterEmbedder().embed_documents([r.text for r in held]), strict=True))
    assert all(np.allclose(r.vector, want[r.text]) for r in held)


def test_levels_are_merged_and_nothing_is_lost(spark, tmp_path):
    path, e = f"file://{tmp_path}/s", LetterEmbedder()
    for i in range(14):
        VectorRuns(spark, path, e, fanout=3).add(texts(spark, [f"t{j}" for j in range(i * 5, i * 5 + 7)]))
    runs = VectorRuns(spark, path, e)
    assert [len(level) for level in runs.levels] == [2, 1, 1] and runs.fanout == 3
    assert sorted(r.text for r in runs.contents().collect()) == sorted(f"t{j}" for j in range(72))
    assert {p.name for p in (tmp_path / "s").iterdir() if p.is_dir()} == {r for level in runs.levels for r in level}


def test_what_a_lost_driver_left_is_not_read(spark, tmp_path):
    path, e = f"file://{tmp_path}/s", LetterEmbedder()
    runs = VectorRuns(spark, path, e)
    runs.add(texts(spark, ["a"]))
    runs._save = lambda: (_ for _ in ()).throw(KeyboardInterrupt())  # lost between the run and the manifest
    with pytest.raises(KeyboardInterrupt):
        runs.add(texts(spark, ["b"]))
    again = VectorRuns(spark, path, e)
    assert [r.text for r in again.contents().collect()] == ["a"]
    assert again.tidy() == 1 and again.add(texts(spark, ["a", "b"])) == 1
    assert again.tidy() == 0 and sorted(r.text for r in again.contents().collect()) == ["a", "b"]


def test_another_embedder_is_refused_and_vectors_are_joined(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    runs = VectorRuns(spark, path, LetterEmbedder())
    assert runs.contents().count() == 0
    runs.add(texts(spark, ["ab", None]))
    with pytest.raises(ValueError, match="letters-36"):
        VectorRuns(spark, path, counting(f"{tmp_path}/log"))
    rows = {r.text: r.vector for r in runs.vectors(texts(spark, ["ab", "zz", None])).collect()}
    assert rows["zz"] is None and sum(rows["ab"]) == 2 and sum(rows[None]) == 0


def test_a_changed_line_embeds_one_text(spark, tmp_path):
    e = counting(f"{tmp_path}/log")
    store = VectorStore(spark, f"file://{tmp_path}/s")
    items = [f"line {i}" for i in range(100)]
    assert store.populate(texts(spark, items), e).count() == 100
    rows = store.populate(texts(spark, [*items[:-1], "another"]), e).orderBy("target_ord").collect()
    assert len(e.seen()) == 101 and [r.text for r in rows] == [*items[:-1], "another"]
    assert len({r.id for r in rows}) == 100 and all(sum(r.vector) > 0 for r in rows)
    assert store.populate(texts(spark, items), e, force=True).where(F.col("vector").isNull()).count() == 0 and len(e.seen()) == 201
