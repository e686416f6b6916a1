import zlib

import corpus_pipeline as C
import numpy as np
import pytest
from test_decontaminate import brute as plain_hits
from test_line_dedup import brute as plain_lines
from test_simhash import brute_components, brute_fingerprint

from schemaloom.llm import decontaminate, simhash
from schemaloom.llm.common import workspace, written


def test_stages_are_the_listed_ones():
    assert [n for n, _ in C.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "packing"]


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    passage = " ".join(next(t for _, t in corpus if len(t.split("\n")[0].split()) > 30).split()[5:20])
    toxic = [(700 + i, f"words of a clown and idiot moron {i} thing {i * 7} more {i * 13}", "en", "s", 0) for i in range(40)]
    rows = [(d, t, "en", "s", len(t or "")) for d, t in corpus] + toxic
    write = lambda name, data, schema: spark.createDataFrame(data, schema).write.parquet(f"file://{path}/{name}.parquet")
    write("documents", rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    write("labels", [(d, 1, int(d >= 700)) for d, *_ in rows if d is not None], "doc_id bigint, quality int, toxic int")
    write("benchmark", [(1, passage)], "item_id bigint, text string")
    return f"file://{path}"


def test_each_stage_decides_on_what_the_last_one_kept(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    schema, path = docs.schema, workspace(spark, "stages")
    seen = [docs.count()]
    for n, (name, stage) in enumerate(C.STAGES):
        docs = written(stage(spark, docs, folder), f"{path}/{n}")
        seen.append(docs.count())
        if n < 4:
            assert docs.schema == schema
        if name == "toxicity":
            assert sum(r.doc_id is not None and r.doc_id >= 700 for r in docs.collect()) <= 2
        if name == "line_dedup":
            assert not any("shared line" in (r.text or "").lower() for r in docs.where("doc_id between 400 and 413").collect())
        if name == "simhash":
            groups = simhash.near_duplicates(docs).select("label").distinct().count()  # two components of one smallest doc_id are two
            assert groups == docs.count()
        if name == "decontamination":
            assert not any(r.contaminated for r in decontaminate.op9_decontamination(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).collect())
    assert seen[1] < seen[0] and seen[2] == seen[1] and seen[3] < seen[2] and seen[4] < seen[3] and seen[5] >= seen[4] > 0


def test_run_returns_the_packing(spark, folder):
    rows = C.run(spark, folder).collect()
    assert rows and {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_rows_equal_those_of_a_plain_chain(spark, folder):
    public, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    encode = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in C.drop_toxic(spark, docs, folder).select("doc_id", "text").collect()]  # the model has tests of its own
    rows = [(d, text) for d, _, _, text in plain_lines(rows, 10)]
    groups: dict[int, list] = {}
    for row, label in zip(rows, brute_components([brute_fingerprint(t) for _, t in rows]), strict=True):
        groups.setdefault(label, []).append(row)
    kept = []
    for group in groups.values():
        first = min((d for d, _ in group if d is not None), default=None)
        texts = {t for d, t in group if d == first}
        assert len(texts) == 1
        kept.append((first, texts.pop()))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    kept = [row for row in kept if not plain_hits([row], items)[0][-1]]
    want = []
    for d, text in kept:
        ids = np.array([*encode.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want += [(d, i, at, len(own), zlib.crc32(own.tobytes())) for i, at in enumerate(range(0, len(ids), 4096)) for own in [ids[at : at + 4096]]]
    got = C.run(spark, folder).collect()
    assert sorted(map(str, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got))) == sorted(map(str, want))
    places: dict[int, list] = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 4096
