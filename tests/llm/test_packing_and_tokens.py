import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from schemaloom.llm import packing as P
from schemaloom.llm import sstable as T
from schemaloom.llm.common import workspace
from schemaloom.llm.tokens import Encoder

public = pytest.importorskip("public_tokenizers")
WORD, BYTE = public.path("word_bpe_49k.json"), public.path("byte_bpe_50k.json")


def reference(path):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return lambda text: own.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module", params=[WORD, BYTE])
def both(request):
    return reference(request.param), Encoder(request.param, cache_parts=500)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("  aab\n\0 \t\n\r\x0b\x0c\x1c\x85\xa0 　abZÉéß'sſ1²,.!|#́​\U0001f600<>endoftx"), max_size=40))
def test_cached_ids_are_the_tokenizers(both, text):
    ids, encoder = both
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == ids(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" \nHJTWYAhwİſÅK\u0301\u0304\u0307\u0308\u030a\u030c\u0331\u0344\u0338é’<"), max_size=30))
def test_letters_compose_before_they_are_lowered(both, text):
    ids, encoder = both
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == ids(text)


@pytest.mark.parametrize("text", ["H\u0331ayr", "J\u030c", "T\u0308", "T\u0344", "W\u030a", "Y\u030a x", "A HOUSE H\u0331 House"])
def test_decomposed_capitals(both, text):
    ids, encoder = both
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == ids(text)


def test_long_parts_are_encoded_and_not_kept(both):
    ids, encoder = both
    texts = ["word " + "ab" * 500 + " word", "x" * 70, "y" * 64]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [ids(t) for t in texts]
    assert max(map(len, encoder.cache)) <= 65


def test_special_strings_are_ordinary_text(both):
    ids, encoder = both
    for text in ("<|endoftext|>", "a <|startoftext|> b", None, ""):
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == ids(text)


def plain_call(path):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    return lambda text: own.encode(text or "", add_special_tokens=False).ids


SPECIAL = [
    *("a<|endoftext|>b", "a\n\n<|endoftext|>\n\nb", "a  <|endoftext|>  b", " <|startoftext|><|endoftext|> ", "<|ENDOFTEXT|> <|EndOfText|>"),
    *("A <|endoftext|>H\u0331", "<|endoftext|>\u0338 é", "a\xa0<|endoftext|>", "\0<|endoftext|>"),
]


@pytest.fixture(scope="module", params=[WORD, BYTE])
def plain(request):
    return plain_call(request.param), Encoder(request.param, cache_parts=500, special_strings=True)


@pytest.mark.parametrize("text", SPECIAL)
def test_special_strings_are_tokens_in_the_plain_call(plain, text):
    ids, encoder = plain
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == ids(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"<|endoftext|>,<|startoftext|>,<|ENDOFTEXT|>,<|end,|>,a,B,'s,é,H\u0331,\u0338,1,!".split(","), *"  \n\t\0\x1c\xa0", "  ", "\n\n"]), max_size=14))
def test_the_plain_calls_ids_around_special_strings(plain, pieces):
    ids, encoder = plain
    text = "".join(pieces)
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == ids(text)


def test_queries_have_the_plain_calls_ids(spark):
    docs = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id bigint, text string")
    for rows, path, end, n in ((P.op1_packing(docs, WORD), WORD, 1, "length"), (T.op10_token_output(docs, BYTE), BYTE, 0, "n_tokens")):
        ids, start = plain_call(path), 0
        for r in rows.orderBy("doc_id").collect():
            own = [*ids(SPECIAL[r.doc_id]), end]
            assert (r[n], r.ids_crc32) == (len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
            assert n == "length" or r.start == start
            start += len(own)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=25))
def test_plan_places_every_document_once_and_gaplessly(counts):
    segments, n = P.plan_bins(counts, 40)
    bins, seen = {}, {}
    for s in sorted(segments):
        assert s.first == seen.get(s.length, 0)
        upto = next((o.first for o in sorted(segments) if o.length == s.length and o.first > s.first), counts[s.length])
        for rank in range(s.first, upto):
            b, k = divmod(rank - s.first, s.times)
            bins.setdefault(s.sequence + b, []).append((s.offset + k * s.length, s.length))
        seen[s.length] = upto
    assert seen == counts and sorted(bins) == list(range(n))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 40
    assert n <= 2 * -(-sum(k * v for k, v in counts.items()) // 40) + 1


def test_two_documents_replace_the_smallest():
    # greedy: 60, 30; gap 10. The 30 goes for 20 + 20, which fill the bin.
    segments, n = P.plan_bins({60: 1, 30: 1, 20: 2}, 100)
    first = sorted(s.length for s in segments if s.sequence == 0)
    assert first == [20, 60] and n == 2


def best_two_fit(lengths, capacity):
    """Sequences of lengths by the method, one document after another."""
    left, sequences = Counter(lengths), []
    while left:
        own, gap = [], capacity
        while fit := [x for x in left if x <= gap]:
            own.append(max(fit))
            gap -= own[-1]
            left -= Counter(own[-1:])
        while gap and len(own) > 1:
            smallest, room = min(own), gap + min(own)
            pairs = [(a, b) for a in left for b in left if a <= b and (a < b or left[a] > 1) and smallest < a + b <= room]
            if not pairs:
                break
            two = max(pairs, key=lambda p: (sum(p), -p[0]))
            own.remove(smallest)
            own += two
            left = left - Counter(two) + Counter([smallest])
            gap = room - sum(two)
        sequences.append(own)
    return sequences


@pytest.mark.parametrize("seed", range(40))
def test_the_plan_needs_as_many_sequences_as_packing_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([20, 50, 128])
    if seed % 2:
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 120))]
    else:
        lengths = [min(capacity, 1 + int(rng.expovariate(6 / capacity))) for _ in range(150)]
    assert P.plan_bins(dict(Counter(lengths)), capacity)[1] == len(best_two_fit(lengths, capacity))


def test_packing_is_near_the_lower_bound():
    rng = random.Random(2)
    counts = {}
    for _ in range(20000):
        k = min(4096, int(rng.lognormvariate(6.5, 0.9)) + 1)
        counts[k] = counts.get(k, 0) + 1
    _, n = P.plan_bins(counts)
    assert n <= 1.002 * sum(k * v for k, v in counts.items()) / 4096 + 1


def test_packed_pieces_are_the_documents_ids(docs, corpus):
    ids = reference(WORD)
    rows = P.pack_documents(docs, WORD, with_ids=True).collect()
    want, got, sequences = [], [], {}
    for d, t in corpus:
        own = [*ids(t), 1]
        want += [str((d, i // 4096, i, own[i : i + 4096])) for i in range(0, len(own), 4096)]
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        got.append(str((r.doc_id, r.piece, r.start, np.frombuffer(bytes(r.ids), "<u4").tolist())))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(got) == sorted(want)
    for items in sequences.values():
        assert [o for o, _ in sorted(items)] == np.cumsum([0, *[n for _, n in sorted(items)]])[:-1].tolist()
        assert sum(n for _, n in items) <= 4096


def test_sequences_hold_their_pieces(spark, docs):
    packed = P.pack_documents(docs, WORD, with_ids=True)
    joined = {r.sequence_id: bytes(r.ids) for r in P.sequences(packed).collect()}
    for r in packed.collect():
        assert joined[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)


def test_shards_round_trip(spark, docs, corpus):
    ids = reference(BYTE)
    manifest = T.write_table(docs, BYTE, workspace(spark, "test"), shards=4)
    rows = T.read_table(manifest, with_ids=True).orderBy("start").collect()
    want = sorted(str((d, [*ids(t), 0])) for d, t in corpus)
    assert sorted(str((r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist())) for r in rows) == want
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()
    keys = [-(1 << 63) if r.doc_id is None else r.doc_id for r in rows]
    assert keys == sorted(keys)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)
    assert len(T.lookup(spark, manifest, 312)) == 2 and len(T.lookup(spark, manifest, None)) == 2
    assert T.lookup(spark, manifest, 99999) == []
    assert T.lookup(spark, manifest, -5)[0].tolist() == [*ids("negative id"), 0]


def test_shard_file_blocks_filter_and_damage(tmp_path, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_BYTES", 200)
    path = tmp_path / "x.sst"
    with path.open("wb") as out:
        w = T.Writer(out, 2)
        for i in range(500):
            w.add(T.key_of(i // 2), np.arange(i % 7))
        w.close()
    with path.open("rb") as f:
        shard = T.Reader(f)
        assert len(shard.blocks) > 20 and shard.documents == 500
        assert all(len(shard.get(i)) == 2 for i in range(0, 250, 17)) and shard.get(9999) == []
        assert sum(shard.may_hold(T.key_of(i)) for i in range(1000, 3000)) < 100
        assert [T.id_of(k) for k, _, _ in shard] == [i // 2 for i in range(500)]
    data = bytearray(path.read_bytes())
    data[40] ^= 1
    path.write_bytes(data)
    with path.open("rb") as f, pytest.raises(ValueError, match="damaged"):
        list(T.Reader(f))
    with pytest.raises(ValueError, match="ascend"):
        w = T.Writer((tmp_path / "y").open("wb"), 2)
        w.add(T.key_of(2), np.arange(1))
        w.add(T.key_of(1), np.arange(1))


def test_empty_table(no_docs):
    assert P.op1_packing(no_docs, WORD).collect() == []
    assert T.op10_token_output(no_docs, BYTE).collect() == []
