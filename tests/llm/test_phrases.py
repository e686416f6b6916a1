import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from schemaloom.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, most=4, least=30, top=2000, covered=80):
    """Every n-gram counted in one place, scored and subsumed with Python integers."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1))
    f = {k: v for k, v in f.items() if v >= least}
    out = []
    for lang in n:
        found = {k[1:]: v for k, v in f.items() if k[0] == lang}
        kept = []
        for phrase, a in found.items():
            inside = lambda big: any(big[i : i + len(phrase)] == phrase for i in range(len(big) - len(phrase) + 1))  # noqa: B023, E731
            if len(phrase) < 2 or any(100 * v >= covered * a for big, v in found.items() if len(big) > len(phrase) and inside(big)):
                continue
            score, _, l, r = min((2000000 * a // (found[phrase[:k]] + found[phrase[k:]]), k, found[phrase[:k]], found[phrase[k:]]) for k in range(1, len(phrase)))  # noqa: E741
            kept.append((-score, -a, " ".join(phrase).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]  # noqa: E741
    return sorted(out)


def made(seed, n):
    rng = random.Random(seed)
    words = "alpha Beta gamma delta é ÉCOLE x1 o'clock naïve \U0001f600 the of and in z\x00z a\xa0b".split(" ")
    mark = lambda: rng.choice([" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!", "\x0b"])
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + mark() for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "en", "de", None, "und", "É"]), rng.choice(["", "new york city hall " * rng.randint(1, 3), "red tape"]) + text))
    return rows + [("en", None), ("en", ""), (None, None), ("xx", " \t\n.,"), ("en", "the the the the " * 40), ("de", "One Two " * 3000)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", 1, "c") for r in rows], "lang string, text string, phrase string, words string, f int, rank string")


def found(spark, rows, **kw):
    return sorted(map(tuple, phrases.collocations(table(spark, rows).repartition(3), **kw).collect()))


def test_rows_are_those_of_plain_counting(spark):
    rows = made(1, 4000)
    want = plain(rows)
    assert len(want) > 80 and found(spark, rows) == want


@pytest.mark.parametrize("kw", [{"most": 2, "least": 5}, {"most": 5, "least": 3, "top": 40, "covered": 60}])
def test_other_parameters(spark, kw):
    rows = made(2, 120)
    assert found(spark, rows, **kw) == plain(rows, **kw)


def test_a_narrow_sketch_loses_nothing_and_keeps_nothing_rare(spark):
    rows = made(3, 200)
    assert found(spark, rows, limits=phrases.Limits(slice_=64, widest=256)) == plain(rows)


def test_texts_divided_into_many_parts_and_emissions(spark):
    rows = made(4, 150)
    assert found(spark, rows, limits=phrases.Limits(gathered=500, part=300)) == plain(rows)


def test_empty_tables(spark):
    assert found(spark, [("en", "a b")]) == []
    assert phrases.op13_phrases(table(spark, [("en", "a b")]).limit(0)).count() == 0


def test_n_grams_of_one_hash_are_counted_apart(monkeypatch):
    texts, langs = pa.array(["a b c a b d", "a b"]), pa.array(["en", "de"])

    class Bits:
        value = (8, np.full((2, 1), 255, np.uint8))

    plain_grams = phrases.Words.grams
    monkeypatch.setattr(phrases.Words, "grams", lambda self, most: ((n, at, np.zeros(len(at), np.uint64)) for n, at, _ in plain_grams(self, most)))
    out = next(phrases._counted(Bits, 2, 1000)(iter([pa.RecordBatch.from_arrays([langs, texts], names=["lang", "text"])]))).to_pylist()
    got = sorted((r["lang"], r["words"], r["phrase"], r["f"]) for r in out)
    assert ("en", 2, "a b", 2) in got and ("de", 2, "a b", 1) in got and ("en", 1, "a", 2) in got and ("en", 0, "", 6) in got
    assert len(got) == 2 + 4 + 2 + 4 + 1


def test_a_sketch_never_counts_too_little(spark):
    rows = made(5, 100)
    docs = table(spark, [("und" if lang is None else lang, text or "") for lang, text in rows]).select("lang", "text")
    bits = phrases.sketch(docs, 1 << 20, 2, 9, phrases.workspace(spark, "test-sketch")).collect()
    rows_ = {r.row: np.frombuffer(r.bits, np.uint8) for r in bits}
    own = phrases.Words(pa.array([r.text for r in docs.collect()]), pa.array([r.lang for r in docs.collect()]))
    for _, _, h in own.grams(2):
        values, n = np.unique(h, return_counts=True)
        for row, c in enumerate(phrases._counters(values[n >= 9], 1 << 20)):
            assert (rows_[row][c >> 3] >> (7 - (c & 7)) & 1).all()
