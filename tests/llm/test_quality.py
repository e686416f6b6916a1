import math
import re
from collections import Counter

import pytest

from schemaloom.llm import quality as Q

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


@pytest.fixture(scope="module")
def labels(spark, corpus):
    rows = [(d, 1, 0, "x") for d, _ in corpus if d is not None and d % 2 == 0] + [(1, 0, 0, "x"), (None, 1, 1, "x"), (2, 1, 0, "x")]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int, llr string")


def test_rules_equal_brute_force(spark, docs, corpus, labels):
    more = [(900, "a b c a b c d"), (901, "x " * 100), (902, "#*|<> & $%\n\n#*|<> & $%\n \n"), (903, "a b a b a")]
    rows = Q.op5_quality_rules(spark.createDataFrame([*corpus, *more], "doc_id bigint, text string"), labels).collect()
    want = sorted(str((d, *brute(t))) for d, t in [*corpus, *more])
    assert sorted(str(tuple(r)[:-1]) for r in rows) == want
    assert all(not r.kept for r in rows if r.base_failed)


def xxhash_bucket(spark, *parts):
    from pyspark.sql import functions as F

    return spark.range(1).select(Q._bucket(*[F.lit(p) for p in parts])).first()[0]


def test_ratios_equal_brute_force(spark):
    docs = [(1, "good words, good"), (2, "bad words!!"), (3, None), (1, "good again")]
    got = Q.log_ratios(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1,), (1,), (None,)], "doc_id bigint"))
    raw, own = Counter(), Counter()
    for d, t in docs:
        tokens = re.findall(r"[^\W_]+|[^\w\s]+", t or "")
        for gram in [*((x,) for x in tokens), *zip(tokens, tokens[1:])]:
            b = xxhash_bucket(spark, *gram)
            raw[b] += 1
            own[b] += d == 1
    r, o = sum(raw.values()) + Q.BUCKETS, sum(own.values()) + Q.BUCKETS
    for b in [*raw, 0, 77]:
        assert got[b] == pytest.approx(math.log((own[b] + 1) / o * r / (raw[b] + 1)))


def test_verdicts_equal_brute_force(spark, docs, corpus, labels):
    trusted = {d for d, _ in corpus if d is not None and d % 2 == 0}
    grams = [[*((x,) for x in w), *zip(w, w[1:])] for w in (re.findall(r"[^\W_]+|[^\w\s]+|_+", t or "") for _, t in corpus)]
    from pyspark.sql import functions as F

    distinct = sorted({g for own in grams for g in own})
    rows = spark.createDataFrame([(g[0], g[1] if len(g) > 1 else None) for g in distinct], "a string, b string")
    bucket = F.when(F.col("b").isNull(), Q._bucket("a")).otherwise(Q._bucket("a", "b"))
    buckets = {(r.a, r.b) if r.b is not None else (r.a,): r.n for r in rows.select("a", "b", bucket.alias("n")).collect()}
    raw, own = Counter(), Counter()
    for (d, _), g in zip(corpus, grams):
        raw.update(buckets[x] for x in g)
        own.update(buckets[x] for x in g if d in trusted)
    r, o = sum(raw.values()), sum(own.values())
    ratio = {b: math.log((own[b] * r / raw[b] / o + 1) / 2) for b in raw}
    got = sorted(((str(x.doc_id), x.n_words, x.word_chars, x.llr, x.kept) for x in Q.judged(docs, labels.where("quality = 1")).collect()))
    want = []
    for (d, t), g in zip(corpus, grams):
        value, rules = sum(ratio[buckets[x]] for x in g) / max(1, len(g)), brute(t)
        want.append((str(d), rules[0], rules[1], value, not rules[-1] and value >= 0.18 * math.log(0.5)))
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-5) and (a[4] == b[4] or abs(b[3] - Q.THRESHOLD) < 1e-5)


def test_unknown_grams_have_one_ratio_at_any_size(spark):
    trusted = spark.createDataFrame([(1,)], "doc_id bigint")
    for n in (1, 50):
        rows = [(1, "known words here " * n), (2, "foreign stuff " * n)]
        ratios = Q.log_ratios(spark.createDataFrame(rows, "doc_id bigint, text string"), trusted, 1.0)
        assert ratios[xxhash_bucket(spark, "foreign")] == pytest.approx(math.log(0.5)) and ratios[xxhash_bucket(spark, "known")] > 0.2
        assert ratios[xxhash_bucket(spark, "neither")] == 0.0


def test_shuffled_join_and_missing_labels(spark, docs, labels, monkeypatch):
    one = Q.log_ratios(docs, labels)
    monkeypatch.setattr(Q, "MAX_BROADCAST", 0)
    assert Q.log_ratios(docs, labels) == one
    assert set(Q.log_ratios(docs, labels.limit(0))) == {0.0}


def test_junk_goes_and_prose_stays(spark):
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    prose = [(i, " ".join(rng.choice(words) for _ in range(80)) + ".") for i in range(120)]
    junk = [(500 + i, " ".join(rng.choice(words).upper() + "!!" + rng.choice("#*%") * 3 for _ in range(80))) for i in range(12)]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 120, 3)], "doc_id bigint, quality int")
    kept = {r.doc_id: r.kept for r in Q.op5_quality_rules(spark.createDataFrame(prose + junk, "doc_id bigint, text string"), labels).collect()}
    assert all(kept[i] for i in range(120)) and not any(kept[500 + i] for i in range(12))


def test_empty_table(no_docs, labels):
    assert Q.op5_quality_rules(no_docs, labels).collect() == []
