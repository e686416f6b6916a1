import random

import pytest

WORDS = "the of and to in for on with data model node value type name case study sample patient visit result code unit range lab test".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows of (doc_id, text) with nulls, empty and long texts, copies, repeated rows and repeated ids."""
    rng = random.Random(5)
    passage = sentence(rng, 40)
    rows = [(i, f"{sentence(rng, rng.randint(3, 120))}.\n{sentence(rng, 8)}\r\n\n" + (passage if i % 3 == 0 else sentence(rng, 20))) for i in range(60)]
    rows += [(100 + i, rows[1][1]) for i in range(8)]  # copies
    rows += [(200 + i, rows[2][1] + f" {WORDS[i]}") for i in range(6)]  # near copies
    rows += [(7, None), (8, None), (300, ""), (301, ""), (None, "text without an id\nShared Line"), (None, None)]
    rows += [(310, "  \t\x0b\x0c\r \n \n"), (311, "É ÀB Straße ſ K x"), (312, "one"), (312, "one"), (313, "two words")]
    rows += [(400 + i, f"  Shared LINE \nown {i} line\nshared line\t\nlast") for i in range(14)]
    rows += [(500, (sentence(rng, 30) + "\n") * 400), (501, "longword" * 20000)]
    rows += [(-5, "negative id"), (600, "a\x00b ퟿\U0001f600 emoji \U0001f600\U0001f600")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with extra columns whose names the operators use themselves."""
    clashing = "lines keys words hits line n h fp hash start width kinds spans piece rank length shard slot key size score batch bucket tokens found anchor label".split()
    rows = [(*r, "en", f"s{i % 3}", len(r[1] or ""), *(["x"] * len(clashing))) for i, r in enumerate(corpus)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in clashing)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
