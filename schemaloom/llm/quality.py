"""Quality rules: rules of thumb, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed n-grams (single tokens and pairs of neighbours) are counted: of the
trusted documents, and of all documents. A text's value is the mean, over its n-grams, of the
logarithm of the two probabilities' ratio, so that its length does not matter; every text with a
value under one fixed threshold is rejected.

The verdict smooths the trusted multinomial by the raw one, with the weight of as many n-grams as
the trusted documents have. An n-gram as frequent there as everywhere then has the ratio 0 and one
that no trusted document holds log(1/2), however large either corpus is, and the threshold is a
share of the latter.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS_CLASS, indexes, let

#: Hash space of the n-grams: the size of both multinomials, whatever the corpus.
BUCKETS = 1 << 14
SMOOTHING = 1.0
#: Weight of the raw multinomial in the trusted one, in parts of the trusted documents' n-grams.
PRIOR = 1.0
#: Mean log-likelihood ratio per n-gram below which a text is rejected: 18 % of what an n-gram unknown to the trusted documents has.
THRESHOLD = 0.18 * log(PRIOR / (1 + PRIOR))
#: Trusted identifiers that may be broadcast, about 64 bytes each in the join's table (32 MB); beyond that the join is shuffled.
MAX_BROADCAST = 500_000
#: Tokens: runs of letters and digits, and runs of other visible characters.
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"
# Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, WINDOW, MOST_REPEATED = 50, 3, 50


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WS_CLASS + "+"), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words inside any 3-word window that the text holds twice or more; windows are told apart by a 64-bit hash."""

    def of(hashes: Column) -> Column:
        def positions(order: Column) -> Column:
            same = F.filter(
                order,
                lambda x, i: (F.get(order, i - 1)["h"] == x["h"]) | (F.get(order, i + 1)["h"] == x["h"]),
            )
            return F.array_sort(F.transform(same, lambda x: x["at"]))

        def step(acc: Column, at: Column) -> Column:
            new = F.least(F.lit(WINDOW), at + WINDOW - acc["end"])
            return F.struct((acc["n"] + new).alias("n"), (at + WINDOW).alias("end"))

        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        counted = F.aggregate(let(order, positions), start, step, lambda acc: acc["n"])
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(counted)

    hashes = F.transform(indexes(F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return let(hashes, of)


def rules(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and the measures of the rules of thumb, one row for each row of ``docs``."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("words", words_of(F.col("text")))
    symbols = sum((F.octet_length("text") - F.octet_length(F.replace("text", F.lit(s), F.lit(""))) for s in SYMBOLS), F.lit(0))
    with_word = F.filter(F.split("text", "\n", -1), lambda line: F.regexp_like(line, F.lit("[^\\x20\\x09-\\x0D]")))
    duplicates = let(with_word, lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))
    measured = rows.select(
        "doc_id",
        "text",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        duplicates.cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    return measured.withColumn("base_failed", failed)


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), 0)


def _bucket(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")


def log_ratios(docs: DataFrame, trusted: DataFrame, prior: float | None = None) -> list[float]:
    """The logarithm of trusted to raw probability of each bucket, from all documents.

    ``trusted`` holds doc_id; every document of such an identifier counts as trusted. Without
    ``prior`` both counts are smoothed by SMOOTHING; with it the trusted multinomial is mixed with
    ``prior`` parts of the raw one, and a bucket without n-grams has the ratio 0. Without trusted
    documents all ratios are 0.
    """
    ids = trusted.select(F.col("doc_id").alias("__t")).where(F.col("__t").isNotNull()).distinct()
    if ids.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        ids = F.broadcast(ids)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.join(ids, rows["doc_id"] == ids["__t"], "left").select(F.col("__t").isNotNull().alias("own"), _tokens(F.col("text")).alias("tokens"))
    pairs = rows.select("own", F.posexplode(F.arrays_zip("tokens", F.slice(F.col("tokens"), F.lit(2), F.size("tokens")).alias("next"))).alias("at", "pair"))
    grams = pairs.select("own", F.explode(F.array(_bucket("pair.tokens"), F.when(F.col("pair.next").isNotNull(), _bucket("pair.tokens", "pair.next")))).alias("bucket"))
    counts = grams.where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count_if("own").alias("own"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    known = every.join(counts, "bucket", "left").select("bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("raw", "own")])
    everything = Window.partitionBy()  # BUCKETS rows at any size
    totals = {c: F.sum(c).over(everything) for c in ("raw", "own")}
    if prior is None:
        odds = ((F.col("own") + SMOOTHING) / (totals["own"] + SMOOTHING * BUCKETS)) / ((F.col("raw") + SMOOTHING) / (totals["raw"] + SMOOTHING * BUCKETS))
    else:
        odds = (F.coalesce(F.try_divide(F.col("own").cast("double") * totals["raw"], F.col("raw").cast("double") * totals["own"]), F.lit(1.0)) + prior) / (1 + prior)
    ratio = F.when(totals["own"] > 0, F.log(odds)).otherwise(F.lit(0.0))
    return [r["ratio"] for r in known.select("bucket", ratio.alias("ratio")).orderBy("bucket").collect()]


def llr(text: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio per n-gram; 0 for a text without tokens."""
    table = F.split(F.lit(",".join(f"{r:.6f}" for r in ratios)), ",").cast("array<double>")  # folded to a constant

    def mean(tokens: Column) -> Column:
        def value(token: Column, i: Column) -> Column:
            following = F.get(tokens, i + 1)
            return F.get(table, _bucket(token)) + F.when(following.isNull(), F.lit(0.0)).otherwise(F.get(table, _bucket(token, following)))

        total = F.aggregate(F.transform(tokens, value), F.lit(0.0), lambda acc, x: acc + x)
        return F.when(F.size(tokens) == 0, F.lit(0.0)).otherwise(total / (F.size(tokens) * 2 - 1))

    return let(_tokens(text), mean)


def judged(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The measures of ``rules`` with ``llr`` and ``kept``: neither failed by rule nor under the threshold.

    Null texts have no words, and a text of under 50 words fails by rule. Repeated rows are judged
    each for itself. Other columns are not read. An empty table gives no rows.
    """
    ratios = log_ratios(docs, trusted, PRIOR)
    found = rules(docs).withColumn("llr", llr(F.col("text"), ratios))
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def op5_quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns of ``judged``; trusted are the documents labelled of quality 1."""
    found = judged(docs, labels.where(F.col("quality") == 1))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
