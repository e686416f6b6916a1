"""Benchmark decontamination: a broadcast hash set of the test windows, probed by every training window.

A window is ``width`` consecutive words; an item of fewer words, but not none, is one window. The
test windows are broadcast by their hashes while there are at most ``max_broadcast`` of them with at
most MAX_BROADCAST_BYTES; beyond that the same join is shuffled. Hash hits are verified word by word
against the item's window.

Windows that the same items hold name one set of items. A hit carries that name only, and a document
meets the items once for each set, however many items share its windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, document_key, indexes, let, null_safe_join, running, workspace, written

#: What separates words after A-Z are lower-cased: ASCII but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 10
MAX_BROADCAST = 500_000
MAX_BROADCAST_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def _hash(words: Column, at: Column, width: int) -> Column:
    return F.xxhash64(F.slice(words, at + 1, width))


def _set_of(item: Column) -> Column:
    """The items of a group, sorted; a null one is an item like others, and last."""
    return F.array_sort(F.transform(F.collect_set(F.struct(item.alias("id"))), lambda x: x["id"]))


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(gram, width, item_ids, items): every distinct window of the test set, the items that hold it, and the name of that set of items."""
    rows = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    rows = rows.withColumn("width", F.least(F.size("words"), F.lit(width)))
    starts = F.sequence(F.lit(1), F.col("size") - F.col("width") + 1)
    each = rows.withColumn("size", F.size("words")).select("item_id", "width", F.transform(starts, lambda i: F.slice("words", i, F.col("width"))).alias("grams"))
    each = each.select("item_id", "width", F.explode(F.array_distinct("grams")).alias("gram"))
    held = each.groupBy("gram", "width").agg(_set_of(F.col("item_id").cast("string")).alias("item_ids"))
    return held.withColumn("items", F.sha2(F.to_json("item_ids"), 256))


def _hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_broadcast: int = MAX_BROADCAST) -> tuple[DataFrame, DataFrame]:
    """One row for each row of ``docs``: doc_id, text, __h, words, hits (start, width, items); and the sets: items, item_ids."""
    windows = written(benchmark_windows(benchmark, width), workspace(docs.sparkSession, "test-windows"))
    sets = windows.groupBy("items").agg(F.first("item_ids").alias("item_ids"))
    test = windows.select(F.xxhash64("gram").alias("hash"), "width", "gram", "items")
    weight = F.sum(F.octet_length(F.array_join("gram", " ")) + 16 * F.col("width") + 200)  # as rows of the join's table
    measured = test.agg(F.count(F.lit(1)).alias("n"), F.coalesce(weight, F.lit(0)).alias("bytes"), F.collect_set("width").alias("widths")).first()
    widths = sorted(measured.widths)  # at most ``width`` values
    keyed = document_key(docs)
    if not widths:
        none = F.array().cast("array<struct<start:int,width:int,items:string>>")
        return keyed.withColumn("words", words_of(F.col("text"))).withColumn("hits", none), sets
    probe = F.broadcast(test) if measured.n <= max_broadcast and measured.bytes <= MAX_BROADCAST_BYTES else test

    def windows_of(words: Column, w: int) -> Column:
        return F.transform(indexes(F.size(words) - w + 1), lambda i: F.struct(i.alias("start"), F.lit(w).alias("width"), _hash(words, i, w).alias("hash")))

    def every(words: Column) -> Column:
        each = [windows_of(words, w) for w in widths]
        return each[0] if len(each) == 1 else F.concat(*each)

    probes = keyed.select("doc_id", "__h", F.explode(let(words_of(F.col("text")), every)).alias("w")).select("doc_id", "__h", "w.start", "w.width", "w.hash")
    found = probes.join(probe, ["hash", "width"]).groupBy("doc_id", "__h").agg(F.collect_set(F.struct("start", "width", "gram", "items")).alias("found"))
    both = null_safe_join(keyed, found, ["doc_id", "__h"], "left")
    both = both.withColumn("words", words_of(F.col("text")))
    sound = F.filter(F.coalesce("found", F.array()), lambda x: F.slice("words", x["start"] + 1, x["width"]) == x["gram"])
    plain = F.transform(F.array_sort(sound), lambda x: F.struct(x["start"], x["width"], x["items"]))
    return both.withColumn("hits", plain).drop("found"), sets


def find_hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Each document's verified hits, to look at.

    Returns doc_id, text (null: empty), words, hits: array of (start, width, item_ids), by start
    and width, one row for each row of ``docs``. Null texts have no words. A null item text has no
    window and its item no hit. With an empty test set, every hits is empty.
    """
    hits, sets = _hits(docs, benchmark, width, max_broadcast)
    hits = hits.withColumn("__row", F.monotonically_increasing_id())
    hits = written(hits, workspace(docs.sparkSession, "hits"))  # row numbers are given once
    each = hits.select("__row", F.explode("hits").alias("x")).select("__row", "x.*").join(sets, "items")
    listed = each.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("start", "width", "item_ids"))).alias("hits"))
    none = F.array().cast("array<struct<start:int,width:int,item_ids:array<string>>>")
    return hits.drop("hits").join(listed, "__row", "left").select("doc_id", "text", "words", F.coalesce("hits", none).alias("hits"))


def covered(hits: Column) -> Column:
    """Words inside any hit: the length of the union of [start, start + width)."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, x: Column) -> Column:
        end = x["start"] + x["width"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x["start"]))).alias("n"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(hits, start, step, lambda acc: acc["n"]).cast("long")


def _judged(docs: DataFrame, benchmark: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_words, n_hit and sets (the sets of items that its windows name) of each row; and (sets, item_ids) of each different one.

    Many documents may hold the same long passage, and many items too: such sets are put together once.
    """
    hits, sets = _hits(docs, benchmark, width)
    named = F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["items"])))
    rows = hits.select("doc_id", F.size("words").cast("long").alias("n_words"), covered(F.col("hits")).alias("n_hit"), named.alias("named"))
    name = F.when(F.size("named") > 0, F.sha2(F.array_join("named", ","), 256))
    rows = written(rows.withColumn("sets", name), workspace(docs.sparkSession, "contaminated"), small=True)  # without the texts
    each = rows.where("sets IS NOT NULL").groupBy("sets").agg(F.first("named").alias("named")).select("sets", F.explode("named").alias("items")).join(sets, "items")
    items = each.select("sets", F.explode("item_ids").alias("id")).groupBy("sets").agg(_set_of(F.col("id")).alias("item_ids"))
    return rows.drop("named"), items


def _told(rows: DataFrame, items: DataFrame, none: dict[str, Column]) -> DataFrame:
    """The rows with what is told of their sets; those without any get ``none``, without a join."""
    clean = rows.where("sets IS NULL").select("doc_id", "n_words", "n_hit", *[v.alias(k) for k, v in none.items()])
    return clean.unionByName(rows.where("sets IS NOT NULL").join(items, "sets").select("doc_id", "n_words", "n_hit", *none))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, item_ids (sorted as strings).

    A word inside any occurrence of a test window counts once in n_hit. A null item_id is one item,
    last in item_ids, however many rows of ``benchmark`` have it. Repeated rows are judged
    each for itself. Other columns are not read. An empty table gives no rows.
    """
    return _told(*_judged(docs, benchmark, width), {"item_ids": F.array().cast("array<string>")})


def hit_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, spans: array of (first, last) word positions of each maximal run of hit words."""
    hits = _hits(docs, benchmark, width)[0]
    lasts = running(F.col("hits"), "int", F.lit(-2), lambda last, x: F.greatest(last, x["start"] + x["width"] - 1))
    last = F.aggregate("hits", F.lit(-2), lambda at, x: F.greatest(at, x["start"] + x["width"] - 1))
    told = F.zip_with("hits", lasts, lambda x, before: F.struct(x["start"].alias("first"), before.alias("before")))

    def spans(firsts: Column) -> Column:
        ends = F.concat(F.transform(F.slice(firsts, 2, F.greatest(F.size(firsts) - 1, F.lit(0))), lambda x: x["before"]), F.array(last))
        return F.zip_with(firsts, ends, lambda x, end: F.struct(x["first"].alias("first"), end.alias("last")))

    none = F.array().cast("array<struct<first:int,last:int>>")
    found = let(F.filter(told, lambda x: x["first"] > x["before"] + 1), spans)
    return hits.select("doc_id", F.when(F.size("hits") == 0, none).otherwise(found).alias("spans"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents that hold no window of the test set, with all their columns, unchanged."""
    keyed = docs.withColumns({"__sl_id": F.col("doc_id"), "__sl_h": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    bad = _hits(docs, benchmark, width)[0].where(F.size("hits") > 0)
    bad = bad.select(F.col("doc_id").alias("__sl_id"), F.col("__h").alias("__sl_h")).distinct()
    return null_safe_join(keyed, bad, ["__sl_id", "__sl_h"], "left_anti").drop("__sl_id", "__sl_h")


def op9_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's digest of ``decontaminate``."""
    rows, items = _judged(docs, benchmark, WIDTH)
    digest = F.sha2(F.array_join("item_ids", ","), 256)  # a null item has no text there
    told = items.select("sets", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"))
    found = _told(rows, told, {"n_items": F.lit(0).cast("long"), "items_sha256": F.sha2(F.lit(""), 256)})
    return found.withColumn("contaminated", F.col("n_hit") > 0)


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
  FROM documents
),
b AS (
  SELECT item_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
  FROM benchmark
),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS k, unnest(list_transform(range(1, len(ws) - least(len(ws), 10) + 2), lambda i: array_to_string(ws[i:i + least(len(ws), 10) - 1], ' '))) AS gram FROM b WHERE len(ws) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT r, k, unnest(range(1, len(ws) - k + 2)) AS i, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS gram
  FROM d, ks WHERE len(ws) >= k
),
hit AS (SELECT r, i, dw.k, item_id FROM dw JOIN bw ON dw.gram = bw.gram AND dw.k = bw.k),
words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM hit) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
