"""Phrase collocations: count-min sketches of n-grams, an exact count of the survivors, scores.

The first pass adds every run of one to four words to a count-min sketch: two rows of counters, each
n-gram in one counter of either row. A task emits the counters that it touched, by slices, and the
slices of all tasks are summed. A sketch never counts too little, so an n-gram of ``least``
occurrences or more has both its counters there, and so have all n-grams inside it. The second pass
counts only what the sketch lets through, exactly and by its words, so nothing frequent is lost and
nothing rare stays. Its width grows with the texts; a wider one only lets fewer rare n-grams through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import workspace, written

# The characters between pieces, and between words.
BREAKS, BLANKS = ".,;:!?\n\x0b\x0c\r", " \t"
MOST_WORDS, LEAST, TOP, COVERED = 4, 30, 2000, 80


@dataclass(frozen=True)
class Limits:
    """Sizes of the sketch and of what a task holds; none of them changes a result."""

    bytes_a_counter: int = 16  # a row has a counter for so many bytes of text
    widest: int = 1 << 29  # 64 MB of bits a row; a sketch of larger corpora lets more rare n-grams through to the exact count
    slice_: int = 1 << 20  # counters that are summed together
    gathered: int = 1 << 22  # n-grams that a task adds up before it emits counters
    part: int = 8 << 20  # bytes of text that are divided at once


_KIND = np.zeros(256, np.uint8)
_KIND[[ord(c) for c in BLANKS]], _KIND[[ord(c) for c in BREAKS]] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Words:
    """The words of some texts, in order: their place in a dictionary, their language, and whether the next one follows in the same piece."""

    def __init__(self, texts, langs):
        import pyarrow as pa
        import xxhash

        wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        bounds = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds -= bounds[0]
        kind = _KIND[data]
        inside = kind == 0
        held = bounds[1:] > bounds[:-1]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        for marks, at in ((begins, bounds[:-1][held]), (ends, bounds[1:][held] - 1)):
            marks[at] = inside[at]  # words end with their text
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        row = np.searchsorted(bounds[1:], starts, side="right")
        piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
        self.follows = np.zeros(len(starts), bool)
        self.follows[:-1] = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
        offsets = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(stops - starts, out=offsets[1:])
        own = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[inside]])]).dictionary_encode()
        self.ids, self.dictionary = own.indices.to_numpy(), own.dictionary
        tongues = langs.dictionary_encode()
        self.lang, self.langs = tongues.indices.to_numpy()[row], tongues.dictionary
        of = lambda values, seed: np.array([xxhash.xxh64_intdigest(v, seed) for v in values.cast(pa.binary()).to_pylist()], np.uint64)
        self.hashes = of(self.dictionary, 1)[self.ids]
        self.salt = of(self.langs, 2)[self.lang]

    def grams(self, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For 1 to ``most`` words: the number, the first words' places, and a 64-bit hash of language and words."""
        at, h = np.arange(len(self.ids)), (self.hashes ^ self.salt) * _M1
        for n in range(1, most + 1):
            if n > 1:
                goes = self.follows[at + n - 2]
                at, h = at[goes], h[goes]
                h = (h ^ (h >> np.uint64(29))) * _M1 + self.hashes[at + n - 1]
            mixed = (h ^ (h >> np.uint64(32))) * _M2
            yield n, at, mixed ^ (mixed >> np.uint64(32))


def _parts(batches, bytes_: int) -> Iterator[Words]:
    """The words of all rows (lang, text), of some texts at a time."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            before = sizes[first - 1] if first else 0
            upto = max(first + 1, int(np.searchsorted(sizes, before + bytes_, side="right")))
            yield Words(batch.column(1).slice(first, upto - first), batch.column(0).slice(first, upto - first))
            first = upto


def _counters(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """An n-gram's counter in either row."""
    mask = np.uint64(width - 1)
    return (h & mask).astype(np.uint32), ((h >> np.uint64(32)) & mask).astype(np.uint32)


def sketch(texts: DataFrame, width: int, most: int, least: int, path: str, limits: Limits = Limits()) -> DataFrame:
    """(row, slice, bits) of the summed sketch: a bit for each counter that reaches ``least``.

    Counters of a task end at 255, which ``least`` may not pass, and of all tasks at no bound.
    """
    if not 0 < least <= 255:
        raise ValueError("least must be from 1 to 255")
    size = limits.slice_

    def add(batches) -> Iterator:
        import pyarrow as pa
        import zstandard

        packed = zstandard.ZstdCompressor(level=1).compress
        gathered: tuple[list, list] = ([], [])

        def emit():
            rows = []
            for row, some in enumerate(gathered):
                touched = np.sort(np.concatenate(some))
                first = np.flatnonzero(np.diff(touched, prepend=np.uint32(0)) > 0) if len(touched) else np.zeros(0, np.int64)
                if len(touched) and (not len(first) or first[0]):
                    first = np.concatenate([[0], first])
                at, n = touched[first], np.minimum(np.diff(first, append=len(touched)), 255).astype(np.uint8)
                cuts = np.searchsorted(at, np.arange(0, width, size, dtype=np.int64))
                for part, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(at)], strict=True)):
                    if a < b:
                        steps = np.diff(at[a:b] & np.uint32(size - 1), prepend=np.uint32(0))
                        kind = "<u2" if steps.max() < 1 << 16 else "<u4"
                        rows.append((row, part, kind, packed(steps.astype(kind).tobytes()), packed(n[a:b].tobytes())))
                some.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        names, types = ["row", "slice", "kind", "steps", "n"], [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary()]
        held = 0
        for words in _parts(batches, limits.part):
            for _, _, h in words.grams(most):
                for some, c in zip(gathered, _counters(h, width), strict=True):
                    some.append(c)
                held += len(h)
                if held >= limits.gathered:
                    yield emit()
                    held = 0
        if held:
            yield emit()

    def total(batches) -> Iterator:
        import pyarrow as pa
        import zstandard

        unpacked = zstandard.ZstdDecompressor().decompress
        now, sums = None, np.zeros(size, np.int64)

        def bits():
            return pa.RecordBatch.from_pydict({"row": pa.array([now[0]], pa.int32()), "slice": pa.array([now[1]], pa.int32()), "bits": [np.packbits(sums >= least).tobytes()]})

        for batch in batches:
            for row, part, kind, steps, n in zip(*(batch.column(i) for i in range(5)), strict=True):
                own = row.as_py(), part.as_py()
                if now not in (None, own):
                    yield bits()
                    sums[:] = 0
                now = own
                at = np.cumsum(np.frombuffer(unpacked(steps.as_py()), kind.as_py()), dtype=np.int64)
                sums[at] += np.frombuffer(unpacked(n.as_py()), np.uint8)
        if now:
            yield bits()

    touched = texts.mapInArrow(add, "row int, slice int, kind string, steps binary, n binary")
    dealt = touched.repartition("row", "slice").sortWithinPartitions("row", "slice")
    return written(dealt.mapInArrow(total, "row int, slice int, bits binary"), path)


def _counted(shared, most: int, part: int):
    """Exact counts of what the sketch lets through, by parts of the texts: lang, words, phrase, f; words is 0 for all words of a language."""

    def survives(h: np.ndarray, width: int, rows) -> np.ndarray:
        found = np.ones(len(h), bool)
        for bits, c in zip(rows, _counters(h, width), strict=True):
            found &= (bits[c >> 3] >> (7 - (c & np.uint32(7))).astype(np.uint8) & 1).astype(bool)
        return found

    def count(batches) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        width, rows = shared.value
        for words in _parts(batches, part):
            out = {"lang": [], "words": [], "phrase": [], "f": []}

            def put(lang, n, phrase, f, out=out):
                for name, values in zip(out, (lang, pa.array(np.full(len(f), n, np.int32)), phrase, pa.array(f.astype(np.int64))), strict=True):
                    out[name].append(values)

            totals = np.bincount(words.lang, minlength=len(words.langs))
            put(words.langs, 0, pa.array([""] * len(totals), pa.string()), totals)
            frequent = np.ones(len(words.ids), bool)
            for n, at, h in words.grams(most):
                keep = survives(h, width, rows) & frequent[at] & (frequent[at + 1] if n > 1 else True)
                frequent = np.zeros(len(words.ids), bool)
                at, h = at[keep], h[keep]
                frequent[at] = True
                own = [words.lang[at], *(words.ids[at + j] for j in range(n))]
                _, first, which, f = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                if any((x != x[first][which]).any() for x in own):  # two n-grams of one hash: told apart by their words
                    _, first, f = np.unique(np.stack(own, 1), axis=0, return_index=True, return_counts=True)
                texts = [words.dictionary.take(pa.array(x[first])) for x in own[1:]]
                put(words.langs.take(pa.array(own[0][first])), n, pc.binary_join_element_wise(*texts, " ") if n > 1 else texts[0], f)
            columns = [pa.concat_arrays(v) for v in out.values()]
            yield pa.RecordBatch.from_arrays(columns, names=list(out))

    return count


def counts(docs: DataFrame, most: int = MOST_WORDS, least: int = LEAST, limits: Limits = Limits()) -> DataFrame:
    """lang, words, phrase, f: every run of 1 to ``most`` words that occurs ``least`` times or more; words 0 is all words of a language."""
    spark = docs.sparkSession
    path = workspace(spark, "phrases")
    lang, text = F.coalesce(F.col("lang").cast("string"), F.lit("und")), F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(lang.alias("lang"), text.alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = min(limits.widest, max(limits.slice_, 1 << (size // limits.bytes_a_counter).bit_length()))
    bits, step = np.zeros((2, width // 8), np.uint8), limits.slice_ // 8  # at most 2 * widest bits
    for r in sketch(texts, width, most, least, f"{path}/sketch", limits).toLocalIterator():
        bits[r.row, r.slice * step : (r.slice + 1) * step] = np.frombuffer(r.bits, np.uint8)
    shared = spark.sparkContext.broadcast((width, bits))
    found = texts.mapInArrow(_counted(shared, most, limits.part), "lang string, words int, phrase string, f bigint")
    exact = found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where((F.col("words") == 0) | (F.col("f") >= least))
    return written(exact, f"{path}/counts", small=True)


def _exact(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def scored(known: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases of two words and more, at the cut of the lowest score."""
    own = known.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    first, rest = F.array_join(F.slice("w", 1, F.col("cut")), " "), F.array_join(F.slice("w", F.col("cut") + 1, F.size("w")), " ")
    cuts = own.select("lang", "phrase", "a", "cut", first.alias("first"), rest.alias("rest"))
    for part, n in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(known.where("words > 0").select("lang", F.col("phrase").alias(part), F.col("f").alias(n)), ["lang", part])
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    lowest = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("x")
    return cuts.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def subsumed(known: DataFrame, covered: int = COVERED) -> DataFrame:
    """(lang, phrase) whose words lie inside a longer phrase that has ``covered`` % of their occurrences or more."""
    longer = known.where("words > 2").select("lang", "f", "words", F.split("phrase", " ").alias("w"))
    sized = longer.withColumn("n", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    placed = sized.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("n") + 1)))
    parts = placed.select("lang", F.array_join(F.slice("w", F.col("at"), F.col("n")), " ").alias("phrase"), "f")
    most = parts.groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    own = known.where("words > 1").select("lang", "phrase", F.col("f").alias("a"))
    return own.join(most, ["lang", "phrase"]).where(_exact(F.col("longest")) * 100 >= _exact(F.col("a")) * covered).select("lang", "phrase")


def collocations(docs: DataFrame, most: int = MOST_WORDS, least: int = LEAST, top: int = TOP, covered: int = COVERED, limits: Limits = Limits()) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts have A-Z in lower case and are split at ``BREAKS`` and line ends into pieces, and these at
    blanks and tabs into words. A null text is empty, and a null lang ``und``, with the texts that
    have that lang. Repeated rows count as often as they occur; doc_id is not read, nor is any other
    column. An empty table, or one without a phrase of ``least`` occurrences, gives no rows.
    """
    known = counts(docs, most, least, limits)
    left = scored(known).join(subsumed(known, covered), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    n = known.where("words = 0").select("lang", F.col("f").alias("n"))
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(docs: DataFrame) -> DataFrame:
    """The contract's rows: ``collocations`` with its defaults."""
    return collocations(docs)


OP13_SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS ws FROM pieces),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS MATERIALIZED (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, {MOST_WORDS + 1})) AS k) WHERE len(ws) >= k)
  GROUP BY ALL HAVING count(*) >= {LEAST}
),
cuts AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS s, unnest(range(1, k)) AS cut FROM g WHERE k > 1),
scores AS (
  SELECT c.lang, c.k, c.phrase, c.a, min({{'score': (2000000::HUGEINT * c.a // (l.f + r.f))::BIGINT, 'cut': c.cut, 'l': l.f, 'r': r.f}}) AS x
  FROM cuts c JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(c.s[:c.cut], ' ') JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(c.s[c.cut + 1:], ' ')
  GROUP BY ALL
),
inner_ AS (
  SELECT lang, array_to_string(s[i:i + m - 1], ' ') AS phrase, max(f) AS longest
  FROM (SELECT lang, f, s, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT lang, k, f, string_split(phrase, ' ') AS s, unnest(range(2, k)) AS m FROM g WHERE k > 2))
  GROUP BY ALL
),
kept AS (
  SELECT s.lang, s.phrase, s.a, s.x.l AS l, s.x.r AS r, s.x.score AS score,
         row_number() OVER (PARTITION BY s.lang ORDER BY s.x.score DESC, s.a DESC, s.phrase) AS rank
  FROM scores s LEFT JOIN inner_ i ON i.lang = s.lang AND i.phrase = s.phrase WHERE i.longest IS NULL OR 100 * i.longest < {COVERED} * s.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) WHERE rank <= {TOP}
"""
