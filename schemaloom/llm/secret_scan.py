"""Secret scanning with a trigram inverted index.

For each rule's regular expression a Boolean query over lower-case trigrams is derived: a document
that holds a match must satisfy it. The index holds postings (trigram, document), sorted by trigram
in Parquet files, and the list of the trigrams that it covers: those that the queries of the given
rules name. Intersecting postings gives each rule's candidates, which its expression then verifies;
a rule whose expression has no mandatory trigram scans every document. Once written, an index
answers any rules whose trigrams it covers without reading a text.
"""

from __future__ import annotations

import json
import re._parser as regex_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, document_key, let, null_safe_join, read_text, running, workspace, write_text, written

#: Literal strings that one position may expand to before the derivation gives up on exactness.
MOST_STRINGS = 64
#: A character class up to this size is expanded.
MOST_CHARS = 8


@dataclass(frozen=True)
class Rule:
    """``base`` rules are counted and digested; ``min_chars`` is asked of capture group ``group``."""

    kind: str
    regex: str
    group: int = 0
    min_chars: int = 0
    ignore_case: bool = False
    base: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.regex


# The expressions of the secret formats.
RULES = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, False, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, False, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]


def _trigrams(text: str) -> frozenset[str]:
    text = text.lower()
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _absorbed(clauses: set[frozenset[str]]) -> set[frozenset[str]]:
    """A disjunction without the clauses that another one implies."""
    return {c for c in clauses if not any(o < c for o in clauses)}


class _Derivation:
    """Walks a parsed expression with the set of strings that may stand right before the current place."""

    def __init__(self) -> None:
        self.strings: set[str] | None = {""}
        self.query: set[frozenset[str]] = {frozenset()}  # disjunction of conjunctions

    def _require(self, clauses: set[frozenset[str]]) -> None:
        both = _absorbed({a | b for a in self.query for b in clauses})
        if len(both) <= MOST_STRINGS:
            self.query = both

    def flush(self) -> None:
        if self.strings:
            self._require({_trigrams(s) for s in self.strings})
        self.strings = {""}

    def append(self, options: set[str] | None) -> None:
        if options is None or len(self.strings) * len(options) > MOST_STRINGS:
            self.flush()
            return
        self.strings = {a + b for a in self.strings for b in options}

    def walk(self, parsed) -> None:
        for op, value in parsed:
            name = str(op)
            if name == "LITERAL":
                self.append({chr(value).lower()})
            elif name == "IN":
                self.append(_class_members(value))
            elif name == "SUBPATTERN":
                self.walk(value[-1])
            elif name == "BRANCH":
                self.append(_exact([branch for branch in value[1]]))
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, inner = value
                exact = _exact([inner])
                if exact and high == 1 and low == 0:
                    self.append(exact | {""})
                elif exact and low >= 1:
                    for _ in range(min(low, 8)):
                        self.append(exact)
                    if low != high or low > 8:
                        self.flush()
                else:
                    self.append(None)
            elif name != "AT":
                self.append(None)


def _class_members(items) -> set[str] | None:
    found: set[str] = set()
    for op, value in items:
        if str(op) == "LITERAL":
            found.add(chr(value).lower())
        elif str(op) == "RANGE" and value[1] - value[0] < MOST_CHARS:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= MOST_CHARS else None


def _exact(branches) -> set[str] | None:
    """All lower-case strings that the branches match, or None where they are too many or unbounded."""
    found: set[str] = set()
    for branch in branches:
        inner = _Derivation()
        flushed = []
        inner.flush = lambda: flushed.append(1)
        inner.walk(branch)
        if flushed:
            return None
        found |= inner.strings
    return found if len(found) <= MOST_STRINGS else None


def trigram_query(regex: str) -> set[frozenset[str]] | None:
    """The expression's query: any of the clauses, all trigrams of a clause; None where nothing is mandatory."""
    derivation = _Derivation()
    derivation.walk(regex_parser.parse(regex))
    derivation.flush()
    return None if frozenset() in derivation.query else derivation.query


def postings(keyed: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index of these trigrams: (trigram, doc_id, __h), a document once for each trigram."""
    lowered = keyed.select("doc_id", "__h", ascii_lower(F.col("text")).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return lowered.select("doc_id", "__h", F.explode(held).alias("trigram"))


def _clauses(rules: list[Rule]) -> tuple[list[tuple[str, int, int, str]], list[str]]:
    """(kind, clause, trigrams of the clause, trigram) of all queries; the kinds that scan fully."""
    clauses, full = [], []
    for rule in rules:
        query = trigram_query(rule.regex)
        if query is None:
            full.append(rule.kind)
            continue
        clauses += [(rule.kind, n, len(clause), t) for n, clause in enumerate(sorted(query, key=sorted)) for t in sorted(clause)]
    return clauses, full


def write_index(docs: DataFrame, rules: list[Rule], path: str) -> str:
    """Write the index of these rules' trigrams under ``path``, a shared folder, and return it."""
    trigrams = sorted({c[-1] for c in _clauses(rules)[0]})
    if trigrams:
        found = postings(document_key(docs), trigrams).hint("rebalance", "trigram")  # a common trigram may fill many files
        written(found.sortWithinPartitions("trigram"), f"{path}/postings")
    write_text(docs.sparkSession, f"{path}/trigrams.json", json.dumps(trigrams))
    return path


def candidates(spark: SparkSession, index: str, rules: list[Rule]) -> tuple[DataFrame | None, list[str]]:
    """(doc_id, __h, kinds) of the documents that a rule's query admits; the kinds that scan fully."""
    clauses, full = _clauses(rules)
    if not clauses:
        return None, full
    named = sorted({c[-1] for c in clauses})
    if not {*named} <= {*json.loads(read_text(spark, f"{index}/trigrams.json") or "[]")}:
        raise ValueError("the index does not cover these rules")
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("kind", "clause", "needs", "trigram"), c, strict=True)]) for c in clauses])
    wanted = spark.range(1).select(F.inline(rows))  # a few rows for each rule
    found = spark.read.parquet(f"{index}/postings").where(F.col("trigram").isin(named))
    met = found.join(F.broadcast(wanted), "trigram").groupBy("doc_id", "__h", "kind", "clause", "needs").agg(F.count_distinct("trigram").alias("n"))
    return met.where(F.col("n") == F.col("needs")).groupBy("doc_id", "__h").agg(F.collect_set("kind").alias("kinds")), full


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """The rule's matches as (start, order, end, kind), leftmost and non-overlapping; code points, end exclusive."""
    regex = F.lit(rule.java)
    matches, between = F.regexp_extract_all(text, regex, 0), F.split(text, rule.java, -1)
    checked = F.regexp_extract_all(text, regex, rule.group)

    def located(parts: Column) -> Column:
        befores = running(parts, "int", F.lit(0), lambda at, m: at + F.char_length(m["before"]) + F.char_length(m["match"]))

        def span(m: Column, at: Column) -> Column:
            start = at + F.char_length(m["before"])
            return F.struct(start.alias("start"), (start + F.char_length(m["match"])).alias("end"))

        return F.zip_with(parts, befores, span)

    parts = F.zip_with(F.slice(between, 1, F.greatest(F.size(between) - 1, F.lit(0))), matches, lambda b, m: F.struct(b.alias("before"), m.alias("match")))
    both = F.arrays_zip(let(parts, located).alias("span"), checked.alias("checked"))
    long_enough = F.filter(both, lambda x: F.char_length(x["checked"]) >= rule.min_chars)
    spans = F.transform(long_enough, lambda x: F.struct(x["span"]["start"].alias("start"), F.lit(order).alias("order"), x["span"]["end"].alias("end"), F.lit(rule.kind).alias("kind")))
    return F.when(F.regexp_like(text, regex), spans)


def find_secrets(docs: DataFrame, rules: list[Rule] = RULES, index: str | None = None) -> DataFrame:
    """Each document's secrets: doc_id, text (null: empty), spans: array of (start, order, end, kind).

    ``index`` is the folder of an index of these documents; without it one is written first.

    Spans are sorted by start, then by the rules' order; spans of different kinds may overlap.
    One row for each row of ``docs``; repeated rows get equal results. Other columns are not read.
    A text may be very long and have very many matches: the work is in proportion to both.
    """
    keyed = document_key(docs)
    spark = docs.sparkSession
    chosen, full = candidates(spark, index or write_index(docs, rules, workspace(spark, "trigrams")), rules)
    if chosen is None:
        both = keyed.withColumn("kinds", F.array().cast("array<string>"))
    else:
        both = null_safe_join(keyed, chosen, ["doc_id", "__h"], "left")
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    found = []
    for order, rule in enumerate(rules):
        spans = _spans(F.col("text"), rule, order)
        admitted = F.lit(True) if rule.kind in full else F.array_contains("kinds", rule.kind)
        found.append(F.coalesce(F.when(admitted, spans), none))
    return both.select("doc_id", "text", F.array_sort(F.concat(*found)).alias("spans"))


def redact(docs: DataFrame, rules: list[Rule] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """doc_id and the text with every span masked; of overlapping spans the first one counts."""
    found = find_secrets(docs, rules)
    characters = F.regexp_extract_all("text", F.lit("(?s)."), 0)
    ends = running(F.col("spans"), "int", F.lit(0), lambda at, x: F.greatest(at, x["end"]))

    def masked(chars: Column) -> Column:
        def piece(x: Column, at: Column) -> Column:
            return F.when(x["start"] < at, F.lit("")).otherwise(F.concat(F.array_join(F.slice(chars, at + 1, F.greatest(x["start"] - at, F.lit(0))), ""), F.lit(mask)))

        last = F.aggregate("spans", F.lit(0), lambda at, x: F.greatest(at, x["end"]))
        tail = let(last, lambda at: F.array_join(F.slice(chars, at + 1, F.greatest(F.size(chars) - at, F.lit(0))), ""))
        return F.concat(F.array_join(F.zip_with("spans", ends, piece), ""), tail)

    return found.select("doc_id", F.when(F.size("spans") == 0, F.col("text")).otherwise(let(characters, masked)).alias("text"))


def op3_secret_scan(docs: DataFrame) -> DataFrame:
    """The contract's digest of ``find_secrets`` with the base rules and the further ones."""
    found = find_secrets(docs)
    base = [r.kind for r in RULES if r.base]
    as_text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    counts = [_count_of(kind).alias(f"n_{kind}") for kind in base]
    digest = F.sha2(as_text(F.filter("spans", lambda x: x["kind"].isin(base))), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, as_text(F.col("spans")).alias("spans"))


def _count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")


def _located(rule: Rule, order: int) -> str:
    regex = "'" + rule.java.replace("'", "''") + "'"
    checked = f"regexp_extract_all(text, {regex}, {rule.group})"
    return f"""
  SELECT r, {order} AS o, '{rule.kind}' AS kind, s, e FROM (
    SELECT r, unnest(list_transform(range(1, len(m) + 1), lambda i: len(array_to_string(b[1:i], '')) + len(array_to_string(m[1:i - 1], '')))) AS s,
           unnest(list_transform(range(1, len(m) + 1), lambda i: len(array_to_string(b[1:i], '')) + len(array_to_string(m[1:i], '')))) AS e, unnest(g) AS g
    FROM (SELECT r, regexp_extract_all(text, {regex}) AS m, {checked} AS g, regexp_split_to_array(text, {regex}) AS b FROM d) WHERE len(m) > 0
  ) WHERE len(g) >= {rule.min_chars}"""


def _sql() -> str:
    parts = [_located(rule, order) for order, rule in enumerate(RULES)]
    base = ", ".join(f"'{r.kind}'" for r in RULES if r.base)
    counts = ",\n       ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in RULES if r.base)
    sums = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({' UNION ALL '.join(parts)}
),
each AS (
  SELECT r, {sums}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (kind IN ({base})) AS base FROM found GROUP BY r
)
SELECT doc_id, {counts},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN each USING (r)
"""


OP3_SQL = _sql()
