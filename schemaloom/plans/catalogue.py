"""Every registered query of the library with its SQL.

A query applies one operator to the tables of a folder; its SQL computes the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.functions import text as tx
from schemaloom.functions.embed import LexicalEmbedder
from schemaloom.functions.vectors import l2_normalise, mean_pool
from schemaloom.operators import approach, joins, metrics, models, profile, sets, training
from schemaloom.operators.search import top_k, top_k_texts
from schemaloom.plans.registry import ORACLE_SQL, QUERIES, register, table
from schemaloom.sources import readers, writers
from schemaloom.streaming.landing import event_counts

# vectors

_PAIRS = """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
p AS (
  SELECT q.vec_id AS source_id, t.vec_id AS target_id, q.label AS source_label, t.label AS target_label,
         round(list_cosine_similarity(q.e, t.e), 12) AS s
  FROM v q JOIN v t ON q.vec_id % 20 = 0 AND q.vec_id <> t.vec_id
),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY s DESC, target_id) AS rk FROM p)
"""


def _neighbours(spark: SparkSession, sf_dir: str, k: int, threshold: float | None = None) -> DataFrame:
    """The stated query set, every vector whose id is divisible by 20, against all vectors but itself."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return top_k(vectors.where("id % 20 = 0"), vectors, k, threshold, skip_self=True)


@register(_PAIRS + "SELECT source_id, target_id, round(s, 6) AS similarity, rk::INTEGER AS rk FROM r WHERE rk <= 10")
def topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir, 10).withColumn("similarity", F.round("similarity", 6))


@register(_PAIRS + "SELECT source_id, target_id, round(s, 6) AS similarity FROM r WHERE rk <= 50 AND s >= 0.3")
def threshold_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir, 50, 0.3).select("source_id", "target_id", F.round("similarity", 6).alias("similarity"))


@register(_PAIRS + "SELECT source_id, target_id, round(s, 6) AS similarity FROM r WHERE rk = 1")
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = metrics.best_per_source(_neighbours(spark, sf_dir, 10), ["source_id"], "similarity", ["target_id"])
    return best.select("source_id", "target_id", F.round("similarity", 6).alias("similarity"))


@register(
    _PAIRS
    + """,
s AS (SELECT source_label AS label, source_id, target_id FROM r WHERE rk <= 5),
e AS (SELECT source_label AS label, source_id, target_id FROM r WHERE rk <= 10 AND source_label = target_label),
c AS (
  SELECT coalesce(s.label, e.label) AS label, count(s.source_id) AS n_suggested, count(e.source_id) AS n_expected,
         count(*) FILTER (s.source_id IS NOT NULL AND e.source_id IS NOT NULL) AS n_correct
  FROM s FULL JOIN e ON s.label = e.label AND s.source_id = e.source_id AND s.target_id = e.target_id GROUP BY 1
),
m AS (SELECT *, CASE WHEN n_suggested > 0 THEN n_correct / n_suggested ELSE 0.0 END AS p, CASE WHEN n_expected > 0 THEN n_correct / n_expected ELSE 0.0 END AS rc FROM c)
SELECT label, n_suggested, n_expected, n_correct, round(p, 6) AS "precision", round(rc, 6) AS recall,
       round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0.0 END, 6) AS f1_score FROM m
"""
)
def knn_label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    found = _neighbours(spark, sf_dir, 10)
    found = found.join(labels.select(F.col("vec_id").alias("source_id"), F.col("label").alias("test_id")), "source_id")
    found = found.join(labels.select(F.col("vec_id").alias("target_id"), F.col("label").alias("target_label")), "target_id")
    pairs = found.select("test_id", "rk", "target_label", *[F.col(c).cast("string").alias(n) for c, n in (("source_id", "source_node"), ("target_id", "target_node"))])
    pairs = pairs.withColumns({"source_property": F.lit("v"), "target_property": F.lit("v")})
    scored = metrics.case_metrics(pairs.where("rk <= 5"), pairs.where("test_id = target_label"))
    rounded = [F.round(c, 6).alias(c) for c in ("precision", "recall", "f1_score")]
    return scored.select(F.col("test_id").alias("label"), "n_suggested", "n_expected", "n_correct", *rounded)


@register(
    """
WITH x AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY ALL),
n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label)
SELECT label, (i - 1)::INTEGER AS dim, round(x / n, 6) AS value FROM m JOIN n USING (label)
"""
)
def mean_pool_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = mean_pool(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    each = pooled.select("label", F.posexplode(l2_normalise(F.col("embedding"))).alias("dim", "value"))
    return each.withColumn("value", F.round("value", 6))


@register()
def lexical_embed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of part lines against all part lines, by the default embedder."""
    lines = _part_lines(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.col("line").alias("text"))
    return top_k_texts(lines.where("id % 20 = 0"), lines, LexicalEmbedder(), 5, 0.0, skip_self=True).withColumn("similarity", F.round("similarity", 6))


# lines


def _part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    size = F.concat(F.lit("Size\t"), F.col("p_size").cast("string"))
    return part.withColumn("line", tx.render_line(F.col("p_brand"), F.col("p_name"), F.col("p_type"), size))


_LINE = "p_brand || '.' || p_name || ' (' || p_type || '): Size    ' || p_size"


@register(f"SELECT p_partkey, {_LINE} AS line FROM part")
def render_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_lines(spark, sf_dir).select("p_partkey", "line")


@register(
    f"""
WITH l AS (SELECT p_partkey, {_LINE} AS line FROM part)
SELECT p_partkey, {", ".join(f"trim(regexp_extract(line, '{tx.LINE_RE2}', {i + 1})) AS {n}" for i, n in enumerate(tx.LINE_FIELDS))} FROM l
"""
)
def parse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_lines(spark, sf_dir).select("p_partkey", tx.parse_line(F.col("line")).alias("x")).select("p_partkey", "x.*")


@register(
    """
SELECT s_suppkey, trim(split_part(line, ':', 1)) AS name, trim(substr(line, instr(line, ':') + 1)) AS description
FROM (SELECT s_suppkey, s_nationkey || '.' || s_name || ': Balance ' || CAST(floor(s_acctbal) AS BIGINT) AS line FROM supplier)
"""
)
def parse_untyped(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    text = F.concat(F.lit("Balance "), F.floor("s_acctbal").cast("string"))
    line = tx.render_untyped(F.col("s_nationkey").cast("string"), F.col("s_name"), text)
    return supplier.select("s_suppkey", tx.split_at_colon(line).alias("x")).select("s_suppkey", "x.*")


_CURIE = "'EX:' || trim(regexp_replace({n}, '\\W+', '_', 'g'), '_') || '_' || trim(regexp_replace({p}, '\\W+', '_', 'g'), '_')"


@register(f"SELECT p_partkey, {_CURIE.format(n='p_brand', p='p_name')} AS curie FROM part")
def curie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.curie(F.concat("p_brand", F.lit("."), "p_name")).alias("curie"))


@register(
    f"""
SELECT {_CURIE.format(n='p_brand', p='p_name')} AS subject_id, p_brand || '.' || p_name AS subject_label, 'skos:relatedMatch' AS predicate_id,
       {_CURIE.format(n='p_type', p='p_name')} AS object_id, p_type || '.' || p_name AS object_label,
       'semapv:UnspecifiedMatching' AS mapping_justification, p_size / 100 AS similarity_score
FROM part
"""
)
def sssom_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    suggested = part.select(
        F.col("p_brand").alias("source_node"), F.col("p_name").alias("source_property"),
        F.col("p_type").alias("target_node"), F.col("p_name").alias("target_property"), (F.col("p_size") / 100).alias("similarity"),
    )
    return approach.mapping_rows(suggested)


@register("SELECT doc_id FROM documents WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) < 1000")
def length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(tx.shorter_than(F.col("text"), 1000)).select("doc_id")


@register("SELECT p_partkey, p_name FROM part WHERE NOT (p_name LIKE '%rod' OR p_name LIKE '%et')")
def suffix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(~tx.ends_with_any(F.col("p_name"), ["rod", "et"])).select("p_partkey", "p_name")


# models


def _part_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A simple model of one node and three properties from each part."""
    prop = lambda name, kind, text: F.struct(F.lit(name).alias("name"), text.alias("description"), F.lit(kind).alias("type"))
    ps = F.array(prop("name", "string", F.col("p_name")), prop("size", "integer", F.col("p_size").cast("string")), prop("type", "string", F.col("p_type")))
    node = F.struct(F.col("p_brand").alias("name"), F.lit("A brand").alias("description"), ps.alias("properties"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("model_id"), F.to_json(F.struct(F.array(node).alias("nodes"))).alias("json"))


@register(
    """
SELECT p_partkey AS model_id, 0 AS node_ord, u.o AS prop_ord, p_brand AS node_name, u.n AS property_name, u.d AS property_description, u.t AS property_type,
       p_brand || '.' || u.n || ' (' || u.t || '): ' || u.d AS npd
FROM (SELECT *, unnest([{'o': 0, 'n': 'name', 'd': p_name, 't': 'string'}, {'o': 1, 'n': 'size', 'd': p_size::VARCHAR, 't': 'integer'}, {'o': 2, 'n': 'type', 'd': p_type, 't': 'string'}]) AS u FROM part)
"""
)
def property_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = models.parse_simple(_part_models(spark, sf_dir)).properties
    return found.select("model_id", "node_ord", "prop_ord", "node_name", "property_name", "property_description", "property_type", "npd")


def _supplier_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary of one node from each supplier: an enum without type, a term's description, and a link with two sub-properties."""
    s = F.col("s_suppkey").cast("string")
    parts = [
        F.lit('{"'), F.col("s_name"), F.lit('":{"description":"supplier","links":[{"name":"nations"}],"properties":{"state":{"enum":["a","b"],"description":"d'), s,
        F.lit('"},"balance":{"type":["number","null"],"term":{"description":"t'), s, F.lit('","termDef":{"id":'), s,
        F.lit('}}},"nations":{"anyOf":[{"items":{"properties":{"id":{"type":"string","description":"key"},"code":{"type":"string"}}}}]}}},"_terms":{"x":1}}'),
    ]
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("model_id"), F.concat(*parts).alias("json"))


@register(
    """
SELECT s_suppkey AS model_id, u.o AS prop_ord, s_name AS node_name, u.n AS property_name, u.d AS property_description, u.t AS property_type, u.m AS additional_metadata
FROM (SELECT *, unnest([
  {'o': 0, 'n': 'state', 'd': 'd' || s_suppkey, 't': 'enum', 'm': NULL},
  {'o': 1, 'n': 'balance', 'd': 't' || s_suppkey, 't': '[''number'', ''null'']', 'm': '{"cde_info":{"id":' || s_suppkey || '}}'},
  {'o': 2, 'n': 'nation.id', 'd': 'key', 't': 'string', 'm': NULL},
  {'o': 3, 'n': 'nation.code', 'd': '', 't': 'string', 'm': NULL}]) AS u FROM supplier)
"""
)
def dictionary_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = models.parse_dictionary(_supplier_dictionaries(spark, sf_dir)).properties
    return found.select("model_id", "prop_ord", "node_name", "property_name", "property_description", "property_type", "additional_metadata")


@register(
    """
SELECT 'd' || s_suppkey AS model_id, 'prefixed' AS chosen, 3::BIGINT AS n_properties FROM supplier
UNION ALL SELECT 's' || p_partkey, 'simple', 3 FROM part
"""
)
def detect_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionaries count as prefixed ones, the last dialect that accepts them; simple models stay simple."""
    d = _supplier_dictionaries(spark, sf_dir).withColumn("model_id", F.concat(F.lit("d"), "model_id"))
    s = _part_models(spark, sf_dir).withColumn("model_id", F.concat(F.lit("s"), "model_id"))
    found = models.parse_unknown(d.unionByName(s))
    n = found.properties.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_properties"))
    return found.valid.where("valid").join(n, "model_id").select("model_id", "chosen", "n_properties")


@register(
    """
SELECT p_partkey AS model_id, p_brand AS node_name, p_name AS property_name, p_type AS property_type, '{"unit":"u"}' AS additional_metadata, '{"kind":"k"}' AS node_metadata FROM part
"""
)
def linked_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    prop = F.struct(F.col("p_type").alias("type"), F.lit("d").alias("description"), F.lit("u").alias("unit"))
    node = F.struct(F.lit("n").alias("description"), F.lit("k").alias("kind"), F.create_map(F.col("p_name"), prop).alias("properties"))
    json = F.to_json(F.struct(F.create_map(F.col("p_brand"), node).alias("$defs")))
    found = models.parse_linked(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("model_id"), json.alias("json")))
    both = found.properties.join(found.nodes.select("model_id", "node_ord", "node_metadata"), ["model_id", "node_ord"])
    return both.select("model_id", "node_name", "property_name", "property_type", "additional_metadata", "node_metadata")


@register(
    """
SELECT p_partkey, p_name AS name, upper(p_name) AS definition, p_type AS property, p_size::VARCHAR AS id, 'https://example.org/' || p_partkey AS source FROM part
"""
)
def element_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda field, c: F.array(F.struct(c.alias(field)))
    raw = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("tinyId"),
        one("designation", F.col("p_name")).alias("designations"),
        one("definition", F.upper("p_name")).alias("definitions"),
        one("value", F.col("p_type")).alias("properties"),
        one("id", F.col("p_size").cast("string")).alias("ids"),
    )
    found = readers.common_elements(raw, "https://example.org/")
    first = lambda c: F.element_at(c, 1)
    return found.select(F.col("tinyId").cast("bigint").alias("p_partkey"), first("names").alias("name"), first("definitions").alias("definition"), first("properties").alias("property"), first("ids").alias("id"), "source")


# metrics


@register(
    """
SELECT lang, avg(quality) AS mean_quality, avg(toxic) AS mean_toxic, count(*) AS n, grouping(lang)::INTEGER AS is_total
FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)
"""
)
def metrics_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return metrics.metrics_by(rows, "lang", ["quality", "toxic"])


@register("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.finished_anti(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@register(
    """
SELECT 'source' AS side, l_orderkey::VARCHAR AS test_id, l_partkey::VARCHAR AS key, count(*) AS n FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY ALL
UNION ALL
SELECT 'target', l_orderkey::VARCHAR, l_suppkey::VARCHAR, count(*) FROM lineitem
WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY ALL
"""
)
def unknown_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of both sides that their table does not have."""
    lines = table(spark, sf_dir, "lineitem").select(*[F.col(c).cast("string").alias(n) for c, n in (("l_orderkey", "case"), ("l_partkey", "source_key"), ("l_suppkey", "target_key"))])
    one = F.lit(0).alias("test_id")
    part = table(spark, sf_dir, "part").where("p_size > 10").select(one, F.col("p_partkey").cast("string").alias("key"))
    supplier = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(one, F.col("s_suppkey").cast("string").alias("key"))
    missing = joins.unknown_keys(lines.select(one, "source_key", "target_key").distinct(), part, supplier)
    found = lines.select("case", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_key").alias("key")) for s in ("source", "target")])).alias("k")).select("case", "k.*")
    return found.join(missing.select("side", "key"), ["side", "key"], "left_semi").groupBy("side", F.col("case").alias("test_id"), "key").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text)::INTEGER AS row, role, length(text)::INTEGER AS n_chars FROM conversations")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("o", F.struct("turn", "role", "text")).withColumn("n_chars", F.char_length("text"))
    return metrics.metrics_rows(rows, "conv_id", "o", ["role", "n_chars"])


@register(
    """
SELECT 'documents' AS origin, doc_id AS id, lang, NULL::VARCHAR AS url FROM documents UNION ALL SELECT 'pages', page_id, NULL, url FROM pages
"""
)
def union_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "lang")
    b = table(spark, sf_dir, "pages").select(F.lit("pages").alias("origin"), F.col("page_id").alias("id"), "url")
    return sets.union_all([a, b])


@register(
    """
SELECT doc_id AS test_id, '{"doc_id":' || doc_id || ', "custom_metrics": {"quality":' || quality || ',"toxic":' || toxic || '}}' AS line FROM labels
"""
)
def append_metrics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    cases = labels.select(F.col("doc_id").alias("test_id"), F.to_json(F.struct("doc_id")).alias("line"))
    return writers.with_metrics(cases, labels.select(F.col("doc_id").alias("test_id"), "quality", "toxic"))


@register("SELECT lang, avg(quality) AS mean_quality, (SELECT avg(quality) FROM labels) AS overall FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def overall_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = metrics.with_overall_mean(table(spark, sf_dir, "labels"), "quality").withColumnRenamed("mean_quality", "overall")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id")
    return rows.groupBy("lang").agg(F.avg("quality").alias("mean_quality"), F.max("overall").alias("overall"))


# profiles


@register("SELECT p_partkey, unnest(list_filter(string_split(p_name, ' '), lambda x: x <> '' AND lower(x) <> 'na')) AS value FROM part")
def multi_value_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(profile.split_values(F.col("p_name"), [" "])).alias("value"))


@register(
    """
SELECT o_orderpriority, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(o_orderkey), o_orderpriority)::INTEGER AS rk FROM orders GROUP BY o_orderpriority
"""
)
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_counts(table(spark, sf_dir, "orders"), [], "o_orderpriority", "o_orderkey")


@register(
    """
WITH e AS (SELECT l_returnflag, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1),
c AS (SELECT l_returnflag, least(floor((l_quantity - lo) / (hi - lo) * 5) + 1, 5)::INTEGER AS bin, count(*) AS n FROM lineitem JOIN e USING (l_returnflag) GROUP BY ALL)
SELECT e.l_returnflag, b.bin::INTEGER AS bin, round(lo + (hi - lo) / 5 * (b.bin - 1), 6) AS low, round(lo + (hi - lo) / 5 * b.bin, 6) AS high, coalesce(n, 0)::BIGINT AS n
FROM e CROSS JOIN (SELECT unnest(range(1, 6)) AS bin) b LEFT JOIN c ON c.l_returnflag = e.l_returnflag AND c.bin = b.bin
"""
)
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.histogram(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")
    return found.withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


@register(
    """
WITH s AS (SELECT string_agg(v, '|' ORDER BY n DESC, v) AS vs, string_agg(n::VARCHAR, '|' ORDER BY n DESC, v) AS ns, sum(n) AS t FROM (SELECT c_mktsegment AS v, count(*) AS n FROM customer GROUP BY 1)),
h AS (SELECT min(c_nationkey) AS lo, max(c_nationkey) AS hi FROM customer),
b AS (SELECT string_agg(n::VARCHAR, '|' ORDER BY bin) AS ns, sum(n) AS t FROM (
  SELECT r.bin, count(c_nationkey) AS n FROM (SELECT unnest(range(1, 6)) AS bin) r CROSS JOIN h
  LEFT JOIN customer ON least(floor((c_nationkey - lo) / (hi - lo) * 5) + 1, 5) = r.bin GROUP BY r.bin))
SELECT 'c_mktsegment' AS column_name, 'string' AS type, 0::BIGINT AS n_numbers, t::BIGINT AS n_strings, vs AS "values", ns AS counts FROM s
UNION ALL SELECT 'c_nationkey', 'number', t::BIGINT, 0, NULL, ns FROM b
"""
)
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.column_profile(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"])
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), "|")
    return found.select("column_name", "type", "n_numbers", "n_strings", join("values").alias("values"), join("counts").alias("counts"))


# joins


@register(
    """
WITH a AS (SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id))
SELECT a.doc_id, a.lang, a.quality, b.toxic FROM a JOIN labels b ON a.doc_id = b.doc_id AND a.quality IS NOT DISTINCT FROM b.quality WHERE b.toxic IS NOT NULL
"""
)
def null_safe_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels.select("doc_id", "quality"), "doc_id", "left")
    found = joins.null_safe_match(rows, labels, ["doc_id", "quality"], ["toxic"])
    return found.select("doc_id", "lang", "quality", F.col("m_toxic").alias("toxic"))


@register(
    """
SELECT n.p_name AS name, arg_min(k.key, k.ord) AS match
FROM (SELECT DISTINCT p_name FROM part) n JOIN (SELECT p_brand || '.' || p_name AS key, p_name, p_partkey AS ord FROM part) k USING (p_name) GROUP BY 1
"""
)
def first_suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    keys = part.select(F.concat("p_brand", F.lit("."), "p_name").alias("key"), F.col("p_partkey").alias("ord"))
    return joins.first_suffix_match(part.select(F.col("p_name").alias("name")).distinct(), keys)


@register(
    """
SELECT r_name, n_name, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ALL
"""
)
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice", "l_discount")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    hops = [(orders, ["o_orderkey"]), (customers, ["c_custkey"]), (nations, ["n_nationkey"]), (table(spark, sf_dir, "region"), ["r_regionkey"])]
    rows = joins.lineage(lines, hops)
    return rows.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@register(
    """
WITH s(node, alternate) AS (VALUES ('sample', 'specimen'), ('sample', 'aliquot'), ('case', 'subject')),
c(domain, node) AS (SELECT n_name, CASE WHEN n_regionkey < 2 THEN 'specimen' WHEN n_regionkey < 4 THEN 'aliquot' ELSE 'subject' END FROM nation),
p AS (SELECT unnest(['sample', 'case']) AS node)
SELECT p.node, p.node || '_id' AS property, s.alternate, c.domain, replace(p.node || '_id', p.node, s.alternate) AS renamed
FROM p JOIN s USING (node) JOIN (SELECT DISTINCT * FROM c) c ON c.node = s.alternate
"""
)
def synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    synonym = spark.createDataFrame([("sample", "specimen"), ("sample", "aliquot"), ("case", "subject")], "node string, alternate string")
    region = F.col("n_regionkey")
    catalog = table(spark, sf_dir, "nation").select(F.col("n_name").alias("domain"), F.when(region < 2, "specimen").when(region < 4, "aliquot").otherwise("subject").alias("node"))
    properties = spark.createDataFrame([("sample", "sample_id"), ("case", "case_id")], "node string, property string")
    return joins.synonyms(properties, synonym, catalog).select("node", "property", "alternate", "domain", "renamed")


@register("SELECT doc_id, coalesce(quality, -1)::INTEGER AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def default_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.lookup(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", "quality", F.lit(-1)).select("doc_id", "quality")


@register(
    """
SELECT n_name || '.' || c_name AS key, n_name || '.' || c_name AS tail, 'N_' || n_name AS new_node, lower(c_name) AS new_property, c_mktsegment AS new_description, false AS missing
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""
)
def var_map_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    nodes = nation.select(F.col("n_name").alias("key"), F.concat(F.lit("N_"), "n_name").alias("new_name"), F.lit("a nation").alias("new_description"))
    customers = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    props = customers.select(F.concat("n_name", F.lit("."), "c_name").alias("key"), F.lower("c_name").alias("new_name"), F.col("c_mktsegment").alias("new_description"))
    return joins.renamed_keys(nodes.unionByName(props))


@register(
    """
SELECT o_orderkey, c_name AS source_model, n_name AS target_model FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON (o_custkey % 25) = n_nationkey
"""
)
def expand_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that name their models by key; a case with an unknown name has no row."""
    named = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    cases = table(spark, sf_dir, "orders").select("o_orderkey", named("c", "o_custkey").alias("source_name"), F.concat(F.lit("n"), (F.col("o_custkey") % 25).cast("string")).alias("target_name"))
    customers = table(spark, sf_dir, "customer").select(named("c", "c_custkey").alias("name"), F.col("c_name").alias("model"))
    nations = table(spark, sf_dir, "nation").select(named("n", "n_nationkey").alias("name"), F.col("n_name").alias("model"))
    return joins.expand_names(cases, customers.unionByName(nations)).select("o_orderkey", "source_model", "target_model")


# training sets


@register("SELECT sha256(lang) AS target_key, count(*) AS n FROM documents GROUP BY lang")
def sha_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "documents").select(training.content_key(F.col("lang")).alias("target_key"))
    return keyed.groupBy("target_key").agg(F.count(F.lit(1)).alias("n"))


@register(
    r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_ord FROM documents)
SELECT doc_id, line_ord::INTEGER AS line_ord, split_part(line, chr(9), 1) AS source, CASE WHEN instr(line, chr(9)) > 0 THEN split_part(line, chr(9), 2) END AS target,
       len(string_split(line, chr(9))) <> 2 AS error
FROM l WHERE line_ord > 0 AND trim(line, ' ' || chr(9) || chr(10) || chr(13)) <> ''
"""
)
def explode_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.mapping_pairs(table(spark, sf_dir, "documents"), "text", ["doc_id"])


@register(
    f"""
WITH l AS (SELECT p_partkey, {_LINE} AS s, 'T.' || p_name || ' (x): ' || p_brand AS t FROM part)
SELECT p_partkey AS test_id, {", ".join(f"trim(regexp_extract({c}, '{tx.LINE_RE2}', {i + 1})) AS {side}_{n}" for c, side in (("s", "source"), ("t", "target")) for i, n in enumerate(tx.LINE_FIELDS))} FROM l
"""
)
def expected_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping text for each part, read back with the quoting of CSV and parsed."""
    lines = _part_lines(spark, sf_dir)
    target = F.concat(F.lit("T."), "p_name", F.lit(" (x): "), "p_brand")
    text = F.concat(F.lit("source\ttarget\n"), writers.quoted(F.col("line")), F.lit("\t"), writers.quoted(target), F.lit("\n"))
    cases = lines.select(F.col("p_partkey").alias("test_id"), text.alias("harmonized_mapping"))
    return readers.expected_mappings(cases).drop("line_ord")


@register("SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, chr(10) ORDER BY o_orderpriority) AS mapping, count(DISTINCT o_orderpriority) AS n_lines FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) >= 2")
def distinct_lines_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.mapping_texts(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority").where("n_lines >= 2")


@register("SELECT p_partkey FROM part WHERE NOT (p_type LIKE '%UM' OR p_type LIKE '%O') AND p_brand NOT IN ('Brand#11', 'Brand#12')")
def training_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit("n").alias("source_node"), F.lit("x").alias("source_property"), F.col("p_brand").alias("target_node"), F.col("p_type").alias("target_property"))
    return training.keep_for_training(rows, endings=["UM", "O"], nodes=["Brand#11", "Brand#12"]).select("p_partkey")


@register(
    """
WITH d AS (SELECT DISTINCT p_brand, p_type FROM part)
SELECT a.p_brand, a.p_type, coalesce(string_agg(b.p_type, '|' ORDER BY b.p_type) FILTER (b.p_type <> a.p_type), '') AS negatives FROM d a JOIN d b USING (p_brand) GROUP BY ALL
"""
)
def negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    found = training.without_positive(rows, "p_brand", "p_type")
    return found.select("p_brand", "p_type", F.array_join("negatives", "|").alias("negatives"))


@register(
    """
WITH u AS (SELECT doc_id, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM documents)
SELECT doc_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'validation' ELSE 'test' END AS split FROM u
"""
)
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.hash_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", {"train": 0.8, "validation": 0.1, "test": 0.1})


@register(
    """
WITH t AS (SELECT count(*) AS n FROM documents), c AS (SELECT n, round(n * 40 / 100)::BIGINT AS a, round(n * 70 / 100)::BIGINT AS b FROM t)
SELECT 0 AS split, a AS n FROM c UNION ALL SELECT 1, b - a FROM c UNION ALL SELECT 2, n - b FROM c
"""
)
def exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("line"))
    return training.split_tallies(training.exact_split(rows, "line", [40, 30, 30], seed=1))


@register("SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL AND lang IS NOT NULL")
def drop_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.drop_nulls(table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left"))


# JSON and events


@register("SELECT event_id, event_type, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@register("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_counts(table(spark, sf_dir, "events"))


@register()
def suggest_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole flow from models to suggestions: every part's model against a target model of all part types."""
    types = table(spark, sf_dir, "part").select(F.col("p_type").alias("name")).distinct()
    prop = F.struct("name", F.col("name").alias("description"), F.lit("string").alias("type"))
    target = types.agg(F.array_sort(F.collect_list(prop)).alias("properties"))  # the distinct types are few
    node = F.struct(F.lit("target").alias("name"), F.lit("all types").alias("description"), "properties")
    target = target.select(F.lit(0).cast("bigint").alias("model_id"), F.to_json(F.struct(F.array(node).alias("nodes"))).alias("json"))
    found = approach.SimilarityApproach(k=3, threshold=0.0).suggest(models.parse_simple(_part_models(spark, sf_dir)), models.parse_simple(target))
    return found.withColumn("similarity", F.round("similarity", 6))


# the queries of the other modules are registered with these
from schemaloom.plans import catalogue_cases, catalogue_flow, catalogue_sources  # noqa: E402, F401

__all__ = ["ORACLE_SQL", "QUERIES"]
