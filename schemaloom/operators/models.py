"""Data models in four JSON dialects as two tables of nodes and properties.

A model is a row of (model_id, json). Objects are read as maps of raw JSON text, which keep the
order of keys; of a repeated key the last value counts, at the first one's place. A model that a
dialect's rules reject has no rows; ``valid`` tells which ones those are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemaloom.functions.expr import let
from schemaloom.functions.scratch import workspace, written
from schemaloom.functions.text import ends_with_any, python_list, render_line

# The entries of a dictionary that are no nodes.
SKIPPED_ENTRIES = ["_terms", "_settings", "_definitions", "metaschema", "root"]
FORMATS = ("simple", "dictionary", "prefixed", "linked")

_MAP, _LIST = "map<string,string>", "array<string>"


@dataclass(frozen=True)
class Models:
    """``nodes``: model_id, node_ord, node_name, node_description, links, node_metadata.
    ``properties``: model_id, node_ord, prop_ord, node_name, property_name, property_description,
    property_type, type_is_list, property_values, additional_metadata, npd.
    ``valid``: model_id, valid.
    """

    nodes: DataFrame
    properties: DataFrame
    valid: DataFrame


def _object(json: Column) -> Column:
    return let(json, lambda own: F.when(F.startswith(F.ltrim(own), F.lit("{")), F.from_json(own, _MAP)))


def _array(json: Column) -> Column:
    return let(json, lambda own: F.when(F.startswith(F.ltrim(own), F.lit("[")), F.from_json(own, _LIST)))


def _dealt(models: DataFrame) -> DataFrame:
    """Models over a number of tasks that is kept: a table that is small, and lies in one file, is much to parse."""
    spark = models.sparkSession
    return models.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "model_id")


def _bound(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that is computed once a row, however many expressions and conditions use it.

    Spark writes a plain column's expression out wherever a condition uses the column, so that JSON
    would be parsed as often; it does not do so with a generated one.
    """
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _entries(json: Column) -> Column:
    """The object's entries as (ord, key, value) in document order; the last of repeated keys has the value."""

    def of(pairs: Column) -> Column:
        as_they_are = F.transform(pairs, lambda x, i: F.struct(i.cast("int").alias("ord"), x["key"].alias("key"), x["value"].alias("value")))

        def told_apart(keys: Column) -> Column:
            last = F.filter(pairs, lambda x, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), x["key"]))
            by_last = F.transform(last, lambda x: F.struct((F.array_position(keys, x["key"]) - 1).cast("int").alias("ord"), x["key"].alias("key"), x["value"].alias("value")))
            return F.when(F.size(F.array_distinct(keys)) == F.size(keys), as_they_are).otherwise(by_last)  # only repeated keys are looked for one by one

        return let(F.transform(pairs, lambda x: x["key"]), told_apart)

    return let(F.map_entries(_object(json)), of)


def _last(m: Column, key: str) -> Column:
    """A map's value for a key, the last one where the key is repeated."""
    return F.try_element_at(F.transform(F.filter(F.map_entries(m), lambda x: x["key"] == key), lambda x: x["value"]), F.lit(-1))


def _has(m: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.map_keys(m), key), F.lit(False))


def _field(m: Column, key: str, default: str = "") -> Column:
    """The value, the default where the key is missing, null where the value is null."""
    return let(m, lambda own: F.when(_has(own, key), _last(own, key)).otherwise(F.lit(default)))


def _given(m: Column, key: str) -> Column:
    """The value, null where the key is missing."""
    return let(m, lambda own: _last(own, key))


def _name(m: Column) -> Column:
    """``name``, or its misspelt form ``name:`` only where ``name`` is missing."""
    return F.when(_has(m, "name"), _field(m, "name")).otherwise(_field(m, "name:"))


def _typed(raw: Column) -> tuple[Column, Column]:
    """The type as text (lists as Python prints them) and whether it is a list."""
    is_list = F.coalesce(F.startswith(raw, F.lit("[")), F.lit(False))
    return F.when(is_list, python_list(_array(raw))).otherwise(raw), is_list


def _exploded(nodes: DataFrame, entries: Column) -> DataFrame:
    """A row for each property entry, and one for a node without any."""
    return nodes.select("model_id", "node_ord", "node_name", "node_description", "links", "node_metadata", F.explode_outer(entries).alias("e"))


def _finish(models: DataFrame, rows: DataFrame, fits: Column, ignore: list[str]) -> Models:
    """Both tables of the valid models, without properties of the ignored endings.

    A model is valid if it has the dialect's shape and no node or property misses a required text.
    """
    required = F.col("property_name").isNull() | F.col("property_description").isNull() | F.col("property_type").isNull()
    broken = F.col("node_name").isNull() | F.col("node_description").isNull() | F.col("broken") | (F.col("prop_ord").isNotNull() & required)
    marked = rows.withColumn("__bad", F.coalesce(broken, F.lit(True)))
    bad = marked.where("__bad").select("model_id").distinct()
    model = Window.partitionBy("model_id").orderBy("node_ord", "prop_ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ok = marked.withColumn("__bad", F.max("__bad").over(model)).where(~F.col("__bad"))  # a model's rows lie in one task since it was dealt, so they tell of each other without being parsed again or moved
    nodes = ok.where(F.coalesce("prop_ord", F.lit(0)) == 0).select("model_id", "node_ord", "node_name", "node_description", "links", "node_metadata").dropDuplicates(["model_id", "node_ord"])
    properties = ok.where(F.col("prop_ord").isNotNull())
    if ignore:
        properties = properties.where(~ends_with_any(F.element_at(F.split("property_name", r"\."), -1), ignore))
    properties = properties.select(
        *"model_id node_ord prop_ord node_name property_name property_description property_type type_is_list property_values additional_metadata".split(),
        render_line(F.col("node_name"), F.col("property_name"), F.col("property_type"), F.col("property_description")).alias("npd"),
    )
    shaped = models.select("model_id", F.coalesce(fits, F.lit(False)).alias("fits"))
    told = bad.select(F.col("model_id").alias("__id"), F.lit(True).alias("bad"))
    valid = shaped.join(told, F.col("model_id").eqNullSafe(F.col("__id")), "left").select("model_id", (F.col("fits") & ~F.coalesce("bad", F.lit(False))).alias("valid"))
    return Models(nodes, properties, valid)


def _no_text() -> Column:
    return F.lit(None).cast("string")


def parse_simple(models: DataFrame, ignore_endings: list[str] | None = None) -> Models:
    """``{"nodes": [{"name", "description", "links", "properties": [...]}]}``."""
    models = _dealt(models)
    listed = _array(_last(_object(F.col("json")), "nodes"))
    each = _bound(models.select("model_id", F.posexplode(listed).alias("node_ord", "raw")), "m", _object(F.col("raw")))
    links = F.when(_has(F.col("m"), "links"), _array(_field(F.col("m"), "links"))).otherwise(F.array().cast(_LIST))
    nodes = each.select(
        "model_id",
        "node_ord",
        _name(F.col("m")).alias("node_name"),
        _field(F.col("m"), "description").alias("node_description"),
        links.alias("links"),
        _no_text().alias("node_metadata"),
        _array(_given(F.col("m"), "properties")).alias("list"),
    )
    rows = _bound(nodes.select("*", F.posexplode_outer("list").alias("prop_ord", "p")), "pm", _object(F.col("p")))
    rows = rows.withColumn("t", _field(F.col("pm"), "type"))
    type_, is_list = _typed(F.col("t"))
    rows = rows.select(
        *"model_id node_ord node_name node_description links node_metadata prop_ord".split(),
        (F.col("list").isNull() | F.col("links").isNull() | (F.col("p").isNotNull() & F.col("pm").isNull())).alias("broken"),
        _name(F.col("pm")).alias("property_name"),
        _field(F.col("pm"), "description").alias("property_description"),
        type_.alias("property_type"),
        is_list.alias("type_is_list"),
        _no_text().alias("property_values"),
        _no_text().alias("additional_metadata"),
    )
    return _finish(models, rows, listed.isNotNull(), ignore_endings or [])


def _entry_nodes(models: DataFrame, json: Column) -> DataFrame:
    each = models.select("model_id", F.explode(_entries(json)).alias("e"))
    named = each.select("model_id", F.col("e.ord").alias("node_ord"), F.col("e.key").alias("node_name"), F.col("e.value").alias("raw"))
    return _bound(named, "m", _object(F.col("raw")))


def _link_names(raw: Column) -> Column:
    """The names of a list of links that have one."""
    named = F.filter(F.transform(_array(raw), lambda x: _object(x)), lambda m: _has(m, "name"))
    return F.transform(named, lambda m: _field(m, "name"))


def singular(name: Column) -> Column:
    """One trailing ``s`` goes; a trailing ``ies`` that is left becomes ``y``."""
    return F.regexp_replace(F.regexp_replace(name, "s$", ""), "ies$", "y")


def parse_dictionary(models: DataFrame, ignore_endings: list[str] | None = None) -> Models:
    """A dictionary keyed by node, whose links to other nodes are expanded to their properties.

    A property with ``anyOf`` gives rows ``node.property`` of the linked items instead of itself. A
    blank type with ``enum`` is ``enum``, a blank description the term's, and a term's definition
    goes to the metadata. A node without description makes the model invalid.
    """
    ignore = ignore_endings or []
    models = _dealt(models)
    each = _entry_nodes(models, F.col("json")).where(~F.col("node_name").isin(SKIPPED_ENTRIES))
    links_raw = _given(F.col("m"), "links")
    direct = F.coalesce(_link_names(links_raw), F.array().cast(_LIST))
    grouped = _link_names(_given(_object(links_raw), "subgroup"))
    nodes = each.select(
        "model_id",
        "node_ord",
        "node_name",
        _given(F.col("m"), "description").alias("node_description"),
        F.when(F.size(direct) > 0, direct).otherwise(F.coalesce(grouped, direct)).alias("links"),
        _no_text().alias("node_metadata"),
        _entries(_field(F.col("m"), "properties", "{}")).alias("entries"),
    )
    raw = _exploded(nodes, F.col("entries"))
    if ignore:  # an ignored property takes what it links to along
        raw = raw.where(F.col("e").isNull() | ~ends_with_any(F.col("e.key"), ignore))
    raw = _bound(raw, "pm", _object(F.col("e.value")))
    linked = _has(F.col("pm"), "anyOf")
    kept = ["model_id", "node_ord", "node_name", "node_description", "links", "node_metadata"]
    plain = raw.where(~linked).select(*kept, F.col("e.ord").alias("at"), F.lit(0).alias("at2"), F.lit(0).alias("at3"), F.col("e.key").alias("property_name"), "pm", (F.col("e").isNotNull() & F.col("pm").isNull()).alias("broken"))
    options = raw.where(linked).select(*kept, "e", F.posexplode(_array(_field(F.col("pm"), "anyOf"))).alias("at2", "option"))
    inner = _object(_given(_object(F.col("option")), "items"))
    subs = options.select(*kept, "e", "at2", F.explode(_entries(_field(inner, "properties", "{}"))).alias("s"))
    expanded = subs.select(*kept, F.col("e.ord").alias("at"), "at2", F.col("s.ord").alias("at3"), F.concat(singular(F.col("e.key")), F.lit("."), F.col("s.key")).alias("property_name"), _object(F.col("s.value")).alias("pm"), F.lit(False).alias("broken"))
    bare = raw.where(linked).select(*kept, F.lit(None).cast("int").alias("at"), F.lit(0).alias("at2"), F.lit(0).alias("at3"), F.lit(None).cast("string").alias("property_name"), F.lit(None).cast(_MAP).alias("pm"), F.lit(False).alias("broken"))
    rows = plain.unionByName(expanded).unionByName(bare)
    rows = _bound(rows, "term", _object(_given(F.col("pm"), "term")))
    pm, term = F.col("pm"), F.col("term")
    rows = rows.withColumn("t", _field(pm, "type"))
    type_, is_list = _typed(F.col("t"))
    description = _field(pm, "description")
    order = F.struct("at", "at2", "at3")
    rows = rows.select(
        *kept,
        F.when(F.col("at").isNotNull(), order).alias("order"),
        "broken",
        "property_name",
        F.when((description == "") & _has(pm, "term"), F.coalesce(_field(term, "description"), F.lit(""))).otherwise(description).alias("property_description"),
        F.when((type_ == "") & _has(pm, "enum"), F.lit("enum")).otherwise(type_).alias("property_type"),
        is_list.alias("type_is_list"),
        _no_text().alias("property_values"),
        F.when(_has(term, "termDef"), F.concat(F.lit('{"cde_info":'), _field(term, "termDef"), F.lit("}"))).alias("additional_metadata"),
    )
    numbered = F.row_number().over(Window.partitionBy("model_id", "node_ord").orderBy(F.col("order").asc_nulls_last())) - 1
    rows = rows.withColumn("prop_ord", F.when(F.col("order").isNotNull(), numbered)).drop("order")
    return _finish(models, rows, _object(F.col("json")).isNotNull(), ignore)


def parse_prefixed(models: DataFrame) -> Models:
    """A dictionary keyed by node, where keys with a leading underscore are no nodes; enums stay values.

    A node whose links are an object with ``subgroup`` makes the model invalid, as it always has.
    """
    models = _dealt(models)
    each = _entry_nodes(models, F.col("json")).where(~F.startswith("node_name", F.lit("_")))
    links_raw = _given(F.col("m"), "links")
    nodes = each.select(
        "model_id",
        "node_ord",
        "node_name",
        _field(F.col("m"), "description").alias("node_description"),
        F.coalesce(_link_names(links_raw), F.array().cast(_LIST)).alias("links"),
        _no_text().alias("node_metadata"),
        _entries(_field(F.col("m"), "properties", "{}")).alias("entries"),
        (F.col("m").isNull() | _has(_object(links_raw), "subgroup")).alias("broken_node"),
    )
    rows = _bound(nodes.select("*", F.explode_outer("entries").alias("e")), "pm", _object(F.col("e.value")))
    rows = rows.withColumn("t", _field(F.col("pm"), "type"))
    type_, is_list = _typed(F.col("t"))
    rows = rows.select(
        *"model_id node_ord node_name node_description links node_metadata".split(),
        F.col("e.ord").alias("prop_ord"),
        (F.col("broken_node") | (F.col("e").isNotNull() & F.col("pm").isNull())).alias("broken"),
        F.col("e.key").alias("property_name"),
        _field(F.col("pm"), "description").alias("property_description"),
        type_.alias("property_type"),
        is_list.alias("type_is_list"),
        F.when(_has(F.col("pm"), "enum"), _field(F.col("pm"), "enum")).when(_has(F.col("pm"), "values"), _field(F.col("pm"), "values")).alias("property_values"),
        _no_text().alias("additional_metadata"),
    )
    return _finish(models, rows, _object(F.col("json")).isNotNull(), [])


def _without(m: Column, *keys: str) -> Column:
    return F.to_json(F.map_filter(m, lambda k, _: ~k.isin(*keys)))


def parse_linked(models: DataFrame, ignore_endings: list[str] | None = None) -> Models:
    """A schema with ``$defs``: keys beyond type and description are kept as metadata; links are empty.

    A node without description makes the model invalid.
    """
    models = _dealt(models)
    defs = _last(_object(F.col("json")), "$defs")
    each = _entry_nodes(models, defs)
    nodes = each.select(
        "model_id",
        "node_ord",
        "node_name",
        _given(F.col("m"), "description").alias("node_description"),
        F.array().cast(_LIST).alias("links"),
        _without(F.col("m"), "properties", "description").alias("node_metadata"),
        _entries(_field(F.col("m"), "properties", "{}")).alias("entries"),
    )
    rows = _bound(nodes.select("*", F.explode_outer("entries").alias("e")), "pm", _object(F.col("e.value")))
    rows = rows.withColumn("t", _field(F.col("pm"), "type"))
    type_, is_list = _typed(F.col("t"))
    rows = rows.select(
        *"model_id node_ord node_name node_description links node_metadata".split(),
        F.col("e.ord").alias("prop_ord"),
        (F.col("e").isNotNull() & F.col("pm").isNull()).alias("broken"),
        F.col("e.key").alias("property_name"),
        _field(F.col("pm"), "description").alias("property_description"),
        type_.alias("property_type"),
        is_list.alias("type_is_list"),
        _no_text().alias("property_values"),
        _without(F.col("pm"), "type", "description").alias("additional_metadata"),
    )
    return _finish(models, rows, _object(defs).isNotNull(), ignore_endings or [])


def _prefer(models: DataFrame, options: list[tuple[str, Callable[[DataFrame], Models]]]) -> Models:
    """For each model the first option that is valid for it. Which one that is is found once and written; then only that one parses the model."""
    ranks = {name: i for i, (name, _) in enumerate(options)}
    fits = [by(models).valid.where("valid").select("model_id", F.lit(ranks[name]).alias("__rank")) for name, by in options]
    first = reduce(DataFrame.unionByName, fits).groupBy("model_id").agg(F.min("__rank").alias("__rank"))
    first = written(first, workspace(models.sparkSession, "dialects"))
    chosen = [by(models.join(first.where(F.col("__rank") == ranks[name]), "model_id", "left_semi")) for name, by in options]
    nodes, properties = (reduce(DataFrame.unionByName, [getattr(c, part) for c in chosen]) for part in ("nodes", "properties"))
    names = F.coalesce(*[F.when(F.col("__rank") == i, F.lit(n)) for n, i in ranks.items()])
    valid = models.select("model_id").join(first, "model_id", "left").select("model_id", F.col("__rank").isNotNull().alias("valid"), names.alias("chosen"))
    return Models(nodes, properties, valid)


def parse_unknown(models: DataFrame, ignore_endings: list[str] | None = None, detect: str = "last") -> Models:
    """Find each model's dialect among simple, dictionary and prefixed.

    ``last`` takes the last one of these that accepts the model, as the known tools do, so that most
    dictionaries are read as prefixed ones; ``first`` takes the first. Models that none accepts are
    not valid. ``linked`` is never tried.
    """
    options = [("simple", partial(parse_simple, ignore_endings=ignore_endings)), ("dictionary", partial(parse_dictionary, ignore_endings=ignore_endings)), ("prefixed", parse_prefixed)]
    if detect not in ("last", "first"):
        raise ValueError("detect must be 'last' or 'first'")
    return _prefer(models, options[::-1] if detect == "last" else options)


def parse(models: DataFrame, format: str = "unknown", ignore_endings: list[str] | None = None) -> Models:
    """Parse by a named dialect, or find it."""
    if format == "prefixed":
        return parse_prefixed(models)
    found = {"simple": parse_simple, "dictionary": parse_dictionary, "linked": parse_linked, "unknown": parse_unknown}
    if format not in found:
        raise ValueError(f"format must be one of {sorted([*found, 'prefixed'])}")
    return found[format](models, ignore_endings)


def property_table(models: Models) -> DataFrame:
    """The display table of a model's properties."""
    return models.properties.select("model_id", "node_ord", "prop_ord", "node_name", "property_name", "property_description", "property_type", "additional_metadata")


def property_lines(models: Models) -> DataFrame:
    """All rendered lines with their order."""
    return models.properties.select("model_id", "node_ord", "prop_ord", "npd")


def documents(models: Models) -> DataFrame:
    """Lines as texts to embed, numbered through each model from 0."""
    order = Window.partitionBy("model_id").orderBy("node_ord", "prop_ord")
    return models.properties.select("model_id", (F.row_number().over(order) - 1).cast("bigint").alias("target_ord"), F.col("npd").alias("text"))


def shape(models: Models) -> DataFrame:
    """Each node with the list of its properties' names, in order."""
    each = models.properties.groupBy("model_id", "node_ord", "node_name").agg(F.array_sort(F.collect_list(F.struct("prop_ord", "property_name"))).alias("p"))
    return each.select("model_id", "node_ord", "node_name", F.transform("p", lambda x: x["property_name"]).alias("properties"))


def line_lookup(models: Models) -> DataFrame:
    """(model_id, key, line): the line of ``node.property``; of repeated keys the last one."""
    key = F.concat("node_name", F.lit("."), "property_name")
    return models.properties.groupBy("model_id", key.alias("key")).agg(F.max_by("npd", F.struct("node_ord", "prop_ord")).alias("line"))


def as_keyed(models: DataFrame) -> DataFrame:
    """A simple model with its properties keyed by name: model_id, node_name, properties (name to JSON), the last duplicate wins."""
    models = _dealt(models)
    listed = _array(_last(_object(F.col("json")), "nodes"))
    each = _bound(models.select("model_id", F.posexplode(listed).alias("node_ord", "raw")), "m", _object(F.col("raw")))
    props = each.select("model_id", "node_ord", _name(F.col("m")).alias("node_name"), F.posexplode(_array(_field(F.col("m"), "properties"))).alias("prop_ord", "p"))
    named = _bound(props, "pm", _object(F.col("p"))).select("model_id", "node_ord", "node_name", "prop_ord", _name(F.col("pm")).alias("name"), "p")
    last = named.groupBy("model_id", "node_ord", "node_name", "name").agg(F.max_by("p", "prop_ord").alias("p"), F.min("prop_ord").alias("at"))
    return last.groupBy("model_id", "node_ord", "node_name").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("at", "name", "p"))), lambda x: F.struct(x["name"], x["p"]))).alias("properties"))


def spread_properties(models: DataFrame, most: int = 1000) -> DataFrame:
    """Properties of simple models with a column for each key that any of them has: model_id, node_ord, prop_ord, node, and the keys.

    The distinct keys are the schema, so there may be at most ``most`` of them.
    """
    models = _dealt(models)
    listed = _array(_last(_object(F.col("json")), "nodes"))
    each = _bound(models.select("model_id", F.posexplode(listed).alias("node_ord", "raw")), "m", _object(F.col("raw")))
    props = _bound(each.select("model_id", "node_ord", _name(F.col("m")).alias("node"), F.posexplode(_array(_given(F.col("m"), "properties"))).alias("prop_ord", "p")), "pm", _object(F.col("p")))
    keys = sorted(r.k for r in props.select(F.explode(F.map_keys("pm")).alias("k")).distinct().limit(most + 1).collect())
    if len(keys) > most:
        raise ValueError(f"more than {most} keys")
    return props.select("model_id", "node_ord", "prop_ord", "node", *[_given(F.col("pm"), k).alias(k if k not in ("model_id", "node_ord", "prop_ord", "node") else f"property_{k}") for k in keys])
