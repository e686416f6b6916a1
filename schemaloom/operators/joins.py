"""Joins between property keys, mappings and their context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.functions.text import key_node, key_tail, rename_in


def null_safe_match(source: DataFrame, other: DataFrame, keys: list[str], required: list[str], prefix: str = "m_") -> DataFrame:
    """Inner join where missing equals missing; rows of ``other`` without a required column take no part."""
    right = other
    for c in required:
        right = right.where(F.col(c).isNotNull())
    right = right.select([F.col(c).alias(f"{prefix}{c}") for c in right.columns])
    condition: Column = F.lit(True)
    for k in keys:
        condition = condition & source[k].eqNullSafe(right[f"{prefix}{k}"])
    return source.join(right, condition, "inner").drop(*[f"{prefix}{k}" for k in keys])


def _last(table: DataFrame, keys: dict[str, str], value: str, ordinal: str | None, out: str) -> DataFrame:
    """One value for each key: that of the last row by ``ordinal`` (a null one is a value too), or the largest; equal ordinals: the largest."""
    order = F.struct(F.col(ordinal), F.col(value)) if ordinal else F.struct(F.col(value))
    each = table.groupBy(*[F.col(c).alias(k) for k, c in keys.items()]).agg(F.max(order).alias("__x"))
    return each.select(*keys, F.col("__x")[value].alias(out))


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str, default: Column | None = None, out: str | None = None, ordinal: str | None = None) -> DataFrame:
    """The table's value for each row's key, or the default (the key itself).

    Of a repeated key the last row by ``ordinal`` counts, or, without one, the largest value.
    """
    found = _last(table.where(F.col(key).isNotNull()), {"__k": key}, value, ordinal, "__v")
    joined = rows.join(found, rows[key] == found["__k"], "left")
    return joined.withColumn(out or value, F.coalesce("__v", rows[key] if default is None else default)).drop("__k", "__v")


def first_suffix_match(names: DataFrame, keys: DataFrame, name: str = "name", key: str = "key", ordinal: str = "ord") -> DataFrame:
    """For each name the first key, by ordinal, that ends with ``.name``; the name itself where none does.

    A key's suffixes are exploded, so that the join is on equality: a few rows for each dot of a key.
    """
    parts = F.split(key, r"\.")
    suffix = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    tails = keys.where(F.size(parts) > 1).select(F.col(key).alias("__key"), F.col(ordinal).alias("__ord"), F.explode(suffix).alias("__tail"))
    first = tails.groupBy("__tail").agg(F.min_by("__key", "__ord").alias("__first"))
    return names.join(first, names[name] == first["__tail"], "left").withColumn("match", F.coalesce("__first", names[name])).drop("__tail", "__first")


def description_match(rows: DataFrame, table: DataFrame, description: str, name: str, line: str, ordinal: str) -> DataFrame:
    """A line by its description, else by its name; of repeated ones the last."""
    by_text = table.where(F.col(description).isNotNull()).groupBy(F.col(description).alias("__d")).agg(F.max_by(line, ordinal).alias("__by_text"))
    by_name = table.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("__n")).agg(F.max_by(line, ordinal).alias("__by_name"))
    joined = rows.join(by_text, rows[description] == by_text["__d"], "left").join(by_name, rows[name] == by_name["__n"], "left")
    return joined.withColumn(line, F.coalesce("__by_text", "__by_name")).drop("__d", "__n", "__by_text", "__by_name")


def lineage(rows: DataFrame, hops: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Equi-joins one after another: each hop is a table and the key columns that it shares."""
    for table, keys in hops:
        rows = rows.join(table, keys)
    return rows


def with_fallback(rows: DataFrame, parents: DataFrame, catalog: DataFrame, node: str, name: str, value: str, ordinal: str | None = None) -> DataFrame:
    """A property's value in its own node, else in the first parent node that has it.

    ``parents`` holds (node, parent, parent_ord); ``catalog`` (node, name, value). Of a property that
    a node has repeatedly the last row by ``ordinal`` counts, or, without one, the largest value.
    """
    own = _last(catalog, {"__n": node, "__p": name}, value, ordinal, "__own")
    of_parent = parents.join(own.select(F.col("__n").alias("parent"), F.col("__p").alias("__pp"), F.col("__own").alias("__v")), "parent")
    best = of_parent.groupBy(F.col(node).alias("__pn"), "__pp").agg(F.min_by("__v", "parent_ord").alias("__inherited"))
    first = rows.join(own, (rows[node] == own["__n"]) & (rows[name] == own["__p"]), "left")
    both = first.join(best, (first[node] == best["__pn"]) & (first[name] == best["__pp"]), "left")
    return both.withColumn(value, F.coalesce("__own", "__inherited")).drop("__n", "__p", "__own", "__pn", "__pp", "__inherited")


def synonyms(properties: DataFrame, synonym: DataFrame, catalog: DataFrame) -> DataFrame:
    """A node's properties in every domain that has one of its alternates, the name rewritten.

    ``properties``: node, property; ``synonym``: node, alternate; ``catalog``: domain, node.
    """
    where = catalog.select("domain", F.col("node").alias("alternate")).distinct()
    found = properties.join(synonym, "node").join(where, "alternate")
    return found.withColumn("renamed", rename_in(F.col("property"), F.col("node"), F.col("alternate")))


def domains_of_nodes(catalog: DataFrame) -> DataFrame:
    return catalog.select("node", "domain").distinct()


def renamed_keys(var_map: DataFrame) -> DataFrame:
    """Rows of ``node.property`` keys with their node's new name; keys of nodes that have none are in ``missing``.

    ``var_map``: key, new_name, new_description.
    """
    nodes = var_map.where(F.instr("key", ".") == 0).select(F.col("key").alias("__node"), F.col("new_name").alias("new_node"))
    rows = var_map.where(F.instr("key", ".") > 0).withColumn("__node", key_node(F.col("key"))).withColumn("tail", key_tail(F.col("key")))
    joined = rows.join(nodes, "__node", "left")
    return joined.select("key", "tail", "new_node", F.col("new_name").alias("new_property"), "new_description", F.col("new_node").isNull().alias("missing"))


def expand_names(cases: DataFrame, models: DataFrame) -> DataFrame:
    """Cases with the models that their source and target names stand for; cases with an unknown name go.

    ``models``: name, model. Models are large, so a small side is broadcast only if Spark finds it to be so.
    """
    s = models.select(F.col("name").alias("source_name"), F.col("model").alias("source_model"))
    t = models.select(F.col("name").alias("target_name"), F.col("model").alias("target_model"))
    return cases.join(s, "source_name").join(t, "target_name")


def unknown_keys(mapping: DataFrame, source: DataFrame, target: DataFrame, skip_blank: bool = False) -> DataFrame:
    """Mapping keys that their model does not have, with the side: (test_id, side, key).

    ``mapping``: test_id, source_key, target_key; ``source`` and ``target``: test_id, key.
    """

    def missing(side: str, model: DataFrame) -> DataFrame:
        own = mapping.select("test_id", F.lit(side).alias("side"), F.col(f"{side}_key").alias("key"))
        if skip_blank:
            own = own.where((F.col("key") != "") & F.col("key").isNotNull())
        return own.join(model.select("test_id", "key"), ["test_id", "key"], "left_anti").select("test_id", "side", "key")

    return missing("source", source).unionByName(missing("target", target))


def finished_anti(keys: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """The keys that are still to do."""
    return keys.join(finished.select(key).distinct(), key, "left_anti")
