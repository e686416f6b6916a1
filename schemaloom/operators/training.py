"""Training sets: lineage, filters, triplets and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemaloom.functions.expr import let
from schemaloom.functions.text import ends_with_any, py_strip, render_line, render_untyped, semicolons

# Fixed values of the training files.
SKIPPED_NODES = ["program", "project"]
SKIPPED_ENDINGS = [".id"]
HEADER_MARK = "harmonized_model_node_prop_desc"

#: Rows with negatives that one task makes of a model's lines; a large model's are dealt to as many as that takes.
TRIPLET_ROWS = 512


def original_properties(synthetic: DataFrame, nodes: DataFrame, dictionary: DataFrame, synonym: DataFrame, parents: DataFrame) -> DataFrame:
    """Where each property of a made-up model comes from: model, node, property, domain, original_node, original_property.

    ``synthetic``: model, node, property; ``nodes``: model, node, original_model; ``dictionary``:
    domain, node, property; ``synonym``: node, alternate; ``parents``: model, node, parent. A
    property is found in its node of the original model, under an alternate of the node in any
    domain, or, failing both, in a parent node. Each origin counts once and blank ones never.
    """
    own = synthetic.where(F.col("property") != "").join(nodes, ["model", "node"])
    d = dictionary.select("domain", F.col("node").alias("original_node"), F.col("property").alias("original_property"))
    key = ["model", "node", "property"]
    direct = own.join(d, (own["original_model"] == d["domain"]) & (own["node"] == d["original_node"]) & (own["property"] == d["original_property"]))
    direct = direct.select(*key, "domain", "original_node", "original_property")
    renamed = own.join(synonym, "node").withColumn("__p", F.replace(F.col("property"), F.col("node"), F.col("alternate")))
    other = renamed.join(d, (renamed["alternate"] == d["original_node"]) & (renamed["__p"] == d["original_property"])).select(*key, "domain", "original_node", "original_property")
    found = direct.unionByName(other)
    missing = own.join(found, key, "left_anti").join(parents, ["model", "node"])
    inherited = missing.join(d, (missing["original_model"] == d["domain"]) & (missing["parent"] == d["original_node"]) & (missing["property"] == d["original_property"]))
    return found.unionByName(inherited.select(*key, "domain", "original_node", "original_property")).distinct()


def lineage_lists(origins: DataFrame) -> DataFrame:
    """Each property with the list of its origins."""
    each = F.struct("domain", "original_node", "original_property")
    return origins.groupBy("model", "node", "property").agg(F.array_sort(F.collect_list(each)).alias("origins"))


def keep_for_training(
    rows: DataFrame,
    source_node: str = "source_node",
    source: str = "source_property",
    target_node: str = "target_node",
    target: str = "target_property",
    endings: list[str] = SKIPPED_ENDINGS,
    nodes: list[str] = SKIPPED_NODES,
    skip: DataFrame | None = None,
) -> DataFrame:
    """Rows with both properties, none of an ignored ending, and target nodes that count.

    ``skip`` holds (target_model, node) pairs to leave out as well.
    """
    kept = rows.where(F.col(target).isNotNull() & (py_strip(F.col(target)) != "") & F.col(source).isNotNull() & (py_strip(F.col(source)) != ""))
    kept = kept.where(~ends_with_any(F.concat(F.lit("."), source), endings) & ~ends_with_any(F.concat(F.lit("."), target), endings))
    kept = kept.where(~F.coalesce(F.col(target_node).isin(nodes), F.lit(False)))
    if skip is not None:
        own = skip.select("target_model", F.col("node").alias(target_node))
        kept = kept.join(own, ["target_model", target_node], "left_anti")
    return kept


def not_header(lines: DataFrame, line: str, header: str) -> DataFrame:
    """Lines without repeated headers."""
    return lines.where((F.col(line) != header) & ~F.contains(line, F.lit(HEADER_MARK)))


def at_least(rows: DataFrame, keys: list[str], n: int = 2) -> DataFrame:
    """Rows of keys that have ``n`` rows or more."""
    enough = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= n).drop("__n")
    return rows.join(enough, keys, "left_semi")


def complete_groups(rows: DataFrame, group: str, target: str, filled: Column) -> DataFrame:
    """Rows of the groups all of whose targets have a filled row."""
    each = rows.groupBy(group, target).agg(F.bool_or(F.coalesce(filled, F.lit(False))).alias("__any"))
    whole = each.groupBy(group).agg(F.bool_and("__any").alias("__all")).where("__all")
    return rows.join(whole, group, "left_semi")


def restrict(rows: DataFrame, column: str, chosen: list) -> DataFrame:
    return rows.where(F.col(column).isin(chosen))


def drop_nulls(rows: DataFrame) -> DataFrame:
    return rows.na.drop("any")


def exact_keys(rows: DataFrame, key: str, exactly_one_dot: bool = True) -> DataFrame:
    dots = F.size(F.split(key, r"\.")) - 1
    return rows.where(dots == 1 if exactly_one_dot else dots >= 1)


def mapping_texts(rows: DataFrame, key: str, line: str) -> DataFrame:
    """The distinct lines of each key, in order, as one text."""
    each = rows.where(F.col(line).isNotNull()).select(key, line).distinct()
    return each.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("mapping"), F.count(F.lit(1)).alias("n_lines"))


def mapping_pairs(cases: DataFrame, mapping: str, keep: list[str], skip_blank: bool = True) -> DataFrame:
    """One row for each pair of a mapping held as tab-separated text; the first line is a header.

    ``error`` marks lines that don't have exactly two fields.
    """
    lines = cases.select(*keep, F.posexplode(F.split(mapping, "\n", -1)).alias("line_ord", "line")).where("line_ord > 0")
    if skip_blank:
        lines = lines.where(py_strip(F.col("line")) != "")
    parts = F.split("line", "\t", -1)
    return lines.select(*keep, "line_ord", F.get(parts, F.lit(0)).alias("source"), F.get(parts, F.lit(1)).alias("target"), (F.size(parts) != 2).alias("error"))


def triplets(pairs: DataFrame, target_lines: DataFrame) -> DataFrame:
    """anchor, positive and negatives (a JSON list): every line of the target model but the positive's property.

    ``pairs``: test_id, anchor, node, property, positive; ``target_lines``: test_id, node_ord,
    prop_ord, node, property, line. The positive is told by its key, so that the form of its line
    does not matter; a null in a key may be anything. The lines of a model are put into JSON once
    and each row cuts its positive out of that text, so a row costs no more than its own bytes;
    these grow with the square of a model's lines all the same.
    """
    spark, keys = pairs.sparkSession, ["test_id", "node", "property"]
    order = ["node_ord", "prop_ord", "node", "property", "line"]
    json = F.to_json(F.array(semicolons(F.col("line"))))
    piece = F.concat(F.substring(json, F.lit(2), F.char_length(json) - 2), F.lit(","))
    by = Window.partitionBy("test_id").orderBy(*order)
    placed = target_lines.select("test_id", "node", "property", piece.alias("piece"), F.row_number().over(by).alias("at"), F.sum(F.octet_length(piece)).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    own = F.array_sort(F.collect_list(F.struct("at", "piece")))
    texts = placed.groupBy("test_id").agg(F.array_join(F.transform(own, lambda x: x["piece"]), "").cast("binary").alias("text"))

    # where each key's lines lie in its model's text: by equal keys, and those with nulls one by one
    spot = placed.select(*keys, (F.col("upto") - F.octet_length("piece")).alias("start"), "upto")
    asked = pairs.select(*keys).distinct()
    odd = F.col("node").isNull() | F.col("property").isNull()
    k, x = (d.select("test_id", *[F.col(c).alias(f"{n}_{c}") for c in d.columns if c != "test_id"]) for n, d in (("k", asked), ("x", spot)))
    same = F.coalesce((F.col("k_node") == F.col("x_node")) & (F.col("k_property") == F.col("x_property")), F.lit(True))
    k_odd, x_odd = F.col("k_node").isNull() | F.col("k_property").isNull(), F.col("x_node").isNull() | F.col("x_property").isNull()
    anything = k.where(k_odd).join(x, "test_id").unionByName(k.where(~k_odd).join(x.where(x_odd), "test_id")).where(same)
    cuts = spot.where(~odd).join(asked, keys).select(*keys, "start", "upto")
    cuts = cuts.unionByName(anything.select("test_id", F.col("k_node").alias("node"), F.col("k_property").alias("property"), F.col("x_start").alias("start"), F.col("x_upto").alias("upto")))
    cuts = cuts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "upto"))).alias("cuts"))

    found = pairs.join(cuts.select("test_id", F.col("node").alias("__n"), F.col("property").alias("__p"), "cuts"), (pairs["test_id"] == cuts["test_id"]) & pairs["node"].eqNullSafe(F.col("__n")) & pairs["property"].eqNullSafe(F.col("__p")), "left").select(pairs["test_id"], "anchor", "positive", "cuts")
    # rows are small and their negatives large: dealt to a number of tasks that is kept, a part of a model's rows at a time;
    # a model's text goes to no more parts than its share of all bytes is worth in tasks, so that what is sent does not grow with the rows
    n = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    work = pairs.groupBy("test_id").agg(F.count(F.lit(1)).alias("rows")).join(placed.groupBy("test_id").agg(F.max("upto").alias("bytes")), "test_id")
    work = work.select("test_id", "rows", (F.col("rows").cast("double") * F.col("bytes")).alias("work"))
    share = F.ceil(F.col("work") * n / F.col("all"))
    parts = work.join(F.broadcast(work.agg(F.sum("work").alias("all"))), how="cross").select("test_id", F.greatest(F.lit(1), F.least(F.ceil(F.col("rows") / TRIPLET_ROWS), share)).alias("parts"))
    dealt = found.join(parts, "test_id", "left").withColumn("salt", F.pmod(F.xxhash64("anchor", "positive"), F.coalesce("parts", F.lit(1)))).drop("parts")
    salted = texts.join(parts, "test_id").select("test_id", "text", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("salt"))
    part = F.concat(F.col("salt").cast("string"), F.lit(":"), F.col("test_id").cast("string"))  # one key, so that a model that is a literal is dealt too
    joined = dealt.withColumn("part", part).repartition(n, "part").join(salted.select(part.alias("part"), "text").hint("shuffle_merge"), "part", "left")
    return joined.select("test_id", semicolons(F.col("anchor")).alias("anchor"), semicolons(F.col("positive")).alias("positive"), _without(F.col("text"), F.col("cuts")).alias("negatives"))


def _without(text: Column, cuts: Column) -> Column:
    """A JSON list of the pieces, each with its comma, that lie between the cuts."""
    cut, size = lambda at, name: F.coalesce(F.get(cuts, F.lit(at))[name], F.lit(0).cast("bigint")), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
    piece = lambda a, b: F.substring(text, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    # up to one cut, as nearly all rows have: two slices, the last comma left out of the one that ends with it
    start, upto = cut(0, "start"), cut(0, "upto")
    slices = [piece(F.lit(0).cast("bigint"), F.when(upto < size, start).otherwise(start - 1)), piece(upto, size - 1)]
    few = F.concat(F.lit(b"["), *[F.coalesce(x, F.lit(b"")) for x in slices], F.lit(b"]")).cast("string")

    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(cuts, lambda x: x["upto"]))
    ends = F.concat(F.transform(cuts, lambda x: x["start"]), F.array(size))
    kept = F.zip_with(starts, ends, lambda a, b: piece(a, b).cast("string"))
    many = let(F.array_join(kept, ""), lambda s: F.concat(F.lit("["), F.substring(s.cast("binary"), F.lit(1), F.greatest(F.octet_length(s) - 1, F.lit(0))).cast("string"), F.lit("]")))
    return F.when(F.size(cuts) > 1, many).otherwise(few)


def without_positive(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Each row with the sorted other values of its group."""
    listed = rows.groupBy(group).agg(F.array_sort(F.collect_set(value)).alias("__all"))
    return rows.join(listed, group).withColumn("negatives", F.filter("__all", lambda x: x != F.col(value))).drop("__all")


def unit_hash(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from a key, the same on every run and partitioning."""
    text = key.cast("string") if not seed else F.concat(key.cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hash_split(rows: DataFrame, key: str, fractions: dict[str, float], seed: int = 0) -> DataFrame:
    """Each row's split by its key's hash: a row stays in its split whatever else the table holds."""
    if abs(sum(fractions.values()) - 1) > 1e-9:
        raise ValueError("fractions must add up to 1")
    u, upto, split = unit_hash(F.col(key), seed), 0.0, None
    names = list(fractions)
    for name in names[:-1]:
        upto += fractions[name]
        split = F.when(u < upto, name) if split is None else split.when(u < upto, name)
    return rows.withColumn("split", F.lit(names[-1]) if split is None else split.otherwise(names[-1]))


def exact_split(rows: DataFrame, line: str, percents: list[int], seed: int = 0) -> DataFrame:
    """Shuffle by a seeded hash and cut at exact percentages; every row is in one split (numbered from 0).

    The order is numbered in key ranges and their counts, so that no task sees all rows.
    """
    if sum(percents) != 100:
        raise ValueError("percentages must add up to 100")
    hashed = rows.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(line).cast("string"), F.lit(""))))).withColumn("__b", F.substring("__h", 1, 3))
    counts = hashed.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))  # 4096 rows at most
    before = counts.select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("__total"))
    rank = F.row_number().over(Window.partitionBy("__b").orderBy("__h", line)) - 1
    placed = hashed.withColumn("__r", rank).join(F.broadcast(before), "__b").withColumn("__at", F.col("__before") + F.col("__r"))
    split, upto = F.lit(len(percents) - 1), 0
    cuts = []
    for p in percents[:-1]:
        upto += p
        cuts.append(upto)
    for i in reversed(range(len(cuts))):
        split = F.when(F.col("__at") < F.round(F.col("__total") * cuts[i] / 100), F.lit(i)).otherwise(split)
    return placed.withColumn("split", split).drop("__h", "__b", "__n", "__before", "__total", "__r", "__at")


def split_tallies(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def first_rows(rows: DataFrame, n: int, order: list) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def content_key(model: Column) -> Column:
    """The hash that groups cases of one target model."""
    return F.sha2(model, 256)


def training_lines(rows: DataFrame) -> DataFrame:
    """source and target lines of mapped properties: the source untyped, the target with its type."""
    return rows.select(
        "*",
        render_untyped(F.col("source_node"), F.col("source_property"), F.col("source_description")).alias("source_line"),
        render_line(F.col("target_node"), F.col("target_property"), F.col("target_type"), F.col("target_description")).alias("target_line"),
    )
