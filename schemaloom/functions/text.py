"""Column expressions over property lines and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line format, its expression, and the prefix of identifiers.
LINE = r"(?d)^(.*?)\.(.*?)\s*(?:\(((?:(?!\)).)*?)\):|:)(.*)$"
LINE_RE2 = r"^(.*?)\.(.*?)\s*(?:\(([^)\n]*?)\):|:)(.*)$"
CURIE_PREFIX = "EX"
LINE_FIELDS = ("node", "property", "type", "description")


def py_strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def one_line(description: Column) -> Column:
    """Tabs become four spaces and line feeds one."""
    return F.replace(F.replace(description, F.lit("\t"), F.lit("    ")), F.lit("\n"), F.lit(" "))


def render_line(node: Column, name: Column, type_: Column, description: Column) -> Column:
    """``node.property (type): description``; null where any part is null."""
    return F.concat(node, F.lit("."), name, F.lit(" ("), type_, F.lit("): "), one_line(description))


def render_untyped(node: Column, name: Column, description: Column) -> Column:
    """``node.property: description``; a missing description is empty."""
    return F.concat(node, F.lit("."), name, F.lit(": "), one_line(F.coalesce(description, F.lit(""))))


def parse_line(line: Column) -> Column:
    """A struct of node, property, type and description; four empty strings where the line has another form."""
    part = lambda i: py_strip(F.regexp_extract(F.coalesce(line, F.lit("")), LINE, i))
    return F.struct(*[part(i + 1).alias(name) for i, name in enumerate(LINE_FIELDS)])


def split_at_colon(line: Column) -> Column:
    """A struct of what stands before and after the first colon; all of it before where there is none."""
    at = F.instr(line, ":")
    before = F.when(at > 0, F.substring(line, F.lit(1), at - 1)).otherwise(line)
    after = F.when(at > 0, F.substring(line, at + 1, F.char_length(line))).otherwise(F.lit(""))
    return F.struct(py_strip(before).alias("name"), py_strip(after).alias("description"))


def curie(key: Column, prefix: str = CURIE_PREFIX) -> Column:
    """``prefix:node_property`` of ``node.property``: what is no word character is an underscore."""
    at = F.instr(key, ".")
    munge = lambda c: F.regexp_replace(F.regexp_replace(c, r"(?U)\W+", "_"), "^_+|_+$", "")
    node = munge(F.substring(key, F.lit(1), at - 1))
    name = munge(F.substring(key, at + 1, F.char_length(key)))
    return F.concat(F.lit(f"{prefix}:"), F.when(at > 0, F.concat(node, F.lit("_"), name)).otherwise(munge(key)))


def key_node(key: Column) -> Column:
    return F.substring_index(key, ".", 1)


def key_tail(key: Column) -> Column:
    """The last two parts of a dotted key."""
    return F.substring_index(key, ".", -2)


def key_dots(key: Column) -> Column:
    return F.size(F.split(key, r"\.")) - 1


def rename_in(name: Column, old: Column, new: Column) -> Column:
    """Every occurrence of ``old`` in a name replaced."""
    return F.replace(name, old, new)


def semicolons(text: Column) -> Column:
    return F.translate(text, ",", ";")


def python_list(items: Column) -> Column:
    """How Python prints a list of plain strings."""
    return F.when(F.size(items) == 0, F.lit("[]")).otherwise(F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']")))


def mapping_line(source: Column, target: Column, width: int = 50, longest: int = 80) -> Column:
    """``source -> target`` with the source padded to a width; pairs over ``longest`` characters stay unpadded."""
    plain = F.concat(source, F.lit(" -> "), target)
    padded = F.when(F.char_length(source) < width, F.rpad(source, width, " ")).otherwise(source)
    return F.when(F.char_length(plain) > longest, plain).otherwise(F.concat(padded, F.lit(" -> "), target))


def short_id(path: Column, length: int = 20) -> Column:
    """The first characters of a file's name."""
    return F.substring(F.element_at(F.split(path, "/"), -1), 1, length)


def display_name(key: Column, names: dict[str, str]) -> Column:
    """The name that a key is shown by, or the key."""
    if not names:
        return key
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), key)


def study_id(path: Column) -> Column:
    return F.regexp_extract(path, r"(phs.*?)\.json", 1)


def document_text(ordinal: Column, text: Column, score: Column | None = None) -> Column:
    """A found document as a printable line."""
    if score is None:
        return F.format_string("%d. %s", ordinal, text)
    return F.format_string("%d. [%.3f] %s", ordinal, score, text)


def ends_with_any(name: Column, endings: list[str]) -> Column:
    """Whether the stripped name ends with any of the endings; no word boundary is asked for."""
    stripped = py_strip(name)
    found = F.lit(False)
    for ending in endings:
        found = found | F.endswith(stripped, F.lit(ending))
    return found


def shorter_than(line: Column, max_length: int) -> Column:
    """Strictly fewer characters than ``max_length`` once stripped."""
    if max_length <= 0:
        raise ValueError("max_length must be positive")
    return F.char_length(py_strip(line)) < max_length


def is_comment(line: Column) -> Column:
    return F.regexp_like(line, F.lit(r"^\s*#"))


def typed_number(text: Column) -> Column:
    """The number that a cell holds as text, or null: decimal digits with sign, point and exponent only."""
    own = py_strip(text)
    return F.when(F.regexp_like(own, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), own.try_cast("double"))
