"""Path and text expressions, all of them built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def fold(text: Column) -> Column:
    """A-Z to a-z and nothing else, whatever the collation: the order and equality of case-blind ASCII."""
    return F.translate(text, UPPER, LOWER)


def contains_like(text: Column, search: str) -> Column:
    """Case-blind (ASCII) LIKE '%search%'. `%` and `_` in the search are wildcards; nothing escapes them."""
    pattern = search.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\")
    return fold(text).like(f"%{pattern}%")


def normalize_path(path: Column) -> Column:
    """Slashes forward, a leading `res://`, `./` and `/` gone, and `.`, `..` and empty segments resolved; `..` stops at the root."""
    start = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^res://", ""), r"^(\./)+", ""), "^/+", "")
    none = F.array().cast("array<string>")

    def step(have: Column, part: Column) -> Column:
        return F.when(part.isin("", "."), have).when(part == "..", F.slice(have, 1, F.greatest(F.size(have) - 1, F.lit(0)))).otherwise(F.concat(have, F.array(part)))

    return F.array_join(F.aggregate(F.split(start, "/"), none, step), "/")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_path(path: Column) -> Column:
    """Up to the last slash; null at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, "^(.*)/[^/]*$", 1))


def extension_of(path: Column) -> Column:
    """The folded extension with its dot; none for names that begin or end with their only dot."""
    return F.regexp_extract(fold(file_name(path)), r"^.+(\.[^.]+)$", 1)


def ancestors(path: Column) -> Column:
    """A path's own ancestors from the top, and the path itself."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "/"))


def under_any(path: Column, prefixes: list[str]) -> Column:
    """Whether a path is one of the prefixes or below one: a path's few ancestors are looked up in the set of prefixes."""
    some = sorted(set(prefixes))
    return F.arrays_overlap(ancestors(path), F.array(*map(F.lit, some))) if some else F.lit(False)


def confidence_milli(value: Column) -> Column:
    """A confidence as thousandths: clamped to 0..1, cut, not rounded."""
    return (F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) * 1000).cast("int")


def remap_flags(flags: Column, bits: dict[int, int]) -> Column:
    """Each set bit of `bits`' keys sets the bit that it maps to."""
    out = F.lit(0).cast("long")
    for have, give in bits.items():
        out = out.bitwiseOR(F.when(flags.bitwiseAND(F.lit(1 << have)) != 0, F.lit(1 << give)).otherwise(F.lit(0)).cast("long"))
    return out


#: Bits of a script's flags and the bits of its root symbol that they set.
SCRIPT_TO_SYMBOL = {
    1: 3,  # tool script
    2: 14,  # extends a node
    3: 15,  # extends a resource
    9: 10,  # has a doc comment
    6: 11,  # ready callback
    7: 12,  # process callback
    8: 13,  # physics process callback
    10: 7,  # parsed incompletely
    11: 8,  # loads dynamically
    12: 9,  # has unresolved references
}
