"""Inventories that another tool made, as dicts of lists of dicts."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("files", "autoloads", "custom_classes")
FILES = (
    "path string, name string, extension string, is_directory boolean, file_type string, engine_type string, size_bytes long, "
    "modified_ns long"
)
AUTOLOADS = "autoload_name string, target_path string, target_project_relative_path string, is_singleton boolean"
CLASSES = "class_name string, script_path string, language string, base_type string"
#: The names of the dicts' fields, in the order of the columns above.
FIELDS = {
    "files": "project_relative_path file_name extension is_directory file_type godot_type size_bytes modified_time_ns".split(),
    "autoloads": "autoload_name target_path target_project_relative_path is_singleton".split(),
    "custom_classes": "class_name script_project_relative_path language direct_base_type".split(),
}
SCHEMAS = {"files": FILES, "autoloads": AUTOLOADS, "custom_classes": CLASSES}


def as_long(value: Any) -> int:
    """Whole numbers as they are, fractions cut, booleans 0 or 1, all else 0."""
    if isinstance(value, float):
        return int(value) if math.isfinite(value) else 0
    return int(value) if isinstance(value, (bool, int)) else 0


def as_boolean(value: Any) -> bool:
    return bool(value) if isinstance(value, (bool, int)) else False


def as_text(value: Any) -> str:
    return value if isinstance(value, str) else "" if value is None else str(value)


def tables(spark: SparkSession, inventory: dict[str, Any], seconds_of: str = "modified_time_unix") -> dict[str, DataFrame]:
    """The three tables of an inventory, with the place of each item in its list. Items that are no dicts are left out; an empty engine
    type is NGT; a file without nanoseconds takes its seconds. Raises ValueError if the dict has none of the three keys."""
    if not any(k in inventory for k in KEYS):
        raise ValueError("the inventory has none of: " + ", ".join(KEYS))
    out = {}
    for key in KEYS:
        rows, fields = [], [f.split() for f in SCHEMAS[key].split(", ")]
        for place, item in enumerate(inventory.get(key) or []):
            if not isinstance(item, dict):
                continue
            kinds = {"long": as_long, "boolean": as_boolean, "string": as_text}
            row = {name: kinds[kind](item.get(field)) for (name, kind), field in zip(fields, FIELDS[key])}
            if key == "files":
                row["engine_type"] = row["engine_type"] or "NGT"
                row["modified_ns"] = row["modified_ns"] or as_long(item.get(seconds_of)) * 1_000_000_000
            rows.append((*row.values(), place))
        out[key] = spark.createDataFrame(rows, f"{SCHEMAS[key]}, place long")
    return out


def last_of(rows: DataFrame, *keys: str) -> DataFrame:
    """Of the items with one key the last of the list, as each overwrites the one before."""
    others = [c for c in rows.columns if c not in (*keys, "place")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "place").alias("_row")).select(*keys, "_row.*")
