"""Filtered, sorted and paged lists of files, classes and symbols, and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbordex.functions.text import contains_like, fold

PAGE = 500


def filter_files(df: DataFrame, *, include_deleted: bool = False, parent_id: int | None = None, is_directory: bool | None = None, extension: str = "", file_type: str = "", engine_type: str = "", search: str = "") -> DataFrame:
    """Rows that meet every filter given; empty text, None and the like mean no filter."""
    if not include_deleted:
        df = df.where(~F.col("is_deleted"))
    if parent_id is not None:
        df = df.where(F.col("parent_id") == max(parent_id, 0))
    if is_directory is not None:
        df = df.where(F.col("is_directory") == is_directory)
    for column, value in (("extension", extension), ("file_type", file_type), ("engine_type", engine_type)):
        if value:
            df = df.where(F.col(column) == value)
    return df.where(contains_like(F.col("path"), search) | contains_like(F.col("name"), search)) if search else df


def filter_classes(df: DataFrame, *, language: str = "", base_type: str = "", search: str = "") -> DataFrame:
    if language:
        df = df.where(F.col("language") == language)
    if base_type:
        df = df.where(F.col("base_type") == base_type)
    return df.where(contains_like(F.col("class_name"), search) | contains_like(F.col("script_path"), search)) if search else df


def filter_symbols(df: DataFrame, *, file_id: int | None = None, kind: str = "", search: str = "", over: tuple[str, ...] = ("name",)) -> DataFrame:
    if file_id is not None:
        df = df.where(F.col("file_id") == file_id)
    if kind:
        df = df.where(F.col("kind") == kind)
    if search:
        hit = F.lit(False)
        for column in over:
            hit = hit | contains_like(F.col(column), search)
        df = df.where(hit)
    return df


def file_order(key: str) -> list[Column]:
    """The order of a file list; unknown keys order by path."""
    return {
        "name": [fold(F.col("name")), F.col("id")],
        "modified_time": [F.col("modified_ns").desc(), F.col("id")],
        "file_type": [F.col("file_type"), F.col("path")],
    }.get(key, [fold(F.col("path")), F.col("id")])


def class_order(key: str) -> list[Column]:
    return {
        "script_path": [fold(F.col("script_path")), F.col("class_name")],
        "base_type": [fold(F.col("base_type")), F.col("class_name")],
    }.get(key, [fold(F.col("class_name")), F.col("id")])


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = PAGE) -> DataFrame:
    """One page of an order: at most 500 rows, from a place that is not negative."""
    return df.orderBy(*order).offset(max(offset, 0)).limit(min(max(limit, 0), PAGE))


def ordered(df: DataFrame, *columns: str) -> DataFrame:
    return df.orderBy(*columns)


def counted(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def next_generation(df: DataFrame, column: str = "generation") -> DataFrame:
    return df.agg((F.coalesce(F.max(column), F.lit(0)) + 1).cast("long").alias("next_generation"))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that is last in an order that no two rows of a key share."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("row")).select("row.*")


def file_rows(df: DataFrame) -> DataFrame:
    """What a file list shows."""
    return df.select(
        "id",
        F.concat(F.lit("res://"), "path").alias("path"),
        "name",
        F.when(F.col("is_directory"), "folder").otherwise("file").alias("type"),
        "extension",
        "file_type",
        "engine_type",
        "size_bytes",
        F.expr("modified_ns div 1000000000").alias("modified_time_unix"),
        "is_directory",
        "is_deleted",
        "parent_id",
    )
