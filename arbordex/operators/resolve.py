"""Binding of names, paths and places to files and symbols.

Best matches are minima of structs: they combine before the shuffle, and a name or file with many candidates never has to be
paired with all its references.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACE = ("line", "column", "slot", "id")


def parents(files: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """files with the id of the file at parent_path, of all files or of `among`, that is not deleted; 0 at the top or where there is
    none."""
    up = (files if among is None else among).where(~F.col("is_deleted")).select(F.col("path").alias("parent_path"), F.col("id").alias("_up"))
    return files.drop("parent_id").join(up, "parent_path", "left").select(*[c for c in files.columns if c != "parent_id"], F.coalesce("_up", F.lit(0)).cast("long").alias("parent_id"))


def symbol_parents(symbols: DataFrame) -> DataFrame:
    """symbols with the id of the symbol of their file that has the slot `parent_slot`."""
    up = symbols.select("file_id", F.col("slot").alias("parent_slot"), F.col("id").alias("parent_id"))
    return symbols.join(up, ["file_id", "parent_slot"], "left")


def _best(df: DataFrame, keys: list[str], order: tuple[str, ...], out: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(F.struct(*order)).alias(out))


def source_symbol(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs with source_symbol_id: of the file's symbols the one with the slot asked for, else its first class; without a slot its
    first class, else its first symbol. First is by line, column, slot, id."""
    exact = _best(symbols, ["file_id", "slot"], PLACE, "exact")
    classes = _best(symbols.where(F.col("kind") == "class"), ["file_id"], PLACE, "class_best")
    first = _best(symbols, ["file_id"], PLACE, "first_best")
    joined = refs.join(exact, (refs["file_id"] == exact["file_id"]) & (refs["slot"] == exact["slot"]), "left").select(*[refs[c] for c in refs.columns], "exact")
    joined = joined.join(classes, "file_id", "left").join(first, "file_id", "left")
    found = F.coalesce(F.col("exact.id"), F.col("class_best.id"), F.when(F.col("slot").isNull(), F.col("first_best.id")))
    return joined.select(*refs.columns, found.alias("source_symbol_id"))


def target_by_path(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs with target_id: the file at target_path that is not deleted."""
    alive = files.where(~F.col("is_deleted")).select(F.col("path").alias("target_path"), F.col("id").alias("target_id"))
    return refs.join(alive, "target_path", "left")


def _asked(named: DataFrame, refs: DataFrame | None, name: str) -> DataFrame:
    """The rows whose name is one of `refs`: few references then need few of the names, and no exchange of all."""
    return named if refs is None else named.join(refs.select(name).where(F.col(name) != "").distinct(), name, "left_semi")


def class_names(symbols: DataFrame, columns: list[str], refs: DataFrame | None = None) -> DataFrame:
    """(name, best): for each name (of `refs`) that a class has in any of the columns, its first class by file, line, column, slot, id."""
    named = symbols.where(F.col("kind") == "class").withColumn("target_class", F.explode(F.array_distinct(F.array(*columns)))).where("target_class <> ''")
    named = _asked(named, refs, "target_class")
    return _best(named, ["target_class"], ("file_id", *PLACE), "best")


def target_by_class(refs: DataFrame, symbols: DataFrame, columns: list[str], few: bool = False) -> DataFrame:
    """refs with target_id filled in, where it is null, by the class of the name target_class. Three names make one equi-join. `few`
    references look for their own names alone."""
    joined = refs.join(class_names(symbols, columns, refs if few else None), "target_class", "left")
    return joined.select(*[c for c in refs.columns if c != "target_id"], F.coalesce("target_id", "best.file_id").alias("target_id"))


def target_by_declaration(refs: DataFrame, classes: DataFrame) -> DataFrame:
    """The last resort: the declared class's file."""
    declared = classes.select(F.col("class_name").alias("target_class"), F.col("file_id").alias("_declared"))
    joined = refs.join(declared, "target_class", "left")
    return joined.select(*[c for c in refs.columns if c != "target_id"], F.coalesce("target_id", "_declared").alias("target_id"))


def target_symbol(refs: DataFrame, symbols: DataFrame, columns: list[str], few: bool = False) -> DataFrame:
    """refs with target_symbol_id: the first symbol of the name in the target file, or anywhere if there is no target file."""
    named = symbols.withColumn("target_name", F.explode(F.array_distinct(F.array(*columns)))).where("target_name <> ''")
    named = _asked(named, refs if few else None, "target_name")
    anywhere = _best(named, ["target_name"], ("file_id", *PLACE), "anywhere")
    there = _best(named.withColumnRenamed("file_id", "target_id"), ["target_name", "target_id"], PLACE, "there")
    joined = refs.join(there, ["target_name", "target_id"], "left").join(anywhere, "target_name", "left")
    return joined.select(*refs.columns, F.when(F.col("target_id").isNull(), F.col("anywhere.id")).otherwise(F.col("there.id")).alias("target_symbol_id"))


def resolution(refs: DataFrame) -> DataFrame:
    """refs with is_resolved and is_unresolved; dynamic ones are neither unless something was found."""
    found = F.col("target_id").isNotNull()
    if "target_symbol_id" in refs.columns:
        found = found | F.col("target_symbol_id").isNotNull()
    return refs.withColumn("is_resolved", found).withColumn("is_unresolved", ~found & ~F.col("is_dynamic"))


def enclosing_symbol(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs with enclosing_id: the last symbol of their file at or above their line, parameters aside; else the file's first class.

    One window over the union of both sides; on one line symbols come first, later ones win.
    """
    marks = symbols.where(F.col("kind") != "parameter").select("file_id", "line", F.lit(0).alias("_side"), F.col("slot").alias("_slot"), F.col("id").alias("_symbol"), F.lit(None).cast("struct<{}>".format(", ".join(f"`{n}`: {t}" for n, t in refs.dtypes))).alias("_ref"))
    asked = refs.select("file_id", "line", F.lit(1).alias("_side"), F.lit(None).cast(dict(symbols.dtypes)["slot"]).alias("_slot"), F.lit(None).cast("long").alias("_symbol"), F.struct(*refs.columns).alias("_ref"))
    place = Window.partitionBy("file_id").orderBy("line", "_side", "_slot", "_symbol").rowsBetween(Window.unboundedPreceding, 0)
    bound = marks.unionByName(asked).withColumn("_found", F.last("_symbol", ignorenulls=True).over(place)).where("_side = 1").select("_ref.*", "_found")
    first = _best(symbols.where(F.col("kind") == "class"), ["file_id"], PLACE, "_class")
    return bound.join(first, "file_id", "left").select(*refs.columns, F.coalesce("_found", "_class.id").alias("enclosing_id"))


def parameters(symbols: DataFrame, function: Column | int) -> DataFrame:
    """The parameters of a function: symbols of its file whose parent is the function, or that have none but its slot."""
    f = symbols.where((F.col("id") == function) & (F.col("kind") == "function")).select("file_id", F.col("id").alias("_f"), F.col("slot").alias("_slot"))
    own = F.coalesce(F.col("parent_id") == F.col("_f"), F.lit(False)) | (F.col("parent_id").isNull() & (F.col("parent_slot") == F.col("_slot")))
    return symbols.where(F.col("kind") == "parameter").join(F.broadcast(f.limit(1)), "file_id").where(own).select(*symbols.columns)


def fill_attachments(attachments: DataFrame, resources: DataFrame) -> DataFrame:
    """attachments whose path is empty get path and uid of the scene's resource of the same id; unknown ids leave them empty."""
    known = resources.groupBy("scene_id", "resource_id").agg(F.max_by(F.struct("path", "uid"), "slot").alias("_r"))
    joined = attachments.join(known, ["scene_id", "resource_id"], "left")
    columns = {c: F.col(c) for c in attachments.columns}
    empty = F.col("script_path") == ""
    columns["script_path"] = F.when(empty, F.coalesce("_r.path", F.lit(""))).otherwise(F.col("script_path"))
    columns["script_uid"] = F.when(empty, F.coalesce("_r.uid", F.lit(""))).otherwise(F.col("script_uid"))
    return joined.select(*[columns[c].alias(c) for c in attachments.columns])


def class_symbol(attachments: DataFrame, symbols: DataFrame) -> DataFrame:
    """attachments with script_symbol_id: the first class of their script."""
    first = _best(symbols.where(F.col("kind") == "class").withColumnRenamed("file_id", "script_id"), ["script_id"], PLACE, "_class")
    return attachments.join(first, "script_id", "left").select(*attachments.columns, F.col("_class.id").alias("script_symbol_id"))


def doc_gaps(symbols: DataFrame, docs: DataFrame) -> DataFrame:
    """Symbols that no attached doc comment describes."""
    return symbols.join(docs.where("is_attached").select(F.col("symbol_id").alias("id")), "id", "left_anti")
