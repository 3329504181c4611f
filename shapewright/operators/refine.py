"""Types inside families: variants of files' types, and columns on which files disagree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapewright.functions.codes import finding
from shapewright.operators.structure import set_key


def type_key(names: Column, types: Column) -> Column:
    """Known types by name as one string; null if none is known."""
    known = F.filter(F.arrays_zip(names.alias("n"), types.alias("t")), lambda x: x["t"].isNotNull())
    return F.when(F.size(known) > 0, F.array_join(F.sort_array(F.transform(known, lambda x: F.concat_ws(":", x["n"], x["t"]))), "|"))


def kinds(files: DataFrame) -> DataFrame:
    """One row for each family and type profile (key, type_key): first, file_count, names, types. Everything about families follows from it."""
    keyed = files.where(F.size("norm_names") > 0).select("file_id", "norm_names", "type_classes", set_key(F.col("norm_names")).alias("key"), type_key(F.col("norm_names"), F.col("type_classes")).alias("type_key"))
    first = F.min_by(F.struct("norm_names", "type_classes"), "file_id").alias("f")
    return keyed.groupBy("key", "type_key").agg(F.min("file_id").alias("first"), F.count("*").alias("file_count"), first).select("key", "type_key", "first", "file_count", F.col("f.norm_names").alias("names"), F.col("f.type_classes").alias("types"))


def families_of(found: DataFrame) -> DataFrame:
    """(family_id, key, first_file_id, file_count, representative_columns, column_count, type_variants) from kinds."""
    grouped = found.groupBy("key").agg(F.min("first").alias("first_file_id"), F.sum("file_count").alias("file_count"), F.min_by("names", "first").alias("representative_columns"), F.greatest(F.lit(1), F.count("type_key")).alias("type_variants"))
    number = F.row_number().over(Window.orderBy("first_file_id"))
    return grouped.withColumn("family_id", F.format_string("F%04d", number)).withColumn("column_count", F.size("representative_columns"))


def variants_of(found: DataFrame, families: DataFrame) -> DataFrame:
    """(key, type_key, family_id, variant_id): type profiles numbered by family, then first file."""
    number = F.row_number().over(Window.orderBy("family_id", "first"))
    typed = found.where("type_key IS NOT NULL").join(families.select("key", "family_id"), "key")
    return typed.select("key", "type_key", "family_id", F.format_string("V%04d", number).alias("variant_id"))


def disagreements(found: DataFrame, families: DataFrame) -> DataFrame:
    """(family_id, name, majority, classes, total): columns that files of a family type unlike; the first seen of two as common leads."""
    each = found.select("key", "first", "file_count", F.explode(F.arrays_zip(F.col("names").alias("n"), F.col("types").alias("t"))).alias("c")).select("key", F.col("c.n").alias("name"), F.col("c.t").alias("cls"), "first", "file_count").where("cls IS NOT NULL")
    counted = each.groupBy("key", "name", "cls").agg(F.sum("file_count").alias("n"), F.min("first").alias("first"))
    one = counted.groupBy("key", "name").agg(F.max_by("cls", F.struct("n", -F.col("first"))).alias("majority"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "first", "cls", "n"))).alias("classes"), F.sum("n").alias("total"))
    return one.where(F.size("classes") > 1).join(families.select("key", "family_id"), "key").drop("key")


def disagreement_findings(found: DataFrame, families: DataFrame) -> DataFrame:
    told = F.array_join(F.transform("classes", lambda x: F.format_string("`%s` in %d file(s)", x["cls"], x["n"])), ", ")
    why = F.format_string("Files of family %s disagree on the type of column '%s': %s. Most say %s.", F.col("family_id"), F.col("name"), told, F.col("majority"))
    one = finding("TYPE_MISMATCH", "WARN", F.format_string("column '%s' (family %s)", "name", "family_id"), F.col("majority"), told, why, F.col("total"))
    return disagreements(found, families).orderBy("family_id", "name").select(one.alias("f")).select("f.*")
