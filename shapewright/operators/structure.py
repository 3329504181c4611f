"""Families of files with the same columns, and how two sets of columns relate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def relation(own: Column, family: Column) -> Column:
    """exact, superset, subset, overlapping or disjoint, of own to family, as sets."""
    more, less = F.size(F.array_except(own, family)), F.size(F.array_except(family, own))
    return (
        F.when((more == 0) & (less == 0), "exact")
        .when(less == 0, "superset")
        .when(more == 0, "subset")
        .when(F.size(F.array_intersect(own, family)) > 0, "overlapping")
        .otherwise("disjoint")
    )


def described(own: Column, family: Column) -> Column:
    """What own lacks and has more, or whether only the order differs."""
    less, more = F.array_sort(F.array_except(family, own)), F.array_sort(F.array_except(own, family))
    said = F.concat_ws("; ", F.when(F.size(less) > 0, F.concat(F.lit("missing: ["), F.array_join(less, ", "), F.lit("]"))), F.when(F.size(more) > 0, F.concat(F.lit("extra: ["), F.array_join(more, ", "), F.lit("]"))))
    return F.when(said != "", said).when(own == family, "exact match").otherwise("same columns, different order")


def set_key(names: Column) -> Column:
    return F.array_sort(F.array_distinct(names))


def place_text(same: Column) -> Column:
    """Why a file is in its family; of columns (family_id, file_id, first_file_id, family_columns)."""
    return (
        F.when(F.col("family_id").isNull(), "No columns were found; the file is in no family.")
        .when(F.col("file_id") == F.col("first_file_id"), F.format_string("First of family %s (%d columns).", "family_id", "family_columns"))
        .when(same, F.format_string("Has the columns of family %s, in its order.", "family_id"))
        .otherwise(F.format_string("Has the columns of family %s, in another order.", "family_id"))
    )


def overlaps(found: DataFrame) -> DataFrame:
    """Pairs of families that share a column, with their likeness; families, not files, are paired, by their columns."""
    side = lambda n: found.select(F.col("family_id").alias(f"{n}_id"), F.col("key").alias(f"{n}_key"), F.col("representative_columns").alias(f"{n}_columns"), F.explode("key").alias("column"))
    pairs = side("a").join(side("b"), "column").where("a_id < b_id").drop("column").distinct()
    return pairs.select("a_id", "b_id", "a_columns", "b_columns", jaccard(F.col("a_key"), F.col("b_key")).alias("jaccard"), relation(F.col("a_key"), F.col("b_key")).alias("relation"))
