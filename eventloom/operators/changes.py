"""What a refresh changed: added, removed and changed records between two feeds, as multisets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F


def feed_difference(old: DataFrame, new: DataFrame, key: list[str], fields: list[str] | None = None) -> DataFrame:
    """(*key, change, fields, n): what became of records, equal outcomes of a key counted in n.

    Records alike in key and fields cancel each other out in one map-side
    combined aggregation, copy by copy. What is left of a key is paired in the
    order of its digests: a pair is 'changed', with the names of the fields that
    differ; without a partner a record is 'added' or 'removed'. Nulls are
    values; a null key is a key. An absent or empty feed adds or removes all.
    """
    fields = [c for c in old.columns if c not in key and c in new.columns] if fields is None else fields
    side = lambda df, sign: df.select(*key, *fields, F.lit(sign).alias("_side"))
    rows = side(old, -1).unionByName(side(new, 1))
    rows = rows.withColumn("_digest", F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256))
    own = [F.first(c).alias(c) for c in fields]
    left = rows.groupBy(*key, "_digest").agg(F.sum("_side").alias("_n"), *own).filter("_n <> 0")
    copies = left.withColumn("_i", F.explode(F.expr("sequence(1, abs(_n))"))).withColumn("_is_new", F.col("_n") > 0)
    order = Window.partitionBy(*key, "_is_new").orderBy("_digest", "_i")
    placed = copies.withColumn("_place", F.row_number().over(order))
    pick = lambda is_new: F.first(F.when(F.col("_is_new") == is_new, F.struct(*fields)), ignorenulls=True)
    both = placed.groupBy(*key, "_place").agg(pick(False).alias("_old"), pick(True).alias("_new"))
    differ = [F.when(~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")), F.lit(c)) for c in sorted(fields)]
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    names = F.when(change == "changed", F.array_join(F.array_compact(F.array(*differ)), ",")).otherwise(F.lit(""))
    return both.select(*key, change.alias("change"), names.alias("fields")).groupBy(*key, "change", "fields").agg(F.count("*").alias("n"))


def change_counts(differences: DataFrame) -> DataFrame:
    """Records per kind of change."""
    return differences.groupBy("change").agg(F.sum("n").alias("n"))


def apply_changes(old: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The new feed from the old one: each removed row takes away one that is equal to it."""
    return reduce(DataFrame.unionByName, [old.exceptAll(removed), added])
