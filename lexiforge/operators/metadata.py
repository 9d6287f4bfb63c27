"""Metadata of terms: sources, parents and variations, merged and summed up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def consolidate(rows: DataFrame) -> DataFrame:
    """Per term the distinct sources and parents, sorted and joined by a bar; ``rows`` has term, source and parent."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.nullif(c, F.lit("")))), "|")
    return rows.groupBy("term").agg(listed(F.col("source")).alias("sources"), listed(F.col("parent")).alias("parents"))


def merge_variations(rows: DataFrame, variations: DataFrame) -> DataFrame:
    """Rows of variations go to their canonical term; ``variations`` has variation and canonical."""
    moved = rows.join(variations, rows["term"] == variations["variation"], "left")
    return moved.select(F.coalesce("canonical", "term").alias("term"), "source", "parent")


def promote(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """Per term whether any of its parents is a known one; ``parents`` has parent."""
    known = parents.select("parent").distinct().withColumn("known", F.lit(1))
    return rows.join(known, "parent", "left").groupBy("term").agg((F.max(F.coalesce("known", F.lit(0))) == 1).alias("promoted"))


def summary(rows: DataFrame) -> DataFrame:
    """One row: terms, terms with parents, mean distinct sources and parents."""
    sizes = rows.groupBy("term").agg(F.countDistinct("source").alias("s"), F.countDistinct("parent").alias("p"))
    return sizes.agg(
        F.count("*").alias("n_terms"), F.count_if(F.col("p") > 0).alias("with_parents"), F.avg("s").alias("mean_sources"), F.avg("p").alias("mean_parents")
    )


def fill_definitions(metadata: DataFrame, fresh: DataFrame, overwrite: bool = False) -> DataFrame:
    """term and definition: blanks are filled and new terms inserted, or with ``overwrite`` known terms replaced."""
    old, new = metadata.select("term", F.nullif(F.trim("definition"), F.lit("")).alias("old")), fresh.select("term", F.col("definition").alias("new"))
    if overwrite:
        return old.join(new, "term", "left").select("term", F.coalesce("new", "old").alias("definition"))
    return old.join(new, "term", "full").select("term", F.coalesce("old", "new").alias("definition"))
