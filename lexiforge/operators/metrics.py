"""Metrics: operations, predictions against gold sets, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_operation(events: DataFrame) -> DataFrame:
    """Per operation: events, sum, least, greatest and mean value."""
    return events.groupBy(F.col("event_type").alias("operation")).agg(
        F.count("*").alias("n"),
        F.sum("value").alias("total"),
        F.min("value").alias("least"),
        F.max("value").alias("most"),
        F.avg("value").alias("mean"),
    )


def recent(events: DataFrame, n: int = 100) -> DataFrame:
    """The last ``n`` events."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def f1(gold: Column, found: Column) -> Column:
    """F1 of two arrays as sets; 1 for two empty ones, 0 if only the gold one is empty."""
    both = F.size(F.array_intersect(gold, found))
    total = F.size(F.array_distinct(gold)) + F.size(F.array_distinct(found))
    return F.when(total == 0, 1.0).otherwise(2.0 * both / total)


def train_validation(rows: DataFrame, key: str, ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """Column part: train or validation, by a hash of the key; the same for every run."""
    place = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(10_000))
    return rows.withColumn("part", F.when(place < int(ratio * 10_000), "train").otherwise("validation"))
