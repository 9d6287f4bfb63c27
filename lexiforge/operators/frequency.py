"""Frequency filters over (source, concept) rows.

Every filter counts the distinct sources of a normalised concept, keeps the concepts at
or above a threshold that follows from the number of sources, and returns a row for
each input occurrence that survives.  Counting is partial before the shuffle; the kept
concepts are joined back by their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lexiforge.functions import text as T


def parse_pairs(lines: DataFrame, column: str = "line") -> DataFrame:
    """(pos, source, concept) from ``source - concept`` lines, split at the last dash; else source generic."""
    line = F.trim(column)
    parted = line.rlike("^.* - .*$")
    pairs = lines.where(line != "").select(
        "pos",
        F.when(parted, F.trim(F.regexp_extract(line, "^(.*) - (.*)$", 1))).otherwise("generic").alias("source"),
        F.when(parted, F.trim(F.regexp_extract(line, "^(.*) - (.*)$", 2))).otherwise(line).alias("concept"),
    )
    return pairs.where(T.valid_concept(F.col("concept")))


def percent(threshold: float) -> float:
    """Shares above 1 are percentages."""
    return threshold / 100 if threshold > 1 else threshold


def counted(pairs: DataFrame, by: str = "source") -> DataFrame:
    """norm and frequency: distinct sources of each normalised concept."""
    return pairs.select(F.lower(F.trim("concept")).alias("norm"), by).distinct().groupBy("norm").agg(F.count("*").alias("frequency"))


def _limit(pairs: DataFrame, least: Column, by: str = "source") -> DataFrame:
    return pairs.agg(F.countDistinct(by).alias("n_sources")).select(least.alias("least"))


def share_limit(pairs: DataFrame, share: float, by: str = "source") -> DataFrame:
    """One row: ``share`` of the sources, rounded up, 1 at least."""
    return _limit(pairs, F.greatest(F.lit(1), F.ceil(F.col("n_sources").cast("double") * F.lit(share))), by)


def venue_limit(pairs: DataFrame) -> DataFrame:
    """One row: a tenth of the sources, rounded down, 2 at least."""
    return _limit(pairs, F.greatest(F.lit(2), F.floor(F.col("n_sources").cast("double") * F.lit(0.1))))


def kept(pairs: DataFrame, limit: DataFrame, by: str = "source", min_frequency: int | None = None) -> DataFrame:
    """norm and frequency of the concepts that reach the limit, a single value."""
    least = limit.first()["least"]  # one number
    out = counted(pairs, by).where(F.col("frequency") >= least)
    if min_frequency is not None:
        out = out.join(counted(pairs).where(F.col("frequency") >= min_frequency).select("norm"), "norm", "left_semi")
    return out


def institutional(pairs: DataFrame, share: float = 0.6) -> DataFrame:
    """Occurrences of kept concepts, in the first spelling met: by first place of the source, then of the row."""
    first = pairs.groupBy("source").agg(F.min("pos").alias("at"))
    spelled = pairs.join(first, "source").groupBy(F.lower(F.trim("concept")).alias("norm")).agg(F.min_by("concept", F.struct("at", "pos")).alias("spelling"))
    chosen = kept(pairs, share_limit(pairs, percent(share))).join(spelled, "norm")
    rows = pairs.withColumn("norm", F.lower(F.trim("concept")))
    return rows.join(chosen, "norm").select("pos", "source", F.col("spelling").alias("concept"), "frequency")


def level0(pairs: DataFrame, share: float = 60) -> DataFrame:
    """Institutions, the part of the source before its first dash, are counted; rows keep their spelling."""
    rows = pairs.withColumn("institution", F.trim(F.substring_index("source", " - ", 1))).withColumn("norm", F.lower(F.trim("concept")))
    chosen = kept(rows, share_limit(rows, percent(share), "institution"), "institution")
    return rows.join(chosen, "norm").select("pos", "institution", "concept", "frequency")


def venue(pairs: DataFrame) -> DataFrame:
    """Occurrences of concepts in a tenth of the venues, 2 at least."""
    rows = pairs.withColumn("norm", F.lower(F.trim("concept")))
    return rows.join(kept(pairs, venue_limit(pairs)), "norm").select("pos", "source", "concept", "frequency")


def histogram(pairs: DataFrame) -> DataFrame:
    """How many concepts have each frequency."""
    return counted(pairs).groupBy("frequency").agg(F.count("*").alias("concepts"))


def audit(pairs: DataFrame, least: int) -> DataFrame:
    """Per concept its frequency, the first five sources in order, their number and whether it is included."""
    distinct = pairs.select(F.lower(F.trim("concept")).alias("norm"), "source").distinct()
    ranked = distinct.withColumn("nth", F.row_number().over(Window.partitionBy("norm").orderBy("source")))
    grouped = ranked.groupBy("norm").agg(
        F.count("*").alias("frequency"), F.array_sort(F.collect_list(F.when(F.col("nth") <= 5, F.col("source")))).alias("first")
    )
    return grouped.select("norm", "frequency", F.array_join("first", "; ").alias("sources"), (F.col("frequency") >= least).alias("included"))


def agreement(responses: DataFrame, threshold: int) -> DataFrame:
    """(source, norm, votes) of concepts that at least ``threshold`` of a source's responses have.

    ``responses`` has source, attempt, concept; a source with one response passes whole.
    """
    n = responses.groupBy("source").agg(F.countDistinct("attempt").alias("attempts"))
    votes = responses.groupBy("source", F.lower(F.trim("concept")).alias("norm")).agg(F.count("*").alias("votes"))
    return votes.join(n, "source").where((F.col("attempts") == 1) | (F.col("votes") >= threshold)).select("source", "norm", "votes")


def top_groups(rows: DataFrame, group: str, item: str, n: int) -> DataFrame:
    """The ``n`` groups with most distinct items; ties by name."""
    sizes = rows.groupBy(group).agg(F.countDistinct(item).alias("items"))
    return sizes.orderBy(F.desc("items"), group).limit(n)
