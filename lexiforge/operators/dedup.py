"""Duplicate terms by their forms: number, spelling, dashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.functions import text as T

#: Singular and plural endings.
PLURALS = (("y", "ies"), ("", "s"))


def basic(terms: DataFrame) -> DataFrame:
    """canonical and variation: the plural of two number forms, the American of two spellings.

    Forms are generated for each term and met by an equi-join.
    """
    rows = terms.select(F.lower("term").alias("term")).distinct()
    low = F.col("term")
    ends = [F.when(low.endswith(a), F.concat(F.left(low, F.length(low) - len(a)), F.lit(b))) for a, b in PLURALS]
    number = rows.select(F.col("term").alias("variation"), F.explode(F.array_distinct(F.array_compact(F.array(*ends)))).alias("term"))
    spell = [F.when(F.contains(low, F.lit(uk)), F.replace(low, F.lit(uk), F.lit(us))) for uk, us in T.SPELLINGS]
    spelling = rows.select(F.col("term").alias("variation"), F.explode(F.array_compact(F.array(*spell))).alias("term"))
    found = number.unionByName(spelling).join(rows, "term").where("term != variation")
    return found.select(F.col("term").alias("canonical"), "variation").distinct()


def without_variations(terms: DataFrame) -> DataFrame:
    """Distinct terms that are no variation of another."""
    gone = basic(terms).select(F.col("variation").alias("low"))
    return terms.select("term").distinct().withColumn("low", F.lower("term")).join(gone, "low", "left_anti").select("term")


def against_levels(terms: DataFrame, higher: DataFrame) -> DataFrame:
    """Terms whose lower-case form is no form of a term of a higher level."""
    forms = higher.select(F.explode(T.variations(F.col("term"))).alias("form")).select(F.lower("form").alias("low")).distinct()
    return terms.withColumn("low", F.lower("term")).join(forms, "low", "left_anti").drop("low")
