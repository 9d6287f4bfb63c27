"""Validation of terms: rules, web coverage, combination of modes, summaries and the cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions import text as T


def rule_checks(term: Column, low: int = 2, high: int = 100, blacklist: tuple[str, ...] = T.BLACKLIST) -> dict[str, Column]:
    """The six checks of a term."""
    bare = T.clean(term)
    words = T.words(bare)
    n = F.size(words)
    distinct = F.size(F.array_distinct(words))
    structure = F.when(n == 1, F.length(bare) >= 3).otherwise(
        (n <= 10) & ((n == distinct) | (distinct / n >= 0.6)) & (F.size(F.filter(words, lambda w: F.length(w) <= 1)) <= n / 2)
    )
    return {
        "min_length": F.length(bare) >= low,
        "max_length": F.length(bare) <= high,
        "letters": bare.rlike("[a-zA-Z]"),
        "not_blacklisted": ~bare.isin(*blacklist),
        "pattern": ~bare.rlike(r"^(\d+|[^\p{L}\p{N}_\s\p{Z}]+|\s*|-+)$"),
        "structure": F.coalesce(structure, F.lit(True)),
    }


def rules(terms: DataFrame) -> DataFrame:
    """term, passed checks and is_valid (length, letters, blacklist and pattern decide); a row for each distinct term."""
    checks = rule_checks(F.col("term"))
    passed = sum((c.cast("int") for c in checks.values()), F.lit(0))
    decide = checks["min_length"] & checks["letters"] & checks["not_blacklisted"] & checks["pattern"]
    return terms.select("term").distinct().select("term", passed.alias("passed_checks"), decide.alias("is_valid"))


def web(terms: DataFrame, resources: DataFrame, least_score: float = 0.5, least_relevance: float = 0.5, good: float = 0.7) -> DataFrame:
    """Counts of verified, relevant and good resources of each term, and the confidence from them.

    ``resources`` has term, score and relevance.
    """
    verified, relevant = F.col("score") >= least_score, F.col("relevance") >= least_relevance
    sums = resources.groupBy("term").agg(
        F.count("*").alias("total"),
        F.count_if(verified).alias("verified"),
        F.count_if(verified & relevant).alias("relevant"),
        F.count_if(verified & relevant & (F.col("score") >= good)).alias("high_quality"),
    )
    share = 0.3 * F.col("verified") / F.col("total") + 0.4 * F.col("relevant") / F.greatest(F.lit(1), "verified") + 0.3 * F.col("high_quality") / F.col("total")
    bonus = F.when(F.col("high_quality") >= 3, 0.1).otherwise(0.0)
    found = sums.withColumn("confidence", F.least(F.lit(1.0), share + bonus)).withColumn("is_valid", F.col("relevant") >= 1)
    out = terms.select("term").distinct().join(found, "term", "left")
    zero = {c: 0 for c in ("total", "verified", "relevant", "high_quality", "confidence")}
    return out.fillna(zero).withColumn("is_valid", F.coalesce("is_valid", F.lit(False)))


def coverage(terms: DataFrame, resources: DataFrame) -> DataFrame:
    """One row: terms, terms with resources, rate and mean resources of those."""
    sizes = terms.select("term").distinct().join(resources.groupBy("term").agg(F.count("*").alias("n")), "term", "left")
    return sizes.agg(
        F.count("*").alias("n_terms"),
        F.count("n").alias("n_covered"),
        (F.count("n") / F.count("*")).alias("rate"),
        F.avg("n").alias("mean_resources"),
    )


def combined(results: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted confidence of each term over the modes it has, the best mode and the majority vote.

    ``results`` has term, mode, confidence and is_valid.
    """
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    weight = F.coalesce(table[F.col("mode")], F.lit(0.0))
    out = results.groupBy("term").agg(
        F.sum(weight * F.col("confidence")).alias("mass"),
        F.sum(weight).alias("weight"),
        F.max_by("mode", F.struct("confidence", "mode")).alias("best_mode"),
        (F.count_if("is_valid") * 2 > F.count("*")).alias("majority"),
    )
    confidence = F.when(F.col("weight") > 0, F.col("mass") / F.col("weight")).otherwise(0.0)
    return out.select("term", confidence.alias("confidence"), "best_mode", "majority")


def summary(results: DataFrame) -> DataFrame:
    """One row: terms, valid ones, their rate, mean confidence."""
    return results.agg(
        F.count("*").alias("n"),
        F.count_if("is_valid").alias("n_valid"),
        (F.count_if("is_valid") / F.count("*")).alias("valid_rate"),
        F.avg("confidence").alias("mean_confidence"),
    )


def unexpired(cache: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Cache rows (key, ts) that are not older than ``days`` at ``as_of``."""
    return cache.where(F.col("ts") >= F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(F.lit(days)))


def cache_partition(terms: DataFrame, rejected: DataFrame, cached: DataFrame, as_of: str) -> DataFrame:
    """term and state: rejected, else cached, else uncached; expired rows don't count."""
    r = unexpired(rejected, as_of).select(F.col("key").alias("term")).distinct().withColumn("r", F.lit(True))
    c = unexpired(cached, as_of).select(F.col("key").alias("term")).distinct().withColumn("c", F.lit(True))
    state = F.when(F.col("r"), "rejected").when(F.col("c"), "cached").otherwise("uncached")
    return terms.select("term").distinct().join(r, "term", "left").join(c, "term", "left").select("term", state.alias("state"))


def cache_upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row for each key (key, payload, ts), the latest."""
    both = cache.unionByName(fresh)
    return both.groupBy("key").agg(F.max_by(F.struct("payload", "ts"), F.struct("ts", "payload")).alias("v")).select("key", "v.payload", "v.ts")
