"""What follows a crawl: duplicates, quality, domains, ranking of URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions import text as T
from lexiforge.functions import urls as U

#: Keywords of academic contents.
KEYWORDS = ("research", "paper", "study", "university", "conference", "journal", "curriculum", "course", "laboratory", "analysis", "methodology", "experiments")


def quality(content: Column, url: Column, keywords: tuple[str, ...] = KEYWORDS) -> Column:
    """0.4 for length, 0.4 for keywords, 0.2 for an academic host; 0 without content."""
    low = F.lower(content)
    hits = sum((F.contains(low, F.lit(k)).cast("int") for k in keywords), F.lit(0))
    value = F.least(F.length(content) / 1000.0, F.lit(1.0)) * 0.4 + F.least(hits / 5.0, F.lit(1.0)) * 0.4 + F.when(U.is_academic(url), 0.2).otherwise(0.0)
    return F.when(F.coalesce(content, F.lit("")) == "", 0.0).otherwise(F.least(value, F.lit(1.0)))


def relevance(content: Column, concept: tuple[str, ...], keywords: tuple[str, ...] = KEYWORDS) -> Column:
    """Occurrences of the concept's words and of keywords for each 250 characters, 1 at most."""
    low = F.lower(content)
    total = sum((T.occurrences(low, k) for k in (*concept, *keywords)), F.lit(0).cast("long"))
    return F.when((F.length(content) == 0) | (total == 0), 0.0).otherwise(F.least(total / (F.length(content) / 250.0), F.lit(1.0)))


def deduplicate(results: DataFrame) -> DataFrame:
    """The first row (by pos) of each URL, or of each content where there is no URL."""
    key = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.sha2(F.coalesce("content", F.lit("")), 256))
    order = Window.partitionBy("key").orderBy("pos")
    return results.withColumn("key", key).withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("key", "nth")


def aggregate(results: DataFrame) -> DataFrame:
    """One row: results, distinct URLs and mean quality after removal of duplicates."""
    kept = deduplicate(results)
    return kept.agg(F.count("*").alias("n"), F.countDistinct("url").alias("urls"), F.avg(quality(F.col("content"), F.col("url"))).alias("mean_quality"))


def by_domain(results: DataFrame) -> DataFrame:
    """Per host: results, mean and median length."""
    n = F.length("content")
    return results.groupBy(U.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.avg(n).alias("mean_length"), F.median(n).alias("median_length"))


def prioritise(urls: DataFrame, preferred: tuple[str, ...]) -> DataFrame:
    """Distinct valid URLs (pos, url) ordered by the first preferred suffix they match, then by place."""
    rank = F.coalesce(*[F.when(U.host(F.col("url")).endswith(s), F.lit(i)) for i, s in enumerate(preferred)], F.lit(len(preferred)))
    first = urls.where(U.is_valid(F.col("url"))).groupBy("url").agg(F.min("pos").alias("pos"))
    return first.withColumn("rank", rank)


def domain_distribution(rows: DataFrame, low: float, high: float) -> DataFrame:
    """Rows of a pair table (similarity, both) within bounds, as the duplicate view shows them."""
    return rows.where(F.col("similarity").between(low, high))
