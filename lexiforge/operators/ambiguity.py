"""Ambiguity of terms: parents that diverge, combination of detectors, confidence, splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parent_divergence(keywords: DataFrame) -> DataFrame:
    """Per term: its parents, and one minus the mean Jaccard index of their keywords.

    ``keywords`` has term, parent and word.
    """
    w = keywords.select("term", "parent", "word").distinct()
    size = w.groupBy("term", "parent").agg(F.count("*").alias("n"))
    both = w.alias("x").join(w.alias("y"), ["term", "word"]).where("x.parent < y.parent").groupBy("term", F.col("x.parent").alias("p"), F.col("y.parent").alias("q")).agg(F.count("*").alias("both"))
    a, b = size.select("term", F.col("parent").alias("p"), F.col("n").alias("n1")), size.select("term", F.col("parent").alias("q"), F.col("n").alias("n2"))
    pairs = a.join(b, "term").where("p < q").join(both, ["term", "p", "q"], "left").fillna(0, ["both"])
    index = F.col("both") / (F.col("n1") + F.col("n2") - F.col("both"))
    found = pairs.groupBy("term").agg((1 - F.avg(index)).alias("divergence"), F.count_if(index < 0.5).alias("divergent_pairs"))
    parents = size.groupBy("term").agg(F.count("*").alias("parents"))
    return found.join(parents, "term")


def noisy_or(results: DataFrame, least: float = 0.5) -> DataFrame:
    """Per term one minus the product of the doubts of all methods, if that is at least ``least``."""
    kept = results.groupBy("term").agg(F.array_sort(F.collect_list("confidence")).alias("c"))
    doubt = F.aggregate("c", F.lit(1.0), lambda a, x: a * (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))))
    return kept.select("term", (1 - doubt).alias("confidence")).where(F.col("confidence") >= least)


def union_best(results: DataFrame) -> DataFrame:
    """The most confident row of each term; ties: the first method."""
    order = Window.partitionBy("term").orderBy(F.desc("confidence"), "method")
    return results.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def intersection_best(results: DataFrame, methods: int) -> DataFrame:
    """The most confident row of each term that all methods have."""
    full = results.groupBy("term").agg(F.countDistinct("method").alias("n")).where(F.col("n") == methods).select("term")
    return union_best(results.join(full, "term", "left_semi"))


def weighted_union(results: DataFrame) -> DataFrame:
    """Mean confidence of each term, with the methods that have it."""
    methods = F.array_join(F.array_sort(F.collect_set("method")), ",")
    return results.groupBy("term").agg(F.avg("confidence").alias("confidence"), methods.alias("methods"))


def cluster_confidence(clusters: Column, silhouette: Column, resources: Column) -> Column:
    """Confidence from the number of clusters, their separation and the resources."""
    base = F.when(clusters == 2, 0.6).when(clusters == 3, 0.7).otherwise(0.8)
    apart = F.when(silhouette > 0, silhouette * 0.2).otherwise(silhouette * 0.1)
    many = F.when(resources >= 10, 0.1).when(resources >= 5, 0.05).otherwise(-0.1)
    return F.when(clusters < 2, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + apart + many)))


def global_confidence(clusters: Column, largest: Column, silhouette: Column) -> Column:
    """Confidence from the global clusters a term spans, the largest one's share and the separation."""
    base = F.when(clusters == 2, 0.6).when(clusters == 3, 0.75).otherwise(F.least(F.lit(0.9), 0.75 + (clusters - 3) * 0.05))
    balance = F.when(largest > 0.8, 0.7).when(largest > 0.6, 0.9).otherwise(1.0)
    return F.least(F.lit(1.0), base * balance * F.when(silhouette > 0, 1 + silhouette * 0.2).otherwise(1.0))


def hierarchy_confidence(divergence: Column, level: Column, parents: Column) -> Column:
    """Confidence from divergence, level and number of parents, 1 at most."""
    return F.least(F.lit(1.0), divergence * (1 + 0.05 * level) + F.least(F.lit(0.2), 0.1 * (parents - 2)))


def distribution(rows: DataFrame) -> DataFrame:
    """Per term that spans more than one cluster: cluster, size and share; ``rows`` has term and cluster (-1: noise)."""
    n = rows.where("cluster >= 0").groupBy("term", "cluster").agg(F.count("*").alias("size"))
    over = Window.partitionBy("term")
    out = n.withColumn("share", F.col("size") / F.sum("size").over(over)).withColumn("clusters", F.count("*").over(over))
    return out.where("clusters > 1")


def split_proposals(shares: DataFrame, least: float = 0.0) -> DataFrame:
    """Senses term_1, term_2 ... of terms whose cluster sizes vary enough (population CV, 1 at most)."""
    spread = shares.groupBy("term").agg(F.least(F.lit(1.0), F.stddev_pop("size") / F.avg("size")).alias("separation"))
    kept = shares.join(spread.where(F.col("separation") >= least), "term")
    return kept.select("term", F.concat_ws("_", "term", (F.col("cluster") + 1).cast("string")).alias("sense"), "size", "separation")


def apply_splits(nodes: DataFrame, senses: DataFrame) -> DataFrame:
    """Nodes with split terms replaced by their senses."""
    split = senses.select("term", "sense").distinct()
    kept = nodes.join(split, "term", "left_anti")
    fresh = nodes.join(split, "term").select(F.col("sense").alias("term"), "level")
    return kept.select("term", "level").unionByName(fresh)
