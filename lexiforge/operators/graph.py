"""The duplicate graph: nodes (term, level), edges (a, b, weight, edge_type)."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder that the session names; only a session on one machine may leave it unset."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lexiforge-"))
    return df.checkpoint()


def add_nodes(nodes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Nodes and those of ``fresh`` whose term isn't there yet: the first level stays."""
    return nodes.unionByName(fresh.join(nodes, "term", "left_anti"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """term and component, the least term of its connected component; single nodes included.

    Labels pass along edges, then jump to the label of the label, until none changes.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(nodes.select("term", F.col("term").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("term", "b"), "b").groupBy(F.col("a").alias("term")).agg(F.min("component").alias("near"))
        step = labels.join(near, "term", "left").select("term", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = step.select(F.col("term").alias("component"), F.col("component").alias("far"))
        fresh = cut(step.join(jump, "component").select("term", "old", F.least("component", "far").alias("component")))
        labels = fresh.select("term", "component")
        if fresh.where("old != component").isEmpty():
            return labels


def scores(nodes: DataFrame, edges: DataFrame, prefer_higher: bool = False) -> DataFrame:
    """term and canonical score: level, degree, web presence, edge weights, length and form of the term.

    Web presence counts where ``nodes`` has its columns: urls (2 points each, 20 at
    most), contents (10 points for any) and relevance (its mean, times 10).
    """
    ends = edges.select(F.col("a").alias("term"), "weight").unionAll(edges.select(F.col("b").alias("term"), "weight"))
    degree = ends.groupBy("term").agg(F.count("*").alias("degree"), F.sum("weight").alias("weights"))
    words = F.size(F.filter(F.split("term", r"\s+"), lambda w: w != ""))
    level = F.col("level") * 100 if prefer_higher else (10 - F.col("level")) * 100
    upper: Column = (F.col("term") == F.upper("term")) & F.col("term").rlike(r"\p{L}") & (F.length("term") <= 5)
    score = (
        level
        + F.coalesce("degree", F.lit(0)) * 10
        + F.coalesce("weights", F.lit(0.0)) * 5
        - F.length("term") * 0.5
        - F.when(upper, 5).otherwise(0)
        + F.when(words == 1, 3).when(words > 3, -(words - 3) * 2).otherwise(0)
    )
    web = {
        "urls": F.least(F.coalesce("urls", F.lit(0)) * 2, F.lit(20)),
        "contents": F.when(F.col("contents") > 0, 10).otherwise(0),
        "relevance": F.coalesce("relevance", F.lit(0.0)) * 10,
    }
    for name in web:
        score = score + web[name] if name in nodes.columns else score
    return nodes.join(degree, "term", "left").select("term", "level", F.coalesce("degree", F.lit(0)).alias("degree"), score.cast("double").alias("score"))


def canonical(nodes: DataFrame, edges: DataFrame, prefer_higher: bool = False) -> DataFrame:
    """term, level, component and canonical, the best scored term of the component (ties: the least)."""
    rows = scores(nodes, edges, prefer_higher).join(components(nodes, edges), "term")
    best = rows.groupBy("component").agg(F.min_by("term", F.struct(-F.col("score"), "term")).alias("canonical"))
    return rows.join(best, "component").select("term", "level", "component", "canonical")


def level_priority(mapped: DataFrame) -> DataFrame:
    """The mapping with the member of the lowest level as canonical; ties: shorter, then least."""
    best = mapped.groupBy("component").agg(F.min_by("term", F.struct("level", F.length("term"), "term")).alias("owner"))
    return mapped.join(best, "component").select("term", "level", F.col("owner").alias("canonical"))


def cross_level(mapped: DataFrame) -> DataFrame:
    """Rows at their canonical's lowest level, with that level."""
    low = F.min("level").over(Window.partitionBy("canonical"))
    return mapped.withColumn("owner_level", low).where("level = owner_level").select("term", "canonical", "owner_level")


def groups(mapped: DataFrame) -> DataFrame:
    """canonical, members (sorted, joined by a bar) and their number."""
    return mapped.groupBy("canonical").agg(F.array_join(F.array_sort(F.collect_list("term")), "|").alias("members"), F.count("*").alias("size"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, components, single ones, the largest and the mean size."""
    sizes = components(nodes, edges).groupBy("component").agg(F.count("*").alias("n"))
    sums = sizes.agg(
        F.sum("n").alias("n_nodes"),
        F.count("*").alias("n_components"),
        F.count_if(F.col("n") == 1).alias("n_single"),
        F.max("n").alias("largest"),
        F.avg("n").alias("mean_size"),
    )
    return sums.withColumn("n_edges", F.lit(edges.count()))


def faults(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fault, item): isolated nodes, nodes without level, self loops."""
    ends = edges.select(F.col("a").alias("term")).union(edges.select(F.col("b").alias("term")))
    isolated = nodes.join(ends, "term", "left_anti").select(F.lit("isolated").alias("fault"), F.col("term").alias("item"))
    bare = nodes.where("level is null").select(F.lit("no_level").alias("fault"), F.col("term").alias("item"))
    loops = edges.where("a = b").select(F.lit("self_loop").alias("fault"), F.col("a").alias("item"))
    return isolated.unionByName(bare).unionByName(loops)


def neighbours(edges: DataFrame) -> DataFrame:
    """term, degree and neighbours (sorted, joined by a bar)."""
    ends = edges.select(F.col("a").alias("term"), F.col("b").alias("other")).union(edges.select(F.col("b").alias("term"), F.col("a").alias("other")))
    return ends.groupBy("term").agg(F.count("*").alias("degree"), F.array_join(F.array_sort(F.collect_list("other")), "|").alias("neighbours"))
