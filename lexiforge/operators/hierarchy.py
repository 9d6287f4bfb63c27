"""Hierarchies: nodes (term, level), edges (parent, child), and what is measured on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.operators.graph import cut


def build(terms: DataFrame) -> DataFrame:
    """parent, child, level of edges from terms (term, level, parents) to parents on lower levels."""
    asked = terms.select(F.col("term").alias("child"), "level", F.explode("parents").alias("parent")).distinct()
    nodes = terms.select(F.col("term").alias("parent"), F.col("level").alias("parent_level")).distinct()
    return asked.join(nodes, "parent").where("parent_level < level").select("parent", "child", "level").distinct()


def per_level(nodes: DataFrame) -> DataFrame:
    """Terms of each level."""
    return nodes.groupBy("level").agg(F.count("*").alias("terms"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Terms below level 0 without a parent."""
    return nodes.where("level > 0").join(edges.select(F.col("child").alias("term")), "term", "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Terms without a child."""
    return nodes.join(edges.select(F.col("parent").alias("term")), "term", "left_anti")


def children(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """term, level and number of distinct children."""
    n = edges.groupBy(F.col("parent").alias("term")).agg(F.countDistinct("child").alias("n"))
    return nodes.join(n, "term", "left").select("term", "level", F.coalesce("n", F.lit(0)).alias("n"))


def branching(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean number of children by level."""
    return children(nodes, edges).groupBy("level").agg(F.avg("n").alias("branching"))


def connectivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """For each pair of adjacent levels the parents and children that are connected, and their shares."""
    top, low = nodes.select(F.col("term").alias("parent"), F.col("level").alias("upper")), nodes.select(F.col("term").alias("child"), F.col("level").alias("lower"))
    met = edges.select("parent", "child").join(top, "parent").join(low, "child").where("lower = upper + 1")
    met = met.groupBy("upper").agg(F.countDistinct("parent").alias("parents"), F.countDistinct("child").alias("children"))
    sizes = per_level(nodes)
    return (
        met.join(sizes.select(F.col("level").alias("upper"), F.col("terms").alias("n_upper")), "upper")
        .join(sizes.select((F.col("level") - 1).alias("upper"), F.col("terms").alias("n_lower")), "upper")
        .select("upper", "parents", "children", (F.col("parents") / F.col("n_upper")).alias("parent_share"), (F.col("children") / F.col("n_lower")).alias("child_share"))
    )


def level_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per level: terms, orphans, leaves and mean children."""
    parts = [
        per_level(nodes),
        orphans(nodes, edges).groupBy("level").agg(F.count("*").alias("orphans")),
        leaves(nodes, edges).groupBy("level").agg(F.count("*").alias("leaves")),
        branching(nodes, edges),
    ]
    return reduce(lambda a, b: a.join(b, "level", "left"), parts).fillna(0)


def issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(issue, term): orphans, branching beyond three times or below a third of the level's mean, redundant parents.

    A parent is redundant if it is also a grandparent's child in the path: a term's
    direct parent that is a parent of another direct parent.
    """
    n = children(nodes, edges).withColumn("mean", F.avg("n").over(Window.partitionBy("level")))
    wide = n.where((F.col("mean") > 0) & (F.col("n") > 3 * F.col("mean"))).select(F.lit("wide").alias("issue"), "term")
    narrow = n.where((F.col("mean") > 0) & (F.col("n") > 0) & (3 * F.col("n") < F.col("mean"))).select(F.lit("narrow").alias("issue"), "term")
    lone = orphans(nodes, edges).select(F.lit("orphan").alias("issue"), "term")
    e = edges.select("parent", "child")
    grand = e.alias("x").join(e.alias("y"), F.col("x.child") == F.col("y.parent")).select(F.col("x.parent").alias("parent"), F.col("y.child").alias("child"))
    redundant = e.join(grand.distinct(), ["parent", "child"], "left_semi").select(F.lit("redundant").alias("issue"), F.col("child").alias("term"))
    return lone.unionByName(wide).unionByName(narrow).unionByName(redundant.distinct())


def path_lengths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Simple paths from the terms of level 0: for each end level the pairs of terms, paths, mean and greatest length.

    The mean is over the pairs' own means.  Edges lead to deeper levels (others are left
    out), so every path is simple and ends.  Paths are extended by one edge at a time, as
    long as any goes on; a pair with many paths of a length is one row.
    """
    level = nodes.select(F.col("term").alias("child"), F.col("level").alias("lower"))
    down = edges.select("parent", "child").distinct().join(level, "child")
    down = cut(down.join(nodes.select(F.col("term").alias("parent"), "level"), "parent").where("lower > level").select(F.col("parent").alias("term"), "child"))
    at = nodes.where("level = 0").select(F.col("term").alias("source"), "term", F.lit(1).cast("long").alias("paths"))
    out, length = None, 0
    while True:
        at = cut(at.join(down, "term").groupBy("source", F.col("child").alias("term")).agg(F.sum("paths").alias("paths")))
        length += 1
        if at.isEmpty():
            break
        step = at.withColumn("length", F.lit(length))
        out = step if out is None else out.unionByName(step)
    if out is None:
        out = at.withColumn("length", F.lit(length))
    mean = F.sum(F.col("paths") * F.col("length")) / F.sum("paths")
    pairs = out.groupBy("source", "term").agg(F.sum("paths").alias("paths"), mean.alias("mean"), F.max("length").alias("most"))
    return pairs.join(nodes, "term").groupBy("level").agg(
        F.count("*").alias("pairs"), F.sum("paths").alias("paths"), F.avg("mean").alias("mean_length"), F.max("most").alias("max_length")
    )


def rank_parents(scored: DataFrame, max_parents: int = 3, least: float = 2.0) -> DataFrame:
    """The best ``max_parents`` parents of each term, then those of at least a score; ``scored`` has parent, child, score."""
    order = Window.partitionBy("child").orderBy(F.desc("score"), "parent")
    return scored.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= max_parents) & (F.col("score") >= least))


def siblings(edges: DataFrame, shared: DataFrame, limit: int = 10) -> DataFrame:
    """For each term the terms with a common parent, ranked by common sources; ``shared`` has term and source."""
    e = edges.select("parent", "child").distinct()
    pairs = e.alias("x").join(e.alias("y"), "parent").where("x.child != y.child").select(F.col("x.child").alias("term"), F.col("y.child").alias("sibling")).distinct()
    s = shared.select("term", "source").distinct()
    both = s.join(s.select(F.col("term").alias("sibling"), "source"), "source").groupBy("term", "sibling").agg(F.count("*").alias("common"))
    ranked = pairs.join(both, ["term", "sibling"], "left").fillna(0, ["common"])
    order = Window.partitionBy("term").orderBy(F.desc("common"), "sibling")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def search(nodes: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Terms that contain the query: exact ones first, then by level and name."""
    q = query.lower()
    hits = nodes.where(F.contains(F.lower("term"), F.lit(q))).withColumn("exact", F.lower("term") == q)
    return hits.orderBy(F.desc("exact"), "level", "term").limit(limit)
