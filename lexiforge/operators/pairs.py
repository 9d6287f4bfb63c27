"""Edges between terms, from inverted indexes instead of nested loops.

``terms`` has pos and term (distinct terms).  Edges have src, dst (src before dst by
pos), weight and edge_type.  A pair of terms that share a word, a URL or initials meets
in an equi-join on that key, so no pair without one is looked at.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lexiforge.functions import text as T

#: Order in which edge creators write; a later one overwrites an earlier one.
EDGE_ORDER = ("text", "compound", "acronym", "synonym", "web_overlap", "domain", "content", "llm")


def similarity(a: str, b: str) -> float:
    """difflib ratio of normalised terms; a contained term scores 0.7 and 0.3 times the length ratio at least."""
    ratio = difflib.SequenceMatcher(None, a, b).ratio()
    if a and b and (a in b or b in a):
        ratio = max(ratio, 0.7 + 0.3 * min(len(a), len(b)) / max(len(a), len(b)))
    return ratio


@F.pandas_udf(DoubleType())
def similarity_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) for x, y in zip(a, b)])


def _numbered(terms: DataFrame) -> DataFrame:
    return terms.select("pos", "term", T.normalise(F.col("term")).alias("norm"))


def meet(keys: DataFrame, key: str = "key") -> DataFrame:
    """(pos1, pos2, shared) of terms with common keys; ``keys`` has pos and the key, distinct."""
    a, b = keys.select(key, F.col("pos").alias("pos1")), keys.select(key, F.col("pos").alias("pos2"))
    return a.join(b, key).where("pos1 < pos2").groupBy("pos1", "pos2").agg(F.count("*").alias("shared"))


def _named(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    left = terms.select(F.col("pos").alias("pos1"), F.col("term").alias("src"))
    right = terms.select(F.col("pos").alias("pos2"), F.col("term").alias("dst"))
    return pairs.join(left, "pos1").join(right, "pos2")


def text_edges(terms: DataFrame, least: float = 0.85) -> DataFrame:
    """Pairs of similar terms.

    A ratio of ``least`` needs a common character bigram unless a term has one
    character, and lengths within a factor that also admits contained terms; pairs meet
    by bigrams and one-character terms by their character.
    """
    rows = _numbered(terms)
    n = F.length("norm")
    grams = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring("norm", i, F.lit(2)))).otherwise(F.array("norm"))
    keys = rows.select("pos", F.explode(F.array_union(grams, F.transform(F.split("norm", ""), lambda c: c))).alias("key")).distinct()
    keys = keys.join(rows.select("pos", n.alias("n")), "pos").where((F.length("key") == 2) | (F.col("n") <= 2))
    pairs = meet(keys.select("pos", "key").distinct())
    a = rows.select(F.col("pos").alias("pos1"), F.col("term").alias("src"), F.col("norm").alias("n1"))
    b = rows.select(F.col("pos").alias("pos2"), F.col("term").alias("dst"), F.col("norm").alias("n2"))
    pairs = pairs.join(a, "pos1").join(b, "pos2")
    bound = F.least(F.length("n1"), F.length("n2")) >= F.greatest(F.length("n1"), F.length("n2")) * (min(least / (2 - least), max(0.0, (least - 0.7) / 0.3)) - 1e-9)
    scored = pairs.where(bound).withColumn("weight", similarity_of("n1", "n2"))
    return scored.where(F.col("weight") >= least).select("src", "dst", "weight", F.lit("text").alias("edge_type"))


def compound_edges(terms: DataFrame) -> DataFrame:
    """Pairs where one term's words contain the other's, or two terms share two words.

    Every such pair shares a word.  The weight is 0.9, or the similarity if that is more.
    """
    rows = _numbered(terms).withColumn("words", F.array_distinct(T.words(F.col("norm"))))
    pairs = meet(rows.select("pos", F.explode("words").alias("key")))
    a = rows.select(F.col("pos").alias("pos1"), F.size("words").alias("w1"))
    b = rows.select(F.col("pos").alias("pos2"), F.size("words").alias("w2"))
    pairs = pairs.join(a, "pos1").join(b, "pos2")
    one = ((F.col("w1") == 1) & (F.col("w2") > 1)) | ((F.col("w2") == 1) & (F.col("w1") > 1))
    both = (F.col("w1") > 1) & (F.col("w2") > 1) & ((F.col("shared") >= 2) | (F.col("shared") == F.least("w1", "w2")))
    met = _named(pairs.where(one | both), terms)
    a, b = T.normalise(F.col("src")), T.normalise(F.col("dst"))
    # a ratio above 0.9 needs lengths that differ by less than a fifth
    near = F.least(F.length(a), F.length(b)) >= 0.66 * F.greatest(F.length(a), F.length(b))
    alike = met.where(near).withColumn("weight", F.greatest(F.lit(0.9), similarity_of(a, b)))
    met = alike.unionByName(met.where(~near).withColumn("weight", F.lit(0.9)))
    return met.select("src", "dst", "shared", "weight", F.lit("compound").alias("edge_type"))


def acronym_edges(terms: DataFrame) -> DataFrame:
    """Upper-case terms of 2 to 10 letters and the terms with these initials, with or without small words."""
    short = terms.where(F.length("term").between(2, 10) & (F.col("term") == F.upper("term")) & F.col("term").rlike(r"\p{L}"))
    long = terms.withColumn("words", T.words(F.col("term"))).where(F.size("words") >= 2)
    real = F.filter("words", lambda w: ~F.lower(w).isin(*T.INITIAL_STOPS))
    keys = F.array_distinct(F.array_compact(F.array(T.initials(F.col("term")), F.when(F.size(real) >= 2, T.initials(F.col("term"), T.INITIAL_STOPS)))))
    long = long.select(F.col("pos").alias("pos_long"), F.col("term").alias("long"), F.explode(keys).alias("term"))
    met = short.join(long, "term").where("pos != pos_long")
    first, second = F.when(F.col("pos") < F.col("pos_long"), F.col("term")), F.when(F.col("pos") < F.col("pos_long"), F.col("long"))
    return met.select(F.coalesce(first, "long").alias("src"), F.coalesce(second, "term").alias("dst"), F.lit(0.95).alias("weight"), F.lit("acronym").alias("edge_type")).distinct()


def synonym_edges(terms: DataFrame, synonyms: tuple[tuple[str, str], ...] = T.SYNONYMS) -> DataFrame:
    """Terms with an abbreviation as a word and terms that contain its long form."""
    short = F.array_compact(F.array(*[F.when(F.col("term").rlike(rf"\b{a}\b"), F.lit(a)) for a, _ in synonyms]))
    long = F.array_compact(F.array(*[F.when(F.contains(F.lower("term"), F.lit(b)), F.lit(a)) for a, b in synonyms]))
    left = terms.select(F.col("pos").alias("p"), F.col("term").alias("a"), F.explode(short).alias("key"))
    right = terms.select(F.col("pos").alias("q"), F.col("term").alias("b"), F.explode(long).alias("key"))
    met = left.join(right, "key").where("p != q")
    ordered = met.select(F.when(F.col("p") < F.col("q"), F.struct(F.col("a").alias("src"), F.col("b").alias("dst"))).otherwise(F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))).alias("e"))
    return ordered.select("e.*", F.lit(0.9).alias("weight"), F.lit("synonym").alias("edge_type")).distinct()


def rule_edges(terms: DataFrame, least: float = 0.85) -> DataFrame:
    """All rule edges with ``ord``, the order of their creators."""
    frames = [text_edges(terms, least), compound_edges(terms).drop("shared"), acronym_edges(terms), synonym_edges(terms)]
    out = None
    for i, frame in enumerate(frames):
        frame = frame.withColumn("ord", F.lit(i))
        out = frame if out is None else out.unionByName(frame)
    return out


def overlap_pairs(resources: DataFrame, low: int = 2, high: int | None = None) -> DataFrame:
    """(a, b, overlap) of terms that share at least ``low`` and fewer than ``high`` URLs.

    ``resources`` has term and url.
    """
    keys = resources.select("url", F.col("term").alias("pos")).distinct()
    out = meet(keys, "url").select(F.col("pos1").alias("a"), F.col("pos2").alias("b"), F.col("shared").alias("overlap")).where(F.col("overlap") >= low)
    return out if high is None else out.where(F.col("overlap") < high)


def web_overlap_edges(resources: DataFrame, low: int = 2, least_relevance: float = 0.3) -> DataFrame:
    """Edges from shared URLs: weight is the pair's mean relevance and a tenth for each shared URL, 1 at most.

    ``resources`` has term, url and relevance.
    """
    means = resources.groupBy("term").agg(F.avg("relevance").alias("mean"))
    pairs = overlap_pairs(resources, low)
    pairs = pairs.join(means.select(F.col("term").alias("a"), F.col("mean").alias("m1")), "a").join(means.select(F.col("term").alias("b"), F.col("mean").alias("m2")), "b")
    relevance = (F.coalesce("m1", F.lit(0.0)) + F.coalesce("m2", F.lit(0.0))) / 2
    return pairs.where(relevance >= least_relevance).select("a", "b", "overlap", F.least(F.lit(1.0), relevance + 0.1 * F.col("overlap")).alias("weight"))


def content_edges(contents: DataFrame, least: float = 0.6) -> DataFrame:
    """Pairs whose distinct lower-case words have a Jaccard index of ``least`` or more; ``contents`` has pos and text."""
    keys = contents.select("pos", F.explode(F.array_distinct(T.words(F.lower("text")))).alias("key"))
    size = keys.groupBy("pos").agg(F.count("*").alias("n"))
    pairs = meet(keys).join(size.select(F.col("pos").alias("pos1"), F.col("n").alias("n1")), "pos1").join(size.select(F.col("pos").alias("pos2"), F.col("n").alias("n2")), "pos2")
    score = F.col("shared") / (F.col("n1") + F.col("n2") - F.col("shared"))
    return pairs.withColumn("weight", score).where(F.col("weight") >= least).select("pos1", "pos2", "shared", "weight")


def upsert(edges: DataFrame, first_wins: bool = False) -> DataFrame:
    """One edge for each unordered pair: the last by ``ord``, or the first."""
    pair = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
    pick: Column = (F.min_by if first_wins else F.max_by)(F.struct("weight", "edge_type"), F.struct("ord", "weight", "edge_type"))
    return edges.groupBy(*pair).agg(pick.alias("e")).select("a", "b", "e.weight", "e.edge_type")


def strong(edges: DataFrame, least: float = 0.3, missing: float = 0.0) -> DataFrame:
    """Edges of at least a weight; a missing weight counts as ``missing``."""
    return edges.where(F.coalesce("weight", F.lit(missing)) >= least)


def judged(pairs: DataFrame, judge, least: float = 0.8) -> DataFrame:
    """Pairs that a judge calls duplicates with enough confidence.

    ``judge`` maps an iterator of pandas frames with a and b to frames with a, b,
    duplicate and confidence; it stands for a model call.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return judge(frames)

    verdicts = pairs.select("a", "b").mapInPandas(run, "a string, b string, duplicate boolean, confidence double")
    return verdicts.where(F.col("duplicate") & (F.col("confidence") >= least))
