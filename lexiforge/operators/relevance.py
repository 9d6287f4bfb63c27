"""How well texts fit terms: relevance of web contents, formats, keywords, shared sources, collected errors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lexiforge.functions import text as T
from lexiforge.operators.mining import KEYWORDS


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit of a number for each character of ``a``."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = full
    for c in b:
        hit = rows & places.get(c, 0)
        rows = ((rows + hit) | (rows - hit)) & full
    return len(a) - rows.bit_count()


def token_set_ratio(a: str | None, b: str | None) -> float:
    """0 to 100: the best likeness of the common words, and of them with the rest of either side; 0 without words."""
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    gap = 1 if both else 0
    whole = (len(both) + gap + len(left), len(both) + gap + len(right))
    best = 1 - (len(left) + len(right) - 2 * _common(left, right)) / sum(whole)
    if both:
        best = max(best, *(1 - (n - len(both)) / (n + len(both)) for n in whole))
    return 100 * best


@F.pandas_udf(DoubleType())
def fuzzy(a: pd.Series, b: pd.Series) -> pd.Series:
    """``token_set_ratio`` of two columns; it has no built-in counterpart."""
    return pd.Series([token_set_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def text_relevance(term: Column, text: Column) -> Column:
    """1 if the cleaned text contains the cleaned term, else the larger of their fuzzy ratio and the share of words found."""
    term, plain = T.clean(term), T.clean(F.coalesce(text, F.lit("")))
    x, y = F.array_distinct(T.words(term)), T.words(plain)
    share = F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.size(x))
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).when(F.contains(plain, term), 1.0).otherwise(F.greatest(fuzzy(term, plain) / 100, share))


def content_relevance(term: Column, content: Column) -> Column:
    """Mean number of times that a term's word occurs, up to half less in contents of over 100 words; 1 at most."""
    x, y = F.array_distinct(T.words(T.clean(term))), T.words(T.clean(F.coalesce(content, F.lit(""))))
    often = F.size(F.filter(y, lambda w: F.array_contains(x, w))) / F.greatest(F.lit(1), F.size(x))
    short = F.least(F.lit(1.0), F.lit(100) / F.greatest(F.lit(1), F.size(y)))
    return F.least(F.lit(1.0), often * (0.5 + 0.5 * short))


def relevance(term: Column, title: Column, snippet: Column, content: Column) -> Column:
    """Half the title's relevance, 0.3 of the snippet's, 0.2 of the content's."""
    return 0.5 * text_relevance(term, title) + 0.3 * text_relevance(term, snippet) + 0.2 * content_relevance(term, content)


def pair_relevance(pairs: DataFrame, resources: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the mean of the two terms' mean scores, 0 if either has none.

    A resource's score is its relevance, else its score, else its confidence.
    """
    value = F.coalesce(*(F.col(c) for c in ("relevance", "score", "confidence") if c in resources.columns))
    means = resources.select("term", value.cast("double").alias("v")).groupBy("term").agg(F.avg("v").alias("mean"))
    a, b = (means.select(F.col("term").alias(x), F.col("mean").alias(f"m{x}")) for x in "ab")
    rows = pairs.join(a, "a", "left").join(b, "b", "left")
    return rows.select("a", "b", F.coalesce((F.col("ma") + F.col("mb")) / 2, F.lit(0.0)).alias("relevance"))


def shared_sources(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the number of sources (``sources``: term, source) that both have."""
    known = sources.select("term", "source").distinct()
    a, b = (known.select(F.col("term").alias(x), "source") for x in "ab")
    hits = pairs.join(a, "a").join(b, ["b", "source"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    return pairs.join(hits, ["a", "b"], "left").select("a", "b", F.coalesce("shared", F.lit(0)).alias("shared"))


def format_issues(term: Column, low: int = 2, high: int = 100) -> Column:
    """The names of a term's faults of form; only hyphens at its ends and repeated spaces leave it valid."""
    plain = F.trim(term)
    faults = {
        "empty_term": plain == "",
        "too_short": F.length(term) < low,
        "too_long": F.length(term) > high,
        "leading_trailing_hyphen": F.startswith(plain, F.lit("-")) | F.endswith(plain, F.lit("-")),
        "multiple_spaces": F.contains(term, F.lit("  ")),
        "only_special_chars": F.regexp_like(term, F.lit(r"^[^\p{L}\p{N}_]+$")),
    }
    return F.array_compact(F.array(*[F.when(hit, name) for name, hit in faults.items()]))


def valid_format(issues: Column) -> Column:
    """Whether the issues leave a term valid."""
    return F.size(F.array_except(issues, F.array(F.lit("leading_trailing_hyphen"), F.lit("multiple_spaces")))) == 0


def collected_errors(results: DataFrame) -> DataFrame:
    """term and its errors as ``mode: error``, by mode and place; ``results`` has term, mode and errors, a list."""
    rows = results.select("term", "mode", F.posexplode("errors").alias("i", "error")).where("error is not null")
    listed = F.array_sort(F.collect_list(F.struct("mode", "i", F.concat("mode", F.lit(": "), "error").alias("text"))))
    return rows.groupBy("term").agg(F.transform(listed, lambda x: x["text"]).alias("errors"))


def top_keywords(contents: DataFrame, top: int = 25, keywords: tuple[str, ...] = KEYWORDS) -> DataFrame:
    """term and those of its ``top`` most frequent words of four letters and more that are keywords, in that order.

    Of equally frequent words the one that comes first is the more frequent.
    """
    found = F.regexp_extract_all(F.lower("content"), F.lit("[a-z]{4,}"), F.lit(0))
    rows = contents.select("term", F.posexplode(found).alias("i", "word")).groupBy("term", "word").agg(F.count("*").alias("n"), F.min("i").alias("i"))
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("n"), "i"))
    rows = rows.withColumn("place", place).where((F.col("place") <= top) & F.col("word").isin(*keywords))
    return rows.groupBy("term").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]).alias("keywords"))


def largest_components(mapped: DataFrame, top: int = 5, sample: int = 5) -> DataFrame:
    """component, size and its first terms, of the ``top`` largest components (ties: by component)."""
    sizes = mapped.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(top)
    rows = mapped.join(F.broadcast(sizes), "component")
    nth = F.row_number().over(Window.partitionBy("component").orderBy("term"))
    rows = rows.withColumn("nth", nth).where(F.col("nth") <= sample)
    return rows.groupBy("component", "size").agg(F.array_join(F.array_sort(F.collect_list("term")), ", ").alias("terms"))
