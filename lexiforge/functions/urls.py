"""URL functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters that only track visitors.
TRACKING = ("utm_", "ref=", "source=")
ACADEMIC_SUFFIX = r"(^|\.)(edu|ac|org|gov)$"


def normalise(url: Column) -> Column:
    """Without scheme, leading www., trailing slashes, fragment and tracking parameters, lower case."""
    bare = F.replace(F.replace(url, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    bare = F.rtrim(F.regexp_replace(bare, r"^www\.", ""), F.lit("/"))
    bare = F.substring_index(bare, "#", 1)
    base = F.substring_index(bare, "?", 1)
    query = F.substring(bare, F.length(base) + 2, F.greatest(F.length(bare), F.lit(1)))
    kept = F.filter(F.split(query, "&"), lambda p: ~F.lower(p).rlike("|".join(TRACKING)))
    joined = F.array_join(kept, "&")
    return F.lower(F.when(F.contains(bare, F.lit("?")) & (F.size(kept) > 0), F.concat(base, F.lit("?"), joined)).otherwise(base))


def host(url: Column) -> Column:
    """Lower-case host name, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def is_valid(url: Column) -> Column:
    """http or https, with a host."""
    return url.rlike(r"^(?i)https?://[^/?#]+")


def domain(url: Column) -> Column:
    """The label before the last of the host."""
    labels = F.split(host(url), r"\.")
    return F.when(F.size(labels) > 1, F.element_at(labels, -2)).otherwise(F.element_at(labels, -1))


def tld(url: Column) -> Column:
    """The last label of the host."""
    return F.element_at(F.split(host(url), r"\."), -1)


def is_academic(url: Column) -> Column:
    """An academic, governmental or organisation suffix, or an institution's name in the host."""
    return host(url).rlike(ACADEMIC_SUFFIX) | host(url).rlike("university|college|institute")
