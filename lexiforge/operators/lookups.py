"""Lookups, filters and summaries of results: validations, detections, the duplicate graph, hierarchies, caches.

``results`` have term, method, confidence, is_valid and perhaps score; ``mapped`` is a
graph's mapping (term, level, component, canonical); ``nodes`` and ``edges`` as in the
modules of graphs and hierarchies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- validation results


def with_validity(results: DataFrame, valid: bool = True) -> DataFrame:
    """The terms that are valid, or that aren't; a null verdict is neither."""
    return results.where(F.col("is_valid") == F.lit(valid)).select("term").distinct()


def by_score(results: DataFrame, least: float, score: Column | None = None) -> DataFrame:
    """Results of at least ``least``: the score, or the confidence where there is none."""
    return results.where(F.coalesce(F.col("confidence") if score is None else score, F.col("confidence")) >= least)


def combined_score(results: DataFrame, weights: dict[str, float]) -> DataFrame:
    """term and the weighted mean of its methods' scores (else confidences); methods without a weight don't count."""
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    rows = results.withColumn("w", known[F.col("method")])
    value = F.coalesce("score", "confidence") if "score" in results.columns else F.col("confidence")
    weight = F.sum(F.when(value.isNotNull(), F.col("w")))
    return rows.groupBy("term").agg(F.coalesce(F.sum(F.col("w") * value) / F.nullif(weight, F.lit(0.0)), F.lit(0.0)).alias("score"))


def improvement(scores: DataFrame) -> DataFrame:
    """absolute and percent improvement of ``after`` over ``before``; a baseline of 0 gives 0 percent."""
    gain = F.col("after") - F.col("before")
    return scores.withColumn("absolute", gain).withColumn("percent", F.when(F.col("before") > 0, gain / F.col("before") * 100).otherwise(0.0))


# --- detections


def detection_summary(results: DataFrame) -> DataFrame:
    """Per method: detections, and mean, least and greatest confidence."""
    c = F.col("confidence")
    return results.groupBy("method").agg(F.count("*").alias("n"), F.avg(c).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most"))


def combined_detections(results: DataFrame, strategy: str = "union", votes: int = 2) -> DataFrame:
    """term, methods and the best confidence: found by any method, by all (``intersection``) or by ``votes`` of them (``voting``)."""
    per = results.groupBy("term").agg(F.countDistinct("method").alias("methods"), F.max("confidence").alias("confidence"))
    if strategy == "union":
        return per
    if strategy == "voting":
        return per.where(F.col("methods") >= votes)
    if strategy == "intersection":
        return per.crossJoin(F.broadcast(results.agg(F.countDistinct("method").alias("all")))).where("methods = all").drop("all")  # one row
    raise ValueError(strategy)


# --- the duplicate graph


def component_members(mapped: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, term): all members of the components of the asked terms; ``asked`` has term."""
    of = asked.select(F.col("term").alias("asked")).distinct().join(mapped.select(F.col("term").alias("asked"), "component"), "asked")
    return of.join(mapped.select("term", "component"), "component").select("asked", "term")


def same_component(pairs: DataFrame, mapped: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with is_duplicate: both are in one component; false for unknown terms."""
    a, b = (mapped.select(F.col("term").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    return pairs.join(a, "a", "left").join(b, "b", "left").select("a", "b", F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)).alias("is_duplicate"))


def edge_info(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the weight of their edge in either direction; null without an edge."""
    both = edges.select("a", "b", "weight").union(edges.select("b", "a", "weight")).groupBy("a", "b").agg(F.max("weight").alias("weight"))
    return pairs.join(both, ["a", "b"], "left").select("a", "b", "weight")


def variations(mapped: DataFrame) -> DataFrame:
    """(canonical, variation) of all terms that aren't their own canonical."""
    return mapped.where("term <> canonical").select("canonical", F.col("term").alias("variation"))


def merged(edges: DataFrame, mapped: DataFrame, pairs: DataFrame, weight: float = 0.95) -> DataFrame:
    """``edges`` (a, b, weight) and an edge between the canonicals of the components of each pair (a, b)."""
    a, b = (mapped.select(F.col("term").alias(x), F.col("canonical").alias(f"c{x}")) for x in "ab")
    fresh = pairs.join(a, "a").join(b, "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
    fresh = fresh.join(edges.select("a", "b"), ["a", "b"], "left_anti")
    return edges.select("a", "b", "weight").unionByName(fresh.withColumn("weight", F.lit(weight)))


# --- hierarchies


def centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """term, level and degree centrality: edges in and out over the other nodes."""
    ends = edges.select(F.col("parent").alias("term")).unionAll(edges.select(F.col("child").alias("term"))).groupBy("term").agg(F.count("*").alias("degree"))
    others = F.broadcast(nodes.agg((F.count("*") - 1).alias("others")))  # one row
    rows = nodes.join(ends, "term", "left").crossJoin(others)
    return rows.select("term", "level", F.when(F.col("others") > 0, F.coalesce("degree", F.lit(0)) / F.col("others")).otherwise(1.0).alias("centrality"))


def network_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, and the greatest number of parents and of children."""
    n, m = nodes.agg(F.count("*").alias("n")), edges.agg(F.count("*").alias("m"))
    up = edges.groupBy("child").agg(F.count("*").alias("k")).agg(F.max("k").alias("most_parents"))
    down = edges.groupBy("parent").agg(F.count("*").alias("k")).agg(F.max("k").alias("most_children"))
    row = n.crossJoin(m).crossJoin(up).crossJoin(down)  # one row each
    return row.select(F.col("n").alias("nodes"), F.col("m").alias("edges"), F.when(F.col("n") > 1, F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("density"), "most_parents", "most_children")


def parent_scores(nodes: DataFrame, edges: DataFrame, sources: DataFrame, likeness: DataFrame | None = None) -> DataFrame:
    """parent, child and score of every edge.

    1, and 5 if the parent is named in the child's sources (``sources``: term, text), and
    up to 3 for its share of the child's level times 10, and 2 for a parent one level
    above or half a level's penalty for each further one, and 4 times the likeness of
    their vectors (``likeness``: parent, child, likeness) where it is known.
    """
    e = edges.select("parent", "child").distinct()
    up, low = nodes.select(F.col("term").alias("parent"), F.col("level").alias("upper")), nodes.select(F.col("term").alias("child"), "level")
    rows = e.join(low, "child").join(up, "parent", "left")
    used = rows.groupBy("level", "parent").agg(F.count("*").alias("used"))
    size = nodes.groupBy("level").agg(F.count("*").alias("size"))
    rows = rows.join(used, ["level", "parent"]).join(F.broadcast(size), "level")  # a row a level
    text = sources.groupBy(F.col("term").alias("child")).agg(F.lower(F.array_join(F.array_sort(F.collect_list("text")), " ")).alias("text"))
    rows = rows.join(text, "child", "left")
    gap = F.col("level") - F.col("upper")
    score = (
        F.lit(1.0)
        + F.when(F.contains(F.col("text"), F.lower("parent")), 5.0).otherwise(0.0)
        + F.least(F.lit(3.0), F.col("used") / F.col("size") * 10)
        + F.when(gap == 1, 2.0).when(gap > 1, -(gap - 1) * 0.5).otherwise(0.0)
    )
    if likeness is not None:
        rows = rows.join(likeness, ["parent", "child"], "left")
        score = score + 4 * F.coalesce("likeness", F.lit(0.0))
    return rows.select("parent", "child", score.alias("score"))


def merged_parents(terms: DataFrame, edges: DataFrame) -> DataFrame:
    """term and parents, its own (``terms``: term, parents) and those of the hierarchy, distinct and sorted."""
    asked = edges.groupBy(F.col("child").alias("term")).agg(F.collect_set("parent").alias("found"))
    rows = terms.join(asked, "term", "left")
    none = F.array().cast("array<string>")
    return rows.select("term", F.array_sort(F.array_union(F.coalesce("parents", none), F.coalesce("found", none))).alias("parents"))


def parent_context(edges: DataFrame, definitions: DataFrame, mark: str = "\n") -> DataFrame:
    """term and the definitions of its parents (``definitions``: term, definition), in the parents' order, joined."""
    known = definitions.where("definition is not null and definition <> ''").select(F.col("term").alias("parent"), "definition")
    rows = edges.select("parent", F.col("child").alias("term")).distinct().join(known, "parent")
    listed = F.array_sort(F.collect_list(F.struct("parent", "definition")))
    return rows.groupBy("term").agg(F.array_join(F.transform(listed, lambda x: x["definition"]), mark).alias("context"))


# --- mapping, merging, caches, batches


def mapping_cascade(asked: DataFrame, known: DataFrame, mapped: DataFrame) -> DataFrame:
    """asked, target and step: 1 an equal known term (any case, trimmed), 2 one through the duplicate mapping, else null.

    ``asked`` and ``known`` have term, ``mapped`` has variation and canonical; of several
    targets the least one stays.
    """
    norm = lambda c: F.lower(F.trim(F.col(c)))
    rows = asked.select(F.col("term").alias("asked"), norm("term").alias("key")).distinct()
    direct = known.groupBy(norm("term").alias("key")).agg(F.min("term").alias("direct"))
    across = mapped.select(norm("variation").alias("key"), norm("canonical").alias("other")).distinct()
    across = across.join(direct.select(F.col("key").alias("other"), "direct"), "other").groupBy("key").agg(F.min("direct").alias("across"))
    rows = rows.join(direct, "key", "left").join(across, "key", "left")
    step = F.when(F.col("direct").isNotNull(), 1).when(F.col("across").isNotNull(), 2)
    return rows.select("asked", F.coalesce("direct", "across").alias("target"), step.alias("step"))


def compound_parts(terms: DataFrame, known: DataFrame) -> DataFrame:
    """term, parts and removable for terms that list others (``and``, commas): removable if all parts are known."""
    parts = F.filter(F.transform(F.split(F.regexp_replace("term", r"(?i)\s+and\s+", ","), ","), lambda p: F.lower(F.trim(p))), lambda p: p != "")
    rows = terms.select("term", parts.alias("parts")).where(F.size("parts") > 1)
    each = rows.select("term", F.explode("parts").alias("part")).distinct()
    hits = each.join(known.select(F.lower(F.trim("term")).alias("part")).distinct(), "part", "left_semi").groupBy("term").agg(F.count("*").alias("hits"))
    out = rows.join(hits, "term", "left")
    return out.select("term", F.size("parts").alias("parts"), (F.coalesce("hits", F.lit(0)) == F.size(F.array_distinct("parts"))).alias("removable"))


def cache_stats(entries: DataFrame, as_of: str, days: int) -> DataFrame:
    """Per store: entries, unexpired and expired ones, and the kilobytes of their payloads; ``entries`` has store, payload, ts."""
    fresh = F.col("ts") > F.expr(f"timestamp '{as_of}' - interval {days} days")
    size = (F.sum(F.octet_length("payload")) / 1024).alias("kilobytes")
    return entries.groupBy("store").agg(F.count("*").alias("entries"), F.count_if(fresh).alias("unexpired"), F.count_if(~fresh).alias("expired"), size)


def pending(items: DataFrame, done: DataFrame, size: int) -> DataFrame:
    """``items`` (pos, ...) with their batch, of the batches of ``size`` that aren't in ``done`` (batch)."""
    return items.withColumn("batch", F.floor(F.col("pos") / size).cast("long")).join(done.select("batch").distinct(), "batch", "left_anti")


def separation(clusters: DataFrame) -> DataFrame:
    """term, clusters and separation: the mean of their evenness (least over greatest size) and of their number by four, 1 at most."""
    sizes = clusters.where("cluster >= 0").groupBy("term", "cluster").agg(F.count("*").alias("n"))
    k = F.count("*")
    value = F.when(k > 1, (F.min("n") / F.max("n") + F.least(F.lit(1.0), k / 4)) / 2).otherwise(0.0)
    return sizes.groupBy("term").agg(k.alias("clusters"), value.alias("separation"))


def checked_splits(splits: DataFrame, least: float = 0.5) -> DataFrame:
    """``splits`` (term, tags, separation) with the reason for which each is rejected, or null."""
    reason = (
        F.when(F.size("tags") < 2, "too few senses")
        .when(F.size(F.array_distinct(F.transform("tags", lambda t: F.lower(F.trim(t))))) < F.size("tags"), "tags not distinct")
        .when(F.col("separation") < least, "poor separation")
    )
    return splits.withColumn("reason", reason)


# --- columns


def normal_url(url: Column) -> Column:
    """scheme://host/path?query in the normal form: host in lower case, no slash at the end, no fragment; https if there is no scheme."""
    plain = F.trim(url)
    scheme = F.lower(F.regexp_extract(plain, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.regexp_replace(F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*:", ""), r"#.*$", "")
    host = F.lower(F.regexp_extract(rest, r"^//([^/?]*)", 1))
    path = F.regexp_replace(F.regexp_extract(rest, r"^(?://[^/?]*)?([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    return F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def links(html: Column) -> Column:
    """The distinct http(s) addresses that a page links to, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(r"href=\"(https?://[^\"]+)\""), F.lit(1))))


def camel(name: Column) -> Column:
    """snake_case as camelCase."""
    parts = F.split(name, "_")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2))))
    return F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))


def text_overlap(term: Column, text: Column) -> Column:
    """Share of the term's words that the text has; 1 if the text contains the whole term, 0 for an empty text."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    share = F.size(F.array_intersect(words(term), words(text))) / F.greatest(F.lit(1), F.size(words(term)))
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).when(F.contains(F.lower(text), F.lower(term)), 1.0).otherwise(share)
