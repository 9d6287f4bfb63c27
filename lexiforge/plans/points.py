"""Queries of lookups, filters and summaries, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.operators import graph
from lexiforge.operators import lookups as L
from lexiforge.plans import inputs as I

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


@query(f"WITH {I.DETECTIONS} SELECT DISTINCT term FROM detections WHERE is_valid")
def valid_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.with_validity(I.detections(spark, sf_dir))


@query(f"WITH {I.DETECTIONS} SELECT DISTINCT term FROM detections WHERE NOT is_valid")
def invalid_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.with_validity(I.detections(spark, sf_dir), False)


@query(f"WITH {I.DETECTIONS} SELECT term, method, confidence FROM detections WHERE confidence >= 0.5")
def results_by_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.by_score(I.detections(spark, sf_dir), 0.5).select("term", "method", "confidence")


@query(f"WITH {I.DETECTIONS} SELECT term, method, confidence FROM detections WHERE coalesce(CASE WHEN method = 'label' THEN confidence / 2 END, confidence) >= 0.3")
def results_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("method") == "label", F.col("confidence") / 2)
    return L.by_score(I.detections(spark, sf_dir), 0.3, score).select("term", "method", "confidence")


@query(f"""WITH {I.DETECTIONS}, w AS (SELECT term, confidence, CASE method WHEN 'label' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS w FROM detections)
SELECT term, round(sum(w * confidence) / sum(w), 6) AS score FROM w GROUP BY 1""")
def combined_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.combined_score(I.detections(spark, sf_dir), {"label": 0.7, "length": 0.3}).withColumn("score", F.round("score", 6))


@query("SELECT c_custkey, c_acctbal AS before, c_acctbal + c_custkey % 7 AS after, round(c_acctbal + c_custkey % 7 - c_acctbal, 6) AS absolute, round(CASE WHEN c_acctbal > 0 THEN (c_acctbal + c_custkey % 7 - c_acctbal) / c_acctbal * 100 ELSE 0 END, 6) AS percent FROM customer")
def score_improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("before"), (F.col("c_acctbal") + F.col("c_custkey") % 7).alias("after"))
    out = L.improvement(rows)
    return out.withColumn("absolute", F.round("absolute", 6)).withColumn("percent", F.round("percent", 6))


@query(f"WITH {I.DETECTIONS} SELECT method, count(*) AS n, round(avg(confidence), 9) AS mean, min(confidence) AS least, max(confidence) AS most FROM detections GROUP BY 1")
def detection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.detection_summary(I.detections(spark, sf_dir)).withColumn("mean", F.round("mean", 9))


_FOUND = f"{I.DETECTIONS}, per AS (SELECT term, count(DISTINCT method) AS methods, max(confidence) AS confidence FROM detections WHERE is_valid GROUP BY 1)"


@query(f"WITH {_FOUND} SELECT * FROM per")
def detections_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.combined_detections(I.detections(spark, sf_dir).where("is_valid"))


@query(f"WITH {_FOUND} SELECT * FROM per WHERE methods = 2")
def detections_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.combined_detections(I.detections(spark, sf_dir).where("is_valid"), "intersection")


@query(f"WITH {_FOUND} SELECT * FROM per WHERE methods >= 2")
def detections_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.combined_detections(I.detections(spark, sf_dir).where("is_valid"), "voting")


# --- the duplicate graph

_MAPPED = f"""WITH RECURSIVE {I.COMPONENTS}, deg AS (SELECT x AS term, count(*) AS degree, sum(weight) AS weights FROM (SELECT a AS x, weight FROM edges UNION ALL SELECT b, weight FROM edges) GROUP BY 1),
scored AS (SELECT n.term, level, component, (10 - level) * 100 + coalesce(degree, 0) * 10 + coalesce(weights, 0) * 5 - length(n.term) * 0.5::DOUBLE + 3 AS score FROM nodes n JOIN comp USING (term) LEFT JOIN deg ON deg.term = n.term),
best AS (SELECT component, min_by(term, (-score, term)) AS canonical FROM scored GROUP BY 1), mapped AS (SELECT term, level, component, canonical FROM scored JOIN best USING (component))"""


def _mapped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = I.graph(spark, sf_dir)
    edges = graph.cut(edges)
    return graph.cut(graph.canonical(nodes, edges)), edges


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): each supplier's key and its nation's, as two part names."""
    return I.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("a"), (F.col("s_nationkey") + 1).cast("string").alias("b")).distinct()


_ASKED = "asked AS (SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS a, CAST(s_nationkey + 1 AS VARCHAR) AS b FROM supplier)"


@query(f"{_MAPPED}, {_ASKED} SELECT DISTINCT x.a AS asked, m.term FROM asked x JOIN comp c ON c.term = x.a JOIN comp m USING (component)")
def component_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped, _ = _mapped(spark, sf_dir)
    return L.component_members(mapped, _asked(spark, sf_dir).select(F.col("a").alias("term")))


@query(f"{_MAPPED}, {_ASKED} SELECT a, b, coalesce(x.component = y.component, false) AS is_duplicate FROM asked LEFT JOIN comp x ON x.term = a LEFT JOIN comp y ON y.term = b")
def same_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.same_component(_asked(spark, sf_dir), _mapped(spark, sf_dir)[0])


@query(f"WITH {I.GRAPH}, {_ASKED}, e AS (SELECT a, b, weight FROM edges UNION ALL SELECT b, a, weight FROM edges) SELECT a, b, weight FROM asked LEFT JOIN e USING (a, b)")
def edge_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.edge_info(_asked(spark, sf_dir), I.graph(spark, sf_dir)[1])


@query(f"{_MAPPED} SELECT canonical, term AS variation FROM mapped WHERE term <> canonical")
def all_variations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.variations(_mapped(spark, sf_dir)[0])


@query(f"""{_MAPPED}, {_ASKED}, fresh AS (SELECT DISTINCT least(x.canonical, y.canonical) AS a, greatest(x.canonical, y.canonical) AS b FROM asked q JOIN mapped x ON x.term = q.a JOIN mapped y ON y.term = q.b WHERE x.canonical <> y.canonical)
SELECT a, b, weight FROM edges UNION ALL SELECT a, b, 0.95::DOUBLE FROM fresh WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.a = fresh.a AND e.b = fresh.b)""")
def merged_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped, edges = _mapped(spark, sf_dir)
    return L.merged(edges, mapped, _asked(spark, sf_dir))


@query(f"WITH {I.GRAPH} SELECT a, b FROM edges")
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.graph(spark, sf_dir)[1].select("a", "b")


@query(f"WITH {I.GRAPH} SELECT * FROM edges WHERE weight >= 0.75")
def edges_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.graph(spark, sf_dir)[1].where("weight >= 0.75")


# --- hierarchies


@query(f"WITH {I.HIERARCHY}, d AS (SELECT t, count(*) AS k FROM (SELECT parent AS t FROM edges UNION ALL SELECT child FROM edges) GROUP BY 1) SELECT level, count(*) AS terms, round(max(coalesce(k, 0)) / (SELECT count(*) - 1 FROM nodes)::DOUBLE, 9) AS most FROM nodes LEFT JOIN d ON t = term GROUP BY 1")
def centrality_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.centrality(*I.hierarchy(spark, sf_dir))
    return rows.groupBy("level").agg(F.count("*").alias("terms"), F.round(F.max("centrality"), 9).alias("most"))


@query(f"""WITH {I.HIERARCHY} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, round(((SELECT count(*) FROM edges)::DOUBLE / ((SELECT count(*) FROM nodes)::DOUBLE * (SELECT count(*) - 1 FROM nodes))) * 1e6, 6) AS density,
(SELECT max(k) FROM (SELECT count(*) AS k FROM edges GROUP BY child)) AS most_parents, (SELECT max(k) FROM (SELECT count(*) AS k FROM edges GROUP BY parent)) AS most_children""")
def network_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.network_metrics(*I.hierarchy(spark, sf_dir)).withColumn("density", F.round(F.col("density") * 1e6, 6))


@query(f"""WITH {I.HIERARCHY}, src AS (SELECT 'o' || o_orderkey AS term, lower('placed by c' || (o_custkey // 2 * 2)) AS text FROM orders), sz AS (SELECT level, count(*) AS size FROM nodes GROUP BY 1),
us AS (SELECT c.level, e.parent, count(*) AS used FROM edges e JOIN nodes c ON c.term = e.child GROUP BY 1, 2)
SELECT e.parent, e.child, round(1 + CASE WHEN contains(coalesce(text, ''), lower(e.parent)) THEN 5 ELSE 0 END + least(3.0::DOUBLE, used / size::DOUBLE * 10) + CASE WHEN c.level - p.level = 1 THEN 2 WHEN c.level - p.level > 1 THEN -(c.level - p.level - 1) * 0.5 ELSE 0 END, 6) AS score
FROM edges e JOIN nodes c ON c.term = e.child JOIN nodes p ON p.term = e.parent JOIN us ON us.level = c.level AND us.parent = e.parent JOIN sz ON sz.level = c.level LEFT JOIN src ON src.term = e.child""")
def parent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.concat(F.lit("placed by C"), (F.floor(F.col("o_custkey") / 2) * 2).cast("string"))
    sources = I.table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("term"), named.alias("text"))
    return L.parent_scores(*I.hierarchy(spark, sf_dir), sources).withColumn("score", F.round("score", 6))


@query(f"""WITH {I.HIERARCHY}, src AS (SELECT 'c' || c_custkey AS term, 'n' || (c_nationkey % 5) AS own FROM customer), f AS (SELECT term, own AS p FROM src UNION SELECT child, parent FROM edges WHERE child IN (SELECT term FROM src))
SELECT term, string_agg(p, ',' ORDER BY p) AS parents FROM f GROUP BY 1""")
def merged_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.array(F.concat(F.lit("n"), (F.col("c_nationkey") % 5).cast("string")))
    terms = I.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("term"), own.alias("parents"))
    return L.merged_parents(terms, I.hierarchy(spark, sf_dir)[1]).withColumn("parents", F.array_join("parents", ","))


@query(f"WITH {I.HIERARCHY} SELECT e.child AS term, n_name || ' of ' || n_regionkey AS context FROM edges e JOIN nation ON e.parent = 'n' || n_nationkey")
def parent_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = I.table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("term"), F.concat("n_name", F.lit(" of "), F.col("n_regionkey").cast("string")).alias("definition"))
    return L.parent_context(I.hierarchy(spark, sf_dir)[1], told)


@query(f"WITH {I.HIERARCHY} SELECT term FROM nodes WHERE level = 2")
def terms_of_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.hierarchy(spark, sf_dir)[0].where("level = 2").select("term")


# --- mapping, caches, batches, columns


@query(f"""WITH {I.TERMS}, known AS (SELECT DISTINCT p_name AS term FROM part), v AS (SELECT DISTINCT term || 's' AS variation, term AS canonical FROM single), asked AS (SELECT term FROM terms UNION SELECT upper(p_name) || ' ' FROM part),
direct AS (SELECT lower(trim(term)) AS key, min(term) AS direct FROM (SELECT term FROM known UNION ALL SELECT term FROM single) GROUP BY 1),
across AS (SELECT lower(trim(variation)) AS key, min(direct) AS across FROM v JOIN direct ON direct.key = lower(trim(canonical)) GROUP BY 1)
SELECT a.term AS asked, coalesce(direct, across) AS target, CASE WHEN direct IS NOT NULL THEN 1 WHEN across IS NOT NULL THEN 2 END AS step FROM asked a LEFT JOIN direct d ON d.key = lower(trim(a.term)) LEFT JOIN across x ON x.key = lower(trim(a.term))""")
def mapping_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = I.table(spark, sf_dir, "part")
    single = part.select(F.explode(F.split("p_name", " ")).alias("term"))
    asked = I.terms(spark, sf_dir).select("term").union(part.select(F.concat(F.upper("p_name"), F.lit(" "))))
    known = part.select(F.col("p_name").alias("term")).union(single)
    return L.mapping_cascade(asked, known, single.select(F.concat("term", F.lit("s")).alias("variation"), F.col("term").alias("canonical")).distinct())


@query("""WITH t AS (SELECT DISTINCT replace(p_name, ' ', ' and ') || CASE WHEN p_size % 2 = 0 THEN ', other' ELSE '' END AS term FROM part), single AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part),
p AS (SELECT term, trim(unnest(string_split(replace(term, ' and ', ','), ','))) AS part FROM t)
SELECT term, count(*) AS parts, count(DISTINCT part) = count(DISTINCT word) AS removable FROM p LEFT JOIN single ON word = part GROUP BY 1 HAVING count(*) > 1""")
def compound_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = I.table(spark, sf_dir, "part")
    listed = F.concat(F.replace("p_name", F.lit(" "), F.lit(" and ")), F.when(F.col("p_size") % 2 == 0, ", other").otherwise(""))
    return L.compound_parts(part.select(listed.alias("term")).distinct(), part.select(F.explode(F.split("p_name", " ")).alias("term")))


@query("""SELECT event_type AS store, count(*) AS entries, count(*) FILTER (ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 DAY) AS unexpired, count(*) FILTER (NOT ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 DAY) AS expired,
round(sum(length(CAST(event_id AS VARCHAR))) / 1024.0::DOUBLE, 6) AS kilobytes FROM events GROUP BY 1""")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.table(spark, sf_dir, "events").select(F.col("event_type").alias("store"), F.col("event_id").cast("string").alias("payload"), "ts")
    return L.cache_stats(rows, "2024-01-20 00:00:00", 10).withColumn("kilobytes", F.round("kilobytes", 6))


@query("SELECT event_id AS pos, event_type, event_id // 100 AS batch FROM events WHERE event_id // 100 NOT IN (SELECT DISTINCT event_id // 100 FROM events WHERE event_type = 'error')")
def resumed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = I.table(spark, sf_dir, "events")
    done = events.where("event_type = 'error'").select(F.floor(F.col("event_id") / 100).cast("long").alias("batch"))
    return L.pending(events.select(F.col("event_id").alias("pos"), "event_type"), done, 100)


@query("""WITH n AS (SELECT user_id AS term, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT term, count(*) AS clusters, round(CASE WHEN count(*) > 1 THEN (min(n) / max(n)::DOUBLE + least(1.0::DOUBLE, count(*) / 4.0::DOUBLE)) / 2 ELSE 0 END, 9) AS separation FROM n GROUP BY 1""")
def cluster_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.table(spark, sf_dir, "events").select(F.col("user_id").alias("term"), F.pmod(F.xxhash64("event_type"), F.lit(1 << 40)).alias("cluster"))
    return L.separation(rows).withColumn("separation", F.round("separation", 9))


@query("""WITH s AS (SELECT o_custkey AS term, list(o_orderstatus || ' ') AS tags, avg(o_totalprice) / max(o_totalprice) AS separation FROM orders GROUP BY 1)
SELECT term, CASE WHEN len(tags) < 2 THEN 'too few senses' WHEN len(list_distinct(tags)) < len(tags) THEN 'tags not distinct' WHEN separation < 0.5 THEN 'poor separation' END AS reason FROM s""")
def checked_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("term")).agg(F.collect_list("o_orderstatus").alias("tags"), (F.avg("o_totalprice") / F.max("o_totalprice")).alias("separation"))
    return L.checked_splits(rows).select("term", "reason")


@query(r"""WITH p AS (SELECT page_id, regexp_replace(' ' || upper(left(url, 12)) || substr(url, 13) || '/#top', '^ +', '') AS u FROM pages), q AS (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, regexp_replace(regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*:', ''), '#.*$', '') AS rest FROM p)
SELECT page_id, CASE WHEN scheme = '' THEN 'https' ELSE scheme END || '://' || lower(regexp_extract(rest, '^//([^/?]*)', 1)) || regexp_replace(regexp_extract(rest, '^(?://[^/?]*)?([^?]*)', 1), '/+$', '')
|| CASE WHEN regexp_extract(rest, '\?(.*)$', 1) <> '' THEN '?' || regexp_extract(rest, '\?(.*)$', 1) ELSE '' END AS url FROM q""")
def normal_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.concat(F.lit(" "), F.upper(F.left("url", F.lit(12))), F.expr("substr(url, 13)"), F.lit("/#top"))
    return I.table(spark, sf_dir, "pages").select("page_id", L.normal_url(odd).alias("url"))


@query(r"""SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href="(https?://[^"]+)"', 1))), ' ') AS links FROM pages""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "pages").select("page_id", F.array_join(L.links(F.col("html")), " ").alias("links"))


@query("SELECT event_id, event_type || 'NameOf' || event_id AS name FROM events")
def camel_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "events").select("event_id", L.camel(F.concat("event_type", F.lit("_name_of_"), F.col("event_id").cast("string"))).alias("name"))


@query(r"""WITH t AS (SELECT p_partkey, p_name, string_split(lower(p_name), ' ') AS w, lower(p_brand || ' ' || p_type || ' ' || string_split(p_name, ' ')[1]) AS x FROM part)
SELECT p_partkey, round(CASE WHEN contains(x, lower(p_name)) THEN 1 ELSE len(list_intersect(list_distinct(w), list_distinct(string_split_regex(x, '\s+')))) / greatest(1, len(list_distinct(w)))::DOUBLE END, 9) AS overlap FROM t""")
def text_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", "p_brand", "p_type", F.get(F.split("p_name", " "), F.lit(0)))
    return I.table(spark, sf_dir, "part").select("p_partkey", F.round(L.text_overlap(F.col("p_name"), text), 9).alias("overlap"))

