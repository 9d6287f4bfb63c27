"""All registered queries over the provided tables, with their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.functions import text as T
from lexiforge.functions import urls as U
from lexiforge.operators import ambiguity, dedup, frequency, graph, hierarchy, metadata, metrics, mining, pairs, validate, vectors
from lexiforge.plans import contents, points, scoring
from lexiforge.plans import inputs as I

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    """Name -> query over (spark, folder of the tables)."""
    return _QUERIES | contents.QUERIES | points.QUERIES | scoring.QUERIES


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL giving the same rows."""
    return _SQL | contents.SQL | points.SQL | scoring.SQL


# --- frequency filters

_FREQ = "freq AS (SELECT lower(concept) AS norm, count(DISTINCT source) AS frequency FROM concepts GROUP BY 1)"
_SHARE = "lim AS (SELECT greatest(1, ceil(count(DISTINCT source)::DOUBLE * 0.6::DOUBLE)) AS least FROM concepts)"


@query(f"""WITH {I.CONCEPTS}, {_FREQ}, {_SHARE}, places AS (SELECT source, min(pos) AS spot FROM concepts GROUP BY 1),
spelled AS (SELECT lower(concept) AS norm, arg_min(concept, (spot, pos)) AS spelling FROM concepts JOIN places USING (source) GROUP BY 1)
SELECT pos, source, spelling AS concept, frequency FROM concepts JOIN freq ON lower(concept) = freq.norm JOIN spelled ON spelled.norm = freq.norm, lim
WHERE frequency >= least""")
def freq_institutional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.institutional(I.concepts(spark, sf_dir), 0.6)


@query(f"""WITH {I.CONCEPTS}, freq AS (SELECT lower(concept) AS norm, count(DISTINCT lang) AS frequency FROM concepts GROUP BY 1)
SELECT pos, lang AS institution, concept, frequency FROM concepts JOIN freq ON lower(concept) = norm
WHERE frequency >= (SELECT greatest(1, ceil(count(DISTINCT lang)::DOUBLE * 0.6::DOUBLE)) FROM concepts)""")
def freq_level0(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.concepts(spark, sf_dir).withColumn("source", F.concat_ws(" - ", "lang", "source"))
    return frequency.level0(rows, 60)


@query(f"""WITH {I.CONCEPTS}, {_FREQ} SELECT pos, source, concept, frequency FROM concepts JOIN freq ON lower(concept) = norm
WHERE frequency >= (SELECT greatest(2, floor(count(DISTINCT source)::DOUBLE * 0.1::DOUBLE)) FROM concepts)""")
def freq_venue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.venue(I.concepts(spark, sf_dir))


@query(f"WITH {I.CONCEPTS}, {_FREQ}, {_SHARE} SELECT norm, frequency FROM freq, lim WHERE frequency >= least AND frequency >= 15")
def freq_min_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.concepts(spark, sf_dir)
    return frequency.kept(rows, frequency.share_limit(rows, 0.6), min_frequency=15)


@query(f"WITH {I.CONCEPTS}, {_FREQ} SELECT frequency, count(*) AS concepts FROM freq GROUP BY 1")
def freq_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.histogram(I.concepts(spark, sf_dir))


@query(f"""WITH {I.CONCEPTS}, u AS (SELECT DISTINCT lower(concept) AS norm, source FROM concepts)
SELECT norm, count(*) AS frequency, array_to_string(list_sort(list(source))[1:5], '; ') AS sources, count(*) >= 12 AS included FROM u GROUP BY norm""")
def freq_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.audit(I.concepts(spark, sf_dir), 12)


@query(r"""WITH l AS (SELECT c_custkey AS pos, CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE c_mktsegment || ' - sub - ' || c_name END AS line FROM customer)
SELECT pos, CASE WHEN line LIKE '% - %' THEN regexp_extract(line, '^(.*) - (.*)$', 1) ELSE 'generic' END AS source,
CASE WHEN line LIKE '% - %' THEN regexp_extract(line, '^(.*) - (.*)$', 2) ELSE line END AS concept FROM l""")
def pair_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")).otherwise(F.concat("c_mktsegment", F.lit(" - sub - "), "c_name"))
    return frequency.parse_pairs(I.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), line.alias("line")))


@query(f"WITH {I.CONCEPTS} SELECT lower(concept) AS norm, count(*) AS n FROM concepts GROUP BY 1")
def valid_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.concepts(spark, sf_dir).groupBy(F.lower("concept").alias("norm")).agg(F.count("*").alias("n"))


@query(r"""WITH r AS (SELECT CAST(conv_id AS VARCHAR) AS source, turn, unnest(list_distinct(regexp_extract_all(lower(text), '\p{L}{5,}'))) AS norm FROM conversations WHERE role = 'assistant'),
a AS (SELECT source, count(DISTINCT turn) AS attempts FROM r GROUP BY 1), v AS (SELECT source, norm, count(*) AS votes FROM r GROUP BY 1, 2)
SELECT source, norm, votes FROM v JOIN a USING (source) WHERE attempts = 1 OR votes >= 2""")
def agreement_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{5,}"), F.lit(0)))
    rows = I.table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return frequency.agreement(rows.select(F.col("conv_id").cast("string").alias("source"), F.col("turn").alias("attempt"), F.explode(words).alias("concept")), 2)


@query("SELECT n_name, count(DISTINCT c_custkey) AS items FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY items DESC, n_name LIMIT 10")
def top_institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.table(spark, sf_dir, "customer").join(I.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return frequency.top_groups(rows, "n_name", "c_custkey", 10)


@query("SELECT lower(n_name) AS institution, string_agg(DISTINCT lower(c_mktsegment), '|' ORDER BY lower(c_mktsegment)) AS colleges FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def colleges_per_institution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.table(spark, sf_dir, "customer").join(I.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    segments = F.array_join(F.array_sort(F.collect_set(F.lower(F.trim("c_mktsegment")))), "|")
    return rows.groupBy(F.lower("n_name").alias("institution")).agg(segments.alias("colleges"))


# --- terms

@query(f"WITH {I.TERMS} SELECT term, CASE WHEN len(string_split(term, ' ')) = 1 THEN 'single' ELSE 'multi' END AS kind FROM terms")
def single_multi_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(T.words(F.regexp_replace("term", r"[^\p{L}\p{N}_\s\p{Z}-]", "")))
    return I.terms(spark, sf_dir).select("term", F.when(n == 1, "single").otherwise("multi").alias("kind"))


@query("""SELECT norm, min_by(term, ord * 1000000 + p_partkey) AS term FROM (SELECT lower(p_name) AS norm, p_name AS term, p_partkey, 0 AS ord FROM part WHERE p_size < 20
UNION ALL SELECT lower(p_name), upper(p_name), p_partkey, 1 FROM part WHERE p_size >= 10) GROUP BY norm""")
def verified_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = I.table(spark, sf_dir, "part")
    a = part.where("p_size < 20").select(F.col("p_name").alias("term"), F.col("p_partkey").alias("pos"), F.lit(0).alias("ord"))
    b = part.where("p_size >= 10").select(F.upper("p_name"), "p_partkey", F.lit(1))
    return a.union(b).groupBy(F.lower("term").alias("norm")).agg(F.min_by("term", F.struct("ord", "pos")).alias("term"))


_LEMMA = "CASE WHEN {0} LIKE '%ies' AND length({0}) > 3 THEN left({0}, length({0}) - 3) || 'y' WHEN {0} LIKE '%es' AND length({0}) > 2 THEN left({0}, length({0}) - 2) WHEN {0} LIKE '%s' AND length({0}) > 1 AND {0} NOT LIKE '%ss' THEN left({0}, length({0}) - 1) ELSE {0} END"


@query(f"WITH {I.TERMS} SELECT term, array_to_string(list_transform(string_split(lower(term), ' '), lambda w: {_LEMMA.format('w')}), ' ') AS lemma FROM terms")
def lemma_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.terms(spark, sf_dir).select("term", T.lemmatised(F.col("term")).alias("lemma"))


@query(f"""WITH {I.TERMS}, s AS (SELECT term, lower(term) AS w, {_LEMMA.format('lower(term)')} AS one FROM terms WHERE term NOT LIKE '% %')
SELECT term, array_to_string(list_sort(list_distinct([term, CASE WHEN one <> w THEN one WHEN regexp_matches(term, 'y$') THEN left(term, length(term) - 1) || 'ies'
WHEN regexp_matches(term, '(s|x|z|ch|sh)$') THEN term || 'es' ELSE term || 's' END])), '|') AS forms FROM s""")
def plural_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.terms(spark, sf_dir).where(~F.contains("term", F.lit(" ")))
    return rows.select("term", F.array_join(T.plural_forms(F.col("term")), "|").alias("forms"))


@query(f"""WITH {I.TERMS} SELECT term, array_to_string(list_sort(list_distinct([term, replace(term, ' ', '-'), replace(term, '-', ' ')])), '|') AS forms FROM terms""")
def dash_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.terms(spark, sf_dir).select("term", F.array_join(T.dash_forms(F.col("term")), "|").alias("forms"))


@query("""SELECT term, CASE WHEN term LIKE '%colour%' THEN replace(term, 'colour', 'color') || '|' || term ELSE term END AS forms
FROM (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN 'colour ' ELSE '' END || p_name AS term FROM part)""")
def spelling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    term = F.concat(F.when(F.col("p_size") % 2 == 0, "colour ").otherwise(""), "p_name")
    rows = I.table(spark, sf_dir, "part").select(term.alias("term")).distinct()
    return rows.select("term", F.array_join(T.spelling_forms(F.col("term")), "|").alias("forms"))


@query(f"""WITH {I.TERMS}, {I.CONCEPTS}, every AS (SELECT term FROM terms UNION SELECT concept FROM concepts),
c AS (SELECT term, lower(term) AS b, string_split(lower(term), ' ') AS w FROM every),
k AS (SELECT term, length(b) >= 2 AS c1, length(b) <= 100 AS c2, regexp_matches(b, '[a-z]') AS c3, b NOT IN ({", ".join(f"'{w}'" for w in T.BLACKLIST)}) AS c4,
  NOT regexp_matches(b, '^[0-9]+$') AS c5, CASE WHEN len(w) = 1 THEN length(b) >= 3 ELSE len(w) <= 10 AND (len(list_distinct(w)) = len(w) OR len(list_distinct(w)) / len(w) >= 0.6) END AS c6 FROM c)
SELECT term, c1::INT + c2::INT + c3::INT + c4::INT + c5::INT + c6::INT AS passed_checks, c1 AND c3 AND c4 AND c5 AS is_valid FROM k""")
def rule_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = I.terms(spark, sf_dir).select("term").union(I.concepts(spark, sf_dir).select("concept"))
    return validate.rules(every)


# --- validation

@query(f"""WITH {I.RESOURCES}, s AS (SELECT term, count(*) AS total, count(*) FILTER (score >= 0.5) AS verified, count(*) FILTER (score >= 0.5 AND relevance >= 0.5) AS relevant,
  count(*) FILTER (score >= 0.7 AND relevance >= 0.5) AS high_quality FROM resources GROUP BY 1)
SELECT CAST(p_partkey AS VARCHAR) AS term, coalesce(total, 0) AS total, coalesce(verified, 0) AS verified, coalesce(relevant, 0) AS relevant, coalesce(high_quality, 0) AS high_quality,
round(coalesce(least(1.0::DOUBLE, 0.3::DOUBLE * verified / total + 0.4::DOUBLE * relevant / greatest(1, verified) + 0.3::DOUBLE * high_quality / total + CASE WHEN high_quality >= 3 THEN 0.1::DOUBLE ELSE 0 END), 0), 6) AS confidence,
coalesce(relevant >= 1, false) AS is_valid FROM part LEFT JOIN s ON term = CAST(p_partkey AS VARCHAR)""")
def web_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = I.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("term"))
    return validate.web(terms, I.resources(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH {I.RESOURCES}, r AS (SELECT * FROM resources WHERE score > 0.9), n AS (SELECT p_partkey, (SELECT count(*) FROM r WHERE term = CAST(p_partkey AS VARCHAR)) AS n FROM part)
SELECT count(*) AS n_terms, count(*) FILTER (n > 0) AS n_covered, round((count(*) FILTER (n > 0))::DOUBLE / count(*), 9) AS rate, round(avg(n) FILTER (n > 0), 9) AS mean_resources FROM n""")
def web_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = I.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("term"))
    out = validate.coverage(terms, I.resources(spark, sf_dir).where("score > 0.9"))
    return out.withColumn("rate", F.round("rate", 9)).withColumn("mean_resources", F.round("mean_resources", 9))


@query(f"""WITH {I.DETECTIONS}, w AS (SELECT *, CASE method WHEN 'label' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM detections)
SELECT term, round(sum(weight * confidence) / sum(weight), 6) AS confidence, max_by(method, (confidence, method)) AS best_mode, (count(*) FILTER (is_valid)) * 2 > count(*) AS majority FROM w GROUP BY 1""")
def combine_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.detections(spark, sf_dir).withColumnRenamed("method", "mode")
    return validate.combined(rows, {"label": 0.3, "length": 0.5}).withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {I.DETECTIONS} SELECT count(*) AS n, count(*) FILTER (is_valid) AS n_valid, round((count(*) FILTER (is_valid))::DOUBLE / count(*), 6) AS valid_rate, round(avg(confidence), 6) AS mean_confidence FROM detections")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validate.summary(I.detections(spark, sf_dir))
    return out.withColumn("valid_rate", F.round("valid_rate", 6)).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("""WITH k AS (SELECT CAST(user_id AS VARCHAR) AS term, event_type, ts FROM events), f AS (SELECT * FROM k WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 DAY)
SELECT DISTINCT k.term, CASE WHEN k.term IN (SELECT term FROM f WHERE event_type = 'error') THEN 'rejected' WHEN k.term IN (SELECT term FROM f WHERE event_type = 'view') THEN 'cached' ELSE 'uncached' END AS state FROM k""")
def cache_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), "event_type", "ts")
    as_of = "2024-01-20 00:00:00"
    recent = lambda kind: validate.unexpired(rows.where(F.col("event_type") == kind), as_of, 10)
    return validate.cache_partition(rows.select(F.col("key").alias("term")), recent("error"), recent("view"), as_of)


@query("SELECT CAST(user_id AS VARCHAR) AS key, max_by(event_type, (ts, event_type)) AS payload, max(ts) AS ts FROM events GROUP BY 1")
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("payload"), "ts", "event_id")
    return validate.cache_upsert(rows.where("event_id % 2 = 0").drop("event_id"), rows.where("event_id % 2 = 1").drop("event_id"))


# --- edges

@query()
def edges_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.compound_edges(I.terms(spark, sf_dir))


@query(f"""WITH {I.TERMS}, p AS (SELECT s.term AS a, s.pos AS p, l.term AS b, l.pos AS q FROM terms s JOIN terms l ON s.term = upper(left(string_split(l.term, ' ')[1], 1) || left(string_split(l.term, ' ')[2], 1))
WHERE l.term LIKE '% %' AND s.term = upper(s.term))
SELECT CASE WHEN p < q THEN a ELSE b END AS src, CASE WHEN p < q THEN b ELSE a END AS dst, 0.95::DOUBLE AS weight, 'acronym' AS edge_type FROM p""")
def edges_acronym(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.acronym_edges(I.terms(spark, sf_dir))


@query(f"""WITH {I.TERMS}, p AS (SELECT s.term AS a, s.pos AS p, l.term AS b, l.pos AS q FROM terms s JOIN terms l ON s.term IN ('RB', 'BG') AND ((s.term = 'RB' AND l.term LIKE '%red bolt%') OR (s.term = 'BG' AND l.term LIKE '%blue gear%')))
SELECT CASE WHEN p < q THEN a ELSE b END AS src, CASE WHEN p < q THEN b ELSE a END AS dst, 0.9::DOUBLE AS weight, 'synonym' AS edge_type FROM p""")
def edges_synonym(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.synonym_edges(I.terms(spark, sf_dir), (("RB", "red bolt"), ("BG", "blue gear")))


@query()
def edges_text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.text_edges(I.terms(spark, sf_dir))


@query()
def edges_rule_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.upsert(pairs.rule_edges(I.terms(spark, sf_dir)))


_MET = f"WITH {I.RESOURCES}, keys AS (SELECT DISTINCT term, url FROM resources), met AS (SELECT x.term AS a, y.term AS b, count(*) AS overlap FROM keys x JOIN keys y ON x.url = y.url AND x.term < y.term GROUP BY 1, 2)"


@query(f"{_MET} SELECT * FROM met WHERE overlap >= 2")
def edges_url_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.overlap_pairs(I.resources(spark, sf_dir), 2)


@query(f"{_MET} SELECT * FROM met WHERE overlap = 1")
def llm_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.overlap_pairs(I.resources(spark, sf_dir), 1, 2)


@query(f"""{_MET}, m AS (SELECT term, avg(relevance) AS mean FROM resources GROUP BY 1)
SELECT a, b, overlap, round(least(1.0, (x.mean + y.mean) / 2 + 0.1::DOUBLE * overlap), 9) AS weight FROM met JOIN m x ON x.term = a JOIN m y ON y.term = b WHERE overlap >= 2 AND (x.mean + y.mean) / 2 >= 0.3""")
def edges_web_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.web_overlap_edges(I.resources(spark, sf_dir)).withColumn("weight", F.round("weight", 9))


@query(r"""WITH w AS (SELECT item_id AS pos, list_filter(list_distinct(string_split_regex(lower(text), '[\s]+')), lambda x: x <> '') AS w FROM benchmark)
SELECT x.pos AS pos1, y.pos AS pos2, len(list_intersect(x.w, y.w)) AS shared, len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w)))::DOUBLE AS weight
FROM w x JOIN w y ON x.pos < y.pos WHERE len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w)))::DOUBLE >= 0.05""")
def edges_content_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), "text")
    return pairs.content_edges(rows, 0.05)


@query(f"WITH {I.GRAPH} SELECT a, b, weight FROM edges WHERE weight >= 0.6")
def weak_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.strong(I.graph(spark, sf_dir)[1], 0.6)


@query(f"""WITH {I.RESOURCES}, e AS (SELECT least(term, url) AS a, greatest(term, url) AS b, score AS weight, CASE WHEN relevance >= 0.5 THEN 'content' ELSE 'domain' END AS edge_type, score * 1000 + relevance AS ord FROM resources)
SELECT a, b, max_by(weight, (ord, weight, edge_type)) AS weight, max_by(edge_type, (ord, weight, edge_type)) AS edge_type FROM e GROUP BY 1, 2""")
def edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("relevance") >= 0.5, "content").otherwise("domain")
    rows = I.resources(spark, sf_dir).select(F.col("term").alias("src"), F.col("url").alias("dst"), F.col("score").alias("weight"), kind.alias("edge_type"), (F.col("score") * 1000 + F.col("relevance")).alias("ord"))
    return pairs.upsert(rows)


# --- graph

@query(f"WITH RECURSIVE {I.COMPONENTS} SELECT term, component FROM comp")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(*I.graph(spark, sf_dir))


_SCORE = """deg AS (SELECT x AS term, count(*) AS degree, sum(weight) AS weights FROM (SELECT a AS x, weight FROM edges UNION ALL SELECT b, weight FROM edges) GROUP BY 1),
scored AS (SELECT n.term, level, component, coalesce(degree, 0) AS degree, (10 - level) * 100 + coalesce(degree, 0) * 10 + coalesce(weights, 0) * 5 - length(n.term) * 0.5::DOUBLE + 3 AS score
  FROM nodes n JOIN comp USING (term) LEFT JOIN deg ON deg.term = n.term),
best AS (SELECT component, min_by(term, (-score, term)) AS canonical FROM scored GROUP BY 1), mapped AS (SELECT term, level, component, canonical FROM scored JOIN best USING (component))"""


@query(f"WITH RECURSIVE {I.COMPONENTS}, {_SCORE} SELECT term, level, degree, score FROM scored")
def canonical_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.scores(*I.graph(spark, sf_dir))


@query(f"WITH RECURSIVE {I.COMPONENTS}, {_SCORE} SELECT * FROM mapped")
def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.canonical(*I.graph(spark, sf_dir))


@query(f"WITH RECURSIVE {I.COMPONENTS}, {_SCORE}, o AS (SELECT component, min_by(term, (level, length(term), term)) AS owner FROM mapped GROUP BY 1) SELECT term, level, owner AS canonical FROM mapped JOIN o USING (component)")
def level_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.level_priority(graph.canonical(*I.graph(spark, sf_dir)))


@query(f"WITH RECURSIVE {I.COMPONENTS}, {_SCORE} SELECT term, canonical, level AS owner_level FROM (SELECT *, min(level) OVER (PARTITION BY canonical) AS low FROM mapped) WHERE level = low")
def cross_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cross_level(graph.canonical(*I.graph(spark, sf_dir)))


@query(f"WITH RECURSIVE {I.COMPONENTS}, {_SCORE} SELECT canonical, string_agg(term, '|' ORDER BY term) AS members, count(*) AS size FROM mapped GROUP BY 1")
def canonical_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.groups(graph.canonical(*I.graph(spark, sf_dir)))


@query(f"""WITH RECURSIVE {I.COMPONENTS}, s AS (SELECT component, count(*) AS n FROM comp GROUP BY 1)
SELECT sum(n)::BIGINT AS n_nodes, count(*) AS n_components, count(*) FILTER (n = 1) AS n_single, max(n) AS largest, avg(n) AS mean_size, (SELECT count(*) FROM edges) AS n_edges FROM s""")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.summary(*I.graph(spark, sf_dir))


@query(f"WITH {I.GRAPH}, {I.ENDS} SELECT 'isolated' AS fault, term AS item FROM nodes WHERE term NOT IN (SELECT x FROM ends)")
def graph_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.faults(*I.graph(spark, sf_dir))


@query(f"WITH {I.GRAPH}, {I.ENDS} SELECT x AS term, count(*) AS degree, string_agg(y, '|' ORDER BY y) AS neighbours FROM ends GROUP BY 1")
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(I.graph(spark, sf_dir)[1])


@query(f"""WITH {I.TERMS}, l AS (SELECT DISTINCT lower(term) AS t FROM terms)
SELECT DISTINCT y.t AS canonical, x.t AS variation FROM l x JOIN l y ON y.t = x.t || 's' OR (x.t LIKE '%y' AND y.t = left(x.t, length(x.t) - 1) || 'ies')""")
def dedup_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.basic(I.terms(spark, sf_dir))


# --- URLs and contents

_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"


@query(r"""WITH a AS (SELECT page_id AS pos, url, string_split(rtrim(regexp_replace(replace(replace(url, 'https://', ''), 'http://', ''), '^www\.', ''), '/'), '#')[1] AS bare FROM pages),
b AS (SELECT *, string_split(bare, '?')[1] AS base, list_filter(string_split(substr(bare, length(string_split(bare, '?')[1]) + 2), '&'), lambda p: NOT regexp_matches(lower(p), 'utm_|ref=|source=')) AS kept FROM a)
SELECT pos, lower(CASE WHEN contains(bare, '?') AND len(kept) > 0 THEN base || '?' || array_to_string(kept, '&') ELSE base END) AS normal FROM b""")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.pages(spark, sf_dir).select("pos", U.normalise(F.col("url")).alias("normal"))


@query(f"SELECT page_id AS pos, {_HOST} AS host, string_split({_HOST}, '.')[-2] AS domain, string_split({_HOST}, '.')[-1] AS tld FROM pages")
def url_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.pages(spark, sf_dir).select("pos", U.host(F.col("url")).alias("host"), U.domain(F.col("url")).alias("domain"), U.tld(F.col("url")).alias("tld"))


@query(f"SELECT page_id AS pos, url FROM pages WHERE regexp_matches({_HOST}, '(^|\\.)(edu|ac|org|gov)$') OR regexp_matches({_HOST}, 'university|college|institute')")
def url_academic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.pages(spark, sf_dir).where(U.is_valid(F.col("url")) & U.is_academic(F.col("url"))).select("pos", "url")


@query(f"SELECT url, min(page_id) AS pos, CASE WHEN {_HOST} LIKE '%.org' THEN 0 WHEN {_HOST} LIKE '%.net' THEN 1 ELSE 2 END AS rank FROM pages GROUP BY url")
def url_prioritize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.prioritise(I.pages(spark, sf_dir), (".org", ".net"))


_KEYS = ("paper", "title", "html", "nav", "script", "article", "footer")
_QUALITY = f"least(length(html) / 1000.0::DOUBLE, 1.0) * 0.4::DOUBLE + least(({' + '.join(f'contains(lower(html), {k!r})::INT' for k in _KEYS)}) / 5.0::DOUBLE, 1.0) * 0.4::DOUBLE + CASE WHEN regexp_matches({_HOST}, '(^|\\.)(edu|ac|org|gov)$') THEN 0.2::DOUBLE ELSE 0 END"


@query(f"SELECT page_id AS pos, round(least({_QUALITY}, 1.0), 6) AS quality FROM pages")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.pages(spark, sf_dir).select("pos", F.round(mining.quality(F.col("content"), F.col("url"), _KEYS), 6).alias("quality"))


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'conference') OR contains(lower(text), 'proceedings') THEN 'conference' WHEN contains(lower(text), 'syllabus') OR contains(lower(text), 'curriculum') THEN 'course'
WHEN contains(lower(text), 'journal') OR contains(lower(text), 'doi') THEN 'journal' WHEN contains(lower(text), 'lecture') OR contains(lower(text), 'notes') THEN 'lecture_notes' ELSE 'article' END AS kind FROM documents""")
def content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "documents").select("doc_id", T.content_type(F.col("text")).alias("kind"))


@query(r"SELECT doc_id, nullif(regexp_extract(text, '(?:19|20)\d{2}', 0), '') AS year, nullif(regexp_extract(text, '(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+', 0), '') AS doi FROM documents")
def citation_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "documents").select("doc_id", T.year(F.col("text")).alias("year"), T.doi(F.col("text")).alias("doi"))


_OCC = " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{k}', ''))) // {len(k)}" for k in ("tion", "the", "ment"))


@query(f"SELECT doc_id, round(CASE WHEN length(text) = 0 OR ({_OCC}) = 0 THEN 0 ELSE least(({_OCC}) / (length(text) / 250.0::DOUBLE), 1.0) END, 6) AS relevance FROM documents")
def relevance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = mining.relevance(F.col("text"), ("tion",), ("the", "ment"))
    return I.table(spark, sf_dir, "documents").select("doc_id", F.round(value, 6).alias("relevance"))


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM documents), n AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY 1, 2)
SELECT doc_id, word, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS r FROM n) WHERE r <= 10""")
def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = I.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word"))
    n = words.groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("n"), "word")
    return n.withColumn("r", F.row_number().over(order)).where("r <= 10").drop("r")


@query(f"""WITH f AS (SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1)
SELECT count(*) AS n, count(DISTINCT url) AS urls, round(avg(least(least(length(html) / 1000.0::DOUBLE, 1.0) * 0.4::DOUBLE + least(({' + '.join(f'contains(lower(html), {k!r})::INT' for k in mining.KEYWORDS)}) / 5.0::DOUBLE, 1.0) * 0.4::DOUBLE
+ CASE WHEN regexp_matches({_HOST}, '(^|\\.)(edu|ac|org|gov)$') THEN 0.2::DOUBLE ELSE 0 END, 1.0)), 6) AS mean_quality FROM f""")
def mining_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.aggregate(I.pages(spark, sf_dir)).withColumn("mean_quality", F.round("mean_quality", 6))


@query(f"SELECT {_HOST} AS host, count(*) AS n, round(avg(length(html)), 6) AS mean_length, median(length(html))::DOUBLE AS median_length FROM pages GROUP BY 1")
def domain_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.by_domain(I.pages(spark, sf_dir)).withColumn("mean_length", F.round("mean_length", 6))


# --- metadata

_SOURCED = """d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Department of ' || source || ' (main) - north' WHEN 1 THEN 'College of ' || lang || ' department' WHEN 2 THEN '"' || source || '!"' ELSE source END AS s FROM documents)"""


def _sourced(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 4
    s = (
        F.when(kind == 0, F.concat(F.lit("Department of "), "source", F.lit(" (main) - north")))
        .when(kind == 1, F.concat(F.lit("College of "), "lang", F.lit(" department")))
        .when(kind == 2, F.concat(F.lit('"'), "source", F.lit('!"')))
        .otherwise(F.col("source"))
    )
    return I.table(spark, sf_dir, "documents").select("doc_id", s.alias("s"))


@query(rf"""WITH {_SOURCED} SELECT doc_id, trim(regexp_replace(regexp_replace(lower(CASE WHEN s LIKE '"%"' THEN s[2:-2] ELSE s END), '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '\s+', ' ', 'g')) AS parent FROM d""")
def meta_clean_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sourced(spark, sf_dir).select("doc_id", T.clean_parent(F.col("s")).alias("parent"))


@query(rf"""WITH {_SOURCED} SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lower(regexp_extract(s, 'of (\S+)', 1)) WHEN 1 THEN lower(regexp_extract(s, 'of (\S+)', 1)) END AS concept, doc_id % 4 < 2 AS department FROM d""")
def meta_concept_from_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sourced(spark, sf_dir).select("doc_id", T.concept_of_source(F.col("s")).alias("concept"), T.is_department(F.col("s")).alias("department"))


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.table(spark, sf_dir, "customer").join(I.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("n_name").alias("term"), F.col("c_mktsegment").alias("source"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"))


_META = "meta AS (SELECT n_name AS term, c_mktsegment AS source, 'r' || n_regionkey AS parent FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query(f"WITH {_META} SELECT term, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, string_agg(DISTINCT parent, '|' ORDER BY parent) AS parents FROM meta GROUP BY 1")
def meta_consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.consolidate(_meta(spark, sf_dir))


@query(f"WITH {_META} SELECT CASE WHEN term LIKE '%1' THEN 'merged' ELSE term END AS term, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, string_agg(DISTINCT parent, '|' ORDER BY parent) AS parents FROM meta GROUP BY 1")
def meta_merge_variations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _meta(spark, sf_dir)
    variations = rows.where(F.col("term").endswith("1")).select(F.col("term").alias("variation"), F.lit("merged").alias("canonical")).distinct()
    return metadata.consolidate(metadata.merge_variations(rows, variations))


@query(f"WITH {_META} SELECT term, bool_or(parent IN ('r0', 'r2')) AS promoted FROM meta GROUP BY 1")
def meta_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = I.table(spark, sf_dir, "region").where("r_regionkey in (0, 2)").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("parent"))
    return metadata.promote(_meta(spark, sf_dir), known)


@query(f"WITH {_META}, s AS (SELECT term, count(DISTINCT source) AS s, count(DISTINCT parent) AS p FROM meta GROUP BY 1) SELECT count(*) AS n_terms, count(*) FILTER (p > 0) AS with_parents, avg(s) AS mean_sources, avg(p) AS mean_parents FROM s")
def meta_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.summary(_meta(spark, sf_dir))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS term, CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE 'new ' || n_regionkey END AS definition FROM nation")
def definitions_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = I.table(spark, sf_dir, "nation")
    term = F.col("n_nationkey").cast("string").alias("term")
    old = nation.where("n_nationkey < 20").select(term, F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).otherwise(" ").alias("definition"))
    late = F.when((F.col("n_nationkey") % 3 == 0) & (F.col("n_nationkey") >= 20), F.col("n_name")).otherwise(F.concat(F.lit("new "), F.col("n_regionkey").cast("string")))
    return metadata.fill_definitions(old, nation.select(term, late.alias("definition")))


# --- hierarchy

@query(f"WITH {I.HIERARCHY} SELECT DISTINCT e.parent, e.child, c.level FROM edges e JOIN nodes c ON c.term = e.child JOIN nodes p ON p.term = e.parent WHERE p.level < c.level")
def hier_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = I.hierarchy(spark, sf_dir)
    parents = edges.groupBy(F.col("child").alias("term")).agg(F.collect_set("parent").alias("parents"))
    return hierarchy.build(nodes.join(parents, "term", "left").withColumn("parents", F.coalesce("parents", F.array().cast("array<string>"))))


@query(f"WITH {I.HIERARCHY} SELECT term, level FROM nodes WHERE level > 0 AND term NOT IN (SELECT child FROM edges)")
def hier_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.orphans(*I.hierarchy(spark, sf_dir))


@query(f"WITH {I.HIERARCHY} SELECT term, level FROM nodes WHERE term NOT IN (SELECT parent FROM edges)")
def hier_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.leaves(*I.hierarchy(spark, sf_dir))


@query(f"WITH {I.HIERARCHY} SELECT level, round(avg(n), 9) AS branching FROM kids GROUP BY 1")
def hier_branching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.branching(*I.hierarchy(spark, sf_dir)).withColumn("branching", F.round("branching", 9))


@query(f"""WITH {I.HIERARCHY}, m AS (SELECT p.level AS upper, count(DISTINCT e.parent) AS parents, count(DISTINCT e.child) AS children FROM edges e JOIN nodes p ON p.term = e.parent JOIN nodes c ON c.term = e.child WHERE c.level = p.level + 1 GROUP BY 1)
SELECT upper, parents, children, round(parents / (SELECT count(*) FROM nodes WHERE level = upper)::DOUBLE, 9) AS parent_share, round(children / (SELECT count(*) FROM nodes WHERE level = upper + 1)::DOUBLE, 9) AS child_share FROM m""")
def hier_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hierarchy.connectivity(*I.hierarchy(spark, sf_dir))
    return out.withColumn("parent_share", F.round("parent_share", 9)).withColumn("child_share", F.round("child_share", 9))


@query(f"""WITH {I.HIERARCHY} SELECT k.level, count(*) AS terms, count(*) FILTER (k.level > 0 AND k.term NOT IN (SELECT child FROM edges)) AS orphans, count(*) FILTER (n = 0) AS leaves, round(avg(n), 9) AS branching FROM kids k GROUP BY 1""")
def hier_level_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.level_summary(*I.hierarchy(spark, sf_dir)).withColumn("branching", F.round("branching", 9))


@query(f"""WITH {I.HIERARCHY}, m AS (SELECT *, avg(n) OVER (PARTITION BY level) AS mean FROM kids)
SELECT 'orphan' AS issue, term FROM nodes WHERE level > 0 AND term NOT IN (SELECT child FROM edges)
UNION ALL SELECT 'wide', term FROM m WHERE mean > 0 AND n > 3 * mean UNION ALL SELECT 'narrow', term FROM m WHERE mean > 0 AND n > 0 AND 3 * n < mean""")
def hier_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.issues(*I.hierarchy(spark, sf_dir))


@query(f"""WITH RECURSIVE {I.HIERARCHY}, walk(source, term, length) AS (SELECT term, term, 0 FROM nodes WHERE level = 0 UNION ALL SELECT w.source, e.child, w.length + 1 FROM walk w JOIN edges e ON e.parent = w.term),
p AS (SELECT source, term, count(*) AS n, avg(length) AS mean, max(length) AS most FROM walk WHERE length > 0 GROUP BY 1, 2)
SELECT level, count(*) AS pairs, CAST(sum(n) AS BIGINT) AS paths, avg(mean) AS mean_length, max(most) AS max_length FROM p JOIN nodes USING (term) GROUP BY 1""")
def hier_path_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.path_lengths(*I.hierarchy(spark, sf_dir))


_RANK = """s AS (SELECT CAST(c_nationkey AS VARCHAR) AS child, CAST(c_custkey AS VARCHAR) AS parent, 1 + round(c_acctbal / 1000) AS score FROM customer)"""


@query(f"WITH {_RANK}, r AS (SELECT *, row_number() OVER (PARTITION BY child ORDER BY score DESC, parent) AS rank FROM s) SELECT child, parent, score, rank FROM r WHERE rank <= 3 AND score >= 2")
def parent_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("child"), F.col("c_custkey").cast("string").alias("parent"), (1 + F.round(F.col("c_acctbal") / 1000)).alias("score"))
    return hierarchy.rank_parents(rows).select("child", "parent", "score", "rank")


@query("""WITH n AS (SELECT n_name AS term, n_regionkey FROM nation), s AS (SELECT DISTINCT n_name AS term, c_mktsegment || (c_custkey % 7) AS source FROM customer JOIN nation ON c_nationkey = n_nationkey),
c AS (SELECT x.term, y.term AS sibling, (SELECT count(*) FROM s a JOIN s b ON a.source = b.source WHERE a.term = x.term AND b.term = y.term) AS common FROM n x JOIN n y ON x.n_regionkey = y.n_regionkey AND x.term <> y.term)
SELECT term, sibling, common, rank FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY common DESC, sibling) AS rank FROM c) WHERE rank <= 10""")
def siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = I.table(spark, sf_dir, "nation")
    edges = nation.select(F.col("n_regionkey").cast("string").alias("parent"), F.col("n_name").alias("child"))
    rows = I.table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    shared = rows.select(F.col("n_name").alias("term"), F.concat("c_mktsegment", (F.col("c_custkey") % 7).cast("string")).alias("source"))
    return hierarchy.siblings(edges, shared)


@query(f"WITH {I.TERMS} SELECT term, length(term) % 4 AS level, lower(term) = 'red' AS exact FROM terms WHERE contains(lower(term), 'red') ORDER BY exact DESC, level, term LIMIT 50")
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = I.terms(spark, sf_dir).select("term", (F.length("term") % 4).alias("level"))
    return hierarchy.search(nodes, "red")


# --- vectors

_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"
_NEAR = f"""near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0))"""


def _near(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    rows = I.table(spark, sf_dir, "embeddings")
    return vectors.nearest(rows.where("vec_id % 50 = 0"), rows, k)


@query(f"WITH {_NEAR} SELECT query_id, vec_id, round(sim, 6) AS similarity, rank FROM near WHERE rank <= 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, 10).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {_NEAR}, s AS (SELECT query_id, label, sum(sim / rank) AS score FROM near JOIN embeddings USING (vec_id) WHERE rank <= 50 GROUP BY 1, 2)
SELECT query_id, label, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS place FROM s) WHERE place <= 3""")
def related_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors.related(_near(spark, sf_dir, 50), I.table(spark, sf_dir, "embeddings"), 3)
    return out.withColumn("score", F.round("score", 6))


@query(f"SELECT a.vec_id AS query_id, b.vec_id, round({_COS}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id WHERE {_COS} >= 0.3")
def map_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.table(spark, sf_dir, "embeddings")
    return vectors.pairs_above(rows, rows.where("vec_id % 50 = 0"), 0.3).withColumn("similarity", F.round("similarity", 6))


@query()
def dbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.cluster_groups(I.table(spark, sf_dir, "embeddings"), "label", 1.2, 3)


# --- ambiguity and metrics

@query("""WITH w AS (SELECT DISTINCT lang AS term, source AS parent, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS word FROM documents), z AS (SELECT term, parent, count(*) AS n FROM w GROUP BY 1, 2),
b AS (SELECT x.term, x.parent AS p, y.parent AS q, count(*) AS n FROM w x JOIN w y ON x.term = y.term AND x.word = y.word AND x.parent < y.parent GROUP BY 1, 2, 3),
i AS (SELECT x.term, coalesce(b.n, 0) / (x.n + y.n - coalesce(b.n, 0))::DOUBLE AS j FROM z x JOIN z y ON x.term = y.term AND x.parent < y.parent LEFT JOIN b ON b.term = x.term AND b.p = x.parent AND b.q = y.parent)
SELECT term, round(1 - avg(j), 6) AS divergence, count(*) FILTER (j < 0.5) AS divergent_pairs, (SELECT count(*) FROM z WHERE z.term = i.term) AS parents FROM i GROUP BY term""")
def parent_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("word")
    rows = I.table(spark, sf_dir, "documents").select(F.col("lang").alias("term"), F.col("source").alias("parent"), words)
    return ambiguity.parent_divergence(rows).withColumn("divergence", F.round("divergence", 6))


@query(f"WITH {I.DETECTIONS} SELECT term, round(1 - product(1 - confidence), 6) AS confidence FROM detections GROUP BY 1 HAVING 1 - product(1 - confidence) >= 0.5")
def noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ambiguity.noisy_or(I.detections(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {I.DETECTIONS} SELECT term, min_by(method, (-confidence, method)) AS method, round(max(confidence), 6) AS confidence FROM detections GROUP BY 1")
def combine_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ambiguity.union_best(I.detections(spark, sf_dir)).select("term", "method", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {I.DETECTIONS} SELECT term, min_by(method, (-confidence, method)) AS method, round(max(confidence), 6) AS confidence FROM detections GROUP BY 1 HAVING count(DISTINCT method) = 2")
def combine_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ambiguity.intersection_best(I.detections(spark, sf_dir), 2).select("term", "method", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {I.DETECTIONS} SELECT term, round(avg(confidence), 6) AS confidence, string_agg(DISTINCT method, ',' ORDER BY method) AS methods FROM detections GROUP BY 1")
def combine_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ambiguity.weighted_union(I.detections(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query("""SELECT p_partkey, round(CASE WHEN c < 2 THEN 0 ELSE greatest(0, least(1, CASE c WHEN 2 THEN 0.6 WHEN 3 THEN 0.7 ELSE 0.8 END + CASE WHEN s > 0 THEN s * 0.2 ELSE s * 0.1 END + CASE WHEN p_size >= 10 THEN 0.1 WHEN p_size >= 5 THEN 0.05 ELSE -0.1 END)) END::DOUBLE, 6) AS clusters,
round(least(1, CASE WHEN c + 2 = 2 THEN 0.6 WHEN c + 2 = 3 THEN 0.75 ELSE least(0.9, 0.75 + (c - 1) * 0.05) END * CASE WHEN p_size / 50.0 > 0.8 THEN 0.7 WHEN p_size / 50.0 > 0.6 THEN 0.9 ELSE 1 END * CASE WHEN s > 0 THEN 1 + s * 0.2 ELSE 1 END)::DOUBLE, 6) AS global
FROM (SELECT p_partkey, p_size, p_size % 6 AS c, (p_size % 11 - 5) / 5.0::DOUBLE AS s FROM part)""")
def confidence_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = F.col("p_size") % 6, (F.col("p_size") % 11 - 5) / 5.0
    return I.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.round(ambiguity.cluster_confidence(c, s, F.col("p_size")), 6).alias("clusters"),
        F.round(ambiguity.global_confidence(c + 2, F.col("p_size") / 50.0, s), 6).alias("global"),
    )


@query("""WITH n AS (SELECT lang AS term, hash_bucket AS cluster, count(*) AS size FROM (SELECT lang, CAST(substr(source, 4) AS INT) % 5 AS hash_bucket FROM documents) GROUP BY 1, 2)
SELECT term, cluster, size, round(size / sum(size) OVER (PARTITION BY term), 9) AS share, count(*) OVER (PARTITION BY term) AS clusters FROM n""")
def term_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    cluster = (F.substring("source", 4, 9).cast("int") % 5).alias("cluster")
    rows = I.table(spark, sf_dir, "documents").select(F.col("lang").alias("term"), cluster)
    return ambiguity.distribution(rows).withColumn("share", F.round("share", 9))


@query("""WITH g AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark), p AS (SELECT item_id, list_distinct(regexp_extract_all(lower(left(text, length(text) // 2)), '[a-z]+')) AS w FROM benchmark)
SELECT item_id, round(CASE WHEN len(g.w) + len(p.w) = 0 THEN 1 ELSE 2.0 * len(list_intersect(g.w, p.w)) / (len(g.w) + len(p.w)) END::DOUBLE, 6) AS f1 FROM g JOIN p USING (item_id)""")
def f1_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    half = F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    return I.table(spark, sf_dir, "benchmark").select("item_id", F.round(metrics.f1(words(F.col("text")), words(half)), 6).alias("f1"))


@query("SELECT event_type AS operation, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def op_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.by_operation(I.table(spark, sf_dir, "events"))
    return out.withColumn("total", F.round("total", 4)).withColumn("mean", F.round("mean", 6))


@query("SELECT event_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.recent(I.table(spark, sf_dir, "events")).select("event_id", "event_type", "value")


@query()
def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.train_validation(I.table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
