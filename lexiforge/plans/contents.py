"""Queries on contents, answers and pair tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions import text as T
from lexiforge.functions import urls as U
from lexiforge.operators import contents
from lexiforge.plans import inputs as I

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(r"""SELECT doc_id, CASE WHEN length(text) <= 400 THEN text WHEN 400 - length(regexp_extract(left(text, 400), '[^,}\]]*$', 0)) > 360 THEN left(text, 400 - length(regexp_extract(left(text, 400), '[^,}\]]*$', 0))) ELSE left(text, 400) END AS context FROM documents""")
def truncate_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "documents").select("doc_id", contents.truncate(F.col("text"), 400).alias("context"))


@query(r"""WITH f AS (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[ \t\n\r]+', ' ', 'g')) AS t FROM pages)
SELECT page_id, CASE WHEN length(t) <= 1000 THEN t ELSE left(t, 333) || ' ... ' || substr(t, length(t) // 2 - 166 + 1, 333) || ' ... ' || right(t, 333) END AS content FROM f""")
def informative_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "pages").select("page_id", contents.informative(F.col("html")).alias("content"))


@query("""WITH r AS (SELECT source AS term, text AS content, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents)
SELECT term, string_agg(content, ' | ' ORDER BY rank) AS content FROM r WHERE rank <= 5 GROUP BY 1""")
def top_resource_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.table(spark, sf_dir, "documents").select(F.col("source").alias("term"), F.col("doc_id").alias("pos"), F.col("n_chars").cast("double").alias("score"), F.col("text").alias("content"))
    return contents.top_contents(rows, 5, " | ")


_ANSWER = "a AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Yes (high) - ' || event_type WHEN 1 THEN 'no, low' WHEN 2 THEN 'invalid - ' || event_type ELSE 'Yes' END AS answer FROM events)"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 4
    answer = F.when(kind == 0, F.concat(F.lit("Yes (high) - "), "event_type")).when(kind == 1, "no, low").when(kind == 2, F.concat(F.lit("invalid - "), "event_type")).otherwise("Yes")
    return I.table(spark, sf_dir, "events").select("event_id", "event_type", answer.alias("answer"))


@query(f"""WITH {_ANSWER} SELECT event_id, regexp_matches(lower(answer), 'yes|true|valid|correct') AS verdict, lower(answer) LIKE 'yes%' AS is_valid,
CASE WHEN contains(lower(answer), 'high') THEN 0.9::DOUBLE WHEN contains(lower(answer), 'medium') THEN 0.7::DOUBLE WHEN contains(lower(answer), 'low') THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END AS confidence,
CASE WHEN contains(answer, '-') THEN trim(regexp_extract(answer, '-(.*)$', 1)) ELSE '' END AS reason FROM a""")
def verdict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _answers(spark, sf_dir)
    return rows.select("event_id", contents.verdict(F.col("answer")).alias("verdict"), contents.parsed_verdict(F.col("answer")).alias("v")).select("event_id", "verdict", "v.*")


@query("SELECT event_id, event_id % 2 = 0 AS is_duplicate, 0.25::DOUBLE AS confidence, event_type AS reason FROM events")
def verdict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("event_id") % 2 == 0, "true").otherwise("false")
    answer = F.concat(F.lit('Sure:\n```json\n{"is_duplicate": '), flag, F.lit(', "confidence": 0.25, "reason": "'), "event_type", F.lit('"}\n```'))
    return I.table(spark, sf_dir, "events").select("event_id", contents.json_verdict(answer).alias("v")).select("event_id", "v.*")


@query("SELECT doc_id // 20 AS batch, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def batch_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contents.batches(I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos")), 20)
    return rows.groupBy("batch").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"


@query(f"""WITH r AS (SELECT 't' || (page_id % 40) AS term, {_HOST} AS host FROM pages), n AS (SELECT term, count(*) AS n FROM r GROUP BY 1),
p AS (SELECT x.term AS term1, y.term AS term2, sum(CASE WHEN contains(x.host, '.edu') AND contains(y.host, '.edu') THEN 1.2 WHEN contains(x.host, '.org') AND contains(y.host, '.org') THEN 1.1 WHEN contains(x.host, '.gov') AND contains(y.host, '.gov') THEN 1.1 ELSE 0 END) AS mass FROM r x JOIN r y ON x.term < y.term GROUP BY 1, 2)
SELECT term1, term2, round(least(1.0::DOUBLE, mass::DOUBLE / least(x.n, y.n)), 6) AS weight FROM p JOIN n x ON x.term = term1 JOIN n y ON y.term = term2 WHERE mass::DOUBLE / least(x.n, y.n) > 0.5""")
def edges_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.pages(spark, sf_dir).select(F.concat(F.lit("t"), (F.col("pos") % 40).cast("string")).alias("term"), U.host(F.col("url")).alias("host"))
    return contents.domain_edges(rows).withColumn("weight", F.round("weight", 6))


_PAIRS = f"""{I.RESOURCES}, keys AS (SELECT DISTINCT term, url FROM resources), s AS (SELECT term, count(*)::DOUBLE AS size FROM keys GROUP BY 1), t AS (SELECT count(DISTINCT url)::DOUBLE AS t FROM keys),
m AS (SELECT x.term AS a, y.term AS b, count(*) AS n FROM keys x JOIN keys y ON x.url = y.url AND x.term < y.term GROUP BY 1, 2 HAVING count(*) >= 2),
j AS (SELECT a, b, n, x.size AS sa, y.size AS sb, t FROM m JOIN s x ON x.term = a JOIN s y ON y.term = b, t),
measured AS (SELECT a, b, n, n / sb AS p_a_b, n / sa AS p_b_a, n / t * log2(n * t / (sa * sb)) + CASE WHEN sa > n THEN (sa - n) / t * log2((sa - n) * t / (sa * (t - sb))) ELSE 0 END
  + CASE WHEN sb > n THEN (sb - n) / t * log2((sb - n) * t / ((t - sa) * sb)) ELSE 0 END + (t - sa - sb + n) / t * log2((t - sa - sb + n) * t / ((t - sa) * (t - sb))) AS information FROM j)"""


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = I.resources(spark, sf_dir).select("term", "url").distinct()
    sizes = keys.groupBy("term").agg(F.count("*").alias("size"))
    both = keys.alias("x").join(keys.alias("y"), "url").where("x.term < y.term").groupBy(F.col("x.term").alias("a"), F.col("y.term").alias("b")).agg(F.count("*").alias("n")).where("n >= 2")
    return contents.pair_measures(both, sizes, keys.select("url").distinct().count())


@query(f"WITH {_PAIRS} SELECT a, b, n, round(p_a_b, 6) AS p_a_b, round(p_b_a, 6) AS p_b_a, round(information, 7) AS information FROM measured")
def pair_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _measured(spark, sf_dir)
    return out.select("a", "b", "n", F.round("p_a_b", 6).alias("p_a_b"), F.round("p_b_a", 6).alias("p_b_a"), F.round("information", 7).alias("information"))


@query(f"WITH {_PAIRS} SELECT count(*) AS pairs, round(avg(n), 6) AS mean_n, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (least(p_a_b, p_b_a) <= 0.1) AS seldom, round(max(least(p_a_b, p_b_a)), 6) AS strongest FROM measured")
def pair_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contents.pair_overview(_measured(spark, sf_dir))
    return out.withColumn("mean_n", F.round("mean_n", 6)).withColumn("strongest", F.round("strongest", 6))


@query(r"""WITH d AS (SELECT lang || ' (' || doc_id || ')' AS term, lang AS base, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS w FROM documents)
SELECT x.term, round(max(len(list_intersect(x.w, y.w)) / greatest(1, len(list_distinct(list_concat(x.w, y.w))))::DOUBLE), 6) AS likeness FROM d x JOIN d y ON x.base = y.base AND x.term <> y.term
GROUP BY 1 HAVING max(len(list_intersect(x.w, y.w)) / greatest(1, len(list_distinct(list_concat(x.w, y.w))))::DOUBLE) >= 0.8""")
def split_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.table(spark, sf_dir, "documents").select(F.concat("lang", F.lit(" ("), F.col("doc_id").cast("string"), F.lit(")")).alias("term"), F.col("text").alias("content"))
    return contents.split_siblings(rows).withColumn("likeness", F.round("likeness", 6))


@query("""WITH i AS (SELECT c_mktsegment AS term, c_custkey AS pos, n_name AS item FROM customer JOIN nation ON c_nationkey = n_nationkey), f AS (SELECT term, lower(item) AS low, min(pos) AS pos, min_by(item, pos) AS item FROM i GROUP BY 1, 2)
SELECT term, pos, item, rank FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY pos) AS rank FROM f) WHERE rank <= 10""")
def mined_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.table(spark, sf_dir, "customer").join(I.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return contents.mined_items(rows.select(F.col("c_mktsegment").alias("term"), F.col("c_custkey").alias("pos"), F.col("n_name").alias("item")), 10)


@query("SELECT vec_id, len(embedding) AS length, array_to_string(list_transform(embedding[1:5], lambda x: CAST(CAST(round(x::DOUBLE * 10000) AS BIGINT) AS VARCHAR)), ',') AS head FROM embeddings")
def vector_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contents.vector_summary(I.table(spark, sf_dir, "embeddings"))


@query(f"WITH {I.TERMS} SELECT term, sha256(lower(term) || ':rule,web') AS key, upper(left(term, 1)) || substr(term, 2) AS capital FROM terms")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.terms(spark, sf_dir).select("term", T.cache_key(F.col("term"), ("web", "rule")).alias("key"), T.first_upper(F.col("term")).alias("capital"))


@query("SELECT event_id, lower(event_type || '_name_of') || event_id AS name FROM events")
def snake_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    camel = F.concat("event_type", F.lit("NameOf"), F.col("event_id").cast("string"))
    return I.table(spark, sf_dir, "events").select("event_id", T.snake(camel).alias("name"))


@query()
def level_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contents.level_sample(I.hierarchy(spark, sf_dir)[0], 25)


@query()
def term_variations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.terms(spark, sf_dir).select("term", F.explode(T.variations(F.col("term"))).alias("form"))
