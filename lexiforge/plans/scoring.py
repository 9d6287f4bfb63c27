"""Queries of relevance, formats, keywords and reports, each with its SQL twin where SQL has the functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.operators import relevance as R
from lexiforge.plans import inputs as I
from lexiforge.plans import points as P

QUERIES: dict[str, P.Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a query under its name, with the SQL that gives the same rows, if there is one."""

    def register(f: P.Query) -> P.Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(None)
def web_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as terms; type and name are the title, first word and brand the snippet, all of them the content."""
    title, content = F.concat_ws(" ", "p_type", "p_name"), F.concat_ws(" ", "p_name", "p_type", "p_brand")
    score = R.relevance(F.col("p_name"), title, F.concat_ws(" ", F.get(F.split("p_name", " "), F.lit(0)), "p_brand"), content)
    return I.table(spark, sf_dir, "part").select("p_partkey", F.round(score, 9).alias("relevance"))


_CLEAN = r"list_filter(string_split_regex(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\s-]', ' ', 'g'), '\s+'), lambda w: w <> '')"


@query(f"""WITH t AS (SELECT doc_id, list_distinct({_CLEAN.format("lang || ' ' || source")}) AS x, {_CLEAN.format("text")} AS y FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL)
SELECT doc_id, round(least(1, len(list_filter(y, lambda w: list_contains(x, w))) / greatest(1, len(x))::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * least(1, 100::DOUBLE / greatest(1, len(y))))), 9) AS relevance FROM t""")
def content_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.table(spark, sf_dir, "documents").where("text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL")
    return docs.select("doc_id", F.round(R.content_relevance(F.concat_ws(" ", "lang", "source"), F.col("text")), 9).alias("relevance"))


@query(f"WITH {I.RESOURCES}, {P._ASKED}, m AS (SELECT term, avg(relevance) AS mean FROM resources GROUP BY 1) SELECT a, b, round(coalesce((x.mean + y.mean) / 2, 0), 9) AS relevance FROM asked LEFT JOIN m x ON x.term = a LEFT JOIN m y ON y.term = b")
def pair_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pair_relevance(P._asked(spark, sf_dir), I.resources(spark, sf_dir)).withColumn("relevance", F.round("relevance", 9))


@query(f"WITH {P._ASKED}, s AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS term, l_returnflag || l_suppkey AS source FROM lineitem) SELECT a, b, (SELECT count(*) FROM s x JOIN s y USING (source) WHERE x.term = a AND y.term = b) AS shared FROM asked")
def shared_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = I.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("term"), F.concat("l_returnflag", F.col("l_suppkey").cast("string")).alias("source"))
    return R.shared_sources(P._asked(spark, sf_dir), sources)


_ODD = "CASE p_size % 6 WHEN 0 THEN '' WHEN 1 THEN '-' || p_name WHEN 2 THEN replace(p_name, ' ', '  ') WHEN 3 THEN repeat(p_name || ' ', 12) WHEN 4 THEN '&' ELSE p_name END"


@query(rf"""WITH t AS (SELECT p_partkey, {_ODD} AS term FROM part), f AS (SELECT p_partkey, list_filter([CASE WHEN trim(term) = '' THEN 'empty_term' END, CASE WHEN length(term) < 2 THEN 'too_short' END,
CASE WHEN length(term) > 100 THEN 'too_long' END, CASE WHEN trim(term) LIKE '-%' OR trim(term) LIKE '%-' THEN 'leading_trailing_hyphen' END, CASE WHEN contains(term, '  ') THEN 'multiple_spaces' END,
CASE WHEN regexp_matches(term, '^\W+$') THEN 'only_special_chars' END], lambda x: x IS NOT NULL) AS i FROM t)
SELECT p_partkey, array_to_string(i, ' ') AS issues, len(list_filter(i, lambda x: x NOT IN ('leading_trailing_hyphen', 'multiple_spaces'))) = 0 AS is_valid_format FROM f""")
def format_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.table(spark, sf_dir, "part").select("p_partkey", F.expr(_ODD).alias("term")).withColumn("i", R.format_issues(F.col("term")))
    return rows.select("p_partkey", F.array_join("i", " ").alias("issues"), R.valid_format(F.col("i")).alias("is_valid_format"))


@query("""WITH r AS (SELECT user_id AS term, event_type AS mode, count(*) AS n FROM events GROUP BY 1, 2)
SELECT term, string_agg(mode || ': ' || n || ' of them', '; ' ORDER BY mode) AS errors FROM r GROUP BY 1""")
def collected_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("term"), F.col("event_type").alias("mode")).agg(F.count("*").alias("n"))
    rows = rows.select("term", "mode", F.array(F.concat(F.col("n").cast("string"), F.lit(" of them")), F.lit(None).cast("string")).alias("errors"))
    return R.collected_errors(rows).select("term", F.array_join("errors", "; ").alias("errors"))


_WANTED = ("wiki", "page", "data", "body", "html", "href")


@query(f"""WITH w AS (SELECT page_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT page_id, regexp_extract_all(lower(html), '[a-z]{{4,}}') AS w FROM pages)),
g AS (SELECT page_id, word, row_number() OVER (PARTITION BY page_id ORDER BY count(*) DESC, min(i)) AS place FROM w GROUP BY 1, 2)
SELECT page_id, string_agg(word, ' ' ORDER BY place) AS keywords FROM g WHERE place <= 25 AND word IN {_WANTED} GROUP BY 1""")
def page_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = I.table(spark, sf_dir, "pages").select(F.col("page_id").alias("term"), F.col("html").alias("content"))
    return R.top_keywords(pages, keywords=_WANTED).select(F.col("term").alias("page_id"), F.array_join("keywords", " ").alias("keywords"))


@query(f"""WITH RECURSIVE {I.COMPONENTS}, s AS (SELECT component, count(*) AS size FROM comp GROUP BY 1 ORDER BY size DESC, component LIMIT 5), n AS (SELECT component, size, term, row_number() OVER (PARTITION BY component ORDER BY term) AS nth FROM comp JOIN s USING (component))
SELECT size, string_agg(term, ', ' ORDER BY term) AS terms FROM n WHERE nth <= 5 GROUP BY component, size""")
def largest_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.largest_components(P._mapped(spark, sf_dir)[0]).select("size", "terms")
