"""The provided tables as inputs of the operators, and the same in SQL.

documents are source-concept pairs and contents, part names are terms, orders that
parts share are URLs, region to customer is a hierarchy, events are operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the provided tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, source, lang, concept): the valid words of all documents in their order."""
    words = F.posexplode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("i", "concept")
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", words)
    rows = rows.select((F.col("doc_id") * 1_000_000 + F.col("i") + 1).alias("pos"), "source", "lang", "concept")
    return rows.where(T.valid_concept(F.col("concept"), 3))


STOP = ", ".join(f"'{w}'" for w in T.NON_ACADEMIC)
CONCEPTS = rf"""concepts AS (
  SELECT doc_id * 1000000 + i AS pos, source, lang, concept FROM (
    SELECT doc_id, source, lang, unnest(w) AS concept, generate_subscripts(w, 1) AS i
    FROM (SELECT doc_id, source, lang, regexp_extract_all(text, '\p{{L}}+') AS w FROM documents))
  WHERE length(concept) BETWEEN 3 AND 100 AND lower(concept) NOT IN ({STOP}))"""


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, term): part names, their single words, and capitals of some, in order."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("term"))
    words = names.select(F.explode(F.split("term", " ")).alias("term"))
    short = names.select(T.initials(F.col("term")).alias("term"))
    every = names.union(words).union(short).union(words.select(F.concat("term", F.lit("s")))).distinct()
    return every.withColumn("pos", F.row_number().over(Window.orderBy("term")))


TERMS = """names AS (SELECT p_name AS term FROM part), single AS (SELECT unnest(string_split(term, ' ')) AS term FROM names),
terms AS (SELECT term, row_number() OVER (ORDER BY term) AS pos FROM (
  SELECT term FROM names UNION SELECT term FROM single UNION SELECT term || 's' FROM single
  UNION SELECT upper(left(string_split(term, ' ')[1], 1) || left(string_split(term, ' ')[2], 1)) FROM names))"""


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, url, score, relevance): parts, and the orders they are in."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("term"),
        F.col("l_orderkey").cast("string").alias("url"),
        (F.col("l_quantity") / 50).alias("score"),
        (F.col("l_discount") * 10).alias("relevance"),
    )


RESOURCES = """resources AS (SELECT CAST(l_partkey AS VARCHAR) AS term, CAST(l_orderkey AS VARCHAR) AS url,
  l_quantity / 50 AS score, l_discount * 10 AS relevance FROM lineitem)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, url, content): all pages."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("pos"), "url", F.col("html").alias("content"))


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (term, level) and edges (a, b, weight): parts that share two orders or more; level by size."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("term"), (F.col("p_size") % 4).alias("level"))
    keys = resources(spark, sf_dir).select("term", "url").distinct()
    met = keys.alias("x").join(keys.alias("y"), "url").where("x.term < y.term").groupBy(F.col("x.term").alias("a"), F.col("y.term").alias("b"))
    edges = met.agg(F.count("*").alias("n")).where("n >= 2").select("a", "b", F.least(F.lit(1.0), F.col("n") / 4).alias("weight"))
    return part, edges


GRAPH = f"""{RESOURCES}, keys AS (SELECT DISTINCT term, url FROM resources),
nodes AS (SELECT CAST(p_partkey AS VARCHAR) AS term, p_size % 4 AS level FROM part),
edges AS (SELECT a, b, least(1.0, CAST(n AS DOUBLE) / 4) AS weight FROM (
  SELECT x.term AS a, y.term AS b, count(*) AS n FROM keys x JOIN keys y ON x.url = y.url AND x.term < y.term GROUP BY 1, 2) WHERE n >= 2)"""
ENDS = "ends AS (SELECT a AS x, b AS y FROM edges UNION SELECT b, a FROM edges)"
#: Components by recursion over (root, member) pairs of a component's least members.
COMPONENTS = f"""{GRAPH}, {ENDS}, reach(root, term) AS (
  SELECT term, term FROM nodes UNION SELECT r.root, e.y FROM reach r JOIN ends e ON e.x = r.term),
comp AS (SELECT term, min(root) AS component FROM reach GROUP BY term)"""


def hierarchy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (term, level) and edges (parent, child): regions, nations, customers, their orders."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    key = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    nodes = (
        region.select(key("r", "r_regionkey").alias("term"), F.lit(0).alias("level"))
        .union(nation.select(key("n", "n_nationkey"), F.lit(1)))
        .union(customer.select(key("c", "c_custkey"), F.lit(2)))
        .union(orders.select(key("o", "o_orderkey"), F.lit(3)))
    )
    edges = (
        nation.select(key("r", "n_regionkey").alias("parent"), key("n", "n_nationkey").alias("child"))
        .union(customer.select(key("n", "c_nationkey"), key("c", "c_custkey")))
        .union(orders.select(key("c", "o_custkey"), key("o", "o_orderkey")))
    )
    return nodes, edges


HIERARCHY = """nodes AS (SELECT 'r' || r_regionkey AS term, 0 AS level FROM region UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation
  UNION ALL SELECT 'c' || c_custkey, 2 FROM customer UNION ALL SELECT 'o' || o_orderkey, 3 FROM orders),
edges AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
kids AS (SELECT n.term, n.level, count(DISTINCT e.child) AS n FROM nodes n LEFT JOIN edges e ON e.parent = n.term GROUP BY 1, 2)"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, method, confidence, is_valid): labels and lengths of documents as verdicts of two detectors."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("term"), F.lit("label").alias("method"), (0.4 + 0.3 * F.col("quality")).alias("confidence"), (F.col("quality") == 1).alias("is_valid")
    )
    length = F.least(F.lit(1.0), F.col("n_chars") / 4096.0)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string"), F.lit("length"), length, length >= 0.25)
    return labels.union(docs)


DETECTIONS = """detections AS (SELECT CAST(doc_id AS VARCHAR) AS term, 'label' AS method, 0.4::DOUBLE + 0.3::DOUBLE * quality AS confidence, quality = 1 AS is_valid FROM labels
  UNION ALL SELECT CAST(doc_id AS VARCHAR), 'length', least(1.0::DOUBLE, n_chars / 4096.0::DOUBLE), least(1.0::DOUBLE, n_chars / 4096.0::DOUBLE) >= 0.25 FROM documents)"""
