"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word of the corpora: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; any file system that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text with null taken as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that all executors see.

    It is ``spark.checkpoint.dir`` of the session; only where that is unset, as in
    tests on one machine, a temporary folder takes its place.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not context.isDefined() and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        known = context.get() if context.isDefined() else tempfile.mkdtemp(prefix="lexiforge-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known


def materialise(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    This cuts the lineage, survives lost executors and lets several consumers read
    one result.  The table is removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: A key with more rows than this, and than all rows by ``HOT_KEYS``, is handled apart.
HOT_ROWS = 1000
#: Keys that can hold more than this share of the rows: their values are broadcast.
HOT_KEYS = 1000
#: Ids that are broadcast at most; more are joined by a shuffle.
SENT_IDS = 1_000_000


def hot_keys(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame | None:
    """The keys of ``rows`` that hold very many rows, ``HOT_KEYS`` at most, as a written table; None without any."""
    counts = materialise(rows.groupBy(*keys).agg(F.count("*").alias("__n")), f"{name}-counts")
    total, most = counts.agg(F.sum("__n"), F.max("__n")).first()
    limit = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    return materialise(counts.where(F.col("__n") > limit).drop("__n"), f"{name}-hot") if (most or 0) > limit else None


def attach(rows: DataFrame, values: DataFrame, keys: Sequence[str], hot: DataFrame | None) -> DataFrame:
    """``rows`` with the columns of ``values`` (a row for each key) added; null without an entry.

    The values of the keys in ``hot`` (``hot_keys``) are broadcast, so that their rows
    don't meet in one task; the others are joined by a shuffle.  Null keys match nothing.
    """
    if hot is None:
        return rows.join(values, list(keys), "left")
    sent = F.broadcast(hot.join(values, list(keys)))
    cold = rows.join(F.broadcast(hot), list(keys), "left_anti").join(values, list(keys), "left")
    return cold.unionByName(rows.join(sent, list(keys)))


def met(docs: DataFrame, found: DataFrame, on: Column, how: str = "left_semi", weight: Column | None = None) -> DataFrame:
    """``docs`` joined with ``found``, a written table, so that texts stay where they are if that can be.

    ``found`` is broadcast if it has at most ``SENT_IDS`` rows (or sum of ``weight``);
    beyond that the join shuffles.
    """
    count = found.agg(F.sum(weight) if weight is not None else F.count("*")).first()[0] or 0
    return docs.join(F.broadcast(found) if count <= SENT_IDS else found, on, how)


def with_ids(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of ``docs`` whose doc_id is (``left_anti``: isn't) in ``ids``, a written table with a column id; null counts."""
    return met(docs, ids.select(F.col("id").alias("__id")).distinct(), F.col("doc_id").eqNullSafe(F.col("__id")), how)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
