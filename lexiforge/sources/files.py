"""File sources and sinks: lines, pairs, JSON, CSV, graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, comment: str | None = None) -> DataFrame:
    """(pos, line) of trimmed lines that aren't blank, nor comments if ``comment`` is their mark.

    ``pos`` grows within a file in the order of its lines.
    """
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), F.trim("value").alias("line")).where("line != ''")
    return rows if comment is None else rows.where(~F.col("line").startswith(comment))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON with a given schema; a corrupt file gives null columns."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row for each JSON line."""
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a given schema."""
    return spark.read.schema(schema).csv(path, header=True, escape='"')


def read_sheets(frames: Sequence[DataFrame], columns: Sequence[str] = ("institution", "department_path")) -> DataFrame:
    """Union of sheets (already read) with the wanted columns; rows without a path are dropped."""
    out = None
    for frame in frames:
        if set(columns) <= set(frame.columns):
            part = frame.select(*columns).dropna(subset=[columns[-1]])
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no sheet has the columns " + ", ".join(columns))
    return out


def write_lines(rows: DataFrame, path: str, *columns: str, separator: str = " - ") -> None:
    """One text line for each row."""
    rows.select(F.concat_ws(separator, *columns).alias("value")).write.mode("overwrite").text(path)


def write_results(rows: DataFrame, path: str, kind: str = "json") -> None:
    """json lines, csv (columns sorted) or parquet."""
    writer = rows.select(*sorted(rows.columns)).write.mode("overwrite")
    if kind == "csv":
        writer.csv(path, header=True, escape='"')
    else:
        writer.format(kind).save(path)


def redact(rows: DataFrame, urls: bool = False, metadata: bool = True) -> DataFrame:
    """Without URL columns, and without the map column metadata or its entries that hold URLs."""
    out = rows if urls else rows.drop("url", "source_url")
    if "metadata" not in out.columns:
        return out
    if not metadata:
        return out.drop("metadata")
    clean = F.map_filter("metadata", lambda k, v: ~(F.lower(k).rlike("url|link") | F.coalesce(v.rlike("^https?://"), F.lit(False))))
    return out if urls else out.withColumn("metadata", clean)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as Parquet tables."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges."""
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def append_failures(rows: DataFrame, path: str) -> None:
    """Failures (module, error_type, message, date) appended by date."""
    rows.write.mode("append").partitionBy("date").parquet(path)


def read_failures(spark: SparkSession, path: str, date: str) -> DataFrame:
    """Failures of one date; other dates aren't read."""
    return spark.read.parquet(path).where(F.col("date") == date)
