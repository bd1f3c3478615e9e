"""Scans of the driver tables and of the attrition source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one driver table; projections and filters applied later reach the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_source(spark: SparkSession, path: str, schema: StructType, fmt: str = "csv") -> DataFrame:
    """Scan one source file with a fixed schema (no inference pass over the data)."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        return reader.option("header", True).option("mode", "PERMISSIVE").csv(path)
    if fmt == "json":
        return reader.option("multiLine", False).json(path)
    return reader.format(fmt).load(path)


def read_splits(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Read the prepared table, partition-pruned to one split when given."""
    df = spark.read.parquet(path)
    return df.where(df["split"] == split) if split is not None else df
