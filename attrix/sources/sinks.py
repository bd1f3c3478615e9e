"""Sinks (S3, S5, S6): written tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_splits(df: DataFrame, path: str, split_col: str = "split") -> str:
    """S3: prepared table as parquet partitioned by split (readers prune to one split)."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """S3: CSV with header, no index column."""
    (df.write.mode("overwrite").option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def write_feature_matrix(df: DataFrame, path: str, features: str = "features") -> str:
    """(key, label, features array<double>) as parquet; vectors are stored as arrays."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import VectorUDT

    if isinstance(df.schema[features].dataType, VectorUDT):
        df = df.withColumn(features, vector_to_array(F.col(features)))
    df.write.mode("overwrite").parquet(path)
    return path


def write_json_report(df: DataFrame, path: str) -> str:
    """One JSON document per row (nested structs kept)."""
    df.write.mode("overwrite").json(path)
    return path
