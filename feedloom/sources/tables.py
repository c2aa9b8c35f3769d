"""Readers for the input tables (one parquet file/folder per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedloom.session import path_exists

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    """``name.parquet`` (file or folder) or the folder ``name``, on any file system that Spark reads."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    return path if path_exists(spark, path) else path.removesuffix(".parquet")


_SCANS: dict = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; Catalyst prunes columns and pushes filters into it.

    The scan (file listing and footer schema) is set up once per session and
    path, like a registered table; every query still reads the files.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _SCANS:
        _SCANS[key] = spark.read.parquet(table_path(spark, sf_dir, name))
    return _SCANS[key]
