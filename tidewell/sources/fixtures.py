"""Readers for the parquet tables the library works on.

Each table is one parquet dataset below a directory. Reads are lazy, so
Catalyst prunes columns and pushes filters into the scan of whatever the
query uses; nothing is cached here.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


class Tables:
    """Attribute access to the tables of one directory: ``t.lineitem``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> DataFrame:
        # one lazy DataFrame per table (a plan, not data): repeated use shares the listing and footer read
        if name not in self._frames:
            self._frames[name] = read(self.spark, self.sf_dir, name)
        return self._frames[name]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, on whatever store it names (any failure of the store is raised)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001 - Hadoop's file system
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))  # noqa: SLF001


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register each table that exists as a temp view under its own name (for ``spark.sql``)."""
    for n in names:
        if path_exists(spark, table_path(sf_dir, n)):
            read(spark, sf_dir, n).createOrReplaceTempView(n)
