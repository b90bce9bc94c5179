"""JDBC sources and sinks.

Thin option builders over Spark's own JDBC data source: a full-table read,
a query read (the filter runs inside the database), a partitioned read
(``partitionColumn`` / bounds / ``numPartitions`` so each executor reads one
key range in parallel) and a batched parallel write. ``register_views``
exposes JDBC tables as temp views for federated ``spark.sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _reader(spark: SparkSession, url: str, props: dict | None):
    r = spark.read.format("jdbc").option("url", url)
    for k, v in (props or {}).items():
        r = r.option(k, v)
    return r


def read_table(spark: SparkSession, url: str, table: str, props: dict | None = None) -> DataFrame:
    """A3: a whole table by name (Catalyst still pushes filters and column pruning into the SQL)."""
    return _reader(spark, url, props).option("dbtable", table).load()


def read_query(spark: SparkSession, url: str, query: str, props: dict | None = None) -> DataFrame:
    """A4: the rows of a SQL query evaluated by the database."""
    return _reader(spark, url, props).option("query", query).load()


def read_partitioned(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int,
                     partitions: int, props: dict | None = None, fetchsize: int = 10000) -> DataFrame:
    """A5: parallel read in ``partitions`` key ranges of ``column`` between ``lower`` and ``upper``."""
    return (_reader(spark, url, props).option("dbtable", table).option("partitionColumn", column)
            .option("lowerBound", lower).option("upperBound", upper).option("numPartitions", partitions)
            .option("fetchsize", fetchsize).load())


def write(df: DataFrame, url: str, table: str, mode: str = "append", props: dict | None = None,
          batchsize: int = 1000, partitions: int | None = None) -> None:
    """Bulk load in batches of ``batchsize`` rows per statement from every partition in parallel."""
    d = df.repartition(partitions) if partitions else df
    w = d.write.format("jdbc").mode(mode).option("url", url).option("dbtable", table).option("batchsize", batchsize)
    for k, v in (props or {}).items():
        w = w.option(k, v)
    w.save()


def register_views(spark: SparkSession, url: str, tables: list[str], props: dict | None = None) -> None:
    """Expose database tables as temp views so ``spark.sql`` can join them with anything else."""
    for t in tables:
        read_table(spark, url, t, props).createOrReplaceTempView(t.split(".")[-1])
