"""Table operations (A8, A9, A11, A14-A21) on path-based parquet tables or catalog tables.

Everything is a DataFrame write/read; nothing is routed through the driver
except scalar counts. Row counts that accompany a write come from
``observe`` (counted while writing), not from a second scan.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixtures import path_exists


def exists(spark: SparkSession, name_or_path: str) -> bool:
    if "/" in name_or_path:
        return path_exists(spark, name_or_path)
    return spark.catalog.tableExists(name_or_path)


def read_table(spark: SparkSession, name_or_path: str) -> DataFrame:
    return spark.read.parquet(name_or_path) if "/" in name_or_path else spark.table(name_or_path)


def write_table(df: DataFrame, name_or_path: str, mode: str = "overwrite", partition_by: list[str] | None = None):
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if "/" in name_or_path:
        w.parquet(name_or_path)
    else:
        w.format("parquet").saveAsTable(name_or_path)


def copy_table(df: DataFrame, target: str, mode: str = "overwrite") -> int:
    """Read -> count -> save in one pass; the count is observed during the write."""
    obs = Observation("copy")
    write_table(df.observe(obs, F.count(F.lit(1)).alias("rows")), target, mode)
    return int(obs.get["rows"])


def append(df: DataFrame, target: str) -> int:
    """Append rows (partitioned parallel writers; no per-row statements)."""
    return copy_table(df, target, mode="append")


def create_if_absent(spark: SparkSession, target: str, schema: T.StructType) -> bool:
    """Idempotent create of an empty table with ``schema``; returns True when created."""
    if exists(spark, target):
        return False
    write_table(spark.createDataFrame([], schema), target, mode="overwrite")
    return True


def create_from_ddl(spark: SparkSession, ddl: str, name: str) -> bool:
    """A16 from DDL text (``CREATE TABLE IF NOT EXISTS ...``), whose column DEFAULTs the table keeps; True when created."""
    before = spark.catalog.tableExists(name)
    spark.sql(ddl)
    return not before


def insert_with_defaults(df: DataFrame, name: str) -> int:
    """A9 / A17 into a catalog table: columns that ``df`` lacks are filled with their DEFAULT, or null; returns the rows."""
    spark = df.sparkSession
    have = {c.lower() for c in df.columns}
    unknown = have - {c.lower() for c in spark.table(name).columns}
    if unknown:
        raise ValueError(f"{name} has no column {sorted(unknown)}")
    cols = [f.name for f in spark.table(name).schema.fields if f.name.lower() in have]
    obs = Observation("insert")
    view = f"_tidewell_insert_{uuid.uuid4().hex}"  # several tables may be filled at a time
    df.select(*cols).observe(obs, F.count(F.lit(1)).alias("rows")).createOrReplaceTempView(view)
    names = ", ".join(f"`{c}`" for c in cols)
    spark.sql(f"INSERT INTO {name} ({names}) SELECT {names} FROM {view}")
    spark.catalog.dropTempView(view)
    return int(obs.get["rows"])


def column_default(field: T.StructField) -> str | None:
    """The SQL text of a column's DEFAULT, as Spark keeps it in the column's metadata."""
    return (field.metadata or {}).get("CURRENT_DEFAULT")


def truncate(spark: SparkSession, target: str) -> dict:
    """Row count before, then an empty table with the same schema; missing -> table_not_found."""
    if not exists(spark, target):
        return {"table": target, "status": "table_not_found"}
    df = read_table(spark, target)
    before = df.count()
    empty = spark.createDataFrame([], df.schema)
    if "/" in target:
        write_table(empty, target, "overwrite")
    else:
        spark.sql(f"TRUNCATE TABLE {target}")
    return {"table": target, "status": "truncated", "rows_deleted": before}


def drop(spark: SparkSession, target: str) -> bool:
    """Drop if exists (catalog tables; path tables are removed through the Hadoop FS)."""
    if "/" not in target:
        spark.sql(f"DROP TABLE IF EXISTS {target}")
        return True
    if not exists(spark, target):
        return False
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    p = jvm.org.apache.hadoop.fs.Path(target)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True))  # noqa: SLF001


def inventory(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """Row count per named table; missing tables report ``not found`` (count null).

    One aggregate per existing table, unioned; parquet counts read footers only.
    """
    parts = []
    for name, loc in tables.items():
        if exists(spark, loc):
            parts.append(read_table(spark, loc).agg(F.count(F.lit(1)).alias("row_count"))
                         .select(F.lit(name).alias("table_name"), "row_count", F.lit("ok").alias("status")))
        else:
            parts.append(spark.range(1).select(F.lit(name).alias("table_name"),
                                               F.lit(None).cast("bigint").alias("row_count"),
                                               F.lit("not found").alias("status")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def count_status(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """Row count per named table, 0 for a missing one."""
    return inventory(spark, tables).select("table_name", F.coalesce("row_count", F.lit(0).cast("bigint")).alias("row_count"))


def describe(df: DataFrame) -> DataFrame:
    """Column, type, nullability, default and position of a table, plus its row count."""
    spark = df.sparkSession
    rows = [(i + 1, f.name, f.dataType.simpleString(), f.nullable, column_default(f)) for i, f in enumerate(df.schema.fields)]
    cols = spark.createDataFrame(rows, "position int, column_name string, data_type string, is_nullable boolean, column_default string")
    return cols.withColumn("row_count", df.select(F.count(F.lit(1))).scalar())


def sample_rows(df: DataFrame, limit: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """First ``limit`` rows with dates/timestamps as ISO text and decimals as doubles.

    With ``order_by`` the rows are the first by that key (reproducible); without it, any rows.
    """
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd" if isinstance(f.dataType, T.DateType) else "yyyy-MM-dd'T'HH:mm:ss")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    if order_by:
        return df.orderBy(*order_by).limit(limit).select(*out)
    return df.select(*out).limit(limit)


def upsert(target: DataFrame, updates: DataFrame, key: list[str]) -> DataFrame:
    """New version of ``target`` where rows of ``updates`` replace rows with the same key.

    Union with a version tag and keep the newest row per key (one shuffle on
    the key; ``max_by`` keeps it an aggregate, so a hot key is combined map-side).
    Among several updates of one key the row of the greatest hash wins, on every run.
    """
    cols = [c for c in target.columns if c not in key]
    u = (target.select(*key, *cols).withColumn("_v", F.lit(0))
         .unionByName(updates.select(*key, *cols).withColumn("_v", F.lit(1))))
    best = u.groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct("_v", F.xxhash64(*cols))).alias("_r"))
    return best.select(*key, "_r.*")
