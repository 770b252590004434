"""Table scans, lookups and small relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require_rows(df: DataFrame) -> DataFrame:
    """The table itself; an empty one is an error (`no data`)."""
    if df.isEmpty():
        raise ValueError("no data")
    return df


def lookup(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Keyed lookups in bulk: one row per key, nulls where the table has none."""
    return keys.join(df, key, "left")


def owned_by(df: DataFrame, owner: str, value) -> DataFrame:
    return df.where(F.col(owner) == value)


def literal_relation(spark: SparkSession) -> DataFrame:
    """Two literal rows put together with UNION ALL; one cell is null."""
    schema = "col_a string, col_b int, col_c string"
    return spark.createDataFrame([("value1", 123, None)], schema).unionByName(spark.createDataFrame([("value2", 456, "not_null")], schema))


def filler(spark: SparkSession, files: int, kib: Column | int) -> DataFrame:
    """Synthetic files of `kib` KiB of the letter A, a row per KiB."""
    kib = F.lit(kib) if isinstance(kib, int) else kib
    return (
        spark.range(files).select(F.col("id").alias("file"), F.explode(F.sequence(F.lit(1), kib)).alias("block")).withColumn("data", F.repeat(F.lit("A"), 1024))
    )
