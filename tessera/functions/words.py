"""Boolean words and their rotation classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .numbers import rotations


def combinations(spark: SparkSession, n: int) -> DataFrame:
    """All 2^n boolean words; a zero bit is true."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.pmod(F.call_function("shiftright", F.col("id"), i), F.lit(2)) == 0)
    return spark.range(2**n).select("id", bits.alias("word"))


def necklaces(words: DataFrame) -> DataFrame:
    """One row per rotation class: its smallest word and the number of its words."""
    return words.withColumn("representative", F.array_min(rotations(F.transform("word", lambda b: b.cast("int"))))).groupBy("representative").agg(F.count(F.lit(1)).alias("words"))
