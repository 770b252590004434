"""Row numbers over a whole table without bringing all rows into one task."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import work

TASK_BYTES = 128 << 20


def global_row_number(df: DataFrame, keys: list[str], name: str = "row_number", buckets: int | None = None) -> DataFrame:
    """Adds 1..N in the order of keys.

    Rows are cut into ranges of the keys (`buckets` of them, or the session's number of partitions, or one for each 128 MB that the
    input reads), sorted, numbered within their range and stored; a pass over the stored numbers counts the ranges, and
    each range is shifted by those before.  The input is computed once, besides the sample that finds the bounds.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES if size < 1 << 60 else 0)
    path = work.fresh(spark, "ranked")
    laid = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    # the upper bits of the id are the range's number, the lower 33 the row's place in it
    laid.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    laid = spark.read.schema(df.schema.add("_at", "long") if "_at" not in df.columns else df.schema).parquet(path)
    counts = {r["b"]: r["n"] for r in laid.groupBy(F.shiftright("_at", 33).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a range
    sizes = [counts.get(b, 0) for b in range(max(counts, default=0) + 1)]
    before = F.array(*[F.lit(x) for x in itertools.accumulate(sizes[:-1], initial=0)])
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1 + F.get(before, F.shiftright("_at", 33).cast("int"))
    return laid.withColumn(name, place.cast("long")).drop("_at")
