"""File inventory: upsert and verification of hashed files, each one join instead of a query per file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Outcomes of a verification.
OUTCOMES = [
    "not_exists_in_inventory",
    "not_modified_same_checksum",
    "not_modified_different_checksum",
    "modified_same_checksum",
    "modified_same_length_different_checksum",
    "modified_different_length_different_checksum",
    "could_not_access",
]


def verify(files: DataFrame, inventory: DataFrame) -> DataFrame:
    """Each file with its outcome.  A file that could not be read has a null sha256."""
    known = inventory.select("path", *[F.col(c).alias(f"_{c}") for c in ("last_modified", "length", "sha256")])
    same, touched = F.col("sha256") == F.col("_sha256"), F.col("last_modified") != F.col("_last_modified")
    outcome = (
        F.when(F.col("_sha256").isNull(), OUTCOMES[0])
        .when(F.col("sha256").isNull(), OUTCOMES[6])
        .when(~touched & same, OUTCOMES[1])
        .when(~touched, OUTCOMES[2])
        .when(same, OUTCOMES[3])
        .when(F.col("length") == F.col("_length"), OUTCOMES[4])
        .otherwise(OUTCOMES[5])
    )
    return files.join(known, "path", "left").withColumn("outcome", outcome).select(*files.columns, "outcome")


def summary(verified: DataFrame) -> DataFrame:
    """One row: a counter per outcome."""
    return verified.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])


def upsert(files: DataFrame, inventory: DataFrame, now: int) -> DataFrame:
    """The inventory after a scan: new paths are inserted, known ones only get a new last_seen (their hash is
    left alone).  `action` is insert, update or keep; ids follow the largest one, in the order of paths."""
    scanned = files.select("path", *[F.col(c).alias(f"_{c}") for c in ("last_modified", "length", "sha256")], F.lit(True).alias("_seen"))
    both = inventory.join(scanned, "path", "full_outer")
    action = F.when(F.col("sha256").isNull(), "insert").when(F.col("_seen"), "update").otherwise("keep")
    both = both.withColumn("action", action)
    return both.select(
        "path",
        *[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) for c in ("last_modified", "length", "sha256")],
        F.when(F.col("_seen"), F.lit(now)).otherwise(F.col("last_seen")).cast("long").alias("last_seen"),
        "action",
    )


def upsert_summary(after: DataFrame) -> DataFrame:
    return after.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("insert", "update", "keep")])


def touch(inventory: DataFrame, seen: DataFrame, now: int) -> DataFrame:
    """UPDATE of last_seen by key, as copy on write."""
    hit = seen.select("path").distinct().withColumn("_hit", F.lit(True))
    return inventory.join(hit, "path", "left").withColumn("last_seen", F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("last_seen"))).drop("_hit")


def same_bytes(a: DataFrame, b: DataFrame, key: str, content: str) -> DataFrame:
    """Checksum comparison of two copies, key by key."""
    left = a.select(key, F.md5(content).alias("first_md5"))
    right = b.select(key, F.md5(content).alias("second_md5"))
    return left.join(right, key, "full_outer").withColumn("equal", F.coalesce(F.col("first_md5") == F.col("second_md5"), F.lit(False)))
