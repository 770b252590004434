"""Positions: fallback coordinates, bounding boxes, latest points and tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers


def best_positions(networks: DataFrame) -> DataFrame:
    """latitude, longitude, bssid: the best pair, or the last one where either of it is infinite; rows without
    either are left out.  Null coordinates count as 0."""
    pair = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("bestlat", "bestlon", "lastlat", "lastlon")}
    no_best = numbers.is_infinite(pair["bestlat"]) | numbers.is_infinite(pair["bestlon"])
    no_last = numbers.is_infinite(pair["lastlat"]) | numbers.is_infinite(pair["lastlon"])
    return networks.where(~(no_best & no_last)).select(
        F.when(no_best, pair["lastlat"]).otherwise(pair["bestlat"]).alias("latitude"),
        F.when(no_best, pair["lastlon"]).otherwise(pair["bestlon"]).alias("longitude"),
        "bssid",
    )


def in_box(positions: DataFrame, lat1: float, lat2: float, lon1: float, lon2: float) -> DataFrame:
    return positions.where(numbers.in_box(F.col("latitude"), F.col("longitude"), lat1, lat2, lon1, lon2))


def scan_counts(networks: DataFrame, lat1: float, lat2: float, lon1: float, lon2: float) -> DataFrame:
    """Rows scanned and rows kept, in one pass."""
    kept = in_box(best_positions(networks), lat1, lat2, lon1, lon2).select(F.lit(0).alias("a"), F.lit(1).alias("b"))
    return networks.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(kept).agg(F.coalesce(F.sum("a"), F.lit(0)).alias("scanned"), F.coalesce(F.sum("b"), F.lit(0)).alias("kept"))


def latest(points: DataFrame, owner: str, order: str) -> DataFrame:
    """The row of the largest `order` for each owner: one aggregate, no sort."""
    rest = [c for c in points.columns if c != owner]
    return points.groupBy(owner).agg(F.max_by(F.struct(*rest), order).alias("r")).select(owner, *[f"r.{c}" for c in rest])


def newest(points: DataFrame, order: str, n: int) -> DataFrame:
    return points.orderBy(F.desc(order)).limit(n)
