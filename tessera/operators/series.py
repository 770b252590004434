"""Sensor time series: counts per interval, rollups, running sums, gaps, bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers

# Pulses a minute at which the display changes, and tiers (minutes, rows kept).
PULSE_BANDS = [8, 17, 85, 166, 830, 1660]
TIERS = [(1, 60), (5, 51_840), (60, 43_800)]


def bucket(ts: Column, minutes: int) -> Column:
    """Start of the interval that holds ts, counted from the epoch."""
    seconds = F.unix_seconds(ts.cast("timestamp"))
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(60 * minutes))).cast("timestamp_ntz")


def pulses_per(events: DataFrame, minutes: int = 1) -> DataFrame:
    return events.groupBy(bucket(F.col("ts"), minutes).alias("start")).agg(F.count(F.lit(1)).alias("pulses"))


def rollup(per_minute: DataFrame, minutes: int, keep: int, xff: float = 0.5) -> DataFrame:
    """Averages of `minutes` one-minute values; null where fewer than xff of them are known.  The newest
    `keep` intervals stay."""
    tier = per_minute.groupBy(bucket(F.col("start"), minutes).alias("start")).agg(F.sum("pulses").alias("_s"), F.count("pulses").alias("known"))
    value = F.when(F.col("known") >= F.lit(minutes * xff), F.col("_s") / F.col("known"))
    return tier.select("start", "known", value.alias("average")).orderBy(F.desc("start")).limit(keep)


def running_sum(samples: DataFrame, owner: str, order: list[str], value: str, name: str = "reading", part: Column | None = None) -> DataFrame:
    """Sum up to each sample of an owner.

    part: something that does not fall along the order (a day).  Sums are formed within (owner, part), and
    shifted by the owner's parts before, so an owner with many samples is no single task.
    """
    if part is None:
        w = Window.partitionBy(owner).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return samples.withColumn(name, F.sum(value).over(w))
    cut = samples.withColumn("_part", part)
    before = Window.partitionBy(owner).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy(owner, "_part").agg(F.sum(value).alias("_sum"))
    parts = parts.select(owner, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    w = Window.partitionBy(owner, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn(name, F.sum(value).over(w)).join(parts, [owner, "_part"]).withColumn(name, F.col(name) + F.col("_before")).select(*samples.columns, name)


def rolling_mean(samples: DataFrame, owner: str, order: list[str], value: str, rows: int, name: str = "mean") -> DataFrame:
    """Mean of the row and those before it, `rows` at most."""
    w = Window.partitionBy(owner).orderBy(*order).rowsBetween(1 - rows, 0)
    return samples.withColumn(name, F.avg(value).over(w))


def last_day_bands(per_minute: DataFrame) -> DataFrame:
    """Per-minute counts of the last 24 hours with the number of thresholds they reach."""
    last = per_minute.agg(F.max("start")).scalar()
    recent = per_minute.where(F.col("start") > last - F.expr("interval 1 day"))
    return recent.select("start", "pulses", numbers.band(F.col("pulses"), PULSE_BANDS).alias("band"))


def silences(events: DataFrame, owner: str, order: list[str], timeout: int) -> DataFrame:
    """Gaps longer than timeout seconds: one notice per silence."""
    w = Window.partitionBy(owner).orderBy(*order)
    gaps = events.withColumn("silent_from", F.lag("ts").over(w))
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.col("silent_from").cast("timestamp"))
    return gaps.withColumn("seconds", seconds).where(F.col("seconds") > timeout).select(owner, "silent_from", F.col("ts").alias("silent_to"), "seconds")


def known_values(samples: DataFrame, owner: str, order: list[str], value: str, heartbeat: int) -> DataFrame:
    """The value, or null (unknown) where the sample before is more than `heartbeat` seconds old."""
    w = Window.partitionBy(owner).orderBy(*order)
    gap = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lag("ts").over(w).cast("timestamp"))
    return samples.withColumn("_gap", gap).withColumn("known", F.when(F.coalesce(F.col("_gap"), F.lit(0)) <= heartbeat, F.col(value))).drop("_gap")


def debounce(events: DataFrame, owner: str, order: list[str], millis: int) -> DataFrame:
    """Events that follow the one before by more than `millis`."""
    w = Window.partitionBy(owner).orderBy(*order)
    gap = F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.lag("ts").over(w).cast("timestamp"))
    return events.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") > millis)).drop("_gap")


def heartbeats(events: DataFrame, owner: str, order: list[str], interval: int) -> DataFrame:
    """Heartbeats that a sender idle for `interval` seconds adds inside its gaps."""
    w = Window.partitionBy(owner).orderBy(*order)
    rows = events.withColumn("_next", F.lead("ts").over(w))
    a, b = F.unix_seconds(F.col("ts").cast("timestamp")), F.unix_seconds(F.col("_next").cast("timestamp"))
    beats = F.when(b - a > interval, F.sequence(a + interval, b - 1, F.lit(interval).cast("bigint")))
    return rows.where(F.col("_next").isNotNull()).select(owner, F.explode(beats).alias("s")).select(owner, F.timestamp_seconds("s").cast("timestamp_ntz").alias("beat_at"))


def trimmed_mean(samples: DataFrame, group: str, value: str) -> DataFrame:
    """Count, sum, extremes, rounded mean, and the mean without one minimum and one maximum (over two samples)."""
    n, s, lo, hi = F.count(value), F.sum(value), F.min(value), F.max(value)
    return samples.groupBy(group).agg(
        n.alias("n"),
        s.alias("total"),
        lo.alias("lowest"),
        hi.alias("highest"),
        F.floor(s / n + 0.5).cast("long").alias("average"),
        F.when(n > 2, F.floor((s - lo - hi) / F.when(n > 2, n - 2) + 0.5)).cast("long").alias("average_mid"),
    )


def relative_index(times: DataFrame, time: str) -> DataFrame:
    """100 * t / smallest positive t, rounded, and its class; null without a positive time."""
    low = times.agg(F.min(F.when(F.col(time) > 0, F.col(time)))).scalar()
    rows = times.withColumn("rel_index", F.floor(F.col(time) * 100 / low + 0.5).cast("long"))
    i = F.col("rel_index")
    return rows.withColumn("class", F.when(i > 5000, "no").when(i > 500, "buggy").when(i > 200, "incomplete").when(i > 100, "almost").when(i.isNotNull(), "yes"))


def schedule_gate(attempts: DataFrame, owner: str, order: list[str], failed: Column, success_wait: int, failure_wait: int) -> DataFrame:
    """Adds `wait`, the seconds until the next attempt may follow, and `due`, whether the attempt comes after the wait of the one before."""
    w = Window.partitionBy(owner).orderBy(*order)
    rows = attempts.withColumn("wait", F.when(failed, F.lit(failure_wait)).otherwise(F.lit(success_wait)))
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    return rows.withColumn("due", F.coalesce(seconds(F.col("ts")) >= seconds(F.lag("ts").over(w)) + F.lag("wait").over(w), F.lit(True)))


def interval_samples(samples: DataFrame, owner: str, minutes: int, value: str, order: list[str]) -> DataFrame:
    """The last value of each owner in each interval that has one."""
    return samples.groupBy(owner, bucket(F.col("ts"), minutes).alias("start")).agg(F.max_by(value, F.struct(*order)).alias(value))
