"""Reliable message links in batch form: order, duplicates, acknowledgement, resending, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers

# Header bits of a frame and command bits of the chunk protocol.
LZ4, GZIP, HEARTBEAT, ACKNOWLEDGED = 1, 2, 4, 8


def allocate_ids(rows: DataFrame, link: str, order: list[str], begin: int = 0) -> DataFrame:
    """begin+1, begin+2, ... per link; running past the largest long is an error."""
    n = F.row_number().over(Window.partitionBy(link).orderBy(*order)).cast("long")
    return rows.withColumn("id", n + F.lit(begin).cast("long"))


def in_order(received: DataFrame, link: str, start: int = 1) -> DataFrame:
    """The ids that can be delivered: from `start` on without a gap, duplicates and stale ids dropped."""
    ids = received.where(F.col("id") >= start).select(link, "id").distinct()
    n = F.row_number().over(Window.partitionBy(link).orderBy("id"))
    return ids.withColumn("_n", n).where(F.col("id") - F.col("_n") == start - 1).drop("_n")


def buffered(received: DataFrame, link: str, start: int = 1) -> DataFrame:
    """The ids that wait for a gap to close."""
    ids = received.where(F.col("id") >= start).select(link, "id").distinct()
    n = F.row_number().over(Window.partitionBy(link).orderBy("id"))
    return ids.withColumn("_n", n).where(F.col("id") - F.col("_n") != start - 1).drop("_n")


def duplicates(received: DataFrame, link: str) -> DataFrame:
    return received.groupBy(link, "id").agg((F.count(F.lit(1)) - 1).alias("extra")).where("extra > 0")


def unacknowledged(written: DataFrame, acks: DataFrame, link: str) -> DataFrame:
    """Written rows without an acknowledgement; unknown and repeated acknowledgements change nothing."""
    return written.join(acks.select(link, "id"), [link, "id"], "left_anti")


def overdue(written: DataFrame, acks: DataFrame, link: str, now, interval: int) -> DataFrame:
    """Rows to send again: unacknowledged, written at or before now - interval (seconds)."""
    return unacknowledged(written, acks, link).where(F.unix_seconds(F.col("written_at").cast("timestamp")) <= F.unix_seconds(now.cast("timestamp")) - interval)


def ack_batches(acks: DataFrame, link: str, seconds: int) -> DataFrame:
    """Pending ids drained into one list per interval."""
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    return acks.groupBy(link, (s - F.pmod(s, F.lit(seconds))).alias("drained_at")).agg(F.sort_array(F.collect_list("id")).alias("ids"))


def outcomes(written: DataFrame, acks: DataFrame, link: str, failed_from=None) -> DataFrame:
    """acked, failed (written on a link that was shut down) or pending for each message."""
    hit = acks.select(link, "id").distinct().withColumn("_acked", F.lit(True))
    rows = written.join(hit, [link, "id"], "left")
    failed = F.lit(False) if failed_from is None else failed_from
    return rows.withColumn("outcome", F.when(F.col("_acked"), "acked").when(failed, "failed").otherwise("pending")).drop("_acked")


def flags(rows: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return rows.withColumns({"lz4": numbers.has_flag(c, LZ4), "gzip": numbers.has_flag(c, GZIP), "heartbeat": numbers.has_flag(c, HEARTBEAT), "acknowledged": numbers.has_flag(c, ACKNOWLEDGED)})


def route(rows: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(payloads, errors); other kinds and null are ignored."""
    return rows.where(F.col(kind) == "payload"), rows.where(F.col(kind) == "error")


def refuse_oversize(rows: DataFrame, payload: str, most: int) -> DataFrame:
    """Payloads over the bound become heartbeats with the same id and an error; order is kept."""
    over = F.length(payload) > most
    return rows.withColumns({"error": F.when(over, F.lit("payload exceeds the bound")), payload: F.when(~over, F.col(payload)), "heartbeat": over})


def poison(rows: DataFrame, text: str) -> DataFrame:
    """Rows that cannot be serialised keep their id as heartbeats with an error."""
    value = F.expr(f"try_parse_json({text})")
    bad = value.isNull()
    return rows.withColumns({"heartbeat": bad, "error": F.when(bad, F.lit("cannot be serialised"))})


def choose_compression(rows: DataFrame, size: str, sizes: dict[str, str], rules: list[tuple[str, int, str, bool]]) -> DataFrame:
    """First matching rule (operator, threshold, codec, only_if_smaller); a rule whose result is not smaller falls
    through to the next.  `sizes` names the column of each codec's compressed size."""
    out = F
    for operator, threshold, codec, only_smaller in rules:
        test = numbers.compare(F.col(size), operator, threshold)
        if only_smaller:
            test = test & (F.col(sizes[codec]) < F.col(size))
        out = out.when(test, codec)
    return rows.withColumn("codec", out.otherwise("raw") if rules else F.lit("raw"))


def dispatch(requests: dict[str, Column]) -> Column:
    """The first of the named requests whose condition holds; `none` where none does."""
    out = F
    for name, asked in requests.items():
        out = out.when(asked, name)
    return out.otherwise("none")


def stack_order(pending: DataFrame, link: str, order: str) -> DataFrame:
    """Pending requests with their place on a stack: the last one comes first."""
    return pending.withColumn("place", F.row_number().over(Window.partitionBy(link).orderBy(F.desc(order))))


def in_flight(sent: DataFrame, acked: DataFrame, link: str, most: int) -> DataFrame:
    """link, id, pending (messages in flight with this one) and admitted (no more than `most`) of each send.

    sent and acked have link, id and at; an acknowledgement of the same moment frees its place first.
    """
    moves = sent.select(link, "id", "at", F.lit(1).alias("step")).unionAll(acked.select(link, "id", "at", F.lit(-1).alias("step")))
    w = Window.partitionBy(link).orderBy("at", "step", "id").rowsBetween(Window.unboundedPreceding, 0)
    return moves.withColumn("pending", F.sum("step").over(w)).where("step = 1").select(link, "id", "pending", (F.col("pending") <= most).alias("admitted"))


def nudges(acks: DataFrame, link: str, interval: int) -> DataFrame:
    """The first moment of each check interval (seconds) in which a link has something to acknowledge, and how much."""
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = acks.select(link, (at - F.pmod(at, F.lit(interval))).alias("interval_start"), at.alias("at"))
    return rows.groupBy(link, "interval_start").agg(F.min("at").alias("nudged_at"), F.count(F.lit(1)).alias("acks"))
