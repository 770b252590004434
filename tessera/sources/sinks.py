"""Sinks and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import numbered, xml_escape

POINT_COLUMNS = "id lat lon desc sat alt spd acc dir prov time stime batt aid ser".split()


def append(df: DataFrame, path: str, dry_run: bool = True) -> DataFrame:
    """Appends rows; a dry run only returns what would be written."""
    if not dry_run:
        df.write.mode("append").parquet(path)
    return df


def by_hour(df: DataFrame, ts: str) -> DataFrame:
    """Columns for a layout of days and hours, and a file stem to the second."""
    return df.withColumns({"ymd": F.date_format(ts, "yyyyMMdd"), "hour": F.date_format(ts, "HH"), "stem": F.date_format(ts, "yyyyMMddHHmmss")})


def write_by_hour(df: DataFrame, ts: str, path: str) -> None:
    by_hour(df, ts).write.mode("append").partitionBy("ymd", "hour").parquet(path)


def csv_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.to_csv(F.struct(*columns)).alias("line"))


def write_csv(df: DataFrame, order: str, path: str) -> None:
    """CSV with a header, ordered; range partitions keep the order over several files."""
    df.orderBy(order).write.option("header", True).mode("overwrite").csv(path)


def gpx_point() -> Column:
    cell = lambda tag, c: F.concat(F.lit(f"<{tag}>"), xml_escape(F.coalesce(c.cast("string"), F.lit(""))), F.lit(f"</{tag}>"))
    col = F.col
    return F.concat(
        F.lit('<rtept lon="'), col("lon").cast("string"), F.lit('" lat="'), col("lat").cast("string"), F.lit('">'),
        cell("name", col("id")), cell("sat", F.coalesce(col("sat"), F.lit(0))), cell("src", col("prov")), cell("pdop", col("acc")), cell("time", col("time")),
        cell("desc", F.concat(F.coalesce("desc", F.lit("")), F.lit(", batt: "), F.coalesce(col("batt").cast("string"), F.lit("")))),
        cell("geoidheight", col("alt")), F.lit("</rtept>"),
    )


def gpx(points: DataFrame, owner: str) -> DataFrame:
    """One escaped route document per owner, points by id."""
    rows = points.groupBy(owner).agg(F.sort_array(F.collect_list(F.struct("id", gpx_point().alias("p")))).alias("ps"))
    body = F.array_join(F.transform("ps", lambda x: x["p"]), "")
    head = '<?xml version="1.0" encoding="UTF-8" standalone="no" ?><gpx version="1.1" creator="gpslogger"><metadata> <!-- metadata --> </metadata><rte><name>'
    return rows.select(owner, F.concat(F.lit(head), xml_escape(F.col(owner).cast("string")), F.lit("</name>"), body, F.lit("</rte></gpx>")).alias("gpx"))


def json_objects(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.to_json(F.struct(*columns)).alias("json"))


def json_history(df: DataFrame, group: str, order: str) -> DataFrame:
    """`{"values":[{"value":..,"time":..},..]}` per group."""
    rows = df.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "value", "time"))).alias("v"))
    return rows.select(group, F.to_json(F.struct(F.transform("v", lambda x: F.struct(x["value"].alias("value"), x["time"].alias("time"))).alias("values"))).alias("json"))


def copy_plan(files: DataFrame, prefix: str) -> DataFrame:
    """What a numbered copy would do: (source, target), in the order of paths."""
    from ..operators.ranking import global_row_number

    ext = F.regexp_extract("path", r"(\.[^./]*)$", 1)
    return global_row_number(files, ["path"], "n").select(F.col("path").alias("source"), numbered(prefix, F.col("n") - 1, ext).alias("target"))
