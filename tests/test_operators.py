"""Small cases of the operators: empty tables, ties, duplicates, nulls."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunks, geo, inventory, messages, ranking, series
from tessera.sources import files, sinks, tables


def test_inventory_on_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "one.jpg").write_bytes(b"1")
    (tmp_path / "a" / "b" / "two.txt").write_bytes(b"22")
    found = files.describe_files(files.scan_files(spark, str(tmp_path)), str(tmp_path) + "/")
    assert sorted((r.path, r.length) for r in found.collect()) == [("a/b/two.txt", 2), ("a/one.jpg", 1)]
    before = found.withColumn("last_seen", F.lit(0).cast("long")).cache()
    before.count()
    (tmp_path / "a" / "one.jpg").write_bytes(b"x")
    (tmp_path / "new.txt").write_bytes(b"n")
    now = files.describe_files(files.scan_files(spark, str(tmp_path)), str(tmp_path) + "/")
    got = {r.path: r.outcome for r in inventory.verify(now.withColumn("last_modified", F.lit(1)), before.withColumn("last_modified", F.lit(1))).collect()}
    assert got == {"a/b/two.txt": "not_modified_same_checksum", "a/one.jpg": "not_modified_different_checksum", "new.txt": "not_exists_in_inventory"}
    assert [r.path for r in files.with_suffix(now, [".JPG"]).collect()] == ["a/one.jpg"]


def test_unreadable_file(spark):
    schema = "path string, last_modified long, length long, sha256 string"
    now = spark.createDataFrame([("a", 1, 1, None)], schema)
    assert inventory.verify(now, spark.createDataFrame([("a", 1, 1, "x")], schema)).first().outcome == "could_not_access"


def test_empty_source_is_an_error(spark):
    with pytest.raises(ValueError, match="no data"):
        tables.require_rows(spark.range(0))


def test_positions(spark):
    inf = float("inf")
    rows = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, "a"), (inf, 2.0, 3.0, 4.0, "b"), (inf, 2.0, inf, 4.0, "c"), (None, 2.0, 3.0, 4.0, "d"), (float("nan"), 2.0, 3.0, 4.0, "e")], "bestlat double, bestlon double, lastlat double, lastlon double, bssid string")
    got = {r.bssid: (r.latitude, r.longitude) for r in geo.best_positions(rows).collect()}
    assert got["a"] == (1.0, 2.0) and got["b"] == (3.0, 4.0) and "c" not in got and got["d"] == (0.0, 2.0)
    assert {r.bssid for r in geo.in_box(geo.best_positions(rows), 1, 0, 2, 2).collect()} == {"a", "d"}


def test_dense_ids_and_empty(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("c", 4)], "digest string, seq long")
    got = {(r.digest, r.seq): (r.chunk_id, r.is_new) for r in chunks.dense_ids(rows, "digest", "seq", 10).collect()}
    assert got == {("b", 1): (11, True), ("a", 2): (12, True), ("b", 3): (11, False), ("c", 4): (13, True)}
    assert chunks.dense_ids(rows.limit(0), "digest", "seq").count() == 0
    assert chunks.next_id(rows.limit(0), "seq").first()[0] == 1


def test_global_row_number(spark):
    rows = spark.range(20_000).select(F.pmod(F.col("id") * 7919, F.lit(20_011)).alias("k"))
    got = ranking.global_row_number(rows, ["k"], "n").orderBy("k").collect()
    assert [r.n for r in got] == list(range(1, 20_001))


def test_message_order(spark):
    def deliver(ids):
        return sorted(r.id for r in messages.in_order(spark.createDataFrame([(1, i) for i in ids], "link long, id long"), "link").collect())

    assert deliver([1, 2, 3]) == [1, 2, 3]
    assert deliver([3, 1, 2, 2]) == [1, 2, 3]
    assert deliver([2, 3]) == []
    assert deliver([1, 3, 0, 1]) == [1]


def test_tiles_cover_images(spark):
    rows = chunks.tiles(spark.createDataFrame([(1, 700, 300), (2, 256, 256), (3, 0, 5)], "image int, width int, height int"), "width", "height", 256, 256)
    area = {r.image: r.a for r in rows.groupBy("image").agg(F.sum(F.col("w") * F.col("h")).alias("a")).collect()}
    assert area == {1: 210_000, 2: 65_536}


def test_rollup_unknown(spark):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(t, 4), (t + dt.timedelta(minutes=1), 6), (t + dt.timedelta(minutes=2), 8), (t + dt.timedelta(minutes=5), 1)], "start timestamp_ntz, pulses long")
    got = {r.start: r.average for r in series.rollup(rows, 5, 10).collect()}
    assert got == {t: 6.0, t + dt.timedelta(minutes=5): None}


def test_relative_index_zero(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 10), ("c", 600)], "n string, t long")
    assert {r.n: (r.rel_index, r["class"]) for r in series.relative_index(rows, "t").collect()} == {"a": (0, "yes"), "b": (100, "yes"), "c": (6000, "no")}
    assert series.relative_index(rows.where("n = 'a'"), "t").first().rel_index is None


def test_gpx_escapes(spark):
    row = spark.createDataFrame([(1, "<t>", 1.5, 2.5, "a&b", 3, "9", 1.0, "gps", "now", 50.0)], "id int, owner string, lat float, lon float, desc string, sat int, alt string, acc float, prov string, time string, batt float")
    text = sinks.gpx(row, "owner").first().gpx
    assert "&lt;t&gt;" in text and "a&amp;b, batt: 50.0" in text
    import xml.dom.minidom

    xml.dom.minidom.parseString(text)


def test_typed_json_without_default(spark):
    rows = spark.createDataFrame([('{"k": 5}',), ("{",), (None,)], "json string")
    assert [(r.k, r.outcome) for r in files.typed_json(rows, "k bigint", None).collect()] == [(5, "ReadFileSuccessful"), (None, "NoDefaultConstructor"), (None, "NoDefaultConstructor")]


def test_csv_and_dry_run(spark, tmp_path):
    rows = spark.range(5)
    path = str(tmp_path / "x")
    assert sinks.append(rows, path).count() == 5 and not (tmp_path / "x").exists()
    sinks.append(rows, path, dry_run=False)
    assert spark.read.parquet(path).count() == 5
    sinks.write_csv(rows, "id", str(tmp_path / "c"))
    parts = [p.read_text().split() for p in sorted((tmp_path / "c").glob("part-*"))]  # part numbers follow the order
    assert all(p[0] == "id" for p in parts) and [x for p in parts for x in p[1:]] == [str(i) for i in range(5)]
    plan = sinks.copy_plan(spark.createDataFrame([("b.png",), ("a.jpg",)], "path string"), "img").collect()
    assert sorted((r.source, r.target) for r in plan) == [("a.jpg", "img000000000.jpg"), ("b.png", "img000000001.png")]


def test_ingest_is_lenient(spark):
    rows = spark.createDataFrame([("t" * 300, "x", "4", "1", "", "2", "5", "7abc", "d", "", "", "", "", "", "12")], "usertoken string, lat string, lon string, spd string, acc string, dir string, batt string, sat string, desc string, alt string, time string, prov string, aid string, ser string, stime string")
    r = files.ingest_points(rows).first()
    assert len(r.usertoken) == 255 and r.lat is None and r.lon == 4.0 and r.sat == 7 and r.stime == 12
    assert files.ingest_samples(spark.createDataFrame([("n", "1")], "name string, value string"), 99).first().time == "99"
