"""Every reference query: name -> (operators it covers, callable, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, numbers, strings, words
from ..operators import chunks, geo, inventory, messages, ranking, series
from ..sources import files, fixtures, sinks, tables, work
from ..sources.tables import table
from .ship import ship

BOX = (-0.1, 0.1, 0.15, -0.15)
RULES = [("greaterEqual", 14, "gzip", True), ("greater", 11, "lz4", False)]

CATALOG: dict = {}


def query(name: str, covers: str, sql: str | None = None):
    """Registers a query; `sql` says the same for DuckDB."""

    def keep(fn):
        CATALOG[name] = (covers.split(), fn, sql)
        return fn

    return keep


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"


# ------------------------------------------------------------------ inventory

_VERIFIED = fixtures.INVENTORY_SQL + """,
ver AS (SELECT cur.path, cur.last_modified, cur.length, cur.sha256,
  CASE WHEN inv.sha256 IS NULL THEN 'not_exists_in_inventory'
       WHEN cur.sha256 IS NULL THEN 'could_not_access'
       WHEN cur.last_modified = inv.last_modified AND cur.sha256 = inv.sha256 THEN 'not_modified_same_checksum'
       WHEN cur.last_modified = inv.last_modified THEN 'not_modified_different_checksum'
       WHEN cur.sha256 = inv.sha256 THEN 'modified_same_checksum'
       WHEN cur.length = inv.length THEN 'modified_same_length_different_checksum'
       ELSE 'modified_different_length_different_checksum' END AS outcome
  FROM cur LEFT JOIN inv USING (path))
"""


@query("inventory_verify", "D1 A2 J1 I16", with_(_VERIFIED, "SELECT * FROM ver"))
def inventory_verify(spark: SparkSession, d: str) -> DataFrame:
    return inventory.verify(fixtures.inventory_current(spark, d), fixtures.inventory_baseline(spark, d))


@query("inventory_summary", "E1", with_(_VERIFIED, "SELECT " + ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in inventory.OUTCOMES) + " FROM ver"))
def inventory_summary(spark, d):
    return inventory.summary(inventory_verify(spark, d))


_UPSERTED = fixtures.INVENTORY_SQL + """,
ups AS (SELECT coalesce(inv.path, cur.path) AS path, coalesce(inv.last_modified, cur.last_modified) AS last_modified,
  coalesce(inv.length, cur.length) AS length, coalesce(inv.sha256, cur.sha256) AS sha256,
  CASE WHEN cur.path IS NOT NULL THEN 99 ELSE inv.last_seen END AS last_seen,
  CASE WHEN inv.path IS NULL THEN 'insert' WHEN cur.path IS NOT NULL THEN 'update' ELSE 'keep' END AS action
  FROM inv FULL JOIN cur ON inv.path = cur.path)
"""


@query("inventory_upsert", "D2", with_(_UPSERTED, "SELECT * FROM ups"))
def inventory_upsert(spark, d):
    return inventory.upsert(fixtures.inventory_current(spark, d), fixtures.inventory_baseline(spark, d), 99)


@query("inventory_upsert_summary", "E2", with_(_UPSERTED, "SELECT count(*) FILTER (action = 'insert') AS \"insert\", count(*) FILTER (action = 'update') AS \"update\", count(*) FILTER (action = 'keep') AS keep FROM ups"))
def inventory_upsert_summary(spark, d):
    return inventory.upsert_summary(inventory_upsert(spark, d))


@query("inventory_touch", "B3", with_(fixtures.INVENTORY_SQL, "SELECT inv.path, inv.last_modified, inv.length, inv.sha256, CASE WHEN s.path IS NOT NULL THEN 7 ELSE last_seen END AS last_seen FROM inv LEFT JOIN (SELECT path FROM cur WHERE last_modified % 2 = 1) s USING (path)"))
def inventory_touch(spark, d):
    return inventory.touch(fixtures.inventory_baseline(spark, d), fixtures.inventory_current(spark, d).where("last_modified % 2 = 1"), 7)


@query("inventory_copies", "E14", with_(fixtures.INVENTORY_SQL, "SELECT path, md5(cur.sha256) AS first_md5, md5(inv.sha256) AS second_md5, coalesce(cur.sha256 = inv.sha256, false) AS equal FROM cur FULL JOIN inv USING (path)"))
def inventory_copies(spark, d):
    return inventory.same_bytes(fixtures.inventory_current(spark, d), fixtures.inventory_baseline(spark, d), "path", "sha256")


@query("path_prefix", "H1 C16", "SELECT doc_id, CASE WHEN starts_with(source || '/' || doc_id, 'src1') THEN substr(source || '/' || doc_id, 5) ELSE source || '/' || doc_id END AS path, source NOT IN ('src1', 'src2') AS wanted FROM documents")
def path_prefix(spark, d):
    path = F.concat("source", F.lit("/"), "doc_id")
    return table(spark, d, "documents").select("doc_id", strings.strip_prefix(path, "src1").alias("path"), strings.outside_outputs(path, ["src1", "src2"]).alias("wanted"))


# ------------------------------------------------------------------ positions

@query("network_positions", "A1 C2", with_(fixtures.NETWORKS_SQL, "SELECT * FROM pos"))
def network_positions(spark, d):
    return geo.best_positions(tables.require_rows(fixtures.networks(spark, d)))


@query("network_bbox", "C1", with_(fixtures.NETWORKS_SQL, "SELECT * FROM pos WHERE latitude BETWEEN -0.1 AND 0.1 AND longitude BETWEEN -0.15 AND 0.15"))
def network_bbox(spark, d):
    return geo.in_box(network_positions(spark, d), *BOX)


@query("network_scan_counts", "C3", with_(fixtures.NETWORKS_SQL, "SELECT (SELECT count(*) FROM net) AS scanned, (SELECT count(*) FROM pos WHERE latitude BETWEEN -0.1 AND 0.1 AND longitude BETWEEN -0.15 AND 0.15) AS kept"))
def network_scan_counts(spark, d):
    return geo.scan_counts(fixtures.networks(spark, d), *BOX)


def _read_back(lines: DataFrame, schema: str) -> DataFrame:
    """The fields of JSON lines, and the names in the order in which they are written."""
    return lines.select(F.array_join(F.json_object_keys("json"), ",").alias("keys"), F.from_json("json", schema).alias("o")).select("keys", "o.*")


@query("network_json", "B10", with_(fixtures.NETWORKS_SQL, "SELECT 'latitude,longitude,bssid' AS keys, latitude, longitude, bssid FROM pos WHERE latitude BETWEEN -0.1 AND 0.1 AND longitude BETWEEN -0.15 AND 0.15"))
def network_json(spark, d):
    made = sinks.json_objects(network_bbox(spark, d), ["latitude", "longitude", "bssid"])
    return _read_back(made, "latitude double, longitude double, bssid string")


@query("track_latest", "G1", with_(fixtures.SAMPLES_SQL, "SELECT owner, id, value, ts, event_type FROM smp QUALIFY row_number() OVER (PARTITION BY owner ORDER BY id DESC) = 1"))
def track_latest(spark, d):
    return geo.latest(fixtures.samples(spark, d), "owner", "id")


@query("track_points", "C12 G7", with_(fixtures.SAMPLES_SQL, "SELECT * FROM smp WHERE owner = 7 ORDER BY id"))
def track_points(spark, d):
    return tables.owned_by(fixtures.samples(spark, d), "owner", 7).orderBy("id")


@query("track_csv_rows", "B7", with_(fixtures.SAMPLES_SQL, "SELECT id || ',' || owner || ',' || value || ',' || event_type AS line FROM smp"))
def track_csv_rows(spark, d):
    return sinks.csv_lines(fixtures.samples(spark, d), ["id", "owner", "value", "event_type"])


def _points(spark, d):
    s = fixtures.samples(spark, d)
    text = lambda x: F.lit(x)
    return s.select(
        "owner", "id", (F.col("value") % 90).cast("float").alias("lat"), (F.col("value") % 180).cast("float").alias("lon"), F.concat(F.lit("<"), "event_type", F.lit("&>")).alias("desc"),
        F.pmod("id", F.lit(12)).cast("int").alias("sat"), F.col("value").cast("string").alias("alt"), F.lit(0.0).cast("float").alias("spd"), F.pmod("id", F.lit(5)).cast("float").alias("acc"), F.lit(0.0).cast("float").alias("dir"),
        text("gps").alias("prov"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("time"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("stime"), F.lit(50.0).cast("float").alias("batt"), text("").alias("aid"), text("").alias("ser"),
    )


_POINT_SQL = fixtures.SAMPLES_SQL + """,
pts AS (SELECT owner, id, CAST(CAST(value % 90 AS FLOAT) AS VARCHAR) AS lat, CAST(CAST(value % 180 AS FLOAT) AS VARCHAR) AS lon, event_type, id % 12 AS sat, value AS alt,
  CAST(CAST(id % 5 AS FLOAT) AS VARCHAR) AS acc, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS time, CAST(floor(epoch(ts)) AS BIGINT) AS stime FROM smp)
"""


@query("gpx_export", "B8 B6", with_(_POINT_SQL, """
SELECT owner, '<?xml version="1.0" encoding="UTF-8" standalone="no" ?><gpx version="1.1" creator="gpslogger"><metadata> <!-- metadata --> </metadata><rte><name>' || owner || '</name>' ||
  string_agg('<rtept lon="' || lon || '" lat="' || lat || '"><name>' || id || '</name><sat>' || sat || '</sat><src>gps</src><pdop>' || acc || '</pdop><time>' || time ||
    '</time><desc>&lt;' || event_type || '&amp;&gt;, batt: 50.0</desc><geoidheight>' || alt || '</geoidheight></rtept>', '' ORDER BY id) || '</rte></gpx>' AS gpx FROM pts GROUP BY owner"""))
def gpx_export(spark, d):
    return sinks.gpx(_points(spark, d), "owner")


@query("point_json", "B9", with_(_POINT_SQL, """
SELECT '{"id":' || id || ',"lat":' || lat || ',"lon":' || lon || ',"desc":"<' || event_type || '&>","sat":' || sat || ',"alt":"' || alt || '","spd":0.0,"acc":' || acc ||
  ',"dir":0.0,"prov":"gps","time":"' || time || '","stime":' || stime || ',"batt":50.0,"aid":"","ser":""}' AS json FROM pts QUALIFY row_number() OVER (PARTITION BY owner ORDER BY id DESC) = 1"""))
def point_json(spark, d):
    return sinks.json_objects(geo.latest(_points(spark, d), "owner", "id"), sinks.POINT_COLUMNS)


@query("point_ingest", "A7 H2 Q18", """
SELECT event_id AS stime, substr(props, 1, 255) AS usertoken, CAST(try_cast(CAST(value AS VARCHAR) AS FLOAT) AS FLOAT) IS NOT NULL AS has_lat,
  CAST(coalesce(try_cast(nullif(regexp_extract(event_id || 'x', '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT), 0) AS INTEGER) AS sat, length(substr(repeat(event_type, 100), 1, 255)) AS desc_length FROM events
""")
def point_ingest(spark, d):
    e = table(spark, d, "events")
    empty = F.lit("")
    req = e.select(F.col("props").alias("usertoken"), F.col("value").cast("string").alias("lat"), empty.alias("lon"), empty.alias("spd"), empty.alias("acc"), empty.alias("dir"), empty.alias("batt"),
                   F.concat("event_id", F.lit("x")).alias("sat"), F.repeat("event_type", 100).alias("desc"), empty.alias("alt"), empty.alias("time"), empty.alias("prov"), empty.alias("aid"), empty.alias("ser"), F.col("event_id").alias("stime"))
    return files.ingest_points(req).select("stime", "usertoken", F.col("lat").isNotNull().alias("has_lat"), "sat", F.length("desc").alias("desc_length"))


# ------------------------------------------------------------------ series

@query("pulse_per_minute", "E6 K1", with_(fixtures.PULSES_SQL, "SELECT * FROM ppm"))
def pulse_per_minute(spark, d):
    return series.pulses_per(fixtures.pulses(spark, d))


def _tier_sql(minutes: int, keep: int) -> str:
    unit = f"time_bucket(INTERVAL '{minutes} minutes', start, TIMESTAMP '1970-01-01')"
    return with_(fixtures.PULSES_SQL, f"SELECT {unit} AS start, count(pulses) AS known, CASE WHEN count(pulses) >= {minutes * 0.5} THEN sum(pulses) / count(pulses) END AS average FROM ppm GROUP BY 1 ORDER BY 1 DESC LIMIT {keep}")


@query("rollup_1min", "F3 B11", _tier_sql(1, 60))
def rollup_1min(spark, d):
    return series.rollup(pulse_per_minute(spark, d), *series.TIERS[0])


@query("rollup_5min", "F3", _tier_sql(5, 51_840))
def rollup_5min(spark, d):
    return series.rollup(pulse_per_minute(spark, d), *series.TIERS[1])


@query("rollup_60min", "F3", _tier_sql(60, 43_800))
def rollup_60min(spark, d):
    return series.rollup(pulse_per_minute(spark, d), *series.TIERS[2])


@query("meter_running_sum", "F1 I2", with_(fixtures.SAMPLES_SQL, "SELECT owner, id, value, ts, event_type, CAST(sum(value) OVER (PARTITION BY owner ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS reading FROM smp"))
def meter_running_sum(spark, d):
    return series.running_sum(fixtures.samples(spark, d), "owner", ["ts", "id"], "value", part=F.to_date("ts"))


@query("meter_rolling_mean", "F2", with_(fixtures.SAMPLES_SQL, "SELECT owner, id, round(avg(value) OVER (PARTITION BY owner ORDER BY ts, id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS mean FROM smp"))
def meter_rolling_mean(spark, d):
    return series.rolling_mean(fixtures.samples(spark, d), "owner", ["ts", "id"], "value", 20).select("owner", "id", F.round("mean", 6).alias("mean"))


@query("power_bands_24h", "F4", with_(fixtures.PULSES_SQL, "SELECT start, pulses, " + " + ".join(f"CASE WHEN pulses >= {b} THEN 1 ELSE 0 END" for b in series.PULSE_BANDS) + " AS band FROM ppm WHERE start > (SELECT max(start) FROM ppm) - INTERVAL 1 DAY"))
def power_bands_24h(spark, d):
    return series.last_day_bands(pulse_per_minute(spark, d))


@query("counter_history", "G2 A8 B5", with_(fixtures.SAMPLES_SQL, "SELECT id, CAST(value AS VARCHAR) AS value, CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) AS time FROM smp WHERE event_type = 'view' ORDER BY id DESC LIMIT 14400"))
def counter_history(spark, d):
    s = tables.owned_by(fixtures.samples(spark, d), "event_type", "view")
    return geo.newest(s, "id", 14_400).select("id", F.col("value").cast("string").alias("value"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("string").alias("time"))


@query("counter_json", "B9", with_(fixtures.SAMPLES_SQL, """
SELECT 'view' AS name, '{"values":[' || string_agg('{"value":"' || value || '","time":"' || CAST(floor(epoch(ts)) AS BIGINT) || '"}', ',' ORDER BY id) || ']}' AS json
FROM (SELECT * FROM smp WHERE event_type = 'view' ORDER BY id DESC LIMIT 14400) HAVING count(*) > 0"""))
def counter_json(spark, d):
    return sinks.json_history(counter_history(spark, d).withColumn("name", F.lit("view")), "name", "id")


@query("silence_periods", "F9 K7", with_(fixtures.SAMPLES_SQL, """
SELECT owner, silent_from, ts AS silent_to, seconds FROM (
  SELECT owner, ts, lag(ts) OVER w AS silent_from, CAST(floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) AS BIGINT) AS seconds FROM smp WINDOW w AS (PARTITION BY owner ORDER BY ts, id)) WHERE seconds > 36000"""))
def silence_periods(spark, d):
    return series.silences(fixtures.samples(spark, d), "owner", ["ts", "id"], 36_000)


@query("known_values", "K3", with_(fixtures.SAMPLES_SQL, """
SELECT owner, id, CASE WHEN coalesce(CAST(floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY owner ORDER BY ts, id))) AS BIGINT), 0) <= 7200 THEN value END AS known FROM smp"""))
def known_values(spark, d):
    return series.known_values(fixtures.samples(spark, d), "owner", ["ts", "id"], "value", 7200).select("owner", "id", "known")


@query("debounced_pulses", "K2", with_(fixtures.SAMPLES_SQL, """
SELECT id, owner, value, ts, event_type FROM (SELECT *, epoch_ms(ts) - epoch_ms(lag(ts) OVER (PARTITION BY owner ORDER BY ts, id)) AS gap FROM smp WHERE event_type = 'click') WHERE gap IS NULL OR gap > 3600000"""))
def debounced_pulses(spark, d):
    return series.debounce(fixtures.pulses(spark, d), "owner", ["ts", "id"], 3_600_000)


@query("idle_heartbeats", "K6", with_(fixtures.SAMPLES_SQL, """
SELECT owner, make_timestamp(unnest(range(a + 36000, b, 36000)) * 1000000) AS beat_at FROM (
  SELECT owner, CAST(floor(epoch(ts)) AS BIGINT) AS a, CAST(floor(epoch(lead(ts) OVER (PARTITION BY owner ORDER BY ts, id))) AS BIGINT) AS b FROM smp) WHERE b - a > 36000"""))
def idle_heartbeats(spark, d):
    return series.heartbeats(fixtures.samples(spark, d), "owner", ["ts", "id"], 36_000)


@query("clock_parts", "I1 B12", "SELECT event_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS millis, strftime(ts, '%Y%m%d') AS ymd, strftime(ts, '%H') AS hour, strftime(ts, '%Y%m%d%H%M%S') AS stem FROM events")
def clock_parts(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return sinks.by_hour(e, "ts").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("millis"), "ymd", "hour", "stem")


@query("trimmed_mean", "E7 E8 E10", """
SELECT l_suppkey, count(v) AS n, CAST(sum(v) AS BIGINT) AS total, min(v) AS lowest, max(v) AS highest, CAST(floor(sum(v) / count(v) + 0.5) AS BIGINT) AS average,
  CASE WHEN count(v) > 2 THEN CAST(floor((sum(v) - min(v) - max(v)) / (count(v) - 2) + 0.5) AS BIGINT) END AS average_mid
FROM (SELECT l_suppkey, CAST(floor(l_extendedprice) AS BIGINT) AS v FROM lineitem) GROUP BY l_suppkey""")
def trimmed_mean(spark, d):
    return series.trimmed_mean(table(spark, d, "lineitem").select("l_suppkey", F.floor("l_extendedprice").cast("long").alias("v")), "l_suppkey", "v")


@query("relative_index", "E9", """
WITH t AS (SELECT event_type, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS ms FROM events GROUP BY 1),
i AS (SELECT event_type, ms, CAST(floor(ms * 100 / (SELECT min(ms) FILTER (ms > 0) FROM t) + 0.5) AS BIGINT) AS rel_index FROM t)
SELECT *, CASE WHEN rel_index > 5000 THEN 'no' WHEN rel_index > 500 THEN 'buggy' WHEN rel_index > 200 THEN 'incomplete' WHEN rel_index > 100 THEN 'almost' WHEN rel_index IS NOT NULL THEN 'yes' END AS class FROM i""")
def relative_index(spark, d):
    t = fixtures.samples(spark, d).groupBy("event_type").agg(F.sum("value").alias("ms"))
    return series.relative_index(t, "ms")


# ------------------------------------------------------------------ chunks

_DENSE = fixtures.CHUNKS_SQL + """,
fst AS (SELECT digest, min(seq) AS first_seq FROM chk GROUP BY 1),
ids AS (SELECT digest, first_seq, row_number() OVER (ORDER BY first_seq) + 100 AS chunk_id FROM fst),
placed AS (SELECT chk.digest, seq, frame, first_seq, chunk_id, seq = first_seq AS is_new FROM chk JOIN ids USING (digest))
"""


@query("chunk_dense_ids", "E4 D8 A3", with_(_DENSE, "SELECT * FROM placed"))
def chunk_dense_ids(spark, d):
    return chunks.dense_ids(fixtures.chunks(spark, d), "digest", "seq", 100)


@query("chunk_frame_counts", "E3", with_(_DENSE, "SELECT frame, count(*) AS iterated, count(*) FILTER (is_new) AS new, count(*) FILTER (NOT is_new) AS found FROM placed GROUP BY 1"))
def chunk_frame_counts(spark, d):
    return chunks.frame_counts(chunk_dense_ids(spark, d), "frame")


@query("next_chunk_id", "E5", "SELECT coalesce(max(p_partkey), 0) + 1 AS next_id FROM part")
def next_chunk_id(spark, d):
    return chunks.next_id(table(spark, d, "part"), "p_partkey")


@query("chunk_salted_digest", "J2", "SELECT doc_id, upper(sha256(from_hex('0C434D8A6B') || encode(text))) AS digest FROM documents")
def chunk_salted_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", chunks.salted_digest(F.encode("text", "UTF-8")).alias("digest"))


@query("missing_chunks", "D3", with_(fixtures.STATES_SQL, "SELECT refs.* FROM refs ANTI JOIN have USING (id)"))
def missing_chunks(spark, d):
    return chunks.missing(fixtures.state_refs(spark, d), fixtures.stored_chunks(spark, d), "id").select("state", "id", "pos")


@query("insert_absent_chunks", "D4", with_(fixtures.STATES_SQL, "SELECT id, min_by(state, state * 100 + pos) AS state, min(state * 100 + pos) AS seq FROM refs ANTI JOIN have USING (id) GROUP BY id"))
def insert_absent_chunks(spark, d):
    refs = fixtures.state_refs(spark, d).select("id", "state", (F.col("state") * 100 + F.col("pos")).alias("seq"))
    return chunks.insert_absent(fixtures.stored_chunks(spark, d), refs, "id", "seq")


@query("complete_states", "D5", with_(fixtures.STATES_SQL, "SELECT state, count(*) AS chunks FROM refs LEFT JOIN have USING (id) GROUP BY state HAVING bool_and(p_size IS NOT NULL)"))
def complete_states(spark, d):
    return chunks.complete_states(fixtures.state_refs(spark, d), fixtures.stored_chunks(spark, d), "state", "id")


@query("drawable_states", "G4 Q3", with_(fixtures.STATES_SQL, "SELECT state, count(*) AS chunks FROM refs LEFT JOIN have USING (id) GROUP BY state HAVING bool_and(p_size IS NOT NULL) ORDER BY state DESC LIMIT 11"))
def drawable_states(spark, d):
    return chunks.drawable(complete_states(spark, d), "state", 10, compat=True)


@query("last_states", "G3", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 25")
def last_states(spark, d):
    return geo.newest(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 25)


@query("states_by_time", "G5", "SELECT o_orderdate, max(o_orderkey) AS o_orderkey, max_by(o_custkey, o_orderkey) AS o_custkey FROM orders GROUP BY 1")
def states_by_time(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"), "o_orderkey", "o_custkey")
    return chunks.by_timestamp(o, "o_orderdate", "o_orderkey")


@query("requested_chunks", "D6", with_(fixtures.STATES_SQL, "SELECT state, id, pos, p_size FROM refs LEFT JOIN have USING (id)"))
def requested_chunks(spark, d):
    return chunks.requested(fixtures.state_refs(spark, d), fixtures.stored_chunks(spark, d), "id").select("state", "id", "pos", "p_size")


_TILES = """
img AS (SELECT p_partkey AS image, 100 + p_partkey % 701 AS width, 100 + p_partkey % 503 AS height FROM part),
tls AS (SELECT image, width, height, CAST(r AS INTEGER) AS tile_row, CAST(c AS INTEGER) AS tile_col, CAST(c * 256 AS INTEGER) AS x, CAST(r * 256 AS INTEGER) AS y, least(256, width - c * 256) AS w, least(256, height - r * 256) AS h
  FROM img, range(0, 4) a(r), range(0, 4) b(c) WHERE r * 256 < height AND c * 256 < width)
"""


def _images(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("image"), (100 + k % 701).alias("width"), (100 + k % 503).alias("height"))


@query("tile_grid", "I6 L6 Q4", with_(_TILES, "SELECT * FROM tls"))
def tile_grid(spark, d):
    return chunks.tiles(_images(spark, d), "width", "height", 256, 256)


@query("tile_offsets", "F5", with_(_TILES, 'SELECT image, tile_row, tile_col, x AS "left", y AS top FROM tls'))
def tile_offsets(spark, d):
    return chunks.stitch_offsets(tile_grid(spark, d), "image").select("image", "tile_row", "tile_col", "left", "top")


# ------------------------------------------------------------------ messages

@query("message_ids", "K13 Q16", with_(fixtures.MESSAGES_SQL, "SELECT link, event_id, id + 1000 AS id FROM snt"))
def message_ids(spark, d):
    return messages.allocate_ids(fixtures.sent(spark, d).drop("id"), "link", ["written_at", "event_id"], 1000).select("link", "event_id", "id")


_PREFIX = fixtures.MESSAGES_SQL + ", dst AS (SELECT DISTINCT link, id FROM rcv), num AS (SELECT *, id - row_number() OVER (PARTITION BY link ORDER BY id) AS g FROM dst)"


@query("message_in_order_prefix", "F6 G6 K4", with_(_PREFIX, "SELECT link, id FROM num WHERE g = 0"))
def message_in_order_prefix(spark, d):
    return messages.in_order(fixtures.received(spark, d), "link")


@query("message_buffered", "F6", with_(_PREFIX, "SELECT link, id FROM num WHERE g <> 0"))
def message_buffered(spark, d):
    return messages.buffered(fixtures.received(spark, d), "link")


@query("message_duplicates", "K4", with_(fixtures.MESSAGES_SQL, "SELECT link, id, count(*) - 1 AS extra FROM rcv GROUP BY ALL HAVING count(*) > 1"))
def message_duplicates(spark, d):
    return messages.duplicates(fixtures.received(spark, d), "link")


@query("unacked_messages", "D7", with_(fixtures.MESSAGES_SQL, "SELECT snt.link, snt.id, event_id FROM snt ANTI JOIN ack USING (link, id)"))
def unacked_messages(spark, d):
    return messages.unacknowledged(fixtures.sent(spark, d), fixtures.acks(spark, d), "link").select("link", "id", "event_id")


@query("unacked_count", "E13", with_(fixtures.MESSAGES_SQL, "SELECT count(*) AS unacknowledged FROM snt ANTI JOIN ack USING (link, id)"))
def unacked_count(spark, d):
    return unacked_messages(spark, d).agg(F.count(F.lit(1)).alias("unacknowledged"))


@query("overdue_messages", "K5", with_(fixtures.MESSAGES_SQL, "SELECT snt.link, snt.id FROM snt ANTI JOIN ack USING (link, id) WHERE floor(epoch(written_at)) <= epoch(TIMESTAMP '2024-01-20 00:00:00') - 10"))
def overdue_messages(spark, d):
    return messages.overdue(fixtures.sent(spark, d), fixtures.acks(spark, d), "link", F.lit("2024-01-20 00:00:00"), 10).select("link", "id")


@query("ack_batches", "E12", with_(fixtures.MESSAGES_SQL, "SELECT link, CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS drained_at, array_to_string(list(id ORDER BY id), ',') AS ids FROM ack GROUP BY 1, 2"))
def ack_batches(spark, d):
    return messages.ack_batches(fixtures.acks(spark, d), "link", 86_400).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("send_outcomes", "K14", with_(fixtures.MESSAGES_SQL, "SELECT snt.link, snt.id, CASE WHEN a.id IS NOT NULL THEN 'acked' WHEN snt.link % 10 = 0 THEN 'failed' ELSE 'pending' END AS outcome FROM snt LEFT JOIN ack a ON a.link = snt.link AND a.id = snt.id"))
def send_outcomes(spark, d):
    return messages.outcomes(fixtures.sent(spark, d), fixtures.acks(spark, d), "link", F.col("link") % 10 == 0).select("link", "id", "outcome")


@query("flag_decode", "C14", "SELECT event_id, (event_id & 1) = 1 AS lz4, (event_id & 2) = 2 AS gzip, (event_id & 4) = 4 AS heartbeat, (event_id & 8) = 8 AS acknowledged, (event_id | 4) & ~1 AS changed FROM events")
def flag_decode(spark, d):
    e = table(spark, d, "events").select("event_id")
    return messages.flags(e, "event_id").withColumn("changed", numbers.set_flag(numbers.set_flag(F.col("event_id"), 4), 1, on=False))


@query("message_routes", "C13", "SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE 'payload' END AS route, count(*) AS n FROM events WHERE event_type IN ('error', 'view') GROUP BY 1")
def message_routes(spark, d):
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "payload")
    payload, error = messages.route(table(spark, d, "events").select(kind.alias("kind")), "kind")
    return payload.unionByName(error).groupBy(F.col("kind").alias("route")).agg(F.count(F.lit(1)).alias("n"))


_OPS = ", ".join(f"({i}, '{o}')" for i, o in enumerate(numbers.COMPARISONS))


@query("compress_condition", "C4", f"""
WITH ops(k, op) AS (VALUES {_OPS}) SELECT op, CAST(v AS INTEGER) AS v,
 CASE op WHEN 'equal' THEN v = 100 WHEN 'greater' THEN v > 100 WHEN 'greaterEqual' THEN v >= 100 WHEN 'lower' THEN v < 100 WHEN 'lowerEqual' THEN v <= 100 ELSE v <> 100 END AS matches
FROM ops, (VALUES (99), (100), (101)) t(v)""")
def compress_condition(spark, d):
    rows = spark.createDataFrame([(o,) for o in numbers.COMPARISONS], "op string").withColumn("v", F.explode(F.array(*[F.lit(x) for x in (99, 100, 101)])))
    return rows.withColumn("matches", numbers.compare(F.col("v"), F.col("op"), 100))


@query("compression_rules", "C5", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 14 AND l_discount * 1000 < l_quantity THEN 'gzip' WHEN l_quantity > 11 THEN 'lz4' ELSE 'raw' END AS codec FROM lineitem""")
def compression_rules(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("size"), (F.col("l_discount") * 1000).alias("gz"), F.col("l_quantity").alias("lz"))
    return messages.choose_compression(rows, "size", {"gzip": "gz", "lz4": "lz"}, RULES).select("l_orderkey", "l_linenumber", "codec")


@query("oversize_messages", "K12 K11", "SELECT event_id, CASE WHEN length(props) <= 8 THEN props END AS props, CASE WHEN length(props) > 8 THEN 'payload exceeds the bound' END AS error, length(props) > 8 AS heartbeat FROM events")
def oversize_messages(spark, d):
    return messages.refuse_oversize(table(spark, d, "events").select("event_id", "props"), "props", 8)


@query("poison_messages", "K11", "SELECT event_id, event_id % 10 = 0 AS heartbeat, CASE WHEN event_id % 10 = 0 THEN 'cannot be serialised' END AS error FROM events")
def poison_messages(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props")).alias("props"))
    return messages.poison(rows, "props").select("event_id", "heartbeat", "error")


@query("ordered_map", "K10", "SELECT event_id, upper(event_type) AS made, row_number() OVER (ORDER BY event_id) AS place FROM events")
def ordered_map(spark, d):
    rows = table(spark, d, "events").select("event_id", F.upper("event_type").alias("made"))
    return ranking.global_row_number(rows, ["event_id"], "place").orderBy("event_id")


# ------------------------------------------------------------------ scalar kernels

_MINI = """
v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 1 THEN -l_quantity / 4 ELSE l_discount * 100 END AS x FROM lineitem),
enc AS (SELECT l_orderkey, l_linenumber, x, CASE WHEN abs(x) > 15.5 THEN 112 WHEN abs(x) < 0.015625 THEN 0 WHEN abs(x) < 0.25 THEN CAST(floor(abs(x) * 64) AS INTEGER)
  ELSE CAST((floor(log2(abs(x))) + 3) * 16 + floor((abs(x) / pow(2, floor(log2(abs(x)))) - 1) * 16) AS INTEGER) END + CASE WHEN x < 0 THEN 128 ELSE 0 END AS code FROM v)
"""
_MINI_VALUE = "CASE WHEN ({c} // 16) % 8 = 0 THEN ({c} % 16) / 64.0 WHEN ({c} // 16) % 8 = 7 AND {c} % 16 <> 0 THEN 'nan'::DOUBLE WHEN ({c} // 16) % 8 = 7 THEN 'infinity'::DOUBLE ELSE (1 + ({c} % 16) / 16.0) * pow(2.0, ({c} // 16) % 8 - 3) END * CASE WHEN {c} >= 128 THEN -1 ELSE 1 END"


def _floats(spark, d):
    x = F.when(F.col("l_linenumber") % 2 == 1, -F.col("l_quantity") / 4).otherwise(F.col("l_discount") * 100)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"))


@query("minifloat_encode", "I8 H15 Q9 Q10", with_(_MINI, "SELECT l_orderkey, l_linenumber, code, lpad(bin(code), 8, '0') AS bits FROM enc"))
def minifloat_encode(spark, d):
    code = numbers.minifloat_encode(F.col("x"))
    return _floats(spark, d).select("l_orderkey", "l_linenumber", code.alias("code"), numbers.minifloat_bits(code).alias("bits"))


@query("minifloat_decode", "I7", "SELECT CAST(c AS INTEGER) AS code, CAST(" + _MINI_VALUE.format(c="c") + " AS DOUBLE) AS value FROM range(0, 256) t(c)")
def minifloat_decode(spark, d):
    return spark.range(256).select(F.col("id").cast("int").alias("code"), numbers.minifloat_decode(F.col("id")).alias("value"))


_MINI_CODE = "CASE WHEN abs({x}) > 15.5 THEN 112 WHEN abs({x}) < 0.015625 THEN 0 WHEN abs({x}) < 0.25 THEN CAST(floor(abs({x}) * 64) AS INTEGER) ELSE CAST((floor(log2(abs({x}))) + 3) * 16 + floor((abs({x}) / pow(2, floor(log2(abs({x})))) - 1) * 16) AS INTEGER) END + CASE WHEN {x} < 0 THEN 128 ELSE 0 END"
_SUMS = _MINI + """,
sums AS (SELECT l_orderkey, a.code AS a, b.code AS b, CAST(""" + _MINI_VALUE.format(c="a.code") + " + " + _MINI_VALUE.format(c="b.code") + """ AS DOUBLE) AS exact
  FROM (SELECT l_orderkey, max(code) AS code FROM enc WHERE l_linenumber = 1 GROUP BY 1) a JOIN (SELECT l_orderkey, max(code) AS code FROM enc WHERE l_linenumber = 2 GROUP BY 1) b USING (l_orderkey))
"""


@query("minifloat_sum", "I9", with_(_SUMS, "SELECT *, " + _MINI_CODE.format(x="exact") + " AS code FROM sums"))
def minifloat_sum(spark, d):
    f = _floats(spark, d).withColumn("code", numbers.minifloat_encode(F.col("x")))
    pairs = f.where("l_linenumber <= 2").groupBy("l_orderkey").agg(F.max(F.when(F.col("l_linenumber") == 1, F.col("code"))).alias("a"), F.max(F.when(F.col("l_linenumber") == 2, F.col("code"))).alias("b"))
    pairs = pairs.where("a is not null and b is not null").withColumn("exact", numbers.minifloat_decode(F.col("a")) + numbers.minifloat_decode(F.col("b")))
    return pairs.withColumn("code", numbers.minifloat_add(F.col("a"), F.col("b")))


@query("minifloat_parse", "I10", "SELECT p_partkey, p_partkey % 256 & ~1 AS code FROM part")
def minifloat_parse(spark, d):
    bits = F.substring(numbers.minifloat_bits(F.col("p_partkey") % 256), 1, 7)
    return table(spark, d, "part").select("p_partkey", numbers.minifloat_parse(bits).cast("long").alias("code"))


@query("necklaces", "E11 I12 L6", """
WITH w AS (SELECT n FROM range(0, 256) t(n)), r AS (SELECT n, list_min([((n << k) | (n >> (8 - k))) & 255 for k in range(0, 8)]) AS rep FROM w)
SELECT count(*) AS words, CAST(count(DISTINCT rep) OVER () AS BIGINT) AS classes FROM r GROUP BY rep""")
def necklaces(spark, d):
    classes = words.necklaces(words.combinations(spark, 8))
    return classes.select("words", classes.agg(F.count(F.lit(1))).scalar().alias("classes"))


@query("rotation_check", "I11 I13 Q11", """
WITH s AS (SELECT p_partkey, p_partkey % 16 AS a, (p_partkey // 16) % 16 AS b FROM part)
SELECT p_partkey, b IN (a, ((a << 1) | (a >> 3)) & 15, ((a << 2) | (a >> 2)) & 15, ((a << 3) | (a >> 1)) & 15) AS is_rotation FROM s""")
def rotation_check(spark, d):
    bits = lambda c: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.pmod(F.call_function("shiftright", c, i), F.lit(2)))
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", numbers.is_rotation_of(bits(k % 16), bits(F.call_function("div", k, F.lit(16)) % 16)).alias("is_rotation"))


@query("power_limit", "I4", """
SELECT event_id, CAST(CASE WHEN u < 100 THEN 100 WHEN u > 300 THEN 300 ELSE floor(u / 7) * 7 END AS INTEGER) AS power_limit FROM (SELECT event_id, -(value * 5 - 400) + 150 - 50 AS u FROM events)""")
def power_limit(spark, d):
    return table(spark, d, "events").select("event_id", numbers.power_limit(F.col("value") * 5 - 400, F.lit(150), 100, 300, 7, 50).alias("power_limit"))


_FIT = "(SELECT p_partkey, 100 + p_partkey % 701 AS w, 100 + p_partkey % 503 AS h FROM part)"


@query("fit_dimension", "I5", f"""
WITH a AS (SELECT p_partkey, CASE WHEN w > 320 THEN 320 ELSE w END AS w1, CASE WHEN w > 320 THEN 320 * h // w ELSE h END AS h1 FROM {_FIT})
SELECT p_partkey, CASE WHEN h1 > 240 THEN 240 * w1 // h1 ELSE w1 END AS width, CASE WHEN h1 > 240 THEN 240 ELSE h1 END AS height FROM a""")
def fit_dimension(spark, d):
    w, h = numbers.fit(F.col("width"), F.col("height"), 320, 240)
    return _images(spark, d).select(F.col("image").alias("p_partkey"), w.alias("width"), h.alias("height"))


@query("size_parse", "H12 A17", """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size * 1024 WHEN 1 THEN p_size WHEN 2 THEN p_size * 1048576 WHEN 3 THEN p_size END::BIGINT AS kib FROM part""")
def size_parse(spark, d):
    k, s = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    text = F.when(k == 0, F.concat(s, F.lit("Mb"))).when(k == 1, F.concat(s, F.lit("KB"))).when(k == 2, F.concat(s, F.lit("gb"))).when(k == 3, s).otherwise(F.concat(F.lit("x"), s))
    return table(spark, d, "part").select("p_partkey", strings.size_kib(text).alias("kib"))


@query("filler_files", "A17", "SELECT f AS file, count(*) AS kib, CAST(sum(1024) AS BIGINT) AS bytes FROM range(0, 4) a(f), range(0, 8) b(k) GROUP BY 1")
def filler_files(spark, d):
    return tables.filler(spark, 4, 8).groupBy("file").agg(F.count(F.lit(1)).alias("kib"), F.sum(F.length("data")).alias("bytes"))


@query("name_hygiene", "C6 C7", with_(fixtures.NAMES_SQL, """
SELECT id, unnest(list_filter([CASE WHEN starts_with(name, ' ') THEN 'starts_with_space' END, CASE WHEN ends_with(name, ' ') THEN 'ends_with_space' END,
 CASE WHEN contains(name, '  ') THEN 'two_spaces' END, CASE WHEN contains(name, ' .') THEN 'space_before_dot' END, CASE WHEN ends_with(name, '.') THEN 'ends_with_dot' END], lambda x: x IS NOT NULL)) AS fault FROM nms"""))
def name_hygiene(spark, d):
    return fixtures.names(spark, d).select("id", F.explode(strings.name_faults(F.col("name"))).alias("fault"))


@query("name_fixes", "C7 H10 H17 Q17 Q19", with_(fixtures.NAMES_SQL, """
SELECT id, replace(name, '  ', ' ') AS collapsed, regexp_replace(name, '\\.[^.]*$', '') AS stem, 'a_' || regexp_replace(name, '\\.[^.]*$', '') || '_z' || regexp_extract(name, '(\\.[^.]*)$', 1) AS renamed,
  regexp_replace(name, '\\.jpeg$', '.jpg') AS normal, count(*) OVER (PARTITION BY regexp_replace(name, '\\.jpeg$', '.jpg')) > 1 AS collides FROM nms"""))
def name_fixes(spark, d):
    n = F.col("name")
    rows = fixtures.names(spark, d).select("id", strings.collapse_pairs(n).alias("collapsed"), strings.stem(n).alias("stem"), strings.renamed(n, "a_", "_z").alias("renamed"), strings.jpeg_to_jpg(n).alias("normal"))
    twice = rows.groupBy("normal").agg((F.count(F.lit(1)) > 1).alias("collides"))
    return rows.join(twice, "normal")


@query("extension_filter", "C8 C9", with_(fixtures.NAMES_SQL, "SELECT id, lower(regexp_extract(name, '\\.([^./]*)$', 1)) AS extension, lower(name) LIKE '%.jpg' OR lower(name) LIKE '%.jpeg' AS jpeg, lower(regexp_extract(name, '\\.([^./]*)$', 1)) IN ('jpeg', 'png') AS kept FROM nms"))
def extension_filter(spark, d):
    n = F.col("name")
    return fixtures.names(spark, d).select("id", strings.extension(n).alias("extension"), strings.is_jpeg(n).alias("jpeg"), strings.extension(n).isin("jpeg", "png").alias("kept"))


@query("junk_names", "C10", with_(fixtures.NAMES_SQL, "SELECT id, name LIKE '%.aux' AS junk FROM nms"))
def junk_names(spark, d):
    return fixtures.names(spark, d).select("id", strings.is_junk(F.col("name")).alias("junk"))


@query("sequence_names", "F7 H11", with_(fixtures.NAMES_SQL, "SELECT name, printf('img%09d', row_number() OVER (ORDER BY name, id) - 1) || '.jpg' AS target FROM nms"))
def sequence_names(spark, d):
    rows = ranking.global_row_number(fixtures.names(spark, d), ["name", "id"], "n")
    return rows.select("name", strings.numbered("img", F.col("n") - 1, ".jpg").alias("target"))


@query("row_numbers", "F8 A16 G8", "SELECT col_a, col_b, col_c, row_number() OVER (ORDER BY col_b) AS row_number FROM (SELECT 'value1' AS col_a, 123 AS col_b, NULL::VARCHAR AS col_c UNION ALL SELECT 'value2', 456, 'not_null') UNION ALL SELECT NULL, NULL, NULL, 0")
def row_numbers(spark, d):
    rows = ranking.global_row_number(tables.literal_relation(spark), ["col_b"]).withColumn("row_number", F.col("row_number").cast("long"))
    return rows.unionByName(spark.createDataFrame([(None, None, None, 0)], rows.schema))  # a cursor off the rows has number 0


@query("process_list", "A11 C11 H9", """
WITH l AS (SELECT CASE WHEN event_id % 5 = 0 THEN 'x' || event_id ELSE CAST(event_id AS VARCHAR) END || ' run.' || event_type || ' ' || props AS value FROM events)
SELECT CAST(split_part(value, ' ', 1) AS INTEGER) AS pid, substr(value, instr(value, ' ') + 1) AS description FROM l
WHERE regexp_full_match(split_part(value, ' ', 1), '[0-9]+') AND contains(value, 'run.') AND NOT contains(value, 'run.error')""")
def process_list(spark, d):
    head = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("x"), "event_id")).otherwise(F.col("event_id").cast("string"))
    rows = table(spark, d, "events").select(F.concat(head, F.lit(" run."), "event_type", F.lit(" "), "props").alias("value"))
    return files.matching_processes(files.process_list(rows), "run.", "run.error")


@query("csv_watts", "A12 I21", "SELECT event_id, CAST(trunc(round(value, 2)) AS INTEGER) AS watts FROM events")
def csv_watts(spark, d):
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit(" "), F.round("value", 2).cast("string"), F.lit(" W")).alias("value"))
    return files.csv_watts(rows).select("event_id", "watts")


@query("meter_power", "A10", "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN value END AS total_act_power FROM events")
def meter_power(spark, d):
    good = F.to_json(F.struct(F.struct(F.col("value").alias("total_act_power")).alias("em:0")))
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, good).otherwise(F.lit("{}")).alias("json"))
    return files.meter_power(rows).select("event_id", "total_act_power")


@query("typed_json", "A14 I18 I19", "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN -1 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 6 = 0 THEN 'DefaultConstructorSuccessful' ELSE 'ReadFileSuccessful' END AS outcome FROM events")
def typed_json(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 6 == 0, F.lit("{broken")).otherwise(F.col("props")).alias("json"))
    return files.typed_json(rows, "k bigint", {"k": -1})


@query("lenient_integers", "I3 Q14", "SELECT event_id, try_cast(nullif(regexp_extract(CASE event_id % 3 WHEN 0 THEN '  -' || event_id || 'kWh' WHEN 1 THEN value::VARCHAR ELSE 'n/a' END, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT) AS n FROM events")
def lenient_integers(spark, d):
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.concat(F.lit("  -"), "event_id", F.lit("kWh"))).when(k == 1, F.col("value").cast("string")).otherwise(F.lit("n/a"))
    return table(spark, d, "events").select("event_id", strings.lenient_long(text).alias("n"))


@query("string_functions", "H3 H4 H5 H6 H7 H8 H13 H14 H18 H19", """
SELECT p_partkey, lower(p_name) = lower(upper(p_name)) AS same, contains(p_type, 'STEEL') AS has, p_type LIKE '%brass%' OR p_type ILIKE '%brass%' AS ilike, instr(p_name, 'a') AS at,
  starts_with(p_name, 'a') AS begins, ends_with(p_name, 'e') AS ends, replace(p_name, 'a', 'o') AS replaced, regexp_replace(p_name, '[aeiou]', '_', 'g') AS vowels, trim(',' || p_name || ',', ',') AS trimmed,
  array_to_string(list_filter(string_split(p_brand || ',,' || p_type, ','), lambda x: x <> ''), '|') AS parts, reverse(p_name) AS backwards, substr(p_name, 2) || substr(p_name, 1, 1) AS rotated,
  md5(p_name) AS md5, sha1(p_name) AS sha1, upper(p_name) AS up, length(p_name) AS n, ascii(p_name) AS code, regexp_replace('<b>' || p_name || '</b>', '<[^>]*>', '', 'g') AS plain,
  'it' || chr(92) || chr(39) || 's ' || chr(92) || chr(92) || ' ' || chr(92) || chr(34) || p_name AS slashed, p_size IN (0) OR p_name IN ('', '0') AS empty,
  regexp_replace(p_name, '(.{1,4})', '\\1-', 'g') AS chunked, '<a href="' || p_brand || '">' || p_name || '</a>' AS link
FROM part""")
def string_functions(spark, d):
    n, t = F.col("p_name"), F.col("p_type")
    return table(spark, d, "part").select(
        "p_partkey", (F.lower(n) == F.lower(F.upper(n))).alias("same"), t.contains("STEEL").alias("has"), t.ilike("%brass%").alias("ilike"), F.instr(n, "a").cast("long").alias("at"),
        n.startswith("a").alias("begins"), n.endswith("e").alias("ends"), F.replace(n, F.lit("a"), F.lit("o")).alias("replaced"), F.regexp_replace(n, "[aeiou]", "_").alias("vowels"),
        F.btrim(F.concat(F.lit(","), n, F.lit(",")), F.lit(",")).alias("trimmed"), F.array_join(strings.parts_without_empty(F.concat("p_brand", F.lit(",,"), "p_type"), ","), "|").alias("parts"),
        F.reverse(n).alias("backwards"), strings.rotate_by_one(n).alias("rotated"), F.md5(n).alias("md5"), F.sha1(n).alias("sha1"), F.upper(n).alias("up"), F.length(n).cast("long").alias("n"), F.ascii(n).alias("code"),
        strings.strip_tags(F.concat(F.lit("<b>"), n, F.lit("</b>"))).alias("plain"), strings.add_slashes(F.concat(F.lit("it's \\ \""), n)).alias("slashed"), (strings.is_empty_loose(n) | (F.col("p_size") == 0)).alias("empty"), strings.chunk_split(n, 4, "-").alias("chunked"), strings.html_link(F.col("p_brand"), n).alias("link"),
    )


@query("html_links", "H16", "SELECT p_partkey, '<a href=\"big/' || p_name || '\"><img src=\"small/' || p_name || '\"></a>' AS html FROM part")
def html_links(spark, d):
    return table(spark, d, "part").select("p_partkey", F.format_string('<a href="big/%s"><img src="small/%s"></a>', "p_name", "p_name").alias("html"))


@query("math_functions", "I17 I16", """
SELECT l_orderkey, l_linenumber, round(abs(l_tax - 0.5), 9) AS a, round(acos(l_tax), 9) AS b, round(asin(l_tax), 9) AS c, round(atan(l_quantity), 9) AS d, CAST(floor(l_extendedprice) AS BIGINT) AS e, round(exp(l_tax), 9) AS f,
  round(sin(l_quantity), 9) AS g, round(tan(l_tax), 9) AS h, round(sqrt(l_quantity), 9) AS i, round(pi(), 9) AS j, isfinite(l_tax) AS k, isnan(l_tax) AS l, lower(hex(l_linestatus)) AS m FROM lineitem""")
def math_functions(spark, d):
    r = lambda c, name: F.round(c, 9).alias(name)
    t, q = F.col("l_tax"), F.col("l_quantity")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", r(F.abs(t - 0.5), "a"), r(F.acos(t), "b"), r(F.asin(t), "c"), r(F.atan(q), "d"), F.floor("l_extendedprice").cast("long").alias("e"), r(F.exp(t), "f"), r(F.sin(q), "g"), r(F.tan(t), "h"),
        r(F.sqrt(q), "i"), r(F.pi(), "j"), numbers.is_finite(t).alias("k"), F.isnan(t).alias("l"), F.lower(F.hex("l_linestatus")).alias("m"),
    )


@query("array_access", "I23", "SELECT event_id, len(string_split(event_type, 'e')) AS n, len(string_split(event_type, 'e')) = 0 AS empty, string_split(event_type, 'e')[3] AS third, json_extract_string(props, '$.k') AS k FROM events")
def array_access(spark, d):
    parts = F.split("event_type", "e")
    keyed = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select("event_id", F.size(parts).cast("long").alias("n"), (F.size(parts) == 0).alias("empty"), F.get(parts, 2).alias("third"), F.try_element_at(keyed, F.lit("k")).alias("k"))


@query("code_decode", "I20", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Offline' WHEN 1 THEN 'Online' ELSE 'Unknown' END AS ac, CASE p_size % 9 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in numbers.ECC.items()) + " ELSE 'Unknown' END AS ecc FROM part")
def code_decode(spark, d):
    return table(spark, d, "part").select("p_partkey", numbers.decode(F.col("p_size") % 4, numbers.AC_LINE).alias("ac"), numbers.decode(F.col("p_size") % 9, numbers.ECC).alias("ecc"))


_DIGIT = "instr('0123456789abcdef', substr(md5({c}), i, 1)) - 1"


@query("bit_difference", "E15", f"SELECT p_partkey, list_sum(list_transform(range(1, 33), lambda i: bit_count(xor({_DIGIT.format(c='p_name')}, {_DIGIT.format(c='p_type')})))) / 128.0 AS share FROM part")
def bit_difference(spark, d):
    return table(spark, d, "part").select("p_partkey", numbers.bit_difference(F.md5("p_name"), F.md5("p_type")).alias("share"))


# ------------------------------------------------------------------ codecs

@query("message_box_roundtrip", "J4 J3", "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS INTEGER) AS size, true AS same, true AS grows_not, strlen(coalesce(text, '')) < 200 OR NULL AS raw_if_small FROM documents")
def message_box_roundtrip(spark, d):
    docs = table(ship(spark), d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("payload"))
    small = F.when(F.col("size") < 200, F.col("flags") == 0)
    return codecs.box_roundtrip(docs).select("doc_id", "size", "same", (F.col("boxed") <= F.col("size")).alias("grows_not"), small.alias("raw_if_small"))


@query("frame_roundtrip", "J8 J9 I15 K18", with_(fixtures.MESSAGES_SQL, """
SELECT link, id, CASE id % 3 WHEN 0 THEN 'heartbeat' WHEN 1 THEN 'acknowledged' ELSE 'message' END AS state, true AS same,
  CASE id % 3 WHEN 0 THEN '00000004' || printf('%016x', id) WHEN 1 THEN '00000008' || printf('%016x', id) || '00000002' || printf('%016x', id) || printf('%016x', id + 1)
    ELSE '00000000' || printf('%016x', id) || printf('%08x', strlen(props)) || printf('%08x', strlen(props)) || lower(hex(encode(props))) END AS frame,
  printf('%016x', id) || printf('%08x', strlen(props)) || lower(hex(encode(props))) || '00000001' || printf('%016x', id) AS block FROM snt"""))
def frame_roundtrip(spark, d):
    return codecs.frame_roundtrip(fixtures.sent(ship(spark), d).select("link", "id", F.encode("props", "UTF-8").alias("payload")))


@query("protocol_roundtrip", "J10 I14 B4", with_(fixtures.STATES_SQL, """
SELECT state, true AS same, '0000000e' || printf('%016x', state) || '00000001' || printf('%08x', count(*)) || string_agg(printf('%016x', id), '' ORDER BY id)
  || printf('%08x', count(*)) || string_agg(printf('%016x', id), '' ORDER BY id) || '00000001' || printf('%016x', min(id)) || '000000020000000100000006010203040506' AS command FROM refs GROUP BY state"""))
def protocol_roundtrip(spark, d):
    return codecs.protocol_roundtrip(fixtures.state_refs(ship(spark), d))


@query("aes_roundtrip", "J5 J6", "SELECT doc_id, CAST(20 + (strlen(coalesce(text, '')) // 16 + 1) * 16 AS INTEGER) AS bytes, true AS same FROM documents")
def aes_roundtrip(spark, d):
    return codecs.aes_roundtrip(table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("payload")))


def _mod64(x: str) -> str:
    return f"(({x}) % 18446744073709551616::UHUGEINT)"


@query("split_mix", "I22", f"""
WITH a AS (SELECT n AS id, CAST({_mod64("42::UHUGEINT + (n + 1)::UHUGEINT * 11400714819323198485::UHUGEINT")} AS UBIGINT) AS z FROM range(0, 1000) t(n)),
b AS (SELECT id, CAST({_mod64("xor(z, z >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT")} AS UBIGINT) AS z FROM a),
c AS (SELECT id, CAST({_mod64("xor(z, z >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT")} AS UBIGINT) AS z FROM b),
e AS (SELECT id, xor(z, z >> 31)::HUGEINT AS z FROM c)
SELECT id, CAST(CASE WHEN z >= 9223372036854775808 THEN z - 18446744073709551616 ELSE z END AS BIGINT) AS mixed FROM e""")
def split_mix(spark, d):
    return codecs.split_mix(ship(spark).range(1000), 42)


# ------------------------------------------------------------------ files, writes and requests

_TREE = """nat AS (SELECT n_nationkey % 2 AS odd, 'region=' || n_regionkey || '/name=' || replace(n_name, ' ', '_') AS folder, 'nation ' || n_nationkey || ': ' || n_name AS note FROM nation),
tre AS (SELECT CASE odd WHEN 0 THEN 'texts/' || folder || '.txt' ELSE 'rows/' || folder || '.json' END AS path, note AS line,
  CASE odd WHEN 0 THEN note || chr(10) ELSE '{"body":"' || note || '"}' || chr(10) END AS content FROM nat)
"""


def _tree(spark, d) -> str:
    """A folder of files at several depths: one for each nation, some of them .txt and some .json."""
    rows = table(spark, d, "nation").select(F.col("n_regionkey").alias("region"), F.translate("n_name", " ", "_").alias("name"), F.concat(F.lit("nation "), "n_nationkey", F.lit(": "), "n_name").alias("body"), (F.col("n_nationkey") % 2).alias("odd"))
    top = work.fresh(ship(spark), "tree")
    rows.where("odd = 0").drop("odd").write.partitionBy("region", "name").text(f"{top}/texts")
    rows.where("odd = 1").drop("odd").write.partitionBy("region", "name").json(f"{top}/rows")
    return top


@query("scan_tree", "A4 A6 J1", with_(_TREE, "SELECT path, strlen(content) AS length, sha256(content) AS sha256, array_to_string([split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2), path], ' ') AS entries FROM tre"))
def scan_tree(spark, d):
    top = _tree(spark, d)
    rows = files.describe_files(files.scan_files(spark, top)).withColumn("path", files.place(F.col("path"), top))
    return rows.select("path", "length", "sha256", F.array_join(files.path_entries(F.col("path")), " ").alias("entries"))


@query("glob_scan", "A5 A13", with_(_TREE, "SELECT path, line FROM tre WHERE path LIKE '%.txt'"))
def glob_scan(spark, d):
    top = _tree(spark, d)
    found = files.with_suffix(files.scan_files(spark, top, "part-*.*").select("path"), ["TXT"]).select(files.place(F.col("path"), top).alias("path"))
    lines = files.lines(spark, top, recursive=True).select(files.place(F.col("_metadata.file_path"), top).alias("path"), F.col("value").alias("line"))
    return found.join(lines, "path")


@query("inventory_append", "B1 B2 B14", with_(fixtures.INVENTORY_SQL, "SELECT path, last_modified, length, sha256, last_seen FROM inv UNION ALL SELECT cur.path, cur.last_modified, cur.length, cur.sha256, CAST(99 AS BIGINT) FROM cur ANTI JOIN inv USING (path)"))
def inventory_append(spark, d):
    """An inventory is created, rows of new files are appended (a dry run before writes nothing), and it is read back."""
    at, known = work.fresh(spark, "inventory"), fixtures.inventory_baseline(spark, d)
    sinks.append(known, at, dry_run=False)
    new = fixtures.inventory_current(spark, d).join(known.select("path"), "path", "left_anti").withColumn("last_seen", F.lit(99).cast("long"))
    sinks.append(new.select(*known.columns), at)
    sinks.append(new.select(*known.columns), at, dry_run=False)
    return spark.read.schema(known.schema).parquet(at)


@query("chunk_sync", "K15", with_(fixtures.STATES_SQL, "SELECT state, count(*) AS chunks, count(*) FILTER (p_size IS NULL) AS fetched FROM refs LEFT JOIN have USING (id) GROUP BY state"))
def chunk_sync(spark, d):
    """Pull the states, fetch what is missing, append it to the store, and read the store back: every state is complete."""
    refs, have = fixtures.state_refs(spark, d), fixtures.stored_chunks(spark, d).select("id")
    at = work.fresh(spark, "store")
    sinks.append(have, at, dry_run=False)
    lacking = chunks.missing(refs, have, "id")
    sinks.append(chunks.insert_absent(have, lacking.select("id", "state", F.struct("state", "pos").alias("seq")), "id", "seq").select("id"), at, dry_run=False)
    whole = chunks.complete_states(refs, spark.read.schema(have.schema).parquet(at), "state", "id")
    asked = lacking.groupBy("state").agg(F.count(F.lit(1)).alias("fetched"))
    return whole.join(asked, "state", "left").select("state", "chunks", F.coalesce("fetched", F.lit(0)).alias("fetched"))


@query("request_dispatch", "C15", "SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'create' WHEN event_id % 11 = 0 THEN 'drop' WHEN event_id % 2 = 0 THEN 'post' WHEN event_type = 'view' THEN 'get' ELSE 'none' END AS action FROM events")
def request_dispatch(spark, d):
    k = F.col("event_id")
    asked = {"create": k % 13 == 0, "drop": k % 11 == 0, "post": k % 2 == 0, "get": F.col("event_type") == "view"}
    return table(spark, d, "events").select("event_id", messages.dispatch(asked).alias("action"))


@query("request_stack", "G9", with_(fixtures.MESSAGES_SQL, "SELECT link, id, row_number() OVER (PARTITION BY link ORDER BY id DESC) AS place FROM snt ANTI JOIN ack USING (link, id)"))
def request_stack(spark, d):
    return messages.stack_order(unacked_messages(spark, d).select("link", "id"), "link", "id")


@query("schedule_gate", "K16", with_(fixtures.SAMPLES_SQL, """
SELECT owner, id, CASE WHEN event_type = 'error' THEN 60 ELSE 1200 END AS wait,
  coalesce(floor(epoch(ts)) >= floor(epoch(lag(ts) OVER w)) + CASE WHEN lag(event_type) OVER w = 'error' THEN 60 ELSE 1200 END, true) AS due FROM smp WINDOW w AS (PARTITION BY owner ORDER BY ts, id)"""))
def schedule_gate(spark, d):
    """After a success the next attempt is due in 20 minutes, after a failure in one."""
    return series.schedule_gate(fixtures.samples(spark, d), "owner", ["ts", "id"], F.col("event_type") == "error", 1200, 60).select("owner", "id", "wait", "due")


@query("ack_nudges", "K8", with_(fixtures.MESSAGES_SQL, "SELECT link, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS interval_start, CAST(floor(epoch(min(ts))) AS BIGINT) AS nudged_at, count(*) AS acks FROM ack GROUP BY 1, 2"))
def ack_nudges(spark, d):
    """At most one nudge in each check interval of an hour: the first acknowledgement of a link gives it."""
    return messages.nudges(fixtures.acks(spark, d), "link", 3600)


@query("interval_samples", "K17", with_(fixtures.SAMPLES_SQL, "SELECT owner, time_bucket(INTERVAL '60 minutes', ts, TIMESTAMP '1970-01-01') AS start, arg_max(value, [CAST(epoch_us(ts) AS BIGINT), id]) AS value FROM smp GROUP BY 1, 2"))
def interval_samples(spark, d):
    return series.interval_samples(fixtures.samples(spark, d), "owner", 60, "value", ["ts", "id"])


@query("backpressure", "K9", with_(fixtures.MESSAGES_SQL, """SELECT link, id, CAST(pending AS BIGINT) AS pending, pending <= 3 AS admitted FROM (
  SELECT link, id, step, sum(step) OVER (PARTITION BY link ORDER BY moved, step, id ROWS UNBOUNDED PRECEDING) AS pending FROM (
    SELECT link, id, written_at AS moved, 1 AS step FROM snt UNION ALL SELECT link, id, written_at + INTERVAL 6 HOUR, -1 FROM snt WHERE event_id % 3 <> 0)) WHERE step = 1"""))
def backpressure(spark, d):
    """Messages in flight at each send (acknowledged after six hours, if at all), and whether the bound of 3 admits it at once."""
    sent = fixtures.sent(spark, d)
    acked = sent.where("event_id % 3 <> 0").select("link", "id", (F.col("written_at") + F.expr("interval 6 hours")).alias("at"))
    return messages.in_flight(sent.select("link", "id", F.col("written_at").alias("at")), acked, "link", 3)


QUERIES = {name: fn for name, (_, fn, _) in CATALOG.items()}
ORACLE_SQL = {name: sql for name, (_, _, sql) in CATALOG.items() if sql}
