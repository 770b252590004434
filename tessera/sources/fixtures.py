"""Inputs derived from the driver's tables: each as a DataFrame and as a SQL common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table


def inventory_current(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    text = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("#"), F.substr(text, F.lit(2)))).otherwise(text)
    return docs.select(
        F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"),
        (F.col("doc_id") * 1000 + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).alias("last_modified"),
        F.length(text).cast("long").alias("length"),
        F.sha2(text, 256).alias("sha256"),
    )


def inventory_baseline(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("doc_id") % 5 != 0).select(
        F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"),
        (F.col("doc_id") * 1000).alias("last_modified"),
        F.length("text").cast("long").alias("length"),
        F.sha2("text", 256).alias("sha256"),
        F.lit(0).cast("long").alias("last_seen"),
    )


INVENTORY_SQL = """
changed AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END AS t7 FROM documents),
cur AS (SELECT source || '/' || doc_id || '.txt' AS path, doc_id * 1000 + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS last_modified,
        length(t) AS length, sha256(t) AS sha256
        FROM (SELECT *, CASE WHEN doc_id % 11 = 0 THEN '#' || substr(t7, 2) ELSE t7 END AS t FROM changed)),
inv AS (SELECT source || '/' || doc_id || '.txt' AS path, doc_id * 1000 AS last_modified, length(text) AS length, sha256(text) AS sha256,
        CAST(0 AS BIGINT) AS last_seen FROM documents WHERE doc_id % 5 <> 0)
"""


def networks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    at = lambda i: F.get("embedding", i).cast("double")
    infinite = F.lit(float("inf"))
    return e.select(
        F.when(F.col("vec_id") % 7 == 0, infinite).otherwise(at(0)).alias("bestlat"),
        at(1).alias("bestlon"),
        F.when(F.col("vec_id") % 21 == 0, infinite).otherwise(at(2)).alias("lastlat"),
        at(3).alias("lastlon"),
        F.concat(F.lit("b"), "vec_id").alias("bssid"),
    )


NETWORKS_SQL = """
net AS (SELECT CASE WHEN vec_id % 7 = 0 THEN 'infinity'::DOUBLE ELSE embedding[1]::DOUBLE END AS bestlat, embedding[2]::DOUBLE AS bestlon,
        CASE WHEN vec_id % 21 = 0 THEN 'infinity'::DOUBLE ELSE embedding[3]::DOUBLE END AS lastlat, embedding[4]::DOUBLE AS lastlon,
        'b' || vec_id AS bssid FROM embeddings),
pos AS (SELECT CASE WHEN isinf(bestlat) OR isinf(bestlon) THEN lastlat ELSE bestlat END AS latitude,
        CASE WHEN isinf(bestlat) OR isinf(bestlon) THEN lastlon ELSE bestlon END AS longitude, bssid
        FROM net WHERE NOT ((isinf(bestlat) OR isinf(bestlon)) AND (isinf(lastlat) OR isinf(lastlon))))
"""


def samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("owner"), F.floor("value").cast("long").alias("value"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type"
    )


SAMPLES_SQL = "smp AS (SELECT event_id AS id, user_id AS owner, CAST(floor(value) AS BIGINT) AS value, ts, event_type FROM events)"


def pulses(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).where(F.col("event_type") == "click")


PULSES_SQL = SAMPLES_SQL + """,
ppm AS (SELECT date_trunc('minute', ts) AS start, count(*) AS pulses FROM smp WHERE event_type = 'click' GROUP BY 1)
"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.sha2("text", 256).alias("digest"), F.col("doc_id").alias("seq"), F.col("source").alias("frame"))


CHUNKS_SQL = "chk AS (SELECT sha256(text) AS digest, doc_id AS seq, source AS frame FROM documents)"


def state_refs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("state"), F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("pos"))


def stored_chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where("p_size <= 45").select(F.col("p_partkey").alias("id"), "p_size")


STATES_SQL = """
refs AS (SELECT l_orderkey AS state, l_partkey AS id, l_linenumber AS pos FROM lineitem),
have AS (SELECT p_partkey AS id, p_size FROM part WHERE p_size <= 45)
"""


def sent(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.messages import allocate_ids

    rows = table(spark, d, "events").select("event_id", F.col("user_id").alias("link"), F.col("ts").cast("timestamp_ntz").alias("written_at"), "event_type", "props", "value")
    return allocate_ids(rows, "link", ["written_at", "event_id"])


def received(spark: SparkSession, d: str) -> DataFrame:
    """What arrives: every 97th event is lost, every 13th comes twice."""
    rows = sent(spark, d).where(F.col("event_id") % 97 != 0)
    return rows.unionByName(rows.where(F.col("event_id") % 13 == 0))


def acks(spark: SparkSession, d: str) -> DataFrame:
    return sent(spark, d).where(F.col("event_id") % 3 != 0).select("link", "id", F.col("written_at").alias("ts"))


MESSAGES_SQL = """
snt AS (SELECT event_id, user_id AS link, ts AS written_at, event_type, props, value,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS id FROM events),
rcv AS (SELECT * FROM snt WHERE event_id % 97 <> 0 UNION ALL SELECT * FROM snt WHERE event_id % 97 <> 0 AND event_id % 13 = 0),
ack AS (SELECT link, id, written_at AS ts FROM snt WHERE event_id % 3 <> 0)
"""


def names(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_name")
    n = F.when(k % 5 == 0, F.concat(F.lit(" "), n)).otherwise(n)
    n = F.when(k % 7 == 0, F.concat(n, F.lit(" "))).otherwise(n)
    n = F.when(k % 11 == 0, F.concat(n, F.lit("  x"))).otherwise(n)
    n = F.when(k % 13 == 0, F.concat(n, F.lit(" .JPEG"))).when(k % 3 == 0, F.concat(n, F.lit(".jpeg"))).when(k % 2 == 0, F.concat(n, F.lit(".aux"))).otherwise(F.concat(n, F.lit(".")))
    return table(spark, d, "part").select(k.alias("id"), n.alias("name"))


NAMES_SQL = """
nm0 AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN ' ' || p_name ELSE p_name END AS n FROM part),
nm1 AS (SELECT id, CASE WHEN id % 7 = 0 THEN n || ' ' ELSE n END AS n FROM nm0),
nm2 AS (SELECT id, CASE WHEN id % 11 = 0 THEN n || '  x' ELSE n END AS n FROM nm1),
nms AS (SELECT id, CASE WHEN id % 13 = 0 THEN n || ' .JPEG' WHEN id % 3 = 0 THEN n || '.jpeg' WHEN id % 2 = 0 THEN n || '.aux' ELSE n || '.' END AS name FROM nm2)
"""
