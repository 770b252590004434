"""Streams against their batch twins and the published message orders."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.functions import codecs
from tessera.operators import series as batch
from tessera.sources import files
from tessera.sources.tables import table
from tessera.streaming import links, series


def test_tumbling_counts(spark, sf, tmp_path):
    events = table(spark, sf, "events").select(F.col("ts").cast("timestamp_ntz").alias("ts")).orderBy("ts")
    events.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    stream = series.event_stream(spark, str(tmp_path / "in"), "ts timestamp_ntz", 3)
    series.into_table(series.tumbling_counts(stream, "1 hour", "1 minute"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.start: r.pulses for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.start: r.pulses for r in batch.pulses_per(events, 60).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(want) - len(got) <= 2  # open windows wait


def run(spark, tmp_path, frame, schema, build):
    """Feeds the rows in batches of their `batch` column and returns what comes out, in order."""
    src = tmp_path / "in"
    out = []
    for b in sorted({r[0] for r in frame}):
        spark.createDataFrame([r[1:] for r in frame if r[0] == b], schema).coalesce(1).write.mode("append").parquet(str(src))
        q = series.per_batch(build(spark.readStream.schema(schema).parquet(str(src))), lambda df, _: out.extend(df.collect()), str(tmp_path / "cp"))
        q.awaitTermination()
    return out


def test_sequencer(spark, tmp_path):
    links.use_rocksdb(spark)
    rows = [(0, 1, 2, "b"), (0, 1, 1, "a"), (1, 1, 1, "a"), (1, 1, 4, "d"), (1, 1, 4, "d"), (2, 1, 3, "c")]
    out = run(spark, tmp_path, rows, "link long, id long, payload string", links.sequence)
    assert [(r.id, r.payload) for r in out if r.event == "delivered"] == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    assert sorted((r.id, r.event) for r in out if r.event in ("stale", "repeated")) == [(1, "stale"), (4, "repeated")]


def test_resend(spark, tmp_path):
    links.use_rocksdb(spark)
    rows = [(0, 1, 1, "written", 0), (0, 1, 2, "written", 0), (1, 1, 1, "ack", 5), (1, 1, 9, "ack", 5), (2, 1, 0, "tick", 10_000), (3, 1, 0, "tick", 12_000), (4, 1, 2, "ack", 13_000), (5, 1, 0, "tick", 40_000)]
    out = run(spark, tmp_path, rows, "link long, id long, kind string, ms long", lambda s: links.resend(s, 10_000))
    assert [(r.id, r.resent_ms) for r in out] == [(2, 10_000)]


def test_silence(spark, tmp_path):
    links.use_rocksdb(spark)
    t = dt.datetime(2024, 1, 1)
    rows = [(0, 1, t), (1, 2, t + dt.timedelta(seconds=60)), (2, 2, t + dt.timedelta(seconds=120)), (3, 2, t + dt.timedelta(seconds=121))]
    out = run(spark, tmp_path, rows, "link long, ts timestamp", lambda s: links.watch(s, "0 seconds", 10_000, 20_000))
    base = int(t.replace(tzinfo=dt.UTC).timestamp() * 1000)
    mine = sorted((r.at_ms - base, r.event) for r in out if r.link == 1)
    assert mine == [(10_000, "heartbeat"), (20_000, "expired")]


def test_frame_source(spark, tmp_path):
    spark.dataSource.register(files.FrameSource)
    path = str(tmp_path / "frames")
    files.write_frames(path, [codecs.encode_frame(0, i, b"x" * i, i) for i in range(1, 6)] + [b"bad"])
    got = []
    stream = spark.readStream.format("tessera_frames").option("path", path).option("framesPerBatch", 2).load()
    q = stream.writeStream.foreachBatch(lambda df, _: got.extend(codecs.decode_frames(df).collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for _ in range(60):
            q.processAllAvailable()
            if len(got) >= 6:
                break
    finally:
        q.stop()
    assert [r.state for r in got] == ["message"] * 5 + ["error"]
    assert [r.id for r in got[:5]] == [1, 2, 3, 4, 5]


def test_sync(spark, tmp_path):
    store = str(tmp_path / "store")
    spark.createDataFrame([(1, 0, b"a")], "id long, seq long, data binary").write.parquet(store)
    spark.createDataFrame([(1, 1, b"z"), (2, 3, b"late"), (2, 2, b"b")], "id long, seq long, data binary").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, seq long, data binary").parquet(str(tmp_path / "in"))
    series.per_batch(stream, series.sync_chunks(store), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.id, bytes(r.data)) for r in spark.read.parquet(store).collect()) == [(1, b"a"), (2, b"b")]


def test_listener_survives(spark):
    seen = []

    def bad(_):
        raise RuntimeError

    listener = series.Listener(bad, lambda p: seen.append(p.numInputRows))

    class Event:
        class progress:  # noqa: N801
            numInputRows = 3  # noqa: N815

    listener.onQueryProgress(Event)
    assert seen == [3]
