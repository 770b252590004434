"""Sensor streams: tumbling counts with watermarks, rollups, incremental sync."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators import chunks


def event_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; admission is bounded by files per trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def tumbling_counts(events: DataFrame, width: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", width)).agg(F.count(F.lit(1)).alias("pulses")).select(F.col("window.start").alias("start"), "pulses")


def into_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Runs over what is there and ends; exactly once by the checkpoint."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)


def per_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync_chunks(store: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch handler: appends the received chunks (id, seq, data) that the store lacks."""

    def handle(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema("id long, seq long, data binary").parquet(store)
        chunks.insert_absent(known.select("id"), batch, "id", "seq").select("id", "seq", "data").write.mode("append").parquet(store)

    return handle


class Listener(StreamingQueryListener):
    """Calls back for each progress report; a callback that fails is left out and changes nothing."""

    def __init__(self, *callbacks: Callable):
        self.callbacks = callbacks

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        for call in self.callbacks:
            try:
                call(event.progress)
            except Exception:  # noqa: BLE001, S112  callbacks are foreign code
                continue

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
