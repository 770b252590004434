"""Message links as streams: order, silence, heartbeats, resending.  State lives in RocksDB, per link."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


class Sequencer(StatefulProcessor):
    """Delivers each link's ids in order from `start`, buffers behind gaps, drops stale and repeated ids.

    Every arrival is acknowledged, dropped ones too: a lost acknowledgement makes the sender repeat.
    """

    def __init__(self, start: int = 1):
        self.start = start

    def init(self, handle) -> None:
        self.next = handle.getValueState("next", "id long")
        self.waiting = handle.getMapState("waiting", "id long", "payload string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        expected = self.next.get()[0] if self.next.exists() else self.start
        out = []
        for pdf in rows:
            for id_, payload in zip(pdf["id"].tolist(), pdf["payload"].tolist()):
                state = "stale" if id_ < expected else "repeated" if self.waiting.containsKey((id_,)) else "buffered"
                if state == "buffered":
                    self.waiting.updateValue((id_,), (payload,))
                out.append((key[0], id_, None, "acknowledged" if state == "buffered" else state))
                while self.waiting.containsKey((expected,)):
                    out.append((key[0], expected, self.waiting.getValue((expected,))[0], "delivered"))
                    self.waiting.removeKey((expected,))
                    expected += 1
        self.next.update((expected,))
        yield pd.DataFrame(out, columns=["link", "id", "payload", "event"])

    def close(self) -> None:
        pass


def sequence(messages: DataFrame, start: int = 1) -> DataFrame:
    """(link, id, payload, event): acknowledged, stale, repeated and, in order, delivered."""
    return messages.groupBy("link").transformWithStateInPandas(
        statefulProcessor=Sequencer(start), outputStructType="link long, id long, payload string, event string", outputMode="Append", timeMode="None"
    )


class Watch(StatefulProcessor):
    """Event-time timers: a heartbeat after `beat` ms without an event, one expiry after `timeout` ms."""

    def __init__(self, beat: int, timeout: int):
        self.beat, self.timeout = beat, timeout

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def _timers(self, last: int):
        return [*range(last + self.beat, last + self.timeout, self.beat), last + self.timeout]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old = self.last.get()[0] if self.last.exists() else None
        new = max(max(int(x) for x in pdf["ms"]) for pdf in rows)
        if old is None or new > old:
            if old is not None:
                for t in self._timers(old):
                    self.handle.deleteTimer(t)
            self.last.update((new,))
            for t in self._timers(new):
                self.handle.registerTimer(t)
        yield pd.DataFrame({"link": [], "at_ms": [], "event": []}).astype({"link": "int64", "at_ms": "int64", "event": "str"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        last = self.last.get()[0] if self.last.exists() else at
        yield pd.DataFrame({"link": [key[0]], "at_ms": [at], "event": ["expired" if at - last >= self.timeout else "heartbeat"]})

    def close(self) -> None:
        pass


def watch(events: DataFrame, watermark: str, beat_ms: int, timeout_ms: int) -> DataFrame:
    """(link, at_ms, event) for idle links of events(link, ts)."""
    stamped = events.withWatermark("ts", watermark).selectExpr("link", "ts", "unix_millis(ts) AS ms")
    return stamped.groupBy("link").transformWithStateInPandas(
        statefulProcessor=Watch(beat_ms, timeout_ms), outputStructType="link long, at_ms long, event string", outputMode="Append", timeMode="EventTime"
    )


class Retainer(StatefulProcessor):
    """Keeps written messages until they are acknowledged; emits those written `interval` ms or more ago."""

    def __init__(self, interval: int):
        self.interval = interval

    def init(self, handle) -> None:
        self.kept = handle.getMapState("kept", "id long", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, out = 0, []
        for pdf in rows:
            for id_, kind, ms in zip(pdf["id"].tolist(), pdf["kind"].tolist(), pdf["ms"].tolist()):
                now = max(now, ms)
                if kind == "written":
                    self.kept.updateValue((id_,), (ms,))
                elif kind == "ack" and self.kept.containsKey((id_,)):
                    self.kept.removeKey((id_,))
        for (id_,), (ms,) in list(self.kept.iterator()):
            if ms <= now - self.interval:
                self.kept.updateValue((id_,), (now,))
                out.append((key[0], id_, now))
        yield pd.DataFrame(sorted(out), columns=["link", "id", "resent_ms"]).astype({"link": "int64", "id": "int64", "resent_ms": "int64"})

    def close(self) -> None:
        pass


def resend(events: DataFrame, interval_ms: int) -> DataFrame:
    """(link, id, resent_ms) from events(link, id, kind, ms): kinds written, ack, tick."""
    return events.groupBy("link").transformWithStateInPandas(
        statefulProcessor=Retainer(interval_ms), outputStructType="link long, id long, resent_ms long", outputMode="Append", timeMode="None"
    )
