"""Stateful streams: steps and latencies of documents in a pipeline, and a cache whose entries end.

Events of a key wait in state until the watermark has passed them, so late ones within it still take their place, and a
repeated event counts once. One timer a key, at the earliest waiting event, wakes it up. Events behind the watermark are
dropped by Spark before they come here."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: State of several kinds with timers needs this store.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _InOrder(StatefulProcessor):
    """Hands events (micros, event_id, value) to ``emit`` in order of time and id, each once, when none can come before them."""

    kept = "x long"  # of the state that subclasses hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "micros long, event_id long, value string")
        self.state = handle.getValueState("state", self.kept)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = list(self.waiting.get()) if self.waiting.exists() else []
        new = [(r.micros, r.event_id, r.value) for r in rows]
        self.waiting.appendList(new)
        first = min((e[0] for e in old), default=None)
        least = min(e[0] for e in new)
        if first is None or least < first:
            if first is not None:
                self.handle.deleteTimer(_millis(first))
            self.handle.registerTimer(_millis(least))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        final = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted(set(self.waiting.get())) if self.waiting.exists() else []
        ready, rest = [e for e in events if e[0] <= final], [e for e in events if e[0] > final]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(_millis(rest[0][0]))
        else:
            self.waiting.clear()
        yield from self.emit(key, ready, final, not rest)

    def emit(self, key, events: list[tuple], final: int, idle: bool) -> Iterable[Row]:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _millis(micros: int) -> int:
    return -(-micros // 1000)


class _Steps(_InOrder):
    kept = "step long, last long, stages array<string>"

    def emit(self, key, events, final, idle):
        step, last, stages = self.state.get() if self.state.exists() else (0, None, [])
        stages = list(stages)
        for micros, event_id, stage in events:
            step += 1
            if stage not in stages:
                stages.append(stage)
            yield Row(key=key[0], step=step, event_id=event_id, stage=stage, micros=micros, latency_ms=None if last is None else (micros - last) / 1000, stages=len(stages))
            last = micros
        if events:
            self.state.update((step, last, stages))


class _Cache(_InOrder):
    kept = "ends long, hits long"

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def emit(self, key, events, final, idle):
        ends, hits = self.state.get() if self.state.exists() else (None, 0)
        for micros, event_id, _ in events:
            hit = ends is not None and micros < ends
            ends, hits = (ends, hits + 1) if hit else (micros + self.ttl, 0)
            yield Row(key=key[0], event_id=event_id, micros=micros, hit=hit, hits=hits)
        if ends is None or (idle and ends <= final):
            self.state.clear()
            return
        self.state.update((ends, hits))
        if idle:
            self.handle.registerTimer(_millis(ends))  # an entry that nobody asks for goes when it ends


def _run(stream: DataFrame, key: str, late: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    plain = stream.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    rows = plain.select(F.col(key).cast("string").alias("key"), "at", F.unix_micros("at").alias("micros"), F.col("event_id").cast("long").alias("event_id"), F.col("value").cast("string").alias("value"))
    out = rows.filter("key is not null and at is not null").groupBy("key").transformWithState(processor, schema, "Append", "EventTime")
    return out.withColumn("at", F.timestamp_micros("micros")).drop("micros")


def step_sequence(stream: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """key, step (1, 2, 3, ...), event_id, stage, latency_ms since the step before, stages (different ones so far), at: the
    stages of each key in order of time, from events (``key``, event_id, value: the stage, at)."""
    return _run(stream, key, late, _Steps(), "key string, step long, event_id long, stage string, micros long, latency_ms double, stages long")


def cache_log(stream: DataFrame, key: str, ttl_hours: float = 24, late: str = "1 hour") -> DataFrame:
    """key, event_id, hit, hits, at: whether each call (``key``, event_id, value, at) finds an entry. A call that finds none
    makes one that ends ``ttl_hours`` later; hits do not prolong it. ``hits`` counts those of the entry so far."""
    return _run(stream, key, late, _Cache(int(ttl_hours * 3_600_000_000)), "key string, event_id long, micros long, hit boolean, hits long")


def drain(stream: DataFrame, path: str, checkpoint: str, spark: SparkSession) -> DataFrame:
    """Run a stream over all that is there, then stop; what it wrote to ``path``. A second run takes up what came since."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(path)
