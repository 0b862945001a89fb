"""Online behaviour as Structured Streaming; the same transforms hold for batch tables."""

from __future__ import annotations

from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from placeworks.operators.predicates import latest

VISIT = ["shop_id", "path", "visitor", "day"]


def visits(events: DataFrame, ts: str = "created_at") -> DataFrame:
    """Human views with their day."""
    return events.filter(~F.coalesce("is_bot", F.lit(False))).withColumn("day", F.to_date(ts))


def first_visits_batch(events: DataFrame, ts: str = "created_at", keys: list[str] = VISIT) -> DataFrame:
    """The first view of each visitor, page and day (R01); ties go to the smallest event id."""
    every = visits(events, ts)
    return latest(every.withColumn("_k", F.struct(*keys)), "_k", [F.col(ts), F.col("event_id")]).drop("_k")


def first_visits(stream: DataFrame, ts: str = "created_at", keys: list[str] = VISIT) -> DataFrame:
    """The same on a stream: state is kept for a day, after which no duplicate can come."""
    return visits(stream, ts).withWatermark(ts, "1 day").dropDuplicatesWithinWatermark(keys)


def earliest_visits(events: DataFrame, ts: str = "created_at", keys: list[str] = VISIT, lateness: str = "1 day") -> DataFrame:
    """The earliest view of each visitor, page and day, whatever the order in which views arrive (R01): each key keeps the smallest
    (time, event id) in event-time state and is emitted when the watermark has passed its day. Views later than ``lateness`` are dropped by the watermark; on a
    table the same expression gives ``first_visits_batch``."""
    rows = visits(events, ts).withWatermark(ts, lateness)
    row = F.struct(*rows.columns)
    first = rows.groupBy(F.window(ts, "1 day"), *keys).agg(F.min_by(row, F.struct(ts, "event_id")).alias("first"))
    return first.select("first.*")


def daily_counts(stream: DataFrame, ts: str = "created_at") -> DataFrame:
    """Counts by day (R05); a day is emitted when the watermark has passed it."""
    return stream.withWatermark(ts, "1 day").groupBy(F.window(ts, "1 day")).agg(F.count("*").alias("n")).select(F.to_date(F.col("window.start")).alias("day"), "n")


def trailing_counts(stream: DataFrame, days: int, ts: str = "created_at") -> DataFrame:
    """Counts of the last ``days`` days, each day."""
    return stream.withWatermark(ts, "1 day").groupBy(F.window(ts, f"{days} days", "1 day")).agg(F.count("*").alias("n")).select(F.to_date(F.col("window.end")).alias("day"), "n")


BUFFER, FORGET_AFTER, SHARDS = 200, timedelta(days=7), 16


class _Delivery(StatefulProcessor):
    """State of one destination and shard: the keys that were sent, with the event time until which they are known, and the number of the next delivery."""

    def __init__(self, columns: list[str], ts: str, most: int, forget: timedelta):
        self.columns, self.ts, self.most, self.forget = columns, ts, most, int(forget.total_seconds() * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.sent = handle.getMapState("sent", "key string", "until long")
        self.next = handle.getValueState("next", "number long")

    def handleInputRows(self, key, rows, timerValues):
        number, waiting, latest = (self.next.get()[0] if self.next.exists() else 0), [], 0
        for pdf in rows:
            until = [int(t.timestamp() * 1000) + self.forget for t in pdf[self.ts]]
            for row, end in zip(pdf[self.columns].itertuples(index=False, name=None), until):
                if not self.sent.containsKey((row[0],)):
                    self.sent.updateValue((row[0],), (end,))
                    latest = max(latest, end)
                    waiting.append(row)
                if len(waiting) == self.most:
                    yield pd.DataFrame(waiting, columns=self.columns).assign(delivery=number)
                    waiting, number = [], number + 1
        if waiting:
            yield pd.DataFrame(waiting, columns=self.columns).assign(delivery=number)
            number += 1
        self.next.update((number,))
        if latest:
            self.handle.registerTimer(latest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        for (old,) in [k for k, v in self.sent.iterator() if v[0] <= now]:
            self.sent.removeKey((old,))
        yield pd.DataFrame([], columns=[*self.columns, "delivery"])

    def close(self) -> None:
        pass


def delivered(stream: DataFrame, keys: list[str], destination: str, ts: str = "created_at", size: int = BUFFER, forget: timedelta = FORGET_AFTER, lateness: str = "1 day", shards: int = SHARDS) -> DataFrame:
    """Events to send: each key once, in deliveries of up to ``size`` rows of one destination (R06), with ``key``, ``shard`` and the number of the ``delivery``.

    A key that comes again, in the same or a later micro-batch, is known in keyed state; a timer clears keys when the watermark has passed their time by
    ``forget``. At most ``size`` rows wait at once, and none beyond their micro-batch. State is kept with the checkpoint, so a restarted query sends nothing
    twice. A busy destination is ``shards`` states, told by the hash of the key. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    keyed = stream.withColumn("key", F.sha2(F.concat_ws(":", *keys), 256)).withWatermark(ts, lateness)
    keyed = keyed.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")).select("key", "shard", *stream.columns)
    schema = ", ".join(f"`{c}` {kind}" for c, kind in keyed.dtypes)
    return keyed.groupBy(destination, "shard").transformWithStateInPandas(_Delivery(keyed.columns, ts, size, forget), f"{schema}, delivery long", "Append", "EventTime")


def deliver(stream: DataFrame, path: str, checkpoint: str, keys: list[str]):
    """Micro-batches of events as folders: each drops its repeated keys and overwrites its own folder, so a retry does no harm. Keys that repeat in
    later micro-batches are what ``delivered`` is for, which may stand before it (R06)."""

    def send(batch: DataFrame, epoch: int) -> None:
        known = batch if "key" in batch.columns else batch.withColumn("key", F.sha2(F.concat_ws(":", *keys), 256))
        known.dropDuplicates(["key"]).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
