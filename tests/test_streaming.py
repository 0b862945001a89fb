"""Streams with late, unordered and repeated events against their batch forms."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from placeworks.streaming import delivered, earliest_visits, first_visits_batch, trailing_counts

SCHEMA = "event_id int, shop_id int, path string, visitor string, created_at timestamp, is_bot boolean"


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


def files(spark, folder, parts, schema=SCHEMA):
    """A file for each part, read as a stream one file a micro-batch, in order."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/part{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    return stream, spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)


def run(out, folder, name, times=1):
    for _ in range(times):
        out.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{folder}/{name}_state").start(f"{folder}/{name}").awaitTermination(300)
    return out.sparkSession.read.parquet(f"{folder}/{name}").collect()


def late_views(seed=1):
    """Views of four days in four parts: within a part in any order, and up to twenty hours late."""
    rng = random.Random(seed)
    rows = [(k, rng.randrange(2), rng.choice("ab"), rng.choice("xyz"), datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(4 * 1440)), rng.random() < 0.2) for k in range(120)]
    arrives = sorted(rows, key=lambda r: r[4] + timedelta(hours=rng.randrange(20)))
    return [arrives[:40], arrives[40:80], arrives[80:], [(999, 0, "a", "x", datetime(2024, 1, 20), False)]]


def test_earliest_visit_whatever_the_order(spark, tmp_path):
    """Late views change who was first; the stream gives the batch result for every day that is over."""
    stream, table = files(spark, str(tmp_path / "in"), late_views())
    over = lambda rows: sorted(tuple(r) for r in rows if r["created_at"] < datetime(2024, 1, 19))
    columns = ["event_id", "shop_id", "path", "visitor", "created_at"]
    want = over(first_visits_batch(table).select(columns).collect())
    assert over(run(earliest_visits(stream).select(columns), str(tmp_path), "earliest", 2)) == want and len(want) > 20
    assert over(earliest_visits(table).select(columns).collect()) == want


def test_trailing_windows_of_late_events(spark, tmp_path):
    stream, table = files(spark, str(tmp_path / "in"), late_views(2))
    over = lambda rows: sorted((r["day"], r["n"]) for r in rows if r["day"] < datetime(2024, 1, 15).date())
    times = [r["created_at"] for r in table.filter("event_id < 999").collect()]
    days = Counter((t.date() + timedelta(k + 1)) for t in times for k in range(3))
    assert over(run(trailing_counts(stream, 3), str(tmp_path), "trailing", 2)) == over(trailing_counts(table, 3).collect()) == sorted(days.items())


def test_delivered_once_across_micro_batches(rocks, tmp_path):
    """Keys that repeat in a later micro-batch or after a restart are not sent again until they are forgotten; deliveries are bounded and nothing stays behind."""
    rng = random.Random(3)
    day = lambda d: datetime(2024, 1, d)
    event = lambda i, d=1: (i, i % 3, day(d))
    schema = "event_id int, shop_id int, created_at timestamp"
    ids = list(range(60))
    parts = [[event(i) for i in ids[:40]], [event(rng.choice(ids)) for _ in range(50)], [event(i) for i in ids] * 2]
    stream, _ = files(rocks, str(tmp_path / "in"), parts, schema)
    out = delivered(stream, ["event_id", "shop_id"], "shop_id", size=7, shards=2, forget=timedelta(days=3))
    run(out, str(tmp_path), "sent")
    add = lambda rows, name: rocks.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{name}"))
    add([event(i) for i in ids[:20]] + [event(100)], "later")
    rows = run(out, str(tmp_path), "sent")
    assert Counter(r["event_id"] for r in rows) == Counter([*ids, 100])
    sizes = Counter((r["shop_id"], r["shard"], r["delivery"]) for r in rows)
    assert max(sizes.values()) <= 7 and len({r["key"] for r in rows}) == 61
    add([event(200, 20)], "much later")  # moves the watermark on
    run(out, str(tmp_path), "sent")
    add([event(5, 20)], "again")
    rows = run(out, str(tmp_path), "sent")
    assert Counter(r["event_id"] for r in rows) == Counter([*ids, 100, 200, 5])
