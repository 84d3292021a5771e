"""Streams over several batches, with late and unordered rows and a restart, against their batch twins."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wayframe.operators.userlog import latest_per_key, sliding_limit
from wayframe.sources.keyed import KeyedTable
from wayframe.streaming import feeds

START = datetime(2025, 1, 1)


def put(spark, folder, number, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/in/{number:03d}")


def run(spark, folder, schema, make, each=None):
    """All batches there are, one folder at a time; run again, it goes on where it stopped."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    stream = make(source).writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    stream = stream.foreachBatch(each).start() if each else stream.format("parquet").option("path", f"{folder}/out").outputMode("append").start()
    stream.awaitTermination()


HITS = "key string, event_id long, ts timestamp"


@pytest.mark.parametrize("order", ["sorted", "late"])
def test_limiter_is_the_batch_counter(spark, tmp_path, order):
    folder = str(tmp_path)
    seconds = [[0, 10, 20], [100, 50, 130], [130, 90, 400], [300, 320, 700]] if order == "late" else [[0, 10], [50, 90], [100, 130, 130], [300, 400, 700]]
    rows, event = [], 0
    for number, batch in enumerate(seconds):
        own = []
        for s in batch:
            for key in ("a", "b") if s % 20 == 0 else ("a",):
                own.append((key, event, START + timedelta(seconds=s)))
                event += 1
        rows += own
        put(spark, folder, number, own, HITS)
        if number == 1:
            run(spark, folder, HITS, lambda df: feeds.sliding_limit_stream(df, 2, 60, "5 minutes"))
    run(spark, folder, HITS, lambda df: feeds.sliding_limit_stream(df, 2, 60, "5 minutes"))
    put(spark, folder, 90, [("z", 999, START + timedelta(hours=9))], HITS)  # moves the watermark past all others
    run(spark, folder, HITS, lambda df: feeds.sliding_limit_stream(df, 2, 60, "5 minutes"))
    got = sorted((r.event_id, r.hits, r.flagged) for r in spark.read.parquet(f"{folder}/out").collect())
    twin = sliding_limit(spark.createDataFrame(rows, HITS), "key", "ts", "event_id", 2, 60)
    assert got == sorted((r.event_id, r.hits, r.flagged) for r in twin.collect()) and any(x[2] for x in got)


def test_a_busy_key_is_spread_over_its_windows(spark, tmp_path):
    """Thousands of hits of one key over many windows, unordered, in several batches; closed at the end."""
    import random

    rng, folder = random.Random(2), str(tmp_path)
    rows = [("busy", i, START + timedelta(seconds=rng.randrange(1000), microseconds=rng.randrange(10**6))) for i in range(4000)]
    rows += [("calm", 5000 + i, START + timedelta(seconds=61 * i)) for i in range(16)]
    for number in range(2):
        put(spark, folder, number, rows[number::2], HITS)
    feed = spark.readStream.schema(HITS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    end = spark.createDataFrame([("the end", 0, START + timedelta(hours=2))], HITS)
    out = feeds.finished(lambda df: feeds.sliding_limit_stream(df, 3, 60, "20 minutes"), feed, end, f"{folder}/run")
    got = sorted((r.event_id, r.hits, r.flagged) for r in out.where("key <> 'the end'").collect())
    twin = sliding_limit(spark.createDataFrame(rows, HITS), "key", "ts", "event_id", 3, 60)
    assert got == sorted((r.event_id, r.hits, r.flagged) for r in twin.collect())
    assert feeds.sliding_limit_stream(spark.createDataFrame(rows, HITS), 3, 0).where("flagged OR hits <> 1").count() == 0


def test_merged_sketches_keep_their_rank_error(spark):
    import numpy as np

    rows = spark.range(60_000).select((F.col("id") % 3).cast("string").alias("train_no"), (F.col("id") % 40).alias("window"), (F.pmod(F.xxhash64("id"), F.lit(1500)) - 100).cast("bigint").alias("delay"))
    windows = rows.groupBy("train_no", "window").agg(
        F.count("*").alias("n"), F.sum("delay").alias("sum_delay"), F.count_if(F.col("delay") <= 30).alias("on_time_n"), F.kll_sketch_agg_bigint("delay", F.lit(200)).alias("sketch"))
    found = {r.train_no: r for r in feeds.sketch_percentiles(windows, ["train_no"]).collect()}
    for train, r in found.items():
        values = np.sort([x.delay for x in rows.where(F.col("train_no") == train).select("delay").collect()])
        assert r.n == len(values) == 20_000
        for q, at in ((0.5, r.p50), (0.8, r.p80), (0.9, r.p90)):
            assert abs(np.searchsorted(values, at, "right") / len(values) - q) < 0.0165 + 1 / 1500


def latest(spark, folder):
    return sorted(tuple(r) for r in feeds.current_table(spark, f"{folder}/table").select("user_id", "item", "at").collect())


def test_latest_table_rewrites_the_buckets_it_must(spark, tmp_path):
    folder, schema = str(tmp_path), "user_id string, item string, at long"
    rows = []
    for number in range(5):
        own = [(f"u{i % 3}", f"i{(i + number) % 4}", 100 * number + i) for i in range(10)]
        rows += own
        put(spark, folder, number, own, schema)
    writer = feeds.merge_latest(f"{folder}/table", ["user_id", "item"], ["at"])
    run(spark, folder, schema, lambda df: df, writer)
    want = latest_per_key(spark.createDataFrame(rows, schema), ["user_id", "item"], ["at"])
    got = latest(spark, folder)
    assert got == sorted(tuple(r) for r in want.select("user_id", "item", "at").collect())
    table = KeyedTable.open(spark, f"{folder}/table")
    assert len(table.versions()) == 2 and table.keys == ["user_id", "item"]
    writer(spark.createDataFrame(rows[-10:], schema), 4)  # the last batch once more
    assert latest(spark, folder) == got
    assert feeds.newest_per_user(spark, f"{folder}/table", ["at"], n=2).groupBy("user_id").count().filter("count > 2").count() == 0
    before = table.manifest()
    assert table.upsert(spark.createDataFrame([("u0", "i0", 10**6)], schema)) == [b for b, n in table.manifest().items() if before[b] != n]
    assert sum(n != before[b] for b, n in table.manifest().items()) == 1


def test_late_rows_come_in_their_place_or_not_at_all(spark, tmp_path):
    """Snapshots in several batches with a restart: repeats within a day count once, rows behind the watermark are dropped."""
    folder, schema = str(tmp_path), "train_no string, station_no int, obs_date date, seen_at timestamp"
    days = lambda d, h=0: START + timedelta(days=d, hours=h)
    row = lambda train, d, h=0: (train, 1, days(d).date(), days(d, h))
    batches = [[row("1", 0), row("1", 0, 2), row("2", 0)], [row("1", 0, 5), row("2", 1)], [row("3", 4)], [row("4", 0), row("2", 1, 3), row("3", 4, 1), row("5", 4, 2)]]
    for number, own in enumerate(batches):
        put(spark, folder, number, own, schema)
        run(spark, folder, schema, feeds.dedupe_snapshots)
    got = sorted((r.train_no, r.obs_date.day) for r in spark.read.parquet(f"{folder}/out").collect())
    assert got == [("1", 1), ("2", 1), ("2", 2), ("3", 5), ("5", 5)]


def test_windows_close_with_a_later_row(spark, tmp_path):
    folder, schema = str(tmp_path), "train_no string, obs_ts timestamp, station_no int, delay string"
    days = [[0, 1, 0], [2, 1], [3, 2]]
    rows = []
    for number, batch in enumerate(days):
        own = [("12", START + timedelta(days=d, hours=i), 1, str(5 + i)) for i, d in enumerate(batch)]
        rows += own
        put(spark, folder, number, own, schema)
    put(spark, folder, 90, [("99", START + timedelta(days=9), 1, "0")], schema)
    run(spark, folder, schema, feeds.delay_stream)
    got = spark.read.parquet(f"{folder}/out").filter("train_no = '12'").agg(F.sum("n"), F.sum("sum_delay")).first()
    assert tuple(got) == (len(rows), sum(int(r[3]) for r in rows))


def test_keys_share_slots_of_state(spark, tmp_path, monkeypatch):
    """Many keys, one of them NULL, in three slots: each is counted for itself."""
    import random

    monkeypatch.setattr(feeds, "SLOTS", 3)
    rng, folder = random.Random(4), str(tmp_path)
    rows = [(rng.choice([None, *[f"k{i}" for i in range(60)]]), i, START + timedelta(seconds=rng.randrange(300))) for i in range(1500)]
    put(spark, folder, 0, rows, HITS)
    feed = spark.readStream.schema(HITS).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    end = spark.createDataFrame([("the end", 0, START + timedelta(hours=2))], HITS)
    out = feeds.finished(lambda df: feeds.sliding_limit_stream(df, 3, 60, "20 minutes"), feed, end, f"{folder}/run")
    got = sorted((r.event_id, r.hits, r.flagged) for r in out.where("key IS NULL OR key <> 'the end'").collect())
    twin = sliding_limit(spark.createDataFrame(rows, HITS), "key", "ts", "event_id", 3, 60)
    assert got == sorted((r.event_id, r.hits, r.flagged) for r in twin.collect()) and len(got) == 1500
