"""Structured Streaming forms of the delay feed, the snapshot collector, the hit limiter and the user tables.

Late data: the watermark is one day by default; later rows are dropped.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .. import fixed
from ..operators.delays import clean_observations
from ..operators.userlog import keep_newest
from ..sources.keyed import KeyedTable

#: Processors travel to the workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def delay_stream(
    raw: DataFrame, event_time: str = "obs_ts", window: str = "1 day", watermark: str = "1 day",
    on_time: int = fixed.ON_TIME_MINUTES,
) -> DataFrame:
    """Tumbling delay sums per train: count, sum and on-time count, ready to be added up.

    A window comes out once the watermark has passed its end. The last ones stay open until later rows move the
    watermark on: a row one window and one watermark after the end of the feed closes them all. Then the sums of
    all windows of a train add up to its whole history.
    """
    stamped = raw.withColumn("obs_date", F.to_date(event_time))
    clean = clean_observations(stamped.select("train_no", "obs_date", "station_no", "delay"))
    # the cleaning keeps no time column, so the day stands for it
    timed = clean.withColumn("event_time", F.col("obs_date").cast("timestamp")).filter(F.col("delay_min").isNotNull())
    return (
        timed.withWatermark("event_time", watermark)
        .groupBy(F.window("event_time", window), "train_no")
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum("delay_min").alias("sum_delay"),
            F.count_if(F.col("delay_min") <= on_time).alias("on_time_n"),
        )
        .select("train_no", F.col("window.start").alias("window_start"), "n", "sum_delay", "on_time_n")
    )


def sketch_stream(
    raw: DataFrame, event_time: str = "obs_ts", window: str = "1 day", watermark: str = "1 day",
    on_time: int = fixed.ON_TIME_MINUTES, k: int = 200,
) -> DataFrame:
    """Tumbling sums per train as delay_stream, with a KLL sketch of the delays: state of bounded size per window.

    A sketch of ``k`` is exact up to k values; beyond, a rank is off by 1.65 % of the values at k = 200, with 99 %
    confidence. Sketches of any windows merge: see sketch_percentiles.
    """
    stamped = raw.withColumn("obs_date", F.to_date(event_time))
    clean = clean_observations(stamped.select("train_no", "obs_date", "station_no", "delay"))
    timed = clean.withColumn("event_time", F.col("obs_date").cast("timestamp")).filter(F.col("delay_min").isNotNull())
    return (
        timed.withWatermark("event_time", watermark)
        .groupBy(F.window("event_time", window), "train_no")
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum("delay_min").alias("sum_delay"), F.count_if(F.col("delay_min") <= on_time).alias("on_time_n"),
            F.kll_sketch_agg_bigint(F.col("delay_min").cast("bigint"), F.lit(k)).alias("sketch"),
        )
        .select("train_no", F.col("window.start").alias("window_start"), "n", "sum_delay", "on_time_n", "sketch")
    )


def sketch_percentiles(windows: DataFrame, by: list[str]) -> DataFrame:
    """Counts, mean, share on time and p50, p80, p90 of the merged windows of each key."""
    merged = windows.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("sum_delay").alias("sum_delay"), F.sum("on_time_n").alias("on_time_n"), F.kll_merge_agg_bigint("sketch").alias("sketch"))
    at = F.kll_sketch_get_quantile_bigint("sketch", F.array(F.lit(0.5), F.lit(0.8), F.lit(0.9)))
    return merged.withColumn("q", at).select(
        *by, "n", F.bround(F.col("sum_delay") / F.col("n"), 1).alias("avg_delay"), F.bround(100.0 * F.col("on_time_n") / F.col("n"), 1).alias("on_time_pct"),
        F.get("q", F.lit(0)).alias("p50"), F.get("q", F.lit(1)).alias("p80"), F.get("q", F.lit(2)).alias("p90"))


def histogram_stream(raw: DataFrame, event_time: str = "obs_ts", watermark: str = "1 day") -> DataFrame:
    """Counts per day, train and delay: exact percentiles of any span come from their sum."""
    stamped = raw.withColumn("obs_date", F.to_date(event_time))
    clean = clean_observations(stamped.select("train_no", "obs_date", "station_no", "delay"))
    timed = clean.withColumn("event_time", F.col("obs_date").cast("timestamp")).filter(F.col("delay_min").isNotNull())
    return (
        timed.withWatermark("event_time", watermark)
        .groupBy(F.window("event_time", "1 day"), "train_no", "delay_min")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("train_no", "delay_min", F.col("window.start").alias("window_start"), "n")
    )


def dedupe_snapshots(snapshots: DataFrame, event_time: str = "seen_at", watermark: str = "1 day") -> DataFrame:
    """Arrival snapshots with one row per train, station and date; state is freed with the watermark."""
    return snapshots.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(
        ["train_no", "station_no", "obs_date"]
    )


LIMIT_SCHEMA = "key string, event_id bigint, ts timestamp, hits int, flagged boolean"
#: Pieces that the hits of a window are kept in, and slots that the keys fall into.
PIECES, SLOTS = 16, 256


class SlidingHits(StatefulProcessor):
    """Counts the hits of a slot of keys in one span of one window length, as the watermark passes its pieces.

    State: per piece the keys, times and ids of its own hits and the keys and times of the span before. A piece is
    worked on once, for all keys of the slot, by a timer at its end. The last timer of a span removes its state.
    """

    def __init__(self, limit: int, width: int):
        self.limit, self.width, self.piece = limit, width, -(-width // PIECES)

    def init(self, handle: StatefulProcessorHandle) -> None:
        longs = ArrayType(LongType())
        self.handle = handle
        piece = StructType([StructField("piece", LongType())])
        hits = StructType([StructField("keys", ArrayType(StringType())), StructField("times", longs), StructField("ids", longs)])
        self.hits = handle.getMapState("hits", piece, hits)

    def _due(self, piece: int) -> int:
        """Milliseconds by which no more hits of a piece can come."""
        return -(-(piece + 1) * self.piece // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        span = int(key[1])
        known = set(self.handle.listTimers())
        for batch in rows:
            keys = batch["key"].to_numpy(object)
            times = batch["us"].to_numpy(np.int64)
            ids = np.where(batch["own"].to_numpy(bool), batch["event_id"].to_numpy(np.int64), -1)
            piece = times // self.piece
            for p in np.unique(piece).tolist():
                at = piece == p
                old = self.hits.getValue((p,)) if self.hits.containsKey((p,)) else ([], [], [])
                self.hits.updateValue((p,), ([*old[0], *keys[at].tolist()], [*old[1], *times[at].tolist()], [*old[2], *ids[at].tolist()]))
                # due when the piece ends, if it has hits of this span
                if (ids[at] >= 0).any() and self._due(p) not in known:
                    known.add(self._due(p))
                    self.handle.registerTimer(self._due(p))
        end = self._due(((span + 1) * self.width - 1) // self.piece)
        if end not in known:
            self.handle.registerTimer(end)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, span = expiredTimerInfo.getExpiryTimeInMs(), int(key[1])
        piece = due * 1000 // self.piece - 1
        while self._due(piece) > due:
            piece -= 1
        first = (piece * self.piece - self.width) // self.piece
        held = {int(p[0]): hits for p, hits in self.hits.iterator() if first <= p[0] <= piece}
        if piece in held:
            keys = np.array([k for p in held for k in held[p][0]], object)
            times, ids = (np.concatenate([np.array(held[p][i], np.int64) for p in held]) for i in (1, 2))
            fresh = np.repeat([p == piece for p in held], [len(held[p][1]) for p in held])
            codes = pd.factorize(keys, use_na_sentinel=False)[0].astype(np.int64)
            order = np.lexsort((ids, times, codes))
            keys, times, ids, fresh, codes = (x[order] for x in (keys, times, ids, fresh, codes))
            # keys one after the other on one line, more than a window apart
            line = times - times.min() + self.width + 1
            line += codes * (line.max() + 1)
            counts = np.arange(1, len(line) + 1) - np.searchsorted(line, line - self.width, "right")
            own = fresh & (ids >= 0)
            if own.any():
                yield pd.DataFrame({
                    "key": keys[own], "event_id": ids[own], "ts": times[own].astype("datetime64[us]"), "hits": counts[own].astype(np.int32), "flagged": counts[own] > self.limit})
        if piece >= ((span + 1) * self.width - 1) // self.piece:
            self.hits.clear()

    def close(self) -> None:
        pass


def sliding_limit_stream(
    hits: DataFrame, limit: int, window_s: int, watermark: str = "10 minutes"
) -> DataFrame:
    """Hit counter per key over a trailing window, equal to the batch counter for rows in any order.

    ``hits`` has key, event_id (not negative) and ts. A hit comes out once the watermark has passed its piece, a
    sixteenth of the window, as no earlier hit can then follow; rows later than the watermark are dropped. Keys share
    slots, so that state and timers do not grow with their number; a slot is spread over its spans of one window
    length, each with a copy of the span before as history. A finished feed is
    closed by a row a window and a watermark after its last one: see finished. The state store is RocksDB, which this
    sets for the session.
    """
    if window_s <= 0:
        return hits.select("key", "event_id", "ts", F.lit(1).alias("hits"), F.lit(False).alias("flagged"))
    width = window_s * 1_000_000
    hits.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = hits.withWatermark("ts", watermark).withColumn("us", F.unix_micros("ts"))
    own = F.floor(F.col("us") / width).cast("bigint")
    both = timed.withColumn("span", F.explode(F.array(own, own + 1))).withColumn("own", F.col("span") == own)
    both = both.withColumn("slot", F.pmod(F.xxhash64("key"), F.lit(SLOTS)).cast("int"))
    return both.groupBy("slot", "span").transformWithStateInPandas(
        statefulProcessor=SlidingHits(limit, width), outputStructType=LIMIT_SCHEMA, outputMode="append", timeMode="eventTime")


def finished(
    stream: Callable[[DataFrame], DataFrame], feed: DataFrame, closing: DataFrame, folder: str
) -> DataFrame:
    """All rows of a feed that has ended, its last windows and hits among them.

    Runs the stream over the feed there is, then once more over the closing rows, which move the watermark past all
    others; both runs share one checkpoint. The closing rows' own output, if any, is to be left out by the caller.
    """
    spark = feed.sparkSession
    more = f"{folder}/closing"
    # an empty file, so that there is a folder to watch
    closing.limit(0).write.mode("overwrite").parquet(more)
    both = feed.unionByName(spark.readStream.schema(feed.schema).parquet(more))
    out = stream(both)
    for last in (False, True):
        if last:
            closing.write.mode("append").parquet(more)
        running = (
            out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True).outputMode("append").start()
        )
        running.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def merge_latest(path: str, keys: list[str], order: list[str], buckets: int = 64):
    """A ``foreachBatch`` writer: the latest row per key so far, in a table of buckets by key.

    A batch rewrites the buckets that its keys fall into and leaves the others as they are. A batch that is run again
    after a failure gives the same version again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        KeyedTable(batch.sparkSession, path, keys, order, buckets).upsert(batch, batch_id)

    return write


def current_table(spark: SparkSession, path: str) -> DataFrame:
    """The latest row per key over all batches: the newest finished version."""
    return KeyedTable.open(spark, path).read()


def newest_per_user(spark: SparkSession, path: str, order: list[str], user: str = "user_id", n: int = 8) -> DataFrame:
    """The newest ``n`` rows per user of the current table."""
    return keep_newest(current_table(spark, path), user, order, n)
