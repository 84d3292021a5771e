"""Mixing sources to target weights by Sainte-Laguë apportionment.

Each source has a target in words. The words of a source, in a seeded order of its documents, are cut into blocks of
equal size. The blocks of the mix are given to the sources by the highest quotients target / (2 seats + 1), and a source's
blocks in the same way to its shards, so that every shard has an integer quota of each source. In a shard, the quota is
taken from the stream of blocks at even steps from a seeded start.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import Steps

#: Fixed value: words stand between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Copies of one document that are placed together; a larger number of copies is spread over the shards.
COPIES = 64


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, most: int) -> list[float]:
    """Each source's part of ``share`` of all sizes by weight, at most ``most`` times its size; the excess is reshared."""
    full = [False] * len(sizes)
    while True:
        rest = share * sum(sizes) - most * sum(n for n, f in zip(sizes, full) if f)
        open_weight = sum(w for w, f in zip(weights, full) if not f)
        now = [f or most * n <= w * rest / open_weight for n, w, f in zip(sizes, weights, full)]
        if now == full:
            return [float(most * n) if f else w * rest / open_weight for n, w, f in zip(sizes, weights, full)]
        full = now
        if all(full):
            return [float(most * n) for n in sizes]


def apportioned(votes: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats of each row by the highest quotients votes / (2 seats + 1), ties to the earlier row, none above its cap.

    Rounding votes times a multiplier gives all seats above one quotient; the multiplier is brought so near that only
    the last seats are left, and those go out one by one from a heap.
    """
    votes, caps = np.asarray(votes, float), np.asarray(caps, np.int64)
    seats = min(seats, int(caps[votes > 0].sum()))

    def above(multiplier: float) -> np.ndarray:
        return np.minimum(caps, np.floor(votes * multiplier + 0.5)).astype(np.int64)

    low, high = 0.0, 1.0
    while above(high).sum() < seats:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        if above(middle).sum() <= seats:
            low = middle
        else:
            high = middle
    got = above(low * (1 - 1e-9))  # a quotient that rounding brings to the edge is left to the heap
    heap = [(-votes[i] / (2 * got[i] + 1), i) for i in np.flatnonzero((got < caps) & (votes > 0)).tolist()]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def _source_seats(weights: Sequence[float], share: float, most: int):
    def run(sources: pd.DataFrame) -> pd.DataFrame:
        sources = sources.sort_values("source", key=lambda c: c.map(lambda s: (s is None, s or ""))).reset_index(drop=True)
        own = [weights[i % len(weights)] for i in range(len(sources))]
        size, blocks = sources["size"].to_numpy(np.int64), sources["blocks"].to_numpy(np.int64)
        sources["target"] = targets([int(n) for n in size], own, share, most)
        votes = sources["target"] * blocks / np.maximum(size, 1)
        sources["seats"] = apportioned(votes.to_numpy(), int(np.floor(sum(votes) + 0.5)), most * blocks)
        return sources[["source", "size", "target", "seats"]]

    return run


def _shard_seats(most: int):
    def run(shards: pd.DataFrame) -> pd.DataFrame:
        shards = shards.sort_values("shard").reset_index(drop=True)
        blocks = shards["blocks"].to_numpy(np.int64)
        shards["quota"] = apportioned(blocks, int(shards["seats"].iloc[0]), most * blocks)
        return shards[["source", "shard", "words", "blocks", "quota", "source_size", "target"]]

    return run


def _seed_of(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


def _number(digest: str | Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def mixed(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, block_words: int = 64, shard_words: int = 1 << 22,
    seed: int = 11, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
) -> DataFrame:
    """doc_id, source, digest, size, source_size, target, spans: one row per row of docs.

    ``spans`` lists the words of the document that the mix takes: (start, length, times), ascending, apart; ``times`` is
    at most ``most``, and so no document gives more than ``most`` times its words. ``digest`` is the MD5 of the text.
    Sources stand in the order of their code points, null (a source of its own) last, and have ``weights`` by turns;
    they share ``share`` of all words, none gets more than ``most`` times its own words, and the excess is reshared by weight. A source's words
    differ from its target by some blocks of ``block_words`` at most. A null text has no words; documents without words
    have no spans. Repeated rows are documents of their own; many copies are spread over the shards. Ties of quotients go
    to the earlier source and shard. Equal input gives equal rows, in whatever order it comes. Other columns are not
    read. An empty table gives none. The table of sources is worked on in one task, that of a source's shards in another;
    a text of any length is read whole, in one task.
    """
    steps = Steps(docs.sparkSession, "mixed")
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{source_column}`").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.md5(text).alias("digest"))
    copies = rows.groupBy("doc_id", "source", "size", "digest").agg(F.count("*").alias("n"))
    parts = copies.withColumn("part", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})")))
    parts = parts.withColumn("n", F.least(F.lit(COPIES).cast("long"), F.col("n") - COPIES * F.col("part")))
    place = _seed_of(F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest", F.col("part").cast("string"))
    entries = steps.table(parts.withColumn("place", place).withColumn("words", F.col("size") * F.col("n")), "entries")
    total = entries.agg(F.sum("words")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    entries = entries.withColumn("shard", _number("place") % shards)

    streams = entries.groupBy("source", "shard").agg(F.sum("words").alias("words")).withColumn("blocks", F.expr(f"(words + {block_words} - 1) div {block_words}"))
    streams = steps.table(streams, "streams")
    sources = streams.groupBy("source").agg(F.sum("words").alias("size"), F.sum("blocks").alias("blocks"))
    sources = sources.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_source_seats(weights, share, most), "source string, size long, target double, seats long")
    sources = steps.table(sources, "sources").select(F.col("source").alias("of"), F.col("size").alias("source_size"), "target", "seats")
    quotas = streams.join(sources, streams.source.eqNullSafe(sources.of)).groupBy("source").applyInPandas(
        _shard_seats(most), "source string, shard long, words long, blocks long, quota long, source_size long, target double")
    turn = F.when(F.col("blocks") > 0, _number(_seed_of(F.lit(str(seed)), F.coalesce("source", F.lit("")), F.col("shard").cast("string"))) % F.col("blocks"))
    quotas = quotas.select(F.col("source").alias("of"), F.col("shard").alias("in"), F.col("words").alias("stream"), "blocks", "quota", "source_size", "target", turn.alias("turn"))

    before = Window.partitionBy("source", "shard").orderBy("place", "doc_id", "digest", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = entries.withColumn("begin", F.coalesce(F.sum("words").over(before), F.lit(0)))
    met = placed.join(quotas, placed.source.eqNullSafe(quotas["of"]) & (placed.shard == quotas["in"]))
    each = met.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    each = each.withColumn("begin", F.col("begin") + F.col("copy") * F.col("size"))
    return each.select("doc_id", "source", "digest", "size", "source_size", "target", _spans().alias("spans"))


def _spans() -> Column:
    """Blocks of a stream have its words in equal parts; block k is taken as often as k quota / blocks passes a whole number."""
    spans = """
        filter(transform(
            sequence(((begin + 1) * blocks - 1) div stream, ((begin + size) * blocks - 1) div stream),
            k -> named_struct(
                'start', greatest(k * stream div blocks - begin, 0L),
                'length', least((k + 1) * stream div blocks - begin, size) - greatest(k * stream div blocks - begin, 0L),
                'times', ((k + 1) * quota + turn) div blocks - (k * quota + turn) div blocks)),
            s -> s.times > 0)"""
    none = "cast(array() as array<struct<start: bigint, length: bigint, times: bigint>>)"
    return F.expr(f"if(size > 0, {spans}, {none})")


def taken_words() -> Column:
    """Words that the mix takes of a row of mixed(), repeats counted."""
    return F.expr("aggregate(spans, 0L, (n, s) -> n + s.length * s.times)")


def mixed_texts(mix: DataFrame, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """doc_id, source, start, times, text: the spans of mixed(docs) as texts, words joined by one space."""
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    texts = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{source_column}`").cast("string").alias("of"), F.md5(text).alias("sum"), text.alias("whole"))
    texts = texts.dropDuplicates(["id", "of", "sum"])
    spans = mix.where(F.size("spans") > 0)
    met = spans.join(texts, spans.doc_id.eqNullSafe(texts.id) & spans.source.eqNullSafe(texts.of) & (spans.digest == texts.sum))
    words = met.select("doc_id", "source", "spans", F.regexp_extract_all("whole", F.lit(f"({WORD})")).alias("words"))
    each = words.select("doc_id", "source", "words", F.explode("spans").alias("s"))
    piece = F.array_join(F.slice("words", (F.col("s.start") + 1).cast("int"), F.col("s.length").cast("int")), " ")
    return each.select("doc_id", "source", "s.start", "s.times", piece.alias("text"))
