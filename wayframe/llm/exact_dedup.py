"""Exact duplicates by composable polynomial fingerprints, confirmed by comparing the texts chunk by chunk.

A text is cut into chunks of fixed size. Each chunk has a polynomial hash, and the hashes of two neighbours combine
by shifting the left one by the length of the right one, so that any cutting gives the same fingerprint. Texts of
equal fingerprint and length are then compared in chunks with the text that stays; texts that only share a
fingerprint are told apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import Steps, free_name
from .words import text_bytes

CHUNK = 1 << 16
#: Two primes below 2^31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 747796405)
#: Members that are compared in one group of the comparison; a larger group of copies is split.
MEMBERS = 64


def powers(chunk: int = CHUNK) -> list[np.ndarray]:
    """For each prime, base^(chunk-1) ... base^0."""
    out = []
    for p, b in zip(PRIMES, BASES):
        row = np.ones(1, np.int64)
        while len(row) < chunk:  # doubles each time: the upper half is the lower one shifted by its length
            row = np.concatenate([row * pow(b, len(row), p) % p, row])
        out.append(row[-chunk:])
    return out


def chunk_hash(raw: np.ndarray, tables: list[np.ndarray]) -> tuple[int, int]:
    values = raw.astype(np.int64) + 1
    return tuple(int(np.dot(values, t[len(t) - len(raw) :])) % p for t, p in zip(tables, PRIMES))


def combine(left: tuple[int, int], right: tuple[int, int], right_size: int) -> tuple[int, int]:
    """Hash of two neighbouring pieces, from their hashes and the right one's size."""
    return tuple((a * pow(b, right_size, p) + c) % p for a, c, p, b in zip(left, right, PRIMES, BASES))


def fingerprint(raw: np.ndarray, tables: list[np.ndarray], bits: int = 62) -> int:
    whole = (0, 0)
    step = len(tables[0])
    for lo in range(0, len(raw), step):
        piece = raw[lo : lo + step]
        whole = combine(whole, chunk_hash(piece, tables), len(piece))
    return ((whole[0] << 31) | whole[1]) & ((1 << bits) - 1)


def same_text(a: memoryview, b: memoryview, chunk: int = CHUNK) -> bool:
    return len(a) == len(b) and all(a[i : i + chunk] == b[i : i + chunk] for i in range(0, len(a), chunk))


def _marks(id_type: str, with_text: bool, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = powers()
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
            prints = [fingerprint(raw[a:b], tables, bits) for a, b in spans]
            digests = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in spans]
            columns = [batch.column(0), pa.array(prints, pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(digests)]
            names = ["id", "print", "size", "sha"]
            if with_text:
                columns, names = [*columns, batch.column(1)], [*names, "text"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {id_type}, print long, size long, sha string" + ", text string" * with_text
    return run, schema


def piece_fingerprints(pieces: DataFrame) -> DataFrame:
    """id, print, size of documents that come as pieces (id, seq, text), each piece hashed where it lies.

    The pieces of a document may lie in any tasks; only their hashes meet, each shifted by the length that follows it.
    The result is that of the joined text, however it is cut. Null text is empty. ``seq`` is unique in a document.
    """
    spark_type = pieces.schema["id"].dataType.simpleString()
    schema = f"id {spark_type}, seq long, size long, low long, high long"

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = powers()
        for batch in batches:
            raw, offsets = text_bytes(batch.column(2))
            prints = [fingerprint(raw[a:b], tables) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            halves = [pa.array([f >> 31 for f in prints], pa.int64()), pa.array([f & ((1 << 31) - 1) for f in prints], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets)), *halves], ["id", "seq", "size", "low", "high"])

    @F.arrow_udf("struct<low: long, high: long>")
    def shifted(low: pa.Array, high: pa.Array, after: pa.Array) -> pa.Array:
        sizes = after.to_pylist()
        parts = [pa.array([h * pow(b, n, p) % p for h, n in zip(x.to_pylist(), sizes)], pa.int64()) for x, p, b in zip((low, high), PRIMES, BASES)]
        return pa.StructArray.from_arrays(parts, ["low", "high"])

    rows = pieces.select("id", F.col("seq").cast("long"), F.col("text").cast("string")).mapInArrow(hashes, schema)
    behind = Window.partitionBy("id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)  # one row per piece
    after = F.coalesce(F.sum("size").over(behind), F.lit(0))
    moved = rows.withColumn("after", after).withColumn("s", shifted("low", "high", "after"))
    whole = moved.groupBy("id").agg(F.sum("size").alias("size"), (F.sum("s.low") % PRIMES[0]).alias("low"), (F.sum("s.high") % PRIMES[1]).alias("high"))
    return whole.select("id", F.shiftleft("low", 31).bitwiseOR(F.col("high")).alias("print"), "size")


def _odd_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group, the text that stays first; gives the rows whose text is another one."""
    group, first = None, b""
    for batch in batches:
        rows = []
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
        raw, offsets = text_bytes(batch.column("text"))
        view = memoryview(raw)
        for i, key in enumerate(keys):
            text = view[offsets[i] : offsets[i + 1]]
            if key != group:
                group, first = key, memoryview(bytes(text))
            elif not same_text(text, first):
                rows.append(i)
        yield batch.select(["id", "print", "size", "sha"]).take(pa.array(rows, pa.int64()))


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bits: int = 62) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Of rows with equal texts the one with the largest id stays. A null text counts as empty, a null id is below all
    others. Of repeated rows (same id, same text) one is kept, and all count in group_size. An empty table gives
    none. Other columns of docs are not read. ``bits`` narrows the fingerprint (tests make it collide).
    """
    spark = docs.sparkSession
    steps = Steps(spark, "exact")
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    marks = steps.table(rows.mapInArrow(*_marks(id_type, False, bits)), "marks")
    entries = marks.groupBy("id", "print", "size", "sha").agg(F.count("*").alias("copies"))
    groups = entries.groupBy("print", "size").agg(F.sum("copies").alias("n"), F.max(F.struct("id", "sha")).alias("stay")).where("n > 1")
    pieces = F.ceil(F.col("n") / MEMBERS)
    members = entries.join(groups, ["print", "size"]).select(
        F.col("id").alias("m_id"), F.col("sha").alias("m_sha"), pieces.cast("int").alias("pieces"),
        (F.struct("id", "sha") == F.col("stay")).alias("stays"))
    texts = rows.mapInArrow(*_marks(id_type, True, bits))
    met = texts.join(members, (texts.id.eqNullSafe(members.m_id)) & (texts.sha == members.m_sha))
    spread = F.when(F.col("stays"), F.sequence(F.lit(0), F.col("pieces") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")))
    compared = met.select("print", "size", F.explode(spread).alias("piece"), (~F.col("stays")).alias("later"), "id", "sha", "text")
    odd = (
        compared.repartition("print", "size", "piece").sortWithinPartitions("print", "size", "piece", "later")
        .mapInArrow(_odd_ones, f"id {id_type}, print long, size long, sha string").distinct()
        .select("id", "sha", F.col("sha").alias("other"))
    )
    odd = steps.table(odd, "odd")
    told = entries.alias("e").join(odd.alias("o"), F.col("e.id").eqNullSafe(F.col("o.id")) & (F.col("e.sha") == F.col("o.sha")), "left").select(
        "e.id", "e.print", "e.size", "e.sha", "e.copies", F.coalesce("o.other", F.lit("")).alias("other"))
    sizes = told.groupBy("print", "size", "other").agg(F.sum("copies").alias("group_size"), F.max("id").alias("keep_id"))
    return (
        told.join(sizes, ["print", "size", "other"])
        .select("id", "keep_id", "group_size", "sha", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
        .select(
            F.col("id").alias(id_column), "keep_id", "group_size",
            (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))
    )


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; see exact_groups."""
    key, number = free_name(docs.columns, "id_and_digest"), free_name(docs.columns, "row_of_digest")
    kept = exact_groups(docs, id_column, text_column).where("kept").select(F.struct(F.col(id_column).alias("id"), F.col("text_sha256").alias("sha")).alias("kept_key"))
    digest = F.sha2(F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")), 256)
    marked = docs.withColumn(key, F.struct(F.col(f"`{id_column}`").alias("id"), digest.alias("sha")))
    chosen = marked.join(kept, marked[key] == kept["kept_key"], "left_semi")
    once = chosen.withColumn(number, F.row_number().over(Window.partitionBy(key).orderBy(F.lit(1))))
    return once.where(F.col(number) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
