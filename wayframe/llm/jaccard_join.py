"""Near-duplicates by the Jaccard similarity of word n-gram sets, found by MinHash bands and verified on the full sets.

Documents of equal n-gram sets form one class, which takes part once. Bands of MinHash values meet in a shuffle; what
meets is joined to candidate groups. Each group's sets are then compared block against block, so that no task holds
more than two blocks and no list of candidate pairs is ever written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .tables import Steps, free_name
from .words import MULTIPLY_A, MULTIPLY_B, Words, joined, mix, separators, text_bytes, window_hashes

GRAM = 5
SIMILARITY = 0.8
#: Least probability that a pair of just this similarity meets in a band, and the most MinHash values to spend on it.
RECALL = 0.999
VALUES = 128
#: Classes of a candidate group in a block.
BLOCK = 256
SLICE = 2 << 20


def band_shape(similarity: float = SIMILARITY, recall: float = RECALL, values: int = VALUES) -> tuple[int, int]:
    """Bands and rows: the most rows (fewest chance meetings) that reach the recall within the values."""
    best = None
    for rows in range(1, values + 1):
        miss = 1 - similarity**rows
        bands = max(1, int(np.ceil(np.log(1 - recall) / np.log(miss)))) if miss > 0 else 1
        if bands * rows <= values:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"{values} values do not reach a recall of {recall}")
    return best


def gram_sets(column: pa.Array, gram: int = GRAM) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First text, end text, sorted distinct n-gram hashes of each text one after the other, offsets.

    A text of fewer words has one n-gram of all its words; a text without words has none.
    """
    raw, offsets = text_bytes(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
        words = Words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], separators())
        owner, count = words.owner(), words.counts()
        grams = window_hashes(words.hash, gram)
        inside = owner[: len(grams)] == owner[gram - 1 : gram - 1 + len(grams)]
        short = np.flatnonzero((count > 0) & (count < gram))
        lone = [window_hashes(words.hash[words.of[i] : words.of[i + 1]], int(count[i]), int(count[i]))[0] for i in short.tolist()]
        hashes = np.concatenate([grams[inside], np.array(lone, np.uint64)])
        of = np.concatenate([owner[: len(grams)][inside], short])
        order = np.lexsort((hashes, of))
        hashes, of = hashes[order], of[order]
        first = np.ones(len(hashes), bool)
        first[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
        yield lo, hi, hashes[first], np.searchsorted(of[first], np.arange(hi - lo + 1))
        lo = hi


def set_name(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(np.ascontiguousarray(grams, "<u8").tobytes(), digest_size=16).digest()


def band_keys(grams: np.ndarray, off: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Keys of each text with n-grams, one row per text, from its MinHash values."""
    salt = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * MULTIPLY_A)
    least = np.full((len(off) - 1, bands * rows), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(grams), 1 << 13):
        hi = min(len(grams), lo + (1 << 13))
        first = np.searchsorted(off, lo, "right") - 1
        last = np.searchsorted(off, hi, "left")
        edge = np.maximum(off[first:last], lo) - lo
        values = (grams[lo:hi, None] ^ salt[None, :]) * MULTIPLY_B
        filled = np.flatnonzero(np.diff(np.append(edge, hi - lo)) > 0)
        least[first + filled] = np.minimum(least[first + filled], np.minimum.reduceat(values, edge[filled], axis=0))
    keys = np.tile(np.arange(bands, dtype=np.uint64), (len(least), 1))
    for r in range(rows):
        keys = joined(keys, least[:, r::rows])
    return keys


def _marks(id_type: pa.DataType, gram: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, grams, off in gram_sets(batch.column(1), gram):
                keys = band_keys(grams, off, bands, rows)
                filled = np.diff(off) > 0
                edge = np.concatenate([[0], np.cumsum(filled * bands)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(edge, pa.array(keys[filled].ravel().view(np.int64)))
                names = [set_name(grams[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(names, pa.binary()), pa.array(np.diff(off)), lists], ["id", "node", "grams", "bands"])

    return run


def _sets(gram: int):
    """Rows (text, node, ...) become (node, ..., set); rows of an equal id but another set are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.select(["node", "component", "blocks", "size"])
            for lo, hi, grams, off in gram_sets(batch.column("text"), gram):
                part = rest.slice(lo, hi - lo)
                spans = list(zip(off[:-1].tolist(), off[1:].tolist()))
                fits = [i for i, (node, (a, b)) in enumerate(zip(part.column("node").to_pylist(), spans)) if set_name(grams[a:b]) == node]
                data = [grams[a:b].tobytes() for a, b in (spans[i] for i in fits)]
                part = part.take(pa.array(fits, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], [*part.schema.names, "grams"])

    return run


def overlaps(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections, as products of a 0/1 matrix taken some n-grams at a time."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1  # an n-gram of one set is in no intersection
    owner, number = owner[shared], number[shared]
    number = np.unique(number, return_inverse=True)[1]
    total = np.zeros((n, n))
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, columns):
        a, b = np.searchsorted(number, [lo, lo + columns])
        matrix = np.zeros((n, min(columns, int(number[-1]) + 1 - lo)), np.float32)
        matrix[owner[a:b], number[a:b] - lo] = 1
        total += matrix @ matrix.T
    total[np.arange(n), np.arange(n)] = size
    return total


def _compare(similarity: float):
    """Rows come sorted by (component, low, high); gives links per class and a spanning forest of the linked classes."""

    def group(rows) -> pa.RecordBatch:
        unique = {r[0]: r for r in rows}
        nodes, block, size, sets = zip(*((k, r[1], r[2], np.frombuffer(r[3], np.uint64)) for k, r in unique.items()))
        block, size = np.array(block), np.array(size)
        length = np.array([len(s) for s in sets])
        both = overlaps(list(sets))
        alike = both / np.maximum(length[:, None] + length[None, :] - both, 1) >= similarity
        np.fill_diagonal(alike, False)
        if block.min() != block.max():
            alike &= block[:, None] != block[None, :]  # pairs within a block are compared in its own group
        links = (alike * size[None, :]).sum(axis=1)
        root = list(range(len(nodes)))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        a, b = [], []
        for i, j in zip(*np.nonzero(np.triu(alike))):
            x, y = find(int(i)), find(int(j))
            if x != y:
                root[y] = x
                a.append(nodes[i])
                b.append(nodes[j])
        met = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays(
            [pa.array([nodes[i] for i in met] + a, pa.binary()), pa.array([None] * len(met) + b, pa.binary()), pa.array(links[met].tolist() + [0] * len(a), pa.int64())],
            ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for component, low, high, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (component, low, high) != key:
                    if len(rows) > 1:
                        yield group(rows)
                    key, rows = (component, low, high), []
                rows.append(row)
        if len(rows) > 1:
            yield group(rows)

    return run


def set_names(gram: int):
    """A column function: name of the n-gram set of a text."""

    @F.arrow_udf("binary")
    def names(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for _, _, grams, off in gram_sets(batch, gram):
                out += [set_name(grams[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.array(out, pa.binary())

    return names


def _classes(docs: DataFrame, id_column: str, text_column: str, gram: int, similarity: float, recall: float, values: int) -> tuple[DataFrame, DataFrame]:
    """Marks (id, node, grams) of all rows, and (node, size, low, links, component) of all n-gram sets."""
    from pyspark.sql.pandas.types import to_arrow_type

    steps = Steps(docs.sparkSession, "jaccard")
    bands, rows = band_shape(similarity, recall, values)
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    kind = texts.schema["id"].dataType
    marks = texts.mapInArrow(_marks(to_arrow_type(kind), gram, bands, rows), f"id {kind.simpleString()}, node binary, grams long, bands array<long>")
    marks = steps.table(marks, "marks")
    classes = steps.table(marks.groupBy("node").agg(F.count("*").alias("size"), F.min("id").alias("low"), F.first("bands").alias("bands")), "classes")

    keys = classes.select("node", F.explode("bands").alias("key"))
    met = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1")
    found = keys.join(met, "key").where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    groups = steps.table(components(found, steps, "candidates"), "groups")

    blocks = groups.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    wanted = groups.join(blocks, "component").join(classes.select("node", "size", F.struct("low").alias("low")), "node")
    sets = (
        texts.withColumn("key", F.struct(F.col("id").alias("low"))).join(wanted, F.col("key") == F.col("low")).select("text", "node", "component", "blocks", "size")
        .mapInArrow(_sets(gram), "node binary, component binary, blocks int, size long, grams binary")
    )
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = sets.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "block", "size", "grams")
    compared = (
        pairs.repartition("component", "low", "high").sortWithinPartitions("component", "low", "high")
        .mapInArrow(_compare(similarity), "a binary, b binary, links long")
    )
    compared = steps.table(compared, "compared")
    links = compared.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    linked = components(compared.where("b IS NOT NULL").select("a", "b"), steps, "linked")
    placed = classes.select("node", "size", "low").join(links, "node", "left").join(linked, "node", "left")
    return marks, placed.select("node", "size", "low", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", gram: int = GRAM, similarity: float = SIMILARITY,
    recall: float = RECALL, values: int = VALUES,
) -> DataFrame:
    """One row per row of docs: id, class_id, n_links, n_grams.

    Words stand between ASCII white space and are compared as they are. ``n_links`` counts the other rows whose n-gram
    sets have at least the given Jaccard similarity, copies included; rows that links join have the class_id of their
    least id. A text of fewer words than an n-gram has one n-gram of all of them. Texts without words, null among
    them, are alike and like nothing else. A null id counts in a class but does not name it, unless it has no other.
    Repeated rows are rows of their own. Other columns are not read. An empty table gives none.

    A pair of just this similarity is found with probability ``recall`` or more, a pair more alike with a higher one;
    what is found is verified on the full sets.
    """
    marks, placed = _classes(docs, id_column, text_column, gram, similarity, recall, values)
    names = placed.groupBy("component").agg(F.min("low").alias("class_id"))
    labelled = placed.join(names, "component").select("node", "class_id", (F.col("size") - 1 + F.col("links")).alias("n_links"))
    return marks.join(labelled, "node").select(F.col("id").alias(id_column), "class_id", "n_links", F.col("grams").alias("n_grams"))


def near_dedup(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", gram: int = GRAM, similarity: float = SIMILARITY,
    recall: float = RECALL, values: int = VALUES,
) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each class (see near_duplicates) the row of the least id.

    Null ids are above all others here. Of several rows of that id and n-gram set the one of the least text stays.
    """
    _, placed = _classes(docs, id_column, text_column, gram, similarity, recall, values)
    first = placed.groupBy("component").agg(F.min(F.struct(F.col("low").isNull().alias("nameless"), "low", "node")).alias("f"))
    kept = first.select(F.struct("f.low", "f.node").alias("kept_key"))
    key, number = free_name(docs.columns, "id_and_set"), free_name(docs.columns, "row_of_set")
    body = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    named = docs.withColumn(key, F.struct(F.col(f"`{id_column}`").alias("low"), set_names(gram)(body).alias("node")))
    chosen = named.join(kept, named[key] == kept["kept_key"], "left_semi")
    once = chosen.withColumn(number, F.row_number().over(Window.partitionBy(key).orderBy(body)))
    return once.where(F.col(number) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
