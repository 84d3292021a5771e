"""Masked pseudo-likelihood of documents under a small bidirectional window network.

The network sees the words on both sides of a masked place and predicts the masked one: embeddings of the window,
one hidden layer, and a two-level softmax (class, word in class). It is trained in numpy on masked places of all
documents: each task follows the gradient over its own documents, and the tasks' weights are averaged, round by round.
A document's score is the sum of the log-probabilities of all its words, each given its window. The network predicts
symbols: frequent words, and hash buckets of the others. A bucketed word's probability is that of its bucket times the
word's share of the bucket's places in the corpus; these shares come from a sharded table of all words' counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Steps
from .words import Words, mix, separators, text_bytes

CLASSES = 32
#: Ids: the most frequent words of the corpus, then hash buckets for all others, then the place outside a document.
RARE = 2 * CLASSES
SIZE = CLASSES * CLASSES
FREQUENT = SIZE - RARE
OUTSIDE = SIZE
#: Words seen on each side.
REACH = 2
EMBEDDING, HIDDEN = 16, 32
ROUNDS = 2
BATCH = 2048
RATE = 0.2
#: Parts of the weights that are averaged apart, and tasks whose weights meet first.
SHARDS, FAN_IN = 16, 1024
SLICE = 2 << 20
#: Logits are held within so much.
STEEPEST = 40.0
#: Bytes of text whose bucketed words are looked up together, and words in a shard of the counts, about.
BLOCK = 8 << 20
SHARD_WORDS, LEAST_SHARDS = 100_000, 64
SYMBOLS = "block long, shard int, words binary, pairs binary, docs binary, times binary, ids array<{kind}>, salts array<long>, n_words array<long>, symbols binary"
SHAPES = {"embedding": (SIZE + 1, EMBEDDING), "inner": (2 * REACH * EMBEDDING, HIDDEN), "inner_bias": (HIDDEN,), "top": (HIDDEN, CLASSES),
          "top_bias": (CLASSES,), "low": (CLASSES, HIDDEN, CLASSES), "low_bias": (CLASSES, CLASSES)}


def window_slices(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """Words of runs of texts of about SLICE bytes: first text, end text, words."""
    raw, offsets = text_bytes(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
        yield lo, hi, Words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], separators())
        lo = hi


@dataclass
class Vocabulary:
    """Hashes of the frequent words, ascending, with their ids; how often each bucket's words occur together."""

    hashes: np.ndarray
    ids: np.ndarray
    bucket_counts: np.ndarray

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        rare = FREQUENT + (mix(hashes) % np.uint64(RARE)).astype(np.int64)
        if not len(self.hashes):
            return rare
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], rare)


def windows(ids: np.ndarray, owner: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Ids around each place, OUTSIDE beyond the document."""
    out = np.full((len(places), 2 * REACH), OUTSIDE, np.int64)
    for k, shift in enumerate((*range(-REACH, 0), *range(1, REACH + 1))):
        at = places + shift
        good = (at >= 0) & (at < len(ids))
        good[good] = owner[at[good]] == owner[places[good]]
        out[good, k] = ids[at[good]]
    return out


def new_weights(shares: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Small random weights; the biases start at the words' shares in the corpus."""
    rng = np.random.default_rng(seed)
    weights = {k: (rng.normal(size=s) * 0.1).astype(np.float32) for k, s in SHAPES.items()}
    grid = (shares + 1e-7).reshape(CLASSES, CLASSES)
    weights["inner_bias"][:] = 0
    weights["top_bias"] = np.log(grid.sum(axis=1)).astype(np.float32)
    weights["low_bias"] = np.log(grid / grid.sum(axis=1, keepdims=True)).astype(np.float32)
    return weights


def _by_class(around: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
    """Order of the targets, windows, classes, words in class and rows in that order, and each class's rows."""
    order = np.argsort(target.astype(np.int16), kind="stable")
    upper, lower = np.divmod(target[order], CLASSES)
    edge = np.searchsorted(upper, np.arange(CLASSES + 1)).tolist()
    return order, around[order], upper, lower, np.arange(len(target)), [(c, slice(edge[c], edge[c + 1])) for c in range(CLASSES) if edge[c] < edge[c + 1]]


def _forward(weights: dict[str, np.ndarray], around: np.ndarray, upper: np.ndarray, used: list) -> tuple[np.ndarray, ...]:
    """Windows' embeddings, hidden layer, and the exponents of the logits of the classes and of the words in the class."""
    seen = np.take(weights["embedding"], around, axis=0).reshape(len(around), -1)
    hidden = seen @ weights["inner"]
    hidden += weights["inner_bias"]
    np.tanh(hidden, out=hidden)
    top = hidden @ weights["top"]
    top += weights["top_bias"]
    low = np.take(weights["low_bias"], upper, axis=0)
    for c, rows in used:
        low[rows] += hidden[rows] @ weights["low"][c]
    for z in (top, low):
        np.clip(z, -STEEPEST, STEEPEST, out=z)
        np.exp(z, out=z)
    return seen, hidden, top, low


def log_probabilities(weights: dict[str, np.ndarray], around: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-probability of each target in its window."""
    order, around, upper, lower, row, used = _by_class(around, target)
    _, _, top, low = _forward(weights, around, upper, used)
    out = np.empty(len(target))
    # sums of 32 exponents as products with ones: faster than along the short axis
    out[order] = np.log(top[row, upper] / (top @ np.ones(CLASSES, top.dtype))) + np.log(low[row, lower] / (low @ np.ones(CLASSES, low.dtype)))
    return out


def gradient(weights: dict[str, np.ndarray], around: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean negative log-probability."""
    n = len(target)
    _, around, upper, lower, row, used = _by_class(around, target)
    seen, hidden, wrong, miss = _forward(weights, around, upper, used)
    for z, at in ((wrong, upper), (miss, lower)):
        z *= (1 / (n * (z @ np.ones(CLASSES, z.dtype))))[:, None]
        z[row, at] -= 1 / n
    out = {"top": hidden.T @ wrong, "top_bias": wrong.sum(axis=0)}
    out |= {k: np.zeros_like(weights[k]) for k in ("low", "low_bias")}
    back = wrong @ weights["top"].T
    for c, rows in used:
        out["low"][c], out["low_bias"][c] = hidden[rows].T @ miss[rows], miss[rows].sum(axis=0)
        back[rows] += miss[rows] @ weights["low"][c].T
    hidden *= hidden
    np.subtract(1, hidden, out=hidden)
    back *= hidden
    out["inner"], out["inner_bias"] = seen.T @ back, back.sum(axis=0)
    cells = (back @ weights["inner"].T).reshape(-1, EMBEDDING)
    symbol = around.ravel().astype(np.int16)
    order = np.argsort(symbol, kind="stable")
    symbol = symbol[order]
    first = np.flatnonzero(np.diff(symbol, prepend=-1))
    out["embedding"] = np.zeros_like(weights["embedding"])
    out["embedding"][symbol[first]] = np.add.reduceat(np.take(cells, order, axis=0), first, axis=0)
    return out


def masked_places(counts: np.ndarray, salt: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """Places that a round masks in documents of so many words, by a hash of the document's salt and the place; the rounds partition all places."""
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.flatnonzero(mix(np.repeat(mix(salt), counts) + place.astype(np.uint64)) % np.uint64(rounds) == turn)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, counts, held = [], [], 0

    def merged():
        found, place = np.unique(np.concatenate(hashes), return_inverse=True)
        return found, np.bincount(place, np.concatenate(counts)).astype(np.int64)

    def rows(found, count):
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(count)], ["word", "count"])

    for batch in batches:
        for _, _, words in window_slices(batch.column(0)):
            found, count = np.unique(words.hash, return_counts=True)
            hashes.append(found)
            counts.append(count)
            held += len(found)
            if held > 2_000_000:
                found, count = merged()
                hashes, counts, held = [found], [count], len(found)
                if held > 1_000_000:
                    yield rows(found, count)
                    hashes, counts, held = [], [], 0
    if hashes:
        yield rows(*merged())


def _blocks(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Symbols and number of words per document of each block, and further columns."""
    for batch in batches:
        for k in range(len(batch)):
            symbols = np.frombuffer(batch.column("symbols")[k].as_buffer(), np.uint16).astype(np.int64)
            yield symbols, batch.column("n_words")[k].values.to_numpy(), *(batch.column(name)[k] for name in names)


def _train(weights: dict[str, np.ndarray], turn: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {k: v.copy() for k, v in weights.items()}
        power = {k: np.full(s, 1e-4, np.float32) for k, s in SHAPES.items()}
        seen = 0
        for ids, counts, salts in _blocks(batches, "salts"):
            places = masked_places(counts, salts.values.to_numpy().view(np.uint64), turn, rounds)
            owner = np.repeat(np.arange(len(counts)), counts)
            for lo in range(0, len(places), BATCH):
                part = places[lo : lo + BATCH]
                for k, g in gradient(own, windows(ids, owner, part), ids[part]).items():
                    power[k] += g * g
                    own[k] -= np.float32(RATE) * g / np.sqrt(power[k])
            seen += len(places)
        if seen:
            flat = np.concatenate([own[k].ravel() for k in SHAPES])
            group = TaskContext.get().partitionId() // FAN_IN
            for shard, part in enumerate(np.array_split(flat, SHARDS)):
                yield _part(group, shard, seen, part)

    return run


PARTS = "group long, shard int, seen long, part binary"


def _part(group: int, shard: int, seen: int, part: np.ndarray) -> pa.RecordBatch:
    kinds = pa.int64(), pa.int32(), pa.int64(), pa.binary()
    values = group, shard, seen, part.astype(np.float64).tobytes()
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], ["group", "shard", "seen", "part"])


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group and shard; weighs each task's weights by the places it saw, and gives one row of group // FAN_IN."""
    key, total, sums = None, 0, None
    for batch in batches:
        for group, shard, n, part in zip(*(c.to_pylist() for c in batch.columns)):
            if (group, shard) != key:
                if key is not None:
                    yield _part(key[0] // FAN_IN, key[1], total, sums / total)
                key, total, sums = (group, shard), 0, 0.0
            total += n
            sums = sums + np.frombuffer(part) * n
    if key is not None:
        yield _part(key[0] // FAN_IN, key[1], total, sums / total)


def corpus_counts(texts: DataFrame) -> DataFrame:
    """word (64-bit hash), count over all texts."""
    return texts.mapInArrow(_counts, "word long, count long").groupBy("word").agg(F.sum("count").alias("count"))


def _bucket_counts(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(SIZE, np.int64)
        for batch in batches:
            np.add.at(sums, vocabulary(batch.column(0).to_numpy().view(np.uint64)), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(range(RARE), pa.int32()), pa.array(sums[FREQUENT:])], ["bucket", "count"])

    return run


def fit_vocabulary(counts: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """The most frequent of all words and the counts of the buckets, and the share of each id in the corpus."""
    top = counts.orderBy(F.desc("count"), "word").limit(FREQUENT).collect()
    hashes = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    ids = np.arange(len(top))
    order = np.argsort(hashes)
    vocabulary = Vocabulary(hashes[order], ids[order], np.zeros(RARE, np.int64))
    for r in counts.mapInArrow(_bucket_counts(vocabulary), "bucket int, count long").groupBy("bucket").agg(F.sum("count").alias("count")).collect():
        vocabulary.bucket_counts[r["bucket"]] = r["count"]
    shares = np.zeros(SIZE)
    shares[: len(top)] = [r["count"] for r in top]
    shares[FREQUENT:] = vocabulary.bucket_counts
    return vocabulary, shares / max(shares.sum(), 1)


def fit_network(symbols: DataFrame, weights: dict[str, np.ndarray], rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Weights after training on all places of all documents (salts, n_words, symbols), each masked in one round.

    Weights of tasks are averaged in groups of FAN_IN, and the groups' in a second step.
    """
    for turn in range(rounds):
        parts = symbols.select("salts", "n_words", "symbols").mapInArrow(_train(weights, turn, rounds), PARTS)
        for _ in range(2):
            parts = parts.repartition("group", "shard").sortWithinPartitions("group", "shard", "seen", "part").mapInArrow(_average, PARTS)
        found = parts.collect()
        if not found:
            break
        flat = np.concatenate([np.frombuffer(r["part"]) for r in sorted(found, key=lambda r: r["shard"])]).astype(np.float32)
        edge = np.cumsum([int(np.prod(shape)) for shape in SHAPES.values()])
        weights = {k: part.reshape(SHAPES[k]) for k, part in zip(SHAPES, np.split(flat, edge))}
    return weights


def _symbols(vocabulary: Vocabulary, shards: int):
    """Per block of texts, a row with the symbols of its words, and a row per shard with its bucketed words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for lo, hi, words in window_slices(batch.column(1)):
                ids, owner = vocabulary(words.hash), words.owner()
                bucketed = ids >= FREQUENT
                held.append((batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), words.counts(), ids.astype(np.uint16), words.hash[bucketed], owner[bucketed]))
                size += len(words.raw)
                if size >= BLOCK:
                    yield _block_rows(block, held, shards)
                    block, held, size = block + 1, [], 0
        if held:
            yield _block_rows(block, held, shards)

    return run


def _score(weights: dict[str, np.ndarray], kind: pa.DataType):
    """Sums of the documents' log-probabilities over symbols, per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, counts, doc_ids, block in _blocks(batches, "ids", "block"):
            owner, sums = np.repeat(np.arange(len(counts)), counts), np.zeros(len(counts))
            for first in range(0, len(ids), 1 << 13):
                part = np.arange(first, min(len(ids), first + (1 << 13)))
                sums += np.bincount(owner[part], log_probabilities(weights, windows(ids, owner, part), ids[part]), len(counts))
            lists = [pa.array([x], pa.list_(t)) for x, t in ((doc_ids.values, kind), (counts, pa.int64()), (sums, pa.float64()))]
            yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int64()), pa.array([-1], pa.int32()), *lists], ["block", "shard", "ids", "n_words", "sums"])

    return run


def _block_rows(block: int, held: list[tuple], shards: int) -> pa.RecordBatch:
    ids, salts = (pa.concat_arrays([x[k] for x in held]) for k in (0, 1))
    n_words, symbols, hashes = (np.concatenate([x[k] for x in held]) for k in (2, 3, 4))
    first = np.cumsum([0, *(len(x[0]) for x in held)])
    found = pa.array(hashes).dictionary_encode()
    word, index = found.dictionary.to_numpy(), found.indices.to_numpy()
    shard = (word % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    key = rank[index] * len(ids) + np.concatenate([x[5] + n for x, n in zip(held, first)])
    key.sort()
    at = np.flatnonzero(np.diff(key, prepend=-1))
    times = np.diff(at, append=len(key)).astype(np.uint32)
    owner, doc = np.divmod(key[at], len(ids))
    edge = np.searchsorted(shard[order], np.arange(shards + 1))
    pair = np.searchsorted(owner, np.arange(len(word) + 1))
    rows = [(block, -1, None, None, None, None)]
    for s in np.flatnonzero(np.diff(edge)).tolist():
        of = pair[edge[s] : edge[s + 1] + 1]
        rows.append((block, s, word[order[edge[s] : edge[s + 1]]].tobytes(), np.diff(of).astype(np.uint32).tobytes(),
                     doc[of[0] : of[-1]].astype(np.uint32).tobytes(), times[of[0] : of[-1]].tobytes()))
    lists = [pa.ListArray.from_arrays(pa.array([0] + [len(ids)] * len(rows), pa.int32()), x) for x in (ids, salts, pa.array(n_words))]
    own = pa.array([symbols.tobytes()] + [None] * (len(rows) - 1), pa.binary())
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
    names = ["block", "shard", "words", "pairs", "docs", "times", "ids", "salts", "n_words", "symbols"]
    return pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(zip(*rows), kinds)), *lists, own], names)


def _bucketed_counts(vocabulary: Vocabulary, shards: int):
    """Packs the counts of bucketed words by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, count = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            good = vocabulary(hashes) >= FREQUENT
            hashes, count = hashes[good], count[good]
            shard = (hashes % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            edge = np.searchsorted(shard[order], np.arange(shards + 1))
            own = np.flatnonzero(np.diff(edge)).tolist()
            packed = [[x[order[edge[s] : edge[s + 1]]].tobytes() for s in own] for x in (hashes, count)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *(pa.array(x, pa.binary()) for x in packed)], ["shard", "words", "counts"])

    return run


def _share_sums(bucket_counts: np.ndarray):
    """Rows come sorted by shard, its counts first; sums log(count / bucket's count) per document of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, hashes, logs = None, [], None, None
        for batch in batches:
            for s, block, words, counts, pairs, docs, times in zip(*batch.columns):
                if s.as_py() != shard:
                    shard, held, hashes = s.as_py(), [], None
                words = np.frombuffer(words.as_buffer(), np.uint64)
                if not block.is_valid:
                    held.append((words, np.frombuffer(counts.as_buffer(), np.int64)))
                    continue
                if hashes is None:
                    hashes, count = (np.concatenate(x) for x in zip(*held))
                    order = np.argsort(hashes)
                    hashes, held = hashes[order], []
                    bucket = (mix(hashes) % np.uint64(RARE)).astype(np.int64)
                    logs = np.log(count[order] / bucket_counts[bucket])
                at = np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)
                if (hashes[at] != words).any():
                    raise RuntimeError("the texts changed between counting and scoring")
                pairs, docs, times = (np.frombuffer(x.as_buffer(), np.uint32) for x in (pairs, docs, times))
                found, place = np.unique(docs, return_inverse=True)
                sums = np.bincount(place, np.repeat(logs[at], pairs) * times)
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()]), pa.array([shard], pa.int32()), pa.array([found.tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary())],
                                                 ["block", "shard", "docs", "shares"])

    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block, its documents first; one row per document."""
    held, sums = None, None

    def rows():
        return pa.RecordBatch.from_arrays([held[0].values, held[1].values, pa.array(sums)], ["doc_id", "n_words", "log_likelihood"])

    for batch in batches:
        for _, shard, docs, shares, ids, n_words, own in zip(*batch.columns):
            if shard.as_py() < 0:
                if held:
                    yield rows()
                held, sums = (ids, n_words), own.values.to_numpy().copy()
            else:
                sums[np.frombuffer(docs.as_buffer(), np.uint32)] += np.frombuffer(shares.as_buffer(), np.float64)
    if held:
        yield rows()


def pseudo_likelihood(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, log_likelihood, mean_log_likelihood: one row per document.

    Words stand between ASCII white space. A document without words, null texts among them, has sum 0 and mean null.
    Repeated rows and null ids are rows of their own. Other columns are not read. An empty table gives none. All
    documents are counted, trained on and scored. Of words that are equally frequent those of lesser hash get symbols of
    their own. A text of any length is worked on whole, in one task, with some 40 bytes per word.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.xxhash64("doc_id").alias("salt"))
    steps = Steps(rows.sparkSession, "likelihood")
    counts = steps.table(corpus_counts(rows.select("text")), "counts")
    vocabulary, shares = fit_vocabulary(counts)
    kind = rows.schema["doc_id"].dataType
    shards = max(LEAST_SHARDS, -(-counts.count() // SHARD_WORDS))
    # written: training and scoring read the symbols, and all shards see the same blocks
    split = steps.table(rows.mapInArrow(_symbols(vocabulary, shards), SYMBOLS.format(kind=kind.simpleString())), "symbols")
    blocks = split.where("shard < 0")
    weights = fit_network(blocks, new_weights(shares), rounds)
    scored = blocks.select("ids", "n_words", "symbols", "block").mapInArrow(
        _score(weights, to_arrow_type(kind)), f"block long, shard int, ids array<{kind.simpleString()}>, n_words array<long>, sums array<double>")
    bucketed = counts.mapInArrow(_bucketed_counts(vocabulary, shards), "shard int, words binary, counts binary")
    asked = split.where("shard >= 0").select("shard", "block", "words", "pairs", "docs", "times")
    met = bucketed.unionByName(asked, allowMissingColumns=True).select("shard", "block", "words", "counts", "pairs", "docs", "times")
    shares = met.repartition("shard").sortWithinPartitions("shard", F.col("block").asc_nulls_first()).mapInArrow(_share_sums(vocabulary.bucket_counts), "block long, shard int, docs binary, shares binary")
    both = shares.unionByName(scored, allowMissingColumns=True).select("block", "shard", "docs", "shares", "ids", "n_words", "sums")
    whole = both.repartition("block").sortWithinPartitions("block", "shard").mapInArrow(_documents, f"doc_id {kind.simpleString()}, n_words long, log_likelihood double")
    return whole.withColumn("mean_log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))
