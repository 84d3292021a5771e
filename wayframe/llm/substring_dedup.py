"""Words of long passages that occurred before, found by recompression.

1. Documents go, ordered by id, into batches. Rounds of recompression name the runs and pairs of each batch's words,
   then those of the symbols, and so on; equal passages hold equal symbols inside, in all batches. Late symbols stand
   for dozens of words: their 96-bit names meet in a shuffle, and where an earlier batch (or an earlier place of the
   batch) has the symbol, all its words are repeated.
2. Windows of words that no such symbol covers pick one sequence of early symbols that their words settle alone. The
   batches' distinct picks meet in the same shuffle, which tells each batch which of them another batch has too.
3. Windows whose pick is shared may be repeated: their own 96-bit names meet in a second shuffle, which tells each
   batch which of them an earlier batch has. Words that a repeated window covers are removed.

Batches send arrays of names and get bit masks back, aligned with what they sent; nothing else of a document moves but
its text. A name is sent once per batch, so a passage in a third of all documents is one value per batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recompression import Symbols, next_round, words_as_symbols
from .tables import Steps, id_ranges, release
from .words import Words, joined, mix, separators, text_bytes, window_hashes

WINDOW = 20
#: Rounds of recompression before windows pick, and symbols in a pick.
ROUNDS, PICK = 2, 4
#: Rounds up to the long symbols (of some 50 words on average); shorter than so many windows they are left to the windows.
LONG_ROUNDS, LONG_WINDOWS = 14, 2
#: Bytes of text in a batch.
BATCH = 4 << 20
#: Names that meet in one group of a shuffle, on average.
MEETING = 1 << 20
#: Bytes of a word with the space after it, to size the shuffles.
WORD_BYTES = 6
#: Rows of an exchange that meet nobody: a batch's long symbols, its open windows, its words in repeated symbols.
SPANS, CANDIDATES, KNOWN = -1, -2, -3


def window_places(words: Words, width: int) -> np.ndarray:
    """First words of all windows that lie in one text."""
    count = words.counts()
    room = np.repeat(words.of[1:], count) - np.arange(len(words.hash))
    return np.flatnonzero(room >= width)


def picks(words: Words, width: int, symbols: Symbols, size: int = PICK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all windows, name of each one's pick, and whether the pick is another occurrence than the one before.

    The pick is, of all sequences of ``size`` neighbouring symbols (fewer if there are no more) whose contexts lie in
    the window, the one of least name; without any such symbol it is the window itself.
    """
    places = window_places(words, width)
    if not len(places):
        return places, np.zeros(0, np.uint64), np.zeros(0, bool)
    first = np.searchsorted(symbols.low, places, "left")
    count = np.searchsorted(symbols.high, places + width, "right") - first
    name = np.full(len(places), np.iinfo(np.uint64).max, np.uint64)
    which = np.zeros(len(places), np.int64)
    chain = symbols.name
    for k in range(1, size + 1):
        if k > 1:
            chain = joined(chain[:-1], symbols.name[k - 1 :], 1000 + k)
        rows = np.flatnonzero(count >= k if k == size else count == k)
        step = 0
        value_of = mix(chain)
        while len(rows):
            at = first[rows] + step
            value = value_of[at]
            better = value < name[rows]
            name[rows[better]], which[rows[better]] = value[better], at[better] * (size + 1) + k
            step += 1
            rows = rows[step + k <= count[rows]]
    bare = np.flatnonzero(count <= 0)
    if len(bare):
        name[bare] = window_hashes(words.hash, width, 7)[places[bare]]
        which[bare] = -1 - places[bare]
    new = np.ones(len(places), bool)
    new[1:] = which[1:] != which[:-1]
    return places, name, new


def passage_names(hashes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """32-bit names of passages: a polynomial of the words' hashes, shifted to the passage's start."""
    factor = 0x5851F42D4C957F2D
    inverse = pow(factor, -1, 1 << 64)
    powers = np.cumprod(np.full(len(hashes) + 1, factor, np.uint64)) * np.uint64(inverse)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.uint64(1)) * powers[: len(hashes)])])
    back = np.cumprod(np.full(len(hashes) + 1, inverse, np.uint64)) * np.uint64(factor)
    return (mix((sums[end] - sums[first]) * back[first]) >> np.uint64(32)).astype(np.uint32)


def window_names(hashes: np.ndarray, width: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent names of the windows at the places: 64 and 32 bits."""
    return window_hashes(hashes, width)[places], passage_names(hashes, places, places + width)


def _groups(names: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """Group of ascending names by their top bits: group, first, end."""
    group = (names >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(names), np.int64)
    cuts = np.flatnonzero(np.diff(group)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(names)]):
        if hi > lo:
            yield int(group[lo]), lo, hi


class Rows:
    """Rows of an exchange, gathered to batches: group, batch, part of the batch, data."""

    names = ("meeting", "batch", "part", "data")

    def __init__(self):
        self.rows: list[tuple[int, int, int, bytes]] = []

    def add(self, *row) -> None:
        self.rows.append(row)

    def flush(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * 4
        self.rows = []
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], self.names)


EXCHANGE = "meeting long, batch long, part int, data binary"


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table, dict]]:
    """Batch, part, rows, and the answers to the batch, from rows sorted by (batch, answers first, id, text).

    A batch of more than BATCH bytes is cut into parts; where depends on the sorted rows alone.
    """
    batch_now, part, held, size, answers = None, 0, [], 0, {}
    for rows in batches:
        batch, is_text = rows.column("batch").to_numpy(), rows.column("is_text").to_numpy(zero_copy_only=False)
        length = pc.fill_null(pc.binary_length(rows.column("text")), 0).to_numpy()
        at, n = 0, rows.num_rows
        runs = np.flatnonzero((np.diff(batch) != 0) | np.diff(is_text)) + 1
        for end in [*runs.tolist(), n]:
            while at < end:
                if batch[at] != batch_now:
                    if held:
                        yield batch_now, part, pa.Table.from_batches(held), answers
                    batch_now, part, held, size, answers = int(batch[at]), 0, [], 0, {}
                if not is_text[at]:
                    for kind, meeting, p, data in zip(*(rows.column(c).slice(at, end - at).to_pylist() for c in ("kind", "meeting", "part", "data"))):
                        answers[kind, p, meeting] = data
                    at = end
                    continue
                room = np.searchsorted(np.cumsum(length[at:end]), BATCH - size, "left") + 1
                take = int(min(room, end - at))
                held.append(rows.slice(at, take))
                size += int(length[at : at + take].sum())
                at += take
                if size >= BATCH:
                    yield batch_now, part, pa.Table.from_batches(held), answers
                    part, held, size = part + 1, [], 0
    if held:
        yield batch_now, part, pa.Table.from_batches(held), answers


def _words(rows: pa.Table) -> Words:
    return Words(*text_bytes(pa.chunked_array(rows.column("text").chunks).combine_chunks() if rows.column("text").num_chunks != 1 else rows.column("text").chunk(0)), separators())


SPAN = np.dtype([("name", "<u8"), ("second", "<u4"), ("first", "<i4"), ("end", "<i4")])


def early_and_late(words: Words, last: int | None = None) -> tuple[Symbols, Symbols]:
    """Symbols of round ROUNDS and of the last one (LONG_ROUNDS by default)."""
    symbols = early = words_as_symbols(words.hash, words.owner())
    for turn in range(LONG_ROUNDS if last is None else last):
        symbols = next_round(symbols, turn)
        if turn + 1 == ROUNDS:
            early = symbols
    return early, symbols


def long_symbols(words: Words, last: Symbols, width: int) -> np.ndarray:
    """Names and places of the last round's symbols of LONG_WINDOWS windows and more."""
    keep = last.end - last.first >= LONG_WINDOWS * width
    out = np.zeros(int(keep.sum()), SPAN)
    out["name"], out["first"], out["end"] = last.name[keep], last.first[keep], last.end[keep]
    out["second"] = passage_names(words.hash, last.first[keep], last.end[keep])
    return out


def _send_picks(width: int, bits: int, long_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows()
        for batch, part, rows, _ in portions(batches):
            words = _words(rows)
            early, late = early_and_late(words)
            spans = long_symbols(words, late, width)
            if len(spans):
                order, begins, _ = _distinct(spans["name"], spans["second"])
                first, second = spans["name"][order[begins]], spans["second"][order[begins]]
                for group, lo, hi in _groups(first, long_bits):
                    out.add(KNOWN - 1 - group, batch, part, first[lo:hi].tobytes() + second[lo:hi].tobytes())
                out.add(SPANS, batch, part, spans.tobytes())
            _, name, new = picks(words, width, early)
            names = np.unique(name[new])
            for group, lo, hi in _groups(names, bits):
                out.add(group, batch, part, names[lo:hi].tobytes())
            yield out.flush()

    return run


def _meet(answer):
    """Rows come sorted by group; ``answer`` gives the masks of all arrays of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, group, held = Rows(), None, []

        def reply():
            for (batch, part, _), mask in zip(held, answer([(b, p) for b, p, _ in held], [d for _, _, d in held])):
                out.add(group, batch, part, np.packbits(mask).tobytes())
            return out.flush()

        for rows in batches:
            for meeting, batch, part, data in zip(*(c.to_pylist() for c in rows.columns)):
                if meeting != group:
                    if held:
                        yield reply()
                    group, held = meeting, []
                held.append((batch, part, data))
        if held:
            yield reply()

    return run


def in_several(_, data: list[bytes]) -> list[np.ndarray]:
    """Which names of each array another array has too."""
    names = [np.frombuffer(d, np.uint64) for d in data]
    _, place, count = np.unique(np.concatenate(names), return_inverse=True, return_counts=True)
    return np.split(count[place] > 1, np.cumsum([len(x) for x in names])[:-1])


def in_earlier(keys: list[tuple[int, int]], data: list[bytes]) -> list[np.ndarray]:
    """Which names of each array an array of an earlier batch or part has too."""
    sizes = [len(d) // 12 for d in data]
    first = np.concatenate([np.frombuffer(d, np.uint64, n) for d, n in zip(data, sizes)])
    second = np.concatenate([np.frombuffer(d, np.uint32, n, 8 * n) for d, n in zip(data, sizes)])
    rank = np.empty(len(keys), np.int64)
    rank[sorted(range(len(keys)), key=keys.__getitem__)] = np.arange(len(keys))
    order = np.lexsort((np.repeat(rank, sizes), second, first))
    again = np.zeros(len(first), bool)
    again[order[1:]] = (first[order[1:]] == first[order[:-1]]) & (second[order[1:]] == second[order[:-1]])
    return np.split(again, np.cumsum(sizes)[:-1])


def _bits(data: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=count).astype(bool)


def _masks(answers: dict, kind: int, part: int, names: np.ndarray, bits: int, meeting=lambda group: group) -> np.ndarray:
    """Answers to the names, which are as they were sent."""
    out = np.zeros(len(names), bool)
    for group, lo, hi in _groups(names, bits):
        out[lo:hi] = _bits(answers[kind, part, meeting(group)], hi - lo)
    return out


def repeated_spans(answers: dict, part: int, long_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of the long symbols that occurred before."""
    spans = np.frombuffer(answers.get((2, part, SPANS), b""), SPAN)
    if not len(spans):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, begins, number = _distinct(spans["name"], spans["second"])
    earlier = _masks(answers, 1, part, spans["name"][order[begins]], long_bits, lambda group: KNOWN - 1 - group)
    again = np.sort(order[~begins | earlier[number]])
    return spans["first"][again].astype(np.int64), spans["end"][again].astype(np.int64)


def _distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by name with the first place of a name first; which rows of that order begin a name; name number of each row."""
    order = np.lexsort((np.arange(len(first)), second, first))
    new = np.ones(len(order), bool)
    new[1:] = (first[order[1:]] != first[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
    return order, new, np.cumsum(new) - 1


def _send_windows(width: int, bits: int, long_bits: int, window_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows()
        for batch, part, rows, answers in portions(batches):
            words = _words(rows)
            places, name, new = picks(words, width, early_and_late(words, ROUNDS)[0])
            names, place, count = np.unique(name[new], return_inverse=True, return_counts=True)
            shared = _masks(answers, 0, part, names, bits) | (count > 1)
            found = places[shared[place][np.cumsum(new) - 1]] if len(places) else places
            begin, end = repeated_spans(answers, part, long_bits)
            if len(begin):
                span = np.searchsorted(begin, found, "right") - 1
                found = found[(span < 0) | (found + width > end[span])]
                out.add(KNOWN, batch, part, np.packbits(_covered(begin, end, len(words.hash))).tobytes())
            if len(found):
                first, second = window_names(words.hash, width, found)
                order, begins, _ = _distinct(first, second)
                first, second = first[order[begins]], second[order[begins]]
                for group, lo, hi in _groups(first, window_bits):
                    out.add(group, batch, part, first[lo:hi].tobytes() + second[lo:hi].tobytes())
                marked = np.zeros(len(words.hash), bool)
                marked[found] = True
                out.add(CANDIDATES, batch, part, np.packbits(marked).tobytes())
            yield out.flush()

    return run


def _covered(first: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Which of so many words lie in one of the ranges."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, end, -1)
    return np.cumsum(steps[:-1]) > 0


def removed_words(words: Words, width: int, answers: dict, part: int, window_bits: int) -> np.ndarray:
    size = len(words.hash)
    removed = _bits(answers[1, part, KNOWN], size) if (1, part, KNOWN) in answers else np.zeros(size, bool)
    if (1, part, CANDIDATES) not in answers:
        return removed
    found = np.flatnonzero(_bits(answers[1, part, CANDIDATES], size))
    first, second = window_names(words.hash, width, found)
    order, begins, number = _distinct(first, second)
    earlier = _masks(answers, 2, part, first[order[begins]], window_bits)
    repeated = found[order[~begins | earlier[number]]]
    return removed | _covered(repeated, repeated + width, size)


def _kept_words(width: int, window_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, rows, answers in portions(batches):
            words = _words(rows)
            gone = removed_words(words, width, answers, part, window_bits)
            per_text = np.concatenate([[0], np.cumsum(gone)])[words.of]
            kept = np.flatnonzero(~gone)
            # each kept word with the byte after it, which becomes the space between
            raw = np.append(words.raw, np.uint8(32))
            edges = np.stack([words.start, words.end + 1], axis=1).ravel()
            size = edges[1::2] - edges[::2]
            ends = np.cumsum(size[kept])
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(words.start[kept] - (ends - size[kept]), size[kept])
            line = raw[at]
            line[ends - 1] = 32
            cut = np.concatenate([[0], ends])[np.searchsorted(kept, words.of)]
            view = memoryview(line)
            digests = [hashlib.sha256(view[a : max(a, b - 1)]).hexdigest() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            columns = [rows.column("id").combine_chunks(), pa.array(words.counts()), pa.array(np.diff(per_text)), pa.array(digests)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_removed", "kept_sha256"])

    return run


def _cut_texts(width: int, window_bits: int):
    """Texts without their removed words and the white space after these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, rows, answers in portions(batches):
            words = _words(rows)
            gone = np.flatnonzero(removed_words(words, width, answers, part, window_bits))
            texts = rows.column("text").combine_chunks()
            if len(gone):
                owner = words.owner()
                following = np.append(words.start[1:], len(words.raw))
                last = np.append(owner[1:] != owner[:-1], True)
                following[last] = words.offsets[1:][owner[last]]
                drop = np.zeros(len(words.raw) + 1, np.int64)
                drop[words.start[gone]] += 1
                np.add.at(drop, following[gone], -1)
                keep = np.cumsum(drop[:-1]) == 0
                off = np.concatenate([[0], np.cumsum(keep)])[words.offsets]
                texts = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(words.raw[keep].tobytes())).cast(pa.string())
            counts = np.bincount(words.owner()[gone], minlength=rows.num_rows)
            yield pa.RecordBatch.from_arrays([rows.column("rest").combine_chunks(), texts, pa.array(counts)], ["rest", "text", "n_removed"])

    return run


def _answered(docs: DataFrame, id_column: str, text_column: str, width: int, with_rest: bool) -> tuple[DataFrame, int]:
    """Rows of all documents and the answers to their batches, sorted for ``portions``, and the bits of window groups."""
    spark = docs.sparkSession
    steps = Steps(spark, "substrings")
    id_type = docs.schema[id_column].dataType.simpleString()
    body = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    size = docs.agg(F.count("*").alias("rows"), F.sum(F.octet_length(body)).alias("bytes")).first()
    words = max(1, (size["bytes"] or 0) // WORD_BYTES)
    batch = id_ranges(docs, id_column, max(1, int(size["rows"] * BATCH / max(size["bytes"] or 1, 1))))
    bits, long_bits, window_bits = ((max(1, int(words * share) // MEETING)).bit_length() for share in (0.25, 0.02, 0.3))
    kinds = {"kind": "int", "meeting": "long", "part": "int", "data": "binary"}
    blanks = [F.lit(None).cast(t).alias(c) for c, t in kinds.items()]

    def stream(answers: list[tuple[int, DataFrame]], rest: bool = False) -> DataFrame:
        own = docs.select(batch.alias("batch"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest"), F.lit(True).alias("is_text"), F.col(f"`{id_column}`").alias("id"), body.alias("text"), *blanks)
        rows = own if rest else own.drop("rest")
        for kind, table in answers:
            answer = table.select("batch", F.lit(False).alias("is_text"), F.lit(None).cast(id_type).alias("id"), F.lit(None).cast("string").alias("text"),
                                  F.lit(kind).alias("kind"), "meeting", "part", "data")
            rows = rows.unionByName(answer, allowMissingColumns=True)
        return rows.repartition("batch").sortWithinPartitions("batch", "is_text", "id", "text")

    def met(sent: DataFrame, answer, name: str) -> DataFrame:
        return steps.table(sent.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(_meet(answer), EXCHANGE), name)

    sent = steps.table(stream([]).mapInArrow(_send_picks(width, bits, long_bits), EXCHANGE), "symbols")
    shared = met(sent.where("meeting >= 0"), in_several, "shared")
    known = met(sent.where(F.col("meeting") < KNOWN), in_earlier, "known")
    spans = steps.table(sent.where(F.col("meeting") == SPANS), "spans")
    steps.drop("symbols")
    sent = steps.table(stream([(0, shared), (1, known), (2, spans)]).mapInArrow(_send_windows(width, bits, long_bits, window_bits), EXCHANGE), "windows")
    earlier = met(sent.where("meeting >= 0"), in_earlier, "earlier")
    marked = steps.table(sent.where("meeting < 0"), "marked")
    steps.drop("windows", "shared", "known", "spans")
    release(spark)
    return stream([(1, marked), (2, earlier)], with_rest), window_bits


def repeated_words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WINDOW) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    Words stand between ASCII white space and are compared as they are. A word is removed if a window of ``width`` words
    that covers it starts earlier too: in a document of smaller id, or earlier in its own. Windows are judged on the
    texts as given. Null text is empty. Null ids come before all others; rows of equal id are ordered by their texts,
    and of repeated rows the first one counts as earlier. Other columns are not read. An empty table gives none.
    """
    rows, window_bits = _answered(docs, id_column, text_column, width, False)
    kind = docs.schema[id_column].dataType.simpleString()
    found = rows.mapInArrow(_kept_words(width, window_bits), f"id {kind}, n_words long, n_removed long, kept_sha256 string")
    return found.withColumnRenamed("id", id_column)


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WINDOW, size_column: str | None = None) -> DataFrame:
    """All rows of docs with their columns; removed words (see repeated_words) are cut from the text, each with the white
    space after it. ``size_column`` gets the new number of characters in rows that lost words. Null text stays null."""
    rows, window_bits = _answered(docs, id_column, text_column, width, True)
    kind = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest")).schema["rest"].dataType.simpleString()
    found = rows.mapInArrow(_cut_texts(width, window_bits), f"rest {kind}, text string, n_removed long")
    cut = F.col("n_removed") > 0

    def column(c: str):
        old = F.col("rest").getField(c)
        if c == text_column:
            return F.when(cut, F.col("text")).otherwise(old).alias(c)
        if c == size_column:
            return F.when(cut, F.char_length("text").cast(docs.schema[c].dataType)).otherwise(old).alias(c)
        return old.alias(c)

    return found.select(*[column(c) for c in docs.columns])
