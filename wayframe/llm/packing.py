"""Order-preserving packing of documents into training sequences by dynamic programming.

The ids of all documents, in the order of the table, form one stream per input partition. Cuts may fall at document
ends (free), at sentence ends, or inside a sentence; the last two cost a truncation penalty. The program minimises
padding plus penalties; the best start of a sequence comes from a monotone queue over the window of allowed lengths.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import kept_by_worker

#: Fixed value: the word pattern of the tokenizer file.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
END_ID = 1
#: Ids that the program looks at together; it settles all but the last sequence of them.
BLOCK = 64
#: Words, tokens of the word pattern, and their characters, whose ids a worker remembers.
REMEMBERED_WORDS, REMEMBERED, REMEMBERED_CHARS = 400_000, 800_000, 32 << 20
#: Stands before an added token among the words; no word holds it.
ADDED = "\n"


@dataclass(frozen=True)
class Costs:
    """Costs in padded ids: a cut at a sentence end, a cut inside a sentence, and each sequence."""

    sentence: float = 4.0
    inside: float = 12.0
    sequence: float = 128.0


class Numbers(dict):
    """Numbers words in the order of their first use; ``new`` are those numbered since it was last emptied."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class WordIds:
    """Ids of whole texts by a tokenizer file, remembering the ids of the words met so far.

    The file's added tokens are cut out of a text before anything else, as the tokenizer does; each is one id.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(file)
        found = self.whole.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in found.values()):
            raise ValueError("added tokens that match more than their own characters")
        self.added = {t.content: number for number, t in found.items()}
        self.added_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.single = Tokenizer(self.whole.model)
        self.single.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.sentence_end = np.zeros(len(self.closes), bool)
        for piece, number in vocabulary.items():
            self.closes[number] = piece.endswith(WORD_END)
            bare = piece.removesuffix(WORD_END)
            self.sentence_end[number] = self.closes[number] and any(c in ".!?" for c in bare) and all(c in ".!?\"')]" for c in bare)
        self.pattern = regex.compile(PRETOKENS)
        self.forget()

    def forget(self) -> None:
        self.tokens, self.chars = Numbers(), 0
        self.token_ids, self.token_off = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self._forget_words()

    def _forget_words(self) -> None:
        self.words = Numbers()
        for content in self.added:
            self.words[ADDED + content]
        self.words.new = []
        self.word_ids, self.word_off = np.array(list(self.added.values()), np.int32), np.arange(len(self.added) + 1)

    def _learn_tokens(self, new: list[str]) -> None:
        encoded = np.array(self.single.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, np.int32)
        ends = np.flatnonzero(self.closes[encoded]) + 1
        if len(ends) != len(new):  # a token without word end: encode one by one
            each = [e.ids for e in self.single.encode_batch_fast(new, add_special_tokens=False)]
            encoded, ends = np.array([i for e in each for i in e], np.int32), np.cumsum([len(e) for e in each])
        self.token_ids, self.token_off = np.concatenate([self.token_ids, encoded]), np.concatenate([self.token_off, self.token_off[-1] + ends])

    def _tokens(self, word: str) -> list[str]:
        if word.isalpha():
            return [word]
        if word[-1:] in (".", ",") and word[:-1].isalpha():
            return [word[:-1], word[-1]]
        return self.pattern.findall(word)

    def _learn_words(self, new: list[str]) -> None:
        parts = [self._tokens(w) for w in new]
        self.chars += sum(map(len, new))
        flat = np.fromiter(map(self.tokens.__getitem__, chain.from_iterable(parts)), np.int64)
        if self.tokens.new:
            self._learn_tokens(self.tokens.new)
            self.tokens.new = []
        ids, off = gathered(self.token_ids, self.token_off, flat)
        edge = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        self.word_ids, self.word_off = np.concatenate([self.word_ids, ids]), np.concatenate([self.word_off, self.word_off[-1] + off[edge]])

    def _split(self, text: str) -> list[str]:
        if not any(map(text.__contains__, self.added)):
            return normal(text).replace("\n", " ").split(" ")
        words = []
        for k, part in enumerate(self.added_pattern.split(text)):
            words += [ADDED + part] if k % 2 else normal(part).replace("\n", " ").split(" ")
        return words

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by END_ID, and the number of ids of each."""
        if len(self.tokens) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.forget()
        if len(self.words) > REMEMBERED_WORDS:
            self._forget_words()
        # spaces and line ends never are inside a token, so the words between them can be encoded one by one
        split = [self._split(t) for t in texts]
        find = self.words.__getitem__
        places = np.concatenate([np.fromiter(map(find, words), np.int64, len(words)) for words in split])
        if self.words.new:
            self._learn_words(self.words.new)
            self.words.new = []
        ids, off = gathered(self.word_ids, self.word_off, places)
        last = off[np.cumsum([len(w) for w in split])]
        out = np.insert(ids, last, END_ID)
        return out, np.diff(np.concatenate([[0], last])) + 1


def normal(text: str) -> str:
    """The tokenizer file's normal form but for white space: composed, each character in lower case by itself."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.lower() if "\u03a3" not in text else "".join(map(str.lower, text))  # a final sigma depends on its place


def gathered(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the given rows of a ragged table one after the other, and the new offsets."""
    size = offsets[rows + 1] - offsets[rows]
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[rows] - (ends - size), size)
    return values[at], np.concatenate([[0], ends])


def best_cuts(places: list[int], penalty: list[float], length: int, capacity: int, costs: Costs, final: bool) -> list[int]:
    """Ascending cuts of the stream 0..length, the last one at length if final, else in its last capacity ids.

    ``places`` ascend within 1..length, each with its penalty, and length is the last. A sequence of n ids is padded
    to capacity unless n is a power of two; as sequences cost, only the stream's end is cut into such. A place that no sequence reaches from a given cut gets a cut of its own,
    capacity after it, at the price of a cut inside a sentence.
    """
    powers = [1 << k for k in range(capacity.bit_length()) if final and 1 << k < capacity]
    cost, before = {0: 0.0}, {0: 0}
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    hard: deque[int] = deque([capacity])
    k, n = 0, len(places)
    while k < n:
        if hard and hard[0] < places[k]:
            at, extra, given = hard.popleft(), costs.inside, False
        else:
            at, extra, given = places[k], penalty[k], True
            k += 1
            if hard and hard[0] == at:
                hard.popleft()
        while queue and queue[0][1] < at - capacity:
            queue.popleft()
        value, start = queue[0]
        value += capacity - at
        for p in powers:
            other = cost.get(at - p)
            if other is not None and other < value:
                value, start = other, at - p
        value += extra + costs.sequence
        cost[at], before[at] = value, start
        while queue and queue[-1][0] >= value + at:
            queue.pop()
        queue.append((value + at, at))
        # after a cut that the text offers, or where the text offers none, a full sequence may follow
        if (given or k < n and places[k] > at + capacity) and at + capacity < length:
            if not hard or hard[-1] < at + capacity:
                hard.append(at + capacity)
    end = length
    if not final:
        end = min((p for p in cost if p > max(0, length - capacity)), key=lambda p: (cost[p], -p))
    cuts = []
    while end > 0:
        cuts.append(end)
        end = before[end]
    return cuts[::-1]


class Packer:
    """Packs a stream of documents; gives the pieces of settled sequences."""

    def __init__(self, capacity: int, costs: Costs, first_sequence: int):
        self.capacity, self.costs, self.sequence = capacity, costs, first_sequence
        self.ids, self.ends_sentence = np.zeros(0, np.int32), np.zeros(0, bool)
        self.docs: list[tuple[object, int, int]] = []  # id, where it begins (may be before the stream's rest), length

    def feed(self, doc_ids: list, ids: np.ndarray, sizes: np.ndarray, ends_sentence: np.ndarray) -> Iterator[dict]:
        begin = len(self.ids) + np.cumsum(sizes) - sizes
        self.docs += zip(doc_ids, begin.tolist(), sizes.tolist())
        self.ids = np.concatenate([self.ids, ids])
        self.ends_sentence = np.concatenate([self.ends_sentence, ends_sentence])
        at = 0
        whole = self.capacity * BLOCK
        while len(self.ids) - at > whole + self.capacity:
            cuts = self._cuts(at, at + whole, False)
            yield self._pieces(at, cuts)
            at += cuts[-1]
        self._drop(at)

    def finish(self) -> Iterator[dict]:
        if len(self.ids):
            yield self._pieces(0, self._cuts(0, len(self.ids), True))

    def _cuts(self, lo: int, hi: int, final: bool) -> list[int]:
        doc_ends = np.array([b + n for _, b, n in self.docs], np.int64)
        doc_ends = doc_ends[(doc_ends > lo) & (doc_ends <= hi)] - lo
        stops = np.flatnonzero(self.ends_sentence[lo:hi]) + 1
        places = np.union1d(np.union1d(doc_ends, stops), [hi - lo])
        penalty = np.where(np.isin(places, doc_ends), 0.0, np.where(np.isin(places, stops), self.costs.sentence, self.costs.inside))
        return best_cuts(places.tolist(), penalty.tolist(), hi - lo, self.capacity, self.costs, final)

    def _pieces(self, lo: int, cuts: list[int]) -> dict:
        edges = np.array([0, *cuts], np.int64) + lo
        begin = np.array([b for _, b, _ in self.docs], np.int64)
        size = np.array([n for _, _, n in self.docs], np.int64)
        inner = begin[(begin > lo) & (begin < edges[-1])]
        points = np.union1d(edges, inner)
        first, last = points[:-1], points[1:]
        doc = np.searchsorted(begin, first, "right") - 1
        row = np.searchsorted(edges, first, "right") - 1
        raw = memoryview(np.ascontiguousarray(self.ids[lo : edges[-1]], "<u4")).cast("B")
        out = {
            "doc_id": [self.docs[d][0] for d in doc.tolist()], "start": first - begin[doc], "length": last - first,
            "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((first - lo).tolist(), (last - lo).tolist())],
            "doc_tokens": size[doc], "sequence_id": self.sequence + row, "offset": first - edges[row],
        }
        self.sequence += len(cuts)
        return out

    def _drop(self, at: int) -> None:
        if at:
            self.ids, self.ends_sentence = self.ids[at:], self.ends_sentence[at:]
            self.docs = [(d, b - at, n) for d, b, n in self.docs if b + n > at]


def _pack(file: str, capacity: int, costs: Costs, id_type: pa.DataType, batch_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept_by_worker(f"word ids {file}", lambda: WordIds(file))
        packer = Packer(capacity, costs, TaskContext.get().partitionId() << 36)

        def rows(found: dict) -> pa.RecordBatch:
            kinds = [id_type, *[pa.int64()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(found.values(), kinds)], list(found))

        def fed(ids, texts):
            encoded, sizes = words.encode(texts)
            return map(rows, packer.feed(ids, encoded, sizes, words.sentence_end[encoded]))

        for batch in batches:
            ids, texts, chars = [], [], 0
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(d)
                texts.append(t.as_py() or "")
                chars += len(texts[-1])
                if chars >= batch_chars:
                    yield from fed(ids, texts)
                    ids, texts, chars = [], [], 0
            if ids:
                yield from fed(ids, texts)
        yield from map(rows, packer.finish())

    return run


def packed(docs: DataFrame, file: str, capacity: int = 2048, costs: Costs = Costs(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece of a document.

    ``file`` is a tokenizer file with word ends. Each document is its ids and END_ID; null text counts as empty, so an
    empty document is a piece of one id. Order is that of the table within each input partition; sequences do not
    cross partitions, whose last ones are padded or cut into powers of two, whichever is cheaper. Null ids and
    repeated rows are documents of their own. A text of any length is worked on whole, in one task; among cuts of equal
    cost the one found first, from the left, stays. Other columns are not read. An empty table gives none. No shuffle.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(_pack(file, capacity, costs, to_arrow_type(kind), 1 << 22), schema)
