"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Spaces become the marker U+2581 and one more is put in front. The best segmentation maximises the sum of the pieces'
log scores. A character that no piece covers falls back to the pieces of its bytes. Words are segmented side by side,
all words of a batch in step, and each distinct word of a batch once: no piece reaches over the start of a space run.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import Numbers, gathered
from .words import text_bytes

MARK = "▁"
#: Log score below the worst piece for a character without piece, as usual for this model.
UNKNOWN = 10.0
#: Longer words are segmented one by one.
LONG = 64
REMEMBERED = 600_000
LANES = 1 << 16
#: States below the top of the double array in which a state with several children looks for room.
NEAR = 256
#: Bytes of the UTF-8 character that a byte begins.
CHAR = np.ones(256, np.int64)
CHAR[0xC0:0xE0], CHAR[0xE0:0xF0], CHAR[0xF0:] = 2, 3, 4


@dataclass
class Pieces:
    """Pieces as bytes (a space for the marker) with log scores, the ids of the byte pieces, and the double array."""

    text: list[bytes]
    score: np.ndarray
    byte_id: np.ndarray
    base: np.ndarray
    check: np.ndarray
    leaf: np.ndarray

    @staticmethod
    def build(pieces: list[tuple[int, str, float]], byte_id: list[int], size: int) -> Pieces:
        """``pieces`` are (id, piece, log score) without control and byte pieces; ``size`` is the number of ids."""
        text, score = [b""] * size, np.full(size, -np.inf)
        for number, piece, value in pieces:
            if MARK in piece.lstrip(MARK) or "\n" in piece:
                raise ValueError(f"piece {piece!r} reaches over the end of a word")
            text[number], score[number] = piece.replace(MARK, " ").encode(), value
        arrays = double_array([(t, i) for i, t in enumerate(text) if t])
        for byte, number in enumerate(byte_id):
            text[number] = bytes([byte])
        return Pieces(text, score, np.array(byte_id, np.int64), *arrays)

    @staticmethod
    def load(file: str) -> Pieces:
        """The pieces of a SentencePiece file. Merge ranks in place of log scores get the scores of Zipf's law."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=file)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        found = {model.id_to_piece(i): i for i in range(size) if model.is_byte(i)}
        harmonic = np.log(np.arange(1, len(plain) + 1)) + np.log(np.log(len(plain)) + 0.5772156649)
        pieces = [(i, model.id_to_piece(i), -float(s)) for i, s in zip(plain, harmonic)]
        return Pieces.build(pieces, [found[f"<0x{b:02X}>"] for b in range(256)], size)

    def __post_init__(self):
        self.length = np.array([len(t) for t in self.text], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        self.pool = np.frombuffer(b"".join(self.text), np.uint8)
        known = self.score[np.isfinite(self.score)]
        self.unknown = (known.min() if len(known) else 0.0) - UNKNOWN
        self.is_byte = np.zeros(len(self.text), bool)
        self.is_byte[self.byte_id] = True

    def segment(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words one after the other, offsets of the words, and the score of each."""
        size = np.array([len(w) for w in words], np.int64)
        order = np.argsort(size, kind="stable")
        ids, counts, scores = [], np.zeros(len(words), np.int64), np.zeros(len(words))
        short = order[size[order] <= LONG]
        done = []
        for lo in range(0, len(short), LANES):
            lanes = short[lo : lo + LANES]
            found, count, score = self._in_step([words[i] for i in lanes.tolist()], size[lanes])
            ids.append(found)
            counts[lanes], scores[lanes] = count, score
            done.append(lanes)
        for i in order[size[order] > LONG].tolist():
            found, scores[i] = self._alone(words[i])
            ids.append(found)
            counts[i] = len(found)
            done.append(np.array([i]))
        if not done:
            return np.zeros(0, np.int64), np.zeros(1, np.int64), scores
        done = np.concatenate(done)
        sorted_off = np.concatenate([[0], np.cumsum(counts[done])])
        back = np.empty(len(words), np.int64)
        back[done] = np.arange(len(words))
        flat, off = gathered(np.concatenate(ids), sorted_off, back)
        return flat, off, scores

    def _in_step(self, words: list[bytes], size: np.ndarray):
        """Viterbi over all words at once, a step per start and length."""
        n, most = len(words), int(size.max(initial=0))
        raw = np.zeros((n, most), np.uint8)
        flat = np.frombuffer(b"".join(words), np.uint8)
        lane = np.repeat(np.arange(n), size)
        raw[lane, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
        best = np.full((n, most + 1), -np.inf)
        best[:, 0] = 0.0
        back = np.full((n, most + 1), -1, np.int64)
        for s in range(most):
            open_ = np.flatnonzero((size > s) & (best[:, s] > -np.inf))
            if not len(open_):
                continue
            width = np.minimum(CHAR[raw[open_, s]], size[open_] - s)
            single = np.zeros(len(open_), bool)
            at, state, d = np.arange(len(open_)), np.zeros(len(open_), np.int64), 0
            while len(at) and s + d < most:
                step = self.base[state] + raw[open_[at], s + d] + 1
                good = (self.check[step] == state) & (size[open_[at]] > s + d)
                at, state, d = at[good], step[good], d + 1
                piece = self.leaf[state]
                hit = piece >= 0
                where, piece = at[hit], piece[hit]
                lanes = open_[where]
                single[where] |= width[where] == d
                value = best[lanes, s] + self.score[piece]
                better = value > best[lanes, s + d]
                best[lanes[better], s + d], back[lanes[better], s + d] = value[better], piece[better]
            for w in range(1, 5):
                lanes = open_[~single & (width == w)]
                if not len(lanes):
                    continue
                lanes = lanes[best[lanes, s] + self.unknown > best[lanes, s + w]]
                best[lanes, s + w] = best[lanes, s] + self.unknown
                back[lanes, s + 1 : s + w + 1] = -1
        place, lanes = size.copy(), np.flatnonzero(size > 0)
        who, what = [], []
        while len(lanes):
            piece = back[lanes, place[lanes]]
            found = np.where(piece >= 0, piece, self.byte_id[raw[lanes, place[lanes] - 1]])
            who.append(lanes)
            what.append(found)
            place[lanes] -= np.where(piece >= 0, self.length[found], 1)
            lanes = lanes[place[lanes] > 0]
        who, what = np.concatenate([*who[::-1], np.zeros(0, np.int64)]), np.concatenate([*what[::-1], np.zeros(0, np.int64)])
        order = np.argsort(who, kind="stable")
        return what[order].astype(np.int64), np.bincount(who.astype(np.int64), minlength=n), best[np.arange(n), size]

    def _alone(self, word: bytes) -> tuple[np.ndarray, float]:
        if not hasattr(self, "lists"):
            self.lists = [x.tolist() for x in (self.base, self.check, self.leaf, self.score, CHAR)]
        base, check, leaf, score, char = self.lists
        n = len(word)
        best, back, low = [-np.inf] * (n + 1), [-1] * (n + 1), -np.inf
        best[0] = 0.0
        for s in range(n):
            here = best[s]
            if here == low:
                continue
            width = min(char[word[s]], n - s)
            state, end, single = 0, s, False
            while end < n:
                step = base[state] + word[end] + 1
                if check[step] != state:
                    break
                state, end = step, end + 1
                piece = leaf[state]
                if piece >= 0:
                    single = single or end == s + width
                    if here + score[piece] > best[end]:
                        best[end], back[end] = here + score[piece], piece
            if not single and here + self.unknown > best[s + width]:
                best[s + width] = here + self.unknown
                back[s + 1 : s + width + 1] = [-1] * width
        out = []
        while n:
            piece = back[n]
            out.append(piece if piece >= 0 else int(self.byte_id[word[n - 1]]))
            n -= len(self.text[piece]) if piece >= 0 else 1
        return np.array(out[::-1], np.int64), best[len(word)]

    def decode_bytes(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of each row of ids without the space in front; new offsets."""
        raw, ends = gathered(self.pool, self.start, ids)
        edge = ends[offsets]
        first = edge[:-1][(np.diff(edge) > 0)]
        first = first[raw[first] == 0x20]
        keep = np.ones(len(raw), bool)
        keep[first] = False
        kept = np.concatenate([[0], np.cumsum(keep)])
        return raw[keep], kept[edge]

    def decode(self, ids: list[int]) -> str:
        raw, _ = self.decode_bytes(np.array(ids, np.int64), np.array([0, len(ids)]))
        return raw.tobytes().decode("utf-8", "replace")


def double_array(keys: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and leaf: the child of state s by byte b is t = base[s] + b + 1 if check[t] == s; leaf[t] is a key's value."""
    children: list[dict[int, int]] = [{}]
    value = [-1]
    for key, number in keys:
        node = 0
        for byte in key:
            nxt = children[node].get(byte)
            if nxt is None:
                nxt = children[node][byte] = len(children)
                children.append({})
                value.append(-1)
            node = nxt
        value[node] = number
    size = 2 * len(children) + 1024
    base, check, leaf = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    free = np.ones(size, bool)
    free[0] = False
    state = {0: 0}
    lowest = top = 1
    todo = [0]
    while todo:
        following = []
        for node in sorted(todo, key=lambda x: -len(children[x])):
            codes = np.array(sorted(children[node]), np.int64) + 1
            if not len(codes):
                continue
            while not free[lowest]:
                lowest += int(free[lowest : lowest + 4096].argmax()) or min(4096, len(free) - lowest)
            # a lone child takes the first hole; a family looks for a fitting hole just below the top, else goes there
            from_ = max(lowest if len(codes) == 1 else top - NEAR, int(codes[0]))
            at = from_ - int(codes[0])
            if at + 4 * NEAR + 1024 > len(free):
                grow = len(free)
                base, check = np.append(base, np.zeros(grow, np.int64)), np.append(check, np.full(grow, -1, np.int64))
                leaf, free = np.append(leaf, np.full(grow, -1, np.int64)), np.append(free, np.ones(grow, bool))
            ahead = free[from_ : top + NEAR + 2].copy() if len(codes) > 1 or not free[from_] else free[from_ : from_ + 1]
            for c in codes[1:]:
                ahead &= free[at + c : at + c + len(ahead)]
            at += int(ahead.argmax())
            here = state.pop(node)
            base[here] = at
            top = max(top, at + int(codes[-1]))
            free[at + codes] = False
            check[at + codes] = here
            for byte, child in children[node].items():
                state[child] = at + byte + 1
                leaf[at + byte + 1] = value[child]
                following.append(child)
        todo = following
    used = int(np.flatnonzero(~free)[-1]) + 258
    fit = lambda a, fill: np.append(a, np.full(max(0, used - len(a)), fill))[:used]
    return fit(base, 0), fit(check, -1), fit(leaf, -1)


WORD = re.compile(r"\n| +[^ \n]*|[^ \n]+")


class Encoder:
    """Encodes texts and remembers the words met so far."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.forget()

    def forget(self) -> None:
        self.words = Numbers()
        self.ids, self.off, self.score = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, offsets of the texts, and the score of each. An empty text has no ids."""
        if len(self.words) > REMEMBERED:
            self.forget()
        split = [WORD.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        find = self.words.__getitem__
        places = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(find, w), np.int64, len(w)) for w in split)])
        if self.words.new:
            ids, off, score = self.pieces.segment([w.encode() for w in self.words.new])
            self.words.new = []
            self.ids, self.off = np.concatenate([self.ids, ids]), np.concatenate([self.off, self.off[-1] + off[1:]])
            self.score = np.concatenate([self.score, score])
        edge = np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)
        ids, off = gathered(self.ids, self.off, places)
        total = np.concatenate([[0.0], np.cumsum(self.score[places])])
        return ids, off[edge], total[edge[1:]] - total[edge[:-1]]


def _portions(batch: pa.RecordBatch, chars: int = 1 << 21) -> Iterator[tuple[int, list[str]]]:
    first, texts, held = 0, [], 0
    for i, t in enumerate(batch.column("text")):
        texts.append(t.as_py() or "")
        held += len(texts[-1])
        if held >= chars:
            yield first, texts
            first, texts, held = i + 1, [], 0
    if texts:
        yield first, texts


def _encode(pieces: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces)
        for batch in batches:
            for first, texts in _portions(batch):
                ids, off, score = encoder(texts)
                lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), lists, pa.array(score)], ["doc_id", "ids", "score"])

    return run


def encoded(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """doc_id, ids, score: the best segmentation of each whole text. Null and empty texts have no ids and score 0.

    Of segmentations of equal score the one of the longest last piece is taken, and so on from the end. A text of any
    length is worked on whole, in one task, word by word between spaces.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encode(pieces), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, score double")


def decoded(ids: Column, pieces: Pieces) -> Column:
    """Text of a column of ids; null ids give null. Bytes that are no UTF-8 become U+FFFD."""

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if x is None else pieces.decode(x) for x in batch.to_pylist()], pa.string())

    return text(ids)


def _both_ways(pieces: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces)
        names = ["doc_id", "n_pieces", "n_byte_pieces", "score", "ids_crc32", "round_trip"]
        for batch in batches:
            for first, texts in _portions(batch):
                ids, off, score = encoder(texts)
                raw, edge = pieces.decode_bytes(ids, off)
                want, want_edge = text_bytes(pa.array(texts, pa.large_string()))
                data, back, own = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), memoryview(raw), memoryview(want)
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
                same = [back[a:b] == own[c:d] for a, b, c, d in zip(edge[:-1].tolist(), edge[1:].tolist(), want_edge[:-1].tolist(), want_edge[1:].tolist())]
                in_bytes = np.concatenate([[0], np.cumsum(pieces.is_byte[ids])])[off]
                columns = [batch.column("doc_id").slice(first, len(texts)), pa.array(np.diff(off)), pa.array(np.diff(in_bytes)), pa.array(score),
                           pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def round_trips(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, score, ids_crc32 (little-endian 32-bit ids), round_trip: one row per document.

    Each whole text is encoded and decoded again; ``round_trip`` tells whether the text came back, which holds for every
    text without the marker U+2581 itself. Null and empty texts have no pieces. Ties and very long texts: see encoded.
    Repeated rows and null ids are rows of their own. Other columns are not read. An empty table gives none. No shuffle.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_both_ways(pieces), f"doc_id {kind}, n_pieces long, n_byte_pieces long, score double, ids_crc32 long, round_trip boolean")
