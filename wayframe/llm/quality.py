"""Quality classifier by co-training of a text view and a metadata view.

Each view is a logistic regression over binned features. In each round a view hands the rows it is surest about, with
the label it gives them, to the other view. After the rounds each view is calibrated on held-out labelled rows, and the
calibrated log-odds are weighted by a last regression on those rows. The result scores every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import Words, separators, text_bytes, window_hashes

BINS = 12
SOURCES = 64
LANGS = 16
#: Bounds of the rows used to fit: labelled ones, and unlabelled ones that may get pseudo-labels.
LABELLED = 20_000
UNLABELLED = 20_000
ROUNDS = 4
#: Share of the unlabelled rows that a view hands over in a round.
HANDED = 0.05

CLASSES = 8
_CLASS = np.full(256, 7, np.uint8)  # 7: other symbols
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[128:] = 3
_CLASS[ord("0") : ord("9") + 1] = 4
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 5
_CLASS[ord("!")] = 6

TEXT_FEATURES = (
    "symbols", "capitals", "accents", "digits", "stops", "shouts", "word_length", "distinct_words", "stuttered", "lines_again",
    "line_words", "four_words_again", "closed_words", "first_capital", "longest_word", "log_words",
)
SLICE = 4 << 20


def text_features(column: pa.Array) -> np.ndarray:
    """One row of TEXT_FEATURES per text; null and empty texts give zeros."""
    raw, offsets = text_bytes(column)
    out = []
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
        out.append(_features(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
        lo = hi
    return np.concatenate(out) if out else np.zeros((0, len(TEXT_FEATURES)))


def _per_text(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n)


def _repeats(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many hashes of a text came before in it."""
    if not len(hashes):
        return np.zeros(n)
    mixed = hashes ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(mixed, kind="stable")
    again = np.flatnonzero(mixed[order][1:] == mixed[order][:-1]) + 1
    return np.bincount(owner[order[again]], minlength=n).astype(float)


def _features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    classes = np.zeros((n, CLASSES))
    kinds = _CLASS[raw]
    for lo in range(0, n):
        classes[lo] = np.bincount(kinds[offsets[lo] : offsets[lo + 1]], minlength=CLASSES)
    words = Words(raw, offsets, separators())
    owner, count = words.owner(), words.counts().astype(float)
    size = (words.end - words.start).astype(float)
    ends = kinds[words.end - 1] if len(size) else np.zeros(0)
    starts = kinds[words.start] if len(size) else np.zeros(0)
    lines = Words(raw, offsets, separators((10,)))
    line_count = lines.counts().astype(float)
    quads = window_hashes(words.hash, 4)
    inside = owner[: len(quads)] == owner[3 : 3 + len(quads)]
    stutter = (words.hash[1:] == words.hash[:-1]) & (owner[1:] == owner[:-1])
    solid = np.maximum(classes[:, 1:].sum(axis=1), 1)
    letters = np.maximum(classes[:, 1] + classes[:, 2] + classes[:, 3], 1)
    many = np.maximum(count, 1)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, size)
    return np.column_stack([
        classes[:, 7] / solid, classes[:, 1] / letters, classes[:, 3] / letters, classes[:, 4] / solid, classes[:, 5] / solid,
        classes[:, 6] / solid, size_mean(size, owner, n, many), (count - _repeats(words.hash, owner, n)) / many,
        _per_text(stutter.astype(float), owner[1:], n) / many, _repeats(lines.hash, lines.owner(), n) / np.maximum(line_count, 1),
        np.log1p(count / np.maximum(line_count, 1)), _repeats(quads[inside], owner[: len(quads)][inside], n) / many,
        _per_text((ends >= 6).astype(float), owner, n) / many, _per_text((starts == 1).astype(float), owner, n) / many,
        np.log1p(longest), np.log1p(count),
    ])


def size_mean(size, owner, n, many):
    return _per_text(size, owner, n) / many


def metadata_features(lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """Language and source as hash classes, and the log of the length; -1 stands for null."""
    coded = lambda column, size: np.array([-1 if v is None else zlib.crc32(v.encode()) % size for v in column.to_pylist()], float)
    length = np.array([-1.0 if v is None else np.log1p(max(v, 0)) for v in n_chars.to_pylist()], float)
    return np.column_stack([coded(lang, LANGS), coded(source, SOURCES), length]).reshape(-1, 3)


@dataclass
class Logistic:
    weights: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 25) -> Logistic:
        """Newton's method with a ridge penalty on all weights but the last, the constant's."""
        w = np.zeros(x.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-6
        for _ in range(steps):
            p = sigmoid(x @ w)
            curve = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
            step = np.linalg.solve(curve, x.T @ (weight * (y - p)) - penalty * w)
            size = np.abs(step).max()
            w += step * min(1.0, 5.0 / max(size, 1e-12))
            if size < 1e-6:
                break
        return Logistic(w)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Binned:
    """One-hot bins of continuous features at quantiles of the fitted rows, one-hot classes of the others, a constant."""

    edges: list[np.ndarray | int] = field(default_factory=list)

    @staticmethod
    def fit(x: np.ndarray, classes: dict[int, int]) -> Binned:
        cut = np.linspace(0, 1, BINS + 1)[1:-1]

        def edges(column: np.ndarray) -> np.ndarray:
            above = column[column > column.min()]  # most texts may share the lowest value
            return np.unique(np.concatenate([np.quantile(column, cut), [column.min()], np.quantile(above, cut) if len(above) else []]))

        return Binned([classes[k] if k in classes else edges(x[:, k]) for k in range(x.shape[1])])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        parts = []
        for k, edge in enumerate(self.edges):
            code, size = (x[:, k].astype(int) + 1, edge + 1) if isinstance(edge, int) else (np.searchsorted(edge, x[:, k], "left"), len(edge) + 1)
            hot = np.zeros((len(x), size))
            hot[np.arange(len(x)), code] = 1
            parts.append(hot)
        return np.concatenate([*parts, np.ones((len(x), 1))], axis=1)


@dataclass
class View:
    binned: Binned
    model: Logistic
    slope: float = 1.0
    shift: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.model.logits(self.binned(x)) + self.shift


@dataclass
class CoTrained:
    """Calibrated views and the weights of their log-odds."""

    text: View
    meta: View
    mixing: np.ndarray

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.logits(text), self.meta.logits(meta)
        return sigmoid(a), sigmoid(b), sigmoid(self.mixing[0] * a + self.mixing[1] * b + self.mixing[2])


def calibrated(view: View, x: np.ndarray, y: np.ndarray) -> View:
    """Platt scaling towards targets drawn in by one row of each label."""
    z = view.model.logits(view.binned(x))
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    line = Logistic.fit(np.column_stack([z, np.ones(len(z))]), target, np.ones(len(z)), ridge=1e-3)
    return View(view.binned, view.model, max(float(line.weights[0]), 0.0), float(line.weights[1]))


def co_train(text: np.ndarray, meta: np.ndarray, label: np.ndarray, rounds: int = ROUNDS, seed: int = 11) -> CoTrained:
    """``label`` is 0 or 1, and -1 for unlabelled rows. Without both labels every score is the share of ones."""
    known = np.flatnonzero(label >= 0)
    share = (label[known].sum() + 1) / (len(known) + 2)
    views_x = [text, meta]
    binned = [Binned.fit(text, {}) if len(text) else Binned([np.zeros(0)] * text.shape[1]), Binned.fit(meta, {0: LANGS, 1: SOURCES}) if len(meta) else Binned([LANGS, SOURCES, np.zeros(0)])]
    if len(np.unique(label[known])) < 2 or len(known) < 10:
        flat = [View(b, Logistic(np.zeros(b(np.zeros((1, len(b.edges)))).shape[1])), 0.0, float(np.log(share / (1 - share)))) for b in binned]
        return CoTrained(*flat, np.array([0.5, 0.5, 0.0]))
    order = np.random.default_rng(seed).permutation(known)
    held, fitted = order[: max(4, len(order) // 5)], order[max(4, len(order) // 5) :]
    if len(np.unique(label[fitted])) < 2 or len(np.unique(label[held])) < 2:
        held = fitted = known
    hot = [b(x) for b, x in zip(binned, views_x)]
    pool = np.flatnonzero(label < 0)
    given = [dict.fromkeys(fitted.tolist()), dict.fromkeys(fitted.tolist())]  # rows of each view
    for view in given:
        for i in view:
            view[i] = (float(label[i]), 1.0)

    def fit(k: int) -> Logistic:
        rows = np.fromiter(given[k], np.int64)
        y, w = np.array(list(given[k].values())).T
        return Logistic.fit(hot[k][rows], y, w)

    models = [fit(0), fit(1)]
    for _ in range(rounds):
        for k in (0, 1):
            free = np.array([i for i in pool.tolist() if i not in given[1 - k]], np.int64)
            if not len(free):
                continue
            p = sigmoid(models[k].logits(hot[k][free]))
            for one, score in ((1.0, p), (0.0, 1 - p)):
                size = int(len(pool) * HANDED * (share if one else 1 - share))
                for j in np.argsort(-score, kind="stable")[:size]:
                    if score[j] >= 0.95:  # a weak view is sure of few rows, and then hands over few
                        given[1 - k][int(free[j])] = (one, 0.3)
        models = [fit(0), fit(1)]
    views = [calibrated(View(b, m), x[held], label[held]) for b, m, x in zip(binned, models, views_x)]
    z = np.column_stack([v.logits(x[held]) for v, x in zip(views, views_x)] + [np.ones(len(held))])
    mixing = Logistic.fit(z, label[held].astype(float), np.ones(len(held)), ridge=0.1).weights
    if mixing[0] < 0 or mixing[1] < 0:  # a view that speaks against itself is left out
        mixing = np.array([float(mixing[0] >= mixing[1]), float(mixing[1] > mixing[0]), 0.0])
    return CoTrained(*views, mixing)


FEATURES = T.ArrayType(T.DoubleType())


def feature_columns(text: str, lang: str, source: str, n_chars: str) -> Column:
    """Both views of a document as one array."""

    @F.arrow_udf(FEATURES)
    def features(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for body, language, origin, length in batches:
            both = np.concatenate([text_features(body), metadata_features(language, origin, length)], axis=1)
            yield pa.ListArray.from_arrays(np.arange(len(both) + 1, dtype=np.int32) * both.shape[1], pa.array(both.ravel()))

    named = [F.col(f"`{c}`") for c in (text, lang, source, n_chars)]
    return features(*[c.cast("string") for c in named[:3]], named[3].cast("long"))


def score_column(model: CoTrained, features: Column) -> Column:
    @F.arrow_udf("struct<text_score: double, metadata_score: double, quality_score: double>")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        k = len(TEXT_FEATURES)
        for batch in batches:
            both = batch.flatten().to_numpy().reshape(len(batch), -1) if len(batch) else np.zeros((0, k + 3))
            found = model.scores(both[:, :k], both[:, k:])
            yield pa.StructArray.from_arrays([pa.array(x) for x in found], ["text_score", "metadata_score", "quality_score"])

    return scores(features)


def sampled(df: DataFrame, id_column: str, size: int, count: int) -> DataFrame:
    """About ``size`` of ``count`` rows, chosen by a hash of the id."""
    return df if count <= size else df.where(F.pmod(F.xxhash64(F.lit(7), F.col(id_column)), F.lit(1 << 30)) < int(size / count * (1 << 30)))


def fit_quality(features: DataFrame, labels: DataFrame) -> CoTrained:
    """Fit on at most about LABELLED labelled and UNLABELLED other ids of features (doc_id, features).

    An id brings one row, that of its least features, however often it is repeated.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    sample = sampled(known, "doc_id", LABELLED, known.count())
    with_label = features.join(sample, "doc_id").groupBy("doc_id").agg(F.min("features").alias("features"), F.max("label").alias("label"))
    others = features.join(known, "doc_id", "left_anti")
    pool = sampled(others, "doc_id", UNLABELLED, others.select("doc_id").distinct().count())
    pool = pool.groupBy("doc_id").agg(F.min("features").alias("features"), F.lit(-1).alias("label"))
    rows = sorted(with_label.unionByName(pool).toLocalIterator(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    both = np.array([r["features"] for r in rows], float).reshape(len(rows), len(TEXT_FEATURES) + 3)
    k = len(TEXT_FEATURES)
    return co_train(both[:, :k], both[:, k:], np.array([r["label"] for r in rows], int))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, text_score, metadata_score, quality_score, kept: one row per document.

    Null text is empty, and null metadata a class of its own; ids without a document and labels other than 0 and 1 are
    not used; a document with both labels counts as good. Repeated rows are scored each. Without labels of both kinds
    every score is the share of good ones (one half if there are none). Of several rows of an id one is fitted on. A text
    of any length is read whole, in one task; rows of null id are scored as others. An empty table gives none. Other columns are not read.
    """
    from .tables import Steps

    steps = Steps(docs.sparkSession, "quality")
    features = steps.table(docs.select("doc_id", feature_columns("text", "lang", "source", "n_chars").alias("features")), "features")
    model = fit_quality(features, labels)
    scored = features.select("doc_id", score_column(model, F.col("features")).alias("s")).select("doc_id", "s.*")
    return scored.withColumn("kept", F.col("quality_score") >= threshold)


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that the classifier keeps, with all their columns."""
    from .tables import Steps, free_name

    steps = Steps(docs.sparkSession, "quality")
    named = feature_columns("text", "lang", "source", "n_chars")
    model = fit_quality(steps.table(docs.select("doc_id", named.alias("features")), "features"), labels)
    score = free_name(docs.columns, "score_of_quality")
    scored = docs.withColumn(score, score_column(model, named))
    return scored.where(F.col(score)["quality_score"] >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
