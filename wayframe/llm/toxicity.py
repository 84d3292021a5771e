"""Severity of toxic language by cumulative-link ordinal regression on sparse word features.

Labels say toxic or not. Toxic labelled documents are graded by how often words occur in them that labelled documents
tie to toxicity; so grades run from 0 (clean) to GRADES. One weight vector serves all thresholds:
P(grade >= k) = sigmoid(score - threshold_k). The expected severity is the sum of these probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import sampled, sigmoid
from .tables import Steps
from .words import Words, mix, separators, text_bytes

GRADES = 3
FEATURES = 1 << 20
#: Beside whole words, their first so many bytes are features: insults are often compounds of one stem.
STEMS = (4, 5, 6, 7, 8, 9, 10)
#: Features that enter the regression: those that tell toxic sample rows from clean ones best.
SCREENED = 1000
#: Bound of the labelled rows used to fit.
LABELLED = 12_000
SLICE = 4 << 20
#: A word hints at toxicity if it is in so many toxic sample documents, and so much more likely there (log odds).
HINT_ROWS, HINT_ODDS = 3, 2.5

#: Words are runs of ASCII letters and of bytes of other scripts.
BREAKS = separators(tuple(b for b in range(128) if not chr(b).isalpha()))


@dataclass
class Sparse:
    """Rows of (feature, value); row i is at[i] : at[i + 1]."""

    at: np.ndarray
    feature: np.ndarray
    value: np.ndarray

    def dot(self, weights: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(weights[self.feature] * self.value)])
        return sums[self.at[1:]] - sums[self.at[:-1]]

    def transposed_dot(self, rows: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.feature, np.repeat(rows, np.diff(self.at)) * self.value, size)

    def rows(self, chosen: np.ndarray) -> Sparse:
        size = np.diff(self.at)[chosen]
        at = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(at[-1]) + np.repeat(self.at[:-1][chosen] - at[:-1], size)
        return Sparse(at, self.feature[place], self.value[place])


def word_counts(column: pa.Array) -> Iterator[Sparse]:
    """Hashed words and stems of each text with the log of one plus their count (1 for a word that occurs once)."""
    raw, offsets = text_bytes(pc.utf8_lower(column))
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
        words = Words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], BREAKS)
        owner = words.owner().astype(np.int64) << 20
        keys = [owner | (words.hash % np.uint64(FEATURES)).astype(np.int64)]
        part, size = np.zeros(len(owner), np.uint64), words.end - words.start
        for k in range(STEMS[-1]):
            long = np.flatnonzero(size > k)
            part[long] = mix(part[long] + words.raw[words.start[long] + k] + np.uint64(1))
            if k + 1 in STEMS:
                keys.append(owner[long] | (part[long] % np.uint64(FEATURES)).astype(np.int64))
        found, count = np.unique(np.concatenate(keys), return_counts=True)
        yield Sparse(np.searchsorted(found >> 20, np.arange(hi - lo + 1)), found & (FEATURES - 1), np.log2(1.0 + count))
        lo = hi


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, score: np.ndarray) -> np.ndarray:
        return sigmoid(score[:, None] - self.thresholds[None, :])

    @staticmethod
    def fit(x: Sparse, grade: np.ndarray, grades: int, ridge: float = 0.05, steps: int = 30) -> Ordinal:
        """Newton's method on the penalised log-likelihood, by turns for the shared weights and for the thresholds.

        A grade g has probability P(>= g) - P(>= g + 1), which is log-concave in score and thresholds.
        """
        n = max(1, len(grade))
        share = np.clip([(grade >= k).mean() if len(grade) else 0.5 for k in range(1, grades + 1)], 0.5 / n, 1 - 0.5 / n)
        t = np.log((1 - share) / share)
        t = t[0] + np.concatenate([[0.0], np.cumsum(np.maximum(np.diff(t), 0.2))])
        used, place = np.unique(x.feature, return_inverse=True)
        weights = np.zeros(FEATURES)
        if not len(grade) or len(np.unique(grade)) < 2 or not len(used):
            return Ordinal(weights, t)
        dense = np.zeros((n, len(used)), np.float32)
        dense[np.repeat(np.arange(n), np.diff(x.at)), place] = x.value
        rows = np.arange(n)
        w = np.zeros(len(used))

        def state(w, t):
            edge = np.concatenate([np.full((n, 1), 40.0), (dense @ w)[:, None] - t[None, :], np.full((n, 1), -40.0)], axis=1)
            p = sigmoid(edge)
            high, low = p[rows, grade], p[rows, grade + 1]
            mass = np.maximum(high - low, 1e-12)
            return high, low, mass, ridge / 2 * (w @ w) - np.log(mass).sum()

        value = state(w, t)[3]
        for _ in range(steps):
            high, low, mass, _ = state(w, t)
            bend = (high * (1 - high) + low * (1 - low)).astype(np.float32)
            curve = ((dense * bend[:, None]).T @ dense).astype(float) + ridge * np.eye(len(w))
            move = np.linalg.solve(curve, dense.T @ (1 - high - low) - ridge * w)
            w, new = _shorter(lambda f: (w + f * move, state(w + f * move, t)[3]), state(w, t)[3])
            high, low, mass, now = state(w, t)
            up, down = high * (1 - high) / mass, low * (1 - low) / mass
            g = np.zeros((n, grades + 2))
            g[rows, grade] -= up
            g[rows, grade + 1] += down
            slope = g[:, 1:-1]
            move_t = np.linalg.solve(slope.T @ slope + 1e-6 * np.eye(grades), slope.sum(axis=0))
            keep_order = lambda f: t + f * move_t
            t, new = _shorter(lambda f: (keep_order(f), state(w, keep_order(f))[3] if np.all(np.diff(keep_order(f)) > 1e-3) else np.inf), now)
            if value - new < 1e-6 * max(1.0, abs(value)):
                break
            value = new
        weights[used] = w
        return Ordinal(weights, t)


def _shorter(at, value: float):
    """The step cut in halves until it does not climb; no step if none does."""
    factor = 1.0
    for _ in range(20):
        point, new = at(factor)
        if new <= value:
            return point, new
        factor /= 2
    return at(0.0)


def severity_grades(x: Sparse, toxic: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """0 for clean rows; toxic rows get 1..grades by the amount of words in them that hint at toxicity."""
    bad = toxic == 1
    owner = np.repeat(np.arange(len(toxic)), np.diff(x.at))
    in_bad = np.bincount(x.feature, bad[owner], FEATURES)
    in_good = np.bincount(x.feature, ~bad[owner], FEATURES)
    odds = np.log((in_bad + 0.5) / (bad.sum() + 1)) - np.log((in_good + 0.5) / ((~bad).sum() + 1))
    hints = ((in_bad >= HINT_ROWS) & (odds >= HINT_ODDS)).astype(float)
    amount = x.dot(hints)
    cuts = np.quantile(amount[bad], np.arange(1, grades) / grades) if bad.any() else np.zeros(grades - 1)
    return np.where(bad, 1 + np.searchsorted(cuts, amount, "left"), 0)


def severity_column(model: Ordinal, text: Column) -> Column:
    used = np.flatnonzero(model.weights)
    thin = (used.astype(np.int32), model.weights[used])

    @F.arrow_udf("struct<at_least: array<double>, expected_severity: double>")
    def severity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = np.zeros(FEATURES)
        weights[thin[0]] = thin[1]
        whole = Ordinal(weights, model.thresholds)
        k = len(model.thresholds)
        for batch in batches:
            score = np.concatenate([x.dot(weights) for x in word_counts(batch)] or [np.zeros(0)])
            p = whole.at_least(score)
            yield pa.StructArray.from_arrays(
                [pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * k, pa.array(p.ravel())), pa.array(p.sum(axis=1))],
                ["at_least", "expected_severity"])

    return severity(F.coalesce(text.cast("string"), F.lit("")))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for x in word_counts(batch.column(1)):
            n = len(x.at) - 1
            spans = list(zip(x.at[:-1].tolist(), x.at[1:].tolist()))
            feature, value = x.feature.astype(np.int32), x.value.astype(np.float32)
            blobs = [pa.array([v[a:b].tobytes() for a, b in spans], pa.binary()) for v in (feature, value)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, n), *blobs], ["doc_id", "feature", "value"])
            done += n


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and toxic rows of each feature, added up per task."""
    rows, bad = np.zeros(FEATURES, np.int64), np.zeros(FEATURES, np.int64)
    for batch in batches:
        for feature, toxic in zip(batch.column("feature").to_pylist(), batch.column("toxic").to_pylist()):
            found = np.frombuffer(feature, np.int32)
            rows[found] += 1
            bad[found] += toxic
    used = np.flatnonzero(rows)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(rows[used]), pa.array(bad[used])], ["feature", "rows", "bad"])


def _restricted(used: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(FEATURES, bool)
        wanted[used] = True
        for batch in batches:
            features, values = [], []
            for feature, value in zip(batch.column("feature").to_pylist(), batch.column("value").to_pylist()):
                found = np.frombuffer(feature, np.int32)
                keep = wanted[found]
                features.append(found[keep].tobytes())
                values.append(np.frombuffer(value, np.float32)[keep].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array(features, pa.binary()), pa.array(values, pa.binary())], ["doc_id", "toxic", "feature", "value"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, grades: int = GRADES) -> Ordinal:
    """Fit on at most about LABELLED labelled documents; the driver gets their SCREENED best features only."""
    steps = Steps(docs.sparkSession, "toxicity")
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # the sample is bounded by LABELLED, whatever the tables' size, so it can go to every task
    sample = F.broadcast(sampled(known, "doc_id", LABELLED, known.count()))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(sample.select("doc_id"), "doc_id", "left_semi")
    # one row per id, the least text: a repeated id brings no more rows than another
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    counted = texts.mapInArrow(_features, f"doc_id {id_type}, feature binary, value binary").join(sample, "doc_id")
    counted = steps.table(counted.select("doc_id", "toxic", "feature", "value"), "features")
    share = counted.agg(F.avg("toxic")).first()[0] or 0.0
    expected = F.col("rows") * F.lit(share)
    score = (F.col("bad") - expected) / F.sqrt(expected + 0.5)
    found = counted.mapInArrow(_feature_rows, "feature int, rows long, bad long").groupBy("feature").agg(F.sum("rows").alias("rows"), F.sum("bad").alias("bad"))
    best = found.where(F.col("bad") >= HINT_ROWS).select("feature", score.alias("score")).where("score > 2").orderBy(F.desc("score"), "feature").limit(SCREENED)
    used = np.array(sorted(r["feature"] for r in best.collect()), np.int64)
    kept = counted.mapInArrow(_restricted(used), f"doc_id {id_type}, toxic int, feature binary, value binary").collect()
    kept.sort(key=lambda r: (r["doc_id"], r["feature"]))
    size = [len(r["feature"]) // 4 for r in kept]
    x = Sparse(np.concatenate([[0], np.cumsum(size)]).astype(np.int64), np.frombuffer(b"".join(r["feature"] for r in kept), np.int32).astype(np.int64),
               np.frombuffer(b"".join(r["value"] for r in kept), np.float32).astype(float))
    toxic = np.array([r["toxic"] for r in kept], int)
    return Ordinal.fit(x, severity_grades(x, toxic, grades), grades)


def toxicity(docs: DataFrame, labels: DataFrame, grades: int = GRADES) -> DataFrame:
    """doc_id, at_least_1 ... at_least_<grades>, expected_severity, severity, toxic: one row per document.

    ``severity`` is the highest grade that the document reaches with probability one half; ``toxic`` tells whether it is
    1 or more. Null text is empty; documents without letters, and all documents if labels have one kind only, get the
    shares of the grades. Ids without a document and labels other than 0 and 1 are not used; a document with both
    counts as toxic, and of several rows of a labelled id the least text is fitted on. Repeated rows and rows of null id
    are scored each. A text of any length is read whole, in one task. An empty table gives none. Other columns are not read.
    """
    model = fit_toxicity(docs, labels, grades)
    scored = docs.select("doc_id", severity_column(model, F.col("text")).alias("s"))
    levels = [F.col("s.at_least")[k - 1].alias(f"at_least_{k}") for k in range(1, grades + 1)]
    out = scored.select("doc_id", *levels, F.col("s.expected_severity").alias("expected_severity"))
    reached = sum((F.col(f"at_least_{k}") >= 0.5).cast("int") for k in range(1, grades + 1))
    return out.withColumn("severity", reached).withColumn("toxic", F.col("severity") >= 1)
