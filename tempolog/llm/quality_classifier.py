"""Text quality by a linear support vector machine over n-gram indicators scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempolog.llm.common import Cache, durable, map_batches, map_partitions, ragged, text_bytes, text_or_empty

# Places of the hashed n-grams.
PLACES = 1 << 18
# Labelled rows that the linear model is fitted on; the class counts use all labelled rows.
FIT_ROWS = 20_000
FOLDS = 5
THRESHOLD = 0.3
# Longer runs without white space are taken by so many neighbouring kinds of characters.
LONG, KINDS = 64, 3
_SAME = 1
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class _Kinds(dict):
    """The kind of each character, for ``str.translate``."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = "U" if c.isupper() else "l" if c.isalpha() else "d" if c.isdigit() else c
        return self[code]


_KINDS, _REPEATS = _Kinds(), re.compile(r"([Uld])\1+|([^Uld])\2{3,}", re.DOTALL)


def form(word: bytes | str) -> str:
    """The form of a word: runs of upper case, lower case and digits by one letter each, other signs up to three times."""
    text = word.decode(errors="replace") if isinstance(word, bytes) else word
    return _REPEATS.sub(r"\1\2\2\2", text.translate(_KINDS))


class Features:
    """Indices of the n-grams (one to three words) of word forms in a text.

    A word equal to the one before it has a form of its own. Words themselves are no features: what they mean is
    not to decide about quality. A run of over ``LONG`` characters (text without spaces, encoded data) counts as a
    sequence of words, one for each ``KINDS`` neighbouring kinds of its whole form.
    """

    def __init__(self):
        self.words = Cache(lambda w: xxhash.xxh64_intdigest(w) & ~0xFFFF | max(2, zlib.crc32(form(w).encode()) & 0xFFFF))

    def values(self, words: list[bytes]) -> np.ndarray:
        """For each word its hash, with the form in the last 16 bits."""
        if max(map(len, words)) <= LONG:
            return np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        parts = []
        for word in words:
            text = word.decode(errors="replace") if len(word) > LONG else ""
            kinds = form(text) if len(text) > LONG else ""
            if len(kinds) > KINDS:
                pieces = [kinds[i:i + KINDS].encode() for i in range(len(kinds) - KINDS + 1)]
                parts.append(np.fromiter(map(self.words.__getitem__, pieces), np.uint64, len(pieces)))
            elif len(text) > LONG:  # not kept in the cache, which would hold the run
                parts.append(np.array([self.words.compute(word)], np.uint64))
            else:
                parts.append(np.array([self.words[word]], np.uint64))
        return np.concatenate(parts)

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.split()
        if not words:
            return np.zeros(0, np.int32)
        values = self.values(words)
        forms = values & np.uint64(0xFFFF)
        forms[1:][values[1:] == values[:-1]] = _SAME
        forms = np.r_[np.uint64(0), forms, np.uint64(0)]
        grams = [forms[1:-1] * _STEPS[0]]
        for n in (2, 3):
            if len(forms) >= n:
                grams.append(sum(forms[i:len(forms) - n + 1 + i] * _STEPS[i] * np.uint64(n * n + 1) for i in range(n)) ^ np.uint64(n))
        mixed = np.concatenate(grams)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _STEPS[1]
        return np.unique(mixed >> np.uint64(46)).astype(np.int32)


def featurize(docs: DataFrame) -> DataFrame:
    """``(doc_id, features)`` for every row; a null text is empty."""

    def start():
        features = Features()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [features(x) for x in text_bytes(batch)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), ragged(found, np.int32)], names=["doc_id", "features"])

        return work

    return map_batches(docs.select("doc_id", text_or_empty().alias("text")), start, "doc_id long, features array<int>")


def class_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """In how many rows of either class (``label`` 1, 0) each feature occurs, over all rows.

    Tasks count what they read and send at most ``PLACES`` sums; so does the result.
    """

    def run(batches):
        sums = np.zeros((2, PLACES), np.int64)
        for batch in batches:
            lists, labels = batch.column("features"), batch.column("label").to_numpy()
            per = np.repeat(labels, np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten().to_numpy()
            for k in (0, 1):
                sums[k] += np.bincount(flat[per == k], minlength=PLACES)
        seen = np.flatnonzero(sums.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(sums[1][seen]), pa.array(sums[0][seen])],
                                         names=["feature", "ones", "zeros"])

    parts = map_partitions(rows.select("features", "label"), run, "feature int, ones long, zeros long")
    table = parts.groupBy("feature").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")).toPandas()
    ones, zeros = np.zeros(PLACES), np.zeros(PLACES)
    ones[table["feature"]], zeros[table["feature"]] = table["ones"], table["zeros"]
    return ones, zeros


def log_count_ratio(ones: np.ndarray, zeros: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    p, q = ones + smoothing, zeros + smoothing
    return np.where(ones + zeros > 0, np.log(p / p.sum()) - np.log(q / q.sum()), 0.0)


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, size: int,
                            cost: float = 1.0, rounds: int = 30, tolerance: float = 1e-3, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of the L2-regularised hinge loss, one dual variable at a time.

    Each step solves for one row's dual variable, kept within 0 and ``cost``, and moves the weights along that row.
    Ends when no projected gradient of a round is above the tolerance.
    """
    weights, duals = np.zeros(size + 1), np.zeros(len(rows))
    signs = np.where(labels > 0, 1.0, -1.0)
    norms = np.array([v @ v + 1.0 for v in values])
    draw = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in draw.permutation(len(rows)):
            at, x, y = rows[i], values[i], signs[i]
            slope = y * (weights[at] @ x + weights[-1]) - 1.0
            old = duals[i]
            worst = max(worst, abs(min(slope, 0.0) if old <= 0 else max(slope, 0.0) if old >= cost else slope))
            duals[i] = min(max(old - slope / norms[i], 0.0), cost)
            if duals[i] != old:
                move = (duals[i] - old) * y
                weights[at] += move * x
                weights[-1] += move
        if worst < tolerance:
            break
    return weights


def sigmoid_fit(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to the share of label 1, by Newton steps on smoothed labels."""
    n1, n0 = (labels > 0).sum(), (labels <= 0).sum()
    goal = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    at = np.array([1.0, 0.0])
    x = np.stack([margins, np.ones_like(margins)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -35, 35)))
        slope = x @ (p - goal) + 1e-6 * at
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2), slope)
        at = at - np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(max(at[0], 0.0)), float(at[1])


@dataclass
class Model:
    """Weights by feature: ``ratio`` scales an indicator, ``weights`` (with bias) is the linear model."""

    ratio: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float

    def margins(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For rows whose features are ``flat[ends[i]:ends[i + 1]]``."""
        sums, squares = (np.diff(np.r_[0.0, np.cumsum(x)][ends]) for x in (self.ratio[flat] * self.weights[flat], self.ratio[flat] ** 2))
        return sums / np.sqrt(np.maximum(squares, 1e-12)) + self.weights[-1]

    def scores(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(flat, ends) + self.offset, -35, 35)))


def fit(rows: DataFrame, bound: int = FIT_ROWS) -> Model:
    """The model of ``rows`` (``doc_id``, ``features``, ``label`` 0 or 1).

    The log-count ratios use all rows. The linear model is fitted on at most ``bound`` of them, picked by a hash of
    doc_id. Without rows of both classes every score is the share of label 1 (a half, if there are no rows).
    """
    ones, zeros = class_counts(rows)
    total, positive = rows.agg(F.count("*"), F.sum("label")).first()
    model = Model(log_count_ratio(ones, zeros), np.zeros(PLACES + 1), 0.0, 0.0)
    if not total or positive in (0, total):
        share = (positive + 1) / (total + 2) if total else 0.5
        model.offset = float(np.log(share / (1 - share)))
        return model
    grain = 1 << 30
    part = F.pmod(F.xxhash64("doc_id"), F.lit(grain)) < int(grain * min(1.0, 0.9 * bound / total)) if total > bound else F.lit(True)
    sample = rows.where(part).select("doc_id", "features", "label").limit(bound).toPandas().sort_values("doc_id")
    found = [np.asarray(x, np.int64) for x in sample["features"]]
    values = [model.ratio[x] for x in found]
    values = [v / max(np.sqrt(v @ v), 1e-6) for v in values]
    labels = sample["label"].to_numpy()
    model.weights = dual_coordinate_descent(found, values, labels, PLACES)
    margins = np.array([model.weights[x] @ v + model.weights[-1] for x, v in zip(found, values)])
    if len(set(labels)) == 2:
        model.slope, model.offset = sigmoid_fit(margins, labels)
    return model


def _held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def learn(stored: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> Model:
    """The model of the labelled rows among ``stored`` (``doc_id``, ``features``) that are not held out."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    return fit(durable(stored.where(~_held_out()).join(known, "doc_id")), bound)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bound: int = FIT_ROWS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Rows whose ``crc32(doc_id as text) mod 5`` is 0 are held out (a null doc_id counts as the empty text, which is);
    the model learns ``labels.quality`` from the others. Of repeated labels the larger counts; null labels are none.
    The score uses the text alone; a null text is empty. Texts are read once: their features are written to the
    shared folder, and both fitting and scoring read them there. Further columns are ignored.
    """
    stored = durable(featurize(docs))
    model = learn(stored, labels, bound)

    def start():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column("features")
            ends = lists.offsets.to_numpy()
            scores = model.scores(lists.flatten().to_numpy(), ends - ends[0])
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

        return work

    scored = map_batches(stored, start, "doc_id long, score double")
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bound: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more, in the same columns and without moving them.

    As ``quality_scores``; every row is judged by its own text, with or without a doc_id.
    """
    model = learn(durable(featurize(docs)), labels, bound)

    def start():
        features = Features()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [features(x) for x in text_bytes(batch)]
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            return batch.filter(pa.array(model.scores(flat, np.cumsum([0, *map(len, found)])) >= threshold))

        return work

    return map_batches(docs, start, docs.schema)
