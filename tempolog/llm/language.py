"""Language of a text: the average of hashed subword embeddings, and a linear softmax over it with a calibrated rejection."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempolog.llm.common import map_batches

# Places of the hashed subwords, their lengths in bytes, and the size of an embedding.
PLACES, SUBWORDS, SIZE = 1 << 16, (1, 2, 3, 4), 16
# Labelled rows that the model is fitted on, over all languages, and the places of one row that are kept for that.
FIT_ROWS, FIT_PLACES = 6000, 4096
FOLDS, HELD_OUT = 4, 2
ROUNDS, RATE = 5, 0.05
# One in so many of the rows at hand calibrates the scores instead; a text is accepted where they promise so much precision.
CALIBRATE, PRECISION = 5, 0.995
# Bytes of a text that are hashed at once; the words of a fit's snippets.
PIECE, SNIPPET = 1 << 18, 12
UNKNOWN = "und"
_WORDS = re.compile(r"[^\W\d_]+")
_STEPS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint64)


def normal(text: str | None) -> bytes:
    """The words of a text in lower case, between single spaces; empty if it has no letter."""
    words = _WORDS.findall((text or "").lower())
    return f" {' '.join(words)} ".encode() if words else b""


def places(data: bytes) -> np.ndarray:
    """The hashed subwords of ``normal`` text: all its runs of 1 to 4 bytes that do not reach past a word's spaces."""
    flat = np.frombuffer(data, np.uint8)
    space = flat == 0x20
    before = np.r_[0, np.cumsum(space)]
    found = []
    value = np.zeros(len(flat), np.uint64)
    for k in SUBWORDS:
        width = len(flat) - k + 1
        if width <= 0:
            break
        value = value[:width] + (flat[k - 1:].astype(np.uint64) + np.uint64(1)) * _STEPS[k - 1]
        # Inner bytes are no spaces, and neither is a single byte.
        clear = before[k - 1:k - 1 + width] == before[1:1 + width] if k > 1 else ~space
        mixed = (value[clear] ^ (value[clear] >> np.uint64(15))) * np.uint64(0x2C1B3C6D + 2 * k)
        found.append(((mixed >> np.uint64(12)) & np.uint64(PLACES - 1)).astype(np.int32))
    return np.concatenate(found) if found else np.zeros(0, np.int32)


def pieces(text: str | None) -> Iterator[np.ndarray]:
    """The places of a text, of a long one in pieces that end between words."""
    data, start = normal(text), 0
    while start < len(data) - 1:
        end = data.find(b" ", start + PIECE)
        end = len(data) if end < 0 else end + 1
        yield places(data[start:end])
        start = end - 1


def tally(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The different places of a text and how often each occurs."""
    parts = [np.unique(x, return_counts=True) for x in pieces(text)]
    if len(parts) < 2:
        return parts[0] if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    total = np.zeros(PLACES, np.int64)
    for at, n in parts:
        total[at] += n
    at = np.flatnonzero(total)
    return at, total[at]


def snippet(text: str | None, key: int) -> str:
    """A few neighbouring words from a place that ``key`` draws, so that the fit sees short texts too."""
    words = _WORDS.findall(text or "")
    rng = np.random.default_rng(key & 0xFFFFFFFF)
    n = int(rng.integers(1, SNIPPET + 1))
    start = int(rng.integers(0, max(1, len(words) - n + 1)))
    return " ".join(words[start:start + n])


# --- the model --------------------------------------------------------------------------------------------------------

@dataclass
class Model:
    """``table`` has for each place the scores it adds to each language; scores of a text are the mean over its subwords."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    heat: float = 1.0
    least: float = 0.0

    def margins(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (n / n.sum()) @ self.table[at] + self.bias if len(at) else self.bias

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated score, and whether the score is high enough to be relied on."""
        sums, n = np.zeros(len(self.languages)), 0
        for part in pieces(text) if self.languages else ():
            sums += self.table[part].sum(axis=0)
            n += len(part)
        if not n:
            return UNKNOWN, 0.0, False
        p = softmax((sums / n + self.bias) * self.heat)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] >= self.least)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, languages: list[str], rounds: int = ROUNDS, rate: float = RATE,
          seed: int = 11) -> Model:
    """Embeddings and softmax weights by stochastic gradient descent, one row at a time, with a falling rate.

    Rows of a language count by the inverse of its share, within a factor of four.
    """
    draw = np.random.default_rng(seed)
    k = len(languages)
    embed = draw.uniform(-1, 1, (PLACES, SIZE)) / SIZE
    weights, bias = np.zeros((SIZE, k)), np.zeros(k)
    share = np.bincount(labels, minlength=k) / max(1, len(labels))
    worth = np.clip(1 / np.maximum(share * k, 1e-9), 0.25, 4.0)
    steps, done = rounds * len(rows), 0
    for _ in range(rounds):
        for i in draw.permutation(len(rows)):
            at, n = rows[i]
            part, y = n / n.sum(), labels[i]
            mean = part @ embed[at]
            slope = softmax(mean @ weights + bias)
            slope[y] -= 1.0
            slope *= rate * worth[y] * (1 - done / steps)
            # The mean moves its parts by their shares; scaled by the different places, so that long texts move them too.
            move = weights @ slope
            weights -= np.outer(mean, slope)
            bias -= 0.1 * slope
            embed[at] -= np.outer(part * min(len(at), 50.0), move)
            done += 1
    return Model(languages, embed @ weights, bias)


def calibrate(model: Model, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, precision: float = PRECISION) -> Model:
    """Fit the softmax's heat to rows that were not trained on, and the least score of accepted texts.

    The heat has the least log loss on a grid; the least score is the smallest at which the accepted of these rows are
    right with ``precision`` (with one wrong row more than seen), and 1 if none is.
    """
    if not len(rows):
        return model
    margins = np.stack([model.margins(*r) for r in rows])
    losses = []
    heats = 2.0**np.linspace(-4, 4, 65)
    for heat in heats:
        p = softmax(margins * heat)[np.arange(len(labels)), labels]
        losses.append(-np.log(np.maximum(p, 1e-12)).mean())
    model.heat = float(heats[int(np.argmin(losses))])
    p = softmax(margins * model.heat)
    best, right = p.max(axis=1), p.argmax(axis=1) == labels
    order = np.argsort(-best, kind="stable")
    held = (np.cumsum(~right[order]) + 1) / (np.arange(len(order)) + 1) <= 1 - precision
    held &= np.r_[best[order][1:] < best[order][:-1], True]  # equal scores are accepted together
    good = np.flatnonzero(held)
    model.least = float(best[order][good[-1]]) if len(good) else 1.0
    return model


def _fold():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS


def learn(docs: DataFrame, bound: int = FIT_ROWS) -> Model:
    """The model of the rows of ``docs`` with a lang that are not held out: at most ``bound`` of them, by a hash of doc_id.

    Each language has an equal claim: those with fewer rows than their part give all. Of a row its most frequent ``FIT_PLACES``
    places are kept, besides those of a snippet of a few words. A third of the places of few rows calibrate.
    """
    known = docs.select("doc_id", "lang", "text").where((_fold() != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.rows for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "lang").limit(bound).collect()}
    if not sizes:
        return Model([], np.zeros((PLACES, 0)), np.zeros(0))
    left, claim = bound, {}
    for i, (lang, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        claim[lang] = min(n, left // (len(sizes) - i))
        left -= claim[lang]
    grain = 1 << 30
    limit = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(int(grain * min(1.0, claim[lang] / n))))])
    key = F.xxhash64("doc_id", "text")
    drawn = known.where(F.pmod(key, F.lit(grain)) < F.element_at(limit, F.col("lang"))).select("lang", "text", key.alias("key"))

    def start():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for lang, text, key in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "key"))):
                for part, own in enumerate((text, snippet(text, key))):
                    at, n = tally(own)
                    if len(at) > FIT_PLACES:
                        most = np.sort(np.argsort(-n, kind="stable")[:FIT_PLACES])
                        at, n = at[most], n[most]
                    out.append((lang, key, part, at.astype("<i4").tobytes(), n.astype("<i4").tobytes()))
            columns = list(zip(*out))
            kinds = pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["lang", "key", "part", "at", "n"])

        return work

    # Arrays come as bytes, since lists would be Python numbers in the driver. A share of rows by a hash may be a little above the bound: the limit holds it.
    table = map_batches(drawn, start, "lang string, key long, part int, at binary, n binary", rows=200).limit(2 * bound + 2000).toPandas()
    table = table[table["at"].map(len) > 0].sort_values(["key", "part", "lang"], kind="stable")
    languages = sorted(sizes)
    number = {x: i for i, x in enumerate(languages)}
    rows = [(np.frombuffer(a, "<i4"), np.frombuffer(n, "<i4")) for a, n in zip(table["at"], table["n"])]
    labels = table["lang"].map(number).to_numpy(np.int64)
    apart = (table["key"].to_numpy() // 7) % CALIBRATE == 0
    if not len(rows) or apart.all():
        apart[:] = False
    fitted = train([r for r, x in zip(rows, apart) if not x], labels[~apart], languages)
    return calibrate(fitted, [r for r, x in zip(rows, apart) if x], labels[apart])


def predict(docs: DataFrame, bound: int = FIT_ROWS) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, accepted)`` for every row of ``docs``.

    Rows whose ``crc32(doc_id as text) mod 4`` is 2 are held out; the model learns from text and lang of the others
    (a null doc_id counts as the empty text, which is not held out; a null lang or text teaches nothing). Predictions use the
    whole text alone. ``score`` is the calibrated probability of ``lang_pred``, and ``accepted`` tells whether it is
    high enough for the precision asked for. A text that is null or has no letter, and any text where nothing could be
    learned, has ``und``, 0 and false. Repeated rows are judged alike; further columns are ignored.

    The model (a table of ``PLACES`` by languages) is sent with the tasks; its size does not grow with the documents.
    """
    model = learn(docs, bound)

    def start():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [model.judge(x) for x in batch.column("text").to_pylist()]
            lang, score, accepted = zip(*found)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())],
                                              names=["doc_id", "lang_pred", "score", "accepted"])

        return work

    found = map_batches(docs.select("doc_id", "text"), start, "doc_id long, lang_pred string, score double, accepted boolean")
    return found.select("doc_id", (_fold() == HELD_OUT).alias("held_out"), "lang_pred", "score", "accepted")
