"""Repeated passages: Rabin-Karp hashes of every window of words, counted in Spark, merged into removal intervals."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempolog.llm.common import WordHashes, durable, int64, map_batches, ragged, text_bytes, text_or_empty

WINDOW = 50
# Words of the shorter windows that mark where texts may agree.
ANCHOR = 12
# Odd multipliers of the two rolling hashes, modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


class Roller:
    """Rolling hashes of word windows: sums of word hash times a power of the base, from prefix sums modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n, x, np.uint64)]) for x in (self.base, self.inverse))

    def windows(self, words: np.ndarray, size: int) -> np.ndarray:
        """The hash of each run of ``size`` words, by its first word."""
        n = len(words)
        if n < size:
            return np.zeros(0, np.uint64)
        self._powers(n)
        sums = np.r_[np.uint64(0), np.cumsum(words * self.up[:n])]
        return (sums[size:] - sums[:-size]) * self.down[:n - size + 1]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:len(x) - (width - have)], x[width - have:]) if have < width else x


def marks(words: np.ndarray, roller: Roller, window: int) -> np.ndarray:
    """For each window the least hash of the anchors in it: equal windows have equal marks, wherever they stand."""
    anchor = min(ANCHOR, window)
    return sliding_min(roller.windows(words, anchor), window - anchor + 1)


def removal_intervals(starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals of words covered by windows of the given first words, which ascend."""
    if not len(starts):
        return starts, starts
    new = np.r_[True, starts[1:] > starts[:-1] + window]
    return starts[new], starts[np.r_[new[1:], True]] + window


def profile(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: number of words, hashes of the whole word sequence, its SHA-256, and the different marks of its windows."""

    def start():
        hashes, roller = WordHashes(), Roller(BASES[0])

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, whole, digests, found = [], [], [], []
            for text in text_bytes(batch):
                words = text.split()
                joined = b" ".join(words)
                counts.append(len(words))
                whole.append(xxhash.xxh3_128_digest(joined))
                digests.append(hashlib.sha256(joined).hexdigest())
                short = len(words) < window
                found.append(np.zeros(0, np.int64) if short else np.unique(marks(hashes.of(words), roller, window)).view(np.int64))
            halves = np.frombuffer(b"".join(whole), np.uint64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(counts, pa.int64()), int64(halves[:, 0].copy()),
                 int64(halves[:, 1].copy()), pa.array(digests, pa.string()), ragged(found, np.int64)],
                names=["doc_id", "text_key", "n_words", "whole_a", "whole_b", "sha256", "marks"])

        return work

    return map_batches(_texts(docs), start, "doc_id long, text_key long, n_words long, whole_a long, whole_b long, "
                                            "sha256 string, marks array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    return texts.withColumn("text_key", F.xxhash64("text"))


def _windows(held: DataFrame, window: int, only_later: bool) -> DataFrame:
    """Windows whose mark is shared: (a, b) is the hash, then the row and the first word.

    ``only_later`` leaves those whose mark also occurs in a smaller document.
    """

    def start():
        hashes, first, second = WordHashes(), Roller(BASES[0]), Roller(BASES[1])

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, keys = (batch.column(c).to_numpy() for c in ("doc_id", "text_key"))
            later, early = (batch.column(c).to_pylist() for c in ("later", "early"))
            out = []
            for i, text in enumerate(text_bytes(batch)):
                words = text.split()
                if len(words) < window:
                    continue
                values = hashes.of(words)
                wanted = np.array(later[i] if only_later else later[i] + early[i], np.int64).view(np.uint64)
                at = np.flatnonzero(np.isin(marks(values, first, window), wanted))
                a = first.windows(values, window)[at]
                b = second.windows(values ^ (values >> np.uint64(29)), window)[at] >> np.uint64(33)
                out.append((a.view(np.int64), b.astype(np.int32), np.full(len(at), ids[i]), np.full(len(at), keys[i]), at.astype(np.int32)))
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, t) for t in "qiqqi"]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "doc_id", "text_key", "place"])

        return work

    return map_batches(held, start, "a long, b int, doc_id long, text_key long, place int")


def _apply(rows: DataFrame, window: int) -> DataFrame:
    def start():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            removed, digests, texts, begins, ends = [], [], [], [], []
            for text, places in zip(text_bytes(batch), batch.column("places").to_pylist()):
                words = text.split()
                begin, end = removal_intervals(np.unique(np.array(places, np.int64)), window)
                kept = words[:begin[0]]
                for a, b in zip(end, [*begin[1:], len(words)]):
                    kept += words[a:b]
                joined = b" ".join(kept)
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(joined).hexdigest())
                texts.append(joined.decode())
                begins.append(begin)
                ends.append(end)
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(removed, pa.int64()), pa.array(digests, pa.string()),
                 pa.array(texts, pa.string()), ragged(begins, np.int32), ragged(ends, np.int32)],
                names=["doc_id", "text_key", "n_cut", "cut_sha256", "cut_text", "begins", "ends"])

        return work

    return map_batches(rows, start, "doc_id long, text_key long, n_cut long, cut_sha256 string, cut_text string, "
                                    "begins array<int>, ends array<int>")


def repeated_passages(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """What to remove from ``docs``: a table per row, and a table of the rows that lose only some of their words.

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller doc_id.

    1. Documents with the same word sequence as a smaller document are whole copies: all their windows recur there,
       and for other documents the smaller one stands for them.
    2. Of the others, each window is marked by the least hash of its anchors (12 words). A repeated window has the
       same mark in both places, so windows whose mark is in one document only need not be counted; a document's
       different marks are about a twentieth of its words.
    3. The windows of shared marks are counted by two Rabin-Karp hashes (64 and 31 bits): the least doc_id of each.
       Those whose mark has a smaller document are then looked up there.
    4. Places found are merged into maximal intervals, per document.

    Counts are aggregated before they are shuffled and look-ups are plain joins, so a passage in a third of all
    documents is not gathered anywhere. Rows without doc_id neither lose words nor make others lose any. Rows that
    repeat a doc_id are judged by their own text and do not count as smaller than each other.
    """
    profiles = durable(profile(docs, window))
    able = profiles.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    firsts = able.groupBy("whole_a", "whole_b").agg(
        F.min("doc_id").alias("first"), F.min_by("marks", "doc_id").alias("marks"))
    marked = firsts.select(F.col("first").alias("doc_id"), F.explode("marks").alias("mark"))
    shared = marked.groupBy("mark").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    shared = durable(shared.select("mark", "first"))
    wanted = marked.join(shared, "mark").groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("first") < F.col("doc_id"), F.col("mark"))).alias("later"),
        F.collect_list(F.when(F.col("first") == F.col("doc_id"), F.col("mark"))).alias("early"))
    held = durable(_texts(docs).join(wanted, "doc_id").dropDuplicates(["doc_id", "text_key"]))
    counted = _windows(held, window, False).groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    # Stored, so that the joins read both sides from exchanges, whose large partitions Spark can split.
    recur = durable(counted.where("first < last").select("a", "b", "first"))
    places = _windows(held, window, True).join(recur, ["a", "b"]).where("first < doc_id")
    places = places.groupBy("doc_id", "text_key").agg(F.collect_list("place").alias("places"))
    cuts = durable(_apply(held.select("doc_id", "text_key", "text").join(places, ["doc_id", "text_key"]), window))
    owners = firsts.select("whole_a", "whole_b", "first")
    rows = profiles.drop("marks").join(owners, ["whole_a", "whole_b"], "left")
    copy = F.coalesce((F.col("n_words") >= window) & (F.col("first") < F.col("doc_id")), F.lit(False))
    return rows.select("doc_id", "text_key", "n_words", "sha256", copy.alias("whole_copy")), cuts


def removal_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` for every row of ``docs``; see ``repeated_passages``.

    A null text has no words. Further columns are ignored.
    """
    rows, cuts = repeated_passages(docs, window)
    joined = rows.join(cuts.select("doc_id", "text_key", "n_cut", "cut_sha256"), ["doc_id", "text_key"], "left")
    removed = F.when(F.col("whole_copy"), F.col("n_words")).otherwise(F.coalesce("n_cut", F.lit(0)))
    kept = F.when(F.col("whole_copy"), F.lit(EMPTY_SHA256)).otherwise(F.coalesce("cut_sha256", "sha256"))
    return joined.select("doc_id", "n_words", removed.alias("n_removed"), kept.alias("kept_sha256"))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages removed from their texts, in the same columns.

    A text that loses words becomes its kept words, joined by one space; others stay as they are. Documents that lose
    every word are left out. ``n_chars``, where there is such a column, is counted anew.
    """
    rows, cuts = repeated_passages(docs, window)
    keyed = docs.withColumn("text_key", F.xxhash64(text_or_empty()))
    copies = rows.where("whole_copy").select("doc_id", "text_key").distinct()
    left = keyed.join(copies, ["doc_id", "text_key"], "left_anti")
    joined = left.join(cuts.select("doc_id", "text_key", "cut_text"), ["doc_id", "text_key"], "left")
    joined = joined.where("cut_text is null or cut_text <> ''").withColumn("text", F.coalesce("cut_text", "text"))
    if "n_chars" in docs.columns:
        counted = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        joined = joined.withColumn("n_chars", F.when(F.col("cut_text").isNull(), F.col("n_chars")).otherwise(counted))
    return joined.select(*docs.columns)
