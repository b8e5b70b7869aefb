"""Packing of documents into fixed windows of tokens, in order, by dynamic programming over their boundaries."""

from __future__ import annotations

import struct
import zlib
from collections import deque
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempolog.llm.common import Cache, durable, map_batches, map_partitions, ragged, text_or_empty
from tempolog.llm.token_count import Splitter

SEQUENCE = 4096
END_ID = 2
# Costs in tokens of padding: of a sequence, of a cut at a sentence's end, of a cut inside a sentence.
SEQUENCE_COST, SENTENCE_CUT, HARD_CUT = 1024, 4, 24
# Sentences longer than the first have further boundaries inside, so many tokens apart.
LONG_SENTENCE, HARD_STEP = 256, 64
# Tokens that are planned at once, and tokens for each task.
BLOCK_TOKENS = 1 << 18
TASK_TOKENS = 1 << 22
MOST_TASKS = 100_000
# Chunks of text whose ids a Python worker keeps.
CHUNKS = 600_000
# Characters of texts whose chunks are told apart at once; a longer text is taken by itself.
GROUP_CHARS = 1 << 22
_MARKS = ".,;:!?"
_SENTENCE_ENDS = ".!?…。！？"
_CRC = 0xEDB88320


class Encoder(Splitter):
    """Token ids of one tokenizer file as little-endian 32-bit numbers, with the boundaries of sentences.

    Plain texts are cut at white space, which no piece of the tokenizer spans, and the library's model encodes the
    pieces of each different chunk that is not in the cache; other texts go through the whole tokenizer.
    """

    def __init__(self, path: str, entries: int):
        super().__init__(path)
        self.model = self.tokenizer.model
        self.pieces = Cache(self._piece, entries // 3)
        self.chunks = Cache(self._ids, entries)
        self.chunks[""] = b""

    def _ids(self, chunk: str) -> bytes:
        # Letters alone, or with one mark behind them, are split as the pattern would.
        if chunk.isalpha():
            return self.pieces[chunk]
        last = chunk[-1]
        if last in _MARKS and chunk[:-1].isalpha():
            return self.pieces[chunk[:-1]] + self.pieces[last]
        return b"".join(map(self.pieces.__getitem__, self.split(chunk)))

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join(map(self.alphabet.__getitem__, piece.encode()))
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per text the ids, and the numbers of tokens before the ends of sentences. Texts are taken some million characters at a time."""
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= GROUP_CHARS:
                size += len(texts[end])
                end += 1
            group = texts[at:end]
            plain = [self.plain(x) for x in group]
            quick = self._plain_texts([x for x, p in zip(group, plain) if p])
            yield from (next(quick) if p else self._any_text(x) for x, p in zip(group, plain))
            at = end

    def _plain_texts(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each different chunk is encoded once; the ids of the texts are gathered from those of the chunks."""
        # The splitter may leave empty chunks, or white space alone, at the ends of a text; neither has ids.
        words = pc.utf8_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string())))
        coded = words.values.dictionary_encode()
        codes, different = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        parts = list(map(self.chunks.__getitem__, different))
        flat = np.frombuffer(b"".join(parts), "<u4")
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        closes = np.fromiter((x != "" and x[-1] in _SENTENCE_ENDS for x in different), bool, len(different))
        counts = sizes[codes]
        after = np.cumsum(counts)
        begins = (np.cumsum(sizes) - sizes)[codes] - (after - counts)
        ids = flat[np.repeat(begins, counts) + np.arange(after[-1] if len(after) else 0)]
        closing = np.flatnonzero(closes[codes])
        rows = words.offsets.to_numpy()
        tokens = np.r_[0, after][rows]
        places = np.searchsorted(closing, rows)
        for i in range(len(texts)):
            yield ids[tokens[i]:tokens[i + 1]], after[closing[places[i]:places[i + 1]]] - tokens[i]

    def _any_text(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode(text, add_special_tokens=False)
        at = [i + 1 for i, (_, b) in enumerate(found.offsets) if b and text[b - 1] in _SENTENCE_ENDS]
        return np.array(found.ids, "<u4"), np.array(at, np.int64)


@cache
def encoder(path: str, entries: int) -> Encoder:
    """One encoder per Python worker, so that its cache outlives a task."""
    return Encoder(path, entries)


def boundaries(sentence_ends: np.ndarray, tokens: int, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Where a document of ``tokens`` tokens may be cut, ending with its own end, and which cuts are inside a sentence."""
    ends = np.append(sentence_ends, tokens)
    steps = np.diff(ends, prepend=0)
    ends, steps = ends[steps > 0], steps[steps > 0]
    long, step = min(LONG_SENTENCE, size), min(HARD_STEP, size)
    inner = [np.arange(ends[i] - steps[i] + step, ends[i], step) for i in np.flatnonzero(steps > long)]
    if not inner:
        return ends, np.zeros(len(ends), bool)
    hard = np.concatenate(inner)
    both = np.union1d(ends, hard)
    return both, ~np.isin(both, ends)


def outline(docs: DataFrame, path: str, end_id: int = END_ID, size: int = SEQUENCE, entries: int = CHUNKS) -> DataFrame:
    """Per document: number of tokens with the closing ``end_id``, places to cut, and the CRC-32 of the ids before each."""

    def start():
        encode = encoder(path, entries)
        closing = np.array([end_id], "<u4").tobytes()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            cuts, hards, sums = [], [], []
            for ids, ends in encode(batch.column("text").to_pylist()):
                ids = memoryview(ids.tobytes() + closing)
                cut, hard = boundaries(ends, len(ids) // 4, size)
                stops = [0, *(4 * cut).tolist()]
                crc = accumulate((ids[a:b] for a, b in zip(stops, stops[1:])), lambda c, x: zlib.crc32(x, c), initial=0)
                cuts.append(cut)
                hards.append(hard)
                sums.append(np.fromiter(crc, np.int64, len(stops))[1:])
            tokens = pa.array([int(c[-1]) for c in cuts], pa.int64())
            hard_list = pa.ListArray.from_arrays(ragged(cuts, np.int32).offsets, pa.array(np.concatenate(hards)) if hards else pa.array([], pa.bool_()))
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tie"), tokens, ragged(cuts, np.int32), hard_list, ragged(sums, np.int64)],
                names=["doc_id", "tie", "tokens", "cuts", "hard", "crcs"])

        return work

    texts = docs.select("doc_id", text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))
    return map_batches(texts, start, "doc_id long, tie long, tokens long, cuts array<int>, hard array<boolean>, crcs array<long>")


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo the CRC-32 polynomial, lowest power in the highest bit."""
    a, b = a.astype(np.uint32), b.astype(np.uint32).copy()
    out = np.zeros(np.broadcast(a, b).shape, np.uint32)
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), b >> np.uint32(1) ^ np.uint32(_CRC), b >> np.uint32(1))
    return out


@cache
def _shifts(most: int) -> np.ndarray:
    """x**(32 n) for n from 0 to ``most``: what appending n ids does to a CRC-32."""
    table = np.array([1 << 31], np.uint32)
    step = np.array([1], np.uint32)  # x**31
    step = _times(step, np.array([1 << 30], np.uint32))  # times x
    while len(table) <= most:
        table = np.r_[table, _times(table, step)]
        step = _times(step, step)
    return table[:most + 1]


def crc_between(before: np.ndarray, after: np.ndarray, ids: np.ndarray, most: int = SEQUENCE) -> np.ndarray:
    """CRC-32 of the last ``ids`` ids, from the CRC-32 of all ids before them and with them."""
    return after.astype(np.uint32) ^ _times(before, _shifts(most)[ids])


def plan(places: list[int], costs: list[int], size: int = SEQUENCE) -> list[int]:
    """The cuts of least total cost, as indices into ``places``; the first and the last place are always cut.

    ``places`` are ascending token positions no more than ``size`` apart, ``costs`` what a cut there costs. A sequence
    costs ``SEQUENCE_COST`` and its padding up to ``size``, of which one whose length is a power of two has none. The
    least cost up to a place is the minimum, over earlier places in reach, of their least cost plus position, which a
    monotone queue keeps; places a power of two back are looked up.
    """
    n = len(places)
    best, back = [0.0] * n, [0] * n
    exact = _power_of_two_back(np.array(places), size)
    queue = deque([0])
    keys = [places[0]] + [0] * (n - 1)
    for j in range(1, n):
        p = places[j]
        low = p - size
        while places[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        least = keys[i] + size - p
        if j in exact:
            for h in exact[j]:
                if best[h] < least:
                    least, i = best[h], h
        best[j], back[j] = least + SEQUENCE_COST + costs[j], i
        key = keys[j] = best[j] + p
        while queue and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def _power_of_two_back(places: np.ndarray, size: int) -> dict[int, list[int]]:
    """For each place, the places a power of two before it, where there are any."""
    found: dict[int, list[int]] = {}
    for k in range(size.bit_length() if size & (size - 1) == 0 else (size - 1).bit_length()):
        at = np.searchsorted(places, places - (1 << k))
        for j in np.flatnonzero(places[np.minimum(at, len(places) - 1)] == places - (1 << k)).tolist():
            found.setdefault(j, []).append(int(at[j]))
    return found


class _Packer:
    """Plans a stream of documents block by block; keeps the boundaries behind the last cut that is settled."""

    NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def __init__(self, size: int, first_sequence: int):
        self.size, self.sequence = size, first_sequence
        # Of each boundary: position, document, place in it, CRC before it, cost of a cut; the first is the last settled cut.
        self.rows = [np.zeros(1, np.int64) for _ in range(5)]
        self.docs: list[tuple] = []  # id and tokens of documents at hand
        self.pending: list[tuple] = []
        self.tokens = 0

    def add(self, doc_id, tokens: int, cuts: np.ndarray, hard: np.ndarray, crcs: np.ndarray) -> None:
        self.pending.append((doc_id, tokens, cuts, hard, crcs))
        self.tokens += tokens

    def settle(self, last: bool) -> pa.RecordBatch | None:
        base, position = len(self.docs), int(self.rows[0][-1])
        new = [self.rows]
        for i, (doc_id, tokens, cuts, hard, crcs) in enumerate(self.pending):
            self.docs.append((doc_id, tokens))
            cost = np.where(hard, HARD_CUT, SENTENCE_CUT)
            cost[-1] = 0
            new.append([position + cuts, np.full(len(cuts), base + i), cuts, crcs, cost])
            position += tokens
        at, doc, place, crc, cost = self.rows = [np.concatenate(c) for c in zip(*new)]
        self.pending, self.tokens = [], 0
        if len(at) < 2:
            return None
        cuts = plan(at.tolist(), cost.tolist(), self.size)
        if not last:
            cuts = cuts[:-2] if len(cuts) > 3 else cuts[:1]
        if len(cuts) < 2:
            return None
        return self._pieces(np.array(cuts))

    def _pieces(self, cuts: np.ndarray) -> pa.RecordBatch:
        at, doc, place, crc, cost = self.rows
        tokens = np.array([t for _, t in self.docs], np.int64)
        settled = np.arange(1, cuts[-1] + 1)
        stops = settled[np.isin(settled, cuts) | (place[settled] == tokens[doc[settled]])]
        before = np.r_[0, stops[:-1]]
        inside = (doc[before] == doc[stops]) & (place[before] < place[stops])
        begin = np.where(inside, place[before], 0)
        crc_before = np.where(inside, crc[before], 0)
        length = place[stops] - begin
        group = np.searchsorted(cuts, stops) - 1
        own = doc[stops]
        out = pa.RecordBatch.from_arrays([
            pa.array([self.docs[d][0] for d in own], pa.int64()), pa.array(begin), pa.array(length),
            pa.array(crc_between(crc_before, crc[stops], length, self.size).astype(np.int64)), pa.array(tokens[own]),
            pa.array(self.sequence + group), pa.array(at[before] - at[cuts[group]])], names=self.NAMES)
        self.sequence += len(cuts) - 1
        rest = slice(cuts[-1], None)
        self.rows = [x[rest] for x in self.rows]
        lowest = int(self.rows[1][0])
        self.docs = self.docs[lowest:]
        self.rows[1] = self.rows[1] - lowest
        self.rows[0] = self.rows[0] - self.rows[0][0]
        return out


def pack(docs: DataFrame, path: str, size: int = SEQUENCE, end_id: int = END_ID, entries: int = CHUNKS) -> DataFrame:
    """All documents in sequences of at most ``size`` tokens, as pieces in the order of doc_id.

    ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``: a piece is ``length`` ids of its document
    from ``start`` on, at ``offset`` of its sequence; ``doc_tokens`` counts the closing id. Every id is in one piece.
    Cuts are at the ends of documents or sentences, and every 64 tokens in sentences of over 256. The plan is of least
    cost within blocks of ``BLOCK_TOKENS`` tokens; the last sequences of a block are planned again with the next.

    Each task plans a range of doc_id (rows without one come first; equal ones by a hash of the text) of about four
    million tokens, and only its last sequence is cut short by the range. sequence_ids ascend in the order of documents, with
    gaps between tasks. Texts are encoded once: token counts, cuts and checksums at the cuts are written to the shared
    folder, and the ids themselves are never moved. A null text is empty and has the closing id alone. Repeated rows
    are packed as often as they occur; further columns are ignored. ``entries`` bounds the cache of a Python worker (about
    200 bytes each), not the result.
    """
    stored = durable(outline(docs, path, end_id, size, entries))
    total = stored.agg(F.sum("tokens")).first()[0] or 0
    tasks = max(1, min(MOST_TASKS, total // TASK_TOKENS))
    ordered = stored.repartitionByRange(int(tasks), F.asc_nulls_first("doc_id"), "tie")
    ordered = ordered.sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(size, TaskContext.get().partitionId() << 40)
        for batch in batches:
            lists = [batch.column(c) for c in ("cuts", "hard", "crcs")]
            flat = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]
            ends = lists[0].offsets.to_numpy() - lists[0].offsets[0].as_py()
            ids, tokens = batch.column("doc_id").to_pylist(), batch.column("tokens").to_pylist()
            for i in range(batch.num_rows):
                packer.add(ids[i], tokens[i], *(x[ends[i]:ends[i + 1]] for x in flat))
                if packer.tokens >= BLOCK_TOKENS and (out := packer.settle(False)) is not None:
                    yield out
        out = packer.settle(True)
        if out is not None:
            yield out

    return map_partitions(ordered.select("doc_id", "tokens", "cuts", "hard", "crcs"), run,
                          "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
