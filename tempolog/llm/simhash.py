"""Near-duplicate documents by SimHash fingerprints and pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempolog.llm.common import durable, int64, map_batches, map_partitions, text_bytes, text_or_empty
from tempolog.llm.components import connected_components

BITS = 64
# Seed of the shingle hash; Spark's own xxhash64 uses the same.
SEED = 42
# Blocks are made finer until a fingerprint meets at most so many others by chance.
CHANCE_PARTNERS = 4
# Larger blocks are split again by the bits that are still free, while these are more than 12; 12 bits tell at most
# 4096 different fingerprints apart.
BLOCK_ROWS = 4096
SMALL_BITS = 12
_PIECE = 1 << 16


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """64-bit SimHash of a text: A-Z in lower case, words between ASCII white space, shingles with repeats.

    A bit is 1 if it is set in over half of the shingles' XXH64. Fewer words than a shingle form one shingle; a text
    without words has fingerprint zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    n = max(1, len(words) - shingle + 1)
    ends = starts[shingle:] if len(words) >= shingle else starts[-1:]
    hashes = np.fromiter((digest(joined[a:b - 1], SEED) for a, b in zip(starts, ends)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, _PIECE):
        part = hashes[at:at + _PIECE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``(doc_id, fp)`` for every row of ``docs``; a null text counts as empty."""

    def start():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            marks = [fingerprint(x, shingle) for x in text_bytes(batch)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), int64(marks)], names=["doc_id", "fp"])

        return work

    return map_batches(docs.select("doc_id", text_or_empty().alias("text")), start, "doc_id long, fp long")


def blocks_for(rows: int, distance: int) -> int:
    """How many blocks to split a fingerprint into, by the number of different fingerprints.

    Two fingerprints within ``distance`` bits agree on at least all but ``distance`` of any blocks, so every choice
    finds the same links; finer blocks mean longer keys and fewer chance partners, for more rows.
    """
    for n in range(distance + 1, 17):
        bits = BITS * (n - distance) // n
        if comb(n, distance) * rows <= CHANCE_PARTNERS << bits:
            return n
    return 16


def _split(mask: int, n: int) -> list[int]:
    """The set bits of a mask in ``n`` blocks of about equal size."""
    bits = [b for b in range(BITS) if mask >> b & 1]
    return [sum(1 << b for b in bits[i * len(bits) // n:(i + 1) * len(bits) // n]) for i in range(n)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keyed(rows: DataFrame, blocks: int, distance: int) -> DataFrame:
    """One row for each choice of blocks that a partner within the distance could agree on.

    ``rows`` has ``key`` (of the block so far), ``mask`` (bits not fixed by it) and ``fp``; so has the result.
    """

    def start():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            key, mask, fp = (batch.column(c).to_numpy().view(np.uint64) for c in ("key", "mask", "fp"))
            out = []
            for free in np.unique(mask):
                here = mask == free
                parts = _split(int(free), blocks)
                for i, loose in enumerate(combinations(parts, distance)):
                    left = np.uint64(sum(loose))
                    fixed = _mix(fp[here] & (free & ~left) ^ _mix(key[here] + np.uint64(i + 1)))
                    out.append((fixed, np.full(len(fixed), left), fp[here]))
            return pa.RecordBatch.from_arrays([int64(np.concatenate(c)) for c in zip(*out)], names=["key", "mask", "fp"])

        return work

    return map_batches(rows, start, "key long, mask long, fp long", rows=1 << 16)


def _roots(group: np.ndarray, fp: np.ndarray, distance: int) -> np.ndarray:
    """For each row the first row that it is linked to inside its group; ``group`` is ascending."""
    n = len(fp)
    root = np.arange(n)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, n])
    # Small groups: all pairs of the batch at once.
    place = np.arange(n) - np.repeat(first, size)
    before = np.where(np.repeat(size, size) <= 64, place, 0)
    right = np.repeat(np.arange(n), before)
    left = right - 1 - (np.arange(len(right)) - np.repeat(np.cumsum(before) - before, before))
    close = np.bitwise_count(fp[left] ^ fp[right]) <= distance
    left, right = left[close], right[close]
    while len(left):
        low = np.minimum(root[left], root[right])
        if (root[left] == low).all() and (root[right] == low).all():
            break
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        root = root[root]
    # Larger groups: breadth first, a slice of the front against what is not reached yet.
    for at, count in zip(first[size > 64], size[size > 64]):
        rest = np.arange(at, at + count)
        while len(rest):
            seed, rest = rest[0], rest[1:]
            front = np.array([seed])
            while len(front) and len(rest):
                now, front = front[:256], front[256:]
                near = (np.bitwise_count(fp[rest][:, None] ^ fp[now][None, :]) <= distance).any(axis=1)
                root[rest[near]] = seed
                front = np.r_[front, rest[near]]
                rest = rest[~near]
    return root


def _linked(keyed: DataFrame, distance: int) -> DataFrame:
    """Links inside each block, as ``(a, b, mask)`` with a null mask, and the rows of blocks that are too large.

    Rows arrive sorted by key, so a task holds one batch and one block of at most ``BLOCK_ROWS`` rows (4096 where few bits are free). A block's links
    are reduced to one per row; rows of a larger block come out as (key, fp, mask) to be split further.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.uint64)] * 3
        too_large = None

        def out(a, b, mask=None):
            masks = pa.nulls(len(a), pa.int64()) if mask is None else int64(mask)
            return pa.RecordBatch.from_arrays([int64(a), int64(b), masks], names=["a", "b", "mask"])

        def links(key, mask, fp):
            root = _roots(key, fp, distance)
            other = np.flatnonzero(root != np.arange(len(fp)))
            return out(fp[root[other]], fp[other])

        for batch in batches:
            new = [batch.column(c).to_numpy().view(np.uint64) for c in ("key", "mask", "fp")]
            key, mask, fp = (np.r_[x, y] for x, y in zip(held, new))
            if not len(key):
                continue
            last = np.searchsorted(key.view(np.int64), key.view(np.int64)[-1])
            if too_large is not None:
                over = np.searchsorted(key.view(np.int64), too_large, side="right")
                yield out(key[:over], fp[:over], mask[:over])
                key, mask, fp = key[over:], mask[over:], fp[over:]
                last = max(0, last - over)
                too_large = too_large if not len(key) else None
            done = slice(0, last)
            first = np.flatnonzero(np.r_[True, key[done][1:] != key[done][:-1]]) if last else np.zeros(0, int)
            size = np.repeat(np.diff(np.r_[first, last]), np.diff(np.r_[first, last]))
            over_size = (size > BLOCK_ROWS) & (np.bitwise_count(mask[done]) > SMALL_BITS)
            large, small = np.flatnonzero(over_size), np.flatnonzero((size > 1) & ~over_size)
            if len(large):
                yield out(key[large], fp[large], mask[large])
            if len(small):
                yield links(key[small], mask[small], fp[small])
            held = [key[last:], mask[last:], fp[last:]]
            if len(held[0]) > BLOCK_ROWS and int(held[1][0]).bit_count() > SMALL_BITS:
                yield out(held[0], held[2], held[1])
                too_large = held[0].view(np.int64)[0]
                held = [x[:0] for x in held]
        if len(held[0]) > 1:
            yield links(*held)

    together = keyed.repartition("key").sortWithinPartitions("key")
    return map_partitions(together, run, "a long, b long, mask long")


def hamming_links(marks: DataFrame, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs of ``marks.fp`` within ``distance`` bits.

    ``marks`` must have different fingerprints. Pigeonhole: of ``blocks`` blocks, a pair agrees on all but
    ``distance``, so it shares the key of one of the choices. A block of more than ``BLOCK_ROWS`` fingerprints is split
    again over the bits its key leaves free; each level halves them, down to 12 bits or less.
    """
    if blocks is None:
        blocks = blocks_for(marks.count(), distance)
    rows = marks.select(F.lit(0).cast("long").alias("key"), F.lit(-1).cast("long").alias("mask"), "fp")
    found = None
    while True:
        step = durable(_linked(_keyed(rows, blocks, distance), distance))
        links = step.where("mask is null").select("a", "b")
        found = links if found is None else found.union(links)
        rows = step.where("mask is not null").select(F.col("a").alias("key"), "mask", F.col("b").alias("fp"))
        if rows.isEmpty():
            return found.distinct()
        blocks = 2 * distance


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, blocks: int | None = None) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    Fingerprints link at ``distance`` or fewer differing bits; ``component_id`` is the smallest doc_id reachable,
    itself included. Texts are compared by whole content: a null text is empty, a text without words has fingerprint
    zero and is linked like any other. Rows with a null doc_id keep their fingerprint and do not name a component
    (which is null if nothing else is in it). Repeated rows stay repeated; further columns are ignored.
    """
    marked = durable(fingerprints(docs, shingle))
    different = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    links = hamming_links(different.select("fp"), distance, blocks)
    member = connected_components(links).withColumnsRenamed({"node": "fp"})
    placed = different.join(member, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = durable(placed.join(least, "root").select("fp", "component_id"))
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, distance: int = 4, shingle: int = 4) -> DataFrame:
    """The documents that name their component: one row of each group of near copies.

    Of rows that repeat the doc_id of a component, one is kept; rows without doc_id are kept.
    """
    placed = near_duplicates(docs.where("doc_id is not null"), distance, shingle)
    keep = placed.where("doc_id = component_id").select("doc_id").distinct()
    columns = docs.columns
    named = docs.where("doc_id is not null").join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.union(docs.where("doc_id is null")).select(*columns)
