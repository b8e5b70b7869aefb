"""Token counts by byte-pair merging with a heap of adjacent pairs and a linked list of symbols."""

from __future__ import annotations

import json
import re
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempolog.llm.common import CACHE_ENTRIES, Cache, map_batches, text_or_empty

# Texts of these characters only are their own NFC form, lower-case one by one, and have no other white space than
# \t-\r and space, so they can be cut at white space before anything else. Other texts take the tokenizer's own
# normaliser and splitter.
PLAIN = re.compile("[\t-\r -~¡-įıĲ-ſ]*")


class Merges:
    """The merge table of a byte-pair vocabulary over numbered symbols."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.number: dict[str, int] = {}
        number = self.symbol
        self.rank = {number(a) << 32 | number(b): i for i, (a, b) in enumerate(pairs)}
        self.result = [number(a + b) for a, b in pairs]

    def symbol(self, text: str) -> int:
        return self.number.setdefault(text, len(self.number))

    def left(self, symbols: list[int]) -> int:
        """How many symbols are left when the lowest-ranked adjacent pair (leftmost of equals) is merged until none is known.

        Symbols form a linked list; a heap holds the known adjacent pairs, as rank and place in one number. An entry
        whose symbols have changed since it was pushed is skipped. The count is the initial number of symbols minus
        the merges.
        """
        n = len(symbols)
        get, result = self.rank.get, self.result
        heap = []
        for i in range(n - 1):
            rank = get(symbols[i] << 32 | symbols[i + 1])
            if rank is not None:
                heap.append(rank << 32 | i)
        if not heap:
            return n
        heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        left = n
        while heap:
            entry = heappop(heap)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            if j >= n or symbols[i] < 0 or get(symbols[i] << 32 | symbols[j]) != rank:
                continue
            merged = symbols[i] = result[rank]
            symbols[j] = -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = get(merged << 32 | symbols[k])
                if rank is not None:
                    heappush(heap, rank << 32 | i)
            h = before[i]
            if h >= 0:
                rank = get(symbols[h] << 32 | merged)
                if rank is not None:
                    heappush(heap, rank << 32 | h)
        return left


class Splitter:
    """What a tokenizer file says about splitting: its pattern, its byte alphabet and its special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            self.spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.split = regex.compile(self.spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        special = [t["content"] for t in self.spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.alphabet = {i: chr(i) for i in range(33, 127)}
        for c in map(chr, range(0xA1, 0x180)):
            shown = self.tokenizer.pre_tokenizer.pre_tokenize_str(c)
            self.alphabet.update(zip(c.encode(), "".join(x for x, _ in shown)))

    def plain(self, text: str) -> bool:
        """Whether the text may be cut at white space and its pieces taken by ``split``."""
        return PLAIN.fullmatch(text) is not None and (self.special is None or not self.special.search(text))


class TokenCounter(Splitter):
    """Counts of one tokenizer file.

    Pieces are merged here; only the normaliser and the splitter of texts outside ``PLAIN`` are the library's.
    """

    def __init__(self, path: str):
        super().__init__(path)
        model = self.spec["model"]
        self.merges = Merges([tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        self.end = model["end_of_word_suffix"] or ""
        symbol = self.merges.symbol
        self.inner = {b: symbol(c) for b, c in self.alphabet.items()}
        self.last = {b: symbol(c + self.end) for b, c in self.alphabet.items()}
        self.pieces = Cache(self._piece, CACHE_ENTRIES // 2)
        self.chunks = Cache(self._chunk, 2 * CACHE_ENTRIES)

    def _piece(self, piece: str) -> int:
        """Tokens of a piece of plain text."""
        encoded = piece.encode()
        symbols = list(map(self.inner.__getitem__, encoded))
        symbols[-1] = self.last[encoded[-1]]
        return self.merges.left(symbols)

    def _chunk(self, chunk: str) -> int:
        """Tokens of a plain text without white space."""
        return sum(map(self.pieces.__getitem__, self.split(chunk)))

    def _shown(self, piece: str) -> int:
        """Tokens of a piece in the byte alphabet."""
        symbol = self.merges.symbol
        return self.merges.left([*map(symbol, piece[:-1]), symbol(piece[-1] + self.end)])

    def _part(self, text: str) -> int:
        if PLAIN.fullmatch(text):
            return sum(map(self.chunks.__getitem__, text.lower().split()))
        shown = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
        return sum(self._shown(p) for p, _ in shown)

    def __call__(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self._part(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._part, parts))


@cache
def token_counter(path: str) -> TokenCounter:
    """One counter per Python worker, so that its caches outlive a task."""
    return TokenCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row of ``docs``.

    ``path`` is a byte-level BPE file of the tokenizers library with an end-of-word suffix, present on every
    executor. A null text is empty and has no tokens. Special strings inside texts count as one token. Repeated rows
    stay repeated; further columns are ignored. No row is moved.
    """

    def start():
        count = token_counter(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column("text").to_pylist()
            counts = pa.array(map(count, texts), pa.int64())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), counts],
                                              names=["doc_id", "n_bytes", "n_tokens"])

        return work

    texts = docs.select("doc_id", text_or_empty().alias("text"))
    texts = texts.withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = map_batches(texts, start, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
