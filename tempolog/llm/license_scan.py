"""License notices in texts, by an exact set-similarity join of text blocks with notice templates."""

from __future__ import annotations

from collections import Counter
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame

from tempolog.llm.common import map_batches, map_partitions, text_bytes, text_or_empty

# Phrases whose words must stand consecutively anywhere in a text, with their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Wordings of notices, of which a line must hold the given share of different words, with their labels.
TEMPLATES = {
    "Licensed under the Apache License, Version 2.0": "apache-2",
    "Released under the MIT License": "mit",
    "Licensed under CC BY-NC 4.0": "cc-by-nc-4",
    "This work is licensed under the GNU General Public License, version 3": "gpl-3",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit-text",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd-text",
    "This Source Code Form is subject to the terms of the Mozilla Public License": "mpl",
}
CONTAINMENT = 0.8
# Words are runs of digits, letters a-z (A-Z in lower case) and characters beyond ASCII.
_WORD_BYTES = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Templates:
    """The right side of the join: token sets in the global order, rarest first, with their prefixes.

    A phrase must be contained whole. For a template of n tokens and threshold t, ``need = ceil(t n)`` tokens must be
    shared, so that one of its ``n - need + 1`` rarest tokens is.
    """

    def __init__(self, frequency: dict[bytes, int], templates: dict[str, str], phrases: dict[str, str], threshold: float):
        self.phrases = [(words_of(p.encode()), label) for p, label in phrases.items()]
        self.sets, self.labels, self.need = [], [], []
        for text, label, share in [(p, x, 1.0) for p, x in phrases.items()] + [(t, x, threshold) for t, x in templates.items()]:
            tokens = sorted(set(words_of(text.encode())), key=lambda w: (frequency.get(w, 0), w))
            if tokens:
                self.sets.append(tokens)
                self.labels.append(label)
                self.need.append(max(1, ceil(share * len(tokens) - 1e-9)))
        known = sorted({w for s in self.sets for w in s}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(known)}
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for i, tokens in enumerate(self.sets):
            for place, w in enumerate(tokens[:len(tokens) - self.need[i] + 1]):
                self.prefix.setdefault(w, []).append((i, place))

    def candidates(self, block: set[bytes]) -> dict[int, int]:
        """Templates that the filters leave for a block, with the number of shared tokens where it reaches the threshold.

        Tokens that no template has are left out of the block beforehand: they can never be shared.
        """
        tokens = sorted(block & self.rank.keys(), key=self.rank.__getitem__)
        found: dict[int, int] = {}
        for at, w in enumerate(tokens):
            for i, place in self.prefix.get(w, ()):
                need, own = self.need[i], self.sets[i]
                if i in found or len(tokens) < need:  # length
                    continue
                if at > len(tokens) - need:  # prefix of the block
                    continue
                if 1 + min(len(own) - place - 1, len(tokens) - at - 1) < need:  # position
                    continue
                shared = sum(x in block for x in own)
                if shared >= need:
                    found[i] = shared
        return found


def token_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many texts each token of the templates occurs, over all texts; a bounded result."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in text_bytes(batch):
                counts.update(vocabulary.intersection(words_of(text)))
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts]), pa.array(list(counts.values()), pa.int64())],
                                             names=["word", "n"])

    counted = map_partitions(docs.select(text_or_empty().alias("text")), run, "word string, n long")
    return {r.word.encode(): r.n for r in counted.groupBy("word").agg({"n": "sum"}).toDF("word", "n").collect()}


def _places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where the phrase's words stand consecutively."""
    n, out, at = len(phrase), [], 0
    while True:
        try:
            at = words.index(phrase[0], at)
        except ValueError:
            return out
        if words[at:at + n] == phrase:
            out.append(at)
        at += 1


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None,
         threshold: float = CONTAINMENT) -> DataFrame:
    """License labels of every row of ``docs``: ``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)``.

    Left side of the join: the blocks of each text (the whole text for phrases, its lines for templates) as token sets.
    Tokens are ordered by how many texts have them, counted over all texts. A block meets a template if it holds
    ``threshold`` of its different tokens; prefix, length and position filters leave few pairs to be counted, and lose
    none. The templates are constants of this module or the caller's, and go to every task; texts are not moved.

    A phrase counts wherever its words stand consecutively: ``n_base`` places, from ``first_word`` to ``last_word``
    (starts, from 0; null if none). ``labels`` adds the templates' labels; ``score`` is the greatest share of a template
    that a block holds, 1 for a phrase, 0 without a label. A null text is empty. Repeated rows stay repeated; further
    columns are ignored.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    vocabulary = {w for t in [*templates, *phrases] for w in words_of(t.encode())}
    joined = Templates(token_frequencies(docs, vocabulary), templates, phrases, threshold)
    n_phrases = len(joined.phrases)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def start():
        def one(text: bytes) -> tuple:
            words = words_of(text)
            whole = set(words)
            places, base, labels, score = [], set(), set(), 0.0
            if not joined.prefix.keys().isdisjoint(whole):
                for i in joined.candidates(whole):
                    if i < n_phrases:
                        here = _places(words, joined.phrases[i][0])
                        places += here
                        if here:
                            base.add(joined.labels[i])
                            score = 1.0
                for line in text.split(b"\n"):
                    for i, shared in joined.candidates(set(words_of(line))).items():
                        if i >= n_phrases:
                            labels.add(joined.labels[i])
                            score = max(score, shared / len(joined.sets[i]))
            return (len(words), len(places), min(places, default=None), max(places, default=None),
                    ",".join(sorted(base)), ",".join(sorted(base | labels)), score)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            rows = list(zip(*map(one, text_bytes(batch)))) or [()] * 7
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(rows, kinds))], names=names)

        return work

    texts = docs.select("doc_id", text_or_empty().alias("text"))
    return map_batches(texts, start, "doc_id long, n_words long, n_base long, first_word long, last_word long, "
                                     "base_labels string, labels string, score double")
